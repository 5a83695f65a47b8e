"""Registered models -> validated scores, intervals and report tables of one split."""

from __future__ import annotations

from typing import Callable, NamedTuple

from pyspark.sql import DataFrame

from emberline.operators import evaluation as ev, reporting
from emberline.session import durable
from emberline.sources.tables import load_split_cells


class Backtest(NamedTuple):
    per_event: DataFrame
    aggregate: DataFrame
    best: DataFrame
    failing: DataFrame


def run_backtest(models: dict[str, Callable[[DataFrame], DataFrame]], cells: DataFrame, split: DataFrame,
                 name: str = "test", draws: int = 1000, seed: int = 42) -> Backtest:
    """Score every model on the trimmed events of one split."""
    state = durable(load_split_cells(cells, split, name))
    pred = durable(ev.predict_all(models, state))
    per_event, agg = ev.backtest(pred, state, draws, seed)
    per_event, agg = durable(per_event), durable(agg)
    order = list(models)
    return Backtest(per_event, agg, reporting.best_model_per_metric(agg, order), reporting.failing_cases(per_event))
