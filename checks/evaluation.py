"""Queries over forecasts and their truth."""

from pyspark.sql import functions as F

from checks.registry import check
from emberline.functions.surface import focal_loss, logit
from emberline.operators import ensembles as en, evaluation as ev, ranking
from emberline.session import durable, shared_folder
from emberline.sources import fixtures

BOTH = "event_cell_day predictions"
TRUTH = """
cum as (select *, max(case when fire_mask >= 0.5 then 1 else 0 end) over (
          partition by event_id, row, col order by day_idx) as y from event_cell_day),
anchor as (select event_id, coalesce(min(case when fire_mask >= 0.5 then day_idx end), min(day_idx)) as a0
           from event_cell_day group by event_id),
scored as (select p.model, c.event_id, c.day_idx, c.row, c.col, p.p, c.y::double as y
           from predictions p join cum c using (event_id, day_idx, row, col) join anchor using (event_id)
           where c.day_idx > a0)"""
BIN = "len(list_filter(range(1, 10), lambda i: i * 0.1::double < {0}))"
EVENT_METRICS = TRUTH + f""",
bins as (select model, event_id, {BIN.format('p')} as bin, count(*) as n, avg(p) as mp, avg(y) as my from scored group by all),
eces as (select model, event_id, sum(n * abs(mp - my)) / sum(n) as ece from bins group by all),
masks as (select model, event_id, avg((p - y) * (p - y)) as brier,
   count(*) filter (where p >= 0.5 and y = 1) as i, count(*) filter (where p >= 0.5 or y = 1) as u,
   count(*) filter (where p >= 0.5) as hp, count(*) filter (where y = 1) as hy from scored group by all),
per_event as (select m.model, m.event_id, case when u = 0 then 1.0::double else i / u::double end as iou,
   case when hp + hy = 0 then 1.0::double else 2 * i / (hp + hy)::double end as dice, brier, ece
   from masks m join eces e using (model, event_id))"""
LONG = EVENT_METRICS + """,
long as (select model, event_id, unnest(['iou', 'dice', 'brier', 'ece']) as metric, unnest([iou, dice, brier, ece]) as value from per_event),
pos as (select *, row_number() over (partition by model order by sha256('42|' || event_id)) - 1 as pos,
          count(*) over (partition by model) as n from per_event),
draw as (select model, r, ('0x' || substr(sha256('42|' || r || '|' || pos), 1, 8))::bigint % n as pick
         from pos cross join range(1, 1001) t(r)),
reps as (select d.model, d.r, avg(iou) as iou, avg(dice) as dice, avg(brier) as brier, avg(ece) as ece
         from draw d join pos p on p.model = d.model and p.pos = d.pick group by all),
rlong as (select model, unnest(['iou', 'dice', 'brier', 'ece']) as metric, unnest([iou, dice, brier, ece]) as value from reps),
ends as (select model, metric, quantile_cont(value, 0.025) as lower, quantile_cont(value, 0.975) as upper from rlong group by all),
agg as (select l.model, l.metric, avg(l.value) as point, any_value(e.lower) as lower, any_value(e.upper) as upper
        from long l join ends e using (model, metric) group by l.model, l.metric)"""
PAIRS = TRUTH + """,
pairs as (select a.event_id, a.day_idx, a.row, a.col, a.p as pa, b.p as pb, a.y, case a.event_id % 3 when 0 then 'train' when 1 then 'val' else 'test' end as split
          from scored a join scored b using (event_id, day_idx, row, col) where a.model = 'a' and b.model = 'b')"""
CLIPPED = "least(greatest({0}, 0), 1)"


def state(spark, d):
    return fixtures.event_cell_day(spark, d)


def scored(spark, d):
    return ev.score_join(fixtures.predictions(spark, d), ev.truth_cells(state(spark, d)))


def per_event(spark, d):
    return ev.event_metrics(scored(spark, d))


def pairs(spark, d):
    s = scored(spark, d)
    one = lambda m: s.filter(F.col("model") == m)
    return en.paired(one("a"), one("b")).withColumn("split", split_of("event_id"))


def split_of(c):
    k = F.col(c) % 3
    return F.when(k == 0, "train").when(k == 1, "val").otherwise("test")


CELL = "event_id:i day_idx:i row:i col:i"


@check("w1_cumulative_burn", CELL + " burned:i", "event_cell_day", TRUTH.split("anchor as")[0].rstrip(", \n") + """,
result as (select *, y as burned from cum)""")
def _(spark, d):
    return ev.cumulative_burn(state(spark, d))


@check("w2_monotone_probability", "model:s " + CELL + " p_mono:f", "predictions", """
result as (select *, max(least(greatest(p, 0), 1)) over (partition by model, event_id, row, col order by day_idx) as p_mono
  from predictions)""")
def _(spark, d):
    return ev.monotone_probability(fixtures.predictions(spark, d))


@check("f4_trim_to_first_fire_day", CELL + " fire_mask:f", "event_cell_day", """
f as (select event_id, min(day_idx) filter (where fire_mask >= 0.5) as f from event_cell_day group by 1),
result as (select e.* from event_cell_day e join f using (event_id) where f is null or day_idx >= f)""")
def _(spark, d):
    return ev.trim_to_first_fire_day(state(spark, d))


@check("f5_exclude_anchor_day", CELL, "event_cell_day", """
f as (select event_id, min(day_idx) as f from event_cell_day group by 1),
result as (select e.* from event_cell_day e join f using (event_id) where day_idx > f)""")
def _(spark, d):
    return ev.exclude_anchor_day(state(spark, d))


@check("f12_validate_prediction", "model:s event_id:i fault:s", BOTH, TRUTH + """,
strange as (select p.model, p.event_id, p.day_idx + 0 as day_idx, p.row, p.col, case when p.model = 'b' then p.p * 1.5 else p.p end as p from predictions p),
sets as (select model, event_id, max(p) as hi from strange join anchor using (event_id) where day_idx > a0 group by all),
result as (select model, event_id, 'probability outside [0, 1]' as fault from sets where hi > 1)""")
def _(spark, d):
    worse = fixtures.predictions(spark, d).withColumn("p", F.when(F.col("model") == "b", F.col("p") * 1.5).otherwise(F.col("p")))
    return ev.prediction_faults(worse, ev.truth_cells(state(spark, d)))


@check("j14_score_join", "model:s " + CELL + " p:f y:f", BOTH, TRUTH + ", result as (select * from scored)")
def _(spark, d):
    return scored(spark, d)


@check("a8_iou_dice", "model:s event_id:i iou:f dice:f", BOTH, EVENT_METRICS + ", result as (select * from per_event)")
def _(spark, d):
    return per_event(spark, d)


@check("a9_brier", "model:s event_id:i brier:f", BOTH, TRUTH + """,
result as (select model, event_id, avg(power(p - y, 2)) as brier from scored group by all)""")
def _(spark, d):
    return per_event(spark, d)


@check("a10_ece", "model:s event_id:i ece:f", BOTH, EVENT_METRICS + ", result as (select * from eces)")
def _(spark, d):
    return per_event(spark, d)


@check("a11_reliability_bins", "model:s bin:i lo:f hi:f count:i mean_pred:f mean_true:f", BOTH, TRUTH + f""",
b as (select model, {BIN.format('p')} as bin, count(*) as n, avg(p) as mp, avg(y) as my from scored group by all),
frame as (select distinct model, bin from scored cross join range(10) t(bin)),
result as (select f.model, f.bin, f.bin / 10.0::double as lo, (f.bin + 1) / 10.0::double as hi, coalesce(n, 0) as count,
  mp as mean_pred, my as mean_true from frame f left join b using (model, bin))""")
def _(spark, d):
    return ev.reliability_bins(scored(spark, d), ["model"])


@check("a12_backtest", "model:s event_id:i iou:f dice:f brier:f ece:f", BOTH, EVENT_METRICS + ", result as (select * from per_event)")
def _(spark, d):
    return ev.backtest(fixtures.predictions(spark, d), state(spark, d))[0]


@check("a12_aggregate_metrics", "model:s metric:s point:f", BOTH, LONG + ", result as (select * from agg)")
def _(spark, d):
    return ev.aggregate_metrics(per_event(spark, d))


@check("a13_bootstrap_ci", "model:s metric:s point:f lower:f upper:f", BOTH, LONG + ", result as (select * from agg)")
def _(spark, d):
    return ev.bootstrap_ci(per_event(spark, d))


@check("a25_burned_cells_by_day", "model:s event_id:i day_idx:i cells:i", "predictions", """
result as (select model, event_id, day_idx, count(*) filter (where p >= 0.5) as cells from predictions group by all)""")
def _(spark, d):
    return ev.burned_cells_by_day(fixtures.predictions(spark, d))


@check("j16_resolve_event_pk", "model:s event_id:i event_pk:i", BOTH, EVENT_METRICS + """,
result as (select model, event_id, event_id * 10 + 7 as event_pk from per_event)""")
def _(spark, d):
    events = state(spark, d).select(F.col("event_id").alias("firms_event_id"), (F.col("event_id") * 10 + 7).alias("id")).distinct()
    return ev.resolve_event_pk(per_event(spark, d), events)


@check("u1_register_model", "model:s " + CELL + " p:f", "event_cell_day", """
result as (select m as model, event_id, day_idx, row, col, case when m = 'persistence' then fire_mask
  else least(1, sqrt(wind_u * wind_u + wind_v * wind_v) / 10) end as p
  from event_cell_day cross join (values ('persistence'), ('windy')) t(m))""")
def _(spark, d):
    models = {}
    ev.register_model(models, "persistence", lambda c: c.withColumn("p", F.col("fire_mask")))
    ev.register_model(models, "windy", lambda c: c.withColumn("p", F.least(F.lit(1.0), F.hypot("wind_u", "wind_v") / 10)))
    return ev.predict_all(models, state(spark, d))


# ---------------------------------------------------------------- ensembles and calibration
@check("x18_logit", "model:s " + CELL + " z:f", "predictions", """
c as (select *, least(greatest(p, 1e-6), 1 - 1e-6) as q from predictions),
result as (select *, ln(q / (1 - q)) as z from c)""")
def _(spark, d):
    return fixtures.predictions(spark, d).withColumn("z", logit("p"))


@check("x29_focal_loss", "model:s loss:f", BOTH, TRUTH + """,
z as (select model, y, ln(least(greatest(p, 1e-6), 1 - 1e-6) / (1 - least(greatest(p, 1e-6), 1 - 1e-6))) as z from scored),
q as (select model, y, 1 / (1 + exp(-z)) as s from z),
result as (select model, avg(case when y = 1 then 0.8 * power(1 - s, 2) * -ln(s) else 0.2 * power(s, 2) * -ln(1 - s) end) as loss
  from q group by model)""")
def _(spark, d):
    return scored(spark, d).groupBy("model").agg(F.avg(focal_loss(logit("p"), "y")).alias("loss"))


@check("n4_blend", CELL + " p:f", "predictions", """
result as (select a.event_id, a.day_idx, a.row, a.col, least(greatest(0.3 * a.p + 0.7 * b.p, 0), 1) as p
  from predictions a join predictions b using (event_id, day_idx, row, col) where a.model = 'a' and b.model = 'b')""")
def _(spark, d):
    p = fixtures.predictions(spark, d)
    return en.blend(p.filter("model = 'a'"), p.filter("model = 'b'"), 0.7)


@check("a17_select_blend_weight", "weight:f brier:f chosen:i", BOTH, PAIRS + """,
w as (select i / 10.0::double as weight, event_id, avg(power((1 - i / 10.0::double) * pa + i / 10.0::double * pb - y, 2)) as b
      from pairs cross join range(11) t(i) where split = 'val' group by i, event_id),
m as (select weight, avg(b) as brier from w group by weight),
result as (select *, (weight = (select min_by(weight, (round(brier, 12), weight)) from m))::int as chosen from m)""")
def _(spark, d):
    val = durable(pairs(spark, d).filter("split = 'val'"))
    best = en.select_blend_weight(val)
    return en.blend_scores(val).withColumn("chosen", (F.col("weight") == best).cast("int"))


@check("n5_stacking", CELL + " p:f")
def _(spark, d):
    p = durable(pairs(spark, d))
    return en.stack(en.fit_stacking(p.filter("split = 'val'")), p)


ISOTONIC = PAIRS + """,
lv as (select pb as p, avg(y) as m, count(*) as n from pairs where split = 'val' group by pb),
numbered as (select *, row_number() over (order by p) as i, sum(n) over (order by p) as cn, sum(n * m) over (order by p) as cs from lv),
prefix as (select i, cn, cs from numbered union all select 0, 0, 0),
blocks as (select a.i + 1 as a, b.i as b, (b.cs - a.cs) / (b.cn - a.cn) as mean from prefix a join prefix b on b.i > a.i),
tail as (select n.i, k.a, min(k.mean) as low from numbered n join blocks k on k.a <= n.i and k.b >= n.i group by all),
fit as (select n.p, max(t.low) as q from tail t join numbered n on n.i = t.i group by all),
cal as (select s.*, s.pb as p, coalesce(f.q, case when s.pb < (select min(p) from fit) then (select min(q) from fit)
          when s.pb > (select max(p) from fit) then (select max(q) from fit) end,
          (select lo.q + (hi.q - lo.q) * (s.pb - lo.p) / (hi.p - lo.p) from fit lo, fit hi
           where lo.p = (select max(p) from fit where p < s.pb) and hi.p = (select min(p) from fit where p > s.pb))) as q
        from pairs s left join fit f on f.p = s.pb)"""


def calibrated(spark, d):
    p = durable(pairs(spark, d).withColumn("p", F.col("pb")))
    return en.calibrate(p, en.fit_isotonic(p.filter("split = 'val'"), "b-1"), "b-1")


@check("n6_isotonic_calibration", CELL + " q:f", BOTH, ISOTONIC + ", result as (select * from cal)")
def _(spark, d):
    return calibrated(spark, d)


@check("n7_calibration_report", "split:s n:i brier_raw:f brier_cal:f ece_raw:f ece_cal:f", BOTH, ISOTONIC + f""",
br as (select split, count(*) as n, avg(power(p - y, 2)) as brier_raw, avg(power(q - y, 2)) as brier_cal from cal group by split),
eb as (select split, k, sum(n * abs(mp - my)) / sum(n) as e from (
   select split, k, {BIN.format('v')} as bin, count(*) as n, avg(v) as mp, avg(y) as my
   from (select split, y, unnest(['raw', 'cal']) as k, unnest([p, q]) as v from cal) x group by all) z group by all),
result as (select br.*, r.e as ece_raw, c.e as ece_cal from br join eb r on r.split = br.split and r.k = 'raw'
  join eb c on c.split = br.split and c.k = 'cal')""")
def _(spark, d):
    return en.calibration_report(calibrated(spark, d), ["split"])


@check("n8_calibrator_lineage", "lineage:s refused:i n:i", BOTH, PAIRS + ", result as (select 'b-1' as lineage, 1 as refused, count(*) as n from pairs)")
def _(spark, d):
    p = durable(pairs(spark, d).withColumn("p", F.col("pb")))
    path = shared_folder(spark, "calibrator")
    en.save_calibrator(en.fit_isotonic(p.filter("split = 'val'"), "b-1"), path)
    cal = en.load_calibrator(spark, path, "b-1")
    try:
        en.load_calibrator(spark, path, "b-2")
        refused = 0
    except ValueError:
        refused = 1
    return en.calibrate(p, cal, "b-1").agg(F.count("*").alias("n")).withColumns(
        {"lineage": F.lit(cal.lineage), "refused": F.lit(refused)})


@check("o2_exact_median_of_scores", "model:s median:f", "predictions", """
result as (select model, quantile_cont(p, 0.5) as median from predictions group by model)""")
def _(spark, d):
    return ranking.exact_median(fixtures.predictions(spark, d), ["model"], "p")
