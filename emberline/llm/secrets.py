"""Secret scans: named patterns, and sliding-window Shannon entropy of candidate strings, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from emberline.llm.common import row_key

# Fixed patterns of the base kinds, in their order.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # runs are whole, so those of fewer characters need not be matched first
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Bits a window must reach: strings of hexadecimal digits, and others.
THRESHOLDS = {"hex": 3.0, "mixed": 3.7}
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
ALLOWED = (r"(?i)example|sample|dummy|placeholder|changeme|0123456789|abcdefghij"
           r"|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
KINDS = ("assign", "access", "hex", "entropy")


def _pieces(hits: DataFrame, kind: str, pattern: str, group: int) -> DataFrame:
    """(key, kind, start, end, size, said): every match of `pattern`, placed by the lengths of what lies between the matches."""
    some = hits.filter(F.col("text").rlike(pattern))
    lens = lambda c: F.transform(c, F.length)
    every = lambda g: F.regexp_extract_all("text", F.lit(pattern), F.lit(g))
    found = some.select("key", F.posexplode(F.arrays_zip(
        lens(F.split("text", pattern, -1)).alias("gap"), lens(every(0)).alias("len"), lens(every(group)).alias("size"), every(0).alias("said"))).alias("i", "z"))
    order = Window.partitionBy("key").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("z.gap") + F.coalesce(F.col("z.len"), F.lit(0))).over(order)
    return (found.withColumn("end", end).filter(F.col("z.len").isNotNull())
            .select("key", F.lit(KINDS.index(kind)).alias("rank"), (F.col("end") - F.col("z.len")).alias("start"), "end",
                    F.col("z.size").alias("size"), F.col("z.said").alias("said")))


def window_entropy(text: Column, width: int = WINDOW) -> Column:
    """The largest entropy, in bits, of `width` characters in a row, by counts that change with the character that enters and the one that leaves."""
    at = F.transform(F.split(text, "", -1), lambda c: F.instr(F.lit(ALPHABET), c))
    at = F.filter(at, lambda i: i >= 0)
    plogp = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(width + 1)])
    f = lambda n: F.element_at(plogp, n + 1)
    zero = F.struct(F.array_repeat(F.lit(0), len(ALPHABET) + 1).alias("n"), F.lit(0.0).alias("s"), F.lit(-1.0).alias("best"), at.alias("at"))  # the characters ride along, else every step would split anew

    def step(state, i):
        new = F.element_at(state["at"], i)
        old = F.when(i > width, F.element_at(state["at"], F.greatest(i - width, F.lit(1)))).otherwise(F.lit(-1))
        n_old = F.when(old >= 0, F.element_at(state["n"], F.greatest(old, F.lit(0)) + 1)).otherwise(F.lit(0))
        s = F.when(old >= 0, state["s"] + f(F.greatest(n_old - 1, F.lit(0))) - f(n_old)).otherwise(state["s"])
        n_new = F.element_at(state["n"], new + 1) - F.when(old == new, F.lit(1)).otherwise(F.lit(0))
        s = s + f(n_new + 1) - f(n_new)
        counts = F.transform(state["n"], lambda c, j: c - (j == old).cast("int") + (j == new).cast("int"))
        best = F.when(i >= width, F.greatest(state["best"], F.lit(math.log2(width)) - s / width)).otherwise(state["best"])
        return F.struct(counts.alias("n"), s.alias("s"), best.alias("best"), state["at"].alias("at"))

    return F.aggregate(F.sequence(F.lit(1), F.length(text)), zero, step, lambda state: state["best"])


def secret_spans(docs: DataFrame) -> DataFrame:
    """(key, rank, start, end): spans of secrets in code points, end exclusive; rank numbers KINDS.

    Base kinds are the fixed patterns. `entropy` adds strings of 20 and more characters with letters and digits of which
    some window reaches the threshold of its character class, unless the allow list knows them or a base span overlaps them.
    """
    worth = F.col("text").rlike(ASSIGN) | F.col("text").rlike(ACCESS) | F.col("text").rlike(HEX) | (
        F.col("text").rlike("[0-9]") & F.col("text").rlike(CANDIDATE))
    hits = docs.filter(worth).select(row_key("doc_id", "text").alias("key"), "text").dropDuplicates(["key"])
    base = (_pieces(hits, "assign", ASSIGN, 2).filter("size >= 6")
            .unionByName(_pieces(hits, "access", ACCESS, 0).filter("size >= 20")).unionByName(_pieces(hits, "hex", HEX, 0).filter("size >= 24")))
    said = F.col("said")
    needed = F.when(said.rlike("^[0-9A-Fa-f]+$"), F.lit(THRESHOLDS["hex"])).otherwise(F.lit(THRESHOLDS["mixed"]))
    more = (_pieces(hits, "entropy", CANDIDATE, 0).filter(said.rlike("[0-9]") & said.rlike("[A-Za-z]") & ~said.rlike(ALLOWED))
            .filter(window_entropy(said) >= needed))
    both = base.unionByName(more).select("key", "rank", "start", "end")
    is_base = F.col("rank") < 3
    by = Window.partitionBy("key").orderBy("start", "rank")
    before = F.max(F.when(is_base, F.col("end"))).over(by.rowsBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(is_base, F.col("start"))).over(by.rowsBetween(0, Window.unboundedFollowing))
    return (both.withColumn("before", before).withColumn("after", after)
            .filter(is_base | ((F.coalesce("before", F.lit(0)) <= F.col("start")) & (F.coalesce("after", F.col("end")) >= F.col("end"))))
            .drop("before", "after"))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_entropy, base, spans) per row of `docs`; base and spans are arrays of `kind:start:end` by start, then kind.

    Null and empty texts have no spans; repeated rows are scanned alike; further columns are not read.
    """
    names = F.array(*[F.lit(k) for k in KINDS])
    label = lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    per = secret_spans(docs).groupBy("key").agg(
        *[F.sum((F.col("rank") == i).cast("long")).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sort_array(F.collect_list(F.struct("start", "rank", "end"))).alias("all"))
    per = per.select("key", *[f"n_{k}" for k in KINDS], F.transform(F.filter("all", lambda s: s["rank"] < 3), label).alias("base"),
                     F.transform("all", label).alias("spans"))
    rows = docs.select(row_key("doc_id", "text").alias("key"), "doc_id").join(per, "key", "left")
    none = F.array().cast("array<string>")
    return rows.select("doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
                       F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"))
