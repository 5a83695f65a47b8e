"""Chat formatting: collapse logged snapshots of growing conversations, then render what is left."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

SPAN = 1024  # turn numbers in one bucket of the two-level running sums


def turn_prefixes(turns: DataFrame) -> DataFrame:
    """Every distinct turn with its rank in the conversation (from 1) and the rolling hashes `p1`, `p2`, `p3`, `p4` of all up to it.

    A turn's digest covers its rank, role and text, so the sum of digests names an ordered prefix. The digest has
    four parts of 32 bits, whose sums cannot overflow. Ranks and sums take two levels, inside spans of
    turn numbers and over the spans, so a conversation of any length is never one task.
    """
    keys = ["conv_id", "span"]
    turns = (turns.select("conv_id", "turn", "role", "text").distinct()
             .withColumn("span", F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / SPAN)))
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]
    inside = Window.partitionBy(*keys).orderBy(*order)
    spans = turns.groupBy(*keys).agg(F.count("*").alias("n"))
    over = Window.partitionBy("conv_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    ahead = spans.select(F.col("conv_id").alias("c"), F.col("span").alias("s"), F.coalesce(F.sum("n").over(over), F.lit(0)).alias("ahead"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("span") == F.col("s"))
    ranked = turns.join(ahead, same).drop("c", "s").withColumn("rank", F.col("ahead") + F.row_number().over(inside)).drop("ahead")
    parts = []
    for i in (0, 1):
        h = F.xxhash64("rank", "role", "text", F.col("role").isNull(), F.col("text").isNull(), F.lit(i))
        parts += [F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF))]
    for i, h in enumerate(parts, 1):
        ranked = ranked.withColumn(f"h{i}", h)
    sums = ranked.groupBy(*keys).agg(*[F.sum(f"h{i}").alias(f"s{i}") for i in range(1, 5)])
    sums = sums.select(F.col("conv_id").alias("c"), F.col("span").alias("s"), *[
        F.coalesce(F.sum(f"s{i}").over(over), F.lit(0)).alias(f"b{i}") for i in range(1, 5)])
    rows = Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.join(sums, same).select("conv_id", "turn", "role", "text", "rank", *[
        (F.col(f"b{i}") + F.sum(f"h{i}").over(rows)).alias(f"p{i}") for i in range(1, 5)])


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, copies) of the conversations that no longer one begins with.

    Of equal conversations the smallest conv_id stays (null after all others), with their number in `copies`.
    """
    from emberline.llm.common import stored
    p = stored(turn_prefixes(turns).select("conv_id", "rank", "p1", "p2", "p3", "p4"), "prefixes")
    length = p.groupBy("conv_id").agg(F.max("rank").alias("n"))
    length = length.withColumnRenamed("conv_id", "c")
    marked = p.join(length, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    state = ["rank", "p1", "p2", "p3", "p4"]
    whole = marked.filter(F.col("rank") == F.col("n")).groupBy(*state).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    begun = marked.filter(F.col("rank") < F.col("n")).select(*state).distinct()
    return whole.join(begun, state, "left_anti").select("conv_id", F.col("rank").alias("n_turns"), "copies")


def rendered_turns(turns: DataFrame, start: str = "<|im_start|>", end: str = "<|im_end|>") -> DataFrame:
    """(conv_id, n_turns, copies, rank, piece): the kept conversations turn by turn in chat markup.

    The pieces of a conversation joined by rank are its transcript. They stay rows, so that a conversation of any
    length can be written. Turns go by number, null first; ties by role and text. Repeated rows are
    one turn. A null role renders as `user`, a null text as nothing, a marker inside a text with a blank before its last bar, so that
    no text can end its turn. A null conv_id is a conversation of its own. An empty table gives no rows; more columns are ignored.
    """
    kept = maximal_conversations(turns).withColumnRenamed("conv_id", "c")
    safe = F.coalesce(F.col("text"), F.lit(""))
    for mark in (start, end):
        safe = F.replace(safe, F.lit(mark), F.lit(mark[:-2] + " " + mark[-2:]))
    piece = F.concat(F.lit(start), F.coalesce(F.col("role"), F.lit("user")), F.lit("\n"), safe, F.lit(end + "\n"))
    ranked = turn_prefixes(turns).select("conv_id", "rank", piece.alias("piece"))
    return (ranked.join(kept, F.col("conv_id").eqNullSafe(F.col("c")))
            .select("conv_id", "n_turns", "copies", "rank", "piece"))
