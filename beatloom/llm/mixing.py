"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in shuffled order, run through ``passes`` times. A
document's virtual finish time is the number of words its queue has sent when the document is
through, divided by the queue's target. All queues are merged by finish time and cut where the
budget is reached, so every source comes near its target at the same moment.

Defined cases: a null source is a source of its own, last in order; null text has size 0, and
documents of size 0 are never taken; an empty table gives no rows; rows with equal doc_id, text
and source stand together in their queue and are taken alike; further columns are kept by ``mixed_documents`` and ignored elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beatloom.llm.common import packed, stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE, PASSES = 1.5, 2
CELL_ROWS = 4_000


def draw():
    """The seeded shuffle key, 32 hex digits: equal for equal (doc_id, text) alone."""
    text = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    return F.md5(F.concat_ws("|", F.lit("mix"), F.col("doc_id").cast("string"), text).cast("binary"))


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, draw)."""
    return docs.select(
        "doc_id",
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        draw().alias("draw"),
    )


def targets(totals: DataFrame, weights=WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source. Weights go
    round by code point of the source; shares beyond ``passes`` times a source's size go to the
    others by weight. In order of size per weight, the level at which a source stops is what is
    left for it and all after it, per weight; the first that its own limit exceeds sets it for all."""
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    w = totals.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")).cast("long").alias("w"))
    w = w.withColumn("limit", F.col("source_size") * passes)
    order = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    w = w.select(
        "*",
        (F.sum("limit").over(order) - F.col("limit")).alias("_full"),
        (F.sum("w").over(whole) - F.sum("w").over(order) + F.col("w")).alias("_left"),
        (F.sum("source_size").over(whole) * share).alias("_budget"),
    )
    level = (F.col("_budget") - F.col("_full")) / F.col("_left")
    w = w.withColumn("_level", F.when(F.col("limit") / F.col("w") >= level, level))
    w = w.withColumn("_level", F.first("_level", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(F.col("limit").cast("double"), F.coalesce(F.col("w") * F.col("_level"), F.col("limit").cast("double")))
    return w.select("source", "source_size", target.alias("target"))


def schedule(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, passes: int = PASSES, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(doc_id, source, size, source_size, target, draw, turns) of every row of ``docs``;
    ``turns`` is how often the mix takes it, 0 to ``passes``.

    Running sums never see a whole source in one task: rows go to cells by the leading digits
    of their draw, are summed in a cell, and moved by the sums of the cells before. The merged
    order is treated alike: finish times fall into ranges, whole ranges before the cut are
    taken, and finish by finish is only summed in the range that holds the cut. Equal finish
    times are taken together or not at all."""
    rows = stored(sizes(docs), "mix-sizes")
    total, words = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    cells = max(1, -(-total // cell_rows))
    rows = rows.withColumn("_cell", F.floor(F.conv(F.substring("draw", 1, 8), 16, 10).cast("long") * cells / F.lit(2**32)).cast("long"))
    per_cell = rows.groupBy("source", "_cell").agg(F.sum("size").alias("_sum"))
    goal = targets(per_cell.groupBy("source").agg(F.sum("_sum").alias("source_size")), weights, share, passes)
    ahead = F.sum("_sum").over(Window.partitionBy("source").orderBy("_cell")) - F.col("_sum")
    known = per_cell.select("source", "_cell", ahead.alias("_ahead")).alias("a").join(goal.alias("g"), F.col("a.source").eqNullSafe(F.col("g.source")))
    known = known.select(F.col("a.source").alias("_source"), F.col("_cell").alias("_c"), "_ahead", "source_size", "target")
    queued = rows.withColumn("_sent", F.sum("size").over(Window.partitionBy("source", "_cell").orderBy("draw")))
    queued = queued.join(known, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_cell") == F.col("_c")))
    queued = queued.select("doc_id", "source", "size", "draw", (F.col("_sent") + F.col("_ahead")).alias("_sent"), "source_size", "target")
    queued = stored(queued, "mix-queues")
    live = (F.col("size") > 0) & (F.col("target") > 0)
    times = [(F.col("_sent") + p * F.col("source_size")) / F.col("target") for p in range(passes)]
    entries = queued.filter(live).select("size", F.explode(F.array(*times)).alias("finish"))
    entries = entries.withColumn("_range", F.floor(F.log2(F.col("finish") + 1) * cells).cast("long"))
    until = F.sum("_sum").over(Window.orderBy("_range"))
    ranges = entries.groupBy("_range").agg(F.sum("size").alias("_sum")).select("_range", until.alias("_until"), (until - F.col("_sum")).alias("_before"))
    budget = words * share
    edge = ranges.filter(F.col("_until") > budget).orderBy("_range").first()
    cut = None
    if edge is not None:
        near = entries.filter(F.col("_range") == edge["_range"]).groupBy("finish").agg(F.sum("size").alias("_sum"))
        near = near.select("finish", F.sum("_sum").over(Window.orderBy("finish")).alias("_until"))
        last = near.filter(F.col("_until") + edge["_before"] <= budget).agg(F.max("finish")).first()[0]
        in_edge = lambda t: t <= last if last is not None else F.lit(False)
        order = lambda t: F.floor(F.log2(t + 1) * cells).cast("long")
        cut = lambda t: (order(t) < edge["_range"]) | ((order(t) == edge["_range"]) & in_edge(t))
    turns = sum(((cut(t) if cut else F.lit(True)).cast("int") for t in times), F.lit(0))
    return queued.select("doc_id", "source", "size", "source_size", "target", "draw", F.when(live, turns).otherwise(0).alias("turns"))


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that the mix takes, whole, each as often as it is taken."""
    takes = schedule(docs, **settings).filter("turns > 0").select(F.col("draw").alias("_d"), F.col("source").alias("_s"), "turns").distinct()
    takes = takes.withColumnRenamed("turns", "_turns")
    full = packed(docs, draw().alias("_draw"), F.col("source").cast("string").alias("_source"))
    full = full.join(takes, (F.col("_draw") == F.col("_d")) & F.col("_source").eqNullSafe(F.col("_s")))
    return full.select("_row", F.explode(F.sequence(F.lit(1), F.col("_turns")))).select("_row.*")
