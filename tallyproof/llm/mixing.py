"""Mixing sources to target weights by weighted fair queueing.

Every document is a packet of its source's queue, in an order shuffled by a hash. It is given a virtual
finish time: the words of its source up to and including it, divided by the source's target. Packets of
all queues are then sorted by that time and taken until the total budget is used up, so that each source
has sent about its target when the mix ends. A source whose target is above its size goes round its
queue again, at most ``max_repeats`` times in all.

**Targets.** Sources in code-point order, null last, weigh 5, 2, 1, 5, 2, 1, ... A target is the
source's share of the budget by weight, at most ``max_repeats`` times its size; what is above is shared
again by weight among the others until none is above.

Only DataFrame operations are used. Running sums are made without a task that sees a whole source: a
range sort deals rows out in order, each piece is summed, and a row's sum is that of its own piece up to
it plus those of the pieces before. Ties and repeated rows are ordered by a hash of id and text, so
reruns agree.

Defined cases: a null text has size 0; documents of size 0, and all documents of a source without words,
are never taken; a null source is a source of its own; equal rows are separate packets; an empty table
gives an empty table; only the id, the text and the source are read from the table, so other columns
never clash.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyproof.llm.common import WORD, content_keys, pick, text_of
from tallyproof.session import delete_path, number_rows, stored

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3


def targets(
    sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, max_repeats: int = MAX_REPEATS
) -> tuple[DataFrame, float]:
    """``(source, source_size, weight, target)`` of ``sizes(source, source_size)``, and the budget.

    Each turn of the loop brings one row of sums to the driver; a turn that caps no further source
    is the last.
    """
    ranked = number_rows(sizes, F.col("source").isNull(), F.col("source"), name="_rank")
    place = ((F.col("_rank") - 1) % len(weights)).cast("int")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place + 1)
    ranked = stored(ranked.select("source", "source_size", weight.alias("weight")), "sources")
    cap = (F.col("source_size") * max_repeats).cast("double")
    budget = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    rate, capped = 0.0, -1
    while True:
        above = (F.lit(rate) * F.col("weight") > cap) if capped >= 0 else F.lit(False)
        fixed, open_weight, count = ranked.agg(
            F.coalesce(F.sum(F.when(above, cap)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)),
            F.count(F.when(above, F.lit(1))),
        ).first()
        if count == capped:
            break
        capped = count
        rate = (budget - fixed) / open_weight if open_weight else math.inf
    target = F.least(F.lit(rate) * F.col("weight"), cap)
    return ranked.withColumn("target", target), budget


def _running(df: DataFrame, order: list, value: str, within: list[str], made: list[str]) -> DataFrame:
    """``df`` with ``upto``: the sum of ``value`` up to and including each row in the total order
    ``order``, which begins with the columns ``within`` that the sum starts anew for."""
    mid = F.monotonically_increasing_id()
    piece, place = F.shiftright(mid, 33), mid.bitwiseAND(F.lit((1 << 33) - 1))
    rows = stored(df.orderBy(*order).withColumns({"_piece": piece, "_place": place}), "ordered", made)
    sums = rows.groupBy("_piece", *within).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*within).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_piece", *within, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    own = Window.partitionBy("_piece", *within).orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("_own", F.sum(value).over(own)).alias("r")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in ("_piece", *within)]
    return summed.join(starts.alias("s"), same).select(
        *[F.col(f"r.{c}") for c in df.columns], (F.col("r._own") + F.col("s._start")).alias("upto")
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.0,
    max_repeats: int = MAX_REPEATS,
    seed: str = "42",
) -> DataFrame:
    """A row per row of ``docs``: its content keys, ``source``, ``size``, ``source_size``,
    ``target`` of its source, and ``taken``: the words the mix takes, repeats counted."""
    made: list[str] = []
    text = text_of(text_col)
    ident = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null"))
    rows = stored(
        docs.select(
            *content_keys(id_col, text_col),
            F.col(f"`{source_col}`").cast("string").alias("source"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
            F.md5(F.concat_ws("-", F.lit(seed), ident, F.md5(text.cast("binary"))).cast("binary")).alias("shuffled"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "sizes",
    )
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    of_source, budget = targets(sizes, weights, share, max_repeats)

    queued = _running(
        rows.filter("size > 0").select("row", "source", "size", "shuffled"),
        [F.col("source").isNull(), "source", "shuffled", "row"],
        "size",
        ["source"],
        made,
    )
    known = of_source.filter("target > 0").select(F.col("source").alias("_source"), "source_size", "target")
    turns = F.least(F.lit(max_repeats), F.floor(F.col("target") / F.col("source_size")) + 1).cast("int")
    packets = (
        queued.join(known, F.col("source").eqNullSafe(F.col("_source")))
        .select("*", F.explode(F.sequence(F.lit(0), turns - 1)).alias("turn"))
        .withColumn("finish", (F.col("turn") * F.col("source_size") + F.col("upto")) / F.col("target"))
        .select("row", "source", "size", "shuffled", "turn", "finish")
    )
    order = ["finish", F.col("source").isNull(), "source", "shuffled", "turn", "row"]
    sent = _running(packets.withColumn("_all", F.lit(0)), ["_all", *order], "size", ["_all"], made)
    taken = sent.filter(F.col("upto") <= F.lit(budget)).groupBy("row").agg(F.sum("size").alias("taken"))
    taken = stored(taken, "taken")
    for path in made:
        delete_path(docs.sparkSession, path)
    named = of_source.select(F.col("source").alias("_source"), "source_size", "target")
    return (
        rows.join(taken, "row", "left")
        .join(named, F.col("source").eqNullSafe(F.col("_source")))
        .select("_k_id", "_k_a", "_k_b", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken."""
    rows = mix(docs, id_col, text_col, source_col, **options)
    chosen = rows.groupBy("_k_id", "_k_a", "_k_b").agg(
        F.count("*").alias("_k_n"), F.sum(F.expr("if(size = 0, 0, cast(taken / size as int))")).alias("_k_copies")
    )
    return pick(docs, stored(chosen.filter("_k_copies > 0"), "chosen"), id_col, text_col)
