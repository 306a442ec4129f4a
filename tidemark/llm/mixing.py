"""Mixing sources to target weights by weighted fair queueing.

Every document gets a virtual finish time: the tokens of its source so far, in
shuffled order, divided by the source's target.  All documents are then
range-sorted by that time and cut where the total budget is reached.  A source
whose target is above its size is dealt again in further passes, at most
``max_repeats`` in all, so no document is taken more often than that.

Neither step runs a window over a whole source: running totals come from
range-partitioned partial sums (:func:`shared.running_total`), so one source may
hold most of the rows.  Only per-source totals reach the driver: one row for each
source, whatever the number of documents.

Defined results: null text has size 0; a null source is a source of its own,
ordered last; documents of size 0 are never taken; repeated rows are separate
documents, of one id ordered by size and text; an empty table
gives an empty mix; extra columns are carried through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise, running_total

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of matches of WORD; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fair_targets(sizes: dict[str | None, int], weights: Sequence[float], share: float, max_repeats: int) -> dict[str | None, float]:
    """Each source's target: its weight's part of the budget, at most ``max_repeats`` times its size.

    What a capped source can't use is shared again by weight among the others,
    until none is above its cap.
    """
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(names)}
    cap = {s: float(max_repeats * sizes[s]) for s in names}
    left = share * sum(sizes.values())
    target: dict[str | None, float] = {}
    open_ = list(names)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if unit * weight[s] > cap[s]]
        if not full:
            target |= {s: unit * weight[s] for s in open_}
            break
        for s in full:
            target[s] = cap[s]
            left -= cap[s]
        open_ = [s for s in open_ if s not in target]
        left = max(left, 0.0)
    return target


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.0,
    max_repeats: int = 3,
    seed: int = 17,
    size: Column | None = None,
    row_key: Column | None = None,
) -> DataFrame:
    """One row per document: id, size, source_size, target, copies, taken; and row_key, if it is given."""
    spark = docs.sparkSession
    key = F.lit(None) if row_key is None else row_key
    slim = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), (word_count(F.col(text_col)) if size is None else size).alias("_size"), F.xxhash64(text_col).alias("_text"), key.alias("_key"))
    # Sizes are counted once: the ranges below are sampled from the written table.
    sized = materialise(slim, "mix-sizes")
    # Rows of one id are ordered by text.
    order = [F.xxhash64("_id", F.lit(seed)), F.col("_id").asc_nulls_last(), F.col("_size"), F.col("_text")]
    dealt = running_total(sized, order, "_size", "_cum", group="_source", name="mix-dealt").select("_row", "_id", "_source", "_size", "_key", "_cum")
    dealt = materialise(dealt, "mix-cumulated")
    totals = {r["_source"]: int(r["n"]) for r in dealt.groupBy("_source").agg(F.sum("_size").alias("n")).collect()}
    target = fair_targets(totals, weights, share, max_repeats)
    budget = int(share * sum(totals.values()))
    plan = spark.createDataFrame([(s, totals[s], float(target[s])) for s in totals], "_s string, _total long, _target double")
    known = dealt.join(F.broadcast(plan), F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")
    # One pass more than the target needs: the cut is by the total budget, not by source.
    passes = F.least(F.lit(max_repeats), F.floor(F.col("_target") / F.col("_total")) + 1).cast("int")
    copies = known.filter("_size > 0 and _target > 0").withColumn("_pass", F.explode(F.sequence(F.lit(0), passes - 1)))
    timed = copies.select("_row", "_size", "_pass", ((F.col("_pass") * F.col("_total") + F.col("_cum")) / F.col("_target")).alias("_finish"))
    timed = timed.withColumnRenamed("_row", "_doc")
    queue = running_total(timed, [F.col("_finish"), F.col("_doc"), F.col("_pass")], "_size", "_through", name="mix-queue")
    taken = queue.filter(F.col("_through") <= budget).groupBy("_doc").agg(F.count("*").alias("_copies"))
    out = known.join(taken, F.col("_row") == F.col("_doc"), "left")
    copies_taken = F.coalesce("_copies", F.lit(0))
    return out.select(
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        F.col("_total").alias("source_size"),
        F.col("_target").alias("target"),
        copies_taken.alias("copies"),
        (copies_taken * F.col("_size")).alias("taken"),
        *([] if row_key is None else [F.col("_key").alias("row_key")]),
    )


def mixed_documents(docs: DataFrame, row_key: Column | None = None, **how) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with their columns.

    ``row_key`` tells the rows of ``docs`` apart whatever their ids, the same each
    time they are read, as file and position of Parquet rows do; without it the
    rows are written first.  Other arguments are those of :func:`mix`.
    """
    if row_key is None:
        docs = materialise(docs.withColumn("_tm_row", F.monotonically_increasing_id()), "mix-rows")
        columns, row_key = docs.columns[:-1], F.col("_tm_row")
    else:
        columns = docs.columns
    often = mix(docs, row_key=row_key, **how).filter("copies > 0").select(F.col("row_key").alias("_tm_key"), F.col("copies").alias("_tm_copies"))
    keyed = docs.withColumn("_tm_of", row_key)
    joined = keyed.join(often, F.col("_tm_of") == F.col("_tm_key"))
    return joined.withColumn("_tm_pass", F.explode(F.sequence(F.lit(1), F.col("_tm_copies").cast("int")))).select(*[F.col(f"`{c}`") for c in columns])
