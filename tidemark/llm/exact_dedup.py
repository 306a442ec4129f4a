"""Exact dedup by content sort.

Sampled splitters range-partition the normalised texts, Spark's external sort
puts equal texts side by side, and neighbours are compared in full.  Splitters
are sampled from the first bytes of a text, a 64-bit hash that stands for the
rest, and the id: so they stay small however long texts are, and a group of
copies with a third of all rows is cut over many partitions.  Runs that touch a
partition's border are then joined by digest; there are two of them a partition
at most.

Defined results: null counts as an empty text; ties of id (repeated rows) keep
one row, the first in order; null ids come last; an empty table gives no rows;
extra columns are ignored, or carried through by :func:`drop_copies`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .shared import materialise, plain, tasks

#: Bytes of a text that splitters are sampled from.
SPLITTER_CHARS = 64


def _sorted_by_content(df: DataFrame, normalised: Column, id_col: str, keep: str) -> DataFrame:
    by_id = F.col(id_col).desc_nulls_last() if keep == "largest" else F.col(id_col).asc_nulls_last()
    df = df.withColumn("_tm_body", normalised)
    head, rest = F.substring("_tm_body", 1, SPLITTER_CHARS), F.xxhash64("_tm_body")
    # An explicit count, so that the ranges of a hot text stay apart.
    return df.repartitionByRange(tasks(df.sparkSession), head, rest, by_id).sortWithinPartitions(head, rest, F.col("_tm_body"), by_id)


def _new_run(body: pa.Array, last: str | None) -> np.ndarray:
    """Whether each row's text differs from the row before; full comparison."""
    fresh = np.ones(len(body), bool)
    if len(body) > 1:
        fresh[1:] = pc.not_equal(body.slice(1), body.slice(0, len(body) - 1)).to_numpy(zero_copy_only=False)
    if len(body) and last is not None:
        fresh[0] = body[0].as_py() != last
    return fresh


def _digests(body: pa.Array, fresh: np.ndarray, sha: bytes) -> list[bytes]:
    out = []
    for i, new in enumerate(fresh):
        if new:
            sha = hashlib.sha256(body[i].as_buffer()).digest()
        out.append(sha)
    return out


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (id, _body) to (id, _sha, _keep, _size, _first, _border); only ids and digests of an open run are held."""
    last, sha, part = None, b"", TaskContext.get().partitionId()
    ids: list[pa.Array] = []
    shas: list[bytes] = []
    first_run = True

    def close(border: bool) -> pa.RecordBatch:
        got = pa.concat_arrays(ids)
        n = len(got)
        return pa.record_batch(
            [got, pa.array([shas[0]] * n, pa.binary()), pa.array([got[0].as_py()] * n, got.type), pa.array(np.full(n, n, np.int64)), pa.array(np.arange(n) == 0), pa.array(np.full(n, border)), pa.array(np.full(n, part, np.int32))],
            names=["_id", "_sha", "_keep", "_size", "_first", "_border", "_part"],
        )

    def settle(closed_ids: pa.Array, closed_shas: list[bytes], fresh: np.ndarray) -> pa.RecordBatch:
        """Whole runs that began and ended within a batch."""
        starts = np.flatnonzero(fresh)
        sizes = np.diff(np.append(starts, len(fresh)))
        return pa.record_batch(
            [closed_ids, pa.array(closed_shas, pa.binary()), closed_ids.take(pa.array(np.repeat(starts, sizes))), pa.array(np.repeat(sizes, sizes)), pa.array(fresh), pa.array(np.zeros(len(fresh), bool)), pa.array(np.full(len(fresh), part, np.int32))],
            names=["_id", "_sha", "_keep", "_size", "_first", "_border", "_part"],
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        body, key = plain(batch.column(1)), plain(batch.column(0))
        fresh = _new_run(body, last)
        each = _digests(body, fresh, sha)
        starts = np.flatnonzero(fresh)
        last, sha = body[len(body) - 1].as_py(), each[-1]
        if not len(starts):  # the open run goes on
            ids.append(key)
            shas = shas or each
            continue
        if starts[0]:
            ids.append(key.slice(0, int(starts[0])))
        if ids:
            yield close(first_run)
            first_run, ids, shas = False, [], []
        a, b = int(starts[0]), int(starts[-1])
        if first_run and b > a:  # the first run of the partition ended in this batch
            c = int(starts[1])
            ids, shas = [key.slice(a, c - a)], each[a:c]
            yield close(True)
            first_run, ids, shas, a = False, [], [], c
        if b > a:
            yield settle(key.slice(a, b - a), each[a:b], fresh[a:b])
        ids, shas = [key.slice(b)], each[b:]
    if ids:
        yield close(True)


def copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", normalised: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    ``keep`` is "largest" or "smallest" id.  ``normalised`` is the text that is
    compared; by default the text itself, null as empty.
    """
    body = F.coalesce(F.col(text_col), F.lit("")) if normalised is None else normalised
    slim = docs.select(F.col(id_col).alias("_id"), body.alias("_text"))
    ranked = _sorted_by_content(slim, F.col("_text"), "_id", keep).select("_id", "_tm_body")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = materialise(ranked.mapInArrow(_runs, f"_id {kind}, _sha binary, _keep {kind}, _size bigint, _first boolean, _border boolean, _part int"), "copies")
    # Runs at a border: two a partition at most, so this table is far smaller than a partition.
    # Partitions are in sort order: a run's first partition holds the row that stays.
    border = rows.filter("_border and _first").groupBy(F.col("_sha").alias("_s")).agg(F.min_by("_keep", "_part").alias("_k"), F.sum("_size").alias("_n"), F.min("_part").alias("_lead"))
    out = rows.join(F.broadcast(border), F.col("_border") & (F.col("_sha") == F.col("_s")), "left")
    leads = F.col("_s").isNull() | (F.col("_part") == F.col("_lead"))
    return out.select(
        F.col("_id").alias(id_col),
        F.when(F.col("_s").isNull(), F.col("_keep")).otherwise(F.col("_k")).alias("keep_id"),
        F.coalesce("_n", "_size").alias("group_size"),
        (F.col("_first") & leads).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each run, with its digest and whether it is the partition's first run."""
    last, head, part = None, True, TaskContext.get().partitionId()
    for batch in batches:
        if not batch.num_rows:
            continue
        body = plain(batch.column(batch.schema.get_field_index("_tm_body")))
        at = np.flatnonzero(_new_run(body, last))
        last = body[len(body) - 1].as_py()
        kept = batch.take(pa.array(at)).drop_columns(["_tm_body"])
        shas = [hashlib.sha256(body[int(i)].as_buffer()).digest() for i in at]
        heads = np.zeros(len(at), bool)
        if head and len(at):
            heads[0], head = True, False
        yield pa.record_batch([*kept.columns, pa.array(shas, pa.binary()), pa.array(heads), pa.array(np.full(len(at), part, np.int32))], names=[*kept.schema.names, "_tm_sha", "_tm_head", "_tm_part"])


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", normalised: Column | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each group of equal texts."""
    body = F.coalesce(F.col(text_col), F.lit("")) if normalised is None else normalised
    ranked = _sorted_by_content(docs, body, id_col, keep)
    kept = StructType([StructField(f.name, f.dataType) for f in docs.schema]).add("_tm_sha", "binary").add("_tm_head", "boolean").add("_tm_part", "integer")
    rows = materialise(ranked.mapInArrow(_firsts, kept), "firsts")
    # A run can go on only from one partition to the next, where it is the head: one a partition.
    heads = rows.filter("_tm_head").select(F.col("_tm_sha").alias("_tm_s")).distinct()
    rivals = rows.join(F.broadcast(heads), F.col("_tm_sha") == F.col("_tm_s"), "left_semi").groupBy(F.col("_tm_sha").alias("_tm_s")).agg(F.min("_tm_part").alias("_tm_lead"))
    out = rows.join(F.broadcast(rivals), F.col("_tm_sha") == F.col("_tm_s"), "left")
    return out.filter(F.col("_tm_s").isNull() | (F.col("_tm_part") == F.col("_tm_lead"))).select(*[F.col(f"`{c}`") for c in docs.columns])
