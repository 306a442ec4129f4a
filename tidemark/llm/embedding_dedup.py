"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors u, v have cosine >= c exactly if they are within epsilon =
sqrt(2 - 2c).  Vectors are rotated to principal dimensions and sorted by the grid
cells, epsilon wide, of the leading ones: the epsilon grid order.  The sequence
is cut into blocks with bounding boxes; intervals of blocks are joined
recursively, from long ones down to single blocks, and whatever is provably
further apart than epsilon is skipped.  Blocks that remain are compared in full
in double precision.  A task gets two intervals of ``TASK_BLOCKS`` blocks and all
pairs of their blocks that remain, so a block is sent once for each interval near
it rather than for each block.  It returns sums and one label a vector, never
pairs.

Equal vectors of a label are one node with a multiplicity.  The rotation is
fitted on a sample of at most about ``ROTATION_ROWS`` vectors; it decides only
what can be skipped, not what is found.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and those without a label, link with nothing; vectors of unequal
length don't link; rows that repeat an id count as vectors of their own and share
their component; a null id is in no component (null), though its vector counts
as a link of others; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import materialise, tasks

COSINE = 0.93
ROTATION_ROWS = 20_000
#: Principal dimensions whose cells give the order, and those that boxes have.
ORDER_DIMS, BOX_DIMS = 8, 24
BLOCK = 512
#: Children of an interval in the recursion.
FAN_OUT = 8
#: Blocks of an interval that is sent to a task.
TASK_BLOCKS = 16


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, embedding) to (id, label, dim, digest, vec); vec (doubles) is null if it can't link."""
    for batch in batches:
        ids, labels, rows = batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()
        vecs, digests, dims = [], [], []
        for label, row in zip(labels, rows):
            v = np.array([np.nan if x is None else x for x in row], np.float64) + 0.0 if row else None
            ok = label is not None and v is not None and bool(np.isfinite(v).all()) and bool(v.any())
            vecs.append(v.tobytes() if ok else None)
            digests.append(hashlib.blake2b(repr(label).encode() + b"\0" + vecs[-1], digest_size=16).digest() if ok else None)
            dims.append(len(v) if ok else 0)
        yield pa.record_batch([ids, batch.column(1), pa.array(dims, pa.int32()), pa.array(digests, pa.binary()), pa.array(vecs, pa.binary())], names=["id", "label", "dim", "digest", "vec"])


def unit(rows: np.ndarray) -> np.ndarray:
    big = np.abs(rows).max(1, keepdims=True)
    rows = rows / big
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    parts = [np.frombuffer(x.as_buffer(), np.float64) for x in column]
    return np.stack(parts)


def fit_rotations(nodes: DataFrame, rows: int = ROTATION_ROWS) -> dict[int, np.ndarray]:
    """For each vector length, the principal directions of a sample, leading ones first."""
    n = nodes.count()
    rate = min(1.0, rows / max(1, n))
    draw = F.pmod(F.xxhash64("node", F.lit(3)), F.lit(1 << 20)) < int(rate * (1 << 20))
    sample = nodes.filter(draw).select("dim", "vec").toPandas()
    out = {}
    for dim, part in sample.groupby("dim"):
        x = unit(np.stack([np.frombuffer(v, np.float64) for v in part["vec"]]))
        out[int(dim)] = np.linalg.eigh(np.cov(x.T, bias=True).reshape(dim, dim))[1][:, ::-1]
    return out


def _rotated(shipped: Broadcast, x: np.ndarray) -> np.ndarray:
    turn = shipped.value.get(x.shape[1])
    return x if turn is None else x @ turn


def _celled(shipped: Broadcast, epsilon: float):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy(zero_copy_only=False)
            cells: list = [None] * len(dims)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = _rotated(shipped, unit(_matrix(batch.column(4).take(pa.array(at)))))[:, :ORDER_DIMS]
                for i, row in zip(at, np.floor(x / epsilon).astype(np.int32)):
                    cells[i] = row
            yield pa.record_batch([*batch.columns, pa.array(cells, pa.list_(pa.int32()))], names=["node", "label", "dim", "times", "vec", "cells"])

    return add


def _blocked(shipped: Broadcast):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def block() -> pa.RecordBatch:
            nonlocal n
            x = np.stack([r[4] for r in held])
            turned = _rotated(shipped, unit(x))[:, :BOX_DIMS]
            number = (part << 32) | n
            n += 1
            return pa.record_batch(
                [
                    pa.array([number]), pa.array([held[0][1]], label_type), pa.array([held[0][2]], pa.int32()), pa.array([turned.min(0)], pa.list_(pa.float64())), pa.array([turned.max(0)], pa.list_(pa.float64())),
                    pa.array([np.array([r[0] for r in held], np.int64).tobytes()], pa.binary()), pa.array([np.array([r[3] for r in held], np.int64).tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary()),
                ],
                names=["block", "label", "dim", "lo", "hi", "nodes", "times", "vecs"],
            )

        for batch in batches:
            label_type = batch.column(1).type
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                row = (*row[:4], np.frombuffer(row[4], np.float64))
                if held and (len(held) >= BLOCK or held[0][1:3] != row[1:3]):
                    yield block()
                    held = []
                held.append(row)
        if held:
            yield block()

    return cut


def box_distance2(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    """Squared distance of two boxes: a lower bound of that of any two of their vectors."""
    gap = F.zip_with(F.zip_with(lo_b, hi_a, lambda x, y: x - y), F.zip_with(lo_a, hi_b, lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    return F.aggregate(gap, F.lit(0.0), lambda acc, x: acc + x * x)


def block_pairs(boxes: DataFrame, epsilon: float) -> DataFrame:
    """(block_a, block_b, task), a <= b in sequence, of blocks of one label and length that may hold vectors within epsilon.

    ``boxes`` has a row for each block.  Intervals of FAN_OUT**level blocks in
    sequence are joined with each other, close ones are replaced by the pairs of
    their children, down to blocks.
    """
    limit = epsilon * epsilon * (1 + 1e-6) + 1e-9
    key = ["label", "dim"]
    level0 = materialise(boxes.withColumn("seq", F.row_number().over(Window.partitionBy(*key).orderBy("block")) - 1), "boxes")
    longest = level0.agg(F.max("seq")).first()[0] or 0
    levels = [level0.select(*key, F.col("seq").cast("long").alias("seq"), "lo", "hi")]
    while longest >= FAN_OUT:
        longest //= FAN_OUT
        last = levels[-1].withColumn("up", F.floor(F.col("seq") / FAN_OUT)).select(*key, "up", F.posexplode(F.arrays_zip("lo", "hi")).alias("d", "box"))
        each = last.groupBy(*key, "up", "d").agg(F.min("box.lo").alias("l"), F.max("box.hi").alias("h"))
        levels.append(each.groupBy(*key, "up").agg(F.array_sort(F.collect_list(F.struct("d", "l", "h"))).alias("x")).select(*key, F.col("up").alias("seq"), F.col("x.l").alias("lo"), F.col("x.h").alias("hi")))
    # Of the longest intervals there are at most FAN_OUT a label.
    top = levels[-1]
    left = top.select(*key, F.col("seq").alias("a"), F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"))
    right = top.select(*key, F.col("seq").alias("b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"))
    near = lambda df: df.filter((F.col("a") <= F.col("b")) & (box_distance2(F.col("lo_a"), F.col("hi_a"), F.col("lo_b"), F.col("hi_b")) <= limit)).select(*key, "a", "b")
    pairs = near(left.join(right, key))
    children = F.sequence(F.lit(0), F.lit(FAN_OUT - 1))
    for level in reversed(levels[:-1]):
        pairs = materialise(pairs, "intervals")
        split = pairs.withColumn("x", F.explode(children)).withColumn("y", F.explode(children)).select(*key, (F.col("a") * FAN_OUT + F.col("x")).alias("a"), (F.col("b") * FAN_OUT + F.col("y")).alias("b")).filter("a <= b")
        left = level.select(*key, F.col("seq").alias("a"), F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"))
        right = level.select(*key, F.col("seq").alias("b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"))
        pairs = near(split.join(left, [*key, "a"]).join(right, [*key, "b"]))
    number = level0.select(*key, F.col("seq").cast("long").alias("seq"), "block")
    first = number.select(*key, F.col("seq").alias("a"), F.col("block").alias("block_a"))
    second = number.select(*key, F.col("seq").alias("b"), F.col("block").alias("block_b"))
    task = F.struct(*key, F.expr(f"a div {TASK_BLOCKS}").alias("a"), F.expr(f"b div {TASK_BLOCKS}").alias("b"))
    return pairs.withColumn("task", task).join(first, [*key, "a"]).join(second, [*key, "b"]).select("block_a", "block_b", "task")


def _linked(a: dict, b: dict, cosine: float) -> pa.RecordBatch | None:
    """(node, links, root) of the vectors of two blocks, or of one (``a`` is ``b``), that have a link."""
    hit = a["x"] @ b["x"].T / np.outer(a["norm"], b["norm"]) >= cosine
    if a is b:
        np.fill_diagonal(hit, False)
    i, j = np.nonzero(hit)
    if not len(i):
        return None
    label = [a["nodes"].copy(), b["nodes"].copy()]
    while True:  # smallest node reachable within this pair of blocks
        before = label[0].sum(dtype=object) + label[1].sum(dtype=object)
        np.minimum.at(label[1], j, label[0][i])
        if a is b:
            label[0] = label[1] = np.minimum(label[0], label[1])
        np.minimum.at(label[0], i, label[1][j])
        if a is b:
            label[1] = label[0]
        if label[0].sum(dtype=object) + label[1].sum(dtype=object) == before:
            break
    rows = [(a["nodes"], hit @ b["times"], label[0])] + ([(b["nodes"], a["times"] @ hit, label[1])] if a is not b else [])
    got = [np.concatenate(z) for z in zip(*((n[s > 0], s[s > 0], r[s > 0]) for n, s, r in rows))]
    return pa.record_batch([pa.array(z.astype(np.int64)) for z in got], names=["node", "links", "root"])


def _compare(cosine: float):
    """Rows (task, block, partners, dim, nodes, times, vecs), sorted by task; the blocks of one task are held at a time."""

    def unpacked(dim: int, nodes, times, vecs) -> dict:
        x = np.frombuffer(vecs.as_buffer(), np.float64).reshape(-1, dim)
        # Scaled by the largest component first, so that squares neither overflow nor vanish.
        x = x / np.abs(x).max(1, keepdims=True)
        return {"nodes": np.frombuffer(nodes.as_buffer(), np.int64), "times": np.frombuffer(times.as_buffer(), np.int64), "x": x, "norm": np.sqrt((x * x).sum(1))}

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, wanted = None, {}, []

        def settle() -> Iterator[pa.RecordBatch]:
            for a, b in wanted:
                got = _linked(held[a], held[b], cosine)
                if got is not None:
                    yield got

        for batch in batches:
            for row in zip(*(c if k > 3 else c.to_pylist() for k, c in enumerate(batch.columns))):
                if row[0] != task:
                    yield from settle()
                    task, held, wanted = row[0], {}, []
                held[row[1]] = unpacked(*row[3:])
                wanted += [(row[1], p) for p in row[2]]
        yield from settle()

    return compare


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """One row per vector: id, n_links, component_id (smallest id reachable), kept (id = component_id)."""
    spark = vectors.sparkSession
    epsilon = float(np.sqrt(2 - 2 * cosine))
    kind = vectors.schema[label_col].dataType.simpleString()
    slim = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("embedding"))
    ready = materialise(slim.mapInArrow(_prepare, f"id bigint, label {kind}, dim int, digest binary, vec binary"), "vectors")
    nodes = ready.filter("vec is not null").groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("times"), F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("vec").alias("vec"))
    # A node is its smallest id; a node of null ids only gets a number of its own below all ids.
    nodes = materialise(nodes.withColumn("node", F.coalesce("least", F.lit(-(1 << 62)) - F.abs(F.xxhash64("digest")) % (1 << 61))), "nodes")
    turns = spark.sparkContext.broadcast(fit_rotations(nodes))
    celled = nodes.select("node", "label", "dim", "times", "vec").mapInArrow(_celled(turns, epsilon), f"node bigint, label {kind}, dim int, times bigint, vec binary, cells array<int>")
    order = ["label", "dim", "cells", "node"]
    ranged = celled.repartitionByRange(tasks(spark), *order).sortWithinPartitions(*order).drop("cells")
    blocks = materialise(ranged.mapInArrow(_blocked(turns), f"block bigint, label {kind}, dim int, lo array<double>, hi array<double>, nodes binary, times binary, vecs binary"), "blocks")
    pairs = block_pairs(blocks.select("block", "label", "dim", "lo", "hi"), epsilon)
    # What a task needs: each block once, with the blocks that it is compared with.
    sent = pairs.select("task", F.col("block_a").alias("block"), F.col("block_b").alias("partner")).unionByName(pairs.select("task", F.col("block_b").alias("block"), F.lit(None).cast("long").alias("partner")))
    sent = sent.groupBy("task", "block").agg(F.collect_list("partner").alias("partners"))
    both = sent.join(blocks, "block").select("task", "block", "partners", "dim", "nodes", "times", "vecs")
    ordered = both.repartition("task").sortWithinPartitions("task")
    found = materialise(ordered.mapInArrow(_compare(cosine), "node bigint, links bigint, root bigint"), "found")
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).distinct())
    # The smallest id of a component; numbers that stand for null ids don't count.
    least = nodes.select("node", "least").join(roots, "node").groupBy("root").agg(F.min("least").alias("component"))
    known = nodes.select("digest", "node", "least", "times").join(linked, "node", "left").join(roots, "node", "left").join(least, "root", "left")
    known = known.select("digest", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "least").alias("component"))
    out = ready.select("id", "digest").join(known.hint("merge"), "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
