"""Near-duplicate documents: consistent weighted sampling of TF-IDF shingles, banded, verified.

Equal texts are one node, by their digest.  A node's shingles are sampled by
improved consistent weighted sampling: two nodes have the same k-th sample with a
probability equal to their weighted Jaccard similarity.  ``ROWS`` samples make a
band, and nodes that agree in a band share a bucket.

A bucket's nodes are not paired with each other.  In each round every bucket has
leaders, and its nodes of other classes are compared with them in full (weighted
Jaccard over all shingles of the whole texts).  A leader is then done with the
bucket; the bucket is done when its other nodes are in one class.  So each two of
a bucket are compared, unless they are in one class by then.  The first leader is
the node with the most bucket mates, which in a group of edited copies is the
text that they come from.  Classes are the connected components of verified links.
A bucket of many nodes is dealt over tasks by salts, to which its leaders are
sent, so no task gets a whole hot bucket.

Defined results: null text counts as empty; a text without a word is a class with
its equals only; a null id is in no class (null); of a class the smallest id
stands for all, of several texts under it the one of the smallest digest; rows
that repeat an id with unlike texts are in classes of their own, which then may
have the same ``class_id``; an empty table gives no rows; extra columns are
ignored, or carried through by :func:`drop_near_copies`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import blocks, materialise, mix64, plain, utf8
from .shingles import DAMPING, Weights, fit_weights, shingle_blocks

THRESHOLD = 0.8
#: 12 bands of 3 samples: two texts of similarity 0.8 meet in a bucket with a probability of 0.9998.
BANDS, ROWS = 12, 3
#: Samples of a node that its first leader did not settle.
MORE_SAMPLES = 385
#: Of these, those that are compared first; two standard deviations more of slack make up for that.
FIRST_SAMPLES = 98
#: Pairs whose samples are compared at a time.
COMPARE_PAIRS = 1 << 15
#: Standard deviations by which a pair's shared samples may fall short of the
#: threshold and the pair is still compared in full: one in 700 falls shorter at the threshold itself, none to speak of above it.
SLACK = 3.0
#: Parts in which a bucket's nodes are counted, and nodes of a bucket for each of its salts.
COUNT_PARTS, SALT_NODES = 1024, 256
#: Leaders that are drawn in a bucket in the second round, and how much more they are in each further one: the first few
#: settle most nodes, so that few pairs are left for the many.
LEADERS, MORE_LEADERS = 128, 16
#: Bytes of pairs of texts that are compared at a time.
VERIFY_BYTES = 2 << 20


def _uniform(bits: np.ndarray) -> np.ndarray:
    """Open (0, 1) from the upper 24 bits."""
    return ((bits >> np.uint64(40)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-24)


def weighted_samples(text: np.ndarray, hashes: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts that have shingles, and the k-th sample of each, as a hash of (shingle, t).

    For a shingle of weight S with r, c ~ Gamma(2, 1) and b ~ Uniform(0, 1), all
    from its hash: t = floor(ln S / r + b), a = c exp(-r (t - b + 1)); the
    smallest a is the sample.
    """
    h = mix64(hashes + np.uint64((2 * k + 1) * 0x9E3779B97F4A7C15 % 2**64))
    g = mix64(h + np.uint64(0x632BE59BD9B4E019))
    r = -np.log(_uniform(h) * _uniform(h << np.uint64(24)))
    c = -np.log(_uniform(g) * _uniform(g << np.uint64(24)))
    # 16 bits of each hash are left.
    b = (((h & np.uint64(0xFFFF)) << np.uint64(16) | (g & np.uint64(0xFFFF))) >> np.uint64(8)).astype(np.float32) * np.float32(2.0**-24)
    t = np.floor(np.log(weights.astype(np.float32)) / r + b)
    a = np.log(c) - r * (t - b + np.float32(1))
    first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    least = np.minimum.reduceat(a, first)
    of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(text))))
    hit = np.flatnonzero(a == least[of])
    hit = hit[np.concatenate([[True], of[hit][1:] != of[hit][:-1]])]
    return text[first], mix64(hashes[hit] ^ mix64(t[hit].astype(np.int64).astype(np.uint64) + np.uint64(k + 1)))


def band_keys(text: np.ndarray, hashes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts that have shingles, and BANDS keys and the lowest bytes of BANDS * ROWS samples for each."""
    if not len(text):
        return text, np.zeros((0, BANDS), np.int64), np.zeros((0, BANDS * ROWS), np.uint8)
    keys, samples = [], []
    for band in range(BANDS):
        key = np.full(1, band + 1, np.uint64)
        for row in range(ROWS):
            texts, sample = weighted_samples(text, hashes, weights, band * ROWS + row)
            samples.append(low_byte(sample))
            key = mix64(sample + key * np.uint64(0xD6E8FEB86659FD93))
        keys.append(key.astype(np.int64))
    return texts, np.stack(keys, 1), np.stack(samples, 1)


def min_alike(n: int, threshold: float, slack: float) -> int:
    """Of n samples, those that a pair must share to be compared in full."""
    return int(np.floor(n * threshold - slack * np.sqrt(n * threshold * (1 - threshold))))


def low_byte(samples: np.ndarray) -> np.ndarray:
    """The byte by which samples are compared; unequal samples count as equal once in 256 times."""
    return (samples >> np.uint64(32)).astype(np.uint8)


def _sampler(shipped: Broadcast):
    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights: Weights = shipped.value
        for batch in batches:
            rows: list = [None] * batch.num_rows
            for a, _, text, h, count in shingle_blocks(batch.column(1)):
                w = weights.of(h, count)
                got = [weighted_samples(text, h, w, BANDS * ROWS + k) for k in range(MORE_SAMPLES)] if len(text) else []
                if got:
                    for i, row in zip(got[0][0], np.stack([low_byte(x) for _, x in got], 1)):
                        rows[a + i] = row.tobytes()
            yield pa.record_batch([batch.column(0), pa.array(rows, pa.binary())], names=["node", "samples"])

    return sample


def _signer(shipped: Broadcast):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights: Weights = shipped.value
        for batch in batches:
            body = plain(batch.column(1)).fill_null("")
            keys: list = [None] * len(body)
            samples: list = [None] * len(body)
            for a, _, text, h, count in shingle_blocks(body):
                for i, key, sample in zip(*band_keys(text, h, weights.of(h, count))):
                    keys[a + i], samples[a + i] = key, sample.tobytes()
            digests = [hashlib.md5(x.as_buffer(), usedforsecurity=False).digest() for x in body]
            yield pa.record_batch([batch.column(0), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(samples, pa.binary())], names=["id", "digest", "bands", "samples"])

    return sign


def weighted_jaccard(a: pa.Array, b: pa.Array, weights: Weights) -> np.ndarray:
    """Similarity of each pair of texts; 0 if neither has a word."""
    sides = []
    for texts in (a, b):
        pair, h, w = [], [], []
        for first, _, text, hashes, count in shingle_blocks(texts):
            pair.append(text + first)
            h.append(hashes)
            w.append(weights.of(hashes, count))
        sides.append([np.concatenate(x) if x else np.zeros(0) for x in (pair, h, w)])
    pair = np.concatenate([sides[0][0], sides[1][0]]).astype(np.int64)
    h = np.concatenate([sides[0][1], sides[1][1]]).astype(np.uint64)
    w = np.concatenate([sides[0][2], sides[1][2]])
    order = np.lexsort((h, pair))
    pair, h, w = pair[order], h[order], w[order]
    both = np.flatnonzero((pair[1:] == pair[:-1]) & (h[1:] == h[:-1])) if len(pair) else np.zeros(0, np.int64)
    total = np.bincount(pair, w, len(a))
    common = np.bincount(pair[both], np.minimum(w[both], w[both + 1]), len(a))
    return np.divide(common, total - common, out=np.zeros(len(a)), where=total > common)


def _verifier(shipped: Broadcast, threshold: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = plain(batch.column(2)), plain(batch.column(3))  # columns 0 and 1: classes
            # Few bytes at a time: a hot leader's text stands in every row.
            for i, j in blocks(utf8(left)[1] + utf8(right)[1], VERIFY_BYTES):
                sim = weighted_jaccard(left.slice(i, j - i), right.slice(i, j - i), shipped.value)
                keep = pa.array(sim >= threshold)
                yield pa.record_batch([batch.column(k).slice(i, j - i).filter(keep) for k in (0, 1)], names=["a", "b"])

    return verify


def _members(nodes: DataFrame) -> DataFrame:
    """(bucket, salt, salts, node, mates, bands, samples) of all buckets with two nodes at least."""
    part = F.pmod(F.xxhash64("node"), F.lit(COUNT_PARTS))
    members = nodes.filter("bands is not null").select("node", F.explode("bands").alias("bucket")).withColumn("part", part)
    # The window is over counts, of which a bucket has COUNT_PARTS at most.
    counts = members.groupBy("bucket", "part").agg(F.count("*").alias("c")).withColumn("n", F.sum("c").over(Window.partitionBy("bucket")))
    members = materialise(members.join(counts.filter("n > 1").drop("c").hint("merge"), ["bucket", "part"]).drop("part"), "members")
    mates = members.groupBy("node").agg(F.sum("n").alias("mates")).join(nodes.select("node", "bands", "samples"), "node")
    salted = members.withColumn("salts", F.ceil(F.col("n") / SALT_NODES).cast("int")).withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"))
    return materialise(salted.drop("n").join(mates.hint("merge"), "node").select("bucket", "salt", "salts", "node", "mates", "bands", "samples"), "members")


def _of_bucket(members: DataFrame, table: DataFrame, how: str = "inner") -> DataFrame:
    """``members`` joined with rows of buckets, each of which goes to all salts of its bucket."""
    spread = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    return members.join(spread.hint("merge"), ["bucket", "salt"], how)


def _leads(members: DataFrame, turn: int) -> DataFrame:
    """``members`` with ``lead``.

    At first the node with the most bucket mates, later drawn nodes, more each time,
    of those that are outside the bucket's largest class.
    """
    if turn == 0:
        first = members.groupBy("bucket").agg(F.min(F.struct((-F.col("mates")).alias("o"), F.col("node").alias("node"))).alias("x"), F.max("salts").alias("salts"))
        return _of_bucket(members, first).withColumn("lead", F.col("node") == F.col("x.node")).drop("x")
    classes = members.groupBy("bucket", "label").agg(F.count("*").alias("n"), F.max("salts").alias("salts"))
    sizes = classes.groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("x"), F.sum("n").alias("n"), F.max("salts").alias("salts"))
    drawn = F.pmod(F.xxhash64("node", F.lit(turn)), F.col("n") - F.col("x.n")) < LEADERS * MORE_LEADERS ** (turn - 1)
    # A bucket is done when its nodes are of one class.
    return _of_bucket(members, sizes.filter("n > x.n")).withColumn("lead", (F.col("label") != F.col("x.label")) & drawn).drop("n", "x")


def _comparer(samples: int, threshold: float, slack: float | None):
    """Rows of buckets and salts, members before leaders, to pairs; only the members of the last salt are held."""
    stages = [] if slack is None else [(samples, min_alike(samples, threshold, slack))]
    if slack is not None and samples > FIRST_SAMPLES:
        stages.insert(0, (FIRST_SAMPLES, min_alike(FIRST_SAMPLES, threshold, slack + 2)))

    def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        bucket, salt, leads, lead = (rows[c].to_numpy() for c in ("bucket", "salt", "leads", "lead"))
        bands = plain(rows["bands"].combine_chunks()).flatten().to_numpy().reshape(-1, BANDS)
        low = utf8(rows["samples"])[0].reshape(-1, samples)
        # Codes in the order of the digests, which are of one length.
        code = lambda name: np.unique(utf8(rows[name])[0].view("S16"), return_inverse=True)[1]
        node, label = code("node"), code("label")
        first = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (salt[1:] != salt[:-1])]))
        n_leaders = np.add.reduceat(leads.astype(np.int64), first)
        n_members = np.diff(np.append(first, len(bucket))) - n_leaders
        upto = np.concatenate([[0], np.cumsum(n_members * n_leaders)])
        for p in range(0, int(upto[-1]), COMPARE_PAIRS):
            nth = np.arange(p, min(p + COMPARE_PAIRS, upto[-1]))
            group = np.searchsorted(upto, nth, "right") - 1
            nth -= upto[group]
            i = first[group] + nth % n_members[group]
            j = first[group] + n_members[group] + nth // n_members[group]
            keep = (label[i] != label[j]) & (~lead[i] | (node[i] < node[j]))
            i, j = i[keep], j[keep]
            for n, least in stages:
                keep = np.count_nonzero(low[i, :n] == low[j, :n], axis=1) >= least
                i, j = i[keep], j[keep]
            # Two nodes are compared in the first of the buckets that they share, and there only.
            shared = np.where(bands[i] == bands[j], bands[i], np.iinfo(np.int64).max)
            keep = shared.min(axis=1) == bucket[i]
            i, j = pa.array(i[keep]), pa.array(j[keep])
            if len(i):
                out = [rows["node"].take(i), rows["label"].take(i), rows["node"].take(j), rows["label"].take(j)]
                yield pa.record_batch([plain(x) for x in out], names=["a", "label_a", "b", "label_b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            rows = new if held is None else pa.concat_tables([held, new]).combine_chunks()
            yield from pairs(rows)
            bucket, salt, leads = (rows[c].to_numpy() for c in ("bucket", "salt", "leads"))
            of_last = np.flatnonzero((bucket == bucket[-1]) & (salt == salt[-1]) & ~leads)
            held = rows.take(pa.array(of_last))

    return compare


def _pairs(members: DataFrame, samples: int, threshold: float, slack: float | None) -> DataFrame:
    """(a, label_a, b, label_b): each node with the leaders of its buckets, unless samples rule it out."""
    columns = ["bucket", "salt", "node", "label", "lead", "bands", "samples"]
    leaders = members.filter("lead").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    both = members.select(*columns, F.lit(False).alias("leads")).union(leaders.select(*columns, F.lit(True).alias("leads")))
    dealt = both.repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", "leads")
    return dealt.mapInArrow(_comparer(samples, threshold, slack), "a binary, label_a binary, b binary, label_b binary")


def digest(text: Column) -> Column:
    """A text's digest, the same as ``sign`` gives."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _classes(docs: DataFrame, id_col: str, text_col: str, threshold: float, slack: float | None, damping: float) -> DataFrame:
    """One row per document: id, digest, class_id and class_digest (id and digest of the row that stands for its class).

    Nodes and labels are digests, so that texts are told apart whatever their ids.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    weights = spark.sparkContext.broadcast(fit_weights(slim.select("text"), damping=damping))
    kind = docs.schema[id_col].dataType.simpleString()
    signed = materialise(slim.mapInArrow(_signer(weights), f"id {kind}, digest binary, bands array<bigint>, samples binary"), "signed")
    nodes = materialise(signed.filter("id is not null").groupBy("digest").agg(F.min("id").alias("id"), F.first("bands").alias("bands"), F.first("samples").alias("samples")).withColumnRenamed("digest", "node"), "nodes")
    members = _members(nodes)
    # Equal texts are combined before they are shuffled.
    texts = slim.filter("id is not null").select(digest(F.col("text")).alias("node"), "text").groupBy("node").agg(F.max("text").alias("text"))
    texts = materialise(texts.join(members.select("node").distinct().hint("merge"), "node", "left_semi"), "member-texts")
    labels = members.select("node", F.col("node").alias("label")).distinct()
    members, turn = members.withColumn("label", F.col("node")), 0
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    while True:
        members = _leads(members, turn)
        if turn == 1:
            members = materialise(members.drop("samples"), "members")
            unsettled = texts.join(members.select("node").distinct().hint("merge"), "node", "left_semi")
            more = unsettled.select("node", "text").mapInArrow(_sampler(weights), "node binary, samples binary")
            members = members.join(materialise(more, "samples").hint("merge"), "node")
        members = materialise(members, "members")
        if members.isEmpty():
            break
        pairs = materialise(_pairs(members, MORE_SAMPLES if turn else BANDS * ROWS, threshold, slack), "pairs")
        compared = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("label_a", "label_b", "text_a", "text_b")
        found = materialise(compared.mapInArrow(_verifier(weights, threshold), "a binary, b binary"), "verified")
        # Classes found so far are the nodes of the next components.
        joined = components(found).withColumnRenamed("node", "label")
        relabel = lambda df, joined=joined: df.join(joined.hint("merge"), "label", "left").withColumn("label", F.coalesce("root", "label")).drop("root")
        labels = relabel(labels)
        # A leader is done with its bucket.
        members = materialise(relabel(members.filter("not lead").drop("lead")), "rest")
        turn += 1
    labels = materialise(labels, "labels")
    first = labels.join(nodes.select("node", "id").hint("merge"), "node").groupBy("label").agg(F.min(F.struct("id", "node")).alias("first"))
    of_node = labels.join(first.hint("merge"), "label").select("node", "first")
    of_text = nodes.select("node", "id").join(of_node, "node", "left").select(F.col("node").alias("digest"), F.coalesce("first", F.struct("id", "node")).alias("first"))
    out = signed.select("id", "digest").join(of_text.hint("merge"), "digest", "left")
    named = F.col("id").isNotNull()
    return out.select("id", "digest", F.when(named, F.col("first.id")).alias("class_id"), F.when(named, F.col("first.node")).alias("class_digest"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, slack: float | None = SLACK, damping: float = DAMPING) -> DataFrame:
    """One row per document: id, class_id (the smallest id of its class), kept (its id and text stand for the class).

    ``slack`` None compares in full all pairs that a bucket proposes, whatever
    their samples; ``damping`` is that of :class:`shingles.Weights`.
    """
    stands = (F.col("id") == F.col("class_id")) & (F.col("digest") == F.col("class_digest"))
    return _classes(docs, id_col, text_col, threshold, slack, damping).select(F.col("id").alias(id_col), "class_id", F.coalesce(stands, F.lit(True)).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, slack: float | None = SLACK, damping: float = DAMPING) -> DataFrame:
    """One document of each class, with all its columns; rows of null id stay.

    Of rows that repeat both the id and the text that stand for a class, the one
    of the smallest hash of the other columns (as JSON) stays.
    """
    stands = (F.col("id") == F.col("class_id")) & (F.col("digest") == F.col("class_digest"))
    kept = _classes(docs, id_col, text_col, threshold, slack, damping).filter(stands).select(F.col("id").alias("_tm_id"), F.col("digest").alias("_tm_digest")).distinct()
    marked = docs.withColumn("_tm_text", digest(F.col(text_col)))
    stay = marked.join(kept, (F.col(id_col) == F.col("_tm_id")) & (F.col("_tm_text") == F.col("_tm_digest")), "left_semi")
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)]
    order = F.xxhash64(F.to_json(F.struct(*others))) if others else F.lit(0)
    one = stay.withColumn("_tm_n", F.row_number().over(Window.partitionBy(id_col, "_tm_text").orderBy(order))).filter("_tm_n = 1").select(*[F.col(f"`{c}`") for c in docs.columns])
    return one.unionByName(docs.filter(F.col(id_col).isNull()))
