"""Language ID of mixed-language text.

Script ranges narrow the languages that a word can be in.  Each word has a score
for each language, the log-likelihood of its character n-grams with the blanks
around it, and the Viterbi path over the words, with a penalty for a switch,
labels spans.  A document's language is the one with the most letters.

The model is counts of hashed n-grams for each language.  It is fitted on a
sample of labelled rows of at most about ``TRAIN_DOCS`` a language (rows are
chosen by a hash of their id; the rate follows from exact counts).  Its size is
``BUCKETS`` numbers a language, whatever the data.

Defined results: null text, or text without a letter, is ``und`` with score 0 and
no spans; ties go to the language that sorts first; letters of a script that no
language was seen in count for none; without any labelled row everything is
``und``; ids pass through, nulls and repeats too; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import blocks, plain, utf8

UNKNOWN = "und"
TRAIN_DOCS = 2000
BUCKETS = 1 << 16
GRAMS = (2, 3, 4)
SWITCH = 8.0
#: A word's languages are at most so far apart, so that no single word outweighs a switch to and fro.
WORST = 10.0
#: Bytes of texts that are scored together, and characters of a piece of a longer text.
BLOCK_BYTES, PIECE_CHARS = 1 << 20, 1 << 18
#: A language has a script if so large a share of its letters is in it.
SCRIPT_SHARE = 0.01

# First and last code point of blocks, by script.
SCRIPTS: list[tuple[str, int, int]] = [
    ("latin", 0x0041, 0x024F),
    ("latin", 0x1E00, 0x1EFF),
    ("greek", 0x0370, 0x03FF),
    ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF),
    ("arabic", 0x0600, 0x077F),
    ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF),
    ("gurmukhi", 0x0A00, 0x0A7F),
    ("gujarati", 0x0A80, 0x0AFF),
    ("tamil", 0x0B80, 0x0BFF),
    ("telugu", 0x0C00, 0x0C7F),
    ("kannada", 0x0C80, 0x0CFF),
    ("malayalam", 0x0D00, 0x0D7F),
    ("thai", 0x0E00, 0x0E7F),
    ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF),
    ("hangul", 0xAC00, 0xD7AF),
    ("ethiopic", 0x1200, 0x137F),
    ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF),
    ("han", 0x20000, 0x3134F),
]
SCRIPT_NAMES = sorted({s for s, _, _ in SCRIPTS}) + ["other"]

_tables: list[tuple[np.ndarray, np.ndarray]] = []


def letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: its script's number + 1 (0: no letter), and its lower case."""
    if not _tables:
        n = 0x110000
        script, lower = np.zeros(n, np.uint8), np.arange(n, dtype=np.uint32)
        for c in range(n):
            if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
                script[c] = len(SCRIPT_NAMES)
                if len(x := chr(c).lower()) == 1:
                    lower[c] = ord(x)
        for name, a, b in SCRIPTS:
            at = slice(a, b + 1)
            script[at] = np.where(script[at] > 0, SCRIPT_NAMES.index(name) + 1, 0)
        _tables.append((script, lower))
    return _tables[0]


class Words:
    """Words of a block of texts as code points: where they begin and end, and to which text they belong."""

    def __init__(self, texts: list[str]):
        script, lower = letter_tables()
        cp = np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le"), np.uint32)
        self.script = script[cp]
        letter = self.script > 0
        self.sign = np.where(letter, lower[cp], np.uint32(32)).astype(np.uint64)
        edge = np.flatnonzero(np.diff(letter.astype(np.int8)))
        self.begin, self.end = edge[::2] + 1, edge[1::2] + 1
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.text_at = np.cumsum(sizes + 1) - sizes
        self.text_of = np.searchsorted(self.text_at, self.begin, "right") - 1
        self.letters = self.end - self.begin

    def grams(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each length: bucket at each position, and the positions of each word's first and last + 1."""
        sign, n_all = self.sign, len(self.sign)
        for n in GRAMS:
            h = np.full(max(0, n_all - n + 1), n, np.uint64)
            for k in range(n):
                h = (h ^ sign[k : k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            first = self.begin - 1
            yield (h % np.uint64(BUCKETS)).astype(np.int64), first, np.maximum(first, np.minimum(self.end + 2 - n, len(h)))

    def script_of(self) -> np.ndarray:
        """The script of each word's first letter."""
        return self.script[self.begin].astype(np.int64) - 1


@dataclass
class ScoredWords:
    """Words of a block: their text, first and last + 1 character in it, whether a language has their script, and scores."""

    text_of: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    known: np.ndarray
    score: np.ndarray


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # BUCKETS x languages
    scripts: np.ndarray  # scripts x languages, boolean

    def word_scores(self, words: Words) -> np.ndarray:
        n = len(self.langs)
        out = np.zeros((len(words.begin), n))
        for bucket, first, last in words.grams():
            for k in range(n):
                total = np.concatenate([[0.0], np.cumsum(self.weights[:, k][bucket], dtype=np.float64)])
                out[:, k] += total[last] - total[first]
        can = self.scripts[words.script_of()]
        known = can.any(1)
        out = np.where(can | ~known[:, None], out, -np.inf)
        out[~known] = 0
        out -= out.max(1, keepdims=True, initial=-np.inf) if n else 0
        return np.maximum(out, -WORST)

    def words(self, texts: list[str]) -> ScoredWords:
        """The words of texts with their scores; a long text is scored piece by piece, cut between words."""
        parts: list[ScoredWords] = []
        for group in _pieces(texts):
            of, at = (np.array([p[k] for p in group], np.int64) for k in (0, 1))
            w = Words([p[2] for p in group])
            known = self.scripts[w.script_of()].any(1) if len(w.begin) else np.zeros(0, bool)
            shift = at[w.text_of] - w.text_at[w.text_of]
            parts.append(ScoredWords(of[w.text_of], w.begin + shift, w.end + shift, known, self.word_scores(w)))
        return ScoredWords(*(np.concatenate(x) for x in zip(*((p.text_of, p.begin, p.end, p.known, p.score) for p in parts))))

    def paths(self, text_of: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The language of each word on its text's best path; texts advance together, word by word."""
        if not len(score) or len(self.langs) < 2:
            return np.zeros(len(score), np.int64)
        first = np.flatnonzero(np.diff(text_of, prepend=-1))
        size = np.diff(np.append(first, len(score)))
        order = np.argsort(-size, kind="stable")
        first, size = first[order], size[order]
        active = np.searchsorted(-size, -np.arange(size[0]), "left")  # texts with more than t words
        best = np.zeros((len(first), len(self.langs)))
        came = np.zeros((len(score), len(self.langs)), np.int8)
        same = np.arange(len(self.langs), dtype=np.int8)
        for t in range(size[0]):
            n = active[t]
            at = first[:n] + t
            if t:
                top = best[:n].argmax(1)
                jump = best[np.arange(n), top] - SWITCH
                stay = best[:n] >= jump[:, None]
                came[at] = np.where(stay, same, top[:, None])
                best[:n] = np.where(stay, best[:n], jump[:, None])
            best[:n] += score[at]
        path = np.zeros(len(score), np.int64)
        now = best.argmax(1)
        for t in range(size[0] - 1, -1, -1):
            n = active[t]
            at = first[:n] + t
            path[at] = now[:n]
            if t:
                now[:n] = came[at, now[:n]]
        return path


def _pieces(texts: list[str]) -> Iterator[list[tuple[int, int, str]]]:
    """(text, first character, piece) of all texts, in groups of about PIECE_CHARS characters."""
    group, chars = [], 0
    for i, text in enumerate(texts):
        at = 0
        while True:
            end = at + PIECE_CHARS
            while end < len(text) and text[end].isalpha():
                end += 1
            if group and chars + min(end, len(text)) - at > PIECE_CHARS:
                yield group
                group, chars = [], 0
            group.append((i, at, text[at:end]))
            chars += len(group[-1][2])
            if end >= len(text):
                break
            at = end
    yield group


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a partition's buckets by language, and of its scripts (negative buckets)."""
    sums: dict[str, np.ndarray] = {}
    scripts: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        texts = batch.column(1).to_pylist()
        groups = [(lang, g) for lang in sorted(set(langs.tolist())) for g in _pieces([texts[i] or "" for i in np.flatnonzero(langs == lang)])]
        for lang, group in groups:
            w = Words([piece for _, _, piece in group])
            got = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
            for bucket, first, last in w.grams():
                edge = np.zeros(len(bucket) + 1, np.int64)
                np.add.at(edge, first, 1)
                np.add.at(edge, last, -1)
                got += np.bincount(bucket[np.cumsum(edge[:-1]) > 0], minlength=BUCKETS)
            seen = scripts.setdefault(lang, np.zeros(len(SCRIPT_NAMES), np.int64))
            seen += np.bincount(w.script[w.script > 0].astype(np.int64) - 1, minlength=len(SCRIPT_NAMES))
    for lang, got in sums.items():
        at, at2 = np.flatnonzero(got), np.flatnonzero(scripts[lang])
        yield pa.record_batch([pa.array([lang] * (len(at) + len(at2)), pa.string()), pa.array(np.concatenate([at, -1 - at2])), pa.array(np.concatenate([got[at], scripts[lang][at2]]))], names=["lang", "bucket", "n"])


def training_rows(docs: DataFrame, id_col: str) -> Column:
    """Whether a row may be learned from: one in five, by its id, is held out."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 != 0


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS) -> Model:
    usable = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang")).filter(F.col("_lang").isNotNull() & F.col("_text").isNotNull())
    usable = usable.filter(training_rows(usable, "_id"))
    # One row a language reaches the driver.
    counts = {r["_lang"]: r["n"] for r in usable.groupBy("_lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((len(SCRIPT_NAMES), 0), bool))
    rate = F.lit(0.0)
    for lang, n in counts.items():
        rate = F.when(F.col("_lang") == lang, min(1.0, train_docs / n)).otherwise(rate)
    draw = F.pmod(F.xxhash64(F.col("_id"), F.lit(5)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = usable.filter(draw < rate).select("_lang", "_text")
    got = sample.mapInArrow(_count_grams, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts_of, letters = np.zeros((BUCKETS, len(langs))), np.zeros((len(SCRIPT_NAMES), len(langs)))
    k = got["lang"].map(langs.index).to_numpy(np.int64) if len(got) else np.zeros(0, np.int64)
    bucket, n = got["bucket"].to_numpy(np.int64), got["n"].to_numpy(np.float64)
    gram = bucket >= 0
    counts_of[bucket[gram], k[gram]] = n[gram]
    letters[-1 - bucket[~gram], k[~gram]] = n[~gram]
    smooth = counts_of + 0.5
    weights = np.log(smooth / smooth.sum(0)).astype(np.float32)
    return Model(langs, weights, letters >= SCRIPT_SHARE * np.maximum(letters.sum(0), 1))


def _labeller(shipped: Broadcast, with_spans: bool):
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shipped.value
        n_langs = len(model.langs)
        for batch in batches:
            column = plain(batch.column(1))
            for first, last in blocks(utf8(column)[1], BLOCK_BYTES):
                texts = [t or "" for t in column.slice(first, last - first).to_pylist()]
                words = model.words(texts)
                path, letters = model.paths(words.text_of, words.score), words.end - words.begin
                votes = np.zeros((len(texts), max(1, n_langs)))
                if n_langs:
                    np.add.at(votes, (words.text_of[words.known], path[words.known]), letters[words.known])
                every = np.bincount(words.text_of, letters, len(texts)) if len(path) else np.zeros(len(texts))
                top = votes.argmax(1)
                share = votes[np.arange(len(texts)), top] / np.maximum(every, 1)
                pred = [model.langs[k] if n_langs and e else UNKNOWN for k, e in zip(top, every)]
                columns, names = [batch.column(0).slice(first, last - first), pa.array(pred, pa.string()), pa.array(share)], ["id", "lang_pred", "score"]
                if with_spans:
                    spans: list[list[dict]] = [[] for _ in texts]
                    if n_langs and len(path):
                        cut = np.flatnonzero((np.diff(words.text_of, prepend=-1) != 0) | (np.diff(path, prepend=-1) != 0))
                        for a, b in zip(cut, [*cut[1:] - 1, len(path) - 1]):
                            spans[words.text_of[a]].append({"begin": int(words.begin[a]), "end": int(words.end[b]), "lang": model.langs[path[a]]})
                    columns.append(pa.array(spans, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))))
                    names.append("spans")
                yield pa.record_batch(columns, names=names)

    return label


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", with_spans: bool = False) -> DataFrame:
    """One row per document: id, lang_pred, score (share of letters in that language), and spans of characters."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, lang_pred string, score double" + (", spans array<struct<begin:int,end:int,lang:string>>" if with_spans else "")
    return docs.select(id_col, text_col).mapInArrow(_labeller(spark.sparkContext.broadcast(model), with_spans), schema).withColumnRenamed("id", id_col)


def _keeper(shipped: Broadcast, text_at: int, least: float):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = _labeller(shipped, False)
        for batch in batches:
            good = [np.zeros(0, bool)]
            for got in label(iter([pa.record_batch([pa.nulls(batch.num_rows), batch.column(text_at)], names=["id", "text"])])):
                good.append(np.array([x != UNKNOWN for x in got.column(1).to_pylist()], bool) & (got.column(2).to_numpy() >= least))
            yield batch.filter(pa.array(np.concatenate(good)))

    return keep


def keep_identified(docs: DataFrame, model: Model, least: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all their columns, that have a language with a score of ``least`` or more."""
    spark = docs.sparkSession
    return docs.mapInArrow(_keeper(spark.sparkContext.broadcast(model), docs.columns.index(text_col), least), docs.schema)
