"""Each operator against brute force on small hostile tables: nulls, empties, ties, repeats, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import bpe, embedding_dedup, exact_dedup, language_id, license_scan, mixing, near_dedup, shingles, token_counts, token_store, warc
from tidemark.llm.components import components
from tidemark.llm.queries import QUERIES

WORD_JSON, BYTE_JSON = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
# "_id", "label" and "kept" clash with names that operators use.
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _id string, kept string, label string"
RND = random.Random(7)
WORDS = ["".join(RND.choices("abcdefgh", k=RND.randint(2, 8))) for _ in range(300)]


def prose(n, rnd=RND):
    return " ".join(rnd.choices(WORDS, k=n))


BASE = prose(200)
EDITED = BASE.replace(BASE.split()[50], "changed", 1)
TEXTS = [None, "", " \n\t", "Hello, World! it's 42 <|endoftext|> a<|STARTOFTEXT|>b", "x" * 3000, prose(4000), BASE, BASE, EDITED, "ÀÉ İstanbul ΣΑΣ 日本語 é́ \x1c y\xa0z", "one two", "one two", "Released under the MIT License. (CC BY-NC 4.0)", prose(30)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "fr", None][i % 3], ["a", "b", None][i % 3], 0, "x", "y", "z") for i, t in enumerate(TEXTS)]
    rows += [rows[6], (None, "null id", "en", "a", 0, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_copies(docs, empty, keep):
    best = max if keep == "largest" else min
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    groups = {t: [i for i, u in rows if u == t] for _, t in rows}
    got = exact_dedup.copy_groups(docs, keep=keep).collect()
    assert len(got) == len(rows) and sum(r["kept"] for r in got) == len(groups)
    text_of = {i: t for i, t in rows}
    for r in got:
        ids = groups[text_of[r["doc_id"]]]
        assert r["group_size"] == len(ids) and r["keep_id"] == (best(ids) if None not in ids else None)
        assert r["text_sha256"] == hashlib.sha256(text_of[r["doc_id"]].encode()).hexdigest()
    assert exact_dedup.copy_groups(empty).count() == 0
    stay = exact_dedup.drop_copies(docs, keep=keep)
    assert stay.columns == docs.columns and stay.count() == len(groups)


def test_hot_copies_cross_partitions(spark):
    df = spark.range(2000).selectExpr("id as doc_id", "case when id % 3 < 2 then 'same' else cast(id as string) end as text")
    got = exact_dedup.copy_groups(df).filter("text_sha256 = '%s'" % hashlib.sha256(b"same").hexdigest()).collect()
    assert len(got) == 1334 and {(r["keep_id"], r["group_size"]) for r in got} == {(1999, 1334)}
    assert sum(r["kept"] for r in got) == 1
    assert exact_dedup.drop_copies(df).filter("text = 'same'").count() == 1


def library(path, texts):
    return [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_token_counts(docs, empty):
    want = dict(zip(range(len(TEXTS)), map(len, library(WORD_JSON, TEXTS))))
    got = token_counts.count_tokens(docs, WORD_JSON, chunk_chars=400, overlap_chars=16).collect()
    assert len(got) == docs.count()
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_tokens"], r["n_bytes"]) == (want[r["doc_id"]], len((TEXTS[r["doc_id"]] or "").encode()))
    assert token_counts.count_tokens(empty, WORD_JSON).count() == 0


WORD_TOK, TOK = Tokenizer.from_file(WORD_JSON), Tokenizer.from_file(BYTE_JSON)
# Turkish capitals, combining marks, contractions, added tokens, odd blanks, Hangul in parts.
ODD = st.lists(st.sampled_from([*"absXİıéÉ\u0301\u0307.,!?' \n\xa0\u3000日本Σς12ŉǅ\u1100\u1161", "<|endoftext|>", "<|startoftext|>", "'s", "'LL", "İ.", "Aİ!", "the"]), max_size=120).map("".join)


@settings(max_examples=60, deadline=None)
@given(st.lists(ODD, max_size=6))
def test_words_of_any_text(texts):
    ids, sizes = ENCODER.encode([t.encode() for t in texts])
    assert np.split(ids, np.cumsum(sizes))[: len(texts)] == [] or [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == library(WORD_JSON, texts)


ENCODER = token_store.WordEncoder(WORD_TOK)


@settings(max_examples=150, deadline=None)
@given(ODD, st.integers(8, 40), st.integers(1, 12))
def test_splices(text, chunk, overlap):
    for tok in (WORD_TOK, TOK):
        encode = lambda t: tok.encode(t, add_special_tokens=False)  # noqa: B023, E731
        assert token_counts.encode_long(text, encode, chunk, overlap, margin=15).tolist() == encode(text).ids


def test_bpe(docs, empty):
    tok = Tokenizer.from_file(BYTE_JSON)
    want = library(BYTE_JSON, TEXTS)
    for r in bpe.encode_documents(docs, BYTE_JSON, full=True).filter("doc_id is not null").collect():
        ids = want[r["doc_id"]]
        assert r["ids"] == ids and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded"] == tok.decode(ids, skip_special_tokens=False)
    assert bpe.encode_documents(empty, BYTE_JSON).count() == 0


CODER = bpe.Coder(open(BYTE_JSON, encoding="utf-8").read())


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_bpe_of_any_text(text):
    n, ids, decoded = CODER.documents([text])[0]
    want = TOK.encode(text, add_special_tokens=False).ids
    assert ids == ",".join(map(str, want)) and n == len(want) and decoded.decode("utf-8", "replace") == TOK.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["ab" * 100_000, "日本語" * 60_000, "a1B2+" * 50_000, "".join(random.Random(1).choices("abcdefghij", k=200_000))], ids=["period", "han", "mixed", "random"])
def test_long_texts_without_blanks(text):
    """Linear time: the whole test takes seconds."""
    n, ids, _ = CODER.documents([text])[0]
    assert ids == ",".join(map(str, TOK.encode(text, add_special_tokens=False).ids))
    assert not any(len(w) > bpe.LONG_WORD for w in CODER.known)
    encode = lambda t: WORD_TOK.encode(t, add_special_tokens=False)
    assert token_counts.encode_long(text, encode, margin=15).tolist() == encode(text).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "ab", "the", "ing", "=", "日", "e9"]), min_size=1, max_size=600).map("".join))
def test_mended_words(text):
    ids = CODER.greedy(text.encode())
    pair = lambda a, b: CODER._fits(a * (CODER.base + 1) + b + 1)
    assert CODER.mended(ids, [i for i, (a, b) in enumerate(zip(ids, ids[1:])) if not pair(a, b)]) == CODER._merged_by_heap(text.encode()) == TOK.encode(text, add_special_tokens=False).ids


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=40), st.binary(max_size=40))
def test_crc_of_joined_strings(a, b):
    assert token_store.crc_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_documents_go_on_in_the_next_file(monkeypatch):
    """Files of 20 ids in groups of 5: pieces of documents are joined by their CRCs."""
    monkeypatch.setattr(token_store, "BLOCK", 5)
    monkeypatch.setattr(token_store, "GROUP", 1)
    monkeypatch.setattr(token_store, "FILE_IDS", 20)
    rnd = np.random.default_rng(3)
    docs = [rnd.integers(0, 60_000, n).astype(np.uint32) for n in (3, 1, 50, 7, 20, 19, 1, 1)]
    files = token_store.Files(4)
    rows = [r for a in range(0, 8, 3) for r in files.add(np.arange(a, min(8, a + 3)), np.zeros(3, bool)[: 8 - a], np.concatenate(docs[a : a + 3]), np.array([len(d) for d in docs[a : a + 3]]))]
    rows += files.close()
    parts: dict[int, list] = {}
    held: list[bytes] = []
    for row in rows:
        held.append(row)
        if row.endswith(token_store.MAGIC) and len(row) > len(token_store.MAGIC):
            part, number, pieces, ids = token_store.read_file(memoryview(b"".join(r + b"\n" for r in held)))
            assert part == 4 and len(held) <= 6
            for i, (n, x) in enumerate(zip(pieces["number"], ids)):
                parts.setdefault(int(n), []).append((int(pieces["skip"][i]), x, int(pieces["total"][i])))
            held = []
    assert not held and sorted(parts) == list(range(8))
    for n, got in parts.items():
        assert np.concatenate([x for _, x, _ in sorted(got, key=lambda g: g[0])]).tolist() == docs[n].tolist() and got[0][2] == len(docs[n])
        crc = 0
        for _, x, _ in sorted(got, key=lambda g: g[0]):
            crc = token_store.crc_joined(crc, zlib.crc32(x.astype("<u4").tobytes()), 4 * len(x))
        assert crc == zlib.crc32(docs[n].astype("<u4").tobytes())


def test_token_files(docs, empty):
    rows = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"]) for r in docs.collect()), key=lambda r: r[:2])
    ids = [x + [1] for x in library(WORD_JSON, [r[2] for r in rows])]
    start = np.cumsum([0, *map(len, ids)])
    want = sorted((r[1] if r[0] else -1, int(s), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for r, s, x in zip(rows, start, ids))
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_store.round_trip(docs, WORD_JSON).collect())
    assert got == want
    assert token_store.round_trip(empty, WORD_JSON).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 50), st.integers(0, 2**32 - 1)), min_size=1, max_size=300))
def test_blocks(values):
    ids = np.array(values, np.uint32)
    assert token_store.unpack_block(memoryview(token_store.pack_block(ids)), 0).tolist() == values


def test_mixing(docs, empty):
    got = mixing.mix(docs).collect()
    for r in got:
        if r["doc_id"] is not None:
            assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", TEXTS[r["doc_id"]] or ""))
        assert 0 <= r["taken"] <= 3 * r["size"]
    again = mixing.mix(docs.repartition(2)).collect()
    key = lambda rows: sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in rows)
    assert key(got) == key(again)
    assert mixing.mix(empty).count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_mix_is_the_queue_by_brute_force(spark):
    """Finish times in shuffled order, all copies in one queue, cut at the budget."""
    rnd = random.Random(4)
    rows = [(i, "w " * rnd.randint(0, 9), rnd.choice(["a", "a", "a", "b", None])) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    shuffled = [r[0] for r in df.orderBy(mixing.F.xxhash64("doc_id", mixing.F.lit(17)), "doc_id").collect()]
    size = {i: len(t.split()) for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    total = Counter()
    for i in size:
        total[source[i]] += size[i]
    target = mixing.fair_targets(dict(total), (5, 2, 1), 1.0, 3)
    queue, through = [], Counter()
    for turn in range(3):
        for i in shuffled:
            through[source[i]] += size[i]
            if turn <= target[source[i]] // total[source[i]] and size[i]:
                queue.append((through[source[i]] / target[source[i]], str(source[i]), i, turn))
    want, left = Counter(), sum(total.values())
    for _, _, i, _ in sorted(queue):
        left -= size[i]
        if left < 0:
            break
        want[i] += size[i]
    got = {r["doc_id"]: r["taken"] for r in mixing.mix(df).collect()}
    # Documents of equal finish times at the cut may change places.
    assert sum(got[i] != want[i] for i in got) <= 2


def test_unlike_documents_under_one_id_have_copies_of_their_own(spark):
    rows = [(1, f"word{i} " * (1 + i % 5), "a" if i % 4 else "b", {"k": i}) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, extra struct<k:bigint>")
    often = Counter(r["extra"]["k"] for r in mixing.mixed_documents(df).collect())
    taken = Counter({k: 0 for k in range(80)})
    for r in mixing.mix(df, row_key=mixing.F.col("extra.k")).collect():
        taken[r["row_key"]] = r["copies"]
    assert +often == +taken and len(set(taken.values())) > 1


def test_targets_come_near(spark):
    df = spark.range(6000).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 37 as int)) as text", "case when id % 3 = 0 then 'hot' else concat('s', id % 7) end as source")
    got = mixing.mix(df).join(df, "doc_id").groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    for r in got:
        assert r["sum(taken)"] == pytest.approx(r["max(target)"], abs=150)


def test_fair_targets():
    t = mixing.fair_targets({"a": 10, "b": 1000, None: 1000}, (5, 2, 1), 1.0, 3)
    assert t["a"] == 30 and t["b"] == pytest.approx(1980 * 2 / 3) and t[None] == pytest.approx(1980 / 3)
    assert mixing.fair_targets({"a": 0}, (5,), 1.0, 3) == {"a": 0.0}


def test_warc(spark):
    big = "<p>" + "x\r\n\r\nWARC/1.1\r\n" * 20
    rows = [(5, "http://a/", big, 1), (3, None, big, 1), (3, None, big, 1), (9, "bad url\r\n", "short", 1), (8, "u", "short", 1), (7, "u", None, 1), (1, "é", "ü" * 60, 1)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, record_type int")
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(df).collect())
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    n = len(big)
    assert got == Counter([(3, n, sha(big), "response", None), (3, n, sha(big), "revisit", 3), (5, n, sha(big), "revisit", 3), (9, 5, sha("short"), "response", None), (8, 5, sha("short"), "response", None), (7, 0, sha(""), "response", None), (1, 120, sha("ü" * 60), "response", None)])
    assert warc.round_trip(df.limit(0)).count() == 0
    named = df.filter("page_id in (5, 9)").withColumn("page_id", warc.F.concat(warc.F.lit("a:/<%>"), "page_id"))
    assert sorted(r["page_id"] for r in warc.round_trip(named).collect()) == ["a:/<%>5", "a:/<%>9"]


def test_archives_are_members_and_end_at_a_size(spark, tmp_path):
    import gzip

    big = [(i, "u", f"{i} " + random.Random(i).randbytes(2000).hex()) for i in range(40)]
    df = spark.createDataFrame(big, "page_id bigint, url string, html string").coalesce(1)
    warc.write_archives(df, f"file://{tmp_path}/w", file_bytes=10_000)
    files = sorted((tmp_path / "w").glob("part-*"))
    assert len(files) > 5 and all(f.stat().st_size < 20_000 for f in files)
    for f in files:
        raw = f.read_bytes()
        # The whole unpacks as one stream of records, and each record from its own member.
        records = [m for m in warc.members(memoryview(raw)) if m != warc.END.encode()]
        assert gzip.decompress(raw) == b"".join(m if m.endswith(b"\r\n\r\n") else m + b"\r\n\r\n" for m in records)
        assert all(m.startswith(b"WARC/1.1\r\n") for m in records)
    assert warc.read_archives(spark, f"file://{tmp_path}/w").count() == 40


def test_reading_an_archive_takes_linear_work(monkeypatch):
    """Bytes that go through the unpacker: the file's, and one piece more for each member."""
    given = []

    class Counted:
        def __init__(self, bits):
            self.inner = zlib.decompressobj(bits)

        def decompress(self, data):
            given.append(len(data))
            return self.inner.decompress(data)

        def __getattr__(self, name):
            return getattr(self.inner, name)

    class Library:
        decompressobj, compressobj, DEFLATED = Counted, zlib.compressobj, zlib.DEFLATED

    rnd = random.Random(2)
    made = [rnd.randbytes(n) for n in [0, 1, 16_000, 16_384, 200_000] + [900] * 2000]
    raw = b"".join(map(warc.member, made))
    monkeypatch.setattr(warc, "zlib", Library)
    assert list(warc.members(memoryview(raw))) == made
    assert sum(given) <= len(raw) + len(made) * (16 << 10)
    with pytest.raises(ValueError, match="cut off"):
        list(warc.members(memoryview(raw[:-1])))
    assert list(warc.members(memoryview(b""))) == []


def test_licenses(docs, empty):
    got = {r["doc_id"]: r for r in license_scan.scan(docs).collect()}
    r = got[12]
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (10, 2, 2, 5, "cc-by-nc,mit")
    assert "mit" in r["labels"] and r["score"] > 0.9
    assert (got[0]["n_words"], got[0]["base_labels"], got[0]["labels"], got[0]["score"], got[0]["first_word"]) == (0, "", "", 0.0, None)
    assert license_scan.scan(empty).count() == 0
    assert len(license_scan.rules()) > 300


def test_weaker_rules_are_suppressed(spark):
    df = spark.createDataFrame([(1, "Licensed under the GNU General Public License, version 3."), (2, "SPDX-License-Identifier: MIT the mit license the mit license")], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in license_scan.scan(df).collect()}
    assert got[1]["labels"] == "gpl-3" and got[2]["n_base"] == 2 and got[2]["labels"] == "mit"


def test_licenses_by_brute_force(spark):
    """All columns against loops over words and pairs of matches, on texts made of rules' words."""
    rnd = random.Random(11)
    pool = ["released under the mit license", "SPDX-License-Identifier: Apache-2.0", "the GNU General Public License, version 2", "licensed under the terms of the cc by nc 4.0 license", "all rights reserved", "apache license version 2", "new bsd license", "license is", "the", "é", "mit", "under", "Permission is hereby granted, free of charge, to any person obtaining a copy"]
    texts = [" ".join(rnd.choices(pool, k=rnd.randint(0, 60))) for _ in range(25)]
    made = license_scan.rules()
    for r, text in zip(license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).orderBy("doc_id").collect(), texts):
        words = re.findall(license_scan.WORD, re.sub("[A-Z]", lambda m: m.group().lower(), text))
        line = " " + " ".join(words) + " "
        found = []
        for rule in made:
            if f"{rule.keyword}" in line:
                for m in re.finditer(f" (?:{rule.pattern})(?= )", line):
                    a = line[: m.start()].count(" ")
                    found.append((a, a + m.group().count(" "), rule))
        def inside(d, o):
            return o[0] <= d[0] and o[1] >= d[1] and (o[2].priority > d[2].priority or (o[2].priority == d[2].priority and o[1] - o[0] > d[1] - d[0]))
        kept = [d for d in found if d[2].base or not any(inside(d, o) for o in found)]
        base = [d for d in found if d[2].base]
        assert r["n_words"] == len(words) and r["n_base"] == len(base)
        assert sorted((d["a"], d["b"], d["label"]) for d in r["detections"]) == sorted((a, b, x.label) for a, b, x in kept)
        assert r["labels"] == ",".join(sorted({x.label for _, _, x in kept})) and r["base_labels"] == ",".join(sorted({x.label for _, _, x in base}))
        assert (r["first_word"], r["last_word"]) == ((min(a for a, _, _ in base), max(a for a, _, _ in base)) if base else (None, None))


def test_many_license_phrases(spark):
    df = spark.range(1).selectExpr("1 as doc_id", "repeat('released under the mit license ', 20000) as text")
    r = license_scan.scan(df).collect()[0]
    assert (r["n_words"], r["n_base"], r["last_word"], r["labels"], len(r["detections"])) == (100_000, 20_000, 99_997, "mit", 40_000)


def alternatives(parsed):
    """Texts that a pattern matches: each branch, option and letter of it at least once."""
    out = [""]
    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL":
            some = [chr(arg)]
        elif op == "BRANCH":
            some = [t for branch in arg[1] for t in alternatives(branch)]
        elif op == "SUBPATTERN":
            some = alternatives(arg[3])
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            some = ([""] if arg[0] == 0 else []) + alternatives(arg[2])
        elif op == "IN":
            some = [chr(x[0] if isinstance(x, tuple) else x) if str(k) != "CATEGORY" else "7" for k, x in arg]
        else:
            assert op == "ANY"
            some = ["x"]
        out = [a + b for a in out for b in some]
    return out


def test_every_alternative_of_every_license_rule_passes_the_filters(spark):
    names = {(label, key, pattern) for label, key, pattern in license_scan.NAMES}
    uses = [u for _, _, use in license_scan.USES for u in alternatives(re._parser.parse(use.replace("{}", "@")))]
    name_texts = {(key, t) for _, key, pattern in names for t in alternatives(re._parser.parse(pattern))}
    sentences = {(key, t) for _, key, pattern in license_scan.SENTENCES for t in alternatives(re._parser.parse(pattern))}
    # A name is held against its keyword in one use, and every use with one name.
    rows = {(key, f"license {t}") for key, t in name_texts} | {("isc", u.replace("@", "isc")) for u in uses} | sentences
    df = spark.createDataFrame(sorted(rows), "key string, text string")
    lost = df.filter(~license_scan.gate(df["text"], license_scan.BASE) | ~license_scan.F.contains(license_scan.normalised(df["text"]), df["key"]))
    assert lost.collect() == []


def test_licenses_whose_name_is_one_word(spark):
    texts = {"Licensed under the Expat License": ("mit", 0.95), "FreeBSD License": ("bsd-2", 0.7), "SPDX-License-Identifier: 0BSD": ("0bsd", 1.0)}
    texts["You can redistribute it and/or modify it under the terms of the GNU General Public License"] = ("gpl", 1.0)
    got = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: (r["labels"], r["score"]) for r in got} == dict(enumerate(texts.values()))


def test_license_query_takes_the_contracts_phrases(spark, tmp_path):
    """Words, places and labels of the query by loops over words, on texts of odd words and separators."""
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    rnd = random.Random(5)
    odd = ["under", "the", "MIT", "license", "under the mit license", "Apache License, Version 2.0", "CC-BY-NC", "cc", "by", "mıt", "lİcense", "licenſe", "\U0001f600", "nc\u0301"]
    seps = [" ", " ", "-", "\r\n", "", "\x00", "\x01", "\xa0", "\u2003", "[", "\x7f", "\u0085"]
    texts = [None, "the MIT license", "Released under the MIT License."] + ["".join(rnd.choice(odd) + rnd.choice(seps) for _ in range(rnd.randint(0, 30))) for _ in range(60)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in QUERIES["op6_license_scan"](spark, str(tmp_path)).collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), texts[r["doc_id"]] or ""))
        at = [(i, label) for phrase, label in phrases.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        places = [i for i, _ in at]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(at), min(places, default=None), max(places, default=None))
        assert r["base_labels"] == ",".join(sorted({label for _, label in at})) and {label for _, label in at} <= set(r["labels"].split(","))


def test_language(spark, docs, empty):
    rnd = random.Random(3)
    make = lambda w, n: " ".join(rnd.choices(w, k=n))
    en, fr = ["the", "and", "thing", "which", "over"], ["le", "été", "quelque", "pour", "où"]
    rows = [(i, make(en if i % 2 else fr, 30), "en" if i % 2 else "fr") for i in range(200)]
    train = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.fit(train)
    mixed = make(en, 20) + " " + make(fr, 40)
    test = spark.createDataFrame([(1, make(en, 20)), (2, make(fr, 20)), (3, None), (4, "123 !?"), (5, mixed), (6, "日本")], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in language_id.identify(test, model, with_spans=True).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 4, 5)] == ["en", "fr", "und", "und", "fr"]
    assert [s["lang"] for s in got[5]["spans"]] == ["en", "fr"] and got[6]["score"] == 0 and got[3]["score"] == 0
    assert language_id.identify(test, language_id.fit(empty)).filter("lang_pred <> 'und'").count() == 0
    assert language_id.identify(empty, model).count() == 0
    assert language_id.keep_identified(docs, model, 0.0).columns == docs.columns


def test_best_paths_by_brute_force():
    from itertools import product

    rnd = np.random.default_rng(8)
    model = language_id.Model(["a", "b", "c"], np.zeros((1, 3), np.float32), np.ones((1, 3), bool))
    sizes = [1, 5, 3, 6]
    score = -rnd.random((sum(sizes), 3)) * 12
    text_of = np.repeat(np.arange(4), sizes)
    path = model.paths(text_of, score)
    worth = lambda s, p: sum(s[i, k] for i, k in enumerate(p)) - language_id.SWITCH * sum(x != y for x, y in zip(p, p[1:]))
    for t in range(4):
        s = score[text_of == t]
        assert worth(s, path[text_of == t]) == pytest.approx(max(worth(s, p) for p in product(range(3), repeat=len(s))))


def test_long_text_in_pieces(monkeypatch, spark):
    """A text that is cut into pieces has the words, scores and spans of the whole."""
    rows = [(i, ("the and which over thing " if i % 2 else "le été quelque pour où ") * 8, "en" if i % 2 else "fr") for i in range(60)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert len(model.words([""]).begin) == 0
    texts = ["", "the thing  " * 40 + "quelque été " * 50, "x", "1 2"]
    whole = model.words(texts)
    monkeypatch.setattr(language_id, "PIECE_CHARS", 37)
    cut = model.words(texts)
    for k in ("text_of", "begin", "end", "known", "score"):
        assert np.allclose(getattr(whole, k), getattr(cut, k))


def all_pairs(texts, weights, threshold):
    """Classes by comparing every two texts in full."""
    a, b = np.triu_indices(len(texts), 1)
    sim = near_dedup.weighted_jaccard(pa.array([texts[i] for i in a]), pa.array([texts[i] for i in b]), weights)
    root = np.arange(len(texts))
    links = [(i, j) for i, j, s in zip(a, b, sim) if s >= threshold or texts[i] == texts[j]]
    for _ in range(len(texts)):
        was = root.copy()
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
        if (was == root).all():
            return root, len(links)


@pytest.mark.parametrize("damping,slack", [(0.25, 3.0), (0.0, None), (1.0, None)])
def test_classes_by_brute_force(spark, damping, slack):
    """Edited copies at all similarities, one hot group, repeated rows; ids are strings."""
    rnd = random.Random(21)
    hot, texts = prose(150, rnd), []
    for i in range(240):
        words = (hot if i % 3 == 0 else prose(rnd.randint(1, 120), rnd) if i % 3 == 1 or not texts else rnd.choice(texts)).split()
        for _ in range(rnd.randint(0, 4)):
            words[rnd.randrange(len(words))] = f"new{rnd.randint(0, 9)}"
        texts.append(" ".join(words))
    df = spark.createDataFrame([(f"d{i:04}", t) for i, t in enumerate(texts)], "doc_id string, text string")
    weights = shingles.fit_weights(df.select("text"), damping=damping)
    root, links = all_pairs(texts, weights, 0.8)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(df, damping=damping, slack=slack).collect()}
    same = sum(got[f"d{i:04}"] == f"d{r:04}" for i, r in enumerate(root))
    assert links > 100 and same >= 0.99 * len(texts)
    # Nothing is joined that brute force leaves apart.
    assert all(root[int(c[1:])] == root[int(i[1:])] for i, c in got.items())


def test_salted_buckets_are_compared_in_any_batches():
    """Pairs of members and leaders against loops, wherever batches are cut, and no row for a pair that samples rule out."""
    rnd = random.Random(4)
    bands = {n: [rnd.randrange(3) * 100 + k for k in range(near_dedup.BANDS)] for n in range(40)}
    low = {n: bytes(rnd.choices([1, 2], [9, 1], k=385)) for n in bands}
    name = lambda n: hashlib.md5(str(n).encode()).digest()
    label = {n: name(n % 25) for n in bands}
    lead = {n: n % 3 == 0 for n in bands}
    rows, want = [], set()
    for bucket in sorted({b for x in bands.values() for b in x}):
        inside = [n for n in bands if bucket in bands[n]]
        for salt in (0, 1):
            for leads in (False, True):
                rows += [(bucket, salt, name(n), label[n], lead[n], bands[n], low[n], leads) for n in inside if (lead[n] if leads else n % 2 == salt)]
        want |= {
            (name(m), name(r)) for m in inside for r in inside
            if lead[r] and label[m] != label[r] and (not lead[m] or name(m) < name(r)) and min(set(bands[m]) & set(bands[r])) == bucket
            and sum(a == b for a, b in zip(low[m][:98], low[r])) >= near_dedup.min_alike(98, 0.8, 5.0) and sum(a == b for a, b in zip(low[m], low[r])) >= near_dedup.min_alike(385, 0.8, 3.0)
        }
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.bool_(), pa.list_(pa.int64()), pa.binary(), pa.bool_()]
    names = ["bucket", "salt", "node", "label", "lead", "bands", "samples", "leads"]
    whole = pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)
    assert 50 < len(want)
    for n in (1, 7, 64, len(rows)):
        got = [(r["a"], r["b"]) for b in near_dedup._comparer(385, 0.8, 3.0)([whole.slice(i, n) for i in range(0, len(rows), n)]) for r in b.to_pylist()]
        assert len(got) == len(set(got)) and set(got) == want


def test_near_duplicates(docs, empty):
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).collect()}
    assert got[6] == got[7] == got[8] == 6 and got[10] == got[11] == 10 and got[None] is None
    assert all(got[i] == i for i in (3, 4, 5, 9, 12, 13))
    assert near_dedup.near_duplicates(empty).count() == 0
    stay = near_dedup.drop_near_copies(docs)
    assert stay.columns == docs.columns and stay.filter("doc_id in (6, 7, 8)").count() == 1


def test_unlike_texts_under_one_id_stay(spark):
    """Id 5 has a text of its own and an edited copy of id 3's; id 7 has two texts alike, one of them twice."""
    alike, own, twice = prose(200), prose(200), prose(200)
    rows = [(3, alike, "a"), (5, alike + " tail", "b"), (5, own, "c"), (7, twice, "d"), (7, twice + " tail", "e"), (7, twice, "f"), (7, twice + " tail", "g")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, tag string")
    got = sorted((r["doc_id"], r["class_id"], r["kept"]) for r in near_dedup.near_duplicates(df).collect())
    assert got == [(3, 3, True), (5, 3, False), (5, 5, True)] + [(7, 7, False)] * 2 + [(7, 7, True)] * 2
    first, again = ({(r["doc_id"], r["text"], r["tag"]) for r in near_dedup.drop_near_copies(df.repartition(n)).collect()} for n in (1, 3))
    assert first == again and len(first) == 3
    assert {(3, alike), (5, own)} < {r[:2] for r in first}


def test_near_duplicates_in_chains(spark):
    """Neighbours of a chain are alike, others aren't; copies of one link make it the leader."""
    words = prose(300).split()
    chain = [" ".join([f"new{i}" if i < 13 * k else w for i, w in enumerate(words)]) for k in range(8)]
    rows = [(100 + i, t) for i, t in enumerate(chain)] + [(200 + i, chain[3] + f" tail{i}") for i in range(40)] + [(1, prose(50))]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["class_id"] for r in got if r["doc_id"] > 1} == {100}
    assert [r["class_id"] for r in got if r["doc_id"] == 1] == [1]


def test_frequent_shingles_in_any_split(spark):
    """Each document has one shingle of its own, every third also three that these share."""
    docs = spark.range(600).selectExpr("concat('a', id, ' b c d e', if(id % 3 = 0, ' f g h', '')) AS text")
    one, many = (shingles.fit_weights(docs.repartition(n)) for n in (1, 40))
    assert one.hashes.tolist() == many.hashes.tolist() and one.factor.tolist() == many.factor.tolist()
    assert len(one.hashes) == 3


def test_weighted_jaccard():
    none = shingles.Weights(np.zeros(0, np.uint64), np.zeros(0), 1, 0.5)
    got = near_dedup.weighted_jaccard(pa.array(["a b c d e f", "", "a b", "x y z"]), pa.array(["a b c d e g", "", "A, b!", "x y"]), none)
    assert got.tolist() == [pytest.approx(1 / 3), 0, 1, 0]


def test_samples_agree_as_often_as_texts_are_similar():
    none = shingles.Weights(np.zeros(0, np.uint64), np.zeros(0), 1, 0.5)
    a, b = BASE, " ".join(BASE.split()[:160] + prose(40).split())
    (want,) = near_dedup.weighted_jaccard(pa.array([a]), pa.array([b]), none)
    ((_, _, text, h, n),) = shingles.shingle_blocks(pa.array([a, b]))
    same = [x[0] == x[1] for x in (near_dedup.weighted_samples(text, h, n.astype(float), k)[1] for k in range(1500))]
    assert np.mean(same) == pytest.approx(want, abs=0.05)


def test_embeddings(spark):
    rnd = np.random.default_rng(5)
    base = rnd.normal(size=(40, 16))
    vecs = np.concatenate([base[rnd.integers(0, 40, 300)] + 0.12 * rnd.normal(size=(300, 16)), np.repeat(base[:1], 30, 0)])
    rows = [(i, [float(x) for x in v], int(i % 2), 0) for i, v in enumerate(vecs)]
    odd = [(900, None, 1, 0), (901, [0.0] * 16, 1, 0), (902, [float("nan")] * 16, 1, 0), (903, [None] + [1.0] * 15, 1, 0), (904, rows[0][1], None, 0), (905, [], 1, 0)]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>, label int, component_id int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_vectors(df).collect()}
    for label in (0, 1):
        ids = np.array([r[0] for r in rows if r[2] == label])
        x = vecs[ids]
        hit = (x @ x.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1)) >= 0.93
        np.fill_diagonal(hit, False)
        root = ids.copy()
        for _ in range(len(ids)):
            root = np.minimum(root, np.where(hit, root[None, :], 10**9).min(1))
        assert {int(i): got[i] for i in ids} == {int(i): (int(n), int(r), i == r) for i, n, r in zip(ids, hit.sum(1), root)}
    assert all(got[r[0]] == (0, r[0], True) for r in odd)
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 40), (50, 60)], "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in components(links).collect()}
    assert all(got[i] == 0 for i in range(21)) and got[50] == got[60] == got[40] == 40


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {"doc_id", "n_tokens", "ids"} <= set(out[0].asDict()) and len(corpus_pipeline.STAGES) == 5
    want = library(BYTE_JSON, TEXTS)
    assert all(r["ids"] == want[r["doc_id"]] for r in out if r["doc_id"] is not None)
    assert not {0, 1, 2, 7, 8} & {r["doc_id"] for r in out}


def test_pipeline_of_an_empty_table(spark, empty, tmp_path):
    import corpus_pipeline

    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    rows = [(i, i, "a b", "en", "s") for i in range(2)]
    df = spark.createDataFrame(rows, "doc_id bigint, _id bigint, text string, lang string, source string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df, "").columns == df.columns, name
