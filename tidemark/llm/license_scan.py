"""License scan with ordered signature rules, in DataFrame functions only.

A text is reduced to its words.  A keyword prefilter, first of the whole scan and
then of each family of rules, decides which regexes run at all.  Every match has
a span of words and a priority; a match inside the span of another of higher
priority, or inside a longer one of the same priority, is suppressed.  Base
phrases are counted apart and are never suppressed.

Defined results: null text is empty: no words, no labels (empty strings), null
positions, score 0; ids pass through, nulls and repeats too; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A word before A-Z is lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

BASE = {"the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Names of licences: label, keyword that any match holds from a word's start, pattern over words.
NAMES: list[tuple[str, str, str]] = [
    ("mit", "mit", r"mit"),
    ("mit", "expat", r"expat"),
    ("mit-0", "mit", r"mit (?:no attribution|0)"),
    ("x11", "x11", r"x11"),
    ("isc", "isc", r"isc"),
    ("bsd", "bsd", r"(?:bsd|berkeley software distribution bsd)"),
    ("bsd-2", "bsd", r"(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd)"),
    ("bsd-2", "freebsd", r"freebsd"),
    ("bsd-3", "bsd", r"(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|revised bsd|modified bsd)"),
    ("bsd-4", "bsd", r"(?:bsd 4 clause|4 clause bsd|original bsd)"),
    ("0bsd", "bsd", r"(?:zero clause bsd|bsd zero clause)"),
    ("0bsd", "0bsd", r"0bsd"),
    ("apache", "apache", r"apache(?: software)?"),
    ("apache-1", "apache", r"apache(?: software)?(?: license)?(?: version)? 1(?: [01])?"),
    ("apache-2", "apache", r"apache(?: software)?(?: license)?(?: version)? 2(?: 0)?"),
    ("gpl", "general public", r"(?:gnu )?general public"),
    ("gpl-1", "general public", r"(?:gnu )?general public license(?: version)? v?1"),
    ("gpl-2", "general public", r"(?:gnu )?general public license(?: version)? v?2"),
    ("gpl-3", "general public", r"(?:gnu )?general public license(?: version)? v?3"),
    ("gpl-2", "gpl", r"(?:gnu )?gpl ?v?2(?: 0)?(?: only| or later)?"),
    ("gpl-3", "gpl", r"(?:gnu )?gpl ?v?3(?: 0)?(?: only| or later)?"),
    ("gpl", "gpl", r"(?:gnu )?gpl"),
    ("lgpl", "lesser general", r"(?:gnu )?lesser general public"),
    ("lgpl-2", "lesser general", r"(?:gnu )?lesser general public license(?: version)? v?2(?: 1)?"),
    ("lgpl-3", "lesser general", r"(?:gnu )?lesser general public license(?: version)? v?3"),
    ("lgpl-2", "lgpl", r"lgpl ?v?2(?: [01])?(?: only| or later)?"),
    ("lgpl-3", "lgpl", r"lgpl ?v?3(?: 0)?(?: only| or later)?"),
    ("agpl-3", "affero", r"(?:gnu )?affero general public(?: license(?: version)? v?3)?"),
    ("agpl-3", "agpl", r"agpl ?v?3(?: 0)?(?: only| or later)?"),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation"),
    ("mpl", "mozilla public", r"mozilla public"),
    ("mpl-1", "mozilla public", r"mozilla public license(?: version)? v?1(?: [01])?"),
    ("mpl-2", "mozilla public", r"mozilla public license(?: version)? v?2(?: 0)?"),
    ("mpl-2", "mpl", r"mpl(?: v?2(?: 0)?)?"),
    ("epl-1", "eclipse public", r"eclipse public license(?: version)? v?1(?: 0)?"),
    ("epl-2", "eclipse public", r"eclipse public license(?: version)? v?2(?: 0)?"),
    ("epl", "eclipse public", r"eclipse public"),
    ("cddl", "common development", r"common development and distribution"),
    ("eupl", "european union public", r"european union public"),
    ("artistic", "artistic", r"artistic(?: license)?(?: 2(?: 0)?)?"),
    ("zlib", "zlib", r"zlib(?: libpng)?"),
    ("boost", "boost software", r"boost software(?: license)?(?: 1 0)?"),
    ("unlicense", "unlicense", r"unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("ofl", "open font", r"(?:sil )?open font"),
    ("ofl", "ofl", r"ofl(?: 1 [01])?"),
    ("odbl", "open database", r"open database"),
    ("odc-by", "open data commons", r"open data commons attribution"),
    ("openrail", "openrail", r"(?:bigscience |creativeml )?openrail(?: m)?"),
    ("postgresql", "postgresql", r"postgresql"),
    ("python", "python", r"python(?: software foundation)?"),
    ("php", "php", r"php(?: 3 0(?:1)?)?"),
    ("ruby", "ruby", r"ruby"),
    ("cc0", "cc0", r"cc0(?: 1 0)?"),
    ("cc0", "creative commons", r"creative commons (?:cc0|zero)(?: 1 0)?(?: universal)?"),
    ("cc", "creative commons", r"creative commons"),
    ("cc-by", "creative commons", r"creative commons attribution(?: [1-4] [05])?(?: international| unported)?"),
    ("cc-by-sa", "creative commons", r"creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported)?"),
    ("cc-by-nd", "creative commons", r"creative commons attribution no ?deriv(?:s|atives)(?: [1-4] [05])?(?: international| unported)?"),
    ("cc-by-nc", "creative commons", r"creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported)?"),
    ("cc-by-nc-sa", "creative commons", r"creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported)?"),
    ("cc-by-nc-nd", "creative commons", r"creative commons attribution non ?commercial no ?deriv(?:s|atives)(?: [1-4] [05])?(?: international| unported)?"),
    ("cc-by", "cc by", r"cc by(?: [1-4] [05])?"),
    ("cc-by-sa", "cc by sa", r"cc by sa(?: [1-4] [05])?"),
    ("cc-by-nd", "cc by nd", r"cc by nd(?: [1-4] [05])?"),
    ("cc-by-nc", "cc by nc", r"cc by nc(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "cc by nc sa", r"cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "cc by nc nd", r"cc by nc nd(?: [1-4] [05])?"),
    ("proprietary", "proprietary", r"proprietary"),
]

# How a name is put to use: priority, confidence, pattern.
USES: list[tuple[int, float, str]] = [
    (5, 1.0, r"spdx license identifier {}"),
    (4, 0.95, r"(?:licen[sc]ed|released|distributed|published|provided|available|offered) under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?{}(?: public)?(?: licen[sc]e)?(?: version \d+(?: \d+)?)?"),
    (3, 0.8, r"(?:under|subject to|governed by|covered by) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?{}(?: licen[sc]e)?(?: version \d+(?: \d+)?)?"),
    (2, 0.7, r"{} (?:style )?(?:software |public )?licen[sc]e(?: version \d+(?: \d+)?)?"),
    (2, 0.7, r"licen[sc]es? (?:is |type |name |type is )?{}"),
]

#: Every use has one of these, at a word's start.
USE_WORDS = ("licens", "licenc", "under", "subject to", "governed", "covered", "spdx")

# Sentences that only one licence has: label, keyword (as above), pattern.
SENTENCES: list[tuple[str, str, str]] = [
    ("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "permission to use copy modify", r"permission to use copy modify and or distribute this software for any purpose"),
    ("bsd", "redistributions of source code", r"redistributions of source code must retain the above copyright notice"),
    ("bsd-3", "neither the name of", r"neither the name of .{1,80}? may be used to endorse or promote products"),
    ("gpl", "you can redistribute it", r"you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("zlib", "altered source versions", r"altered source versions must be plainly marked as such"),
    ("unlicense", "unencumbered software", r"this is free and unencumbered software released into the public domain"),
    ("public-domain", "public domain", r"(?:dedicated|released|placed|is|are) (?:in|into|to) the public domain"),
    ("all-rights-reserved", "all rights reserved", r"all rights reserved"),
    ("cc0", "no rights reserved", r"no rights reserved"),
]


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    pattern: str
    priority: int
    confidence: float
    base: bool = False


def rules(base: Mapping[str, str] = BASE) -> list[Rule]:
    """All rules, highest priority first; base phrases stand first.

    Of the rules of one use, those of a more specific label ("cc-by-nc" before "cc") have priority.
    """
    made = [Rule(label, phrase, phrase, 90, 1.0, True) for phrase, label in base.items()]
    made += [Rule(label, key, pattern, 60, 1.0) for label, key, pattern in SENTENCES]
    made += [Rule(label, key, use.format(pattern), 10 * priority + label.count("-"), sure) for priority, sure, use in USES for label, key, pattern in NAMES]
    return sorted(made, key=lambda r: -r.priority)


def normalised(text: Column) -> Column:
    """Lower-cased words with one blank before, between and after them."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), SEPARATORS, " ")), F.lit(" "))


def _probe(keywords: Iterable[str]) -> str:
    """A regex over raw text that finds any of the keywords, each from a word's start."""
    gap = SEPARATORS.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")
    return "(?i)(?<!" + WORD.rstrip("+") + ")(?:" + "|".join(gap.join(k.split()) for k in sorted(set(keywords))) + ")"


def gate(text: Column, base: Mapping[str, str]) -> Column:
    """Whether any rule can match: a base phrase, a sentence's keyword, or a name's together with a use's."""
    has = lambda keys: F.rlike(text, F.lit(_probe(keys)))
    return (has(k for _, k, _ in NAMES) & has(USE_WORDS)) | has(base) | has(k for _, k, _ in SENTENCES)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, also where lambdas within use it for each element."""
    return F.transform(F.array(value), body)[0]


def _blanks(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))


#: Stands before the first word of a match; no word holds it.
MARK = "\x01"


def _spans(words: Column, rule: Column) -> Column:
    """Each match of a rule as a struct with its span of words."""
    pattern = F.concat(F.lit(" ("), rule["pattern"], F.lit(")(?= )"))
    marked = lambda: F.split(F.regexp_replace(words, pattern, F.lit(f" {MARK}$1")), F.lit(" "), -1)
    # The first element is the nothing before the first blank, so word 0 is element 1.
    starts = lambda: F.filter(F.transform(marked(), lambda w, i: F.when(F.startswith(w, F.lit(MARK)), i - 1)), F.isnotnull)
    nothing = F.array().cast("array<struct<a:int,b:int>>")
    sized = lambda found: F.zip_with(starts(), F.transform(found, _blanks), lambda a, n: F.struct(a.alias("a"), (a + n).cast("int").alias("b")))
    spans = _let(F.regexp_extract_all(words, pattern, F.lit(0)), lambda found: F.when(F.size(found) > 0, sized(found)).otherwise(nothing))
    # In this order of columns, what holds a match sorts before it.
    return F.transform(spans, lambda s: F.struct(s["a"].alias("a"), (-s["b"]).alias("minus_b"), (-rule["priority"]).alias("minus_priority"), rule["label"].alias("label"), rule["confidence"].alias("confidence"), rule["base"].alias("base")))


def detections(words: Column, made: list[Rule]) -> Column:
    """Matches of all rules whose keyword the text has, before suppression."""
    # Both tables are constants that the optimizer folds; as JSON they are one expression each.
    keywords = F.from_json(F.lit(json.dumps(sorted({r.keyword for r in made}))), "array<string>")
    present = F.filter(keywords, lambda k: F.contains(words, k))
    table = F.from_json(F.lit(json.dumps([asdict(r) for r in made])), "array<struct<label:string,keyword:string,pattern:string,priority:int,confidence:double,base:boolean>>")
    gated = _let(present, lambda p: F.filter(table, lambda r: F.array_contains(p, r["keyword"])))
    return F.flatten(F.transform(gated, lambda r: _spans(words, r)))


def unsuppressed(found: Column) -> Column:
    """Without matches that lie inside a stronger one; base phrases stay.  Sorted by place.

    What holds a match stands before it in sort order, and begins at most as many
    words before it as the longest match has.  So each match is held against the
    ``reach`` before it: the least power of four that goes back so far everywhere.
    """
    words = lambda d: -d["minus_b"] - d["a"]

    def beaten(d: Column, i: Column, every: Column, reach: Column) -> Column:
        def holds(k: Column) -> Column:
            o = F.get(every, i - k)
            # Of the same span, only what is stronger; of a longer one also what is as strong.
            same = (o["a"] == d["a"]) & (o["minus_b"] == d["minus_b"])
            return (o["minus_b"] <= d["minus_b"]) & ((o["minus_priority"] < d["minus_priority"]) | ((o["minus_priority"] == d["minus_priority"]) & ~same))

        return F.when(F.least(reach, i) > 0, F.exists(F.sequence(F.lit(1), F.least(reach, i)), holds)).otherwise(F.lit(False))

    def far_enough(every: Column, longest: Column, reach: Column) -> Column:
        apart = lambda i: F.get(every, i)["a"] - F.get(every, i - reach)["a"] >= longest
        return (reach >= F.size(every)) | F.forall(F.sequence(reach, F.greatest(reach, F.size(every) - 1)), apart)

    def kept(every: Column) -> Column:
        powers = F.array(*[F.lit(4**k) for k in range(2, 15)])
        # The first that is enough ends the search.
        least = lambda longest: F.aggregate(powers, F.lit(0), lambda acc, p: F.when(acc > 0, acc).when(far_enough(every, longest, p), p).otherwise(acc))
        passed = lambda r: F.filter(F.transform(every, lambda d, i: F.when(d["base"] | ~beaten(d, i, every, r), d)), F.isnotnull)
        return F.when(F.size(every) > 1, _let(_let(F.array_max(F.transform(every, words)), least), passed)).otherwise(every)

    return _let(F.array_sort(found), kept)


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: Mapping[str, str] = BASE) -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections."""
    made = rules(base)
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).alias("_id"), text.alias("_text"))
    counted = slim.select("_id", normalised(F.col("_text")).alias("_every"), gate(F.col("_text"), base).alias("_gate"))
    # One blank stands before each word and one at the end; without a word there are two.
    n_words = F.when(F.octet_length("_every") <= 2, 0).otherwise(_blanks(F.col("_every")) - 1)
    counted = counted.select("_id", n_words.cast("long").alias("n_words"), F.when(F.col("_gate"), F.col("_every")).alias("_words"))
    found = counted.withColumn("_all", F.coalesce(F.when(F.col("_words").isNotNull(), detections(F.col("_words"), made)), F.array().cast("array<struct<a:int,minus_b:int,minus_priority:int,label:string,confidence:double,base:boolean>>")))
    shown = lambda d: F.struct(d["a"].alias("a"), (-d["minus_b"]).alias("b"), d["label"].alias("label"), (-d["minus_priority"]).alias("priority"), d["confidence"].alias("confidence"), d["base"].alias("base"))
    kept = found.withColumn("detections", F.transform(unsuppressed(F.col("_all")), shown)).withColumn("_base", F.filter("_all", lambda d: d["base"]))
    return kept.select(
        F.col("_id").alias(id_col),
        "n_words",
        F.size("_base").cast("long").alias("n_base"),
        F.array_min(F.transform("_base", lambda d: d["a"])).cast("long").alias("first_word"),
        F.array_max(F.transform("_base", lambda d: d["a"])).cast("long").alias("last_word"),
        _joined(F.transform("_base", lambda d: d["label"])).alias("base_labels"),
        _joined(F.transform("detections", lambda d: d["label"])).alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0)).alias("score"),
        "detections",
    )
