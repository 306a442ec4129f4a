"""Catalog of channels and series: search, choice by time, registration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEARCH_LIMIT = 125


def search(channels: DataFrame, patterns: dict[str, str], ignore_case: bool = False) -> DataFrame:
    """Rows whose columns match all given regexes; none given: no rows."""
    given = {c: p for c, p in patterns.items() if p}
    if not given:
        return channels.limit(0)
    cond = F.lit(True)
    for c, p in given.items():
        cond &= F.col(c).rlike(f"(?i){p}" if ignore_case else p)
    return channels.filter(cond)


def search_first(channels: DataFrame, name: str, pattern: str, n: int = SEARCH_LIMIT) -> DataFrame:
    """The first ``n`` by name, case ignored: a top-k, not a full sort."""
    return search(channels, {name: pattern}, True).orderBy(name).limit(n)


def best_overlap(configs: DataFrame, channel: str, start: str, beg: Column, end: Column, tie: str) -> DataFrame:
    """Of each channel's configs, each valid until the next, the one that overlaps [beg, end) longest; the later of equals."""
    w = Window.partitionBy(channel).orderBy(start, tie)
    valid = configs.withColumn("_until", F.lead(start).over(w))
    length = F.greatest(F.least(F.coalesce("_until", end), end) - F.greatest(F.col(start), beg), F.lit(0))
    ranked = valid.withColumn("overlap", length)
    best = Window.partitionBy(channel).orderBy(F.desc("overlap"), F.desc(start), F.desc(tie))
    return ranked.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n", "_until")


def quorum(answers: DataFrame, key: str, config: list[str]) -> DataFrame:
    """The config that most nodes give for each key; of equals the smallest."""
    votes = answers.groupBy(key, *config).agg(F.count("*").alias("votes"))
    w = Window.partitionBy(key).orderBy(F.desc("votes"), *config)
    return votes.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def in_order(wanted: DataFrame, info: DataFrame, key: str) -> DataFrame:
    """Info of each wanted id, in the order asked, nulls where there is none."""
    return wanted.join(info, key, "left").orderBy("ord")


def ambiguous(channels: DataFrame, name: str, series: str) -> DataFrame:
    """Rows whose name has another series."""
    many = channels.groupBy(F.col(name).alias("_n")).agg(F.min(series).alias("_lo"), F.max(series).alias("_hi")).filter("_lo <> _hi")
    return channels.join(many.select("_n"), F.col(name) == F.col("_n"), "left_semi")


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key in ``order``."""
    cols = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("r"))
    return best.select(key, *[F.col(f"r.{c}").alias(c) for c in cols])


def any_channel(channels: DataFrame, seed: int | None = None) -> DataFrame:
    return channels.orderBy(F.rand(seed)).limit(1)


def active(files: DataFrame, keys: list[str], size: str, least: int = 10 << 20) -> DataFrame:
    """Channels whose files hold more than ``least`` bytes."""
    return files.groupBy(*keys).agg(F.sum(size).alias("bytes")).filter(F.col("bytes") > least)


def series_id(*parts: Column, salt: int = 0) -> Column:
    """A positive 63-bit id from a channel's identity; registration retries with another salt below 10**18."""
    digest = F.md5(F.concat_ws("\x1f", *[p.cast("string") for p in parts], F.lit(str(salt))))
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)") % F.lit((1 << 63) - 1).cast("decimal(20,0)")


def register(wanted: DataFrame, known: DataFrame, keys: list[str], kind: list[str]) -> DataFrame:
    """Each wanted (keys, kind, ts): "current" if the channel's last entry has that kind, "updated" if an earlier one has, else "created"."""
    w = Window.partitionBy(*keys).orderBy(F.desc("ts"))
    ranked = known.withColumn("_n", F.row_number().over(w))
    of_kind = ranked.groupBy(*keys, *kind).agg(F.min("_n").alias("_n"))
    got = wanted.join(of_kind, [*keys, *kind], "left")
    state = F.when(F.col("_n").isNull(), "created").when(F.col("_n") == 1, "current").otherwise("updated")
    return got.withColumn("state", state).drop("_n")


#: Salts that are tried for a new id; about one in nine ids is too small.
SALTS = 32
LEAST_ID = 10**18


def new_id(*parts: Column) -> Column:
    """The first id of a channel's identity that is large enough."""
    tried = F.array(*[series_id(*parts, salt=k) for k in range(SALTS)])
    return F.filter(tried, lambda i: i >= F.lit(LEAST_ID))[0].cast("bigint")


def register_ids(wanted: DataFrame, known: DataFrame, keys: list[str], kind: list[str]) -> DataFrame:
    """:func:`register` with ``series``: the known id of the channel and kind, else a new one; ``tscs`` are all its times in order.

    ``known`` has keys, kind, series and ts; ``wanted`` has keys, kind and ts.  A
    channel that is current gets no new time, others get that of ``wanted``.
    """
    held = known.groupBy(*keys, *kind).agg(F.min("series").alias("_series"), F.array_sort(F.collect_set("ts")).alias("_tscs"))
    got = register(wanted, known, keys, kind).join(held, [*keys, *kind], "left")
    times = F.when(F.col("state") == "current", F.col("_tscs")).otherwise(F.array_sort(F.array_distinct(F.concat(F.coalesce("_tscs", F.array().cast("array<bigint>")), F.array("ts")))))
    return got.withColumn("series", F.coalesce("_series", new_id(*[F.col(c) for c in (*keys, *kind)]))).withColumn("tscs", times).drop("_series", "_tscs", "ts")


def config_of(configs: DataFrame, series: str, ids: list[int]) -> DataFrame:
    """Configs of series ids."""
    return configs.filter(F.col(series).isin(ids))


def active_in(written: DataFrame, series: str, msp: str, partitions: list[int], **kinds: str) -> DataFrame:
    """Series that were written in some partitions, of given kinds only."""
    cond = F.col(msp).isin(partitions)
    for column, kind in kinds.items():
        cond &= F.col(column) == kind
    return written.filter(cond).select(series).distinct()


def maintain(known: DataFrame, scanned: DataFrame, keys: list[str], config: list[str]) -> DataFrame:
    """The catalog after a scan: keys, config, ``state`` ("new", "changed", "same" or "missing") and ``was``, the former config of changed rows.

    Rows that a scan lacks stay as they are, since files come and go.
    """
    old = known.select(*keys, F.struct(*config).alias("_old"))
    new = scanned.select(*keys, F.struct(*config).alias("_new"))
    both = old.join(new, keys, "full")
    same = F.col("_old").eqNullSafe(F.col("_new"))
    state = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "missing").when(same, "same").otherwise("changed")
    now = F.coalesce("_new", "_old")
    out = both.withColumn("state", state)
    return out.select(*keys, *[now[c].alias(c) for c in config], "state", F.when(F.col("state") == "changed", F.col("_old")).alias("was"))
