"""URL rules and block lists through a Bloom filter cascade.

Level 0 of a cascade is a Bloom filter of the listed keys. Level 1 holds the
keys of the corpus that level 0 takes for listed though they are not, level 2
the listed keys that level 1 takes for its own, and so on until a level has no
false positive. Over the corpus's complete key universe membership is then
exact, and looking a key up reads a few bits of a small constant: no join, no
shuffle. Level 0 gets the false-positive rate r / (s * sqrt 2) for r listed and
s other keys, all later levels one half, which keeps the cascade near its
smallest size.

A filter becomes a constant of the plan, so its size is bounded: keys are split
by hash into as many shards as keep each shard's filter below ``MAX_BITS``, and
rows meet one shard after another.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.session import cut_lineage

from .text import long_table, lower_ascii, sealed, take

MAX_BITS = 1 << 23          # of one shard's largest filter: 1 MB
URL = "(?s)^.*?://([^/?#]*)([^?#]*)"   # host and path


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    words: list


def _spots(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(j)), F.lit(bits)) for j in range(hashes)]


def _shape(n: int, rate: float) -> tuple[int, int]:
    """Bits and hash functions for n keys at a false-positive rate."""
    bits = max(64, math.ceil(n * math.log2(1 / rate) / math.log(2)))
    return -(-bits // 64) * 64, max(1, round(math.log2(1 / rate)))


def _level(keys: DataFrame, level: int, n: int, rate: float) -> Level:
    bits, hashes = _shape(n, rate)
    spots = keys.select(F.explode(F.array(*_spots(F.col("key"), level, bits, hashes))).alias("p"))
    words = spots.groupBy(F.floor(F.col("p") / 64).alias("i")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))).alias("w"))
    out = [0] * (bits // 64)
    for r in words.collect():  # at most bits / 64 rows, and bits is bounded by the sharding
        out[r.i] = r.w
    return Level(bits, hashes, out)


def _in_level(key: Column, k: int, level: Level) -> Column:
    table = long_table(level.words)
    hit = None
    for p in _spots(key, k, level.bits, level.hashes):
        bit = F.getbit(F.get(table, F.floor(p / 64).cast("int")), (p % 64).cast("int")) == 1
        hit = bit if hit is None else hit & bit
    return hit


def build(keys: DataFrame) -> list[Level]:
    """Cascade over ``keys`` (key, listed): every key once, listed or not."""
    n_in, n_out = (keys.agg(F.count_if("listed"), F.count_if(~F.col("listed"))).first())
    if not n_in:
        return []
    inside, outside, levels = keys.where("listed"), keys.where(~F.col("listed")), []
    n, rate = n_in, min(0.5, n_in / (math.sqrt(2) * max(1, n_out)))
    while n:
        k = len(levels)
        levels.append(_level(inside, k, n, rate))
        outside = outside.where(_in_level(F.col("key"), k, levels[k]))
        n, rate = outside.count(), 0.5
        inside, outside = outside, inside
    return levels


def member(key: Column, levels: list[Level]) -> Column:
    """Whether a key of the universe is listed."""
    out = F.lit(len(levels) % 2 == 1)
    for k in reversed(range(len(levels))):
        out = F.when(~_in_level(key, k, levels[k]), F.lit(k % 2 == 1)).otherwise(out)
    return out


def listed_members(df: DataFrame, listed: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Add ``hits``: the keys of array column ``keys`` that ``listed`` (column key) has."""
    universe = df.select(F.explode("keys").alias("key")).distinct().withColumn("listed", F.lit(False))
    tagged = listed.select("key", F.lit(True).alias("listed")).where(F.col("key").isNotNull())
    keys = universe.unionByName(tagged).groupBy("key").agg(F.max("listed").alias("listed"))
    keys = cut_lineage(keys)
    n_in, n_out = keys.agg(F.count_if("listed"), F.count_if(~F.col("listed"))).first()
    rate = min(0.5, n_in / (math.sqrt(2) * max(1, n_out))) if n_in else 0.5
    shards = max(1, -(-2 * _shape(n_in, rate)[0] // max_bits))
    shard = lambda c: F.pmod(F.xxhash64(c, F.lit("shard")), F.lit(shards))

    def found(s: int, levels: list[Level]):
        return lambda x: member(x, levels) if shards == 1 else (shard(x) == s) & member(x, levels)

    df = df.withColumn("hits", F.array().cast("array<string>"))
    for s in range(shards):
        levels = build(keys if shards == 1 else keys.where(shard(F.col("key")) == s))
        if not levels:
            continue
        df = df.withColumn("hits", F.concat("hits", F.filter("keys", found(s, levels))))
        if shards > 1:
            df = cut_lineage(df)
    return df


def judge_urls(pages: DataFrame, rules: DataFrame, blocked_hosts: DataFrame, id_col: str = "page_id",
               url_col: str = "url", max_bits: int = MAX_BITS) -> DataFrame:
    """Host, path, longest fitting rule and verdict of every URL.

    ``rules`` has (host, path, verdict), ``blocked_hosts`` (key): hosts that are
    blocked with all their subdomains where no rule fits. Rules of one length go
    to the longer host. A NULL URL, or one without ``://``, has an empty host and
    path: no rule fits, verdict allow. Repeated rows are judged alike.
    """
    d = take(pages, page_id=id_col, url=url_col)
    d = d.select("page_id", lower_ascii(F.coalesce(F.regexp_extract("url", URL, 1), F.lit(""))).alias("host"),
                 F.coalesce(F.regexp_extract("url", URL, 2), F.lit("")).alias("path"))
    labels = F.split("host", "\\.", -1)
    # The distinct (labels, path length) of the rules: bounded by the longest host and path of a rule.
    shapes = rules.select(F.size(F.split("host", "\\.", -1)).alias("n"), F.length("path").alias("m")).distinct().collect()
    # The distinct numbers of labels of listed hosts: bounded by the deepest one.
    depths = sorted(r[0] for r in blocked_hosts.select(F.size(F.split("key", "\\.", -1)).alias("n")).distinct().collect() if r[0] > 0)
    tail = lambda n: F.array_join(F.slice(labels, -n, n), ".")
    cands = [F.when((F.size(labels) >= n) & (F.length("path") >= m) & (F.col("host") != ""),
                    F.concat(F.lit(tag), tail(n), F.substring("path", 1, m)))
             for n, m in sorted(map(tuple, shapes)) for tag in ("a:", "b:")]
    keys = F.array_compact(F.array(*cands)) if cands else F.array().cast("array<string>")
    if depths:
        fits = F.filter(F.lit(depths), lambda n: (n <= F.size(labels)) & (F.col("host") != ""))
        keys = F.concat(keys, F.transform(fits, lambda n: F.concat(F.lit("h:"), F.array_join(F.slice(labels, -n, n), "."))))
    d = d.withColumn("keys", keys)
    tag = F.when(F.col("verdict") == "allow", "a:").otherwise("b:")
    listed = rules.select(F.concat(tag, "host", "path").alias("key")).unionByName(
        blocked_hosts.select(F.concat(F.lit("h:"), "key").alias("key"))).distinct()
    d = listed_members(d, listed, max_bits)
    best = F.array_max(F.transform(
        F.filter("hits", lambda x: ~x.startswith("h:")),
        lambda x: F.struct(F.length(x).alias("n"), F.instr(F.concat(x, F.lit("/")), "/").alias("h"), x.alias("key"))))["key"]
    verdict = F.when(best.startswith("a:"), "allow").when(best.startswith("b:"), "block") \
        .when(F.exists("hits", lambda x: x.startswith("h:")), "block").otherwise("allow")
    return sealed(d.select("page_id", "host", "path", F.substring(best, 3, 1 << 30).alias("rule"),
                           verdict.alias("verdict")))
