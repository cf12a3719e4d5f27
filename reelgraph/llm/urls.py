"""URL rules by a cascade of Bloom filters.

A rule is a host and a path, like example.net/en/. It fits its host and all subdomains if the path
starts with the rule's; so a url meets the rules host suffix + path up to a slash, its keys. All
keys of the corpus are the universe. Level 1 encodes the listed keys; level 2 those keys of the
universe that pass level 1 without being listed; level 3 the listed keys that pass level 2; and so
on, until a level has nothing to encode. Every key of the universe is then told apart exactly,
without a join. A second cascade, over the listed keys, tells block from allow.

Level 1's rate of false positives is the share of listed keys in the universe, halved; every later level's
is one half. So levels after the first hold about as many keys as are listed, or fewer, and all
together take some 1.5 * (log2(universe / listed) + 5) bits for each listed key, however large the corpus is.
Built-in expressions only.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import shared_dir, stored


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ://, up to / ? # or the end, A-Z lower-cased. Path: from there up to ? or #."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)\A.*?://", "")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)


def keys_of(host: Column, path: Column) -> Column:
    """Every string that a rule fitting this url can be."""
    labels, dirs = F.split(host, r"\."), F.split(path, "/")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    paths = F.when(F.size(dirs) > 1, F.transform(F.sequence(F.lit(1), F.size(dirs) - 1), lambda i: F.concat(F.array_join(F.slice(dirs, F.lit(1), i), "/"), F.lit("/")))).otherwise(F.array(F.lit("")))
    return F.array_distinct(F.flatten(F.transform(hosts, lambda h: F.transform(F.concat(F.array(F.lit("")), paths), lambda p: F.concat(h, p)))))


def _place(key: Column, level: int, bits: int, i: Column) -> Column:
    """The i-th of a key's places among the bits of a level."""
    a = F.pmod(F.xxhash64(key, F.lit(level)), F.lit(bits))
    b = F.pmod(F.xxhash64(F.lit(level), key), F.lit(bits - 1)) + 1
    return F.pmod(a + i * b, F.lit(bits))


class Cascade:
    """levels: (bits, hashes, words of 64 bits as decimal text). No levels: nothing is listed."""

    def __init__(self, levels: list[tuple[int, int, str]]):
        self.levels = levels

    def level_has(self, key: Column, n: int) -> Column:
        bits, hashes, words = self.levels[n]
        # The text folds into one array when the plan is made; places are tried until a bit is unset.
        array = F.split(F.lit(words), ",").cast("array<bigint>")
        at = lambda i: _place(key, n, bits, i)
        return F.forall(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.getbit(F.get(array, F.shiftright(at(i), 6).cast("int")), F.pmod(at(i), F.lit(64)).cast("int")) == 1)

    def has(self, key: Column) -> Column:
        """Exact for every key of the universe."""
        out = F.lit(len(self.levels) % 2 == 1)
        for n in reversed(range(len(self.levels))):
            out = F.when(~self.level_has(key, n), F.lit(n % 2 == 1)).otherwise(out)
        return out


def _level(mine: DataFrame, n: int, level: int, rate: float) -> tuple[int, int, str]:
    """A Bloom filter of n keys. Its words come to the driver, as the rules came from there."""
    hashes = max(1, round(-math.log2(rate)))
    bits = 64 * max(1, math.ceil(n * hashes / math.log(2) / 64))
    at = mine.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: _place(F.col("key"), level, bits, i))).alias("p"))
    words = at.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("p", F.lit(64)).cast("int"))).alias("b")).collect()
    held = {r["w"]: r["b"] for r in words}
    return bits, hashes, ",".join(str(held.get(i, 0)) for i in range(bits // 64))


def build_cascade(universe: DataFrame, listed: DataFrame, total: int, work: str, rate: float = 0.5) -> Cascade:
    """universe: (key) of at most total rows, which may repeat; listed: distinct (key). rate: of the levels after the
    first, and the most of the first."""
    levels: list = []
    inside, outside = listed, None
    while True:
        mine = inside if len(levels) % 2 == 0 else outside
        n = mine.count()
        if not n:
            return Cascade(levels)
        levels.append(_level(mine, n, len(levels), rate if levels else min(rate, n / max(total, 1) / 2)))
        passed = Cascade(levels).level_has(F.col("key"), len(levels) - 1)
        if len(levels) == 1:  # few of the universe pass, so what is sorted out is about as large as the list
            outside = universe.where(passed).distinct().join(listed, "key", "left_anti")
        elif len(levels) % 2:
            outside = outside.where(passed)
        else:
            inside = inside.where(passed)
        if len(levels) % 2:
            outside = stored(outside, f"{work}/outside-{len(levels)}")


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], default: str = "allow", rate: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict) per row; rules: (block or allow, host/path/).

    The longest fitting rule wins; a url that no rule fits gets the default. Null urls and such
    without :// have an empty host and path, and no rule. Rules must have a slash after the host, end
    in one, and not be listed twice. Repeated rows stay; other columns are not read. No rules, or an
    empty table: nothing is fitted.
    """
    if any("/" not in r or not r.endswith("/") for _, r in rules) or len({r for _, r in rules}) < len(rules):
        raise ValueError("rules: host/ or host/path/, each once")
    spark = pages.sparkSession
    work = shared_dir(spark, "urls")
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    keys = keys_of(F.col("host"), F.col("path"))
    total = rows.agg(F.coalesce(F.sum(F.size(keys)), F.lit(0)).alias("n")).first()["n"]
    listed = spark.createDataFrame([(r, k == "block") for k, r in rules], "key string, block boolean")
    any_rule = build_cascade(rows.select(F.explode(keys).alias("key")), listed.select("key"), total, f"{work}/any", rate)
    block = build_cascade(listed.select("key"), listed.where("block").select("key"), len(rules), f"{work}/block", rate)
    best = F.array_max(F.transform(F.filter(keys, any_rule.has), lambda k: F.struct(F.length(k).alias("n"), k.alias("rule"))))["rule"]
    out = rows.select("page_id", "host", "path", best.alias("rule"))
    return out.withColumn("verdict", F.when(F.col("rule").isNull(), F.lit(default)).when(block.has(F.col("rule")), F.lit("block")).otherwise(F.lit("allow")))
