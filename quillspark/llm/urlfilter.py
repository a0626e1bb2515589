"""Operator 7 [native]: URL rules and exact blocklist membership by a cascade of Bloom filters.

The universe is every distinct host of the corpus, the listed keys are the part of it that the list
names. Level 1 encodes the listed keys; level 2 encodes the unlisted keys that pass level 1; level 3 the
listed keys that pass level 2; and so on until a level has no false positive. A key is then decided by
the first level that it does not pass: exact for every key of the universe, in scans without a join.

Size: keys are dealt by hash over shards, as many as keep the first two levels of a shard within
SHARD_BITS bits (2 MB). A shard has its own cascade, whose levels are one row of 64-bit words each, read
as scalar subqueries by the pass over that shard's pages. So a task holds the words of one shard however
long the list or the universe is; passes read disjoint parts of the pages.

Hashing: the salt of a level and probe is hashed before the key, so it seeds the hash of the key, and keys
that collide under one salt part under the next. If a level of MAX_LEVELS still has false positives an
error is raised instead of an inexact answer.

Edge cases: a null url or one without ``://`` has empty host and path, no rule, and is judged as the
empty host. Null listed hosts are ignored, repeated ones count once, an empty list lists nothing.
Repeated rows are answered one by one; other columns are not read. An empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .store import cut, new_path, table

BITS_PER_KEY, HASHES = 10, 4
#: Share of unlisted keys that pass a level of that size, rounded up.
PASSING = 0.013
SHARD_BITS = 1 << 24
MAX_LEVELS = 64

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Hosts with one of these labels are on the blocklist that the query passes where no list is given.
LISTED_LABELS = ("ads", "ad", "ads-track", "adserver", "track", "tracker", "click", "promo")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_match(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    if not rules:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    rule, verdict = F, F
    for kind, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = rule.when(fits, F.lit(h + p)), verdict.when(fits, F.lit(kind))
    return rule, verdict


def _salted(salt: int, key: Column) -> Column:
    return F.xxhash64(F.lit(salt), key)


def _shard(key: Column, shards: int) -> Column:
    return F.pmod(_salted(-1, key), F.lit(shards)).cast("int")


def _spots(key: Column, m: int, level: int) -> list[Column]:
    return [F.pmod(_salted(level * HASHES + j, key), F.lit(m)) for j in range(HASHES)]


def _passes(key: Column, m: int, level: int, bits: Column) -> Column:
    out = F.lit(True)
    for spot in _spots(key, m, level):
        word = F.get(bits, F.shiftright(spot, 6).cast("int"))
        out = out & (F.call_function("shiftright", word, spot.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1)
    return out


def _level(keys: DataFrame, n: int, level: int) -> tuple[int, DataFrame]:
    """(bits, one row with the dense array of words) for the n keys."""
    words = max(1, -(-n * BITS_PER_KEY // 64))
    m = words * 64
    spots = keys.select(F.explode(F.array(*_spots(F.col("key"), m, level))).alias("s"))
    ones = spots.select(F.shiftright("s", 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("s").bitwiseAND(F.lit(63)).cast("int")).alias("b"))
    zero = keys.sparkSession.range(words).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("b"))
    rows = ones.unionAll(zero).groupBy("w").agg(F.bit_or("b").alias("b"))
    return m, cut(rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("bits")))


class Cascade:
    """Exact membership in the keys marked ``in`` among all keys of one shard (columns key and in; keys distinct)."""

    def __init__(self, keys: DataFrame):
        self.levels = []
        current, other = keys.where("in").select("key"), keys.where("not in").select("key")
        n = current.count()
        while n:
            level = len(self.levels)
            if level == MAX_LEVELS:
                raise RuntimeError(f"{n} keys cannot be told apart in {MAX_LEVELS} levels")
            m, bits = _level(current, n, level)
            self.levels.append((m, bits))
            # what passes although it is on the other side goes into the next level
            wrong = cut(other.where(_passes(F.col("key"), m, level, bits.scalar())))
            current, other = wrong, current
            n = current.count()

    def contains(self, key: Column) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for i, (m, bits) in reversed(list(enumerate(self.levels))):
            # not passing an even level means unlisted, not passing an odd level means listed
            out = F.when(~_passes(key, m, i, bits.scalar()), F.lit(i % 2 == 1)).otherwise(out)
        return out


def marked(universe: DataFrame, listed: DataFrame) -> DataFrame:
    """key, in: the distinct keys of the universe, and whether the list has them; one aggregation, no join."""
    both = universe.select("key", F.lit(False).alias("l")).unionAll(listed.select("key", F.lit(True))).where("key is not null")
    return both.groupBy("key").agg(F.bool_or("l").alias("in"), F.bool_or(~F.col("l")).alias("seen")).where("seen").select("key", "in")


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """key: the hosts of a text file, one a line; blank lines and lines that begin with # are left out."""
    line = F.translate(F.trim("value"), _UPPER, _LOWER)
    return spark.read.text(path).select(line.alias("key")).where("key <> '' and not startswith(key, '#')")


def listed_hosts(pages: DataFrame, labels=LISTED_LABELS) -> DataFrame:
    host, _ = host_path(F.col("url"))
    return pages.select(host.alias("key")).where(F.arrays_overlap(F.split("key", r"\."), F.array(*map(F.lit, labels)))).distinct()


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, shard_bits: int = SHARD_BITS) -> DataFrame:
    """page_id, host, path, rule, verdict, listed: the rule decides, else membership of the host in ``listed`` (column key)."""
    spark = pages.sparkSession
    host, path = host_path(F.col("url"))
    rows = pages.select("page_id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    keys = table(marked(rows.select(F.col("host").alias("key")), listed), "url-keys")
    n = dict(keys.groupBy("in").count().collect())
    first_two = max(n.get(True, 0), int(n.get(False, 0) * PASSING)) * BITS_PER_KEY
    shards = max(1, -(-first_two // shard_bits))

    def judged(part: DataFrame, own: DataFrame) -> DataFrame:
        rule, verdict = rule_match(F.col("host"), F.col("path"), rules)
        part = part.withColumn("listed", Cascade(own).contains(F.col("host")))
        return part.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "listed")

    if shards == 1:
        return judged(rows, keys)
    keys = table(keys.withColumn("shard", _shard(F.col("key"), shards)), "url-key-shards", by="shard")
    rows = table(rows.withColumn("shard", _shard(F.col("host"), shards)), "url-shards", by="shard")
    out = new_path(spark, "url-verdicts")
    for s in range(shards):
        done = judged(rows.where(F.col("shard") == s).drop("shard"), keys.where(F.col("shard") == s).drop("shard"))
        done.write.mode("append").parquet(out)
    return spark.read.schema(done.schema).parquet(out)


def oracle(rules=RULES, labels=LISTED_LABELS) -> str:
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, kind) for kind, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))]
    rule, verdict = (" ".join(f"WHEN {c} THEN '{x[i]}'" for c, *x in fits) for i in (0, 1))
    own = ", ".join(f"'{x}'" for x in labels)
    return f"""
WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
l AS (SELECT *, list_has_any(string_split(host, '.'), [{own}]) AS listed FROM u)
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} ELSE CASE WHEN listed THEN 'block' ELSE 'allow' END END AS verdict, listed FROM l"""
