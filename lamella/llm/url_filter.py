"""URL rules by Bloom filter cascades: exact membership over a complete key universe, without joins at query time.

A key is a host suffix (whole labels) followed by a path prefix; a list of rules is a set of keys. Level 0 encodes the listed
keys, level 1 the keys of the universe that level 0 takes wrongly, level 2 the listed keys that level 1 takes wrongly, and so
on, until nothing is taken wrongly. The first level that misses a key tells whether it is listed, for every key of the
universe. Level 0 has as many hashes as leave about as many keys of the universe taken wrongly as are listed, so that all
levels together grow with the list and the logarithm of the universe, not with the universe. Levels are arrays of 64-bit
words inside the plan, tested with bit operations: DataFrame functions only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, others, partitions_for

#: Of a level after the first, and the most of the first.
HASHES, MOST_HASHES = 4, 48

#: The rules of the production list, as (verdict, host, path).
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def _positions(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(bits)) for i in range(hashes)]


@dataclass(frozen=True)
class Cascade:
    """Each level's number of hashes and its words, as decimal text."""

    levels: tuple[tuple[int, tuple[str, ...]], ...]

    @staticmethod
    def of(listed: DataFrame, universe: DataFrame, size: int | None = None) -> Cascade:
        """The cascade of the distinct non-null keys of ``listed`` (column key), exact for the keys of ``universe`` (column key).

        ``size``: about how many distinct keys the universe has, if that is known; it is exact whatever is given. Listed keys
        outside the universe are listed too. An empty list has no level and holds no key."""
        keys = materialise(listed.where("key is not null").select("key").distinct(), "listed", 1)
        parts = partitions_for(universe, 64 << 20, 1)
        encoded, tested, key = keys, None, F.col("key")
        levels: list[tuple[int, tuple[str, ...]]] = []
        while count := encoded.count():
            hashes = HASHES
            if not levels:
                size = universe_size(universe) if size is None else size
                hashes = min(max(math.ceil(math.log2(max(size / count, 1))), HASHES), MOST_HASHES)
            bits = 64 * -(-math.ceil(count * hashes / math.log(2)) // 64)
            pos = encoded.select(F.explode(F.array(*_positions(key, len(levels), bits, hashes))).alias("p"))
            words = pos.groupBy(F.floor(F.col("p") / 64).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))).alias("v")).collect()
            dense = ["0"] * (bits // 64)
            for w, v in words:
                dense[w] = str(v)
            levels.append((hashes, tuple(dense)))
            if tested is None:  # the universe is read once; what level 0 takes of it is small
                wrong = universe.where("key is not null").where(_hit(key, 0, *levels[0])).select("key").distinct().join(keys, "key", "left_anti")
            else:
                wrong = tested.where(_hit(key, len(levels) - 1, *levels[-1]))
            tested, encoded = encoded, materialise(wrong.select("key"), "wrong", parts)
        return Cascade(tuple(levels))

    def has(self, key: Column) -> Column:
        """Whether a key of the universe (or the list) is listed; false for null."""
        out = F.lit(len(self.levels) % 2 == 1)
        for n in reversed(range(len(self.levels))):
            out = F.when(_hit(key, n, *self.levels[n]), out).otherwise(F.lit(n % 2 == 1))
        return F.coalesce(key.isNotNull() & out, F.lit(False))


def universe_size(universe: DataFrame) -> int:
    return universe.agg(F.approx_count_distinct("key", 0.1)).head()[0]


def _hit(key: Column, level: int, hashes: int, words: tuple[str, ...]) -> Column:
    table = F.split(F.lit(",".join(words)), ",").cast("array<bigint>")  # folded to one literal
    bit = [F.call_function("shiftright", F.get(table, F.floor(p / 64).cast("int")), (p % 64).cast("int")).bitwiseAND(F.lit(1)) == 1 for p in _positions(key, level, 64 * len(words), hashes)]
    return reduce(Column.__and__, bit)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered): after the first ``://`` up to ``/ ? #`` or the end; path: from there up to ``? #`` or the end."""
    url = F.coalesce(url, F.lit(""))
    after = F.when(F.instr(url, "://") > 0, F.expr("substring(_lamella_u, instr(_lamella_u, '://') + 3)")).otherwise(F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_extract(after, "^([^/?#]*)", 1), upper, lower), F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1)


def candidates(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """All keys under which a rule of the list could fit: its numbers of labels, its lengths of paths."""
    labels = sorted({h.count(".") + 1 for _, h, _ in rules})
    lengths = sorted({len(p) for _, _, p in rules})
    n = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    keys = [F.when((n >= c) & (F.length(path) >= m), F.concat(F.substring_index(host, ".", -c), F.substring(path, 1, m))) for c in labels for m in lengths]
    return F.array_compact(F.array(*keys)) if keys else F.array().cast("array<string>")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict: of the fitting rules that with the longest key; ``default`` where none fits.

    The rules' keys are two lists, allowed and blocked, each a cascade over the candidate keys of all urls. A key under both
    verdicts counts as blocked. A null url, or one without ``://``, has an empty host and path, which no rule fits; equal
    urls are judged alike; an empty table gives no rows; columns of ``pages`` named as a result are replaced. The rules come
    from the driver, and so do their cascades: some 1.5 bits a rule for each doubling from the list to the universe, which every task gets with its plan."""
    spark = pages.sparkSession
    kept = [f.name for f in others(pages, ("host", "path", "rule", "verdict"))]
    host, path = host_and_path(F.col("_lamella_u"))
    base = pages.withColumn("_lamella_u", F.coalesce(F.col(url), F.lit(""))).select(*kept, host.alias("host"), path.alias("path"))
    base = base.withColumn("_lamella_keys", candidates(F.col("host"), F.col("path"), rules))
    universe = base.select(F.explode("_lamella_keys").alias("key"))
    longest = lambda keys: F.array_max(F.transform(keys, lambda k: F.struct(F.length(k).alias("n"), k.alias("key"))))["key"]
    blocked = sorted({h + p for v, h, p in rules if v == "block"})
    allowed = sorted({h + p for v, h, p in rules if v == "allow"} - set(blocked))
    size = universe_size(universe) if rules else 0
    lists = {v: Cascade.of(_listed(spark, keys), universe, size) for v, keys in (("allow", allowed), ("block", blocked))}
    found = {v: longest(F.filter(F.col("_lamella_keys"), c.has)) for v, c in lists.items()}
    out = base.withColumn("_lamella_a", found["allow"]).withColumn("_lamella_b", found["block"])
    wins = F.coalesce(F.length("_lamella_b"), F.lit(-1)) > F.coalesce(F.length("_lamella_a"), F.lit(-1))
    rule = F.when(wins, F.col("_lamella_b")).otherwise(F.col("_lamella_a"))
    tie = (F.length("_lamella_a") == F.length("_lamella_b")) & (F.col("_lamella_b") > F.col("_lamella_a"))
    rule = F.when(F.coalesce(tie, F.lit(False)), F.col("_lamella_b")).otherwise(rule)
    out = out.withColumn("rule", rule)
    verdict = F.when(F.col("rule").isNull(), default).when(F.coalesce(F.col("rule") == F.col("_lamella_b"), F.lit(False)), "block").otherwise("allow")
    return out.select(*kept, "host", "path", "rule", verdict.alias("verdict"))


def _listed(spark: SparkSession, keys: list[str]) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(k) for k in keys]).cast("array<string>")).alias("key"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, RULES).drop("url")


OP8_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(verdict, h, q) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fit AS (SELECT p.page_id, r.h || r.q AS rule, r.verdict, row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.h || r.q) DESC, r.h || r.q DESC) AS n
        FROM p JOIN rules r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.q))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM p LEFT JOIN fit f ON p.page_id = f.page_id AND f.n = 1
"""
