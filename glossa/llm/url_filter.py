"""URL filters: an exact Bloom filter cascade over the corpus's own keys, in DataFrame functions only.

A rule is a host and the beginning of a path. The keys of a URL are the pairs of a domain of its host and a
beginning of its path as long as some rule's. Level 1 of the cascade encodes the keys of the rules, level 2
the keys of the corpus that level 1 takes wrongly, level 3 the rule keys that level 2 takes wrongly, and so
on until no key errs. Over the corpus that it was built for, its answer is exact and needs no join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import written

#: host, path, verdict
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MOST_RULES = 20_000
WORD_BITS = 64


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty for null or no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def keys(host_col: Column, path_col: Column, lengths: list[int]) -> Column:
    """Keys of a URL, the longest first: each domain of the host with each beginning of the path of a rule's length."""
    labels = F.split(host_col, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.filter(F.array(*[F.when(F.length(path_col) >= n, F.substring(path_col, 1, n)) for n in lengths]), lambda x: x.isNotNull())
    pairs = F.flatten(F.transform(domains, lambda d: F.transform(starts, lambda p: F.concat(d, F.lit("\n"), p))))
    by_length = F.transform(F.array_distinct(pairs), lambda k: F.struct((-F.length(k)).alias("n"), k.alias("key")))
    return F.transform(F.array_sort(by_length), lambda x: x["key"])


@dataclass
class Bloom:
    """A Bloom filter as an array of 64-bit words; its size depends on the number of keys put in alone."""

    words: list[int]
    hashes: int
    seed: int

    def _bit(self, key: Column, i: int) -> Column:
        n = len(self.words) * WORD_BITS
        return F.pmod(F.xxhash64(F.lit(self.seed), F.lit(i), key), F.lit(n))

    def positions(self, key: Column) -> Column:
        return F.array(*[self._bit(key, i) for i in range(self.hashes)])

    def test(self, key: Column) -> Column:
        if not any(self.words):
            return F.lit(False)
        table, out = F.lit(self.words), F.lit(True)
        for i in range(self.hashes):
            b = self._bit(key, i)
            word = F.element_at(table, (F.shiftright(b, 6) + 1).cast("int"))
            out = out & (F.getbit(word, F.pmod(b, F.lit(WORD_BITS)).cast("int")) == 1)
        return out

    @staticmethod
    def of(frame: DataFrame, n_keys: int, bits_a_key: float, seed: int) -> "Bloom":
        """Encode the ``key`` column: bits are set in the cluster, and the driver gets no more than the filter's words."""
        hashes = max(1, round(bits_a_key * 0.693))
        bloom = Bloom([0] * max(1, -(-int(n_keys * bits_a_key) // WORD_BITS)), hashes, seed)
        bits = frame.select(F.explode(bloom.positions(F.col("key"))).alias("b"))
        word = F.expr("shiftleft(1L, cast(pmod(b, 64) as int))")
        for r in bits.groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(word).alias("v")).collect():
            bloom.words[r["w"]] = r["v"]
        return bloom


@dataclass
class Cascade:
    levels: list[Bloom]

    def test(self, key: Column) -> Column:
        """Membership of a key of the universe: decided by the first level that rejects it; odd levels reject non-members."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            out = F.when(self.levels[i].test(key), out).otherwise(F.lit(i % 2 == 1))
        return out

    @staticmethod
    def of(listed: DataFrame, universe: DataFrame, seed: int = 0, most_levels: int = 64) -> "Cascade":
        """Build for ``listed`` keys over the ``universe`` (each a frame of distinct ``key``).

        Level 1 has so many bits a key that it takes about half as many wrong keys as there are listed ones,
        however large the universe; so all filters stay in proportion to the list, times the logarithm of
        the universe's share.
        """
        listed = written(listed, "listed")
        n = listed.count()
        if not n:
            return Cascade([])
        others = universe.join(F.broadcast(listed) if n <= 100_000 else listed, "key", "left_anti")
        n_others = universe.count()
        ratio, bits = max(2.0, 2.0 * n_others / n), 0.0
        while 0.6185**bits > 1 / ratio:
            bits += 1.0
        levels, inside, outside, size = [], listed, others, n
        while size:
            if len(levels) == most_levels:
                raise RuntimeError("the cascade does not end")
            level = Bloom.of(inside, size, bits + 1, seed + len(levels))
            levels.append(level)
            wrong = written(outside.filter(level.test(F.col("key"))), "wrong")
            size, inside, outside, bits = wrong.count(), wrong, inside, 2.0
        return Cascade(levels)


def judge(pages: DataFrame, rules=RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule (host and path of the rule that decides, else null), verdict.

    A rule fits its host and all subdomains if the URL's path starts with the rule's; the longest rule wins,
    and without one ``default`` holds, since the URL's keys are not listed. Null URLs and such without
    ``://`` have an empty host and path and fit no rule. Rows may repeat; an empty table gives no rows;
    other columns are ignored. The rules' verdicts and the filters' bits are literals of the plan, so there
    may be ``MOST_RULES`` rules at most; more raise an error.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).alias("id"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    own = keys(F.col("host"), F.col("path"), sorted({len(p) for _, p, _ in rules}))
    universe = written(rows.select("host", "path").distinct().select(F.explode(own).alias("key")).distinct(), "keys")
    verdicts = {f"{h}\n{p}": v for h, p, v in rules}
    listed = spark.sql("SELECT explode(from_json(:keys, 'array<string>')) AS key", args={"keys": _json(sorted(verdicts))})
    cascade = Cascade.of(listed, universe)
    rule = F.try_element_at(F.filter(own, cascade.test), F.lit(1))
    verdict = F.try_element_at(F.create_map(*[F.lit(x) for kv in verdicts.items() for x in kv]), F.col("key")) if verdicts else F.lit(None).cast("string")
    return rows.withColumn("key", rule).select(
        F.col("id").alias(id_col), "host", "path", F.translate("key", "\n", "").alias("rule"),
        F.coalesce(verdict, F.lit(default)).alias("verdict"),
    )


def _json(values: list[str]) -> str:
    import json

    return json.dumps(values)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP5_SQL = r"""
WITH p AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM p),
r(rhost, rpath, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (
  SELECT page_id, rhost || rpath AS rule, verdict FROM h JOIN r
  ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)),
b AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM m GROUP BY page_id)
SELECT h.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM h LEFT JOIN b ON h.page_id = b.page_id
"""
