"""URL filter: a blocked Bloom filter of listed canonical URLs in front of an exact hash join.

An entry is a host and a path; its canonical form is the two joined, like ``example.com/en/``. A url
meets an entry if its host is the entry's or a subdomain of it and its path starts with the entry's. Rules
judge the host as the url has it, the list the canonical one, without user, port and closing dots.
Entries' paths end with ``/``. A url is therefore looked up under every suffix of its host and every
prefix of its path that ends with ``/``, as deep as the deepest entry.

The filter has blocks of 256 bits. A key's hash selects one block, and four more slices of a second
hash set one bit in each of its four words. Keys whose four bits are set go to the exact join, which
drops the false positives. There are no false negatives.

Everything here is a DataFrame expression. Work is done once for each distinct host and path head,
however many rows a hot host has; the verdicts then return to the rows by a many-to-one join whose
large keys Spark can split.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table

#: Rules (verdict, host, path) and listed hosts.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
LISTED = [
    "ads-track.example.com/",
    "adult-x.example.com/",
    "casino-win.example.net/",
    "cheap-pills.example.net/",
    "free-bets.example.net/",
    "spam-farm.example.org/",
]

BITS_PER_KEY = 16
WORDS = 4
#: A filter of at most so many blocks (32 bytes each) is broadcast: 2 MB.
BROADCAST_BLOCKS = 65_536


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; null or no ``://``: empty."""
    return ascii_lower(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0))


def url_path(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    return F.coalesce(F.get(F.split(url, "://", 2), F.lit(1)), F.lit(""))


def canonical_host(host: Column) -> Column:
    """A host as entries are listed: without user, port and closing dots."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r":[0-9]*\z", ""), r"\.+\z", "")


def _upto(name: str, mark: str, k: Column) -> Column:
    return F.call_function("substring_index", F.col(name), F.lit(mark), k)


def entries(spark: SparkSession, rules: list[tuple[str, str, str]], listed: list[str]) -> DataFrame:
    """One row for each entry: key, host, path, verdict, is_rule."""
    rows = [(h + p, h, p, v, True) for v, h, p in rules]
    rows += [(x, x.split("/", 1)[0], "/" + x.split("/", 1)[1], "block", False) for x in listed]
    names = ("key", "host", "path", "verdict", "is_rule")
    values = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*values)))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _bits(key: Column) -> list[Column]:
    h = F.xxhash64(F.lit(7), key)
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(WORDS)]


@dataclass
class BlockedBloom:
    """table: one row for each block that is not empty, with its four words."""

    table: DataFrame
    blocks: int

    def may_hold(self, df: DataFrame, key: str) -> DataFrame:
        """The rows of df whose key may be among the filter's keys."""
        side = F.broadcast(self.table) if self.blocks <= BROADCAST_BLOCKS else self.table
        probes = df.withColumn("_block", _block(F.col(key), self.blocks))
        test = F.lit(True)
        for i, bit in enumerate(_bits(F.col(key))):
            test = test & (F.col(f"_w{i}").bitwiseAND(bit) != 0)
        return probes.join(side, "_block").filter(test).select(*df.columns)


def blocked_bloom(keys: DataFrame, key: str, n_keys: int) -> BlockedBloom:
    blocks = max(1, -(-n_keys * BITS_PER_KEY // (64 * WORDS)))
    table = (
        keys.groupBy(_block(F.col(key), blocks).alias("_block"))
        .agg(*[F.bit_or(bit).alias(f"_w{i}") for i, bit in enumerate(_bits(F.col(key)))])
    )
    return BlockedBloom(table, blocks)


def judge(pages: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row for each row of pages: id, host, path, rule, verdict.

    The longest rule that fits decides. Without one, a url that meets a listed entry is blocked and
    any other allowed. A null url, or one without ``://``, has an empty host and path, meets nothing
    and is allowed. Repeated rows stay; an empty table gives no rows; other columns are not read.
    """
    found = listed.agg(
        F.count("*").alias("n"),
        F.max(F.size(F.split("host", r"\."))).alias("labels"),
        F.max(F.size(F.split("path", "/"))).alias("parts"),
    ).first()
    n, labels, parts = found["n"], found["labels"] or 1, found["parts"] or 1
    url = F.col(url_col)
    rows = pages.select(F.col(id_col), url_host(url).alias("host"), url_path(url).alias("path"))
    #: As much of a path as any entry can ask for.
    rows = rows.withColumn("_head", F.substring_index("path", "/", parts - 1) if parts > 1 else F.lit(""))
    rows = rows.withColumn(
        "_head",
        F.when(F.length("_head") < F.length("path"), F.concat("_head", F.lit("/"))).otherwise(F.col("_head")),
    )
    heads = rows.filter("host != ''").select("host", "_head").distinct()
    heads = heads.withColumn("_canon", canonical_host(F.col("host")))

    def suffixes(name: str, is_rule: bool) -> Column:
        depth = F.least(F.size(F.split(name, r"\.")), F.lit(labels))
        return F.transform(F.sequence(F.lit(1), depth), lambda k: F.struct(_upto(name, ".", -k).alias("s"), F.lit(is_rule).alias("r")))
    slashes = F.size(F.split("_head", "/")) - 1
    prefixes = F.when(
        slashes > 0,
        F.transform(F.sequence(F.lit(1), slashes), lambda k: F.concat(_upto("_head", "/", k), F.lit("/"))),
    ).otherwise(F.array().cast("array<string>"))
    probes = (
        heads.select("host", "_head", F.explode(F.concat(suffixes("host", True), suffixes("_canon", False))).alias("_suffix"), prefixes.alias("_prefixes"))
        .select("host", "_head", "_suffix", F.explode("_prefixes").alias("_prefix"))
        .select("host", "_head", F.concat("_suffix.s", "_prefix").alias("key"), F.col("_suffix.r").alias("is_rule"))
    )
    possible = blocked_bloom(listed, "key", n).may_hold(probes, "key")
    exact = listed.select("key", F.col("verdict").alias("_verdict"), "is_rule")
    exact = F.broadcast(exact) if n <= BROADCAST_BLOCKS else exact
    hits = possible.join(exact, ["key", "is_rule"])
    verdicts = hits.groupBy("host", "_head").agg(
        F.max(F.when(F.col("is_rule"), F.struct(F.length("key").alias("n"), F.col("key"), F.col("_verdict")))).alias("_rule"),
        F.max(F.when(~F.col("is_rule"), F.col("_verdict"))).alias("_listed"),
    )
    #: Joined by one string: dealt anew on both sides, so that the join can split a hot host.
    verdicts = verdicts.select(F.concat("host", "_head").alias("_at"), "_rule", "_listed")
    return rows.withColumn("_at", F.concat("host", "_head")).join(verdicts, "_at", "left").select(
        F.col(id_col),
        "host",
        "path",
        F.col("_rule.key").alias("rule"),
        F.coalesce("_rule._verdict", "_listed", F.lit("allow")).alias("verdict"),
    )


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of pages with its host, path, rule and verdict."""
    return judge(table(spark, sf_dir, "pages"), entries(spark, RULES, LISTED))


ORACLE_SQL = f"""
WITH rules(rule, host, path, verdict) AS (VALUES
  {', '.join(f"('{h + p}', '{h}', '{p}', '{v}')" for v, h, p in RULES)}),
listed(key, host) AS (VALUES {', '.join(f"('{x}', '{x[:-1]}')" for x in LISTED)}),
rest AS (
  SELECT page_id, row_number() OVER () AS rid,
         CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS r FROM pages),
urls AS (
  SELECT page_id, rid, translate(regexp_extract(r, '^[^/?#]*'), '{"ABCDEFGHIJKLMNOPQRSTUVWXYZ"}', '{"abcdefghijklmnopqrstuvwxyz"}') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
fit AS (
  SELECT u.rid, x.rule, x.verdict, row_number() OVER (PARTITION BY u.rid ORDER BY length(x.rule) DESC) AS k
  FROM urls u JOIN rules x ON (u.host = x.host OR ends_with(u.host, '.' || x.host)) AND starts_with(u.path, x.path)),
bad AS (
  SELECT DISTINCT u.rid FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '(?s)^.*@', ''), ':[0-9]*\\z', ''), '\\.+\\z', '') AS canon FROM urls) u JOIN listed l
  ON (u.canon = l.host OR ends_with(u.canon, '.' || l.host)) AND starts_with(u.path, '/'))
SELECT u.page_id, u.host, u.path, f.rule,
       coalesce(f.verdict, CASE WHEN b.rid IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM urls u LEFT JOIN fit f ON u.rid = f.rid AND f.k = 1 LEFT JOIN bad b ON u.rid = b.rid
"""
