"""URL filters: a blocked Bloom filter of listed canonical URLs in front of an exact hash join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Cuts, join_unique, literal_rows, table

#: (host, path, verdict). A rule fits its host and all subdomains, where the url's path starts with its path.
DEFAULT_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Listed canonical URLs, which decide where no rule fits: spam, gambling and tracking hosts as they occur, all paths.
DEFAULT_LISTED = tuple(
    f"{prefix}{name}.example.{tld}/"
    for prefix in ("", "blog.", "m.")
    for name in ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
    for tld in ("com", "net", "org")
)

LANES = 8
#: Bound of the filter: 2^16 blocks of 512 bits are 4 MiB, whatever the list. More listed URLs than it can
#: tell apart only let more rows through to the exact join.
MAX_BLOCKS = 1 << 16


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for null or without ``://``. Only A-Z of the host are lower-cased."""
    u = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.expr("substring(_u, instr(_u, '://') + 3)")).otherwise(F.lit(""))
    rest = F.regexp_replace(rest, r"(?s)[?#].*", "")
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/]*(.*)$", 1)


def canonical(url: Column) -> Column:
    """``host/path``: no scheme, user, port, query, fragment, leading ``www.`` or dot at the host's end; A-Z of the host
    are lower-cased, an empty path is ``/``. Null stays null; without a host, null."""
    rest = F.regexp_replace(F.regexp_replace(url, r"(?s)^[^/?#]*://", ""), r"(?s)[?#].*", "")
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r":\d*$", ""), r"^www\.|\.$", "")
    path = F.regexp_extract(rest, r"(?s)^[^/]*(.*)$", 1)
    return F.when(host != "", F.concat(host, F.when(path == "", F.lit("/")).otherwise(path)))


def _lanes(key: Column) -> list[Column]:
    bits = F.xxhash64(key, F.lit("lane"))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(LANES)]


def build_bloom(keys: DataFrame, n_blocks: int) -> DataFrame:
    """Split-block filter of column ``key``: one row of LANES 64-bit words per block."""
    rows = keys.select(F.pmod(F.xxhash64("key"), F.lit(n_blocks)).alias("block"), *[m.alias(f"m{i}") for i, m in enumerate(_lanes(F.col("key")))])
    return rows.groupBy("block").agg(*[F.bit_or(f"m{i}").alias(f"w{i}") for i in range(LANES)])


def probe_bloom(candidates: DataFrame, bloom: DataFrame, n_blocks: int) -> DataFrame:
    """The candidates whose ``key`` may be listed; no listed key is lost."""
    out = candidates.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(n_blocks))).join(F.broadcast(bloom), "block")
    for i, m in enumerate(_lanes(F.col("key"))):
        out = out.where(F.col(f"w{i}").bitwiseAND(m) != 0)
    return out.drop("block", *[f"w{i}" for i in range(LANES)])


def split_bloom(candidates: DataFrame, bloom: DataFrame, n_blocks: int) -> tuple[DataFrame, DataFrame]:
    """(candidates whose ``key`` may be listed, those whose key is not)."""
    out = candidates.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(n_blocks))).join(F.broadcast(bloom), "block", "left")
    hit = F.lit(True)
    for i, m in enumerate(_lanes(F.col("key"))):
        hit = hit & (F.coalesce(F.col(f"w{i}"), F.lit(0)).bitwiseAND(m) != 0)
    out = out.withColumn("hit", hit).select(*candidates.columns, "hit")
    return out.where("hit").drop("hit"), out.where(~F.col("hit")).drop("hit")


#: Hosts with rules up to this many are broadcast (their number is counted first); more are hash joined.
SMALL_RULES = 10_000


def matched_rules(base: DataFrame, rules: DataFrame) -> DataFrame:
    """(rid, rule, verdict): of the rules that fit a row of ``base`` (rid, host, path), the one of the longest host + path
    (on equal lengths the longer host).

    Each host is tried at its suffixes of whole labels, an equi-join with the rules of that host; of these, those whose
    path the url's path starts with are left.
    """
    by_host = rules.groupBy(F.col("host").alias("s")).agg(F.collect_set(F.struct("path", "verdict")).alias("rs"))
    by_host = F.broadcast(by_host) if by_host.count() <= SMALL_RULES else by_host
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    tried = base.where("host <> ''").select("rid", "path", F.explode(suffixes).alias("s")).join(by_host, "s")
    fit = tried.select("rid", "s", F.explode(F.filter("rs", lambda r: F.startswith(F.col("path"), r["path"]))).alias("r"))
    key = F.concat("s", "r.path")
    best = fit.groupBy("rid").agg(F.max(F.struct(F.length(key), F.length("s"), key.alias("rule"), F.col("r.verdict").alias("verdict"))).alias("b"))
    return best.select("rid", "b.rule", F.col("b.verdict").alias("rule_verdict"))


def listed_rows(base: DataFrame, listed: DataFrame, cuts: Cuts) -> DataFrame:
    """rid of the rows of ``base`` (rid, host, _u) whose canonical url is listed, or whose host is listed as a whole.

    An entry without a path, ``host/``, stands for all of that host; any other for that url alone. So each row
    has two keys at most, whatever the list. Keys that may be listed by the filter go to the exact join; those
    that most rows share are broadcast.
    """
    entries = cuts.cut(listed.select(canonical(F.col("url")).alias("key")).where("key is not null").distinct())
    n_blocks = max(1, min(MAX_BLOCKS, -(-entries.count() * 16 // 512)))
    bloom = build_bloom(entries, n_blocks)
    key = canonical(F.col("_u"))
    keys = base.where("host <> ''").select("rid", F.explode(F.array_distinct(F.array(key, F.concat(F.substring_index(key, "/", 1), F.lit("/"))))).alias("key"))
    possible = cuts.cut(probe_bloom(keys.where("key is not null"), bloom, n_blocks))
    exact = entries.join(possible.groupBy("key").agg(F.count("*").alias("n")), "key")
    return join_unique(possible, exact, ["key"], "n", possible.count()).select("rid").distinct()


def filter_urls(pages: DataFrame, rules: DataFrame, listed: DataFrame, id_column: str = "page_id") -> DataFrame:
    """One row per row of ``pages``: id, url, host, path, rule, verdict.

    ``rules``: host, path, verdict. ``listed``: url, of whole hosts (``host/``) or single urls. The longest rule that
    fits decides (see ``matched_rules``); without one, a url whose canonical form is listed is blocked (see
    ``listed_rows``) and any other allowed. Rules see the host as it stands, port and user included; the list
    sees canonical forms. Null urls and those without ``://`` have empty host and path and are allowed; urls of any
    length are read whole; repeated rows are judged one by one; an empty table gives an empty result; other columns are
    not read, whatever their names.
    """
    cuts = Cuts(pages.sparkSession, "urls")
    base = pages.select(F.col(id_column).alias("_id"), F.col("url").alias("_u"))
    host, path = split_url(F.col("_u"))
    base = cuts.cut(base.withColumns({"host": host, "path": path}).withColumn("rid", F.monotonically_increasing_id()))
    hit = listed_rows(base, listed, cuts).withColumn("listed", F.lit(True))
    out = base.join(matched_rules(base, rules), "rid", "left").join(hit, "rid", "left")
    verdict = F.coalesce("rule_verdict", F.when(F.col("listed"), "block"), F.lit("allow"))
    return out.select(F.col("_id").alias(id_column), F.col("_u").alias("url"), "host", "path", "rule", verdict.alias("verdict"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every row of ``pages``; edge cases as for ``filter_urls``."""
    text = dict.fromkeys(("host", "path", "verdict", "url"), "string")
    hosts, paths, verdicts = map(list, zip(*DEFAULT_RULES, strict=True))
    rules = literal_rows(spark, {"host": hosts, "path": paths, "verdict": verdicts}, text)
    listed = literal_rows(spark, {"url": list(DEFAULT_LISTED)}, text)
    return filter_urls(table(spark, sf_dir, "pages"), rules, listed).drop("url")


_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in DEFAULT_RULES)
_LISTED = ", ".join(f"('{u[:-1]}')" for u in DEFAULT_LISTED)
#: Every default entry is a whole host, so the list is compared with the host without user, port, www. and last dot.
ORACLE = rf"""
WITH r(h, p, v) AS (VALUES {_RULES}), listed(h) AS (VALUES {_LISTED}),
u AS (
  SELECT row_number() OVER () AS rid, page_id,
         CASE WHEN contains(url, '://') THEN regexp_replace(substr(url, strpos(url, '://') + 3), '(?s)[?#].*', '') ELSE '' END AS rest
  FROM pages),
s AS (
  SELECT rid, page_id, translate(regexp_extract(rest, '(?s)^([^/]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '(?s)^[^/]*(.*)$', 1) AS path
  FROM u),
m AS (
  SELECT rid, max(struct_pack(len := length(h) + length(p), hl := length(h), rule := h || p, v := v)) AS x
  FROM s JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY rid),
c AS (SELECT rid, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '^www[.]|[.]$', '', 'g') AS name FROM s)
SELECT page_id, host, path, x.rule AS rule, coalesce(x.v, CASE WHEN name IN (SELECT h FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM s JOIN c USING (rid) LEFT JOIN m USING (rid)"""
