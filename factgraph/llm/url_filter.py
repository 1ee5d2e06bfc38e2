"""URL filters: pattern rules indexed by their rarest literal token. DataFrame operations only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import ascii_lower, hot_join

#: Host/path rules: the rule fits its host and all subdomains when the path starts with the rule's path.
HOST_RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: Phrases by topic that block a URL in whose host or path they stand between separators, where no host/path rule fits. An own
#: list of common topics, as an example: users pass their own rules.
TOPICS = {
    "adult": ("adult", "porn", "xxx", "nude", "escort"),
    "gambling": ("casino", "free-bets", "poker", "sportsbook", "slots"),
    "pharmacy": ("cheap-pills", "viagra", "online-pharmacy"),
    "advertising": ("ads-track", "adserver", "banner-ads", "popunder"),
    "spam": ("spam-farm", "link-farm", "buy-followers", "keygen"),
}
#: Pattern rules: (name, literal tokens, regular expression on host + path).
PATTERN_RULES = tuple((f"{topic}:{phrase}", tuple(phrase.split("-")), rf"(?is)(?<![a-z0-9]){phrase}(?![a-z0-9])") for topic, phrases in TOPICS.items() for phrase in phrases)
#: Rule indexes up to this many rows are broadcast; larger ones are joined by a shuffle on the token.
BROADCAST_RULES = 20_000

_RULE = T.StructType([T.StructField("rule", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("verdict", T.StringType()), T.StructField("regex", T.StringType()), T.StructField("tokens", T.ArrayType(T.StringType()))])


def rule_table(spark: SparkSession, host_rules=HOST_RULES, pattern_rules=PATTERN_RULES) -> DataFrame:
    """Rules as rows. A token counts as literal only where separators enclose it in every URL that fits."""
    rows = []
    for rule, verdict in host_rules:
        host, slash, path = rule.partition("/")
        path = slash + path
        whole = path[: path.rfind("/") + 1]
        rows.append((rule, "host", verdict, r"(?s)\A(?:[^/]*\.)?" + re.escape(host) + (re.escape(path) if path else r"(?:/.*)?\z"), re.findall("[a-z0-9]+", (host + whole).lower())))
    rows += [(name, "pattern", "block", regex, list(tokens)) for name, tokens, regex in pattern_rules]
    return spark.createDataFrame(rows, _RULE)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(key: Column) -> Column:
    """Distinct literal tokens of a URL, and the empty token, under which rules without any literal are filed."""
    return F.array_distinct(F.concat(F.regexp_extract_all(ascii_lower(key), F.lit("([a-z0-9]+)")), F.array(F.lit(""))))


def rule_index(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(token, rule ...): each rule under that of its tokens which the fewest URLs hold (ties: the smaller token).
    ``urls`` has one row per distinct URL with its ``tokens``."""
    wanted = rules.select("*", F.explode(F.when(F.size("tokens") == 0, F.array(F.lit(""))).otherwise(F.array_distinct("tokens"))).alias("token")).drop("tokens")
    seen = urls.select(F.explode("tokens").alias("token")).join(F.broadcast(wanted.select("token").distinct()) if _small(rules) else wanted.select("token").distinct(), "token", "left_semi")
    counts = seen.groupBy("token").agg(F.count("*").alias("n"))
    rare = Window.partitionBy("rule", "kind").orderBy("n", "token")
    return wanted.join(counts, "token", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("at", F.row_number().over(rare)).filter("at = 1").drop("at", "n")


def _small(rules: DataFrame) -> bool:
    return rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES


def judge_urls(pages: DataFrame, rules: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages``.

    A URL's tokens fetch candidate rules from the index and only those run their regular expressions. The longest
    fitting host/path rule decides (ties: the smaller rule text); without one, a fitting pattern rule blocks, else
    ``default`` holds. URLs are judged once each, repeated rows share the verdict. Null urls and urls without ``://``
    have an empty host and path and get the verdict that no rule gives. Other columns of ``pages`` are not read.
    """
    pages = pages.select("page_id", "url")
    rules = rule_table(pages.sparkSession) if rules is None else rules
    key = F.concat(host_of(F.col("url")), path_of(F.col("url")))
    urls = pages.select("url").filter("url is not null").distinct().withColumn("key", key).withColumn("tokens", tokens_of(F.col("key")))
    index = rule_index(urls, rules)
    fetched = urls.select("url", "key", F.explode("tokens").alias("token")).join(F.broadcast(index) if _small(rules) else index, "token")
    fits = fetched.filter(F.expr("key rlike regex"))
    decided = fits.groupBy("url").agg(
        F.max(F.when(F.col("kind") == "host", F.struct(F.length("rule").alias("long"), F.expr("transform(split(rule, ''), c -> -ascii(c))").alias("first"), "rule", "verdict"))).alias("best"),
        F.max(F.when(F.col("kind") == "pattern", F.col("verdict"))).alias("pattern"),
    )
    return hot_join(pages, decided, "url", "page_id", "left").select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", "pattern", F.lit(default)).alias("verdict"),
    )


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ``pages`` url judged by the host/path rules, else by the pattern rules."""
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP10_SQL = f"""
WITH u AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM h
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN regexp_matches(lower(host || path), '(^|[^a-z0-9])({"|".join(p for phrases in TOPICS.values() for p in phrases)})([^a-z0-9]|$)') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
