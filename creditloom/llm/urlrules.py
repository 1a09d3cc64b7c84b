"""URL filters: rules for hosts and paths, found by short hash prefixes and confirmed by full digests.

A rule (host, path, verdict) fits its host and all its subdomains where the URL's path starts with the rule's. Of the
rules that fit a URL, the one with the longest host and path together wins, of equally long ones that with the longer host;
where one rule is there with both verdicts, block wins. A URL without a rule has the verdict `otherwise`.

Each distinct (host, path) is expanded into expressions: the host's last labels followed by a beginning of the path, in the
shapes (number of labels, length of path) that rules have. Any rule that fits a URL is one of its expressions, whatever the
lengths. Expressions meet rules in an equi-join on the first PREFIX_HEX hex digits of their SHA-256 digests; the whole
digest then confirms. The verdicts of the distinct (host, path) are joined to the rows by a 64-bit hash and confirmed by
both texts.

What is collected is only the shapes of the rules: at most MAX_LABELS labels by MAX_PATH characters, checked. Both joins
leave the choice to Spark, which broadcasts the rules' side below its threshold and shuffles otherwise, when adaptive
execution splits a host that holds a third of all rows: both sides of either join come from exchanges of their own. Rows of
one URL are one row past the first, partial aggregate.

A null URL, or one without `://`, has an empty host and path and no rule. Very long URLs give as many expressions as rules
have shapes. Repeated rows are judged alike, each a row. Empty tables give no rows; without rules all is `otherwise`. A null
id stays null. Other columns of the pages are not carried, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX_HEX, MAX_LABELS, MAX_PATH = 8, 128, 2_048
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL: what stands after the first `://` up to `/`, `?`, `#` or the end, and from there up to `?`, `#` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def prepared(rules: DataFrame) -> DataFrame:
    """Rows (rule, verdict, labels, length, digest, prefix), one for each host and path of rules (host, path, verdict)."""
    host, path = F.translate("host", UPPER, LOWER), F.coalesce(F.col("path"), F.lit(""))
    one = rules.where(F.col("host").isNotNull()).select(host.alias("host"), path.alias("path"), "verdict").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    rule = F.concat("host", "path")
    digest = _digest(rule)
    shape = F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("length")
    return one.select(rule.alias("rule"), "verdict", *shape, digest.alias("digest"), F.substring(digest, 1, PREFIX_HEX).alias("prefix"))


def shapes(rules: DataFrame) -> list[tuple[int, int]]:
    """The distinct (labels, length) of prepared rules; longer ones than MAX_LABELS or MAX_PATH are an error."""
    found = sorted(tuple(r) for r in rules.select("labels", "length").distinct().collect())
    if any(labels > MAX_LABELS or length > MAX_PATH for labels, length in found):
        raise ValueError(f"a rule has more than {MAX_LABELS} labels or {MAX_PATH} characters of path")
    return found


def expressions(urls: DataFrame, of: list[tuple[int, int]]) -> DataFrame:
    """Rows (host, path, prefix, digest): what urls (host, path) may share with rules of the given shapes."""
    kinds = F.array(*(F.struct(F.lit(labels).alias("labels"), F.lit(length).alias("length")) for labels, length in of))
    shaped = urls.withColumn("__n", F.size(F.split("host", r"\."))).withColumn("__l", F.length("path"))
    fitting = F.filter(kinds, lambda s: (s["labels"] <= F.col("__n")) & (s["length"] <= F.col("__l")))
    cut = F.transform(fitting, lambda s: F.concat(F.call_function("substring_index", F.col("host"), F.lit("."), -s["labels"]), F.substring(F.col("path"), F.lit(1), s["length"])))
    digests = shaped.select("host", "path", F.explode(cut).alias("e")).select("host", "path", _digest("e").alias("digest"))
    return digests.withColumn("prefix", F.substring("digest", 1, PREFIX_HEX))


def url_verdicts(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", otherwise: str = "allow") -> DataFrame:
    """Rows (id, host, path, rule, verdict), one for each page. rules: (host, path, verdict)."""
    host, path = url_parts(F.col(url_col).cast("string"))
    urls = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    ready = prepared(rules)
    of = shapes(ready)
    if not of:
        return urls.select("*", F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict"))
    asked = expressions(urls.select("host", "path").where("host <> ''").distinct(), of)
    hits = asked.join(ready.withColumnRenamed("digest", "__digest"), "prefix").where(F.col("digest") == F.col("__digest"))
    rank = F.struct(F.length("rule"), -F.col("length"))
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), rank).alias("__best"))
    key = F.xxhash64("host", "path")
    found = best.select(key.alias("__key"), F.col("host").alias("__host"), F.col("path").alias("__path"), "__best")
    joined = urls.withColumn("__key", key).join(found, "__key", "left")
    fits = (F.col("host") == F.col("__host")) & (F.col("path") == F.col("__path"))
    return joined.select("id", "host", "path", F.when(fits, F.col("__best.rule")).alias("rule"), F.coalesce(F.when(fits, F.col("__best.verdict")), F.lit(otherwise)).alias("verdict"))


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules).withColumnRenamed("id", "page_id")


OP11_SQL = """
with cut as (
    select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end rest from pages
), parts as (
    select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from cut
), rules(r_host, r_path, r_verdict) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), fits as (
    select host, path, max_by(r_host || r_path, length(r_host || r_path)) rule, max_by(r_verdict, length(r_host || r_path)) verdict
    from (select distinct host, path from parts) p join rules on (host = r_host or ends_with(host, '.' || r_host)) and starts_with(path, r_path)
    group by host, path
)
select page_id, p.host, p.path, rule, coalesce(verdict, 'allow') verdict from parts p left join fits f on p.host = f.host and p.path = f.path
"""
