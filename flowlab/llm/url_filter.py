"""URL rules whose block decisions spread over redirects and canonical links.

A rule (verdict, host, path) fits its host and all subdomains where the path
starts with the rule's; the longest rule that fits decides.  Pages name other
addresses of themselves by canonical links and refresh redirects; addresses that
are connected by such edges are aliases.  An address without a rule of its own
takes the decision of its aliases: allowed if a rule allows one of them, else
blocked if a rule blocks one, else allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlab.llm.graph import connected_components
from flowlab.scratch import materialize

CANONICAL = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
REFRESH = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
HREF = r"""(?is)\bhref\s*=\s*["']?([^"'>\s]+)"""
TARGET = r"""(?is)\burl\s*=\s*["']?([^"'>;\s]+)"""
_PARTS = r"(?s)^(.*?)://([^/?#]*)([^?#]*)(\??[^#]*)"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_part(url: Column, part: int) -> Column:
    """Scheme, host, path or query; empty for a null url and one without ``://``."""
    return F.coalesce(F.regexp_extract(url, _PARTS, part), F.lit(""))


def host_of(url: Column) -> Column:
    return lower_ascii(url_part(url, 2))


def address(url: Column) -> Column:
    """The url without fragment, scheme and host in lower case; null without a host."""
    whole = F.concat(lower_ascii(url_part(url, 1)), F.lit("://"), host_of(url),
                     F.when(url_part(url, 3) == "", "/").otherwise(url_part(url, 3)), url_part(url, 4))
    return F.when(host_of(url) != "", whole)


def resolve(base: Column, link: Column) -> Column:
    """A link's absolute url as seen from ``base``."""
    origin = F.concat(url_part(base, 1), F.lit("://"), url_part(base, 2))
    folder = F.concat(origin, F.regexp_extract(F.concat(url_part(base, 3), F.lit("")), r"(?s)^(.*/)?", 1))
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    return (
        F.when(link.contains("://"), link)
        .when(link.startswith("//"), F.concat(url_part(base, 1), F.lit(":"), link))
        .when(link.startswith("/"), F.concat(origin, link))
        .when(~link.startswith("#"), F.concat(folder, link))
    )


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Edges (a, b) between addresses from the canonical links and refresh redirects of pages."""
    source = pages.select(F.col(url).alias("url"), F.col(html).cast("string").alias("html")).where(
        r"""html rlike '(?i)canonical|http-equiv'""")
    tags = source.select("url", F.explode(F.concat(
        F.transform(F.regexp_extract_all("html", F.lit(CANONICAL), 0), lambda t: F.regexp_extract(t, HREF, 1)),
        F.transform(F.regexp_extract_all("html", F.lit(REFRESH), 0), lambda t: F.regexp_extract(t, TARGET, 1)))).alias("link"))
    named = tags.where("link <> ''").withColumn("link", F.regexp_replace("link", "&amp;", "&"))
    return named.select(address(F.col("url")).alias("a"), address(resolve(F.col("url"), F.col("link"))).alias("b")).where(
        "a is not null and b is not null")


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules as rows (verdict, rule_host, rule_path); of equal ones an allow rule wins."""
    made = spark.createDataFrame(rules, "verdict string, rule_host string, rule_path string")
    return made.groupBy(F.lower("rule_host").alias("rule_host"), "rule_path").agg(F.min("verdict").alias("verdict"))


def fitting_rules(urls: DataFrame, rules: DataFrame, column: str) -> DataFrame:
    """``urls`` with ``rule`` and ``rule_verdict``: the longest rule that fits, null if none does.

    Hosts, not urls, are joined to the rules by each of their suffixes.
    """
    hosts = urls.select(host_of(F.col(column)).alias("host")).where("host <> ''").distinct()
    labels = F.split("host", r"\.", -1)
    suffixes = hosts.select("host", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))).alias("rule_host"))
    by_host = materialize(suffixes.join(rules, "rule_host").groupBy("host").agg(F.collect_list(F.struct(
        F.length(F.concat("rule_host", "rule_path")).alias("size"), F.col("rule_path").alias("path"),
        F.concat("rule_host", "rule_path").alias("rule"), F.col("verdict"))).alias("rules")), "host_rules")
    best = F.array_max(F.filter("rules", lambda r: F.col("path_of").startswith(r["path"])))
    return (
        urls.withColumn("host_is", host_of(F.col(column))).withColumn("path_of", url_part(F.col(column), 3))
        .join(by_host, F.col("host_is") == F.col("host"), "left")
        .withColumn("best", best).withColumn("rule", F.col("best.rule")).withColumn("rule_verdict", F.col("best.verdict"))
        .drop("host", "rules", "best", "path_of", "host_is")
    )


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], redirects: DataFrame | None = None,
               key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """A verdict for every page's url.

    ``rules`` are (verdict, host, path); ``redirects`` may add edges (from_url,
    to_url) to those found in the pages.  Returns a row per page: page_id, host,
    path, rule (host and path of the deciding rule, else null), verdict and
    component (the first of its aliases; null without any).  A null url, or one
    without ``://``, has an empty host and path, no aliases, and is allowed; a
    null html has no links; repeated rows stay; an empty table gives no rows;
    other columns are ignored.
    """
    spark = pages.sparkSession
    table = rule_table(spark, rules)
    edges = link_edges(pages, url, html)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(
            address(F.col("from_url")).alias("a"), address(F.col("to_url")).alias("b")).where("a is not null and b is not null"))
    nodes = connected_components(edges)
    judged = fitting_rules(nodes, table, "node")
    groups = judged.groupBy("component").agg(
        F.max(F.col("rule_verdict") == "allow").alias("allowed"), F.max(F.col("rule_verdict") == "block").alias("blocked"))
    spread = materialize(nodes.join(groups, "component").select(
        "node", "component", F.when(F.col("blocked") & ~F.coalesce("allowed", F.lit(False)), "block").otherwise("allow").alias("spread")), "aliases")
    own = pages.select(F.col(key).alias("page_id"), F.col(url).cast("string").alias("url"))
    return (
        fitting_rules(own, table, "url").withColumn("node", address(F.col("url")))
        .join(spread, "node", "left")
        .select("page_id", host_of(F.col("url")).alias("host"), url_part(F.col("url"), 3).alias("path"), "rule",
                F.coalesce("rule_verdict", "spread", F.lit("allow")).alias("verdict"), "component")
    )
