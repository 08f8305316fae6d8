"""URL rules, carried over to aliases: pages that redirect to each other or name one canonical address.

A rule is a host and the beginning of a path, to allow or to block. It fits its host and all subdomains; of several
the longest wins. Redirects and canonical links are edges between addresses, an address being host, path and query.
Their connected components are found by distributed star contraction, so chains and huge groups of aliases are
fine. A block inside a component holds for every member without a rule of its own; an explicit allow, that is a page's
own rule, always comes first. What is left is allowed.

Edges come from ``<link rel=canonical href>`` and ``<meta http-equiv=refresh content="n;url=...">`` of the pages, from
outside comments, and from an optional table of redirects (from_url, to_url). Relative addresses are resolved
against the page's own.

Defined cases: a null url, or one without ``://``, has empty host and path, fits no rule and is no alias of
anything. Null or empty html has no edges. Repeated rows come back as often as they came. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quoteflow.llm.common import cut
from quoteflow.llm.components import components

#: host, path, verdict
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    after = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(after, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def address(url: Column) -> Column:
    """Host without a default port, path and query; null where there is no host."""
    host = F.regexp_replace(host_of(url), ":(80|443)$", "")
    path = F.when(path_of(url) == "", "/").otherwise(path_of(url))
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)
    return F.when(host != "", F.concat(host, path, F.when(query == "?", "").otherwise(query)))


def _resolved(link: Column, url: Column) -> Column:
    """The whole url that a link names on a page."""
    link = F.trim(F.replace(link, F.lit("&amp;"), F.lit("&")))
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    root = F.concat(scheme, F.lit("://"), host_of(url))
    folder = F.regexp_extract(path_of(url), r"(?s)^(.*/)", 1)
    folder = F.when(folder == "", "/").otherwise(folder)
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when((link == "") | link.startswith("#") | link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .otherwise(F.concat(root, folder, link))
    )


def _value(tag: Column, name: str) -> Column:
    """An attribute of a tag, quoted or bare; empty if it isn't there."""
    start = rf"(?is)[\s\"'/]{name}\s*=\s*"
    quoted = [F.regexp_extract(tag, rf"{start}{q}([^{q}]*){q}", 1) for q in ('"', "'")]
    bare = F.regexp_extract(tag, rf"{start}([^\s\"'>]+)", 1)
    return F.when(quoted[0] != "", quoted[0]).when(quoted[1] != "", quoted[1]).otherwise(bare)


def page_edges(pages: DataFrame) -> DataFrame:
    """u and v: the address of a page, and one that it names as canonical or sends the reader to."""
    named = pages.filter(F.col("html").rlike("(?i)canonical|refresh"))
    body = F.regexp_replace("html", r"(?s)<!--.*?-->", " ")
    tags = named.select("url", F.explode(F.regexp_extract_all(body, F.lit(r"(?is)(<(?:link|meta)\b[^<>]*>)"))).alias("tag"))
    tags = tags.select("url", "tag", *[_value(F.col("tag"), x).alias(x[:4]) for x in ("rel", "http-equiv", "href", "content")])
    sent = F.regexp_extract("cont", r"(?is)^[^;,]*[;,]\s*url\s*=\s*[\"']?([^\"']*)", 1)
    tags = tags.withColumn("sent", sent)
    canonical = F.col("tag").rlike("(?i)^<link") & F.lower("rel").rlike(r"(^|\s)canonical(\s|$)")
    refresh = F.col("tag").rlike("(?i)^<meta") & (F.lower("http") == "refresh") & (F.col("sent") != "")
    links = tags.select("url", F.when(canonical, F.col("href")).when(refresh, F.col("sent")).alias("link"))
    links = cut(links.filter("link is not null and instr(url, '://') > 0").distinct(), "named")
    resolved = links.select("url", _resolved(F.col("link"), F.col("url")).alias("to_url"))
    return resolved.select(address(F.col("url")).alias("u"), address(F.col("to_url")).alias("v"))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """Rules as a table of rule_host, rule_path and rule_verdict."""
    return spark.createDataFrame([tuple(r) for r in rules], "rule_host string, rule_path string, rule_verdict string")


def ruled(places: DataFrame, rules: DataFrame) -> DataFrame:
    """For each distinct host and path that a rule fits, the longest such rule and its verdict."""
    deepest = rules.agg(F.max(F.size(F.split("rule_host", r"\.")))).first()[0] or 1
    ends = F.expr(
        f"transform(sequence(1, least({deepest}, size(split(host, '[.]')))), i -> substring_index(host, '.', -i))"
    )
    fits = (
        places.select("host", "path")
        .distinct()
        .withColumn("rule_host", F.explode(ends))
        .join(rules, "rule_host")
        .filter(F.col("path").startswith(F.col("rule_path")))
    )
    rule = F.concat("rule_host", "rule_path")
    best = F.max(F.struct(F.length(rule).alias("size"), rule.alias("rule"), F.col("rule_verdict").alias("verdict")))
    return fits.groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.rule", "best.verdict")


def judged(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and whether the verdict is an alias's, of every page."""
    pages = pages.select(*[F.col(c).cast(kind).alias(c) for c, kind in (("page_id", "long"), ("url", "string"), ("html", "string"))])
    edges = page_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(address(F.col("from_url")).alias("u"), address(F.col("to_url")).alias("v")))
    member = components(edges.filter("u is not null and v is not null"))
    placed = member.select(
        "component", F.expr("substring(node, 1, instr(node, '/') - 1)").alias("host"),
        F.substring_index(F.expr("substring(node, instr(node, '/'))"), "?", 1).alias("path"),
    )
    bad = (
        placed.join(ruled(placed, rules).filter("verdict = 'block'"), ["host", "path"])
        .select("component")
        .distinct()
        .withColumn("blocked", F.lit(True))
    )
    aliases = member.join(bad, "component").select(F.col("node").alias("address"), "blocked")
    located = cut(
        pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), address(F.col("url")).alias("address")),
        "pages",
    )
    out = located.join(ruled(located, rules), ["host", "path"], "left").join(aliases, "address", "left")
    inherited = F.col("verdict").isNull() & F.col("blocked").isNotNull()
    return out.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("verdict", F.when(F.col("blocked"), "block"), F.lit("allow")).alias("verdict"),
        inherited.alias("inherited"),
    )
