"""URL filters, DataFrame functions only: rules by host and path, carried to aliases over redirects and canonical links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import components, look_up, staged

#: The rules of the registered query: (host, path, verdict).
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as struct(rule, verdict), or null. Of equally long ones that of the longer host."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r[2]))
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in reversed(ordered):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def node_of(url: Column) -> Column:
    """A URL as a node: without its fragment, scheme and host in lower case. Null unless it has `://`."""
    parts = r"(?s)^(.*?://[^/?#]*)([^#]*)"
    return F.when(url.contains("://"), F.concat(F.translate(F.regexp_extract(url, parts, 1), UPPER, LOWER), F.regexp_extract(url, parts, 2)))


def resolved(link: Column, url: Column) -> Column:
    """A link of the page at url as an absolute URL; null if it is none."""
    scheme, site = F.regexp_extract(url, r"(?s)^(.*?):", 1), F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    link = F.regexp_replace(F.trim(link), "&amp;", "&")
    return (
        F.when((link == "") | link.startswith("#"), None)
        .when(link.rlike("(?i)^[a-z][a-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(site, link))
        .when(link.rlike("(?i)^[a-z][a-z0-9+.-]*:"), None)
        .otherwise(F.concat(folder, link))
    )


def page_links(html: Column) -> Column:
    """The targets of canonical links and of refresh redirects in a page, as an array."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<link\b[^>]*>"), F.lit(0))
    canonical = F.filter(tags, lambda t: t.rlike(r"""(?i)\brel\s*=\s*["']?[^"'>]*\bcanonical\b"""))
    metas = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0)), lambda t: t.rlike(r"""(?i)http-equiv\s*=\s*["']?refresh"""))
    value = lambda t, pattern: F.coalesce(*(F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for p in pattern))
    href = (r"""(?is)\bhref\s*=\s*"([^"]*)\"""", r"""(?is)\bhref\s*=\s*'([^']*)'""", r"""(?is)\bhref\s*=\s*([^\s"'>]+)""")
    to = (r"""(?is)url\s*=\s*'([^']*)'""", r"""(?is)\burl\s*=\s*([^"'>;]+)""")
    links = F.concat(F.transform(canonical, lambda t: value(t, href)), F.transform(metas, lambda t: value(t, to)))
    return F.when(F.coalesce(html.rlike("(?i)canonical|refresh"), F.lit(False)), F.filter(links, lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))


def page_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b): from each page's URL to the URLs that it redirects to or names as canonical."""
    links = pages.select(F.col(url_col).alias("url"), F.explode(page_links(F.col(html_col))).alias("link"))
    return links.select(node_of(F.col("url")).alias("a"), node_of(resolved(F.col("link"), F.col("url"))).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """(id, host, path, rule, verdict, component): allow or block for each row.

    A rule fits its host and all subdomains if the path starts with the rule's path; the longest that fits decides. A
    URL that no rule fits takes the verdict of its aliases: URLs joined by redirects (columns a and b, if given) and
    canonical or refresh links of the pages. If a rule allows one of these the verdict is allow, else if a rule blocks
    one it is block, else allow. Targets count even if they are no page. component is the smallest URL of the aliases,
    null if there are none. Null URLs and those without `://` have an empty host and path, no rule and no aliases.
    Rows with equal URLs each get a row. The rules are a list given by the caller and become one expression.
    """
    edges = redirects.select(node_of(F.col("a")).alias("a"), node_of(F.col("b")).alias("b")).where("a IS NOT NULL AND b IS NOT NULL") if redirects is not None else None
    if html_col is not None:
        own = page_edges(pages, url_col, html_col)
        edges = own if edges is None else edges.union(own)
    judged = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"))
    judged = judged.select("_id", node_of(F.col("_url")).alias("_node"), host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"))
    judged = judged.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    found = components(edges) if edges is not None else pages.sparkSession.createDataFrame([], "node string, root string")
    decided = found.withColumn("_rule", rule_of(host_of(F.col("node")), path_of(F.col("node")), rules)["verdict"])
    by_root = staged(decided.groupBy("root").agg(F.coalesce(F.max(F.col("_rule") == "allow"), F.lit(False)).alias("allowed"), F.coalesce(F.max(F.col("_rule") == "block"), F.lit(False)).alias("blocked")), "verdicts")
    table = look_up(found, "root", by_root, "node").select(F.col("node").alias("_node"), F.col("root").alias("component"), "allowed", "blocked")
    out = look_up(judged, "_node", table, "_id")
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.coalesce("allowed", F.lit(False)), "allow").when(F.coalesce("blocked", F.lit(False)), "block").otherwise("allow"))
    return out.select(F.col("_id").alias(id_col), "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "component")


def op7_urls(spark, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES).drop("component")


OP7_SQL = r"""
WITH p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
             CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '^(.*?://[^/?#]*)([^#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(url, '^(.*?://[^/?#]*)([^#]*)', 2, 's') END AS node,
             html FROM pages),
rules(rh, rp, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
tags AS (SELECT node, unnest(regexp_extract_all(html, '<link\b[^>]*>', 0, 'is')) AS tag FROM p WHERE node IS NOT NULL),
links AS (SELECT node AS a, regexp_extract(tag, 'href\s*=\s*"([^"]*)"', 1, 'is') AS b FROM tags WHERE regexp_matches(tag, 'rel\s*=\s*["'']?[^"''>]*canonical', 'is')),
nodes AS (SELECT a, translate(regexp_extract(b, '^(.*?://[^/?#]*)([^#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(b, '^(.*?://[^/?#]*)([^#]*)', 2, 's') AS b FROM links WHERE contains(b, '://')),
ends AS (SELECT a, b FROM nodes UNION SELECT b, a FROM nodes UNION SELECT a, a FROM nodes UNION SELECT b, b FROM nodes),
reach AS (WITH RECURSIVE r AS (SELECT a, b FROM ends UNION SELECT r.a, ends.b FROM r JOIN ends ON r.b = ends.a) SELECT * FROM r),
verdicts AS (SELECT reach.a AS node, arg_max(v, len(rh) + len(rp)) AS v, reach.b FROM reach JOIN rules
             ON (regexp_extract(reach.b, '^.*?://([^/?#]*)', 1, 's') = rh OR ends_with(regexp_extract(reach.b, '^.*?://([^/?#]*)', 1, 's'), '.' || rh)) AND starts_with(regexp_extract(reach.b, '^.*?://[^/?#]*([^?#]*)', 1, 's'), rp) GROUP BY reach.a, reach.b),
alias AS (SELECT node, CASE WHEN bool_or(v = 'allow') THEN 'allow' ELSE 'block' END AS v FROM verdicts GROUP BY node),
own AS (SELECT page_id, arg_max(rh || rp, len(rh) + len(rp)) AS rule, arg_max(v, len(rh) + len(rp)) AS v FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT page_id, host, path, own.rule, coalesce(own.v, alias.v, 'allow') AS verdict
FROM p LEFT JOIN own USING (page_id) LEFT JOIN alias USING (node)
"""
