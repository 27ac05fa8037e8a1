"""URL filters with redirect equivalence, in DataFrame functions only.

A url is cut into host and path and judged by the longest rule that fits its host (or a parent domain)
and the start of its path. Urls that redirect to each other (meta refresh) or name a canonical link are
aliases, and so is a url without its fragment; connected components over these edges carry decisions:
a url without a rule of its own is blocked if its component holds a blocked url and no allowed one
(allow has precedence). A url's own rule always stands.

Edges may be given as well, as (src, dst) urls. Components are found with aggregates and equi joins (see
`components`); a rule table is small and given by the caller, and each host looks up its own parent domains.

Cases: null urls and urls without :// have empty host and path, no rule, no edge and are allowed. Repeated
rows are judged alike. Pages without a link are components of their own. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components

#: Fixed values: (rule, verdict), a rule being host and start of path.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_path(url: Column) -> tuple[Column, Column]:
    rest = F.substring_index(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), "#", 1)
    rest = F.substring_index(rest, "?", 1)
    host = F.substring_index(rest, "/", 1)
    return F.coalesce(_lower(host), F.lit("")), F.coalesce(F.substr(rest, F.length(host) + 1), F.lit(""))


def parse(pages: DataFrame, url: str = "url") -> DataFrame:
    host, path = host_path(F.col(url))
    return pages.withColumns({"host": host, "path": path})


def own_rules(hosts: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """rule, own (its verdict) for rows with host and path: the longest rule that fits, or null."""
    best = F.lit(None).cast("struct<size:int,rule:string,own:string>")
    for rule, verdict in rules:
        domain, slash, start = rule.partition("/")
        fits = ((F.col("host") == domain) | F.col("host").endswith("." + domain)) & F.col("path").startswith(slash + start)
        best = F.greatest(best, F.when(fits, F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("own"))))
    return hosts.withColumn("__best", best).withColumns({"rule": F.col("__best.rule"), "own": F.col("__best.own")}).drop("__best")


def node(url: Column) -> Column:
    """What stands for a url as a vertex: no fragment, scheme and host in lower case."""
    bare = F.substring_index(url, "#", 1)
    head = F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", 0)
    return F.when(head != "", F.concat(_lower(head), F.substr(bare, F.length(head) + 1)))


def absolute(link: Column, url: Column) -> Column:
    """`link` as found on page `url`; null if it is no web address."""
    root = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
    scheme = F.substring_index(url, "://", 1)
    folder = F.regexp_extract(F.substring_index(F.substring_index(url, "#", 1), "?", 1), r"^[A-Za-z][A-Za-z0-9+.-]*://.*/", 0)
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") | (link == ""), F.lit(None))
        .otherwise(F.concat(F.when(folder.rlike("://[^/]"), folder).otherwise(F.concat(root, F.lit("/"))), link))
    )


def page_edges(pages: DataFrame) -> DataFrame:
    """(src, dst) of canonical links and meta refreshes in pages' html."""
    canonical_tag = F.regexp_extract("html", r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>", 0)
    refresh_tag = F.regexp_extract("html", r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>", 0)
    canonical = F.regexp_extract(canonical_tag, r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    refresh = F.regexp_extract(refresh_tag, r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1)
    links = pages.where("html is not null and url is not null").select("url", F.explode(F.array(canonical, refresh)).alias("link")).where("link != ''")
    return links.select(node(F.col("url")).alias("src"), node(absolute(F.col("link"), F.col("url"))).alias("dst"))


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, edges: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, component (a url; null for a page without aliases)."""
    links = page_edges(pages)
    if edges is not None:
        links = links.union(edges.select(node(F.col("src")), node(F.col("dst"))))
    links = links.where("src is not null and dst is not null and src != dst").distinct()
    groups = components(links, "src", "dst").withColumnRenamed("node", "vertex")
    ruled = own_rules(parse(groups, "vertex"), rules)
    carried = ruled.groupBy("component").agg(F.max((F.col("own") == "allow").cast("int")).alias("allowed"), F.max((F.col("own") == "block").cast("int")).alias("blocked"))
    carried = carried.select("component", F.when((F.coalesce("allowed", F.lit(0)) == 0) & (F.col("blocked") == 1), "block").otherwise("allow").alias("carried"))
    known = groups.join(carried, "component")  # a vertex is one row, so pages without aliases don't meet on a missing component
    own = own_rules(parse(pages.select("page_id", "url")), rules).withColumn("vertex", node(F.col("url")))
    out = own.join(known, "vertex", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("own", "carried", F.lit("allow")).alias("verdict"), "component")
