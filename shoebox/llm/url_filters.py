"""URL filters with redirect equivalence (operator 1).

Rules are (verdict, host, path). A rule fits a URL if the URL's host is the rule's or a subdomain of it and
the URL's path starts with the rule's; the longest rule wins. URLs that no rule fits get the verdict of
their redirect class: pages that redirect to one another (meta refresh) or name one another as
canonical are one class, found as distributed connected components, and a block of any member is
passed on to all its aliases. An explicit allow has precedence: a member that an allow rule
fits stays allowed. Everything else is allowed.

A node of the graph is host + path + query; scheme and fragment do not part pages. Targets are resolved against
the page's URL (dot segments, '?' targets, an empty path as '/'), with &amp; decoded. Rules meet URLs by
an equi-join on host suffixes (one row per label of the host), so neither side is multiplied.

Defined cases: a null URL, or one without '://', has empty host and path, fits no rule, and is no node:
it is allowed; repeated rows are judged alike; null html has no edges; a tie of rules of equal
length goes to allow; URLs and html of any length are read whole (a host of many labels has a row for each); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from ..operators.components import components

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(\??[^#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules up to which they are broadcast.
BROADCAST_RULES = 100_000
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def node(url: Column) -> Column:
    """host + path + query; null where there is no host."""
    key = F.concat(host(url), F.when(path(url) == "", "/").otherwise(path(url)), F.regexp_extract(url, _PARTS, 3))
    return F.when(host(url) != "", key)


def without_dots(url: Column) -> Column:
    """The URL with the segments . and .. of its path removed."""

    def step(kept: Column, x: Column) -> Column:
        return F.when(x == ".", kept).when(x == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(1)))).otherwise(F.concat(kept, F.array(x)))

    parts = F.split(path(url), "/")
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    kept = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    plain = F.concat(F.lit("x://"), host(url), F.array_join(kept, "/"), F.regexp_extract(url, _PARTS, 3))
    return F.when(path(url).rlike(r"/\.\.?(/|$)"), plain).otherwise(url)


def link_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b): nodes that a page's canonical link or meta refresh ties together."""
    html = F.col(html_col)
    canonical = F.regexp_extract(html, r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)""", 1)
    refresh = F.regexp_extract(html, r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\bcontent\s*=\s*["']?[^"'>]*?url\s*=\s*["']?([^"'\s>]+)""", 1)
    may = pages.where(F.lower(html).rlike("canonical|http-equiv")).select(F.col(url_col).alias("url"), F.explode(F.array(canonical, refresh)).alias("to")).where("to <> ''")
    may = may.withColumn("to", F.regexp_replace("to", "(?i)&amp;|&#0*38;|&#x0*26;", "&"))
    scheme = F.regexp_extract("url", r"^([^:/?#]*)://", 1)
    own = F.when(path(F.col("url")) == "", "/").otherwise(path(F.col("url")))
    near = F.when(F.col("to").startswith("?"), F.concat(own, "to")).when(F.col("to").startswith("#"), F.concat(own, F.regexp_extract("url", _PARTS, 3))).otherwise(F.concat(F.regexp_extract(own, "^(.*/)?", 1), "to"))
    full = F.when(F.col("to").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), F.col("to")).when(F.col("to").startswith("//"), F.concat(scheme, F.lit(":"), "to")).when(F.col("to").startswith("/"), F.concat(scheme, F.lit("://"), host(F.col("url")), "to")).otherwise(F.concat(scheme, F.lit("://"), host(F.col("url")), near))
    return may.select(node(F.col("url")).alias("a"), node(without_dots(full)).alias("b")).where("a is not null and b is not null and a <> b").distinct()


def rule_verdicts(urls: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """(url, rule, verdict) of the distinct URLs that a rule fits. rules: verdict, host, path."""
    rows = urls.select(F.col(url_col).alias("url")).where("url is not null").distinct().withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url"))).where("host <> ''")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    book = rules.select(F.col("host").alias("suffix"), F.col("path").alias("start"), F.concat("host", "path").alias("rule"), "verdict")
    book = F.broadcast(book) if rules.count() <= BROADCAST_RULES else book
    fits = rows.select("url", "path", F.explode(suffixes).alias("suffix")).join(book, "suffix").where(F.expr("startswith(path, start)"))
    best = fits.groupBy("url").agg(F.max(F.struct(F.length("rule").alias("n"), (F.col("verdict") == "allow").alias("allow"), "rule", "verdict")).alias("x"))
    return best.select("url", "x.rule", "x.verdict")


def blocked_nodes(ruled: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes of redirect classes of which a rule blocks a member. ruled: node, verdict."""
    classes = components(edges).withColumnRenamed("id", "node")
    bad = ruled.where("verdict = 'block'").select("node").distinct().join(classes, "node").select("component").distinct()
    return classes.join(bad, "component", "left_semi").select("node")


def judge(pages: DataFrame, rules: DataFrame, edges: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, by) of every row; by is rule, redirect or default."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    ruled = rule_verdicts(rows, rules)
    out = rows.join(ruled, "url", "left").withColumn("node", node(F.col("url")))
    edges = written(edges, "edges")
    if edges.isEmpty():
        out = out.withColumn("aliased", F.lit(False))
    else:
        targets = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        seen = ruled.select(node(F.col("url")).alias("node"), "verdict")
        more = rule_verdicts(targets.select(F.concat(F.lit("x://"), "node").alias("url")), rules).select(node(F.col("url")).alias("node"), "verdict")
        blocked = blocked_nodes(seen.unionByName(more), edges).withColumn("aliased", F.lit(True))
        out = out.join(blocked, "node", "left")
    aliased = F.coalesce("aliased", F.lit(False))
    verdict = F.when(F.col("verdict").isNotNull(), F.col("verdict")).when(aliased, "block").otherwise("allow")
    by = F.when(F.col("verdict").isNotNull(), "rule").when(aliased, "redirect").otherwise("default")
    return out.select("id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), "rule", verdict.alias("verdict"), by.alias("decided_by"))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return judge(pages, rules, link_edges(pages)).withColumnRenamed("id", "page_id")


_VALUES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)


def _tag(name: str, key: str, value: str, target: str) -> str:
    """SQL: the target in the first tag of html that has the key."""
    return f"""regexp_extract(list_filter(regexp_extract_all(html, '(?is)<{name}\\b[^>]*'), lambda x: regexp_matches(x, '(?is)\\b{key}\\s*=\\s*["'']?{value}\\b') AND regexp_matches(x, '(?is){target}'))[1], '(?is).*{target}', 1)"""


ORACLE = f"""
WITH RECURSIVE rules(v, h, p) AS (VALUES {_VALUES}),
u AS (SELECT row_number() OVER () AS rid, page_id, url, html, position('://' IN coalesce(url, '')) AS pos FROM pages),
s AS (SELECT *, CASE WHEN pos > 0 THEN url[pos + 3:] ELSE '' END AS rest FROM u),
t AS (SELECT rid, page_id, url, html, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*(\\??[^#]*)', 1) AS query FROM s),
n AS (SELECT *, CASE WHEN path = '' THEN '/' ELSE path END AS own, CASE WHEN host <> '' THEN host || CASE WHEN path = '' THEN '/' ELSE path END || query END AS node FROM t),
f AS (SELECT rid, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v FROM t JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY rid),
k AS (SELECT node, host, own, query, {_tag("link", "rel", "canonical", """\\bhref\\s*=\\s*["'']?([^"''\\s>]+)""")} AS raw FROM n WHERE node IS NOT NULL
      UNION ALL SELECT node, host, own, query, {_tag("meta", "http-equiv", "refresh", """\\bcontent\\s*=\\s*["'']?[^"''>]*?url\\s*=\\s*["'']?([^"''\\s>]+)""")} FROM n WHERE node IS NOT NULL),
k1 AS (SELECT node, host, own, query, regexp_replace(raw, '(?i)&amp;|&#0*38;|&#x0*26;', '&', 'g') AS l FROM k WHERE raw <> ''),
k2 AS (SELECT node AS a, regexp_replace(CASE WHEN regexp_matches(l, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN regexp_replace(l, '^.*?://', '') WHEN starts_with(l, '//') THEN l[3:] WHEN starts_with(l, '/') THEN host || l
        WHEN starts_with(l, '?') THEN host || own || l WHEN starts_with(l, '#') THEN host || own || query ELSE host || regexp_extract(own, '^(.*/)?') || l END, '#.*$', '') AS rest FROM k1),
k3 AS (SELECT a, translate(regexp_extract(rest, '^[^/?]*'), '{_UPPER}', '{_LOWER}') AS h, regexp_extract(rest, '^[^/?]*([^?]*)', 1) AS p, regexp_extract(rest, '^[^?]*(.*)$', 1) AS q FROM k2),
k4 AS (SELECT a, h || CASE WHEN p = '' THEN '/' WHEN regexp_matches(p, '/\\.\\.?(/|$)') THEN
        list_reduce(string_split(p, '/'), lambda x, y: CASE y WHEN '.' THEN x WHEN '..' THEN regexp_replace(x, '/[^/]*$', '') ELSE x || '/' || y END) || CASE WHEN regexp_matches(p, '/\\.\\.?$') THEN '/' ELSE '' END ELSE p END || q AS b FROM k3 WHERE h <> ''),
e AS (SELECT a, b FROM k4 WHERE a <> b UNION SELECT b, a FROM k4 WHERE a <> b),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
seen AS (SELECT n.node, f.v FROM n JOIN f USING (rid) UNION ALL SELECT a, v FROM (SELECT DISTINCT a, regexp_extract(a, '^[^/]*') AS host, regexp_extract(a, '^[^/]*([^?]*)', 1) AS path FROM e)
         JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) QUALIFY row_number() OVER (PARTITION BY a ORDER BY length(h || p) DESC) = 1),
bad AS (SELECT DISTINCT r.b AS node FROM r JOIN seen ON seen.node = r.a WHERE seen.v = 'block')
SELECT n.page_id, n.host, n.path, f.rule, coalesce(f.v, CASE WHEN bad.node IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
  CASE WHEN f.v IS NOT NULL THEN 'rule' WHEN bad.node IS NOT NULL THEN 'redirect' ELSE 'default' END AS decided_by
FROM n LEFT JOIN f USING (rid) LEFT JOIN bad USING (node)
"""
