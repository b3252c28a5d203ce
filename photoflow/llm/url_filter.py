"""URL filter: block and allow rules by host and path, carried over to aliases.

Pages whose canonical link, refresh or redirect leads to one another are one component (distributed connected components
over URLs). In a component an explicit allow takes precedence over blocks; a page's own rule over its component.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photoflow.llm.common import connected_components, materialise

#: (host, path, action); a rule's string is its host and path.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
#: Rules that are broadcast at most; beyond it they are joined by a shuffle on the host.
BROADCAST_RULES = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without it or of null."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty without ``://`` or of null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node(url: Column) -> Column:
    """A URL without scheme and fragment, host in lower case; null where it has no host."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)
    return F.when(host(url) != "", F.concat(host(url), F.when(path(url) == "", "/").otherwise(path(url)), query))


def resolved(href: Column, base: Column) -> Column:
    """``href`` against ``base``: absolute, ``//host``, ``/path``, or relative to the folder; null if empty."""
    h = F.trim(F.replace(href, F.lit("&amp;"), F.lit("&")))
    scheme, folder = F.regexp_extract(base, r"^(.*?:)//", 1), F.regexp_replace(path(base), r"[^/]*$", "")
    return (
        F.when(h == "", None).when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), h).when(h.startswith("//"), F.concat(scheme, h))
        .when(h.startswith("/"), F.concat(scheme, F.lit("//"), host(base), h))
        .when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .otherwise(F.concat(scheme, F.lit("//"), host(base), F.when(folder == "", "/").otherwise(folder), h))
    )


def page_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``src, dst`` URLs of canonical links and refresh redirects in the pages' HTML."""
    tags = F.regexp_extract_all(F.col(html_col), F.lit(r"(?is)(<(?:link|meta)\b[^>]*>)"), 1)
    tags = F.filter(tags, lambda t: t.rlike(r"(?is)\brel\s*=\s*['\"]?\s*canonical\b") | t.rlike(r"(?is)\bhttp-equiv\s*=\s*['\"]?\s*refresh\b"))
    tag = pages.where(f"{url_col} is not null and {html_col} is not null").select(F.col(url_col).alias("src"), F.explode(tags).alias("tag"))
    target = F.when(F.col("tag").rlike(r"(?is)^<link"), F.regexp_extract("tag", r"""(?is)\bhref\s*=\s*['"]?([^'"\s>]*)""", 1))
    target = target.otherwise(F.regexp_extract("tag", r"""(?is)\burl\s*=\s*['"]?([^'"\s>]*)""", 1))
    return tag.select("src", resolved(target, F.col("src")).alias("dst")).where("dst is not null")


def matched(urls: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """``urls`` (keys, host, path) with the ``rule`` string and ``action`` of the longest fitting rule, else null.

    A rule fits its host and that host's subdomains if the path starts with the rule's. Ties in length go to allow, then
    to the greater string. Hosts' suffixes of as many labels as some rule's host has are joined with these by equality.
    """
    rules = rules.select(F.translate("host", _UPPER, _LOWER).alias("rule_host"), F.col("path").alias("rule_path"), "action").distinct()
    small = rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    labels = lambda c: F.length(c) - F.length(F.replace(F.col(c), F.lit("."), F.lit(""))) + 1
    counts = sorted(r[0] for r in rules.select(labels("rule_host")).distinct().collect())  # a host name has 127 labels at most
    suffixes = F.array_compact(F.array(*[F.when(labels("host") >= k, F.substring_index("host", ".", -k)) for k in counts]).cast("array<string>"))
    each = urls.where("host <> ''").select(*keys, "path", F.explode(suffixes).alias("rule_host"))
    hit = each.join(F.broadcast(rules) if small else rules, "rule_host").where("startswith(path, rule_path)")
    best = F.max(F.struct((F.length("rule_host") + F.length("rule_path")).alias("n"), (F.col("action") == "allow").alias("allow"), F.concat("rule_host", "rule_path").alias("rule"), "action"))
    return hit.groupBy(*keys).agg(best.alias("x")).select(*keys, "x.rule", "x.action")


def judged(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col, host, path, rule, verdict, alias_verdict`` for each row of ``pages``.

    verdict: the own rule's action; else allow where the component has an explicit allow, block where it has a block,
    and allow. Edges are those of the pages' HTML and of ``redirects(src, dst)``; the URLs they lead to count with their
    rules even if they are no pages. Null URLs and those without a host have no rule and no alias: allow. Repeated rows
    are judged each. Empty tables give no rows, and no rules allow all.
    """
    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    own = own.select("id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), node(F.col("url")).alias("node"))
    edges = page_edges(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.union(redirects.select("src", "dst"))
    comp = materialise(connected_components(edges.select(node(F.col("src")).alias("src"), node(F.col("dst")).alias("dst"))), "aliases")
    split = [F.regexp_extract("node", r"(?s)^([^/?]*)", 1).alias("host"), F.regexp_extract("node", r"(?s)^[^/?]*([^?]*)", 1).alias("path")]
    ruled = matched(comp.select("node", *split), rules, ["node"])
    said = comp.join(ruled, "node").groupBy("component").agg(F.when(F.max(F.col("action") == "allow"), "allow").otherwise("block").alias("alias_verdict"))
    alias = comp.join(said, "component").select("node", "alias_verdict")
    sites = own.select("host", "path").distinct()  # pages share them; rules read nothing else
    rule = matched(sites, rules, ["host", "path"])
    out = own.join(rule, ["host", "path"], "left").join(alias, "node", "left")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("action", "alias_verdict", F.lit("allow")).alias("verdict"), "alias_verdict")


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


def url_aliases(spark, sf_dir: str) -> DataFrame:
    """The same rules where two pages of three were moved: each leads to the URL of the page before it, so chains of three are one site."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    moved = pages.where("page_id % 3 <> 0").select((F.col("page_id") - 1).alias("to"), F.col("url").alias("src"))
    redirects = moved.join(pages.select(F.col("page_id").alias("to"), F.col("url").alias("dst")), "to").select("src", "dst")
    return judged(pages, spark.createDataFrame(RULES, "host string, path string, action string"), redirects)


#: The pages link to nothing by canonical links or refreshes, so rules decide alone; the aliases are tested on fixtures.
_ORDERED = sorted(RULES, key=lambda r: -len(r[0] + r[1]))


def _case(value) -> str:
    return "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{value(h, p, a)}'" for h, p, a in _ORDERED) + " END"


OP1_SQL = f"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)
SELECT page_id, host, path, {_case(lambda h, p, a: h + p)} AS rule, coalesce({_case(lambda h, p, a: a)}, 'allow') AS verdict,
       CAST(NULL AS VARCHAR) AS alias_verdict
FROM p
"""

URL_ALIASES_SQL = f"""
WITH RECURSIVE u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
             regexp_extract(rest, '^[^?#]*(\\?[^#]*)', 1) AS query FROM u),
n AS (SELECT page_id, host, path, host || CASE WHEN path = '' THEN '/' ELSE path END || query AS node FROM p),
e AS (SELECT a.node AS s, b.node AS d FROM n a JOIN n b ON b.page_id = a.page_id - 1 WHERE a.page_id % 3 <> 0 AND a.host <> '' AND b.host <> '' AND a.node <> b.node),
b AS (SELECT s, d FROM e UNION SELECT d, s FROM e),
r AS (SELECT s AS node, s AS other FROM b UNION SELECT r.node, b.d FROM r JOIN b ON b.s = r.other),
o AS (SELECT node, other, regexp_extract(other, '^([^/?]*)', 1) AS host, regexp_extract(other, '^[^/?]*([^?]*)', 1) AS path FROM r),
k AS (SELECT node, {_case(lambda h, p, a: a)} AS action FROM o),
m AS (SELECT node, CASE WHEN bool_or(action = 'allow') THEN 'allow' ELSE 'block' END AS alias_verdict FROM k WHERE action IS NOT NULL GROUP BY 1)
SELECT page_id, host, path, {_case(lambda h, p, a: h + p)} AS rule, coalesce({_case(lambda h, p, a: a)}, alias_verdict, 'allow') AS verdict, alias_verdict FROM n LEFT JOIN m USING (node)
"""
