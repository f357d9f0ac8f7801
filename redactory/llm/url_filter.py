"""URL filters: redirect equivalence (DataFrame functions only).

Rules decide by host and path. Pages, redirects and canonical links make an undirected graph of URLs; its connected
components are sets of aliases. A URL without a rule of its own is blocked if an alias is blocked. An explicit allow
takes precedence: a URL with an allow rule stays allowed whatever its aliases are.

Defined cases: a null URL, or one without ``://``, has an empty host and path, no rule and no aliases; null html has
no links; repeated pages are judged each; of fitting rules that are equally long
the one named first counts; an empty table gives no rows; of the input only the named columns are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redactory.llm.common import connected_components, read_table, stored

#: (host, path, verdict). Fixed values of the production query.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    """What follows the first ``://``; null if there is none."""
    return F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(_after_scheme(url), r"\A([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as struct<rule, verdict>, else null. The rules are a short list; each is an expression."""
    longest_first = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in longest_first]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def node_of(url: Column) -> Column:
    """A URL as a node of the graph: lower-case scheme and host, no fragment; null without ``://``."""
    scheme = F.lower(F.substring_index(url, "://", 1))
    rest = F.regexp_extract(_after_scheme(url), r"\A[^/?#]*([^#]*)", 1)
    return F.when(F.locate("://", url) > 0, F.concat(scheme, F.lit("://"), host_of(url), F.when(rest == "", "/").otherwise(rest)))


def link_edges(pages: DataFrame) -> DataFrame:
    """Edges (a, b) from each page to the targets of its meta refresh and canonical links.

    Links may be absolute, without a scheme, from the root, or relative to the page's folder.
    """
    tags = F.regexp_extract_all("html", F.lit(r"(?is)<(?:link|meta)\b[^>]*\b(?:canonical|refresh)\b[^>]*>"), F.lit(0))
    quoted = r"""\s*=\s*["']?"""
    canonical = F.when(F.col("tag").rlike(r"(?is)\brel" + quoted + "canonical"), F.regexp_extract("tag", r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)""", 1))
    refresh = F.when(F.col("tag").rlike(r"(?is)\bhttp-equiv" + quoted + "refresh"), F.regexp_extract("tag", r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)""", 1))
    found = pages.where(F.col("html").rlike(r"(?i)\b(?:canonical|refresh)\b")).select("url", F.explode(tags).alias("tag"))
    found = found.select("url", F.replace(F.coalesce(canonical, refresh), F.lit("&amp;"), F.lit("&")).alias("link")).distinct()
    found = stored(found.where("link IS NOT NULL AND link <> '' AND contains(url, '://')"))  # few rows; written so that the expressions below stay small
    url, link = F.col("url"), F.col("link")
    found = found.select("url", "link", F.substring_index(url, "://", 1).alias("scheme"), host_of(url).alias("host"), F.regexp_extract(path_of(url), r"\A(.*/)", 1).alias("folder"))
    root = F.concat("scheme", F.lit("://"), "host")
    target = (
        F.when(link.contains("://"), link).when(link.startswith("//"), F.concat("scheme", F.lit(":"), link)).when(link.startswith("/"), F.concat(root, link))
        .otherwise(F.concat(root, F.when(F.col("folder") == "", "/").otherwise(F.col("folder")), link))
    )
    found = stored(found.select("url", target.alias("target")).distinct())
    return found.select(node_of(url).alias("a"), node_of(F.col("target")).alias("b")).distinct()


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], edges: DataFrame) -> DataFrame:
    """pages (page_id, url) with host, path, rule, verdict and component (null where a URL has no alias)."""
    components = connected_components(edges)
    placed = components.select("component", host_of(F.col("node")).alias("host"), path_of(F.col("node")).alias("path")).distinct()
    ruled = placed.select("component", best_rule(F.col("host"), F.col("path"), rules)["verdict"].alias("verdict"))
    blocked = ruled.where("verdict = 'block'").select("component").distinct().withColumn("alias_blocked", F.lit(True))
    parts = components.join(blocked, "component", "left").select("node", "component", "alias_blocked")
    own = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("node"))
    own = own.withColumn("own", best_rule(F.col("host"), F.col("path"), rules))
    inherited = F.when(F.coalesce("alias_blocked", F.lit(False)), "block").otherwise("allow")
    return own.join(parts, "node", "left").select("page_id", "url", "host", "path", F.col("own.rule").alias("rule"), F.coalesce(F.col("own.verdict"), inherited).alias("verdict"), "component")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return judge_urls(pages, RULES, link_edges(pages)).select("page_id", "host", "path", "rule", "verdict")


def url_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where pages have aliases: each five pages in a row name the first of them as canonical, in one form or another."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    first = pages.select(F.col("page_id").alias("first_id"), F.col("url").alias("target"))
    linked = pages.withColumn("first_id", F.col("page_id") - F.col("page_id") % 5).join(first, "first_id", "left")
    tag = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('<link rel="canonical" href="'), "target", F.lit('">'))).otherwise(F.concat(F.lit('<META http-equiv=refresh content="0; url='), "target", F.lit('">')))
    linked = linked.select("page_id", "url", F.concat(F.coalesce("html", F.lit("")), F.coalesce(tag, F.lit(""))).alias("html"))
    return judge_urls(linked, RULES, link_edges(linked)).select("page_id", "host", "path", "rule", "verdict")


#: The same by SQL for absolute links: who can be reached from a blocked URL over the edges in either direction.
OP3_SQL = r"""
WITH RECURSIVE parts AS (
  SELECT page_id, url, html, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
), p AS (
  SELECT page_id, url, html, lower(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), '')) AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM parts
), rules(h, pre, verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), links AS (
  SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*\b(?:canonical|refresh)\b[^>]*>')) AS tag FROM pages
), targets AS (
  SELECT url, CASE WHEN regexp_matches(tag, '(?is)\brel\s*=\s*["'']?canonical') THEN regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
                   ELSE regexp_extract(tag, '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1) END AS target FROM links
), edges AS (
  SELECT DISTINCT split_part(url, '#', 1) AS a, split_part(target, '#', 1) AS b FROM targets WHERE contains(target, '://')
), both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
nodes AS (SELECT DISTINCT a AS n FROM both_ways),
node_rule AS (
  SELECT n, (SELECT arg_max(verdict, length(h || pre)) FROM rules WHERE (nh = h OR ends_with(nh, '.' || h)) AND starts_with(np, pre)) AS verdict
  FROM (SELECT n, lower(regexp_extract(substr(n, instr(n, '://') + 3), '^([^/?#]*)', 1)) AS nh, regexp_extract(substr(n, instr(n, '://') + 3), '^[^/?#]*([^?#]*)', 1) AS np FROM nodes)
), reached AS (
  SELECT n FROM node_rule WHERE verdict = 'block'
  UNION SELECT e.b FROM both_ways e JOIN reached r ON e.a = r.n
), judged AS (
  SELECT page_id, url, host, path, (SELECT arg_max(h || pre, length(h || pre)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre)) AS rule FROM p
)
SELECT page_id, host, path, rule,
  coalesce((SELECT verdict FROM rules WHERE h || pre = rule), CASE WHEN split_part(url, '#', 1) IN (SELECT n FROM reached) THEN 'block' ELSE 'allow' END) AS verdict
FROM judged
"""
_LINKED = """WITH RECURSIVE linked_pages AS (SELECT p.page_id, p.url, coalesce(p.html, '') || coalesce(CASE WHEN p.page_id % 2 = 0 THEN '<link rel="canonical" href="' || q.url || '">'
  ELSE '<META http-equiv=refresh content="0; url=' || q.url || '">' END, '') AS html FROM pages p LEFT JOIN pages q ON q.page_id = p.page_id - p.page_id % 5), parts AS"""
ALIASES_SQL = OP3_SQL.replace("FROM pages", "FROM linked_pages").replace("WITH RECURSIVE parts AS", _LINKED)
