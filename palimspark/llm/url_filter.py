"""URL rules, spread over redirect and canonical-link equivalence.

Every address has a node key (host, path without its closing slash, and query; no scheme and no fragment). All of a
page's ``<link rel="canonical">`` and ``<meta http-equiv="refresh">`` are edges from the page's node to the nodes they
name, relative ones by the page's own address. Connected components over those edges are aliases of one another. A url that a rule fits has that
rule's verdict; any other takes its component's: allow if a member is allowed by a rule, else block if a
member is blocked by a rule, else allow. Targets that aren't pages themselves are judged as members too.

Everything is DataFrame expressions and joins.

Defined results: a null url or one without ``://`` has an empty host and path, fits no rule and has no node, and
is allowed; a null html has no edges; targets of other schemes (``mailto:``) and bare fragments are ignored, a
``<base>`` isn't read and ``&amp;`` is the only entity that is; equal urls share their node; a
repeated row gives a repeated row; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import ascii_lower, written


class UrlRule(NamedTuple):
    host: str
    path: str
    verdict: str


#: The production rules.
RULES = [
    UrlRule("net", "/", "block"),
    UrlRule("example.net", "/en/", "allow"),
    UrlRule("example.com", "/de/", "block"),
    UrlRule("org", "/fr/", "allow"),
]

#: A link whose ``rel`` has the token canonical, and a refresh; attributes stand behind white space or a quote, so ``data-href`` is none.
CANONICAL = r"""(?is)<link(?=[^>]*[\s"']rel\s*=\s*(?:"(?:[^">]*\s)?canonical(?:\s[^">]*)?"|'(?:[^'>]*\s)?canonical(?:\s[^'>]*)?'|canonical(?=[\s/>])))(?=\s)[^>]*?[\s"']href\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?is)<meta(?=[^>]*[\s"']http-equiv\s*=\s*["']?refresh(?![\w-]))(?=\s)[^>]*?[\s"']content\s*=\s*["']?[^"'>]*?\burl\s*=\s*["']?([^"'\s>]+)"""
COMMENT = r"(?s)<!--.*?(?:-->|$)"


def url_host(url: Column) -> Column:
    """From after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_query(url: Column) -> Column:
    """The query with its ``?``; empty where there is none."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)?", 1), F.lit(""))


def _without_dots(path: Column) -> Column:
    """A path that starts with a slash, its segments ``.`` and ``..`` resolved."""
    parts = F.split(F.regexp_replace(path, r"(?<=/)\.\.?$", "$0/"), "/", -1)
    kept = F.aggregate(
        F.slice(parts, 2, F.size(parts)),
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x == ".", acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, x)),
    )
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def absolute(target: Column, host: Column, path: Column) -> Column:
    """``target`` as a whole address, by host and path of the page that names it; null where it names no other page."""
    target = F.replace(target, F.lit("&amp;"), F.lit("&"))
    own, rest = F.regexp_extract(target, r"(?s)^([^?#]*)", 1), F.regexp_extract(target, r"(?s)^[^?#]*(.*)", 1)
    folder = F.concat(F.lit("/"), F.regexp_extract(path, r"(?s)^/(.*/)", 1))
    at = F.concat(F.lit("http://"), host)  # node keys have no scheme
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when((host == "") | target.rlike(r"^(#|[A-Za-z][A-Za-z0-9+.-]*:)"), F.lit(None).cast("string"))
        .when(target.startswith("?"), F.concat(at, path, target))
        .when(target.startswith("/"), F.concat(at, _without_dots(own), rest))
        .otherwise(F.concat(at, _without_dots(F.concat(folder, own)), rest))
    )


def matching_rule(host: Column, path: Column, rules: list[UrlRule], value) -> Column:
    """``value(rule)`` of the longest rule that fits, else null: hosts and their subdomains, paths by prefix.

    The longest is the one with the longest host and path together, the longer host among equals.
    """
    chosen = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.host) + len(r.path), len(r.host))):  # later ones win
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        chosen = F.when(fits, F.lit(value(rule))).otherwise(chosen)
    return chosen


def node_key(host: Column, path: Column, query: Column) -> Column:
    """One name for the spellings of an address, null where there is no host."""
    return F.when(host != "", F.concat(host, F.regexp_replace(path, "/+$", ""), F.when(query != "?", query).otherwise("")))


def judge_urls(pages: DataFrame, rules: list[UrlRule] | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, node and component of every row of ``pages`` (page_id, url, html)."""
    rules = RULES if rules is None else rules
    url, html = F.col("url").cast("string"), F.regexp_replace(F.col("html").cast("string"), COMMENT, " ")
    parsed = pages.select("page_id", url_host(url).alias("host"), url_path(url).alias("path"), url_query(url).alias("query"), F.concat(*(F.when(F.coalesce(html, F.lit("")).rlike(p), F.regexp_extract_all(html, F.lit(p), F.lit(1))).otherwise(F.array().cast("array<string>")) for p in (CANONICAL, REFRESH))).alias("targets"))
    rule = matching_rule(F.col("host"), F.col("path"), rules, lambda r: r.host + r.path)
    own = matching_rule(F.col("host"), F.col("path"), rules, lambda r: r.verdict)
    named = parsed.withColumns({"rule": rule, "own": own, "node": node_key(F.col("host"), F.col("path"), F.col("query"))}).drop("query")
    kept = written(named, "judged-urls")  # read more than once below; html is left behind
    links = kept.filter(F.size("targets") > 0).select("node", "host", "path", F.explode("targets").alias("target"))
    links = links.select("node", absolute(F.col("target"), F.col("host"), F.col("path")).alias("target"))
    ends = links.select("node", url_host(F.col("target")).alias("host"), url_path(F.col("target")).alias("path"), url_query(F.col("target")).alias("query"))
    ends = ends.withColumns({"own": matching_rule(F.col("host"), F.col("path"), rules, lambda r: r.verdict), "target": node_key(F.col("host"), F.col("path"), F.col("query"))})
    ends = written(ends.filter("node is not null and target is not null"), "url-links")
    components = connected_components(ends, "node", "target")
    members = kept.filter("node is not null and own is not null").select("node", "own").unionByName(ends.filter("own is not null").select(F.col("target").alias("node"), "own"))
    # Only what is linked needs a verdict from elsewhere; the join keeps one small row per component.
    spread = (
        members.join(components, "node")
        .groupBy("component")
        .agg(F.when(F.max(F.col("own") == "allow"), "allow").otherwise("block").alias("theirs"))
    )
    found = kept.join(components, "node", "left").join(spread, "component", "left")
    verdict = F.coalesce("own", "theirs", F.lit("allow"))
    return found.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "node", F.coalesce("component", "node").alias("component"))


QUERY_COLUMNS = ["page_id", "host", "path", "rule", "verdict"]


def oracle() -> str:
    """The same for DuckDB, with a recursive closure over the links."""
    fits = lambda r, host="host", path="path": f"(({host} = '{r.host}' OR {host} LIKE '%.{r.host}') AND starts_with({path}, '{r.path}'))"
    longest = sorted(RULES, key=lambda r: (-len(r.host) - len(r.path), -len(r.host)))
    case = lambda value, *a: "CASE " + " ".join(f"WHEN {fits(r, *a)} THEN '{value(r)}'" for r in longest) + " END"
    lower = "translate(%s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parse = lambda c: (lower % f"coalesce(regexp_extract({c}, '(?s)^.*?://([^/?#]*)', 1), '')", f"coalesce(regexp_extract({c}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')")
    host, path = parse("url")
    thost, tpath = parse("target")
    key = "CASE WHEN host <> '' THEN host || regexp_replace(path, '/+$', '') END"
    tag = lambda name, value: f"list_filter(regexp_extract_all(html, '(?is)<{name}\\b[^>]*>'), lambda x: regexp_matches(x, '{value}'))"
    return f"""
WITH RECURSIVE p AS (SELECT page_id, {host} AS host, {path} AS path, regexp_replace(coalesce(html, ''), '(?s)<!--.*?(-->|$)', ' ', 'g') AS html FROM pages),
j AS (SELECT *, {case(lambda r: r.host + r.path)} AS rule, {case(lambda r: r.verdict)} AS own, {key} AS node FROM p),
t AS (SELECT node, regexp_extract(unnest({tag("link", "(?i)[\\s\"'']rel\\s*=\\s*([\"'']([^\"''>]*\\s)?canonical[\\s\"'']|canonical[\\s/>])")}), '(?i)[\\s"'']href\\s*=\\s*["'']?([^"''\\s>]+)', 1) AS target FROM j
      UNION ALL
      SELECT node, regexp_extract(unnest({tag("meta", "(?i)http-equiv\\s*=\\s*[\"'']?refresh")}), '(?i)url\\s*=\\s*["'']?([^"''\\s>]+)', 1) FROM j),
e0 AS (SELECT node, {thost} AS host, {tpath} AS path FROM t),
e AS (SELECT node, {key} AS target, {case(lambda r: r.verdict)} AS own FROM e0 WHERE host <> '' AND node IS NOT NULL),
both_ways AS (SELECT node AS a, target AS b FROM e UNION SELECT target, node FROM e),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, x.b FROM reach r JOIN both_ways x ON r.b = x.a),
known AS (SELECT node, own FROM j WHERE own IS NOT NULL AND node IS NOT NULL UNION SELECT target, own FROM e WHERE own IS NOT NULL),
theirs AS (SELECT a AS node, CASE WHEN bool_or(own = 'allow') THEN 'allow' ELSE 'block' END AS theirs FROM reach JOIN known ON known.node = b GROUP BY a)
SELECT page_id, host, path, rule, coalesce(own, theirs, 'allow') AS verdict FROM j LEFT JOIN theirs USING (node)"""
