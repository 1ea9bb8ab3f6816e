"""URL filter with redirect equivalence.

Explicit rules decide the urls they fit. Redirect and canonical-link edges join
urls into classes by distributed connected components, and a class passes its
decisions on to the urls no rule fits: an explicit allow in the class wins over
a block.

DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.dims import small
from .shared import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
COMMENT = r"(?s)<!--.*?(?:-->|\z)"
LINK, META = r"(?is)<link\b[^>]*>", r"(?is)<meta\b[^>]*>"
VALUE = r"\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
HREF, REL, CONTENT = (rf"(?is)[\s\"'/]{name}{VALUE}" for name in ("href", "rel", "content"))
REFRESH = r"(?is)[\s\"'/]http-equiv\s*=\s*[\"']?\s*refresh\s*[\"'\s/>]"
TARGET = r"(?is)(?:^|[;,\s])url\s*=\s*[\"']?([^\"']*)"
#: Character references that stand for something in a url; the ampersand last.
REFERENCES = (
    (r"(?i)&#0*47;|&#x0*2f;|&sol;", "/"), (r"(?i)&#0*58;|&#x0*3a;|&colon;", ":"), (r"(?i)&#0*63;|&#x0*3f;|&quest;", "?"), (r"(?i)&#0*61;|&#x0*3d;|&equals;", "="),
    (r"(?i)&#0*35;|&#x0*23;|&num;", "#"), (r"(?i)&#0*38;|&#x0*26;|&amp;", "&"),
)
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"
#: Scheme and site, path, query of a url without its fragment.
SITE, PATH, QUERY = r"(?s)^(.*?://[^/?]*)", r"(?s)^.*?://[^/?]*([^?]*)", r"(?s)^[^?]*(\?.*)$"

#: (verdict, host, path): a rule fits its host and all subdomains.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Up to so many rules become one expression; more are joined by host.
MOST_RULES = 2000


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ? or #; empty without ://."""
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, ties by verdict and text; else null."""
    fits = [
        F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    ]
    return F.coalesce(*fits, F.lit(None).cast("struct<rule:string,verdict:string>"))


def ruled(df: DataFrame, url: str, rules=RULES, most: int = MOST_RULES) -> DataFrame:
    """df with host, path and hit, the longest rule that fits its url."""
    named = df.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    if len(rules) <= most:
        return named.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules))
    # a host meets the rules of itself and of all its parents
    table = small(df.sparkSession.createDataFrame(list(rules), "verdict string, parent string, start string").distinct())
    labels = F.split("host", r"\.", -1)
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    pairs = named.select("host", "path").distinct().select("host", "path", F.explode(parents).alias("parent"))
    fits = pairs.join(table, "parent").where(F.col("path").startswith(F.col("start")))
    rank = F.struct(-F.length(F.concat("parent", "start")), "verdict", "parent", "start")
    best = fits.groupBy("host", "path").agg(F.min_by(F.struct(F.concat("parent", "start").alias("rule"), "verdict"), rank).alias("hit"))
    return named.join(best, ["host", "path"], "left")


def node_of(url: Column) -> Column:
    """A url as a node of the link graph: without its fragment, scheme and host
    lower-cased, without the scheme's own port, dot segments resolved."""
    bare = F.regexp_replace(F.trim(url), r"(?s)#.*$", "")
    site = F.translate(F.regexp_extract(bare, SITE, 1), UPPER, LOWER)
    site = F.regexp_replace(F.regexp_replace(site, r"^(http://.*):80$", "$1"), r"^(https://.*):443$", "$1")
    path = F.regexp_replace(F.regexp_extract(bare, PATH, 1), r"(/\.\.?)$", "$1/")
    step = lambda done, s: F.when(s == "..", F.regexp_replace(done, r"(?s)/[^/]*$", "")).when(s == ".", done).otherwise(F.concat(done, F.lit("/"), s))
    steps = F.split(F.when(path == "", "/").otherwise(path), "/", -1)
    return F.when(bare.contains("://"), F.concat(site, F.aggregate(F.slice(steps, 2, F.size(steps)), F.lit(""), step), F.regexp_extract(bare, QUERY, 1)))


def resolve(base: Column, link: Column) -> Column:
    """link as an absolute url, seen from base (RFC 3986); null if it is none of
    the web, such as mailto:."""
    base = F.regexp_replace(base, r"(?s)#.*$", "")
    site, path = F.regexp_extract(base, SITE, 1), F.regexp_extract(base, PATH, 1)
    folder = F.regexp_extract(path, r"(?s)^(.*/)", 1)
    return (
        F.when(link.rlike(SCHEME), F.when(link.contains("://"), link))
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, r"(?s)^(.*?:)//", 1), link))
        .when(link.startswith("/"), F.concat(site, link))
        .when(link.startswith("?"), F.concat(site, path, link))
        .when(link.startswith("#"), base)
        .otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), link))
    )


def _value(tag: Column, pattern: str) -> Column:
    """An attribute's value, however it is quoted; empty if the tag has none."""
    return F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)])


def page_links(pages: DataFrame) -> DataFrame:
    """Edges (u, v): page url to each of its canonical links and refresh targets,
    but for those in comments."""
    # no tag ends after the last bracket; without the rest, a search for one never fails at the end of the page
    page = F.regexp_extract(F.regexp_replace("html", COMMENT, ""), "(?s)^.*>", 0)
    is_canonical = lambda t: F.array_contains(F.split(F.lower(_value(t, REL)), r"\s+"), "canonical")
    canonical = F.transform(F.filter(F.regexp_extract_all(page, F.lit(LINK), F.lit(0)), is_canonical), lambda t: _value(t, HREF))
    refresh = F.transform(F.filter(F.regexp_extract_all(page, F.lit(META), F.lit(0)), lambda t: t.rlike(REFRESH)), lambda t: F.regexp_extract(_value(t, CONTENT), TARGET, 1))
    found = pages.where(F.col("url").contains("://") & F.col("html").rlike(r"(?i)canonical|refresh"))
    found = found.select("url", F.explode(F.concat(canonical, refresh)).alias("link"))
    link = F.trim("link")
    for pattern, char in REFERENCES:
        link = F.regexp_replace(link, pattern, char)
    found = found.select("url", link.alias("link")).where("link <> ''")
    return found.select(node_of(F.col("url")).alias("u"), node_of(resolve(F.col("url"), F.col("link"))).alias("v"))


def judge_urls(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None, most: int = MOST_RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    verdict is that of the longest fitting rule. Where none fits, the classes of
    urls that redirects (u, v), canonical links and refresh targets join decide:
    allow if a rule allows any url of the class, else block if one blocks any,
    else allow. A null url, or one without ://, has empty host and path and no
    class. A null html has no links. Repeated rows are judged alike; further
    columns are ignored. Any number of rules will do.
    """
    edges = page_links(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node_of(F.col("u")).alias("u"), node_of(F.col("v")).alias("v")))
    nodes = ruled(components(edges), "node", rules, most)
    classes = nodes.groupBy("component").agg(
        F.when(F.max(F.col("hit.verdict") == "allow"), "allow").when(F.max(F.col("hit.verdict") == "block"), "block").otherwise("allow").alias("passed")
    )
    passed = nodes.join(classes, "component").select("node", "passed")
    judged = ruled(pages.select("page_id", "url"), "url", rules, most)
    # only urls that no rule fits ask their class, so the rest isn't shuffled
    open_ = judged.where("hit IS NULL AND contains(url, '://')").withColumn("node", node_of(F.col("url"))).join(passed, "node", "left")
    out = ["page_id", "host", "path", F.col("hit.rule").alias("rule")]
    decided = judged.where("hit IS NOT NULL OR url IS NULL OR NOT contains(url, '://')").select(*out, F.coalesce("hit.verdict", F.lit("allow")).alias("verdict"))
    return decided.unionByName(open_.select(*out, F.coalesce("passed", F.lit("allow")).alias("verdict")))


def _sql() -> str:
    q = lambda p: "'" + p.replace("'", "''") + "'"
    first = lambda x, p, i=1: f"coalesce(regexp_extract({x}, {q(p)}, {i}), '')"
    lower = lambda x: f"translate({x}, '{UPPER}', '{LOWER}')"
    host, path = (lambda u: lower(first(u, PARTS))), (lambda u: first(u, PARTS, 2))
    value = lambda t, p: " || ".join(first(t, p, i) for i in (1, 2, 3))

    def node(url: str) -> str:
        bare = f"regexp_replace(trim({url}), '(?s)#.*$', '')"
        site = f"regexp_replace(regexp_replace({lower(first(bare, SITE))}, '^(http://.*):80$', '\\1'), '^(https://.*):443$', '\\1')"
        steps = f"string_split(CASE WHEN {first(bare, PATH)} = '' THEN '/' ELSE regexp_replace({first(bare, PATH)}, '(/[.][.]?)$', '\\1/') END, '/')"
        walk = f"list_reduce({steps}, lambda done, s: CASE WHEN s = '..' THEN regexp_replace(done, '(?s)/[^/]*$', '') WHEN s = '.' THEN done ELSE done || '/' || s END)"
        return f"CASE WHEN contains({bare}, '://') THEN {site} || {walk} || {first(bare, QUERY)} END"

    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    link = "trim(raw)"
    for pattern, char in REFERENCES:
        link = f"regexp_replace({link}, {q(pattern)}, '{char}', 'g')"
    base = "regexp_replace(url, '(?s)#.*$', '')"
    folder = first(first(base, PATH), "(?s)^(.*/)")
    return rf"""
WITH RECURSIVE rules AS (SELECT * FROM (VALUES {rules}) AS r(verdict, rhost, rpath)),
bodies AS (SELECT url, regexp_replace(html, {q(COMMENT)}, '', 'g') AS page FROM pages WHERE contains(url, '://') AND html IS NOT NULL),
tags AS (
  SELECT url, {value('tag', HREF)} AS raw FROM (SELECT url, unnest(regexp_extract_all(page, {q(LINK)}, 0)) AS tag FROM bodies)
  WHERE list_contains(regexp_split_to_array(lower({value('tag', REL)}), '\s+'), 'canonical')
  UNION ALL
  SELECT url, {first('(' + value('tag', CONTENT) + ')', TARGET)} FROM (SELECT url, unnest(regexp_extract_all(page, {q(META)}, 0)) AS tag FROM bodies)
  WHERE regexp_matches(tag, {q(REFRESH)})),
links AS (SELECT url, {link} AS link FROM tags),
edges AS (
  SELECT {node('url')} AS u, {node('far')} AS v FROM (SELECT url, CASE
      WHEN regexp_matches(link, '{SCHEME}') THEN CASE WHEN contains(link, '://') THEN link END
      WHEN starts_with(link, '//') THEN {first(base, '(?s)^(.*?:)//')} || link
      WHEN starts_with(link, '/') THEN {first(base, SITE)} || link
      WHEN starts_with(link, '?') THEN {first(base, SITE)} || {first(base, PATH)} || link
      WHEN starts_with(link, '#') THEN {base}
      ELSE {first(base, SITE)} || CASE WHEN {folder} = '' THEN '/' ELSE {folder} END || link
    END AS far FROM links WHERE link <> '')),
pairs AS (SELECT u, v FROM edges WHERE u <> v UNION SELECT v, u FROM edges WHERE u <> v),
reach(node, other) AS (SELECT u, u FROM pairs UNION SELECT reach.node, pairs.v FROM reach JOIN pairs ON reach.other = pairs.u),
fit AS (
  SELECT node, other, (SELECT r.verdict FROM rules r
     WHERE (h = rhost OR ends_with(h, '.' || rhost)) AND starts_with(p, rpath) ORDER BY length(rhost || rpath) DESC LIMIT 1) AS verdict
  FROM (SELECT node, other, {host('other')} AS h, {path('other')} AS p FROM reach)),
passed AS (SELECT node, CASE WHEN bool_or(verdict = 'allow') THEN 'allow' WHEN bool_or(verdict = 'block') THEN 'block' ELSE 'allow' END AS verdict FROM fit GROUP BY node),
judged AS (SELECT page_id, {host('url')} AS host, {path('url')} AS path, {node('url')} AS node FROM pages),
best AS (
  SELECT j.*, (SELECT {{'rule': rhost || rpath, 'verdict': r.verdict}} FROM rules r
     WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) ORDER BY length(rhost || rpath) DESC LIMIT 1) AS hit
  FROM judged j)
SELECT page_id, host, path, hit.rule AS rule, coalesce(hit.verdict, passed.verdict, 'allow') AS verdict
FROM best LEFT JOIN passed USING (node)
"""


SQL = _sql()
