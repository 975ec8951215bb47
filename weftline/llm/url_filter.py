"""Operator 6: allow and block rules for URLs, with redirect equivalence, in DataFrame functions only.

A rule is a host and a path. It fits its host and all subdomains where the URL's path starts with the rule's; the longest
fitting rule decides. URLs without a rule follow their aliases: URLs with the same key (scheme, fragment, `www.`, tracking
parameters and a last slash aside), and all that canonical links, refreshes, moved sites and a table of redirects connect. One
blocked alias blocks all URLs of its component that have no rule. An explicit allow takes precedence for the URLs that have it and for those
with the same key; it frees no other alias.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import ascii_lower, components, prepared, table

#: The rules of the query.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]

#: The moved sites of the query. Where a site's URLs redirect to: with their path behind it, or all to one page. The first chain
#: has two hops, the others meet at a hub; some URLs of its sites have a rule that allows them.
MOVED = [
    ("spam-farm.example.net", "http://cheap-pills.example.net", "path"),
    ("cheap-pills.example.net", "http://cheap-pills.example.com/de", "path"),
    ("spam-farm.example.com", "http://cheap-pills.example.com", "path"),
    ("cheap-pills.example.com", "http://parked.example.com/de/all", "page"),
    ("spam-farm.example.org", "http://parked.example.com/de/all", "page"),
    ("cheap-pills.example.org", "http://parked.example.com/de/all", "page"),
]

#: So many rules are put into the plan as a constant; more are joined by host.
MOST_LITERAL = 100

_TRACKING = r"(?s)^(utm_[a-z]+|ref|gclid|fbclid)=.*$"
_CANONICAL = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
_HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
_REFRESH = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*\burl\s*=\s*["']?([^"'\s>]+)"""


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def alias_key(url: Column) -> Column:
    """What URLs of one page share: host without www., path without its last slash, query without tracking; null without ://."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    told = F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(_TRACKING))
    said = F.when(F.size(told) > 0, F.concat(F.lit("?"), F.array_join(told, "&"))).otherwise("")
    return F.when(F.contains(url, F.lit("://")), F.concat(F.regexp_replace(url_host(url), r"^www\.", ""), F.regexp_replace(url_path(url), r"/\z", ""), said))


def _unescaped(c: Column) -> Column:
    """Ampersands and quotes of HTML as signs; &amp; last, so that nothing is decoded twice."""
    for name, sign in ((r"(?i)&(quot|#34|#x22);", '"'), (r"(?i)&(apos|#0*39|#x0*27);", "'"), (r"(?i)&(#0*47|#x0*2f|sol);", "/"), (r"(?i)&(amp|#0*38|#x0*26);", "&")):
        c = F.regexp_replace(c, name, sign)
    return c


def _resolved(source: Column, to: Column) -> Column:
    """The URL that a target names on a page: absolute, from the scheme, the root, the page's folder, or its query alone."""
    root = F.regexp_extract(source, r"(?s)^(.*?://[^/?#]*)", 1)
    scheme = F.regexp_extract(source, r"(?s)^(.*?:)//", 1)
    path = url_path(source)
    folder = F.regexp_extract(F.when(path == "", "/").otherwise(path), r"(?s)^(.*/)", 1)
    tail = F.regexp_extract(to, r"(?s)^[^?#]*(.*)$", 1)
    names = F.regexp_extract(to, r"(?s)^([^?#]*)", 1)
    whole = F.when(names.startswith("/"), names).otherwise(F.concat(folder, names))
    steps = F.split(F.substring(whole, 2, 1 << 30), "/")
    last = F.element_at(steps, -1)
    ends_open = last.isin(".", "..")

    def walk(acc: Column, x: Column) -> Column:
        up = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(x == "..", up).when(x == ".", acc).otherwise(F.concat(acc, F.array(x)))

    kept = F.aggregate(steps, F.array().cast("array<string>"), walk)
    clean = F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(ends_open & (F.size(kept) > 0), "/").otherwise(""))
    query = F.regexp_extract(source, r"(?s)^[^?#]*(\?[^#]*)?", 1)
    return (
        F.when(to.rlike(r"(?s)^[^/?#]*://") | to.contains("://") & to.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), to)
        .when(to.startswith("//"), F.concat(F.when(scheme == "", "http:").otherwise(scheme), to))
        .when((root == "") | (to == "") | to.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(to.startswith("#"), F.concat(root, path, query, to))
        .when(to.startswith("?"), F.concat(root, path, to))
        .otherwise(F.concat(root, clean, tail))
    )


_LINKS = "array<struct<source:string,target:string>>"


def html_links(url: Column, html: Column) -> Column:
    """(source, target) URLs of all canonical links and refreshes, relative ones from the page's URL; other schemes without :// are left."""
    canonical = F.transform(F.regexp_extract_all(html, F.lit(_CANONICAL), F.lit(0)), lambda tag: F.regexp_extract(tag, _HREF, 1))
    named = F.concat(canonical, F.regexp_extract_all(html, F.lit(_REFRESH), F.lit(1)))
    found = F.transform(named, lambda to: F.struct(url.alias("source"), _resolved(url, _unescaped(to)).alias("target")))
    return F.when(html.rlike("(?i)canonical|refresh"), F.filter(found, lambda x: x["target"].isNotNull())).cast(_LINKS)


def moved_links(host: Column, path: Column, url: Column, moved: list[tuple[str, str, str]]) -> Column:
    """(source, target) URLs of the redirects that a URL of a moved site, or of a subdomain, passes until its site is none.

    moved has the site, the URL that its URLs redirect to, and whether their path is kept behind it ("path") or not ("page"). A site
    that comes again ends the chain.
    """
    sites = {site: (to, keeps) for site, to, keeps in moved}
    chosen = F
    for site in sorted(sites, key=lambda x: (-len(x), x)):
        hops, at, within, seen = [url], site, path, set()
        while at in sites and at not in seen:
            seen.add(at)
            to, keeps = sites[at]
            within = F.concat(F.lit("/" + "/".join(to.split("/")[3:]) if to.count("/") > 2 else ""), within if keeps == "path" else F.lit(""))
            at = to.split("/")[2]
            hops.append(F.concat(F.lit("http://" + at), within))
        edges = F.array(*(F.struct(a.alias("source"), b.alias("target")) for a, b in zip(hops, hops[1:], strict=False)))
        chosen = chosen.when((host == site) | host.endswith("." + site), edges)
    return F.lit(None).cast(_LINKS) if chosen is F else chosen.cast(_LINKS)


def _known(rules: DataFrame) -> DataFrame:
    return rules.select(ascii_lower(F.col("host")).alias("rule_host"), F.concat(ascii_lower(F.col("host")), "path").alias("rule"), "path", "action").distinct().where("rule is not null")


def _ruled(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds rule and action, by host and path; both null where no rule fits."""
    few = _known(rules).limit(MOST_LITERAL + 1).collect()
    return _ruled_by_constant(urls, few) if len(few) <= MOST_LITERAL else _ruled_by_join(urls, rules)


def _ruled_by_constant(urls: DataFrame, rules: list) -> DataFrame:
    """Without a shuffle: the first rule that fits, the longest ones first, of two equally long the allowing one."""
    cases = F
    for r in sorted(rules, key=lambda r: (-len(r.rule), r.action, r.rule, r.path)):
        fits = ((F.col("host") == r.rule_host) | F.col("host").endswith("." + r.rule_host)) & F.col("path").startswith(r.path)
        cases = cases.when(fits, F.struct(F.lit(r.rule).alias("rule"), F.lit(r.action).alias("action")))
    best = F.lit(None).cast("struct<rule:string,action:string>") if cases is F else cases
    return urls.withColumn("best", best).withColumns({"rule": F.col("best.rule"), "action": F.col("best.action")}).drop("best")


def _ruled_by_join(urls: DataFrame, rules: DataFrame) -> DataFrame:
    hosts = urls.select("host").distinct()
    labels = F.split("host", r"\.")
    ends = hosts.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("rule_host"))
    # longest first; of two equally long the allowing one
    fitting = ends.join(_known(rules), "rule_host").groupBy("host").agg(
        F.array_sort(F.collect_list(F.struct((-F.char_length("rule")).alias("order"), "action", "rule", "path"))).alias("rules")
    )
    joined = urls.join(fitting, "host", "left")
    best = F.get(F.filter("rules", lambda r: F.col("path").startswith(r["path"])), 0)
    return joined.withColumn("best", best).withColumns({"rule": F.col("best.rule"), "action": F.col("best.action")}).drop("best", "rules")


def url_verdicts(
    pages: DataFrame,
    rules: DataFrame,
    redirects: DataFrame | None = None,
    moved: list[tuple[str, str, str]] = (),
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """(id, host, path, rule, verdict, alias) of every row; rules has action, host and path, redirects source and target URLs, moved
    what moved_links says.

    alias tells where the verdict comes from: rule, key (a URL with the same key is allowed by a rule), component (an alias is blocked) or
    default (allow). A null URL, and one without ://, has an empty host and path, fits no rule and is allowed. Rows may repeat; of an empty
    table comes an empty result. A very long html is searched in one pass, a null one has no links. Rule hosts are taken A-Z lower-cased. The result does not
    depend on the rows' order. Other columns are not read. Pages are read once; what later steps need of them is checkpointed.
    """
    prepared(pages.sparkSession)
    url = F.col("url")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    rows = rows.withColumns({"host": url_host(url), "path": url_path(url), "key": alias_key(url)})
    none = F.array().cast(_LINKS)
    links = F.concat(F.coalesce(html_links(url, F.col("html")), none), F.coalesce(moved_links(F.col("host"), F.col("path"), url, moved), none))
    judged = _ruled(rows.select("id", "host", "path", "key", links.alias("links")), rules).checkpoint()

    edges = judged.where(F.size("links") > 0).select(F.inline("links"))
    if redirects is not None:
        edges = edges.union(redirects.select(F.col("source").cast("string"), F.col("target").cast("string")))
    keyed = edges.distinct().select(alias_key(F.col("source")).alias("u"), alias_key(F.col("target")).alias("v"), "source", "target").where("u is not null and v is not null").checkpoint()
    groups = components(keyed.select("u", "v")).withColumnRenamed("node", "key")
    ends = keyed.select(F.explode(F.array("source", "target")).alias("end")).distinct()
    ends = _ruled(ends.select(url_host(F.col("end")).alias("host"), url_path(F.col("end")).alias("path"), alias_key(F.col("end")).alias("key")), rules)

    # what the rules say of each key, then of each component
    said = judged.where("action is not null and key is not null").select("key", "action").union(ends.where("action is not null").select("key", "action"))
    by_key = said.groupBy("key").agg(F.max(F.col("action") == "allow").alias("allowed"), F.max(F.col("action") == "block").alias("blocked"))
    named = by_key.join(groups, "key", "full").withColumn("component", F.coalesce("component", "key"))
    by_component = named.groupBy("component").agg(F.max("blocked").alias("blocked"))
    verdicts = named.select("key", "component", "allowed").join(by_component, "component").select("key", "allowed", "blocked").where("allowed or blocked")

    # only pages without a rule ask for their key and component
    ruled = judged.where("action is not null").select("id", "host", "path", "rule", F.col("action").alias("verdict"), F.lit("rule").alias("alias"))
    rest = judged.where("action is null").join(verdicts, "key", "left")
    allowed, blocked = F.coalesce("allowed", F.lit(False)), F.coalesce("blocked", F.lit(False))
    verdict = F.when(blocked & ~allowed, "block").otherwise("allow")
    alias = F.when(allowed, "key").when(blocked, "component").otherwise("default")
    return ruled.union(rest.select("id", "host", "path", "rule", verdict.alias("verdict"), alias.alias("alias"))).withColumnRenamed("id", id_col)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """url_verdicts of all pages by RULES, with the redirects of MOVED sites besides the pages' own links."""
    rules = spark.createDataFrame(RULES, "action string, host string, path string")
    return url_verdicts(table(spark, sf_dir, "pages"), rules, moved=MOVED)


QUERIES = {"op6_url_filter": op6_url_filter}

# The oracle takes URLs apart by position, not by pattern. Relative targets are left to tests: pages of the tables have none.
_URL = """
  select *, hostname as host, split_part(split_part(tail, '#', 1), '?', 1) as path,
    case when pos > 0 then (case when starts_with(hostname, 'www.') then substr(hostname, 5) else hostname end)
      || (case when ends_with(split_part(split_part(tail, '#', 1), '?', 1), '/') then left(split_part(split_part(tail, '#', 1), '?', 1), -1) else split_part(split_part(tail, '#', 1), '?', 1) end)
      || coalesce('?' || nullif(array_to_string(list_filter(string_split(substr(split_part(tail, '#', 1), length(split_part(split_part(tail, '#', 1), '?', 1)) + 2), '&'),
        lambda x: x <> '' and not (contains(x, '=') and (split_part(x, '=', 1) in ('ref', 'gclid', 'fbclid') or regexp_full_match(split_part(x, '=', 1), 'utm_[a-z]+')))), '&'), ''), '') end as key
  from (select *, substr(after, length(first) + 1) as tail, translate(first, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as hostname
    from (select *, left(after, least(coalesce(nullif(strpos(after, '/'), 0), 999999999), coalesce(nullif(strpos(after, '?'), 0), 999999999), coalesce(nullif(strpos(after, '#'), 0), 999999999)) - 1) as first
      from (select *, coalesce(strpos(url, '://'), 0) as pos, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as after from {urls})))"""

ORACLE_SQL = {
    "op6_url_filter": rf"""
with recursive rules(action, rhost, rpath) as (values {", ".join(map(str, RULES))}),
moved(site, base, kept) as (values {", ".join(map(str, MOVED))}),
p as ({_URL.format(urls="pages")}),
hops(source, target, n) as (
  select p.url, base || case when kept = 'path' then p.path else '' end, 1 from p join moved on p.host = site or ends_with(p.host, '.' || site)
  union select target, base || case when kept = 'path' then substr(target, length('http://' || site) + 1) else '' end, n + 1
    from hops join moved on split_part(target, '/', 3) = site where n < {len(MOVED)}),
tags as (select url as source, unnest(list_concat(
    list_transform(regexp_extract_all(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), lambda t: regexp_extract(t, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)),
    regexp_extract_all(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*\burl\s*=\s*["'']?([^"''\s>]+)', 1))) as link from pages),
links as (select source, target from hops union select source, link from tags where contains(link, '://')),
ends as ({_URL.format(urls="(select source as url from links union select target from links)")}),
edges as (select a.key as u, b.key as v from links join ends a on a.url = source join ends b on b.url = target),
sides as (select u, v from edges union select v, u from edges),
reach(k, m) as (select u, u from sides union select reach.k, sides.v from reach join sides on reach.m = sides.u),
urls as (select host, path, key from p union select host, path, key from ends),
ruled as (
  select host, path, key, rhost || rpath as rule, action,
    row_number() over (partition by host, path, key order by length(rhost || rpath) desc, action) as nth
  from urls join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)),
best as (select * from ruled where nth = 1),
linked as (select k, m from reach union select key, key from urls where key is not null),
said as (select k, max(action = 'allow' and best.key = k) as allowed, max(action = 'block') as blocked from linked join best on best.key = m group by k)
select page_id, p.host, p.path, best.rule,
  coalesce(best.action, case when blocked and not allowed then 'block' else 'allow' end) as verdict,
  case when best.action is not null then 'rule' when allowed then 'key' when blocked then 'component' else 'default' end as alias
from p left join best on p.host = best.host and p.path = best.path and p.key is not distinct from best.key left join said on said.k = p.key
"""
}
