"""URL rules with redirect equivalence, in DataFrame functions only.

A rule (verdict, host, path) fits its host and all subdomains where the url's path starts with the rule's; the longest rule
wins. A page that no rule fits takes the verdict of its aliases: pages whose urls differ in spelling only, and pages joined by
redirects and canonical links, form components; if a rule blocks a page of the component, the pages without a rule of
their own are blocked, unless one that is explicitly allowed has the same canonical spelling. Pages with a rule keep it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.components import components
from tidewater.llm.store import cut, table, tidy

UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\burl\s*=\s*["']?([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, SMALL)).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def _rest(url: Column) -> Column:
    return F.substring(url, F.instr(url, "://") + F.lit(3), F.greatest(F.length(url), F.lit(1)))


def resolved(link: Column, host: Column, path: Column) -> Column:
    """The url that a page's link leads to; null where that is the page itself or no page. What has "://" is taken as whole."""
    at = F.regexp_extract(link, r"^([^?#]*)", 1)
    full = F.when(at.startswith("/"), at).otherwise(F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(path, r"[^/]*$", ""), r"^/", ""), at))
    up = lambda done, x: F.when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))).when(x == ".", done).otherwise(F.concat(done, F.array(x)))
    plain = F.array_join(F.aggregate(F.split(full, "/"), F.array().cast("array<string>"), up), "/")
    whole = F.when(F.instr(link, "://") > 0, link).when(link.startswith("//"), F.concat(F.lit("http:"), link))
    return whole.when((at != "") & ~link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), F.concat(F.lit("http://"), host, plain))


def spelling(host: Column, path: Column) -> Column:
    """One spelling for urls that differ in scheme, default port, query, fragment, final slash, .html or index page only."""
    plain = F.regexp_replace(F.regexp_replace(path, r"(?i)/index\.html?$", "/"), r"(?i)(\.html?|/+)$", "")
    return F.concat(F.regexp_replace(host, r":(80|443)$", ""), plain)


def fitting(host: Column, path: Column, rules: list[tuple[str, str, str]], what: int) -> Column:
    """The longest fitting rule's name (what = 1) or verdict (0), else null. Of equally long ones the first in order of name."""
    out = F.lit(None).cast("string")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2]), reverse=False):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.lit((verdict, h + p)[what])).otherwise(out)
    return out


@tidy
def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, links: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page.

    links: (source, target) urls known to redirect, beside the refresh and canonical links in `html`, if pages has that column,
    relative ones too (a base element is not looked at). A null url has empty host and path, no rule, and is allowed, as is any page that nothing blocks.
    Repeated rows are judged each; other columns are ignored; an empty table gives no rows.
    """
    has = "html" in pages.columns
    p = pages.select(F.col("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), (F.col("html") if has else F.lit(None)).cast("string").alias("html"))
    urls = [F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(x), F.lit(1)) for x in (CANONICAL, REFRESH)]
    node = lambda c: F.xxhash64(spelling(host_of(c), path_of(c)))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    p = p.select("page_id", host.alias("host"), path.alias("path"), F.concat(*urls).alias("to"))
    p = p.select("page_id", "host", "path", F.filter(F.transform("to", lambda x: resolved(x, F.col("host"), F.col("path"))), lambda x: x.isNotNull()).alias("to"))
    p = p.withColumn("rule", fitting(F.col("host"), F.col("path"), rules, 1)).withColumn("own", fitting(F.col("host"), F.col("path"), rules, 0))
    p = cut(p.withColumn("node", F.when(F.col("host") != "", F.xxhash64(spelling(F.col("host"), F.col("path"))))), "pages")
    edges = p.where("node is not null").select(F.col("node").alias("u"), F.explode("to").alias("x")).select("u", node(F.col("x")).alias("v"))
    if links is not None:
        edges = edges.unionByName(links.where("instr(source, '://') > 0 and instr(target, '://') > 0").select(node(F.col("source")).alias("u"), node(F.col("target")).alias("v")))
    comp = components(edges)
    said = p.where("own is not null and node is not null").groupBy("node").agg(F.max((F.col("own") == "block").cast("int")).alias("blocks"), F.max((F.col("own") == "allow").cast("int")).alias("allows"))
    at = said.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    blocked = at.groupBy("comp").agg(F.max("blocks").alias("blocks")).where("blocks = 1").select("comp")
    open_ = p.where("own is null and node is not null").select("node").distinct().join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    spread = open_.join(blocked, "comp", "left_semi").join(said.where("allows = 1").select("node"), "node", "left_anti").select("node", F.lit(True).alias("spread"))
    out = p.join(spread, "node", "left")
    verdict = F.when(F.col("own").isNotNull(), F.col("own")).when(F.col("spread"), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def op6_url_filter(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages"))


OP6_SQL = r"""
with recursive p as (
  select page_id, html, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
q as (select page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from p),
rules(verdict, h, p) as (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
own as (select page_id, max_by(h || r.p, length(h || r.p)) as rule, max_by(verdict, length(h || r.p)) as own
        from q join rules r on (host = h or ends_with(host, '.' || h)) and starts_with(path, r.p) group by page_id),
s as (select q.page_id, host, path, html, rule, own,
             regexp_replace(host, ':(80|443)$', '') || regexp_replace(regexp_replace(path, '(?i)/index\.html?$', '/'), '(?i)(\.html?|/+)$', '') as node
      from q left join own using (page_id)),
l as (select node as u, unnest([regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*\bhref\s*=\s*["'']?([^"''\s>]+)', 1),
                                regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*\burl\s*=\s*["'']?([^"''\s>]+)', 1)]) as x from s where host <> ''),
e as (select distinct u, regexp_replace(translate(regexp_extract(substr(x, strpos(x, '://') + 3), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ':(80|443)$', '')
               || regexp_replace(regexp_replace(regexp_extract(substr(x, strpos(x, '://') + 3), '^[^/?#]*([^?#]*)', 1), '(?i)/index\.html?$', '/'), '(?i)(\.html?|/+)$', '') as v
      from l where contains(x, '://')),
sides as (select u, v from e union select v, u from e),
reach(a, b) as (select distinct node, node from s where own = 'block' union select reach.a, sides.v from reach join sides on reach.b = sides.u),
blocked as (select distinct b as node from reach),
allowed as (select distinct node from s where own = 'allow')
select page_id, host, path, rule,
       coalesce(own, case when host <> '' and node in (select node from blocked) and node not in (select node from allowed) then 'block' else 'allow' end) as verdict
from s
"""
