"""URL filters: host and path rules, and block decisions that follow redirects.

Rules name a host (and all its subdomains) and a path prefix; the longest rule that fits
decides.  Urls without a rule of their own take the decision of their aliases: canonical links
and refresh redirects found in pages are edges between urls, and distributed connected
components over them (star contraction, nothing on the driver) make classes of aliases.  In a
class an explicit allow comes before any block; without either the verdict is allow.

Two urls are one node if they differ only in scheme, fragment, a closing "/" or tracking
parameters; a link between two such urls makes them aliases as any link does, but without a link
that touches their node they are judged each by itself.  The decisions of link targets that are no
page themselves count too.

Targets may be absolute, start with "//", "/" or "?", or be relative to the page's folder; any
number of "." and ".." steps is folded, and steps above the root stay at the root.  "&amp;" in
targets is "&".

Defined results: a null url, or one without "://", has empty host and path, no rule and the
verdict allow; a null html has no links; links to a fragment or
another scheme ("mailto:") are ignored; repeated
rows are judged each on their own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm.common import ascii_lower, components, cut, table

ALLOW, BLOCK = "allow", "block"
RULES = (
    (ALLOW, "com", "/"),
    (BLOCK, "example.com", "/en/"),
    (ALLOW, "www.example.com", "/en/"),
    (BLOCK, "net", "/es/"),
    (BLOCK, "net", "/fr/"),
)
TRACKING = r"(?:utm_[a-z]+|ref|fbclid|gclid)=[^&]*&?"
CANONICAL = r"(?is)<link\s[^>]*rel=[\"']?canonical[^>]*>"
REFRESH = r"(?is)<meta\s[^>]*http-equiv=[\"']?refresh[^>]*>"
HREF = r"(?is)href=[\"']?([^\"'\s>]+)"
TARGET = r"(?is)url\s*=\s*[\"']?([^\"'\s>;]+)"
#: Another scheme than host urls have, as "mailto:".
OTHER_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"
#: The page's own folder, and the page without query and fragment.
FOLDER, PAGE = r"^[^/?#]*(?:[^?#]*/)?", r"^[^?#]*"
#: Host and path, before query and fragment.
HEAD = r"^[^?#]*"


def after_scheme(url: Column) -> Column:
    """What follows the first "://", null without it."""
    return F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))


def host_of(rest: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit("")))


def path_of(rest: Column) -> Column:
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(rest: Column) -> Column:
    """The node of a url, from what follows its scheme; null where there is no host."""
    query = F.regexp_replace(F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1), TRACKING, "")
    query = F.rtrim(query, F.lit("&"))
    host = host_of(rest)
    return F.when(host != "", F.concat(host, F.rtrim(path_of(rest), F.lit("/")), F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def ranked(rules) -> list[tuple[str, str, str]]:
    return sorted(rules, key=lambda r: -len(r[1] + r[2]))


def rule_of(host: Column, path: Column, rules) -> Column:
    """struct<rule, verdict> of the longest rule that fits, null without one."""
    found = None
    for verdict, name, prefix in ranked(rules):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        told = F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, told) if found is None else found.when(fits, told)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def link_targets(html: Column) -> Column:
    """Targets of canonical links and refresh redirects; the patterns only run where a word of
    theirs occurs."""
    low = F.lower(html)
    canonical = F.when(low.contains("canonical"), F.transform(F.regexp_extract_all(html, F.lit(f"({CANONICAL})"), 1), lambda x: F.regexp_extract(x, HREF, 1)))
    refresh = F.when(low.contains("refresh"), F.transform(F.regexp_extract_all(html, F.lit(f"({REFRESH})"), 1), lambda x: F.regexp_extract(x, TARGET, 1)))
    none = F.array().cast("array<string>")
    return F.concat(F.coalesce(canonical, none), F.coalesce(refresh, none))


def target_rest(target: Column, rest: Column) -> Column:
    """What would follow a target's scheme, seen from the page: absolute, //host, /path, ?query, or
    relative to the page's folder; null for a mere fragment or another scheme."""
    target = F.replace(target, F.lit("&amp;"), F.lit("&"))
    own, folder = F.regexp_extract(rest, r"^[^/?#]*", 0), F.regexp_extract(rest, FOLDER, 0)
    found = (
        F.when(F.instr(target, "://") > 0, after_scheme(target))
        .when(target.startswith("//"), F.substr(target, F.lit(3)))
        .when(target.startswith("/"), F.concat(own, target))
        .when(target.startswith("?"), F.concat(F.regexp_extract(rest, PAGE, 0), target))
        .when(target.startswith("#") | (target == "") | target.rlike(OTHER_SCHEME), F.lit(None))
        .otherwise(F.concat(folder, F.when(folder.endswith("/"), "").otherwise("/"), target))
    )
    return F.when(found.contains("/."), folded(found)).otherwise(found)


def folded(rest: Column) -> Column:
    """``rest`` without "." and ".." steps in its path."""
    head = F.regexp_extract(rest, HEAD, 0)
    parts = F.split(head, "/")
    step = lambda kept, part: F.when(part == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).when(part == ".", kept).otherwise(F.concat(kept, F.array(part)))
    kept = F.aggregate(F.slice(parts, 2, F.size(parts)), F.array().cast("array<string>"), step)
    # a path that ends in a step is a folder
    last = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.concat(F.array_join(F.concat(F.slice(parts, 1, 1), last), "/"), F.substr(rest, F.length(head) + 1))


def edges(pages: DataFrame) -> DataFrame:
    """(src, dst, dst_rest) of the alias edges of ``pages(url, html)``."""
    rest = after_scheme(F.col("url"))
    linked = pages.select(rest.alias("rest"), link_targets(F.col("html")).alias("targets")).where(F.size("targets") > 0)
    each = linked.select("rest", F.explode("targets").alias("target"))
    each = each.select(key_of(F.col("rest")).alias("src"), target_rest(F.col("target"), F.col("rest")).alias("dst_rest"))
    return each.select("src", key_of(F.col("dst_rest")).alias("dst"), "dst_rest").where("src is not null and dst is not null").distinct()


def url_filter(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) per row of ``pages(page_id, url, html, ...)``."""
    rest = after_scheme(F.col("url"))
    judged = pages.select("page_id", rest.alias("rest")).select("page_id", "rest", host_of(F.col("rest")).alias("host"), path_of(F.col("rest")).alias("path"))
    judged = judged.withColumn("told", rule_of(F.col("host"), F.col("path"), rules))
    ruled = judged.where("told is not null").select("page_id", "host", "path", "told.rule", "told.verdict")
    free = judged.where("told is null").select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), key_of(F.col("rest")).alias("node"))
    links = cut(edges(pages.select("url", "html")), "aliases")
    if links.isEmpty():
        return ruled.unionByName(free.drop("node").withColumn("verdict", F.lit(ALLOW)))
    linked = components(links.select("src", "dst"))
    # a link between urls of one node makes a class of that node
    alone = links.where("src = dst").select(F.col("src").alias("node")).distinct().join(linked, "node", "left_anti")
    classes = linked.unionByName(alone.withColumn("component", F.col("node")))
    # explicit decisions of the nodes: of link targets, and of pages that have links or are targets
    of_rest = lambda rest: rule_of(host_of(rest), path_of(rest), rules)["verdict"]
    told = links.select(F.col("dst").alias("node"), of_rest(F.col("dst_rest")).alias("verdict"))
    told = told.unionByName(judged.where("told is not null").select(key_of(F.col("rest")).alias("node"), F.col("told.verdict").alias("verdict")))
    told = told.where("verdict is not null").distinct()
    decided = classes.join(told, "node").groupBy("component").agg(F.bool_or(F.col("verdict") == ALLOW).alias("allow"))
    blocked = classes.join(decided.where("not allow"), "component").select("node")
    named = free.where("node is not null").join(blocked.withColumn("hit", F.lit(True)), "node", "left")
    named = named.select("page_id", "host", "path", "rule", F.when(F.col("hit"), BLOCK).otherwise(ALLOW).alias("verdict"))
    nameless = free.where("node is null").drop("node").withColumn("verdict", F.lit(ALLOW))
    return ruled.unionByName(named).unionByName(nameless)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))


def _oracle() -> str:
    """The same verdicts in DuckDB: reachability by a recursive query."""
    q = lambda pattern: "'" + pattern.replace("'", "''") + "'"
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    host = f"coalesce({low.format('regexp_extract(rest, ' + q('^[^/?#]*') + ')')}, '')"
    path = "coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '')"
    query_part = rf"rtrim(regexp_replace(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), {q(TRACKING)}, '', 'g'), '&')"
    key = f"case when {host} <> '' then {host} || rtrim({path}, '/') || case when {query_part} <> '' then '?' || {query_part} else '' end end"
    fits = [(f"({host} = '{h}' or ends_with({host}, '.{h}')) and starts_with({path}, '{p}')", h + p, v) for v, h, p in ranked(RULES)]
    rule = "case " + " ".join(f"when {c} then '{name}'" for c, name, _ in fits) + " end"
    verdict = "case " + " ".join(f"when {c} then '{v}'" for c, _, v in fits) + " end"
    after = "case when strpos({0}, '://') > 0 then substr({0}, strpos({0}, '://') + 3) end"
    folder = f"regexp_extract(prest, {q(FOLDER)})"
    target = (
        f"case when strpos(g, '://') > 0 then {after.format('g')} when starts_with(g, '//') then substr(g, 3) when starts_with(g, '/') then regexp_extract(prest, '^[^/?#]*') || g"
        f" when starts_with(g, '?') then regexp_extract(prest, {q(PAGE)}) || g when starts_with(g, '#') or g = '' or regexp_matches(g, {q(OTHER_SCHEME)}) then null"
        f" else {folder} || case when ends_with({folder}, '/') then '' else '/' end || g end"
    )
    head, parts = f"regexp_extract(rest, {q(HEAD)})", f"string_split(regexp_extract(rest, {q(HEAD)}), '/')"
    kept = f"list_reduce(list_prepend([]::varchar[], list_transform({parts}[2:], lambda s: [s])), lambda k, s: case when s[1] = '..' then k[:len(k) - 1] when s[1] = '.' then k else list_concat(k, s) end)"
    folded = f"array_to_string(list_concat({parts}[1:1], {kept}, case when {parts}[-1] in ('.', '..') then [''] else [] end), '/') || substr(rest, length({head}) + 1)"
    folded = f"case when contains(rest, '/.') then {folded} else rest end"
    return f"""
with recursive p as (select page_id, html, {after.format("url")} as rest from pages),
k as (select *, {host} as host, {path} as path, {rule} as rule, {verdict} as told, {key} as node from p),
x as (select node as src, rest as prest, unnest(list_concat(
        [regexp_extract(e, {q(HREF)}, 1) for e in regexp_extract_all(html, {q(CANONICAL)})],
        [regexp_extract(e, {q(TARGET)}, 1) for e in regexp_extract_all(html, {q(REFRESH)})])) as g from k where html is not null),
y0 as (select src, {target} as rest from (select src, prest, replace(g, '&amp;', '&') as g from x)),
y as (select src, {folded} as rest from y0),
e as (select src, {key} as dst, {verdict} as told from y),
pair as (select src as a, dst as b from e where src is not null and dst is not null union select dst, src from e where src is not null and dst is not null),
reach(a, b) as (select a, a from pair union select r.a, s.b from reach r join pair s on s.a = r.b),
told as (select dst as node, told from e where told is not null union select node, told from k where told is not null and node is not null),
c as (select r.a as node, bool_or(t.told = 'allow') as ok from reach r join told t on t.node = r.b group by r.a)
select page_id, host, path, rule, coalesce(told, case when c.ok = false then 'block' else 'allow' end) as verdict from k left join c on c.node = k.node
"""


ORACLE_SQL = _oracle()
