"""URL filters: explicit rules first, then a path-template tree per host, in DataFrame operations alone.

Rules are ``host/path`` strings: a rule fits its host and all subdomains where
the url's path starts with the rule's path; the longest that fits wins.

The method judges the rest. Paths become templates level by level, ``depth``
levels and a tail. At each node of a host's tree

1. frequent segments (``support`` urls and ``share`` of the node's) are branches;
   all others, the variable ones, are one branch ``*``;
2. each branch has labelled evidence: its own labels, and up to ``alpha`` pseudo-labels
   at the rate of the same branch over all hosts, so that hosts without labels have some;
3. branches are put in order of their bad rate; a branch joins the group before it unless it differs
   significantly (two-proportion test, ``z``) from that group's first, so no group holds two that differ, however many
   lie between them. All without evidence merge. A merged branch is ``{a?b}``, or ``*`` if the variable one is among them.

A template is judged by its purity, its labelled bad rate smoothed by ``alpha``
pseudo-labels at an inherited rate. Hosts inherit from their domain (the last two names)
and this from all urls; templates inherit from the same template over all hosts; the two
are combined as independent evidence (their odds over the general odds multiply). So
templates that hold no label themselves are judged as well; they are blocked only if
the template has ``support`` labels over all hosts. Templates whose purity reaches ``purity``
are blocked. Labels may be given; without them the urls that rules judge are the labelled ones.

Scale: every aggregation has a map-side part and keys on (host, template,
segment), so a host with a third of all urls is counted in many tasks. Only
frequent, distinct segments, at most 1/share of a node, are put in order.
Joins back are left to the planner (by size) and AQE's skew splitting.

Edge cases: null urls or urls without ``://`` have empty host and path, and no
rule can fit them; they form the template of the empty host. Repeated urls count
as often as they occur; an empty table gives no rows. Rules of equal length: the one listed first.
A null label is none; several labels of a page: the worst. Without any label nothing
is blocked. Very long segments are segments like others. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import ascii_lower
from .store import written

DEPTH, SUPPORT, SHARE, Z, ALPHA, PURITY = 3, 8, 0.01, 1.96, 4.0, 0.9
#: Rates stay this far from 0 and 1 where their odds are taken.
EDGE = 1e-6

#: The rules of the contract.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty if there is no ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    whole = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(whole, pattern, 1)), F.regexp_extract(whole, pattern, 2)


def by_rules(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does. Equal lengths: the one listed first."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(reversed(rules), key=lambda x: len(x[0])):
        at, slash, rest = text.partition("/")
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _branches(children: DataFrame, support: int, share: float, z: float, alpha: float) -> DataFrame:
    """``(host, template, seg, branch)`` of the frequent segments; ``children``: ``(host, template, seg, n, lab, bads)``."""
    total = children.groupBy("host", "template").agg(F.sum("n").alias("pn"))
    # only segments with enough urls need their node's total, so what meets at a node is few; the variable ones are added up with map-side parts
    often = children.where((F.col("n") >= support) & ~F.col("seg").isin("", "*")).select("host", "template", "seg", "n").join(total, ["host", "template"])
    often = often.where(F.col("n") >= share * F.col("pn")).select("host", "template", "seg", F.lit(True).alias("often"))
    key = F.when(F.col("seg") == "", "").when(F.col("often"), F.col("seg")).otherwise("*")
    named = children.join(often, ["host", "template", "seg"], "left").withColumn("key", key)
    own = named.groupBy("host", "template", "key").agg(F.sum("lab").alias("lab"), F.sum("bads").alias("bads"))
    world = own.groupBy("template", "key").agg(F.sum("lab").alias("wlab"), F.sum("bads").alias("wbads"))
    pseudo = F.when(F.col("wlab") > 0, F.least(F.lit(alpha), F.col("wlab").cast("double"))).otherwise(0.0)
    both = own.where("key <> ''").join(world, ["template", "key"]).withColumn("pseudo", pseudo)
    both = both.select("host", "template", "key", (F.col("lab") + F.col("pseudo")).alias("k"), (F.col("bads") + F.coalesce(F.try_divide(F.col("pseudo") * F.col("wbads"), "wlab"), F.lit(0.0))).alias("b"))
    both = both.withColumn("rate", F.try_divide("b", "k"))
    # at most 1/share branches and the variable one, by their rates
    members = F.array_sort(F.collect_list(F.struct(F.col("rate").isNull().alias("none"), "rate", "key", "k", "b")))
    none = F.lit(None).cast("double")
    begin = F.struct(F.lit(0).alias("part"), none.alias("rate"), none.alias("k"), none.alias("b"), F.lit(True).alias("none"), F.array().cast("array<struct<part:int,key:string,none:boolean>>").alias("out"))

    def placed(state: Column, x: Column) -> Column:
        """A branch joins the group unless it differs from the group's first, its lowest rate; evidence beside none differs too."""
        pooled, gap = F.try_divide(x["b"] + state["b"], x["k"] + state["k"]), x["rate"] - state["rate"]
        differs = gap * gap > z * z * pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), x["k"]) + F.try_divide(F.lit(1.0), state["k"]))
        new = (state["part"] == 0) | (x["none"] & ~state["none"]) | F.coalesce(differs, F.lit(False))
        part = state["part"] + F.when(new, 1).otherwise(0)
        first = [F.when(new, x[c]).otherwise(state[c]).alias(c) for c in ("rate", "k", "b", "none")]
        return F.struct(part.alias("part"), *first, F.concat(state["out"], F.array(F.struct(part.alias("part"), x["key"].alias("key"), x["none"].alias("none")))).alias("out"))

    groups = both.groupBy("host", "template").agg(members.alias("m")).select("host", "template", F.inline(F.aggregate("m", begin, placed, lambda state: state["out"])))
    of = groups.groupBy("host", "template", "part").agg(F.array_sort(F.collect_list("key")).alias("keys"), F.max("none").alias("unknown"))
    # a segment holds no question mark, so no other template has this name
    name = F.when(F.array_contains("keys", "*") | F.col("unknown"), "*").when(F.size("keys") == 1, F.get("keys", F.lit(0))).otherwise(F.concat(F.lit("{"), F.array_join("keys", "?"), F.lit("}")))
    return of.select("host", "template", F.explode("keys").alias("seg"), name.alias("branch")).where("seg <> '*'")


def with_templates(urls: DataFrame, depth: int = DEPTH, support: int = SUPPORT, share: float = SHARE, z: float = Z, alpha: float = ALPHA) -> DataFrame:
    """Adds ``template`` to rows with host, path and bad (1, 0 or null)."""
    segments = F.filter(F.split("path", "/"), lambda x: x != "")
    rows = urls.withColumn("segments", segments).withColumn("template", F.lit(""))
    counts = [F.count("*").alias("n"), F.count("bad").alias("lab"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bads")]
    for level in range(depth):
        rows = rows.withColumn("seg", F.coalesce(F.get("segments", F.lit(level)), F.lit("")))
        children = rows.groupBy("host", "template", "seg").agg(*counts)
        # written, else each level's plan would hold all plans above it, many times over
        branches = written(_branches(children, support, share, z, alpha), "branches")
        rows = rows.join(branches, ["host", "template", "seg"], "left")
        step = F.when(F.col("seg") == "", "").otherwise(F.concat(F.lit("/"), F.coalesce("branch", F.lit("*"))))
        rows = rows.withColumn("template", F.concat("template", step)).drop("branch", "seg")
    tail = F.when(F.size("segments") > depth, "/**").otherwise("")
    return rows.withColumn("template", F.concat("template", tail)).drop("segments")


def _odds(rate: Column) -> Column:
    r = F.least(F.greatest(rate, F.lit(EDGE)), F.lit(1 - EDGE))
    return r / (1 - r)


def blocked_templates(rows: DataFrame, support: int = SUPPORT, alpha: float = ALPHA, purity: float = PURITY) -> DataFrame:
    """``(host, template)`` of the templates whose smoothed purity reaches ``purity``."""
    t = written(rows.groupBy("host", "template").agg(F.count("bad").alias("lab"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bads")), "templates")
    t = t.withColumn("domain", F.substring_index("host", ".", -2))
    sums = lambda key, lab, bads: t.groupBy(key).agg(F.sum("lab").alias(lab), F.sum("bads").alias(bads))
    world = t.agg(F.sum("lab").alias("wlab"), F.sum("bads").alias("wbads")).where("wlab > 0").select((F.col("wbads") / F.col("wlab")).alias("general"))  # at most one row
    both = t.join(sums("host", "hlab", "hbads"), "host").join(sums("domain", "dlab", "dbads"), "domain").join(sums("template", "tlab", "tbads"), "template").join(F.broadcast(world))
    general = F.col("general")
    domain = (F.col("dbads") + alpha * general) / (F.col("dlab") + alpha)
    host = (F.col("hbads") + alpha * domain) / (F.col("hlab") + alpha)
    same = (F.col("tbads") + alpha * general) / (F.col("tlab") + alpha)
    odds = _odds(host) * _odds(same) / _odds(general)
    rate = (F.col("bads") + alpha * (odds / (1 + odds))) / (F.col("lab") + alpha)
    return both.where((rate >= purity) & ((F.col("lab") > 0) | (F.col("tlab") >= support))).select("host", "template")


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], labels: DataFrame | None = None) -> DataFrame:
    """``(page_id, host, path, rule, verdict, template)`` for each row of ``(page_id, url)``; labels: ``(page_id, bad)``."""
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, said = by_rules(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), said.alias("said"))
    if labels is None:
        rows = rows.withColumn("bad", F.when(F.col("said") == "block", 1).when(F.col("said") == "allow", 0))
    else:
        rows = rows.join(labels.groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("bad")), "page_id", "left")
    rows = with_templates(rows)
    bad = blocked_templates(rows).withColumn("blocked", F.lit(True))
    rows = rows.join(bad, ["host", "template"], "left")
    method = F.when(F.col("blocked"), "block").otherwise("allow")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("said", method).alias("verdict"), "template")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), RULES)


def _sql() -> str:
    case = lambda of: "CASE " + " ".join(f"WHEN (host = '{r.partition('/')[0]}' OR host LIKE '%.{r.partition('/')[0]}') AND starts_with(path, '/{r.partition('/')[2]}') THEN '{of(r, v)}'" for r, v in sorted(RULES, key=lambda x: -len(x[0]))) + " END"
    odds = lambda r: f"(least(greatest({r}, {EDGE}), {1 - EDGE}) / (1 - least(greatest({r}, {EDGE}), {1 - EDGE})))"
    # whether a branch begins a new group: it differs from the first of the one before
    new = f"(s.part = 0 OR (x.rate IS NULL AND s.rate IS NOT NULL) OR coalesce((x.rate - s.rate) * (x.rate - s.rate) > {Z * Z} * ((x.b + s.b) / (x.k + s.k)) * (1 - (x.b + s.b) / (x.k + s.k)) * (1 / x.k + 1 / s.k), false))"
    levels = ""
    for k in range(DEPTH):
        levels += f""",
s{k} AS (SELECT *, coalesce(segments[{k + 1}], '') AS seg FROM r{k}),
c{k} AS (SELECT *, sum(n) OVER (PARTITION BY host, template) AS pn FROM (SELECT host, template, seg, count(*) AS n, count(bad) AS lab, coalesce(sum(bad), 0) AS bads FROM s{k} GROUP BY ALL)),
o{k} AS (SELECT host, template, CASE WHEN seg = '' THEN '' WHEN seg <> '*' AND n >= {SUPPORT} AND n >= {SHARE} * pn THEN seg ELSE '*' END AS key, sum(lab) AS lab, sum(bads) AS bads FROM c{k} GROUP BY ALL),
w{k} AS (SELECT template, key, sum(lab) AS wlab, sum(bads) AS wbads FROM o{k} GROUP BY ALL),
e{k} AS (SELECT host, template, key, lab + pseudo AS k, bads + CASE WHEN wlab > 0 THEN pseudo * wbads / wlab ELSE 0 END AS b
  FROM (SELECT *, CASE WHEN wlab > 0 THEN least({ALPHA}::DOUBLE, wlab::DOUBLE) ELSE 0::DOUBLE END AS pseudo FROM o{k} JOIN w{k} USING (template, key) WHERE key <> '')),
f{k} AS (SELECT *, CASE WHEN k > 0 THEN b / k END AS rate FROM e{k}),
g{k} AS (SELECT host, template, list({{'key': key, 'k': k, 'b': b, 'rate': rate, 'part': 0, 'out': []::STRUCT(key VARCHAR, part INTEGER, nothing BOOLEAN)[]}} ORDER BY rate ASC NULLS LAST, key) AS m FROM f{k} GROUP BY host, template),
h{k} AS (SELECT host, template, unnest(list_reduce(m, lambda s, x: {{'key': '', 'k': CASE WHEN {new} THEN x.k ELSE s.k END, 'b': CASE WHEN {new} THEN x.b ELSE s.b END, 'rate': CASE WHEN {new} THEN x.rate ELSE s.rate END, 'part': s.part + CASE WHEN {new} THEN 1 ELSE 0 END,
  'out': list_append(s.out, {{'key': x.key, 'part': s.part + CASE WHEN {new} THEN 1 ELSE 0 END, 'nothing': x.rate IS NULL}})}}, {{'key': '', 'k': 0::DOUBLE, 'b': 0::DOUBLE, 'rate': NULL::DOUBLE, 'part': 0, 'out': []::STRUCT(key VARCHAR, part INTEGER, nothing BOOLEAN)[]}}).out) AS o FROM g{k}),
n{k} AS (SELECT host, template, list(o.key ORDER BY o.key) AS keys, bool_or(o.nothing) AS nothing FROM h{k} GROUP BY host, template, o.part),
l{k} AS (SELECT host, template, unnest(keys) AS seg, CASE WHEN list_contains(keys, '*') OR nothing THEN '*' WHEN len(keys) = 1 THEN keys[1] ELSE '{{' || array_to_string(keys, '?') || '}}' END AS branch FROM n{k}),
r{k + 1} AS (SELECT s.* EXCLUDE (seg, template), s.template || CASE WHEN s.seg = '' THEN '' ELSE '/' || coalesce(l.branch, '*') END AS template
  FROM s{k} s LEFT JOIN (SELECT * FROM l{k} WHERE seg <> '*') l ON s.host = l.host AND s.template = l.template AND s.seg = l.seg)"""
    return f"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
j AS (SELECT *, {case(lambda r, v: r)} AS rule, {case(lambda r, v: v)} AS said FROM u),
r0 AS (SELECT *, CASE said WHEN 'block' THEN 1 WHEN 'allow' THEN 0 END AS bad, list_filter(string_split(path, '/'), lambda x: x <> '') AS segments, '' AS template FROM j){levels},
done AS (SELECT * REPLACE (template || CASE WHEN len(segments) > {DEPTH} THEN '/**' ELSE '' END AS template) FROM r{DEPTH}),
t AS (SELECT host, template, array_to_string(string_split(host, '.')[-2:], '.') AS domain, count(bad) AS lab, coalesce(sum(bad), 0) AS bads FROM done GROUP BY ALL),
v AS (SELECT *, sum(lab) OVER (PARTITION BY host) AS hlab, sum(bads) OVER (PARTITION BY host) AS hbads, sum(lab) OVER (PARTITION BY domain) AS dlab, sum(bads) OVER (PARTITION BY domain) AS dbads,
  sum(lab) OVER (PARTITION BY template) AS tlab, sum(bads) OVER (PARTITION BY template) AS tbads, sum(lab) OVER () AS wlab, sum(bads) OVER () AS wbads FROM t),
x AS (SELECT *, wbads / wlab AS general FROM v WHERE wlab > 0),
y AS (SELECT *, {odds(f'((hbads + {ALPHA} * ((dbads + {ALPHA} * general) / (dlab + {ALPHA}))) / (hlab + {ALPHA}))')} * {odds(f'((tbads + {ALPHA} * general) / (tlab + {ALPHA}))')} / {odds('general')} AS odds FROM x),
b AS (SELECT host, template FROM y WHERE (bads + {ALPHA} * (odds / (1 + odds))) / (lab + {ALPHA}) >= {PURITY} AND (lab > 0 OR tlab >= {SUPPORT}))
SELECT page_id, done.host, path, rule, coalesce(said, CASE WHEN b.host IS NULL THEN 'allow' ELSE 'block' END) AS verdict, done.template
FROM done LEFT JOIN b ON done.host = b.host AND done.template = b.template"""


QUERIES = {"op1_url_filter": op1_url_filter}
ORACLE_SQL = {"op1_url_filter": _sql()}
