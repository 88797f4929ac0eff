"""Queries of the general data problems: references, frequent keys, packed fields, hierarchies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.hierarchy import hierarchy
from ..operators.hotkeys import frequent_keys, target_profiles
from ..operators.references import Ref, orphan_counts, orphan_references
from ..operators.unpack import cover, unpack
from .registry import Registry

R = Registry()

_REFS = """with r as (
  select 'pagelink' as tab, pl_seen as seen, pl_from as from_id, pl_to as to_id from pagelink
  union all select 'redirect', rd_seen, rd_from, rd_to from redirect
  union all select 'categorylink', cl_seen, cl_parent, cl_child from categorylink),
k as (select *, to_id is not null and not exists (select 1 from page p where p.page_id = r.to_id and p.pg_created <= r.seen
  and (p.pg_deleted is null or r.seen < p.pg_deleted)) as orphan from r where to_id is not null)
"""


def _refs(t):
    return [
        Ref("pagelink", t("pagelink"), "pl_from", "pl_to", "pl_seen"),
        Ref("redirect", t("redirect"), "rd_from", "rd_to", "rd_seen"),
        Ref("categorylink", t("categorylink"), "cl_parent", "cl_child", "cl_seen"),
    ]


@R.add("p1_found", _REFS + "select distinct tab, strftime(seen, '%Y-%m') as period, from_id, to_id from k where orphan")
def p1_found(t):
    """References whose target has no living page at their time."""
    bad = orphan_references(_refs(t), t("page"), "page_id", "pg_created", "pg_deleted")
    return bad.select("tab", "period", "from_id", "to_id").distinct()


@R.add("p1_counts", _REFS + """select tab, strftime(seen, '%Y-%m') as period, count(*) as refs, count(*) filter (where orphan) as orphans,
  count(distinct to_id) filter (where orphan) as missing_keys from k group by all""")
def p1_counts(t):
    """References, orphans and missing keys per table and month."""
    return orphan_counts(_refs(t), t("page"), "page_id", "pg_created", "pg_deleted")


def _frequent(tab: str, col: str) -> str:
    return f"""select '{tab}' as tab, {col} as key_id from {tab} where {col} is not null group by {col}
      having count(*) >= 5 and count(*) >= 0.01 * (select count({col}) from {tab})"""


@R.add("p2_found", _frequent("pagelink", "pl_to") + " union all " + _frequent("redirect", "rd_to"))
def p2_found(t):
    """Targets that hold at least 1 % of the rows of their table."""
    out = [frequent_keys(t(tab), col, 0.01, 5).select(F.lit(tab).alias("tab"), "key_id") for tab, col in (("pagelink", "pl_to"), ("redirect", "rd_to"))]
    return out[0].unionByName(out[1])


@R.add("p2_targets", """select coalesce(a.t, b.t) as target, coalesce(links, 0) as links, coalesce(sources, 0) as sources, coalesce(redirects, 0) as redirects
  from (select pl_to as t, count(*) as links, count(distinct pl_from) as sources from pagelink where pl_to is not null group by 1) a
  full join (select rd_to as t, count(*) as redirects from redirect where rd_to is not null group by 1) b on a.t = b.t""")
def p2_targets(t):
    """Links, distinct sources and redirects of every target."""
    return target_profiles(t("pagelink"), "pl_from", "pl_to", t("redirect"), "rd_from", "rd_to")


@R.add("p3_found", r"""with m as (select distinct li_id, li_data from pagelink_in where li_data is not null),
  x as (select li_id, regexp_extract_all(li_data, '"(?:[^"\\]|\\.|"")*"|[^\s:;,|/：；，｜]+') as v from m),
  y as (select li_id, unnest(v) as val, generate_subscripts(v, 1) as pos from x where len(v) > 0)
  select distinct li_id, pos::int as pos, case when val like '"%"' then trim(replace(replace(val[2:-2], '""', '"'), '\"', '"')) else val end as val from y""")
def p3_found(t):
    """Every value packed in pagelink_in.li_data with its position."""
    return unpack(t("pagelink_in"), "li_id", "li_data", _known_values(t), "value")


def _known_values(t):
    """The ids and titles of all pages, the latter also with underscores for blanks."""
    p = t("page")
    title = p.select(F.col("page_title").alias("value"))
    return p.select(F.col("page_id").cast("string").alias("value")).unionByName(title).unionByName(title.select(F.replace("value", F.lit(" "), F.lit("_")).alias("value")))


@R.add("p3_cover")
def p3_cover(t):
    """How many values of each packed field are known whole values, and how many of those hold delimiters."""
    return cover(t("pagelink_in"), "li_id", "li_data", _known_values(t), "value").select("li_id", F.size("vals").alias("n"), "known", "together").distinct()


_LINKS = "e as (select distinct cl_parent as p, cl_child as c from categorylink where cl_parent is not null and cl_child is not null)"


@R.add("p4_found", f"""with recursive {_LINKS},
  r(root_id, node_id, depth) as (
    select distinct p, p, 0 from e where p not in (select c from e)
    union select r.root_id, e.c, r.depth + 1 from r join e on e.p = r.node_id where r.depth < 400),
  w(a, b) as (select p, c from e union select w.a, e.c from w join e on e.p = w.b)
  select root_id, node_id, min(depth)::int as depth from r group by 1, 2
  union all select min(x.b), x.a, -1 from w x join w y on x.a = y.b and x.b = y.a group by x.a""")
def p4_found(t):
    """Depth of each node under each root; the nodes on rings."""
    h = hierarchy(t("categorylink"), "cl_parent", "cl_child")
    rings = h.rings().select(F.col("ring").alias("root_id"), F.col("node").alias("node_id"), F.lit(-1).alias("depth"))
    return h.under_roots().select("root_id", "node_id", "depth").unionByName(rings)


@R.add("p4_paths", f"""with recursive {_LINKS},
  r(root_id, node_id, depth, path) as (
    select p, p, 0, [p] from (select distinct p from e where p not in (select c from e))
    union select r.root_id, e.c, r.depth + 1, min(list_append(r.path, e.c)) from r join e on e.p = r.node_id where r.depth < 400 and not list_contains(r.path, e.c) group by 1, 2, 3)
  select root_id, node_id, min(depth)::int as depth, arg_min(path, depth) as path from r group by 1, 2""")
def p4_paths(t):
    """The path of fewest links from each root to each node (of smallest ids among equals)."""
    return hierarchy(t("categorylink"), "cl_parent", "cl_child", paths=True).under_roots()


@R.add("p4_descendants", f"""with recursive {_LINKS}, w(a, b) as (select p, c from e union select w.a, e.c from w join e on e.p = w.b)
  select a as node_id, count(*) as descendants from w group by 1""")
def p4_descendants(t):
    """How many nodes each node reaches (itself too if it is on a ring)."""
    return hierarchy(t("categorylink"), "cl_parent", "cl_child").closure.groupBy(F.col("a").alias("node_id")).agg(F.count("*").alias("descendants"))
