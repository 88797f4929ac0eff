"""Queries of the link graph, the link texts and relatedness over the encyclopedia's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import terms, titles
from ..operators import anchors as A
from ..operators import graph as G
from ..operators import relatedness as L
from .registry import Registry

R = Registry()

# the last life of each page, links with both ends, redirects and category links without repeats
CUR = """p as (select page_id, page_title, page_type from (select *, row_number() over (partition by page_id order by pg_created desc nulls last, coalesce(page_title, '') desc,
 coalesce(page_type, 0) desc) as rn from (select distinct page_id, page_title, page_type, pg_created from page where page_id is not null)) where rn = 1)"""
LINK = "l as (select pl_from as f, pl_to as t from pagelink where pl_from is not null and pl_to is not null)"
CAT = "c as (select distinct cl_parent, cl_child from categorylink where cl_parent is not null and cl_child is not null)"
ANCHOR = "a as (select anchor as text, an_to as id, sum(coalesce(an_count, 0))::bigint as n from anchor where anchor <> '' and an_to is not null group by 1, 2)"
FOLDED = "a as (select lower(anchor) as text, an_to as id, sum(coalesce(an_count, 0))::bigint as n from anchor where anchor <> '' and an_to is not null group by 1, 2)"
SENSES = """s as (select text, id, n, (sum(n) over (partition by text))::bigint as link_count, case when sum(n) over (partition by text) > 0 then round(n / sum(n) over (partition by text), 6) end as commonness,
 row_number() over (partition by text order by n desc, id)::int as rank from a)"""


def pages(t):
    return G.current_pages(t("page"), "pg_created", "pg_deleted")


def anchors(t, process=None):
    return A.anchor_relation(t("anchor"), "anchor", "an_to", "an_count", process)


@R.add("page_stats", f"""with {CUR} select count(*) filter (where page_type = 1) as articles, count(*) filter (where page_type = 2) as categories,
 count(*) filter (where page_type = 3) as redirects, count(*) filter (where page_type = 4) as disambiguations from p""")
def page_stats(t):
    """Pages by type."""
    return G.page_stats(pages(t))


@R.add("pages_current", f"with {CUR} select *, case page_type when 1 then 'article' when 2 then 'category' when 3 then 'redirect' when 4 then 'disambiguation' end as kind from p")
def pages_current(t):
    """The last life of each page, with the name of its type."""
    return pages(t).withColumn("kind", G.type_name(F.col("page_type")))


@R.add("page_keyset", f"with {CUR} select * from p where page_id > 15000 and page_type = 1 order by page_id limit 100")
def page_keyset(t):
    """The next 100 articles of a scan by id."""
    return G.page_batch(pages(t), 15000, 100, G.ARTICLE)


@R.add("link_counts", f"with {CUR}, {LINK} select page_id, (select count(*) from l where t = page_id) as lc_in, (select count(*) from l where f = page_id) as lc_out from p")
def link_counts(t):
    """Links in and out of every page."""
    return G.link_counts(pages(t), t("pagelink"))


@R.add("in_links", f"with {LINK} select distinct t as id, f as source from l where f <> t")
def in_links(t):
    """Distinct sources of every target."""
    return G.in_edges(t("pagelink"))


@R.add("out_links", f"with {LINK}, n as (select t, count(*) as lc_in from l group by 1) select distinct f as id, l.t as target, lc_in from l join n on n.t = l.t")
def out_links(t):
    """Distinct targets of every source with their links in."""
    return G.out_edges(t("pagelink"))


@R.add("in_adjacency", f"with {CUR}, {LINK} select page_id, coalesce(list_sort(list(distinct f) filter (where f is not null)), []) as sources from p left join l on t = page_id and f <> t group by 1")
def in_adjacency(t):
    """The source list of every page."""
    return G.in_adjacency(pages(t), t("pagelink"))


@R.add("in_adjacency_chunks", f"with {LINK} select t as page_id, f // 10000 as part, list(distinct f order by f) as sources from l where f <> t group by 1, 2")
def in_adjacency_chunks(t):
    """The source lists of every page by ranges of ids."""
    return G.in_chunks(t("pagelink"))


@R.add("out_adjacency", f"""with {LINK}, n as (select t, count(*) as lc_in from l group by 1), d as (select distinct f, l.t, lc_in from l join n on n.t = l.t)
 select f as page_id, list({{'target': t, 'lc_in': lc_in}} order by t) as targets from d group by 1""")
def out_adjacency(t):
    """The target list of every source."""
    return G.out_adjacency(t("pagelink"))


@R.add("valid_pages", f"""with {CUR}, {LINK} select page_id from p where page_type = 2 or (page_id in (select t from l group by t having count(*) >= 5) and page_id in (select f from l group by f having count(*) >= 5))""")
def valid_pages(t):
    """Pages with five links either way, and categories."""
    return G.valid_pages(pages(t), t("pagelink"), 5)


RESOLVED = """rd as (select rd_from, min(rd_to) as rd_to from redirect where rd_from is not null and rd_to is not null group by 1),
 w(a, b, h, path) as (select rd_from, rd_to, 1, [rd_from] from rd union all select w.a, rd.rd_to, w.h + 1, list_append(w.path, w.b) from w join rd on rd.rd_from = w.b where not list_contains(w.path, w.b)),
 z as (select a, arg_max(b, h) as b, max(h) as h, list_append(arg_max(path, h), arg_max(b, h)) as path from w group by a),
 y as (select a, b, h, b in (select rd_from from rd) as ring, path[list_position(path, b):] as members from z),
 res as (select a as rd_from, case when not ring then b when list_contains(members, a) then a else list_min(members) end as rd_to, case when not ring then h end as hops from y)"""


@R.add("redirect_targets", f"with recursive {RESOLVED} select rd_from, rd_to, hops::bigint as hops from res")
def redirect_targets(t):
    """Where each redirect ends."""
    return G.resolve_redirects(t("redirect"))


@R.add("redirects_of", f"with {CUR} select distinct rd_to as page_id, rd_from as redirect_id, page_title as redirect_title from redirect join p on page_id = rd_from where rd_to is not null")
def redirects_of(t):
    """The redirects of each page."""
    return G.redirects_of(pages(t), t("redirect"))


GENERALITY = f"""{CAT}, root as (select min(cl_parent) as r from c where cl_parent not in (select cl_child from c)),
 g(page_id, depth) as (select r, 0 from root union select c.cl_child, g.depth + 1 from g join c on c.cl_parent = g.page_id where g.depth < 400),
 m as (select page_id, min(depth) as depth from g group by 1),
 gen as (select page_id, depth::int as depth, round(1 - depth / greatest(1, max(depth) over ()), 6) as generality from m)"""


@R.add("generality", f"with recursive {GENERALITY} select * from gen")
def generality(t):
    """Depth and generality under the first root category."""
    return G.generality(G.depths(t("categorylink"), G.root_category(pages(t), t("categorylink"))))


@R.add("parents", f"with {CUR}, {CAT} select cl_child as page_id, cl_parent as parent_id, page_title as parent_title from c join p on page_id = cl_parent")
def parents(t):
    """Parent categories of each page."""
    return G.parents(pages(t), t("categorylink"))


@R.add("child_articles", f"with {CUR}, {CAT} select cl_parent as category_id, cl_child as child_id, page_title as child_title from c join p on page_id = cl_child where page_type = 1")
def child_articles(t):
    """Articles of each category."""
    return G.children(pages(t), t("categorylink"), G.ARTICLE)


@R.add("child_categories", f"with {CUR}, {CAT} select cl_parent as category_id, cl_child as child_id, page_title as child_title from c join p on page_id = cl_child where page_type = 2")
def child_categories(t):
    """Categories of each category."""
    return G.children(pages(t), t("categorylink"), G.CATEGORY)


@R.add("contains", f"with {CAT} select distinct x.cl_parent, y.cl_child from c x join c y on x.cl_child = y.cl_parent join c on c.cl_parent = x.cl_parent and c.cl_child = y.cl_child")
def contains(t):
    """Grandchildren of a category that are its children too."""
    c = t("categorylink").where("cl_parent is not null and cl_child is not null").select("cl_parent", "cl_child").distinct()
    pairs = c.withColumnRenamed("cl_child", "m").join(c.select(F.col("cl_parent").alias("m"), "cl_child"), "m").select("cl_parent", "cl_child").distinct()
    return G.contains(t("categorylink"), pairs)


_KEY = "lower(trim(replace(page_title, '_', ' ')))"


@R.add("equivalents", f"""with {CUR}, k as (select page_id, page_type, {_KEY} as t from p where page_title is not null),
 w as (select page_id, page_type, case when page_type = 2 then rtrim(regexp_extract(t, '^[^ ]+'), 's') else regexp_extract(t, '[^ ]+$') end as k from k),
 x as (select k, min(page_id) as category_id from w where page_type = 2 and k <> '' group by 1),
 y as (select k, min(page_id) as article_id from w where page_type = 1 and k <> '' group by 1) select category_id, article_id from x join y using (k)""")
def equivalents(t):
    """Categories and articles of one kind: the first word of the one, in the singular, is the last word of the other (full titles never agree in these tables)."""
    title = F.lower(F.trim(F.replace(F.col("page_title"), F.lit("_"), F.lit(" "))))
    kind = F.when(F.col("page_type") == G.CATEGORY, F.rtrim(F.regexp_extract(title, "^[^ ]+", 0), F.lit("s"))).otherwise(F.regexp_extract(title, "[^ ]+$", 0))
    return G.equivalents(pages(t), kind)


def _linked(me, other):
    return f"with {CUR}, {LINK} select distinct {me} as page_id, {other} as other_id, page_title as other_title from l join p on page_id = {other} where page_type in (1, 4)"


@R.add("links_in_pages", _linked("t", "f"))
def links_in_pages(t):
    """Articles and disambiguations that link to each page."""
    return G.linked_pages(pages(t), t("pagelink"), incoming=True)


@R.add("links_out_pages", _linked("f", "t"))
def links_out_pages(t):
    """Articles and disambiguations that each page links to."""
    return G.linked_pages(pages(t), t("pagelink"), incoming=False)


_RANKED = """x as (select f, t, count(*) as n from l join p on page_id = f where page_type in ({}) group by 1, 2)
 select f as page_id, x.t as sense_id, q.page_title as sense_title, row_number() over (partition by f order by n desc, x.t)::int as rank from x join p q on q.page_id = x.t"""


@R.add("disambiguation_senses", f"with {CUR}, {LINK}, " + _RANKED.format("4, 1"))
def disambiguation_senses(t):
    """The senses of each disambiguation page by how often it links to them, rank 1 the most obvious; articles are read likewise (here no disambiguation has links)."""
    return G.ranked_links(pages(t), t("pagelink"), G.DISAMBIGUATION, G.ARTICLE)


@R.add("pages_by_title", f"""with {CUR}, q as (select distinct anchor as title, k as page_type from anchor, unnest([1, 2, 3, 4]) as u(k) where anchor is not null)
 select title, q.page_type, min(page_id) as page_id from q join p on p.page_title = title and p.page_type = q.page_type group by 1, 2""")
def pages_by_title(t):
    """The page of each type that a link text names exactly."""
    asked = t("anchor").where("anchor is not null").select(F.col("anchor").alias("title"), F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))).alias("page_type"))
    return G.pages_by_title(pages(t), asked)


@R.add("page_offset", f"with {CUR} select * from p order by page_id limit 100 offset 500")
def page_offset(t):
    """The 100 pages after the first 500."""
    return G.page_offset(pages(t), 500, 100)


@R.add("round_robin", f"with {CUR} select page_id, ((row_number() over (order by page_id) - 1) % 7)::int as part from p where page_type = 1")
def round_robin(t):
    """Articles dealt out to seven parts in turn."""
    return G.round_robin(pages(t).where(F.col("page_type") == G.ARTICLE).select("page_id"), "page_id", 7)


@R.add("valid_articles", f"""with {CUR}, {LINK}, c as (select co_id as id, min(content) as text from pagecontent where content is not null group by 1),
 o as (select f, count(distinct t) as n from l group by 1) select page_id from p join c on id = page_id left join o on f = page_id
 where page_type = 1 and not coalesce(lower(page_title) like 'list%', false)""")
def valid_articles(t):
    """Articles with a content that are no lists, whatever their size."""
    return G.valid_articles(pages(t), t("pagelink"), _content(t), words=(0, 1 << 30))


@R.add("training_articles")
def training_articles(t):
    """Articles of 20 to 10,000 words, at most half of their lines list entries, at most two links a word."""
    return G.valid_articles(pages(t), t("pagelink"), _content(t), (20, 10_000), (0.0, 2.0), 0.5)


def _content(t):
    return t("pagecontent").select(F.col("co_id").alias("id"), F.col("content").alias("text"))


@R.add("articles_by_title", f"""with recursive {CUR}, {RESOLVED}, q as (select distinct anchor as title, upper(anchor[1]) || anchor[2:] as k from anchor where anchor is not null),
 d as (select page_title as k, min(page_id) as direct from p where page_type = 1 group by 1), v as (select page_title as k, min(page_id) as rd_from from p where page_type = 3 group by 1)
 select title, coalesce(direct, res.rd_to) as article_id from q left join d using (k) left join v using (k) left join res using (rd_from) where coalesce(direct, res.rd_to) is not null""")
def articles_by_title(t):
    """The article that each link text names, directly or by a redirect."""
    return G.articles_by_title(pages(t), t("redirect"), t("anchor"), "anchor")


@R.add("article_sample", f"""with {CUR}, {LINK} select page_id from p where page_type = 1 and page_id in (select t from l group by t having count(*) >= 5) and page_id in (select f from l group by f having count(*) >= 5)
 order by md5('1:' || page_id) limit 100""")
def article_sample(t):
    """A seeded sample of 100 well linked articles."""
    return G.article_sample(pages(t), t("pagelink"), 5, 5, 100, 1)


@R.add("anchor_counts", f"with {ANCHOR} select * from a")
def anchor_counts(t):
    """Link texts by destination."""
    return anchors(t)


@R.add("anchor_titles", f"""with recursive {CUR}, {RESOLVED}, {ANCHOR}, x as (select page_title as text, page_id as id from p where page_type = 1 and page_title <> ''
 union select page_title, res.rd_to from p join res on res.rd_from = page_id where page_type = 3 and page_title <> '')
 select * from a union all select text, id, 0 from x where not exists (select 1 from a where a.text = x.text and a.id = x.id)""")
def anchor_titles(t):
    """Link texts and the titles that are none."""
    return A.fill_titles(anchors(t), pages(t), G.resolve_redirects(t("redirect")))


@R.add("anchor_summary", f"with {ANCHOR} select text, list({{'n': n, 'id': id}} order by n desc, id) as senses from a group by 1")
def anchor_summary(t):
    """The senses of each link text as a list."""
    return A.anchor_summary(anchors(t))


@R.add("anchor_casefold", f"with {FOLDED} select * from a")
def anchor_casefold(t):
    """Link texts put together by case folding."""
    return anchors(t, terms.PROCESSORS["casefold"])


@R.add("anchor_stem")
def anchor_stem(t):
    """Link texts put together by Porter stems."""
    return anchors(t, terms.PROCESSORS["porter_stem"])


@R.add("senses", f"with {ANCHOR}, {SENSES} select * from s")
def senses(t):
    """Senses of each link text with commonness and rank."""
    return A.senses(anchors(t))


@R.add("page_senses", f"with {CUR}, {FOLDED}, {SENSES} select s.* from s join p on page_id = id where page_type in (1, 4)")
def page_senses(t):
    """Senses that are articles or disambiguations."""
    return A.page_senses(A.senses(anchors(t, terms.case_fold)), pages(t))


@R.add("frequent_senses", f"with {ANCHOR} select * from a where n > 3")
def frequent_senses(t):
    """Senses of more than three links."""
    return A.frequent_senses(anchors(t), 3)


@R.add("likeliest_article", f"with {CUR}, {FOLDED}, {SENSES} select text, arg_min(id, rank) as id, arg_min(commonness, rank) as commonness from s join p on page_id = id where page_type = 1 and commonness is not null group by 1")
def likeliest_article(t):
    """The most obvious article of each link text."""
    return A.likeliest_article(A.senses(anchors(t, terms.case_fold)).where("commonness is not null"), pages(t))


@R.add("anchor_texts", f"""with {ANCHOR} select id, text, n, case when sum(n) over (partition by id) > 0 then round(n / sum(n) over (partition by id), 6) end as proportion,
 row_number() over (partition by id order by n desc, text)::int as rank from a""")
def anchor_texts(t):
    """The link texts of each page."""
    return A.texts_of(anchors(t))


LINKP = r"""lp_n as (select text, sum(n)::bigint as link_count from a group by 1),
 lp_k as (select text, link_count, array_to_string(regexp_split_to_array(trim(text), '\s+'), ' ') as key from lp_n),
 lp_d as (select doc_id, unnest(regexp_split_to_array(lower(text), '[\n\r\v\f\x1c-\x1e\x85  ]')) as line from documents where text is not null),
 lp_v as (select doc_id, list_filter(regexp_split_to_array(line, '[\s\x1f\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]+'), lambda x: x <> '') as v from lp_d),
 lp_g as (select distinct doc_id, array_to_string(v[i:j], ' ') as key from lp_v, unnest(generate_series(1, len(v))) as u(i), unnest(generate_series(i, least(len(v), i + 10))) as w(j)),
 lp_o as (select key, count(*) as occ_count from lp_g where key in (select key from lp_k) group by 1),
 lp as (select text, link_count, coalesce(occ_count, 0) as occ_count, case when coalesce(occ_count, 0) > 0 then round(least(1.0, link_count / occ_count), 6) else 0 end as link_probability from lp_k left join lp_o using (key))"""


@R.add("link_probability", f"with {FOLDED}, {LINKP} select * from lp")
def link_probability(t):
    """How likely each link text is a link where it occurs in the documents."""
    a = anchors(t, terms.case_fold)
    return A.link_probability(a, A.document_occurrences(t("documents"), "text", a, terms.case_fold))


@R.add("anchor_statistics", f"with {FOLDED}, {LINKP} select text, link_count, case when occ_count > 0 then occ_count else -1 end as occ_count from lp")
def anchor_statistics(t):
    """Links and documents of each link text, where it was met in any."""
    a = anchors(t, terms.case_fold)
    met = A.document_occurrences(t("documents"), "text", a, terms.case_fold).where("occ_count > 0")
    return A.statistics(a, met)


def _pairs(t):
    """Pairs of the first sense of each link text, case folded, with its other senses: as many as there are senses."""
    s = A.senses(anchors(t, terms.case_fold)).select("text", "id", "rank")
    x = s.where("rank > 1").join(s.where("rank = 1").select("text", F.col("id").alias("first")), "text")
    return x.select(F.least("id", "first").alias("a"), F.greatest("id", "first").alias("b")).distinct()


PAIRS = f"{SENSES}, q as (select distinct least(x.id, y.id) as a, greatest(x.id, y.id) as b from s x join s y on x.text = y.text and x.rank = 1 and y.rank > 1)"
N_ART = "nn as (select count(*) as n from p where page_type = 1)"
IN_SETS = f"{N_ART}, e as (select distinct t as id, f as s from l where f <> t), z as (select id, count(*) as n from e group by 1)"


def in_rel(q: str, out: str) -> str:
    """CTEs for the relatedness by in-links of the pairs (a, b) in q."""
    return f"""h_{out} as (select q.a, q.b, count(*) as ab from {q} q join e x on x.id = q.a join e y on y.id = q.b and y.s = x.s group by 1, 2),
 r_{out} as (select q.a, q.b, za.n as na, zb.n as nb, h.ab, (ln(greatest(za.n, zb.n)) - ln(h.ab)) as up, (ln(nn.n) - ln(least(za.n, zb.n))) as down
  from {q} q left join z za on za.id = q.a left join z zb on zb.id = q.b left join h_{out} h on h.a = q.a and h.b = q.b, nn),
 {out} as (select a, b, round(case when na is null or nb is null or ab is null then 0 else 1 - case when down = 0 or up / down > 1 then 1 else up / down end end, 6) as rel from r_{out})"""


IN_REL = f"{PAIRS}, {IN_SETS}, {in_rel('q', 'rin')}"
OUT_REL = """e2 as (select distinct l.f as id, l.t from l), i2 as (select t, count(*) as c from l group by 1), w2 as (select id, e2.t, ln(nn.n / c) as w from e2 join i2 using (t), nn),
 s2 as (select id, sum(w * w) as s from w2 group by 1), d2 as (select q.a, q.b, sum(x.w * y.w) as d from q join w2 x on x.id = q.a join w2 y on y.id = q.b and y.t = x.t group by 1, 2),
 rout as (select q.a, q.b, round(case when x.s is null or y.s is null or x.s * y.s = 0 then 0 else 1 - acos(least(1, greatest(-1, coalesce(d, 0) / (sqrt(x.s) * sqrt(y.s))))) / (pi() / 2) end, 6) as rel
  from q left join s2 x on x.id = q.a left join s2 y on y.id = q.b left join d2 on d2.a = q.a and d2.b = q.b)"""


def _articles(t):
    return pages(t).where(F.col("page_type") == G.ARTICLE).count()


@R.add("relatedness_in", f"with {CUR}, {LINK}, {FOLDED}, {IN_REL} select * from rin")
def relatedness_in(t):
    """Relatedness by in-links of pages that share a link text."""
    return L.by_incoming(_pairs(t), t("pagelink"), _articles(t))


@R.add("relatedness_out", f"with {CUR}, {LINK}, {FOLDED}, {PAIRS}, {N_ART}, {OUT_REL} select * from rout")
def relatedness_out(t):
    """Relatedness by out-links of pages that share a link text."""
    return L.by_outgoing(_pairs(t), t("pagelink"), _articles(t))


@R.add("relatedness_both", f"with {CUR}, {LINK}, {FOLDED}, {IN_REL}, {OUT_REL} select a, b, round((rin.rel + rout.rel) / 2, 6) as rel from rin join rout using (a, b)")
def relatedness_both(t):
    """The mean of both measures."""
    return L.related(_pairs(t), t("pagelink"), _articles(t), "both")


def shared(q: str) -> str:
    """CTEs for the links that the pairs (a, b) in q share or not."""
    return f"""i as (select distinct t as m, f as x from l where f <> t), o as (select distinct f as m, t as x from l),
 ni as (select m, count(*) as n from i group by 1), no as (select m, count(*) as n from o group by 1),
 si as (select q.a, q.b, count(*) as n from {q} q join i x on x.m = q.a join i y on y.m = q.b and y.x = x.x group by 1, 2), so as (select q.a, q.b, count(*) as n from {q} q join o x on x.m = q.a join o y on y.m = q.b and y.x = x.x group by 1, 2),
 sh as (select q.a, q.b, coalesce(si.n, 0) as shared_in, coalesce(ia.n, 0) - coalesce(si.n, 0) as only_a_in, coalesce(ib.n, 0) - coalesce(si.n, 0) as only_b_in, coalesce(so.n, 0) as shared_out,
  coalesce(oa.n, 0) - coalesce(so.n, 0) as only_a_out, coalesce(ob.n, 0) - coalesce(so.n, 0) as only_b_out
  from {q} q left join si using (a, b) left join so using (a, b) left join ni ia on ia.m = q.a left join ni ib on ib.m = q.b left join no oa on oa.m = q.a left join no ob on ob.m = q.b)"""


@R.add("shared_links", f"with {LINK}, {FOLDED}, {PAIRS}, {shared('q')} select * from sh")
def shared_links(t):
    """Links that two senses of one link text share or not."""
    return G.shared_links(_pairs(t), t("pagelink"))


def term_pairs(ranked):
    """(t1, t2): the most frequent link text of each page with the other texts that mean it first: as many as there are texts."""
    x = ranked.where("rank = 1 and n > 0").select("id", "text", "n")
    top = x.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("m"), "text")).alias("x")).select("id", F.col("x.text").alias("top"))
    return x.join(top, "id").where("text <> top").select(F.least("text", "top").alias("t1"), F.greatest("text", "top").alias("t2")).distinct()


TERM_REL = f"""{SENSES}, tx as (select id, text, row_number() over (partition by id order by n desc, text) as k from s where rank = 1 and n > 0),
 tp as (select distinct least(x.text, y.text) as t1, greatest(x.text, y.text) as t2 from tx x join tx y on x.id = y.id and x.k = 1 and y.k > 1),
 sb as (select text, id, commonness as c, rank as r from s where commonness >= 0.01),
 sp as (select t1, t2, x.id as id1, y.id as id2, (x.c + y.c) / 2 as mean, x.r as r1, y.r as r2 from tp join sb x on x.text = t1 join sb y on y.text = t2),
 tq as (select distinct least(id1, id2) as a, greatest(id1, id2) as b from sp), {IN_SETS}, {in_rel('tq', 'trel')},
 oo as (select sp.*, rel, row_number() over (partition by t1, t2 order by mean desc, r1, r2) as k from sp join trel on a = least(id1, id2) and b = greatest(id1, id2)),
 fo(t1, t2, k, bench, id1, id2, rel) as (select t1, t2, k, case when rel > 0.4 then rel else 0 end::double, id1, id2, rel from oo where k = 1
  union all select oo.t1, oo.t2, oo.k, case when oo.rel > bench + 0.4 then oo.rel else bench end, case when oo.rel > bench + 0.4 then oo.id1 else fo.id1 end,
   case when oo.rel > bench + 0.4 then oo.id2 else fo.id2 end, case when oo.rel > bench + 0.4 then oo.rel else fo.rel end from fo join oo on oo.t1 = fo.t1 and oo.t2 = fo.t2 and oo.k = fo.k + 1),
 ph as (select text, max(link_count) as pn from s group by 1),
 tr as (select t1, t2, id1, id2, round(least(1.0, rel + case when pn > 0 then ln(pn) / 30 else 0 end), 6) as rel from (select * from fo qualify row_number() over (partition by t1, t2 order by k desc) = 1) f
  left join ph on ph.text = t1 || ' ' || t2)"""


@R.add("term_relatedness", f"with recursive {CUR}, {LINK}, {FOLDED}, {TERM_REL} select * from tr")
def term_relatedness(t):
    """How related the link texts of a page are to its most frequent one."""
    ranked = A.senses(anchors(t, terms.case_fold))
    return L.by_terms(term_pairs(ranked), ranked, t("pagelink"), _articles(t))


_TITLES = "x as (select distinct page_title as title from page where page_title is not null)"


@R.add("title_functions", rf"""with {_TITLES} select title, trim(regexp_replace(regexp_replace(regexp_replace(trim(title), '_+', ' ', 'g'), '\s+', ' ', 'g'), '#.*$', '')) as clean,
 upper(title[1]) || title[2:] as upper_first, case when regexp_extract(title, '^(.+)\(([^()]*)\)\s*$', 2) <> '' then trim(regexp_extract(title, '^(.+)\(([^()]*)\)\s*$', 2)) end as scope,
 trim(regexp_replace(title, '(.)\([^()]*\)\s*$', '\1')) as without_scope from x""")
def title_functions(t):
    """Titles cleaned, with their scope notes split off."""
    c = F.col("title")
    x = t("page").select(F.col("page_title").alias("title")).where("title is not null").distinct()
    return x.select("title", titles.clean_title(c).alias("clean"), titles.first_upper(c).alias("upper_first"), titles.title_scope(c).alias("scope"), titles.title_without_scope(c).alias("without_scope"))


@R.add("title_casing", rf"""with {_TITLES} select title, array_to_string(list_transform(regexp_extract_all(title, '[\p{{L}}\p{{N}}\p{{M}}_]+|[^\p{{L}}\p{{N}}\p{{M}}_]+'), lambda w: upper(w[1]) || w[2:]), '') as cased from x""")
def title_casing(t):
    """Titles with each word's first letter in upper case."""
    x = t("page").select(F.col("page_title").alias("title")).where("title is not null").distinct()
    return x.select("title", titles.normalize_casing(F.col("title")).alias("cased"))


@R.add("source_modes", r"""select distinct co_id, case when regexp_matches(content, '^\s*(www\.|https?://)') then 'url' when len(regexp_extract_all(content, '<[^<>]*>')) > len(regexp_extract_all(content, '\[\[[^\[\]]*\]\]')) then 'html' else 'wiki' end as mode
 from pagecontent where content is not null""")
def source_modes(t):
    """Whether each content is read as an address, HTML or wiki text."""
    c = t("pagecontent").where("content is not null")
    return c.select("co_id", titles.source_mode(F.col("content")).alias("mode")).distinct()


@R.add("stopwords_removed", r"""with x as (select distinct lower(anchor) as term from anchor where anchor is not null)
 select term, array_to_string(list_filter(regexp_split_to_array(term, '\s+'), lambda w: w not in ('the', 'of', 'and', 'a', 'in', 'at', 'before', 'first', 'old')), ' ') as kept from x""")
def stopwords_removed(t):
    """Link texts without stopwords."""
    x = t("anchor").select(F.lower("anchor").alias("term")).where("term is not null").distinct()
    return x.select("term", terms.remove_stopwords(F.col("term"), ["the", "of", "and", "a", "in", "at", "before", "first", "old"]).alias("kept"))
