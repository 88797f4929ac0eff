"""Queries of the text functions, the services, packing and incremental counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markup as M
from ..functions import terms
from ..operators import anchors as A
from ..operators import annotate as N
from ..operators import graph as G
from ..sources import files
from ..streaming.counts import windowed_links
from .encyclopedia import CUR, FOLDED, IN_SETS, LINK, TERM_REL, anchors, in_rel, pages, shared, term_pairs
from .registry import Registry
from .services import Encyclopedia, respond

R = Registry()

_C = "c as (select distinct co_id, content from pagecontent where content is not null)"


def _contents(t):
    return t("pagecontent").where("content is not null").select("co_id", "content").distinct()


@R.add("markup_rules", rf"""with {_C} select co_id, content,
 regexp_replace(content, '(?s)<!--.*?-->', '', 'g') as comments, regexp_replace(regexp_replace(content, '(?is)<ref[^<>]*/>', '', 'g'), '(?is)<ref\b[^<>]*>.*?</ref\s*>', '', 'g') as refs,
 regexp_replace(content, '</?[A-Za-z][^<>]*>', '', 'g') as html, regexp_replace(content, '''{{2,}}', '', 'g') as formatting, regexp_replace(content, '__[A-Z]+__', '', 'g') as magic,
 regexp_replace(regexp_replace(content, '\[(?:https?|ftp)://[^\s\]]+\s+([^\]]*)\]', '\1', 'g'), '\[(?:https?|ftp)://[^\s\]]+\]', '', 'g') as external,
 regexp_replace(content, '\[\[|\]\]|\{{\{{|\}}\}}|\{{\||\|\}}', '', 'g') as brackets, regexp_replace(content, '(?m)^=+[^=\n]+=+[ \t]*$', '', 'g') as headings,
 regexp_replace(content, '(?m)^[*#:;]+[^\n]*$', '', 'g') as items, regexp_replace(content, '\n(?:[ \t]*\n){{2,}}', chr(10) || chr(10), 'g') as newlines from c""")
def markup_rules(t):
    """Each rule that is one pattern, applied to every content."""
    c = F.col("content")
    rules = {"comments": M.strip_comments, "refs": M.strip_refs, "html": M.strip_html, "formatting": M.strip_formatting, "magic": M.strip_magic_words, "external": M.strip_external_links,
             "brackets": M.strip_orphaned_brackets, "headings": M.strip_headings, "items": M.strip_list_items, "newlines": M.strip_excess_newlines}
    return _contents(t).select("co_id", "content", *[f(c).alias(n) for n, f in rules.items()])


@R.add("plain_text")
def plain_text(t):
    """Every content without any markup, with links kept, and its first sentence and paragraph."""
    c = F.col("content")
    return _contents(t).select("co_id", *[M.udf(f)(c).alias(n) for n, f in (("plain", M.strip_everything), ("linked", M.strip_to_links), ("sentence", M.first_sentence), ("paragraph", M.first_paragraph))])


@R.add("sentences")
def sentences(t):
    """The sentences of every content in order."""
    s = _contents(t).select("co_id", F.posexplode(M.udf(lambda x: M.sentences(M.strip_everything(x)), "array<string>")(F.col("content"))).alias("pos", "sentence"))
    return s


@R.add("preprocessed_documents")
def preprocessed_documents(t):
    """Every content blanked at the same length, with its context, destinations and sections."""
    w = _contents(t).select("co_id", M.udf(M.preprocess_wiki, M.PREPROCESSED)(F.col("content")).alias("p"))
    return w.select("co_id", "p.*")


@R.add("preprocessed_html")
def preprocessed_html(t):
    """Every content read as HTML and blanked likewise."""
    return _contents(t).select("co_id", M.udf(M.preprocess_html, M.PREPROCESSED)(F.col("content")).alias("p")).select("co_id", "p.*")


@R.add("definitions")
def definitions(t):
    """The definition of every content in HTML."""
    return _contents(t).select("co_id", M.udf(M.define)(F.col("content")).alias("definition"))


@R.add("definition_summary")
def definition_summary(t):
    """The first sentence and paragraph of every content, the relation that look-ups of definitions read."""
    c = F.col("content")
    return _contents(t).select(F.col("co_id").alias("df_id"), M.udf(M.first_sentence)(c).alias("df_firstsentence"), M.udf(M.first_paragraph)(c).alias("df_firstparagraph"))


@R.add("term_processors")
def term_processors(t):
    """Every link text by each term processor."""
    x = t("anchor").where("anchor is not null").select("anchor").distinct()
    return x.select("anchor", *[f(F.col("anchor")).alias(n) for n, f in terms.PROCESSORS.items()])


@R.add("packed_in", f"with {CUR}, {LINK} select page_id as li_id, coalesce(string_agg(distinct f, ':' order by f), '') as li_data from p left join l on t = page_id and f <> t group by 1")
def packed_in(t):
    """In-links packed into one field a page."""
    return files.pack_in(G.in_adjacency(pages(t), t("pagelink")))


@R.add("packed_out", f"""with {LINK}, n as (select t, count(*) as c from l group by 1), d as (select distinct f, l.t, c from l join n on n.t = l.t)
 select f as lo_id, string_agg(t || ':' || c, ';' order by t) as lo_data from d group by 1""")
def packed_out(t):
    """Out-links packed into one field a page."""
    return files.pack_out(G.out_adjacency(t("pagelink")))


@R.add("links_by_window", "select time_bucket(interval '30 days', pl_seen, timestamp '1970-01-01') as start, pl_to as target, count(*) as links from pagelink where pl_seen is not null and pl_to is not null group by 1, 2")
def links_by_window(t):
    """Links by target and window of 30 days, the batch form of the stream."""
    return windowed_links(t("pagelink"), "pl_seen", "pl_to").withColumn("start", F.col("start").cast("timestamp_ntz"))


def _encyclopedia(t):
    content = t("pagecontent").select(F.col("co_id").alias("id"), F.col("content").alias("text")).distinct()
    return Encyclopedia(pages(t), t("pagelink"), t("redirect"), t("categorylink"), anchors(t, terms.case_fold), content)


@R.add("service_search")
def service_search(t):
    """Search for every link text."""
    e = _encyclopedia(t)
    return e.search_terms(e.anchors.select(F.col("text").alias("term")))


_IDS = "select least(me.x, o.other_id) as a, greatest(me.x, o.other_id) as b from"


@R.add("service_page", f"""with {CUR}, {LINK}, {FOLDED}, me as (select pl_to as x from pagelink where pl_to is not null group by 1 order by count(*) desc, 1 limit 1),
 c as (select distinct cl_parent, cl_child from categorylink where cl_parent is not null and cl_child is not null), {IN_SETS},
 li as (select distinct f as other_id, page_title from l join p on page_id = f, me where t = x and page_type in (1, 4) order by 1 limit 250),
 lo as (select distinct t as other_id, page_title from l join p on page_id = t, me where f = x and page_type in (1, 4) order by 1 limit 250),
 q as (select distinct a, b from ({_IDS} me, li o union all {_IDS} me, lo o)), {in_rel('q', 'rin')},
 tx as (select text, n, case when sum(n) over () > 0 then round(n / sum(n) over (), 6) end as proportion from a, me where id = x)
 select 'page' as part, page_id as id, page_title as title, page_type::double as value from p, me where page_id = x
 union all select 'text', x, text, proportion from tx, me where n > 0
 union all select 'redirect', rd_from, page_title, 1.0 from (select distinct rd_from, rd_to from redirect) r join p on page_id = rd_from, me where rd_to = x
 union all select 'parent', cl_parent, page_title, 1.0 from c join p on page_id = cl_parent, me where cl_child = x
 union all select * from (select 'child category', cl_child, page_title, 1.0 from c join p on page_id = cl_child, me where cl_parent = x and page_type = 2 order by 2 limit 251)
 union all select * from (select 'child article', cl_child, page_title, 1.0 from c join p on page_id = cl_child, me where cl_parent = x and page_type = 1 order by 2 limit 251)
 union all select 'link in', other_id, page_title, rel from li, me left join rin on a = least(x, other_id) and b = greatest(x, other_id)
 union all select 'link out', other_id, page_title, rel from lo, me left join rin on a = least(x, other_id) and b = greatest(x, other_id)""")
def service_page(t):
    """All that is known of the page with most links."""
    top = t("pagelink").where("pl_to is not null").groupBy("pl_to").count().orderBy(F.desc("count"), "pl_to").first()[0]
    return _encyclopedia(t).search_page(top)


@R.add("service_compare", f"with recursive {CUR}, {LINK}, {FOLDED}, {TERM_REL}, cq as (select distinct id1 as a, id2 as b from tr), {shared('cq')} select tr.*, sh.* exclude (a, b) from tr join sh on a = id1 and b = id2")
def service_compare(t):
    """The most frequent link text of each page compared with its other texts."""
    e = _encyclopedia(t)
    return e.compare(term_pairs(e.ranked))


@R.add("service_responses", f"""with recursive {CUR}, {LINK}, {FOLDED}, {TERM_REL}, cq as (select distinct id1 as a, id2 as b from tr), {shared('cq')}
 select 'compare' as task, null as error, to_json(x)::varchar as response from (select struct_pack(t1 := t1, t2 := t2, id1 := id1, id2 := id2, rel := rel, shared_in := shared_in, only_a_in := only_a_in, only_b_in := only_b_in,
  shared_out := shared_out, only_a_out := only_a_out, only_b_out := only_b_out) as x from tr join sh on a = id1 and b = id2) union all select 'no task', 'ValueError: no such task: no task', null""")
def service_responses(t):
    """The comparisons as JSON rows, and what an unknown task answers."""
    e = _encyclopedia(t)
    spark = e.page.sparkSession
    return respond(spark, "compare", lambda: e.compare(term_pairs(e.ranked))).unionByName(respond(spark, "no task", lambda: e.page))


@R.add("wikified_contents")
def wikified_contents(t):
    """Every content, read by its own kind of markup, with the first reference to each topic in a region as a coloured link; some titles are banned."""
    e = _encyclopedia(t)
    docs = _contents(t).select(F.xxhash64("co_id", "content").alias("doc"), F.col("content").alias("text"))
    p = A.link_probability(e.anchors, A.document_occurrences(docs, "text", e.anchors, terms.case_fold)).select("text", "link_probability")
    banned = N.banned_topics(e.page.sparkSession, "143856; Cat; dog")
    return e.wikify(docs, p.where("link_probability >= 0.03"), 0.2, "region", banned, mode="guess", render=N.coloured(N.tooltip_tag, (200, 0, 0), (120, 120, 120)))
