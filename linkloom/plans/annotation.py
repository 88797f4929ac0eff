"""Queries of the annotation pipeline over documents and link texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import terms
from ..operators import anchors as A
from ..operators import annotate as N
from ..operators import graph as G
from ..operators import relatedness as L
from ..session import cut
from .encyclopedia import CUR, FOLDED, GENERALITY, IN_SETS, LINK, LINKP, SENSES, _articles, anchors, in_rel, pages
from .registry import Registry

R = Registry()

# boundaries of words, white space of every kind among them
_B = r"""\s\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}{}()"'.,;:_-"""
_Q = _B.replace("'", "''")
SPOT = f"""{CUR}, {LINK}, {FOLDED}, {LINKP}, tm as (select distinct text as term, link_probability as lp, regexp_extract(text, '^[^{_Q}]+') as head from lp
  where link_probability >= 0.03 and text <> '' and not regexp_matches(text, '^[{_Q}]|[{_Q}]$')),
 hit as (select doc, low, term, lp, head from (select doc_id as doc, lower(text) as low from documents where text is not null) join tm on contains(low, term)),
 occ as (select *, unnest(list_filter(generate_series(1, length(low) - length(term) + 1), lambda i: substr(low, i, length(term)) = term)) as i from hit),
 refs as (select doc, (i - 1)::int as start, (i - 1 + length(term))::int as "end", term, lp as link_probability from occ
  where (i = 1 or regexp_matches(substr(low, i - 1, 1), '[{_Q}]')) and (i + length(term) > length(low) or regexp_matches(substr(low, i + length(term), 1), '[{_Q}]'))
   and not (length(head) = 1 and i > 1 and substr(low, i - 1, 1) = ''''))"""
CAND = f"""{SPOT}, {SENSES}, cand as (select r.doc, r.term, r.link_probability, s.id, p.page_title as title, s.commonness, s.rank
  from (select distinct doc, term, link_probability from refs) r join s on s.text = r.term and s.commonness >= 0.02 join p on p.page_id = s.id and p.page_type = 1)"""
_DATES = r"(?i)^(january|february|march|april|may|june|july|august|september|october|november|december)\s+\d+"


def _best(rows: str, name: str) -> str:
    """CTEs that weigh the candidate context in `rows` (doc, id, title, lp) and keep the best."""
    return f"""{name}_c as (select doc, id, max(lp) as lp from ({rows}) where not coalesce(regexp_matches(title, '{_DATES}'), false) group by 1, 2),
 {name}_x as (select x.doc, x.id, least(x.id, y.id) as a, greatest(x.id, y.id) as b from {name}_c x join {name}_c y on x.doc = y.doc), {name}_q as (select distinct a, b from {name}_x), {in_rel(f'{name}_q', f'{name}_r')},
 {name}_m as (select doc, id, avg(rel) as r from {name}_x join {name}_r using (a, b) group by 1, 2),
 {name} as (select doc, id, weight from (select doc, id, round((lp + 2 * r) / 3, 6) as weight from {name}_c join {name}_m using (doc, id)) qualify row_number() over (partition by doc order by weight desc, id) <= 26)"""


CTX = f"""{CAND}, {IN_SETS}, """ + _best("select doc, id, title, link_probability as lp from (select *, count(*) over (partition by doc, term) as k from cand) where k = 1 or (rank = 1 and commonness > 0.98)", "ctx")
FEAT = f"""{CTX}, fp as (select distinct c.doc, c.id, x.id as cid, x.weight from cand c join ctx x using (doc)), fq as (select distinct least(id, cid) as a, greatest(id, cid) as b from fp), {in_rel('fq', 'fr')},
 fw as (select doc, id, round(sum(rel * weight) / sum(weight), 6) as relatedness from fp join fr on a = least(id, cid) and b = greatest(id, cid) group by 1, 2), ql as (select doc, round(sum(weight), 6) as quality from ctx group by 1),
 feat as (select cand.*, coalesce(relatedness, 0) as relatedness, coalesce(quality, 0) as quality from cand left join fw using (doc, id) left join ql using (doc)),
 chosen as (select * from (select *, round(1 / (1 + exp(-(-2.5 + 4.0 * commonness + 6.0 * relatedness + 0.02 * quality))), 6) as confidence from feat) where confidence > 0.5
  qualify row_number() over (partition by doc, term order by confidence desc, id) = 1)"""
TOPICS = f"""{FEAT}, tp as (select r.doc, c.id, c.title, count(*) as occurrences, round(avg(r.link_probability), 6) as mean_link_probability, max(r.link_probability) as most_link_probability,
  round(avg(confidence), 6) as mean_confidence, max(confidence) as most_confidence, round(min(start / greatest(length(text), 1)), 6) as first, round(max(start / greatest(length(text), 1)), 6) as last
  from refs r join chosen c on c.doc = r.doc and c.term = r.term join documents d on d.doc_id = r.doc group by 1, 2, 3),
 tx as (select x.doc, x.id, least(x.id, y.id) as a, greatest(x.id, y.id) as b from tp x join tp y on x.doc = y.doc and x.id <> y.id), tq as (select distinct a, b from tx), {in_rel('tq', 'tr')},
 tm2 as (select doc, id, round(avg(rel), 6) as others from tx join tr using (a, b) group by 1, 2),
 topics as (select *, round((2 * coalesce(others, 0) + occurrences / max(occurrences) over (partition by doc) + spread) / 5, 6) as weight
  from (select tp.*, round(last - first, 6) as spread, others from tp left join tm2 using (doc, id)))"""


def _terms(t):
    """Link texts, case folded, with their link probability."""
    a = anchors(t, terms.case_fold)
    return A.link_probability(a, A.document_occurrences(t("documents"), "text", a, terms.case_fold)).select("text", "link_probability")


def _refs(t):
    return cut(N.spot(t("documents"), "doc_id", "text", _terms(t), least=0.03))


def _candidates(t, refs):
    return cut(N.candidates(refs, A.senses(anchors(t, terms.case_fold)), pages(t)))


def _topics(t):
    refs = _refs(t)
    cand = _candidates(t, refs)
    n = _articles(t)
    ctx = cut(N.context(cand, t("pagelink"), n))
    chosen = cut(N.disambiguate(N.sense_features(cand, ctx, t("pagelink"), n)))
    lengths = t("documents").where("text is not null").select(F.col("doc_id").alias("doc"), F.length("text").alias("length"))
    out = cut(N.topics(refs, chosen, lengths))
    return refs, chosen, cut(N.index_weights(N.relatedness_to_others(out, t("pagelink"), n)))


@R.add("spotted_terms", f"with {SPOT} select * from refs")
def spotted_terms(t):
    """Known terms in every document with their positions."""
    return _refs(t)


@R.add("sense_candidates", f"with {CAND} select * from cand")
def sense_candidates(t):
    """The senses that the terms of each document may have."""
    return _candidates(t, _refs(t))


@R.add("document_context", f"with {CTX} select * from ctx")
def document_context(t):
    """The context of each document."""
    return N.context(_candidates(t, _refs(t)), t("pagelink"), _articles(t))


@R.add("ambiguous_context", f"with {CAND}, {IN_SETS}, " + _best("select doc, id, title, link_probability * commonness as lp from cand", "amb") + " select * from amb")
def ambiguous_context(t):
    """The context of each document from all senses of its terms."""
    return N.context_of_all(_candidates(t, _refs(t)), t("pagelink"), _articles(t))


@R.add("senses_in_context", f"""with {CTX}, kk as (select doc, term, count(*) as k from cand group by 1, 2), sp as (select distinct cand.doc, cand.id, ctx.id as cid from cand join kk using (doc, term) join ctx on ctx.doc = cand.doc where k > 1),
 sq as (select distinct least(id, cid) as a, greatest(id, cid) as b from sp), {in_rel('sq', 'sr')}, sw as (select doc, id, sum(rel) as r from sp join sr on a = least(id, cid) and b = greatest(id, cid) group by 1, 2)
 select doc, term as text, id, round(coalesce(r, 0) + commonness, 6) as weight from cand left join sw using (doc, id)""")
def senses_in_context(t):
    """The senses of each document's terms weighed by its context."""
    cand = _candidates(t, _refs(t))
    ctx = cut(N.context(cand, t("pagelink"), _articles(t)))
    return L.in_context(cand.withColumnRenamed("term", "text"), ctx, t("pagelink"), _articles(t))


@R.add("senses_in_terms", f"""with {CAND}, {IN_SETS}, kk as (select doc, term, count(*) as k from cand group by 1, 2), ll as (select text, arg_min(id, rank) as id from s join p on page_id = id where page_type = 1 group by 1),
 sx as (select distinct doc, ll.id from refs join ll on ll.text = refs.term), sp as (select distinct cand.doc, cand.id, sx.id as cid from cand join kk using (doc, term) join sx on sx.doc = cand.doc where k > 1),
 sq as (select distinct least(id, cid) as a, greatest(id, cid) as b from sp), {in_rel('sq', 'sr')}, sw as (select doc, id, sum(rel) as r from sp join sr on a = least(id, cid) and b = greatest(id, cid) group by 1, 2)
 select doc, term as text, id, round(coalesce(r, 0) + commonness, 6) as weight from cand left join sw using (doc, id)""")
def senses_in_terms(t):
    """The senses of each document's terms weighed by the likeliest articles of all its terms."""
    refs = _refs(t)
    cand = _candidates(t, refs)
    likely = A.likeliest_article(A.senses(anchors(t, terms.case_fold)), pages(t))
    return L.in_context_of_terms(cand.withColumnRenamed("term", "text"), refs.select("doc", F.col("term").alias("text")).distinct(), likely, t("pagelink"), _articles(t))


@R.add("document_topics", f"with {TOPICS} select * from topics")
def document_topics(t):
    """The topics of each document with their features and weights."""
    return _topics(t)[2]


@R.add("document_scores", f"with {TOPICS} select doc, round(sum(coalesce(others, 0)), 6) as score from topics group by 1")
def document_scores(t):
    """How well the topics of each document hang together."""
    return N.document_scores(_topics(t)[2])


@R.add("best_topics", f"with {TOPICS} select * from topics where weight >= 0.3")
def best_topics(t):
    """Topics of a weight of at least 0.3."""
    return N.best_topics(_topics(t)[2], 0.3)


@R.add("topics_unbanned", f"with {TOPICS}, bb as (select distinct d.doc_id as doc, pl_to as id from documents d join pagelink on pl_from = d.page_id) select * from topics t where not exists (select 1 from bb where bb.doc = t.doc and bb.id = t.id) and (title is null or lower(title) not in (select lower(page_title) from p where page_id % 7 = 0 and page_title is not null))")
def topics_unbanned(t):
    """Topics but for what the page that a document is about links to, and for a list of titles."""
    links = t("documents").where("page_id is not null").select(F.col("doc_id").alias("doc"), F.col("page_id").alias("pl_from")).join(t("pagelink"), "pl_from").select("doc", F.col("pl_to").alias("id"))
    titles = pages(t).where("page_id % 7 = 0").select(F.col("page_title").alias("title"))
    return N.without_banned(N.without_banned(_topics(t)[2], links), titles)


def _tagged(t, repeat: str, regions=None):
    refs, chosen, topics = _topics(t)
    good = N.best_topics(topics, 0.2).select("doc", "id", "weight")
    x = refs.join(chosen.select("doc", "term", "id", "title"), ["doc", "term"]).join(good, ["doc", "id"])
    return N.by_repeat(N.without_overlaps(x.select("doc", "start", "end", "id", "title", "weight")), repeat, regions)


@R.add("tagged_documents", f"""with recursive {TOPICS}, rf as (select r.doc, r.start, r."end", c.id, c.title, row_number() over (partition by r.doc order by r.start, r."end" desc, c.id) as k
  from refs r join chosen c on c.doc = r.doc and c.term = r.term join topics t on t.doc = r.doc and t.id = c.id and t.weight >= 0.2),
 fold(doc, k, upto, kept) as (select doc, k, "end", true from rf where k = 1
  union all select rf.doc, rf.k, case when rf.start >= upto then rf."end" else upto end, rf.start >= upto from fold join rf on rf.doc = fold.doc and rf.k = fold.k + 1),
 one as (select rf.* from rf join fold using (doc, k) where kept qualify row_number() over (partition by doc, id order by start, "end") = 1),
 cut as (select o.*, text, lag(o."end", 1, 0) over (partition by doc order by o.start) as prev, substr(text, o.start + 1, o."end" - o.start) as word from one o join documents d on d.doc_id = o.doc),
 put as (select doc, any_value(text) as text, max("end") as last, string_agg(substr(text, prev + 1, start - prev) || '[[' || case when title is null or lower(title) = lower(word) then '' else title || '|' end || word || ']]', '' order by start) as head from cut group by 1)
 select doc_id as doc, case when head is null then d.text else head || substr(d.text, last + 1) end as tagged from documents d left join put on put.doc = d.doc_id where doc_id is not null""")
def tagged_documents(t):
    """The documents with the first reference to each of their better topics as a link."""
    return N.tag(t("documents"), "doc_id", "text", _tagged(t, "first"))


@R.add("tagged_regions")
def tagged_regions(t):
    """The documents with the first reference to a topic in each paragraph as a coloured link with its weight."""
    d = t("documents").where("text is not null")
    breaks = F.transform(F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: s["i"] > 0), lambda s: s["i"])
    starts = d.select(F.col("doc_id").alias("doc"), F.explode(breaks).alias("i"), "text").select("doc", F.expr("length(substring_index(text, '\n', i))").alias("start"))
    return N.tag(t("documents"), "doc_id", "text", _tagged(t, "region", starts), N.coloured(N.tooltip_tag, (200, 0, 0), (120, 120, 120)))


_ABOUT = "ab as (select doc_id as doc, page_id as id from documents where page_id is not null and text is not null)"


@R.add("topic_evaluation", f"""with {TOPICS}, {_ABOUT}, n as (select (select count(*) from (select distinct doc, id from topics)) as found, (select count(*) from (select distinct doc, id from topics intersect select * from ab)) as correct, (select count(*) from (select distinct * from ab)) as wanted),
 m as (select *, coalesce(correct / nullif(found, 0), 0) as p, coalesce(correct / nullif(wanted, 0), 0) as r from n)
 select found, correct, wanted, round(p, 6) as precision, round(r, 6) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 6) as f from m""")
def topic_evaluation(t):
    """Precision and recall of the topics against the pages that the documents are about."""
    truth = t("documents").where("page_id is not null and text is not null").select(F.col("doc_id").alias("doc"), F.col("page_id").alias("id"))
    return N.evaluate(_topics(t)[2], truth, ["doc", "id"])


@R.add("sense_forest")
def sense_forest(t):
    """Senses scored by bagged trees learnt from the pages that the documents are about."""
    refs = _refs(t)
    cand, n = _candidates(t, refs), _articles(t)
    f = cut(N.sense_features(cand, N.context(cand, t("pagelink"), n), t("pagelink"), n))
    about = t("documents").where("page_id is not null").select(F.col("doc_id").alias("doc"), F.col("page_id").alias("id"))
    truth = f.join(about, ["doc", "id"]).select("doc", "term", "id")
    rows = cut(N.sense_training(f, truth))
    return N.disambiguate(f, N.forest(rows, ["commonness", "relatedness", "quality"], "valid", "confidence"))


def _link_rows(t):
    depth = G.depths(t("categorylink"), G.root_category(pages(t), t("categorylink")))
    topics = N.with_generality(_topics(t)[2], G.generality(depth))
    about = t("documents").select(F.col("doc_id").alias("doc"), "page_id")
    return cut(N.link_training(topics.drop("weight"), N.own_links(about, t("pagelink"))))


@R.add("link_features", f"""with recursive {TOPICS}, {GENERALITY}, ol as (select d.doc_id as doc, pl_to as id from documents d join pagelink on pl_from = d.page_id where pl_to is not null union select doc_id, page_id from documents where page_id is not null)
 select topics.* exclude (weight), generality, (exists (select 1 from ol where ol.doc = topics.doc and ol.id = topics.id))::int as linked from topics left join gen on gen.page_id = topics.id""")
def link_features(t):
    """The training rows of the link detector: the features of every topic and whether the page its document is about links to it or is it."""
    return _link_rows(t)


@R.add("link_weights")
def link_weights(t):
    """Topics weighed by the link detector, learnt from half of the documents and applied to the others."""
    rows = _link_rows(t)
    half = F.pmod(F.xxhash64("doc"), F.lit(2)) == 0
    return N.link_detector(rows.where(half), share=0.5)(rows.where(~half)).select("doc", "id", "title", "weight", "linked")


@R.add("link_evaluation")
def link_evaluation(t):
    """Precision and recall of the links that the detector would set in the documents it has not learnt from."""
    x = link_weights(t)
    return N.evaluate(x.where("weight > 0.5"), x.where("linked = 1"), ["doc", "id"])


@R.add("class_weights", "with x as (select doc_id, case when lang = 'en' then 1 else 0 end as y from documents) select doc_id, y, case when y = 1 then 0.5 / (select avg(y) from x) else 0.5 / (1 - (select avg(y) from x)) end as class_weight from x")
def class_weights(t):
    """Weights that balance English and other documents."""
    x = t("documents").select("doc_id", F.when(F.col("lang") == "en", 1).otherwise(0).alias("y"))
    return N.class_weights(x, "y")


@R.add("unambiguous_terms", f"with {CUR}, {FOLDED}, {SENSES}, v as (select s.* from s join p on page_id = id where page_type = 1), n as (select text, count(*) as k from v where commonness >= 0.02 group by 1) select v.text, v.id from v join n using (text) where commonness >= 0.02 and (k = 1 or (rank = 1 and commonness > 0.98))")
def unambiguous_terms(t):
    """Link texts that can stand for the context: one sense, or one that is nearly always meant."""
    v = A.page_senses(A.senses(anchors(t, terms.case_fold)), pages(t), 1).where("commonness >= 0.02")
    k = F.count("*").over(Window.partitionBy("text"))
    return v.withColumn("k", k).where((F.col("k") == 1) | ((F.col("rank") == 1) & (F.col("commonness") > 0.98))).select("text", "id")
