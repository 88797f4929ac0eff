"""Queries of the training-data problems."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.registry import Registry
from .encode import encode_texts
from .frequency import folded, marks, repeats, term_counts, whole, words
from .markup import clean_documents, marked
from .mixture import Mixture, ramp
from .simjoin import SimilarSets
from .subjects import assign_subjects

R = Registry()


@R.add("p5_found")
def p5_found(t):
    """Headings, entries, code blocks and formulas of every content, in order."""
    return marked(t("pagecontent"), "co_id", "content").distinct()


@R.add("p5_text")
def p5_text(t):
    """Every content as clean text that keeps its structure."""
    return clean_documents(t("pagecontent").distinct(), "co_id", "content", "co_model").select("co_id", "text")


_ANCHOR = r"""a as (select distinct * from anchor), b as (select trim(regexp_replace(lower(anchor), '[ \t\x{A0}]+', ' ', 'g')) as term, coalesce(an_count, 0) as n from a),
 fa as (select term, sum(n)::bigint as occurrences, count(*) as records from b where term <> '' group by 1), na as (select count(*) as total from b where term <> '')"""
_CONTENT = r"""c as (select distinct * from pagecontent), w as (select row_number() over () as r, list_transform(regexp_extract_all(content, '\p{L}+'), lambda x: lower(x)) as v from c where content is not null),
 u as (select r, unnest(v) as term from w), fc as (select term, count(*) as occurrences, count(distinct r) as records from u group by 1), nc as (select count(*) as total from w)"""


def _anchors(t):
    a = t("anchor").distinct().select(folded(F.col("anchor")).alias("term"), "an_count").where("term is not null")
    return a, term_counts(a, "term", whole, weight="an_count")


def _contents(t):
    c = t("pagecontent").distinct().where("content is not null")
    return c, term_counts(c, "content", words)


@R.add("p6_found", f"""with {_ANCHOR}, {_CONTENT},
 x as (select 'anchor' as fld, term, occurrences, records >= 0.01 * total as common from fa, na
  union all select 'content', term, occurrences, records >= 0.1 * total from fc, nc)
 select fld, term, 'rare' as mark from x where occurrences <= 2 union all select fld, term, 'common' from x where common""")
def p6_found(t):
    """Terms of anchors and contents that are too rare or too common to be useful."""
    a, fa = _anchors(t)
    c, fc = _contents(t)
    a = marks(fa, a.count(), 2, 0.01).select(F.lit("anchor").alias("fld"), "term", "mark")
    return a.unionByName(marks(fc, c.count(), 2, 0.1).select(F.lit("content").alias("fld"), "term", "mark"))


@R.add("p6_terms", f"with {_ANCHOR}, {_CONTENT} select 'anchor' as fld, * from fa union all select 'content', * from fc")
def p6_terms(t):
    """Occurrences and records of every anchor and every word of the contents."""
    cols = ["fld", "term", "occurrences", "records"]
    return _anchors(t)[1].withColumn("fld", F.lit("anchor")).select(cols).unionByName(_contents(t)[1].withColumn("fld", F.lit("content")).select(cols))


@R.add("p6_ngrams", f"""with {_CONTENT}, g as (
  select r, 1 as n, unnest(v) as term from w
  union all select r, 2, unnest(list_transform(generate_series(1, len(v) - 1), lambda i: v[i] || ' ' || v[i + 1])) from w
  union all select r, 3, unnest(list_transform(generate_series(1, len(v) - 2), lambda i: v[i] || ' ' || v[i + 1] || ' ' || v[i + 2])) from w)
 select n::int as n, term, count(*) as occurrences, count(distinct r) as records from g group by 1, 2 having count(*) > 2""")
def p6_ngrams(t):
    """Runs of up to three words of the contents that occur more than twice."""
    c = t("pagecontent").distinct().where("content is not null")
    return term_counts(c, "content", words, most=3).where("occurrences > 2")


@R.add("p6_repeats")
def p6_repeats(t):
    """Runs of words of any length of the contents that occur more than twice, as intervals of lengths with the same places."""
    c = t("pagecontent").distinct().where("content is not null").withColumn("md5", F.md5("content"))
    return repeats(c, ["co_id", "md5"], "content", words)


_SETS = """s as (select pl_from as f, pl_to as k from pagelink where pl_from is not null and pl_to is not null group by 1, 2),
 z as (select f, count(*) as n from s group by 1 having count(*) >= 5), q as (select s.f, s.k, z.n from s join z using (f)),
 c as (select a.f as a, b.f as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as shared from q a join q b on a.k = b.k and a.f < b.f and b.n >= 0.7 * a.n and a.n >= 0.7 * b.n group by 1, 2)"""


@R.add("p7_found", f"with {_SETS} select a as from_a, b as from_b from c where shared / (na + nb - shared) >= 0.7")
def p7_found(t):
    """Pairs of sources whose sets of targets nearly agree."""
    return SimilarSets(t("pagelink"), "pl_from", "pl_to", 0.7, least=5).pairs().select(F.col("a").alias("from_a"), F.col("b").alias("from_b"))


@R.add("p7_classes", f"""with {_SETS}, t as (select f, list(k order by k) as toks from q group by 1), m as (select f, min(f) over (partition by toks) as rep, count(*) over (partition by toks) as copies from t),
 e as (select a, b from c where shared / (na + nb - shared) >= 0.7 and a in (select rep from m) and b in (select rep from m)),
 n as (select rep, count(*) as links from (select a as rep from e union all select b from e) group by 1)
 select f as id, rep as class, copies, coalesce(links, 0) as links from m left join n using (rep)""")
def p7_classes(t):
    """The class of equal sets of every source, its copies and its links to other classes."""
    return SimilarSets(t("pagelink"), "pl_from", "pl_to", 0.7, least=5).classes()


@R.add("p8_ids")
def p8_ids(t):
    """The token ids of every document."""
    return encode_texts(t("documents"), "doc_id", "text").select("doc_id", "ids")


@R.add("p8_counts")
def p8_counts(t):
    """The number of tokens of every document by a second tokenizer."""
    return encode_texts(t("documents"), "doc_id", "text", "byte_bpe_multi_50k.tiktoken", counts_only=True)


@R.add("p8_pieces")
def p8_pieces(t):
    """The token ids of every document by a piece tokenizer."""
    return encode_texts(t("documents"), "doc_id", "text", "piece_bpe_32k.model").select("doc_id", "ids")


def _mixture(t, curriculum: bool = True):
    m = Mixture(t("documents"), "doc_id", "text", "source", t("mixtargets"), "mt_source", "mt_weight", "mt_max_repeat")
    if curriculum:  # plain entries first, talk and lists later; each schedule's integral is its source's weight
        m.schedules = ramp({s: p[0] for s, p in m.plan.items()}, {"dump_main", "abstracts", "glossary"})
    return m


@R.add("p9_mix")
def p9_mix(t):
    """The mixture along a curriculum of weights that change over the training run: each text's copies with their training positions, in order."""
    return _mixture(t).draws()


@R.add("p9_shares")
def p9_shares(t):
    """Wanted and reached share of each source."""
    return _mixture(t).shares()


@R.add("p9_flat")
def p9_flat(t):
    """The mixture with weights that stay the same over the training run."""
    return _mixture(t, curriculum=False).draws()


def _subjects(t):
    return assign_subjects(t("documents"), "doc_id", "text", "page_id", "source", t("doclabels"), "doc_id", "subject", t("subjects"), "subject")


@R.add("p10_found")
def p10_found(t):
    """The one or two subjects that each text is mainly about."""
    return _subjects(t).select("doc_id", "subject")


@R.add("p10_composition")
def p10_composition(t):
    """Texts by subject; a text of two subjects counts half for each."""
    s = _subjects(t)
    n = s.groupBy("doc_id").agg(F.count("*").alias("k"))
    return s.join(n, "doc_id").groupBy("subject").agg(F.count("*").alias("texts"), F.round(F.sum(1 / F.col("k")), 6).alias("weight"))
