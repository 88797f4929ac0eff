"""Link graph, link texts, relatedness, annotation, text functions, sources, streaming: hand-made cases."""

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from linkloom.functions import markup as M
from linkloom.functions import terms as T
from linkloom.functions import titles as TI
from linkloom.operators import anchors as A
from linkloom.operators import annotate as N
from linkloom.operators import graph as G
from linkloom.operators import relatedness as L
from linkloom.plans.services import Encyclopedia
from linkloom.sources import dump, files
from linkloom.streaming.counts import follow, follow_windows, totals, windowed_links

LINKS = [(1, 3), (1, 3), (1, 4), (2, 3), (2, 4), (2, 2), (5, 4), (None, 3), (1, None)]


@pytest.fixture
def links(df):
    return df(LINKS, "pl_from bigint, pl_to bigint")


@pytest.fixture
def page(df):
    return df([(i, f"T{i}", 1) for i in range(1, 6)] + [(6, "T3", 2), (7, "T9", 4), (8, "T8", 3)], "page_id bigint, page_title string, page_type int")


def test_link_summaries(page, links):
    arts = page.where("page_id <= 5")
    assert rows_of(G.link_counts(arts, links)) == [(1, 0, 3), (2, 1, 3), (3, 3, 0), (4, 3, 0), (5, 0, 1)]
    assert rows_of(G.in_adjacency(arts, links)) == [(1, []), (2, []), (3, [1, 2]), (4, [1, 2, 5]), (5, [])]
    assert {r[0]: [tuple(x) for x in r[1]] for r in G.out_adjacency(links).collect()} == {1: [(3, 3), (4, 3)], 2: [(2, 1), (3, 3), (4, 3)], 5: [(4, 3)]}
    assert rows_of(G.valid_pages(page, links, 1)) == [(2,), (6,)]
    assert rows_of(G.page_stats(page)) == [(5, 1, 1, 1)]


def test_adjacency_in_chunks(links):
    assert rows_of(G.in_chunks(links, 2)) == [(3, 0, [1]), (3, 1, [2]), (4, 0, [1]), (4, 1, [2]), (4, 2, [5])]


def test_redirects_end_and_rings(df):
    r = df([(10, 11), (11, 3), (20, 21), (21, 20), (30, 20), (31, 30), (40, 40), (None, 1), (1, None)], "rd_from bigint, rd_to bigint")
    assert rows_of(G.resolve_redirects(r), "rd_from", "rd_to") == [(10, 3), (11, 3), (20, 20), (21, 21), (30, 20), (31, 20), (40, 40)]
    long = df([(i, i + 1) for i in range(100, 140)] + [(140, 131)] + [(i, i + 1) for i in range(200, 205)], "rd_from bigint, rd_to bigint")  # a long way into a ring
    assert rows_of(G.resolve_redirects(long), "rd_from", "rd_to") == [(i, 131 if i < 131 else i) for i in range(100, 141)] + [(i, 205) for i in range(200, 205)]
    chain = df([(i, i + 1) for i in range(70)], "rd_from bigint, rd_to bigint")
    assert rows_of(G.resolve_redirects(chain), "rd_from", "rd_to", "hops") == [(i, 70, 70 - i) for i in range(70)]
    assert G.resolve_redirects(df([], "rd_from bigint, rd_to bigint")).count() == 0


def test_depths_and_generality(df):
    c = df([(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (5, 2)], "cl_parent bigint, cl_child bigint")
    assert rows_of(G.depths(df([(i, i + 1) for i in range(40)] + [(40, 3)], "cl_parent bigint, cl_child bigint"), 0)) == [(i, i) for i in range(41)]
    d = G.depths(c, 1)
    assert rows_of(d) == [(1, 0), (2, 1), (3, 1), (4, 2), (5, 3)]
    assert {r["page_id"]: r["generality"] for r in G.generality(d).collect()}[4] == pytest.approx(1 - 2 / 3, abs=1e-6)


def test_pages_and_titles(df, page, links):
    assert rows_of(G.equivalents(page, F.col("page_title"))) == [(6, 3)]
    rd = df([(8, 4)], "rd_from bigint, rd_to bigint")
    assert rows_of(G.articles_by_title(page, rd, df([("t1",), ("T8",), ("zz",), (None,)], "x string"), "x")) == [("T8", 4), ("t1", 1)]
    assert rows_of(G.page_batch(page, 2, 2), "page_id") == [(3,), (4,)]
    assert G.article_sample(page, links, 0, 1, 2, 1).count() == 2
    pairs = df([(3, 4), (3, 4)], "a bigint, b bigint")
    assert rows_of(G.shared_links(pairs, links)) == [(3, 4, 2, 0, 1, 0, 0, 0)]
    assert rows_of(G.contains(df([(1, 2)], "cl_parent bigint, cl_child bigint"), df([(1, 2), (2, 1)], "cl_parent bigint, cl_child bigint"))) == [(1, 2)]


def test_relatedness(df, links):
    p = df([(3, 4), (1, 3), (3, 3), (1, 1), (4, 3)], "a bigint, b bigint")
    assert rows_of(L.by_incoming(p, links, 5)) == [(1, 1, 0.0), (1, 3, 0.0), (3, 3, 1.0), (3, 4, 0.557493)]
    p = df([(1, 2), (1, 1), (1, 3)], "a bigint, b bigint")
    assert rows_of(L.by_outgoing(p, links, 5)) == [(1, 1, 1.0), (1, 2, 0.268595), (1, 3, 0.0)]
    with pytest.raises(ValueError):
        L.related(p, links, 5, "no")


def test_senses(df, page):
    raw = df([("plane", 10, 6), ("plane", 11, 3), ("plane", 12, 1), ("Plane", 10, 2), ("", 1, 5), (None, 1, 5), ("x", None, 1), ("x", 1, None)], "t string, i bigint, n bigint")
    a = A.anchor_relation(raw, "t", "i", "n")
    s = {(r["text"], r["id"]): r for r in A.senses(a).collect()}
    assert [s["plane", i]["commonness"] for i in (10, 11, 12)] == [0.6, 0.3, 0.1] and s["x", 1]["commonness"] is None
    assert rows_of(A.anchor_relation(raw, "t", "i", "n", T.case_fold).where("text = 'plane'"), "id", "n") == [(10, 8), (11, 3), (12, 1)]
    occ = df([("plane", 40), ("Plane", 1), ("x", 0)], "text string, occ_count bigint")
    assert {r["text"]: r["link_probability"] for r in A.link_probability(a, occ).collect()} == {"plane": 0.25, "Plane": 1.0, "x": 0.0}
    assert [tuple(x) for x in A.anchor_summary(a).where("text = 'plane'").first()["senses"]] == [(6, 10), (3, 11), (1, 12)]
    assert rows_of(A.statistics(a, occ.where("text = 'plane'"))) == [("Plane", 2, -1), ("plane", 10, 40), ("x", 0, -1)]
    full = A.fill_titles(a, page, df([(8, 4, 1)], "rd_from bigint, rd_to bigint, hops bigint"))
    assert ("T8", 4, 0) in rows_of(full) and ("T1", 1, 0) in rows_of(full)
    parts = df([("a", 1, 2), ("a", 2, 3), ("b", 0, 9)], "text string, link_count bigint, occ_count bigint")
    assert rows_of(A.merge_counts(parts)) == [("a", 3, 5)]


def test_document_occurrences(df):
    docs = df([("big cat\nsat",), ("big\ncat",), ("big cat big cat",), (None,)], "t string")
    a = df([("big cat", 1, 1), ("sat", 2, 1), ("dog", 3, 1)], "text string, id bigint, n bigint")
    assert rows_of(A.document_occurrences(docs, "t", a)) == [("big cat", 2), ("dog", 0), ("sat", 1)]


def test_term_relatedness_adds_phrase(df, links):
    ranked = A.senses(df([("a", 3, 9), ("a", 5, 1), ("b", 4, 5), ("a b", 3, 8)], "text string, id bigint, n bigint"))
    got = L.by_terms(df([("a", "b"), ("a", "none")], "t1 string, t2 string"), ranked, links, 5)
    import math

    assert rows_of(got, "t1", "t2", "id1", "id2") == [("a", "b", 3, 4)]
    assert got.first()["rel"] == pytest.approx(0.557493 + math.log(8) / 30, abs=1e-5)


def test_spotting_and_overlaps(df):
    docs = df([(1, "The Big-cat's cat."), (2, None), (3, "")], "k bigint, t string")
    terms = df([("cat", 0.5), ("big-cat", 0.9), ("s", 0.9), ("the", 0.01)], "text string, link_probability double")
    assert rows_of(N.spot(docs, "k", "t", terms, 0.03), "doc", "start", "end", "term") == [(1, 4, 11, "big-cat"), (1, 8, 11, "cat"), (1, 14, 17, "cat")]
    refs = df([(1, 0, 5, 9), (1, 0, 3, 8), (1, 3, 4, 7), (1, 5, 9, 6)], "doc bigint, start int, end int, id bigint")
    assert rows_of(N.without_overlaps(refs), "start", "end") == [(0, 5), (5, 9)]
    rep = df([(1, 0, 1, 9), (1, 5, 6, 9), (1, 12, 13, 9)], "doc bigint, start int, end int, id bigint")
    assert rows_of(N.by_repeat(rep, "first"), "start") == [(0,)]
    assert rows_of(N.by_repeat(rep, "region", df([(1, 4), (1, 10)], "doc bigint, start int")), "start") == [(0,), (5,), (12,)]
    marks = df([(1, 4, 11, "Big-cat"), (1, 14, 17, "Felis")], "doc bigint, start int, end int, title string")
    assert rows_of(N.tag(docs, "k", "t", marks)) == [(1, "The [[Big-cat]]'s [[Felis|cat]]."), (2, None), (3, "")]


def test_sieve_changes_nothing(df, monkeypatch):
    from linkloom.operators import sieve

    docs = df([(1, "a b c a b"), (2, "b c")], "k bigint, t string")
    terms = df([("a b", 0.5), ("c", 0.9), ("x", 0.9)] + [(f"w{i} v", 0.9) for i in range(20_000)], "text string, link_probability double")
    anchors = terms.select("text", F.lit(1).alias("id"), F.lit(1).alias("n"))
    got = []
    for bits in (27, 16, 15):  # from large enough to one that lets much through
        monkeypatch.setattr(sieve, "MOST_BITS", bits)
        got.append((rows_of(N.spot(docs, "k", "t", terms), "doc", "start", "term"), rows_of(A.document_occurrences(docs, "t", anchors).where("text not like 'w%'"))))
    assert got[0] == got[1] == got[2] == ([(1, 0, "a b"), (1, 4, "c"), (1, 6, "a b"), (2, 2, "c")], [("a b", 1), ("c", 2), ("x", 0)])


def test_context_weights(df):
    c = df([(1, "x", 0.4, 10, "X", 1.0, 1), (1, "y", 0.2, 11, "Y", 1.0, 1), (1, "d", 0.9, 12, "May 5", 1.0, 1), (1, "z", 0.9, 13, "Z", 0.5, 1), (1, "z", 0.9, 14, "Q", 0.5, 2)],
           "doc bigint, term string, link_probability double, id bigint, title string, commonness double, rank int")
    l = df([(1, 10), (2, 10), (1, 11), (2, 11)], "pl_from bigint, pl_to bigint")
    assert rows_of(N.context(c, l, 100)) == [(1, 10, 0.8), (1, 11, 0.733333)]  # both fully related
    w = N.index_weights(df([(1, 5, 2, 0.5, 0.25), (1, 6, 4, None, 0.0)], "doc bigint, id bigint, occurrences bigint, others double, spread double"))
    assert {r["id"]: r["weight"] for r in w.collect()} == {5: 0.35, 6: 0.2}
    assert rows_of(N.evaluate(df([(1,), (2,), (3,)], "id bigint"), df([(2,), (3,), (4,), (5,)], "id bigint"), ["id"])) == [(3, 2, 4, 0.666667, 0.5, 0.571429)]
    cw = N.class_weights(df([(1,)] * 3 + [(0,)] * 9, "y int"), "y")
    assert {r["y"]: round(r["class_weight"], 6) for r in cw.collect()} == {1: 2.0, 0: 0.666667}


def test_forest_learns(df):
    rows = df([(i / 100, (i * 37 % 100) / 100, int(i > 50)) for i in range(100)] * 10, "a double, b double, y int")
    score = N.forest(rows, ["a", "b"], "y", "p")
    got = {r["a"]: r["p"] for r in score(df([(0.1, 0.5), (0.9, 0.5)], "a double, b double")).collect()}
    assert got[0.1] < 0.3 < 0.7 < got[0.9]


def test_titles(df):
    t = lambda s, f: df([(s,)], "x string").select(f(F.col("x"))).first()[0]
    assert t("émile zOLA (o'neil foo_bar)", TI.normalize_casing) == "Émile ZOLA (O'Neil Foo_bar)"
    assert t(" a__b  c#x ", TI.clean_title) == "a b c"
    assert t("Plane (film)", TI.title_scope) == "film" and t("Plane (film)", TI.title_without_scope) == "Plane"
    assert t('a"b\\n\nc', lambda c: TI.unescape_text(TI.escape_text(c))) == 'a"b\\n\nc'
    assert t("January 5", TI.is_date_title) and not t("Plane", TI.is_date_title)
    assert t("www.x.org", TI.source_mode) == "url" and t("<b>x</b>", TI.source_mode) == "html" and t("[[x]]", TI.source_mode) == "wiki"
    assert t("x", lambda c: TI.argument(c, "int", 7)) == 7 and t("5", lambda c: TI.argument(c, "int", 7)) == 5
    assert t(None, TI.clean_title) is None


def test_small_helpers(spark, df, links):
    x = df([("a |b| c ", 0.12345678, "Cats"), ("d", 0.5, "Dogs"), (None, None, None)], "x string, v double, w string")
    dest, text = TI.link_parts(F.col("x"))
    assert rows_of(x.select(dest.alias("d"), text.alias("t"))) == [(None, None), ("a", " c "), ("d", "d")]
    assert rows_of(x.where("v is not null").select(TI.six_digits(F.col("v")).alias("s"), TI.percent(F.col("v")).alias("p"))) == [("0.123457", "12.35%"), ("0.500000", "50.00%")]
    T.register_sql(spark)
    x.createOrReplaceTempView("helpers")
    assert rows_of(spark.sql("select simple_stem(w) as a, porter_stem(lower(w)) as b, clean_term(w) as c from helpers")) == [(None, None, None), ("cat", "cat", "cats"), ("dog", "dog", "dogs")]
    assert rows_of(L.out_in_links_of(links, df([(4,), (5,), (4,)], "id bigint"))) == [(1, 4), (2, 4), (5, 4)]
    pairs = df([("a", 1), ("a", 1), ("b", None), ("", 2), (None, 2), ("a", 2)], "t string, i bigint")
    assert rows_of(A.count_anchors(pairs, "t", "i")) == [("a", 1, 2), ("a", 2, 1)]
    assert M.strip_lone_links("[[a]]\n b [[c]]\n  [[d]] \ne") == " b [[c]]\ne"
    a = df([("x", 1, 9), ("x", 2, 1)], "text string, id bigint, n bigint")
    assert rows_of(A.frequent_senses(a, 3)) == [("x", 1, 9)]


def test_terms(df):
    words = "caresses ponies ties caress cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky relational conditional rational digitizer operator feudalism decisiveness hopefulness formality triplicate formative formalize electrical goodness revival allowance inference adjustable replacement adjustment adoption homologous effective bowdlerize probate rate cease controlling rolling"
    stems = "caress poni ti caress cat feed agre plaster bled motor sing conflat troubl size hop tan fall hiss fizz fail file happi sky relat condit ration digit oper feudal decis hope formal triplic form formal electr good reviv allow infer adjust replac adjust adopt homolog effect bowdler probat rate ceas control roll"
    assert T.porter_stem(words) == stems
    assert T.clean_term("O'Neil, the  A.B. (x)!") == "oneil the a.b x" and T.clean_term("") == ""
    assert T.simple_stem("Parties classes glass cats bus") == "party class glass cat bus"
    assert rows_of(df([("the cat of x",), (None,)], "x string").select(T.remove_stopwords(F.col("x"), ["the", "of"]))) == [(None,), ("cat x",)]
    assert rows_of(df([(None,), ("Cats",)], "x string").select(T.PROCESSORS["porter_stem"](F.lower("x")))) == [(None,), ("cat",)]
    with pytest.raises(ValueError):
        T.register_processor("clean", T.case_fold)


def test_markup_scanners_are_linear():
    import time

    for mark in ("{{x\n\n", "[[x\n\n", "<!-- x\n\n", "<ref>x\n\n", "{|x\n\n", "No. ", "<a>x "):
        s, t = mark * 40_000, time.perf_counter()
        for f in (M.strip_everything, M.strip_to_links, M.preprocess_wiki, M.preprocess_html, M.sentences, M.first_paragraph, M.define):
            f(s)
        assert time.perf_counter() - t < 20, mark
    nested = "[[" * 50_000 + "x" + "]]" * 50_000
    assert M.strip_links(nested) == "x" and M.strip_links("[[a|[[b|c]] d]] [[e") == "c d [[e"


def test_markup_functions(df):
    assert M.strip_links(M.strip_templates("{{x|{{y}}}} A '''cat''' is a [[felid|small felid]].")) == " A '''cat''' is a small felid."
    assert M.strip_everything("{{x|{{y}}}} A '''cat''' is a [[felid|small felid]].\n\n\n\n== H ==\n* item<ref>r</ref>") == "A cat is a small felid.\n\nitem"
    assert M.strip_templates("a {{b {{c}} d") == "a {{b  d" and M.strip_templates("x}} y") == "x}} y"
    assert M.strip_images("a [[File:x.png|thumb|see [[b]]]] c [[d]]") == "a  c [[d]]"
    assert M.strip_section("a\n== See also ==\n* x\n== B ==\nc", "See also") == "a\n== B ==\nc"
    assert M.sentences("Mr. Smith met J. R. Ewing. They spoke! Why? No. 5 was [[a. b]] here.") == ["Mr. Smith met J. R. Ewing.", "They spoke!", "Why?", "No. 5 was [[a. b]] here."]
    assert M.sentences("A b. C d? E f.", question_marks=False) == ["A b.", "C d? E f."]
    assert M.sentences("") == [] and M.first_paragraph("") == "" and M.first_sentence("") == ""
    text = "'''Cat''' is a [[felid|small felid]] of note, seen in many places.\n\n== Uses ==\n{{t}} <b>x</b>"
    assert M.define(text, "plain") == "Cat is a small felid of note, seen in many places."
    assert M.define(text) == '<b>Cat</b> is a <a href="felid">small felid</a> of note, seen in many places.'
    p = M.preprocess_wiki(text)
    assert len(p["text"]) == len(text) and p["banned"] == ["felid"] and p["context"] == ["Uses", "small felid"] and p["splits"] == [text.index("== U")]
    page = "<title>T</title><article>a <a href='x'>link</a> &amp; b</article>"
    h = M.preprocess_html(page)
    assert len(h["text"]) == len(page)
    assert h["context"] == ["t", "link"] and "link" not in h["text"] and " a " in h["text"]
    out = df([(text,), (None,)], "x string").select(M.udf(M.preprocess_wiki, M.PREPROCESSED)(F.col("x")).alias("p")).select("p.context").collect()
    assert [r[0] for r in out] == [["Uses", "small felid"], None]


DUMP = """<mediawiki><siteinfo><namespaces><namespace key="0"/><namespace key="14">Category</namespace></namespaces></siteinfo>
<page><title>Cat</title><id>1</id><revision><text>A [[felid|small felid]] and [[kitty]] {{t|[[no]]}} [[Category:Animals]] [[de:Katze]]</text></revision></page>
<page><title>Kitty</title><id>2</id><redirect title="Cat"/><revision><text>#REDIRECT [[Cat]]</text></revision></page>
<page><title>Felid</title><id>3</id><revision><text>See [[cat]].</text></revision></page>
<page><title>Category:Animals</title><id>4</id><revision><text>[[Category:Things]]</text></revision></page>
<page><title>Animals</title><id>5</id><revision><text>{{disambig}}
* [[Cat]], a pet
* [[Felid]]
[[de:Tiere]]
* [[Kitty]]
== See also ==
* [[Kitty]]</text></revision></page>
<page><title>Talk:Cat</title><id>6</id><revision><text>x</text></revision></page></mediawiki>"""


def test_dump(spark, tmp_path):
    (tmp_path / "x-pages-articles.xml").write_text(DUMP)
    path = dump.find_dump(spark, f"file://{tmp_path}")
    r = dump.ingest(spark, path)
    assert rows_of(r["page"], "page_id", "page_type") == [(1, 1), (2, 3), (3, 1), (4, 2), (5, 4), (6, 1)]
    assert rows_of(r["redirect"]) == [(2, 1)]
    assert rows_of(r["pagelink"].where("pl_from <> 5")) == [(1, 1), (1, 3), (2, 1), (3, 1)]
    assert rows_of(r["categorylink"]) == [(4, 1)]
    assert rows_of(r["translation"]) == [(1, "de", "Katze"), (5, "de", "Tiere")]
    assert rows_of(r["disambiguation"]) == [(5, 1, 1, "Cat, a pet"), (5, 3, 2, "Felid")]
    assert rows_of(r["equivalence"]) == [(4, 5)]
    assert ("small felid", 3, 1) in rows_of(r["anchor"])
    with pytest.raises(FileNotFoundError):
        dump.find_dump(spark, f"file://{tmp_path}/none")


def test_files(spark, df, tmp_path):
    p = str(tmp_path)
    a = df([("x \"y\" \\z", 1, 2), ("b,c", 3, 4)], "an_text string, an_to bigint, an_count bigint")
    files.write_csv(a, f"{p}/csv")
    assert rows_of(files.read_csv(spark, f"{p}/csv", "anchor")) == rows_of(a)
    files.load(a.unionByName(a.limit(0)).unionByName(df([("b,c", 3, 9)], a.schema)), "anchor", f"{p}/anchor")
    assert rows_of(spark.read.parquet(f"{p}/anchor")) == rows_of(a)
    assert files.exists(spark, f"{p}/anchor") and not files.exists(spark, f"{p}/none")
    with pytest.raises(FileNotFoundError):
        files.check_complete(spark, p)
    made = []
    for _ in range(2):
        assert files.stage(spark, f"{p}/stage", lambda: made.append(1) or a).count() == 2
    assert made == [1]
    files.write_article_set(df([(3,), (1,), (3,)], "page_id bigint"), f"{p}/set")
    assert rows_of(files.read_article_set(spark, f"{p}/set")) == [(1,), (3,)]
    (tmp_path / "w.txt").write_text(" The \n\nof\n")
    assert rows_of(files.read_words(spark, f"{p}/w.txt", fold=True)) == [("of",), ("the",)]
    assert files.read_documents(spark, f"{p}/w.txt").first()["text"] == " The \n\nof\n"
    packed = files.pack_out(df([(1, [(3, 2), (4, 1)])], "page_id bigint, targets array<struct<target: bigint, lc_in: bigint>>"))
    assert packed.first()["lo_data"] == "3:2;4:1" and [tuple(x) for x in files.unpack_out(packed).first()["targets"]] == [(3, 2), (4, 1)]


def test_streaming(spark, df, tmp_path):
    p = str(tmp_path)
    rows = [(i % 3, i % 2) for i in range(20)]
    df(rows, "pl_to bigint, n bigint").write.parquet(f"{p}/in")
    for _ in range(2):  # what was taken once is not taken again
        s = spark.readStream.schema("pl_to bigint, n bigint").parquet(f"{p}/in")
        follow(s, f"{p}/out", f"{p}/ck", ["pl_to"], ["n"]).awaitTermination(120)
    want = {k: sum(n for t, n in rows if t == k) for k in range(3)}
    assert dict(rows_of(totals(spark, f"{p}/out", ["pl_to"], ["n"]))) == want
    from datetime import datetime

    w = windowed_links(df([(datetime(2022, 1, 5), 1), (datetime(2022, 1, 6), 1), (None, 1), (datetime(2022, 5, 6), 1)], "at timestamp_ntz, t bigint"), "at", "t")
    assert sorted(r["links"] for r in w.collect()) == [1, 2]


def test_stream_counts_late_links(spark, df, tmp_path):
    """A link that comes a year late is counted as in the batch query."""
    from datetime import datetime

    p, kind = str(tmp_path), "at timestamp, t bigint"
    loads = [[(datetime(2023, 3, 1), 1), (datetime(2023, 3, 2), 2)], [(datetime(2022, 1, 5), 1), (datetime(2023, 3, 3), 1), (None, 1), (datetime(2023, 3, 3), None)]]
    for rows in loads:
        df(rows, kind).coalesce(1).write.mode("append").parquet(f"{p}/in")
        follow_windows(spark.readStream.schema(kind).parquet(f"{p}/in"), f"{p}/out", f"{p}/ck", "at", "t").awaitTermination(120)
    got = rows_of(totals(spark, f"{p}/out", ["start", "target"], ["links"]), "start", "target", "links")
    want = rows_of(windowed_links(df(loads[0] + loads[1], kind), "at", "t"), "start", "target", "links")
    assert got == want and len(got) == 3


def test_services(df, page, links):
    anchors = df([("t three", 3, 5), ("t three", 4, 5), ("t four", 4, 9)], "text string, id bigint, n bigint")
    e = Encyclopedia(page, links, df([(8, 3)], "rd_from bigint, rd_to bigint"), df([(6, 3)], "cl_parent bigint, cl_child bigint"), anchors, df([(3, "T3 is a page."), (4, None)], "id bigint, text string"))
    found = e.search_terms(df([("t three",), ("nothing",)], "term string"))
    assert rows_of(found, "id", "commonness", "definition") == [(3, 0.5, "T3 is a page."), (4, 0.5, None)]
    parts = {(r["part"], r["id"]) for r in e.search_page(3).collect()}
    assert {("page", 3), ("redirect", 8), ("parent", 6), ("link in", 1), ("text", 3)} <= parts
    assert rows_of(e.compare(df([("t three", "t four")], "t1 string, t2 string")), "t1", "t2")[0] == ("t three", "t four")
    docs = df([(1, "About T three and t four."), (2, "nothing")], "doc bigint, text string")
    probs = df([("t three", 0.9), ("t four", 0.9)], "text string, link_probability double")
    out = {r["doc"]: r["tagged"] for r in e.wikify(docs, probs, least=0.0, score=N.logistic({"commonness": 5.0}, -1.0, "confidence")).collect()}
    assert out[1] == "About [[T3|T three]] and [[T4|t four]]." and out[2] == "nothing"


def test_regions_and_tags(df):
    assert N.region_bounds([(10, "open"), (30, "close"), (20, "split"), (40, "close")]) == [(10, 1), (20, 2), (30, 0), (40, 3)]
    assert N.region_bounds([]) == []
    refs = df([(1, s, s + 1, 9) for s in (1, 12, 15, 25, 35, 45)] + [(2, 1, 2, 9), (2, 5, 6, 9)], "doc bigint, start int, end int, id bigint")
    marks = df([(1, 10, "open"), (1, 20, "split"), (1, 30, "close"), (1, 40, "close")], "doc bigint, start int, kind string")
    # what was seen before a region opened counts again after it has closed
    assert rows_of(N.by_repeat(refs, "region", marks), "doc", "start") == [(1, 1), (1, 12), (1, 25), (1, 45), (2, 1)]
    assert rows_of(N.by_repeat(refs, "region", marks.limit(0)), "doc", "start") == [(1, 1), (2, 1)]
    assert N.colour((0, 0, 0), (100, 200, 50), 0.5) == "rgb(50,100,25)"
    assert N.coloured(N.wiki_tag, (9, 9, 9))("a", "B", 0.3, 1) == '<span style="color:rgb(9,9,9)">[[B|a]]</span>'
    assert N.tooltip_tag("a", 'B "c"', 0.5, 3) == '<a id="topic3" href="B_&quot;c&quot;" title="B &quot;c&quot; (0.50)">a</a>'
    docs = df([(1, "xay")], "k bigint, t string")
    m = df([(1, 1, 2, "B", 0.25)], "doc bigint, start int, end int, title string, weight double")
    assert rows_of(N.tag(docs, "k", "t", m, N.tooltip_tag)) == [(1, 'x<a id="topic1" href="B" title="B (0.25)">a</a>y')]


def test_banned(spark, df):
    t = df([(1, 5, "Cat"), (1, 6, "Dog"), (2, 5, "Cat"), (2, 7, None)], "doc bigint, id bigint, title string")
    assert rows_of(N.without_banned(t, N.banned_topics(spark, "6; CAT ;;")), "doc", "id") == [(2, 7)]
    assert rows_of(N.without_banned(t, df([(1, 5), (None, 7)], "doc bigint, id bigint")), "doc", "id") == [(1, 6), (2, 5), (2, 7)]
    assert N.without_banned(t, N.banned_topics(spark, "")).count() == 4


def test_link_detector_learns_and_is_kept(spark, df, tmp_path):
    feats = {f: "double" for f in N.LINK_FEATURES}
    rows = [(i % 20, i, *[float(i > 50 if f in ("occurrences", "generality") else i * 37 % 100) for f in N.LINK_FEATURES]) for i in range(100)]
    rows = [tuple(None if N.LINK_FEATURES[k - 2] == "generality" and r[1] % 9 == 0 and k > 1 else v for k, v in enumerate(r)) for r in rows]
    t = df(rows, "doc bigint, id bigint, " + ", ".join(f"{f} {k}" for f, k in feats.items()))
    truth = df([(i % 20, i) for i in range(51, 100)], "doc bigint, id bigint")
    train = N.link_training(t, truth)
    assert train.where("linked = 1").count() == 49
    score = N.link_detector(train, share=0.8)
    got = {r["id"]: r["weight"] for r in score(t).collect()}
    assert got[10] < 0.3 < 0.7 < got[90]
    N.save_model(score, f"{tmp_path}/m")
    again = N.load_model(f"{tmp_path}/m", N.LINK_FEATURES, "weight")
    assert {r["id"]: r["weight"] for r in again(t).collect()} == got
    N.save_rows(train, f"{tmp_path}/rows")
    assert rows_of(spark.read.parquet(f"{tmp_path}/rows")) == rows_of(train)
    one = N.link_detector(train.where("linked = 1"))
    assert {r["weight"] for r in one(t).collect()} == {1.0} and one.model is None
    assert {r["weight"] for r in N.link_detector(train.limit(0))(t).collect()} == {None}
    with pytest.raises(ValueError):
        N.save_model(one, f"{tmp_path}/none")
    links = df([(7, 3), (7, 3), (None, 1), (8, None)], "pl_from bigint, pl_to bigint")
    assert rows_of(N.own_links(df([(1, 7), (2, None), (3, 8)], "doc bigint, page_id bigint"), links)) == [(1, 3), (1, 7), (3, 8)]
    g = N.with_generality(df([(1, 3), (1, 4)], "doc bigint, id bigint"), df([(3, 1, 0.5)], "page_id bigint, depth int, generality double"))
    assert rows_of(g, "id", "generality") == [(3, 0.5), (4, None)]


def test_context_of_ambiguous_terms(df):
    c = df([(1, "x", 0.4, 10, "X", 0.5, 1), (1, "x", 0.4, 11, "Y", 0.5, 2), (1, "z", 0.9, 13, "Z", 0.01, 3), (1, "d", 0.9, 12, "May 5", 1.0, 1)],
           "doc bigint, term string, link_probability double, id bigint, title string, commonness double, rank int")
    l = df([(1, 10), (2, 10), (1, 11), (2, 11)], "pl_from bigint, pl_to bigint")
    assert rows_of(N.context_of_all(c, l, 100)) == [(1, 10, 0.733333), (1, 11, 0.733333)]
    cand = df([(1, "a", 10, 0.6), (1, "a", 12, 0.4), (1, "b", 11, 1.0)], "doc bigint, text string, id bigint, commonness double")
    terms = df([(1, "t"), (1, "none")], "doc bigint, text string")
    got = L.in_context_of_terms(cand, terms, df([("t", 11)], "text string, id bigint"), l, 100)
    assert rows_of(got, "text", "id", "weight") == [("a", 10, 1.6), ("a", 12, 0.4), ("b", 11, 1.0)]


def test_page_look_ups(df, page, links):
    assert rows_of(G.pages_by_title(page, df([("T3", 1), ("T3", 2), ("T3", 3), (None, 1)], "title string, page_type int"))) == [("T3", 1, 3), ("T3", 2, 6)]
    c = df([(6, 3), (9, 6), (None, 1)], "cl_parent bigint, cl_child bigint")
    assert G.root_category(page, c, "T3") == 6 and G.root_category(page, c, "none") == 9 and G.root_category(page, c.limit(0)) is None
    assert rows_of(G.page_offset(page, 2, 2), "page_id") == [(3,), (4,)]
    assert rows_of(G.round_robin(page.select("page_id"), "page_id", 3)) == [(i, (i - 1) % 3) for i in range(1, 9)]
    assert rows_of(G.ranked_links(page, links, 1), "page_id", "sense_id", "rank") == [(1, 3, 1), (1, 4, 2), (2, 2, 1), (2, 3, 2), (2, 4, 3), (5, 4, 1)]
    tr = df([(1, "de", "Katze"), (1, "fr", "Chat"), (1, "de", "Katze"), (None, "de", "x")], "tl_id bigint, tl_lang string, tl_text string")
    assert [(r[0], r[1], r[2]) for r in G.translations(tr).collect()] == [(1, ["de", "fr"], {"de": "Katze", "fr": "Chat"})]
    content = df([(1, "one two three four"), (2, "* a entry\n* b entry\nline of text"), (3, None), (4, "{{x}} [[a|b]] word")], "id bigint, text string")
    assert rows_of(G.valid_articles(page, links, content)) == [(i,) for i in range(1, 6)]
    assert rows_of(G.valid_articles(page, links, content, words=(3, 100))) == [(1,), (2,)]
    assert rows_of(G.valid_articles(page, links, content, list_share=0.5)) == [(1,), (4,)]
    assert rows_of(G.valid_articles(page, links, content, link_share=(0.45, 1.0))) == [(1,)]


def test_wikify_sources_and_responses(spark, df, page, links):
    from linkloom.plans.services import as_json, respond

    anchors = df([("t three", 3, 9), ("t four", 4, 9)], "text string, id bigint, n bigint")
    e = Encyclopedia(page, links, df([(8, 3)], "rd_from bigint, rd_to bigint"), df([(6, 3)], "cl_parent bigint, cl_child bigint"), anchors, df([(3, "x")], "id bigint, text string"))
    probs = df([("t three", 0.9), ("t four", 0.9)], "text string, link_probability double")
    docs = df([(1, "T three <b>t four</b> and t three"), (2, "[[T4]] is t four, t three"), (3, None)], "doc bigint, text string")
    how = {"least": 0.0, "score": N.logistic({"commonness": 5.0}, -1.0, "confidence"), "mode": "guess"}
    out = {r["doc"]: r["tagged"] for r in e.wikify(docs, probs, **how).collect()}
    assert out == {1: "[[T3|T three]] <b>[[T4|t four]]</b> and t three", 2: "[[T4]] is t four, [[T3|t three]]", 3: None}
    out = {r["doc"]: r["tagged"] for r in e.wikify(docs, probs, banned=N.banned_topics(spark, "t3"), render=N.html_tag, **how).collect()}
    assert out[1] == 'T three <b><a href="T4">t four</a></b> and t three'
    rows = [r["response"] for r in as_json(df([(1, None)], "a int, b string")).collect()]
    assert rows == ['{"a":1,"b":null}']
    assert [r["error"] for r in respond(spark, "none", lambda: page).collect()] == ["ValueError: no such task: none"]
    assert respond(spark, "search", lambda: page).where("error is null").count() == page.count()


def test_load_progress(spark, df, tmp_path):
    assert files.progress(spark, str(tmp_path)) == 0
    files.load(df([(1, 2)], "pl_from bigint, pl_to bigint"), "pagelink", f"{tmp_path}/pagelink")
    assert files.progress(spark, str(tmp_path)) == 1 / len(files.RELATIONS)


def test_entry_lists():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert all(any(k.startswith(f"p{n}_") for k in e.queries()) for n in range(1, 5))
