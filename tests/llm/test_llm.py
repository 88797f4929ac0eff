"""Training-data operators against brute force, public libraries and hand-made cases."""

import base64
import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

pytest.importorskip("linkloom.llm.encode")

from linkloom.llm import encode as E
from linkloom.llm import frequency as Q
from linkloom.llm import markup as K
from linkloom.llm import mixture as X
from linkloom.llm import simjoin as S
from linkloom.llm import subjects as J


def rows_of(frame, *cols):
    got = [tuple(r[c] for c in cols) if cols else tuple(r) for r in frame.collect()]
    return sorted(got, key=lambda r: tuple((x is not None, x) for x in r))


# --- markup


def found(s):
    return [(e.kind, e.val) for e in K.elements(s) if e.kind != "text"]


CASES = [
    ("== A ''b'' ==\ntext", [("heading", "A b")]),
    ("===[[x|A]] &amp; B=== <!-- keep -->", [("heading", "A & B")]),
    ("# Title ##\n\ntext", [("heading", "Title")]),
    ("# one\n# two\n##three", [("item", "one"), ("item", "two"), ("item", "three")]),
    ("Title __x__\n=====\n\nOther\n---\n", [("heading", "Title x"), ("heading", "Other")]),
    ("* a<ref>r</ref> b\n** c{{t|{{u}}}}\n*# [https://x.y d]", [("item", "a b"), ("item", "c"), ("item", "d")]),
    ("- a `b`\n- [c](http://d \"e\")\n  + ~~f~~\n\n1) g\n2. h", [("item", "a b"), ("item", "c"), ("item", "f"), ("item", "g"), ("item", "h")]),
    ("Room no. 4 - the smallest - was closed.\n\n----\n\n3 * 4 * 5", []),
    ("\\* not an item", []),
    ("<!-- == Old ==\n* old -->\n{{box\n* hidden\n}}\n<nowiki>* not</nowiki>", []),
    ("<ul>\n<li class='k' title='a > b'>x<br/>y\n<li>z <b>w</b></li></ul>", [("item", "x y"), ("item", "z w")]),
    ("<ol><li>a<ul><li>b</li></ul></li></ol>", [("item", "a"), ("item", "b")]),
    ("<h2\n id='s'>\n <em>A</em>&nbsp;&#8211; b\n</h2>", [("heading", "A – b")]),
    ("<table><tr><td><ul><li>x</ul><h2>y</h2></td></tr></table>", []),
    ("{|\n! h\n|-\n| * x\n|}", []),
    ("<script>'<h2>no</h2>'</script><style>h2 {}</style>", []),
    ("<pre><code class=\"c\">a &lt; b\n== c ==</code></pre>", [("code", "a < b == c ==")]),
    ("<source lang=py>\nx  = 1\n</source>", [("code", "x = 1")]),
    ("```py\n# no\n```\n\n~~~\n* no\n~~~", [("code", "# no"), ("code", "* no")]),
    ("For example:\n\n    a\n      b\n\ntext", [("code", "a b")]),
    ("It has `x` in it.", []),
    ("a <math>x_1</math> b \\(y\\) c $z^2$ d\n\n$$w$$\n\n\\[v\\]", [("formula", x) for x in ("x_1", "y", "z^2", "w", "v")]),
    ("It cost between $5 and $9, or \\$3 (from $12).", []),
    ("\\section*{A \\emph{b}} \\label{s}\n\n\\begin{itemize}\n  \\item \\textbf{c} \\& d\\footnote{e}\n  \\item \\href{u}{f}\n\\end{itemize}", [("heading", "A b"), ("item", "c & d"), ("item", "f")]),
    ("\\begin{verbatim}\n\\item no\n\\end{verbatim}\n\\begin{equation*}x\\end{equation*}\n% \\section{Old}", [("code", "\\item no"), ("formula", "x")]),
    ("**open bold\n\n## `A`", [("heading", "A")]),
    ("[[unfinished link\n\n* a", [("item", "a")]),
    ("```\nopen code\n\n* a", [("code", "open code"), ("item", "a")]),
    ("<!-- open\n\n* a", [("item", "a")]),
    ("the sign == means\n==x", []),
    ("", []),
    ("\r\n* a\r\n* b", [("item", "a"), ("item", "b")]),
    ("file_name_old and a * b * c\n\n* x_1_y", [("item", "x_1_y")]),
]


@pytest.mark.parametrize("text,want", CASES)
def test_elements(text, want):
    assert found(text) == want


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n*#=<>/li[]{}|`$\\-~'&;_h2\ufdd0", max_size=60))
def test_elements_take_any_text(s):
    for e in K.elements(s):
        assert e.val and "\ufdd0" not in e.val and "\x00" not in e.val
    K.render(K.elements(s))


def test_long_text():
    s = "* a\n" * 20_000 + "{{" * 200
    assert len(found(s)) == 20_000


@pytest.mark.parametrize("mark", ["{{x\n\n", "<!-- x\n\n", "<pre>x\n\n", "```\nx\n\n", "`x ", "$x ", "\\(x\n\n", "[[x ", "*a ", "_a ", "<li>x\n", "<a ", "<div>x ", "{|\nx\n\n", "\\section{x\n", "[https://x ", "![a]("])
def test_open_marks_take_one_pass(mark):
    import time

    t = time.perf_counter()
    K.render(K.elements(mark * 40_000))
    assert time.perf_counter() - t < 5


def test_many_marks_without_error():
    for s in ("{{" * 100_000, "[[" * 50_000 + "x" + "]]" * 50_000, "<div>" * 50_000 + "</div>" * 50_000):
        K.elements(s)
    assert found("* [[a|[[b|[[c|[[d|[[e|f]]]]]]]]]]\n* g") == [("item", "f"), ("item", "g")]
    assert found("999. a\n1000. b") == [("item", "a"), ("item", "b")]


def voted(df, rows):
    d = df(rows, "id bigint, content string, model string")
    docs = K.parsed(d.select(F.col("id").alias("k"), F.col("content").alias("c"), F.col("model").alias("h")))
    every = {(r["host"], r["path"], r["kind"]) for r in docs.select(F.col("h").alias("host"), F.explode("items").alias("x")).select("host", "x.path", "x.kind").collect()}
    return every - {(r["host"], r["path"], r["kind"]) for r in K.winning_paths(docs).collect()}


def test_structure(df):
    nav = "<nav class='top1'><a href='x'>Home page</a></nav><ul><li>real <b>{}</b></li></ul>"
    rows = [(i, nav.format(i), "html", 1) for i in range(30)] + [(0, nav.format(0), "html", 1), (90, None, "html", 1), (91, " ", None, 1), (None, "* x", "odd", 1)]
    d = df(rows, "id bigint, content string, model string, seq int")
    assert voted(df, [r[:3] for r in rows if r[1]]) == {("html", "nav.top", "text")}
    got = rows_of(K.structure(d, "id", "content", "model").select("id", "seq", "kind", "val"))
    assert got == [(None, 1, "item", "x")] + [(i, 1, "item", f"real {i}") for i in range(30)]
    assert K.structure(df([], "id bigint, content string, model string"), "id", "content", "model").count() == 0
    text = K.render(K.elements("== A ==\nb ''c''\n\n* d\n* e\n\n<math>f</math>"))
    assert text == "## A\n\nb c\n- d\n- e\n\n$$f$$"
    assert rows_of(K.clean_documents(df([(1, None), (2, ""), (2, "")], "id bigint, c string"), "id", "c")) == [(1, None), (2, ""), (2, "")]


def test_winning_paths_change_rows(df):
    """The same bar is content on a host whose pages write in it, and none on one whose pages only link there."""
    bar = "<div class='bar'>{}</div>\n\n<p class='main'>body of <a href='u'>page</a> {}</p>"
    link, prose = "<a href='z'>Menu</a>", "<a href='z'>Menu</a> and some words of its own"
    rows = [(i, bar.format(link, i), "html") for i in range(10)] + [(20 + i, bar.format(prose if i else link, i), "wikitext") for i in range(10)]
    assert voted(df, rows) == {("html", "div.bar", "text")}
    d = df(rows, "id bigint, content string, model string")
    texts = defaultdict(list)
    for i, v in rows_of(K.structure(d, "id", "content", "model").where("kind = 'text'").select("id", "val")):
        texts[i].append(v)
    assert texts[3] == ["body of page 3"] and texts[20] == ["Menu", "body of page 0"]
    clean = dict(rows_of(K.clean_documents(d, "id", "content", "model")))
    assert clean[3] == "body of page 3" and clean[20] == "Menu\n\nbody of page 0"


def test_vote_keeps_elements_whatever_the_number(df):
    page = "<h2><a href='u'>H</a></h2><ul class='see'><li><a href='x'>A</a><li><a href='y'>B</a></ul>\n\n<div class='bar'><a href='z'>Menu $m$</a></div>\n\nbody"
    for n in (1, 19, 20, 60):
        rows = [(i, page, "html") for i in range(n)]
        d = df(rows, "id bigint, content string, model string")
        assert voted(df, rows) == {("html", "div.bar", "text")}
        s = K.structure(d, "id", "content", "model")
        got = rows_of(s.where("id = 0 and kind <> 'text'").select("seq", "kind", "val"))
        assert got == [(1, "heading", "H"), (2, "item", "A"), (3, "item", "B"), (4, "formula", "m")]
        assert [r["val"] for r in s.where("id = 0 and kind = 'text'").collect()] == ["body"]
        text = K.clean_documents(d, "id", "content", "model").where("id = 0").first()["text"]
        assert text == "## H\n- A\n- B\n\n$$m$$\n\nbody"


def test_elements_take_no_vote(df, monkeypatch):
    """p5_found reports every element by definition, so it takes no vote; the same elements stand in what is voted on."""
    from linkloom.llm import queries

    rows = [(i, f"<nav class='top'><a href='x'>Home</a></nav><ul><li><a href='u'>e {i}</a></ul>\n\n== H ==\nbody $m$\n\n    code", m) for i, m in enumerate(("html", "wikitext", None, "odd"))]
    d = df([*rows, rows[0], (9, None, "html"), (None, "* x", "text")], "co_id bigint, content string, co_model string")
    voted_on = rows_of(K.structure(d, "co_id", "content", "co_model").where("kind <> 'text'").select("co_id", "seq", "kind", "val"))
    monkeypatch.setattr(K, "winning_paths", lambda docs: pytest.fail("a vote that can't change a row"))
    got = rows_of(queries.p5_found(lambda name: d))
    assert got == voted_on == [(None, 1, "item", "x")] + [(i, k, *e) for i in range(4) for k, e in enumerate([("item", f"e {i}"), ("heading", "H"), ("formula", "m"), ("code", "code")], 1)]


LINKS = ["<a href='u'>Home</a>", "[[Main page|Home]]", "[[Home]]", "[Home](u)", "[https://x.y Home]", "[Home][1]", "\\href{u}{\\textbf{Home}}"]


@pytest.mark.parametrize("link", LINKS)
def test_bars_of_any_link_lose(df, link):
    """A bar of links loses in whatever markup they are written; on a host that writes in its bars it is content."""
    page = "<div class='bar'>{}</div>\n\n<p>body of {} page {}</p>"
    rows = [(i, page.format(link, link, i), "wikitext") for i in range(3)] + [(10 + i, page.format(link + " and words" * (i > 0), link, i), "latex") for i in range(3)]
    assert voted(df, rows) == {("wikitext", "div.bar", "text")}
    clean = dict(rows_of(K.clean_documents(df(rows, "id bigint, content string, model string"), "id", "content", "model")))
    assert clean[1] == "body of Home page 1" and clean[10] == "Home\n\nbody of Home page 0"


def test_text_outside_of_containers_stays(df):
    """Where nothing stands in a container there is none to vote on, be it all links."""
    d = df([(i, x, m) for i, (x, m) in enumerate(zip(LINKS[:1] + LINKS[2:4] + LINKS[6:], ("html", "wikitext", "markdown", "latex"), strict=True))], "id bigint, content string, model string")
    assert rows_of(K.clean_documents(d, "id", "content", "model")) == [(i, "Home") for i in range(4)]


def test_link_labels():
    for s, want in [("[[a|b]] [[c [[d|e]] f]] g", ["b", "c e f"]), ("[[open x", []), ("<a href='x'>A [[b]]</a> [[c]]", ["A [[b]]", "c"]), ("[https://x] \\url{http://a} [x](u)", ["http://a", "x"])]:
        assert K.link_labels(s) == want


def test_open_container_ends_with_its_paragraph():
    s = "<nav class='top'><a href='x'>Home</a>\n\nkept\n\n<h2>T</h2>\n\n* e\n\n<math>f</math>"
    got = [(e.kind, e.val, e.path) for e in K.elements(s)]
    assert sorted(got) == [("formula", "f", ""), ("heading", "T", ""), ("item", "e", ""), ("text", "Home", "nav.top"), ("text", "f", ""), ("text", "kept", "")]


# --- frequency


@pytest.mark.parametrize("seed", range(6))
def test_suffix_counts_brute_force(seed):
    """n-grams of any length, of one record and of several, repeated within a record and not."""
    rnd = random.Random(seed)
    docs = [[rnd.randrange(1 + seed) for _ in range(rnd.randrange(12))] for _ in range(60)]
    docs += [docs[3] + docs[4]] * 3 + [[7] * 30, list(range(20)) * 2]
    flat = np.array([t for d in docs for t in d])
    rec = np.array([i for i, d in enumerate(docs) for _ in d])
    weight = np.array([i % 3 for i, d in enumerate(docs) for _ in d])
    occ, recs = Counter(), Counter()
    for i, d in enumerate(docs):
        g = [tuple(d[i : i + n]) for n in range(1, len(d) + 1) for i in range(len(d) - n + 1)]
        for x in g:
            occ[x] += i % 3
        recs.update(set(g))
    for most in (None, 1, 4):
        got = {}
        for n, first, o, r in Q.suffix_counts(flat, rec, weight, most):
            for f, a, b in zip(first, o, r, strict=True):
                got[tuple(flat[f : f + n].tolist())] = (a, b)
        assert got == {k: (occ[k], recs[k]) for k in recs if most is None or len(k) <= most}


def test_suffix_array_is_in_order():
    rnd = np.random.default_rng(1)
    sizes = rnd.integers(0, 40, 200)
    tokens = rnd.integers(0, 3, sizes.sum())
    end = np.repeat(np.cumsum(sizes), sizes)
    order, common = Q.suffix_array(tokens, end)
    suffix = [tuple(tokens[i : end[i]]) for i in order]
    assert suffix == sorted(suffix) and sorted(order) == list(range(len(tokens)))
    for k in range(1, len(suffix)):
        a, b = suffix[k - 1], suffix[k]
        assert common[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_term_counts(df, monkeypatch):
    monkeypatch.setattr(Q, "TOKENS_AT_ONCE", 5)
    d = df([("The the cat1dog", 2), ("the Été", None), (None, 1), ("", 1), ("!!", 1), ("x" * 100_000, 1)], "t string, w int")
    got = {r["term"]: (r["occurrences"], r["records"]) for r in Q.term_counts(d, "t", Q.words).collect()}
    assert got == {"the": (3, 2), "cat": (1, 1), "dog": (1, 1), "été": (1, 1), "x" * 100_000: (1, 1)}
    got = rows_of(Q.term_counts(d.limit(2), "t", Q.whole, weight="w"), "term", "occurrences", "records")
    assert got == [("The the cat1dog", 2, 1), ("the Été", 0, 1)]
    assert Q.term_counts(df([], "t string"), "t", Q.words).count() == 0
    t = df([("a", 2, 1), ("b", 3, 5), ("c", 1, 5)], "term string, occurrences bigint, records bigint")
    assert rows_of(Q.marks(t, 50, 2, 0.1)) == [("a", "rare"), ("b", "common"), ("c", "common"), ("c", "rare")]
    assert rows_of(df([(" A\u00a0 b\t",), ("",), (None,)], "x string").select(Q.folded(F.col("x")))) == [(None,), (None,), ("a b",)]


@pytest.mark.parametrize("seed,chunk", [(1, 50_000), (2, 15)])
def test_repeats_of_any_length(df, monkeypatch, seed, chunk):
    monkeypatch.setattr(Q, "TOKENS_IN_BLOCK", chunk)
    rnd = random.Random(seed)
    line = [rnd.choice("abcdefgh") for _ in range(40)]
    docs = [" ".join(rnd.choice("abcd") for _ in range(rnd.randrange(12))) for _ in range(25)]
    docs += [" ".join(line[: rnd.randrange(20, 41)] + [c]) for c in "xyz"] + [" ".join(line[5:])] * 2 + ["q " * 13]
    occ, recs = Counter(), Counter()
    for d in docs:
        w = d.split()
        g = [" ".join(w[i : i + n]) for n in range(1, len(w) + 1) for i in range(len(w) - n + 1)]
        occ.update(g)
        recs.update(set(g))
    want = sorted((k, occ[k], recs[k]) for k in occ if occ[k] > 2)
    assert max(len(k.split()) for k, *_ in want) > 20
    d = df([(i, x) for i, x in enumerate(docs)] + [(98, None), (99, "")], "id bigint, t string").repartition(3)
    got = Q.repeats(d, ["id"], "t", Q.words).collect()
    spell = lambda r, n: " ".join(docs[r["id"]].split()[r["at"] : r["at"] + n])
    assert sorted((spell(r, n), r["occurrences"], r["records"]) for r in got for n in range(r["n_from"], r["n_to"] + 1)) == want
    assert len(got) <= 2 * sum(len(x.split()) for x in docs)


def test_repeats_spelled(df):
    d = df([(i, "a b c d e f") for i in range(3)] + [(None, "b c"), (4, "!")], "id bigint, t string")
    r = Q.repeats(d, ["id"], "t", Q.words)
    assert rows_of(Q.spelled(r, d, ["id"], "t", Q.words, 5)) == [("a b c d e", 3, 3), ("b c d e f", 3, 3)]
    assert ("b c", 4, 4) in rows_of(Q.spelled(r, d, ["id"], "t", Q.words, 2))
    assert Q.repeats(df([], "id bigint, t string"), ["id"], "t", Q.words).count() == 0


# --- similarity


def brute_pairs(sets, t, least):
    out = set()
    for (a, x), (b, y) in combinations(sorted((k, v) for k, v in sets.items() if len(v) >= least), 2):
        if len(x & y) / len(x | y) >= t:
            out.add((a, b))
    return out


@pytest.mark.parametrize("t,seed", [(0.7, 1), (0.7, 2), (0.5, 3), (0.9, 4)])
def test_similar_sets(df, t, seed):
    rnd = random.Random(seed)
    sets = {}
    for i in range(150):
        if sets and rnd.random() < 0.6:
            s = set(sets[rnd.choice(list(sets))])
            for _ in range(rnd.randrange(5)):
                s.discard(rnd.choice(list(s))) if rnd.random() < 0.5 and len(s) > 1 else s.add(rnd.randrange(300))
        else:
            s = {0, 1} | {rnd.randrange(300) for _ in range(rnd.choice([1, 3, 5, 8, 20, 60]))}
        sets[i] = s
    rows = [(i, k, "x") for i, s in sets.items() for k in s for _ in range(rnd.choice([1, 1, 2]))] + [(None, 1, "x"), (1, None, "x")]
    rnd.shuffle(rows)
    j = S.SimilarSets(df(rows, "r bigint, k bigint, id string"), "r", "k", t, least=5)
    want = brute_pairs(sets, t, 5)
    assert set(rows_of(j.pairs())) == want and j.pairs().count() == len(want)
    classes = {r["id"]: (r["class"], r["copies"]) for r in j.classes().collect()}
    groups = defaultdict(list)
    for i, s in sets.items():
        if len(s) >= 5:
            groups[frozenset(s)].append(i)
    assert classes == {i: (min(g), len(g)) for g in groups.values() for i in g}


def test_similar_sets_edges(df):
    assert S.SimilarSets(df([], "r bigint, k bigint"), "r", "k", 0.7).pairs().count() == 0
    d = df([(i, f"w{k}") for i in (1, 2) for k in range(30_000 + i)], "r bigint, k string")
    assert rows_of(S.SimilarSets(d, "r", "k", 0.7, 5).pairs()) == [(1, 2)]


@pytest.mark.parametrize("crowded", [0, 3])
def test_similar_sets_second_split(df, monkeypatch, crowded):
    """The second split loses nothing: with every shared signature, or with many, split again."""
    monkeypatch.setattr(S, "CROWDED", crowded)
    monkeypatch.setattr(S, "FINDERS_A_CHUNK", 3)
    for t, seed in ((0.7, 1), (0.5, 3)):
        test_similar_sets(df, t, seed)


def test_similar_sets_of_few_tokens_stay_in_proportion(spark):
    """Small sets with nothing in common meet in numbers that grow with their own, not with its square."""
    met = []
    for n in (20_000, 80_000):
        d = spark.range(n).selectExpr("id as r", "explode(sequence(1, 5 + cast(id % 3 as int))) as j").selectExpr("r", f"xxhash64(r, j) % {n * 10} as k")
        met.append(S.SimilarSets(d, "r", "k", 0.7, least=5).met_pairs.count())
    assert met[1] < 5 * max(met[0], n / 10), met


@pytest.mark.parametrize("t,seed", [(0.7, 1), (0.5, 2)])
def test_similar_sets_between_tables(df, t, seed):
    rnd = random.Random(seed)
    tables = [{}, {}]
    for i in range(160):
        old = [s for x in tables for s in x.values()]
        s = set(rnd.choice(old)) if old and rnd.random() < 0.6 else {rnd.randrange(200) for _ in range(rnd.choice([5, 7, 12, 30]))}
        for _ in range(rnd.randrange(4)):
            s.add(rnd.randrange(200))
        tables[i % 2][rnd.choice([1, -1]) * (i // 2)] = s
    a, b = (df([(i, k) for i, s in x.items() for k in s] + [(None, 1), (1, None)], "r bigint, k bigint") for x in tables)
    j = S.SimilarSets(a, "r", "k", t, least=5, other=(b.withColumnRenamed("r", "q"), "q", "k"))
    want = {(x, y) for x, s in tables[0].items() for y, u in tables[1].items() if len(s & u) / len(s | u) >= t}
    got = rows_of(j.pairs())
    assert set(got) == want and len(got) == len(want)
    assert S.SimilarSets(a.limit(0), "r", "k", t, other=(b, "r", "k")).pairs().count() == 0


# --- encoding


TEXTS = ["", "Hello  world\n\n it's  <|endoftext|> é漢字🌍 123", "aaaaaaaaaa bbbb aaa", " \t\u00a0x\u2003y \r\n", "A" * 50_000, "ÀÉ ΣΣ don't'll"]


def test_encoder_matches_public_libraries():
    tokenizers = pytest.importorskip("tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    rnd = random.Random(2)
    texts = TEXTS + ["".join(rnd.choice("abc eTh é\n'.,12漢") for _ in range(200)) for _ in range(50)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        t = tokenizers.Tokenizer.from_file(f"{E.TOKENIZERS}/{name}")
        t.encode_special_tokens = True
        mine = E.PairIndexBPE(f"{E.TOKENIZERS}/{name}")
        got = [[i for w in s for i in mine.kept[w]] for s in mine.encode(texts)]
        assert got == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
    path = f"{E.TOKENIZERS}/byte_bpe_multi_50k.tiktoken"
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    mine = E.PairIndexBPE(path)
    t = tiktoken.Encoding("own", pat_str=E.SPLIT.replace(r"\p{White_Space}", r"\s").replace(r"\P{White_Space}", r"\S"), mergeable_ranks=ranks, special_tokens={})
    assert [[i for w in s for i in mine.kept[w]] for s in mine.encode(texts)] == [t.encode_ordinary(x) for x in texts]
    with pytest.raises(ValueError):
        E.PairIndexBPE(f"{E.TOKENIZERS}/README.md")


def test_piece_encoder_matches_the_public_library():
    sentencepiece = pytest.importorskip("sentencepiece")
    rnd = random.Random(3)
    texts = TEXTS + ["".join(rnd.choice("abc eTh é\n'.,12漢 \u2581🌍") for _ in range(200)) for _ in range(60)] + [" " * n + "x" + " " * n for n in range(1, 70)] + ["<s> <0x0A> </s>", "a" + " " * 5000]
    mine = E.PairIndexBPE(f"{E.TOKENIZERS}/piece_bpe_32k.model")
    t = sentencepiece.SentencePieceProcessor(model_file=f"{E.TOKENIZERS}/piece_bpe_32k.model")
    assert [[i for w in s for i in mine.kept[w]] for s in mine.encode(texts)] == t.encode(texts)


def test_encode_texts(df):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(50, None), (None, "x"), (1, TEXTS[1])]
    d = df(rows, "ids bigint, text string")
    out = E.encode_texts(d.withColumnRenamed("ids", "k"), "k", "text")
    got = {r["k"]: list(r["ids"]) for r in out.collect()}
    assert out.count() == len(rows) and got[0] == [] and got[50] == [] and got[None]
    import json

    vocab = {v: k for k, v in json.load(open(f"{E.TOKENIZERS}/byte_bpe_50k.json"))["model"]["vocab"].items()}
    back = {c: b for b, c in enumerate(E._byte_letters())}
    for i, t in enumerate(TEXTS):  # exact round trip
        assert bytes(back[c] for x in got[i] for c in vocab[x]).decode() == t
    n = {r["k"]: r["n_tokens"] for r in E.encode_texts(d.withColumnRenamed("ids", "k"), "k", "text", counts_only=True).collect()}
    assert n == {k: len(v) for k, v in got.items()}
    assert E.encode_texts(df([], "k bigint, t string"), "k", "t").count() == 0


# --- mixture


def mix(df, docs, targets, **kw):
    d = df([(i, s, t, "x") for i, (s, t) in enumerate(docs)], "doc_id bigint, src string, txt string, n_tokens string")
    return X.Mixture(d, "doc_id", "txt", "src", df(targets, "s string, w double, r int"), "s", "w", "r", **kw)


def test_mixture(df):
    rnd = random.Random(1)
    docs = [(rnd.choice(["Big-One", "big_one ", "BIG ONE"]), f"word {rnd.random()} and more {rnd.random()}") for _ in range(300)]
    docs += [("small", f"tiny text {i} {rnd.random()}") for i in range(20)] + [("small", "tiny text again"), ("small", "tiny text again"), ("other", "x y"), ("small", ""), ("small", None), (None, "z")]
    m = mix(df, docs, [("big one", 0.6, 1), ("SMALL", 0.3, 3), ("absent", 0.1, 2), (None, 0.5, 1)])
    shares = {r["source"]: r for r in m.shares().collect()}
    assert set(shares) == {"big_one", "small", "absent"} and shares["absent"]["reached"] == 0
    assert shares["big_one"]["reached"] == pytest.approx(2 / 3, abs=0.01) and shares["small"]["reached"] == pytest.approx(1 / 3, abs=0.01)
    draws = m.draws().collect()
    assert [r["position"] for r in draws] == sorted(r["position"] for r in draws) and all(0 <= r["position"] <= 1 for r in draws)
    used = Counter((r["source"], r["doc_id"]) for r in draws)
    assert max(n for (s, _), n in used.items() if s == "small") == 3 and max(n for (s, _), n in used.items() if s == "big_one") == 1
    assert shares["small"]["texts"] == 21  # the text that stands twice counts once
    half = [r for r in draws if r["position"] < 0.5]
    assert sum(r["n_tokens"] for r in half if r["source"] == "small") / sum(r["n_tokens"] for r in half) == pytest.approx(1 / 3, abs=0.03)


def test_mixture_over_and_empty(df):
    docs = [("a", f"text {i}") for i in range(10)] + [("b", f"words {i}") for i in range(100)]
    m = mix(df, docs, [("a", 0.5, 2), ("b", 0.5, 1)], total=200)
    s = {r["source"]: r for r in m.shares().collect()}
    assert s["a"]["draws"] == 20 and s["a"]["reached"] < 0.5 and s["b"]["draws"] <= 100
    assert mix(df, [], [("a", 1.0, 1)]).draws().count() == 0
    assert mix(df, docs, []).draws().count() == 0
    assert mix(df, docs, [("a", None, 1), ("b", 0.5, None)]).draws().count() == 0


def test_curriculum(df):
    knots = X.ramp({"a": 0.4}, {"a"})["a"]
    t = X.invert(knots, np.array([0, 0.1, 0.4]))
    assert t[0] == 0 and t[2] == pytest.approx(1) and X.cumulative(knots)[2][-1] == pytest.approx(0.4)
    grid = np.linspace(0, 1, 1001)
    w = np.interp(grid, *zip(*knots, strict=True))
    assert np.interp(t[1], grid, np.concatenate(([0], np.cumsum((w[1:] + w[:-1]) / 2 * 0.001)))) == pytest.approx(0.1, abs=1e-6)
    docs = [(s, f"{s} text {i} of some length") for s in "ab" for i in range(200)]
    m = mix(df, docs, [("a", 0.5, 1), ("b", 0.5, 1)])
    m.schedules = X.ramp({"a": 0.5, "b": 0.5}, {"a"})
    first = [r for r in m.draws().collect() if r["position"] < 0.5]
    assert sum(r["source"] == "a" for r in first) / len(first) == pytest.approx(0.625, abs=0.03)


def test_amounts_follow_schedules(df):
    docs = [(s, f"{s} text {i} of some length") for s in "ab" for i in range(200)]
    knots = {"a": [(0.0, 0.9), (1.0, 0.6)]}  # an integral of 0.75, where the target says 0.5
    for m in (mix(df, docs, [("a", 0.5, 1), ("b", 0.25, 1)], schedules=knots), mix(df, docs, [("a", 0.5, 1), ("b", 0.25, 1)])):
        m.schedules = knots
        s = {r["source"]: r for r in m.shares().collect()}
        assert s["a"]["reached"] == pytest.approx(0.75, abs=0.01) and s["a"]["wanted"] == pytest.approx(0.75)
        assert s["a"]["used"] == pytest.approx(1, abs=0.01) and s["b"]["used"] == pytest.approx(1 / 3, abs=0.01)


# --- subjects


def test_subjects_held_out(df):
    rnd = random.Random(6)
    words = {s: [f"{s}term{i}" for i in range(12)] for s in ("law", "sport", "nature")}
    filler = ["It was renamed.", "A list follows.", "The name is old."]

    def text(subjects, passing=None):
        out = [f"The {rnd.choice(words[s])} met a {rnd.choice(words[s])} there." for s in subjects for _ in range(rnd.randrange(4, 8))] + rnd.choices(filler, k=3)
        if passing:
            out.append(f"One {rnd.choice(words[passing])} was seen.")
        rnd.shuffle(out)
        return "\n".join(" ".join(out[i : i + 3]) for i in range(0, len(out), 3))

    docs, truth = [], {}
    for i in range(400):
        s = rnd.sample(list(words), 2 if rnd.random() < 0.2 else 1)
        p = rnd.choice([x for x in words if x not in s])
        docs.append((i, text(s, p if rnd.random() < 0.3 else None), i % 40, rnd.choice(["A-b", "a_b", None]), "x"))
        truth[i] = set(s)
    docs += [(900, None, 1, "a", "x"), (901, " \n", None, "a", "x"), (902, " ".join(filler), 1, "a", "x"), (None, text(["law"]), 1, "a", "x")]
    labels = [(i, f" {s.upper()}" if i % 7 == 0 else s) for i in range(200) for s in truth[i]] + [(3, None), (4, "no such"), (5, "law") if "law" in truth[5] else (6, None)]
    labels += [(i, "law") for i in (11, 12)]  # readers err
    d = df(docs, "doc_id bigint, text string, page bigint, src string, subject string")
    sub = df([("law",), ("sport",), ("nature",)], "s string")
    got = defaultdict(set)
    for i, s in rows_of(J.assign_subjects(d, "doc_id", "text", "page", "src", df(labels, "d bigint, l string"), "d", "l", sub, "s"), "doc_id", "subject"):
        got[i].add(s)
    held = range(200, 400)
    assert sum(got[i] == truth[i] for i in held) / len(held) > 0.95
    assert not {900, 901, 902, None} & {k for k, v in got.items() if v}
    none = J.assign_subjects(d, "doc_id", "text", "page", "src", df([], "d bigint, l string"), "d", "l", sub, "s")
    assert none.count() == 0
    assert J.assign_subjects(d.limit(0), "doc_id", "text", "page", "src", df(labels, "d bigint, l string"), "d", "l", sub, "s").count() == 0


def test_queries_on_smallest_tables(spark):
    from linkloom.llm.queries import R

    empty = {name for name, q in R.queries.items() if not q(spark, "/root/testdata/sf0.001").count()}
    assert empty <= {"p7_found", "p10_found", "p10_composition"}  # few sources and labels there
    for name in ("p7_found", "p10_found"):
        assert R.queries[name](spark, "/root/testdata/sf0.01").count() > 0
