"""References, frequent keys, packed fields and hierarchies: edge cases and brute force."""

import random
from collections import Counter, defaultdict
from datetime import datetime

import pytest
from conftest import rows_of
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from linkloom.operators import skew
from linkloom.operators import unpack as U
from linkloom.operators.hierarchy import hierarchy
from linkloom.operators.hotkeys import dense_accumulate, frequent_keys, target_profiles
from linkloom.operators.references import Ref, orphan_counts, orphan_references

LINK = "s bigint, t bigint, at timestamp_ntz, tab string"
PAGE = "id bigint, born timestamp_ntz, died timestamp_ntz, to_id bigint"
day = lambda n: datetime(2022, 1 + n // 28, 1 + n % 28)


def orphans(df, refs, pages):
    r = Ref("x", df(refs, LINK), "s", "t", "at")
    return rows_of(orphan_references([r], df(pages, PAGE), "id", "born", "died").select("period", "from_id", "to_id"))


def test_orphans_lives_and_nulls(df):
    pages = [(1, day(0), None, 9), (2, day(10), day(20), 9), (2, day(30), None, 9), (2, day(30), None, 9), (3, None, None, 9), (None, day(0), None, 9)]
    refs = [(7, 1, day(5), "c"), (7, 2, day(10), "c"), (7, 2, day(20), "c"), (7, 2, day(35), "c"), (7, 3, day(5), "c"), (7, 4, day(5), "c"), (7, None, day(5), "c"), (None, 4, day(5), "c"), (8, 1, None, "c")]
    assert orphans(df, refs, pages) == [(None, 8, 1), ("2022-01", None, 4), ("2022-01", 7, 2), ("2022-01", 7, 3), ("2022-01", 7, 4)]


def test_orphans_empty_tables(df):
    assert orphans(df, [], [(1, day(0), None, 9)]) == []
    assert orphans(df, [(1, 2, day(1), "c")], []) == [("2022-01", 1, 2)]


def test_orphans_keep_repeats_and_count(df):
    r = Ref("x", df([(1, 5, day(1), "c")] * 3 + [(1, 6, day(1), "c")], LINK), "s", "t", "at")
    p = df([(6, day(0), None, 0)], PAGE)
    assert orphan_references([r], p, "id", "born", "died").count() == 3
    assert rows_of(orphan_counts([r], p, "id", "born", "died")) == [("x", "2022-01", 4, 3, 1)]


def test_orphans_against_brute_force_with_split_keys(df, monkeypatch):
    monkeypatch.setattr(skew.heavy_keys, "__defaults__", (20,))
    rnd = random.Random(5)
    pages = [(rnd.randrange(12), day(rnd.randrange(60)), None if rnd.random() < 0.4 else day(60 + rnd.randrange(60)), 0) for _ in range(14)]
    refs = [(rnd.randrange(50), 3 if rnd.random() < 0.5 else rnd.randrange(14), day(rnd.randrange(150)), "c") for _ in range(800)]
    want = sorted((f"{a:%Y-%m}", s, t) for s, t, a, _ in refs if not any(i == t and b <= a and (d is None or a < d) for i, b, d, _ in pages))
    assert orphans(df, refs, pages) == want


def test_dense_accumulate(df, monkeypatch):
    import linkloom.operators.hotkeys as H

    monkeypatch.setattr(H, "KEYS_A_BLOCK", 3)
    rnd = random.Random(1)
    rows = [(None if rnd.random() < 0.1 else 7 if rnd.random() < 0.4 else rnd.randrange(-5, 30), None if rnd.random() < 0.3 else rnd.randrange(100), "z") for _ in range(3000)]
    rows.append((99, None, "z"))
    m = {"n": ("count", None), "total": ("sum", "v"), "low": ("min", "v"), "high": ("max", "v")}
    got = rows_of(dense_accumulate(df(rows, "k int, v int, n string"), "k", m), "k", "n", "total", "low", "high")
    by = defaultdict(list)
    for k, v, _ in rows:
        if k is not None:
            by[k].append(v)
    some = {k: [v for v in vs if v is not None] for k, vs in by.items()}
    assert got == sorted((k, len(vs), sum(some[k]) if some[k] else None, min(some[k], default=None), max(some[k], default=None)) for k, vs in by.items())


def test_dense_accumulate_strings_and_empty(df):
    d = df([("a",), ("b",), ("a",), ("",), (None,), ("x" * 100_000,)], "k string")
    assert Counter(dict(rows_of(dense_accumulate(d, "k", {"n": ("count", None)})))) == Counter({"a": 2, "b": 1, "": 1, "x" * 100_000: 1})
    assert dense_accumulate(df([], "k bigint"), "k", {"n": ("count", None)}).count() == 0


def test_frequent_keys_ties(df):
    d = df([(1,)] * 5 + [(2,)] * 5 + [(3,)] * 4 + [(None,)] * 50, "k bigint")
    assert rows_of(frequent_keys(d, "k", 5 / 14, 5)) == [(1, 5, 14), (2, 5, 14)]
    assert rows_of(frequent_keys(d, "k", 0.9, 1)) == []


def test_target_profiles(df):
    l = df([(1, 2), (1, 2), (3, 2), (None, 2), (1, None), (1, 4)], "a bigint, b bigint")
    r = df([(9, 2), (8, 7), (8, 7), (8, None)], "a bigint, b bigint")
    assert rows_of(target_profiles(l, "a", "b", r, "a", "b")) == [(2, 4, 2, 1), (4, 1, 1, 0), (7, 0, 0, 2)]


FIELDS = [
    ("1:2:3", ["1", "2", "3"]),
    ("1, 2;3|4/5\t6\n7 8", list("12345678")),
    ('"Treaty of X, 1593":5', ["Treaty of X, 1593", "5"]),
    ('" 12 ";7', ["12", "7"]),
    ('"Y\'s ""abbey"""|3', ["Y's \"abbey\"", "3"]),
    ('1 "Y\'s \\"abbey\\"" 2', ["1", "Y's \"abbey\"", "2"]),
    (";;1;;2;", ["1", "2"]),
    ("1：2；3", ["1", "2", "3"]),
    ("Foo_(ship):9", ["Foo_(ship)", "9"]),
    ("A: b c:7", ["A: b c", "7"]),  # a known whole value without quotes
    ("7:A: b c", ["7", "A: b c"]),
    ('"":1', ["1"]),
    ('"open:1', ['"open', "1"]),
    ("   ", []),
    ("", []),
]


def test_unpack(df):
    d = df([(i, s, "x") for i, (s, _) in enumerate(FIELDS)] + [(0, "1:2:3", "y"), (50, None, "x"), (None, "5", "x")], "li bigint, data string, pos string")
    words = df([("A: b c",), (" A: b c ",), (None,), ("Foo (ship)",), ("12",), ("",)], "t string")
    got = defaultdict(list)
    for k, p, v in rows_of(U.unpack(d, "li", "data", words, "t")):
        got[k].append((p, v))
    assert got.pop(None) == [(1, "5")]
    assert {i: [v for _, v in x] for i, x in got.items()} == {i: v for i, (_, v) in enumerate(FIELDS) if v}
    assert all([p for p, _ in x] == list(range(1, len(x) + 1)) for x in got.values())


def test_unpack_titles_that_begin_with_a_number(df):
    words = df([("2001: A Space Odyssey",), ("100 metres",), ("3:4",)], "t string")
    d = df([(1, "7:2001: A Space Odyssey|8"), (2, "5 100 metres"), (3, "100:12"), (4, "3:4 x")], "li bigint, data string")
    got = rows_of(U.unpack(d, "li", "data", words, "t"))
    want = {1: ["7", "2001: A Space Odyssey", "8"], 2: ["5", "100 metres"], 3: ["100", "12"], 4: ["3", "4", "x"]}
    assert got == [(k, p, v) for k, x in want.items() for p, v in enumerate(x, 1)]


def test_unpack_empty_and_long(df):
    words = df([], "t string")
    assert U.unpack(df([], "li bigint, data string"), "li", "data", words, "t").count() == 0
    long = ":".join(map(str, range(50_000)))
    assert U.unpack(df([(1, long)], "li bigint, data string"), "li", "data", words, "t").agg({"pos": "max"}).first()[0] == 50_000


@settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet='ab1 ":;,|/\\\'', min_size=1, max_size=8).map(str.strip).filter(bool), min_size=1, max_size=6), st.sampled_from([":", ", ", " | ", "\t"]))
def test_unpack_round_trip(values, delimiter):
    values = [v for v in values if not v.endswith("\\") and '\\"' not in v and "\\" not in v]
    packed = delimiter.join('"' + v.replace('"', '""') + '"' for v in values)
    cutter = U._cutter(U.DELIMITERS)
    assert U.segment(packed, U.pieces(packed, cutter), None)[0] == values


def brute_hierarchy(edges):
    e = {(a, b) for a, b in edges if a is not None and b is not None}
    ch = defaultdict(set)
    for a, b in e:
        ch[a].add(b)
    reach = {}
    for n in {x for p in e for x in p}:
        dist, front = {}, {n}
        d = 0
        while front:
            d += 1
            front = {y for x in front for y in ch[x]} - dist.keys()
            dist.update(dict.fromkeys(front, d))
        reach[n] = dist
    return e, reach


def check_hierarchy(df, edges, **kw):
    h = hierarchy(df([(a, b, "x") for a, b in edges], "p bigint, c bigint, depth string"), "p", "c", **kw)
    e, reach = brute_hierarchy(edges)
    assert rows_of(h.closure, "a", "b", "depth") == sorted((a, b, d) for a, r in reach.items() for b, d in r.items())
    roots = {a for a, _ in e} - {b for _, b in e}
    assert rows_of(h.under_roots(), "root_id", "node_id", "depth") == sorted([(r, r, 0) for r in roots] + [(r, b, d) for r in roots for b, d in reach[r].items()])
    want = sorted((min(b for b in reach[a] if a in reach[b]), a) for a in reach if a in reach[a])
    assert rows_of(h.rings()) == want
    return h


@pytest.mark.parametrize(
    "edges",
    [
        [],
        [(None, 1), (1, None)],
        [(1, 2), (1, 2), (2, 3), (1, 3)],
        [(1, 1)],
        [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (5, 2)],
        [(9, 1), (1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (5, 6)],
        [(i, i + 1) for i in range(40)] + [(20, 100 + i) for i in range(30)],
    ],
)
def test_hierarchy_shapes(df, edges):
    check_hierarchy(df, edges, least_share=0.3)


def test_hierarchy_random(df):
    rnd = random.Random(3)
    check_hierarchy(df, [(rnd.randrange(40), rnd.randrange(40)) for _ in range(45)], least_share=0.2)
    check_hierarchy(df, [(rnd.randrange(40), rnd.randrange(40)) for _ in range(45)], least_share=0)


def test_hierarchy_paths(df):
    h = check_hierarchy(df, [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (5, 6), (6, 5)], paths=True, least_share=0.5)
    path = {(r["root_id"], r["node_id"]): list(r["path"]) for r in h.under_roots().collect()}
    assert path[1, 1] == [1] and path[1, 4] == [1, 2, 4] and path[1, 6] == [1, 2, 4, 5, 6]


def test_hierarchy_sizes_of_all_nodes(df):
    edges = [(i, i + 1) for i in range(9)] + [(20, 21), (21, 20), (21, 9)]  # a chain deeper than the peeled levels, and a ring
    h = hierarchy(df(edges, "p bigint, c bigint"), "p", "c", least_share=0.2)
    assert rows_of(h.sizes, "node", "size") == [(i, 10 - i) for i in range(10)] + [(20, 3), (21, 3)]


def test_dense_accumulate_many_small_splits(spark, monkeypatch):
    """No task merges more than FAN_IN pieces of a block, however many splits there are."""
    import linkloom.operators.hotkeys as H

    monkeypatch.setattr(H, "FAN_IN", 8)
    monkeypatch.setattr(H, "KEYS_A_BLOCK", 50)
    d = spark.range(0, 3000, 1, 600).selectExpr("id % 101 as k")
    out = dense_accumulate(d, "k", {"n": ("count", None)})
    assert sorted(out.agg({"n": "sum", "k": "count"}).first()) == [101, 3000]
    # 600 splits, 8 at once: 75, 10, 2, 1
    assert out._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInArrow") == 4


def test_unpack_cover_decides(df):
    words = df([("A: b c",), ("7",), ("x;y",)], "t string")
    d = df([(1, "7:A: b c|8|x;y"), (2, "9 9")], "li bigint, data string")
    got = rows_of(U.cover(d, "li", "data", words, "t"), "li", "vals", "known", "together")
    assert got == [(1, ["7", "A: b c", "8", "x;y"], 3, 2), (2, ["9", "9"], 0, 0)]
