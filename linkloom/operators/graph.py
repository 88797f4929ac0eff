"""Pages, redirects, links and categories as relations: summaries, adjacency, look-ups and depths.

All operators take relations with these columns, whatever else they hold: page (page_id, page_title, page_type),
links (pl_from, pl_to), redirect (rd_from, rd_to), categorylink (cl_parent, cl_child). Null ends are no links.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, drop

ARTICLE, CATEGORY, REDIRECT, DISAMBIGUATION = 1, 2, 3, 4
#: Most rounds of pointer jumping: chains of 2 ** 40 redirects.
ROUNDS = 40


def current_pages(page: DataFrame, born: str, died: str) -> DataFrame:
    """(page_id, page_title, page_type): the last life of each page (by `born`, then title and type)."""
    p = page.where("page_id is not null").select("page_id", "page_title", "page_type", F.col(born).alias("b"), F.col(died).alias("d")).distinct()
    last = F.max_by(F.struct("page_title", "page_type"), F.struct("b", F.coalesce("page_title", F.lit("")), F.coalesce("page_type", F.lit(0))))
    return p.groupBy("page_id").agg(last.alias("x")).select("page_id", "x.page_title", "x.page_type")


def type_name(col: Column) -> Column:
    """The name of a page type, null for others."""
    return F.when(col == ARTICLE, "article").when(col == CATEGORY, "category").when(col == REDIRECT, "redirect").when(col == DISAMBIGUATION, "disambiguation")


def page_stats(page: DataFrame) -> DataFrame:
    """One row: the number of articles, categories, redirects and disambiguations."""
    kinds = {"articles": ARTICLE, "categories": CATEGORY, "redirects": REDIRECT, "disambiguations": DISAMBIGUATION}
    return page.agg(*[F.count_if(F.col("page_type") == k).alias(n) for n, k in kinds.items()])


def links_of(links: DataFrame) -> DataFrame:
    """(f, t): the link occurrences with both ends."""
    return links.select(F.col("pl_from").alias("f"), F.col("pl_to").alias("t")).where("f is not null and t is not null")


def link_counts(page: DataFrame, links: DataFrame) -> DataFrame:
    """(page_id, lc_in, lc_out) of every page; repeated links count each time, pages without links have 0.

    In and out degrees are summed in one shuffle: each link gives two partial counts, merged before it.
    """
    l = links_of(links)
    ends = l.select(F.explode(F.array(F.struct(F.col("t").alias("id"), F.lit(1).alias("i")), F.struct(F.col("f").alias("id"), F.lit(0).alias("i")))).alias("e"))
    n = ends.groupBy("e.id").agg(F.sum("e.i").alias("lc_in"), F.sum(1 - F.col("e.i")).alias("lc_out"))
    return page.select("page_id").join(n.withColumnRenamed("id", "page_id"), "page_id", "left").select("page_id", F.coalesce("lc_in", F.lit(0)).alias("lc_in"), F.coalesce("lc_out", F.lit(0)).alias("lc_out"))


def in_edges(links: DataFrame) -> DataFrame:
    """(id, source): distinct sources of each target, without self links. Rows instead of one list a page, as one page may have most links."""
    return links_of(links).where("f <> t").distinct().select(F.col("t").alias("id"), F.col("f").alias("source"))


def out_edges(links: DataFrame) -> DataFrame:
    """(id, target, lc_in): distinct targets of each source, self links too, with how often the target is linked to."""
    l = links_of(links)
    return l.distinct().join(l.groupBy("t").agg(F.count("*").alias("lc_in")), "t").select(F.col("f").alias("id"), F.col("t").alias("target"), "lc_in")


def in_adjacency(page: DataFrame, links: DataFrame) -> DataFrame:
    """(page_id, sources): the ascending distinct sources of every page, empty for none. A page's list must fit a task; use in_edges where it may not."""
    lists = in_edges(links).groupBy("id").agg(F.sort_array(F.collect_list("source")).alias("sources"))
    return page.select("page_id").join(lists.withColumnRenamed("id", "page_id"), "page_id", "left").select("page_id", F.coalesce("sources", F.array().cast("array<bigint>")).alias("sources"))


def in_chunks(links: DataFrame, width: int = 10_000) -> DataFrame:
    """(page_id, part, sources): the distinct sources of each target in lists by ranges of `width` ids, so that no list is longer, however many links a page has."""
    e = in_edges(links).select(F.col("id").alias("page_id"), F.floor(F.col("source") / width).alias("part"), "source")
    return e.groupBy("page_id", "part").agg(F.sort_array(F.collect_list("source")).alias("sources"))


def out_adjacency(links: DataFrame) -> DataFrame:
    """(page_id, targets): ascending (target, lc_in) of each source."""
    return out_edges(links).groupBy(F.col("id").alias("page_id")).agg(F.sort_array(F.collect_list(F.struct("target", "lc_in"))).alias("targets"))


def valid_pages(page: DataFrame, links: DataFrame, least: int) -> DataFrame:
    """(page_id): pages with at least `least` links in and out, and all categories."""
    n = link_counts(page, links).where((F.col("lc_in") >= least) & (F.col("lc_out") >= least)).select("page_id")
    return n.unionByName(page.where(F.col("page_type") == CATEGORY).select("page_id")).distinct()


def resolve_redirects(redirect: DataFrame) -> DataFrame:
    """(rd_from, rd_to, hops): where each redirect ends; of several targets the smallest counts.

    A ring of redirects has no end: a page on it stays with itself, one that leads to it with the smallest page
    of the ring. Pointers are doubled each round (each page learns its target's target), so chains need a logarithm of
    their length in rounds. A chain has pages of every length up to its own, so a round in which none comes to its end
    leaves none but those that lead to rings; their walks all stand on rings once the number of places they stand on no longer falls.
    """
    first = redirect.where("rd_from is not null and rd_to is not null").groupBy("rd_from").agg(F.min("rd_to").alias("rd_to"))
    cur = cut(first.select(F.col("rd_from").alias("a"), F.col("rd_to").alias("b"), F.lit(1).cast("bigint").alias("hops"), F.lit(True).alias("more")))
    before = (-1, -1)
    for _ in range(ROUNDS):
        nxt = cur.select(F.col("a").alias("b"), F.col("b").alias("b2"), F.col("hops").alias("h2"))
        step = cur.where("more").join(nxt, "b", "left").select("a", F.coalesce("b2", "b").alias("b"), (F.col("hops") + F.coalesce("h2", F.lit(0))).alias("hops"), F.col("b2").isNotNull().alias("more"))
        new = cut(cur.where("not more").unionByName(step))
        drop(cur)
        cur = new
        now = tuple(cur.where("more").agg(F.count("*"), F.count_distinct("b")).first())
        if not now[0] or now == before:
            break
        before = now
    done = cur.where("not more").select("a", "b", "hops")
    if not now[0]:
        return done.select(F.col("a").alias("rd_from"), F.col("b").alias("rd_to"), "hops")
    stuck = cur.where("more").select("a", F.col("b").alias("on"))
    # where the walks stand are all pages of the rings
    ring = _smallest_of_rings(first.select(F.col("rd_from").alias("a"), F.col("rd_to").alias("b")).join(stuck.select(F.col("on").alias("a")).distinct(), "a", "left_semi"))
    self_ = ring.select(F.col("on").alias("a"), F.lit(True).alias("is_on"))
    out = stuck.join(ring, "on").join(self_, "a", "left").select("a", F.when(F.col("is_on"), F.col("a")).otherwise(F.col("smallest")).alias("b"), F.lit(None).cast("bigint").alias("hops"))
    return done.unionByName(out).select(F.col("a").alias("rd_from"), F.col("b").alias("rd_to"), "hops")


def _smallest_of_rings(step: DataFrame) -> DataFrame:
    """(on, smallest) of rings given by each page's next (a, b), by doubling with a running minimum until no minimum changes."""
    cur = cut(step.select("a", "b", F.least("a", "b").alias("low"), F.lit(True).alias("fell")))
    for _ in range(ROUNDS):
        nxt = cur.select(F.col("a").alias("b"), F.col("b").alias("b2"), F.col("low").alias("low2"))
        new = cut(cur.join(nxt, "b").select("a", F.col("b2").alias("b"), F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("fell")))
        drop(cur)
        cur = new
        if cur.where("fell").isEmpty():
            break
    return cur.select(F.col("a").alias("on"), F.col("low").alias("smallest"))


def depths(categorylink: DataFrame, root: int) -> DataFrame:
    """(page_id, depth): fewest links from the root category; unreachable pages are absent, rings do no harm.

    Level by level from the root, so that no more is done than the root's own pages ask for; each level is joined with the links
    and freed of what has been reached, and as many jobs are run as the root has levels.
    """
    spark = categorylink.sparkSession
    c = cut(categorylink.where("cl_parent is not null and cl_child is not null").select("cl_parent", "cl_child").distinct())
    front = spark.createDataFrame([(root, 0)], "page_id bigint, depth int")
    seen, depth = front, 0
    parts = 1
    while True:
        depth += 1
        new = c.join(front.select(F.col("page_id").alias("cl_parent")), "cl_parent", "left_semi").select(F.col("cl_child").alias("page_id")).distinct()
        front = cut(new.join(seen.select("page_id"), "page_id", "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            return seen
        seen, parts = seen.unionByName(front), parts + 1
        if parts == 16:  # a plan of few tables, however deep the root
            seen, parts = cut(seen), 1


def generality(depth: DataFrame) -> DataFrame:
    """(page_id, depth, generality): 1 for the root, 0 for the deepest; the most depth is one aggregate, joined as a number."""
    most = depth.agg(F.max("depth")).first()[0] or 0
    return depth.select("page_id", "depth", F.round(1 - F.col("depth") / F.lit(max(1, most)), 6).alias("generality"))


def redirects_of(page: DataFrame, redirect: DataFrame) -> DataFrame:
    """(page_id, redirect_id, redirect_title): the redirects that point at each page directly."""
    r = redirect.where("rd_to is not null").select("rd_from", "rd_to").distinct()
    return r.join(page.select(F.col("page_id").alias("rd_from"), "page_title"), "rd_from").select(F.col("rd_to").alias("page_id"), F.col("rd_from").alias("redirect_id"), F.col("page_title").alias("redirect_title"))


def parents(page: DataFrame, categorylink: DataFrame) -> DataFrame:
    """(page_id, parent_id, parent_title): the parent categories of each page that have a page."""
    c = categorylink.where("cl_parent is not null and cl_child is not null").select("cl_parent", "cl_child").distinct()
    return c.join(page.select(F.col("page_id").alias("cl_parent"), "page_title"), "cl_parent").select(F.col("cl_child").alias("page_id"), F.col("cl_parent").alias("parent_id"), F.col("page_title").alias("parent_title"))


def children(page: DataFrame, categorylink: DataFrame, page_type: int) -> DataFrame:
    """(category_id, child_id, child_title): the children of a type."""
    c = categorylink.where("cl_parent is not null and cl_child is not null").select("cl_parent", "cl_child").distinct()
    p = page.where(F.col("page_type") == page_type).select(F.col("page_id").alias("cl_child"), "page_title")
    return c.join(p, "cl_child").select(F.col("cl_parent").alias("category_id"), F.col("cl_child").alias("child_id"), F.col("page_title").alias("child_title"))


def contains(categorylink: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of `pairs` (cl_parent, cl_child) that are direct links."""
    return pairs.join(categorylink.select("cl_parent", "cl_child").distinct(), ["cl_parent", "cl_child"], "left_semi")


def equivalents(page: DataFrame, title: Column) -> DataFrame:
    """(category_id, article_id): a category and the article of its title; of several the smallest on either side, first come by id."""
    t = page.select("page_id", "page_type", title.alias("k")).where("k is not null and k <> ''")
    c = t.where(F.col("page_type") == CATEGORY).groupBy("k").agg(F.min("page_id").alias("category_id"))
    a = t.where(F.col("page_type") == ARTICLE).groupBy("k").agg(F.min("page_id").alias("article_id"))
    return c.join(a, "k").select("category_id", "article_id")


def pages_by_title(page: DataFrame, asked: DataFrame) -> DataFrame:
    """(title, page_type, page_id): the page of a title and type, both exact; of several the smallest id. `asked` (title, page_type)."""
    p = page.where("page_title is not null").groupBy(F.col("page_title").alias("title"), "page_type").agg(F.min("page_id").alias("page_id"))
    return asked.select("title", "page_type").distinct().join(p, ["title", "page_type"]).select("title", "page_type", "page_id")


def root_category(page: DataFrame, categorylink: DataFrame, title: str | None = None) -> int | None:
    """The id of the category of that title or, without one, the smallest category that is a parent and nobody's child; None without any."""
    if title is not None:
        named = page.where((F.col("page_type") == CATEGORY) & (F.col("page_title") == title)).agg(F.min("page_id")).first()[0]
        if named is not None:
            return named
    c = categorylink.where("cl_parent is not null and cl_child is not null")
    return c.select(F.col("cl_parent").alias("x")).distinct().join(c.select(F.col("cl_child").alias("x")), "x", "left_anti").agg(F.min("x")).first()[0]


def ranked_links(page: DataFrame, links: DataFrame, *types: int) -> DataFrame:
    """(page_id, sense_id, sense_title, rank): where the pages of the types lead, by how often they link there, then by id: the senses of a disambiguation page, the most obvious first."""
    x = links_of(links).join(page.where(F.col("page_type").isin(*types)).select(F.col("page_id").alias("f")), "f", "left_semi").groupBy("f", "t").agg(F.count("*").alias("n"))
    x = x.join(page.select(F.col("page_id").alias("t"), "page_title"), "t")
    r = F.row_number().over(Window.partitionBy("f").orderBy(F.desc("n"), "t"))
    return x.select(F.col("f").alias("page_id"), F.col("t").alias("sense_id"), F.col("page_title").alias("sense_title"), r.alias("rank"))


def translations(translation: DataFrame) -> DataFrame:
    """(page_id, languages, titles): the languages of each page, ascending, and its title in each as a map, from (tl_id, tl_lang, tl_text)."""
    one = translation.where("tl_id is not null and tl_lang is not null").groupBy("tl_id", "tl_lang").agg(F.min("tl_text").alias("tl_text"))
    g = one.groupBy(F.col("tl_id").alias("page_id")).agg(F.sort_array(F.collect_list(F.struct("tl_lang", "tl_text"))).alias("s"))
    return g.select("page_id", F.transform("s", lambda x: x["tl_lang"]).alias("languages"), F.map_from_entries("s").alias("titles"))


def linked_pages(page: DataFrame, links: DataFrame, incoming: bool) -> DataFrame:
    """(page_id, other_id, other_title): distinct linked articles and disambiguations on the other end."""
    e = links_of(links).distinct()
    me, other = ("t", "f") if incoming else ("f", "t")
    p = page.where(F.col("page_type").isin(ARTICLE, DISAMBIGUATION)).select(F.col("page_id").alias(other), "page_title")
    return e.join(p, other).select(F.col(me).alias("page_id"), F.col(other).alias("other_id"), F.col("page_title").alias("other_title"))


def articles_by_title(page: DataFrame, redirect: DataFrame, titles: DataFrame, title: str) -> DataFrame:
    """(title, article_id) for each distinct title: the article of that name (first letter in upper case), else the end of the redirect of that name."""
    from ..functions.titles import first_upper

    t = titles.select(F.col(title).alias("title")).where("title is not null").distinct().withColumn("page_title", first_upper(F.col("title")))
    a = page.where(F.col("page_type") == ARTICLE).groupBy("page_title").agg(F.min("page_id").alias("direct"))
    r = page.where(F.col("page_type") == REDIRECT).groupBy("page_title").agg(F.min("page_id").alias("rd_from"))
    ends = resolve_redirects(redirect).select("rd_from", F.col("rd_to").alias("via"))
    out = t.join(a, "page_title", "left").join(r.join(ends, "rd_from"), "page_title", "left")
    return out.select("title", F.coalesce("direct", "via").alias("article_id")).where("article_id is not null")


def page_batch(page: DataFrame, after: int, size: int, page_type: int | None = None) -> DataFrame:
    """The next `size` pages beyond an id, in the order of ids: a keyset page of a scan."""
    p = page.where(F.col("page_id") > after)
    return (p if page_type is None else p.where(F.col("page_type") == page_type)).orderBy("page_id").limit(size)


def article_sample(page: DataFrame, links: DataFrame, least_in: int, least_out: int, size: int, seed: int) -> DataFrame:
    """(page_id): a seeded random set of articles with enough links either way; the same for every partitioning."""
    n = link_counts(page.where(F.col("page_type") == ARTICLE), links).where((F.col("lc_in") >= least_in) & (F.col("lc_out") >= least_out))
    return n.orderBy(F.md5(F.concat_ws(":", F.lit(seed), "page_id")), "page_id").limit(size).select("page_id").orderBy("page_id")


def valid_articles(page: DataFrame, links: DataFrame, content: DataFrame, words: tuple[int, int] | None = None, link_share: tuple[float, float] | None = None, list_share: float | None = None) -> DataFrame:
    """(page_id): articles fit for training: no disambiguations or lists by title and, where bounds are given, words, links out by word and list entries by line within them.

    `content` (id, text); with bounds a page without content is not valid. A text without lines or words has shares of 0.
    """
    from ..functions.markup import article_counts

    p = page.where((F.col("page_type") == ARTICLE) & ~F.coalesce(F.lower("page_title").startswith("list"), F.lit(False))).select("page_id")
    if words is None and link_share is None and list_share is None:
        return p

    @F.pandas_udf("struct<lines: int, entries: int, words: int>")
    def counts(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([article_counts(x) for x in s], columns=["lines", "entries", "words"])

    one = content.where("text is not null").groupBy("id").agg(F.min("text").alias("text"))
    n = one.select(F.col("id").alias("page_id"), counts("text").alias("n")).select("page_id", "n.*")
    out = links_of(links).distinct().groupBy(F.col("f").alias("page_id")).agg(F.count("*").alias("out"))
    x = p.join(n, "page_id").join(out, "page_id", "left")
    if words is not None:
        x = x.where(F.col("words").between(*words))
    if link_share is not None:
        x = x.where((F.coalesce("out", F.lit(0)) / F.greatest("words", F.lit(1))).between(*link_share))
    if list_share is not None:
        x = x.where(F.col("entries") / F.greatest("lines", F.lit(1)) <= list_share)
    return x.select("page_id")


def page_offset(page: DataFrame, offset: int, size: int) -> DataFrame:
    """`size` pages after the first `offset`, in the order of ids: a scan by offset; `page_batch` needs no count of what is skipped."""
    return page.orderBy("page_id").offset(offset).limit(size)


def numbered(df: DataFrame, key: str) -> DataFrame:
    """`df` with `number`, from 0 in the order of `key`; repeated keys in any order. Each part counts itself, the parts' sizes (one row a part) are added up."""
    x = df.repartitionByRange(F.col(key)).sortWithinPartitions(key)
    x = cut(x.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    n = x.groupBy("_p").agg(F.count("*").alias("n"))
    before = n.select("_p", (F.sum("n").over(Window.orderBy("_p")) - F.col("n")).alias("_before"))
    return x.join(F.broadcast(before), "_p").withColumn("number", F.col("_before") + F.col("_i")).drop("_p", "_i", "_before")


def round_robin(df: DataFrame, key: str, parts: int) -> DataFrame:
    """`df` with `part`, from 0: rows dealt out in turn in the order of `key`."""
    return numbered(df, key).withColumn("part", (F.col("number") % parts).cast("int")).drop("number")


def common_neighbours(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b, shared) of the distinct pairs (a, b): how many x each has in edges (me, x), and how many both have.

    The page of a pair with fewer neighbours is expanded and its neighbours are looked up, by page and neighbour,
    among the other's: a page with most links is never expanded against a small one, and no key of the second join repeats.
    """
    p = pairs.select("a", "b").where("a is not null and b is not null").distinct()
    n = edges.groupBy("me").agg(F.count("*").alias("n"))
    p = p.join(n.select(F.col("me").alias("a"), F.col("n").alias("n_a")), "a", "left").join(n.select(F.col("me").alias("b"), F.col("n").alias("n_b")), "b", "left")
    few, many = F.when(F.col("n_a") <= F.col("n_b"), F.col("a")).otherwise(F.col("b")), F.when(F.col("n_a") <= F.col("n_b"), F.col("b")).otherwise(F.col("a"))
    q = p.where("n_a is not null and n_b is not null").select("a", "b", few.alias("me"), many.alias("other"))
    both = q.join(edges, "me").select("a", "b", F.col("other").alias("me"), "x").join(edges, ["me", "x"]).groupBy("a", "b").agg(F.count("*").alias("shared"))
    return p.join(both, ["a", "b"], "left").select("a", "b", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_a", "n_b", "shared")])


def shared_links(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b, shared_in, only_a_in, only_b_in, shared_out, only_a_out, only_b_out) of the pairs (a, b)."""
    edges = {
        "in": in_edges(links).select(F.col("id").alias("me"), F.col("source").alias("x")),
        "out": links_of(links).distinct().select(F.col("f").alias("me"), F.col("t").alias("x")),
    }
    out = None
    for name, e in edges.items():
        c = common_neighbours(pairs, e)
        c = c.select("a", "b", F.col("shared").alias(f"shared_{name}"), *[(F.col(f"n_{s}") - F.col("shared")).alias(f"only_{s}_{name}") for s in ("a", "b")])
        out = c if out is None else out.join(c, ["a", "b"])
    return out


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first by `order`: a load that ignores later rows of a key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
