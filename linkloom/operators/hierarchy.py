"""Parent-child links to full hierarchies: descendants, depths, roots, paths and rings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, drop

#: Peeling goes on while a level takes at least this part of the parents left; 0 peels to the end.
LEAST_SHARE = 0.1
#: Most rounds of doubling: chains of 2 ** 40 links.
ROUNDS = 40


class Hierarchy:
    """What `hierarchy` found; each part is made when it is asked for.

    `edges` (p, c): the distinct links. `low`: the descendant lists of the peeled nodes, `spine`: the closure among the nodes left,
    `hang`: the links from those to peeled nodes and leaves; all as rows (a, b, depth[, path]).
    """

    def __init__(self, edges: DataFrame, low: DataFrame, spine: DataFrame, hang: DataFrame) -> None:
        self.edges, self.low, self.spine, self.hang = edges, low, spine, hang
        self._closure: DataFrame | None = None

    def lists(self, of: DataFrame | None = None) -> DataFrame:
        """(a, b, depth[, path]): a reaches b by `depth` >= 1 links at least, a = b on a ring; for the nodes `of` (a) only, if given.

        The reverse of the peeling: what the spine reaches, what hangs below that, and the lists of the peeled nodes there.
        """
        only = (lambda df: df.join(of, "a", "left_semi")) if of is not None else (lambda df: df)
        closed, own = only(self.spine), only(self.hang)
        under = own.unionByName(_then(closed, self.hang))
        parts = closed.unionByName(under).unionByName(_then(_shortest(under), self.low))
        return _shortest(parts).unionByName(only(self.low))

    @property
    def closure(self) -> DataFrame:
        """The lists of all nodes."""
        if self._closure is None:
            self._closure = cut(self.lists())
        return self._closure

    @property
    def sizes(self) -> DataFrame:
        """(node, size): the descendants of every node, itself included, counted from the lists."""
        nodes = self.edges.select(F.col("p").alias("node")).union(self.edges.select("c")).distinct()
        below = self.closure.where("a <> b").groupBy(F.col("a").alias("node")).agg(F.count("*").alias("n"))
        return nodes.join(below, "node", "left").select("node", (F.coalesce("n", F.lit(0)) + 1).alias("size"))

    def roots(self) -> DataFrame:
        """(root): nodes that are a parent in some link and a child in none."""
        return self.edges.select(F.col("p").alias("root")).distinct().join(self.edges.select(F.col("c").alias("root")), "root", "left_anti")

    def under_roots(self) -> DataFrame:
        """(root_id, node_id, depth[, path]) for each root and each node it reaches, itself at depth 0."""
        r = cut(self.roots())
        down = self.lists(r.select(F.col("root").alias("a"))) if self._closure is None else self._closure.join(r.withColumnRenamed("root", "a"), "a", "left_semi")
        path = ["path"] if "path" in down.columns else []
        if path:
            down = down.withColumn("path", F.concat(F.array("a"), F.col("path")))
            r = r.withColumn("path", F.array("root"))
        down = down.select(F.col("a").alias("root_id"), F.col("b").alias("node_id"), "depth", *path)
        own = r.select(F.col("root").alias("root_id"), F.col("root").alias("node_id"), F.lit(0).alias("depth"), *path)
        return down.unionByName(own)

    def rings(self) -> DataFrame:
        """(ring, node): the nodes that can reach themselves, and the smallest node of their ring (strong component). They are never peeled."""
        on = self.spine.where("a = b").select(F.col("a").alias("x"))
        c = self.spine.select("a", "b").join(on.withColumnRenamed("x", "a"), "a", "left_semi").join(on.withColumnRenamed("x", "b"), "b", "left_semi")
        back = c.select(F.col("b").alias("a"), F.col("a").alias("b"))
        both = c.join(back, ["a", "b"], "left_semi")
        return both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("ring")).select("ring", "node")


def _shortest(df: DataFrame) -> DataFrame:
    """One row for each (a, b): the least depth and, with paths, the path of smallest ids among those."""
    if "path" in df.columns:
        return df.groupBy("a", "b").agg(F.min(F.struct("depth", "path")).alias("m")).select("a", "b", "m.depth", "m.path")
    return df.groupBy("a", "b").agg(F.min("depth").alias("depth"))


def _then(up: DataFrame, down: DataFrame) -> DataFrame:
    """a -> m (up) and m -> b (down) as a -> b."""
    path = "path" in up.columns
    d = down.select(F.col("a").alias("m"), F.col("b").alias("b2"), F.col("depth").alias("d2"), *([F.col("path").alias("p2")] if path else []))
    x = up.join(d, up["b"] == d["m"])
    return x.select("a", F.col("b2").alias("b"), (F.col("depth") + F.col("d2")).alias("depth"), *([F.concat("path", "p2").alias("path")] if path else []))


def hierarchy(links: DataFrame, parent: str, child: str, paths: bool = False, least_share: float = LEAST_SHARE) -> Hierarchy:
    """The full hierarchy of `links`; unknown depth, several parents and rings are allowed.

    Rows with a null end are no links, identical links count once, any id is a node, a self link is a ring of
    one. An empty table gives an empty hierarchy. Only the two columns are read.

    Leaves are peeled bottom-up, level by level: a node all of whose children are peeled takes their descendant
    lists, one link longer, as (node, descendant) rows, never as one array, so a parent of a third of all rows
    is spread over the tasks. Once a level takes less than `least_share` of the parents left, what is left is a thin deep spine and
    everything that can reach a ring; peeling it one level a job would take as many jobs as its longest chain, so it is closed
    by doubling instead (reach by up to 2^k links joined with itself at exactly 2^k), in a logarithm of the
    depth. Nodes peeled are then put under the spine in reverse order. With `paths`, the path of a row is that of fewest links and,
    among those, of smallest ids.
    """
    e = cut(links.select(F.col(parent).cast("bigint").alias("p"), F.col(child).cast("bigint").alias("c")).where("p is not null and c is not null").distinct())

    def link(df: DataFrame) -> DataFrame:
        """Rows p, c as reach by one link."""
        x = df.select(F.col("p").alias("a"), F.col("c").alias("b"), F.lit(1).alias("depth"))
        return x.withColumn("path", F.array("b")) if paths else x

    # peeling: `left` are links among nodes not yet peeled on the parent side; `lists` the rows of the peeled
    left, levels = e, []
    n_left = e.select("p").distinct().count()
    while n_left:
        # nodes all of whose children have been peeled: their children occur as no parent in `left`
        open_parents = left.select(F.col("p").alias("x")).distinct()
        blocked = left.join(open_parents.withColumnRenamed("x", "c"), "c", "left_semi").select("p").distinct()
        ready = cut(open_parents.withColumnRenamed("x", "p").join(blocked, "p", "left_anti"))
        n = ready.count()
        if not n or n < least_share * n_left:
            drop(ready)
            break
        n_left -= n
        mine = left.join(ready, "p", "left_semi")
        one = link(mine)
        lists = one
        if levels:
            below = levels[0]
            for x in levels[1:]:
                below = below.unionByName(x)
            lists = one.unionByName(_then(one, below))
        levels.append(cut(_shortest(lists)))
        nxt = cut(left.join(ready, "p", "left_anti"))
        if left is not e:
            drop(left)
        left = nxt
    low = levels[0] if levels else link(e).limit(0)
    for x in levels[1:]:
        low = low.unionByName(x)
    # the spine: links between nodes that are still parents; the other links of theirs lead to peeled nodes or leaves
    spine_nodes = left.select(F.col("p").alias("c")).distinct()
    spine = link(left.join(spine_nodes, "c", "left_semi"))
    closed = cut(_shortest(spine))
    reach = 1
    for _ in range(ROUNDS):
        edge = closed.where(F.col("depth") == reach)
        if edge.isEmpty():
            break
        longer = _then(edge, closed)
        nxt = cut(_shortest(closed.unionByName(longer)))
        drop(closed)
        closed, reach = nxt, reach * 2
    return Hierarchy(e, low, closed, link(left.join(spine_nodes, "c", "left_anti")))
