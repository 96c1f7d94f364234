"""The tag graph: neighbours, strong components, closures and cycles.

Edges may run in circles and may point to tags that are not defined yet. A circle is found
as a strong component and from then on is one node, so that no pair of two of its tags is
ever made unless the result asks for it. What is far apart is reached by path doubling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage, steps
from .reads import alive, latest_versions

LEVELS, JOBS = 5, 4  # levels that one job walks, and such jobs before paths are doubled
TRIMS = 12  # rounds of trimming that are made as long as they take anything away


def _edges(cat: dict, down: bool, honour_tombstones: bool = True) -> DataFrame:
    """(src, dst) of live tag edges; dst is not a tag known to be deleted."""
    e = alive(cat["entries"]).where("type = 1")
    e = e.select(F.col("tag_id").alias("src"), F.col("target_id").alias("dst")) if down else e.select(F.col("target_id").alias("src"), F.col("tag_id").alias("dst"))
    if honour_tombstones:
        dead = cat["tags"].where("deleted").select(F.col("id").alias("dst"))
        e = e.join(dead, "dst", "left_anti").select("src", "dst")
    return e.distinct()


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges without those whose ends cannot lie on a circle: nothing comes in at the start
    or goes out at the end. After TRIMS rounds more are made only while they take away a fifth
    of the edges, so that a long chain is left to the colours."""
    edges = stage(edges, "circle-edges")
    n, before, rounds = edges.count(), None, 0
    while n and n != before and (rounds < TRIMS or 5 * (before - n) >= before):
        inner = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        edges = stage(inner.select("src", "dst"), "circle-edges")
        before, n, rounds = n, edges.count(), rounds + 1
    return edges


def _colours(edges: DataFrame, seed: int) -> DataFrame:
    """(node, f, b): of all nodes that reach a node, and of all that it reaches, itself
    included, the one that comes first in a random order.

    First each node follows one edge in and one edge out, and these chains are doubled
    until nothing new is seen: a circle or path of n nodes takes log2 n rounds. Then nodes
    ask all neighbours, and what the first one that they know of knows, until all is known."""
    rank = lambda c: F.struct(F.xxhash64(c, F.lit(seed)).alias("h"), F.col(c).alias("n"))
    ends = edges.select(F.col("src").alias("node"), F.lit(None).cast("string").alias("up"), F.col("dst").alias("down")).union(edges.select(F.col("dst"), F.col("src"), F.lit(None).cast("string")))
    known = ends.groupBy("node").agg(F.coalesce(F.min("up"), "node").alias("up"), F.coalesce(F.min("down"), "node").alias("down"))
    known = stage(known.select("node", "up", "down", rank("node").alias("f"), rank("node").alias("b")), "colours")
    moved = True
    while moved:
        a, z = known.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("f").alias("f2")), known.select(F.col("node").alias("down"), F.col("down").alias("down2"), F.col("b").alias("b2"))
        step = known.join(a, "up").join(z, "down")
        step = stage(step.select("node", F.col("up2").alias("up"), F.col("down2").alias("down"), F.least("f", "f2").alias("f"), F.least("b", "b2").alias("b"), ((F.col("f2") < F.col("f")) | (F.col("b2") < F.col("b"))).alias("moved")), "colours")
        known, moved = step.drop("moved"), not step.where("moved").isEmpty()
    known = known.select("node", "f", "b")
    none = F.lit(None).cast(known.schema["f"].dataType)
    moved = True
    while moved:
        f, b = known.select(F.col("node").alias("at"), "f"), known.select(F.col("node").alias("at"), "b")
        up = edges.select(F.col("dst").alias("node"), F.col("src").alias("at")).union(known.select("node", F.col("f.n")))
        down = edges.select(F.col("src").alias("node"), F.col("dst").alias("at")).union(known.select("node", F.col("b.n")))
        told = up.join(f, "at").select("node", "f", none.alias("b")).union(down.join(b, "at").select("node", none.alias("f"), "b")).union(known.select("node", "f", "b"))
        now = told.groupBy("node").agg(F.min("f").alias("f"), F.min("b").alias("b"))
        before = known.select("node", F.col("f").alias("old_f"), F.col("b").alias("old_b"))
        now = stage(now.join(before, "node").select("node", "f", "b", ((F.col("f") != F.col("old_f")) | (F.col("b") != F.col("old_b"))).alias("moved")), "colours")
        known, moved = now.drop("moved"), not now.where("moved").isEmpty()
    return known


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that lies on a circle of edges(src, dst), an edge to
    itself included; component is its least node.

    Edges that cannot lie on a circle are trimmed. In what is left every node learns the
    first of its ancestors and the first of its descendants in a random order; nodes for
    which both are the same node form its component, and an edge between nodes that differ
    in one of them lies on no circle and goes. The order changes from turn to turn."""
    with steps(edges.sparkSession) as keep:
        edges = stage(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), "circle-edges")
        loops = edges.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("root"))
        left, found, turn = _trimmed(edges.where("src <> dst")), [], 0
        while not left.isEmpty():
            colours = _colours(left, turn)
            found.append(colours.where("f = b").select("node", F.col("f.n").alias("root")))
            open_ = colours.where("f <> b")
            a, z = (open_.select(F.col("node").alias(c), F.col("f").alias(f"f_{c}"), F.col("b").alias(f"b_{c}")) for c in ("src", "dst"))
            same = left.join(a, "src").join(z, "dst").where("f_src = f_dst and b_src = b_dst").select("src", "dst")
            left, turn = _trimmed(same), turn + 1
        members = reduce(DataFrame.unionAll, found, loops.limit(0))
        sizes = members.groupBy("root").agg(F.min("node").alias("component"), F.count("*").alias("n"))
        real = members.join(sizes.where("n > 1"), "root").select("node", "component")
        return keep(real.unionByName(loops.join(real, "node", "left_anti").select("node", F.col("root").alias("component"))), "components")


def paths(edges: DataFrame) -> DataFrame:
    """(src, dst) for all pairs joined by one edge or more, where edges have no circle. Each
    round doubles the length of the paths: a chain of n takes about log2 n rounds."""
    all_ = stage(edges.select("src", "dst").distinct(), "paths")
    n, size = -1, all_.count()
    while n != size:
        longer = all_.select("src", F.col("dst").alias("mid")).join(all_.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst")
        all_ = stage(all_.union(longer).distinct(), "paths")
        n, size = size, all_.count()
    return all_


class Condensed:
    """A graph with each circle as one node: ``of`` tells the component of the nodes on
    circles; any other node is its own. ``edges`` run between components."""

    def __init__(self, edges: DataFrame):
        self.of = strong_components(edges)
        ends = self.into(self.into(edges.select("src", "dst"), "src"), "dst")
        self.edges = stage(ends.where("src <> dst").distinct(), "condensed")

    def into(self, df: DataFrame, col: str) -> DataFrame:
        """df with the component in place of the node in a column."""
        of = self.of.select(F.col("node").alias("_node"), F.col("component").alias("_component"))
        return df.join(of, df[col] == F.col("_node"), "left").withColumn(col, F.coalesce("_component", col)).drop("_node", "_component")

    def members(self, df: DataFrame, col: str) -> DataFrame:
        """df with one row for each node of the component in a column."""
        of = self.of.select(F.col("node").alias("_node"), F.col("component").alias("_component"))
        return df.join(of, df[col] == F.col("_component"), "left").withColumn(col, F.coalesce("_node", col)).drop("_node", "_component")

    def below(self, roots: DataFrame) -> DataFrame:
        """(root, node) for components reachable from components root, by one edge or more."""
        return _reached(self.edges, roots, lambda frontier: _by_paths(self.edges, frontier))


def _by_paths(edges: DataFrame, frontier: DataFrame) -> DataFrame:
    return frontier.join(paths(edges), F.col("node") == F.col("src")).select("root", F.col("dst").alias("node"))


def _reached(edges: DataFrame, roots: DataFrame, far) -> DataFrame:
    """(root, node) by one edge or more: JOBS jobs walk LEVELS levels each from the roots;
    if the last one still found new pairs, ``far(pairs)`` gives all that lies beyond."""
    here = roots.select("root").distinct().withColumn("node", F.col("root"))
    seen = None
    for _ in range(JOBS):
        found = []
        for _ in range(LEVELS):
            here = here.join(edges, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct()
            found.append(here)
        new = reduce(DataFrame.union, found).distinct()
        here = stage(new if seen is None else new.join(seen, ["root", "node"], "left_anti"), "reach")
        seen = here if seen is None else seen.union(here)
        if here.isEmpty():
            return seen
    return seen.union(far(here)).distinct()


def closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node) for every node reachable from each root(root) by one edge or more.

    A shallow graph is walked from the roots. A deep one is condensed, and the paths between
    its components are doubled. The driver only asks whether a step found anything."""
    with steps(edges.sparkSession) as keep:
        edges = stage(edges.select("src", "dst"), "edges")

        def far(frontier: DataFrame) -> DataFrame:
            graph = Condensed(edges)
            own = graph.into(frontier, "node").distinct()
            return graph.members(own.union(_by_paths(graph.edges, own)).distinct(), "node")

        return keep(_reached(edges, roots, far), "closure")


def subtags(cat: dict, roots: DataFrame, transitive: bool = False) -> DataFrame:
    """(root, node) below the tags in roots(root). Roots are not checked themselves."""
    return _walk(_edges(cat, True), roots, transitive)


def parent_tags(cat: dict, roots: DataFrame, transitive: bool = False) -> DataFrame:
    return _walk(_edges(cat, False), roots, transitive)


def _walk(edges: DataFrame, roots: DataFrame, transitive: bool) -> DataFrame:
    if transitive:
        return closure(edges, roots)
    return roots.select("root").distinct().join(edges, F.col("root") == F.col("src")).select("root", F.col("dst").alias("node"))


def tags_of_files(cat: dict, transitive: bool = False) -> DataFrame:
    """(file_id, tag_id): live direct tags, and with transitive all their ancestors. The
    ancestors are found once for each component of tags, not for each file."""
    dead = cat["tags"].where("deleted").select(F.col("id").alias("tag_id"))
    direct = alive(cat["entries"]).where("type = 0").select(F.col("target_id").alias("file_id"), "tag_id").join(dead, "tag_id", "left_anti").select("file_id", "tag_id").distinct()
    if not transitive:
        return direct
    with steps(direct.sparkSession) as keep:
        graph = Condensed(stage(_edges(cat, False), "edges"))
        held = stage(graph.into(direct, "tag_id").distinct(), "held")
        above = graph.below(held.select(F.col("tag_id").alias("root")))
        all_ = held.union(held.join(above, F.col("tag_id") == F.col("root")).select("file_id", F.col("node").alias("tag_id"))).distinct()
        return keep(graph.members(all_, "tag_id"), "tags-of-files")


def files_of_tags(cat: dict, roots: DataFrame, transitive: bool = False) -> DataFrame:
    """(root, file_id). This walk goes through deleted tags; only deleted edges stop it."""
    own = roots.select("root", F.col("root").alias("node")).distinct()
    if transitive:
        own = own.union(closure(_edges(cat, True, False), roots)).distinct()
    files = alive(cat["entries"]).where("type = 0").select(F.col("tag_id").alias("node"), F.col("target_id").alias("file_id"))
    return own.join(files, "node").select("root", "file_id").distinct()


def tag_cycles(cat: dict) -> DataFrame:
    """Tags that reach themselves."""
    return strong_components(_edges(cat, True)).select(F.col("node").alias("tag_id"))


def validate_edges(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad): a tag below itself or a target that is no id is bad."""
    from ..functions.scalars import normalize_id_prefix

    target = normalize_id_prefix("target_id")
    bad = F.coalesce(target.isNull() | (F.length(target) != 32) | ((F.col("type") == 1) & (F.col("tag_id") == F.col("target_id"))), F.lit(True))
    return df.where(~bad), df.where(bad)


def tag_stats(cat: dict) -> DataFrame:
    """Per tag: files and bytes below it, directly and transitively. What lies below a tag is
    counted once for its component, so a circle of many tags costs as much as one tag."""
    tags = cat["tags"].select(F.col("id").alias("root"))
    sizes = latest_versions(cat["versions"].select("file_id", "version_number", "size")).select("file_id", "size")
    with steps(tags.sparkSession) as keep:
        held = stage(alive(cat["entries"]).where("type = 0").select("tag_id", F.col("target_id").alias("file_id")).distinct().join(sizes, "file_id"), "held")

        def totals(files: DataFrame, by: str, name: str) -> DataFrame:
            return files.groupBy(by).agg(F.count("*").alias(f"{name}_files"), F.sum("size").alias(f"{name}_bytes"))

        graph = Condensed(stage(_edges(cat, True, False), "edges"))
        of = stage(graph.into(tags.withColumn("component", F.col("root")), "component"), "tag-components")
        own = graph.into(held, "tag_id").distinct()
        below = graph.below(of.select(F.col("component").alias("root")))
        deep = own.union(below.join(own, F.col("node") == F.col("tag_id")).select("file_id", F.col("root").alias("tag_id"), "size").select(own.columns)).distinct()
        out = of.join(totals(held, "tag_id", "direct"), F.col("root") == F.col("tag_id"), "left").drop("tag_id")
        out = out.join(totals(deep, "tag_id", "transitive"), F.col("component") == F.col("tag_id"), "left")
        return keep(out.select(F.col("root").alias("tag_id"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("direct_files", "direct_bytes", "transitive_files", "transitive_bytes")]), "tag-stats")
