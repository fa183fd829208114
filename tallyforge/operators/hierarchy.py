"""Parent-child links of unknown depth: roots, depths, paths, descendants and loops.

Everything is level-wise joins over ``hierarchy, parent, child`` links. Children of one
parent are spread over chunks of at most about ``CHUNK`` links, and a frontier row joins
chunk by chunk, so a parent with a third of all links never lands in one task.

Roots, depths and loops first fold chains of single-parent nodes (pointer doubling), so that a
level of the frontier is a joint, a node with several parents, and not a link: a tree of any depth takes a
logarithmic number of joins, a mesh one per level. Nodes that no fold ends at are on or below a loop
without joints; loops through joints are the repeated nodes of a frontier among those that frontiers from both ends leave
unreached. Paths and descendants keep all levels; there pairs a few links apart are joined
beforehand where that stays small. The rows of each join are written to the shared folder, which cuts lineage.

Nulls and self links make no link; repeated links count once; an empty table gives an
empty result. Extra columns of the inputs are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import double_slash
from ..runtime import Stash, join_spread

#: Links of one parent per chunk.
CHUNK = 4096
#: Most links between the ends of a precomputed pair, and most pairs as a multiple of the links.
MAX_HOPS, HOP_GROWTH = 16, 16
#: Rows per partition of pairs kept for all levels.
ROWS_PER_TASK = 200_000
#: Most rows of a round that are sent to all tasks.
SENT_ROWS = 100_000
_KEY = ["hierarchy", "node", "root"]
_AT = ["hierarchy", "at", "chunk"]


def concept_links(ancestors: DataFrame) -> DataFrame:
    """Distinct pairs of level 1 with two different ends, ids as decimal strings."""
    return (
        ancestors.filter("min_levels_of_separation = 1 and ancestor_concept_id <> descendant_concept_id")
        .select(
            F.lit("concept").alias("hierarchy"),
            F.col("ancestor_concept_id").cast("string").alias("parent"),
            F.col("descendant_concept_id").cast("string").alias("child"),
        )
        .distinct()
    )


def code_links(codes: DataFrame) -> DataFrame:
    """From each parent reference (one ``/`` read as ``//``) that is another known code to the code."""
    known = codes.select(F.col("code").alias("parent")).distinct()
    pairs = (
        codes.select(F.explode("parent_codes").alias("e"), F.col("code").alias("child"))
        .select(double_slash(F.col("e")).alias("parent"), "child")
        .filter("parent <> child")
        .distinct()
    )
    return pairs.join(known, "parent", "left_semi").select(F.lit("code").alias("hierarchy"), "parent", "child")


def _nearest(rows: DataFrame, keys: list[str], with_path: bool) -> DataFrame:
    """Fewest ``hops`` per key; with paths the least ``via`` of those. ``chunks`` and ``depth`` are the same within a key."""
    carried = [F.max(c).alias(c) for c in ("chunks", "depth") if c in rows.columns]
    if not with_path:
        return rows.groupBy(*keys).agg(F.min("hops").alias("hops"), *carried)
    best = rows.groupBy(*keys).agg(F.min(F.struct("hops", "via")).alias("b"), *carried)
    return best.select(*keys, "b.hops", "b.via", *[c for c in ("chunks", "depth") if c in rows.columns])


def hop_links(links: DataFrame, stash: Stash, with_path: bool = False) -> tuple[DataFrame, int]:
    """``hierarchy, parent, child, hops[, via]`` of all pairs up to some number of links apart, and that number.

    It doubles while the pairs stay below ``HOP_GROWTH`` times the links (by the number of
    two-step ways, known from degrees before anything is joined), so trees and light meshes
    advance several levels with each later join and dense meshes one.
    """
    via = [F.array("child").alias("via")] * with_path
    pairs, n = stash.put(links.select("hierarchy", "parent", "child", F.lit(1).alias("hops"), *via))
    reach_, most = 1, HOP_GROWTH * n
    while n and reach_ < MAX_HOPS:
        into = pairs.groupBy("hierarchy", F.col("child").alias("v")).agg(F.count(F.lit(1)).alias("a"))
        out = pairs.groupBy("hierarchy", F.col("parent").alias("v")).agg(F.count(F.lit(1)).alias("b"))
        ways = into.join(out.hint("merge"), ["hierarchy", "v"]).agg(F.sum(F.col("a") * F.col("b")).alias("n")).first()["n"]
        if n + (ways or 0) > most:
            break
        left = pairs.select("hierarchy", "parent", F.col("child").alias("v"), F.col("hops").alias("h0"), *[F.col("via").alias("v0")] * with_path)
        right = pairs.select("hierarchy", F.col("parent").alias("v"), "child", F.col("hops").alias("h1"), *[F.col("via").alias("v1")] * with_path)
        joined = left.join(right.hint("merge"), ["hierarchy", "v"]).filter("parent <> child")
        two = joined.select(
            "hierarchy", "parent", "child", (F.col("h0") + F.col("h1")).alias("hops"), *[F.concat("v0", "v1").alias("via")] * with_path
        )
        wider, n = stash.put(_nearest(pairs.unionByName(two), ["hierarchy", "parent", "child"], with_path))
        stash.drop(pairs)
        pairs, reach_ = wider, reach_ * 2
    return pairs, reach_


def chunked(pairs: DataFrame) -> DataFrame:
    """Pairs with their parent's chunk and ``chunks``, the number of chunks the child has as a parent."""
    sizes = pairs.groupBy("hierarchy", "parent").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("n"))
    own = pairs.join(sizes.hint("merge"), ["hierarchy", "parent"])
    below = sizes.select("hierarchy", F.col("parent").alias("child"), F.col("n").alias("chunks"))
    return own.join(below.hint("merge"), ["hierarchy", "child"], "left").select(
        "hierarchy",
        F.col("parent").alias("at"),
        F.pmod(F.xxhash64("child"), F.col("n")).cast("int").alias("chunk"),
        "child",
        F.coalesce("chunks", F.lit(0)).alias("chunks"),
        *[c for c in ("hops", "via") if c in pairs.columns],
    )


def starts(edges: DataFrame, only_roots: bool) -> DataFrame:
    """Nodes that have children and, if asked for, no parent; from ``chunked`` pairs."""
    parents = edges.groupBy("hierarchy", F.col("at").alias("node")).agg((F.max("chunk") + 1).alias("chunks"))
    if only_roots:
        children = edges.select("hierarchy", F.col("child").alias("node"))
        parents = parents.join(children.hint("merge"), ["hierarchy", "node"], "left_anti")
    return parents


def reach(links: DataFrame, only_roots: bool, stash: Stash, with_path: bool = False) -> DataFrame:
    """Every node each source reaches, with the fewest links: ``hierarchy, node, root, depth[, path]``.

    Sources are the roots or all parents; a source itself has depth 0. ``path`` runs from root to
    node; of equally short paths the lexicographically least is kept. Every shortest path
    has a node at each depth, so a frontier of nodes at one depth and pairs of up to ``hops``
    links give the next ``hops`` levels. Loops end because a node known to a root is not expanded
    again. All jobs have the same plan but for the tables they read, so they share compiled
    code; sort-merge joins are asked for, as many small broadcasts would fill the driver.
    """
    pairs, hops = hop_links(links, stash, with_path)
    edges, n = stash.put(chunked(pairs))
    width = max(links.sparkSession.sparkContext.defaultParallelism, -(-n // ROWS_PER_TASK))
    edges = edges.repartition(width, *_AT).persist()  # partitioned once for all levels
    first = starts(edges, only_roots).select(
        "hierarchy", "node", F.col("node").alias("root"), F.lit(hops).alias("hops"), *[F.array("node").alias("via")] * with_path,
        "chunks", F.lit(0).cast("bigint").alias("depth"),
    )
    new, n = stash.put(first)
    known = [new]
    while n:
        frontier = new.filter((F.col("hops") == hops) & (F.col("chunks") > 0)).select(
            "hierarchy", "root", F.col("node").alias("at"), "depth", *[F.col("via").alias("path")] * with_path,
            F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"),
        )
        met = frontier.join(edges.hint("merge"), _AT).select(
            "hierarchy", F.col("child").alias("node"), "root", "hops", "chunks", "depth", *[F.concat("path", "via").alias("via")] * with_path
        )
        nearest = _nearest(met, _KEY, with_path).withColumn("depth", F.col("depth") + F.col("hops"))
        old = stash.together(known).select(*_KEY).hint("merge")
        new, n = stash.put(nearest.join(old, _KEY, "left_anti"))
        known.append(new)
    edges.unpersist()
    return stash.together(known).select(*_KEY, "depth", *[F.col("via").alias("path")] * with_path)


# -- folding: chains of nodes with a single parent ------------------------------------------------------
def fold(links: DataFrame, stash: Stash) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chains of single-parent nodes, shortened by pointer doubling.

    Anchors are roots and joints (nodes with several parents). Returned are ``hierarchy, node, top,
    dist, open``: for every single-parent node the anchor above it and the links between; ``open`` rows have none,
    as they lie on or below a loop of single-parent nodes. Further ``single`` (``hierarchy, node, up``) and the
    nodes of those loops. A round doubles the links a pointer spans; it closes every chain that ends within them,
    so a round that closes none leaves only loops. In a loop all nodes are hit again after enough
    steps and no other node is, so the tops of the open rows shrink to the loops' nodes.
    """
    own = links.groupBy("hierarchy", F.col("child").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("parent").alias("up"))
    single, _ = stash.put(own.filter("n = 1").select("hierarchy", "node", "up"))
    is_single = single.select("hierarchy", F.col("node").alias("up"), F.lit(True).alias("open"))
    first = single.join(is_single.hint("merge"), ["hierarchy", "up"], "left").select(
        "hierarchy", "node", F.col("up").alias("top"), F.lit(1).cast("bigint").alias("dist"), F.coalesce("open", F.lit(False)).alias("open")
    )
    state, n = stash.put(first)
    left = state.filter("open").count()
    closed = [state.filter("not open")]
    state = state.filter("open")
    while left:  # ``closed`` rows stay as they are; open ones go on from where their top points
        every = reduce(lambda x, y: x.unionByName(y), closed, state)
        state, _ = stash.put(_jump(state, every, left))
        still = state.filter("open").count()
        closed.append(state.filter("not open"))
        state = state.filter("open")
        if still == left:
            break
        left = still
    loops, m = stash.put(state.select("hierarchy", F.col("top").alias("node")).distinct())
    turning = state
    while m:
        turning, left = stash.put(_jump(turning, turning, left))
        fewer, k = stash.put(turning.select("hierarchy", F.col("top").alias("node")).distinct())
        done, loops, m = k == m, fewer, k
        if done:
            break
    return reduce(lambda x, y: x.unionByName(y), closed, state), single, loops


def _jump(rows: DataFrame, targets: DataFrame, n: int) -> DataFrame:
    """Each of ``n`` rows' tops replaced by its top's own; few rows go to the targets, so these are not shuffled."""
    on = targets.select("hierarchy", F.col("node").alias("top"), F.col("top").alias("t"), F.col("dist").alias("d"), F.col("open").alias("o"))
    met = on.join(F.broadcast(rows), ["hierarchy", "top"]) if n <= SENT_ROWS else rows.join(on.hint("merge"), ["hierarchy", "top"])
    return met.select(
        "hierarchy", "node", F.col("t").alias("top"), (F.col("dist") + F.col("d")).alias("dist"), F.col("o").alias("open")
    )


def folded_links(links: DataFrame, chains: DataFrame, single: DataFrame, stash: Stash) -> DataFrame:
    """``hierarchy, parent, child, hops[, last]``: from anchors to joints, fewest links; a joint can lead back to itself.

    ``last`` is the last node before the joint.
    """
    into = links.join(single.select("hierarchy", F.col("node").alias("child")).hint("merge"), ["hierarchy", "child"], "left_anti")
    above = chains.select("hierarchy", F.col("node").alias("last"), "top", "dist", "open")
    met = into.withColumnRenamed("parent", "last").join(above.hint("merge"), ["hierarchy", "last"], "left")
    ways = met.filter("open is null or not open").select(
        "hierarchy", F.coalesce("top", "last").alias("parent"), "child", (F.coalesce("dist", F.lit(0)) + 1).alias("hops"), "last"
    )
    return stash.put(ways)[0]


def joint_depths(ways: DataFrame, roots: DataFrame, stash: Stash) -> DataFrame:
    """``hierarchy, node, root, depth`` of the joints each root reaches: level-wise frontier joins over folded links.

    A joint met again by a shorter way goes into the frontier again; a longer or equal one ends there.
    """
    pairs = ways.groupBy("hierarchy", "parent", "child").agg(F.min("hops").alias("hops"))
    edges, _ = stash.put(chunked(pairs))
    start = roots.select("hierarchy", F.col("node").alias("parent"))
    from_roots = pairs.join(start.hint("merge"), ["hierarchy", "parent"], "left_semi")
    counts = edges.select("hierarchy", F.col("child").alias("node"), "chunks").distinct()
    first = from_roots.withColumnRenamed("child", "node").join(counts.hint("merge"), ["hierarchy", "node"])
    state, n = stash.put(
        first.select("hierarchy", "node", F.col("parent").alias("root"), F.col("hops").alias("depth"), "chunks", F.lit(True).alias("fresh"))
    )
    while n:
        frontier = state.filter("fresh and chunks > 0").select(
            "hierarchy", "root", F.col("node").alias("at"), "depth", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")
        )
        met = frontier.join(edges.hint("merge"), _AT).select(
            "hierarchy", F.col("child").alias("node"), "root", (F.col("depth") + F.col("hops")).alias("depth"), "chunks", F.lit(True).alias("fresh")
        )
        both = state.withColumn("fresh", F.lit(False)).unionByName(met).groupBy(*_KEY)
        before = F.min(F.when(~F.col("fresh"), F.col("depth"))).alias("before")
        merged = both.agg(F.min("depth").alias("depth"), F.max("chunks").alias("chunks"), before)
        after, _ = stash.put(merged.withColumn("fresh", F.coalesce(F.col("depth") < F.col("before"), F.lit(True))).drop("before"))
        stash.drop(state)
        state, n = after, after.filter("fresh").limit(1).count()
    return state.select(*_KEY, "depth")


# -- loops ----------------------------------------------------------------------------------------------
def _trimmed(links: DataFrame) -> DataFrame:
    """Links whose parent has a parent and whose child has a child: one round of trimming at both ends."""
    above = links.select("hierarchy", F.col("child").alias("parent")).distinct()
    below = links.select("hierarchy", F.col("parent").alias("child")).distinct()
    return links.join(above.hint("merge"), ["hierarchy", "parent"], "left_semi").join(
        below.hint("merge"), ["hierarchy", "child"], "left_semi"
    )


def trim(links: DataFrame, stash: Stash) -> tuple[DataFrame, int]:
    """Trim until nothing changes: frontiers from both ends, what they do not reach holds every loop and what lies between loops."""
    left, n = stash.put(links.select("hierarchy", "parent", "child").distinct())
    while n:
        smaller, m = stash.put(_trimmed(left))
        stash.drop(left)
        left, done, n = smaller, m == n, m
        if done:
            break
    return left, n


def _spread_from(start: DataFrame, links: DataFrame, stash: Stash) -> DataFrame:
    """Colours carried along links, level by level, until no node takes a greater one."""
    colour, n = stash.put(start.withColumn("moved", F.lit(True)))
    while n:
        sent = (
            colour.filter("moved")
            .select("hierarchy", F.col("node").alias("parent"), F.col("colour").alias("sent"))
            .join(links.hint("merge"), ["hierarchy", "parent"])
            .groupBy("hierarchy", F.col("child").alias("node"))
            .agg(F.max("sent").alias("sent"))
        )
        after = colour.join(sent.hint("merge"), ["hierarchy", "node"], "left").select(
            "hierarchy",
            "node",
            F.greatest("colour", "sent").alias("colour"),
            F.coalesce(F.col("sent") > F.col("colour"), F.lit(False)).alias("moved"),
        )
        new, _ = stash.put(after)
        stash.drop(colour)
        colour, n = new, new.filter("moved").limit(1).count()
    return colour.select("hierarchy", "node", "colour")


def loop_groups(links: DataFrame, stash: Stash) -> DataFrame:
    """``hierarchy, node, colour``: nodes that reach each other, of groups of two or more or with a link to itself.

    Frontiers from both ends leave the unreached. There every node's name is carried down to all it reaches, the
    greatest wins (its *colour*); the nodes of a colour that lead back to the node of that name are one group: the
    name is repeated at its own start. Groups found are taken out and the rest goes round again. Work is in
    proportion to links, also for one giant loop.
    """
    found: list[DataFrame] = []
    selves = links.filter("parent = child").select("hierarchy", F.col("parent").alias("node"), F.col("parent").alias("colour")).distinct()
    left, n = trim(links, stash)
    while n:
        nodes = left.select("hierarchy", F.col("parent").alias("node")).union(left.select("hierarchy", "child")).distinct()
        colour = _spread_from(nodes.withColumn("colour", F.col("node")), left, stash)
        tail = colour.select("hierarchy", F.col("node").alias("parent"), "colour")
        head = colour.select("hierarchy", F.col("node").alias("child"), F.col("colour").alias("c"))
        inside, _ = stash.put(
            left.join(tail.hint("merge"), ["hierarchy", "parent"]).join(head.hint("merge"), ["hierarchy", "child"]).filter("colour = c").drop("c")
        )
        frontier, m = stash.put(colour.filter("node = colour"))
        parts = [frontier]
        while m:  # backwards from the colour's own node
            back = (
                frontier.select("hierarchy", F.col("node").alias("child"), "colour")
                .join(inside.hint("merge"), ["hierarchy", "child", "colour"])
                .select("hierarchy", F.col("parent").alias("node"), "colour")
                .distinct()
                .join(stash.together(parts).hint("merge"), ["hierarchy", "node", "colour"], "left_anti")
            )
            frontier, m = stash.put(back)
            parts.append(frontier)
        members = stash.together(parts)
        size = members.groupBy("hierarchy", "colour").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hierarchy", "colour")
        loops, _ = stash.put(members.join(size.hint("merge"), ["hierarchy", "colour"], "left_semi"))
        found.append(loops)
        gone = members.select("hierarchy", "node")
        rest = left.join(gone.withColumnRenamed("node", "parent").hint("merge"), ["hierarchy", "parent"], "left_anti").join(
            gone.withColumnRenamed("node", "child").hint("merge"), ["hierarchy", "child"], "left_anti"
        )
        left, n = trim(rest, stash)
    if not found:
        return selves
    several = stash.together(found).select("hierarchy", "node", "colour")
    alone = selves.join(several.select("hierarchy", "node").hint("merge"), ["hierarchy", "node"], "left_anti")
    return several.unionByName(alone)


def _loop_chains(ways: DataFrame, groups: DataFrame, chains: DataFrame, single: DataFrame, stash: Stash) -> DataFrame:
    """Single-parent nodes on the way from one joint of a group to another (or itself).

    The last nodes of such ways are marked; marks climb by pointer doubling through the chains below the group's joints.
    """
    tail = groups.select("hierarchy", F.col("node").alias("parent"), "colour")
    head = groups.select("hierarchy", F.col("node").alias("child"), F.col("colour").alias("c"))
    inside = ways.join(tail.hint("merge"), ["hierarchy", "parent"]).join(head.hint("merge"), ["hierarchy", "child"]).filter("colour = c and hops > 1")
    marked, n = stash.put(inside.select("hierarchy", F.col("last").alias("node")).distinct())
    if not n:
        return marked
    below = chains.filter("not open").select("hierarchy", F.col("top").alias("parent"), "node")
    near = below.join(tail.select("hierarchy", "parent").hint("merge"), ["hierarchy", "parent"], "left_semi").select("hierarchy", "node")
    ups = single.join(near.hint("merge"), ["hierarchy", "node"], "left_semi")
    pointers, m = stash.put(ups.join(near.withColumnRenamed("node", "up").hint("merge"), ["hierarchy", "up"], "left_semi").select("hierarchy", "node", "up"))
    while m:
        climbed = marked.join(pointers.hint("merge"), ["hierarchy", "node"]).select("hierarchy", F.col("up").alias("node"))
        marked, k = stash.put(marked.unionByName(climbed).distinct())
        if k == n:  # closed under this jump and all shorter ones: complete
            break
        n = k
        far = pointers.select("hierarchy", F.col("node").alias("up"), F.col("up").alias("next"))
        pointers, m = stash.put(pointers.join(far.hint("merge"), ["hierarchy", "up"]).select("hierarchy", "node", F.col("next").alias("up")))
    return marked


class Folded:
    """Links folded once, for roots, depths and loops."""

    def __init__(self, links: DataFrame):
        self.stash = stash = Stash(links.sparkSession, packed=True)
        self.links, _ = stash.put(links.select("hierarchy", "parent", "child"))
        self.chains, self.single, self.bare_loops = fold(self.links, stash)
        self.ways = folded_links(self.links, self.chains, self.single, stash)

    def depths(self) -> DataFrame:
        """``hierarchy, node, root, depth``: every node below a root, with the fewest links, and the roots themselves."""
        children = self.links.select("hierarchy", F.col("child").alias("node"))
        roots, _ = self.stash.put(
            self.links.select("hierarchy", F.col("parent").alias("node")).distinct().join(children.hint("merge"), ["hierarchy", "node"], "left_anti")
        )
        own = roots.select("hierarchy", "node", F.col("node").alias("root"), F.lit(0).cast("bigint").alias("depth"))
        anchors, _ = self.stash.put(own.unionByName(joint_depths(self.ways, roots, self.stash)))
        at = F.struct("hierarchy", F.col("top").alias("node")).alias("at")
        hanging, _ = self.stash.put(self.chains.filter("not open").select(at, "node", "dist"))
        met = join_spread(hanging, anchors.select(F.struct("hierarchy", "node").alias("at"), "root", "depth"), "at", "inner", ["node"])
        return anchors.unionByName(met.select("at.hierarchy", "node", "root", (F.col("depth") + F.col("dist")).alias("depth")))

    def loops(self) -> DataFrame:
        """``hierarchy, node`` of every node that can reach itself."""
        children = self.ways.select("hierarchy", "child").distinct()
        joints = self.ways.join(children.withColumnRenamed("child", "parent").hint("merge"), ["hierarchy", "parent"], "left_semi")
        groups, _ = self.stash.put(loop_groups(joints.select("hierarchy", "parent", "child").distinct(), self.stash))
        between = _loop_chains(self.ways, groups, self.chains, self.single, self.stash)
        return self.bare_loops.unionByName(groups.select("hierarchy", "node")).unionByName(between.select("hierarchy", "node"))


def cycle_nodes(links: DataFrame) -> DataFrame:
    """``hierarchy, node`` of every node that can reach itself."""
    return Folded(links).loops()


def hierarchy_report(links: DataFrame) -> DataFrame:
    """``hierarchy, node, root, depth``: one row per node and root, and ``CYCLE``/-1 per node in a loop."""
    folded = Folded(links)
    loops = folded.loops()
    marked = loops.select("hierarchy", "node", F.lit("CYCLE").alias("root"), F.lit(-1).cast("bigint").alias("depth"))
    return folded.depths().unionByName(marked)


def predecessors(links: DataFrame) -> DataFrame:
    """``hierarchy, root, node, depth, parent, n_paths``: all shortest paths from each root, as the links they use.

    A row is a link that ends some shortest path from the root to the node; going up from parent to parent spells
    every shortest path once. ``n_paths`` is the number of these paths through the link. So all paths are
    there, though there may be exponentially many. Counts are decimals and go level by level with the depth.
    """
    folded = Folded(links)
    stash = folded.stash
    rows, _ = stash.put(folded.depths())
    above = rows.select("hierarchy", F.col("node").alias("parent"), "root", F.col("depth").alias("d"))
    near = rows.join(folded.links.withColumnRenamed("child", "node").hint("merge"), ["hierarchy", "node"])
    used, _ = stash.put(near.join(above.hint("merge"), ["hierarchy", "parent", "root"]).filter("depth = d + 1").drop("d"))
    several, _ = stash.put(used.groupBy(*_KEY, "depth").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    doubled = [r["depth"] for r in several.select("depth").distinct().orderBy("depth").collect()]  # at most one row per level
    one = F.lit(1).cast("decimal(38,0)")
    if not doubled:
        return used.select("hierarchy", "root", "node", "depth", "parent", one.alias("n_paths"))
    deepest = rows.agg(F.max("depth").alias("d")).first()["d"]
    level, _ = stash.put(rows.filter(F.col("depth") < doubled[0]).select(*_KEY, "depth", one.alias("n")))
    done = [level.select("hierarchy", "root", F.col("node").alias("parent"), "n", "depth")]
    for depth in range(doubled[0], deepest + 1):
        last = done[-1].filter(F.col("depth") == depth - 1).drop("depth")
        into = used.filter(F.col("depth") == depth).join(last.hint("merge"), ["hierarchy", "root", "parent"])
        summed, _ = stash.put(into.groupBy("hierarchy", "root", F.col("node").alias("parent"), "depth").agg(F.sum("n").cast("decimal(38,0)").alias("n")))
        done.append(summed.select("hierarchy", "root", "parent", "n", "depth"))
    counts = reduce(lambda x, y: x.unionByName(y), done).drop("depth")
    return used.join(counts.hint("merge"), ["hierarchy", "root", "parent"]).select(
        "hierarchy", "root", "node", "depth", "parent", F.col("n").alias("n_paths")
    )


def hierarchy_paths(links: DataFrame) -> DataFrame:
    """``hierarchy, node, root, depth, path``: the shortest path from every root of each node."""
    return reach(links, True, Stash(links.sparkSession, packed=True), with_path=True)


def descendants(links: DataFrame) -> DataFrame:
    """``hierarchy, ancestor, descendant, min_levels`` of all pairs; a node in a loop does not list itself."""
    pairs = reach(links, False, Stash(links.sparkSession, packed=True))
    return pairs.filter("depth > 0").select(
        "hierarchy", F.col("root").alias("ancestor"), F.col("node").alias("descendant"), F.col("depth").alias("min_levels")
    )
