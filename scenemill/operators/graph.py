"""Graphs of image pairs: components, counts, degrees, blocks and the verdict on a capture."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from scenemill.functions import ranks
from scenemill.functions.storage import cut, kept

#: Fixed value: image ids are below this number in an encoded pair.
PAIR_BASE = 2147483647
#: Rounds after which a graph that is still changing is an error.
MOST_ROUNDS = 60
#: Edges that a task thins out at once, and steps from a root after which it leaves a graph as it is.
AT_ONCE, MOST_STEPS = 1 << 21, 64


def components(nodes: DataFrame, edges: DataFrame, key: str, most_rounds: int = 100) -> DataFrame:
    """(key, node, root): each node's smallest reachable node; nodes (key, node), edges (key, a, b).

    Large-star and small-star steps in turn, all keys at once; a round is two joins of the edges with their
    least neighbours; these are cut as well, and read without their order, so that Spark can split what the root
    of a large component brings to a join. The edges themselves are read twice, for the first large-star step, and
    neither shuffled whole nor kept: what that step leaves of a dense graph is few rows a node. Two numbers a round
    come to the driver. A graph that is still changing after ``most_rounds`` is an error.
    """
    plain, low, high = edges.where("a <> b"), F.least("a", "b"), F.greatest("a", "b")
    ends = F.inline(F.array(F.struct(low.alias("a"), low.alias("m")), F.struct(high.alias("a"), low.alias("m"))))  # a node is no greater than what is above it
    least = kept(plain.select(key, ends).groupBy(key, "a").agg(F.min("m").alias("m")))
    pairs = plain.select(key, low.alias("a"), high.alias("b")).join(least, [key, "a"]).select(key, F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    pairs, state = cut(pairs), None
    for _ in range(most_rounds):
        either = F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
        both = pairs.select(key, either)
        least = both.groupBy(key, "a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, [key, "a"]).where("b > a").select(key, F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy(key, "a").agg(F.min("b").alias("m"))
        moved = F.inline(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b"))))
        pairs = cut(large.join(least, [key, "a"]).select(key, moved).where("a <> b").distinct())
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64(key, "a", "b").cast("decimal(38,0)"))).first())
        if now == state or not now[0]:
            break
        state = now
    else:
        raise RuntimeError(f"components: the graph was still changing after {most_rounds} rounds")
    found = pairs.select(key, F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.join(found, [key, "node"], "left").select(key, "node", F.coalesce("root", "node").alias("root"))


def decode_pairs(pairs: DataFrame) -> DataFrame:
    """Adds i, j of ``pair_id`` and whether they are a valid pair, i before j."""
    out = pairs.withColumn("i", F.expr(f"pair_id div {PAIR_BASE}")).withColumn("j", F.col("pair_id") % PAIR_BASE)
    return out.withColumn("valid", F.coalesce((F.col("i") >= 0) & (F.col("i") < F.col("j")), F.lit(False)))


def _pair_key(*tables: DataFrame) -> list[str]:
    """What pairs meet by: with the first image ``i`` where all tables have it, so that tables dealt by it stay where they are."""
    return ["capture_id", *(["i"] if all("i" in t.columns for t in tables) else []), "pair_id"]


def validate_pairs(
    schedule: DataFrame, matches: DataFrame, verified: DataFrame, images: DataFrame, descriptors: DataFrame | None = None, complete: bool = False
) -> DataFrame:
    """(capture_id, pair_id, reason): what is wrong with the pairs of a capture.

    bad_id, unknown_image, not_scheduled, verified_over_matched; with ``descriptors`` (capture_id, image_id, rows)
    descriptorless_rows: rows matched or verified of an image without descriptors; if the attempt was ``complete``,
    no_matches and no_verified: scheduled pairs that a table doesn't have. A row of 0 is one. The three tables meet
    once, by pair; an image's state is broadcast to its pairs, for images are few beside them.
    """
    pair, flag = _pair_key(schedule, matches, verified), F.lit(True)
    tables = {"planned": 1, "tried": 2, "passed": 4, "filled": 8}  # bits: few columns are hashed faster than many
    marked = lambda df, seen, least=F.lit(None), rows=F.lit(None): df.select(*pair, seen.alias("_seen"), least.cast("long").alias("_least"), rows.cast("long").alias("_rows"))
    found = marked(schedule, F.lit(tables["planned"]))
    filled = F.when(F.col("matched") > 0, F.lit(tables["tried"] | tables["filled"])).otherwise(F.lit(tables["tried"]))
    found = found.unionByName(marked(matches, filled, least=F.coalesce("matched", F.lit(0))))
    found = found.unionByName(marked(verified, F.lit(tables["passed"]), rows=F.col("verified")))
    found = found.groupBy(*pair).agg(F.bit_or("_seen").alias("_seen"), F.min("_least").alias("_least"), F.max("_rows").alias("_rows"))
    same = F.col("capture_id").isNotNull() & F.col("pair_id").isNotNull()  # a null is the same as no other
    seen = lambda *c: F.col("_seen").bitwiseAND(F.lit(sum(tables[x] for x in c))) != 0
    has = lambda c: same & seen(c)
    known = images.select("capture_id", "image_id", flag.alias("known"), F.lit(False).alias("bare"))
    if descriptors is not None:
        known = known.unionByName(descriptors.where("rows = 0").select("capture_id", "image_id", F.lit(False).alias("known"), flag.alias("bare")))
    known = F.broadcast(known.groupBy("capture_id", "image_id").agg(F.max("known").alias("known"), F.max("bare").alias("bare")))
    found = decode_pairs(found)
    for end in ("i", "j"):
        found = found.join(known.select("capture_id", F.col("image_id").alias(end), F.col("known").alias(f"_known_{end}"), F.col("bare").alias(f"_bare_{end}")), ["capture_id", end], "left")
    either = lambda c: F.coalesce(f"_{c}_i", F.lit(False)) | F.coalesce(f"_{c}_j", F.lit(False))
    both = F.coalesce("_known_i", F.lit(False)) & F.coalesce("_known_j", F.lit(False))
    recorded, planned, valid = seen("tried", "passed"), seen("planned"), F.col("valid")
    reasons = {
        "bad_id": recorded & ~valid,
        "unknown_image": recorded & valid & ~both,
        "not_scheduled": recorded & valid & ~has("planned"),
        "verified_over_matched": F.col("_rows") > F.coalesce(F.when(same, F.col("_least")), F.lit(0)),
        "descriptorless_rows": same & valid & (seen("filled") | (F.coalesce("_rows", F.lit(0)) > 0)) & either("bare"),
    }
    if complete:
        reasons |= {"no_matches": planned & ~has("tried"), "no_verified": planned & ~has("passed")}
    why = F.array(*[F.when(c, F.lit(n)) for n, c in reasons.items()])  # nulls go after it: a filter within is not compiled
    return found.select("capture_id", "pair_id", F.explode(why).alias("reason")).where("reason is not null")


def pair_counts(schedule: DataFrame, matches: DataFrame, verified: DataFrame, least: int = 15) -> DataFrame:
    """Per capture and role: pairs scheduled, attempted, matched and verified with at least ``least`` rows.

    The tables meet by pair in one grouping, which counts what joins of their rows would hold.
    """
    pair = _pair_key(schedule, matches, verified)
    kinds = {"_role": "struct<role:string>", "_m": "boolean", "_v": "boolean", "_rows": "long"}
    marked = lambda df, **own: df.select(*pair, *[own.get(c, F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])
    both = marked(schedule, _role=F.struct("role")).unionByName(marked(matches, _m=F.lit(True), _rows=F.col("matched"))).unionByName(marked(verified, _v=F.lit(True), _rows=F.col("verified")))
    rows, same = F.col("_rows"), F.col("capture_id").isNotNull() & F.col("pair_id").isNotNull()
    count = lambda c: F.count_if(same & c)
    met = both.groupBy(*pair).agg(
        F.collect_list("_role").alias("_roles"), count(F.col("_m")).alias("_m"), count(F.col("_v")).alias("_v"), count(F.col("_m") & rows.isNotNull()).alias("_tried"),
        count(F.col("_v") & rows.isNotNull()).alias("_checked"), count(F.col("_m") & (rows > 0)).alias("_matched"), count(F.col("_v") & (rows >= least)).alias("_good"),
    )
    m, v = F.greatest("_m", F.lit(1)), F.greatest("_v", F.lit(1))  # a scheduled pair without a row stays one
    own = met.select("capture_id", F.inline("_roles"), (m * v).alias("_all"), (m * v - (m - F.col("_tried")) * (v - F.col("_checked"))).alias("_any"), (F.col("_matched") * v).alias("_matched"), (F.col("_good") * m).alias("_good"))
    return own.groupBy("capture_id", "role").agg(F.sum("_all").alias("scheduled"), F.sum("_any").alias("attempted"), F.sum("_matched").alias("matched"), F.sum("_good").alias("verified"))


def degrees(images: DataFrame, edges: DataFrame) -> DataFrame:
    """Per capture: nearest-rank percentiles of the degree, and isolated images. edges: (capture_id, a, b)."""
    ends = edges.select("capture_id", F.explode(F.array("a", "b")).alias("image_id")).groupBy("capture_id", "image_id").agg(F.count("*").alias("n"))
    all_ = images.join(ends, ["capture_id", "image_id"], "left").withColumn("degree", F.coalesce("n", F.lit(0)))
    lonely = all_.groupBy("capture_id").agg(F.count_if(F.col("degree") == 0).alias("isolated"))
    return ranks.percentiles(all_, "capture_id", "degree", ranks.names([0.1, 0.5, 0.9])).join(lonely, "capture_id")


def component_summary(members: DataFrame) -> DataFrame:
    """Per capture: images, components, the largest (first on ties), its size and the next size."""
    sizes = members.groupBy("capture_id", "root").agg(F.count("*").alias("n"))
    order = W.partitionBy("capture_id").orderBy(F.desc("n"), "root")
    placed = sizes.withColumn("_r", F.row_number().over(order)).withColumn("_next", F.lead("n").over(order))
    first = lambda c: F.max(F.when(F.col("_r") == 1, F.col(c)))
    return placed.groupBy("capture_id").agg(
        F.sum("n").alias("images"), F.count("*").alias("components"), first("root").alias("dominant"), first("n").alias("dominant_size"),
        F.coalesce(first("_next"), F.lit(0)).alias("second_size"),
    )


def graph_verdict(summary: DataFrame) -> DataFrame:
    """Adds ``verdict``: accepted if the dominant component has 90% of the images (95% beside a second of two
    or more), relaxed if it has 8 and is strictly the largest, else rejected."""
    share = F.col("dominant_size") / F.col("images")
    beside = F.col("second_size") > 1
    strict = F.when(beside, share >= 0.95).otherwise(share >= 0.90)
    relaxed = (F.col("dominant_size") >= 8) & (F.col("dominant_size") > F.col("second_size"))
    return summary.withColumn("verdict", F.when(strict, "accepted").when(relaxed, "relaxed").otherwise("rejected"))


# Blocks (biconnected components) of graphs that no task holds, all keys at once: edges are thinned out where they lie, and
# what is left goes through rounds of joins whose number grows with the logarithm of the nodes: a spanning tree by hooking, its preorder by numbering a round trip, what subtrees reach
# by intervals of that order, and components over the tree's edges.


def _both_ways(edges: DataFrame, key: str, a: str, b: str, *rest: str) -> DataFrame:
    return edges.select(key, F.inline(F.array(F.struct(a, b), F.struct(F.col(b).alias(a), F.col(a).alias(b)))), *rest)


def _thinning():
    """Rows (keys, a, b), a < b, of a task's edges: what ``sparse`` keeps of them."""

    def hooked(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the edges a - b of a spanning forest of n nodes, and each node's root."""
        root, left, used = np.arange(n), np.arange(len(a)), [np.empty(0, np.int64)]
        while True:
            p, q = root[a[left]], root[b[left]]
            apart = p != q
            if not apart.any():
                return np.concatenate(used), root
            left, p, q = left[apart], p[apart], q[apart]
            by = np.full(n, -1)
            by[np.maximum(p, q)] = np.arange(len(left))
            parts = np.flatnonzero(by >= 0)
            by = by[parts]
            root[parts] = np.minimum(p, q)[by]
            used.append(left[by])
            while (root[root] != root).any():
                root = root[root]

    def thinned(rows: pa.Table) -> pa.Table:
        """Of edges those of a breadth-first forest and of a spanning forest of the others."""
        *keys, a, b = (c.combine_chunks() for c in rows.columns)

        def numbers(values):
            coded = values.dictionary_encode(null_encoding="encode")
            return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)

        place, n = numbers(pa.concat_arrays([a, b]))
        for of_key, n_keys in map(numbers, keys):
            place, n = (place, n) if n_keys == 1 else numbers(pa.array(place * n_keys + np.tile(of_key, 2)))
        a, b = np.split(place, 2)
        _, first = np.unique(a * n + b, return_index=True)
        a, b = a[first], b[first]
        _, root = hooked(n, a, b)
        step = np.where(root == np.arange(n), 0, -1)
        left, other = np.arange(len(first)), np.ones(len(first), bool)
        for k in range(MOST_STEPS):
            sa, sb = step[a[left]], step[b[left]]
            by = np.full(n, -1)
            for near, far, ends in ((sa, sb, b), (sb, sa, a)):
                on = left[(near == k) & (far < 0)]
                by[ends[on]] = on
            found = np.flatnonzero(by >= 0)
            if not len(found):
                break
            step[found], other[by[found]] = k + 1, False
            left = left[(step[a[left]] < 0) | (step[b[left]] < 0)]
        if len(left):
            return rows.take(pa.array(first))
        rest = np.flatnonzero(other)
        other[rest], other[rest[hooked(n, a[rest], b[rest])[0]]] = True, False
        return rows.take(pa.array(np.sort(first[~other])))

    def fn(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= AT_ONCE:
                left = thinned(pa.Table.from_batches(held))
                held, n = left.to_batches(), left.num_rows
                if n > AT_ONCE // 2:
                    yield from held
                    held, n = [], 0
        if n:
            yield from thinned(pa.Table.from_batches(held)).to_batches()

    return fn


def sparse(edges: DataFrame, *keys: str) -> DataFrame:
    """(keys, a, b), a < b: edges of graphs with the same components and blocks, some two for each node and task.

    What a task leaves out of its edges joins nodes of one block of those that it keeps: of a breadth-first forest and a
    spanning forest of all other edges. So, whatever edges come from elsewhere, no node parts others that it didn't part
    before. Loops are left out. Tasks hold ``AT_ONCE`` edges, not a graph; what is no fewer for it, or long, goes on as it
    is. Few tasks, as each keeps its own forests, and fewer ones once more where much is left.
    """
    plain = edges.where("a <> b").select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    tasks = 4 * edges.sparkSession.sparkContext.defaultParallelism
    conf, limit = edges.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    before = conf.get(limit, None)
    conf.set(limit, str(2**31 - 1))  # a batch is measured after each row, which takes longer than all else; its rows are short and counted
    try:
        left = kept(plain.coalesce(tasks).mapInArrow(_thinning(), plain.schema))
        if tasks > 8 and left.count() > AT_ONCE:
            left = kept(left.coalesce(tasks // 8).mapInArrow(_thinning(), plain.schema))
    finally:
        conf.unset(limit) if before is None else conf.set(limit, before)
    return left


def spanning_forest(edges: DataFrame, key: str) -> DataFrame:
    """(key, a, b): edges (a < b) of a spanning tree of each component. Loops and repeated edges count for nothing."""
    plain = edges.where("a <> b").select(key, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = kept(plain.select(key, F.col("a").alias("p"), F.col("b").alias("q"), F.struct("a", "b").alias("e")))
    forest = None
    for _ in range(MOST_ROUNDS):
        if left.isEmpty():
            break
        hooks = _both_ways(left, key, "p", "q", "e").where("q < p").groupBy(key, "p").agg(F.min(F.struct("q", "e")).alias("m"))
        hooks = kept(hooks.select(key, "p", F.col("m.q").alias("to"), F.col("m.e.a").alias("a"), F.col("m.e.b").alias("b")))
        chosen = hooks.select(key, "a", "b")
        forest = chosen if forest is None else forest.unionByName(chosen)
        jumps = hooks.select(key, "p", "to")
        for _ in range(MOST_ROUNDS):  # parts hook to smaller ones, so the way ends; two jumps a round
            jumped = jumps.withColumn("moved", F.lit(False))
            for _ in range(2):
                on = jumped.select(key, F.col("p").alias("to"), F.col("to").alias("on"))
                jumped = jumped.join(on, [key, "to"], "left").select(key, "p", F.coalesce("on", "to").alias("to"), F.col("on").isNotNull().alias("moved"))
            jumped = kept(jumped)
            jumps = jumped.select(key, "p", "to")
            if jumped.where("moved").isEmpty():
                break
        for end in ("p", "q"):
            left = left.join(jumps.select(key, F.col("p").alias(end), "to"), [key, end], "left").withColumn(end, F.coalesce("to", end)).drop("to")
        left = left.where("p <> q").groupBy(key, F.least("p", "q").alias("_p"), F.greatest("p", "q").alias("_q")).agg(F.min("e").alias("e"))
        left = kept(left.select(key, F.col("_p").alias("p"), F.col("_q").alias("q"), "e"))
    else:
        raise RuntimeError(f"spanning_forest: parts were still apart after {MOST_ROUNDS} rounds")
    return plain.limit(0) if forest is None else kept(forest)


def rooted(forest: DataFrame, key: str) -> DataFrame:
    """(key, node, parent, pre, size) of every node of the trees: the root is a tree's least node, ``pre`` numbers a key's
    nodes from 0 on so that every subtree is the interval from its node's number on, ``size`` nodes long."""
    arcs = _both_ways(forest, key, "a", "b")
    around = kept(ranks.number_rows(arcs, [key, "a"], ["b"]))  # the arcs that leave a node, in turn
    turn = around.select(key, "a", F.col("b"), "_i", "_n")
    leave = turn.select(key, F.col("a").alias("v"), F.col("_i").alias("at"), F.col("b").alias("w"))
    trees = components(forest.select(key, F.col("a").alias("node")).unionByName(forest.select(key, F.col("b").alias("node"))).distinct(), forest, key)
    trees = kept(trees)
    come = turn.select(key, F.col("b").alias("u"), F.col("a").alias("v"), ((F.col("_i") + 1) % F.col("_n")).alias("at"))  # u -> v: the next leaves v after v -> u
    roots = trees.where("node = root").select(key, F.col("node").alias("v"), F.lit(0).cast("long").alias("at"), F.lit(True).alias("last"))
    arc = lambda a, b: F.struct(F.col(a).alias("u"), F.col(b).alias("v"))
    steps = come.join(leave, [key, "v", "at"]).join(roots, [key, "v", "at"], "left")  # the trip ends where it would begin again
    steps = kept(steps.select(key, arc("u", "v").alias("arc"), F.when(F.col("last").isNull(), arc("v", "w")).alias("next"), F.col("last").isNull().cast("long").alias("after")))
    for _ in range(MOST_ROUNDS):
        for _ in range(2):
            on = steps.select(key, F.col("arc").alias("next"), F.col("next").alias("_next"), F.col("after").alias("_after"))
            steps = steps.join(on, [key, "next"], "left").select(key, "arc", F.col("_next").alias("next"), (F.col("after") + F.coalesce("_after", F.lit(0))).alias("after"))
        steps = kept(steps)
        if steps.where("next is not null").isEmpty():
            break
    else:
        raise RuntimeError(f"rooted: a trip was not at its end after {MOST_ROUNDS} rounds")
    ends = steps.select(key, F.col("arc.u").alias("u"), F.col("arc.v").alias("v"), "after")
    back = ends.select(key, F.col("u").alias("v"), F.col("v").alias("u"), F.col("after").alias("back"))
    down = ends.join(back, [key, "u", "v"]).where("after > back")
    nodes = down.select(key, F.col("v").alias("node"), F.col("u").alias("parent"), "after", ((F.col("after") - F.col("back") + 1) / 2).cast("long").alias("size"))
    nodes = nodes.join(trees, [key, "node"])
    tops = trees.groupBy(key, "root").agg(F.count("*").alias("size")).select(key, F.col("root").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(2**62).alias("after"), "size", "root")
    placed = ranks.number_rows(kept(nodes.unionByName(tops).withColumn("late", -F.col("after"))), key, ["root", "late"])
    return kept(placed.select(key, "node", "parent", F.col("_i").alias("pre"), "size"))


def reaches(edges: DataFrame, tree: DataFrame, key: str) -> DataFrame:
    """The tree's rows with ``low`` and ``high``: the least and the greatest preorder number in a node's subtree or next
    to it by an edge that is not the tree's."""
    number = tree.select(key, F.col("node").alias("a"), F.col("pre").alias("pa"), F.col("parent").alias("up"))
    other = tree.select(key, F.col("node").alias("b"), F.col("pre").alias("pb"), F.col("parent").alias("up_b"))
    plain = edges.where("a <> b").select(key, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    apart = plain.join(number, [key, "a"]).join(other, [key, "b"]).where("not (up <=> b) and not (up_b <=> a)")
    near = _both_ways(apart.select(key, "pa", "pb"), key, "pa", "pb").groupBy(key, "pa").agg(F.min("pb").alias("low"), F.max("pb").alias("high"))
    own = tree.join(near.withColumnRenamed("pa", "pre"), [key, "pre"], "left")
    level = kept(own.select(key, "pre", F.least("pre", "low").alias("low"), F.greatest("pre", "high").alias("high")))
    asked = kept(tree.select(key, "node", "pre", "size", F.floor(F.log2(F.col("size") + 0.5)).cast("int").alias("_k")))
    most = asked.agg(F.max("_k")).first()[0]
    found = None
    for k in range((-1 if most is None else most) + 1):
        reach = 2**k
        first = level.select(key, "pre", "low", "high")
        second = level.select(key, F.col("pre").alias("_last"), F.col("low").alias("_low"), F.col("high").alias("_high"))
        here = asked.where(F.col("_k") == k).withColumn("_last", F.col("pre") + F.col("size") - reach)
        here = here.join(first, [key, "pre"]).join(second, [key, "_last"])
        here = here.select(key, "node", F.least("low", "_low").alias("low"), F.greatest("high", "_high").alias("high"))
        found = here if found is None else found.unionByName(here)
        if k < most:
            on = second.select(key, (F.col("_last") - reach).alias("pre"), "_low", "_high")
            level = kept(level.join(on, [key, "pre"]).select(key, "pre", F.least("low", "_low").alias("low"), F.greatest("high", "_high").alias("high")))
    if found is None:
        return tree.withColumns({"low": F.col("pre"), "high": F.col("pre")})
    return kept(tree.join(found, [key, "node"]))


def blocks(edges: DataFrame, key: str) -> DataFrame:
    """(key, node, parent, block): the edges of a spanning tree; ``block`` is the least child among a block's tree edges.

    edges: (key, a, b). A block of n nodes has n - 1 tree edges; a bridge is a block of one. Nodes without edges
    have no row; loops and repeated edges count for nothing.
    """
    edges = sparse(edges, key)
    tree = rooted(spanning_forest(edges, key), key)
    tree = reaches(edges, tree, key)
    upper = tree.select(key, F.col("node").alias("parent"), F.col("pre").alias("p_pre"), F.col("size").alias("p_size"), F.col("parent").alias("p_parent"))
    hangs = tree.join(upper, [key, "parent"]).where("p_parent is not null")
    beyond = (F.col("low") < F.col("p_pre")) | (F.col("high") >= F.col("p_pre") + F.col("p_size"))
    up = hangs.where(beyond).select(key, F.col("node").alias("a"), F.col("parent").alias("b"))
    place = lambda n: tree.select(key, F.col("node").alias(n), F.col("pre").alias(f"{n}_pre"), F.col("size").alias(f"{n}_size"))
    ends = edges.where("a <> b").join(place("a"), [key, "a"]).join(place("b"), [key, "b"])
    apart = (F.col("a_pre") + F.col("a_size") <= F.col("b_pre")) | (F.col("b_pre") + F.col("b_size") <= F.col("a_pre"))
    across = ends.where(apart).select(key, "a", "b")
    children = tree.where("parent is not null")
    found = components(children.select(key, "node"), kept(up.unionByName(across)), key)
    return children.select(key, "node", "parent").join(found, [key, "node"]).withColumnRenamed("root", "block")


def biconnectivity(edges: DataFrame, key: str = "capture_id") -> DataFrame:
    """(key, articulations, blocks, largest, second): nodes in more than one block, blocks, and the sizes of the two
    largest ones (0 where there are fewer)."""
    found = kept(blocks(edges, key))
    sizes = found.groupBy(key, "block").agg((F.count("*") + 1).alias("_size"))
    counts = sizes.groupBy(key, "_size").agg(F.count("*").alias("_times"))  # few sizes, however many blocks
    placed = counts.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.desc("_size"))))
    of = lambda condition: F.max(F.when(condition, F.col("_size")))
    top = placed.groupBy(key).agg(
        F.sum("_times").alias("blocks"), F.max("_size").alias("largest"),
        of((F.col("_r") == 1) & (F.col("_times") > 1)).alias("again"), of(F.col("_r") == 2).alias("next"),
    )
    in_block = found.select(key, F.explode(F.array("node", "parent")).alias("node"), "block").distinct()
    cuts = in_block.groupBy(key, "node").agg(F.count("*").alias("_n")).where("_n > 1").groupBy(key).agg(F.count("*").alias("articulations"))
    out = top.join(cuts, key, "left")
    return out.select(key, F.coalesce("articulations", F.lit(0)).alias("articulations"), "blocks", "largest", F.coalesce("again", "next", F.lit(0)).alias("second"))


def descriptorless(images: DataFrame, descriptors: DataFrame, schedule: DataFrame) -> DataFrame:
    """(capture_id, image_id, name): scheduled images whose descriptors have no rows.

    images: (capture_id, image_id, name); descriptors: (capture_id, image_id, rows); schedule: (capture_id, i, j), or
    (capture_id, image_id) of the images in it. Ends of pairs become one row an image where the pairs lie.
    """
    ends = schedule if "image_id" in schedule.columns else schedule.select("capture_id", F.explode(F.array("i", "j")).alias("image_id"))
    used = ends.select("capture_id", "image_id").distinct()
    bare = descriptors.where("rows = 0").select("capture_id", "image_id")
    return images.join(bare, ["capture_id", "image_id"], "left_semi").join(used, ["capture_id", "image_id"], "left_semi").select("capture_id", "image_id", "name")


def _json(df: DataFrame, columns: list[str]) -> Column:
    """A row as JSON, nulls included. Whole numbers under plain names need no writer of JSON: it costs more than the hash."""
    if all(re.fullmatch(r"\w+", c, re.ASCII) and isinstance(df.schema[c].dataType, (ByteType, ShortType, IntegerType, LongType)) for c in columns):
        fields = [F.concat(F.lit(f'"{c}":'), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in columns]
        return F.concat(F.lit("{"), *[part for f in fields for part in (F.lit(","), f)][1:], F.lit("}"))
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def _hashed_in_order(key: str):
    """Rows (key, _b, _h) in their order, each _h of 64 digits, as one hash of all _h of each (key, _b)."""

    def fn(batches):
        running, kind = {}, None
        for b in batches:
            kind = b.schema.field(0).type
            keys, places = (b.column(k).dictionary_encode(null_encoding="encode") for k in range(2))
            group = keys.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(places.dictionary) + places.indices.to_numpy(zero_copy_only=False)
            at, text = b.column(2).buffers()[1:]
            start = np.frombuffer(at, np.int32)[b.column(2).offset]
            by_group = np.argsort(group, kind="stable")
            digits = np.frombuffer(text, "V64", len(group), start)[by_group].view(np.uint8)
            ends = [*(np.flatnonzero(np.diff(group[by_group])) + 1).tolist(), len(group)] if len(group) else []
            names, codes, first = (keys.dictionary.to_pylist(), places.dictionary.to_pylist()), group[by_group], 0
            for last in ends:
                k, p = divmod(int(codes[first]), len(places.dictionary))
                entry = running.setdefault((names[0][k], names[1][p]), [0, hashlib.sha256()])
                entry[0] += last - first
                entry[1].update(digits[64 * first : 64 * last])
                first = last
        if running:
            columns = [pa.array([k for k, _ in running], kind), pa.array([p for _, p in running]), pa.array([n for n, _ in running.values()], pa.int64()), pa.array([h.hexdigest() for _, h in running.values()])]
            yield pa.RecordBatch.from_arrays(columns, [key, "_b", "_n", "_h"])

    return fn


def table_digest(df: DataFrame, key: str, order: list[str], tasks: int | None = None) -> DataFrame:
    """(key, rows, digest) by which equal tables agree, whatever the order of their rows.

    A row's SHA-256 is of its JSON without the key. Rows are put in order in buckets by the MD5 of ``order``
    (its first three digits) and their hashes hashed; the digest is of the buckets' names and hashes in order.
    Buckets are dealt over ``tasks`` (or Spark's number); a task sorts its rows, which spills, and hashes them as they
    come, so no bucket is held: only the rows themselves are shuffled, and their hashes are made after that.
    """
    place = F.substring(F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in order])), 1, 3)
    own = df.withColumn("_b", place)
    own = own.repartition(tasks, key, "_b") if tasks else own.repartition(key, "_b")
    row = F.sha2(_json(df, [c for c in df.columns if c != key]), 256)
    own = own.select(key, "_b", *order, row.alias("_h")).sortWithinPartitions(*order, "_h").select(key, "_b", "_h")
    bucket = own.mapInArrow(_hashed_in_order(key), f"{key} {df.schema[key].dataType.simpleString()}, _b string, _n long, _h string")
    whole = F.transform(F.array_sort(F.collect_list(F.struct("_b", "_h"))), lambda x: F.concat(x["_b"], x["_h"]))
    return bucket.groupBy(key).agg(F.sum("_n").alias("rows"), F.sha2(F.array_join(whole, ""), 256).alias("digest"))
