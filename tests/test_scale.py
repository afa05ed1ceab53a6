"""Work of pairs and models over many tasks, and the same results by another way."""

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from scenemill import catalog
from scenemill.functions import ranks
from scenemill.operators import conditioning, graph, models, pairs, splats
from scenemill.plans import views
from scenemill.plans.views import view
from scenemill.sources import model_files


def test_schedule_is_dealt_by_images(spark):
    schedule = view(spark, "/root/testdata/sf0.1", "schedule")  # 1,000 images of 5 captures
    tasks = schedule.groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) >= 8
    total = sum(t["count"] for t in tasks)
    assert max(t["count"] for t in tasks) < total / 4


def _tables(spark):
    schedule = spark.createDataFrame([(1, 3, "local"), (1, 3, "far"), (1, 4, "far"), (1, 5, None), (None, 6, "far"), (1, None, "local")], "capture_id int, pair_id long, role string")
    matches = spark.createDataFrame([(1, 3, 0), (1, 3, 7), (1, 4, None), (None, 6, 5), (1, None, 4), (1, 99, 2)], "capture_id int, pair_id long, matched long")
    verified = spark.createDataFrame([(1, 3, 20), (1, 3, 3), (1, 5, 15), (None, 6, 50), (1, 98, 9)], "capture_id int, pair_id long, verified long")
    return schedule, matches, verified


def test_pair_counts_as_joined(spark):
    schedule, matches, verified = _tables(spark)
    joined = schedule.join(matches, ["capture_id", "pair_id"], "left").join(verified, ["capture_id", "pair_id"], "left")
    want = joined.groupBy("capture_id", "role").agg(F.count("*"), F.count(F.coalesce("matched", "verified")), F.count_if(F.col("matched") > 0), F.count_if(F.col("verified") >= 15))
    assert sorted(map(tuple, graph.pair_counts(schedule, matches, verified).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def _exchanges(df):
    """Shuffles by a pair in the plan, whatever Spark would change while it runs."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("Exchange hashpartitioning" in line and "pair_id" in line for line in plan.splitlines())


def test_pairs_stay_with_their_first_image(spark, sf_dir):
    tables = [view(spark, sf_dir, t) for t in ("schedule", "matches", "verified")]
    assert _exchanges(graph.pair_counts(*tables)) == 0
    assert _exchanges(graph.validate_pairs(*tables, view(spark, sf_dir, "graph_images"), complete=True)) == 0


def test_no_pairs_are_shuffled_however_many_images(spark):
    """Images too many for Spark's own limit of a broadcast: only rows moved to another first image leave their place."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = catalog.queries()["C1_validate_pairs"](spark, "/root/testdata/sf0.1")
        lines = [x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not [x for x in lines if re.search(r"\b(i|j|pair_id)#", x) and "REPARTITION_BY_NUM" not in x]
    moved = [x for x in lines if re.search(r"\bi#", x)]
    assert len(moved) == 1
    tree = found._jdf.queryExecution().optimizedPlan().toString()
    below = tree[tree.index("RepartitionByExpression [i#") :].splitlines()
    assert re.search(r"AND NOT \(\(CASE .* div 2147483647\) = ", next(x for x in below if "Filter" in x))


def test_schedule_as_joined(spark):
    """Rows of images side by side give the pairs of a plain join: over several rows, repeated, negative and null."""
    ids = [*range(1000, 1060), 2047, 2048, 2049, *range(5000, 5030), 5029, -3, -1, 0, None]
    images = spark.createDataFrame([(c, k) for c in (1, 2, None) for k in ids[:: c or 1]], "capture_id int, image_id long")
    plain = views.VIEWS["schedule"].replace("{graph_images}", "{images}")
    want = spark.sql(plain, images=images).collect()
    assert len(want) > 2000 and sorted(map(tuple, views._schedule(images).collect())) == sorted(map(tuple, want))


def test_nulls_are_no_pair(spark):
    """A null capture or pair meets no other."""
    schedule, matches, verified = _tables(spark)
    images = spark.createDataFrame([(1, 0)], "capture_id int, image_id long")
    got = {tuple(r) for r in graph.validate_pairs(schedule, matches, verified, images, complete=True).collect()}
    assert {(None, 6, "no_matches"), (None, 6, "verified_over_matched"), (1, None, "bad_id"), (1, None, "no_matches"), (1, 98, "verified_over_matched"), (1, 3, "verified_over_matched")} <= got
    assert (1, 3, "no_matches") not in got and (1, 5, "not_scheduled") not in got and (1, 99, "not_scheduled") in got


def test_match_digest_as_of_the_whole_text(spark):
    rows = [(c, i, j) for c in ("x", "y", None) for i in (10, 9, 2) for j in (5000, 3, 1023, 1024, 70)] + [("x", 2, 3), ("z", -1, 4)]
    edges = spark.createDataFrame(rows, "capture_id string, i long, j int").repartition(7)
    want = {tuple(r) for r in model_files.match_list(edges).drop("text").collect()}
    got = model_files.match_digest(edges)
    assert {tuple(r) for r in got.collect()} == want
    whole = got._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(j" in whole and "struct" not in whole  # no list of a capture's pairs


def _shuffled_pairs(df):
    """Shuffles of a plan by both ends of an edge."""
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line and line.count("#") > 2]


def test_components_read_edges_where_they_lie(spark, monkeypatch):
    """Neither kept nor shuffled whole: only what the first step leaves."""
    sizes = []
    for name in ("cut", "kept"):
        real = getattr(graph, name)
        monkeypatch.setattr(graph, name, lambda df, real=real: (lambda out: (sizes.append(out.count()), out)[1])(real(df)))
    n = 60
    edges = spark.createDataFrame([(1, a, b) for a in range(n) for b in range(a + 1, n)] + [(1, 100, 101), (2, 7, 3), (2, 3, 7), (2, 5, 5)], "key int, a long, b long")
    nodes = spark.createDataFrame([(1, a) for a in range(n)] + [(1, 100), (1, 101), (2, 3), (2, 5), (2, 7)], "key int, node long")
    got = {(r.key, r.node): r.root for r in graph.components(nodes, edges, "key").collect()}
    assert got == {(1, a): 0 for a in range(n)} | {(1, 100): 100, (1, 101): 100, (2, 3): 3, (2, 5): 5, (2, 7): 3}
    assert max(sizes) < n * (n - 1) / 2 / 4


def test_blocks_keep_few_edges_of_a_dense_graph(spark, monkeypatch):
    """Two cliques that share a node, a bridge, a triangle behind it: no table of all edges, or of half of them."""
    sizes = []
    for name in ("cut", "kept"):
        real = getattr(graph, name)
        monkeypatch.setattr(graph, name, lambda df, real=real: (lambda out: (sizes.append(out.count()), out)[1])(real(df)))
    n = 150
    cliques = [(1, a, b) for base in (0, n - 1) for a in range(base, base + n) for b in range(a + 1, base + n)]
    edges = spark.createDataFrame([*cliques, *cliques[:99], (1, 5, 1000), (1, 1000, 1001), (1, 1001, 1002), (1, 1002, 1000), (1, 7, 7), (2, 4, 3)], "key int, a long, b long").coalesce(2)
    got = {tuple(r) for r in graph.biconnectivity(edges, "key").collect()}
    assert got == {(1, 3, 4, n, n), (2, 0, 1, 2, 0)}
    assert max(sizes) < len(cliques) / 8


def _parts(edges, gone):
    """Sets of nodes that edges join without the node ``gone``."""
    root = {x: x for e in edges for x in e if x != gone}

    def of(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if gone not in (a, b):
            root[of(a)] = of(b)
    return {frozenset(y for y in root if of(y) == x) for x in root if root[x] == x}


def test_thinned_edges_part_nodes_as_all_do(monkeypatch):
    """Whatever node is taken away and whatever edges come from another task; batch by batch; long graphs stay whole."""
    rng = np.random.default_rng(4)
    monkeypatch.setattr(graph, "AT_ONCE", 40)

    def thinned(rows):
        batches = pa.table({"key": pa.array([r[0] for r in rows]), "a": pa.array([r[1] for r in rows]), "b": pa.array([r[2] for r in rows])}).to_batches(5)
        return [r for b in graph._thinning()(iter(batches)) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]

    fewer = 0
    for _ in range(300):
        n = int(rng.integers(3, 10))
        rows = [(str(k), int(a), int(b)) for k, a, b in zip(rng.integers(0, 2, 200), rng.integers(0, n, 200), rng.integers(0, n, 200), strict=True) if a < b]
        got = thinned(rows)
        assert set(got) <= set(rows)
        fewer += len(got) < len(set(rows))
        for key in "01":
            more = {(int(a), int(b)) for a, b in rng.integers(0, n, (int(rng.integers(0, 5)), 2))}
            whole, left = ({r[1:] for r in of if r[0] == key} | more for of in (rows, got))
            assert all(_parts(whole, x) == _parts(left, x) for x in range(-1, n))
    assert fewer > 100
    monkeypatch.setattr(graph, "AT_ONCE", 10_000)
    ladder = [("x", k, k + d) for k in range(400) for d in (1, 2)]
    assert sorted(thinned(ladder)) == ladder


def test_plan_counts_pairs_either_way(spark):
    images = spark.createDataFrame([(1, k) for k in range(5)], "capture_id int, image_id long")
    local = spark.createDataFrame([(1, 0, 1), (1, 2, 1), (1, 3, 3)], "capture_id int, i long, j long")
    loops = spark.createDataFrame([(1, 1, 0), (1, 1, 2), (1, 3, 2), (1, 2, 3)], "capture_id int, i long, j long")
    assert [tuple(r) for r in pairs.refinement_plan(images, local, loops, 3).collect()] == [(1, 2, 1, False, True)]


def test_ordered_plan_is_not_shuffled_by_pair(spark, sf_dir):
    s = view(spark, sf_dir, "schedule")
    plan = pairs.refinement_plan(view(spark, sf_dir, "graph_images"), s.where("role = 'local'"), s.where("role = 'retrieval'"), 2000)
    assert not _shuffled_pairs(plan)


def test_integrity_of_points_of_all_models(spark):
    kind = "model_id int, image_id int, point2d_idx int, point_id long"
    seen = spark.createDataFrame([(1, 1, 0, 5), (1, 1, 0, 6), (1, 1, 1, 7), (2, 1, 0, 9), (2, 1, None, 5)], kind)
    tracks = spark.createDataFrame([(1, 1, 0, 5), (1, 4, 0, 5), (2, 1, 0, 9), (2, 1, None, 5)], kind)
    got = {tuple(r) for r in models.integrity(seen, tracks, spark.createDataFrame([(5,), (6,), (9,)], "point_id long")).collect()}
    assert got == {
        (1, "duplicate_observation", 1), (1, "missing_point", 1), (1, "observation_without_track", 2), (1, "track_without_observation", 1),
        (2, "observation_without_track", 1), (2, "track_without_observation", 1),
    }


def test_scheduled_images_are_the_ends_of_pairs(spark):
    """Found without all pairs: near ones, far ones, images of captures of their own, and a null."""
    images = spark.createDataFrame([(1, k) for k in (*range(0, 60, 7), 300, 301, 5000)] + [(2, 3), (3, 11), (3, 11 + 2**20), (4, 0), (4, 256 * 11), (None, 1), (None, 2)], "capture_id int, image_id long")
    s = views._schedule(images)
    want = {tuple(r) for e in "ij" for r in s.select("capture_id", e).collect()}
    got = views._scheduled_images(images)
    assert sorted(map(tuple, got.collect())) == sorted(want) and (2, 3) not in want
    assert "CartesianProduct" not in got._jdf.queryExecution().executedPlan().toString()


def test_scheduled_pairs_are_one_row_an_image_before_they_meet(spark):
    images = spark.createDataFrame([(1, k, f"image{k}") for k in range(9)], "capture_id int, image_id long, name string")
    pairs_ = spark.createDataFrame([(1, i, j) for i in range(5) for j in range(i + 1, 7)], "capture_id int, i long, j long")
    out = graph.descriptorless(images, images.withColumn("rows", F.col("image_id") % 2), pairs_)
    assert {r.image_id for r in out.collect()} == {0, 2, 4, 6}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_" in plan or plan.count("HashAggregate") >= 2


def test_percentiles_sort_only_the_spans_of_their_places(spark, monkeypatch):
    rng = np.random.default_rng(7)
    odd = [0.0, -0.0, float("inf"), float("-inf"), float("nan"), None, 5e-324, -1e308]
    values = [*(float(v) for v in rng.normal(size=2000) * 50), *[2.5] * 200, *odd]
    df = spark.createDataFrame([(i % 3, v) for i, v in enumerate(values)] + [(7, 1.0), (8, None)], "k int, v double")
    wanted = {"a": ("rank", 0.9), "b": ("middle", 0.5), "c": ("linear", 0.13), "d": ("rank", 0.0), "e": ("floor", 0.25), "f": ("rank", 1.0)}
    show = lambda rows: sorted((str(tuple(r)) for r in rows))
    want = show(ranks.percentiles(df, "k", "v", wanted).collect())
    sorted_, real = [], ranks._ranges
    monkeypatch.setattr(ranks, "_ranges", lambda df, *a: (lambda out: (sorted_.append(out.count()), out)[1])(real(df, *a)))
    assert show(ranks.percentiles_twice(df, "k", "v", wanted).collect()) == want
    assert sorted_[0] < 500
    whole = df.select("k", F.expr("try_cast(v as long) div 7 as n")).where("abs(n) < 100")
    assert show(ranks.percentiles_twice(whole, "k", "n", wanted).collect()) == show(ranks.percentiles(whole, "k", "n", wanted).collect())


def test_tracks_meet_over_batches(spark):
    """Tracks cut by batches of rows, of one ray and of many, each against all pairs of its rays."""
    rng = np.random.default_rng(8)
    rows = [(m, p, float(abs(rng.normal()) / 300), *map(float, rng.normal(size=3) * 0.1 + [0, 0, 5])) for m in (1, 2) for p in range(12) for _ in range(int(rng.integers(1, 30)))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = {tuple(r)[:2]: tuple(r)[2:] for r in conditioning.parallax(spark.createDataFrame(rows, "model_id int, point_id long, angle double, rx double, ry double, rz double"), block=7).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 24
    for key, found in got.items():
        own = np.array([r[2:] for r in rows if r[:2] == key])
        unit = own[:, 1:] / np.linalg.norm(own[:, 1:], axis=1)[:, None]
        apart = np.degrees(np.arccos(np.clip(np.abs(unit @ unit.T), 0, 1)))
        np.fill_diagonal(apart, -1)
        need = np.maximum(0.05, 3 * np.degrees(np.maximum(own[:, None, 0], own[None, :, 0])))
        limit = max(0.05, 3 * np.degrees(np.sort(own[:, 0])[int(np.ceil(0.9 * len(own))) - 1]))
        assert found[0] == len(own) and found[1:5] == tuple(int((apart >= x).any(axis=1).sum()) for x in (1.5, 2.0, 3.0, need))
        assert found[5] == (max(0.0, apart.max()) >= limit) and abs(found[6] - limit) < 1e-12


def test_crowds_are_cut_before_their_shuffle(spark, monkeypatch):
    """The smallest rows of each crowd; no crowd is sorted as a whole."""
    monkeypatch.setattr(splats.ranks, "number_rows", lambda *a: 1 / 0)
    points = spark.createDataFrame([(s, x, 100 - i) for s, x, n in ((1, 0.0, 90), (1, 2.0, 4), (1, 3.0, 3), (2, 0.0, 5)) for i in range(n)], "scene long, x double, row_index long").repartition(5)
    found = splats.crowds(points, ["scene", "x"], 3)
    assert {(r.scene, r.x, *r.first) for r in found.collect()} == {(1, 0.0, 11, 12, 13, 14), (1, 2.0, 97, 98, 99, 100), (2, 0.0, 96, 97, 98, 99)}
    assert found._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 2  # partial and final


def test_table_digest_holds_no_bucket(spark):
    """Hashes are made after the shuffle and hashed as they come; ties, nulls and other types as by definition."""
    rows = [(c, i * 31 % 400, w) for c in ("x", "y", None) for i in range(400) for w in (i % 7, None)] + [("z", None, 3), ("z", 5, 1)]
    df = spark.createDataFrame(rows, "k string, id long, v int")
    md5, sha = (lambda t, f=f: f(t.encode()).hexdigest() for f in (hashlib.md5, hashlib.sha256))
    for typed, form in ((df, lambda v: "null" if v is None else str(v)), (df.withColumn("v", F.col("v").cast("string")), lambda v: "null" if v is None else f'"{v}"')):
        want = set()
        for c in {r[0] for r in rows}:
            buckets = {}
            for _, i, v in (r for r in rows if r[0] == c):
                own = sha(f'{{"id":{"null" if i is None else i},"v":{form(v)}}}')
                buckets.setdefault(md5("" if i is None else str(i))[:3], []).append((i is not None, i or 0, own))
            want.add((c, sum(map(len, buckets.values())), sha("".join(b + sha("".join(h for *_, h in sorted(buckets[b]))) for b in sorted(buckets)))))
        size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
        try:
            for tasks in (None, 3):
                got = graph.table_digest(typed, "k", ["id"], tasks)
                assert {tuple(r) for r in got.collect()} == want
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        assert got._jdf.queryExecution().optimizedPlan().toString().count("collect_list(") == 1  # of buckets, not of rows
