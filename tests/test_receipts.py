"""Grounds on which an experiment is refused, one by one."""

from scenemill.operators import receipts

SCHEMA = (
    "experiment_id long, path string, arm string, scene string, replicate long, provenance map<string,string>, trainer_sha256 string, "
    "trainer_environment map<string,string>, memory_budget_bytes long, profile string, iterations long, seed long, holdout_every long"
)
FINE = {"sort_ordering": "depth", "renderer_source_sha256": "m"}


def table(spark, changes):
    """One experiment for each change: two arms, two scenes, two replicates; a change is made to the first receipt."""
    rows, views = [], []
    for k, (change, view) in enumerate(changes):
        n = 0
        for arm in ("baseline", "candidate"):
            for scene in ("garden", "room"):
                for replicate in (1, 2):
                    row = dict(experiment_id=k, path=f"p{n}", arm=arm, scene=scene, replicate=replicate, provenance=FINE, trainer_sha256="t", trainer_environment={"A": "1"}, memory_budget_bytes=4, profile="balanced", iterations=10, seed=1, holdout_every=8)
                    if n == 0:
                        row |= change
                    rows.append(row)
                    views += [(k, row["path"], v) for v in ("v1", "v2") if n or v != view]
                    n += 1
    return spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA), spark.createDataFrame(views, "experiment_id long, path string, view_id string")


def test_every_ground(spark):
    changes = [
        ({}, None), ({"path": "p7"}, None), ({"replicate": 2}, None), ({"provenance": {"sort_ordering": "", "renderer_source_sha256": "m"}}, None), ({"provenance": None}, None),
        ({"provenance": FINE | {"sort_ordering": "tile"}}, None), ({"trainer_sha256": None}, None), ({"trainer_sha256": "u"}, None), ({"scene": "attic"}, None), ({}, "v2"), ({"arm": None}, None),
    ]
    runs, views = table(spark, changes)
    got = {}
    for r in receipts.refusals(runs, views).collect():
        got.setdefault(r.experiment_id, []).append((r.place, r.reason, r.n))
    assert {k: sorted(v) for k, v in got.items()} == {
        1: [(1, "duplicate_receipt", 1)], 2: [(2, "duplicate_replicate", 1)], 3: [(3, "missing_provenance", 1)], 4: [(3, "missing_provenance", 1)], 5: [(4, "renderer_mismatch", 2)],
        6: [(5, "missing_trainer", 1)], 7: [(6, "trainer_mismatch", 2)], 8: [(7, "scene_set_mismatch", 1)], 9: [(8, "view_set_mismatch", 1)], 10: [(7, "scene_set_mismatch", 1)],
    }
    assert 5 not in {r.experiment_id for r in receipts.refusals(runs, views, fatal_renderer=False).collect()}
    few = {(r.experiment_id, r.arm, r.scene): r.n for r in receipts.under_replicated(runs, 2).collect()}
    assert few == {(8, "baseline", "garden"): 1, (8, "baseline", "attic"): 1, (10, "baseline", "garden"): 1, (10, "?", "garden"): 1}


def test_what_tells_arms_apart(spark):
    runs, _ = table(spark, [({}, None), ({"trainer_sha256": None, "memory_budget_bytes": 8}, None), ({"trainer_environment": {"A": "2", "B": ""}}, None), ({"trainer_environment": None}, None)])
    got = {(r.experiment_id, r.difference): r.names for r in receipts.arms_differ(runs).collect()}
    assert got == {(0, "nothing"): None, (1, "trainer binary"): None, (1, "memory budget"): None, (2, "environment"): "A, B", (3, "environment"): "A"}


def test_scope(spark):
    runs, _ = table(spark, [({}, None), ({"seed": None, "profile": "fast"}, None), ({"iterations": 11, "holdout_every": None}, None)])
    got = sorted((r.experiment_id, r.path or "", r.problem) for r in receipts.out_of_scope(runs, {"profile": "balanced", "iterations": 10, "seed": 1, "holdout_every": 8}, 3).collect())
    assert got == sorted([(k, "", "scenes") for k in range(3)] + [(1, "p0", "no seed"), (1, "p0", "other profile"), (2, "p0", "no holdout_every"), (2, "p0", "other iterations")])
