"""The mapper's log profile on hand-made logs: figures of a good one, and one log for each fault."""

import re

import pytest

from scenemill.operators import logs
from scenemill.plans.views import view

AT = "I20240101 00:00:{:02d}.5 71 mapper.cc:9] {}"
FIELDS = ["   Residuals : 10", "  Parameters : 4", "  Iterations : 3", "        Time : 1.5 [s]", "Initial cost : 2 [px]", "  Final cost : 1 [px]", " Termination : Convergence"]
BUNDLE, POSE = AT.format(3, "Bundle adjustment report"), AT.format(3, "Pose refinement report")
REGISTER, GLOBAL = AT.format(1, "Registering image #4 (num_reg_frames=2)"), AT.format(1, "Global bundle adjustment")
KEEP, END = AT.format(9, "Keeping successful reconstruction"), AT.format(10, "Elapsed time: 0.5 [minutes]")
GOOD = [REGISTER, POSE, *FIELDS, "", BUNDLE, *FIELDS, AT.format(3, "Global bundle adjustment"), BUNDLE, *FIELDS, KEEP, END]


def swap(k, line):
    return [*FIELDS[:k], line, *FIELDS[k + 1 :]]


FAULTS = {
    "empty_log": ["", None, "  "],
    "no_timestamps": ["hello"],
    "invalid_timestamp": [AT.format(61, "x"), KEEP, END],
    "backwards_timestamp": [AT.format(5, "x"), REGISTER, KEEP, END],
    "invalid_elapsed": [REGISTER, KEEP, AT.format(10, "Elapsed time: 01 [minutes]")],
    "no_elapsed": [REGISTER, KEEP],
    "elapsed_not_last": [REGISTER, KEEP, END, AT.format(11, "x")],
    "no_span": [AT.format(10, "x"), END],
    "nested_report": [REGISTER, BUNDLE, POSE, *FIELDS, KEEP, END],
    "incomplete_report": [REGISTER, BUNDLE, *FIELDS[:-1], KEEP, END],
    "no_solver_report": [GLOBAL, KEEP, END],
    "unknown_report": [AT.format(1, "x"), BUNDLE, *FIELDS, KEEP, END],
    "outside_report": [REGISTER, FIELDS[0], KEEP, END],
    "invalid_field": [REGISTER, BUNDLE, "  Weights : 3", *FIELDS, KEEP, END],
    "invalid_integer": [REGISTER, BUNDLE, *swap(0, "Residuals : 1.5"), KEEP, END],
    "invalid_number": [REGISTER, BUNDLE, *swap(3, "Time : 1d [s]"), KEEP, END],
    "nonfinite": [REGISTER, BUNDLE, *swap(3, "Time : 1e999 [s]"), KEEP, END],
    "negative": [REGISTER, BUNDLE, *swap(1, "Parameters : -1"), KEEP, END],
    "invalid_termination": [REGISTER, BUNDLE, *swap(6, "Termination : 7"), KEEP, END],
    "duplicate_field": [REGISTER, BUNDLE, FIELDS[0], *FIELDS, KEEP, END],
    "missing_field": [REGISTER, BUNDLE, *FIELDS[1:], KEEP, END],
    "no_completion": [REGISTER, BUNDLE, *FIELDS, END],
    "solver_exceeds_wall": [REGISTER, BUNDLE, *swap(3, "Time : 900 [s]"), KEEP, END],
    "solver_exceeds_regions": [AT.format(2, "Global bundle adjustment"), BUNDLE, *swap(3, "Time : 2 [s]"), AT.format(3, "Registering image #4 (num_reg_frames=2)"), KEEP, END],
}


@pytest.fixture(scope="module")
def found(spark):
    known = {"good": GOOD, **FAULTS}
    rows = [(name, 7 * i, line) for name, text in known.items() for i, line in enumerate(text)]
    df = spark.createDataFrame(rows, "log_id string, line_no long, line string").repartition(5)
    return {r.log_id: r for r in logs.mapper_profile(df).collect()}


def test_each_fault_is_told(found):
    assert {k: r.reason for k, r in found.items()} == {"good": None, **{k: k for k in FAULTS}}
    assert found["duplicate_field"].reason_line == 7 * 3 and found["no_solver_report"].reason_line == 7
    assert found["backwards_timestamp"].reason_line == 7 and found["no_completion"].reason_line is None
    assert found["negative"].pose_seconds is None


def test_figures(found):
    r = found["good"]
    assert (r.registrations, r.initial_globals, r.later_globals, r.pose_reports, r.local_reports, r.global_reports) == (1, 1, 0, 1, 1, 1)
    assert (r.pose_seconds, r.local_seconds, r.global_seconds, r.region_seconds, r.wall_seconds) == (1.5, 1.5, 1.5, 6.0, 9.0)
    assert r.bundle_share == pytest.approx(1 / 3) and r.region_share == pytest.approx(2 / 3)
    assert r.speedup_2 == pytest.approx(1.2) and r.limit == pytest.approx(1.5)


def test_wall_times_of_others(spark):
    rows = [(k, i, line) for k in range(5) for i, line in enumerate(GOOD)]
    df = spark.createDataFrame(rows, "log_id long, line_no long, line string")
    walls = spark.createDataFrame([(0, 18.0), (1, 8.0), (2, -1.0), (3, float("nan"))], "log_id long, wall_seconds double")
    got = {r.log_id: r for r in logs.mapper_profile(df, walls).collect()}
    assert [got[k].reason for k in range(5)] == [None, "wall_too_short", "invalid_wall", "invalid_wall", None]
    assert got[0].bundle_share == pytest.approx(1 / 6) and got[4].wall_seconds == 9.0
    assert logs.mapper_profile(df.limit(0)).count() == 0


def test_lines_are_sorted_once_by_code_that_is_compiled(spark, sf_dir):
    """The JVM interprets methods of over 8,000 bytes; a log's lines are sorted once, for all that looks above a line."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        run = logs.mapper_profile(view(spark, sf_dir, "mapper_log"))._jdf.queryExecution()
        code = run.explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen"))
        assert run.executedPlan().toString().count("Sort [log_id") == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert sizes and max(sizes) <= 8000
