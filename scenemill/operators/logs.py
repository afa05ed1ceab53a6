"""Solver logs as rows of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def mapping_profile(lines: DataFrame, phases: dict[str, str], report: str) -> DataFrame:
    """(log_id, phase, reports, total, share, speedup_2, limit): each solver report belongs to the last phase
    whose marker stands above it. ``report`` has one group, the time. Speed-ups follow Amdahl's law."""
    marker = F.coalesce(*[F.when(F.col("line").rlike(p), F.lit(name)) for name, p in phases.items()])
    by_line = W.partitionBy("log_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    marked = lines.withColumn("_m", marker).withColumn("phase", F.last("_m", ignorenulls=True).over(by_line))
    spent = marked.withColumn("_t", F.regexp_extract("line", report, 1)).where("_t <> '' and phase is not null")
    sums = spent.groupBy("log_id", "phase").agg(F.count("*").alias("reports"), F.sum(F.col("_t").cast("double")).alias("total"))
    share = F.col("total") / F.nullif(F.sum("total").over(W.partitionBy("log_id")), F.lit(0.0))
    return sums.withColumn("share", share).withColumn("speedup_2", 1 / (1 - F.col("share") / 2)).withColumn("limit", F.when(F.col("share") < 1, 1 / (1 - F.col("share"))))


def log_progress(lines: DataFrame, pattern: str, total: float) -> DataFrame:
    """(log_id, line_no, progress): only increases of the share that a line reports, at most 0.99."""
    w = W.partitionBy("log_id").orderBy("line_no")
    said = lines.withColumn("_p", F.regexp_extract("line", pattern, 1)).where("_p <> ''")
    said = said.withColumn("progress", F.least(F.lit(0.99), F.col("_p").cast("double") / total))
    before = F.max("progress").over(w.rowsBetween(W.unboundedPreceding, -1))
    return said.withColumn("_b", before).where("_b is null or progress > _b").select("log_id", "line_no", "progress")


#: What a mapper's log says.
STAMP = r"^[IWEF]\d{8} (?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d\.\d{1,6} \S+ [^\]]+(\] ?.*)$"  # all before the message has a fixed place
GLOBAL_MARKERS = ("Global bundle adjustment", "Retriangulation and Global bundle adjustment")
REPORT_MARKERS = ("Pose refinement report", "Bundle adjustment report")
NAME = r"^\s*(Residuals|Parameters|Iterations|Time|Initial cost|Final cost|Termination)\s*:"
FIELDS = {
    "residuals": r"^[^:]*:\s*(\S+)\s*$",
    "parameters": r"^[^:]*:\s*(\S+)\s*$",
    "iterations": r"^[^:]*:\s*(\S+)\s*$",
    "time": r"^[^:]*:\s*(\S+)\s*\[s\]\s*$",
    "initial_cost": r"^[^:]*:\s*(\S+)\s*\[px\]\s*$",
    "final_cost": r"^[^:]*:\s*(\S+)\s*\[px\]\s*$",
    "termination": r"^[^:]*:\s*(.*?)\s*$",
}
TOLERANCE = 0.001


def _stamped(lines: DataFrame) -> DataFrame:
    """Lines with ``at`` (microseconds, null without a valid time), ``said`` (the message) and ``field``, ``value``.

    A line is matched against the stamp or the fields' names once, and then only against the pattern of its field.
    """
    line = F.col("line")
    part = lambda first, n: line.substr(first, n)
    out = lines.withColumn("_after", F.when(part(1, 1).isin(*"IWEF"), F.regexp_extract(line, STAMP, 1)).otherwise(""))
    day = F.unix_date(F.concat_ws("-", part(2, 4), part(6, 2), part(8, 2)).try_cast("date"))
    hours, minutes, seconds = (part(k, 2).cast("bigint") for k in (11, 14, 17))
    fraction = F.rpad(F.substring_index(part(20, 7), " ", 1), 6, "0").cast("bigint")
    at = (((day.cast("bigint") * 24 + hours) * 60 + minutes) * 60 + seconds) * 1_000_000 + fraction
    out = out.withColumn("at", F.when(F.col("_after") != "", at)).withColumn("said", F.when(F.col("at").isNotNull(), F.trim(F.substr("_after", F.lit(2)))))
    name = F.replace(F.lower(F.regexp_extract(line, NAME, 1)), F.lit(" "), F.lit("_"))
    out = out.withColumn("_name", F.when(F.col("at").isNull() & line.contains(":"), name))
    alike = {p: [n for n in FIELDS if FIELDS[n] == p] for p in FIELDS.values()}
    value = F.coalesce(*[F.when(F.col("_name").isin(*names) & (line.rlike(p) if "termination" in names else F.lit(True)), F.regexp_extract(line, p, 1)) for p, names in alike.items()])
    out = out.withColumn("value", value).withColumn("field", F.when((F.col("value") != "") | (F.col("_name") == "termination") & F.col("value").isNotNull(), F.col("_name")))
    return out.withColumn("value", F.when(F.col("field").isNotNull(), F.col("value"))).drop("_after", "_name")


def _with_faults(lines: DataFrame) -> DataFrame:
    """Adds ``number`` and ``fault``: why the value of a report's field cannot be used."""
    kind, value = F.col("field"), F.col("value")
    parsed = F.when(kind != "termination", value.try_cast("double"))
    plain = F.coalesce(~F.isnan("number") & (F.abs("number") != float("inf")), F.lit(False))
    lettered = F.translate(value, "dDfF", "") != value
    real = F.when(F.lower(value).rlike(r"^[+-]?(nan|inf|infinity)$"), F.lit(float("inf"))).otherwise(F.col("number"))
    unusual = (
        F.when(real.isNull() | (lettered & ~value.rlike(r"^[+-]?(?i:inf|infinity)$")), "invalid_number")
        .when(real == float("inf"), "nonfinite")
        .when(real < 0, "negative")
    )
    fault = (
        F.when(kind == "termination", F.when(~value.rlike("^[A-Za-z][A-Za-z_ -]*$"), "invalid_termination"))
        .when(kind.isin("residuals", "parameters", "iterations") & ~value.rlike(r"^[+-]?\d+$"), "invalid_integer")
        .when(plain & ~lettered, F.when(F.col("number") < 0, "negative"))
        .otherwise(unusual)
    )
    return lines.withColumn("number", parsed).withColumn("fault", fault)


def mapper_profile(lines: DataFrame, walls: DataFrame | None = None) -> DataFrame:
    """One row for each log: reports, solver seconds, global regions, shares and Amdahl's speed-ups, or a reason.

    A global region is the time from a global marker to the first registration or end of a reconstruction after it;
    a bundle report is global or local by the last of these above it. A log that is damaged has ``reason``, of its
    first fault (times are checked before reports), ``reason_line`` where a line shows it, and no figures.
    lines: (log_id, line_no, line), line_no tells a log's lines apart; a null line is a blank one. walls: (log_id,
    wall_seconds), one row a log; without it, or without its row, the wall time is the span of the times. Lines are
    read after their shuffle, so that making and reading them are two methods, each small enough for the JVM to compile
    (8,000 bytes); a larger one runs interpreted. What the lines of a log say is sorted once, in one partition, which
    spills; nothing of a log is held as a whole.
    """
    by = W.partitionBy("log_id")
    above = by.orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    last = lambda c: F.last(c, ignorenulls=True).over(above)
    own = lines.select("log_id", F.col("line_no").cast("long").alias("line_no"), F.coalesce("line", F.lit("")).alias("line"))
    own = _with_faults(_stamped(own.repartition("log_id")))
    said, event, line = F.col("said"), F.col("at").isNotNull(), F.col("line")
    says = (
        F.when(said == GLOBAL_MARKERS[0], "initial")
        .when(said == GLOBAL_MARKERS[1], "later")
        .when(said == REPORT_MARKERS[0], "pose")
        .when(said == REPORT_MARKERS[1], "bundle")
        .when(said.startswith("Elapsed time:"), "elapsed")
        .when(said.startswith("Keeping successful reconstruction") | said.startswith("Discarding reconstruction"), "ended")
        .when(said.startswith("Registering"), F.when(said.rlike(r"^Registering image #\d+ \(num_reg_frames=\d+\)$"), "R"))
    )
    unsound = F.when(
        event, F.when((F.col("says") == "elapsed") & ~said.rlike(r"^Elapsed time: (?:0|[1-9]\d*)(?:\.\d+)? \[minutes\]$"), "invalid_elapsed")
    ).otherwise(F.when(line.rlike(r"^[IWEF]\d{8}\s"), "invalid_timestamp"))
    text = event | F.col("field").isNotNull() | line.rlike(r"\S")
    stray = F.col("field").isNotNull() | F.when(~event & line.contains("report"), F.regexp_replace("line", r"^\s+|\s+$", "").isin(*REPORT_MARKERS)).otherwise(False)
    seconds = F.when(F.col("field") == "time", F.col("number"))
    own = own.withColumn("says", says)
    own = own.select("log_id", "line_no", "at", "field", "fault", "says", unsound.alias("unsound"), text.alias("text"), stray.alias("stray"), seconds.alias("seconds"))
    says, opens = F.col("says"), F.coalesce(F.col("says").isin("pose", "bundle"), F.lit(False))
    turn = F.when(opens, 1).when(F.col("field") == "termination", 0)
    early = F.when(F.col("at") < last("at"), "backwards_timestamp").otherwise(F.col("unsound"))
    seen = {n: F.coalesce(last(F.when(F.col("field") == n, F.col("line_no"))) > last(F.when(opens, F.col("line_no"))), F.lit(False)) for n in FIELDS}  # in this report
    again = F.coalesce(*[F.when(F.col("field") == n, c) for n, c in seen.items()])
    missing = (F.col("field") == "termination") & (sum(c.cast("int") for n, c in seen.items() if n != "termination") != len(FIELDS) - 1)
    inside = F.coalesce(last(turn) == 1, F.lit(False))
    own = own.select("*", early.alias("early"), again.alias("again"), missing.alias("missing"), inside.alias("inside"))
    own = own.withColumn("_final", F.max(F.when(says == "elapsed", F.col("line_no"))).over(by))
    event, ended = F.col("at").isNotNull(), F.coalesce(says == "ended", F.lit(False))
    marked = F.when(says.isin("initial", "later"), "G").when(says == "R", "R").when(ended | (says == "elapsed") & (F.col("line_no") == F.col("_final")), "E")
    own = own.withColumn("marked", marked).withColumn("mode", last("marked"))
    phase = F.when(says == "pose", "pose").when(says == "bundle", F.when(F.col("mode") == "G", "global").when(F.col("mode") == "R", "local").otherwise("unknown"))
    own = own.withColumn("_phase", phase).withColumn("phase", last("_phase"))
    settled = F.when(F.col("marked") == "G", "G").when(F.col("marked").isNotNull() | (F.col("inside") & (F.col("field") == "termination") & (F.col("phase") == "global")), "done")
    own = own.withColumn("pending", F.coalesce(last(settled) == "G", F.lit(False)))
    late = (
        F.when(event & F.col("inside"), F.when(opens, "nested_report").otherwise("incomplete_report"))
        .when(event, F.when(F.col("marked").isNotNull() & F.col("pending"), "no_solver_report").when(F.col("_phase") == "unknown", "unknown_report"))
        .when(~F.col("inside"), F.when(F.col("stray"), "outside_report"))
        .when(F.col("text"), F.coalesce(F.when(F.col("field").isNull(), "invalid_field"), "fault", F.when(F.col("again"), "duplicate_field"), F.when(F.col("missing"), "missing_field")))
    )
    own = own.withColumn("late", late)
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("line_no", c))).alias("_" + c)
    spent = lambda p: F.coalesce(F.sum(F.when(F.col("inside") & (F.col("phase") == p), F.col("seconds"))), F.lit(0.0)).alias(p + "_seconds")
    opened = (F.col("marked") == "G") & (F.coalesce(F.col("mode"), F.lit("")) != "G")
    closed = F.col("marked").isin("R", "E") & (F.col("mode") == "G")
    logs = own.groupBy("log_id").agg(
        first("early"), first("late"), F.max("text").alias("_any"), F.min("at").alias("_from"), F.max("at").alias("_to"), F.max("_final").alias("_final"),
        F.max(F.when(event, F.col("line_no"))).alias("_stamp"), F.max(ended).alias("_ended"), F.max_by(turn, F.when(turn.isNotNull(), F.col("line_no"))).alias("_open"),
        F.count_if(says == "R").alias("registrations"), F.count_if(says == "initial").alias("initial_globals"), F.count_if(says == "later").alias("later_globals"),
        *[F.count_if(F.col("_phase") == p).alias(p + "_reports") for p in ("pose", "local", "global")], *[spent(p) for p in ("pose", "local", "global")],
        (F.coalesce(F.sum(F.when(closed, F.col("at")).when(opened, -F.col("at"))), F.lit(0)) / 1e6).alias("region_seconds"),
    )
    logs = logs.withColumn("span_seconds", (F.col("_to") - F.col("_from")) / 1e6)
    logs = logs.join(walls.select("log_id", F.col("wall_seconds").cast("double").alias("_wall")), "log_id", "left") if walls is not None else logs.withColumn("_wall", F.lit(None).cast("double"))
    logs = logs.withColumn("wall_seconds", F.coalesce("_wall", "span_seconds"))
    bundle = F.col("local_seconds") + F.col("global_seconds")
    odd = F.isnan("_wall") | (F.abs("_wall") == float("inf")) | (F.col("_wall") <= 0)
    reason = (
        F.when(~F.col("_any"), "empty_log")
        .when(F.col("_early").isNotNull(), F.col("_early.early"))
        .when(F.col("_stamp").isNull(), "no_timestamps")
        .when(F.col("_final").isNull(), "no_elapsed")
        .when(F.col("_final") != F.col("_stamp"), "elapsed_not_last")
        .when(F.col("_to") <= F.col("_from"), "no_span")
        .when(F.col("_late").isNotNull(), F.col("_late.late"))
        .when(F.col("_open") == 1, "ends_in_report")
        .when(~F.col("_ended"), "no_completion")
        .when(odd, "invalid_wall")
        .when(F.col("_wall") + TOLERANCE < F.col("span_seconds"), "wall_too_short")
        .when(F.col("pose_seconds") + bundle > F.col("wall_seconds") + TOLERANCE, "solver_exceeds_wall")
        .when(F.col("global_seconds") > F.col("region_seconds") + TOLERANCE, "solver_exceeds_regions")
    )
    where = F.when(F.col("reason") == F.col("_early.early"), F.col("_early.line_no")).when(F.col("reason") == F.col("_late.late"), F.col("_late.line_no"))
    share = F.least(F.lit(1.0), bundle / F.col("wall_seconds"))
    figures = {
        **{c: F.col(c) for c in ("registrations", "initial_globals", "later_globals", "pose_reports", "local_reports", "global_reports", "pose_seconds", "local_seconds", "global_seconds", "region_seconds", "wall_seconds")},
        "bundle_share": share,
        "region_share": F.least(F.lit(1.0), F.col("region_seconds") / F.col("wall_seconds")),
        **{f"speedup_{n}": 1 / (1 - share + share / n) for n in (2, 5, 10)},
        "limit": F.when(share < 1, 1 / F.nullif(1 - share, F.lit(0.0))),
    }
    return logs.withColumn("reason", reason).select("log_id", "reason", where.alias("reason_line"), *[F.when(F.col("reason").isNull(), c).alias(n) for n, c in figures.items()])
