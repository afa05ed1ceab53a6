"""Secret scans, with DataFrame functions only: fixed patterns, and Markov models of characters.

The models: in how many random strings and ordinary identifiers a pair of characters occurs, smoothed. Both
are trained on the first ``TRAIN_ROWS`` distinct texts in the order of their hash. Random strings are labelled by construction (base64,
hexadecimal and upper-case digests of those texts) and by the patterns (the values they capture); ordinary
identifiers are their tokens too short to be scored. Every token of ``LEAST`` characters or
more is scored. It is a span of kind ``random`` if its log-likelihood ratio per character is over ``threshold``
times 1 + 20 / length, and the sum over its distinct pairs, so that no line of one sign is random, over
``EVIDENCE`` times ``threshold``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds with their pattern, the group that must have a least length, and that length.
PATTERNS = {
    "assign": (r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
#: What a text must hold for a pattern to find anything; cheaper than the pattern.
PRESENT = {"assign": PATTERNS["assign"][0], "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}"}
LEAST, EVIDENCE = 16, 24.0
TOKEN = rf"[A-Za-z0-9+/_=-]{{{LEAST},}}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
TRAIN_ROWS = 4000
THRESHOLD = 1.0
_SPAN = "array<struct<kind:string,start:bigint,end:bigint>>"


def _found(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Spans of the leftmost matches that do not overlap, in code points, of those long enough.

    ``split`` and ``regexp_extract_all`` walk the same matches, so a match starts where the pieces and the
    matches before it end.
    """
    pieces, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    measured = matches if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    zipped = F.arrays_zip(pieces.alias("piece"), matches.alias("match"), measured.alias("measured"))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(_SPAN).alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["piece"])
        end = (begin + F.coalesce(F.length(x["match"]), F.lit(0))).cast("bigint")
        span = F.struct(F.lit(kind).alias("kind"), begin.cast("bigint").alias("start"), end.alias("end"))
        long_enough = F.coalesce(F.length(x["measured"]) >= least, F.lit(False))
        return F.struct(end.alias("at"), F.when(long_enough, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(zipped, start, step, lambda acc: acc["spans"])


def pattern_spans(text: Column, kind: str) -> Column:
    pattern, group, least = PATTERNS[kind]
    return F.when(text.rlike(PRESENT[kind]), _found(text, kind, pattern, group, least)).otherwise(F.array().cast(_SPAN))


def train(docs: DataFrame, text_col: str = "text", train_rows: int = TRAIN_ROWS) -> dict[str, float]:
    """Log-likelihood ratio of each pair of characters of ALPHABET (at most 67 * 67 of them)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    hashed = docs.select(text.alias("t")).withColumn("h", F.xxhash64("t"))
    last = hashed.select("h").distinct().orderBy("h").limit(train_rows).agg(F.max("h")).first()[0]
    sample = hashed.where(F.col("h") <= F.lit(last).cast("long")).groupBy("h").agg(F.min("t").alias("t"))
    digest = F.unhex(F.sha2("t", 512))
    made = F.array(F.base64(digest), F.lower(F.hex(digest)), F.translate(F.base64(digest), "abcdefghijklmnopqrstuvwxyz+/=", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    caught = F.concat(*[
        F.when(F.col("t").rlike(PRESENT[k]), F.filter(F.regexp_extract_all("t", F.lit(p), F.lit(g)), lambda x, n=n: F.length(x) >= n)).otherwise(F.array().cast("array<string>"))
        for k, (p, g, n) in PATTERNS.items()
    ])
    words = F.regexp_extract_all("t", F.lit(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{4,%d}(?![A-Za-z0-9+/_=-])" % (LEAST - 1)), F.lit(0))
    labelled = sample.select(F.explode(F.array(
        F.struct(F.lit(True).alias("random"), F.concat(made, caught).alias("all")), F.struct(F.lit(False).alias("random"), words.alias("all"))
    )).alias("x")).select("x.random", F.explode("x.all").alias("s"))
    pairs = labelled.where("length(s) > 1").select("random", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("s") - 1), lambda i: F.substring("s", i, F.lit(2))))).alias("pair"))
    counts = pairs.groupBy("random", "pair").agg(F.count("*").alias("n"))
    table = {(r["random"], r["pair"]): r["n"] for r in counts.collect() if len(r["pair"]) == 2 and set(r["pair"]) <= set(ALPHABET)}
    out, weight = {}, 5.0  # a pair counts with its second character's own share, as if met 5 times more
    ends = {k: {b: sum(table.get((k, a + b), 0) for a in ALPHABET) for b in ALPHABET} for k in (False, True)}
    share = {k: {b: (ends[k][b] + 0.5) / (sum(ends[k].values()) + 0.5 * len(ALPHABET)) for b in ALPHABET} for k in (False, True)}
    for a in ALPHABET:
        totals = {k: sum(table.get((k, a + b), 0) for b in ALPHABET) for k in (False, True)}
        for b in ALPHABET:
            logs = {k: math.log((table.get((k, a + b), 0) + weight * share[k][b]) / (totals[k] + weight)) for k in (False, True)}
            out[a + b] = logs[True] - logs[False]
    return out


def random_spans(text: Column, ratios: dict[str, float], threshold: float = THRESHOLD, least: int = LEAST) -> Column:
    size = len(ALPHABET)
    values = ", ".join(f"{ratios.get(a + b, 0.0):.6f}D" for a in ALPHABET for b in ALPHABET)
    table, letters = F.expr(f"array({values})"), F.lit(ALPHABET)

    def random(token: Column) -> Column:
        codes, n = F.transform(F.split(token, ""), lambda c: F.instr(letters, c) - 1), F.length(token)
        steps = F.zip_with(F.slice(codes, 1, n - 1), F.slice(codes, 2, n - 1), lambda a, b: a * size + b)
        total = lambda at: F.aggregate(at, F.lit(0.0), lambda acc, i: acc + F.get(table, i))
        return (total(steps) / (n - 1) > threshold * (1 + 20 / n)) & (total(F.array_distinct(steps)) > EVIDENCE * threshold)

    spans = _found(text, "random", TOKEN, 0, least)
    cut_out = lambda s: F.substring(text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
    return F.when(text.rlike(TOKEN), F.filter(spans, lambda s: random(cut_out(s)))).otherwise(F.array().cast(_SPAN))


def scan(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``docs`` with ``spans``: array of (kind, start, end), by start and then kind as in assign, access, hex, random.

    Offsets are code points, ends exclusive. A null text has no spans. Spans of different kinds may overlap.
    A column of ``docs`` named spans is replaced. Rows keep their order and number, repeated or not.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = [pattern_spans(text, kind) for kind in PATTERNS]
    every = F.concat(*base, random_spans(text, train(docs, text_col, train_rows), threshold))
    rank = {"assign": 0, "access": 1, "hex": 2, "random": 3}
    order = F.create_map(*[F.lit(x) for kv in rank.items() for x in kv])
    keyed = F.array_sort(F.transform(every, lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return docs.withColumn("spans", F.transform(keyed, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", **options) -> DataFrame:
    """``docs`` with every span of ``scan`` in the text replaced by ``mark`` (overlapping ones by one mark).

    n_chars, where there is such a column, follows; rows without spans stay as they are, and none goes.
    """
    found = scan(docs.withColumnRenamed("spans", "_own_spans"), text_col, **options)
    text = F.col(text_col).cast("string")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        fresh = (s["start"] >= acc["at"]) | (acc["at"] == 0)
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    done = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    new = F.when(F.size("spans") > 0, done).otherwise(text)
    out = found.withColumn(text_col, new).drop("spans").withColumnRenamed("_own_spans", "spans")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(text_col).isNull(), F.col("n_chars")).otherwise(F.length(text_col).cast("long")))
    return out.select(*docs.columns)
