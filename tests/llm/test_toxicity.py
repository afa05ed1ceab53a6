import zlib

import numpy as np
from pyspark.sql import functions as F

from scenemill.llm import toxicity
from scenemill.llm.queries import queries

CLEAN = "thering onderful ation thought readly sunlight harbor window garden letter morning silver common".split()
BAD = ["moronic", "idiotly", "scumling"]


def corpus(spark, n=400):
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = list(rng.choice(CLEAN, 30)) + ([str(rng.choice(BAD))] if toxic else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out(spark, sf_dir):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    got = queries()["op6_toxicity"](spark, "/root/testdata/sf0.01").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert np.mean([p == y for p, y in held]) > 0.93


def test_hidden_words_are_restored(spark):
    rows, labels = corpus(spark)
    rows += [(1000, "garden m0r0nic window " * 2), (1001, "harbor i d i o t l y letter"), (1002, "morning sccccumling common"), (1003, "letter 1d1otly silver"), (1004, "sunlight 2024 window 10 letter"), (1005, None), (1006, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"toxic": F.lit(0), "fold": F.lit("x")})
    known = spark.createDataFrame(labels + [(1, None), (2, 7)], "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    got = {r.doc_id: r.predicted for r in toxicity.score(df, known).collect()}
    wrong = [i for i, y in labels if got[i] != y]
    assert not wrong and [got[i] for i in range(1000, 1007)] == [1, 1, 1, 1, 0, 0, 0]
    kept = toxicity.drop_toxic(df, known)
    assert kept.columns == df.columns and kept.count() == sum(1 - v for v in got.values())


def test_no_labels_no_rows(spark):
    rows, _ = corpus(spark, 8)
    df = spark.createDataFrame([*rows, (None, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.score(df, none).collect()} == {0}
    assert toxicity.score(df.limit(0), none).count() == 0


def test_words_hidden_at_their_edges_and_in_runs(spark):
    rows, labels = corpus(spark)
    spaced = lambda *words: " ".join("".join(words))
    hidden = [
        "garden $cumling window", "garden !diotly window", "harbor |diotly", "letter moron!c$ silver", spaced("you", "moronic"),
        "window " + spaced("thought", "sunlight", "garden", "idiotly", "letter", "morning", "silver") + " garden",
        spaced(*["window"] * 30, "scumling", *["garden"] * 30), spaced("garden", "1d10tly", "window"),
    ]
    plain = ["garden! -window- |letter| $silver", spaced("thought", "sunlight", "garden", "letter", "morning", "silver") + " window", spaced(*["window"] * 60), "1 2 3 4 5 6 7 8", ". . . . - - * * *"]
    df = spark.createDataFrame(rows + [(1000 + i, t) for i, t in enumerate(hidden + plain)], "doc_id long, text string")
    got = {r.doc_id: r.predicted for r in toxicity.score(df, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert [got[1000 + i] for i in range(len(hidden + plain))] == [1] * len(hidden) + [0] * len(plain)


def test_rare_toxic_words_among_many_common_ones(spark):
    rng = np.random.default_rng(3)
    common = ["".join(w) for w in rng.choice(list("abcdefghijklmnopqrstuvwxyz"), (6000, 8))]
    rows = [(i, " ".join(common + ["moronic"] * (i % 4 == 0))) for i in range(60)]
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(60)], "doc_id long, toxic int")
    weights = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), labels).weights
    assert weights["=moronic"] > 0 and not set(weights) & {"=" + w for w in common}


def test_long_tokens_and_wide_gaps(spark):
    rows, labels = corpus(spark)
    filler = "thering" * 12
    hidden = [
        "window " + filler[:80] + "-m0r0nic garden", "-".join(["window"] * 40) + "-1d1otly", "harbor i  d  i   o\tt  l  y letter",
        " ".join("sunlightgardenmorningharborwindowsilverletter" + "scumling" + "onderfulthought"), "letter 5(um1ing silver", "m*o*r*o*n*i*c window",
    ]
    assert len(hidden[3].replace(" ", "")) > 60
    plain = [filler * 3 + " garden", "a  b  c  d  e  f", "2006 26 6 (c) 2026", "x" * 50_000 + " window", "9a" * 20_000]
    df = spark.createDataFrame(rows + [(1000 + i, t) for i, t in enumerate(hidden + plain)], "doc_id long, text string")
    got = {r.doc_id: r.predicted for r in toxicity.score(df, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert [got[1000 + i] for i in range(len(hidden + plain))] == [1] * len(hidden) + [0] * len(plain)


def brute_restore(restore, token):
    """Every path through the lattice, by plain recursion over characters read."""
    best = None

    def go(i, a, b, value, said):
        nonlocal best
        if i == len(token):
            best = max(best or (-1e9, ""), (value + restore.log[a][b][0], said))
            return
        for n, letter, cost in restore.options(token, i):
            if letter:
                c = ord(letter) - 96 if "a" <= letter <= "z" else 27
                go(i + n, b, c, value + restore.log[a][b][c] - cost, said + letter)
            else:
                go(i + n, a, b, value - cost - 2.0, said)

    go(0, 0, 0, 0.0, "")
    return best[1]


def test_viterbi_is_the_best_path():
    counts = np.random.default_rng(0).integers(0, 50, 28**3)
    restore = toxicity.Restorer(counts)
    for token in ["m0r0n", "1d10t", "phvv00d", "sccc-um", "60od", "(u7e", "a", "$$", "p-h-1-l", "é1x"]:
        assert restore(token) == brute_restore(restore, token)
    assert len(restore("a1" * 30_000)) > 20_000


def test_repeated_ids_train_once_and_rows_stay(spark):
    rows, labels = corpus(spark)
    hot = [(1, "garden window")] * 3000 + [(2, None), (2, ""), (None, "moronic"), (None, None)]
    df = spark.createDataFrame(rows + hot, "doc_id long, text string").withColumns({"toxic": F.lit(1), "score": F.lit("x"), "fold": F.lit(2)})
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.score(df, known)
    assert got.count() == len(rows) + len(hot) and got.where("doc_id is null and predicted = 1").count() == 1
    kept = toxicity.drop_toxic(df, known)
    assert kept.columns == df.columns and kept.where("doc_id = 1").count() == 3001
