import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenemill.llm import runs
from scenemill.llm.queries import queries, with_repetitions

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w):
    """All runs by comparing the words at every lag; a stretch's smallest period by trying all."""
    out, n = [], len(w)
    for q in range(1, n // 4 + 1):
        same = [w[i] == w[i + q] for i in range(n - q)] + [False]
        begin = None
        for i, s in enumerate(same):
            if s and begin is None:
                begin = i
            if not s and begin is not None:
                length = i - begin + q
                if length >= max(6, 4 * q) and not any(all(w[k] == w[k + r] for k in range(begin, begin + length - r)) for r in range(1, q)):
                    out.append((begin, length, q))
                begin = None
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def edited(doc_id, text):
    h, w = zlib.crc32(str(doc_id).encode()), WORD.findall(text or "")
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    return w


def test_query_against_brute_force(spark, sf_dir):
    rows = {r.doc_id: r for r in queries()["op12_periodic_runs"](spark, sf_dir).collect()}
    docs, some = spark.read.parquet(f"{sf_dir}/documents.parquet").collect(), 0
    assert len(rows) == len(docs)
    for d in docs:
        w, r = edited(d.doc_id, d.text), rows[d.doc_id]
        ids = {x: i for i, x in enumerate(dict.fromkeys(w))}
        numbers = np.array([ids[x] for x in w])
        found = brute(w) if len(w) < 700 else by_lags(numbers)
        best = max(found, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(found), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if found else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(kept(w, found).encode()).hexdigest()
        some += bool(found)
    assert some > 5


def by_lags(x):
    """As ``brute``, with numpy."""
    out = []
    for q in range(1, len(x) // 4 + 1):
        edge = np.flatnonzero(np.diff((x[:-q] == x[q:]).astype(int), prepend=0, append=0)).reshape(-1, 2)
        for a, b in edge[edge[:, 1] - edge[:, 0] + q >= max(6, 4 * q)].tolist():
            own = x[a : b + q]
            if not any((own[r:] == own[:-r]).all() for r in range(1, q)):
                out.append((a, b - a + q, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_all_periods(seed):
    """Runs of periods on both sides of every scale, nested, next to each other, broken in the middle."""
    rng = np.random.default_rng(seed)
    sequences = [np.empty(0, np.uint64)]
    for period in [1, 2, 3, 7, 8, 9, 15, 16, 17, 18, 31, 32, 33, 34, 63, 64, 65, 66, 100, 129]:
        block = rng.integers(0, (2, 4, 1000)[int(rng.integers(0, 3))], period)
        if rng.random() < 0.4:  # a block that is itself periodic
            block = np.resize(block[: max(1, period // 3)], period)
        parts = [rng.integers(0, 1000, int(rng.integers(0, 40)))]
        for copies in rng.uniform(3.5, 6.5, int(rng.integers(1, 4))):
            parts += [np.resize(block, int(period * copies)), rng.integers(0, 5, int(rng.integers(0, 7)))]
        x = np.concatenate(parts)
        if rng.random() < 0.5 and len(x):
            x[int(rng.integers(0, len(x)))] = 5000
        sequences.append(x.astype(np.uint64))
    sequences += [rng.integers(0, 2, 400).astype(np.uint64), np.zeros(300, np.uint64), np.resize([1, 2], 301).astype(np.uint64)]
    got = runs.find(sequences)
    assert got == [by_lags(x) for x in sequences]
    assert sum(map(len, got)) > 20


def test_words_that_make_fibonacci_strings():
    a, b = [1], [1, 2]
    while len(b) < 900:
        a, b = b, b + a
    for k in (1, 2, 3):
        x = np.array((b[:200] * (k + 3))[:1200], np.uint64)
        assert runs.find([x]) == [by_lags(x)]


def test_odd_rows(spark):
    long = " ".join(f"x{i % 7001}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n "), (4, "a " * 5), (5, "a " * 6), (5, "a " * 6), (None, "b c " * 4), (6, long), (2**62 + 1, "é𝄞 ü " * 9), (7, "A a " * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"runs": F.lit(1), "collapsed": F.lit(2)})
    got = {(r.doc_id, tuple((x.start, x.length, x.period) for x in r.runs), r.collapsed) for r in runs.periodic_runs(df).collect()}
    assert got == {
        (1, (), ""), (2, (), ""), (3, (), ""), (4, (), "a a a a a"), (5, ((0, 6, 1),), "a"), (None, ((0, 8, 2),), "b c"),
        (6, ((0, 30_000, 7001),), " ".join(long.split()[:7001])), (2**62 + 1, ((0, 18, 2),), "é𝄞 ü"), (7, (), "A a A a A a"),
    }
    assert runs.periodic_runs(df).count() == len(rows) and runs.periodic_runs(df.limit(0)).count() == 0


def test_edit(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(i % 40))) for i in range(300)] + [(None, "a b c d"), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, WORD.findall(r.text)) for r in with_repetitions(df).collect()]
    want = [(d, edited("" if d is None else d, t)) for d, t in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
