import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scenemill.llm import packing
from scenemill.llm.queries import queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", "a<|endoftext|>b", "  x \n\n y\t", "　 x y", "naïve 12 ½ ٣ 日本", "emoji 😀 z", "don't 'S can't", "x " * 30000, "\x85a\x1cb", "same text", "same text"]


def check(pieces, texts, window=1024):
    """texts: (doc_id, text) in any order; ids may repeat."""
    bpe = Tokenizer.from_file(PATH)
    want = sorted((d, zlib.crc32(np.array(bpe.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes()), len(bpe.encode(t or "", add_special_tokens=False).ids) + 1) for d, t in texts)
    docs, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(bytes(p.ids), "<u2").astype("<u4")
        assert len(ids) == p.length
        docs[p.doc_id].append((p.start, ids, p.doc_tokens))
        sequences[p.sequence_id].append((p.offset, p.length))
    assert sum(len(ids) for v in docs.values() for _, ids, _ in v) == sum(n for _, _, n in want)
    counts = defaultdict(int)
    for d, _ in texts:
        counts[d] += 1
    for d, crc, n in want:
        if counts[d] == 1:
            own = sorted(docs[d], key=lambda x: x[0])
            whole = np.concatenate([ids for _, ids, _ in own])
            assert [s for s, _, _ in own] == np.cumsum([0] + [len(i) for _, i, _ in own])[:-1].tolist() and {m for _, _, m in own} == {n}
            assert zlib.crc32(whole.tobytes()) == crc
    padding = 0
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert check(packing.pack(docs, PATH).collect(), [(r.doc_id, r.text) for r in docs.collect()]) < 1024
    rows = queries()["op7_packing"](spark, sf_dir).collect()
    assert sum(r.length for r in rows) == sum({r.doc_id: r.doc_tokens for r in rows}.values())


def test_odd_texts(spark):
    texts = list(enumerate(ODD))
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"start": F.lit(1), "length": F.lit("x"), "ids": F.lit(2)})
    assert check(packing.pack(df, PATH).collect(), texts) < 1024
    again = [(1, "same text")] * 5 + [(None, "no id")]
    assert sum(p.length for p in packing.pack(spark.createDataFrame(again, "doc_id long, text string"), PATH).collect()) == sum(len(Tokenizer.from_file(PATH).encode(t).ids) + 1 for _, t in again)
    assert packing.pack(df.limit(0), PATH).count() == 0


def test_counts_stay_within_the_histogram():
    rng = np.random.default_rng(0)
    histogram = np.bincount(rng.integers(1, 64, 3000), minlength=64)
    combos, counts = packing.solve_counts(histogram, 64)
    used = np.zeros(64, np.int64)
    for combo, n in zip(combos, counts, strict=True):
        assert combo.sum() == 64 or (np.count_nonzero(combo) == 1 and combo.sum() & (combo.sum() - 1) == 0)
        for length in combo[combo > 0]:
            used[length] += n
    assert (used <= histogram).all() and used.sum() > 0.9 * histogram.sum()


def exact(a, b):
    """The non-negative least squares solution, by an active set."""
    free, x = np.zeros(a.shape[1], bool), np.zeros(a.shape[1])
    while True:
        pull = a.T @ (b - a @ x)
        pull[free] = -1
        if free.all() or pull.max() < 1e-9:
            return x
        free[np.argmax(pull)] = True
        while True:
            s = np.zeros(len(x))
            s[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if s[free].min() > 1e-12:
                x = s
                break
            low = free & (s <= 1e-12)
            x = x + (x[low] / (x[low] - s[low])).min() * (s - x)
            free &= x > 1e-12
            x[~free] = 0


def test_least_squares_are_those_of_an_active_set():
    rng = np.random.default_rng(1)
    for window in (8, 12, 16):
        have = np.bincount(rng.integers(1, window, 400), minlength=window).astype(float)
        have[0] = 0
        combos = packing.combinations(np.flatnonzero(have), window)
        a = np.zeros((window, len(combos)))
        for j, combo in enumerate(combos):
            for n in combo[combo > 0]:
                a[n, j] += 1
        best = np.linalg.norm(a @ exact(a, have) - have)
        assert abs(np.linalg.norm(a @ packing.relaxed_counts(combos, have, 5000) - have) - best) < 1e-3 * max(1, best)


def test_small_powers_fill_no_sequence_of_their_own(spark):
    df = spark.createDataFrame([(i, None) for i in range(3000)], "doc_id long, text string")  # one token each
    pieces = packing.pack(df, PATH).collect()
    assert check(pieces, [(i, None) for i in range(3000)]) < 1024 and len({p.sequence_id for p in pieces}) == 3
