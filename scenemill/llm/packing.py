"""Packing token sequences: non-negative least squares over shallow length combinations.

Documents are tokenized once. What fills whole windows is cut off; the remainders' lengths make a histogram
of at most ``window - 1`` numbers, whatever the input's size. Combinations of at most three lengths that sum
to the window (or single lengths that are a power of two and half a window at least, which need no padding) are the columns of a non-negative
least-squares problem against that histogram. Its solution, rounded within what there is, deals remainders
of each length to combinations; the rest is packed greedily end to end, cut at window borders, so only the
last sequence of all can hold padding.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import prefix_sums, small_batches, table, tidy

WINDOW = 1024
#: How byte-level vocabularies split a text, and characters that are left to the slow way.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_UNSURE = "[^\\t\\n\\r -~\u00a1-\u024f\u2010-\u2027]"
_PIECES = "doc_id long, start long, length int, doc_tokens long, sequence_id long, offset int, ids binary"
_CUT = _PIECES + ", _pos long"
_tokenizers: dict = {}


class Tokenizer:
    """Ids of a byte-level BPE file, as little-endian 16-bit bytes.

    A rank encoder with the file's vocabulary does the work, as its ids are in the order of its merges. Texts
    with special tokens, or with characters on whose class two regular-expression engines may not agree, go
    to the file's own tokenizer.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer as Bpe

        self.bpe = Bpe.from_file(path)
        special = {t.content: i for i, t in self.bpe.get_added_tokens_decoder().items()}
        self.slow = re.compile("|".join([_UNSURE, *map(re.escape, special)]))
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in self.bpe.get_vocab().items() if token not in special}
        self.fast = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if self.slow.search(text):
            ids = self.bpe.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return np.array(ids, "<u2").tobytes()


def _byte_letters() -> dict[str, int]:
    """The bytes that a byte-level vocabulary's letters stand for: printable ones for themselves, the others
    for those from 256 on, in order."""
    shown = {b for b in range(256) if chr(b).isprintable() and b not in (32, 173)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def tokenizer(path: str) -> Tokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = Tokenizer(path)
    return _tokenizers[path]


def _cut_windows(path: str, end: int, window: int):
    @tidy
    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, task, filled, made = tokenizer(path), TaskContext.get().partitionId(), 0, 0
        closing = np.array([end], "<u2").tobytes()
        for whole in batches:
            for begin in range(0, len(whole), 500):
                batch, rows = whole.iloc[begin : begin + 500], []
                for doc, text in zip(batch["doc_id"].astype("object").where(batch["doc_id"].notna(), None), batch["text"], strict=True):
                    ids = (encode(text) if text else b"") + closing
                    n = len(ids) // 2
                    for start in range(0, n, window):
                        length = min(window, n - start)
                        full = length == window
                        rows.append((doc, start, length, n, (task << 40) + filled if full else None, 0 if full else None, ids[2 * start : 2 * (start + length)], (task << 40) + made))
                        filled, made = filled + full, made + 1
                yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids", "_pos"])

    return fn


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """Rows of three of these lengths (0: none) that fill the window, and single powers of two, half of it at least."""
    there = np.zeros(window + 1, bool)
    there[lengths] = True
    ones = [n for n in lengths if n & (n - 1) == 0 and 2 * n >= window]
    found = [np.array([[n, 0, 0] for n in ones], np.int64).reshape(-1, 3)]
    two = np.array([n for n in lengths if 2 * n <= window and there[window - n]], np.int64)
    found.append(np.stack([window - two, two, np.zeros_like(two)], 1))
    for n in lengths[lengths * 3 <= window]:
        mid = lengths[(lengths >= n) & (2 * lengths <= window - n)]
        mid = mid[there[window - n - mid]]
        found.append(np.stack([window - n - mid, mid, np.full_like(mid, n)], 1))
    return np.concatenate(found)


def relaxed_counts(combos: np.ndarray, have: np.ndarray, steps: int = 300) -> np.ndarray:
    """x of min |A x - have|, x >= 0, by accelerated projected gradients.

    A column of A counts the lengths of its combination; it has at most three entries, so a step needs only
    gathers and counts.
    """
    used = combos > 0
    pull = lambda r: (r[combos] * used).sum(1)
    push = lambda x: np.bincount(combos[used], np.repeat(x, used.sum(1)), len(have))
    probe = np.ones(len(combos))
    for _ in range(15):
        probe = pull(push(probe))
        step = np.linalg.norm(probe)
        probe /= step
    x = y = np.zeros(len(combos))
    momentum = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - pull(push(y) - have) / step)
        t = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        x, y, momentum = new, new + (momentum - 1) / t * (new - x), t
    return x


def solve_counts(histogram: np.ndarray, window: int, steps: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """(combinations, repeat counts): rounded least squares solution, within what there is."""
    have = histogram.astype(np.float64).copy()
    have[0] = 0
    combos = combinations(np.flatnonzero(have), window)
    if not len(combos):
        return combos, np.zeros(0, np.int64)
    used, x = combos > 0, relaxed_counts(combos, have, steps)
    counts, left = np.zeros(len(combos), np.int64), histogram.astype(np.int64).copy()
    for i in np.lexsort((np.arange(len(x)), used.sum(1), -np.floor(x))):  # whole counts first, then one more where it fits
        n = int(np.floor(x[i]))
        if n:
            parts, need = np.unique(combos[i][used[i]], return_counts=True)
            n = min(n, int((left[parts] // need).min()))
            left[parts] -= n * need
            counts[i] = n
    for i in np.argsort(np.floor(x) - x, kind="stable"):
        if x[i] > 1e-3:
            parts, need = np.unique(combos[i][used[i]], return_counts=True)
            if (left[parts] >= need).all():
                left[parts] -= need
                counts[i] += 1
    return combos[counts > 0], counts[counts > 0]


def deal(combos: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
    """For each length, ranges of ranks and where they go: rank first + k to sequence + k, at the offset."""
    rows, base, taken = [], 0, {}
    for combo, n in zip(combos.tolist(), counts.tolist(), strict=True):
        at = 0
        for length in combo:
            if length:
                rows.append((length, taken.get(length, 0), n, base, at))
                taken[length], at = taken.get(length, 0) + n, at + length
        base += n
    return pd.DataFrame(rows, columns=["length", "first", "n", "sequence", "at"])


def _place(plan: dict[int, np.ndarray], sequences: int, window: int):
    @tidy
    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            length, rank = rows["length"].to_numpy(), rows["_rank"].to_numpy()
            sequence, at = np.full(len(rows), -1, np.int64), np.zeros(len(rows), np.int32)
            for n in np.unique(length):
                if n in plan:
                    own, ranges = np.flatnonzero(length == n), plan[n]
                    k = np.searchsorted(ranges[:, 0], rank[own], "right") - 1
                    inside = rank[own] < ranges[k, 0] + ranges[k, 1]
                    own, k = own[inside], k[inside]
                    sequence[own], at[own] = ranges[k, 2] + rank[own] - ranges[k, 0], ranges[k, 3]
            yield rows.assign(sequence_id=sequence, offset=at).drop(columns="_rank")

    return fn


def _cut_rest(first: int, window: int):
    @tidy
    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for doc, start, length, n, ids, g in zip(rows["doc_id"].astype("object").where(rows["doc_id"].notna(), None), rows["start"], rows["length"], rows["doc_tokens"], rows["ids"], rows["_before"], strict=True):
                done = 0
                while done < length:
                    at = (g + done) % window
                    take = min(window - at, length - done)
                    out.append((doc, start + done, take, n, first + (g + done) // window, at, ids[2 * done : 2 * (done + take)]))
                    done += take
            yield pd.DataFrame(out, columns=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    return fn


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, sequence_id, offset, ids): each token of each row in one.

    ``ids``: little-endian unsigned 16-bit token ids. A row's tokens are its text's (null: none) and ``end``.
    Each row of ``docs`` is a document of its own, also where ids are null or repeat. Sequence ids are
    unique, not dense. Texts are encoded whole, however long; other columns are ignored, whatever their names.
    An empty table gives an empty result. The vocabulary must have at most 65536 ids. Pieces are ranked by the
    place where they were cut, so equal rows are spread like any others.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = table(texts.mapInPandas(_cut_windows(tokenizer_path, end, window), _CUT))
    rest = pieces.where(F.col("length") < window)
    bucketed = rest.select("doc_id", "start", "length", "doc_tokens", "ids", "_pos", F.expr("pmod(xxhash64(_pos), 1024)").alias("_bucket"))
    # at most window - 1 lengths: the histogram has a fixed size
    counted = {r["length"]: r["n"] for r in rest.groupBy("length").agg(F.count("*").alias("n")).collect()}
    histogram = np.zeros(window, np.int64)
    for length, n in counted.items():
        histogram[length] = n
    combos, counts = solve_counts(histogram, window)
    plan = {n: g[["first", "n", "sequence", "at"]].to_numpy() for n, g in deal(combos, counts).groupby("length")}
    total = int(counts.sum())
    tail_base = 1 << 60  # full windows are numbered task << 40 + n, below
    for ranges in plan.values():
        ranges[:, 2] += tail_base
    ranked = prefix_sums(bucketed.withColumn("_one", F.lit(1).cast("long")), "length", "_bucket", ["_pos"], "_one", "_rank")
    placed = ranked.select("doc_id", "start", "length", "doc_tokens", "ids", "_pos", "_bucket", "_rank").mapInPandas(
        _place(plan, total, window), "doc_id long, start long, length int, doc_tokens long, ids binary, _pos long, _bucket long, sequence_id long, offset int"
    )
    placed = table(placed)
    left = placed.where("sequence_id < 0").withColumn("_all", F.lit(0)).withColumn("length_", F.col("length").cast("long"))
    run = prefix_sums(left, "_all", "_bucket", ["_pos"], "length_", "_before")
    cut_up = run.select("doc_id", "start", "length", "doc_tokens", "ids", "_before").mapInPandas(_cut_rest(tail_base + total, window), _PIECES)
    columns = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    return (
        pieces.where(F.col("length") == window).select(*columns)
        .unionByName(placed.where("sequence_id >= 0").select(*columns))
        .unionByName(cut_up.select(*columns))
    )
