"""Periodic runs of words, by minimizers at several scales.

A run is a stretch of consecutive words with smallest period q and at least ``max(LEAST, COPIES * q)`` words
that cannot be extended. Periods up to ``LAGS`` are found by comparing the words with those q places on. For
longer ones there is a scale for each power of two K: periods from K/2 + 1 to K, K-grams of words, windows of
K/2 + 1 K-grams. Inside a run of such a period

* some window and the one q places on hold the same K-grams, so their minima are q places apart, and
* equal K-grams lie at multiples of q only, as K >= q, so these two minima follow each other among equal ones.

So every run shows itself as two neighbouring equal minimizers at a distance of its period. Such a pair is a
seed: it is extended word by word to both sides, and kept if no divisor of the distance is a period too. The
work is linear in the words at each scale, and a scale is only met by texts long enough for it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, small_batches, tidy
from .words import in_parts, mix, words_of

COPIES, LEAST, LAGS = 4, 6, 8
_U = np.uint64


def _shortest(q: int) -> int:
    """Words of the shortest run of period q."""
    return max(LEAST, COPIES * q)


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every ``width`` values on end."""
    reach = 1
    while 2 * reach <= width:
        x = pick(x[:-reach], x[reach:])
        reach *= 2
    return pick(x[: len(x) - (width - reach)], x[width - reach :]) if width > reach else x


def _minimizers(grams: np.ndarray, width: int) -> np.ndarray:
    """Places whose value is the least of some window of ``width`` places (all of them, if several are least)."""
    if len(grams) < width:
        return np.empty(0, np.int64)
    least = _slide(grams, width, np.minimum)
    zeros = np.zeros(width - 1, grams.dtype)
    best = _slide(np.concatenate([zeros, least, zeros]), width, np.maximum)  # of the windows that cover a place
    return np.flatnonzero(grams == best)


def _reach(x: np.ndarray, at: int, lag: int, step: int) -> int:
    """How many places from ``at`` on (step 1) or before it (step -1) equal those ``lag`` places later."""
    done, size = 0, 64
    while True:
        if step > 0:
            a, b = x[at + done : at + done + size], x[at + lag + done : at + lag + done + size]
            a = a[: len(b)]
        else:
            low = max(0, at - done - size)
            a, b = x[low : at - done][::-1], x[low + lag : at + lag - done][::-1]
        off = np.flatnonzero(a != b)
        if len(off):
            return done + int(off[0])
        done += len(a)
        if len(a) < size:
            return done
        size *= 2


def _divisors(q: int) -> list[int]:
    """q divided by each of its primes: a shorter period of a run of q divides one of these."""
    found, rest, p = [], q, 2
    while p * p <= rest:
        if rest % p == 0:
            found.append(q // p)
            while rest % p == 0:
                rest //= p
        p += 1
    return found + [q // rest] if rest > 1 else found


def _primitive(x: np.ndarray, start: int, length: int, q: int) -> bool:
    own = x[start : start + length]
    return not any((own[r:] == own[:-r]).all() for r in _divisors(q))


def find(sequences: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """For each sequence of 64-bit word hashes its runs (start, length, period), by start and period."""
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))  # a scale then takes the first so many
    sizes = np.array([len(sequences[i]) + 1 for i in order], np.int64)
    ends = np.cumsum(sizes)
    x = np.empty(int(ends[-1]) if len(ends) else 0, _U)
    for place, i in enumerate(order):
        x[ends[place] - sizes[place] : ends[place] - 1] = sequences[i]
    x[ends - 1] = _U(2**64 - 1) - np.arange(len(ends), dtype=_U)  # borders equal nothing
    found: set[tuple[int, int, int]] = set()

    def keep(start: int, length: int, q: int) -> None:
        if length >= _shortest(q) and _primitive(x, start, length, q):
            found.add((start, length, q))

    def long_enough(q: int) -> int:
        """Words of those sequences that a run of period q fits into."""
        n = int(np.count_nonzero(sizes > _shortest(q)))
        return int(ends[n - 1]) if n else 0

    for q in range(1, LAGS + 1):
        own = x[: long_enough(q)]
        if len(own) > q:
            edge = np.diff((own[:-q] == own[q:]).astype(np.int8), prepend=np.int8(0), append=np.int8(0))
            begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            for k in np.flatnonzero(end - begin + q >= _shortest(q)).tolist():
                keep(int(begin[k]), int(end[k] - begin[k]) + q, q)
    grams, scale = x, 1
    while n := long_enough(scale // 2 + 1):
        if scale > LAGS:
            here = grams[: max(0, n - scale + 1)]
            places = _minimizers(here, scale // 2 + 1)
            by = np.lexsort((places, here[places]))
            places, value = places[by], here[places[by]]
            gap = np.diff(places)
            seed = (value[1:] == value[:-1]) & (gap > scale // 2) & (gap <= scale)
            until: dict[int, int] = {}  # of each period the end of the last stretch
            for at, q in sorted(zip(places[:-1][seed].tolist(), gap[seed].tolist(), strict=True)):
                if at >= until.get(q, -1):
                    before, after = _reach(x, at, q, -1), _reach(x, at, q, 1)
                    until[q] = at + after
                    keep(at - before, before + after + q, q)
        if len(grams) <= scale:
            break
        grams = mix(grams[:-scale] * _U(0xD1342543DE82EF95) + (grams[scale:] ^ (grams[scale:] >> _U(32))), scale)
        scale *= 2
    out: list[list[tuple[int, int, int]]] = [[] for _ in sequences]
    owner = np.searchsorted(ends, [start for start, _, _ in found], side="right")
    for place, (start, length, q) in zip(owner.tolist(), found, strict=True):
        out[order[place]].append((start - int(ends[place] - sizes[place]), length, q))
    return [sorted(rs, key=lambda r: (r[0], r[2])) for rs in out]


def dropped(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether a word is a repetition within some run: in it, but not of its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, q in runs:
        change[start + q] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) > 0


@tidy
def _run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    word = re.compile(WORD)
    for part in in_parts(batches):
        w = words_of(part["text"].tolist())
        runs = find([w.hash[a:b] for a, b in zip(w.since.tolist(), w.until.tolist(), strict=True)])
        texts = []
        for text, own in zip(part["text"], runs, strict=True):
            words = word.findall(text)
            if own:
                gone = dropped(len(words), own)
                words = [x for x, d in zip(words, gone.tolist(), strict=True) if not d]
            texts.append(" ".join(words))
        rows = [[{"start": s, "length": n, "period": q} for s, n, q in own] for own in runs]
        yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "runs": rows, "collapsed": texts})


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, runs, collapsed): all runs of every text, and its words without their repetitions, joined by spaces.

    ``runs`` is an array of (start, length, period) in words, by start and period. Of each run its first period
    stays. A null text is an empty one: no runs, and "" is left. Null ids stay. Rows are taken one by one, so
    equal rows have equal results; an empty table gives an empty result; other columns are ignored, whatever
    their names. No shuffle: a task reads its rows as they come, a long text is whole in one of them.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), text.alias("text"))
    made = rows.mapInPandas(_run, "doc_id string, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    return made.withColumn("doc_id", F.col("doc_id").cast(dict(docs.dtypes)[id_col]))
