"""Passages that repeat across a corpus, by a compressed FM-index for each shard of its windows.

A window is ``window`` words on end. Its key is the least hash of its ``GRAM``-word grams, so equal windows have
equal keys; windows on end with one key form a segment. Keys deal segments to shards, and so equal windows meet
in one shard, however far apart their documents are, and no document has to pass every shard.

1. Segments that can repeat: those whose key another segment has, or that repeat within themselves. They are found
   in ranges of (key, digest of the segment), so that a key or a segment that many documents hold is spread over
   ranges. A segment met again in a range is a repeat as a whole; the first of each range goes on with its words.
2. A key with more than ``HOT`` segments (windows at the border of a passage that very many documents
   share) is dealt by the digests of its single windows instead.
3. Each shard's segments are its text, in the order of their documents. Of it a suffix order (``DEPTH`` words deep),
   its Burrows-Wheeler transform in a wavelet tree, and least positions of ranges of the order are built. Then the
   documents' segments are streamed through it: backward search from a window's end runs as long as what it has
   read occurs earlier, and its matching statistic moves the window past all that can't match, or, if it reaches the
   window's begin, reports an interval.

``without_repeats`` gives the spans and the texts that are left.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, release, small_batches, table, tidy
from .words import in_parts, mix, words_of

GRAM, HOT = 5, 16_384
#: Words of a shard's text, about.
SHARD = 1 << 19
#: The longest patterns that are searched for, and the windows that one lane of the search goes through.
DEPTH, LANE = 48, 32
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0 to n of an odd number modulo 2**64, and their inverses."""
    one = np.ones(n + 1, _U)
    one[1:] = _U(_BASE)
    back = np.ones(n + 1, _U)
    back[1:] = _U(pow(_BASE, -1, 2**64))
    return np.multiply.accumulate(one), np.multiply.accumulate(back)


def _digests(words: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each stretch of words."""
    up, down = _powers(len(words))
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(words * up[:-1], dtype=_U)])
    return mix((sums[end] - sums[start]) * down[start], 11) ^ mix((end - start).astype(_U), 13)


def _segments(words: np.ndarray, since: np.ndarray, until: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(text, first word, windows, key, whether it may repeat within itself) of the segments of several texts."""
    counts = np.maximum(until - since - window + 1, 0)
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(since, counts)  # all windows
    if not len(at):
        none = np.empty(0, np.int64)
        return none, none, none, none.view(_U), none.astype(bool)
    grams, width = np.zeros(len(words) - GRAM + 1, _U), window - GRAM + 1
    for i in range(GRAM):
        grams = grams * _U(0x100000001B3) + words[i : i + len(grams)]
    grams = mix(grams, 5)
    least, reach = grams, 1
    while 2 * reach <= width:
        least, reach = np.minimum(least[:-reach], least[reach:]), 2 * reach
    least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
    text, key = np.repeat(np.arange(len(since)), counts), least[at]
    head = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (text[1:] != text[:-1])]))
    start, n = at[head], np.diff(np.append(head, len(at)))
    twice = np.zeros(len(grams), bool)  # whether a gram occurs again within a window's reach
    for lag in range(1, min(width, len(grams) - 1) + 1):
        twice[:-lag] |= grams[:-lag] == grams[lag:]
    sums = np.concatenate([[0], np.cumsum(twice)])
    return text[head], start, n, key[head], sums[start + n + width - 1] > sums[start]


def _describe(window: int):
    """Of each text its segments: key, digest and place."""

    @tidy
    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in in_parts(batches):
            part = part.drop_duplicates(["doc", "tie"])
            w = words_of(part["text"].tolist())
            text, start, n, key, inner = _segments(w.hash, w.since, w.until, window)
            yield pd.DataFrame({
                "key": key.view(np.int64), "digest": _digests(w.hash, start, start + n + window - 1).view(np.int64),
                "doc": part["doc"].to_numpy()[text], "tie": part["tie"].to_numpy()[text],
                "start": start - w.since[text], "windows": n, "inner": inner,
            })

    return fn


_PLACE = "doc long, tie long, start long, windows long"


def _sort_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of the rows of a range, by key, digest and place: the repeats of a digest, and the segments whose key is not
    alone (``wanted``). What the first and the last key of a range have in other ranges isn't known: they are wanted."""
    columns = ["key", *[c.split()[0] for c in _PLACE.split(", ")], "wanted"]
    held = None  # the one row so far that leads a digest of the last key
    before = None  # the last row met
    for batch in batches:
        if not len(batch):
            continue
        key, digest, place = batch["key"].to_numpy(), batch["digest"].to_numpy(), batch[["doc", "tie", "start"]].to_numpy()
        last = (~key[0], digest[0], place[0]) if before is None else before
        new_key = key != np.append(last[0], key[:-1])
        new_digest = new_key | (digest != np.append(last[1], digest[:-1]))
        same_place = (place == np.concatenate([last[2][None], place[:-1]])).all(axis=1)
        run = np.cumsum(new_key)  # 0: the key of the batch before
        several = np.bincount(run[new_digest], minlength=run[-1] + 1) > 1
        several[0] = True
        if before is None:
            several[1] = True
        wanted = new_digest & (several[run] | batch["inner"].to_numpy())
        again = ~new_digest & ~same_place
        out = [batch.assign(wanted=wanted)[wanted | again]]
        if held is not None and (new_digest & (run == 0)).any():
            out.append(held)
            held = None
        if run[-1]:
            lead = np.flatnonzero(new_key)[-1]
            held = None if several[run[-1]] or wanted[lead] else batch.iloc[[lead]].assign(wanted=True)
        before = (key[-1], digest[-1], place[-1])
        yield pd.concat(out)[columns]
    if held is not None:
        yield held[columns]


def _cut_out(window: int):
    """The bytes of the wanted segments; those of hot keys as single windows."""

    @tidy
    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in in_parts(batches, most=500):
            part = part.drop_duplicates(["doc", "tie"])
            w = words_of(part["text"].tolist())
            key, start, n, hot = (np.concatenate(part[c].tolist()) for c in ("keys", "starts", "windows", "hot"))
            row = np.repeat(np.arange(len(part)), [len(x) for x in part["keys"]])
            first = start + w.since[row]
            if hot.any():  # a window each
                times = np.where(hot, n, 1)
                own = np.repeat(np.arange(len(n)), times)
                step = np.arange(len(own)) - np.repeat(np.cumsum(times) - times, times)
                row, first, single = row[own], first[own] + step, hot[own]
                key, n = key[own], np.where(single, 1, n[own])
                key[single] = _digests(w.hash, first[single], first[single] + window).view(np.int64)
            begin, end = w.begin[first].tolist(), w.end[first + n + window - 2].tolist()
            yield pd.DataFrame({
                "key": key, "doc": part["doc"].to_numpy()[row], "tie": part["tie"].to_numpy()[row], "start": first - w.since[row],
                "windows": n, "words": [w.data[a:b] for a, b in zip(begin, end, strict=True)],
            })

    return fn


class WaveletTree:
    """Ranks of symbols 0 <= s < 2**levels in a sequence: a bit vector for each level, packed, with counts of its ones."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels, self.n = levels, len(symbols)
        self.bits, self.ones, self.zeros = [], [], []
        for level in range(levels - 1, -1, -1):
            bit = (symbols >> level) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(_U)
            counts = np.bitwise_count(packed)
            self.bits.append(packed)
            self.ones.append(np.concatenate([np.zeros(1, np.int32), np.cumsum(counts, dtype=np.int32)]))
            one = bit.astype(bool)
            self.zeros.append(int(len(symbols) - np.count_nonzero(one)))
            symbols = np.concatenate([symbols[~one], symbols[one]])

    def rank(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often ``symbol`` occurs before ``low`` and before ``high``."""
        k = len(symbol)
        at, base = np.concatenate([low, high]), np.zeros(k, np.int64)
        for i in range(self.levels):
            bit = ((symbol >> (self.levels - 1 - i)) & 1).astype(bool)
            both = np.concatenate([at, base])  # base: where the symbol's part of this level begins
            block = both >> 6
            rest = (_U(1) << (both & 63).astype(_U)) - _U(1)
            ones = self.ones[i][block].astype(np.int64) + np.bitwise_count(self.bits[i][block] & rest)
            both = np.where(np.concatenate([bit, bit, bit]), self.zeros[i] + ones, both - ones)
            at, base = both[: 2 * k], both[2 * k :]
        return at[:k] - base, at[k:] - base


class FMIndex:
    """Backward search in a text of symbols from 1 on; 0 parts the text and ends it. Patterns have ``DEPTH`` symbols at most."""

    def __init__(self, text: np.ndarray):
        n, top = len(text), int(text.max()) + 1
        rank, depth = text.astype(np.int64), 1
        while depth < DEPTH:  # by twice as many symbols each time
            pair = rank * (max(n, top) + 1)
            pair[:-depth] += rank[depth:] + 1
            order = np.argsort(pair, kind="stable")
            own = pair[order]
            new = np.concatenate([[0], np.cumsum(own[1:] != own[:-1])])
            rank = np.empty(n, np.int64)
            rank[order] = new
            depth *= 2
            if new[-1] == n - 1:
                break
        self.text = text
        self.least = [order.astype(np.int32)]  # least position of each 1, 2, 4, ... neighbours in the order
        while 2 ** len(self.least) <= n:
            last, reach = self.least[-1], 2 ** (len(self.least) - 1)
            self.least.append(np.minimum(last[:-reach], last[reach:]))
        before = text[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top))])
        self.tree = WaveletTree(before, max(1, (top - 1).bit_length()))

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranges of patterns with one more symbol before them."""
        a, b = self.tree.rank(symbol, low, high)
        return self.first[symbol] + a, self.first[symbol] + b

    def earliest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least position of the suffixes of each range; ranges are not empty."""
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level).tolist():
            own = level == k
            t = self.least[k]
            out[own] = np.minimum(t[low[own]], t[high[own] - 2**k])
        return out


def matches(index: FMIndex, first: np.ndarray, last: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Stretches (begin, end) of the index's text that cover every window, of those that begin at first to last of a
    lane, which occurs earlier in the text; windows of a lane don't leave their segment."""
    text, most = index.text, DEPTH - window
    begin, final = first.copy(), last.copy()  # of each lane: the window looked at, the last one
    more = np.zeros(len(begin), np.int64)  # windows that are tested along with it
    ahead = begin + window - 1
    low, high = np.zeros(len(begin), np.int64), np.full(len(begin), len(text), np.int64)
    out: list[np.ndarray] = []
    while len(begin):
        low, high = index.step(text[ahead], low, high)
        earlier = index.earliest(low, high) < ahead
        whole = earlier & (ahead == begin)
        if whole.any():
            out.append(np.stack([begin[whole], begin[whole] + more[whole] + window]))
        failed = ~earlier
        alone = failed & (more == 0)
        begin = np.where(whole, begin + more + 1, np.where(alone, ahead + 1, begin))
        more = np.where(whole, np.minimum(2 * more + 3, most), np.where(failed, more // 4, more))
        again = whole | failed
        more = np.where(again, np.maximum(np.minimum(more, final - begin), 0), more)
        ahead = np.where(again, begin + more + window - 1, ahead - 1)
        low, high = np.where(again, 0, low), np.where(again, len(text), high)
        going = begin <= final
        if not going.all():
            begin, final, more, ahead, low, high = (v[going] for v in (begin, final, more, ahead, low, high))
    return tuple(np.concatenate([np.empty((2, 0), np.int64), *out], axis=1))


def _search(window: int):
    """The intervals of a shard."""

    def fn(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates(["doc", "tie", "start"]).sort_values(["doc", "tie", "start"])
        w = words_of(group["words"].tolist())
        sizes, start = w.until - w.since, np.zeros(len(group), np.int64)
        start[1:] = np.cumsum(sizes[:-1] + 1)
        text = np.zeros(int(sizes.sum()) + len(group) + 1, np.int64)
        inside = np.arange(len(w.hash)) - np.repeat(w.since, sizes) + np.repeat(start, sizes)
        text[inside] = np.unique(w.hash, return_inverse=True)[1] + 1
        lanes = -(-group["windows"].to_numpy() // LANE)
        own = np.repeat(np.arange(len(group)), lanes)
        first = start[own] + LANE * (np.arange(len(own)) - np.repeat(np.cumsum(lanes) - lanes, lanes))
        last = np.minimum(first + LANE, start[own] + group["windows"].to_numpy()[own]) - 1
        a, b = matches(FMIndex(text), first, last, window)
        at = np.searchsorted(start, a, side="right") - 1
        place = group["start"].to_numpy()[at] - start[at]
        out = pd.DataFrame({"doc": group["doc"].to_numpy()[at], "tie": group["tie"].to_numpy()[at], "start": a + place, "end": b + place})
        release()
        return out

    return fn


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, tie, id, text): doc orders as the id does, null last; tie tells documents of one id apart, 0 if all ids differ."""
    if dict(docs.dtypes)[id_col] not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{id_col} must be an integer: documents are ordered by it")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("doc", F.coalesce("id", F.lit(2**63 - 1)))
    shared = rows.groupBy("doc").count().where("count > 1").limit(1).count()
    tie = F.xxhash64("text", F.col("id").isNull()) if shared else F.col("doc").bitwiseAND(F.lit(0).cast("long"))
    return rows.select("doc", tie.alias("tie"), "id", "text")


def _intervals(rows: DataFrame, window: int) -> DataFrame:
    """(doc, tie, start, end), overlapping ones included."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    described = rows.select("doc", "tie", "text").mapInPandas(_describe(window), f"key long, digest long, {_PLACE}, inner boolean")
    order = ["key", "digest", "doc", "tie", "start"]
    ranged = table(described).repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    sorted_out = table(ranged.mapInPandas(tidy(_sort_out), f"key long, {_PLACE}, wanted boolean"))
    wanted = sorted_out.where("wanted")
    n_words = wanted.agg(F.coalesce(F.sum(F.col("windows") + window), F.lit(0))).first()[0]
    hot = wanted.groupBy("key").count().where(F.col("count") > HOT).select("key", F.lit(True).alias("hot"))
    listed = F.collect_list(F.struct("key", "start", "windows", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("s")
    lists = wanted.join(hot, "key", "left").groupBy("doc", "tie").agg(listed)
    lists = lists.select("doc", "tie", F.col("s.key").alias("keys"), F.col("s.start").alias("starts"), F.col("s.windows").alias("windows"), F.col("s.hot").alias("hot"))
    segments = rows.join(lists, ["doc", "tie"]).mapInPandas(_cut_out(window), f"key long, {_PLACE}, words binary")
    shard = F.pmod(F.xxhash64("key"), F.lit(max(1, -(-n_words // SHARD)))).alias("shard")
    found = segments.select(shard, "doc", "tie", "start", "windows", "words").groupBy("shard")
    found = found.applyInPandas(_search(window), "doc long, tie long, start long, end long")
    whole = sorted_out.where("not wanted").select("doc", "tie", "start", (F.col("start") + F.col("windows") + (window - 1)).alias("end"))
    return found.unionByName(whole)


@tidy
def _strip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    word = re.compile(WORD)
    for part in in_parts(batches):
        made = []
        for text, starts, ends in zip(part["text"], part["starts"], part["ends"], strict=True):
            words, n = word.findall(text), 0
            total, spans = len(words), []
            if starts is not None and len(starts):
                change = np.zeros(total + 1, np.int64)
                np.add.at(change, np.asarray(starts, np.int64), 1)
                np.add.at(change, np.asarray(ends, np.int64), -1)
                gone = np.cumsum(change[:-1]) > 0
                n = int(gone.sum())
                words = [x for x, g in zip(words, gone.tolist(), strict=True) if not g]
                edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=np.int8(0), append=np.int8(0)))
                spans = [{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()]
            made.append((total, n, spans, " ".join(words)))
        out = pd.DataFrame(made, columns=["n_words", "n_removed", "spans", "kept"])
        out.insert(0, "doc_id", part["id"].to_numpy())
        yield out


def without_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept): every text without the words of windows that also start earlier.

    A window starts earlier in a document with a smaller id, or further ahead in the same one. ``spans`` are the
    stretches (start, end) of removed words, ``kept`` the others, joined by single spaces. Windows are judged on the
    input. Texts shorter than a window stay. A null text is an empty one. Null ids come last. Of different
    documents with one id the hash of their texts gives the order; rows equal in id and text are one document, and
    each has its result. An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    if not 2 * GRAM <= window <= DEPTH // 2:
        raise ValueError(f"windows have {2 * GRAM} to {DEPTH // 2} words")
    small_batches(docs.sparkSession)
    rows = _keyed(docs, id_col, text_col)
    spans = _intervals(rows, window).groupBy("doc", "tie").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    joined = rows.join(spans, ["doc", "tie"], "left").select(F.col("id").cast("string").alias("id"), "text", "starts", "ends")
    made = joined.mapInPandas(_strip, "doc_id string, n_words long, n_removed long, spans array<struct<start: long, end: long>>, kept string")
    return made.withColumn("doc_id", F.col("doc_id").cast(dict(docs.dtypes)[id_col]))
