"""MinHash near-dedup by fast similarity sketching, banding and exact verification.

Sketch: ``COORDS`` bins. In round i < COORDS every element of a set is thrown into a bin chosen by the
round's hash; in round COORDS + j all go to bin j, so that after at most 2 * COORDS rounds each bin of a
non-empty set is filled. A bin keeps the least (round, hash) it has met. Two sets agree in a bin with
probability equal to their Jaccard similarity, and the agreement is concentrated as for independent draws.

Banding: keys of as many bins as leave a pair at the asked similarity without a common key with probability
``MISS`` at most: 8 bins, 32 keys for 0.85; 7 bins, 36 keys for 0.80.

Groups of documents with one shingle set are one class. Among classes, each is first compared with the
centre (least id) of the buckets it is in; what these links leave in different components but in one bucket
is then compared block by block across components: sizes and sketches (a byte a bin) first, and on full sets
what these leave. A pair at the asked similarity falls out there with probability 4e-5 or less. No pair is
written that is not a link, and no bucket is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, release, small_batches, table, tidy

COORDS, MISS = 256, 3e-4
SHINGLE = 5
BLOCK = 128
#: Bytes of text that are hashed at once in a task.
AT_ONCE = 1 << 20
_U = np.uint64
_FULL = np.iinfo(np.uint64).max


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x + _U(salt & (2**64 - 1))) * _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


#: A random number for each byte at each place of a word, places taken modulo 64.
_LETTERS = _mix(np.arange(64 * 256, dtype=_U), 0x1F83D9AB)


def banding(percent: int) -> tuple[int, int]:
    """(bins of a key, keys): the longest keys that miss a pair at this similarity with probability MISS at most."""
    fits = [r for r in range(1, 17) if (1 - (percent / 100) ** r) ** (COORDS // r) <= MISS]
    return max(fits, default=1), COORDS // max(fits, default=1)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """For each text the sorted 64-bit hashes of its distinct 5-word shingles; of all its words, if there are fewer.

    Bytes are hashed by their place in their word, words by the sum of their bytes' hashes; nothing is kept
    between calls.
    """
    raw = [t.encode("utf-8", "surrogatepass").lower() if t else b"" for t in texts]  # bytes: A-Z only
    data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    inside = np.flatnonzero(~blank)
    if not len(inside):
        return [np.empty(0, _U)] * len(texts)
    first = np.flatnonzero(np.diff(inside, prepend=-2) > 1)  # words, as places in `inside`
    sizes = np.diff(np.append(first, len(inside)))
    place = np.arange(len(inside)) - np.repeat(first, sizes)
    byte = _LETTERS[((place & 63) << 8) + data[inside]] * ((place >> 6) * 2 + 1).astype(_U)
    words = _mix(np.add.reduceat(byte, first), 3)
    ends = np.cumsum([len(r) + 1 for r in raw])
    until = np.searchsorted(inside[first], ends)  # words up to the end of each text
    since = np.concatenate([[0], until[:-1]])
    sums, grams = np.zeros(len(words), _U), {}
    for width in range(1, SHINGLE + 1):
        n = max(0, len(words) - width + 1)
        sums = sums[:n] * _U(0x100000001B3) + words[width - 1 :]
        grams[width] = _mix(sums, width)
    out = []
    for a, b in zip(since.tolist(), until.tolist(), strict=True):
        width = min(SHINGLE, b - a)
        own = np.sort(grams[width][a : b - width + 1]) if width else np.empty(0, _U)
        out.append(own[np.diff(own, prepend=~own[:1]) != 0] if len(own) > 1 else own)
    return out


def sketches(sets: list[np.ndarray], coords: int = COORDS) -> np.ndarray:
    """One row of ``coords`` values for each set; rows of empty sets are all ones."""
    sizes = np.array([len(s) for s in sets], np.int64)
    bins = np.full((len(sets), coords), _FULL, _U)
    flat, elements = bins.reshape(-1), np.concatenate([*sets, np.empty(0, _U)])
    owner = np.repeat(np.arange(len(sets)), sizes)
    for i in range(2 * coords):
        value = _mix(elements, 0x5851F42D4C957F2D * (i + 1))
        place = (value & _U(0xFFFFFFFF)) * _U(coords) >> _U(32) if i < coords else np.full(len(value), i - coords, _U)
        at = owner * coords + place.astype(np.int64)
        free = flat[at] >= _U(i << 54)  # filled in an earlier round: not touched again
        np.minimum.at(flat, at[free], _U(i << 54) | (value[free] >> _U(10)))
        open_ = (bins == _FULL).any(axis=1)
        keep = open_[owner]
        elements, owner = elements[keep], owner[keep]
        if not len(elements):
            break
    return bins


def band_keys(bins: np.ndarray, percent: int = 85) -> np.ndarray:
    width, n = banding(percent)
    keys = np.zeros((len(bins), n), _U)
    for b in range(n):
        for r in range(width):
            keys[:, b] = _mix(keys[:, b] ^ bins[:, b * width + r], b + 1)
    return keys.view(np.int64)


def _in_parts(batches: Iterator[pd.DataFrame], most: int = 500) -> Iterator[tuple[pd.DataFrame, list[np.ndarray]]]:
    """The rows of a task, so few at once that their texts have about AT_ONCE letters, and their sets."""
    for whole in batches:
        lengths = np.array([len(t) if t else 0 for t in whole["text"]], np.int64)
        part = (np.cumsum(lengths) - lengths) // AT_ONCE * len(whole) + np.arange(len(whole)) // most
        for own in np.split(np.arange(len(whole)), np.flatnonzero(np.diff(part)) + 1):
            if len(own):
                rows = whole.iloc[own]
                yield rows, shingle_sets(rows["text"].tolist())


def _describe(percent: int):
    @tidy
    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, sets in _in_parts(batches):
            yield pd.DataFrame({
                "doc_id": rows["doc_id"].array,
                "n_shingles": [len(s) for s in sets],
                "fp1": [int(_mix(s, 11).sum(dtype=_U).view(np.int64)) for s in sets],
                "fp2": [int(_mix(s, 23).sum(dtype=_U).view(np.int64)) for s in sets],
                "bands": list(band_keys(sketches(sets), percent)),
            })

    return fn


@tidy
def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows, sets in _in_parts(batches):
        low = (sketches(sets) & _U(255)).astype(np.uint8)
        yield pd.DataFrame({"doc_id": rows["doc_id"].array, "n": [len(s) for s in sets], "hashes": [s.tobytes() for s in sets], "sketch": [x.tobytes() for x in low]})


def _hopeful(percent: int):
    p = percent / 100
    least = p - 4 * (p * (1 - p) / COORDS) ** 0.5  # four deviations below

    def fn(rows: pd.DataFrame) -> pd.DataFrame:
        """The rows of a group that may have a link across components, by sizes and sketches."""
        comps, left, n = rows["comp"].to_numpy(), rows["left"].to_numpy(), rows["n"].to_numpy()
        sketch = np.frombuffer(b"".join(rows["sketch"]), np.uint8).reshape(len(rows), COORDS)
        wanted = np.zeros(len(rows), bool)
        for i in np.flatnonzero(left):
            other = np.flatnonzero((comps != comps[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])))
            near = other[(sketch[other] == sketch[i]).mean(axis=1) >= least]
            wanted[near] = True
            wanted[i] |= len(near) > 0
        return rows.loc[wanted, ["g1", "g2", "g3", "doc_id", "comp", "left"]]

    return fn


def _links(percent: int):
    def fn(rows: pd.DataFrame) -> pd.DataFrame:
        """Links between the rows marked left and all rows of a group, where their components differ."""
        ids, comps, left = rows["doc_id"].to_numpy(), rows["comp"].to_numpy(), rows["left"].to_numpy()
        sets = [np.frombuffer(h, _U) for h in rows["hashes"]]
        sizes = np.array([len(s) for s in sets], np.int64)
        every, ends = np.concatenate([*sets, np.empty(0, _U)]), np.cumsum(sizes)
        owner = np.repeat(np.arange(len(sets)), sizes)
        a, b = [], []
        for i in np.flatnonzero(left):
            own = sets[i]
            if not len(own):
                continue
            at = np.searchsorted(own, every)
            common = np.bincount(owner[own[np.minimum(at, len(own) - 1)] == every], minlength=len(sets)).astype(np.int64)
            hit = (100 * common >= percent * (sizes + sizes[i] - common)) & (common > 0) & (comps != comps[i])
            a += [ids[i]] * int(hit.sum())
            b += list(ids[hit])
        if len(every) > AT_ONCE:
            del every, owner, sets
            release()
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return fn


def _verify(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """groups: (g1, g2, g3, doc_id, comp, left), of at most two blocks each. Returns the links (a, b)."""
    rows = groups.join(sets.select("doc_id", "hashes"), "doc_id")
    return rows.groupBy("g1", "g2", "g3").applyInPandas(_links(percent), "a long, b long").distinct()


def near_dedup(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, n_shingles, component_id, kept) for each row of ``docs``.

    Documents are linked if 100 * |A & B| >= percent * |A | B| for their sets of word shingles. Null, empty
    and blank texts have an empty set and no link. A row with a null id is never linked: its component is
    null and it is kept. Rows with one id are one document for the links; each of them is returned. Texts are
    taken whole, however long. Other columns of ``docs`` are ignored, whatever their names. An empty table
    gives an empty result.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketched = cut(
        texts.mapInPandas(_describe(percent), "doc_id long, n_shingles long, fp1 long, fp2 long, bands array<long>")
    )
    linkable = sketched.where("n_shingles > 0 and doc_id is not null")
    classes = cut(
        linkable.groupBy("fp1", "fp2", "n_shingles").agg(F.min(F.struct("doc_id", "bands")).alias("m"))
        .select("fp1", "fp2", "n_shingles", F.col("m.doc_id").alias("rep"), F.col("m.bands").alias("bands"))
    )
    posts = classes.select("rep", F.explode("bands").alias("key"))
    # The smaller sides of joins are tables: Spark knows their sizes, and can split what a hot key brings to the other.
    buckets = table(posts.groupBy("key").agg(F.min("rep").alias("centre"), F.count("*").alias("k")).where("k > 1"))
    in_buckets = cut(posts.join(buckets, "key"))
    compared = table(in_buckets.select(F.col("rep").alias("doc_id")).distinct())
    sets = table(texts.join(compared, "doc_id", "left_semi").mapInPandas(_sets, "doc_id long, n long, hashes binary, sketch binary"))

    best = cut(
        in_buckets.where("rep <> centre").groupBy("rep", "centre").agg(F.count("*").alias("shared"))
        .groupBy("rep").agg(F.max_by("centre", F.struct("shared", -F.col("centre"))).alias("centre"))
    )
    chunks = table(best.groupBy("centre").agg(F.ceil(F.count("*") / BLOCK).alias("chunks")))
    chunked = cut(best.join(chunks, "centre").withColumn("chunk", F.expr("pmod(xxhash64(rep), chunks)")))
    stars = chunked.select(
        F.col("centre").alias("g1"), F.col("chunk").alias("g2"), F.lit(0).alias("g3"),
        F.col("rep").alias("doc_id"), F.col("rep").alias("comp"), F.lit(False).alias("left"),
    ).unionByName(
        chunked.select(F.col("centre").alias("g1"), F.col("chunk").alias("g2")).distinct().select(
            "g1", "g2", F.lit(0).alias("g3"), F.col("g1").alias("doc_id"), F.col("g1").alias("comp"), F.lit(True).alias("left")
        )
    )
    first = cut(components(_verify(stars, sets, percent)))

    placed = in_buckets.join(first.withColumnRenamed("node", "rep"), "rep", "left").select(
        "key", "rep", F.coalesce("root", "rep").alias("comp")
    )
    parts = placed.groupBy("key", "comp").agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("who")
    )
    mixed = (
        parts.groupBy("key")
        .agg(F.count("*").alias("comps"), F.sum("n").alias("k"), F.sum("who").alias("who"), F.max_by("comp", F.struct("n", -F.col("comp"))).alias("main"), F.max("n").alias("most"))
        .where("comps > 1")
    )
    once = mixed.groupBy("who", "k").agg(F.min(F.struct("key", "main", "most")).alias("m"))  # same members: one bucket
    once = table(once.select(
        "m.key", "m.main",
        F.ceil(F.col("k") / BLOCK).alias("columns"), F.ceil((F.col("k") - F.col("m.most")) / BLOCK).alias("rows"),
    ))
    rest = cut(placed.join(once, "key"))
    spot = lambda n: F.expr(f"pmod(xxhash64(rep), {n})")
    tail = [F.col("rep").alias("doc_id"), "comp"]
    across = rest.select(
        F.col("key").alias("g1"), F.explode(F.expr("sequence(0L, rows - 1)")).alias("g2"),
        spot("columns").alias("g3"), *tail, F.lit(False).alias("left"),
    ).unionByName(
        rest.where("comp <> main").select(
            F.col("key").alias("g1"), spot("rows").alias("g2"),
            F.explode(F.expr("sequence(0L, columns - 1)")).alias("g3"), *tail, F.lit(True).alias("left"),
        )
    )
    across = across.join(sets.select("doc_id", "n", "sketch"), "doc_id")
    hopeful = cut(across.groupBy("g1", "g2", "g3").applyInPandas(_hopeful(percent), "g1 long, g2 long, g3 long, doc_id long, comp long, left boolean"))
    more = _verify(hopeful, sets, percent)
    roots = components(first.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))

    named = classes.select("fp1", "fp2", "n_shingles", "rep").join(
        roots.withColumnRenamed("node", "rep"), "rep", "left"
    ).select("fp1", "fp2", "n_shingles", F.coalesce("root", "rep").alias("root"))
    found = sketched.select("doc_id", "n_shingles", "fp1", "fp2").join(named, ["fp1", "fp2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def drop_copies(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near copies: that of the smallest id; columns as they are.

    Rows with a null id are told apart by their text and come after all ids, so they are linked like any
    other; of rows equal in id and text one stays. Rows of one id with other texts are one document: they stay
    or go together. Texts without words are copies of nothing.
    """
    text = F.col(text_col).cast("string")
    unnamed = F.lit(2**62) + F.xxhash64(text).bitwiseAND(F.lit(2**62 - 1))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col(id_col).cast("long"), unnamed).alias("_id"), F.xxhash64(text).alias("_text"))
    found = cut(near_dedup(rows.select("_id", F.col("row")[text_col].alias("text")), percent, "_id"))
    # tables: Spark sends them to all tasks where they are small
    copies = table(found.where("not kept").select(F.col("doc_id").alias("_id")).distinct())
    repeated = table(found.groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("_n")).where("_n > 1").select("_id"))
    rows = rows.join(copies, "_id", "left_anti")
    once = rows.join(repeated, "_id", "left_anti")
    several = rows.join(repeated, "_id", "left_semi").dropDuplicates(["_id", "_text"])
    return once.unionByName(several).select("row.*")
