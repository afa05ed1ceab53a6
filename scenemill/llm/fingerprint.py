"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A paragraph is a line that is not blank. Each paragraph has a vector of two parts: ``LANES`` lanes hashed
from all of it, added modulo 2**32, and ``SKETCH`` lanes that add, modulo 2**16, +1 or -1 at a place hashed
from each of its word pairs. A fingerprint is the sum of its paragraphs' vectors, so it doesn't depend on
their order, and ``add`` and ``remove`` update it by a paragraph alone. The first part decides equality; of
the second, squared lengths of vectors and of their difference estimate how many word pairs two texts have
in common, to about sqrt(2 / SKETCH).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table, tidy

LANES, SKETCH = 16, 256
_words: dict[str, int] = {}
_CACHE_LIMIT = 100_000


def _pairs(paragraph: str) -> np.ndarray:
    words = paragraph.split()
    get = _words.get
    if len(_words) > _CACHE_LIMIT:
        _words.clear()
    ids = [get(w) for w in words]
    for i, (h, w) in enumerate(zip(ids, words, strict=True)):
        if h is None:
            ids[i] = _words[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
    h = np.array(ids, np.uint64)
    h = h if len(h) == 1 else h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def of_paragraphs(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(LANES of uint32, SKETCH of int16): the sum of the vectors of a text's paragraphs."""
    lanes, hashes = np.zeros(LANES, np.uint32), []
    for paragraph in text.split("\n"):
        if paragraph.strip():
            lanes += np.frombuffer(hashlib.blake2b(paragraph.encode("utf-8", "surrogatepass"), digest_size=4 * LANES).digest(), "<u4")
            hashes.append(_pairs(paragraph))
    if not hashes:
        return lanes, np.zeros(SKETCH, np.int16)
    h = np.concatenate(hashes)
    sign = 1.0 - 2.0 * (h >> np.uint64(63)).astype(np.float64)
    return lanes, np.bincount((h % np.uint64(SKETCH)).astype(np.int64), sign, SKETCH).astype(np.int64).astype(np.int16)


def show(vector: tuple[np.ndarray, np.ndarray]) -> str:
    return base64.b64encode(vector[0].astype("<u4").tobytes() + vector[1].astype("<i2").tobytes()).decode()


def read(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = base64.b64decode(fingerprint)
    return np.frombuffer(raw[: 4 * LANES], "<u4"), np.frombuffer(raw[4 * LANES :], "<i2")


def add(fingerprint: str, paragraph: str) -> str:
    a, b = read(fingerprint), of_paragraphs(paragraph)
    return show((a[0] + b[0], a[1] + b[1]))


def remove(fingerprint: str, paragraph: str) -> str:
    a, b = read(fingerprint), of_paragraphs(paragraph)
    return show((a[0] - b[0], a[1] - b[1]))


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """1 for equal fingerprints; else the estimated share of word pairs in common, below 1 and at least 0."""
    if (a[0] == b[0]).all() and (a[1] == b[1]).all():
        return 1.0
    x, y = a[1].astype(np.float64), b[1].astype(np.float64)
    d = a[1] - b[1]
    whole = (x * x).sum() + (y * y).sum()
    same = 1.0 - (d.astype(np.float64) ** 2).sum() / whole if whole else 0.0
    return float(min(max(same, 0.0), 1.0 - 2.0**-20))


def edit(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many of the next text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come by bucket, in order; guests end a bucket: they only are the next of the last row."""
    held = None  # (bucket, row without its fingerprints)
    kept_vector: tuple[str, tuple] | None = None

    def vector(text: str) -> tuple:
        nonlocal kept_vector
        if kept_vector is None or kept_vector[0] != text:
            kept_vector = (text, of_paragraphs(text))
        return kept_vector[1]

    def finish(row, following: str) -> tuple:
        own = vector(row[1])
        changed = edit(row[1], following)
        other, nxt = of_paragraphs(changed), vector(following)
        return (row[0], len(row[1]), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), show(own), show(other), likeness(own, other), likeness(own, nxt))

    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    for whole in batches:
        for begin in range(0, len(whole), 500):
            batch, out = whole.iloc[begin : begin + 500], []
            ids = batch["doc_id"].astype("object").where(batch["doc_id"].notna(), None)
            for bucket, doc, text, guest in zip(batch["_bucket"], ids, batch["text"], batch["_guest"], strict=True):
                if held is not None:
                    if held[0] != bucket:
                        raise ValueError("a bucket ended without its guest")
                    out.append(finish(held[1], text))
                    held = None
                if not guest:
                    held = (bucket, (doc, text))
            yield pd.DataFrame(out, columns=columns)
    if held is not None:
        raise ValueError("a bucket ended without its guest")


#: Keys sampled for each range, and copies of one row that a task writes at most.
PER_RANGE, COPIES = 40, 10_000
_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def order_key(doc_id: Column, text: Column) -> Column:
    """Sorts as ids do downwards, null ids last, then by the text's MD5."""
    down = F.lpad(F.hex(F.bitwise_not(doc_id.bitwiseXOR(F.lit(-(2**63))))), 16, "0")
    return F.concat(F.coalesce(F.concat(F.lit("0"), down), F.lit("1")), F.md5(text.cast("binary")))


def _own_next(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows whose next document has the same text."""
    for whole in batches:
        ids = whole["doc_id"].astype("object").where(whole["doc_id"].notna(), None)
        for at in range(0, len(whole), 100):
            part = [next(_run(iter([pd.DataFrame({"_bucket": 0, "doc_id": [d, d], "text": t, "_guest": [False, True]})]))) for d, t in zip(ids[at : at + 100], whole["text"][at : at + 100], strict=True)]
            yield pd.concat(part, ignore_index=True).assign(_n=whole["_n"].to_numpy()[at : at + 100])


def fingerprint_edits(docs: DataFrame, ranges: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edit with the next document's text, and their likenesses.

    The next document has the next smaller id (rows with one id: in the order of their texts' MD5; null ids
    come last); after the last comes the first. A null text is an empty one. A single row is its own next.
    Other columns are ignored, whatever their names. An empty table gives an empty result.

    Rows are dealt into ``ranges`` ranges of (id, MD5) between keys of a sample, so one id, or no id, for all
    rows is spread like any other; only the document at each border is copied into the range before it. Of
    rows equal in id and text one takes part in the order; the others precede it, each the next of the one
    before, and are written from its text.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("_key", order_key(F.col("doc_id"), F.col("text")))
    keys = table(rows.groupBy("_key").agg(F.count("*").alias("_n")))
    ranges = ranges or 2 * max(32, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # at most PER_RANGE short keys a range
    sample = sorted(r["_key"] for r in keys.orderBy(F.xxhash64("_key"), "_key").limit(PER_RANGE * ranges).select("_key").collect())
    if not sample:
        return spark.createDataFrame([], _OUT)
    least = keys.agg(F.min("_key")).first()[0]
    step = max(1, len(sample) // ranges)
    starts = np.array(sorted({least, *sample[step::step]}), dtype="S49")

    @F.pandas_udf("long")
    def deal(key: pd.Series) -> pd.Series:
        own = key.to_numpy().astype("S49")
        at = np.searchsorted(starts, own, side="right") - 1
        return pd.Series(2 * at + (starts[at] == own))

    repeated = table(keys.where("_n > 1"))
    several = table(rows.join(repeated, "_key").groupBy("_key", "doc_id", "_n").agg(F.min("text").alias("text")))
    chain = rows.join(repeated, "_key", "left_anti").select("doc_id", "text", "_key").unionByName(several.select("doc_id", "text", "_key"))
    chain = chain.withColumn("_dealt", deal("_key")).withColumn("_at", F.expr("cast(_dealt div 2 as int)"))
    to = F.array(F.struct(F.col("_at").alias("bucket"), F.lit(False).alias("guest")))
    guest = F.array(F.struct(F.pmod(F.col("_at") - 1, F.lit(len(starts))).alias("bucket"), F.lit(True).alias("guest")))
    dealt = chain.withColumn("_to", F.explode(F.when(F.col("_dealt") % 2 == 1, F.concat(to, guest)).otherwise(to)))
    dealt = dealt.select("doc_id", "text", "_key", F.col("_to.bucket").alias("_bucket"), F.col("_to.guest").alias("_guest"))
    ordered = dealt.repartitionById(len(starts), "_bucket").sortWithinPartitions("_bucket", "_guest", "_key")
    made = ordered.select("doc_id", "text", "_bucket", "_guest").mapInPandas(tidy(_run), _OUT)

    parts = several.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 2) div {COPIES}"))))
    parts = parts.select("doc_id", "text", F.least(F.lit(COPIES), F.col("_n") - 1 - F.col("_part") * COPIES).alias("_n"), "_part").repartition("doc_id", "_part")
    copies = parts.select("doc_id", "text", "_n").mapInPandas(tidy(_own_next), _OUT + ", _n long")
    copies = copies.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), "_n"))).drop("_n")
    return made.unionByName(copies)
