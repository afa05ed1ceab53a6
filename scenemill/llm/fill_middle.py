"""Fill-in-middle transformation over a learned index of boundaries.

The boundaries of a text's units (code points, or words) lie at byte offsets that grow almost evenly with
their rank. ``RankIndex`` covers all of them with segments of lines that stay within ``ERROR`` bytes of every
boundary, and keeps what is left at each boundary as a residual of one byte: a cut at rank r is the line's value
at r plus the residual, exactly. Texts are read in blocks of ``BLOCK`` bytes, so that fitting takes bounded
memory beside the text; a segment ends with its block at the latest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, tidy

ERROR, BLOCK = 100, 1 << 16
MARKS = ("<P>", "<S>", "<M>")


def boundaries(raw: bytes, unit: str = "char") -> Iterator[np.ndarray]:
    """Byte offsets at which a unit begins, in blocks; the text's end is the last one."""
    if unit not in ("char", "word"):
        raise ValueError(f"unknown unit {unit!r}")
    data, blank_before = np.frombuffer(raw, np.uint8), True
    for at in range(0, len(data), BLOCK):
        part = data[at : at + BLOCK]
        if unit == "char":
            begins = (part & 0xC0) != 0x80
        else:
            blank = (part == 32) | ((part >= 9) & (part <= 13))
            begins = ~blank & np.concatenate([[blank_before], blank[:-1]])
            blank_before = bool(blank[-1])
        yield np.flatnonzero(begins) + at
    yield np.array([len(data)])


def segments(offsets: np.ndarray, error: int = ERROR) -> list[tuple[int, float]]:
    """(first place, slope) of greedy segments: the line through a segment's first point stays within ``error``."""
    found, begin, n = [], 0, len(offsets)
    while begin < n:
        low, high, end, size = -np.inf, np.inf, begin + 1, 4096
        while end < n:
            x = np.arange(end - begin, min(n, end + size) - begin, dtype=np.float64)
            y = (offsets[end : end + size] - offsets[begin]).astype(np.float64)
            highs = np.minimum(np.minimum.accumulate((y + error) / x), high)
            lows = np.maximum(np.maximum.accumulate((y - error) / x), low)
            crossed = lows > highs
            fits = int(np.argmax(crossed)) if crossed.any() else len(x)
            if fits:
                low, high = lows[fits - 1], highs[fits - 1]
            end += fits
            if fits < len(x):
                break
            size *= 2
        found.append((begin, float((low + high) / 2) if end > begin + 1 else 0.0))
        begin = end
    return found


class RankIndex:
    """Byte offset of a boundary by its rank; ``n`` is the number of units, rank ``n`` the text's end."""

    def __init__(self, raw: bytes, unit: str = "char", error: int = ERROR):
        if not 1 <= error <= 120:
            raise ValueError("residuals of one byte take an error of 1 to 120")
        rank, lines, residuals = 0, [], []
        for offsets in boundaries(raw, unit):
            found = segments(offsets, error) if len(offsets) else []
            for (place, slope), (until, _) in zip(found, [*found[1:], (len(offsets), 0.0)], strict=True):
                own = offsets[place:until]
                lines.append((rank + place, int(own[0]), slope))
                residuals.append((own - own[0] - np.rint(slope * np.arange(len(own))).astype(np.int64)).astype(np.int8))
            rank += len(offsets)
        self.n = rank - 1
        self.first, self.base, self.slope = (np.array(x) for x in zip(*lines, strict=True))
        self.residuals = np.concatenate(residuals)

    def cut(self, rank: int) -> int:
        """The line's prediction, corrected by what is stored."""
        own = int(np.searchsorted(self.first, rank, side="right")) - 1
        return int(self.base[own]) + int(np.rint(self.slope[own] * (rank - self.first[own]))) + int(self.residuals[rank])


def join(form: str, prefix: bytes, middle: bytes, suffix: bytes) -> bytes:
    p, s, m = (mark.encode() for mark in MARKS)
    return p + prefix + s + suffix + m + middle if form == "psm" else s + suffix + p + prefix + m + middle


def restored(output: Column, form: Column) -> Column:
    """The text from which ``output`` was made; the parts hold no marks, so each mark is found where it occurs."""
    p, s, m = MARKS
    body, middle = F.substring_index(output, m, 1), F.substring_index(output, m, -1)
    psm = F.concat(F.substring(F.substring_index(body, s, 1), len(p) + 1, 2**31 - 1), middle, F.substring_index(body, s, -1))
    spm = F.concat(F.substring_index(body, p, -1), middle, F.substring(F.substring_index(body, p, 1), len(s) + 1, 2**31 - 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def _draw(doc_id: Column, seed: int, place: int) -> Column:
    """One of the 32-bit numbers that an id and a seed give."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * place + 1, 8), 16, 10).cast("long")


def _cutter(unit: str):
    @tidy
    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch, made = whole.iloc[at : at + 256].reset_index(drop=True), []
                for text, form, h1, h2 in zip(batch["text"], batch["form"], batch["h1"], batch["h2"], strict=True):
                    raw = text.encode("utf-8", "surrogatepass")
                    index = RankIndex(raw, unit)
                    if form == "plain":
                        made.append((index.n, None, None, text))
                        continue
                    low, high = sorted((h1 % (index.n + 1), h2 % (index.n + 1)))
                    a, b = (index.cut(low) if low else 0), index.cut(high) if high else 0
                    made.append((index.n, low, high - low, join(form, raw[:a], raw[a:b], raw[b:]).decode("utf-8", "surrogatepass")))
                out = pd.DataFrame(made, columns=["n", "prefix_units", "middle_units", "output"], dtype=object)
                yield pd.concat([batch[["doc_id", "form"]], out], axis=1)[["doc_id", "n", "form", "prefix_units", "middle_units", "output"]]

    return fn


def transform(
    docs: DataFrame, unit: str = "char", seed: int = 1, percent: int = 90, spm_percent: int = 20, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n, form, prefix_units, middle_units, output) of every text.

    ``percent`` of all texts are cut at two places drawn from their id and ``seed``; of these ``spm_percent``
    begin with the suffix ("spm"), the others with the prefix ("psm"). Empty texts and those that hold a mark stay
    as they are ("plain", the cuts null). ``unit`` is "char" (code points) or "word" (cuts before words; blanks
    before the first word go with the first part).

    A null text is an empty one; a null id draws as an empty string. Rows are taken one by one: rows equal in id
    and text have equal results, an empty table gives an empty result, and other columns are ignored, whatever
    their names. No shuffle: a task reads its rows as they come.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    marked = F.lit(False)
    for mark in MARKS:
        marked = marked | F.col("text").contains(mark)
    form = F.when((F.col("text") == "") | marked | (_draw(F.col("doc_id"), seed, 2) % 100 >= percent), "plain")
    form = form.when(_draw(F.col("doc_id"), seed, 3) % 100 < spm_percent, "spm").otherwise("psm")
    draws = [_draw(F.col("doc_id"), seed, i).alias(f"h{i + 1}") for i in range(2)]
    drawn = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "text", form.alias("form"), *draws)
    made = drawn.mapInPandas(_cutter(unit), "doc_id string, n long, form string, prefix_units long, middle_units long, output string")
    return made.withColumn("doc_id", F.col("doc_id").cast(kind))
