"""Words of whole texts as 64-bit hashes, for operators that compare sequences of words."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd

_U = np.uint64
#: Bytes of text that are hashed at once in a task.
AT_ONCE = 1 << 20


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = (x + _U(salt & (2**64 - 1))) * _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(29))


#: A random number for each byte at each place of a word, places taken modulo 64.
_LETTERS = mix(np.arange(1, 64 * 256 + 1, dtype=_U), 0x2545F4914F6CDD1D)


class Words(NamedTuple):
    """Words of several texts: word i has hash[i] and the bytes data[begin[i]:end[i]]; text t has the words since[t]:until[t]."""

    data: bytes
    hash: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    since: np.ndarray
    until: np.ndarray


def words_of(texts: list[str | bytes | None]) -> Words:
    """Words are runs of other bytes than space and \\t to \\r; equal words have equal hashes. A null text has none."""
    raw = [t if isinstance(t, bytes) else t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    data = b"\n".join([*raw, b""])
    letters = np.frombuffer(data, np.uint8)
    inside = ~((letters == 32) | ((letters >= 9) & (letters <= 13)))
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(begin):
        at = np.flatnonzero(inside)
        place = at - np.repeat(begin, end - begin)
        byte = _LETTERS[((place & 63) << 8) + letters[at]] * ((place >> 6) * 2 + 1).astype(_U)
        own = mix(np.add.reduceat(byte, np.concatenate([[0], np.cumsum(end - begin)[:-1]])))
    else:
        own = np.empty(0, _U)
    until = np.searchsorted(begin, np.cumsum([len(r) + 1 for r in raw]))
    return Words(data, own, begin, end, np.concatenate([[0], until[:-1]]).astype(np.int64), until.astype(np.int64))


def in_parts(batches: Iterator[pd.DataFrame], column: str = "text", most: int = 2000) -> Iterator[pd.DataFrame]:
    """The rows of a task, so few at once that their texts have about AT_ONCE letters (or are one long text)."""
    for whole in batches:
        lengths = np.array([len(t) if t else 0 for t in whole[column]], np.int64)
        part = (np.cumsum(lengths) - lengths) // AT_ONCE * (len(whole) + 1) + np.arange(len(whole)) // most
        for own in np.split(np.arange(len(whole)), np.flatnonzero(np.diff(part)) + 1):
            if len(own):
                yield whole.iloc[own]
