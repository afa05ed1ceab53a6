"""Toxicity by a noisy channel: hidden words are restored, then the restored text is scored.

Restoring: a token that may hide a word (digits or signs among its letters, letters repeated, or single
characters with gaps between them) is a lattice: each character was itself, a letter it stands for, a
repetition or a separator, and some pairs of letters were one, each at a channel cost. Viterbi decoding finds
the likeliest letters of the whole token, however long, under a trigram model of characters counted over all
documents. A plain word's lattice has one path: itself. The
parts of a joined token (a-b, a/b) are read on their own as well. Runs of single characters, with one sign or any
blanks between them, are read in parts that overlap by the longest word looked for (``LONGEST`` letters), so
no such word is lost at a border; their lattice has word borders too, and every word and stem that begins
anywhere in a part is scored.

Scoring: words and their stems have weights, the smoothed log odds of being in a toxic document. A document
has the largest weight of its words and the number of its weighty words; a logistic curve over both, fitted
on other documents than the weights, gives the score. Weights come from at most ``TRAIN_ROWS`` documents
of each label; every word and stem in three of the toxic ones is weighed.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table, tidy

TRAIN_ROWS, STEMS = 10_000, (4, 5, 6, 7)
#: Letters that a character may stand for.
STANDS_FOR = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c"}
#: Pairs of letters that may stand for one.
PAIRS = {"vv": "w", "ph": "f"}
SEPARATORS = "-_.*~'"
COST_SIGN, COST_REPEAT, COST_SEPARATOR = 1.0, 0.5, 0.7
_SIZE = 28  # word border, a-z, any other letter
_GAP = r"(?:[.\-_*]|[ \t]+)"
_SPACED = re.compile(rf"(?<!\S)(?:\S{_GAP}){{2,}}\S(?!\S)")
_JOINED = re.compile(r"[-_/.,;:~]+")  # what may join words to one token
_HIDING = re.compile(r"[0-9@$!|+*_.~(-]|(.)\1\1|vv|ph")
_EDGE = " \t\r\n.,;:!?\"'()[]{}<>%&#*$~-_/\\|"
_PUNCTUATION = " \t\r\n.,;:?\"'()[]{}<>%&#/\\"  # signs at an edge that stand for no letter
PART, OVERLAP, SHORTEST, LONGEST = 40, 20, 4, 20  # of a run: letters in a part and in two parts, of a word in it
#: Tokens whose weight a task remembers, and letters whose trigrams it counts at once.
MEMORY, AT_ONCE = 100_000, 1 << 20


def _codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    out = np.where((points >= 97) & (points <= 122), points - 96, np.where(points >= 170, 27, 0))
    return out.astype(np.int64)


@tidy
def _count_trigrams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total, held, letters = np.zeros(_SIZE**3, np.int64), [], 0

    def count() -> None:
        c = _codes(" " + "  ".join(held) + " ")
        total[:] += np.bincount((c[:-2] * _SIZE + c[1:-1]) * _SIZE + c[2:], minlength=_SIZE**3)

    for batch in batches:
        for text in batch["text"]:
            if text:
                held.append(text)
                letters += len(text)
            if letters > AT_ONCE:
                count()
                held, letters = [], 0
    if held:
        count()
    at = np.flatnonzero(total)
    yield pd.DataFrame({"code": at, "n": total[at]})


class Restorer:
    def __init__(self, counts: np.ndarray):
        n = counts.reshape(_SIZE, _SIZE, _SIZE) + 0.1
        same = np.arange(1, _SIZE - 1)
        n[same, same, same] = 0.1  # a letter three times over is what is to be undone, not how words are spelt
        self.log = np.log(n / n.sum(axis=2, keepdims=True)).tolist()

    def options(self, token: str, i: int) -> list[tuple[int, str, float]]:
        """What may begin at character i: (characters read, letter said, cost)."""
        c = token[i]
        out = [(1, c, 0.0)] if c.isalpha() else [(1, x, COST_SIGN) for x in STANDS_FOR.get(c, "")]
        if i and c == token[i - 1]:
            out.append((1, "", COST_REPEAT))
        if c in SEPARATORS or not c.isalnum():
            out.append((1, "", COST_SEPARATOR))
        if token[i : i + 2] in PAIRS:
            out.append((2, PAIRS[token[i : i + 2]], COST_SIGN))
        return out or [(1, "", 3.0)]

    def __call__(self, token: str, borders: bool = False) -> str:
        """The likeliest letters of one token; with blanks between words, if asked.

        A state is the last two letters; it keeps its best score and a chain of what was said, shared with
        the states it came from, so time and memory are linear in the token.
        """
        ahead: list[dict] = [{(0, 0): (0.0, None)}, {}, {}]
        log = self.log
        for i in range(len(token)):
            choices = self.options(token, i)
            for (a, b), (score, said) in ahead[0].items():
                for n, letter, cost in choices:
                    new = ahead[n]
                    if letter:
                        c = ord(letter) - 96 if "a" <= letter <= "z" else 27
                        value = score + log[a][b][c] - cost
                        if (b, c) not in new or value > new[b, c][0]:
                            new[b, c] = (value, (said, letter))
                        if borders and b:
                            value = score + log[a][b][0] + log[b][0][c] - cost
                            if (0, c) not in new or value > new[0, c][0]:
                                new[0, c] = (value, (said, " " + letter))
                    elif (a, b) not in new or score - cost - 2.0 > new[a, b][0]:
                        new[a, b] = (score - cost - 2.0, said)
            ahead = [*ahead[1:], {}]
        (a, b), (_, said) = max(ahead[0].items(), key=lambda x: x[1][0] + log[x[0][0]][x[0][1]][0])
        letters = []
        while said is not None:
            said, letter = said
            letters.append(letter)
        return "".join(reversed(letters))


def features(word: str) -> list[str]:
    return ["=" + word, *("^" + word[:k] for k in STEMS if len(word) > k)]


class Reader:
    """The readings of each distinct token of a text: as it stands and, where it may hide a word, restored.

    A run of single characters is a token of its own, its parts joined and marked by a blank before them.
    """

    def __init__(self, restore: Restorer):
        self.restore = restore

    def words(self, token: str) -> tuple[str, ...]:
        plain = token.strip(_EDGE)
        found = [plain] if plain else []
        core = token.strip(_PUNCTUATION)
        for part in [core, *_JOINED.split(core)]:
            if part != core and len(part) >= SHORTEST:
                found.append(part)
            if _HIDING.search(part) and any(c.isalpha() for c in part) and (part == core or len(part) >= SHORTEST):
                found.append(self.restore(part))
        if plain != core and _HIDING.search(plain) and any(c.isalpha() for c in plain):
            found.append(self.restore(plain))
        if token[0] == " " and any(c.isalpha() for c in token):
            found += self.restore(token[1:], borders=True).split()
        return tuple(dict.fromkeys(found))

    def features(self, token: str) -> set[str]:
        """Those of the token's words; in a part of a run, of all words of some length that may begin anywhere."""
        words = self.words(token)
        out = {f for w in words for f in features(w)}
        if token[0] == " ":
            for w in [*words[:3], "".join(self.restore(token[1:], borders=True).split())]:
                for i in range(len(w) - SHORTEST + 1):
                    out.update("^" + w[i : i + k] for k in STEMS)
                    out.update("=" + w[i : i + k] for k in range(SHORTEST, LONGEST + 1))
        return out

    def tokens(self, text: str) -> set[str]:
        text = text.lower()
        out = set(text.split())
        for m in _SPACED.findall(text):
            run = re.sub(r"[ \t.\-_*]", "", m)
            out.update(" " + run[i : i + PART] for i in range(0, max(1, len(run) - OVERLAP), PART - OVERLAP))
        out.discard(" ")
        return out


def _count_features(restore: Restorer):
    @tidy
    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read, counts, memory = Reader(restore), Counter(), {}

        def words(token: str) -> tuple[str, ...]:
            if token not in memory:
                if len(memory) > MEMORY:
                    memory.clear()
                memory[token] = read.words(token)
            return memory[token]

        for batch in batches:
            for text in batch["text"]:
                counts.update({f for t in read.tokens(text or "") for w in words(t) for f in features(w)})
        if counts:
            yield pd.DataFrame({"feature": list(counts), "n": list(counts.values())})

    return fn


class Scorer:
    def __init__(self, restore: Restorer, weights: dict[str, float], curve: tuple[float, float, float]):
        self.read, self.weights, self.curve, self.memory = Reader(restore), weights, curve, {}
        self.whole = {f[1:]: w for f, w in weights.items() if f[0] == "="}
        self.stems = {f[1:]: w for f, w in weights.items() if f[0] == "^"}

    def token(self, token: str) -> float:
        core = token.strip(_PUNCTUATION)
        if core.isalpha() and token[0] != " " and not _HIDING.search(core):  # a plain word: no other reading
            value = self.whole.get(core, 0.0)
            for k in STEMS:
                if len(core) > k:
                    value = max(value, self.stems.get(core[:k], 0.0))
        else:
            value = max((self.weights.get(f, 0.0) for f in self.read.features(token)), default=0.0)
        if len(self.memory) > MEMORY:
            self.memory.clear()
        self.memory[token] = value
        return value

    def evidence(self, text: str | None) -> tuple[float, float]:
        known, values = self.memory.get, []
        for t in self.read.tokens(text or ""):
            value = known(t)
            values.append(self.token(t) if value is None else value)
        return max(values, default=0.0), math.log1p(sum(v > 1.0 for v in values))

    def score(self, text: str | None) -> float:
        m, n = self.evidence(text)
        a, b, c = self.curve
        return 1.0 / (1.0 + math.exp(-min(30.0, max(-30.0, a + b * m + c * n))))


def _apply(scorer: Scorer, evidence: bool):
    @tidy
    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if evidence:
                found = [scorer.evidence(t) for t in batch["text"]]
                yield pd.DataFrame({"toxic": batch["toxic"].array, "m": [x[0] for x in found], "n": [x[1] for x in found]})
            else:
                if not len(batch):
                    continue
                yield batch.drop(columns="text").assign(score=[scorer.score(t) for t in batch["text"]])

    return fn


def fit_curve(m: np.ndarray, n: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic curve with a small ridge, by Newton steps; a fixed one where a label is missing."""
    if not len(y) or y.min() == y.max():
        return (-5.0, 2.0, 0.5)
    x = np.stack([np.ones(len(m)), m, n], 1)
    w = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 1e-2, 1e-2])
        w = w + np.linalg.solve(h, x.T @ (y - p) - np.array([1e-3, 1e-2, 1e-2]) * w)
    return tuple(float(v) for v in w)


def remainder(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Scorer:
    """Character counts over all of ``docs``; weights and curve from labelled rows with a remainder over 0."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    counts = np.zeros(_SIZE**3, np.int64)
    grams = texts.select("text").mapInPandas(_count_trigrams, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))
    for r in grams.collect():  # at most 28**3 numbers
        counts[r["code"]] = r["n"]
    restore = Restorer(counts)
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.withColumn("fold", remainder(F.col("doc_id"))).where("fold > 0").join(texts.select("doc_id").where("doc_id is not null").distinct(), "doc_id", "left_semi")
    picked = [known.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows) for t in (0, 1)]
    sample = texts.join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id")  # 2 * train_rows small rows
    sample = sample.groupBy("doc_id", "toxic", "fold").agg(F.min("text").alias("text"))  # one text of an id
    sample = sample.repartition(4 * docs.sparkSession.sparkContext.defaultParallelism).select("text", "toxic", "fold")
    sample = table(sample)
    size = {(r["toxic"], r["fit"]): r["n"] for r in sample.groupBy("toxic", (F.col("fold") < 4).alias("fit")).agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = size.get((1, True), 0), size.get((0, True), 0)

    def counted(toxic: int) -> DataFrame:
        rows = sample.where((F.col("fold") < 4) & (F.col("toxic") == toxic)).select("text")
        return rows.mapInPandas(_count_features(restore), "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))

    both = counted(1).where("n >= 3").join(counted(0).withColumnRenamed("n", "clean"), "feature", "left")
    odds = F.log((F.col("n") + 0.5) / (n_toxic + 1)) - F.log((F.coalesce("clean", F.lit(0)) + 0.5) / (n_clean + 1))
    weighty = both.withColumn("odds", odds).where("odds > 1.5").select("feature", (F.col("odds") * F.col("n") / (F.col("n") + 3)).alias("weight"))
    weights = {r["feature"]: r["weight"] for r in weighty.collect()}  # of at most train_rows texts
    scorer = Scorer(restore, weights, (-5.0, 2.0, 0.5))
    fit = sample.where("fold = 4").mapInPandas(_apply(scorer, True), "toxic int, m double, n double").toPandas()
    scorer.curve = fit_curve(fit["m"].to_numpy(), fit["n"].to_numpy(), fit["toxic"].to_numpy(float))
    return scorer


def score(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs`` (doc_id, text; other columns are ignored).

    ``labels``: (doc_id, toxic); null or other values are no labels, of several for one id the largest counts.
    Without labels of both kinds a fixed curve stands in and every score is low. Null and empty texts get the
    score of a text without weighty words. Texts and tokens are read whole, however long. Repeated rows are
    scored each; of the rows of one id the least text trains. An empty table gives an empty result.
    """
    scorer = train(docs, labels, **options)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder(F.col("doc_id")) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInPandas(_apply(scorer, False), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that score 0.5 or more; columns and all other rows as they are."""
    scorer = train(docs, labels, **options)

    @tidy
    def judge(batches):
        for texts in batches:
            yield pd.Series([scorer.score(t) < 0.5 for t in texts], dtype=bool)

    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from judge(batches)

    return docs.where(clean(F.col("text").cast("string")))
