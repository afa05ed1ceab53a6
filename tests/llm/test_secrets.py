import hashlib
import re

from pyspark.sql import functions as F

from scenemill.llm import secrets
from scenemill.llm.queries import queries

PLAIN = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 24),
}


def base(text):
    found = [(m.start(), i, kind, m.end()) for i, (kind, (p, g, n)) in enumerate(PLAIN.items()) for m in p.finditer(text or "") if len(m[g]) >= n]
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


def test_whole_table(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries()["op5_secret_scan"](spark, sf_dir).collect():
        want = base(texts[r.doc_id])
        shown = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(shown.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for k, _, _ in want) for kind in PLAIN)
        assert {s for s in r.spans.split(",") if s} >= {s for s in shown.split(",") if s}


TEXTS = [
    None, "", "x", "token=api_key=abcdefgh", "secret=token: abcdefgh", "PassWord = 'abc123' and passwd:short", "api_key: abcdef apikey=\"zzzzzzz\"",
    "é𝄞 token=ünot token=abcdef", "AKIAAKIA12 AKIA" + "Q" * 16, "AKIA" + "7" * 15, "0123456789abcdef01234567 deadbeef " + "a" * 23 + " " + "b" * 24,
    "token=" + "ab12" * 8000, "ſecret=abcdefgh toKen=abcdefgh", "token=\tabcdefgh secret=abcdefgh\n", "key qZ8fK2mX9vB4nT7wR3jL6pD1 done", "internationalization_of_identifiers_2024_report",
]


def test_odd_texts_and_redaction(spark):
    rows = list(enumerate(TEXTS)) + [(100 + i, f"the garden_window letter {i} silver morning") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"spans": F.lit("own"), "start": F.lit(1)})
    for r in secrets.scan(df).collect():
        got = [(s.kind, s.start, s.end) for s in r.spans]
        assert [s for s in got if s[0] != "random"] == base(dict(rows)[r.doc_id]), r.doc_id
    kinds = {r.doc_id: {s.kind for s in r.spans} for r in secrets.scan(df).collect()}
    assert kinds[14] == {"random"} and kinds[15] == set()
    clean = secrets.redact(df)
    assert clean.columns == df.columns
    for r in clean.collect():
        if dict(rows)[r.doc_id]:
            assert not base(r.text) and (r.text == dict(rows)[r.doc_id]) == (not kinds[r.doc_id])
    assert secrets.scan(df.limit(0)).count() == 0


def test_ratio_tells_random_from_words(spark, sf_dir):
    ratios = secrets.train(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    mean = lambda t: sum(ratios[t[i : i + 2]] for i in range(len(t) - 1)) / (len(t) - 1)
    assert all(mean(hashlib.sha256(str(i).encode()).hexdigest()) > secrets.THRESHOLD for i in range(200))
    assert mean("the_and_ertion_of_thering") < 0


def test_random_tokens_of_letters_only_and_short_ones(spark, sf_dir):
    kept = ["qZkfKsmXivBonTwwRtjLzpDe", "WfXqHvKzRmTgBnYpJdLc", "qZ8fK2mX9vB4nT7w", "K7/dQx2+Vb9LmZp4Tw", "XQZJVKWPBFGYXHQDNZRK"]
    plain = ["=" * 30, "-" * 40, "_" * 16, "0" * 20, "4111111111111111", "internationalization", "the_and_ertion_of_thering", "getElementsByClassName"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(-1 - i, f"so {t} it is") for i, t in enumerate(kept + plain)], "doc_id long, text string")
    got = {r.doc_id: [(s.start, s.end) for s in r.spans if s.kind == "random"] for r in secrets.scan(docs.unionByName(more)).where("doc_id < 0").collect()}
    assert got == {-1 - i: [(3, 3 + len(t))] if t in kept else [] for i, t in enumerate(kept + plain)}


def test_copies_do_not_weigh_in_training(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text")
    hot = spark.range(300).select(F.lit("zzqx jjxq vvzz 99-zz zz=jj").alias("text"))
    for rows in (50, 4000):
        assert secrets.train(docs.unionByName(hot), train_rows=rows) == secrets.train(docs.unionByName(hot).distinct(), train_rows=rows)


def brute_random(text, ratios, threshold=secrets.THRESHOLD):
    """Spans of tokens whose ratios say random, character by character."""
    out = []
    for m in re.finditer(secrets.TOKEN, text or ""):
        t = m[0]
        pairs = [t[i : i + 2] for i in range(len(t) - 1)]
        mean = sum(ratios[p] for p in pairs) / len(pairs)
        if mean > threshold * (1 + 20 / len(t)) and sum(ratios[p] for p in dict.fromkeys(pairs)) > secrets.EVIDENCE * threshold:
            out.append((m.start(), m.end()))
    return out


def test_random_spans_of_the_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    ratios = secrets.train(docs)
    got = {r.doc_id: [(s.start, s.end) for s in r.spans if s.kind == "random"] for r in secrets.scan(docs).collect()}
    assert got == {d: brute_random(t, ratios) for d, t in texts.items()} and any(got.values())


def test_repeated_rows_and_empty_tables_train(spark):
    df = spark.createDataFrame([(1, "token=abcdefgh"), (1, "token=abcdefgh"), (None, ""), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, len(r.spans)) for r in secrets.scan(df).collect())
    assert got == [(0, 0), (0, 0), (1, 1), (1, 1)]
