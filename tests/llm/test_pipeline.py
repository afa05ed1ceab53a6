import corpus_pipeline
from tests.llm.test_near_dedup import brute
from tests.llm.test_packing import PATH
from tests.llm.test_secrets import base
from tokenizers import Tokenizer


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = kept[name] = spark.read.parquet(str(tmp_path / name))
    first = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name in ("toxicity", "near_dedup", "secrets", "mixing"):
        assert kept[name].columns == first.columns
    scores = {r.doc_id: r.predicted for r in __import__("scenemill.llm.queries", fromlist=["queries"]).queries()["op6_toxicity"](spark, sf_dir).collect()}
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    assert ids(kept["toxicity"]) == sorted(d for d, p in scores.items() if not p)
    want = brute([(r.doc_id, r.text) for r in kept["toxicity"].collect()], 80)
    assert ids(kept["near_dedup"]) == sorted(d for d, (_, _, k) in want.items() if k)
    before = {r.doc_id: r.text for r in kept["near_dedup"].collect()}
    after = {r.doc_id: r for r in kept["secrets"].collect()}
    assert set(before) == set(after)
    for d, text in before.items():
        assert not base(after[d].text) and (bool(base(text)) or after[d].text == text or "[SECRET]" in after[d].text)
        assert after[d].n_chars == len(after[d].text)
    bpe = Tokenizer.from_file(PATH)
    tokens = sum(len(bpe.encode(r.text, add_special_tokens=False).ids) + 1 for r in kept["mixing"].collect())
    assert tokens == sum(r.length for r in kept["packing"].collect())


def made(spark, folder, rows, labels):
    """Tables of a folder with columns whose names the stages use themselves."""
    kind = "doc_id long, text string, lang string, source string, n_chars long, row string, _id long, spans array<int>, size long, kept boolean"
    full = [(d, t, "en", s, len(t or ""), "r", 1, [1], 2, False) for d, t, s in rows]
    spark.createDataFrame(full, kind).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_run_on_odd_rows(spark, tmp_path):
    """Nulls in every place, repeated rows, ties, one very long text, clashing names: pieces of whole documents."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    texts = [" ".join(f"t{k}n{i}" for i in range(40)) for k in range(12)]
    rows = [(k, t, ("a", "b", None)[k % 3]) for k, t in enumerate(texts)]
    rows += [(None, None, None), (None, "", "a"), (None, texts[0], "b"), (20, None, "a"), (21, "", None), (22, " \n ", "a"), (23, long, "b"), (24, texts[3] + " more", "a"), (25, texts[3], "b")]
    rows += [rows[5]] * 3 + [(5, "another text of the same id, of more than five words", "c")]
    sf = made(spark, tmp_path / "odd", rows, [(k, 1, 0) for k in range(12)] + [(3, None, None), (None, 1, 1)])
    got = corpus_pipeline.run(spark, sf).collect()
    ids = {r.doc_id for r in got}
    assert {0, 1, 2, 3, 4, 6, 23} & ids and not ids & {24, 25}
    for r in got:
        assert 0 <= r.start < r.start + r.length <= r.doc_tokens and 0 <= r.offset <= 1024 - r.length
    used = {}
    for r in got:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
    again = corpus_pipeline.run(spark, sf)
    key = lambda rows: sorted(((r.doc_id is None, r.doc_id or 0), r.start, r.length, r.ids_crc32) for r in rows)
    assert key(again.collect()) == key(got)


def test_run_on_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, made(spark, tmp_path / "none", [], [])).count() == 0
    assert corpus_pipeline.run(spark, made(spark, tmp_path / "blank", [(None, None, None)], [])).count() <= 2
