"""The registered queries of the corpus operators, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fill_middle, fingerprint, licenses, mixing, near_dedup, neighbours, packing, runs, secrets, sharding, substrings, toxicity, url_filter
from .common import WORD, tidy

SHARD_BYTES = 1 << 20


def tokenizer_path(spark: SparkSession) -> str:
    """The vocabulary's place: ``spark.scenemill.tokenizer``, else that of the installed package."""
    path = spark.conf.get("spark.scenemill.tokenizer", None)
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return path


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(_read(spark, sf_dir, "documents"))


def op2_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def page_captures(pages: DataFrame) -> DataFrame:
    """Each page as fetched on a day of a year, by its id."""
    return pages.select("page_id", "url", F.pmod(F.col("page_id") * 37 + 11, F.lit(365)).cast("int").alias("day"))


def page_list(pages: DataFrame) -> DataFrame:
    """Dated entries on the addresses that occur, chosen by digests of rule and list."""
    rules = pages.select(F.explode(F.slice(url_filter.rule_keys(F.col("url")), 1, 3)).alias("rule")).distinct()
    dated = rules.select("rule", F.explode(F.array(F.lit("ads"), F.lit("malware"))).alias("list"))
    sums = [F.conv(F.substring(F.md5(F.concat_ws("|", "list", "rule", F.lit(i))), 1, 8), 16, 10).cast("long") for i in range(3)]
    dated = dated.where(sums[0] % 5 == 0).select("list", "rule", (sums[1] % 300).cast("int").alias("day"), (sums[2] % 4).alias("kind"))
    block = dated.select("list", "rule", "day", F.when(F.col("kind") == 0, "allow").otherwise("block").alias("action"))
    end = dated.where("kind > 1").select("list", "rule", (F.col("day") + 60).alias("day"), F.lit("remove").alias("action"))
    return block.unionByName(end)


def op3_url_temporal_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    return url_filter.judge(page_captures(pages), page_list(pages))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.budget(_read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_read(spark, sf_dir, "documents"))
    show = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"] != "random")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(F.array_join(F.transform(base, show), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", show), ",").alias("spans"),
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def piece_digests(pieces: DataFrame) -> DataFrame:
    """Pieces without their ids, but with the CRC-32 of these as unsigned 32-bit numbers."""

    @tidy
    def fn(batches):
        import zlib

        import numpy as np

        for b in batches:
            sums = [zlib.crc32(np.frombuffer(x, "<u2").astype("<u4").tobytes()) for x in b["ids"]]
            yield b.drop(columns="ids").assign(ids_crc32=sums)

    columns = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    order = [c.split()[0] for c in columns.split(", ")]
    cast = pieces.select("doc_id", "start", F.col("length").cast("long"), "doc_tokens", "sequence_id", F.col("offset").cast("long"), "ids")
    made = cast.mapInPandas(fn, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids_crc32 long")
    return made.select(*order)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(packing.pack(_read(spark, sf_dir, "documents"), tokenizer_path(spark)))


def op8_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(_read(spark, sf_dir, "documents"), SHARD_BYTES)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_edits(_read(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substrings.without_repeats(_read(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def with_repetitions(docs: DataFrame) -> DataFrame:
    """Documents of which some (by the CRC-32 of their id) go on, from some word on, with a stretch of words again and again."""
    text = F.coalesce("text", F.lit(""))
    h, words = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.regexp_extract_all(text, F.lit(WORD), 0)
    rows = docs.select("doc_id", text.alias("text"), h.alias("h")).withColumn("g", F.expr("h div 10"))
    chosen = F.col("h") % 10 == 0
    rows = rows.withColumn("w", F.when(chosen, words)).withColumn("n", F.size("w").cast("long"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    again = F.transform("w", lambda x, i: F.when(i < F.col("a"), x).otherwise(F.element_at("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int") + 1)))
    return rows.select("doc_id", F.when(chosen & (F.col("n") > 0), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(with_repetitions(_read(spark, sf_dir, "documents")))
    rank = lambda a, b: (
        F.when(a["length"] * b["period"] > b["length"] * a["period"], -1)
        .when(a["length"] * b["period"] < b["length"] * a["period"], 1)
        .when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1))
        .otherwise(F.when(a["period"] < b["period"], -1).when(a["period"] > b["period"], 1).otherwise(0))
    )
    best = F.try_element_at(F.array_sort("runs", rank), F.lit(1))
    show = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        digest(F.array_join(F.transform("runs", show), "")).alias("runs_sha256"),
        digest(F.col("collapsed")).alias("collapsed_sha256"),
    )


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_middle.transform(_read(spark, sf_dir, "documents"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return cut.select(
        "doc_id", "n", "form",
        F.col("prefix_units").alias("prefix_chars"),
        F.col("middle_units").alias("middle_chars"),
        digest(F.col("output")).alias("output_sha256"),
        digest(fill_middle.restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


def queries() -> dict:
    own = (
        op1_minhash_near_dedup, op2_permutation_index, op3_url_temporal_filter, op4_source_mixing, op5_secret_scan,
        op6_toxicity, op7_packing, op8_extendible_sharding, op9_fingerprints, op10_license_scan,
        op11_substring_dedup, op12_periodic_runs, op13_fill_in_middle,
    )
    return {f.__name__: f for f in own}


MIXING_SQL = r"""
WITH d AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), s AS (
  SELECT k, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY k) - 1 AS i FROM d GROUP BY k
), w AS (
  SELECT k, source_size, CASE i % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w, source_size * 2.0::DOUBLE AS cap FROM s
), l AS (
  SELECT *, cap / w AS r,
    (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM w
), f AS (SELECT arg_min(level, r) AS level FROM l WHERE r > level), t AS (
  SELECT k, source_size, CASE WHEN r <= l.level OR f.level IS NULL THEN cap ELSE f.level * w END AS target FROM l LEFT JOIN f ON true
), p AS (
  SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(target / t.source_size) ELSE 0 END AS e,
    coalesce(sum(size) OVER (PARTITION BY k ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t USING (k)
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(e * size + greatest(0, least(floor(target) - e * source_size - before, size)) AS BIGINT) AS taken FROM p
"""

SHARDING_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0) AS bytes,
    lpad(bin(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS UBIGINT)), 48, '0') AS bits
  FROM documents
), x AS (SELECT doc_id, bytes, bits, n, substr(bits, 1, n) AS shard FROM d, (SELECT unnest(range(0, 17)) AS n)),
s AS (SELECT *, sum(bytes) OVER (PARTITION BY shard, n) AS shard_bytes FROM x)
SELECT doc_id, CAST(bytes AS BIGINT) AS bytes, arg_min(shard, n) AS shard, CAST(arg_min(shard_bytes, n) AS BIGINT) AS shard_bytes, true AS fits
FROM s WHERE shard_bytes <= {SHARD_BYTES} GROUP BY doc_id, bytes, bits
"""


URL_SQL = r"""
WITH h AS (
  SELECT page_id, CAST((page_id * 37 + 11) % 365 AS INT) AS day,
    lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:\[]+)', 1), '\.+$', '')) AS host,
    regexp_extract(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '^(/[^/]+)', 1) AS first
  FROM pages
), k AS (
  SELECT page_id, day, CASE WHEN host IS NULL OR host = '' THEN [] ELSE list_concat(CASE WHEN first <> '' THEN [host || first] ELSE [] END,
    list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.'))) END AS keys FROM h
), e AS (
  SELECT DISTINCT unnest(keys[:3]) AS rule FROM k
), d AS (
  SELECT rule, list, CAST('0x' || substr(md5(list || '|' || rule || '|0'), 1, 8) AS BIGINT) AS a, CAST('0x' || substr(md5(list || '|' || rule || '|1'), 1, 8) AS BIGINT) AS b,
    CAST('0x' || substr(md5(list || '|' || rule || '|2'), 1, 8) AS BIGINT) AS c FROM e, (SELECT unnest(['ads', 'malware']) AS list)
), n AS (
  SELECT list, rule, CAST(b % 300 AS INT) AS day, CASE WHEN c % 4 = 0 THEN 'allow' ELSE 'block' END AS action FROM d WHERE a % 5 = 0
  UNION ALL SELECT list, rule, CAST(b % 300 AS INT) + 60, 'remove' FROM d WHERE a % 5 = 0 AND c % 4 > 1
), v AS (
  SELECT list, rule, day, max(action) AS action FROM n GROUP BY ALL
), i AS (
  SELECT *, lead(day) OVER (PARTITION BY list, rule ORDER BY day) AS until FROM v
), p AS (
  SELECT page_id, day, unnest(keys) AS rule, unnest(range(len(keys))) AS pos FROM k
), m AS (
  SELECT p.page_id, p.day, p.rule, i.list, i.action, row_number() OVER (PARTITION BY p.page_id, p.day ORDER BY pos, action, list, p.rule) AS place
  FROM p JOIN i ON i.rule = p.rule AND p.day >= i.day AND (i.until IS NULL OR p.day < i.until) WHERE i.action <> 'remove'
)
SELECT DISTINCT k.page_id, k.day, coalesce(m.action, 'pass') AS verdict, m.rule, m.list FROM k LEFT JOIN m ON m.page_id = k.page_id AND m.day = k.day AND place = 1
"""


SUBSTRING_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), p AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i, len(w) AS n FROM d
), x AS (
  SELECT doc_id, i, word, CASE WHEN i + 20 <= n THEN string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) END AS passage FROM p
), r AS (
  SELECT *, passage IS NOT NULL AND row_number() OVER (PARTITION BY passage ORDER BY doc_id, i) > 1 AS again FROM x
), c AS (
  SELECT doc_id, i, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM r
), k AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""

MIDDLE_SQL = """
WITH h AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), d AS (
  SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM h
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
    ELSE '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM c
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_url_temporal_filter": URL_SQL, "op4_source_mixing": MIXING_SQL, "op8_extendible_sharding": SHARDING_SQL,
        "op11_substring_dedup": SUBSTRING_SQL, "op13_fill_in_middle": MIDDLE_SQL,
    }
