"""Queries of the training-data operators: thin contracts over the operators' general interfaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .progressive_jpeg import store_texts

    return store_texts(_table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import held_out, predict, train

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs, ~held_out(F.col("doc_id")))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    return dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_personal_data

    return find_personal_data(_table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score, train

    docs = _table(spark, sf_dir, "documents")
    return score(docs, train(docs, _table(spark, sf_dir, "labels")))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), **byte_bpe())


def byte_bpe() -> dict:
    """The byte-level vocabulary as pack_documents takes it; the special string is one id, as in the vocabulary's library."""
    import public_tokenizers as p

    return {"ranks_path": p.path("byte_bpe_50k.tiktoken"), "pattern": p.PATTERN, "specials": {"<|endoftext|>": 50256}, "exact_path": p.path("byte_bpe_50k.json")}


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import ngram_components

    return ngram_components(_table(spark, sf_dir, "documents"))


def op11_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .runs import word_runs

    return word_runs(_table(spark, sf_dir, "documents"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resampling import resample

    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_duplicates

    return exact_duplicates(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


_MIX = r"""WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
 s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
 w AS (SELECT *, CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS w, CAST(source_size * 2 AS DOUBLE) AS room FROM s),
 r AS (SELECT *, row_number() OVER (ORDER BY room / w, source NULLS LAST) AS k FROM w),
 l AS (SELECT *, (CAST((SELECT sum(source_size) FROM s) AS DOUBLE) * 1.5 - coalesce(sum(room) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / ((SELECT sum(w) FROM w) - coalesce(sum(w) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM r),
 o AS (SELECT min_by(level, k) AS open FROM l WHERE room > level * w),
 t AS (SELECT source, source_size, least(room, coalesce(open * w, room)) AS target FROM l, o),
 b AS (SELECT *, CAST(round(target) AS BIGINT) AS budget FROM t),
 e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM b),
 x AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs, e.budget - e.epochs * e.source_size AS cut, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id NULLS LAST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
 SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, cut - start)) AS BIGINT) AS taken FROM x"""


# CRC-32 of each distinct word from its bytes in hex, bit by bit table of 256 entries
_RESAMPLE = r"""WITH crc AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS tab FROM range(256) r(i)),
 d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
 b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
 dw AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(words) AS w FROM d) GROUP BY ALL),
 bw AS (SELECT w, count(*) AS n FROM (SELECT unnest(words) AS w FROM b) GROUP BY w),
 v AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
 k AS (SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(h) // 2), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))), lambda c, x: xor(c // 256, tab[CAST(xor(c % 256, x) + 1 AS BIGINT)])), 4294967295) % 10000 AS bucket FROM v, crc),
 ds AS (SELECT bucket, CAST(sum(n) AS DOUBLE) AS s FROM dw JOIN k USING (w) GROUP BY bucket),
 bt AS (SELECT bucket, CAST(sum(n) AS DOUBLE) AS t FROM bw JOIN k USING (w) GROUP BY bucket),
 g AS (SELECT bucket, CAST(floor(1000.0::DOUBLE * ln((coalesce(t, 0) + 1) * ((SELECT coalesce(sum(s), 0) FROM ds) + 10000) / ((s + 1) * ((SELECT coalesce(sum(t), 0) FROM bt) + 10000)))) AS BIGINT) AS gain FROM ds LEFT JOIN bt USING (bucket)),
 f AS (SELECT doc_id, sum(n) AS n_features, sum(n * gain) AS weight FROM dw JOIN k USING (w) JOIN g USING (bucket) GROUP BY doc_id),
 x AS (SELECT doc_id, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN f USING (doc_id)),
 y AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000.0::DOUBLE * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM x),
 z AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place FROM y)
 SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= (SELECT count(*) FROM y WHERE n_features >= 20) * 10 // 100 THEN place END AS rank FROM z"""

_EXACT = """SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
 FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""


def oracle_sql() -> dict[str, str]:
    """Checks for DuckDB; the other operators have no SQL form and are held against brute force in the tests."""
    return {"op8_mixing": _MIX, "op12_resampling": _RESAMPLE, "op13_exact_dedup": _EXACT}
