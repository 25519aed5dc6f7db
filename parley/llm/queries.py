"""The registered queries of this subpackage: thin digests of each operator's
output over the whole table, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents", "doc_id", "text")


# ------------------------------------------------------------------- mixing
MIX_WEIGHTS, MIX_BUDGET, MIX_EPOCHS, MIX_SEED = [3, 1, 2], 1.5, 2.0, "mix-1"

MIX_SQL = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5('{MIX_SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k
  FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rn FROM s0),
s2 AS (SELECT *, CAST([3, 1, 2][rn % 3 + 1] AS DOUBLE) AS w, source_size * CAST(2 AS DOUBLE) AS cap FROM s1),
s3 AS (SELECT *, (sum(source_size) OVER () * CAST(1.5 AS DOUBLE) - coalesce(sum(cap) OVER
           (ORDER BY cap / w, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY cap / w, rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM s2),
s4 AS (SELECT *, cap / w > lvl AS op, max(CASE WHEN cap / w > lvl THEN lvl END) OVER () AS fill FROM s3),
s5 AS (SELECT source, source_size, CASE WHEN op THEN least(cap, fill * w) ELSE cap END AS target FROM s4),
s AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM s5),
c AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
SELECT c.doc_id, c.size, s.source_size, s.target,
       CAST(s.whole * c.size + least(c.size, greatest(0,
            CAST(round(s.target) AS BIGINT) - s.whole * s.source_size - c.before)) AS BIGINT) AS taken
FROM c JOIN s ON c.source IS NOT DISTINCT FROM s.source"""


@register("op3_mixing", MIX_SQL)
def op3_mixing(spark, sf_dir):
    from parley.llm.mixing import mix
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "source")
    return mix(docs, MIX_WEIGHTS, MIX_BUDGET, MIX_EPOCHS, MIX_SEED) \
        .select("doc_id", "size", "source_size", "target", "taken")


# --------------------------------------------------------------- line dedup
LINE_MIN_CHARS = 10

LINES_SQL = f"""
WITH l AS (
  SELECT doc_id, unnest(generate_series(1, len(ls))) AS pos, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= {LINE_MIN_CHARS}
      GROUP BY key HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT k.*, f.first IS NOT NULL AND f.first <> k.doc_id AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""


@register("op5_line_dedup", LINES_SQL)
def op5_line_dedup(spark, sf_dir):
    from parley.llm.line_dedup import dedup_lines
    return dedup_lines(documents(spark, sf_dir), LINE_MIN_CHARS).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


# --------------------------------------------------------------- tokenizers
def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@register("op7_bpe")
def op7_bpe(spark, sf_dir):
    from parley.llm.bpe import bpe_round_trip
    return bpe_round_trip(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


@register("op8_token_counts")
def op8_token_counts(spark, sf_dir):
    from parley.llm.token_counts import token_counts
    return token_counts(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


# ------------------------------------------------------------------ secrets
@register("op9_secrets")
def op9_secrets(spark, sf_dir):
    from parley.llm.secrets import scan_secrets
    return scan_secrets(documents(spark, sf_dir)).select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(F.encode("base_spans", "UTF-8"), 256).alias("base_sha256"), "spans")


# ------------------------------------------------------------------ simhash
SIMHASH_WORDS, SIMHASH_BITS = 4, 4


@register("op6_simhash")
def op6_simhash(spark, sf_dir):
    from parley.llm.simhash import hex_digits, near_duplicates
    return near_duplicates(documents(spark, sf_dir), SIMHASH_WORDS, SIMHASH_BITS).select(
        "doc_id", hex_digits("fp").alias("fingerprint"), "component_id")


# ----------------------------------------------------------------- toxicity
TOXIC_AT = 0.3


def held_out(doc_id: str = "doc_id"):
    """Rows that are never learned from: crc32 of the id as text, mod 4, is 2.
    A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def toxicity_grammar(spark: SparkSession, sf_dir: str):
    from parley.llm.toxicity import train
    labels = read(spark, sf_dir, "labels", "doc_id", "toxic").where(~held_out())
    return train(documents(spark, sf_dir), labels)


@register("op2_toxicity")
def op2_toxicity(spark, sf_dir):
    from parley.llm.toxicity import score_toxicity
    return score_toxicity(documents(spark, sf_dir), toxicity_grammar(spark, sf_dir)).select(
        "doc_id", held_out().alias("held_out"), "score",
        (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"))


# ------------------------------------------------------------------ vectors
ANN_NEAREST, ANN_QUERY_MOD = 20, 20


@register("op4_ann")
def op4_ann(spark, sf_dir):
    from parley.llm.ann import nearest
    vectors = read(spark, sf_dir, "embeddings", "vec_id", "embedding")
    queries = vectors.where(F.col("vec_id") % ANN_QUERY_MOD == 0).select(F.col("vec_id").alias("id"))
    return nearest(vectors, queries, ANN_NEAREST)


# -------------------------------------------------------------- suffix array
REPEAT_BYTES = 100


@register("op1_suffix_dedup")
def op1_suffix_dedup(spark, sf_dir):
    from parley.llm.suffix_dedup import remove_repeats
    return remove_repeats(documents(spark, sf_dir), REPEAT_BYTES)


TOP_K, TOP_QUERY_MOD, TOP_SCALE = 10, 100, 1024

TOP_SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({TOP_SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e
           FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % {TOP_QUERY_MOD} = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
             vec_id, score FROM s)
SELECT * FROM r WHERE rank <= {TOP_K}"""


@register("op10_topk", TOP_SQL)
def op10_topk(spark, sf_dir):
    from parley.llm.topk import top_k
    vectors = read(spark, sf_dir, "embeddings", "vec_id", "embedding")
    queries = vectors.where(F.col("vec_id") % TOP_QUERY_MOD == 0).select(F.col("vec_id").alias("id"))
    return top_k(vectors, queries, TOP_K, TOP_SCALE)


# ------------------------------------------------------------------ quality
@register("op11_quality")
def op11_quality(spark, sf_dir):
    from parley.llm.quality import quality_filter
    return quality_filter(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


# ----------------------------------------------------------------- spelling
SPELLING_FACTOR = 10


@register("op12_spelling")
def op12_spelling(spark, sf_dir):
    from parley.llm.spelling import spelling_forms, vocabulary
    return spelling_forms(vocabulary(documents(spark, sf_dir)), SPELLING_FACTOR)


# ---------------------------------------------------------------- whitening
@register("op13_whitening")
def op13_whitening(spark, sf_dir):
    from parley.llm.whitening import whiten
    return whiten(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))
