"""One query per operator, with production parameters over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import (
    capacity_packing,
    compression_bands,
    cross_parsing,
    deleted_interpolation,
    importance_sampling,
    lsh_forest,
    norm_buckets,
    phrase_mining,
    pii_boost,
    quality_trees,
    quote_linking,
    rank_queue_bpe,
    token_cache,
)
from logloom.llm.common import read_table, remainder
from logloom.sources.scratch import scratch_path

VOCABULARY = "byte_bpe_50k.tiktoken"
COUNTED = "word_bpe_49k.json"


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", "text")


def word_tokens(text: str = "text") -> Column:
    """Words and one end token."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)) + 1


def op1_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    return compression_bands.compression_bands(docs, compression_bands.learn(docs)).drop("text")


def op2_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = cross_parsing.learn(docs, remainder("doc_id", 4) != 2)
    found = cross_parsing.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op3_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return norm_buckets.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_pii_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_boost.find(texts(spark, sf_dir))

    def number(kind: int) -> Column:
        return F.size(F.filter("pii_base", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *[number(i).alias(f"n_{name}") for i, name in enumerate(pii_boost.KINDS)],
        F.sha2(pii_boost.listed(F.col("pii_base")), 256).alias("base_sha256"),
        pii_boost.listed(F.col("pii_spans")).alias("spans"),
    )


def op5_capacity_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capacity_packing.best_fit(texts(spark, sf_dir), word_tokens())


def op6_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quote_linking.link(read_table(spark, sf_dir, "conversations"))


def op7_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deleted_interpolation.score(texts(spark, sf_dir))


def op8_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = texts(spark, sf_dir), read_table(spark, sf_dir, "labels")
    model = quality_trees.learn(docs, labels, remainder("doc_id", 3) != 1)
    found = quality_trees.classify(docs, model)
    return found.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op9_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.near_duplicates(texts(spark, sf_dir), lsh_forest.Forest(shingle=2))


def op10_rank_queue_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    return rank_queue_bpe.encode_digests(texts(spark, sf_dir), path, public_tokenizers.PATTERN).drop("text")


def op11_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_mining.collocations(read_table(spark, sf_dir, "documents").select("lang", "text"))


def op12_digest_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts with an empty cache, so the figures are those of the whole work."""
    vocabulary = token_cache.Vocabulary.read(public_tokenizers.path(COUNTED))
    return token_cache.count_tokens(texts(spark, sf_dir), vocabulary, scratch_path(spark, "token-cache"))


def op13_regular_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_sampling.resample(texts(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_compression_bands,
        op2_cross_parsing,
        op3_norm_buckets,
        op4_pii_boost,
        op5_capacity_packing,
        op6_quote_linking,
        op7_deleted_interpolation,
        op8_quality_trees,
        op9_lsh_forest,
        op10_rank_queue_bpe,
        op11_fm_index,
        op12_digest_cache,
        op13_regular_sampling,
    )
}

ORACLES = {
    "op3_norm_buckets": """
        WITH e AS (
            SELECT vec_id,
                   list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
            FROM e q JOIN e c ON q.vec_id <> c.vec_id
            WHERE q.vec_id % 50 = 0
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM scored
        )
        SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM ranked WHERE place <= 5
    """,
    "op11_fm_index": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang,
                   unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                       'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents
        ), cut AS (
            SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces
        ), grams AS (
            SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2),
                       lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
            FROM cut, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k
        ), f AS (
            SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30
        ), sizes AS (SELECT lang, sum(len(w)) AS n FROM cut GROUP BY lang
        ), longer AS (
            SELECT lang, f, string_split(phrase, ' ') AS w, k, unnest(range(2, k)) AS size FROM f WHERE k > 2
        ), inside AS (
            SELECT lang, f, unnest(list_transform(range(1, k - size + 2),
                       lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase
            FROM longer
        ), covered AS (SELECT lang, phrase, max(f) AS most FROM inside GROUP BY ALL
        ), cuts AS (
            SELECT lang, phrase, f AS a, j, array_to_string(w[1:j], ' ') AS first, array_to_string(w[j + 1:], ' ') AS rest
            FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS j FROM f WHERE k > 1)
        ), scored AS (
            SELECT c.lang, c.phrase, a, j, x.f AS l, y.f AS r, CAST(2000000 AS HUGEINT) * a // (x.f + y.f) AS score
            FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.first
            JOIN f y ON y.lang = c.lang AND y.phrase = c.rest
        ), lowest AS (
            SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
        ), ranked AS (
            SELECT lang, phrase, a, l, r, n, score,
                   row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
            FROM lowest LEFT JOIN covered USING (lang, phrase) JOIN sizes USING (lang)
            WHERE most IS NULL OR 100 * most < 80 * a
        )
        SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
        FROM ranked WHERE rank <= 2000
    """,
    "op13_regular_sampling": r"""
        WITH steps AS (
            SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
                        lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY n) AS t
            FROM (SELECT CAST(range AS BIGINT) AS n FROM range(256))
        ), doc_words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
            FROM documents
        ), target_words AS (
            SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
            FROM benchmark
        ), features AS (SELECT doc_id, unnest(words) AS word FROM doc_words
        ), distinct_words AS (SELECT word FROM features UNION SELECT word FROM target_words
        ), hashed AS (
            SELECT word, xor(4294967295, list_reduce(
                list_prepend(4294967295, list_transform(range(length(hex(word)) // 2),
                    lambda i: CAST(16 * (instr('0123456789ABCDEF', substr(hex(word), 2 * i + 1, 1)) - 1)
                        + instr('0123456789ABCDEF', substr(hex(word), 2 * i + 2, 1)) - 1 AS BIGINT))),
                lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1]))) % 10000 AS bucket
            FROM distinct_words, steps
        ), corpus AS (SELECT bucket, count(*) AS n FROM features JOIN hashed USING (word) GROUP BY bucket
        ), target AS (SELECT bucket, count(*) AS n FROM target_words JOIN hashed USING (word) GROUP BY bucket
        ), gains AS (
            SELECT bucket, CAST(floor(1000 * ln(
                CAST(coalesce(t.n, 0) + 1 AS DOUBLE) * CAST((SELECT count(*) FROM features) + 10000 AS DOUBLE)
                / (CAST(coalesce(s.n, 0) + 1 AS DOUBLE) * CAST((SELECT count(*) FROM target_words) + 10000 AS DOUBLE))
                )) AS BIGINT) AS gain
            FROM corpus s FULL JOIN target t USING (bucket)
        ), weighed AS (
            SELECT doc_id, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight
            FROM features JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY doc_id
        ), scored AS (
            SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
                   coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score
            FROM (SELECT *, CAST(CAST('0x' || sha256('2024:' || doc_id)[1:8] AS BIGINT) AS DOUBLE) AS h FROM doc_words) d
            LEFT JOIN weighed w ON w.doc_id = d.doc_id
        ), ranked AS (
            SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n
            FROM scored WHERE n_features >= 20
        )
        SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank
        FROM scored LEFT JOIN ranked USING (doc_id)
    """,
}
