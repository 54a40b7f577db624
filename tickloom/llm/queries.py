"""One registered query per operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import (
    alignment,
    ann,
    class_model,
    labelled,
    mixing,
    packing,
    pii,
    piece_codec,
    quality_rules,
    ranking,
    repeats,
    simhash,
    token_counts,
    whitening,
)
from tickloom.session import materialise


def tokenizer(name: str) -> str:
    """Place of a public tokenizer's file on this machine; pass another path to the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), capacity=1024, end_id=2)


def op2_class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return class_model.class_scores(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 2)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = quality_rules.judge(docs, quality_rules.train(docs, labels))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select(*columns, "probability")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"), words=20, with_text=False)
    return found.select(
        "doc_id",
        F.col("tl_n_words").alias("n_words"),
        F.col("tl_n_removed").alias("n_removed"),
        F.sha2("tl_kept", 256).alias("kept_sha256"),
    )


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(documents(spark, sf_dir)).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans"
    )


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = materialise(ranking.feature_rows(docs), "features")
    scores = rows.select("doc_id", ranking.score_of(ranking.fit_all(rows, labels, cut=0.3)).alias("score"))
    return scores.select("doc_id", labelled.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id % 50 = 0", k=5)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_components(documents(spark, sf_dir), words=4, bits=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("l0"), 16, "0")).alias("fingerprint"), "component_id")


def op10_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = piece_codec.encode_texts(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"))
    return encoded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op11_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(documents(spark, sf_dir), weights=(5, 2, 1), share=(3, 2), most=2)
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_counts(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), components=16)


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_class_scores": op2_class_scores,
    "op3_token_counts": op3_token_counts,
    "op4_quality_rules": op4_quality_rules,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_pii": op6_pii,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_simhash": op9_simhash,
    "op10_piece_codec": op10_piece_codec,
    "op11_source_mixing": op11_source_mixing,
    "op12_cross_tokenizer_alignment": op12_cross_tokenizer_alignment,
    "op13_embedding_whitening": op13_embedding_whitening,
}

ORACLES = {
    "op5_substring_dedup": r"""
        WITH d AS (
            SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
            FROM documents
        ), w AS (SELECT doc_id, words, unnest(generate_series(1, len(words))) AS place FROM d WHERE len(words) > 0),
        keyed AS (
            SELECT doc_id, place, words[place] AS word,
                CASE WHEN place + 19 <= len(words) THEN array_to_string(words[place:place + 19], ' ') END AS key FROM w
        ), marked AS (
            SELECT *, CASE WHEN key IS NOT NULL AND row_number() OVER (PARTITION BY key ORDER BY doc_id, place) > 1
                THEN place END AS again FROM keyed
        ), covered AS (
            SELECT *, max(again) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) IS NOT NULL
                AS gone FROM marked
        ), g AS (
            SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY place) FILTER (NOT gone) AS kept
            FROM covered GROUP BY 1
        )
        SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, coalesce(g.n_removed, 0) AS n_removed,
            sha256(coalesce(g.kept, '')) AS kept_sha256
        FROM d LEFT JOIN g USING (doc_id)
    """,
    "op8_nearest_neighbours": """
        WITH v AS (
            SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND q.vec_id % 50 = 0
        )
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score
        FROM scored QUALIFY rank <= 5
    """,
    "op11_source_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
            FROM documents
        ), s AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS words,
                [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
            FROM d GROUP BY source
        ), prefix AS (
            -- sources by the level at which they stop; the level is highest where the right ones have stopped
            SELECT *, sum(words) OVER w AS stopped, sum(weight) OVER w AS heavy, sum(words) OVER () AS total, sum(weight) OVER () AS weights
            FROM s WINDOW w AS (ORDER BY words / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)
        ), level AS (
            SELECT max(CASE WHEN weights - heavy > 0 THEN (3 * total - 4 * stopped) / (2 * (weights - heavy)) END) AS after,
                max(3 * total / (2 * weights)) AS first
            FROM prefix
        ), t AS (
            SELECT source, words, least(CAST(2 * words AS DOUBLE), weight * greatest(after, first)) AS target FROM s, level
        ), r AS (SELECT *, coalesce(target / nullif(words, 0), 0) AS rate FROM t),
        drawn AS (
            SELECT d.*, r.words, r.target, r.rate, k AS seed, floor(r.rate) + CASE WHEN
                CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || (k // 4)), CAST((k % 4) * 8 + 1 AS INT), 8) AS BIGINT)
                    / 4294967296.0 < r.rate - floor(r.rate) THEN 1 ELSE 0 END AS copies
            FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source, range(64) g(k)
        ), tried AS (
            SELECT source, seed FROM drawn GROUP BY source, seed
            QUALIFY row_number() OVER (PARTITION BY source ORDER BY abs(sum(size * copies) - any_value(target)), seed) = 1
        )
        SELECT doc_id, size, words AS source_size, target, CAST(size * copies AS BIGINT) AS taken
        FROM drawn JOIN tried ON drawn.source IS NOT DISTINCT FROM tried.source AND drawn.seed = tried.seed
    """,
}
