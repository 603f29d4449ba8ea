"""One registered query for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenframe.llm import bpe, collocations, exact_dedup, language_id, line_dedup, media, minhash, packing, quality, substring_dedup, token_counts, toxicity, whitening
from lumenframe.llm.common import read_documents
from lumenframe.session import ship

Query = Callable[[SparkSession, str], DataFrame]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_classes(read_documents(spark, sf_dir))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_documents(spark, sf_dir))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_documents(spark, sf_dir)).drop("k1", "k2")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.load_media(media.store_media(read_documents(spark, sf_dir)), with_media=False)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_spans(read_documents(spark, sf_dir)).drop("text_key")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_documents(spark, sf_dir))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(read_documents(spark, sf_dir))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read_documents(spark, sf_dir))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(read_documents(spark, sf_dir))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitening(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_documents(spark, sf_dir))


def queries() -> dict[str, Query]:
    found = (
        op1_line_dedup, op2_token_counts, op3_minhash_near_dedup, op4_quality_classifier, op5_media_columns,
        op6_substring_dedup, op7_packing, op8_bpe, op9_exact_dedup, op10_language_id,
        op11_toxicity, op12_whitening, op13_collocations,
    )

    def shipped(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        return run

    return {f.__name__: shipped(f) for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


#: The operators here that SQL expresses.
ORACLES = {
    "op13_collocations": r"""
        WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM t),
        s AS (SELECT lang, k, list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' ')) AS p FROM w, range(1, 5) AS r(k) WHERE len(w) >= k),
        c AS (SELECT lang, k, phrase, count(*) AS f FROM (SELECT lang, k, unnest(p) AS phrase FROM s) GROUP BY ALL),
        n AS (SELECT lang, sum(f)::BIGINT AS n FROM c WHERE k = 1 GROUP BY lang),
        d AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM c WHERE k > 1 AND f >= 30),
        x AS (SELECT d.lang, phrase, a, j, array_to_string(w[:j], ' ') AS head, array_to_string(w[j + 1:], ' ') AS tail FROM d, range(1, 4) AS r(j) WHERE j < k),
        y AS (SELECT x.lang, x.phrase, x.a, j, h.f AS l, t.f AS r, (2000000::HUGEINT * x.a // (h.f::HUGEINT + t.f))::BIGINT AS score
            FROM x JOIN c h ON h.lang = x.lang AND h.phrase = head JOIN c t ON t.lang = x.lang AND t.phrase = tail),
        z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
        g AS (SELECT lang, unnest([array_to_string(w[:k - 1], ' '), array_to_string(w[2:], ' ')]) AS phrase, a AS f FROM d WHERE k > 2),
        m AS (SELECT lang, phrase, max(f) AS f FROM g GROUP BY ALL),
        o AS (SELECT z.* FROM z LEFT JOIN m ON m.lang = z.lang AND m.phrase = z.phrase WHERE m.f IS NULL OR 100::HUGEINT * m.f < 80::HUGEINT * z.a)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang)
        QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) <= 2000
    """,
    "op9_exact_dedup": r"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)
    """,
}
