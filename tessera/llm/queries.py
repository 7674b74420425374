"""The training-data queries, by the names the driver knows, and the SQL that some can be checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, jaccard_join, line_dedup, packing, pairwise_quality, quality_rules, records, token_counts, toxicity
from .common import table, work_path

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "records")
    records.write_records(table(spark, sf_dir, "documents"), path, tokenizer("word_bpe_49k.json"), end_id=2)
    return records.read_records(spark, path)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=0, capacity=2048)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicate(table(spark, sf_dir, "documents"), min_chars=1).select("doc_id", "n_lines", "n_removed", "text")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairwise_quality.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.over_limit(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), limit=1024)


PROBE = "</s>[INST] ok [/INST]"


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    formatted = chat.render(chat.fold(chat.events_of(rows.unionByName(probe))))
    return chat.digests(chat.parse(formatted))


QUERIES: dict[str, Query] = {q.__name__: q for q in (op1_token_records, op2_best_fit_packing, op3_toxicity, op4_quality_rules, op5_ngram_jaccard_join, op6_line_dedup, op7_benchmark_decontamination, op8_quality_classifier, op9_token_counts, op10_chat_formatting)}


def _escaped(x: str) -> str:
    x = f"replace({x}, '\\', '\\\\')"
    for c in chat.CONTROL:
        x = f"replace({x}, '{c}', '{c[0]}\\{c[1:]}')"
    return x


ORACLE_SQL: dict[str, str] = {
    "op10_chat_formatting": f"""
        WITH t AS (
            SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'
        ), s AS (
            SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS spoken,
                coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
                sum(length({_escaped("role")}) + length({_escaped("text")}) + {len(chat.OPEN + chat.BODY + chat.CLOSE)}) AS chars
            FROM t GROUP BY conv_id
        )
        SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(spoken) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM s
    """,
}
