"""The registered queries of the numbered operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import chat, decontaminate, embedding_dedup, mixing, quality, substring_dedup, toxicity, wavelet, wrappers
from tessella.llm.minhash_dedup import near_duplicates
from tessella.llm.scratch import Scratch
from tessella.session import table

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    trap = "\\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", trap), (-7, 1, "assistant", trap)], "conv_id long, turn long, role string, text string")
    formatted = Scratch(spark, "chat").keep(chat.format_chats(rows.unionByName(more), tokenizer_path=tokenizer_path()), "formatted")
    return chat.digests(formatted)


def chat_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op3 that SQL can tell."""
    return op3_chat_formatting(spark, sf_dir).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_texts(table(spark, sf_dir, "pages"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op6_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Scratch(spark, 'tokens').path}/shards"
    wavelet.write_shards(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return wavelet.read_documents(wavelet.read_shards(spark, path))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    taken = F.col("__whole") * F.col("__size") + F.col("__extra")
    return planned.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), taken.alias("taken"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_html_extraction": op4_html_extraction,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_token_binary": op6_token_binary,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_source_mixing": op8_source_mixing,
    "op9_toxicity": op9_toxicity,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "chat_read_back": chat_read_back,
}

_REACH = """, reach(a, b) AS (SELECT id, id FROM nodes UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
component AS (SELECT a id, min(b) component_id FROM reach GROUP BY 1)"""

SQL: dict[str, str] = {
    "chat_read_back": r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') r, coalesce(text, '') t FROM conversations UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT CAST(conv_id AS BIGINT) conv_id, count(*) n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, t)) turns_sha256, CAST(coalesce(sum(length(t)) FILTER (r = 'assistant'), 0) AS BIGINT) loss_chars,
sha256(coalesce(string_agg(t, '' ORDER BY turn, r, t) FILTER (r = 'assistant'), '')) loss_sha256 FROM c GROUP BY 1""".replace("\\\\", "\\"),
    "op5_embedding_near_dedup": """WITH RECURSIVE v AS (SELECT vec_id id, CAST(embedding AS DOUBLE[]) e FROM embeddings), nodes AS (SELECT id FROM v),
pairs AS (SELECT a.id a, b.id b FROM v a JOIN v b ON a.id <> b.id AND list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.9)"""
    + _REACH
    + """ SELECT id vec_id, coalesce(n, 0) n_links, component_id, id = component_id kept FROM component LEFT JOIN (SELECT a, count(*) n FROM pairs GROUP BY 1) ON a = id""",
    "op8_source_mixing": r"""WITH s AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) size FROM documents),
g AS (SELECT source, CAST(sum(size) AS BIGINT) source_size FROM s GROUP BY 1),
w AS (SELECT source, source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END weight, 2.0::DOUBLE * source_size "stop", 1.5::DOUBLE * sum(source_size) OVER () budget FROM g),
l AS (SELECT *, "stop" / weight ratio, (budget - coalesce(sum("stop") OVER (ORDER BY "stop" / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY "stop" / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) level FROM w),
t AS (SELECT source, source_size, CASE WHEN ratio <= level THEN "stop" ELSE least("stop", weight * (SELECT arg_min(level, ratio) FROM l WHERE ratio > level)) END target FROM l),
r AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END whole FROM t),
d AS (SELECT s.doc_id, size, source_size, target, whole, CAST(floor(target - whole * source_size) AS BIGINT) rest, CAST(coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) earlier
FROM s JOIN r ON s.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, whole * size + least(size, greatest(0, rest - earlier)) taken FROM d""",
    "op10_minhash_near_dedup": r"""WITH RECURSIVE w AS (SELECT doc_id id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w FROM documents),
nodes AS (SELECT id FROM w), k AS (SELECT DISTINCT id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] END) k FROM w),
n AS (SELECT id, count(*) n FROM k GROUP BY 1), c AS (SELECT x.id a, y.id b, count(*) c FROM k x JOIN k y ON x.k = y.k AND x.id < y.id GROUP BY 1, 2),
half AS (SELECT a, b FROM c JOIN n p ON p.id = a JOIN n q ON q.id = b WHERE 100 * c >= 75 * (p.n + q.n - c)), pairs AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half)"""
    + _REACH
    + """ SELECT component.id doc_id, coalesce(n, 0) n_shingles, component_id, component.id = component_id kept FROM component LEFT JOIN n ON n.id = component.id""",
}
