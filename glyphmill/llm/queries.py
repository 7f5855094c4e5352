"""The queries of this subpackage, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import chat, cover_tree, digests, language, mixing, near_copies, packing, periodic_runs, personal_data, repeats, spelling, toxicity, url_rules
from glyphmill.llm.common import table


def op1_cover_tree_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.link(table(spark, sf_dir, "embeddings"))


OP1_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
n AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v),
ok AS (SELECT * FROM n WHERE label IS NOT NULL AND norm > 0 AND isfinite(norm)),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
    WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
r(id, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT p.b, r.c FROM r JOIN p ON r.id = p.a),
m AS (SELECT id, min(c) AS component_id FROM r GROUP BY id),
k AS (SELECT a, count(*) AS n_links FROM p GROUP BY a)
SELECT v.vec_id, CAST(coalesce(k.n_links, 0) AS BIGINT) AS n_links, m.component_id, v.vec_id = m.component_id AS kept
FROM v JOIN m ON v.vec_id = m.id LEFT JOIN k ON v.vec_id = k.a
"""


def op2_canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests.fingerprints(table(spark, sf_dir, "documents"))


def op3_reply_tree_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "\\### Assistant: </turn> ok"
    rows = rows.union(spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], rows.schema))
    read = chat.read_back(chat.format_paths(chat.best_paths(chat.linear(rows))))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("learned", "")
    return read.select(
        F.col("thread").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP3_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS rn,
    length(replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\t')) AS n_text,
    length(replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\t'), ':', '\c')) AS n_role FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256,
    CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY rn), '')) AS loss_sha256,
    CAST(sum(4 + n_role + 2 + n_text + 9) AS BIGINT) AS formatted_chars
FROM o GROUP BY conv_id
"""


def op4_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.find(table(spark, sf_dir, "documents"))


def op5_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op6_icws_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")


def op7_deep_shallow_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op8_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return mixed.select(F.col("row.doc_id").alias("doc_id"), "source", "block", "slot", "release", "deadline", "start")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), url_rules.rule_table(spark))


OP10_SQL = r"""
WITH rules(rhost, rpath, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'),
    ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
best AS (SELECT p.*, (SELECT max_by(rhost || rpath || ' ' || verdict, length(rhost || rpath)) FROM rules
    WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS hit FROM p)
SELECT page_id, host, path, split_part(hit, ' ', 1) AS rule, coalesce(split_part(hit, ' ', 2), 'allow') AS verdict
FROM best
"""


def op11_clause_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("clauses")


def op12_errata_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), spoil=True)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.find_runs(periodic_runs.with_made_runs(table(spark, sf_dir, "documents"))))


QUERIES = {
    "op1_cover_tree_links": op1_cover_tree_links,
    "op2_canonical_digest": op2_canonical_digest,
    "op3_reply_tree_chat": op3_reply_tree_chat,
    "op4_bootstrapped_pii": op4_bootstrapped_pii,
    "op5_language_mixture": op5_language_mixture,
    "op6_icws_near_copies": op6_icws_near_copies,
    "op7_deep_shallow_repeats": op7_deep_shallow_repeats,
    "op8_pfair_mixing": op8_pfair_mixing,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_url_rules": op10_url_rules,
    "op11_clause_toxicity": op11_clause_toxicity,
    "op12_errata_spelling": op12_errata_spelling,
    "op13_periodic_runs": op13_periodic_runs,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {"op1_cover_tree_links": OP1_SQL, "op3_reply_tree_chat": OP3_SQL, "op10_url_rules": OP10_SQL}
