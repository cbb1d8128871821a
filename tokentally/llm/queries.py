"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tokentally.llm.shared import table


#: Exact search; larger factors prune more.
ANN_FACTOR = 1.0
#: The queries' key.  Whoever runs the operator on real data passes a secret of their own.
PII_KEY = b"key of the registered queries"


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_vp_tree_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokentally.llm.vptree import nearest

    return nearest(table(spark, sf_dir, "embeddings"), every=100, k=10, factor=ANN_FACTOR)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokentally.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), 2048, 0)


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokentally.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokentally.llm.pii import pseudonyms

    return pseudonyms(table(spark, sf_dir, "documents"), PII_KEY)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokentally.llm.binpack import token_files

    return token_files(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), 2)


def op3_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokentally.llm.toolcalls import tool_calls_query

    return tool_calls_query(spark, sf_dir)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokentally.llm.toxicity import toxicity_scores

    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokentally.llm.decontam import find_items

    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokentally.llm.ppm import language_model_scores

    return language_model_scores(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokentally.llm.quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokentally.llm.divergence import source_divergence

    return source_divergence(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokentally.llm.spelling import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokentally.llm.urlfilter import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_vp_tree_neighbours, op2_best_fit_packing, op3_tool_calls, op4_toxicity, op5_decontamination, op6_language_model, op7_quality, op8_minhash_dedup, op9_pii_pseudonyms, op10_token_files, op11_source_divergence, op12_spelling_variants, op13_url_filter, pipeline)}


def oracle_sql() -> dict[str, str]:
    from tokentally.llm.divergence import SQL as DIVERGENCE_SQL
    from tokentally.llm.toolcalls import SQL

    return {"op11_source_divergence": DIVERGENCE_SQL, "op1_vp_tree_neighbours": OP1_SQL, "op3_tool_calls": SQL, "op8_minhash_dedup": OP8_SQL}


_VALID = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
OP1_SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE vec_id IS NOT NULL AND {_VALID}),
d AS (SELECT q.vec_id AS query_id, v.vec_id AS vec_id, sqrt(list_reduce(list_transform(list_zip(q.e, v.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda x, y: x + y)) AS score FROM v AS q JOIN v ON v.vec_id <> q.vec_id AND len(v.e) = len(q.e) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank FROM d)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS h FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN n AS x ON x.doc_id = p.a JOIN n AS y ON y.doc_id = p.b WHERE 100 * p.c >= 75 * (x.n + y.n - p.c)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS d, doc_id AS m FROM documents UNION SELECT u.a, r.m FROM r JOIN u ON u.b = r.d)
SELECT r.d AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.m) AS component_id, r.d = min(r.m) AS kept FROM r LEFT JOIN n ON n.doc_id = r.d GROUP BY r.d
"""
