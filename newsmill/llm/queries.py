"""One query per training-data operator over the given tables."""

import public_tokenizers

from newsmill.llm.conversation_repair import conversation_repair
from newsmill.llm.fingerprints import fingerprints
from newsmill.llm.html_text import main_text
from newsmill.llm.mixing import mix_report
from newsmill.llm.near_dedup import near_dedup
from newsmill.llm.packing import best_fit_packing
from newsmill.llm.ranked_search import ranked_search
from newsmill.llm.simhash_dedup import simhash_dedup
from newsmill.llm.substring_dedup import substring_dedup
from newsmill.llm.suffix_dedup import suffix_dedup
from newsmill.llm.token_files import token_files
from newsmill.llm.topk_search import topk_search
from newsmill.llm.toxicity import score_toxicity

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def over(table, operator, **options):
    return lambda spark, sf_dir: operator(spark.read.parquet(f"{sf_dir}/{table}.parquet"), **options)


def toxicity(spark, sf_dir):
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return score_toxicity(read("documents"), read("labels"))


def search(spark, sf_dir):
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return ranked_search(read("documents"), read("benchmark"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_suffix_array_dedup": over("documents", suffix_dedup),
    "op2_best_fit_packing": over("documents", best_fit_packing, tokenizer=TOKENIZER),
    "op3_token_files": over("documents", token_files, tokenizer=TOKENIZER),
    "op4_html_extraction": over("pages", main_text),
    "op5_topk_search": over("embeddings", topk_search),
    "op6_substring_dedup": over("documents", substring_dedup),
    "op7_source_mixing": over("documents", mix_report),
    "op8_toxicity": toxicity,
    "op9_near_dedup": over("documents", near_dedup),
    "op10_fingerprints": over("documents", fingerprints),
    "op11_simhash_dedup": over("documents", simhash_dedup),
    "op12_ranked_search": search,
    "op13_conversation_repair": over("conversations", conversation_repair),
    "pipeline": pipeline,
}

# brute force; the other operators are tested against brute force in tests/llm
ORACLES = {
    "op12_ranked_search": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
        ), sizes AS (
            SELECT doc_id, CAST(len(t) AS BIGINT) AS n FROM d WHERE len(t) > 0
        ), total AS (
            SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM sizes
        ), counts AS (
            SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d) GROUP BY ALL
        ), asked AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
        ), weights AS (
            SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
            FROM counts, total GROUP BY term, n_docs
        ), scores AS (
            SELECT item_id, doc_id,
                CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
            FROM asked JOIN weights USING (term) JOIN counts USING (term) JOIN sizes USING (doc_id), total
            GROUP BY item_id, doc_id
        )
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
        FROM scores WHERE score > 0 QUALIFY rank <= 10
    """,
    "op5_topk_search": """
        WITH v AS (
            SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                CAST(list_sum([q.e[i] * c.e[i] FOR i IN range(1, len(q.e) + 1)]) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
    """,
}
