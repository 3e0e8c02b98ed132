"""The ten operators as queries over the standard tables, with production parameters.

All take tables without rows, which give none, and tables with more columns of any names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantavol.llm import ann, katz, language, mixing, neardup, packing, phrases, quality, sharding, warc


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path(name: str = packing.TOKENIZER) -> str:
    """The place of a public vocabulary file; it is never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of those outside fold 1 of 5; null texts are empty, rows that repeat are scored each."""
    docs = read(spark, sf_dir, "documents")
    return katz.score_documents(spark, docs, language.held_out(docs, 5))


def op2_histogram_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens; null texts are the end id alone, rows that repeat are packed each."""
    return packing.pack_documents(spark, read(spark, sf_dir, "documents"), tokenizer_path())


def op3_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of all documents, by a list learned from labels; null texts have no words and fail the base rules."""
    return quality.judge(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))[0]


def op4_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 7 of all documents by doc_id, and with a ninth; null texts have size 1, rows that repeat get slots of their own."""
    return sharding.place_documents(spark, read(spark, sf_dir, "documents"), 8)


def op5_rank_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents by profiles of those outside fold 1 of 3; `und` for null texts and texts without a letter."""
    return language.identify(spark, read(spark, sf_dir, "documents"))


def op6_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all pages, written to packages and read back; null html is an empty payload, rows that repeat are stored each."""
    return warc.archive_pages(spark, read(spark, sf_dir, "pages"))


def op7_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked at 85 % of shingles; texts without a word have no link, null ids are kept and take no part."""
    return neardup.near_duplicates(spark, read(spark, sf_dir, "documents"), 85)


def op8_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 nearest found of each vec_id divisible by 20, of all others; rows without a usable vector take no part, ties go to smaller ids."""
    return ann.search_embeddings(spark, read(spark, sf_dir, "embeddings"))


def op9_flow_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document, sources weighing 5, 2, 1 in turn; null texts have none, null sources are one, the last."""
    return mixing.mix_documents(spark, read(spark, sf_dir, "documents"))


def op10_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without windows of 20 words that start earlier; null texts are empty, null ids come last, rows that repeat stand at one place."""
    out = phrases.remove_repeats(spark, read(spark, sf_dir, "documents"), 20, joined=True)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_katz_scores, op2_histogram_packing, op3_decision_list, op4_jump_shards, op5_rank_profiles, op6_zip_warc, op7_lsh_forest, op8_prefix_forest, op9_flow_mix, op10_phrase_automata)}


WORDS_SQL = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"

OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS n, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS f FROM p)
SELECT page_id, n AS payload_bytes,
 array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  CAST(((instr('0123456789abcdef', substr(x, 5*k//4+1, 1))-1)*16 + instr('0123456789abcdef', substr(x, 5*k//4+2, 1))-1) // ([8,4,2,1])[5*k%4+1] % 32 + 1 AS BIGINT), 1)), '') AS payload_digest,
 CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to FROM d"""

OP7_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS_SQL.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS l FROM documents),
g AS (SELECT doc_id, unnest(CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 5 THEN [array_to_string(l, ' ')]
 ELSE list_transform(range(len(l)-4), lambda i: array_to_string(l[i+1:i+5], ' ')) END) AS g FROM w),
s AS (SELECT DISTINCT doc_id, g FROM g), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100*c >= 85*(x.n+y.n-c)),
sides AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS d, doc_id AS r FROM documents UNION SELECT sides.b, reach.r FROM reach JOIN sides ON sides.a = reach.d),
comp AS (SELECT d, min(r) AS component_id FROM reach GROUP BY d)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN comp ON comp.d = w.doc_id"""

OP10_SQL = f"""
WITH w AS (SELECT doc_id, {WORDS_SQL.format("coalesce(text, '')")} AS l FROM documents),
t AS (SELECT doc_id, unnest(range(len(l))) AS p, unnest(l) AS word FROM w),
win AS (SELECT doc_id, p, array_to_string(l[p+1:p+20], ' ') AS g FROM (SELECT doc_id, l, unnest(range(greatest(len(l)-19, 0))) AS p FROM w)),
later AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS k FROM win) WHERE k > 1),
m AS (SELECT t.doc_id, t.p, word, coalesce(max(CASE WHEN later.p IS NOT NULL THEN 1 END) OVER (PARTITION BY t.doc_id ORDER BY t.p ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) AS gone
 FROM t LEFT JOIN later ON later.doc_id = t.doc_id AND later.p = t.p),
k AS (SELECT doc_id, count(*) AS n_words, CAST(sum(gone) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (gone = 0) AS kept FROM m GROUP BY doc_id)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    """The operators that DuckDB can express; the others are tested against brute force: 1 (a model),
    2 (a tokenizer), 3 and 5 (learned), 4 (crc32), 8 (approximate), 9 (an order by md5 and real targets)."""
    return {"op6_zip_warc": OP6_SQL, "op7_lsh_forest": OP7_SQL, "op10_phrase_automata": OP10_SQL}
