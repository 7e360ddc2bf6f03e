"""The registered query of each operator, over whole tables, and its SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.registry import prepare
from feedloom.llm.bpe import Vocabulary, round_trip
from feedloom.llm.chat import CLOSE, OPEN, digest, events_of, format_conversations
from feedloom.llm.codes import ENTRIES, PARTS, ROUNDS, SCALE, compress
from feedloom.llm.exact import exact_duplicates
from feedloom.llm.language import identify_languages
from feedloom.llm.minhash import near_duplicates
from feedloom.llm.mixing import mix_rows
from feedloom.llm.pii import replace_entities
from feedloom.llm.quality import quality
from feedloom.llm.subwords import classify_quality
from feedloom.llm.toxicity import toxicity
from feedloom.llm.urls import filter_urls
from feedloom.llm.whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return build(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> Vocabulary:
    """One of the public vocabularies that the installed package of that name describes."""
    import public_tokenizers

    return Vocabulary.read(public_tokenizers.path(name), public_tokenizers.PATTERN)


@query("op1_minhash_near_dedup", rf"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN [array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)]
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM texts
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)
), reached AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
), component AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY 1
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN component USING (doc_id) LEFT JOIN sizes USING (doc_id)
""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4)


@query("op2_exact_dedup", f"""
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, {LOWER} AS t FROM documents) x
""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


@query("op3_byte_bpe")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), vocabulary()).drop("tokens")


_ESCAPED = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;')"


@query("op4_chat_format", f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum({len(OPEN) + len(CLOSE) + 1} + length(replace({_ESCAPED.format("role")}, chr(10), '&#10;')) + length({_ESCAPED.format("text")})) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], rows.schema)
    return digest(format_conversations(events_of(rows.unionByName(extra))))


#: Which sites are accepted or rejected outright.
URL_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


@query("op5_url_filter")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES).drop("ratio", "probability")


@query("op6_source_mixing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_rows(table(spark, sf_dir, "documents")).select("doc_id", "source", "mix_epoch", "mix_block", "mix_tokens")


@query("op7_language_id")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


@query("op8_pii_surrogates")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = replace_entities(table(spark, sf_dir, "documents"), key="feedloom")
    return done.select("doc_id", F.size("entities").cast("long").alias("n_entities"), "text", "entities")


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_quality_rules")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


@query("op11_embedding_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


@query("op12_quality_classifier")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _codes_sql() -> str:
    """Every round as a pair of tables: the nearest entry of each part, and the entries moved to their parts' means."""
    nearest = """
), near{k} AS MATERIALIZED (
  SELECT r, p, arg_min(e, d * {entries} + e) AS e, min(d) AS d
  FROM (SELECT a.r, a.p, c.e, sum((a.x - c.x) * (a.x - c.x))::HUGEINT AS d FROM cells a JOIN book{k} c ON a.p = c.p AND a.i = c.i GROUP BY 1, 2, 3) t GROUP BY 1, 2"""
    moved = """
), book{n} AS MATERIALIZED (
  SELECT b.p, b.e, b.i, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN (
    SELECT n.p, n.e, a.i, ((sum(a.x) - ((sum(a.x) % count(*)) + count(*)) % count(*)) // count(*))::HUGEINT AS x
    FROM near{k} n JOIN cells a ON a.r = n.r AND a.p = n.p GROUP BY 1, 2, 3) m ON m.p = b.p AND m.e = b.e AND m.i = b.i"""
    rounds = "".join(nearest.format(k=k, entries=ENTRIES) + moved.format(k=k, n=k + 1) for k in range(ROUNDS)) + nearest.format(k=ROUNDS, entries=ENTRIES)
    return f"""
WITH used AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda c: CAST(floor({SCALE} * CAST(c AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), cells AS MATERIALIZED (
  SELECT r, j // (len(v) // {PARTS}) AS p, j % (len(v) // {PARTS}) AS i, v[j + 1]::HUGEINT AS x FROM (SELECT r, v, unnest(range(len(v))) AS j FROM used) t
), book0 AS MATERIALIZED (
  SELECT p, r - 1 AS e, i, x FROM cells WHERE r <= {ENTRIES}{rounds}
), digest AS (
  SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM book{ROUNDS}
), coded AS (
  SELECT r, string_agg(printf('%02x', CAST(e AS INT)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY 1
)
SELECT vec_id, label, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM used JOIN coded USING (r) CROSS JOIN digest
"""


@query("op13_vector_codes", _codes_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))
