"""Queries of the training-data operators, and the SQL each must agree with where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from turnmill.llm import alignment, bpe, covering, crf, divergence, linewindows, mixing, permutation, quotient, surrogates, urlrules, vafile, xent
from turnmill.llm.arrays import small_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The setting that holds the key of surrogates; whoever runs the query on real texts sets it.
SURROGATE_KEY = "spark.turnmill.surrogateKey"


def query(name: str, sql: str | None = None):
    def add(run):
        def prepared(spark, folder):
            small_batches(spark)
            return run(spark, folder)

        QUERIES[name] = prepared
        if sql is not None:
            SQL[name] = sql
        return run

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_bpe")
def op1(spark, folder):
    return tokenized(table(spark, folder, "documents"))


def tokenized(docs: DataFrame) -> DataFrame:
    """Digests of the ids and of the bytes decoded from them, one row per document."""
    ranks = bpe.read_ranks(public_tokenizers.path(VOCABULARY))
    done = docs.select("doc_id", bpe.round_trip(docs, ranks, public_tokenizers.PATTERN).alias("t"))
    return done.select("doc_id", "t.n_tokens", "t.ids_sha256", "t.decoded_sha256")


@query("op2_mixing")
def op2(spark, folder):
    sizes, targets, blocks = mixing.mix(table(spark, folder, "documents"))
    return mixing.documents_taken(sizes, targets, blocks).withColumnRenamed("id", "doc_id")


EXACT_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
), g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g USING (norm)
"""


@query("op3_exact_dedup", EXACT_SQL)
def op3(spark, folder):
    return quotient.exact_duplicates(table(spark, folder, "documents"))


@query("op7_simhash")
def op7(spark, folder):
    found = covering.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op5_language_id")
def op5(spark, folder):
    docs = table(spark, folder, "documents")
    found = docs.select("doc_id", crf.held_out(F.col("doc_id")).alias("held_out"), crf.languages(docs, crf.learn(docs)).alias("l"))
    return found.select("doc_id", "held_out", "l.lang_pred", "l.score")


#: The rules of the contract, as host, path and verdict.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]

URL_SQL = """
WITH rules(r_host, r_path, r_verdict) AS (VALUES %s),
p AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
), fit AS (
  SELECT page_id, r_host || r_path AS rule, r_verdict,
    row_number() OVER (PARTITION BY page_id ORDER BY length(r_host || r_path) DESC, length(r_path) DESC) AS n
  FROM h JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
)
SELECT h.page_id, h.host, h.path, fit.rule, coalesce(fit.r_verdict, 'allow') AS verdict
FROM h LEFT JOIN fit ON fit.page_id = h.page_id AND fit.n = 1
""" % ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)


@query("op8_url_rules", URL_SQL)
def op8(spark, folder):
    rules = spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in RULES])))
    judged = urlrules.judge(table(spark, folder, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op9_line_windows")
def op9(spark, folder):
    clean = linewindows.remove_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return clean.select("doc_id", "lines", "removed", "text", F.sha2("text", 256).alias("text_sha256"))


@query("op10_surrogates")
def op10(spark, folder):
    key = spark.conf.get(SURROGATE_KEY, "a key for tables without real people")
    return surrogates.replace(table(spark, folder, "documents").select("doc_id", "text"), key.encode())


@query("op6_permutation_index")
def op6(spark, folder):
    return permutation.nearest(table(spark, folder, "embeddings"), F.col("id") % 50 == 0)


@query("op4_cross_entropy")
def op4(spark, folder):
    good = table(spark, folder, "labels").filter("quality = 1").select("doc_id")
    return xent.score(table(spark, folder, "documents"), good)


@query("op11_alignment")
def op11(spark, folder):
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as a, open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as b:
        return alignment.Alignment(table(spark, folder, "documents"), a.read(), b.read()).documents()


DIVERGENCE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), w AS (SELECT rid, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT rid) >= 10),
g AS (SELECT lang, source, coalesce(v, 0) AS v FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, count(*) AS v FROM kept GROUP BY lang) USING (lang)),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
totals AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(t.total, 0) + 2 * g.v) AS p
  FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
  LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source
), whole AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term),
q AS (
  SELECT w.lang, w.term, 1 + (1000000000::HUGEINT * (w.n + 2)) // (sum(w.n) OVER (PARTITION BY w.lang) + 2 * count(*) OVER (PARTITION BY w.lang)) AS q
  FROM whole w
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL
  SELECT p.lang, p.source, 'term', p.term, (p.p - q.q) * (p.p - q.q) // (p.p + q.q) FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


@query("op12_divergence", DIVERGENCE_SQL)
def op12(spark, folder):
    return divergence.Audit(table(spark, folder, "documents")).divergence()


TOP_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vec FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.vec, c.vec) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


@query("op13_va_search", TOP_SQL)
def op13(spark, folder):
    return vafile.search(table(spark, folder, "embeddings"), F.col("id") % 50 == 0)
