"""Driver tables seen as message tables, in Spark and in SQL.

The tables have no log paths or message dates, so both are derived from their keys: five documents make a session,
sessions take turns over three owners and six sources, and one session in seventeen is undated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from turnmill import constants as K
from turnmill.functions import identity as I
from turnmill.queries.registry import table

_SOURCES = ", ".join(f"'{s}'" for s in K.SOURCES)

CONV_SQL = """
conv AS (
  SELECT 'default' AS owner_id, substr(sha256('conv:' || conv_id), 1, 16) AS session_id, 'custom' AS source,
         conv_id, turn AS line_id, 'undated' AS date, text
  FROM conversations WHERE role = 'user' AND trim(text) <> ''
)"""

DOCS_SQL = f"""
docs AS (
  SELECT 'u' || (s % 3) AS owner_id, substr(sha256('doc:' || s), 1, 16) AS session_id,
         [{_SOURCES}][s % 6 + 1] AS source, s AS session_no, doc_id, doc_id % 5 AS line_id,
         CASE WHEN s % 17 = 0 THEN 'undated' ELSE strftime(DATE '2024-01-01' + CAST(s * 7 % 700 AS INTEGER), '%Y-%m-%d') END AS date,
         text
  FROM (SELECT doc_id, doc_id // 5 AS s, text FROM documents)
  WHERE trim(text) <> ''
)"""


def _key(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


def _messages(rows: DataFrame, owner: Column, session: Column, source: Column, path: Column, line: Column, date: Column):
    return rows.filter("trim(text) != ''").select(
        owner.alias("owner_id"), session.alias("session_id"), source.alias("source"), path.alias("file_path"),
        F.lit(0).cast("bigint").alias("block_start"), line.alias("line_id"), F.lit(0).cast("bigint").alias("part_no"),
        date.alias("date"), "text")


def conversation_messages(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").filter("role = 'user'")
    return _messages(
        rows, F.lit("default"), I.short_hash(_key("conv:", F.col("conv_id")), 16), F.lit("custom"),
        F.lpad(F.col("conv_id").cast("string"), 12, "0"), F.col("turn"), F.lit("undated"))


def document_session() -> Column:
    return F.floor(F.col("doc_id") / 5)


def document_messages(spark: SparkSession, folder: str) -> DataFrame:
    s = document_session()
    source = F.element_at(F.array(*[F.lit(x) for x in K.SOURCES]), (s % 6 + 1).cast("int"))
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (s * 7 % 700).cast("int")), "yyyy-MM-dd")
    return _messages(
        table(spark, folder, "documents"), _key("u", s % 3), I.short_hash(_key("doc:", s), 16), source,
        F.lpad(s.cast("string"), 12, "0"), F.col("doc_id") % 5, F.when(s % 17 == 0, "undated").otherwise(day))
