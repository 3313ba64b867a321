"""Generations replayed from operations.

A customer is an owner and each of its orders an operation: every third goes back to one of the last orders, the others
choose the parts of their lines. A part was approved or rejected in the first days of a month.
"""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from turnmill.plans import generations
from turnmill.queries.registry import query, table
from turnmill.session import materialize

OPS_SQL = """
placed AS (SELECT 'u' || o_custkey AS owner_id, o_orderkey, o_orderdate AS created_at, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS op FROM orders),
ops AS (
  SELECT *, CASE WHEN o_orderkey % 3 = 0 AND op > 0 THEN 'rollback' ELSE 'activate' END AS operation,
         CASE WHEN o_orderkey % 3 = 0 AND op > 0 THEN op - 1 - o_orderkey % 4 END AS target FROM placed
),
decided AS (
  SELECT DISTINCT 'p' || (l_partkey % 30) AS candidate_id, date_trunc('month', l_shipdate) + INTERVAL 2 DAY AS decided_at,
         (l_partkey % 30 + month(l_shipdate)) % 4 <> 0 AS approves FROM lineitem
),
picks AS (
  SELECT o.owner_id, o.op, l.candidate_id, coalesce(arg_max(d.approves, d.decided_at), false) AS allowed
  FROM ops o JOIN (SELECT DISTINCT l_orderkey, 'p' || (l_partkey % 30) AS candidate_id FROM lineitem) l ON l.l_orderkey = o.o_orderkey
  LEFT JOIN decided d ON d.candidate_id = l.candidate_id AND d.decided_at <= o.created_at
  WHERE o.operation = 'activate' GROUP BY ALL
),
steps AS (
  SELECT o.*, coalesce(list(p.candidate_id) FILTER (p.candidate_id IS NOT NULL), []) AS chosen,
         coalesce(list(p.candidate_id) FILTER (NOT p.allowed), []) AS blocked
  FROM ops o LEFT JOIN picks p ON p.owner_id = o.owner_id AND p.op = o.op GROUP BY ALL
),
replay(owner_id, op, operation, members, history, made) AS (
  SELECT DISTINCT owner_id, CAST(-1 AS BIGINT), 'none', CAST([] AS VARCHAR[]), CAST([] AS STRUCT(op BIGINT, members VARCHAR[])[]), false FROM ops
  UNION ALL
  SELECT owner_id, op, operation, next_members, CASE WHEN ok THEN list_append(history, {'op': op, 'members': next_members}) ELSE history END, ok
  FROM (
    SELECT *, CASE WHEN NOT ok THEN members WHEN operation = 'activate' THEN list_concat(members, fresh) ELSE hit[1].members END AS next_members
    FROM (
      SELECT *, CASE WHEN operation = 'activate' THEN len(fresh) > 0 AND len(list_intersect(fresh, blocked)) = 0
                     ELSE len(hit) = 1 AND history[-1].op <> target END AS ok
      FROM (
        SELECT r.owner_id, s.op, s.operation, s.target, s.blocked, r.members, r.history, list_filter(s.chosen, lambda x: NOT list_contains(r.members, x)) AS fresh,
               list_filter(r.history, lambda h: h.op = s.target) AS hit
        FROM replay r JOIN steps s ON s.owner_id = r.owner_id AND s.op = r.op + 1)))
),
made AS (
  SELECT owner_id, op, operation, CAST(len(members) AS BIGINT) AS members, row_number() OVER (PARTITION BY owner_id ORDER BY op) - 1 AS place,
         list_sum(list_transform(members, lambda c: CAST('0x' || substr(sha256(c), 1, 15) AS BIGINT)::HUGEINT)) AS hash
  FROM replay WHERE made
)"""


@query("generations", f"""
WITH RECURSIVE {OPS_SQL},
named AS (SELECT *, 'gen_' || substr(sha256(owner_id || '|' || place || '|' || operation || '|' || hash), 1, 20) AS generation_id FROM made)
SELECT owner_id, op, operation, members, generation_id, lag(generation_id) OVER (PARTITION BY owner_id ORDER BY place) AS parent_generation_id FROM named""")
def next_generations(spark, folder):
    orders = table(spark, folder, "orders").select(
        F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("owner_id"), "o_orderkey", F.col("o_orderdate").alias("created_at"),
        (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).cast("bigint").alias("op"))
    k, back = F.col("o_orderkey"), (F.col("o_orderkey") % 3 == 0) & (F.col("op") > 0)
    ops = materialize(orders.withColumns({
        "operation": F.when(back, "rollback").otherwise("activate"), "target": F.when(back, F.col("op") - 1 - k % 4)}), "operations")
    lines = table(spark, folder, "lineitem").withColumn("candidate_id", F.concat(F.lit("p"), (F.col("l_partkey") % 30).cast("string")))
    decided = lines.select(
        F.lit("all").alias("owner_id"), "candidate_id", (F.date_trunc("month", "l_shipdate") + F.make_dt_interval(days=F.lit(2))).alias("decided_at"),
        F.when((F.col("l_partkey") % 30 + F.month("l_shipdate")) % 4 != 0, "approve").otherwise("reject").alias("decision")).distinct()
    decided = decided.withColumns({"decision_id": F.lit("d"), "policy_class": F.lit("safe")})
    picked = lines.select("l_orderkey", "candidate_id").distinct().join(ops.filter("operation = 'activate'"), F.col("l_orderkey") == k)
    asked = picked.select(F.col("owner_id").alias("by"), "op", F.lit("all").alias("owner_id"), "candidate_id", F.col("created_at").cast("timestamp").alias("created_at"))
    chosen = generations.allowed_at(asked, decided.withColumn("decided_at", F.col("decided_at").cast("timestamp")))
    made, _ = generations.replay(ops, chosen.select(F.col("by").alias("owner_id"), "op", "candidate_id", "allowed"))
    return made.select("owner_id", "op", "operation", "members", "generation_id", "parent_generation_id")
