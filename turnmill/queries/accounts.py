"""Account, lineage and review queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnmill import constants as K
from turnmill.functions import calendar as C
from turnmill.operators.lineage import walk
from turnmill.operators.ordered import integer_chunks, ranked
from turnmill.plans import accounts, review
from turnmill.queries.registry import query, table
from turnmill.session import materialize

_TYPES = {
    "click": ("subscription.active", "active", "false"), "view": ("subscription.updated", "trialing", "false"),
    "signup": ("subscription.canceled", "active", "event_id % 2 = 0"), "purchase": ("subscription.past_due", "active", "false"),
    "error": ("subscription.revoked", "canceled", "false"),
}
# Subscription events from the event table: an event takes effect up to half a day before it arrives, every 50th id
# repeats the one before, and now and then a customer id belongs to another account.
_ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"
BILLING_SQL = f"""
billing AS (
  SELECT event_id AS arrival, 'acct_' || md5('a' || user_id) AS account_id,
         'evt_' || CASE WHEN event_id % 50 = 0 AND event_id > 0 THEN event_id - 1 ELSE event_id END AS event_id,
         'cus_' || CASE WHEN event_id % 97 = 0 THEN user_id + 1 ELSE user_id END AS customer_id,
         CASE event_type {' '.join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in _TYPES.items())} END AS type,
         CASE event_type {' '.join(f"WHEN '{k}' THEN '{v[1]}'" for k, v in _TYPES.items())} END AS status,
         CASE event_type {' '.join(f"WHEN '{k}' THEN {v[2]}" for k, v in _TYPES.items())} END AS cancels,
         ts, ts - to_seconds(CAST(event_id * 7919 % 43200 AS BIGINT)) AS effective_ts
  FROM events
),
changes AS (
  SELECT *, {_ISO.format('effective_ts')} AS effective_at,
    CASE WHEN type = 'subscription.revoked' THEN 'ended' WHEN type = 'subscription.past_due' THEN 'past_due'
         WHEN type = 'subscription.canceled' AND cancels THEN status WHEN type = 'subscription.canceled' THEN 'ended' ELSE status END AS state
  FROM billing
),
ready AS (
  SELECT *, CASE WHEN state = 'past_due' THEN {_ISO.format('effective_ts + INTERVAL 7 DAY')} END AS grace_ends_at,
         CASE WHEN state = 'ended' THEN {_ISO.format('effective_ts + INTERVAL 30 DAY')} END AS recovery_ends_at FROM changes
),
known AS (SELECT DISTINCT 'acct_' || md5('a' || user_id) AS account_id FROM events WHERE user_id % 10 <> 3),
firsts AS (SELECT event_id, min(arrival) AS arrival FROM ready GROUP BY event_id),
fresh AS (SELECT r.* FROM ready r JOIN firsts f ON f.arrival = r.arrival JOIN known k ON k.account_id = r.account_id),
owners AS (SELECT customer_id, arg_min(account_id, arrival) AS customer_owner FROM fresh GROUP BY customer_id),
valid AS (SELECT f.* FROM fresh f JOIN owners USING (customer_id) WHERE customer_owner = account_id),
placed AS (SELECT *, max({{'e': effective_at, 'i': event_id}}) OVER (PARTITION BY account_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM valid),
statuses AS (
  SELECT r.arrival, r.event_id, r.account_id,
    CASE WHEN f.arrival IS NULL THEN 'duplicate' WHEN k.account_id IS NULL THEN 'unknown-account'
         WHEN o.customer_owner <> r.account_id THEN 'customer-conflict'
         WHEN p.seen IS NULL OR {{'e': p.effective_at, 'i': p.event_id}} > p.seen THEN 'applied' ELSE 'stale' END AS status
  FROM ready r LEFT JOIN firsts f ON f.arrival = r.arrival LEFT JOIN known k ON k.account_id = r.account_id
    LEFT JOIN owners o ON o.customer_id = r.customer_id LEFT JOIN placed p ON p.arrival = r.arrival
),
current AS (SELECT account_id, arg_max(struct_pack(event_id, state, effective_at, grace_ends_at, recovery_ends_at), {{'e': effective_at, 'i': event_id}}) AS row
            FROM valid GROUP BY account_id)"""
PRODUCTS = {"prod_month": "founding-monthly", "prod_year": "founding-yearly"}


def _account(user):
    return F.concat(F.lit("acct_"), F.md5(F.concat(F.lit("a"), user.cast("string"))))


def billing(spark, folder):
    rows, n, user = table(spark, folder, "events"), F.col("event_id"), F.col("user_id")
    effective = F.col("ts") - F.make_dt_interval(secs=n * 7919 % 43200)

    def pick(place):
        return F.coalesce(*[F.when(F.col("event_type") == k, F.expr(v[place]) if place == 2 else F.lit(v[place])) for k, v in _TYPES.items()])

    raw = rows.select(
        n.alias("arrival"), F.concat(F.lit("evt_"), F.when((n % 50 == 0) & (n > 0), n - 1).otherwise(n).cast("string")).alias("event_id"),
        pick(0).alias("type"), C.iso_millis(F.col("ts")).alias("timestamp"), F.col("ts").alias("received_at"),
        F.struct(
            F.concat(F.lit("sub_"), user.cast("string")).alias("id"),
            F.concat(F.lit("cus_"), F.when(n % 97 == 0, user + 1).otherwise(user).cast("string")).alias("customer_id"),
            F.when(n % 2 == 0, "prod_month").otherwise("prod_year").alias("product_id"), pick(1).alias("status"),
            C.iso_millis(effective).alias("modified_at"), F.lit(None).cast("string").alias("current_period_end"),
            pick(2).alias("cancel_at_period_end"), _account(user).alias("external_id")).alias("data"))
    return materialize(accounts.normalize_events(raw, PRODUCTS), "billing")


def _known(spark, folder):
    return table(spark, folder, "events").filter("user_id % 10 != 3").select(_account(F.col("user_id")).alias("account_id")).distinct()


@query("normalize_events", f"""
WITH {BILLING_SQL}
SELECT arrival, event_id, account_id, state, customer_id, effective_at, grace_ends_at, recovery_ends_at,
       CASE WHEN arrival % 2 = 0 THEN 'founding-monthly' ELSE 'founding-yearly' END AS product_code FROM ready""")
def normalize_events(spark, folder):
    return billing(spark, folder).select(
        "arrival", "event_id", "account_id", "state", "customer_id", "effective_at", "grace_ends_at", "recovery_ends_at", "product_code")


@query("event_status", f"WITH {BILLING_SQL} SELECT arrival, event_id, account_id, status FROM statuses")
def event_status(spark, folder):
    events = billing(spark, folder).select("arrival", "event_id", "account_id", "customer_id", "effective_at")
    return accounts.event_status(events, _known(spark, folder)).select("arrival", "event_id", "account_id", "status")


@query("entitlements", f"""
WITH {BILLING_SQL}
SELECT account_id, row.event_id AS event_id, row.state AS state, row.effective_at AS effective_at FROM current""")
def entitlements(spark, folder):
    events = billing(spark, folder)
    named = accounts.event_status(events.select("arrival", "event_id", "account_id", "customer_id", "effective_at"), _known(spark, folder))
    done = named.filter("status in ('applied', 'stale')").select("arrival")
    return accounts.entitlements(events.join(done, "arrival", "left_semi")).select("account_id", "event_id", "state", "effective_at")


_NOW = "2024-02-10 00:00:00"


@query("account_access", f"""
WITH {BILLING_SQL}, everyone AS (SELECT DISTINCT 'acct_' || md5('a' || user_id) AS account_id FROM events)
SELECT e.account_id, coalesce(c.row.state, 'none') AS state, coalesce(c.row.state, 'none') IN ('trialing', 'active', 'past_due', 'grace') AS can_write,
       coalesce(c.row.state, 'none') IN ('trialing', 'active', 'past_due', 'grace')
         OR coalesce(CAST(replace(c.row.recovery_ends_at, 'Z', '') AS TIMESTAMP) > TIMESTAMP '{_NOW}', false) AS can_read
FROM everyone e LEFT JOIN current c USING (account_id)""")
def account_access(spark, folder):
    events = billing(spark, folder)
    named = accounts.event_status(events.select("arrival", "event_id", "account_id", "customer_id", "effective_at"), _known(spark, folder))
    done = named.filter("status in ('applied', 'stale')").select("arrival")
    current = accounts.entitlements(events.join(done, "arrival", "left_semi"))
    everyone = table(spark, folder, "events").select(_account(F.col("user_id")).alias("account_id")).distinct()
    status = accounts.account_status(everyone, current)
    return accounts.access(status, F.lit(_NOW).cast("timestamp")).select("account_id", "state", "can_write", "can_read")


@query("quota_usage", """
WITH u AS (SELECT o_custkey AS account_id, count(*) AS generations, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS bytes FROM orders GROUP BY o_custkey)
SELECT *, generations < 500 AND bytes + 66000000 <= 67108864 AS available FROM u""")
def quota_usage(spark, folder):
    rows = table(spark, folder, "orders").select(F.col("o_custkey").alias("account_id"), F.floor("o_totalprice").alias("bytes"))
    return accounts.quota(rows, 66_000_000)


@query("device_counts", """
SELECT l_suppkey AS account_id, count(*) FILTER (l_linestatus = 'O') AS active_devices,
       max(l_shipdate) FILTER (l_linestatus = 'O') AS last_seen_at, count(*) FILTER (l_linestatus = 'O') < 5 AS may_add
FROM lineitem GROUP BY l_suppkey""")
def device_counts(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("account_id"), F.col("l_shipdate").alias("last_seen_at"),
        F.when(F.col("l_linestatus") != "O", F.col("l_shipdate")).alias("revoked_at"))
    return accounts.devices(rows)


@query("bounded_export", """
SELECT account_id, received_at, generation_id FROM (
  SELECT o_orderpriority AS account_id, o_orderdate AS received_at, o_orderkey AS generation_id,
         row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r <= 500""")
def bounded_export(spark, folder):
    return accounts.export(table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("account_id"), F.col("o_orderdate").alias("received_at"), F.col("o_orderkey").alias("generation_id")))


@query("retain_newest", """
SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS r FROM events)
WHERE r <= 100""")
def retain_newest(spark, folder):
    return accounts.retain_newest(table(spark, folder, "events").select("event_type", "event_id"), ["event_type"], "event_id")


@query("erase_and_expire", """
SELECT o_orderkey, o_custkey AS account_id FROM orders
WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AND o_orderdate > TIMESTAMP '1995-01-01'""")
def erase_and_expire(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("account_id"), F.col("o_orderdate").alias("expires_at"))
    erased = table(spark, folder, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("account_id"))
    return accounts.erase(accounts.unexpired(rows, F.lit("1995-01-01").cast("timestamp")), erased).select("o_orderkey", "account_id")


# Uploads: an order's parent is one to seven orders back, in blocks of a thousand; they arrive slightly out of order.
UPLOADS_SQL = """
uploads AS (
  SELECT o_orderkey // 1000 AS account_id, o_orderkey AS node,
         CASE WHEN (o_orderkey - (o_orderkey % 7 + 1)) // 1000 = o_orderkey // 1000 AND o_orderkey > o_orderkey % 7
              THEN o_orderkey - (o_orderkey % 7 + 1) END AS parent, o_orderkey + (o_orderkey * 31 % 5) * 2 AS moved
  FROM orders
)"""


def _uploads(spark, folder):
    k = F.col("o_orderkey")
    parent = k - (k % 7 + 1)
    return table(spark, folder, "orders").select(
        F.floor(k / 1000).cast("string").alias("owner_id"), k.alias("node"),
        F.when((F.floor(parent / 1000) == F.floor(k / 1000)) & (parent >= 0), parent).alias("next"),
        (k + (k * 31 % 5) * 2).alias("moved"))


@query("lineage_ancestors", f"""
WITH RECURSIVE {UPLOADS_SQL}, heads AS (SELECT account_id, max(node) AS node FROM uploads GROUP BY account_id),
chain(account_id, start, node, steps) AS (
  SELECT account_id, node, node, 0 FROM heads
  UNION ALL SELECT c.account_id, c.start, u.parent, c.steps + 1 FROM chain c JOIN uploads u USING (node) WHERE u.parent IS NOT NULL)
SELECT CAST(account_id AS VARCHAR) AS owner_id, start, node, CAST(steps AS BIGINT) AS steps FROM chain""")
def lineage_ancestors(spark, folder):
    pointers = materialize(_uploads(spark, folder), "uploads")
    heads = pointers.groupBy("owner_id").agg(F.max("node").alias("node"))
    return walk(pointers, heads).withColumn("steps", F.col("steps").cast("bigint"))


@query("pull_status", f"""
WITH RECURSIVE {UPLOADS_SQL}, heads AS (SELECT account_id, max(node) AS node FROM uploads GROUP BY account_id),
chain(account_id, node, steps) AS (
  SELECT account_id, node, 0 FROM heads
  UNION ALL SELECT c.account_id, u.parent, c.steps + 1 FROM chain c JOIN uploads u USING (node) WHERE u.parent IS NOT NULL),
local AS (SELECT account_id, max(node) - CASE account_id % 3 WHEN 0 THEN 0 ELSE 300 + account_id % 5 END AS node FROM uploads GROUP BY account_id)
SELECT CAST(h.account_id AS VARCHAR) AS owner_id, l.node AS local, h.node AS remote,
       CASE WHEN l.node = h.node THEN 'unchanged' WHEN EXISTS (SELECT 1 FROM chain c WHERE c.account_id = h.account_id AND c.node = l.node) THEN 'activated'
            ELSE 'conflict' END AS status FROM heads h JOIN local l USING (account_id)""")
def pull_status(spark, folder):
    generations = materialize(_uploads(spark, folder).select(
        "owner_id", F.col("node").alias("generation_id"), F.col("next").alias("parent_generation_id")), "uploads")
    remote = generations.groupBy("owner_id").agg(F.max("generation_id").alias("generation_id"))
    n = F.col("owner_id").cast("int")
    local = remote.withColumn("generation_id", F.col("generation_id") - F.when(n % 3 == 0, 0).otherwise(300 + n % 5))
    return review.pull_status(generations, local, remote)


# Uploads are as large as their orders' totals; a quota of 150 of them and 15 million bytes binds in some accounts by
# number, in others by size. Accounts of even number hold something already.
_MOST, _MOST_BYTES = 150, 15_000_000
ADMITTED_SQL = f"""
{UPLOADS_SQL},
arrived AS (
  SELECT u.*, CAST(floor(o_totalprice) AS BIGINT) * (1 + account_id % 3) AS bytes, row_number() OVER (ORDER BY moved, node) AS arrival,
         row_number() OVER (PARTITION BY account_id ORDER BY moved, node) AS place FROM uploads u JOIN orders ON o_orderkey = node
),
replay(account_id, place, node, accepted, held, held_bytes) AS (
  SELECT account_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), false, CASE WHEN account_id % 2 = 0 THEN 60 ELSE 0 END,
         CASE WHEN account_id % 2 = 0 THEN CAST(1000000 AS HUGEINT) ELSE 0 END FROM (SELECT DISTINCT account_id FROM arrived)
  UNION ALL
  SELECT r.account_id, a.place, a.node, r.held < {_MOST} AND r.held_bytes + a.bytes <= {_MOST_BYTES},
         r.held + CASE WHEN r.held < {_MOST} AND r.held_bytes + a.bytes <= {_MOST_BYTES} THEN 1 ELSE 0 END,
         r.held_bytes + CASE WHEN r.held < {_MOST} AND r.held_bytes + a.bytes <= {_MOST_BYTES} THEN a.bytes ELSE 0 END
  FROM replay r JOIN arrived a ON a.account_id = r.account_id AND a.place = r.place + 1
),
admitted AS (SELECT a.*, r.accepted FROM arrived a JOIN replay r USING (account_id, place))"""


def _arriving(spark, folder):
    """Uploads with their sizes in order of arrival, and what accounts hold before."""
    sizes = table(spark, folder, "orders").select(F.col("o_orderkey").alias("node"), F.floor("o_totalprice").alias("total"))
    rows = _uploads(spark, folder).join(sizes, "node").withColumn("all", F.lit(0))
    placed = materialize(ranked(rows, ["all"], ["moved", "node"], integer_chunks("moved"), "arrival"), "uploads")
    account = F.col("owner_id").cast("bigint")
    uploads = placed.select(
        F.col("owner_id").alias("account_id"), F.col("node").alias("generation_id"), F.col("next").alias("parent_generation_id"), "arrival",
        (F.col("total") * (1 + account % 3)).alias("bytes"))
    even = uploads.select("account_id").distinct().filter(F.col("account_id").cast("bigint") % 2 == 0)
    return uploads, even.select("account_id", F.lit(60).alias("generations"), F.lit(1_000_000).alias("bytes"))


@query("advance_heads", f"""
WITH RECURSIVE {ADMITTED_SQL}, taken AS (SELECT * FROM admitted WHERE accepted),
following AS (SELECT p.account_id, p.node, arg_min(c.node, c.arrival) AS next FROM taken p JOIN taken c ON c.parent = p.node AND c.arrival > p.arrival GROUP BY ALL),
path(account_id, node, steps) AS (
  SELECT account_id, arg_min(node, arrival), 0 FROM taken WHERE parent IS NULL GROUP BY account_id
  UNION ALL SELECT p.account_id, f.next, p.steps + 1 FROM path p JOIN following f USING (node))
SELECT CAST(a.account_id AS VARCHAR) AS account_id, a.node AS generation_id, a.accepted, p.node IS NOT NULL AS head_advanced
FROM admitted a LEFT JOIN path p USING (node)""")
def advance_heads(spark, folder):
    uploads, held = _arriving(spark, folder)
    moved, _ = accounts.advance_heads(uploads, None, held, _MOST, _MOST_BYTES)
    return moved.select("account_id", "generation_id", "accepted", "head_advanced")


@query("upload_quota", f"""
WITH RECURSIVE {ADMITTED_SQL} SELECT CAST(account_id AS VARCHAR) AS account_id, node AS generation_id, bytes, accepted FROM admitted""")
def upload_quota(spark, folder):
    uploads, held = _arriving(spark, folder)
    return accounts.within_quota(uploads, held, _MOST, _MOST_BYTES).select("account_id", "generation_id", "bytes", "accepted")


# --- review ----------------------------------------------------------------
# A part is a candidate, its line items are the evidence, the orders of the customer with its number decide.

_RISK = "CASE WHEN p_size % 11 = 0 THEN ['legal'] WHEN p_size % 13 = 0 THEN ['mystery'] ELSE [] END"
CANDIDATES_SQL = f"""
candidates AS (
  SELECT 'u' || (p_partkey % 4) AS owner_id, p_partkey AS candidate_id,
         CASE WHEN p_size % 7 = 0 THEN 'retirement' ELSE 'directive' END AS kind, {_RISK} AS risks,
         CASE WHEN p_size % 5 = 0 THEN 2 ELSE 0 END AS contradictions FROM part
),
evidence AS (SELECT l_partkey AS candidate_id, count(*) AS receipts, count(DISTINCT l_orderkey % (l_partkey % 5 + 1)) AS sessions,
                    count(DISTINCT strftime(l_shipdate, '%Y')) AS strata FROM lineitem GROUP BY l_partkey),
decided AS (
  SELECT o_custkey AS candidate_id, arg_max(CASE WHEN o_orderstatus = 'F' THEN 'approve' ELSE 'reject' END, {{'d': o_orderdate, 'k': o_orderkey}}) AS decision,
         max({{'d': o_orderdate, 'k': o_orderkey}}).k AS decision_id FROM orders GROUP BY o_custkey
),
queue AS (
  SELECT c.owner_id, c.candidate_id, e.receipts, e.sessions, e.strata AS time_strata,
    CASE WHEN 'mystery' IN risks THEN 'unknown-risk-category' WHEN len(risks) > 0 THEN 'prohibited-risk' WHEN kind = 'retirement' THEN 'retirement'
         WHEN contradictions > 0 THEN 'contradiction' WHEN e.sessions < 3 THEN 'insufficient-sessions'
         WHEN e.strata < 2 THEN 'insufficient-time-strata' ELSE 'auto-disabled' END AS policy_reason,
    CASE WHEN 'mystery' IN risks THEN 'reject' ELSE 'review' END AS policy_class,
    coalesce(d.decision, 'pending') AS decision, d.decision_id
  FROM candidates c JOIN evidence e USING (candidate_id) LEFT JOIN decided d USING (candidate_id)
)"""


def candidates(spark, folder):
    part, size = table(spark, folder, "part"), F.col("p_size")
    none = F.array().cast("array<string>")
    base = part.select(
        F.concat(F.lit("u"), (F.col("p_partkey") % 4).cast("string")).alias("owner_id"), F.col("p_partkey").alias("candidate_id"),
        F.when(size % 7 == 0, "retirement").otherwise("directive").alias("kind"),
        F.when(size % 11 == 0, F.array(F.lit("legal"))).when(size % 13 == 0, F.array(F.lit("mystery"))).otherwise(none).alias("risk_categories"),
        F.when(size % 5 == 0, 2).otherwise(0).alias("contradiction_count"))
    # One row of evidence per line item; counted, never listed, so a part with very many is no larger than another.
    rows = table(spark, folder, "lineitem").select(
        F.concat(F.lit("u"), (F.col("l_partkey") % 4).cast("string")).alias("owner_id"), F.col("l_partkey").alias("candidate_id"),
        (F.col("l_orderkey") % (F.col("l_partkey") % 5 + 1)).alias("session_id"), F.date_format("l_shipdate", "yyyy").alias("time_stratum"))
    return review.with_support(base, rows)


def decisions(spark, folder):
    k = F.col("o_custkey")
    return table(spark, folder, "orders").select(
        F.concat(F.lit("u"), (k % 4).cast("string")).alias("owner_id"), k.alias("candidate_id"), F.col("o_orderkey").alias("decision_id"),
        F.when(F.col("o_orderstatus") == "F", "approve").otherwise("reject").alias("decision"), F.lit("because").alias("reason"),
        F.col("o_orderdate").alias("decided_at"))


@query("review_queue", f"WITH {CANDIDATES_SQL} SELECT * FROM queue")
def review_queue(spark, folder):
    rows = review.review_queue(candidates(spark, folder), decisions(spark, folder))
    return rows.select(
        "owner_id", "candidate_id", F.col("receipts").cast("bigint").alias("receipts"), F.col("sessions").cast("bigint").alias("sessions"),
        F.col("time_strata").cast("bigint").alias("time_strata"), "policy_reason", "policy_class", "decision", "decision_id")


@query("latest_decisions", """
SELECT o_custkey AS candidate_id, max({'d': o_orderdate, 'k': o_orderkey}).k AS decision_id FROM orders GROUP BY o_custkey""")
def latest_decisions(spark, folder):
    return review.latest_decisions(decisions(spark, folder)).select("candidate_id", "decision_id")


@query("status_counts", f"""
WITH {CANDIDATES_SQL}, c AS (SELECT owner_id, count(*) AS candidates, count(*) FILTER (decision = 'pending') AS pending,
  count(*) FILTER (decision = 'approve') AS approved, count(*) FILTER (decision = 'reject') AS rejected FROM queue GROUP BY owner_id),
i AS (SELECT 'u' || (user_id % 5) AS owner_id, count(*) AS inbox FROM events GROUP BY 1),
g AS (SELECT 'u' || (o_orderkey % 3) AS owner_id, count(*) AS generations FROM orders GROUP BY 1)
SELECT owner_id, coalesce(candidates, 0) AS candidates, coalesce(pending, 0) AS pending, coalesce(approved, 0) AS approved,
       coalesce(rejected, 0) AS rejected, coalesce(inbox, 0) AS inbox, coalesce(generations, 0) AS generations
FROM c FULL JOIN i USING (owner_id) FULL JOIN g USING (owner_id)""")
def status_counts(spark, folder):
    queue = review.review_queue(candidates(spark, folder), decisions(spark, folder))

    def owned(name, column, modulus):
        return table(spark, folder, name).select(F.concat(F.lit("u"), (F.col(column) % modulus).cast("string")).alias("owner_id"))

    return review.status_counts(queue, owned("events", "user_id", 5), owned("orders", "o_orderkey", 3))


@query("blocked_candidates", f"""
WITH {CANDIDATES_SQL} SELECT owner_id, candidate_id FROM queue WHERE NOT (decision = 'approve' AND policy_class IN ('safe', 'review'))""")
def blocked_candidates(spark, folder):
    chosen = candidates(spark, folder)
    made = decisions(spark, folder).join(review.with_policy(chosen).select("owner_id", "candidate_id", "policy_class"), ["owner_id", "candidate_id"])
    return review.blocked_candidates(chosen.select("owner_id", "candidate_id"), made)


# One user more, the busy one, has half of all events.
@query("quiet_sessions", """
WITH e AS (SELECT user_id, ts FROM events UNION ALL SELECT -1, ts FROM events),
g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 3600 SECOND THEN 0 ELSE 1 END AS opens FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS part FROM g)
SELECT user_id, min(ts) AS first_at, max(ts) AS last_at, count(*) AS events FROM n GROUP BY user_id, part""")
def quiet_sessions(spark, folder):
    events = table(spark, folder, "events").select("user_id", "ts")
    busy = events.withColumn("user_id", F.lit(-1).cast(events.schema["user_id"].dataType))
    return review.quiet_sessions(events.unionByName(busy), ["user_id"], "ts", 3600)
