"""Receipt, packing and segment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnmill import constants as K
from turnmill.functions.identity import sha256
from turnmill.operators.ordered import hash_chunks, ranked, running
from turnmill.operators.packing import pack_greedy
from turnmill.operators.selection import lane_rank, select_run_segments, select_segments, select_stage as select_stage_rows, temporal_queue
from turnmill.plans import corpus, receipts, segments
from turnmill.queries import sqltext as S
from turnmill.queries.corpus import DOCS_KEPT, MINED, ROLLED_SQL
from turnmill.queries.inputs import DOCS_SQL, document_messages
from turnmill.queries.registry import query, table
from turnmill.session import materialize

MINED_DOCS = f"{DOCS_SQL}, {DOCS_KEPT}, {MINED}"
LEDGER_SQL = """
receipts AS (
  SELECT owner_id, 'rcpt-' || substr(sha256('{"content_hash":"' || content_hash || '","date":"' || date || '","ordinal":' || ordinal ||
           ',"schema_version":"1","session_id":"' || session_id || '"}'), 1, 20) AS receipt_id,
         session_id, source, date, CAST(ordinal AS BIGINT) AS ordinal, text, CAST(greatest(1, length(text) // 4) AS BIGINT) AS tokens, content_hash
  FROM (SELECT *, sha256(text) AS content_hash FROM mined)
)"""
_PADDED = "' ' || print || ' '"
_FAMILY = {f: S.contains_any(_PADDED, m) for f, m in K.SALIENCE_MARKERS.items()}
_SCORE = " + ".join(f"CASE WHEN {c} THEN {K.SALIENCE_WEIGHTS[f]} ELSE 0 END" for f, c in _FAMILY.items())
SCORED_SQL = f"""
printed AS (SELECT *, {S.fingerprint('text')} AS print FROM receipts),
recurring AS (SELECT owner_id, print, count(DISTINCT session_id) AS n FROM printed GROUP BY owner_id, print),
scored0 AS (
  SELECT p.*, r.n AS recurrence_sessions, {S.labels(list(_FAMILY.items()) + [('recurrence', 'r.n > 1')])} AS fam,
         {S.labels([(d, S.contains_any(_PADDED, m)) for d, m in K.DOMAIN_MARKERS.items()])} AS dom,
         1 + {_SCORE} + CASE WHEN r.n > 1 THEN least(24, (r.n - 1) * 6) ELSE 0 END AS salience
  FROM printed p JOIN recurring r USING (owner_id, print)
),
scored AS (
  SELECT *, CASE WHEN len(fam) = 0 THEN ['exploration'] ELSE fam END AS families,
         CASE WHEN len(dom) = 0 THEN ['work'] ELSE dom END AS domains FROM scored0
)"""


def mined_documents(spark, folder):
    """The mined messages as a written table: every later step reads them more than once."""
    return materialize(corpus.mine(document_messages(spark, folder)), "messages")


def scored_documents(spark, folder):
    return _ledger_and_scored(spark, folder)[1]


def _ledger_and_scored(spark, folder):
    """Receipts and their scores, from messages that are mined once."""
    ledger = receipts.ledger(mined_documents(spark, folder))
    return ledger, materialize(receipts.score(ledger), "scored")


@query("receipt_ledger", f"""
WITH {MINED_DOCS}, {LEDGER_SQL}
SELECT owner_id, receipt_id, session_id, source, date, ordinal, tokens, content_hash FROM receipts""")
def receipt_ledger(spark, folder):
    return receipts.ledger(mined_documents(spark, folder)).select(
        "owner_id", "receipt_id", "session_id", "source", "date", F.col("ordinal").cast("bigint").alias("ordinal"), "tokens",
        "content_hash")


@query("score_receipts", f"""
WITH {MINED_DOCS}, {LEDGER_SQL}, {SCORED_SQL}
SELECT owner_id, receipt_id, CAST(salience AS BIGINT) AS salience, array_to_string(families, ',') AS families,
       array_to_string(domains, ',') AS domains, CAST(recurrence_sessions AS BIGINT) AS recurrence_sessions,
       sha256('{{"domain_hints":["' || array_to_string(domains, '","') || '"],"receipt_id":"' || receipt_id || '","recurrence_sessions":' ||
         recurrence_sessions || ',"salience":' || salience || ',"schema_version":"1","signal_families":["' ||
         array_to_string(families, '","') || '"]}}') AS salience_hash
FROM scored""")
def score_receipts(spark, folder):
    return scored_documents(spark, folder).select(
        "owner_id", "receipt_id", F.col("salience").cast("bigint").alias("salience"),
        F.array_join("signal_families", ",").alias("families"), F.array_join("domain_hints", ",").alias("domains"),
        F.col("recurrence_sessions").cast("bigint").alias("recurrence_sessions"), "salience_hash")


@query("lane_ranking", f"""
WITH {MINED_DOCS}, {LEDGER_SQL}, {SCORED_SQL},
lanes AS (
  SELECT owner_id, d.domain, source, CASE WHEN date = 'undated' THEN 'unknown' ELSE {S.quarter('date')} END AS quarter, f.family,
         receipt_id, salience
  FROM scored, unnest(domains) d(domain), unnest(families) f(family)
)
SELECT owner_id, domain, source, quarter, family, receipt_id, CAST(row_number() OVER (
  PARTITION BY owner_id, domain, source, quarter, family ORDER BY salience DESC, receipt_id) - 1 AS BIGINT) AS lane_rank
FROM lanes""")
def lane_ranking(spark, folder):
    return lane_rank(scored_documents(spark, folder)).select(
        "owner_id", "domain", "source", "quarter", "family", "receipt_id", "lane_rank")


@query("corpus_snapshot", f"""
WITH {MINED_DOCS}, {LEDGER_SQL},
leaves AS (
  SELECT owner_id, leaf AS k, leaf || ':' || count(*) AS v FROM (
    SELECT owner_id, sha256('{{"content_hash":"' || content_hash || '","receipt_id":"' || receipt_id || '"}}') AS leaf FROM receipts)
  GROUP BY owner_id, leaf),
l6 AS (SELECT owner_id, substr(k, 1, 6) AS k6, sha256(string_agg(k || '=' || v, chr(10) ORDER BY k)) AS v FROM leaves GROUP BY ALL),
l4 AS (SELECT owner_id, substr(k6, 1, 4) AS k4, sha256(string_agg(k6 || '=' || v, chr(10) ORDER BY k6)) AS v FROM l6 GROUP BY ALL),
l2 AS (SELECT owner_id, substr(k4, 1, 2) AS k2, sha256(string_agg(k4 || '=' || v, chr(10) ORDER BY k4)) AS v FROM l4 GROUP BY ALL)
SELECT owner_id, sha256(string_agg(k2 || '=' || v, chr(10) ORDER BY k2)) AS corpus_snapshot_hash FROM l2 GROUP BY owner_id""")
def corpus_snapshot(spark, folder):
    return receipts.snapshot_hash(receipts.ledger(mined_documents(spark, folder)))


@query("select_stage")
def select_stage(spark, folder):
    scored = scored_documents(spark, folder)
    selected, _ = receipts.stage_plan(scored, "A")
    return selected.select("owner_id", "receipt_id", "tokens", "position")


@query("stage_packets")
def stage_packets(spark, folder):
    scored = scored_documents(spark, folder)
    _, packet_rows = receipts.stage_plan(scored, "A")
    return packet_rows.select(
        "owner_id", "packet_no", "packet_hash", "source_tokens", F.size("receipt_ids").cast("bigint").alias("receipts"),
        "first_date", "last_date", F.array_join("sources", ",").alias("sources"),
        F.to_json("domain_counts").alias("domain_counts"), F.to_json("signal_counts").alias("signal_counts"))


# A budget so small that rounds stop, large receipts are skipped and smaller ones fill what is left.
_BUDGET, _PACKET, _PACKETS = 9_000, 1_500, 4
_SMALL_STAGE = f"""
WITH RECURSIVE {MINED_DOCS}, {LEDGER_SQL}, {SCORED_SQL},
fitting AS (SELECT * FROM scored WHERE tokens <= {_PACKET}),
lane_rows AS (
  SELECT owner_id, d.domain, source, CASE WHEN date = 'undated' THEN 'unknown' ELSE {S.quarter('date')} END AS quarter, f.family,
         receipt_id, tokens, salience FROM fitting, unnest(domains) d(domain), unnest(families) f(family)),
lanes AS (
  SELECT owner_id, row_number() OVER (PARTITION BY owner_id ORDER BY domain, source, quarter, family) AS lane, ids, sizes FROM (
    SELECT owner_id, domain, source, quarter, family, list(receipt_id ORDER BY salience DESC, receipt_id) AS ids,
           list(tokens ORDER BY salience DESC, receipt_id) AS sizes FROM lane_rows GROUP BY ALL)),
owners AS (SELECT owner_id, count(*) AS n FROM lanes GROUP BY owner_id),
visit(owner_id, lane, heads, taken, spent, moved, done) AS (
  SELECT owner_id, CAST(1 AS BIGINT), list_transform(range(0, n), lambda x: CAST(1 AS BIGINT)), CAST([] AS VARCHAR[]), CAST(0 AS BIGINT), false, false FROM owners
  UNION ALL
  SELECT owner_id, CASE WHEN lane = n THEN 1 ELSE lane + 1 END, list_concat(list_concat(heads[1:lane - 1], [coalesce(spot, len(ids)) + 1]), heads[lane + 1:n]),
         CASE WHEN picks THEN list_append(taken, ids[spot]) ELSE taken END, CASE WHEN picks THEN spent + sizes[spot] ELSE spent END,
         CASE WHEN lane = n THEN false ELSE moved OR picks END, lane = n AND NOT (moved OR picks)
  FROM (SELECT *, spot IS NOT NULL AND spent + sizes[spot] <= {_BUDGET} AS picks FROM (
    SELECT v.*, o.n, l.ids, l.sizes, list_filter(range(v.heads[v.lane], len(l.ids) + 1), lambda x: NOT list_contains(v.taken, l.ids[x]))[1] AS spot
    FROM visit v JOIN owners o USING (owner_id) JOIN lanes l ON l.owner_id = v.owner_id AND l.lane = v.lane WHERE NOT v.done))
),
rounds AS (SELECT owner_id, taken, spent FROM visit WHERE done),
waiting AS (SELECT f.owner_id, f.receipt_id, f.tokens, row_number() OVER (PARTITION BY f.owner_id ORDER BY salience DESC, receipt_id) AS k
            FROM fitting f JOIN rounds r USING (owner_id) WHERE NOT list_contains(r.taken, f.receipt_id)),
fill(owner_id, k, taken, spent) AS (
  SELECT owner_id, CAST(0 AS BIGINT), taken, spent FROM rounds
  UNION ALL
  SELECT f.owner_id, w.k, CASE WHEN f.spent + w.tokens <= {_BUDGET} THEN list_append(f.taken, w.receipt_id) ELSE f.taken END,
         CASE WHEN f.spent + w.tokens <= {_BUDGET} THEN f.spent + w.tokens ELSE f.spent END
  FROM fill f JOIN waiting w ON w.owner_id = f.owner_id AND w.k = f.k + 1
),
chosen AS (SELECT owner_id, unnest(taken) AS receipt_id, generate_subscripts(taken, 1) - 1 AS position FROM (
  SELECT owner_id, arg_max(taken, k) AS taken FROM fill GROUP BY owner_id)),
picked AS (SELECT c.owner_id, c.receipt_id, f.tokens, CAST(c.position AS BIGINT) AS position, f.content_hash, f.date, f.source FROM chosen c JOIN fitting f USING (owner_id, receipt_id))"""


def _small_stage(spark, folder):
    scored = scored_documents(spark, folder)
    return scored, select_stage_rows(scored, _BUDGET, _PACKET)


@query("select_small_stage", f"{_SMALL_STAGE} SELECT owner_id, receipt_id, tokens, position FROM picked")
def select_small_stage(spark, folder):
    return _small_stage(spark, folder)[1]


def _pack_sql(rows: str, limit: int, reach: bool = False) -> str:
    """Bins of ``rows(grp, n, c, p)``: place, running weight with and without the row. One step per bin, all groups at once."""
    edge = f"x.p >= b.start_p + {limit}" if reach else f"x.c > b.start_p + {limit}"
    return f"""
packrows AS ({rows}),
bins(grp, start_n, start_p) AS (
  SELECT grp, n, p FROM packrows WHERE n = 0
  UNION ALL
  SELECT * FROM (
    SELECT x.grp, min(x.n) AS n, min(x.p) AS p FROM bins b JOIN packrows x ON x.grp = b.grp AND x.n > b.start_n AND {edge} GROUP BY x.grp)
)"""


@query("small_stage_packets", f"""{_SMALL_STAGE},
{_pack_sql(f"""SELECT owner_id AS grp, receipt_id, content_hash, date, source, tokens, position AS n,
  CAST(sum(tokens) OVER g AS BIGINT) AS c, CAST(sum(tokens) OVER g - tokens AS BIGINT) AS p FROM picked WINDOW g AS (PARTITION BY owner_id ORDER BY position)""", _PACKET)},
numbered AS (SELECT grp, start_n, row_number() OVER (PARTITION BY grp ORDER BY start_n) - 1 AS packet_no FROM bins)
SELECT x.grp AS owner_id, CAST(b.packet_no AS BIGINT) AS packet_no, CAST(sum(x.tokens) AS BIGINT) AS source_tokens, count(*) AS receipts, min(date) AS first_date, max(date) AS last_date,
       array_to_string(list_sort(list_distinct(list(source))), ',') AS sources,
       sha256('{{"content_hashes":[' || string_agg('"' || content_hash || '"', ',' ORDER BY n) || '],"receipt_ids":[' || string_agg('"' || receipt_id || '"', ',' ORDER BY n) || '],"schema_version":"1"}}') AS packet_hash
FROM packrows x ASOF JOIN numbered b ON x.grp = b.grp AND x.n >= b.start_n WHERE b.packet_no < {_PACKETS} GROUP BY x.grp, b.packet_no""")
def small_stage_packets(spark, folder):
    scored, picked = _small_stage(spark, folder)
    picked = materialize(picked, "picked")
    selected = scored.join(picked.select("owner_id", "receipt_id", "position"), ["owner_id", "receipt_id"])
    return receipts.packets(selected, _PACKETS, _PACKET).select(
        "owner_id", F.col("packet_no").cast("bigint").alias("packet_no"), "source_tokens", F.size("receipt_ids").cast("bigint").alias("receipts"),
        "first_date", "last_date", F.array_join("sources", ",").alias("sources"), "packet_hash")


_PACKED = f"""{_SMALL_STAGE},
{_pack_sql(f"""SELECT owner_id AS grp, receipt_id, content_hash, date, source, tokens, position AS n,
  CAST(sum(tokens) OVER g AS BIGINT) AS c, CAST(sum(tokens) OVER g - tokens AS BIGINT) AS p FROM picked WINDOW g AS (PARTITION BY owner_id ORDER BY position)""", _PACKET)},
numbered AS (SELECT grp, start_n, row_number() OVER (PARTITION BY grp ORDER BY start_n) - 1 AS packet_no FROM bins),
placed AS (SELECT x.grp AS owner_id, b.packet_no, x.receipt_id, x.n - b.start_n AS place FROM packrows x ASOF JOIN numbered b ON x.grp = b.grp AND x.n >= b.start_n
           WHERE b.packet_no < {_PACKETS}),
hydrated AS (SELECT p.owner_id, p.packet_no, p.place, r.receipt_id, r.session_id, r.source, r.date, r.text FROM placed p JOIN receipts r USING (owner_id, receipt_id))"""


def _packed(spark, folder):
    ledger, scored = _ledger_and_scored(spark, folder)
    picked = materialize(select_stage_rows(scored, _BUDGET, _PACKET), "picked")
    selected = scored.join(picked.select("owner_id", "receipt_id", "position"), ["owner_id", "receipt_id"])
    return materialize(receipts.packets(selected, _PACKETS, _PACKET), "packets"), ledger


@query("hydrated_packets", f"""{_PACKED}
SELECT owner_id, CAST(place AS BIGINT) AS place, receipt_id, session_id, sha256(text) AS text_hash FROM hydrated""")
def hydrated_packets(spark, folder):
    rows, ledger = _packed(spark, folder)
    return receipts.hydrate_packets(rows, ledger).select(
        "owner_id", F.col("place").cast("bigint").alias("place"), "receipt_id", "session_id", sha256(F.col("text")).alias("text_hash"))


@query("packet_texts", f"""{_PACKED}
SELECT owner_id, sha256(string_agg('===== receipt:' || receipt_id || ' session:' || session_id || ' source:' || source || ' date:' || date || ' =====' || chr(10) || text,
       chr(10) || chr(10) ORDER BY place) || chr(10)) AS text_hash FROM hydrated GROUP BY owner_id, packet_no""")
def packet_texts(spark, folder):
    rows, ledger = _packed(spark, folder)
    return receipts.render_packets(rows, ledger).select("owner_id", sha256(F.col("text")).alias("text_hash"))


@query("needs_deepening", """
SELECT p_partkey, (CASE WHEN p_size % 4 = 0 THEN 'no-signal' ELSE 'active' END <> 'active') OR p_size % 5 < 1 OR p_size % 6 < 2 OR p_size % 7 < 2 OR p_size % 11 < 2
       OR p_size % 13 = 5 AS weak FROM part""")
def needs_deepening(spark, folder):
    size = F.col("p_size")
    weak = receipts.needs_deepening(
        F.when(size % 4 == 0, "no-signal").otherwise("active"), size % 5, size % 6, size % 7, size % 11, F.when(size % 13 == 5, 2))
    return table(spark, folder, "part").select("p_partkey", weak.alias("weak"))


_BY_ORDER = """
SELECT l_returnflag || l_linestatus AS grp, l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS w,
       row_number() OVER g - 1 AS n, CAST(sum(CAST(l_quantity AS BIGINT)) OVER g AS BIGINT) AS c,
       CAST(sum(CAST(l_quantity AS BIGINT)) OVER g - CAST(l_quantity AS BIGINT) AS BIGINT) AS p
FROM lineitem WINDOW g AS (PARTITION BY l_returnflag || l_linestatus ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)"""
_LIMIT = 4000


def _line_items(spark, folder):
    """Line items of each return flag and status, in order, with a unique place per order."""
    return table(spark, folder, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("grp"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        "l_extendedprice", F.col("l_quantity").cast("bigint").alias("w"))


def _order_chunks():
    return [{"order_c1": F.floor(F.col("l_orderkey") / 1024)}, {"order_c2": F.floor(F.col("l_orderkey") / (1 << 20))}]


_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


@query("pack_greedy", f"""
WITH RECURSIVE {_pack_sql(_BY_ORDER, _LIMIT)}
SELECT b.grp, b.start_p AS bin_start, count(*) AS items, CAST(sum(x.w) AS BIGINT) AS weight
FROM packrows x ASOF JOIN bins b ON x.grp = b.grp AND x.n >= b.start_n GROUP BY b.grp, b.start_p""")
def pack_by_weight(spark, folder):
    packed = pack_greedy(_line_items(spark, folder), ["grp"], _ORDER, _order_chunks(), "w", _LIMIT)
    return packed.groupBy("grp", "bin_start").agg(F.count("*").alias("items"), F.sum("w").alias("weight"))


@query("pack_chunks", f"""
WITH RECURSIVE {_pack_sql(_BY_ORDER, _LIMIT, reach=True)}
SELECT b.grp, b.start_p AS bin_start, count(*) AS items, CAST(sum(x.w) AS BIGINT) AS weight
FROM packrows x ASOF JOIN bins b ON x.grp = b.grp AND x.n >= b.start_n GROUP BY b.grp, b.start_p""")
def pack_chunks(spark, folder):
    packed = pack_greedy(_line_items(spark, folder), ["grp"], _ORDER, _order_chunks(), "w", _LIMIT, on_overflow=False)
    return packed.groupBy("grp", "bin_start").agg(F.count("*").alias("items"), F.sum("w").alias("weight"))


_TARGET = 5_000


def _seal_sql(prefix: str, rolled: str) -> str:
    rows = f"""
SELECT owner_id || '/' || source AS grp, *, row_number() OVER g - 1 AS n, CAST(sum(tokens) OVER g AS BIGINT) AS c,
       CAST(sum(tokens) OVER g - tokens AS BIGINT) AS p
FROM {rolled} WINDOW g AS (PARTITION BY owner_id, source ORDER BY first_date, session_id)"""
    packed = _pack_sql(rows, _TARGET).replace("packrows", f"{prefix}rows").replace("bins", f"{prefix}bins")
    return packed + f""",
{prefix}segments AS (
  SELECT x.owner_id, x.source, count(*) AS sessions, CAST(sum(tokens) AS BIGINT) AS source_tokens,
         coalesce(min(nullif(first_date, 'undated')), 'undated') AS first_date,
         coalesce(max(nullif(last_date, 'undated')), 'undated') AS last_date,
         sha256(string_agg(content_hash, chr(10) ORDER BY x.n)) AS text_hash,
         count(*) = 1 AND sum(tokens) > {_TARGET} AS oversize, list(x.session_id ORDER BY x.n) AS members,
         sha256('{{"extraction_schema_version":"2","schema_version":"1","sessions":[' || string_agg('{{"content_hash":"' || content_hash ||
           '","session_id":"' || session_id || '"}}', ',' ORDER BY x.n) || '],"target_tokens":{_TARGET}}}') AS segment_hash
  FROM {prefix}rows x ASOF JOIN {prefix}bins b ON x.grp = b.grp AND x.n >= b.start_n GROUP BY x.owner_id, x.source, b.start_n
)"""


_SEGMENT_COLUMNS = ["owner_id", "segment_hash", "active", "source", "sessions", "first_date", "last_date", "source_tokens",
                    "text_hash", "oversize"]
_SEAL = f"WITH RECURSIVE {MINED_DOCS}, {ROLLED_SQL}, {_seal_sql('s', 'rolled')}"


def _shown(rows):
    return rows.withColumn("sessions", F.size("session_versions").cast("bigint")).select(*_SEGMENT_COLUMNS)


def sealed_documents(spark, folder):
    sessions = materialize(corpus.roll_up(mined_documents(spark, folder)), "sessions")
    return sessions, segments.seal(sessions, _TARGET)


@query("segment_seal", f"""
{_SEAL}
SELECT owner_id, segment_hash, true AS active, source, sessions, first_date, last_date, source_tokens, text_hash, oversize
FROM ssegments""")
def segment_seal(spark, folder):
    return _shown(sealed_documents(spark, folder)[1])


# One session in ten is edited, and one in fifteen was not there before.
_EDITED = "CASE WHEN CAST('0x' || substr(session_id, 1, 4) AS INTEGER) % 10 = 0 THEN sha256(content_hash || '!') ELSE content_hash END"
_NEW = "CAST('0x' || substr(session_id, 1, 4) AS INTEGER) % 15 = 1"


def _draw(modulus: int):
    return F.conv(F.substring("session_id", 1, 4), 16, 10).cast("int") % modulus


def _before_and_after(spark, folder):
    now = materialize(corpus.roll_up(mined_documents(spark, folder)), "sessions")
    was = now.filter(_draw(15) != 1).withColumn("content_hash", F.when(
        _draw(10) == 0, sha256(F.concat("content_hash", F.lit("!")))).otherwise(F.col("content_hash")))
    return was, now


_SYNC = f"""
WITH RECURSIVE {MINED_DOCS}, {ROLLED_SQL},
was AS (SELECT * EXCLUDE (content_hash), {_EDITED} AS content_hash FROM rolled WHERE NOT ({_NEW})), {_seal_sql('o', 'was')},
held AS (SELECT owner_id, segment_hash, unnest(members) AS session_id FROM osegments),
stale AS (SELECT DISTINCT h.owner_id, h.segment_hash FROM held h
          LEFT JOIN rolled r USING (owner_id, session_id) LEFT JOIN was w USING (owner_id, session_id)
          WHERE r.content_hash IS DISTINCT FROM w.content_hash),
represented AS (SELECT h.owner_id, h.session_id FROM held h ANTI JOIN stale USING (owner_id, segment_hash)),
todo AS (SELECT * FROM rolled ANTI JOIN represented USING (owner_id, session_id)), {_seal_sql('f', 'todo')}"""


@query("segment_sync", f"""
{_SYNC}
SELECT o.owner_id, o.segment_hash, s.segment_hash IS NULL AS active, source, sessions, first_date, last_date, source_tokens, text_hash, oversize
FROM osegments o LEFT JOIN stale s USING (owner_id, segment_hash)
UNION ALL
SELECT owner_id, segment_hash, true, source, sessions, first_date, last_date, source_tokens, text_hash, oversize FROM fsegments""")
def segment_sync(spark, folder):
    was, now = _before_and_after(spark, folder)
    index = materialize(segments.seal(was, _TARGET), "segments")
    return _shown(segments.sync(index, now, _TARGET))


@query("stale_segments", f"{_SYNC} SELECT * FROM stale")
def stale_segments(spark, folder):
    was, now = _before_and_after(spark, folder)
    return segments.stale_segments(segments.seal(was, _TARGET), now)


@query("segment_plan", f"""
{_SEAL},
hit AS (SELECT *, substr(segment_hash, 1, 1) < '8' AS cached FROM ssegments)
SELECT owner_id, count(*) AS selected_segments, CAST(sum(source_tokens) AS BIGINT) AS selected_source_tokens,
       count(*) FILTER (cached) AS cached_segments, count(DISTINCT source || ':' || substr(first_date, 1, 7)) AS strata,
       count(*) FILTER (NOT cached) AS planned_worker_calls, CAST(1 AS BIGINT) AS planned_reducer_calls,
       count(DISTINCT source || ':' || substr(first_date, 1, 7)) >= 2 AS adequate_strata
FROM hit GROUP BY owner_id""")
def segment_plan(spark, folder):
    _, sealed = sealed_documents(spark, folder)
    sealed = materialize(sealed, "segments")
    cached = sealed.filter(F.substring("segment_hash", 1, 1) < "8")
    plan = segments.plan(sealed, cached)
    return plan.withColumn("planned_reducer_calls", F.col("planned_reducer_calls").cast("bigint"))


@query("temporal_queue", f"""
{_SEAL},
placed AS (SELECT *, row_number() OVER (PARTITION BY owner_id, source ORDER BY first_date, segment_hash) - 1 AS r,
                  count(*) OVER (PARTITION BY owner_id, source) AS n FROM ssegments)
SELECT owner_id, source, segment_hash, CASE WHEN r * 2 < n THEN r * 2 ELSE (n - 1 - r) * 2 + 1 END AS queue_position FROM placed""")
def temporal_queue_documents(spark, folder):
    _, sealed = sealed_documents(spark, folder)
    narrow = materialize(sealed.select("owner_id", "source", "first_date", "segment_hash"), "segments")
    return temporal_queue(narrow).select("owner_id", "source", "segment_hash", "queue_position")


@query("select_segments")
def select_preview(spark, folder):
    _, sealed = sealed_documents(spark, folder)
    sealed = materialize(sealed, "segments")
    return select_segments(sealed, K.STARTER_CANDIDATES[2]["segments"], 20_000).select(
        "owner_id", "source", "first_date", "segment_hash", "source_tokens")


_PREVIEW, _PREVIEW_TOKENS = 6, 20_000


@query("preview_segments", f"""
{_SEAL},
usable AS (SELECT * FROM ssegments WHERE NOT oversize AND source_tokens <= {_PREVIEW_TOKENS}),
placed AS (SELECT *, row_number() OVER (PARTITION BY owner_id, source ORDER BY first_date, segment_hash) - 1 AS r, count(*) OVER (PARTITION BY owner_id, source) AS n FROM usable),
lines AS (
  SELECT owner_id, row_number() OVER (PARTITION BY owner_id ORDER BY source) AS line, names, sizes FROM (
    SELECT owner_id, source, list(segment_hash ORDER BY q) AS names, list(source_tokens ORDER BY q) AS sizes
    FROM (SELECT *, CASE WHEN r * 2 < n THEN r * 2 ELSE (n - 1 - r) * 2 + 1 END AS q FROM placed) GROUP BY owner_id, source)),
owners AS (SELECT owner_id, count(*) AS n FROM lines GROUP BY owner_id),
visit(owner_id, line, heads, taken, spent, moved, done) AS (
  SELECT owner_id, CAST(1 AS BIGINT), list_transform(range(0, n), lambda x: CAST(1 AS BIGINT)), CAST([] AS VARCHAR[]), CAST(0 AS BIGINT), false, false FROM owners
  UNION ALL
  SELECT owner_id, CASE WHEN line = n THEN 1 ELSE line + 1 END, list_concat(list_concat(heads[1:line - 1], [coalesce(spot, len(names)) + 1]), heads[line + 1:n]),
         CASE WHEN spot IS NULL THEN taken ELSE list_append(taken, names[spot]) END, CASE WHEN spot IS NULL THEN spent ELSE CAST(spent + sizes[spot] AS BIGINT) END,
         CASE WHEN line = n THEN false ELSE moved OR spot IS NOT NULL END,
         len(taken) + CASE WHEN spot IS NULL THEN 0 ELSE 1 END >= {_PREVIEW} OR (line = n AND NOT (moved OR spot IS NOT NULL))
  FROM (SELECT v.*, o.n, l.names, l.sizes, list_filter(range(v.heads[v.line], len(l.names) + 1), lambda x: v.spent + l.sizes[x] <= {_PREVIEW_TOKENS})[1] AS spot
    FROM visit v JOIN owners o USING (owner_id) JOIN lines l ON l.owner_id = v.owner_id AND l.line = v.line WHERE NOT v.done)
)
SELECT s.owner_id, s.source, s.first_date, s.segment_hash, s.source_tokens FROM ssegments s
JOIN visit v ON v.done AND v.owner_id = s.owner_id AND list_contains(v.taken, s.segment_hash)""")
def preview_segments(spark, folder):
    """A preview whose budget leaves most segments out."""
    _, sealed = sealed_documents(spark, folder)
    sealed = materialize(sealed, "segments")
    return select_segments(sealed, _PREVIEW, _PREVIEW_TOKENS).select(
        "owner_id", "source", "first_date", "segment_hash", "source_tokens")


@query("run_segments", f"""
{_SEAL},
fresh AS (SELECT * FROM ssegments WHERE NOT oversize AND substr(segment_hash, 1, 1) >= '4'),
usable AS (SELECT * FROM fresh WHERE NOT oversize AND source_tokens <= {_PREVIEW_TOKENS}),
placed AS (SELECT *, row_number() OVER (PARTITION BY owner_id, source ORDER BY first_date, segment_hash) - 1 AS r, count(*) OVER (PARTITION BY owner_id, source) AS n FROM usable),
lines AS (
  SELECT owner_id, row_number() OVER (PARTITION BY owner_id ORDER BY source) AS line, names, sizes FROM (
    SELECT owner_id, source, list(segment_hash ORDER BY q) AS names, list(source_tokens ORDER BY q) AS sizes
    FROM (SELECT *, CASE WHEN r * 2 < n THEN r * 2 ELSE (n - 1 - r) * 2 + 1 END AS q FROM placed) GROUP BY owner_id, source)),
owners AS (SELECT owner_id, count(*) AS n FROM lines GROUP BY owner_id),
visit(owner_id, line, heads, taken, spent, moved, done) AS (
  SELECT owner_id, CAST(1 AS BIGINT), list_transform(range(0, n), lambda x: CAST(1 AS BIGINT)), CAST([] AS VARCHAR[]), CAST(0 AS BIGINT), false, false FROM owners
  UNION ALL
  SELECT owner_id, CASE WHEN line = n THEN 1 ELSE line + 1 END, list_concat(list_concat(heads[1:line - 1], [coalesce(spot, len(names)) + 1]), heads[line + 1:n]),
         CASE WHEN spot IS NULL THEN taken ELSE list_append(taken, names[spot]) END, CASE WHEN spot IS NULL THEN spent ELSE CAST(spent + sizes[spot] AS BIGINT) END,
         CASE WHEN line = n THEN false ELSE moved OR spot IS NOT NULL END,
         len(taken) + CASE WHEN spot IS NULL THEN 0 ELSE 1 END >= {_PREVIEW} OR (line = n AND NOT (moved OR spot IS NOT NULL))
  FROM (SELECT v.*, o.n, l.names, l.sizes, list_filter(range(v.heads[v.line], len(l.names) + 1), lambda x: v.spent + l.sizes[x] <= {_PREVIEW_TOKENS})[1] AS spot
    FROM visit v JOIN owners o USING (owner_id) JOIN lines l ON l.owner_id = v.owner_id AND l.line = v.line WHERE NOT v.done)
)
SELECT owner_id, segment_hash, 'retained' AS state FROM ssegments WHERE NOT oversize AND substr(segment_hash, 1, 1) < '4'
UNION ALL
SELECT f.owner_id, f.segment_hash, CASE WHEN v.owner_id IS NULL THEN 'waiting' ELSE 'work' END FROM fresh f
LEFT JOIN (SELECT owner_id, unnest(taken) AS segment_hash FROM visit WHERE done) v USING (owner_id, segment_hash)""")
def run_segments(spark, folder):
    """Segments with a report stay, some of the others are worked on now, the rest wait."""
    _, sealed = sealed_documents(spark, folder)
    sealed = materialize(sealed, "segments")
    known = sealed.filter(F.substring("segment_hash", 1, 1) < "4")
    chosen, work, _ = select_run_segments(sealed, known, _PREVIEW, _PREVIEW_TOKENS)
    key = ["owner_id", "segment_hash"]
    work = materialize(work.select(*key, F.lit("work").alias("state")), "work")
    retained = chosen.select(*key).join(work.select(*key), key, "left_anti").withColumn("state", F.lit("retained"))
    taken = materialize(retained.unionByName(work), "taken")
    rest = sealed.filter("not oversize").select(*key).join(taken.select(*key), key, "left_anti").withColumn("state", F.lit("waiting"))
    return taken.unionByName(rest)


@query("ranked_by_hash", """
SELECT o_orderpriority, sha256('o' || o_orderkey) AS id, CAST(row_number() OVER (
  PARTITION BY o_orderpriority ORDER BY o_orderstatus, sha256('o' || o_orderkey)) - 1 AS BIGINT) AS place FROM orders""")
def ranked_by_hash(spark, folder):
    rows = table(spark, folder, "orders").select(
        "o_orderpriority", "o_orderstatus", sha256(F.concat(F.lit("o"), F.col("o_orderkey").cast("string"))).alias("id"))
    return ranked(rows, ["o_orderpriority"], ["o_orderstatus", "id"],
                  hash_chunks("id", prefix=("o_orderstatus",), digits=(2, 1)), "place").drop("o_orderstatus")


@query("running_totals", """
SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
       CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) OVER w, 0) AS BIGINT) AS quantity_before,
       max(l_partkey) OVER w AS largest_part_before
FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def running_totals(spark, folder):
    rows = table(spark, folder, "lineitem").select("l_returnflag", *_ORDER, "l_quantity")
    return running(rows, ["l_returnflag"], _ORDER, _order_chunks(), sums={"quantity_before": F.col("l_quantity").cast("bigint")},
                   maxes={"largest_part_before": F.col("l_partkey")}).drop("l_quantity")

