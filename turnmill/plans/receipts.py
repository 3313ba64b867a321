"""The receipt ledger, its scores, stages and packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from turnmill import constants as K
from turnmill.functions import calendar as C, identity as I, markers as M, text as T
from turnmill.operators.digest import set_digest
from turnmill.operators.ordered import integer_chunks, ranked
from turnmill.operators.packing import pack_greedy
from turnmill.operators.selection import select_stage
from turnmill.session import materialize

KEY = ["owner_id", "receipt_id"]


def ledger(messages: DataFrame) -> DataFrame:
    """One receipt per mined message, named by session, date, place and content."""
    hashed = messages.withColumn("content_hash", I.sha256(F.col("text")))
    return hashed.select(
        "owner_id", F.lit(K.RECEIPT_VERSION).alias("schema_version"),
        I.receipt_id(F.col("session_id"), F.col("date"), F.col("ordinal"), F.col("content_hash")).alias("receipt_id"),
        "session_id", "source", "date", "ordinal", "text",
        T.estimate_tokens(F.length("text")).alias("tokens"), "content_hash",
    )


def snapshot_hash(receipts: DataFrame) -> DataFrame:
    """Digest per owner that changes whenever a receipt does."""
    entry = I.canonical_json({"receipt_id": F.col("receipt_id"), "content_hash": F.col("content_hash")})
    return set_digest(receipts, ["owner_id"], entry, "corpus_snapshot_hash")


def score(receipts: DataFrame, word_boundary: bool = False) -> DataFrame:
    """Salience, signal families and domains of every receipt; ``text`` is left behind.

    Markers are tested where the text is; only hashes and short arrays go through the recurrence join. A fingerprint
    shared by much of the corpus is counted by distinct session before the shuffle and looked up with salt.
    """
    tokens = T.salience_tokens(F.col("text"))
    marked = receipts.withColumn("__tokens", tokens).withColumn("__print", F.array_join("__tokens", " "))
    given = F.col("domain_hints") if "domain_hints" in receipts.columns else None
    marked = marked.select(
        *[c for c in receipts.columns if c not in ("text", "domain_hints")],
        F.size("__tokens").alias("normalized_token_count"),
        F.coalesce(I.sha256(F.col("__print")), F.lit("")).alias("__print_hash"),
        M.base_signals(F.col("__print"), word_boundary).alias("__signals"),
        M.domain_hints(F.col("__print"), given, word_boundary).alias("domain_hints"),
    )
    # Written once without the text, so that texts are read and tokenised once though the rows are used twice.
    marked = materialize(marked, "marked")
    print_key = ["owner_id", "__print_hash"]
    sessions = marked.select(*print_key, "session_id").distinct().groupBy(*print_key).agg(
        F.count("*").cast("int").alias("recurrence_sessions"))
    joined = marked.join(sessions, print_key)
    scored = joined.withColumns({
        "salience": M.salience(F.col("__signals"), F.col("recurrence_sessions")),
        "signal_families": M.signal_families(F.col("__signals"), F.col("recurrence_sessions")),
    })
    identity = I.canonical_json({
        "schema_version": F.lit(K.SALIENCE_VERSION), "receipt_id": F.col("receipt_id"), "salience": F.col("salience"),
        "signal_families": F.col("signal_families"), "domain_hints": F.col("domain_hints"),
        "recurrence_sessions": F.col("recurrence_sessions")})
    return scored.withColumn("salience_hash", I.sha256(identity)).drop("__signals", "__print_hash")


def packets(selected: DataFrame, packet_limit: int, packet_tokens: int) -> DataFrame:
    """Pack selected receipts in order of ``position`` and describe each packet.

    ``selected`` holds the picked receipts with scores; a stage budget bounds it per owner.
    """
    binned = _bin(selected, packet_limit, packet_tokens)
    item = F.struct("position", "receipt_id", "content_hash")
    base = binned.groupBy("owner_id", "packet_no").agg(
        F.sort_array(F.collect_list(item)).alias("items"), F.sum("tokens").alias("source_tokens"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.sort_array(F.collect_set("source")).alias("sources"),
        *[F.count_if(F.array_contains("domain_hints", d)).cast("int").alias(f"__d_{d}") for d in K.DOMAINS],
        *[F.count_if(F.array_contains("signal_families", s)).cast("int").alias(f"__s_{s}") for s in K.SIGNAL_FAMILIES],
    )
    ids = F.transform("items", lambda i: i["receipt_id"])
    identity = I.canonical_json({
        "schema_version": F.lit(K.PACKET_VERSION), "receipt_ids": ids,
        "content_hashes": F.transform("items", lambda i: i["content_hash"])})
    domains = F.create_map(*[x for d in K.DOMAINS for x in (F.lit(d), F.col(f"__d_{d}"))])
    signals = F.map_filter(
        F.create_map(*[x for s in sorted(K.SIGNAL_FAMILIES) for x in (F.lit(s), F.col(f"__s_{s}"))]), lambda _, n: n > 0)
    return base.select(
        "owner_id", "packet_no", F.lit(K.PACKET_VERSION).alias("schema_version"), I.sha256(identity).alias("packet_hash"),
        "source_tokens", ids.alias("receipt_ids"), domains.alias("domain_counts"), signals.alias("signal_counts"),
        "first_date", "last_date", "sources")


def _bin(selected: DataFrame, packet_limit: int, packet_tokens: int) -> DataFrame:
    narrow = selected.select("owner_id", "position", "receipt_id", "tokens")
    packed = pack_greedy(narrow, ["owner_id"], ["position"], integer_chunks("position"), "tokens", packet_tokens)
    bins = packed.select("owner_id", "bin_start").distinct()
    numbered = ranked(bins, ["owner_id"], ["bin_start"], integer_chunks("bin_start", packet_tokens), "packet_no")
    kept = packed.join(numbered.filter(F.col("packet_no") < packet_limit), ["owner_id", "bin_start"])
    return selected.join(kept.select(*KEY, "packet_no"), KEY)


def missing_receipts(packet_rows: DataFrame, receipts: DataFrame) -> DataFrame:
    """Receipt ids a packet names but the ledger lacks."""
    named = packet_rows.select("owner_id", "packet_hash", F.explode("receipt_ids").alias("receipt_id"))
    return named.join(receipts.select(*KEY), KEY, "left_anti")


def hydrate_packets(packet_rows: DataFrame, receipts: DataFrame) -> DataFrame:
    """Receipts of each packet in packet order."""
    named = packet_rows.select(
        "owner_id", "packet_hash", F.posexplode("receipt_ids").alias("place", "receipt_id"))
    return named.join(receipts, KEY)


def render_packets(packet_rows: DataFrame, receipts: DataFrame) -> DataFrame:
    """Packet as text: a header line per receipt, then its words."""
    header = F.format_string("===== receipt:%s session:%s source:%s date:%s =====\n%s",
                             "receipt_id", "session_id", "source", "date", "text")
    rows = hydrate_packets(packet_rows, receipts).groupBy("owner_id", "packet_hash").agg(
        F.sort_array(F.collect_list(F.struct("place", header.alias("section")))).alias("parts"))
    return rows.select("owner_id", "packet_hash", F.concat(
        F.array_join(F.transform("parts", lambda p: p["section"]), "\n\n"), F.lit("\n")).alias("text"))


def stage_plan(scored: DataFrame, stage: str = "A", excluded: DataFrame | None = None):
    """Selected receipts and packets of a stage."""
    config = K.STAGES[stage]
    picked = select_stage(scored, config["source_tokens"], config["packet_tokens"], excluded)
    selected = scored.join(picked.select(*KEY, "position"), KEY)
    return selected, packets(selected, config["packets"], config["packet_tokens"])


def stage_summary(selected: DataFrame, packet_rows: DataFrame, receipts: DataFrame, stage: str = "A") -> DataFrame:
    """The plan a person approves: budgets used, coverage and hashes."""
    picked = selected.groupBy("owner_id").agg(
        F.sum("tokens").alias("selected_source_tokens"), F.count("*").alias("selected_receipts"),
        F.sort_array(F.collect_set("source")).alias("sources"),
        F.coalesce(F.min(C.known(F.col("date"))), F.lit(C.UNDATED)).alias("first_date"),
        F.coalesce(F.max(C.known(F.col("date"))), F.lit(C.UNDATED)).alias("last_date"))
    calls = packet_rows.groupBy("owner_id").agg(
        F.count("*").alias("planned_scout_calls"),
        F.transform(F.sort_array(F.collect_list(F.struct("packet_no", "packet_hash"))),
                    lambda p: p["packet_hash"]).alias("packet_hashes"))
    plan = picked.join(calls, "owner_id").join(snapshot_hash(receipts), "owner_id").withColumns({
        "stage": F.lit(stage), "planned_domain_reducer_calls": F.lit(len(K.DOMAINS)),
        "planned_domains": F.array(*[F.lit(d) for d in sorted(K.DOMAINS)])})
    return plan.withColumn("plan_hash", I.sha256(I.canonical_json({c: F.col(c) for c in plan.columns})))


def next_stage(scored: DataFrame, first_selected: DataFrame, drafts: DataFrame):
    """Stage B: the frozen ledger again, domains that need it only, stage A receipts left out.

    ``drafts``: owner_id, domain and ``needs_deepening`` for every domain of a finished stage A.
    """
    weak = drafts.filter("needs_deepening").groupBy("owner_id").agg(
        F.sort_array(F.collect_set("domain")).alias("planned_domains"))
    eligible = scored.join(weak, ["owner_id"]).filter(
        F.arrays_overlap("domain_hints", "planned_domains"))
    selected, packet_rows = stage_plan(eligible.drop("planned_domains"), "B", first_selected)
    return weak, selected, packet_rows


def needs_deepening(status: Column, rules: Column, evidence: Column, sessions: Column, strata: Column,
                    contradictions: Column) -> Column:
    """Whether a domain draft is too thin to stand."""
    def below(value, bound):
        return F.coalesce(value, F.lit(0)) < bound
    weak = below(rules, 1) | below(evidence, 2) | below(sessions, 2) | below(strata, 2)
    return (F.coalesce(status, F.lit("")) != "active") | weak | (F.coalesce(contradictions, F.lit(0)) > 0)

