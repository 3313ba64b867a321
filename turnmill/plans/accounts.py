"""Subscription events folded to entitlements, and what an account may do with them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from turnmill import constants as K
from turnmill.functions import calendar as C
from turnmill.operators.lineage import walk
from turnmill.operators.ordered import first_rows, integer_chunks, newest, ranked, running, top_rows
from turnmill.session import materialize

PROVIDER_ID = "^[A-Za-z0-9_-]{1,128}$"
ACCOUNT_ID = "^acct_[a-f0-9]{32}$"


def entitlement_state(event_type: Column, status: Column, cancels: Column) -> Column:
    """State an event leads to; null where status or cancellation flag make no sense."""
    live = status.isin("active", "trialing")
    state = (
        F.when(event_type == "subscription.revoked", "ended")
        .when(event_type == "subscription.past_due", "past_due")
        .when((event_type == "subscription.canceled") & cancels & live, status)
        .when(event_type == "subscription.canceled", "ended")
        .when(status.isin("trialing", "active", "past_due"), status)
        .when(status.isin("canceled", "unpaid"), "ended"))
    return F.when(status.isNotNull() & cancels.isNotNull(), state)


def normalize_events(raw: DataFrame, products: dict[str, str]) -> DataFrame:
    """Subscription events as entitlement changes, each with its first error.

    ``raw``: event_id, type, timestamp, received_at, data struct (id, customer_id, product_id, status, modified_at,
    current_period_end, cancel_at_period_end, external_id). ``products`` maps product ids to plan codes. Events that
    are no subscription events are dropped.
    """
    if len(set(products.values())) != len(products):
        raise ValueError("two products share a plan code")
    d = {f: F.col(f"data.{f}") for f in (
        "id", "customer_id", "product_id", "status", "modified_at", "current_period_end", "cancel_at_period_end", "external_id")}
    code = F.coalesce(*[F.when(d["product_id"] == p, F.lit(c)) for p, c in products.items()], F.lit(None))
    sent = C.utc_millis(F.col("timestamp"))
    effective = F.when(d["modified_at"].isNull(), sent).otherwise(C.utc_millis(d["modified_at"]))
    state = entitlement_state(F.col("type"), d["status"], d["cancel_at_period_end"])
    bad_id = [~F.coalesce(d[f].rlike(PROVIDER_ID), F.lit(False)) for f in ("product_id", "id", "customer_id")]
    error = (
        F.when(sent.isNull(), "timestamp")
        .when(~F.coalesce(d["external_id"].rlike(ACCOUNT_ID), F.lit(False)), "account")
        .when(bad_id[0], "product").when(code.isNull(), "product-not-allowed")
        .when(effective.isNull(), "modified-at").when(state.isNull(), "status")
        .when(bad_id[1], "subscription").when(bad_id[2], "customer")
        .when(d["current_period_end"].isNotNull() & C.utc_millis(d["current_period_end"]).isNull(), "period-end"))
    rows = raw.filter(F.col("type").isin(*K.SUBSCRIPTION_EVENTS)).withColumns({
        "state": state, "product_code": code, "effective_at": effective, "error": error})
    kept = [c for c in ("arrival",) if c in raw.columns]
    return rows.select(
        *kept, "event_id", "type", "received_at", d["external_id"].alias("account_id"), "state", "product_code",
        d["id"].alias("subscription_id"), d["customer_id"].alias("customer_id"), d["product_id"].alias("product_id"),
        "effective_at", C.utc_millis(d["current_period_end"]).alias("current_period_end"),
        F.when(F.col("state") == "past_due", C.add_days(F.col("effective_at"), K.GRACE_DAYS)).alias("grace_ends_at"),
        F.when(F.col("state") == "ended", C.add_days(F.col("effective_at"), K.RECOVERY_DAYS)).alias("recovery_ends_at"),
        "error")


def event_status(events: DataFrame, accounts: DataFrame | None = None) -> DataFrame:
    """What became of each event when it arrived: applied, stale, duplicate, unknown-account or customer-conflict.

    ``events``: account_id, event_id, customer_id, effective_at, arrival (unique integer, in order of receipt). An
    event is stale when an earlier arrival of its account has a later ``(effective_at, event_id)``: the running
    maximum decides, chunk by chunk, so one busy account needs no task of its own.
    """
    first = events.groupBy("event_id").agg(F.min("arrival").alias("first_arrival"))
    marked = events.join(first, "event_id").withColumn("is_first", F.col("arrival") == F.col("first_arrival"))
    if accounts is None:
        marked = marked.withColumn("known", F.lit(True))
    else:
        known = accounts.select("account_id").distinct().withColumn("known", F.lit(True))
        marked = marked.join(known, "account_id", "left")
    marked = materialize(marked, "events")
    fresh = F.col("is_first") & F.col("known").isNotNull()
    owners = marked.filter(fresh).groupBy("customer_id").agg(F.min_by("account_id", "arrival").alias("customer_owner"))
    owned = marked.join(owners, "customer_id", "left").withColumn("conflict", F.col("customer_owner") != F.col("account_id"))
    # Only events that count can make a later one stale; the others take part with nothing to compare.
    place = F.struct("effective_at", "event_id")
    counts = fresh & ~F.coalesce("conflict", F.lit(False))
    placed = running(materialize(owned, "events"), ["account_id"], ["arrival"], integer_chunks("arrival"),
                     maxes={"newest_before": F.when(counts, place)})
    status = (
        F.when(~F.col("is_first"), "duplicate").when(F.col("known").isNull(), "unknown-account")
        .when(F.col("conflict"), "customer-conflict")
        .when(F.col("newest_before").isNull() | (place > F.col("newest_before")), "applied").otherwise("stale"))
    return placed.withColumn("status", status).select(*events.columns, "status")


def entitlements(events: DataFrame, order: tuple[str, str] = ("effective_at", "event_id")) -> DataFrame:
    """Current row per account: the newest event by time, then id."""
    return newest(events, ["account_id"], list(order))


def account_status(accounts: DataFrame, current: DataFrame) -> DataFrame:
    """Every account with its entitlement, state ``none`` where it has none."""
    return accounts.select("account_id").join(current, "account_id", "left").fillna("none", ["state"])


def access(status: DataFrame, now: Column) -> DataFrame:
    """Whether an account may write, and whether it may still read."""
    writes = F.col("state").isin(*K.WRITE_STATES)
    recovering = F.coalesce(F.col("recovery_ends_at").try_cast("timestamp") > now, F.lit(False))
    return status.withColumns({"can_write": writes, "can_read": writes | recovering})


def unexpired(rows: DataFrame, now: Column) -> DataFrame:
    return rows.filter(F.col("expires_at") > now)


def erase(rows: DataFrame, erased: DataFrame) -> DataFrame:
    """Rows of accounts that did not ask to be erased."""
    return rows.join(erased.select("account_id").distinct(), "account_id", "left_anti")


def quota(generations: DataFrame, incoming_bytes: int = 0) -> DataFrame:
    """Rows and bytes an account stores, and whether it may add ``incoming_bytes`` more."""
    used = generations.groupBy("account_id").agg(
        F.count("*").alias("generations"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("bigint").alias("bytes"))
    fits = (F.col("generations") < K.MAX_GENERATIONS) & (F.col("bytes") + incoming_bytes <= K.MAX_ACCOUNT_BYTES)
    return used.withColumn("available", fits)


def devices(rows: DataFrame) -> DataFrame:
    """Active devices per account, the time one was last seen, and whether another may be added."""
    live = F.col("revoked_at").isNull()
    return rows.groupBy("account_id").agg(
        F.count_if(live).alias("active_devices"), F.max(F.when(live, F.col("last_seen_at"))).alias("last_seen_at")
    ).withColumn("may_add", F.col("active_devices") < K.MAX_DEVICES)


def export(generations: DataFrame, limit: int = K.EXPORT_ROWS) -> DataFrame:
    """First stored generations of each account, by time of receipt."""
    return top_rows(generations, ["account_id"], [F.col("received_at"), F.col("generation_id")], limit)


def retain_newest(rows: DataFrame, group: list[str], ident: str, keep: int = K.RETAINED_DIAGNOSTICS) -> DataFrame:
    return top_rows(rows, group, [F.desc(ident)], keep)


def within_quota(uploads: DataFrame, stored: DataFrame | None = None, most: int = K.MAX_GENERATIONS,
                 most_bytes: int = K.MAX_ACCOUNT_BYTES) -> DataFrame:
    """``uploads`` with ``accepted``: an account takes uploads, by arrival, while ``most`` generations and ``most_bytes`` hold.

    ``uploads`` have a column bytes; without it only generations are counted. ``stored``: account_id, generations and,
    where uploads have sizes, bytes it holds already. Refused uploads, and those that repeat a generation, take no room.
    """
    key = ["account_id", "generation_id"]
    if "bytes" in uploads.columns:
        return uploads.join(_fitting(uploads, stored, most, most_bytes), key)
    new = first_rows(uploads.select(*key, "arrival"), key, ["arrival"])
    placed = ranked(new, ["account_id"], ["arrival"], integer_chunks("arrival"), "place")
    held = F.lit(0)
    if stored is not None:
        placed = placed.join(stored.select("account_id", F.col("generations").alias("held")), "account_id", "left")
        held = F.coalesce("held", F.lit(0))
    room = placed.select(*key, (F.col("place") + held < most).alias("accepted"))
    return uploads.join(room, key)


def _admit(most: int, most_bytes: int):
    """Take the uploads of one account in order while both bounds hold. They are few: ``_fitting`` leaves out what cannot fit."""
    def run(rows: pa.Table) -> pa.Table:
        count, used = rows.column("held")[0].as_py(), rows.column("held_bytes")[0].as_py()
        taken = []
        order = sorted(zip(rows.column("arrival").to_pylist(), rows.column("bytes").to_pylist(), range(rows.num_rows)))
        for _, size, n in order:
            if count < most and used + size <= most_bytes:
                count, used = count + 1, used + size
                taken.append(n)
        return rows.select(["account_id", "generation_id"]).take(pa.array(taken, pa.int64()))

    return run


def _fitting(uploads: DataFrame, stored: DataFrame | None, most: int, most_bytes: int) -> DataFrame:
    """``account_id, generation_id, accepted`` under both bounds.

    Uploads of an account are put into classes by powers of two of their size. Of a class no more can fit than the places and
    the room allow; once one more has come, one of them was refused, so less than twice the class's least size is left, and
    at most one further upload fits. From there on an upload that is not smaller than all since is refused: whether the
    smaller one was refused or taken, there is no room for it. What remains is a bounded number of uploads per class, and
    falling sizes, and is taken in order by one replay per account.
    """
    key = ["account_id", "generation_id"]
    new = materialize(first_rows(uploads.select(*key, "arrival", F.coalesce("bytes", F.lit(0)).cast("bigint").alias("bytes")), key, ["arrival"]), "uploads")
    room = new.withColumns({"held": F.lit(0).cast("bigint"), "held_bytes": F.lit(0).cast("bigint")})
    if stored is not None:
        held = stored.select("account_id", F.col("generations").cast("bigint").alias("held"), F.col("bytes").cast("bigint").alias("held_bytes"))
        room = new.join(held, "account_id", "left").fillna(0, ["held", "held_bytes"])
    left, places = F.lit(most_bytes) - F.col("held_bytes"), F.lit(most) - F.col("held")
    size_class = F.when(F.col("bytes") > 0, F.length(F.conv(F.col("bytes").cast("string"), 10, 2))).otherwise(0)
    least = F.when(F.col("size_class") > 0, F.expr("shiftleft(1L, size_class - 1)"))
    fitting = room.filter((places > 0) & (F.col("bytes") <= left)).withColumn("size_class", size_class).withColumn(
        "enough", 1 + F.least(places, F.coalesce(F.floor(left / least), places)))
    placed = materialize(ranked(fitting, ["account_id", "size_class"], ["arrival"], integer_chunks("arrival"), "place"), "placed")
    early, late = placed.filter("place < enough"), placed.filter("place >= enough AND size_class > 0")
    falling = running(late, ["account_id", "size_class"], ["arrival"], integer_chunks("arrival"), maxes={"smallest": -F.col("bytes")})
    falling = falling.filter(F.col("smallest").isNull() | (-F.col("bytes") > F.col("smallest")))
    names = [*key, "arrival", "bytes", "held", "held_bytes"]
    tried = early.select(*names).unionByName(falling.select(*names))
    schema = StructType([tried.schema[c] for c in key])
    taken = tried.groupBy("account_id").applyInArrow(_admit(most, most_bytes), schema).withColumn("accepted", F.lit(True))
    return new.select(*key).join(taken, key, "left").fillna(False, ["accepted"])


def advance_heads(uploads: DataFrame, heads: DataFrame | None = None, stored: DataFrame | None = None,
                  most: int = K.MAX_GENERATIONS, most_bytes: int = K.MAX_ACCOUNT_BYTES) -> tuple[DataFrame, DataFrame]:
    """Replay uploads against each account's head: an upload moves it only if its parent is the head.

    ``uploads``: account_id, generation_id, parent_generation_id, arrival. ``heads``: where accounts stand before
    these uploads. Without a head the first root becomes it. From any head the next one is its first child to arrive
    after it, so each generation points at one successor and the moves are the path from the start. Returns the
    uploads, without repeats, with ``head_advanced``, and the heads. Uploads with a column bytes are admitted first
    (``within_quota`` with ``stored`` and the bounds); refused ones move nothing and come back with ``accepted`` false.
    """
    key = ["account_id", "generation_id"]
    everything = first_rows(uploads, key, ["arrival"])
    if "bytes" in uploads.columns:
        everything = materialize(within_quota(everything, stored, most, most_bytes), "admitted")
        stored = everything.filter("accepted")
    else:
        stored = everything
    roots = first_rows(stored.filter("parent_generation_id is null"), ["account_id"], ["arrival"]).select(*key)
    parents = stored.select(*key, F.col("arrival").alias("since"))
    if heads is not None:
        roots = roots.join(heads, "account_id", "left_anti").unionByName(heads.select(*key))
        parents = parents.join(heads.select(*key), key, "left_anti").unionByName(heads.select(
            *key, F.lit(-1).cast("bigint").alias("since")))
    parents = parents.withColumnRenamed("generation_id", "parent_generation_id")
    children = stored.filter("parent_generation_id is not null").join(parents, ["account_id", "parent_generation_id"])
    following = children.filter("arrival > since").groupBy("account_id", "parent_generation_id").agg(
        F.min_by("generation_id", "arrival").alias("next"))
    pointers = following.select(F.col("account_id").alias("owner_id"), F.col("parent_generation_id").alias("node"), "next")
    starts = roots.select(F.col("account_id").alias("owner_id"), F.col("generation_id").alias("node"))
    path = walk(pointers, starts).select(
        F.col("owner_id").alias("account_id"), F.col("node").alias("generation_id"), "steps")
    tips = path.groupBy("account_id").agg(F.max_by("generation_id", "steps").alias("generation_id"))
    moved = everything.join(path.select(*key, F.lit(True).alias("head_advanced")), key, "left").fillna(False, ["head_advanced"])
    return moved, tips
