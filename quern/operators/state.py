"""Time- and state-dependent rules over a table of events: the batch twins of the streaming operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.operators.versions import first_per_key


def window_start(ts: Column, seconds: int) -> Column:
    """Start of the tumbling window of ``seconds`` since the epoch."""
    at = F.unix_seconds(ts.cast("timestamp"))
    return F.timestamp_seconds(at - F.pmod(at, F.lit(seconds)))


def rate_limit(events: DataFrame, key: str, ts: str, seq: str, seconds: int, most: int, start: Column | None = None) -> DataFrame:
    """Verdict on each hit (T-1): refused when the window's counter exceeds ``most``; refused hits count too.

    ``start`` is the start of a hit's window, that of :func:`window_start` if not given.
    """
    rows = events.withColumn("window_start", window_start(F.col(ts), seconds) if start is None else start)
    hits = F.row_number().over(Window.partitionBy(key, "window_start").orderBy(seq))
    rows = rows.withColumn("hits", hits).withColumn("allowed", F.col("hits") <= most)
    left = F.unix_seconds("window_start") + seconds - F.unix_seconds(F.col(ts).cast("timestamp"))
    return rows.withColumn("retry_after", F.when(~F.col("allowed"), left))


def daily_cap(events: DataFrame, viewer: str, ts: str, item: str, seq: str, limit: int) -> DataFrame:
    """Verdict on each view (T-2): an item already seen that day is free, a new one counts up to the limit; refused ones are not recorded.

    The first ``limit`` distinct items of a viewer and day are the ones that
    are ever seen, so the rank of an item's first view decides.
    """
    rows = events.withColumn("day", F.to_date(F.col(ts).cast("timestamp")))
    firsts = rows.groupBy(viewer, "day", item).agg(F.min(seq).alias("__first"))
    rank = F.row_number().over(Window.partitionBy(viewer, "day").orderBy("__first"))
    seen = firsts.withColumn("__rank", rank)
    rows = rows.join(seen, [viewer, "day", item])
    return rows.withColumn("allowed", F.col("__rank") <= limit).withColumn("is_new", F.col(seq) == F.col("__first")).drop("__first", "__rank")


def views_today(events: DataFrame, viewer: str, ts: str, item: str) -> DataFrame:
    """Distinct items per viewer and day."""
    return events.groupBy(viewer, F.to_date(F.col(ts).cast("timestamp")).alias("day")).agg(F.count_distinct(item).alias("used"))


def subscription_outcomes(events: DataFrame, spark_schema: str | None = None, plans: dict[str, str] | None = None) -> DataFrame:
    """What each subscription event leads to, in arrival order (T-3, A.14).

    Columns: event_id, arrival, user_id (null if none matches), subscription,
    status, price, quantity, occurred_at, relevant. Outcomes: duplicate,
    ignored, unmatched, stale, other_subscription, unknown_price, applied:PLAN.
    The state of a user depends on which earlier events were applied, so it is
    a fold in arrival order, one user a group; duplicates are found before it.
    """
    plans = plans or {}
    first = Window.partitionBy("event_id").orderBy("arrival")
    rows = events.withColumn("__dup", F.row_number().over(first) > 1)
    plain = F.when(F.col("__dup"), "duplicate").when(~F.col("relevant"), "ignored").when(F.col("user_id").isNull(), "unmatched")
    rows = rows.withColumn("outcome", plain).drop("__dup")
    done = rows.where(F.col("outcome").isNotNull()).withColumn("plan", F.lit(None).cast("string")).withColumn("seats", F.lit(None).cast("int"))
    todo = rows.where(F.col("outcome").isNull()).drop("outcome")

    def fold(pdf):
        pdf = pdf.sort_values("arrival", kind="stable")
        state = {"at": None, "sub": None}
        outcomes, got, seats = [], [], []
        for r in pdf.itertuples():
            outcome, plan, n = apply_event(state, r.occurred_at, r.subscription, r.status, r.price, r.quantity, plans)
            outcomes.append(outcome)
            got.append(plan)
            seats.append(n)
        return pdf.assign(outcome=outcomes, plan=got, seats=seats).astype({"seats": "Int32"})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in todo.schema)
    folded = todo.groupBy("user_id").applyInPandas(fold, f"{fields}, outcome string, plan string, seats int")
    return folded.unionByName(done)


def apply_event(state: dict, occurred_at, subscription: str, status: str, price: str, quantity, plans: dict[str, str]) -> tuple[str, str | None, int | None]:
    """One event against a user's state, which it may change; shared with the stream."""
    keeps = status in ("active", "trialing", "past_due")
    if state["at"] is not None and occurred_at < state["at"]:
        return "stale", None, None
    if state["sub"] not in (None, subscription) and not keeps:
        return "other_subscription", None, None
    if keeps and price not in plans:
        return "unknown_price", None, None
    plan = plans[price] if keeps else "free"
    state["at"], state["sub"] = occurred_at, subscription if keeps else None
    return f"applied:{plan}", plan, int(quantity) if plan == "team" and quantity is not None else None


def sessions(events: DataFrame, key: str, ts: str, gap_seconds: int) -> DataFrame:
    """Sessions that slide with use: a gap of ``gap_seconds`` or more starts a new one (T-4)."""
    at = F.unix_seconds(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(key).orderBy("__at")
    rows = events.select(key, at.alias("__at"))
    rows = rows.withColumn("__new", (F.col("__at") - F.lag("__at").over(w) >= gap_seconds) | F.lag("__at").over(w).isNull())
    rows = rows.withColumn("session", F.sum(F.col("__new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "session").agg(F.timestamp_seconds(F.min("__at")).alias("started"), F.timestamp_seconds(F.max("__at")).alias("last_used"), F.timestamp_seconds(F.max("__at") + gap_seconds).alias("expires"), F.count("*").alias("uses"))


def plan_access(plan: Column, trial_ends: Column, now: Column) -> Column:
    """The plan that counts: a running trial is pro (T-5)."""
    return F.when(trial_ends > now, "pro").otherwise(F.coalesce(plan, F.lit("free")))


def can(plan: Column, matrix: dict[str, list[str]], feature: str) -> Column:
    """Whether a plan has a feature (F26); signed out is a null plan."""
    return F.coalesce(plan, F.lit("signed out")).isin(matrix.get(feature, []))


def features_for(plan: Column, matrix: dict[str, list[str]]) -> Column:
    """The features of a plan, in the matrix's order."""
    return F.array_compact(F.array(*[F.when(can(plan, matrix, f), F.lit(f)) for f in matrix]))


def two_step(attempts: DataFrame, session: str, seq: str, step: str, right: str, most: int = 5) -> DataFrame:
    """Outcome of code attempts (T-6): ``ok`` once a right code's step is newer than all accepted before; ``most`` wrong ones end the session."""
    w = Window.partitionBy(session).orderBy(seq)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = attempts.withColumn("__newest", F.max(F.when(F.col(right), F.col(step))).over(before))
    good = F.col(right) & (F.col("__newest").isNull() | (F.col(step) > F.col("__newest")))
    rows = rows.withColumn("__good", good)
    wrong = F.coalesce(F.sum((~F.col("__good")).cast("int")).over(before), F.lit(0))
    return rows.withColumn("outcome", F.when(wrong >= most, "ended").when(F.col("__good"), "ok").otherwise("wrong")).drop("__newest", "__good")


def pacing(requests: DataFrame, host: str, ready: str, delay: str, least: float = 1.0, most: float = 10.0) -> DataFrame:
    """When each request of a host may start (T-8): not before it is ready nor before the delay after the one before.

    start_n = max over i <= n of ready_i plus the delays from i to n, so a
    running maximum over shifted times does it.
    """
    wait = F.least(F.greatest(F.coalesce(F.col(delay), F.lit(0.0)), F.lit(least)), F.lit(most))
    w = Window.partitionBy(host).orderBy(ready, "__id")
    rows = requests.withColumn("__id", F.xxhash64(*requests.columns)).withColumn("__wait", wait)
    rows = rows.withColumn("__sum", F.coalesce(F.sum("__wait").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    start = F.max(F.col(ready) - F.col("__sum")).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("__sum")
    return rows.withColumn("start", start).drop("__id", "__wait", "__sum")


def fresh(cache: DataFrame, at: str, now: Column, days: int, transient: Column | None = None) -> DataFrame:
    """Cached rows young enough to be used; transient verdicts never are (T-10)."""
    rows = cache.where(F.col(at) > now - F.make_dt_interval(F.lit(days)))
    return rows.where(~F.coalesce(transient, F.lit(False))) if transient is not None else rows


def latest_answers(requests: DataFrame, keys: list[str], status: str, at: str, tie: str) -> DataFrame:
    """The latest answer of each key that is not pending."""
    return first_per_key(requests.where(F.col(status) != "pending"), keys, [F.desc(at), F.desc(tie)])
