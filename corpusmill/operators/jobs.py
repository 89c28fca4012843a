"""Job tables: due jobs, lease transitions, retries and expiry.

A job table is a DataFrame and a transition is a projection of it; batches of
commands are applied in one join. The streaming package holds the stateful
form of the same rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TERMINAL = ("succeeded", "dead", "cancelled")
CLEANABLE = ("reserved", "uploading", "uploaded", "verified", "expired")


def _seconds(value: Column | int) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), value.cast("decimal(18,6)") if isinstance(value, Column) else F.lit(value).cast("decimal(18,6)"))


def due(now: Column, redispatch_seconds: int = 90) -> Column:
    """Queued and not (recently) dispatched, retry time reached, or lease run out."""
    stale = now - _seconds(max(30, int(redispatch_seconds)))
    queued = (F.col("status") == "queued") & (F.col("last_dispatched_at").isNull() | (F.col("last_dispatched_at") <= stale))
    retry = (F.col("status") == "retry_wait") & (F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= now))
    lost = (F.col("status") == "running") & F.col("lease_expires_at").isNotNull() & (F.col("lease_expires_at") <= now)
    return queued | retry | lost


def dispatchable(jobs: DataFrame, now: Column, limit: int = 100, redispatch_seconds: int = 90) -> DataFrame:
    """Oldest due jobs (a top-k, not a sort of the table)."""
    return jobs.filter(due(now, redispatch_seconds)).orderBy("created_at", "job_id").limit(max(1, int(limit)))


def claimable(now: Column, worker: Column) -> Column:
    held = (F.col("status") == "running") & F.col("lease_expires_at").isNotNull() & (F.col("lease_expires_at") > now) & (F.col("lease_owner") != worker)
    waiting = (F.col("status") == "retry_wait") & F.col("next_attempt_at").isNotNull() & (F.col("next_attempt_at") > now)
    return ~F.col("status").isin(*TERMINAL) & ~F.coalesce(held, F.lit(False)) & ~F.coalesce(waiting, F.lit(False))


def claim(jobs: DataFrame, claims: DataFrame, lease_seconds: int = 600) -> DataFrame:
    """Apply one claim ``(job_id, worker_id, at)`` per job; refused claims change nothing.

    With several claims for one job the earliest is tried (worker id breaks ties).
    """
    first = claims.groupBy("job_id").agg(F.min_by(F.struct("worker_id", "at"), F.struct("at", "worker_id")).alias("c"))
    j = jobs.join(first, "job_id", "left")
    ok = F.col("c").isNotNull() & claimable(F.col("c.at"), F.col("c.worker_id"))
    j = j.withColumn("claimed", F.coalesce(ok, F.lit(False)))
    return (
        j.withColumn("status", F.when(F.col("claimed"), "running").otherwise(F.col("status")))
        .withColumn("attempt", F.col("attempt") + F.col("claimed").cast("int"))
        .withColumn("lease_owner", F.when(F.col("claimed"), F.col("c.worker_id")).otherwise(F.col("lease_owner")))
        .withColumn(
            "lease_expires_at",
            F.when(F.col("claimed"), F.col("c.at") + _seconds(max(60, int(lease_seconds)))).otherwise(F.col("lease_expires_at")),
        )
        .drop("c")
    )


def heartbeat(jobs: DataFrame, beats: DataFrame, lease_seconds: int = 600) -> DataFrame:
    """Extend the lease of a running job for its own worker only; ``lost`` marks others."""
    last = beats.groupBy("job_id").agg(F.max_by(F.struct("worker_id", "at"), "at").alias("b"))
    j = jobs.join(last, "job_id", "left")
    ok = (F.col("status") == "running") & (F.col("lease_owner") == F.col("b.worker_id"))
    j = j.withColumn("lost", F.col("b").isNotNull() & ~F.coalesce(ok, F.lit(False)))
    return j.withColumn(
        "lease_expires_at",
        F.when(F.coalesce(ok, F.lit(False)), F.col("b.at") + _seconds(max(60, int(lease_seconds)))).otherwise(F.col("lease_expires_at")),
    ).drop("b")


def backoff_seconds(attempt: Column, base: int = 30, cap: int = 3600) -> Column:
    """``min(cap, base * 2^(attempt - 1))``."""
    return F.least(F.lit(cap), (F.lit(base) * F.pow(F.lit(2.0), F.least(F.greatest(attempt - 1, F.lit(0)), F.lit(30)))).cast("long").cast("int"))


def fail(jobs: DataFrame, failures: DataFrame, base_delay: int = 30) -> DataFrame:
    """Apply failures ``(job_id, worker_id, at, permanent)``: dead or retry with backoff.

    A published index build (``published``) counts as succeeded instead.
    """
    last = failures.groupBy("job_id").agg(F.max_by(F.struct("worker_id", "at", "permanent"), "at").alias("f"))
    j = jobs.join(last, "job_id", "left")
    mine = F.coalesce(F.col("f").isNotNull() & (F.col("lease_owner") == F.col("f.worker_id")), F.lit(False))
    final = F.col("f.permanent") | (F.col("attempt") >= F.col("max_attempts"))
    done = F.coalesce(F.col("published"), F.lit(False)) if "published" in jobs.columns else F.lit(False)
    j = j.withColumn("_mine", mine).withColumn(
        "_status", F.when(done, "succeeded").when(final, "dead").otherwise("retry_wait")
    )
    retry_at = F.col("f.at") + _seconds(backoff_seconds(F.col("attempt"), base_delay))
    return (
        j.withColumn("status", F.when(F.col("_mine"), F.col("_status")).otherwise(F.col("status")))
        .withColumn("next_attempt_at", F.when(F.col("_mine"), F.when(F.col("_status") == "retry_wait", retry_at)).otherwise(F.col("next_attempt_at")))
        .withColumn("lease_owner", F.when(F.col("_mine"), F.lit("")).otherwise(F.col("lease_owner")))
        .withColumn("lease_expires_at", F.when(~F.col("_mine"), F.col("lease_expires_at")))
        .drop("f", "_mine", "_status")
    )


def complete(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Finish running jobs for the worker that holds the lease."""
    j = jobs.join(results.select("job_id", F.col("worker_id").alias("_w")).distinct(), "job_id", "left")
    ok = F.coalesce((F.col("status") == "running") & (F.col("lease_owner") == F.col("_w")), F.lit(False))
    return j.withColumn("status", F.when(ok, "succeeded").otherwise(F.col("status"))).withColumn(
        "lease_owner", F.when(ok, F.lit("")).otherwise(F.col("lease_owner"))
    ).drop("_w")


def quarantine(jobs: DataFrame, findings: DataFrame) -> DataFrame:
    """Jobs whose document carries injected instructions die with their findings."""
    found = findings.groupBy("job_id").agg(F.array_sort(F.collect_set(F.substring("finding", 1, 80))).alias("findings"))
    j = jobs.join(found, "job_id", "left")
    hit = F.size(F.coalesce("findings", F.array().cast("array<string>"))) > 0
    return j.withColumn("status", F.when(hit, "dead").otherwise(F.col("status"))).withColumn(
        "stage", F.when(hit, "quarantined").otherwise(F.col("stage") if "stage" in jobs.columns else F.lit(None))
    )


def reserve(existing: DataFrame, requests: DataFrame, keys: tuple[str, ...] = ("tenant_id", "idempotency_key"), order: str = "requested_at") -> DataFrame:
    """Idempotent reservations: a key seen before (stored or earlier in the batch) is not new.

    ``conflict`` marks a repeated key with another payload.
    """
    rest = [c for c in requests.columns if c not in keys]
    first = requests.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), order).alias("v"), F.countDistinct("payload").alias("_payloads")
    )
    stored = existing.select(*keys, F.col("payload").alias("_stored"))
    j = first.join(stored, list(keys), "left")
    return j.select(
        *keys,
        "v.*",
        F.col("_stored").isNull().alias("is_new"),
        ((F.col("_payloads") > 1) | (F.col("_stored").isNotNull() & (F.col("_stored") != F.col("v.payload")))).alias("conflict"),
    )


def expired_uploads(sessions: DataFrame, now: Column, limit: int = 100, grace_seconds: int = 300) -> DataFrame:
    """Oldest open upload sessions past their expiry plus grace."""
    cutoff = now - _seconds(max(0, int(grace_seconds)))
    return (
        sessions.filter(F.col("state").isin(*CLEANABLE) & (F.col("expires_at") <= cutoff))
        .orderBy("expires_at", "upload_id")
        .limit(max(1, int(limit)))
    )
