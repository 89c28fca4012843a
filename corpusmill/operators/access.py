"""Access policies, scopes and authorization as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ADMIN_ROLE = "admin"
EVERYONE_ROLE = "all"


def allowed_sources(principals: DataFrame, sources: DataFrame, policies: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """``principal_id, source_id, allowed`` for every candidate source.

    ``principals(principal_id, roles array)``, ``sources(source_id)``,
    ``policies(source_id, roles array)``. A source without policy is open to all.
    With ``requested(principal_id, source_id)`` only those are judged, and unknown
    ids vanish. Candidates meet principals through the roles, not by a product:
    open sources and admins are the only unrestricted parts and are tagged.
    """
    known = sources.select("source_id").distinct()
    ruled = known.join(policies.select("source_id", "roles"), "source_id", "left").withColumn(
        "roles", F.coalesce("roles", F.array(F.lit(EVERYONE_ROLE)))
    )
    if requested is None:
        raise ValueError("give the requested pairs, or use grants() for the unrestricted form")
    pairs = requested.select("principal_id", "source_id").distinct().join(ruled.withColumnRenamed("roles", "policy_roles"), "source_id")
    judged = pairs.join(principals.select("principal_id", "roles"), "principal_id")
    allowed = (
        F.array_contains("roles", ADMIN_ROLE)
        | F.array_contains("policy_roles", EVERYONE_ROLE)
        | F.arrays_overlap("roles", "policy_roles")
    )
    return judged.select("principal_id", "source_id", allowed.alias("allowed"))


def grants(sources: DataFrame, policies: DataFrame) -> DataFrame:
    """``role, source_id``: one row per role a source is open to (``all`` for everyone).

    A search joins a principal's roles plus ``all`` with this table, so the pairs
    of principals and sources are never written out.
    """
    ruled = sources.select("source_id").distinct().join(policies.select("source_id", "roles"), "source_id", "left")
    return ruled.select(F.explode(F.coalesce("roles", F.array(F.lit(EVERYONE_ROLE)))).alias("role"), "source_id").distinct()


def last_policy(changes: DataFrame) -> DataFrame:
    """Replaying policy changes ``(source_id, roles, version)``: the last write wins."""
    return changes.groupBy("source_id").agg(F.max_by("roles", "version").alias("roles"))


def in_scope(tenant: Column, kb: Column, index_version: Column, scope: tuple[str, str, str]) -> Column:
    """Tenant, knowledge base and index version agree; no version means no rows."""
    if not scope[2]:
        return F.lit(False)
    return (tenant == scope[0]) & (kb == scope[1]) & (index_version == scope[2])


def require_scope(scope: tuple[str, str, str]) -> None:
    if not all(scope):
        raise ValueError("reads and writes need tenant, knowledge base and index version")


def may_read(role: Column, tenant_admin: Column, owner: Column, user: Column, visibility: Column) -> Column:
    return role.isin("owner", "admin") | tenant_admin | (owner == user) | (visibility == "tenant")


def authorize(requests: DataFrame, tenants: DataFrame, users: DataFrame, memberships: DataFrame, bases: DataFrame) -> DataFrame:
    """Outcome per request ``(request_id, tenant_id, subject, kb_id, tenant_admin)``.

    Checks run in a fixed order and the first that fails names the outcome.
    """
    live = lambda df: df.filter("active")
    r = requests.join(live(tenants).select("tenant_id", F.lit(True).alias("_t")), "tenant_id", "left")
    r = r.join(live(users).select("tenant_id", "subject", "user_id"), ["tenant_id", "subject"], "left")
    r = r.join(live(memberships).select("tenant_id", "user_id", "role"), ["tenant_id", "user_id"], "left")
    r = r.join(live(bases).select("tenant_id", "kb_id", "owner_user_id", "visibility", F.lit(True).alias("_k")), ["tenant_id", "kb_id"], "left")
    readable = may_read(F.col("role"), F.col("tenant_admin"), F.col("owner_user_id"), F.col("user_id"), F.col("visibility"))
    writable = F.col("role").isin("owner", "admin") | F.col("tenant_admin") | (F.col("owner_user_id") == F.col("user_id"))
    outcome = (
        F.when(F.col("_t").isNull(), "tenant_inactive")
        .when(F.col("user_id").isNull() | F.col("role").isNull(), "not_a_member")
        .when(F.col("_k").isNull(), "not_found")
        .when(~F.coalesce(readable, F.lit(False)), "denied")
        .otherwise("granted")
    )
    return r.select("request_id", outcome.alias("outcome"), ((outcome == "granted") & F.coalesce(writable, F.lit(False))).alias("can_write"))


def ready_sources(documents: DataFrame, members: DataFrame, index_versions: DataFrame) -> DataFrame:
    """Sources whose current version is a ready member of the ready active index."""
    active = index_versions.filter("status = 'ready' AND is_active").select("tenant_id", "kb_id", "index_version_id")
    ready = members.filter("status = 'ready'").join(active, ["tenant_id", "kb_id", "index_version_id"])
    docs = documents.filter("status = 'ready' AND deleted_at IS NULL").withColumnRenamed("current_version_id", "document_version_id")
    return docs.join(
        ready.select("tenant_id", "kb_id", "document_id", "document_version_id"), ["tenant_id", "kb_id", "document_id", "document_version_id"]
    ).select("tenant_id", "kb_id", "source_id", "document_id")


def deny_incomplete(requested: DataFrame, ready: DataFrame) -> DataFrame:
    """A request naming any source that is not ready is denied as a whole."""
    missing = requested.join(ready.select("kb_id", "source_id").distinct(), ["kb_id", "source_id"], "left_anti").select("request_id").distinct()
    return requested.join(missing, "request_id", "left_anti")
