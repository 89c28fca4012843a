"""Job, limiter, graph and report operators over the relational tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import graph, jobs, limiter, metrics
from corpusmill.plans.registry import query
from corpusmill.session import read_table


def events(spark, sf_dir):
    return read_table(spark, sf_dir, "events")


# A job per event: the event type is its state, the value (in minutes) its timing.
JOBS_SQL = """
    ev AS (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
    jb AS (SELECT event_id AS job_id, user_id, ts AS created_at, value, k,
      CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'retry_wait' WHEN 'error' THEN 'running' WHEN 'purchase' THEN 'succeeded' ELSE 'dead' END AS status,
      CASE WHEN k % 3 = 0 THEN NULL ELSE ts + to_milliseconds(CAST(round(value * 60000) AS BIGINT)) END AS last_dispatched_at,
      CASE WHEN k % 4 = 0 THEN NULL ELSE ts + to_milliseconds(CAST(round(value * 120000) AS BIGINT)) END AS next_attempt_at,
      CASE WHEN k % 5 = 0 THEN NULL ELSE ts + to_milliseconds(CAST(round(value * 90000) AS BIGINT)) END AS lease_expires_at,
      'w' || (user_id % 7) AS lease_owner, CAST(k % 6 AS INTEGER) AS attempt, 5 AS max_attempts FROM ev),
    nw AS (SELECT max(ts) AS now FROM events)"""


def job_table(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    plus = lambda per_unit: F.col("ts").cast("timestamp") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), (F.round(F.col("value") * per_unit) / 1000).cast("decimal(18,6)")
    )
    status = (
        F.when(F.col("event_type") == "view", "queued")
        .when(F.col("event_type") == "click", "retry_wait")
        .when(F.col("event_type") == "error", "running")
        .when(F.col("event_type") == "purchase", "succeeded")
        .otherwise("dead")
    )
    return events(spark, sf_dir).withColumn("k", k).select(
        F.col("event_id").alias("job_id"),
        "user_id",
        F.col("ts").cast("timestamp").alias("created_at"),
        "value",
        "k",
        status.alias("status"),
        F.when(F.col("k") % 3 != 0, plus(60000)).alias("last_dispatched_at"),
        F.when(F.col("k") % 4 != 0, plus(120000)).alias("next_attempt_at"),
        F.when(F.col("k") % 5 != 0, plus(90000)).alias("lease_expires_at"),
        F.concat(F.lit("w"), F.col("user_id") % 7).alias("lease_owner"),
        (F.col("k") % 6).cast("int").alias("attempt"),
        F.lit(5).alias("max_attempts"),
    )


def clock(spark, sf_dir):
    return events(spark, sf_dir).agg(F.max("ts").cast("timestamp").alias("now")).scalar()


@query(
    "dispatchable_jobs",
    f"""WITH {JOBS_SQL}
        SELECT job_id, status FROM jb, nw WHERE
          (status = 'queued' AND (last_dispatched_at IS NULL OR last_dispatched_at <= now - INTERVAL 90 SECOND))
          OR (status = 'retry_wait' AND (next_attempt_at IS NULL OR next_attempt_at <= now))
          OR (status = 'running' AND lease_expires_at IS NOT NULL AND lease_expires_at <= now)
        ORDER BY created_at, job_id LIMIT 100""",
)
def dispatchable_jobs(spark, sf_dir):
    table = job_table(spark, sf_dir).withColumn("now", clock(spark, sf_dir))
    return jobs.dispatchable(table, F.col("now")).select("job_id", "status")


@query(
    "due_job_counts",
    f"""WITH {JOBS_SQL},
        d AS (SELECT status, ((status = 'queued' AND (last_dispatched_at IS NULL OR last_dispatched_at <= now - INTERVAL 90 SECOND))
          OR (status = 'retry_wait' AND (next_attempt_at IS NULL OR next_attempt_at <= now))
          OR (status = 'running' AND lease_expires_at IS NOT NULL AND lease_expires_at <= now)) AS due FROM jb, nw)
        SELECT status, count(*) AS n_jobs, count(*) FILTER (WHERE due) AS n_due FROM d GROUP BY status""",
)
def due_job_counts(spark, sf_dir):
    table = job_table(spark, sf_dir).withColumn("now", clock(spark, sf_dir))
    marked = table.withColumn("due", F.coalesce(jobs.due(F.col("now")), F.lit(False)))
    return marked.groupBy("status").agg(F.count("*").alias("n_jobs"), F.sum(F.col("due").cast("long")).alias("n_due"))


@query(
    "lease_transitions",
    f"""WITH {JOBS_SQL},
        cl AS (SELECT job_id, 'w' || (k % 5) AS worker_id, created_at + to_milliseconds(CAST(round(value * 100000) AS BIGINT)) AS asked FROM jb),
        t AS (SELECT j.*, worker_id, asked, status NOT IN ('succeeded', 'dead', 'cancelled')
          AND NOT coalesce(status = 'running' AND lease_expires_at IS NOT NULL AND lease_expires_at > asked AND lease_owner <> worker_id, false)
          AND NOT coalesce(status = 'retry_wait' AND next_attempt_at IS NOT NULL AND next_attempt_at > asked, false) AS claimed FROM jb j JOIN cl USING (job_id))
        SELECT job_id, claimed, CASE WHEN claimed THEN 'running' ELSE status END AS status, attempt + CASE WHEN claimed THEN 1 ELSE 0 END AS attempt,
          CASE WHEN claimed THEN worker_id ELSE lease_owner END AS lease_owner,
          epoch_us(CASE WHEN claimed THEN asked + INTERVAL 600 SECOND ELSE lease_expires_at END) AS lease_us FROM t""",
)
def lease_transitions(spark, sf_dir):
    """One claim per job, at a time and by a worker taken from the event."""
    table = job_table(spark, sf_dir)
    claims = table.select(
        "job_id",
        F.concat(F.lit("w"), F.col("k") % 5).alias("worker_id"),
        (
            F.col("created_at")
            + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.round(F.col("value") * 100000) / 1000).cast("decimal(18,6)"))
        ).alias("at"),
    )
    return jobs.claim(table, claims).select(
        "job_id", "claimed", "status", "attempt", "lease_owner", F.unix_micros("lease_expires_at").alias("lease_us")
    )


@query(
    "retry_backoff",
    f"""WITH {JOBS_SQL}
        SELECT job_id, CASE WHEN status <> 'running' THEN status WHEN k > 90 OR attempt >= 5 THEN 'dead' ELSE 'retry_wait' END AS status,
          CASE WHEN status = 'running' AND NOT (k > 90 OR attempt >= 5) THEN epoch_us(created_at) + 1000000 * least(3600, 30 * CAST(power(2, greatest(attempt - 1, 0)) AS BIGINT)) END AS retry_us
        FROM jb WHERE status = 'running' OR status = 'queued'""",
)
def retry_backoff(spark, sf_dir):
    """Running jobs fail at their creation time; some failures are permanent."""
    table = job_table(spark, sf_dir).filter(F.col("status").isin("running", "queued"))
    failures = table.filter("status = 'running'").select(
        "job_id", F.col("lease_owner").alias("worker_id"), F.col("created_at").alias("at"), (F.col("k") > 90).alias("permanent")
    )
    failed = jobs.fail(table, failures)
    return failed.select(
        "job_id", "status", F.when((F.col("status") == "retry_wait"), F.unix_micros("next_attempt_at")).alias("retry_us")
    )


@query(
    "expired_uploads",
    """WITH s AS (SELECT event_id AS upload_id, CASE event_type WHEN 'view' THEN 'reserved' WHEN 'click' THEN 'uploading' WHEN 'error' THEN 'expired' WHEN 'signup' THEN 'verified' ELSE 'completed' END AS state,
          ts + to_milliseconds(CAST(round(value * 60000) AS BIGINT)) AS expires_at FROM events), nw AS (SELECT max(ts) AS now FROM events)
        SELECT upload_id, state FROM s, nw WHERE state IN ('reserved', 'uploading', 'uploaded', 'verified', 'expired') AND expires_at <= now - INTERVAL 300 SECOND
        ORDER BY expires_at, upload_id LIMIT 100""",
)
def expired_uploads(spark, sf_dir):
    state = (
        F.when(F.col("event_type") == "view", "reserved")
        .when(F.col("event_type") == "click", "uploading")
        .when(F.col("event_type") == "error", "expired")
        .when(F.col("event_type") == "signup", "verified")
        .otherwise("completed")
    )
    expires = F.col("ts").cast("timestamp") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), (F.round(F.col("value") * 60000) / 1000).cast("decimal(18,6)")
    )
    sessions = events(spark, sf_dir).select(F.col("event_id").alias("upload_id"), state.alias("state"), expires.alias("expires_at"))
    return jobs.expired_uploads(sessions.withColumn("now", clock(spark, sf_dir)), F.col("now")).select("upload_id", "state")


@query(
    "idempotent_reservations",
    """WITH e AS (SELECT user_id AS tenant_id, event_type AS idempotency_key, event_id, CAST(json_extract(props, '$.k') AS BIGINT) // 50 AS payload FROM events),
        f AS (SELECT tenant_id, idempotency_key, min(event_id) AS event_id, count(DISTINCT payload) AS payloads FROM e GROUP BY ALL)
        SELECT f.tenant_id, f.idempotency_key, f.event_id, s.s_suppkey IS NULL AS is_new, payloads > 1 OR (s.s_suppkey IS NOT NULL AND e.payload <> 0) AS conflict
        FROM f JOIN e USING (tenant_id, idempotency_key, event_id) LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 5000) s ON s.s_suppkey = f.tenant_id AND f.idempotency_key = 'view'""",
)
def idempotent_reservations(spark, sf_dir):
    requests = events(spark, sf_dir).select(
        F.col("user_id").alias("tenant_id"),
        F.col("event_type").alias("idempotency_key"),
        "event_id",
        F.floor(F.get_json_object("props", "$.k").cast("long") / 50).alias("payload"),
    )
    stored = read_table(spark, sf_dir, "supplier").filter("s_acctbal < 5000").select(
        F.col("s_suppkey").alias("tenant_id"), F.lit("view").alias("idempotency_key"), F.lit(0).cast("long").alias("payload")
    )
    out = jobs.reserve(stored, requests, order="event_id")
    return out.select("tenant_id", "idempotency_key", "event_id", "is_new", "conflict")


@query(
    "rate_limit_fixed_window",
    """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS us FROM events),
        w AS (SELECT user_id, min(us) AS start FROM e GROUP BY user_id
              UNION ALL
              SELECT w.user_id, (SELECT min(e.us) FROM e WHERE e.user_id = w.user_id AND e.us >= w.start + 86400000000) FROM w
              WHERE EXISTS (SELECT 1 FROM e WHERE e.user_id = w.user_id AND e.us >= w.start + 86400000000)),
        n AS (SELECT e.event_id, e.user_id, e.us, w.start, row_number() OVER (PARTITION BY e.user_id, w.start ORDER BY e.us, e.event_id) AS nth
              FROM e JOIN w ON w.user_id = e.user_id AND e.us >= w.start AND e.us < w.start + 86400000000)
        SELECT event_id, start AS window_us, nth, nth <= 3 AS allowed, greatest(0, 3 - nth) AS remaining,
          greatest(1, CAST(floor((start + 86400000000 - us) / 1000000.0 + 0.999) AS BIGINT)) AS retry_after FROM n""",
)
def rate_limit_fixed_window(spark, sf_dir):
    """Three requests per user and day, windows anchored at their first request."""
    keyed = events(spark, sf_dir).select(
        "event_id", F.col("user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us")
    )
    out = limiter.rate_limit(keyed, 3, 86400)
    return out.select("event_id", "window_us", "nth", "allowed", "remaining", "retry_after")


@query(
    "session_activity",
    """WITH e AS (SELECT user_id, ts, value, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
        s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 2 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM e)
        SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n_events, round(sum(value), 6) AS total FROM s GROUP BY user_id, sid""",
)
def session_activity(spark, sf_dir):
    """Activity sessions with a two-hour gap, as a session-window aggregate."""
    table = events(spark, sf_dir).withColumn("at", F.col("ts").cast("timestamp"))
    out = table.groupBy("user_id", F.session_window("at", "2 hours")).agg(F.count("*").alias("n_events"), F.sum("value").alias("total"))
    return out.select("user_id", F.unix_micros("session_window.start").alias("start_us"), "n_events", F.round("total", 6).alias("total"))


@query(
    "latency_percentiles",
    """SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50,
        round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type""",
)
def latency_percentiles(spark, sf_dir):
    out = metrics.latency_summary(events(spark, sf_dir), "value", ("event_type",))
    return out.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "p50", "p95", "p99")])


@query(
    "nearest_percentiles",
    """WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
        SELECT event_type, max(value) FILTER (WHERE i = CAST(round_even((n - 1) * 0.95, 0) AS BIGINT) + 1) AS p95_round,
          max(value) FILTER (WHERE i = greatest(1, CAST(ceil(0.95 * n) AS BIGINT))) AS p95_rank FROM o GROUP BY event_type""",
)
def nearest_percentiles(spark, sf_dir):
    table = events(spark, sf_dir)
    a = metrics.nearest_round_percentile(table, "value", ("event_type",), out="p95_round")
    b = metrics.nearest_rank_percentile(table, "value", ("event_type",), out="p95_rank")
    return a.join(b, "event_type")


@query(
    "stage_histogram",
    """SELECT event_type AS stage, count(*) AS n, round(sum(value / 1000.0), 6) AS total_seconds,
        count(*) FILTER (WHERE value / 1000.0 <= 0.005) AS le_0_005, count(*) FILTER (WHERE value / 1000.0 <= 0.01) AS le_0_01,
        count(*) FILTER (WHERE value / 1000.0 <= 0.025) AS le_0_025, count(*) FILTER (WHERE value / 1000.0 <= 0.05) AS le_0_05,
        count(*) FILTER (WHERE value / 1000.0 <= 0.1) AS le_0_1 FROM events GROUP BY event_type""",
)
def stage_histogram(spark, sf_dir):
    stages = events(spark, sf_dir).select(F.col("event_type").alias("stage"), F.col("value").alias("duration_ms"))
    out = metrics.stage_histogram(stages, (0.005, 0.01, 0.025, 0.05, 0.1))
    return out.withColumn("total_seconds", F.round("total_seconds", 6))


@query(
    "variant_summary",
    """SELECT lang AS dataset, source AS variant, count(*) AS questions, CAST(sum(quality) AS BIGINT) AS score, count(*) AS max_score,
        round(sum(quality) / count(*), 6) AS accuracy, count(*) FILTER (WHERE quality = 1) AS perfect_questions, count(*) FILTER (WHERE quality = 0) AS zero_questions,
        round(avg(n_chars / 1000.0), 6) AS avg_seconds FROM labels JOIN documents USING (doc_id) GROUP BY ALL""",
)
def variant_summary(spark, sf_dir):
    """Label quality as the score of each (language, source) variant."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    records = read_table(spark, sf_dir, "labels").join(docs, "doc_id").select(
        F.col("lang").alias("dataset"),
        F.col("source").alias("variant"),
        F.col("quality").alias("score"),
        F.lit(1).alias("max_score"),
        (F.col("n_chars") / 1000.0).alias("seconds"),
    )
    out = metrics.variant_summary(records, ("dataset", "variant"))
    return out.withColumn("accuracy", F.round("accuracy", 6)).withColumn("avg_seconds", F.round("avg_seconds", 6))


@query(
    "interval_union",
    """WITH RECURSIVE s AS (SELECT l_orderkey AS order_id, CAST(l_partkey AS BIGINT) AS a, CAST(l_partkey + l_quantity * 10 AS BIGINT) AS b FROM lineitem),
        o AS (SELECT order_id, a, b, max(b) OVER (PARTITION BY order_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM s WHERE b > a)
        SELECT order_id, CAST(sum(greatest(0, b - greatest(a, coalesce(r, a)))) AS BIGINT) AS covered FROM o GROUP BY order_id""",
)
def interval_union(spark, sf_dir):
    """Covered length of the key ranges of each order's lines."""
    spans = read_table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").cast("long").alias("start"),
        (F.col("l_partkey") + F.col("l_quantity") * 10).cast("long").alias("end"),
    )
    return metrics.interval_union(spans, ("order_id",))


def place_graph(spark, sf_dir):
    """Customers and suppliers live in nations, nations in regions."""
    customer, supplier, nation = (read_table(spark, sf_dir, t) for t in ("customer", "supplier", "nation"))
    name = lambda prefix, column: F.concat(F.lit(prefix), F.col(column))
    edges = (
        customer.select(name("c", "c_custkey").alias("edge_id"), name("c", "c_custkey").alias("source"), name("n", "c_nationkey").alias("target"), F.lit(0.9).alias("confidence"))
        .unionByName(supplier.select(name("s", "s_suppkey").alias("edge_id"), name("s", "s_suppkey").alias("source"), name("n", "s_nationkey").alias("target"), F.lit(0.8).alias("confidence")))
        .unionByName(nation.select(name("n", "n_nationkey").alias("edge_id"), name("n", "n_nationkey").alias("source"), name("r", "n_regionkey").alias("target"), F.lit(1.0).alias("confidence")))
    )
    supports = edges.select("edge_id", F.col("source").alias("chunk_id")).unionByName(edges.select("edge_id", F.col("target").alias("chunk_id")))
    return edges, supports


GRAPH_SQL = """
    ed AS (SELECT 'c' || c_custkey AS edge_id, 'c' || c_custkey AS s, 'n' || c_nationkey AS t, 0.9::DOUBLE AS conf FROM customer
      UNION ALL SELECT 's' || s_suppkey, 's' || s_suppkey, 'n' || s_nationkey, 0.8 FROM supplier
      UNION ALL SELECT 'n' || n_nationkey, 'n' || n_nationkey, 'r' || n_regionkey, 1.0 FROM nation),
    bi AS (SELECT edge_id, s, t, conf FROM ed UNION ALL SELECT edge_id, t, s, conf FROM ed),
    su AS (SELECT edge_id, s AS chunk_id FROM ed UNION ALL SELECT edge_id, t FROM ed),
    sd AS (SELECT n_nationkey AS query_id, 'n' || n_nationkey AS e FROM nation)"""


@query(
    "graph_bfs_2hop",
    f"""WITH {GRAPH_SQL},
        h1 AS (SELECT query_id, edge_id, t, conf * 1.2 AS w FROM sd JOIN bi ON bi.s = sd.e),
        rc AS (SELECT DISTINCT query_id, t AS e FROM h1 EXCEPT SELECT query_id, e FROM sd),
        h2 AS (SELECT query_id, edge_id, conf * (1.2 / 2) AS w FROM rc JOIN bi ON bi.s = rc.e)
        SELECT query_id, chunk_id, round(sum(w), 6) AS score FROM (SELECT query_id, edge_id, w FROM h1 UNION ALL SELECT * FROM h2) JOIN su USING (edge_id) GROUP BY ALL""",
)
def graph_bfs_2hop(spark, sf_dir):
    """Two-step expansion from every nation."""
    edges, supports = place_graph(spark, sf_dir)
    seeds = read_table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("query_id"), F.concat(F.lit("n"), F.col("n_nationkey")).alias("entity_id")
    )
    return graph.two_hop_scores(seeds, edges, supports).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@query(
    "graph_health",
    """WITH rel AS (SELECT o_orderkey, o_custkey FROM orders), sup AS (SELECT l_orderkey, l_partkey FROM lineitem)
        SELECT (SELECT count(*) FROM customer) AS entities, (SELECT count(*) FROM rel) AS relations, (SELECT count(*) FROM sup) AS supports,
          (SELECT count(*) FROM sup WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)) AS missing_supports""",
)
def graph_health(spark, sf_dir):
    """Orders as relations, lines as supports, small parts as missing chunks."""
    return graph.graph_health(
        read_table(spark, sf_dir, "orders"),
        read_table(spark, sf_dir, "customer"),
        read_table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("chunk_id")),
        read_table(spark, sf_dir, "part").filter("p_size > 5").select(F.col("p_partkey").alias("chunk_id")),
    )
