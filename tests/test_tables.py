import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import access, catalogue, graph, jobs, limiter, metrics

T0 = dt.datetime(2024, 1, 1, 12, 0, 0)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


JOBS = "job_id string, status string, last_dispatched_at timestamp, next_attempt_at timestamp, lease_expires_at timestamp, lease_owner string, attempt int, max_attempts int, created_at timestamp"


def job_table(spark, rows):
    return spark.createDataFrame(rows, JOBS)


def test_due_jobs_at_the_edges(spark):
    rows = [
        ("a", "queued", None, None, None, "", 0, 3, at(1)),
        ("b", "queued", at(-89), None, None, "", 0, 3, at(2)),
        ("c", "queued", at(-90), None, None, "", 0, 3, at(3)),
        ("d", "retry_wait", None, at(0), None, "", 1, 3, at(4)),
        ("e", "retry_wait", None, at(1), None, "", 1, 3, at(5)),
        ("f", "running", None, None, at(0), "w", 1, 3, at(6)),
        ("g", "running", None, None, at(1), "w", 1, 3, at(7)),
        ("h", "dead", None, None, at(-5), "w", 1, 3, at(8)),
    ]
    got = jobs.dispatchable(job_table(spark, rows), F.lit(T0)).collect()
    assert [r["job_id"] for r in got] == ["a", "c", "d", "f"]


def test_claims(spark):
    rows = [
        ("free", "queued", None, None, None, "", 0, 3, at(0)),
        ("held", "running", None, None, at(10), "other", 1, 3, at(0)),
        ("mine", "running", None, None, at(10), "w", 1, 3, at(0)),
        ("late", "running", None, None, at(0), "other", 1, 3, at(0)),
        ("wait", "retry_wait", None, at(1), None, "", 1, 3, at(0)),
        ("done", "succeeded", None, None, None, "", 1, 3, at(0)),
    ]
    claims = spark.createDataFrame([(r[0], "w", T0) for r in rows], "job_id string, worker_id string, at timestamp")
    got = {r["job_id"]: r for r in jobs.claim(job_table(spark, rows), claims, 10).collect()}
    assert {k for k, r in got.items() if r["claimed"]} == {"free", "mine", "late"}
    assert got["free"]["lease_expires_at"] == at(60) and got["free"]["attempt"] == 1


def test_failures_back_off_and_die(spark):
    rows = [("a", "running", None, None, at(9), "w", 1, 3, T0), ("b", "running", None, None, at(9), "w", 3, 3, T0), ("c", "running", None, None, at(9), "x", 1, 3, T0)]
    failures = spark.createDataFrame([(k, "w", T0, False) for k in "abc"], "job_id string, worker_id string, at timestamp, permanent boolean")
    got = {r["job_id"]: r for r in jobs.fail(job_table(spark, rows), failures).collect()}
    assert (got["a"]["status"], got["a"]["next_attempt_at"]) == ("retry_wait", at(30))
    assert got["b"]["status"] == "dead" and got["c"]["status"] == "running"
    delays = spark.range(1, 12).select(jobs.backoff_seconds(F.col("id").cast("int"), 60)).collect()
    assert [r[0] for r in delays] == [min(3600, 60 * 2 ** (n - 1)) for n in range(1, 12)]


def test_reservations_are_idempotent(spark):
    stored = spark.createDataFrame([("t", "k1", "p")], "tenant_id string, idempotency_key string, payload string")
    requests = spark.createDataFrame(
        [("t", "k1", "p", 1), ("t", "k2", "p", 2), ("t", "k2", "other", 3), ("u", "k1", "p", 4)], "tenant_id string, idempotency_key string, payload string, requested_at int"
    )
    got = {(r["tenant_id"], r["idempotency_key"]): (r["is_new"], r["conflict"]) for r in jobs.reserve(stored, requests).collect()}
    assert got == {("t", "k1"): (False, False), ("t", "k2"): (True, True), ("u", "k1"): (True, False)}


@pytest.mark.parametrize("target", [3, 1000])
def test_rate_limit_against_a_plain_loop(spark, target):
    random.seed(5)
    events = [(i, "hot" if random.random() < 0.6 else f"k{i % 3}", random.randrange(0, 600) * 1_000_000 + 7 * i) for i in range(300)]
    want, state = {}, {}
    for event_id, key, us in sorted(events, key=lambda e: (e[2], e[0])):
        count, ends = state.get(key, (0, None))
        if ends is None or us >= ends:
            count, ends = 0, us + 60_000_000
        count += 1
        state[key] = (count, ends)
        want[event_id] = (ends - 60_000_000, count, count <= 4)
    df = spark.createDataFrame(events, "event_id long, key string, us long")
    got = {r["event_id"]: (r["window_us"], r["nth"], r["allowed"]) for r in limiter.rate_limit(df, 4, 60, target=target).collect()}
    assert got == want


def test_order_statistics_with_a_hot_group(spark):
    random.seed(3)
    rows = [("hot", round(random.random() * 50, 1)) for _ in range(3000)] + [("small", v) for v in (1.0, 2.0, 4.0, 10.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r for r in metrics.latency_summary(df, "v", ("g",)).collect()}
    assert got["small"]["p50"] == 3.0
    hot = sorted(v for g, v in rows if g == "hot")
    for p in (0.5, 0.95, 0.99):
        at_ = (len(hot) - 1) * p
        lo, hi = hot[math.floor(at_)], hot[math.ceil(at_)]
        assert math.isclose(got["hot"][f"p{int(p * 100)}"], lo + (hi - lo) * (at_ - math.floor(at_)))
    rank = {r["g"]: r["p95"] for r in metrics.nearest_rank_percentile(df, "v", ("g",)).collect()}
    assert rank["hot"] == hot[math.ceil(0.95 * len(hot)) - 1] and rank["small"] == 10.0


def test_span_metrics(spark):
    spans = "query_id int, rank int, file_id string, start int, end int"
    retrieved = spark.createDataFrame([(1, 1, "f", 0, 10), (1, 2, "f", 5, 15), (1, 3, "g", 0, 10)], spans)
    gold = spark.createDataFrame([(1, 1, "f", 0, 15)], "query_id int, span_no int, file_id string, start int, end int")
    double = metrics.span_metrics(retrieved, gold).first()
    once = metrics.span_metrics(retrieved, gold, union=True).first()
    assert double["char_recall"] == 20 / 15 and once["char_recall"] == 1.0 and once["retrieved_chars"] == 25 and once["rank1_hit"]


def test_access(spark):
    principals = spark.createDataFrame([("p", ["hr"]), ("root", ["admin"])], "principal_id string, roles array<string>")
    sources = spark.createDataFrame([("open",), ("hr",), ("it",)], "source_id string")
    policies = spark.createDataFrame([("hr", ["hr"]), ("it", ["it"])], "source_id string, roles array<string>")
    asked = spark.createDataFrame([(p, s) for p in ("p", "root") for s in ("open", "hr", "it", "unknown")], "principal_id string, source_id string")
    got = {(r[0], r[1]): r[2] for r in access.allowed_sources(principals, sources, policies, asked).collect()}
    assert got == {("p", "open"): True, ("p", "hr"): True, ("p", "it"): False, ("root", "open"): True, ("root", "hr"): True, ("root", "it"): True}


def test_scope_fails_closed(spark):
    df = spark.createDataFrame([("t", "k", "v")], "a string, b string, c string")
    test = lambda scope: df.filter(access.in_scope(F.col("a"), F.col("b"), F.col("c"), scope)).count()
    assert test(("t", "k", "v")) == 1 and test(("t", "k", "")) == 0 and test(("x", "k", "v")) == 0
    with pytest.raises(ValueError):
        access.require_scope(("t", "k", ""))


def test_whole_request_is_denied(spark):
    requested = spark.createDataFrame([(1, "kb", "a"), (1, "kb", "b"), (2, "kb", "a")], "request_id int, kb_id string, source_id string")
    ready = spark.createDataFrame([("kb", "a")], "kb_id string, source_id string")
    assert {r["request_id"] for r in access.deny_incomplete(requested, ready).collect()} == {2}


ENTRY = "index_version_id string, point_id string, chunk_id string, chunk_record_id string, document_id string, document_version_id string, content_sha256 string"


def test_manifest_digest_ignores_order_and_finds_duplicates(spark):
    sha = "a" * 64
    rows = [("v", f"p{i}", f"c{i}", f"r{i}", "d", "dv", sha) for i in range(20)]
    one = catalogue.manifest_digest(spark.createDataFrame(rows, ENTRY), ("index_version_id",)).first()
    two = catalogue.manifest_digest(spark.createDataFrame(rows[::-1], ENTRY).repartition(7), ("index_version_id",)).first()
    bad = catalogue.manifest_digest(spark.createDataFrame(rows + [rows[0]], ENTRY), ("index_version_id",)).first()
    other = catalogue.manifest_digest(spark.createDataFrame(rows[:-1] + [("v", "x", "c19", "r19", "d", "dv", sha)], ENTRY), ("index_version_id",)).first()
    assert one["digest"] == two["digest"] and one["valid"] and not bad["valid"] and other["digest"] != one["digest"]


def test_publish_is_compare_and_set(spark):
    current = spark.createDataFrame([("a", "v1", 3), ("b", "v1", 3), ("c", None, 0)], "kb_id string, active_index_version_id string, generation int")
    request = spark.createDataFrame([("a", "v2", "v1", 3), ("b", "v2", "v1", 2), ("c", "v1", None, 0)], "kb_id string, target string, expected_active string, expected_generation int")
    got = {r["kb_id"]: (r["active_index_version_id"], r["generation"], r["published"]) for r in catalogue.publish(current, request).collect()}
    assert got == {"a": ("v2", 4, True), "b": ("v1", 3, False), "c": ("v1", 1, True)}


def test_conversations_and_memories(spark):
    memories = spark.createDataFrame([("m", 1, 1, "c1")], "content string, created_at int, updated_at int, conversation_id string")
    up = catalogue.remember(memories, spark.createDataFrame([("m", 5, 5), ("n", 6, 6)], "content string, created_at int, updated_at int"))
    assert {tuple(r) for r in up.collect()} == {("m", 1, 5), ("n", 6, 6)}
    conv = spark.createDataFrame([("c1",), ("c2",)], "conversation_id string")
    c, m, mem = catalogue.delete_conversations(conv, conv, memories, conv.filter("conversation_id = 'c1'"))
    assert c.count() == 1 and m.count() == 1 and mem.first()["conversation_id"] is None


def test_versions_tombstones_keys(spark):
    uploads = spark.createDataFrame(
        [("d", "u1", 1, 10, 5, 5, "AB", "ab", "t", "t"), ("d", "u2", 2, 10, 5, 5, "ab", "ab", "t", "t"), ("d", "u3", 11, 10, 5, 5, "ab", "ab", "t", "t"), ("e", "u4", 1, 10, 4, 5, "ab", "ab", "t", "t")],
        "document_id string, upload_id string, observed_at int, expires_at int, observed_size int, expected_size int, observed_sha256 string, expected_sha256 string, observed_mime string, expected_mime string",
    )
    versions = spark.createDataFrame([("d", 4)], "document_id string, version_number int")
    assert {r["upload_id"]: r["version_number"] for r in catalogue.next_versions(uploads, versions).collect()} == {"u1": 5, "u2": 6}
    documents = spark.createDataFrame([("d", None), ("e", 3)], "document_id string, deleted_at int")
    keys = spark.createDataFrame([("d", "k1"), ("d", "k2")], "document_id string, object_key string")
    requests = spark.createDataFrame([("d", "i", 7), ("d", "i", 9), ("e", "i", 9)], "document_id string, idempotency_key string, requested_at int")
    marked, outbox = catalogue.tombstones(documents, requests, keys)
    assert {r["document_id"]: r["deleted_at"] for r in marked.collect()} == {"d": 7, "e": 3}
    assert [(r["document_id"], r["object_keys"]) for r in outbox.collect()] == [("d", ["k1", "k2"])]
    row = spark.range(1).select(catalogue.object_key(F.lit("t"), F.lit("k"), F.lit("d"), F.lit("v"), F.lit("x.EXE"))).first()[0]
    assert row == "tenants/t/knowledge-bases/k/documents/d/versions/v/original.bin"


def test_point_ids_and_redaction(spark):
    import uuid

    df = spark.createDataFrame([("t", "k", "v", "c")], "a string, b string, c string, d string")
    assert df.select(catalogue.point_id("a", "b", "c", "d")).first()[0] == str(uuid.uuid5(uuid.NAMESPACE_URL, "t/k/v/c"))
    logged = spark.createDataFrame([({"api_key": "abcd", "n": "1"},)], "m map<string,string>").select(catalogue.redact(F.col("m"))).first()[0]
    assert logged == {"api_key": '{"redacted":true,"length":4}', "n": "1"}


def brute_two_hops(edges, supports, seeds):
    adjacency = {}
    for e, s, t, c in edges:
        adjacency.setdefault(s, []).append((e, t, c))
        adjacency.setdefault(t, []).append((e, s, c))
    scores, seen, queue = {}, set(seeds), [(s, 0) for s in seeds]
    while queue:
        node, depth = queue.pop(0)
        if depth >= 2:
            continue
        for e, target, conf in adjacency.get(node, []):
            for chunk in supports.get(e, ()):
                scores[chunk] = scores.get(chunk, 0) + conf * 1.2 / (depth + 1)
            if target not in seen:
                seen.add(target)
                queue.append((target, depth + 1))
    return {k: round(v, 9) for k, v in scores.items()}


def test_two_hop_scores(spark):
    edges = [("e1", "a", "b", 0.5), ("e2", "b", "c", 0.9), ("e3", "c", "d", 1.0), ("e4", "a", "c", 0.3)]
    supports = {"e1": ["x"], "e2": ["x", "y"], "e3": ["z"], "e4": ["y"]}
    got = graph.two_hop_scores(
        spark.createDataFrame([(1, "a")], "query_id int, entity_id string"),
        spark.createDataFrame(edges, "edge_id string, source string, target string, confidence double"),
        spark.createDataFrame([(e, c) for e, cs in supports.items() for c in cs], "edge_id string, chunk_id string"),
    )
    assert {r["chunk_id"]: round(r["score"], 9) for r in got.collect()} == brute_two_hops(edges, supports, ["a"])


def test_graph_context(spark):
    asked = spark.createDataFrame([(1, "Ann 屬於哪一派"), (2, "Ann 是什麼")], "query_id int, question string")
    entities = spark.createDataFrame([("a", "Ann", []), ("g", "Guild", [])], "entity_id string, name string, aliases array<string>")
    relations = spark.createDataFrame(
        [("r1", "a", "g", "MEMBER_OF", 0.8), ("r2", "g", "z", "USES", 0.9), ("r3", "z", "y", "MEMBER_OF", 1.0)], "relation_id string, source string, target string, type string, confidence double"
    )
    supports = spark.createDataFrame([("r1", "c1", 0), ("r2", "c2", 0), ("r3", "c1", 0), ("r3", "c3", 1)], "relation_id string, chunk_id string, position int")
    found = graph.mentions(asked, entities, "query_id", "question")
    rows = graph.graph_context(asked, relations, found, supports, 3).orderBy("query_id", "rank").collect()
    # Question 2 is a content question and gets nothing.
    assert [(r["query_id"], r["chunk_id"], round(r["score"], 6)) for r in rows] == [(1, "c1", 3.9), (1, "c3", 2.0), (1, "c2", 0.45)]
    trace = graph.relation_trace(graph.rank_relations(asked, relations, found), entities).filter("relation_id = 'r1'").first()["trace"]
    assert trace == "Ann -MEMBER_OF-> Guild"
