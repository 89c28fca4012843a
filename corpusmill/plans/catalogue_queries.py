"""Catalogue, access and conversation operators over the relational tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import access, catalogue
from corpusmill.plans.registry import query
from corpusmill.session import read_table


@query(
    "source_counts",
    """WITH k AS (SELECT DISTINCT source AS source_id FROM documents UNION SELECT n_name FROM nation), c AS (SELECT source AS source_id, count(*) AS n FROM documents GROUP BY source)
        SELECT source_id, coalesce(n, 0) AS chunk_count FROM k LEFT JOIN c USING (source_id)""",
)
def source_counts(spark, sf_dir):
    """Documents per source; nations are known sources without documents."""
    docs = read_table(spark, sf_dir, "documents").withColumnRenamed("source", "source_id")
    known = read_table(spark, sf_dir, "nation").select(F.col("n_name").alias("source_id"))
    return catalogue.source_counts(docs, known)


@query(
    "folder_counts",
    """WITH f AS (SELECT 'n' || n_nationkey AS folder_id, n_name AS name FROM nation WHERE n_regionkey < 3),
        d AS (SELECT coalesce(f.folder_id, 'uncategorized') AS folder_id, count(*) AS n FROM customer LEFT JOIN f ON f.folder_id = 'n' || c_nationkey GROUP BY 1),
        b AS (SELECT folder_id, name FROM f UNION ALL SELECT 'uncategorized', 'uncategorized')
        SELECT folder_id, name, coalesce(n, 0) AS document_count, folder_id = 'uncategorized' AS "system" FROM b LEFT JOIN d USING (folder_id)""",
)
def folder_counts(spark, sf_dir):
    """Customers filed under nations; the folders of two regions do not exist."""
    folders = read_table(spark, sf_dir, "nation").filter("n_regionkey < 3").select(
        F.concat(F.lit("n"), F.col("n_nationkey")).alias("folder_id"), F.col("n_name").alias("name")
    )
    documents = read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("document_id"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("folder_id")
    )
    return catalogue.folder_counts(folders, documents)


@query(
    "latest_version",
    """SELECT o_custkey AS document_id, o_orderkey AS version_number, o_orderstatus AS status, o_totalprice AS size FROM orders
        WHERE (o_custkey, o_orderkey) IN (SELECT o_custkey, max(o_orderkey) FROM orders GROUP BY o_custkey)""",
)
def latest_version(spark, sf_dir):
    versions = read_table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("document_id"),
        F.col("o_orderkey").alias("version_number"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("size"),
    )
    return catalogue.latest_version(versions)


@query(
    "active_index_membership",
    """WITH v AS (SELECT o_custkey AS d, max(o_orderkey) AS cur FROM orders GROUP BY 1), m AS (SELECT o_custkey AS d, max(o_orderkey) AS mem FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
        SELECT c_custkey AS document_id, cur AS version_number, coalesce(mem = cur, false) AS in_active_index FROM customer LEFT JOIN v ON d = c_custkey LEFT JOIN m ON m.d = c_custkey WHERE c_acctbal >= 0""",
)
def active_index_membership(spark, sf_dir):
    """Customers as documents, their orders as versions, filled orders as index members."""
    orders = read_table(spark, sf_dir, "orders")
    versions = orders.select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("version_number"))
    current = catalogue.latest_version(versions).withColumnRenamed("version_number", "current_version_id")
    documents = (
        read_table(spark, sf_dir, "customer")
        .select(
            F.col("c_custkey").alias("document_id"),
            F.when(F.col("c_acctbal") < 0, F.lit("gone")).alias("deleted_at"),
            F.col("c_name").alias("created_at"),
        )
        .join(current, "document_id", "left")
    )
    members = catalogue.latest_version(
        orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("version_number"))
    ).select("document_id", F.col("version_number").alias("document_version_id"), F.lit("ready").alias("status"))
    return catalogue.document_list(documents, versions, members).select("document_id", "version_number", "in_active_index")


@query(
    "conversation_list",
    """SELECT conv_id AS conversation_id, max(turn) AS updated_at, count(*) AS message_count FROM conversations GROUP BY conv_id ORDER BY updated_at DESC, conversation_id LIMIT 30""",
)
def conversation_list(spark, sf_dir):
    messages = read_table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "conversation_id")
    conversations = messages.groupBy("conversation_id").agg(F.max("turn").alias("updated_at"))
    return catalogue.conversation_list(conversations, messages).select("conversation_id", "updated_at", "message_count")


@query(
    "recent_messages",
    """SELECT conv_id AS conversation_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM
        (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 4""",
)
def recent_messages(spark, sf_dir):
    messages = read_table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "conversation_id")
    out = catalogue.recent_messages(messages, 4, ("turn",))
    return out.select("conversation_id", "turn", "role", F.col("position").cast("long").alias("position"))


@query(
    "conversation_titles",
    r"""SELECT conv_id AS conversation_id, substr(trim(regexp_replace(arg_min(text, turn), '\s+', ' ', 'g')), 1, 80) AS title FROM conversations WHERE role = 'user' GROUP BY conv_id""",
)
def conversation_titles(spark, sf_dir):
    messages = read_table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("conversation_id"), "turn", "role", F.col("text").alias("content")
    )
    return catalogue.conversation_titles(messages, "turn")


ACL_SQL = """
    pr AS (SELECT c_custkey AS p, [c_mktsegment] || CASE WHEN c_acctbal > 9000 THEN ['admin'] ELSE [] END AS roles FROM customer),
    po AS (SELECT s_suppkey AS s, CASE WHEN s_acctbal < 0 THEN ['all'] WHEN s_acctbal < 5000 THEN ['BUILDING', 'MACHINERY'] ELSE ['HOUSEHOLD'] END AS roles FROM supplier WHERE s_acctbal < 8000),
    rq AS (SELECT DISTINCT o_custkey AS p, l_suppkey AS s FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""


@query(
    "acl_allowed_sources",
    f"""WITH {ACL_SQL}
        SELECT p AS principal_id, s AS source_id, list_contains(pr.roles, 'admin') OR list_contains(coalesce(po.roles, ['all']), 'all') OR len(list_intersect(pr.roles, coalesce(po.roles, ['all']))) > 0 AS allowed
        FROM rq JOIN pr USING (p) JOIN supplier ON s_suppkey = s LEFT JOIN po USING (s)""",
)
def acl_allowed_sources(spark, sf_dir):
    """Customers ask for the suppliers of their orders; policies name market segments."""
    principals = read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("principal_id"),
        F.when(F.col("c_acctbal") > 9000, F.array(F.col("c_mktsegment"), F.lit("admin"))).otherwise(F.array("c_mktsegment")).alias("roles"),
    )
    supplier = read_table(spark, sf_dir, "supplier")
    policies = supplier.filter("s_acctbal < 8000").select(
        F.col("s_suppkey").alias("source_id"),
        F.when(F.col("s_acctbal") < 0, F.array(F.lit("all")))
        .when(F.col("s_acctbal") < 5000, F.array(F.lit("BUILDING"), F.lit("MACHINERY")))
        .otherwise(F.array(F.lit("HOUSEHOLD")))
        .alias("roles"),
    )
    lines = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    requested = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(
        F.col("o_custkey").alias("principal_id"), F.col("l_suppkey").alias("source_id")
    )
    sources = supplier.select(F.col("s_suppkey").alias("source_id"))
    return access.allowed_sources(principals, sources, policies, requested)


@query(
    "source_grants",
    """SELECT DISTINCT unnest(CASE WHEN s_acctbal >= 8000 THEN ['all'] WHEN s_acctbal < 0 THEN ['all'] WHEN s_acctbal < 5000 THEN ['BUILDING', 'MACHINERY'] ELSE ['HOUSEHOLD'] END) AS role, s_suppkey AS source_id FROM supplier""",
)
def source_grants(spark, sf_dir):
    supplier = read_table(spark, sf_dir, "supplier")
    policies = supplier.filter("s_acctbal < 8000").select(
        F.col("s_suppkey").alias("source_id"),
        F.when(F.col("s_acctbal") < 0, F.array(F.lit("all")))
        .when(F.col("s_acctbal") < 5000, F.array(F.lit("BUILDING"), F.lit("MACHINERY")))
        .otherwise(F.array(F.lit("HOUSEHOLD")))
        .alias("roles"),
    )
    return access.grants(supplier.select(F.col("s_suppkey").alias("source_id")), policies)


@query(
    "authorize_requests",
    """WITH r AS (SELECT o_orderkey AS request_id, n_regionkey AS tenant, c_custkey AS u, l.l_suppkey AS kb FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
            JOIN (SELECT l_orderkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1) l ON l.l_orderkey = o_orderkey),
        k AS (SELECT s_suppkey AS kb, n_regionkey AS tenant, s_suppkey * 7 AS owner, CASE WHEN s_acctbal > 3000 THEN 'tenant' ELSE 'private' END AS vis FROM supplier JOIN nation ON n_nationkey = s_nationkey),
        j AS (SELECT request_id, r.tenant, c_acctbal, c_mktsegment, u, k.owner, k.vis FROM r JOIN customer ON c_custkey = u LEFT JOIN k ON k.kb = r.kb AND k.tenant = r.tenant)
        SELECT request_id, CASE WHEN tenant = 4 THEN 'tenant_inactive' WHEN c_acctbal < 0 THEN 'not_a_member' WHEN vis IS NULL THEN 'not_found'
            WHEN NOT (c_mktsegment = 'BUILDING' OR owner = u OR vis = 'tenant') THEN 'denied' ELSE 'granted' END AS outcome,
          tenant <> 4 AND c_acctbal >= 0 AND vis IS NOT NULL AND (c_mktsegment = 'BUILDING' OR owner = u) AS can_write FROM j""",
)
def authorize_requests(spark, sf_dir):
    """Regions as tenants, customers as members, suppliers as knowledge bases."""
    nation = read_table(spark, sf_dir, "nation")
    customer = read_table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    supplier = read_table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    tenants = read_table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("tenant_id"), (F.col("r_regionkey") != 4).alias("active"))
    users = customer.select(
        F.col("n_regionkey").alias("tenant_id"), F.col("c_name").alias("subject"), F.col("c_custkey").alias("user_id"), F.lit(True).alias("active")
    )
    memberships = customer.select(
        F.col("n_regionkey").alias("tenant_id"),
        F.col("c_custkey").alias("user_id"),
        F.when(F.col("c_mktsegment") == "BUILDING", "admin").otherwise("member").alias("role"),
        (F.col("c_acctbal") >= 0).alias("active"),
    )
    bases = supplier.select(
        F.col("n_regionkey").alias("tenant_id"),
        F.col("s_suppkey").alias("kb_id"),
        (F.col("s_suppkey") * 7).alias("owner_user_id"),
        F.when(F.col("s_acctbal") > 3000, "tenant").otherwise("private").alias("visibility"),
        F.lit(True).alias("active"),
    )
    first = read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("kb_id"))
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    requests = (
        orders.join(first, orders["o_orderkey"] == first["l_orderkey"])
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("o_orderkey").alias("request_id"),
            F.col("n_regionkey").alias("tenant_id"),
            F.col("c_name").alias("subject"),
            "kb_id",
            F.lit(False).alias("tenant_admin"),
        )
    )
    return access.authorize(requests, tenants, users, memberships, bases)


@query(
    "index_manifest_digest",
    """WITH h AS (SELECT lang, sha256(concat_ws(chr(0), doc_id, doc_id, doc_id, source, lang, sha256(text))) AS h FROM documents)
        SELECT lang AS index_version_id, count(*) AS entry_count, sha256("""
    + " || '|' || ".join(f"sum(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT))" for i in range(8))
    + """) AS digest, true AS valid FROM h GROUP BY lang""",
)
def index_manifest_digest(spark, sf_dir):
    """Manifest of the documents, one index version per language."""
    entries = read_table(spark, sf_dir, "documents").select(
        F.col("lang").alias("index_version_id"),
        F.col("doc_id").alias("point_id"),
        F.col("doc_id").alias("chunk_id"),
        F.col("doc_id").alias("chunk_record_id"),
        F.col("source").alias("document_id"),
        F.col("lang").alias("document_version_id"),
        F.sha2("text", 256).alias("content_sha256"),
    )
    return catalogue.manifest_digest(entries, ("index_version_id",))


@query(
    "publish_versions",
    """WITH c AS (SELECT s_suppkey AS kb, CAST(s_nationkey AS VARCHAR) AS act, s_suppkey % 5 AS gen FROM supplier),
        r AS (SELECT l_suppkey AS kb, CAST(max(l_orderkey) AS VARCHAR) AS target, CAST(min(l_linenumber) + 3 AS VARCHAR) AS ea, max(l_orderkey) % 5 AS eg FROM lineitem GROUP BY 1),
        j AS (SELECT c.*, target, coalesce(target IS NOT NULL AND act = ea AND gen = eg, false) AS ok FROM c LEFT JOIN r USING (kb))
        SELECT kb AS kb_id, CASE WHEN ok THEN target ELSE act END AS active_index_version_id, gen + CASE WHEN ok THEN 1 ELSE 0 END AS generation, ok AS published FROM j""",
)
def publish_versions(spark, sf_dir):
    """Compare-and-set of index versions; most expectations are stale on purpose."""
    current = read_table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("kb_id"), F.col("s_nationkey").cast("string").alias("active_index_version_id"), (F.col("s_suppkey") % 5).alias("generation")
    )
    request = read_table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("kb_id")).agg(
        F.max("l_orderkey").cast("string").alias("target"),
        (F.min("l_linenumber") + 3).cast("string").alias("expected_active"),
        (F.max("l_orderkey") % 5).alias("expected_generation"),
    )
    return catalogue.publish(current, request).select("kb_id", "active_index_version_id", "generation", "published")
