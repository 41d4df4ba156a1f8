"""Change application over the test tables: the table after the changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changes as C
from .registry import query

ASOF = "1996-06-15"


def flagged(t):
    return t.customer.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment", F.lit(0).alias("is_structured"))


@query(
    "c1_upsert",
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) ELSE c_name END AS c_name, CASE WHEN c_custkey % 6 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS is_structured FROM customer
    UNION ALL SELECT -c_custkey, upper(c_name), CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_acctbal + 1 END, NULL, 1 FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 = 0 AND c_custkey > 0""",
)
def _(t):
    hit = t.customer.where("c_custkey % 3 = 0")
    new = hit.select("c_custkey", F.upper("c_name").alias("c_name"), F.when(F.col("c_custkey") % 6 != 0, F.col("c_acctbal") + 1).alias("c_acctbal"))
    extra = new.where("c_custkey % 2 = 0 and c_custkey > 0").withColumn("c_custkey", -F.col("c_custkey"))
    return C.upsert(flagged(t), new.unionByName(extra), ["c_custkey"], ["c_name", "c_acctbal"], {"is_structured": 1})


@query("c2_upsert_long", "SELECT n_nationkey, x.lang, CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) || '-' || x.lang ELSE n_name END AS text FROM nation, (VALUES ('en'), ('tr')) x(lang)")
def _(t):
    old = t.nation.select("n_nationkey", F.explode(F.array(F.lit("en"), F.lit("tr"))).alias("lang"), F.col("n_name").alias("text"))
    wide = t.nation.select(F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey")).alias("n_nationkey"), F.concat(F.lower("n_name"), F.lit("-en")).alias("text_en"), F.concat(F.lower("n_name"), F.lit("-tr")).alias("text_tr"))
    return C.upsert_long(old, wide, "n_nationkey", {"text_en": "en", "text_tr": "tr"})


@query("c3_insert_ignore", "SELECT user_id, event_type, event_id FROM events WHERE user_id % 2 = 0 UNION ALL (SELECT user_id, event_type, event_id FROM events WHERE (user_id, event_type) NOT IN (SELECT user_id, event_type FROM events WHERE user_id % 2 = 0) QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1)")
def _(t):
    e = t.events.select("user_id", "event_type", "event_id")
    return C.insert_ignore(e.where("user_id % 2 = 0"), e, ["user_id", "event_type"], ["event_id"])[0]


@query("c4_update_matched", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'X' ELSE c_name END AS c_name, c_acctbal, c_mktsegment, 0 AS is_structured FROM customer")
def _(t):
    new = t.customer.where("c_custkey % 5 = 0").select("c_custkey", F.lit("X").alias("c_name")).unionByName(t.spark.createDataFrame([(-1, "nobody")], "c_custkey long, c_name string"))
    return C.update_matched(flagged(t), new, ["c_custkey"], ["c_name"])


@query("c5_patch", "SELECT c_custkey, c_name, CASE WHEN c_custkey % 7 = 0 AND c_custkey % 2 = 0 THEN 0.5 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 7 = 0 THEN 'P' ELSE c_mktsegment END AS c_mktsegment, 0 AS is_structured FROM customer")
def _(t):
    new = t.customer.where("c_custkey % 7 = 0").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, 0.5).alias("c_acctbal"), F.lit("P").alias("c_mktsegment"))
    return C.patch(flagged(t), new, "c_custkey")


@query("c5_set_flag", "SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN 1 ELSE 0 END AS is_structured FROM customer")
def _(t):
    return C.set_flag(flagged(t), t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "is_structured", 1).select("c_custkey", "is_structured")


@query("c6_soft_delete", "SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN 0 ELSE 1 END AS is_active FROM orders")
def _(t):
    return C.soft_delete(t.orders.select("o_orderkey", F.lit(1).alias("is_active")), t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("c7_cascade_delete", "SELECT o_orderkey AS k, 0 AS line FROM orders WHERE o_custkey % 3 <> 0 UNION ALL SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 3 = 0)")
def _(t):
    left = C.cascade_delete({"orders": (t.orders, "o_orderkey"), "lines": (t.lineitem, "l_orderkey")}, t.orders.where("o_custkey % 3 = 0").select("o_orderkey"))
    return left["orders"].select(F.col("o_orderkey").alias("k"), F.lit(0).alias("line")).union(left["lines"].select("l_orderkey", "l_linenumber"))


@query("c8_replace_group", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1993-01-01') UNION ALL SELECT DISTINCT l_orderkey, 1, -1.0 FROM lineitem WHERE l_shipdate < TIMESTAMP '1993-01-01'")
def _(t):
    batch = t.lineitem.where("l_shipdate < timestamp_ntz'1993-01-01'").select("l_orderkey", F.lit(1).alias("l_linenumber"), F.lit(-1.0).alias("l_quantity")).distinct()
    return C.replace_group(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity"), batch, "l_orderkey")


@query(
    "c9_upsert_task",
    """WITH s AS (SELECT CAST(user_id AS VARCHAR) AS document_id, event_type AS task_type, CAST(max(event_id) AS DOUBLE) AS u, CAST(min(event_id) AS DOUBLE) AS st FROM events GROUP BY 1, 2), b AS (SELECT CAST(user_id AS VARCHAR) AS document_id, 'click' AS task_type, CAST(user_id % 2 * 10 AS INTEGER) AS percent FROM (SELECT DISTINCT user_id FROM events) WHERE user_id % 3 = 0)
    SELECT coalesce(s.document_id, b.document_id) AS document_id, coalesce(s.task_type, b.task_type) AS task_type, CASE WHEN b.percent IS NOT NULL THEN 'Running' ELSE 'Completed' END AS status, CASE WHEN b.percent IS NOT NULL THEN 'again' ELSE 'ok' END AS message, coalesce(b.percent, 100) AS percent, CASE WHEN b.percent IS NOT NULL THEN 1e6 ELSE u END AS updated_at, CASE WHEN b.percent = 0 OR s.document_id IS NULL THEN 1e6 ELSE st END AS start_time
    FROM s FULL JOIN b ON s.document_id = b.document_id AND s.task_type = b.task_type""",
)
def _(t):
    e = t.events.withColumn("document_id", F.col("user_id").cast("string"))
    state = e.groupBy("document_id", F.col("event_type").alias("task_type")).agg(F.lit("Completed").alias("status"), F.lit("ok").alias("message"), F.lit(100).alias("percent"), F.max("event_id").cast("double").alias("updated_at"), F.min("event_id").cast("double").alias("start_time"))
    batch = e.where("user_id % 3 = 0").select("document_id", "user_id").distinct().select("document_id", F.lit("click").alias("task_type"), F.lit("Running").alias("status"), F.lit("again").alias("message"), (F.col("user_id") % 2 * 10).cast("int").alias("percent"), F.lit(1e6).alias("updated_at"))
    return C.upsert_task(state, batch)


@query("c10_remap", "SELECT event_id, CASE event_type WHEN 'click' THEN 'tap' WHEN 'view' THEN 'look' ELSE event_type END AS event_type FROM events")
def _(t):
    return C.remap(t.events.select("event_id", "event_type"), "event_type", {"click": "tap", "view": "look"})


@query("c11_deactivate_orphans", "SELECT o_orderkey AS item_id, CASE WHEN o_orderstatus = 'F' AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) THEN 0 WHEN o_orderstatus = 'O' AND o_custkey NOT IN (SELECT s_suppkey FROM supplier) THEN 0 ELSE 1 END AS is_active FROM orders")
def _(t):
    items = t.orders.select(F.col("o_orderkey").alias("item_id"), F.col("o_orderstatus").alias("parent_type"), F.col("o_custkey").alias("parent_id"), F.lit(1).alias("is_active"))
    return C.deactivate_orphans(items, {"F": (t.customer.where("c_acctbal > 0"), "c_custkey"), "O": (t.supplier, "s_suppkey")}).select("item_id", "is_active")


@query("c12_retain", f"SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '{ASOF}' - INTERVAL 90 DAY")
def _(t):
    return C.retain(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", ASOF)


@query("c13_assign_ids", "SELECT o_orderkey, 999 + row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS id FROM orders")
def _(t):
    return C.assign_ids(t.orders.select("o_orderdate", "o_orderkey"), 1000, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "id")


@query("c14_replace_owners", "SELECT l_orderkey AS item_id, 'stakeholder' AS kind, CAST(l_suppkey AS INTEGER) AS owner_id, CASE WHEN l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') THEN 0 ELSE 1 END AS is_active FROM lineitem UNION ALL SELECT o_orderkey, 'user', CAST(o_custkey AS INTEGER), 1 FROM orders WHERE o_orderstatus = 'P' AND o_custkey % 2 = 0")
def _(t):
    links = t.lineitem.select(F.col("l_orderkey").alias("item_id"), F.lit("stakeholder").alias("kind"), F.col("l_suppkey").cast("int").alias("owner_id"), F.lit(1).alias("is_active"))
    p = t.orders.where("o_orderstatus = 'P'").withColumnRenamed("o_orderkey", "item_id")
    return C.replace_owners(links, p, p.select("item_id", F.concat(F.when(F.col("o_custkey") % 2 == 0, "U-").otherwise("?-"), F.col("o_custkey").cast("string")).alias("code")))


@query("c15_add_links", "WITH l AS (SELECT l_orderkey AS item_id, l_partkey AS requires, CASE l_returnflag WHEN 'R' THEN 0 ELSE 1 END AS is_active FROM lineitem) SELECT * FROM l UNION ALL SELECT DISTINCT item_id, requires, 1 FROM l WHERE (item_id, requires) NOT IN (SELECT item_id, requires FROM l WHERE is_active = 1)")
def _(t):
    links = t.lineitem.select(F.col("l_orderkey").alias("item_id"), F.col("l_partkey").alias("requires"), F.when(F.col("l_returnflag") == "R", 0).otherwise(1).alias("is_active"))
    return C.add_links(links, links)


STATUS = "CASE l_linestatus WHEN 'F' THEN 'done' ELSE CASE l_returnflag WHEN 'N' THEN 'in_progress' ELSE 'todo' END END"


@query(
    "c16_sync_status",
    f"""WITH a AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER ({STATUS} = 'done') AS d, count(*) FILTER ({STATUS} = 'in_progress') AS b FROM lineitem GROUP BY 1)
    SELECT o_orderkey AS project_id, CASE WHEN n IS NULL THEN 'Not Started' WHEN d >= n THEN 'Completed' WHEN d > 0 OR b > 0 THEN 'Active' ELSE 'Not Started' END AS status, DATE '{ASOF}' AS updated_at FROM orders LEFT JOIN a ON o_orderkey = l_orderkey""",
)
def _(t):
    from .relational import items

    projects = t.orders.select(F.col("o_orderkey").alias("project_id"), F.col("o_orderstatus").alias("status"), F.lit("1970-01-01").cast("date").alias("updated_at"))
    return C.sync_status(projects, items(t), F.lit(ASOF).cast("date"))


@query(
    "c17_recalculate",
    f"""WITH i AS (SELECT l_orderkey, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER ({STATUS} = 'done') AS DOUBLE) AS d FROM lineitem GROUP BY 1), v AS (SELECT o_orderpriority, sum(o_totalprice) AS v FROM orders WHERE o_orderstatus IN ('F', 'P') GROUP BY 1)
    SELECT o_orderkey AS kr_id, round(CASE o_orderkey % 4 WHEN 0 THEN v.v WHEN 1 THEN round(coalesce(i.d / i.n * 100.0, 0.0) * 80.0 / 100.0, 2) ELSE -1.0 END, 2) AS achieved FROM orders o LEFT JOIN i ON o_orderkey = l_orderkey LEFT JOIN v ON v.o_orderpriority = o.o_orderpriority""",
)
def _(t):
    from .relational import items, named

    k = F.col("o_orderkey") % 4
    krs = t.orders.select(
        F.col("o_orderkey").alias("kr_id"), F.when(k == 0, "product").when(k == 1, "project").when(k == 2, "manual").otherwise("product").alias("measurement"), F.col("o_orderpriority").alias("product"),
        F.when(k == 3, "not json").otherwise('["F", "P"]').alias("statuses"), F.col("o_orderkey").alias("project_id"), F.lit(80.0).alias("target"), F.lit(-1.0).alias("achieved"),
    )
    return C.recalculate(krs, named(t.orders, product="o_orderpriority", status="o_orderstatus", amount="o_totalprice"), items(t)).select("kr_id", F.round("achieved", 2).alias("achieved"))


@query("c18_abort", "SELECT event_id, CASE WHEN event_type IN ('click', 'signup') THEN 'Aborted' ELSE event_type END AS status, CASE WHEN event_type IN ('click', 'signup') THEN 'restart' ELSE props END AS message FROM events")
def _(t):
    return C.abort(t.events.select("event_id", F.col("event_type").alias("status"), F.col("props").alias("message")), ("click", "signup"), "Aborted", "restart")


@query(
    "c19_sync_customers",
    """WITH l AS (SELECT o_custkey, CAST(round(sum(o_totalprice)) AS BIGINT) AS v FROM orders WHERE date_trunc('year', o_orderdate) = (SELECT max(date_trunc('year', o_orderdate)) FROM orders) GROUP BY 1), s AS (SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS sector FROM orders GROUP BY 1)
    SELECT c_custkey AS customer_id, CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) ELSE c_name END AS name, CASE WHEN c_custkey % 2 = 0 THEN v ELSE 0 END AS credit_limit, CASE WHEN c_custkey % 2 = 0 THEN sector ELSE c_mktsegment END AS sector FROM customer LEFT JOIN l ON l.o_custkey = c_custkey LEFT JOIN s ON s.o_custkey = c_custkey""",
)
def _(t):
    local = t.customer.select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("name"), F.lit(0).cast("long").alias("credit_limit"), F.col("c_mktsegment").alias("sector"))
    limits = t.orders.select(F.col("o_custkey").alias("customer_id"), F.date_trunc("year", "o_orderdate").alias("as_of"), F.col("o_totalprice").alias("amount"), F.col("o_orderkey").alias("line"))
    sectors = t.orders.select(F.col("o_custkey").alias("customer_id"), F.col("o_orderpriority").alias("sector"), F.col("o_orderkey").alias("line"))
    return C.sync_customers(local, local.select("customer_id", F.upper("name").alias("name")), limits, sectors, local.where("customer_id % 2 = 0"))
