"""Filters, joins, aggregates, positions and sets over the star schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import aggregates as A
from ..operators import filters as P
from ..operators import joins as J
from ..operators import position as W
from ..operators.durable import new_path
from ..operators.paging import build_pages, page_count, seek_page
from ..sources import feeds as S
from .registry import query

ASOF = "1996-06-15"


def named(df, **names):
    """Columns under new names: new=old."""
    return df.select(*[F.col(o).alias(n) for n, o in names.items()])


def customers(t):
    return named(t.customer, customer_id="c_custkey", customer="c_name")


def headers(t):
    return named(t.orders, deal_id="o_orderkey", customer_id="o_custkey", expected="o_orderdate")


def deals(t):
    return named(t.lineitem, deal_id="l_orderkey", line="l_linenumber", product_id="l_partkey", amount="l_extendedprice")


def products(t):
    return named(t.part, product_id="p_partkey", product="p_name")


STATUS = "CASE l_linestatus WHEN 'F' THEN 'done' ELSE CASE l_returnflag WHEN 'N' THEN 'in_progress' ELSE 'todo' END END"


def items(t):
    """Work items: the lines of an order."""
    return t.lineitem.select(
        F.col("l_orderkey").alias("project_id"), F.col("l_linenumber").alias("line"),
        F.when(F.col("l_linestatus") == "F", "done").when(F.col("l_returnflag") == "N", "in_progress").otherwise("todo").alias("status"),
    )


DEALS = """SELECT l.l_orderkey AS deal_id, l.l_linenumber AS line, c.c_name AS customer, p.p_name AS product, l.l_extendedprice AS amount, o.o_orderdate AS expected
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN part p ON l.l_partkey = p.p_partkey"""
DEAL_COLUMNS = ["deal_id", "line", "customer", "product", "amount", "expected"]


@query("s1_table_scan", "SELECT * FROM supplier")
def _(t):
    return S.table(t.spark, t.folder, "supplier")


S.define_view("customers_by_segment", "SELECT c_custkey, c_name, c_acctbal FROM {customer} WHERE c_mktsegment = :segment AND c_acctbal >= :low")


@query("s2_named_view", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 100")
def _(t):
    return S.view(t.spark, "customers_by_segment", {"customer": t.customer}, segment="BUILDING", low=100)


@query("s3_rate_json", "SELECT CAST(ts AS DATE) AS effective_date, 'SOFR_ON' AS rate_type, value AS rate_value FROM events WHERE event_id % 3 = 0 AND value IS NOT NULL")
def _(t):
    rate = F.struct(F.when(F.col("event_id") % 3 == 0, F.col("ts").cast("date").cast("string")).alias("effectiveDate"), F.col("value").alias("percentRate"))
    return S.read_rate_json(t.events.select(F.to_json(F.struct(F.array(rate).alias("refRates"))).alias("payload")), "payload", "SOFR_ON")


@query(
    "s4_melt_measures",
    """SELECT l_orderkey, l_linenumber, u.rate_type, u.rate_value FROM lineitem, LATERAL (VALUES ('PRICE', l_extendedprice), ('DISCOUNT', nullif(l_discount, 0)), ('TAX', l_tax), ('QTY', l_quantity)) u(rate_type, rate_value) WHERE u.rate_value IS NOT NULL""",
)
def _(t):
    df = t.lineitem.withColumn("l_discount", F.nullif("l_discount", F.lit(0.0)))
    return S.melt_measures(df, ["l_orderkey", "l_linenumber"], {"l_extendedprice": "PRICE", "l_discount": "DISCOUNT", "l_tax": "TAX", "l_quantity": "QTY"})


@query(
    "s5_rate_csv",
    """WITH n AS (SELECT o_custkey % 50 AS series, o_orderkey, CAST(o_orderdate AS DATE) AS d, round(o_totalprice, 2) AS v, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey DESC) AS rn FROM orders WHERE o_orderkey % 11 <> 0)
    SELECT series, d AS effective_date, 'EURIBOR' AS rate_type, CAST(v AS DOUBLE) AS rate_value FROM n WHERE rn <= 40 AND o_orderkey % 7 <> 0""",
)
def _(t):
    value = F.when(F.col("o_orderkey") % 7 == 0, ".").otherwise(F.replace(F.round("o_totalprice", 2).cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(",")))
    line = F.when(F.col("o_orderkey") % 11 == 0, "# remark").otherwise(F.concat(F.col("o_orderdate").cast("date").cast("string"), F.lit(";"), value))
    return S.read_rate_csv(t.orders.select((F.col("o_custkey") % 50).alias("series"), "o_orderkey", line.alias("line")), "line", "EURIBOR", "o_orderkey", "series")


@query(
    "s6_expand_indicators",
    """WITH m AS (SELECT strftime(l_shipdate, '%Y-%m') AS period, count(*) AS lines, CAST(sum(l_linenumber) AS BIGINT) AS numbers FROM lineitem GROUP BY 1)
    SELECT x.code, x.name, period, x.value, 'count' AS unit, 'activity' AS category FROM m, LATERAL (VALUES ('L1', 'Lines', lines), ('L2', 'Numbers', numbers)) x(code, name, value)""",
)
def _(t):
    wide = t.lineitem.groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("period")).agg(F.count(F.lit(1)).alias("lines"), F.sum("l_linenumber").alias("numbers"))
    meta = t.spark.createDataFrame([("lines", "L1", "Lines", "count", "activity"), ("numbers", "L2", "Numbers", "count", "activity")], "measure string, code string, name string, unit string, category string")
    return S.expand_indicators(wide, "period", meta).drop("raw")


def html_body(c: str) -> str:
    from .scalars import html_text

    return html_text(c)


PRINTED = "regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g')"


@query(
    "s7_read_feed",
    f"""WITH d AS (SELECT source, doc_id // 25 AS feed, doc_id, row_number() OVER (PARTITION BY source, doc_id // 25 ORDER BY doc_id) - 1 AS p, {PRINTED} AS t FROM documents),
    x AS (SELECT *, coalesce(nullif(trim(substr(t, 1, 40), chr(32) || chr(9) || chr(10) || chr(13)), ''), 'Untitled') AS title, {html_body("'<p>' || substr(t, 1, 200) || '</p>'")} AS b FROM d WHERE p < 10)
    SELECT source || '/' || feed AS feed, CAST(p AS INTEGER) AS position, title, 'http://x.example/' || doc_id AS url, coalesce(nullif(b, ''), title) AS body FROM x""",
)
def _(t):
    esc = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    printed = t.documents.withColumn("text", F.regexp_replace("text", r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""))
    item = F.concat(F.lit("<item><title>"), esc(F.substring("text", 1, 40)), F.lit("</title><link>http://x.example/"), F.col("doc_id").cast("string"), F.lit("</link><description>"), esc(F.concat(F.lit("<p>"), F.substring("text", 1, 200), F.lit("</p>"))), F.lit("</description></item>"))
    feed = F.concat_ws("/", "source", F.floor(F.col("doc_id") / 25).cast("string"))
    feeds = printed.groupBy(feed.alias("feed")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", item.alias("i")))), lambda x: x["i"]), "").alias("items"))
    return S.read_feed(feeds.select("feed", F.concat(F.lit("<rss><channel>"), "items", F.lit("</channel></rss>")).alias("xml")), "xml", "feed")


@query("s9_decode_vector", "SELECT vec_id, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 3) AS total FROM embeddings")
def _(t):
    v = S.decode_vector(F.to_json("embedding"))
    return t.embeddings.select("vec_id", F.size(v).cast("long").alias("n"), F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double")), 3).alias("total"))


@query("s12_sparse_record", "SELECT event_id, CAST(NULL AS VARCHAR) AS model, value, CAST(user_id AS INTEGER) AS user_id FROM events")
def _(t):
    return S.conform_sparse(t.events, T.StructType.fromDDL("event_id bigint, model string, value double, user_id int"))


@query("s13_deal_export", "SELECT o_orderkey, o_custkey, o_totalprice, CASE WHEN c_nationkey < 20 THEN n_name ELSE 'TRY' END AS currency FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def _(t):
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).withColumnRenamed("c_nationkey", "currency_code")
    codes = t.nation.where("n_nationkey < 20").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("description"))
    return S.deal_export(rows, codes, ["o_orderkey", "o_custkey", "o_totalprice", "currency"])


@query("s16_conform", "SELECT c_custkey, c_name, 1 AS is_active FROM customer")
def _(t):
    return S.conform(t.customer, T.StructType.fromDDL("c_custkey bigint, c_name string, is_active int"), {"is_active": 1})


@query("p1_key_lookup", "SELECT * FROM customer WHERE c_custkey = 42")
def _(t):
    return P.by_key(t.customer, "c_custkey", 42)


@query("p2_active", "SELECT c_custkey, c_name, CAST(c_custkey % 2 AS INTEGER) AS is_structured FROM customer WHERE c_custkey % 2 = 1 ORDER BY c_name")
def _(t):
    return P.active(t.customer.select("c_custkey", "c_name", (F.col("c_custkey") % 2).cast("int").alias("is_structured")), "is_structured", "c_name")


@query("p3_to_target", "SELECT c_custkey AS id, c_name AS name, c_acctbal AS credit_limit, 'TRY' AS currency, CAST(NULL AS VARCHAR) AS branch FROM customer")
def _(t):
    return P.to_target(t.customer, {"c_custkey": "id", "c_name": "name", "c_acctbal": "credit_limit"}, {"currency": "TRY", "branch": (None, "string")})


CODE = "(200 + CAST(floor(value) AS INTEGER) % 400)"


def coded(t):
    return t.events.withColumn("status", (F.lit(200) + F.floor("value").cast("int") % 400).cast("int"))


@query("p4_status_class", f"SELECT event_id, {CODE} AS status FROM events WHERE {CODE} >= 400 AND {CODE} < 500")
def _(t):
    return P.status_class(coded(t), "status", "4xx").select("event_id", "status")


@query("p5_where_supplied", "SELECT event_id, user_id, event_type FROM events WHERE event_type = 'click'")
def _(t):
    return P.where_supplied(t.events, user_id=None, event_type="click").select("event_id", "user_id", "event_type")


def rates(t):
    return t.events.select(F.col("event_id").alias("id"), F.col("event_type").alias("rate_type"), F.col("ts").cast("date").alias("effective_date"), F.col("value").alias("rate_value"))


@query("p6_rate_filter", "SELECT event_id AS id, event_type AS rate_type, CAST(ts AS DATE) AS effective_date, value AS rate_value FROM events WHERE event_type = 'view' AND value BETWEEN 10 AND 60")
def _(t):
    return P.rate_filter(rates(t), kind="view", lo=10, hi=60)


@query("p6_rate_latest", "SELECT event_id AS id, event_type AS rate_type, CAST(ts AS DATE) AS effective_date, value AS rate_value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY CAST(ts AS DATE) DESC, event_id DESC) = 1")
def _(t):
    return P.rate_filter(rates(t))


@query("p7_indicator_filter", "SELECT o_orderpriority AS code, strftime(o_orderdate, '%Y-%m') AS period, o_totalprice AS value FROM orders WHERE o_orderpriority = '1-URGENT' AND contains(strftime(o_orderdate, '%Y-%m'), '-03') AND o_totalprice >= 1000")
def _(t):
    df = t.orders.select(F.col("o_orderpriority").alias("code"), F.date_format("o_orderdate", "yyyy-MM").alias("period"), F.col("o_totalprice").alias("value"))
    return P.indicator_filter(df, code="1-URGENT", text="-03", lo=1000)


@query("p8_eq_or_blank", "WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN '' ELSE p_brand END AS brand FROM part) SELECT * FROM p WHERE brand = 'Brand#13' OR brand IS NULL OR brand = ''")
def _(t):
    df = t.part.select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, None).when(F.col("p_partkey") % 7 == 0, "").otherwise(F.col("p_brand")).alias("brand"))
    return df.where(P.eq_or_blank(F.col("brand"), "Brand#13"))


@query("p9_in_ids", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def _(t):
    return P.in_ids(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", t.customer.where("c_acctbal > 5000").select("c_custkey"))


@query("p10_text_filter_options", "SELECT array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS p_brand, array_to_string(list_sort(list(DISTINCT p_type)), ',') AS p_type FROM part WHERE CAST(p_size AS VARCHAR) = '7'")
def _(t):
    return P.text_filter_options(t.part, "p_size", "7", ["p_brand", "p_type"])[1].select(*[F.array_join(c, ",").alias(c) for c in ("p_brand", "p_type")])


@query("p11_deadline_class", f"""SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'none' WHEN CAST(o_orderdate AS DATE) < DATE '{ASOF}' THEN 'overdue' WHEN CAST(o_orderdate AS DATE) = DATE '{ASOF}' THEN 'today' WHEN CAST(o_orderdate AS DATE) <= DATE '{ASOF}' + 7 THEN 'week' ELSE 'later' END AS class FROM orders""")
def _(t):
    d = F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderdate").cast("date"))
    return t.orders.select("o_orderkey", P.deadline_class(d, ASOF).alias("class"))


@query("p12_has_assignee", "SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0 OR o_custkey % 10 = 5")
def _(t):
    owners = F.concat(F.when(F.col("o_orderkey") % 3 == 0, "U-1").otherwise("S-2"), F.lit(", "), F.when(F.col("o_custkey") % 10 == 5, "U-1").otherwise("U-11"))
    return t.orders.where(P.has_assignee(owners, "U-1")).select("o_orderkey")


@query("p13_due_state", f"""SELECT o_orderkey, CAST(date_diff('day', DATE '{ASOF}', CAST(o_orderdate AS DATE)) AS INTEGER) AS days_left, CASE WHEN o_orderstatus = 'F' THEN '' WHEN CAST(o_orderdate AS DATE) < DATE '{ASOF}' THEN 'overdue' WHEN CAST(o_orderdate AS DATE) <= DATE '{ASOF}' + 3 THEN 'soon' ELSE '' END AS due FROM orders""")
def _(t):
    df = t.orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("open").alias("status"))
    return P.due_state(df, "d", "status", ASOF).select("o_orderkey", "days_left", "due")


@query("p14_on_day", "SELECT event_id FROM events WHERE CAST(ts AS DATE) = (SELECT min(CAST(ts AS DATE)) FROM events)")
def _(t):
    day = t.events.agg(F.min("ts").cast("date").cast("string")).first()[0] or "1970-01-01"
    return t.events.where(P.on_day(F.col("ts"), day)).select("event_id")


@query("j1_deal_list", DEALS)
def _(t):
    return J.deal_list(headers(t), deals(t), customers(t), products(t)).select(*DEAL_COLUMNS)


@query("j2_deal_detail", DEALS + " WHERE l.l_orderkey = (SELECT max(o_orderkey) FROM orders)")
def _(t):
    key = t.orders.agg(F.max("o_orderkey")).first()[0]
    return J.deal_detail(headers(t), deals(t), customers(t), products(t), key).select(*DEAL_COLUMNS)


@query("j3_documents_with_user", "SELECT o_custkey, o_orderkey, o_orderdate, c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 4 <> 0) ON o_custkey = c_custkey ORDER BY o_orderdate DESC")
def _(t):
    users = t.customer.where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return J.with_user(t.orders.select("o_custkey", "o_orderkey", "o_orderdate"), users, "o_custkey", "o_orderdate")


@query("j4_recent_history", "SELECT e.user_id, event_id, ts, c_name FROM (SELECT * FROM events ORDER BY ts DESC, event_id LIMIT 50) e LEFT JOIN customer ON e.user_id = c_custkey")
def _(t):
    return J.recent_history(t.events.select("user_id", "event_id", "ts"), t.customer.select(F.col("c_custkey").alias("user_id"), "c_name"), "user_id", [F.col("ts").desc(), F.col("event_id")])


@query(
    "j5_parent_names",
    """SELECT event_id, event_type AS parent_type, user_id AS parent_id, CASE event_type WHEN 'view' THEN p_name WHEN 'click' THEN c_name || ' / Syndication #' || user_id WHEN 'purchase' THEN c_name || ' / Foreign Loan #' || user_id END AS parent_name
    FROM events LEFT JOIN part ON user_id = p_partkey LEFT JOIN customer ON user_id = c_custkey""",
)
def _(t):
    items_ = t.events.select("event_id", F.when(F.col("event_type") == "view", "project").otherwise(F.col("event_type")).alias("parent_type"), F.col("user_id").alias("parent_id"))
    got = J.parent_names(items_, named(t.part, project_id="p_partkey", project="p_name"), named(t.customer, deal_id="c_custkey", customer="c_name"), {"click": "Syndication", "purchase": "Foreign Loan"})
    return got.withColumn("parent_type", F.when(F.col("parent_type") == "project", "view").otherwise(F.col("parent_type")))


@query("j6_latest_attribute", "SELECT o_custkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def _(t):
    return J.latest_attribute(t.orders, "o_custkey", "o_orderpriority", ["o_orderdate", "o_orderkey"])


@query("j7_any_attribute", "SELECT l_orderkey, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) = 1")
def _(t):
    return J.any_attribute(t.lineitem, "l_orderkey", "l_partkey", ["l_linenumber", "l_partkey"])


@query("j8_latest_snapshot", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)")
def _(t):
    return J.latest_snapshot(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate")


@query("j9_orphans", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def _(t):
    return J.orphans(t.orders.select("o_orderkey", "o_custkey"), t.customer.where("c_acctbal > 0"), "o_custkey", "c_custkey")


@query("j10_unseen", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t):
    return J.unseen(t.documents.select("doc_id", "source"), t.labels, "doc_id")


@query("j11_decode", "SELECT s_suppkey, coalesce(n_name, '?') AS description, coalesce(r_name, '-') AS value1 FROM supplier LEFT JOIN (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 3 <> 0) ON s_nationkey = n_nationkey")
def _(t):
    codes = t.nation.where("n_nationkey % 3 <> 0").join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("description"), F.col("r_name").alias("value1"))
    return J.decode(t.supplier.select("s_suppkey", "s_nationkey"), codes, "s_nationkey", {"description": "?", "value1": "-"}).drop("s_nationkey")


@query("j12_owner_name", "SELECT o_orderkey, coalesce(s_name, c_name || ' ' || CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END) AS owner FROM orders LEFT JOIN supplier ON s_suppkey = o_orderkey % 200 LEFT JOIN customer ON c_custkey = o_custkey")
def _(t):
    df = t.orders.select("o_orderkey", (F.col("o_orderkey") % 200).alias("a_id"), F.col("o_custkey").alias("b_id"))
    b = t.customer.select(F.col("c_custkey").alias("b_id"), F.col("c_name").alias("b_name"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("b_surname"))
    return J.owner_name(df, named(t.supplier, a_id="s_suppkey", a_name="s_name"), b).select("o_orderkey", "owner")


@query("j13_blocked", "WITH i AS (SELECT o_orderkey AS item_id, CASE o_orderstatus WHEN 'F' THEN 'done' ELSE 'open' END AS status FROM orders) SELECT * FROM i WHERE item_id IN (SELECT l_orderkey FROM lineitem JOIN i p ON p.item_id = l_partkey WHERE p.status <> 'done')")
def _(t):
    items_ = t.orders.select(F.col("o_orderkey").alias("item_id"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("open").alias("status"))
    return J.blocked(items_, named(t.lineitem, item_id="l_orderkey", requires="l_partkey"))


@query(
    "j14_project_board",
    f"""WITH a AS (SELECT o_custkey AS project_id, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'O') AS in_progress FROM orders GROUP BY 1)
    SELECT c_custkey AS project_id, c_nationkey AS objective_id, n_name, coalesce(total, 0) AS total, coalesce(done, 0) AS done, coalesce(in_progress, 0) AS in_progress FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN a ON c_custkey = a.project_id""",
)
def _(t):
    i = t.orders.select(F.col("o_custkey").alias("project_id"), F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "in_progress").otherwise("todo").alias("status"))
    return J.project_board(named(t.customer, project_id="c_custkey", objective_id="c_nationkey"), named(t.nation, objective_id="n_nationkey", n_name="n_name"), i).select("project_id", "objective_id", "n_name", "total", "done", "in_progress")


@query("j16_lookup_with_flag", "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END, '') AS c_name, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 1 ELSE 0 END AS known FROM customer")
def _(t):
    src = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("c_name"))
    return J.lookup_with_flag(src, t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("a1_count_where", "SELECT count(*) FILTER (c_acctbal > 0) AS n FROM customer")
def _(t):
    return A.count_where(t.customer, F.col("c_acctbal") > 0)


@query("a2_request_stats", f"SELECT CAST(ts AS DATE) AS day, count(*) AS total, count(DISTINCT user_id) AS users, count(*) FILTER ({CODE} >= 400) AS errors, CAST(coalesce(floor(avg(CAST(floor(value) AS BIGINT))), 0) AS BIGINT) AS mean_ms FROM events GROUP BY 1")
def _(t):
    return A.request_stats(coded(t).withColumn("duration_ms", F.floor("value").cast("long")), F.col("ts").cast("date"))


@query("a3_customer_overview", "SELECT c.c_custkey, c_name, coalesce(n, 0) AS deals, 0 AS size FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def _(t):
    return A.customer_overview(t.customer.select("c_custkey", "c_name"), t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("a4_product_counts", "SELECT p_partkey, p_name, coalesce(n, 0) AS deals FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON p_partkey = l_partkey")
def _(t):
    return A.product_counts(t.part.select("p_partkey", "p_name"), t.lineitem.select(F.col("l_partkey").alias("p_partkey")), "p_partkey")


@query("a5_language_pivot", "SELECT user_id, max(props) FILTER (event_type = 'click') AS click, max(props) FILTER (event_type = 'view') AS view FROM events GROUP BY 1")
def _(t):
    return A.language_pivot(t.events, "user_id", "event_type", "props", ["click", "view"])




@query(
    "a6_kr_from_products",
    """WITH k AS (SELECT c_custkey AS kr_id, CASE WHEN c_custkey % 2 = 0 THEN '1-URGENT' ELSE '5-LOW' END AS product, CASE c_custkey % 3 WHEN 0 THEN ['F', 'O'] WHEN 1 THEN ['P'] ELSE ['X'] END AS s FROM customer)
    SELECT kr_id, round(coalesce(sum(v), 0), 2) AS value FROM (SELECT k.kr_id, a.v FROM (SELECT kr_id, product, unnest(s) AS st FROM k) k LEFT JOIN (SELECT o_orderpriority AS p, o_orderstatus AS st, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2) a ON a.p = k.product AND a.st = k.st) GROUP BY 1""",
)
def _(t):
    krs = t.customer.select(F.col("c_custkey").alias("kr_id"), F.when(F.col("c_custkey") % 2 == 0, "1-URGENT").otherwise("5-LOW").alias("product"), F.when(F.col("c_custkey") % 3 == 0, '["F", "O"]').when(F.col("c_custkey") % 3 == 1, '["P"]').otherwise('["X"]').alias("statuses"))
    return A.kr_from_products(krs, named(t.orders, product="o_orderpriority", status="o_orderstatus", amount="o_totalprice")).withColumn("value", F.round("value", 2))


@query("a7_kr_from_projects", f"SELECT o_orderkey AS kr_id, round(coalesce(d / n * 100.0, 0.0) * 50.0 / 100.0, 2) AS value FROM orders LEFT JOIN (SELECT l_orderkey, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER ({STATUS} = 'done') AS DOUBLE) AS d FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def _(t):
    return A.kr_from_projects(t.orders.select(F.col("o_orderkey").alias("kr_id"), F.col("o_orderkey").alias("project_id"), F.lit(50.0).alias("target")), items(t))


@query("a8_child_counts", f"SELECT l_orderkey AS project_id, count(*) AS total, count(*) FILTER ({STATUS} = 'done') AS done, count(*) FILTER ({STATUS} = 'in_progress') AS in_progress FROM lineitem GROUP BY 1")
def _(t):
    return A.child_counts(items(t), "project_id")


@query("a9_join_text", "SELECT l_orderkey, string_agg('S-' || l_suppkey, ',' ORDER BY l_linenumber, 'S-' || l_suppkey) AS owner FROM lineitem GROUP BY 1")
def _(t):
    return A.join_text(t.lineitem.withColumn("owner", F.concat(F.lit("S-"), F.col("l_suppkey").cast("string"))), "l_orderkey", "owner", "l_linenumber", ",")


@query(
    "a10_collect_children",
    """SELECT o_orderkey AS item_id, coalesce((SELECT string_agg(l_partkey, ',' ORDER BY l_partkey) FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber > 2), '') AS prereqs,
    coalesce((SELECT string_agg(l_linenumber || ':' || l_returnflag, ',' ORDER BY l_linenumber, l_returnflag) FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber <= 3), '') AS subitems FROM orders""",
)
def _(t):
    li = t.lineitem.withColumnRenamed("l_orderkey", "item_id")
    got = A.collect_children(t.orders.select(F.col("o_orderkey").alias("item_id")), li.where("l_linenumber > 2").select("item_id", F.col("l_partkey").alias("requires")), li.where("l_linenumber <= 3").select("item_id", F.col("l_linenumber").alias("sort_order"), F.col("l_returnflag").alias("title"), F.lit("todo").alias("status")), li.select("item_id", F.col("l_suppkey").cast("string").alias("owner")).where("false"))
    return got.select("item_id", F.array_join(F.col("prereqs").cast("array<string>"), ",").alias("prereqs"), F.array_join(F.transform("subitems", lambda x: F.concat_ws(":", x["sort_order"].cast("string"), x["title"])), ",").alias("subitems"))


def timings(t):
    return t.events.select(F.col("event_type").alias("model"), F.floor("value").cast("long").alias("ms"), F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"), F.when(F.col("event_type") == "error", F.col("props")).alias("error"))


@query("a11_timing_summary", "SELECT count(*) AS runs, CAST(round(avg(CAST(floor(value) AS BIGINT))) AS BIGINT) AS mean_ms, count(*) FILTER (event_type = 'error') AS errors FROM events")
def _(t):
    return A.timing_summary(timings(t), "ms")


@query("a12_timing_by", "SELECT event_type AS model, count(*) AS runs, CAST(round(avg(CAST(floor(value) AS BIGINT))) AS BIGINT) AS mean FROM events WHERE event_type <> 'error' GROUP BY 1 ORDER BY 3, 1")
def _(t):
    return A.timing_by(timings(t), "model", "ms")


@query("a13_options", "SELECT DISTINCT p_brand FROM part WHERE p_brand IS NOT NULL ORDER BY 1")
def _(t):
    return A.options(t.part, "p_brand")


@query(
    "a14_coverage",
    """WITH s AS (SELECT l_orderkey, sum(l_extendedprice) AS offered FROM lineitem GROUP BY 1), c AS (SELECT o_orderkey AS deal_id, CASE WHEN o_totalprice > 0 THEN coalesce(offered, 0.0) / o_totalprice * 100 ELSE 0.0 END AS p FROM orders LEFT JOIN s ON o_orderkey = l_orderkey)
    SELECT deal_id, round(p, 4) AS percent, CASE WHEN p >= 100 THEN 'full' WHEN p >= 75 THEN 'near' ELSE 'low' END AS class FROM c""",
)
def _(t):
    return A.coverage(named(t.orders, deal_id="o_orderkey", amount="o_totalprice"), named(t.lineitem, deal_id="l_orderkey", offered="l_extendedprice")).select("deal_id", F.round("percent", 4).alias("percent"), "class")


@query("a15_progress", "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_quantity - 5 > 0 THEN least(l_linenumber / (l_quantity - 5) * 100, 100.0) ELSE 0.0 END, 6) AS achieved_pct, round(CASE WHEN l_quantity - 5 > 0 THEN least((l_linenumber + l_tax) / (l_quantity - 5) * 100, 100.0) ELSE 0.0 END, 6) AS total_pct FROM lineitem")
def _(t):
    krs = t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_quantity") - 5).alias("target"), F.col("l_linenumber").cast("double").alias("achieved"), F.col("l_tax").alias("pipeline"))
    return A.progress(krs).select("l_orderkey", "l_linenumber", F.round("achieved_pct", 6).alias("achieved_pct"), F.round("total_pct", 6).alias("total_pct"))


@query("a16_backlog_counts", "SELECT count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (user_id % 2 = 0) AS done FROM events")
def _(t):
    return A.backlog_counts(t.events.select(F.col("event_type").alias("parent_type"), F.when(F.col("user_id") % 2 == 0, "done").alias("status")), ["click", "view"])


@query("a17_period_summary", "SELECT strftime(o_orderdate, '%Y%m') AS period_code, arg_min(strftime(o_orderdate, '%Y-%m-%d'), o_orderkey) AS period_date, arg_min(o_orderpriority, o_orderkey) AS period_label FROM orders GROUP BY 1")
def _(t):
    return A.period_summary(t.orders.select(F.date_format("o_orderdate", "yyyyMM").alias("period_code"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("period_date"), F.col("o_orderpriority").alias("period_label"), F.col("o_orderkey").alias("line_order")))


@query(
    "a18_ingest_counts",
    """WITH b AS (SELECT event_type, user_id, count(*) AS n, bool_or(user_id % 3 = 0) AS known FROM events GROUP BY 1, 2)
    SELECT event_type, CAST(sum(CASE WHEN known THEN 0 ELSE 1 END) AS BIGINT) AS inserted, CAST(sum(n - CASE WHEN known THEN 0 ELSE 1 END) AS BIGINT) AS ignored FROM b GROUP BY ROLLUP (event_type)""",
)
def _(t):
    return A.ingest_counts(t.events.select("event_type", "user_id"), t.events.where("user_id % 3 = 0"), ["event_type", "user_id"], "event_type")


@query("a19_busy", "SELECT count(*) FILTER (event_type IN ('error', 'signup')) > 0 AS busy FROM events")
def _(t):
    return A.busy(t.events, "event_type", ("error", "signup"))


@query("a20_total_size", "SELECT round(sum(coalesce(CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END, 0)), 1) AS total FROM orders")
def _(t):
    return A.total_size(t.orders.withColumn("x", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice"))), "x").select(F.round("total", 1).alias("total"))


@query(
    "a21_task_board",
    """SELECT user_id AS document_id, coalesce(max(props) FILTER (event_type = 'click'), 'Not Started') AS click_status, coalesce(max(event_type) FILTER (event_type = 'click'), '') AS click_message, coalesce(max(CAST(floor(value) AS INTEGER)) FILTER (event_type = 'click'), 0) AS click_percent,
    coalesce(max(props) FILTER (event_type = 'view'), 'Not Started') AS view_status, coalesce(max(event_type) FILTER (event_type = 'view'), '') AS view_message, coalesce(max(CAST(floor(value) AS INTEGER)) FILTER (event_type = 'view'), 0) AS view_percent FROM events GROUP BY 1""",
)
def _(t):
    return A.task_board(t.events.select(F.col("user_id").alias("document_id"), F.col("event_type").alias("task_type"), F.col("props").alias("status"), F.col("event_type").alias("message"), F.floor("value").cast("int").alias("percent")), ["click", "view"])


@query("w1_latest_per", "SELECT event_type, event_id, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) = 1")
def _(t):
    return W.latest_per(t.events, ["event_type"], [F.col("ts").desc(), F.col("event_id").desc()]).select("event_type", "event_id", "ts", "value")


@query("w2_latest_side_by_side", "SELECT arg_max(value, (ts, event_id)) FILTER (event_type = 'click') AS click, arg_max(value, (ts, event_id)) FILTER (event_type = 'view') AS view, CAST(NULL AS DOUBLE) AS none FROM events")
def _(t):
    return W.latest_side_by_side(t.events, "event_type", "value", ["ts", "event_id"], ["click", "view", "none"])


@query("w3_first_n_per", "SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 10")
def _(t):
    return W.first_n_per(t.documents.select("source", "doc_id"), ["source"], ["doc_id"], 10)


@query("w4_last_n_per", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) <= 4")
def _(t):
    return W.last_n_per(t.orders.select("o_custkey", "o_orderkey"), ["o_custkey"], [F.col("o_orderkey")], 4)


@query("w5_rank_zero", "SELECT vec_id, label, CAST(row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) - 1 AS INTEGER) AS rank FROM embeddings")
def _(t):
    return W.rank_zero(t.embeddings, ["label"], [F.get("embedding", F.lit(0)).desc(), F.col("vec_id")]).select("vec_id", "label", F.col("rank").cast("int").alias("rank"))


@query("w6_fill_forward", "SELECT l_orderkey, l_linenumber, last_value(CASE WHEN l_returnflag <> 'N' THEN l_returnflag END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS section FROM lineitem")
def _(t):
    df = t.lineitem.withColumn("section", F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")))
    return W.fill_forward(df, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], ["section"]).select("l_orderkey", "l_linenumber", "section")


@query(
    "w7_group_runs",
    """WITH e AS (SELECT event_id, user_id, event_type IN ('purchase', 'error') AS v FROM events), s AS (SELECT *, CASE WHEN NOT v AND coalesce(lag(v) OVER (PARTITION BY user_id ORDER BY event_id), true) THEN 1 ELSE 0 END AS st FROM e)
    SELECT event_id, user_id, CAST(sum(st) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM s""",
)
def _(t):
    return W.group_runs(t.events.select("event_id", "user_id", "event_type"), ["user_id"], ["event_id"], F.col("event_type").isin("purchase", "error")).drop("event_type")


# a code line in the first, third, ... place of an unbroken row of lines that could take the next one takes it
@query(
    "w8_attach_next",
    """WITH l AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS n, w[CAST(i AS INTEGER)] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS w FROM documents), unnest(range(1, len(w) + 1)) r(i)),
    a AS (SELECT *, length(line) < 20 AND coalesce(NOT regexp_matches(lead(line) OVER w, '^[0-9]'), false) AS can, lead(line) OVER w AS after FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
    b AS (SELECT *, n - max(CASE WHEN can THEN -1 ELSE n END) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS row_place FROM a), c AS (SELECT *, can AND row_place % 2 = 1 AS takes FROM b)
    SELECT doc_id, n, CASE WHEN takes THEN trim(line) || ' ' || trim(after) ELSE line END AS line FROM c QUALIFY NOT coalesce(lag(takes) OVER (PARTITION BY doc_id ORDER BY n), false)""",
)
def _(t):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return W.attach_next(lines, ["doc_id"], ["n"], "line", F.length("line") < 20, F.col("line").rlike(r"^\d"))


@query("w9_latest_active_group", "SELECT user_id, event_id, ts FROM events WHERE user_id = (SELECT user_id FROM events WHERE event_type IN ('click', 'signup') ORDER BY ts DESC, user_id DESC LIMIT 1) ORDER BY ts")
def _(t):
    return W.latest_active_group(t.events, "user_id", "event_type", ("click", "signup"), "ts").select("user_id", "event_id", "ts")


@query("o1_ordered", "SELECT o_orderkey, CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE o_custkey END AS c FROM orders ORDER BY c NULLS FIRST, o_orderkey DESC")
def _(t):
    return W.ordered(t.orders.select("o_orderkey", F.when(F.col("o_custkey") % 4 != 0, F.col("o_custkey")).alias("c")), F.col("c"), F.col("o_orderkey").desc())


@query("o2_page", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 100")
def _(t):
    return W.page(t.events.select("event_id", "ts"), [F.col("ts").desc(), F.col("event_id").desc()], 3)


@query(
    "o2_late_pages",
    """WITH e AS (SELECT event_id, ts, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS n, CAST((count(*) OVER () + 49) // 50 AS BIGINT) AS last FROM events)
    SELECT (n + 49) // 50 AS page, event_id, ts FROM e WHERE (n + 49) // 50 IN (1, last // 2, last)""",
)
def _(t):
    path, rows = new_path(t.spark, "pages"), t.events.select("event_id", "ts")
    build_pages(rows, [F.col("ts").desc(), F.col("event_id").desc()], path)
    last = page_count(t.spark, path)
    return reduce(DataFrame.unionByName, [seek_page(t.spark, path, rows.schema, n).select(F.lit(n).cast("long").alias("page"), "*") for n in sorted({1, last // 2, last})])


@query("o3_top_n", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 120")
def _(t):
    return W.top_n(t.events.select("event_id", "ts"), [F.col("ts").desc(), F.col("event_id")], 9999, 120)


@query("o4_order_numeric", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS code FROM part ORDER BY p_size, p_partkey")
def _(t):
    return W.order_numeric(t.part.select("p_partkey", F.col("p_size").cast("string").alias("code")), "code", "p_partkey")


@query("o5_top_k", "SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS score FROM embeddings ORDER BY 2 DESC, vec_id LIMIT 15")
def _(t):
    return W.top_k(t.embeddings.select("vec_id", F.get("embedding", F.lit(0)).cast("double").alias("score")), "score", "vec_id", 15)


@query("u1_options_with", "SELECT p_brand FROM part WHERE p_brand IS NOT NULL UNION SELECT 'Any' UNION SELECT 'None' ORDER BY 1")
def _(t):
    return W.options_with(t.part, "p_brand", ["Any", "None"])


@query("u2_concat_series", "SELECT strftime(o_orderdate, '%Y-%m') AS period, o_orderkey AS id, o_totalprice AS value FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT strftime(l_shipdate, '%Y-%m'), l_orderkey, l_tax FROM lineitem WHERE l_linenumber = 1 ORDER BY 1 DESC, 2 DESC")
def _(t):
    a = t.orders.where("o_orderstatus = 'F'").select(F.date_format("o_orderdate", "yyyy-MM").alias("period"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value"))
    b = t.lineitem.where("l_linenumber = 1").select(F.date_format("l_shipdate", "yyyy-MM").alias("period"), F.col("l_orderkey").alias("id"), F.col("l_tax").alias("value"))
    return W.concat_series(a, b)


@query("u3_first_by", "SELECT host, page_id FROM (SELECT CASE WHEN page_id % 6 = 0 THEN '' ELSE regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) END AS host, page_id FROM pages) WHERE host <> '' QUALIFY row_number() OVER (PARTITION BY host ORDER BY page_id) = 1 ORDER BY page_id LIMIT 10")
def _(t):
    df = t.pages.select(F.when(F.col("page_id") % 6 == 0, "").otherwise(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)).alias("host"), "page_id")
    return W.first_by(df, "host", ["page_id"], 10)


@query("u4_distinct_in_order", "SELECT conv_id, turn, CASE WHEN trim(role) = 'user' THEN 'user' WHEN role = '' THEN 'user' ELSE 'user|' || role END AS variants FROM conversations")
def _(t):
    return t.conversations.select("conv_id", "turn", F.array_join(W.distinct_in_order(F.lit("user"), F.array(F.concat(F.lit(" "), F.col("role")), F.lit("  "), F.col("role"))), "|").alias("variants"))
