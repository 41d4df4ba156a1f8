"""Statements, trees, retrieval, graphs, pages and streams over the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import changes as C
from ..operators import commits
from ..operators import graph as G
from ..operators import joins as J
from ..operators import pages as L
from ..operators import retrieval as R
from ..operators import statements as ST
from ..operators import trees as TR
from ..operators.durable import durable, new_path
from ..sources import feeds as S
from ..sources.feeds import spread
from ..streaming import streams as M
from ..streaming.tail_source import tail_stream
from .registry import query
from .relational import items
from .scalars import BOT, html_text, paragraphs

# ---- statements: the lines of an order as the pages of a report ---------------------------------------------------


def report_pages(t):
    """A balance sheet for each of the orders: a title page line, sections, and the order's lines as items with two amounts."""
    money = lambda c: F.translate(F.format_number(c, 2), ",.", ".,")
    line = F.concat(F.lit("1.1."), F.col("l_linenumber").cast("string"), F.lit(" Kalem\n"), money(F.col("l_extendedprice")), F.lit("\n("), money(F.col("l_tax") * 100 + 1), F.lit(")"))
    body = spread(t.lineitem).groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", line.alias("s")))), lambda x: x["s"]), "\n").alias("body"))
    head = "Bilanço\nBin TL\n31 Aralık 2024\n31 Aralık 2023\nVARLIKLAR\nDipnot\n1.1 Dönen Varlıklar:\n"
    return body.select("doc_id", F.lit(0).alias("page_no"), F.concat(F.lit(head), F.col("body")).alias("text"))


@query("t1_classify_pages", "SELECT DISTINCT l_orderkey AS doc_id, 0 AS page_no, 'BALANCE_SHEET' AS statement, 1000 AS scale FROM lineitem")
def _(t):
    return ST.classify_pages(report_pages(t)).select("doc_id", "page_no", "statement", "scale")


@query("t2_periods", "SELECT doc_id, p.* FROM (SELECT DISTINCT l_orderkey AS doc_id FROM lineitem), (VALUES (0, '202412', '2024-12-31'), (1, '202312', '2023-12-31')) p(period_no, period_code, period_date)")
def _(t):
    return ST.periods(ST.classify_pages(report_pages(t))).select("doc_id", "period_no", "period_code", "period_date")


@query("t3_clean_lines", "SELECT l_orderkey AS doc_id, 2 + 3 * count(*) AS lines FROM lineitem GROUP BY 1")
def _(t):
    return ST.clean_lines(ST.classify_pages(report_pages(t))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"))


def records(t):
    pages = durable(ST.classify_pages(report_pages(t)), "pages")  # read for the lines and for the periods
    return ST.statement_lines(ST.clean_lines(pages, ST.line_tasks(pages)), ST.periods(pages))


@query(
    "t4_statement_lines",
    """SELECT l_orderkey AS doc_id, p.code AS period_code, '1.1.' || l_linenumber || ' Kalem' AS label, '1.1 Dönen Varlıklar' AS parent, 2 AS depth, CAST(CASE p.code WHEN '202412' THEN round(l_extendedprice, 2) * 1000 ELSE -(round(l_tax * 100 + 1, 2) * 1000) END AS DECIMAL(22, 2)) AS amount
    FROM lineitem, (VALUES ('202412'), ('202312')) p(code)""",
)
def _(t):
    return records(t).where("depth = 2").select("doc_id", "period_code", "label", "parent", "depth", "amount")


def report_book(t):
    """Three pages for each order: a balance sheet with coded, dashed, footnoted, grouped and total lines, its second page without a title, and an income statement in another unit."""
    money = lambda c: F.translate(F.format_number(c, 2), ",.", ".,")
    price, tax = money(F.col("l_extendedprice")), money(F.col("l_tax") * 100 + 1)
    odd = F.concat(F.lit("1.1."), F.col("l_linenumber").cast("string"), F.lit(" Kalem\n"), price, F.lit("\n("), tax, F.lit(")"))
    even = F.concat(F.lit("- Alt Kalem\n12\n"), price, F.lit("\n"), tax)
    line = F.when(F.col("l_linenumber") % 2 == 1, odd).otherwise(even)
    body = spread(t.lineitem).groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", line.alias("s")))), lambda x: x["s"]), "\n").alias("body"))
    sums = t.orders.select(F.col("o_orderkey").alias("doc_id"), money(F.col("o_totalprice")).alias("m"))
    dates = "31 Aralık 2024\n31 Aralık 2023\n"
    page = lambda n, *parts: F.struct(F.lit(n).alias("page_no"), F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts]).alias("text"))
    b, m = F.col("body"), F.col("m")
    pages = F.array(
        page(0, "Finansal Durum Tablosu\nBin TL\n" + dates + "VARLIKLAR\nDipnot\n1.1 Dönen Varlıklar:\n", b, "\nGrup\n- Parça\n", m, "\n-\nToplam Varlıklar\n", m, "\n", m),
        page(1, "cari dönem\nKAYNAKLAR\nII. Özkaynaklar\n2.1\nSermaye\n", m, "\n", m, "\n2.1.3 Yedek\n-\n", m),
        page(2, "Gelir Tablosu\nMilyon TL\n" + dates + "GELİR VE GİDER KALEMLERİ\nI. FAİZ GELİRLERİ\n", m, "\n", m, "\n1.1 Kredi\n", m, "\n", m, "\n1.1.1 Konut\n", m, "\n(", m, ")\nDiğer\n", m, "\n", m),
    )
    return body.join(sums, "doc_id").select("doc_id", F.explode(pages).alias("p")).select("doc_id", "p.*")


@query(
    "t4_every_depth",
    """WITH o AS (SELECT o_orderkey AS doc_id, CAST(o_totalprice AS DECIMAL(22, 2)) AS m FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)), p AS (SELECT * FROM (VALUES ('202412', 0), ('202312', 1)) v(period_code, k)),
    fixed AS (SELECT doc_id, x.*, m FROM o, (VALUES
      ('BALANCE_SHEET', 'VARLIKLAR', NULL, 'VARLIKLAR', 0, 0, NULL, NULL), ('BALANCE_SHEET', 'VARLIKLAR', 'VARLIKLAR', '1.1 Dönen Varlıklar', 1, 0, NULL, NULL), ('BALANCE_SHEET', 'VARLIKLAR', '1.1 Dönen Varlıklar', 'Grup', 2, 0, NULL, NULL),
      ('BALANCE_SHEET', 'VARLIKLAR', 'Grup', '- Parça', 3, 0, 1000, 0), ('BALANCE_SHEET', 'VARLIKLAR', '1.1 Dönen Varlıklar', 'Toplam Varlıklar', 2, 1, 1000, 1000), ('BALANCE_SHEET', 'KAYNAKLAR', NULL, 'KAYNAKLAR', 0, 0, NULL, NULL),
      ('BALANCE_SHEET', 'II. ÖZKAYNAKLAR', NULL, 'II. Özkaynaklar', 0, 0, NULL, NULL), ('BALANCE_SHEET', 'II. ÖZKAYNAKLAR', 'II. ÖZKAYNAKLAR', '2.1 Sermaye', 1, 0, 1000, 1000), ('BALANCE_SHEET', 'II. ÖZKAYNAKLAR', '2.1 Sermaye', '2.1.3 Yedek', 2, 0, 0, 1000),
      ('INCOME_STATEMENT', 'GELİR VE GİDER KALEMLERİ', NULL, 'GELİR VE GİDER KALEMLERİ', 0, 0, NULL, NULL), ('INCOME_STATEMENT', 'I. FAİZ GELİRLERİ', NULL, 'I. FAİZ GELİRLERİ', 0, 0, 1000000, 1000000),
      ('INCOME_STATEMENT', 'I. FAİZ GELİRLERİ', 'I. FAİZ GELİRLERİ', '1.1 Kredi', 1, 0, 1000000, 1000000), ('INCOME_STATEMENT', 'I. FAİZ GELİRLERİ', '1.1 Kredi', '1.1.1 Konut', 2, 0, 1000000, -1000000), ('INCOME_STATEMENT', 'I. FAİZ GELİRLERİ', '1.1 Kredi', 'Diğer', 2, 0, 1000000, 1000000)
      ) x(statement, section, parent, label, depth, subtotal, f0, f1))
    SELECT doc_id, statement, period_code, section, parent, label, CAST(NULL AS VARCHAR) AS note, depth, subtotal, CAST(CASE k WHEN 0 THEN f0 ELSE f1 END * m AS DECIMAL(22, 2)) AS amount FROM fixed, p
    UNION ALL SELECT l_orderkey, 'BALANCE_SHEET', period_code, 'VARLIKLAR', '1.1 Dönen Varlıklar', CASE WHEN l_linenumber % 2 = 1 THEN '1.1.' || l_linenumber || ' Kalem' ELSE '- Alt Kalem' END, CASE WHEN l_linenumber % 2 = 0 THEN '12' END, CASE WHEN l_linenumber % 2 = 1 THEN 2 ELSE 3 END, 0,
      CAST(CASE WHEN k = 0 THEN round(l_extendedprice, 2) * 1000 WHEN l_linenumber % 2 = 1 THEN -(round(l_tax * 100 + 1, 2) * 1000) ELSE round(l_tax * 100 + 1, 2) * 1000 END AS DECIMAL(22, 2)) FROM lineitem JOIN o ON doc_id = l_orderkey, p""",
)
def _(t):
    pages = durable(ST.classify_pages(report_book(t)), "pages")
    return ST.statement_lines(ST.clean_lines(pages, ST.line_tasks(pages)), ST.periods(pages)).select("doc_id", "statement", "period_code", "section", "parent", "label", "note", "depth", "subtotal", "amount")


@query("t5_report", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey = (SELECT min(l_orderkey) FROM lineitem) ORDER BY l_linenumber")
def _(t):
    df = t.lineitem.select(F.col("l_orderkey").alias("doc_id"), F.lit("202412").alias("period_code"), F.col("l_linenumber").alias("line_order"), "l_quantity")
    first = t.lineitem.agg(F.min("l_orderkey")).first()[0]
    return ST.report(df, first).select(F.col("doc_id").alias("l_orderkey"), F.col("line_order").alias("l_linenumber"), "l_quantity")


# ---- trees: parts as a heap ----------------------------------------------------------------------------------------


def tree(t):
    key = F.col("p_partkey")
    parent = F.when(key == 1, "NULL").otherwise(F.floor(key / 2).cast("int").cast("string"))
    defs = t.part.select(key.cast("int").alias("id"), parent.alias("parent_id"), key.cast("string").alias("code"), F.col("p_name").alias("name"), (key * 2 > t.part.count()).cast("int").alias("is_leaf"))
    amounts = t.lineitem.select(F.col("l_partkey").cast("int").alias("id"), F.year("l_shipdate").alias("period_id"), F.col("l_quantity").alias("original_value"))
    return defs, amounts


ROLLED = """WITH RECURSIVE up(id, anc) AS (SELECT CAST(p_partkey AS INTEGER), CAST(p_partkey AS INTEGER) FROM part UNION ALL SELECT id, anc // 2 FROM up WHERE anc > 1),
periods AS (SELECT DISTINCT CAST(year(l_shipdate) AS INTEGER) AS period_id FROM lineitem), own AS (SELECT CAST(l_partkey AS INTEGER) AS id, CAST(year(l_shipdate) AS INTEGER) AS period_id, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2),
s AS (SELECT anc AS id, period_id, sum(v) AS amount FROM own JOIN up USING (id) GROUP BY 1, 2),
rolled AS (SELECT CAST(p_partkey AS INTEGER) AS id, periods.period_id, coalesce(amount, 0.0) AS amount FROM part CROSS JOIN periods LEFT JOIN s ON s.id = p_partkey AND s.period_id = periods.period_id) """


@query("t6_rollup_tree", ROLLED + "SELECT id, period_id, round(amount, 2) AS amount FROM rolled")
def _(t):
    return TR.rollup_tree(*tree(t)).withColumn("amount", F.round("amount", 2))


@query(
    "t7_preorder",
    """WITH RECURSIVE walk(id, depth, path) AS (SELECT CAST(p_partkey AS INTEGER), 0, [CAST(p_partkey AS VARCHAR)] FROM part WHERE p_partkey <= 1 UNION ALL
      SELECT CAST(p_partkey AS INTEGER), depth + 1, list_append(path, CAST(p_partkey AS VARCHAR)) FROM walk JOIN part ON p_partkey // 2 = id WHERE p_partkey > 1),
    below AS (SELECT anc AS id, count(*) AS size FROM (WITH RECURSIVE up(id, anc) AS (SELECT p_partkey, p_partkey FROM part UNION ALL SELECT id, anc // 2 FROM up WHERE anc > 1) SELECT * FROM up) GROUP BY 1)
    SELECT walk.id, depth, size > 1 AS has_children, row_number() OVER (ORDER BY path) - 1 AS place, size FROM walk JOIN below ON below.id = walk.id""",
)
def _(t):
    return TR.preorder(tree(t)[0]).select("id", "depth", "has_children", "place", "size")


@query("t8_asset_series", ROLLED + "SELECT period_id, round(sum(amount), 2) AS assets FROM rolled WHERE id IN (1, 2) GROUP BY 1")
def _(t):
    defs, amounts = tree(t)
    return TR.asset_series(TR.rollup_tree(defs, amounts), defs).withColumn("assets", F.round("assets", 2))


# ---- retrieval -----------------------------------------------------------------------------------------------------


def documents(t):
    return t.documents.select(F.col("doc_id").alias("document_id"), "text")


@query("r1_stride_chunks", "SELECT doc_id AS document_id, CAST((i - 1) // 900 AS INTEGER) AS chunk_no, substr(text, CAST(i AS INTEGER), 1000) AS text FROM (SELECT doc_id, text, unnest(range(1, greatest(length(text), 1) + 1, 900)) AS i FROM documents) WHERE substr(text, CAST(i AS INTEGER), 1000) <> ''")
def _(t):
    return R.stride_chunks(documents(t), 1000, 100)


@query("r1_chunk")
def _(t):
    return R.chunk(documents(t), 500, 50)


@query("r2_dedupe_chunks", "SELECT md5(text) AS id, min(doc_id) AS document_id FROM documents GROUP BY 1")
def _(t):
    return R.dedupe_chunks(documents(t).withColumn("chunk_no", F.lit(0))).select("id", "document_id")


QUERY_TEXT = "the tion of inonand the token"
BM25 = f"""WITH w AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-zA-Z0-9'']+') AS w FROM documents), s AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM w),
p AS (SELECT id, len(w) AS l, unnest(w) AS word FROM w), tf AS (SELECT id, l, word, count(*) AS tf FROM p GROUP BY 1, 2, 3), df AS (SELECT word, count(*) AS df FROM tf GROUP BY 1),
idf AS (SELECT word, ln(n - df + 0.5) - ln(df + 0.5) AS idf, mean FROM df, s), eps AS (SELECT avg(idf) * 0.25 AS e FROM idf),
q AS (SELECT word, count(*) AS times FROM (SELECT unnest(regexp_extract_all('{QUERY_TEXT}', '[a-zA-Z0-9'']+')) AS word) GROUP BY 1),
bm AS (SELECT id, sum(times * CASE WHEN idf < 0 THEN e ELSE idf END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / mean))) AS score FROM tf JOIN q USING (word) JOIN idf USING (word), eps GROUP BY 1) """


INDEXES: dict[tuple[str, str], str] = {}


def stored_index(t):
    """The documents' keyword index, built once for a session and folder."""
    key = (t.spark.sparkContext.applicationId, t.folder)
    if key not in INDEXES:
        path = new_path(t.spark, "index")
        R.add_segment(t.documents.select(F.col("doc_id").alias("id"), "text"), path, 0)
        INDEXES[key] = path
    return INDEXES[key]


@query("r3_bm25", BM25 + "SELECT 'q' AS query_id, id, round(score, 6) AS score FROM bm")
def _(t):
    asked = t.spark.createDataFrame([("q", QUERY_TEXT)], "query_id string, query string")
    return R.search(t.spark, stored_index(t), asked).withColumn("score", F.round("score", 6))


RARE_TEXT = "the ation thention ofonndre"


@query("r3_best_chunks", BM25.replace(QUERY_TEXT, RARE_TEXT) + "SELECT 'q' AS query_id, id, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, id LIMIT 10")
def _(t):
    asked = t.spark.createDataFrame([("q", RARE_TEXT)], "query_id string, query string")
    return R.search(t.spark, stored_index(t), asked, n=10).withColumn("score", F.round("score", 6))


def vectors(t):
    return t.embeddings.select(F.col("vec_id").alias("id"), "embedding")


def vector_queries(t, n: int):
    """The first ``n`` vectors as the queries of one request."""
    return t.embeddings.where(F.col("vec_id") < n).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


COS = "list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"


@query("j15_score_pairs", f"SELECT e.vec_id AS id, q.vec_id AS query_id, round({COS}, 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0")
def _(t):
    asked = t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return J.cosine_pairs(asked, vectors(t)).select("id", "query_id", F.round("score", 6).alias("score"))


@query("r4_semantic", f"SELECT e.vec_id AS id, round({COS}, 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0 ORDER BY {COS} DESC, e.vec_id LIMIT 4")
def _(t):
    return R.semantic(vectors(t), vector_queries(t, 1), 4).withColumn("score", F.round("score", 6))


@query("r5_semantic_multi", f"SELECT e.vec_id AS id, round(max({COS}), 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id < 4 GROUP BY 1 ORDER BY max({COS}) DESC, id LIMIT 20")
def _(t):
    return R.semantic_multi(vectors(t), vector_queries(t, 4), 20).withColumn("score", F.round("score", 6))


@query("r6_fuse", "WITH a AS (SELECT vec_id, row_number() OVER (ORDER BY embedding[1] DESC, vec_id) - 1 AS r FROM embeddings), b AS (SELECT vec_id, row_number() OVER (ORDER BY embedding[2] DESC, vec_id) - 1 AS r FROM embeddings WHERE vec_id % 2 = 0) SELECT vec_id AS id, round(sum(1.0::DOUBLE / (60 + r)), 8) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1")
def _(t):
    v = t.embeddings.select(F.col("vec_id").alias("id"), *[F.get("embedding", F.lit(i)).alias(f"s{i}") for i in (0, 1)])
    return R.fuse(R.ranked(v, "s0"), R.ranked(v.where("id % 2 = 0"), "s1")).withColumn("score", F.round("score", 8))


HYBRID = (
    BM25
    + f""", sem AS (SELECT e.vec_id AS id, max({COS}) AS score FROM embeddings e, embeddings q WHERE q.vec_id < 3 AND e.vec_id % 3 <> 0 AND e.vec_id IN (SELECT doc_id FROM documents) GROUP BY 1),
key AS (SELECT doc_id AS id, coalesce(score, 0.0) AS score FROM documents LEFT JOIN bm ON bm.id = doc_id WHERE doc_id % 3 <> 0),
r AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS r FROM sem UNION ALL SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS r FROM key)
SELECT id, round(sum(1.0::DOUBLE / (60 + r)), 8) AS score FROM r GROUP BY 1 ORDER BY sum(1.0::DOUBLE / (60 + r)) DESC, id LIMIT 20"""
)


@query("r7_hybrid", HYBRID)
def _(t):
    chunks = t.documents.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 3).alias("document_id"))
    return R.hybrid(chunks, vectors(t), QUERY_TEXT, vector_queries(t, 3), docs=[1, 2], index=stored_index(t)).withColumn("score", F.round("score", 8))


@query("r8_context", "SELECT conv_id, string_agg(text, chr(10) || '---' || chr(10) ORDER BY turn) AS context, count(*) AS chunks, CAST(length(string_agg(text, chr(10) || '---' || chr(10) ORDER BY turn)) AS INTEGER) AS chars FROM conversations GROUP BY 1")
def _(t):
    return R.context(t.conversations, "turn", "\n---\n", ["conv_id"])


@query("r9_rank_summaries", f"SELECT e.vec_id AS id, round({COS}, 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id = 7 ORDER BY {COS} DESC, e.vec_id LIMIT 15")
def _(t):
    q = t.embeddings.where("vec_id = 7").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return R.rank_summaries(t.embeddings.select(F.col("vec_id").alias("id"), "embedding"), q).withColumn("score", F.round("score", 6))


# ---- graph ----------------------------------------------------------------------------------------------------------


def payloads(t):
    """An extraction result for each order: its suppliers and parts; every third holds an element that is no object."""
    node = F.to_json(F.struct(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("id"), F.col("l_returnflag").alias("type")))
    edge = F.to_json(F.struct(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("source"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("target"), F.col("l_linestatus").alias("relation")))
    rows = t.lineitem.groupBy(F.col("l_orderkey").alias("seq")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", node.alias("n"), edge.alias("e")))).alias("x"))
    stray = F.when(F.col("seq") % 3 == 0, ', "stray"').otherwise("")
    part = lambda c: F.array_join(F.transform("x", lambda r: r[c]), ",")
    return rows.select("seq", F.concat(F.lit('{"nodes": ['), part("n"), stray, F.lit('], "edges": ['), part("e"), F.lit("]}")).alias("payload"))


@query("g1_triples", "SELECT l_orderkey AS seq, 'node' AS kind, 'P' || l_partkey AS id, CAST(NULL AS VARCHAR) AS target FROM lineitem UNION ALL SELECT l_orderkey, 'edge', NULL, 'P' || l_partkey FROM lineitem")
def _(t):
    return G.triples(payloads(t), "payload").select("seq", "kind", "id", "target")


ORDERED = "(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS p FROM lineitem)"


@query("g2_nodes", f"SELECT 'P' || l_partkey AS id, arg_max(l_returnflag, (l_orderkey, p)) AS type FROM {ORDERED} GROUP BY 1 UNION ALL SELECT DISTINCT 'S' || l_suppkey, 'Unknown' FROM lineitem")
def _(t):
    return G.nodes(G.triples(payloads(t), "payload"))


@query("g3_edges", f"SELECT 'P' || l_partkey AS src, 'S' || l_suppkey AS dst, arg_max(l_linestatus, (l_orderkey, p)) AS relation FROM {ORDERED} GROUP BY 1, 2")
def _(t):
    return G.edges(G.triples(payloads(t), "payload"))


def supply(t):
    """Suppliers and the parts of their lines as a graph of text ids."""
    e = t.lineitem.select(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("dst")).distinct().withColumn("relation", F.lit("supplies"))
    return e.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), e


@query("g4_communities")
def _(t):
    return G.communities(*supply(t))


# Of a forest of stars the communities with the largest modularity are the stars themselves, if there are enough of them.
@query("g4_star_communities", "WITH n AS (SELECT c_nationkey, min('C' || c_custkey) AS least FROM customer GROUP BY 1) SELECT 'C' || c_custkey AS id, least AS community FROM customer JOIN n USING (c_nationkey) UNION ALL SELECT 'N' || c_nationkey, least FROM n")
def _(t):
    e = t.customer.select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("src"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("dst"), F.lit("lives in").alias("relation"))
    return G.communities(e.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), e)


@query("g4_modularity", "WITH e AS (SELECT DISTINCT l_partkey, l_suppkey, s_nationkey AS c FROM lineitem JOIN supplier ON l_suppkey = s_suppkey), x AS (SELECT l_partkey % 25 AS a, c AS b FROM e), d AS (SELECT c, count(*) AS k FROM (SELECT a AS c FROM x UNION ALL SELECT b FROM x) GROUP BY 1), i AS (SELECT a AS c, count(*) AS n FROM x WHERE a = b GROUP BY 1) SELECT round(sum(coalesce(n, 0) / m - (k / (2.0 * m)) ** 2), 8) AS modularity FROM d LEFT JOIN i USING (c), (SELECT CAST(count(*) AS DOUBLE) AS m FROM e)")
def _(t):
    nodes, edges = supply(t)
    nation = t.supplier.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_nationkey").cast("int").alias("community"))
    parts = nodes.where(F.col("id").startswith("P")).select("id", (F.substring("id", 2, 20).cast("int") % 25).alias("community"))
    return G.modularity(edges, nation.unionByName(parts)).select(F.round("modularity", 8).alias("modularity"))


def by_nation(t):
    return t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("community"))


def supplier_pairs(t):
    """Suppliers of one line and the next of an order."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey")
    met = t.lineitem.select(F.col("l_suppkey").alias("x"), F.lead("l_suppkey").over(w).alias("y")).where("x <> y")
    return met.select(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst")).distinct().withColumn("relation", F.lit("met"))


PAIRS = "(SELECT DISTINCT least(x, y) AS src, greatest(x, y) AS dst FROM (SELECT l_suppkey AS x, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) AS y FROM lineitem) WHERE x <> y)"


@query("g5_members", "SELECT s_nationkey AS community, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS position, s_suppkey AS id FROM supplier")
def _(t):
    return G.members(by_nation(t))


@query(
    "g6_community_context",
    f"""SELECT a.s_nationkey AS community, 'relation' AS kind, src || ' - met - ' || dst AS line FROM {PAIRS} JOIN supplier a ON src = a.s_suppkey JOIN supplier b ON dst = b.s_suppkey WHERE a.s_nationkey = b.s_nationkey
    UNION ALL SELECT s_nationkey, 'member', CAST(s_suppkey AS VARCHAR) FROM supplier""",
)
def _(t):
    return G.community_context(supplier_pairs(t), by_nation(t))


@query("g7_graph_summary", f"SELECT (SELECT count(*) FROM supplier) AS nodes, (SELECT count(*) FROM {PAIRS}) AS edges, (SELECT count(DISTINCT s_nationkey) FROM supplier) AS communities")
def _(t):
    return G.graph_summary(by_nation(t), supplier_pairs(t), by_nation(t))


# ---- pages ----------------------------------------------------------------------------------------------------------


LINK = f"""(SELECT url AS page_url, CAST(i - 1 AS INTEGER) AS position, a[CAST(i AS INTEGER)] AS a FROM (SELECT url, regexp_extract_all(html, '(?is)(<a\\b[^>]*>.*?</a\\s*>)', 1) AS a FROM pages), unnest(range(1, len(a) + 1)) r(i))"""
LINKS = f"""(SELECT page_url, position, href, {html_text('a')} AS text, CASE WHEN link = '' THEN page_url WHEN regexp_matches(link, '^[a-zA-Z][\\w+.-]*:') THEN link WHEN link LIKE '//%' THEN regexp_extract(page_url, '^([a-zA-Z][\\w+.-]*:)', 1) || link
    WHEN link LIKE '/%' THEN regexp_extract(page_url, '^([a-zA-Z][\\w+.-]*://[^/?#]*)', 1) || link WHEN link LIKE '?%' THEN regexp_replace(page_url, '[?#].*$', '') || link WHEN link LIKE '#%' THEN regexp_replace(page_url, '#.*$', '') || link
    ELSE CASE WHEN regexp_matches(page_url, '^[a-zA-Z][\\w+.-]*://[^/?#]*([?#].*)?$') THEN regexp_replace(page_url, '[?#].*$', '') || '/' ELSE regexp_replace(regexp_replace(page_url, '[?#].*$', ''), '[^/]*$', '') END || link END AS url
    FROM (SELECT *, trim(regexp_replace(href, '(?i)^href:\\s*', '')) AS link FROM (SELECT page_url, position, a, regexp_extract(a, '(?is)^<a\\b[^>]*?\\bhref\\s*=\\s*["'']?([^"''>\\s]*)', 1) AS href FROM {LINK} WHERE regexp_matches(a, '(?is)^<a\\b[^>]*\\bhref\\s*='))))"""


@query("l1_links", f"SELECT * FROM {LINKS}")
def _(t):
    return L.links(t.pages)


def url_links(t):
    """A tree of addresses over the parts: /1, /1/2, ... each links to its two children and to a stranger."""
    url = lambda k: F.concat(F.lit("http://x.example/"), k.cast("string"))
    k = F.col("p_partkey")
    return t.part.select(url(k).alias("src"), F.explode(F.array(url(k * 2), url(k * 2 + 1), F.lit("http://y.example/"))).alias("dst"))


@query("l2_reachable", "WITH RECURSIVE r(k, depth) AS (SELECT CAST(1 AS BIGINT), 0 UNION ALL SELECT k * 2 + c, depth + 1 FROM r, (VALUES (0), (1)) x(c) WHERE depth < 6 AND k <= (SELECT max(p_partkey) FROM part)) SELECT 'http://x.example/' AS seed, 'http://x.example/' || k AS url, depth FROM r WHERE k > 1")
def _(t):
    start = t.spark.createDataFrame([("http://x.example/", "http://x.example/1")], "src string, dst string")
    seeds = t.spark.createDataFrame([("http://x.example/",)], "seed string")
    got = L.reachable(url_links(t).unionByName(start), seeds, 7)
    return got.where("depth > 1").withColumn("depth", F.col("depth") - 1)


@query("l3_find_files", f"SELECT * FROM (SELECT page_url, position, href, text, url || '.pdf?x=1' AS url FROM {LINKS}) WHERE lower(regexp_extract(url, '^[^?#]*')) LIKE '%.pdf' AND (lower(url) LIKE '%th%' OR lower(text) LIKE '%th%') AND url <> '' QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_url, position) = 1")
def _(t):
    return L.find_files(L.links(t.pages).withColumn("url", F.concat("url", F.lit(".pdf?x=1"))), ["pdf"], "th")


@query(
    "l4_articles",
    f"""WITH b AS (SELECT url, {paragraphs('html')} AS body FROM pages QUALIFY row_number() OVER (PARTITION BY url ORDER BY length(body) DESC, body) = 1)
    SELECT p.url, substr(html, 1, 20) AS title, 'snippet' AS snippet, page_id AS arrived, CASE WHEN length(body) > 200 AND NOT regexp_matches(lower(body), '{BOT}') THEN substr(body, 1, 4000) ELSE 'snippet' END AS summary
    FROM pages p JOIN b ON b.url = p.url WHERE p.url <> '' AND p.url NOT IN (SELECT url FROM pages WHERE page_id % 10 = 0 AND url IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY p.url ORDER BY page_id) = 1""",
)
def _(t):
    results = t.pages.select("url", F.substring("html", 1, 20).alias("title"), F.lit("snippet").alias("snippet"), F.col("page_id").alias("arrived"))
    return L.articles(results, t.pages, t.pages.where("page_id % 10 = 0").select("url"))


@query("l5_search_jobs", "SELECT conv_id, turn, k AS keyword, k || ' when:7d' AS search, replace(k, ' ', '+') || '+when%3A7d' AS search_url FROM conversations, LATERAL (VALUES (role), ('bank loan')) x(k)")
def _(t):
    return L.search_jobs(t.conversations, F.concat(F.lit(" "), F.col("role"), F.lit(" ,, bank loan")), F.lit("w")).select("conv_id", "turn", "keyword", "search", "search_url")


@query("l6_ingest_outcomes", "SELECT page_id AS doc_id, CASE WHEN page_id IN (SELECT doc_id FROM labels) THEN 'skipped' ELSE 'added' END AS outcome FROM pages")
def _(t):
    return L.ingest_outcomes(t.pages.select(F.col("page_id").alias("doc_id")), t.labels, "doc_id")


# ---- streams: the batch twins --------------------------------------------------------------------------------------


def requests(t):
    return t.events.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", (F.lit(200) + F.floor("value").cast("int") % 400).alias("status"), F.floor("value").cast("long").alias("duration_ms"))


def one_more(t, df, folder: str):
    """A stream of a table's rows, and of one row a year later that closes all that is open on a stream. ``df``: the rows as a batch, with ts."""
    path = new_path(t.spark, folder)
    df.write.parquet(f"{path}/rows")
    end = F.max("ts") + F.expr("INTERVAL 365 DAYS")
    df.agg(end.alias("ts")).select(*[F.col("ts") if c == "ts" else F.lit(None).cast(k).alias(c) for c, k in df.dtypes]).write.parquet(f"{path}/end")
    read = t.spark.readStream.schema(df.schema).parquet
    return read(f"{path}/rows").union(read(f"{path}/end"))


def landed(t, stream, mode: str = "append"):
    """All rows that a stream gives, through batches that count once."""
    path = new_path(t.spark, "landed")
    run_stream(stream, lambda df, n: S.append(df.withColumn("__batch", F.lit(n)), path, batch=n), t.spark, mode)
    schema = T.StructType([*stream.schema.fields, T.StructField("__batch", T.IntegerType())])
    return commits.read(t.spark, path, schema, ledger=True)


@query("m1_daily_stats", "SELECT CAST(ts AS DATE) AS day, count(*) AS total, count(DISTINCT user_id) AS users, count(*) FILTER ((200 + CAST(floor(value) AS INTEGER) % 400) >= 400) AS errors, CAST(floor(avg(CAST(floor(value) AS BIGINT))) AS BIGINT) AS mean_ms FROM events GROUP BY 1")
def _(t):
    return landed(t, M.daily_stats_exact(one_more(t, requests(t), "requests"))).drop("__batch")


@query("m3_current_state", "SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def _(t):
    return M.current_state(t.events, ["user_id"], ["event_type", "value"], "event_id")


@query("m4_tail", "SELECT event_id AS id, event_type FROM events WHERE event_id > 500")
def _(t):
    return M.tail(requests(t), 500).select("id", "event_type")


@query("m4_tail_source", "SELECT event_id AS id, event_type FROM events WHERE event_id > 500")
def _(t):
    log, path, checkpoint = (new_path(t.spark, x) for x in ("log", "landed", "stream"))
    rows = requests(t).select("id", "event_type")
    half = (rows.agg(F.max("id")).first()[0] or 0) // 2
    for part in (F.col("id") <= half, F.col("id") > half):  # the stream stops, the log grows, the stream goes on
        rows.where(part).repartitionByRange("id").write.mode("append").parquet(log)
        stream = tail_stream(t.spark, log, rows.schema, "id", 500)
        run_stream(stream, lambda df, n: S.append(df, path, batch=n, keys=["id"]), t.spark, checkpoint=checkpoint)
    return commits.read(t.spark, path, rows.schema, ledger=True)


@query("m6_assemble_text", "SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text, count(*) AS tokens FROM conversations GROUP BY 1")
def _(t):
    return M.assemble_text(t.conversations, "conv_id", "turn", "text", " ")


def stream_of(t, name: str):
    """A table's files as a stream."""
    return t.spark.readStream.schema(getattr(t, name).schema).parquet(f"{t.folder}/{name}.parquet*")


def run_stream(stream, sink, spark, mode: str = "append", checkpoint: str | None = None) -> None:
    """All that is there now, through a foreachBatch sink, with a checkpoint in the shared folder: a new one, or that of an earlier run to go on from."""
    job = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint or new_path(spark, "stream")).trigger(availableNow=True).start()
    job.awaitTermination()


@query("m2_ledger_stream", "SELECT user_id, event_type, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY 1, 2")
def _(t):
    path = new_path(t.spark, "ledger")
    rows = stream_of(t, "events").select("user_id", "event_type", "event_id", "value")
    for _ in range(2):  # the second time all of it is known
        run_stream(rows, M.ledger_sink(path, ["user_id", "event_type"], ["event_id"]), t.spark)
    return commits.read(t.spark, path, rows.schema, ledger=True)


@query("m2_ledger_window", "SELECT user_id, event_type, count(*) > 0 AS known FROM events WHERE event_type IS NOT NULL GROUP BY 1, 2")
def _(t):
    rows = stream_of(t, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type").where("event_type is not null")
    return landed(t, M.ledger_stream(rows, ["user_id", "event_type"], "3650 days")).select("user_id", "event_type", F.lit(True).alias("known"))


@query(
    "m3_task_clock",
    """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS document_id, event_type AS task_type, CAST(floor(value) AS INTEGER) % 3 * 50 AS percent, CAST(event_id AS DOUBLE) AS seen FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL)
    SELECT document_id, task_type, arg_max(percent, seen) AS percent, max(seen) AS updated_at, coalesce(max(seen) FILTER (percent = 0), min(seen)) AS start_time FROM e GROUP BY 1, 2""",
)
def _(t):
    e = stream_of(t, "events").where("user_id is not null and event_type is not null")
    rows = e.select(F.col("user_id").cast("string").alias("document_id"), F.col("event_type").alias("task_type"), F.lit("Running").alias("status"), (F.floor("value").cast("int") % 3 * 50).alias("percent"), F.col("event_id").cast("double").alias("updated_at"))
    every = landed(t, M.task_state(rows), "update")  # a task's row of the last batch is its state
    return every.groupBy("document_id", "task_type").agg(*[F.max_by(c, "__batch").alias(c) for c in ("percent", "updated_at", "start_time")])


@query("m5_status_upkeep", "WITH a AS (SELECT l_orderkey AS id, count(*) AS n, count(*) FILTER (l_linestatus = 'F') AS d, count(*) FILTER (l_linestatus <> 'F' AND l_returnflag = 'N') AS b FROM lineitem GROUP BY 1) SELECT o_orderkey AS project_id, CASE WHEN n IS NULL THEN 'Open' WHEN d >= n THEN 'Completed' WHEN d > 0 OR b > 0 THEN 'Active' ELSE 'Not Started' END AS status FROM orders LEFT JOIN a ON id = o_orderkey")
def _(t):
    path = new_path(t.spark, "projects")
    first = t.orders.select(F.col("o_orderkey").alias("project_id"), F.lit("Open").alias("status"), F.lit(0).alias("updated_at"))
    commits.write(first, path, 0, ["project_id"])

    def apply(projects, changed):
        projects = durable(projects, "projects")  # what is read here is not what is written
        changed = commits.dealt_by_rows(durable(changed, "changed"), ["project_id"], projects.count() + items(t).count())
        synced = C.sync_status(projects.join(changed, "project_id", "left_semi"), items(t).join(changed, "project_id", "left_semi"), F.lit(1))
        return projects.join(changed, "project_id", "left_anti").unionByName(synced)

    run_stream(stream_of(t, "lineitem").select("l_orderkey"), M.upkeep_sink(path, first.schema, "project_id", "l_orderkey", apply), t.spark)
    return commits.read(t.spark, path, first.schema).select("project_id", "status")


@query("c1_upsert_stream", "SELECT c_custkey, c_name, coalesce(price, c_acctbal) AS c_acctbal, CASE WHEN price IS NULL THEN 0 ELSE 1 END AS is_active FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS price FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def _(t):
    path = new_path(t.spark, "customers")
    first = t.customer.select("c_custkey", "c_name", "c_acctbal", F.lit(0).alias("is_active"))
    commits.write(first, path, 0, ["c_custkey"])
    rows = stream_of(t, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("c_acctbal"), "o_orderkey")
    run_stream(rows, M.upsert_sink(path, first.schema, ["c_custkey"], ["c_acctbal"], [F.col("o_orderkey").desc()], {"is_active": 1}), t.spark)
    return commits.read(t.spark, path, first.schema)


# ---- sinks: written, and what is read back -------------------------------------------------------------------------


@query("s8_load_summaries", "SELECT 'D' || label AS document_id, CAST(vec_id AS INTEGER) AS community_id, 'old' AS summary_text, embedding[1] AS first FROM embeddings WHERE label IS DISTINCT FROM 0 UNION ALL SELECT 'D0', CAST(vec_id AS INTEGER), 'new ' || vec_id, embedding[1] FROM embeddings")
def _(t):
    path, v = new_path(t.spark, "summaries"), F.col("vec_id")
    S.write_json(t.embeddings.select(v.cast("int").alias("community_id"), F.concat(F.lit("new "), v.cast("string")).alias("summary_text"), "embedding"), path)
    current = t.embeddings.select(F.concat(F.lit("D"), F.col("label").cast("string")).alias("document_id"), v.cast("int").alias("community_id"), F.lit("old").alias("summary_text"), "embedding")
    return S.load_summaries(t.spark, path, "D0", current).select("document_id", "community_id", "summary_text", F.get("embedding", F.lit(0)).alias("first"))


@query("s10_list_documents", "SELECT DISTINCT coalesce(source, 'none') AS source, true AS named FROM documents")
def _(t):
    path = new_path(t.spark, "files")
    t.documents.select(F.coalesce("source", F.lit("none")).alias("source"), F.coalesce("text", F.lit("")).alias("text")).write.partitionBy("source").text(path)
    files = S.list_documents(t.spark, path, "txt")
    return files.groupBy(F.regexp_extract("path", "/source=([^/]*)/", 1).alias("source")).agg(F.min(F.col("document_id").startswith("part-") & ~F.col("document_id").contains(".txt")).alias("named"))


@query("s11_append", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'none' ELSE event_type END AS event_type, value FROM events")
def _(t):
    path = new_path(t.spark, "log")
    rows = t.events.select("event_id", F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("event_type"), "value")
    for part in (0, 1, 1):  # a batch that is repeated counts once
        S.append(rows.where(F.pmod("event_id", F.lit(2)) == part), path, {"event_type": "none"}, batch=part, keys=["event_id"])
    return commits.read(t.spark, path, rows.schema, ledger=True)


@query("s14_json_round_trip", "SELECT vec_id, label, embedding[1] AS first, CAST(len(embedding) AS INTEGER) AS n FROM embeddings")
def _(t):
    path = new_path(t.spark, "json")
    S.write_json(t.embeddings, path)
    return t.spark.read.schema(t.embeddings.schema).json(path).select("vec_id", "label", F.get("embedding", F.lit(0)).alias("first"), F.size("embedding").alias("n"))


@query("s15_graph_round_trip", f"SELECT 'node' AS kind, 'P' || l_partkey AS a, arg_max(l_returnflag, (l_orderkey, p)) AS b FROM {ORDERED} GROUP BY 2 UNION ALL SELECT DISTINCT 'node', 'S' || l_suppkey, 'Unknown' FROM lineitem UNION ALL SELECT DISTINCT 'edge', 'P' || l_partkey, 'S' || l_suppkey FROM lineitem")
def _(t):
    path, found = new_path(t.spark, "graph"), durable(G.triples(payloads(t), "payload"), "triples")  # read for the nodes and for the edges
    S.write_graph(G.nodes(found), G.edges(found), path)
    read = t.spark.read.parquet
    return read(f"{path}/nodes").select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("type").alias("b")).union(read(f"{path}/edges").select(F.lit("edge"), "src", "dst"))


@query("s17_editable_columns", " UNION ALL ".join(f"SELECT '{c}' AS name, CAST({i} AS INTEGER) AS place, count({c}) AS filled FROM customer" for i, c in enumerate(("c_name", "c_nationkey", "c_acctbal", "c_mktsegment"))))
def _(t):
    columns = S.editable_columns(t.customer, "c_custkey")
    filled = t.customer.agg(*[F.count(c).alias(c) for c in columns])
    return filled.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.lit(i).alias("place"), F.col(c).alias("filled")) for i, c in enumerate(columns)])).alias("x")).select("x.*")
