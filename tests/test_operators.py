"""Hand-made cases of operators whose rules show best on a few rows."""

from decimal import Decimal

import duckdb
import pandas as pd
import pytest
from millrace.operators import changes as C
from millrace.operators import graph as G
from millrace.operators import joins as J
from millrace.operators import pages as L
from millrace.operators import position as W
from millrace.operators import retrieval as R
from millrace.operators import statements as ST
from millrace.operators import trees as TR
from millrace.sources import feeds as S
from millrace.streaming import streams as M
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_insert_ignore_is_idempotent(spark):
    ledger = spark.createDataFrame([(1, "a", 1.0)], "d int, k string, v double")
    batch = spark.createDataFrame([(1, "a", 9.0), (2, "a", 2.0), (2, "a", 3.0)], "d int, k string, v double")
    after, new = C.insert_ignore(ledger, batch, ["d", "k"], ["v"])
    assert rows(new) == [(2, "a", 2.0)] and rows(after, "d") == [(1, "a", 1.0), (2, "a", 2.0)]
    assert C.insert_ignore(after, batch, ["d", "k"], ["v"])[1].count() == 0


def test_upsert_overwrites_with_null(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k int, x string, y int")
    new = spark.createDataFrame([(2, None), (3, "c")], "k int, x string")
    assert rows(C.upsert(old, new, ["k"], ["x"], {"y": 1}), "k") == [(1, "a", 5), (2, None, 1), (3, "c", 1)]


def test_tree_with_odd_parents(spark):
    defs = spark.createDataFrame([(1, "NULL", "1", "a", 0), (2, "1", "12", "b", 1), (3, "", "2", "c", 0), (4, "3", "20", "d", 1), (5, "99", "3", "e", 1), (6, "0", "10", "f", 1)], "id int, parent_id string, code string, name string, is_leaf int")
    amounts = spark.createDataFrame([(1, 1, 1.0), (2, 1, 2.0), (4, 2, 4.0), (5, 1, 8.0), (4, 2, None)], "id int, period_id int, original_value double")
    rolled = TR.rollup_tree(defs, amounts)
    assert {(r.id, r.period_id): r.amount for r in rolled.collect() if r.amount} == {(1, 1): 3.0, (2, 1): 2.0, (3, 2): 4.0, (4, 2): 4.0, (5, 1): 8.0}
    assert [(r.id, r.depth, r.has_children) for r in TR.preorder(defs).collect()] == [(1, 0, True), (2, 1, False), (6, 0, False), (3, 0, True), (4, 1, False)]
    assert rows(TR.asset_series(rolled, defs), "period_id") == [(1, 3.0), (2, 4.0)]
    leaves = defs.where("id in (2, 4)").withColumn("parent_id", F.lit(None).cast("string"))
    assert rows(TR.asset_series(TR.rollup_tree(leaves, amounts), leaves), "period_id") == [(1, 2.0), (2, 4.0)]


def test_codes_attach_to_the_next_line(spark):
    lines = ["1.1", "Kasa", "5", "I.", "II.", "Son", "2.2", "7"]
    df = spark.createDataFrame([(0, i, x) for i, x in enumerate(lines)], "d int, n int, line string")
    got = W.attach_next(df, ["d"], ["n"], "line", F.col("line").rlike(r"^([IVX]+\.|\d\.\d)$"), F.col("line").rlike(r"^\d$"))
    assert [r.line for r in got.orderBy("n").collect()] == ["1.1 Kasa", "5", "I. II.", "Son", "2.2", "7"]


def test_statement_end_to_end(spark):
    text = "Bilanço\nBin TL\n31 Aralık 2024\n31 Aralık 2023\nVARLIKLAR\nDipnot\nDönen Varlıklar:\nNakit\n3\n1.234\n(5)\nAlacaklar\nTicari\n10\n-\nTOPLAM VARLIKLAR\n99\n100\nÖZKAYNAKLAR\nSermaye\n7\n8"
    pages = spark.createDataFrame([(1, 0, "İçindekiler\nBilanço"), (1, 1, text), (1, 2, "Cari Dönem\nYedekler\n70\n80"), (2, 0, "nothing here"), (2, 1, None)], "doc_id int, page_no int, text string")
    kept = ST.classify_pages(pages)
    assert rows(kept.select("doc_id", "page_no", "statement", "scale"), "doc_id", "page_no") == [(1, 1, ST.BALANCE, 1000), (1, 2, ST.BALANCE, 1000), (2, 0, ST.BALANCE, 1000)]
    periods = ST.periods(kept)
    assert rows(periods.where("doc_id = 1").select("period_code"), "period_no") == [("202412",), ("202312",)]
    assert rows(periods.where("doc_id = 2").select("period_code"), "period_no") == [("202512",), ("202412",)]
    got = ST.statement_lines(ST.clean_lines(kept), periods).where("doc_id = 1 and period_code = '202412'").orderBy("line_order").collect()
    d = Decimal
    assert [(r.section, r.parent, r.label, r.note, r.amount, r.depth, r.subtotal) for r in got] == [
        ("VARLIKLAR", None, "VARLIKLAR", None, None, 0, 0), ("VARLIKLAR", "VARLIKLAR", "Dönen Varlıklar", None, None, 1, 0), ("VARLIKLAR", "Dönen Varlıklar", "Nakit", "3", d("1234000.00"), 2, 0),
        ("VARLIKLAR", "Dönen Varlıklar", "Alacaklar Ticari", None, d("10000.00"), 2, 0), ("VARLIKLAR", "Dönen Varlıklar", "TOPLAM VARLIKLAR", None, d("99000.00"), 2, 1),
        ("ÖZKAYNAKLAR", None, "ÖZKAYNAKLAR", None, None, 0, 0), ("ÖZKAYNAKLAR", "ÖZKAYNAKLAR", "Sermaye", None, d("7000.00"), 2, 0), ("ÖZKAYNAKLAR", "ÖZKAYNAKLAR", "Yedekler", None, d("70000.00"), 2, 0),
    ]


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_statements_are_dealt_once(spark, tmp_path):
    """Pages are dealt, not their lines: one shuffle each for the lines and the periods, and no item is worked out twice."""
    path = str(tmp_path / "pages")
    spark.createDataFrame([(1, 0, "BALANCE_SHEET", 1000, "31 Aralık 2024\nVARLIKLAR\n1.1.1 Kasa\n1,00\n2,00")], "doc_id int, page_no int, statement string, scale int, text string").write.parquet(path)
    pages = spark.read.parquet(path)
    assert exchanges(ST.periods(pages)) == 2 and exchanges(ST.clean_lines(pages)) == 1
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert exchanges(ST.statement_lines(ST.clean_lines(pages, 7), ST.periods(pages))) <= 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert ST.line_tasks(pages) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_codes_dashes_and_groups_of_a_statement(spark):
    text = "Gelir Tablosu\n31 Aralık 2024\n31 Aralık 2023\nI. ESAS FAALİYET GELİRLERİ\n100\n90\n1.1 Faiz\n60\n50\n1.1.1 Bireysel\n40\n30\n- Konut\n20\n10\nDiğer\n- Araç\n15\n14\n2.1 Ücret\n17\n16\n2.1.1.1 Alt\n21\n22\nFon\n31\n32\n- Son\n33\n34"
    kept = ST.classify_pages(spark.createDataFrame([(1, 0, text)], "doc_id int, page_no int, text string"))
    got = ST.statement_lines(ST.clean_lines(kept), ST.periods(kept)).where("period_code = '202312'").orderBy("line_order").collect()
    first = "I. ESAS FAALİYET GELİRLERİ"
    assert [(r.section, r.parent, r.label, r.depth, r.amount and int(r.amount)) for r in got] == [
        (first, None, first, 0, 90_000), (first, first, "1.1 Faiz", 1, 50_000), (first, "1.1 Faiz", "1.1.1 Bireysel", 2, 30_000), (first, "1.1 Faiz", "- Konut", 3, 10_000), (first, "1.1 Faiz", "Diğer", 2, None),
        (first, "Diğer", "- Araç", 3, 14_000), (first, "2.1 Ücret", "2.1 Ücret", 1, 16_000), (first, "2.1 Ücret", "2.1.1.1 Alt", 3, 22_000), (first, "2.1 Ücret", "Fon", 2, 32_000), (first, "2.1 Ücret", "- Son", 3, 34_000),
    ]


def test_chunks_keep_the_text(spark):
    words = " ".join(f"w{i}" for i in range(400))
    for size, overlap in ((100, 20), (500, 50)):
        parts = R.split_text(words, size, overlap)
        assert all(len(p) <= size for p in parts) and {w for p in parts for w in p.split()} == set(words.split())
        assert all(a.split()[-1] in b.split() for a, b in zip(parts, parts[1:]))
    assert R.split_text("x" * 250, 100, 0) == ["x" * 100, "x" * 100, "x" * 50] and R.split_text("", 10, 0) == []
    assert R.chunk(spark.createDataFrame([(1, None), (2, "a b")], "document_id long, text string"), 10, 0, 1).count() == 1


def test_fusion_ties_and_single_lists(spark):
    a = spark.createDataFrame([("x", 0), ("y", 1)], "id string, rank int")
    b = spark.createDataFrame([("y", 0), ("z", 1)], "id string, rank int")
    got = dict(rows(R.fuse(a, b)))
    assert got["y"] == pytest.approx(1 / 61 + 1 / 60) and got["x"] == pytest.approx(1 / 60) and got["z"] == pytest.approx(1 / 61)


def test_cells_of_cosines_equal_the_scores_of_pairs(spark, monkeypatch):
    some = [[float(i % 5), 1.0, i / 7] for i in range(20)] + [[0.0, 0.0, 0.0], None, [1.0, None, 2.0], [1.0, 2.0], []]
    vectors = spark.createDataFrame(list(enumerate(some)), "id int, embedding array<float>")
    asked = vectors.where("id % 2 = 0 or id > 19").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    key = lambda r: {(x.id, x.query_id): None if x.score is None else round(x.score, 9) for x in r.collect()}
    want = key(J.score_pairs(asked, vectors, R.cosine))
    monkeypatch.setattr(J, "CELL_VECTORS", 7)
    monkeypatch.setattr(J, "CELL_QUERIES", 4)
    got = J.cosine_pairs(asked, vectors)
    assert key(got) == want and got.count() == len(want) == len(some) * asked.count()
    assert J.cosine_pairs(asked.where("false"), vectors).count() == 0


def test_cells_hold_few_copies_and_all_pairs(spark, monkeypatch):
    vectors = spark.range(6000).select("id", F.array(F.col("id") % 7 + 1.0, F.lit(1.0)).alias("embedding"))
    asked = vectors.where("id % 4 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    assert J.cells(asked, vectors).count() == 6000 + 1500
    pairs = J.cosine_pairs(asked, vectors)
    assert pairs.count() == pairs.select("id", "query_id").distinct().count() == 6000 * 1500
    monkeypatch.setattr(J, "PIECE", 3000)
    assert J.cosine_pairs(asked, vectors).agg(F.count(F.lit(1)), F.round(F.sum("score"), 6)).first() == pairs.agg(F.count(F.lit(1)), F.round(F.sum("score"), 6)).first()


def test_queries_in_blocks_score_the_same(spark, monkeypatch):
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "id int, embedding array<double>")
    asked = vectors.where("id % 2 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    want = sorted((i, q, i * q + 1.0) for i in range(20) for q in range(0, 20, 2))
    for block in (64, 3):
        monkeypatch.setattr(J, "QUERY_BLOCK", block)
        assert sorted(rows(J.score_pairs(asked, vectors, dot).select("id", "query_id", "score"))) == want
    assert J.score_pairs(asked.where("false"), vectors, dot).count() == 0


def test_positions_within_groups(spark):
    df = spark.createDataFrame([(g, i * 7 % 11) for g in ("a", None, "b") for i in range(11)], "g string, x int")
    got = rows(W.rank_zero(df, ["g"], [F.col("x").desc()]).select("g", "x", "rank"))
    assert sorted(got, key=str) == sorted(((g, x, 10 - x) for g in ("a", None, "b") for x in range(11)), key=str)


def test_small_scans_are_dealt_out(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    assert one.rdd.getNumPartitions() == 1 and S.spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert rows(S.spread(one), "id") == [(i,) for i in range(100)]
    many = spark.range(0, 100, 1, 50)
    assert S.spread(many) is many


def test_communities_of_two_cliques(spark):
    clique = lambda p: [(f"{p}{i}", f"{p}{j}", "r") for i in range(6) for j in range(i + 1, 6)]
    edges = spark.createDataFrame([*clique("a"), *clique("b"), ("a0", "b0", "r")], "src string, dst string, relation string")
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    labels = {r.id: r.community for r in G.communities(nodes, edges).collect()}
    assert len({labels[f"a{i}"] for i in range(6)}) == 1 and len({labels[f"b{i}"] for i in range(6)}) == 1 and labels["a1"] != labels["b1"]


def connected(edges, members):
    """Whether the links among ``members`` connect them."""
    seen, edge = set(), {min(members)}
    while edge:
        seen |= edge
        edge = {b for x in edges for a, b in (x, x[::-1]) if a in edge and b in members} - seen
    return seen == set(members)


def test_communities_are_connected(spark):
    """A graph of rings and chords at random: every community holds together by its own links, and is no worse than one level of plain moves."""
    draw = __import__("random").Random(3)
    edges = sorted({tuple(sorted((i, (i + 1) % 60))) for i in range(60)} | {tuple(sorted(draw.sample(range(60), 2))) for _ in range(40)})
    frame = spark.createDataFrame([(a, b, "r") for a, b in edges], "src int, dst int, relation string")
    found = {r.id: r.community for r in G.communities(spark.createDataFrame([(x,) for x in range(61)], "id int"), frame).collect()}
    groups = {c: {x for x, of in found.items() if of == c} for c in found.values()}
    assert all(min(m) == c and connected(edges, m) for c, m in groups.items()) and groups[60] == {60}
    assert plain_modularity(edges, found) >= plain_modularity(edges, greedy(edges))


def greedy(edges):
    """One level of plain single moves, node by node, until none gains."""
    group, moved = {x: x for e in edges for x in e}, True
    while moved:
        moved = False
        for x in sorted(group):
            now = plain_modularity(edges, group)
            options = {group[b] for e in edges for a, b in (e, e[::-1]) if a == x}
            best = max(options, key=lambda c: (plain_modularity(edges, group | {x: c}), -c))
            if plain_modularity(edges, group | {x: best}) > now + 1e-9:
                group[x], moved = best, True
    return group


def test_parts_of_a_cut_community(spark):
    pairs = spark.createDataFrame([(a, b) for x in [(1, 2), (2, 3), (4, 5), (3, 9), (9, 4)] for a, b in (x, x[::-1])], "u int, v int")
    labels = spark.createDataFrame([(i, 7) for i in (1, 2, 3, 4, 5, 6)] + [(9, 8)], "id int, community int")
    assert rows(G.connected_parts(pairs, labels), "id") == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (9, 9)]


def partitions(items):
    """All ways to put items into groups, as a list of group numbers."""
    ways = [[0]]
    for _ in items[1:]:
        ways = [[*w, g] for w in ways for g in range(max(w) + 2)]
    return ways


def plain_modularity(edges, group):
    m = len(edges)
    degree, inside = {}, 0
    for a, b in edges:
        inside += group[a] == group[b]
        for x in (a, b):
            degree[group[x]] = degree.get(group[x], 0) + 1
    return inside / m - sum((k / (2 * m)) ** 2 for k in degree.values())


@pytest.mark.parametrize("edges, slack", [([(a, b) for t in (0, 3, 6) for a, b in ((t, t + 1), (t, t + 2), (t + 1, t + 2), (t, (t + 4) % 9))], 1e-9), ([(0, 1), (0, 2), (0, 3), (1, 4), (2, 5), (3, 6), (4, 5), (6, 7), (5, 7), (1, 6)], 0.05)])
def test_communities_reach_the_best_modularity(spark, edges, slack):
    n = sorted({x for e in edges for x in e})
    best = max(plain_modularity(edges, dict(zip(n, w))) for w in partitions(n))
    frame = spark.createDataFrame([(a, b, "r") for a, b in edges], "src int, dst int, relation string")
    labels = G.communities(spark.createDataFrame([(x,) for x in n], "id int"), frame).cache()
    found = plain_modularity(edges, {r.id: r.community for r in labels.collect()})
    assert best - slack <= found <= best + 1e-9
    assert abs(G.modularity(frame, labels).first()[0] - found) < 1e-9
    assert {r.community for r in labels.collect()} == {min(r.id for r in labels.collect() if r.community == c) for c in {r.community for r in labels.collect()}}


def test_members_and_contexts(spark):
    labels = spark.createDataFrame([(5, 1), (3, 1), (4, 2)], "id int, community int")
    edges = spark.createDataFrame([(3, 5, "knows"), (3, 4, "knows")], "src int, dst int, relation string")
    assert rows(G.members(labels), "community", "position") == [(1, 0, 3), (1, 1, 5), (2, 0, 4)]
    context = G.community_context(edges, labels)
    assert rows(context, "community", "kind", "line") == [(1, "member", "3"), (1, "member", "5"), (1, "relation", "3 - knows - 5"), (2, "member", "4")]
    assert rows(G.context_text(context, 1)) == [(1, "3 - knows - 5", "3, 5")]


def test_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    from millrace.operators import durable

    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("S", (), {"master": "spark://x", "getCheckpointDir": staticmethod(lambda: None)})

    with pytest.raises(ValueError):
        durable.shared_dir(Cluster())


def test_triples_skip_strays(spark):
    payload = '{"nodes": [{"id": "A", "type": "x"}, "stray", {"name": "B"}, {"type": "y"}], "edges": [{"source": "B", "target": "A"}, {"source": "C"}, 5]}'
    t = G.triples(spark.createDataFrame([(1, payload), (2, "bad"), (3, '{"nodes": [{"id": "A", "type": "z"}]}')], "seq int, payload string"), "payload")
    assert sorted(rows(G.nodes(t))) == [("A", "z"), ("B", "Unknown")] and rows(G.edges(t)) == [("A", "B", "related")]


def test_links_and_reach(spark):
    html = '<a href="/x">To <b>x</b></a> <a class=q HREF=y.pdf>File</a><a name="n">none</a>'
    got = rows(L.links(spark.createDataFrame([("http://h/a/", html), ("http://h/b", None)], "url string, html string")), "position")
    assert [(r[2], r[3], r[4]) for r in got] == [("/x", "To x", "http://h/x"), ("y.pdf", "File", "http://h/a/y.pdf")]
    links = spark.createDataFrame([("s", "s1"), ("s1", "s2"), ("s2", "s"), ("s", "other"), ("s1", "s1")], "src string, dst string")
    assert rows(L.reachable(links, spark.createDataFrame([("s",)], "seed string"), 5), "depth") == [("s", "s", 0), ("s", "s1", 1), ("s", "s2", 2)]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "sub").mkdir()
    for name in ("a.pdf", "sub/b.pdf", "c.txt"):
        (tmp_path / "in" / name).write_text("x")
    assert sorted(r.document_id for r in S.list_documents(spark, str(tmp_path / "in"), "pdf").collect()) == ["a", "b"]
    rates = spark.createDataFrame([(1, i, x) for i, x in enumerate(["﻿# head", "2024-01-01;1,5", "2024-01-02;.", "bad", "2024-01-03;2.5"])], "s int, n int, line string")
    assert [r.rate_value for r in S.read_rate_csv(rates, "line", "E", "n", "s").orderBy("effective_date").collect()] == [1.5, 2.5]
    feed = spark.createDataFrame([("f", "<rss><channel><item><title> </title><link>u1</link><description>&lt;b&gt;hi&lt;/b&gt;</description></item><item><title>T</title><link>u2</link></item></channel></rss>")], "feed string, xml string")
    assert rows(S.read_feed(feed, "xml", "feed"), "position") == [("f", 0, "Untitled", "u1", "hi"), ("f", 1, "T", "u2", "T")]
    summaries = spark.createDataFrame([(1, "s", [0.5])], "community_id int, summary_text string, embedding array<float>")
    S.write_json(summaries, str(tmp_path / "sum"))
    current = spark.createDataFrame([("d", 9, "old", [1.0]), ("e", 9, "stay", [1.0])], "document_id string, community_id int, summary_text string, embedding array<float>")
    assert sorted(r.summary_text for r in S.load_summaries(spark, str(tmp_path / "sum"), "d", current).collect()) == ["s", "stay"]
    S.append(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "log"), {"b": "x"})
    S.append(spark.createDataFrame([(2, "y")], "a int, b string"), str(tmp_path / "log"))
    assert rows(spark.read.parquet(str(tmp_path / "log")), "a") == [(1, "x"), (2, "y")]
    S.write_graph(summaries.select("community_id"), summaries.select("summary_text"), str(tmp_path / "graph"))
    assert spark.read.parquet(str(tmp_path / "graph" / "nodes")).count() == 1
    S.write_csv(summaries.drop("embedding"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["community_id", "summary_text"]
    schema = T.StructType.fromDDL("a int, b string")
    seed = spark.createDataFrame([(7, "seed")], schema)
    none = spark.createDataFrame([], "a int")
    assert rows(S.conform(none, schema, {"b": "d"}, seed)) == [(7, "seed")] and rows(S.conform(seed.select("a"), schema, {"b": "d"}, seed)) == [(7, "d")]
    assert S.editable_columns(seed, "a") == ["b"]


@pytest.fixture
def stream(spark, tmp_path):
    def make(frames, schema):
        source = tmp_path / "source"
        for i, f in enumerate(frames):
            spark.createDataFrame(f, schema).coalesce(1).write.mode("append").parquet(str(source))
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))

    return make


def run(df, mode, tmp_path, name, **options):
    w = df.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True)
    q = (w.foreachBatch(options["sink"]) if "sink" in options else w.format("memory").queryName(name)).start()
    q.awaitTermination(120)
    assert not q.isActive


def test_streams_equal_their_batch_twins(spark, stream, tmp_path):
    t = lambda h: (pd.Timestamp("2024-01-01") + pd.Timedelta(hours=h)).to_pydatetime()
    schema = "id long, ts timestamp, user_id long, status int, duration_ms long"
    frames = [[(1, t(1), 1, 200, 10), (2, t(2), 1, 500, 20)], [(3, t(3), 2, 200, 30), (4, t(26), 2, 404, 40)]]
    s = stream(frames, schema)
    batch = spark.createDataFrame([r for f in frames for r in f], schema)
    run(M.daily_stats(s), "complete", tmp_path, "daily")
    assert rows(spark.table("daily"), "day") == rows(M.daily_stats(batch), "day")
    assert [r[1:] for r in rows(spark.table("daily"), "day")] == [(3, 2, 1, 20), (1, 1, 1, 40)]
    run(M.current_state(s, ["user_id"], ["status"], "id"), "complete", tmp_path, "state")
    assert rows(spark.table("state"), "user_id") == [(1, 500), (2, 404)]
    run(M.tail(s, 2), "append", tmp_path, "tail")
    assert [r.id for r in spark.table("tail").orderBy("id").collect()] == [3, 4]
    run(M.ledger_stream(s, ["user_id"]), "append", tmp_path, "ledger")
    assert {r.user_id for r in spark.table("ledger").collect()} == {1, 2} and spark.table("ledger").count() == 2
    sink = M.ledger_sink(str(tmp_path / "ledger"), ["user_id"], ["id"])
    run(s, "append", tmp_path, "sink", sink=sink)
    run(s, "append", tmp_path, "again", sink=sink)
    assert spark.read.parquet(str(tmp_path / "ledger")).count() == 2
    changed = []
    run(s, "append", tmp_path, "upkeep", sink=M.status_upkeep(lambda p: changed.extend(r.user_id for r in p.collect()), "user_id"))
    assert set(changed) == {1, 2}


def test_text_and_tasks_as_streams(spark, stream, tmp_path):
    s = stream([[("m", 2, "lo")], [("m", 1, "hel")]], "key string, seq int, tok string")
    run(M.assemble_text(s, "key", "seq", "tok"), "complete", tmp_path, "text")
    assert rows(spark.table("text")) == [("m", "hello", 2)]


def test_task_clock(spark, stream, tmp_path):
    s = stream([[("d", "Map", "Running", 0, 1.0)], [("d", "Map", "Running", 50, 2.0)], [("d", "Map", "Running", 0, 3.0)], [("d", "Map", "Done", 100, 4.0)]], "document_id string, task_type string, status string, percent int, updated_at double")
    run(M.task_state(s), "update", tmp_path, "tasks")
    assert sorted({(r.percent, r.start_time) for r in spark.table("tasks").collect()}) == [(0, 1.0), (0, 3.0), (50, 1.0), (100, 3.0)]


def test_task_clock_takes_rows_in_any_order(spark, stream, tmp_path):
    n = 25_000  # more than a batch of rows that Python gets at once
    order = sorted(range(n), key=lambda i: i * 7919 % n)
    first = [("d", "Map", "Running", 0 if i == 20_000 else 50, float(i)) for i in order if i != 7]
    s = stream([first, [("d", "Map", "Late", 10, 7.0), ("e", "Map", "Running", None, 1.0)]], "document_id string, task_type string, status string, percent int, updated_at double")
    run(M.task_state(s), "update", tmp_path, "clock")
    assert {tuple(r) for r in spark.table("clock").collect()} == {("d", "Map", "Running", 50, n - 1.0, 20_000.0), ("e", "Map", "Running", None, 1.0, 1.0)}


def test_synced_limits_do_not_depend_on_the_order_of_additions(spark):
    local = spark.createDataFrame([(1, "a", 0, "s")], "customer_id long, name string, credit_limit long, sector string")
    limits = spark.createDataFrame([(1, 2024, x) for x in (111215.54, 271481.35, 136848.61)], "customer_id long, as_of int, amount double")  # 519545.50, as doubles 519545.49999999994
    got = C.sync_customers(local, local.select("customer_id", "name"), limits, spark.createDataFrame([(1, "t", 1)], "customer_id long, sector string, line int"), local)
    assert rows(got) == [(1, "a", 519546, "t")]


def test_synced_limits_with_lines_are_added_as_sql_adds_them(spark):
    amounts = {1: (111215.54, 271481.35, 136848.61), 2: (0.1, 1e17, -1e17), 3: (1e17, -1e17, 0.7), 4: (0.5, None), 5: (None,)}
    values = ", ".join(f"({i}, {'NULL' if x is None else repr(x)}::DOUBLE)" for i, xs in amounts.items() for x in xs)
    want = duckdb.connect(config={"threads": 1}).sql(f"SELECT i, CAST(round(sum(x)) AS BIGINT) FROM (VALUES {values}) v(i, x) GROUP BY 1").fetchall()
    local = spark.createDataFrame([(i, "a", 0, "s") for i in amounts], "customer_id long, name string, credit_limit long, sector string")
    limits = spark.createDataFrame([(i, 2024, x, n) for i, xs in amounts.items() for n, x in enumerate(xs)], "customer_id long, as_of int, amount double, line int").orderBy(F.desc("line"))
    got = C.sync_customers(local, local.select("customer_id", "name"), limits, spark.createDataFrame([(1, "t", 1)], "customer_id long, sector string, line int"), local)
    assert {r.customer_id: r.credit_limit for r in got.collect()} == dict(want) == {1: 519545, 2: 0, 3: 1, 4: 1, 5: None}


def test_pages_are_cut_into_lines_once(spark):
    pages = spark.createDataFrame([(1, "BALANCE_SHEET", 1000, 0, "VARLIKLAR\nKalem\n5,00"), (1, "BALANCE_SHEET", 1000, 1, ""), (2, "BALANCE_SHEET", 1000, 0, None)], "doc_id long, statement string, scale int, page_no int, text string")
    lines = ST.clean_lines(pages, 4)
    assert lines._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert [r.line for r in lines.orderBy("page_no", "line_no").collect()] == ["VARLIKLAR", "Kalem", "5,00"]


def test_extraction_results_are_parsed_once(spark):
    df = spark.createDataFrame([(1, '{"nodes": [{"id": "a"}, "stray"], "edges": [{"source": "a", "target": "b"}]}')], "seq int, payload string")
    plan = G.triples(df, "payload")._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Filter" in line and "from_json" in line for line in plan.split("\n"))
    assert [r.kind for r in G.triples(df, "payload").collect()] == ["node", "edge"]
