"""Hand-made cases of the scalar functions."""

import pytest
from millrace.functions import scalars as X
from pyspark.sql import functions as F


def each(spark, f, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_amounts(spark):
    cases = {"(1.234,56)": -1234.56, "1,234.56": 1234.56, "12,50": 12.5, "1.234": 1234.0, "-": 0.0, "(0)": 0.0, "abc": 0.0, "": 0.0, None: 0.0, "12.50": 12.5, "123.50": 12350.0, "-5": -5.0, "—7": -7.0, " 1.234.567 ": 1234567.0, "1,234": 1234.0}
    assert each(spark, X.amount, *cases) == pytest.approx(list(cases.values()))
    assert each(spark, lambda c: X.amount(c, 1000), "(2,50)") == [-2500.0]


def test_codes(spark):
    got = [tuple(x) for x in each(spark, X.code, "I. Varlık", "1.1 X", "1.1.1 X", "1.234.567 X", "plain", None, "xii son")]
    assert got == [("I", "Varlık", "ROOT"), ("1.1", "X", "CATEGORY"), ("1.1.1", "X", "ITEM"), (None, "1.234.567 X", "ITEM"), (None, "plain", "ITEM"), (None, "", "ITEM"), ("XII", "son", "ROOT")]


def test_periods(spark):
    got = each(spark, X.period, "31 Aralık 2025", "Mart 2024", "5 MART", "5 foo 2024", "1 ŞUBAT 2023", None)
    assert [x and (x.code, x.date) for x in got] == [("202512", "2025-12-31"), ("202403", "2024-03-31"), None, None, ("202302", "2023-02-01"), None]


def test_tokens_of_lines(spark):
    assert each(spark, X.is_value, "60", "61", "-", "(1.234)", "1.234,5", "x1", None) == [False, True, True, True, True, False, False]
    assert each(spark, X.is_note, "5", "3,4", "1.234", "Dipnot 12", "101", "x") == [True, True, False, True, False, False]
    assert each(spark, X.is_number, "5", "(1)", "-", "a5", "") == [True, True, True, False, False]
    assert each(spark, X.is_boilerplate, "Bilanço", "Ekteki dipnotlar tamamlayıcıdır", "Ticari Alacaklar", "x" * 50 + ".", None) == [True, True, False, True, False]
    assert each(spark, X.is_subtotal, "TOPLAM VARLIKLAR", "Kasa", "Sonuç (I+II)") == [True, False, True]


def test_fold_and_slug(spark):
    assert each(spark, X.fold, "İSTANBUL IŞIK ığdır", "Ünïcödé", None) == ["istanbul isik igdir", "unicode", ""]
    assert each(spark, X.slug, "Şirket  Raporu - 2024!", "ıß", None, "a" * 60) == ["sirket_raporu_2024", "document", "document", "a" * 50]


def test_names_times_keys(spark):
    df = spark.createDataFrame([("Ann", None), ("Bo", "Li"), (None, "X")], "a string, b string")
    assert [r.x for r in df.select(X.full_name(F.col("a"), F.col("b")).alias("x")).collect()] == ["Ann ", "Bo Li", None]
    assert each(spark, X.local_time, "2024-01-01T23:30:00", "2024-01-01 10:00:59.123", "soon", "", None) == ["2024-01-02 02:30", "2024-01-01 13:00", "soon", "", ""]
    assert each(spark, X.date_digits, "12-34/5678 9", "1234567", None) == ["12345678", "00000000", "00000000"]
    assert each(spark, X.mask, "abcdef", "abcdefghij") == ["****", "abcd****ij"]
    assert [x and tuple(x) for x in each(spark, X.split_owner, "U-12", "S-7", "X-1", "U-", None)] == [("user", 12), ("stakeholder", 7), None, None, None]
    assert each(spark, X.clean_parent, "NULL", "", "0", "7", "x", None) == [None, None, None, 7, None, None]
    assert each(spark, X.scale, "Milyar TL", "bin Türk Lirası", "milyon tl", "Türk Lirası olarak", "") == [10**9, 1000, 10**6, 1, 1000]


def test_urls_and_html(spark):
    base = F.lit("http://h.example/a/b.html?x=1#f")
    got = each(spark, lambda c: X.resolve_url(base, c), "c", "/c", "//o.example/c", "?y", "#z", "https://q/", "", "href: /d", "mailto:a@b")
    assert got == ["http://h.example/a/c", "http://h.example/c", "http://o.example/c", "http://h.example/a/b.html?y", "http://h.example/a/b.html?x=1#z", "https://q/", "http://h.example/a/b.html?x=1#f", "http://h.example/d", "mailto:a@b"]
    html = "<p>One &amp; <b>two</b></p><script>var t='</p>';</script><p>three<p>four</p>"
    assert each(spark, X.paragraphs, html, None) == ["One & two three four", ""]
    assert each(spark, lambda c: X.has_extension(c, ["pdf"]), "a.PDF?q", "a.html?b.pdf", "x.pdf#1") == [True, False, True]


def test_lists_and_json(spark):
    assert each(spark, X.split_list, " A, ,b ", None) == [["a", "b"], []]
    assert each(spark, X.word_count, " a  b\nc ", "", None) == [3, 0, 0]
    assert [x and x.a for x in each(spark, lambda c: X.clean_json(c, "a int"), '```json\n{"a": 1}\n```', '<think>no</think>{"a": 2}', "bad")] == [1, 2, None]
    df = spark.createDataFrame([({"k": "abcdef", "My_Password": "x", "authToken": "y"},)], "m map<string,string>")
    assert df.select(X.drop_secrets(F.col("m"), 3).alias("m")).first().m == {"k": "abc"}
    zero = spark.createDataFrame([([0.0, 0.0], [3.0, 4.0])], "a array<float>, b array<float>")
    r = zero.select(X.normalise(F.col("a")).alias("z"), X.normalise(F.col("b")).alias("n"), X.cosine(F.col("a"), F.col("b")).alias("c"), X.cosine(F.col("b"), F.col("b")).alias("d")).first()
    assert r.z == [0, 0] and r.n == pytest.approx([0.6, 0.8]) and r.c == 0 and r.d == pytest.approx(1)


def test_token_tests_ask_the_cheap_question_first(spark):
    """Tokens without a digit, a dash or a bracket are told by one look; texts are folded only where there is a year."""
    df = spark.createDataFrame([("x",)], "w string")
    plan = lambda f: df.select(f(F.col("w")))._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan(X.is_date_line).index("20") < plan(X.is_date_line).index("ocak")
    assert all(plan(f).index(r"[\d(\-—]") < plan(f).index(r"^") for f in (X.is_value, X.is_note, X.is_number))
    odd = (None, "", "(.)", "(", "-", "—", "()", "012", "100", "101", "1-2", "1,234", "not:7", "60", "61", ".", "٣")
    assert each(spark, X.is_value, *odd) == [x in ("(.)", "-", "—", "100", "101", "1,234", "61") for x in odd]
    assert each(spark, X.is_note, *odd) == [x in ("012", "100", "1-2", "not:7", "60", "61") for x in odd]
    assert each(spark, X.is_number, *odd) == [x in ("-", "—", "012", "100", "101", "1,234", "60", "61") for x in odd]
    assert each(spark, X.is_date_line, None, "Ocak", "2025", "Ocak 2025", "31 ARALIK 2024", "Ocak 12025") == [False, False, False, True, True, False]
