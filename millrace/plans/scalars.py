"""Scalar functions over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from .registry import query


@query("f1_label", "SELECT c_custkey, c_name || ' / Deal #' || CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey END AS label FROM customer")
def _(t):
    return t.customer.select("c_custkey", X.label(F.col("c_name"), "Deal", F.when(F.col("c_custkey") % 4 != 0, F.col("c_custkey"))).alias("label"))


@query("f2_full_name", "SELECT c_custkey, c_name || ' ' || CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END AS name FROM customer")
def _(t):
    return t.customer.select("c_custkey", X.full_name(F.col("c_name"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment"))).alias("name"))


@query("f3_local_time", "SELECT event_id, CASE event_id % 10 WHEN 0 THEN '' WHEN 1 THEN 'not a date at a' ELSE strftime(ts + INTERVAL 3 HOUR, '%Y-%m-%d %H:%M') END AS local FROM events")
def _(t):
    text = F.when(F.col("event_id") % 10 == 0, "").when(F.col("event_id") % 10 == 1, "not a date at a").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return t.events.select("event_id", X.local_time(text).alias("local"))


@query("f4_prefix", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def _(t):
    return t.orders.select("o_orderkey", X.prefix(F.col("o_orderdate"), 10).alias("day"))


@query("f5_slug", "SELECT p_partkey, coalesce(nullif(substr(lower(regexp_replace(trim(regexp_replace(p_name, '[^a-zA-Z0-9_\\s-]', '', 'g')), '[-\\s]+', '_', 'g')), 1, 50), ''), 'document') AS slug FROM part")
def _(t):
    return t.part.select("p_partkey", X.slug(F.col("p_name")).alias("slug"))


@query("f6_systematic_name", "SELECT doc_id, '20250131_' || source || '_' || lang || '.pdf' AS name FROM documents")
def _(t):
    return t.documents.select("doc_id", X.systematic_name(F.lit("20250131"), F.col("source"), F.col("lang"), F.lit("pdf")).alias("name"))


@query("f7_date_digits", "SELECT doc_id, CASE WHEN length(regexp_replace(text, '[^0-9]', '', 'g')) >= 8 THEN substr(regexp_replace(text, '[^0-9]', '', 'g'), 1, 8) ELSE '00000000' END AS digits FROM documents")
def _(t):
    return t.documents.select("doc_id", X.date_digits(F.col("text")).alias("digits"))


def folded(c: str) -> str:
    return f"lower(translate(strip_accents(coalesce({c}, '')), 'ı', 'i'))"


@query("f8_fold", f"SELECT doc_id, {folded('text')} AS folded FROM documents")
def _(t):
    return t.documents.select("doc_id", X.fold(F.col("text")).alias("folded"))


MONTH = "CASE month(o_orderdate) WHEN 1 THEN 'Ocak' WHEN 2 THEN 'Şubat' WHEN 3 THEN 'Mart' WHEN 4 THEN 'Nisan' WHEN 5 THEN 'Mayıs' WHEN 6 THEN 'Haziran' WHEN 7 THEN 'Temmuz' WHEN 8 THEN 'Ağustos' WHEN 9 THEN 'Eylül' WHEN 10 THEN 'EKİM' WHEN 11 THEN 'Kasım' ELSE 'ARALIK' END"


@query("f9_period", "SELECT o_orderkey, CASE WHEN year(o_orderdate) >= 2000 OR true THEN '20' || lpad(CAST(year(o_orderdate) % 100 AS VARCHAR), 2, '0') || lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0') END AS code, '20' || lpad(CAST(year(o_orderdate) % 100 AS VARCHAR), 2, '0') || '-' || lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0') || '-' || CASE WHEN o_orderkey % 2 = 0 THEN '31' ELSE lpad(CAST(day(o_orderdate) AS VARCHAR), 2, '0') END AS date FROM orders")
def _(t):
    names = F.array(*[F.lit(m) for m in ("Ocak", "Şubat", "Mart", "Nisan", "Mayıs", "Haziran", "Temmuz", "Ağustos", "Eylül", "EKİM", "Kasım", "ARALIK")])
    day = F.when(F.col("o_orderkey") % 2 == 0, "").otherwise(F.concat(F.dayofmonth("o_orderdate").cast("string"), F.lit(" ")))
    text = F.concat(day, F.element_at(names, F.month("o_orderdate")), F.lit(" 20"), F.date_format("o_orderdate", "yy"))
    p = X.period(text)
    return t.orders.select("o_orderkey", p["code"].alias("code"), p["date"].alias("date"))


@query("f10_amount", "SELECT o_orderkey, round(CASE o_orderkey % 6 WHEN 3 THEN -o_totalprice WHEN 4 THEN 0 WHEN 5 THEN 0 ELSE o_totalprice END, 2) AS amount FROM orders")
def _(t):
    dotted = F.translate(F.format_number("o_totalprice", 2), ",.", ".,")
    text = F.when(F.col("o_orderkey") % 6 == 0, F.format_number("o_totalprice", 2)).when(F.col("o_orderkey") % 6 == 3, F.concat(F.lit("("), dotted, F.lit(")"))).when(F.col("o_orderkey") % 6 == 4, " - ").when(F.col("o_orderkey") % 6 == 5, "abc").otherwise(dotted)
    return t.orders.select("o_orderkey", F.round(X.amount(text), 2).alias("amount"))


WORDS = "(SELECT doc_id, CAST(i - 1 AS INTEGER) AS n, w[CAST(i AS INTEGER)] AS w, trim(w[CAST(i AS INTEGER)]) AS s FROM (SELECT doc_id, regexp_split_to_array(text, '[\\n ]') AS w FROM documents), unnest(range(1, len(w) + 1)) r(i))"
BLANK = "s IN ('-', '--', '—', '0', '(0)')"
NOTE = "trim(regexp_replace(lower(w), '^(?:not|dipnot|dipnotlar|no)?[:\\s]*', ''))"
MONTHS = "(ocak|subat|mart|nisan|mayis|haziran|temmuz|agustos|eylul|ekim|kasim|aralik)"


@query(
    "f11_token_tests",
    f"""SELECT doc_id, n, {BLANK} OR regexp_matches(s, '^\\([0-9.,\\s]+\\)$') OR (regexp_matches(s, '^-?[0-9.,]+$') AND regexp_matches(s, '[0-9]') AND NOT (regexp_matches(s, '^[0-9]+$') AND coalesce(TRY_CAST(s AS DOUBLE) <= 60, false))) AS value,
    regexp_matches({NOTE}, '^[0-9]{{1,3}}(?:[\\s,\\-.]+[0-9]{{1,3}})*$') AND len(list_filter(regexp_extract_all({NOTE}, '[0-9]+'), lambda x: TRY_CAST(x AS BIGINT) > 100 OR TRY_CAST(x AS BIGINT) IS NULL)) = 0
    AND NOT (regexp_matches({NOTE}, '[.,]') AND len(list_filter(list_slice(regexp_split_to_array({NOTE}, '[.,]'), 2, 1000), lambda x: length(x) = 3)) > 0) AS note,
    {BLANK} OR (regexp_matches(s, '^-?[0-9.,()\\s]+$') AND regexp_matches(s, '[0-9-]')) AS number, regexp_matches({folded('w')}, '{MONTHS}') AND regexp_matches(w, '\\b20[0-9][0-9]\\b') AS date FROM {WORDS}""",
)
def _(t):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", r"[\n ]")).alias("n", "w"))
    return lines.select("doc_id", "n", X.is_value(F.col("w")).alias("value"), X.is_note(F.col("w")).alias("note"), X.is_number(F.col("w")).alias("number"), X.is_date_line(F.col("w")).alias("date"))


TEXT_LINES = "(SELECT doc_id, CAST(i - 1 AS INTEGER) AS n, w[CAST(i AS INTEGER)] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS w FROM documents), unnest(range(1, len(w) + 1)) r(i))"
REMARKS = "(finansal durum tablosu|bilanco|kar veya zarar|gelir tablosu|profit or loss|income statement|anonim sirketi|anonim ortakligi|tutarlar|aksi belirtilmedikce|ifade edilmis|satin alma gucu|gosterilmistir|para birimi)"
COMPANIONS = "(parca|olus|ekteki|takip|iliskin|tamamlayici|bakiniz|ayrilmaz|okunma|beraber)"


@query(
    "f12_boilerplate",
    f"""SELECT doc_id, n, f <> '' AND (regexp_matches(f, '{REMARKS}') OR (regexp_matches(f, 'not') AND regexp_matches(f, '{COMPANIONS}')) OR (length(s) > 45 AND (s LIKE '%.' OR (s LIKE '(%' AND s LIKE '%)')))) AS boilerplate
    FROM (SELECT doc_id, n, trim(line) AS s, {folded('line')} AS f FROM {TEXT_LINES})""",
)
def _(t):
    return t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).select("doc_id", "n", X.is_boilerplate(F.col("line")).alias("boilerplate"))


@query(
    "f13_code",
    """SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN 'IV' WHEN 1 THEN '1.' || l_linenumber WHEN 2 THEN '1.2.' || l_linenumber END AS code,
    CASE l_linenumber % 4 WHEN 3 THEN '1.234.567 x' ELSE l_returnflag || ' item' END AS label, CASE l_linenumber % 4 WHEN 0 THEN 'ROOT' WHEN 1 THEN 'CATEGORY' ELSE 'ITEM' END AS level FROM lineitem""",
)
def _(t):
    n, tail = F.col("l_linenumber"), F.concat(F.lit(" "), F.col("l_returnflag"), F.lit(" item"))
    text = F.when(n % 4 == 0, F.concat(F.lit("iv."), tail)).when(n % 4 == 1, F.concat(F.lit("1."), n.cast("string"), tail)).when(n % 4 == 2, F.concat(F.lit("1.2."), n.cast("string"), F.lit("."), tail)).otherwise("1.234.567 x")
    return t.lineitem.select("l_orderkey", "l_linenumber", X.code(text).alias("c")).select("l_orderkey", "l_linenumber", "c.code", "c.label", "c.level")


@query("f14_subtotal", "SELECT l_orderkey, l_linenumber, l_linenumber % 3 <> 2 AS subtotal FROM lineitem")
def _(t):
    n = F.col("l_linenumber")
    return t.lineitem.select("l_orderkey", "l_linenumber", X.is_subtotal(F.when(n % 3 == 0, "ARA TOPLAM").when(n % 3 == 1, "Sonuç (I+II)").otherwise("Ticari alacaklar")).alias("subtotal"))


@query("f15_scale", "SELECT o_orderkey, CAST(CASE o_orderkey % 5 WHEN 0 THEN 1000000000 WHEN 1 THEN 1000000 WHEN 2 THEN 1000 WHEN 3 THEN 1 ELSE 1000 END AS INTEGER) AS scale FROM orders")
def _(t):
    k = F.col("o_orderkey") % 5
    text = F.when(k == 0, "Tutarlar milyar TL").when(k == 1, "MİLYON TÜRK LİRASI").when(k == 2, "Bin TL").when(k == 3, "Türk Lirası olarak").otherwise("")
    return t.orders.select("o_orderkey", X.scale(text).alias("scale"))


@query("f16_tokens", "SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '[a-zA-Z0-9'']+')) AS INTEGER) AS n, array_to_string(regexp_extract_all(lower(text), '[a-zA-Z0-9'']+'), ' ') AS words FROM documents")
def _(t):
    w = X.tokens(F.col("text"))
    return t.documents.select("doc_id", F.size(w).alias("n"), F.array_join(w, " ").alias("words"))


@query("f17_hashes", "SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5 FROM documents")
def _(t):
    return t.documents.select("doc_id", X.sha256(F.col("text")).alias("sha256"), X.md5(F.col("text")).alias("md5"))


@query("f18_normalise_cosine", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 4) AS norm, 1.0::DOUBLE AS self FROM embeddings")
def _(t):
    return t.embeddings.select("vec_id", F.round(X.norm(X.normalise(F.col("embedding"))), 4).alias("norm"), F.round(X.cosine(F.col("embedding"), F.col("embedding")), 4).alias("self"))


HIDDEN = "(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<!--.*?-->"


def unescaped(c: str) -> str:
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        c = f"replace({c}, '{entity}', '{plain}')"
    return c


def html_text(c: str) -> str:
    """SQL of the text of a page."""
    bare = f"regexp_replace(regexp_replace(coalesce({c}, ''), '{HIDDEN}', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
    return f"trim(regexp_replace({unescaped(bare)}, '\\s+', ' ', 'g'))"


def paragraphs(c: str) -> str:
    """SQL of the texts of a page's paragraphs: a mark ahead of all that ends one, then what lies up to the next mark."""
    marked = f"regexp_replace(regexp_replace(coalesce({c}, ''), '{HIDDEN}', ' ', 'g'), '(?i)(</p>|<p\\b|</article>)', chr(1) || '\\1', 'g')"
    return f"array_to_string(list_filter(list_transform(regexp_extract_all({marked}, '(?is)<p\\b[^>]*>([^' || chr(1) || ']*)', 1), lambda x: {html_text('x')}), lambda x: x <> ''), ' ')"


@query("f19_html_text", f"SELECT page_id, {html_text('html')} AS text, {paragraphs('html')} AS paragraphs FROM pages")
def _(t):
    return t.pages.select("page_id", X.html_text(F.col("html")).alias("text"), X.paragraphs(F.col("html")).alias("paragraphs"))


BOT = "(cookie|javascript|subscribe|paywall|browser|robot|captcha|abone ol)"


@query("f20_article", f"SELECT doc_id, CASE WHEN length(text) > 200 AND NOT regexp_matches(lower(text), '{BOT}') THEN substr(text, 1, 4000) ELSE source END AS summary FROM documents")
def _(t):
    return t.documents.select("doc_id", X.article_text(F.col("text"), F.col("source")).alias("summary"))


@query("f21_resolve_url", "SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/a/b' AS rooted, regexp_replace(url, '#.*$', '') || '#x' AS fragment, regexp_replace(url, '[?#].*$', '') || '?q=1' AS query FROM pages")
def _(t):
    u = F.col("url")
    return t.pages.select("page_id", X.resolve_url(u, F.lit("href: /a/b")).alias("rooted"), X.resolve_url(u, F.lit("#x")).alias("fragment"), X.resolve_url(u, F.lit("?q=1")).alias("query"))


@query("f22_has_extension", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN true WHEN 1 THEN true ELSE false END AS file FROM pages")
def _(t):
    url = F.concat(F.lit("http://x.example/f"), F.when(F.col("page_id") % 3 == 0, ".PDF?v=2").when(F.col("page_id") % 3 == 1, ".xlsx").otherwise(".html?f=.pdf"))
    return t.pages.select("page_id", X.has_extension(url, ["pdf", "xlsx"]).alias("file"))


@query("f23_clean_json", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE json_extract_string(props, '$.k') END AS k FROM events")
def _(t):
    text = F.when(F.col("event_id") % 5 == 0, "```json\nnot json\n```").otherwise(F.concat(F.lit("```json\n<think>a\nb</think>"), F.col("props"), F.lit("\n```")))
    return t.events.select("event_id", X.clean_json(text, "k string")["k"].alias("k"))


STATUS = "CASE l_linestatus WHEN 'F' THEN 'done' ELSE CASE l_returnflag WHEN 'N' THEN 'in_progress' ELSE 'todo' END END"


@query(
    "f24_project_status",
    f"""WITH a AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER ({STATUS} = 'done') AS d, count(*) FILTER ({STATUS} = 'in_progress') AS b FROM lineitem GROUP BY 1)
    SELECT l_orderkey, CASE WHEN d >= n THEN 'Completed' WHEN d > 0 OR b > 0 THEN 'Active' ELSE 'Not Started' END AS status, CAST(CASE WHEN d >= n THEN 100 WHEN d > 0 OR b > 0 THEN floor(d / n * 100) ELSE 0 END AS INTEGER) AS percent FROM a""",
)
def _(t):
    from ..operators.aggregates import project_states
    from .relational import items

    return project_states(items(t), "project_id").select(F.col("project_id").alias("l_orderkey"), "status", "percent")


@query(
    "f25_eta",
    """SELECT event_id, CASE WHEN event_type = 'click' AND value > 0 THEN 'Took ' || CAST(floor(floor(value) / 60) AS INTEGER) || 'm ' || CAST(floor(value) AS INTEGER) % 60 || 's' WHEN event_type = 'view' AND event_id % 4 = 0 THEN 'Calculating...' WHEN event_type = 'view' THEN '~3m 20s remaining' END AS eta FROM events""",
)
def _(t):
    status = F.when(F.col("event_type") == "click", "Completed").when(F.col("event_type") == "view", "Running").otherwise("Error")
    pct = F.when(F.col("event_id") % 4 == 0, 0).otherwise(50)
    return t.events.select("event_id", X.eta(F.lit(1000.0), F.lit(1000.0) + F.col("value"), pct, status, 1200.0).alias("eta"))


@query("f26_split_owner", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'stakeholder' END AS kind, CASE WHEN o_orderkey % 3 < 2 THEN CAST(o_custkey AS INTEGER) END AS id FROM orders")
def _(t):
    c = F.concat(F.when(F.col("o_orderkey") % 3 == 0, "U-").when(F.col("o_orderkey") % 3 == 1, "S-").otherwise("X-"), F.col("o_custkey").cast("string"))
    return t.orders.select("o_orderkey", X.split_owner(c).alias("x")).select("o_orderkey", "x.kind", "x.id")


@query("f27_drop_secrets", "SELECT event_id, 'k=' || substr(json_extract_string(props, '$.k'), 1, 3) AS body FROM events")
def _(t):
    m = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("User_Password"), F.lit("x"), F.lit("csrf_token"), F.lit("y"))
    return t.events.select("event_id", F.array_join(F.transform(F.map_entries(X.drop_secrets(m, 3)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("body"))


@query("f28_mask", "SELECT c_custkey, CASE WHEN length(c_name) <= 6 THEN '****' ELSE substr(c_name, 1, 4) || repeat('*', length(c_name) - 6) || right(c_name, 2) END AS masked FROM customer")
def _(t):
    return t.customer.select("c_custkey", X.mask(F.col("c_name")).alias("masked"))


@query("f29_title", "SELECT conv_id, turn, CASE WHEN length(text) > 60 THEN substr(text, 1, 60) || '…' ELSE text END AS title FROM conversations")
def _(t):
    return t.conversations.select("conv_id", "turn", X.title(F.col("text")).alias("title"))


@query("f30_series", "SELECT event_id, CASE event_type WHEN 'click' THEN 'Overnight' ELSE event_type END AS name, CASE event_type WHEN 'view' THEN 'EUR' ELSE 'USD' END AS currency FROM events")
def _(t):
    return t.events.select("event_id", X.series_alias(F.col("event_type"), {"click": "Overnight"}).alias("name"), X.series_currency(F.col("event_type"), {"view": "EUR"}).alias("currency"))


@query("f31_clean_parent", "SELECT p_partkey, CASE WHEN p_partkey % 5 < 4 THEN NULL ELSE CAST(p_partkey AS INTEGER) END AS parent FROM part")
def _(t):
    k = F.col("p_partkey") % 5
    return t.part.select("p_partkey", X.clean_parent(F.when(k == 0, "NULL").when(k == 1, "").when(k == 2, "0").when(k == 3, "x7").otherwise(F.col("p_partkey").cast("string"))).alias("parent"))


@query("f32_lists", "SELECT doc_id, lower(source) || '|' || lower(lang) AS parts, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS INTEGER) AS words FROM documents")
def _(t):
    return t.documents.select("doc_id", F.array_join(X.split_list(F.concat(F.lit(" "), F.upper("source"), F.lit(",, "), F.col("lang"))), "|").alias("parts"), X.word_count(F.col("text")).alias("words"))


@query("f33_rounding", "SELECT o_orderkey, round(o_totalprice / 7, 6) AS rate, CAST(round(o_totalprice) AS BIGINT) AS credit_limit FROM orders")
def _(t):
    return t.orders.select("o_orderkey", X.round6(F.col("o_totalprice") / 7).alias("rate"), X.to_limit(F.col("o_totalprice")).alias("credit_limit"))


@query("f34_norm_code", "SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE upper(p_brand) END AS code FROM part")
def _(t):
    return t.part.select("p_partkey", X.norm_code(F.when(F.col("p_partkey") % 9 == 0, "  ").otherwise(F.concat(F.lit(" "), F.lower("p_brand"), F.lit(" ")))).alias("code"))
