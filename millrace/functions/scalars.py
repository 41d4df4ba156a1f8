"""Scalar functions: Column in, Column out, all native expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -----------------------------------------------------------------------------------------------
#: Month names after folding, in calendar order.
MONTHS = ("ocak", "subat", "mart", "nisan", "mayis", "haziran", "temmuz", "agustos", "eylul", "ekim", "kasim", "aralik")
BLANK_AMOUNTS = ("-", "--", "—", "0", "(0)")
BANNERS = ("finansal durum tablosu", "bilanco", "kar veya zarar", "gelir tablosu", "profit or loss", "income statement", "anonim sirketi", "anonim ortakligi")
NOTE_WORDS = ("not", "dipnot")
NOTE_COMPANIONS = ("parca", "olus", "ekteki", "takip", "iliskin", "tamamlayici", "bakiniz", "ayrilmaz", "okunma", "beraber")
UNIT_WORDS = ("tutarlar", "aksi belirtilmedikce", "ifade edilmis", "satin alma gucu", "gosterilmistir", "para birimi")
SUBTOTALS = ("toplam", "ara toplam", "brut k/z", "brut kar", "brut zarar", "net faaliyet", "net k/z", "net kar", "net zarar", "donem k/z", "donem kari", "donem zarari")
BOT_WORDS = ("cookie", "javascript", "subscribe", "paywall", "browser", "robot", "captcha", "abone ol")
SENSITIVE = ("password", "token")
ROMAN = r"(?i)^(I|II|III|IV|V|VI|VII|VIII|IX|X|XI|XII)"
# -----------------------------------------------------------------------------------------------------------------


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` worked out once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def any_of(words: tuple[str, ...], c: Column) -> Column:
    return reduce(lambda a, w: a | c.contains(w), words[1:], c.contains(words[0]))


def label(name: Column, kind: str, id_: Column) -> Column:
    """``name / kind #id``; null if a part is null."""
    return F.concat(name, F.lit(f" / {kind} #"), id_.cast("string"))


def full_name(first: Column, last: Column) -> Column:
    """the surname may be missing; a missing first name gives null."""
    return F.concat(first, F.lit(" "), F.coalesce(last, F.lit("")))


def local_time(c: Column, hours: int = 3) -> Column:
    """UTC text as local minutes; unreadable text keeps its first 16 characters, empty stays empty."""
    readable = F.translate(F.substring(c, 1, 19), "T", " ")
    shifted = F.date_format(F.try_to_timestamp(readable, F.lit("yyyy-MM-dd HH:mm:ss")) + F.expr(f"INTERVAL {hours} HOURS"), "yyyy-MM-dd HH:mm")
    return F.when(F.coalesce(c, F.lit("")) == "", "").otherwise(F.coalesce(shifted, F.substring(c, 1, 16)))


def prefix(c: Column, n: int) -> Column:
    """F4."""
    return F.substring(c.cast("string"), 1, n)


def marked_letters() -> tuple[str, str]:
    """Latin letters with marks and the same letters without, by their canonical decomposition."""
    parts = {c: unicodedata.normalize("NFD", c) for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)])}
    plain = {c: d[0] for c, d in parts.items() if len(d) > 1 and all(unicodedata.combining(m) for m in d[1:])}
    return "".join(plain), "".join(plain.values())


MARKED, PLAIN = marked_letters()
PLAIN_FOLD = "".join(b for a, b in zip(MARKED, PLAIN, strict=True) if a != "İ")


def slug(c: Column, n: int = 50, default: str = "document") -> Column:
    """letters without marks, other non-ASCII dropped, lower case, runs of separators as one underscore."""
    ascii_ = F.regexp_replace(F.translate(c, MARKED, PLAIN), r"[^\x00-\x7F]", "")
    words = F.lower(F.regexp_replace(F.trim(F.regexp_replace(ascii_, r"[^\w\s-]", "")), r"[-\s]+", "_"))
    return F.coalesce(F.nullif(F.substring(words, 1, n), F.lit("")), F.lit(default))


def systematic_name(date: Column, base: Column, slug_: Column, ext: Column) -> Column:
    """F6."""
    return F.concat(F.concat_ws("_", date, base, slug_), F.lit("."), ext)


def date_digits(c: Column) -> Column:
    """the first eight digits of a text, else zeros."""
    digits = F.regexp_replace(F.coalesce(c, F.lit("")), r"\D", "")
    return F.when(F.length(digits) >= 8, F.substring(digits, 1, 8)).otherwise("00000000")


def fold(c: Column) -> Column:
    """F8: lower case without marks; dotted and dotless i are one letter; null is empty."""
    plain = F.translate(F.regexp_replace(F.coalesce(c, F.lit("")), "i̇", "i"), "ıIİ" + MARKED.replace("İ", ""), "iii" + PLAIN_FOLD)
    ascii_ = F.octet_length(c) == F.length(c)  # nothing but lower case to do then
    return F.when(ascii_, F.lower(c)).otherwise(F.lower(F.regexp_replace(plain, r"\p{M}", "")))


def period(c: Column) -> Column:
    """struct(code, date, label) of ``31 Aralık 2025``; a missing day is 31; null without month or year."""
    month_of = lambda f: reduce(lambda chain, x: chain.when(f.contains(x[1]), f"{x[0]:02}"), list(enumerate(MONTHS, 1))[1:], F.when(f.contains(MONTHS[0]), "01"))
    year_of = lambda s: F.nullif(F.regexp_extract(s, r"\b(20\d\d)\b", 1), F.lit(""))
    day_of = lambda s: F.coalesce(F.lpad(F.nullif(F.regexp_extract(s, r"\b(\d{1,2})\b", 1), F.lit("")), 2, "0"), F.lit("31"))
    found = F.when(c.rlike(r"\b20\d\d\b"), F.struct(let(fold(c), month_of).alias("month"), year_of(c).alias("year"), day_of(c).alias("day"), F.trim(c).alias("label")))
    made = lambda x: F.struct(F.concat(x["year"], x["month"]).alias("code"), F.concat_ws("-", x["year"], x["month"], x["day"]).alias("date"), x["label"].alias("label"))
    return let(found, lambda x: F.when(x["month"].isNotNull(), made(x)))


def amount(c: Column, scale: Column | float = 1.0) -> Column:
    """blanks and dashes 0, parentheses or a leading minus negative, either decimal separator; unreadable 0."""
    unit = F.lit(scale) if not isinstance(scale, Column) else scale

    def plain(body: Column) -> Column:
        dots, commas = body.contains("."), body.contains(",")
        comma_last = F.length(F.substring_index(body, ",", -1)) < F.length(F.substring_index(body, ".", -1))
        cents = lambda sep: body.rlike(rf"^[^{sep}]*[{sep}][^{sep}]{{2}}$")
        return (
            F.when(dots & commas & comma_last, F.translate(F.translate(body, ".", ""), ",", "."))
            .when(dots & commas, F.translate(body, ",", ""))
            .when(commas & cents(","), F.translate(body, ",", "."))
            .when(commas, F.translate(body, ",", ""))
            .when(dots & cents(".") & (F.length(body) <= 5), body)
            .when(dots, F.translate(body, ".", ""))
            .otherwise(body)
        )

    def read(s: Column) -> Column:
        bracketed, minus = s.startswith("(") & s.endswith(")"), s.startswith("-") | s.startswith("—")
        body = F.when(bracketed, F.trim(F.regexp_replace(s, r"^\((.*)\)$", "$1"))).when(minus, F.trim(F.regexp_replace(s, "^[-—]", ""))).otherwise(s)
        value = let(body, plain).try_cast("double") * unit * F.when(bracketed | minus, -1).otherwise(1)
        return F.when((s == "") | s.isin(*BLANK_AMOUNTS), 0.0).otherwise(F.coalesce(value, F.lit(0.0)))

    return let(F.coalesce(F.trim(c), F.lit("")), read)


def may_be_number(c: Column) -> Column:
    """Whether a text holds a digit, a dash or a bracket, as all numbers and blank amounts do. Most tokens don't, and tests that ask this first stop there."""
    return F.coalesce(c, F.lit("")).rlike(r"[\d(\-—]")


def is_value(c: Column) -> Column:
    """an amount token; a bare integer up to 60 is a footnote."""
    s = F.trim(F.coalesce(c, F.lit("")))
    number = s.rlike(r"^-?[\d\.,]+$") & s.rlike(r"\d") & ~(s.rlike(r"^\d+$") & (s.try_cast("double") <= 60))
    return may_be_number(c) & (s.isin(*BLANK_AMOUNTS) | s.rlike(r"^\([\d\.,\s]+\)$") | number)


def is_note(c: Column) -> Column:
    """a footnote reference: numbers up to 100, not grouped in threes."""
    def test(s: Column) -> Column:
        large = s.rlike(r"10[1-9]|1[1-9]\d|[2-9]\d\d")  # none of the numbers has more than three digits
        return s.rlike(r"^\d{1,3}(?:[\s,\-\.]+\d{1,3})*$") & ~large & ~s.rlike(r"[\.,][^\.,]{3}([\.,]|$)")

    return may_be_number(c) & let(F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"^(?:not|dipnot|dipnotlar|no)?[:\s]*", "")), test)


def is_number(c: Column) -> Column:
    """a numeric token of a statement line."""
    s = F.trim(F.coalesce(c, F.lit("")))
    return may_be_number(c) & (s.isin(*BLANK_AMOUNTS) | (s.rlike(r"^-?[\d\.,\(\)\s]+$") & s.rlike(r"[\d-]")))


def is_date_line(c: Column, folded: Column | None = None) -> Column:
    """a month and a year. ``folded``: fold(c) where the caller has it already."""
    # the year first: few texts have one, and only these are folded
    return F.coalesce(c.contains("20"), F.lit(False)) & c.rlike(r"\b(20\d\d)\b") & any_of(MONTHS, fold(c) if folded is None else folded)


def is_prose(c: Column) -> Column:
    """Long lines that end like a sentence or stand in parentheses."""
    s = F.trim(F.coalesce(c, F.lit("")))
    return (F.length(s) > 45) & (s.endswith(".") | (s.startswith("(") & s.endswith(")")))


def is_boilerplate(c: Column, folded: Column | None = None) -> Column:
    """banners, notes on the notes, remarks on units, and prose. ``folded``: fold(c) where the caller has it already."""
    folded = fold(c) if folded is None else folded
    return (folded != "") & (any_of(BANNERS, folded) | (any_of(NOTE_WORDS, folded) & any_of(NOTE_COMPANIONS, folded)) | any_of(UNIT_WORDS, folded) | is_prose(c))


def code(c: Column) -> Column:
    """struct(code, label, level): ROOT for Roman numerals, CATEGORY for n.n, ITEM for deeper codes and no code."""
    s = F.trim(F.coalesce(c, F.lit("")))
    roman, dotted = ROMAN + r"\.?\s+(.+)$", r"^(\d+(?:\.\d+)+)\.?\s+(.+)$"
    number = F.regexp_extract(s, dotted, 1)
    parts = F.split(number, r"\.")
    money = F.forall(F.slice(parts, 2, 1000), lambda x: F.length(x) == 3)
    made = lambda a, b, level: F.struct(a.alias("code"), b.alias("label"), F.lit(level).alias("level") if isinstance(level, str) else level.alias("level"))
    return (
        F.when(s.rlike(roman), made(F.upper(F.regexp_extract(s, roman, 1)), F.trim(F.regexp_extract(s, roman, 2)), "ROOT"))
        .when(s.rlike(dotted) & ~money, made(number, F.trim(F.regexp_extract(s, dotted, 2)), F.when(F.size(parts) == 2, "CATEGORY").otherwise("ITEM")))
        .otherwise(made(F.lit(None).cast("string"), s, "ITEM"))
    )


def is_subtotal(c: Column, folded: Column | None = None) -> Column:
    """total wording, or a formula over line numbers in parentheses. ``folded``: fold(c) where the caller has it already."""
    return any_of(SUBTOTALS, fold(c) if folded is None else folded) | F.coalesce(c, F.lit("")).rlike(r"\([IVX|\d]+[+\-.]+.*[IVX|\d]+\)")


def scale(c: Column, folded: Column | None = None) -> Column:
    """the unit that a page states; thousands if it says nothing. ``folded``: fold(c) where the caller has it already."""
    f = fold(c) if folded is None else folded
    money = r"\b.*\b(tl|turk lirasi|try)\b"
    return (
        F.when(f.rlike(r"(?s)\bmilyar" + money), 1_000_000_000)
        .when(f.rlike(r"\bmilyon" + money) | f.contains("milyon tl") | f.contains("milyon turk lirasi"), 1_000_000)
        .when(f.rlike(r"\bbin" + money) | f.contains("bin tl") | f.contains("bin turk lirasi"), 1000)
        .when(f.rlike(r"\b(tl|turk lirasi)\b\s+olarak") & ~f.contains("bin") & ~f.contains("milyon"), 1)
        .otherwise(1000)
    )


def tokens(c: Column) -> Column:
    """F16: lower-case words for keyword search."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([a-zA-Z0-9']+)"), 1)


def sha256(c: Column) -> Column:
    """F17."""
    return F.sha2(c.cast("binary"), 256)


def md5(c: Column) -> Column:
    """F17."""
    return F.md5(c.cast("binary"))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def normalise(v: Column) -> Column:
    """a zero vector stays as it is."""
    n = norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is zero."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when((norm(a) > 0) & (norm(b) > 0), dot / (norm(a) * norm(b))).otherwise(0.0)


def unescape(c: Column) -> Column:
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(plain))
    return c


def html_text(c: Column) -> Column:
    """text without tags, scripts and styles; white space as single blanks."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(unescape(F.regexp_replace(bare, r"(?s)<[^>]*>", " ")), r"\s+", " "))


def paragraphs(c: Column) -> Column:
    """the paragraphs' texts joined by a blank."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.array_join(F.filter(F.transform(F.regexp_extract_all(bare, F.lit(r"(?is)<p\b[^>]*>(.*?)(?=</p>|<p\b|</article>|$)"), 1), html_text), lambda x: x != ""), " ")


def valid_article(c: Column) -> Column:
    """longer than 200 characters and no sign of a bot wall."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return (F.length(low) > 200) & ~any_of(BOT_WORDS, low)


def article_text(c: Column, snippet: Column, n: int = 4000) -> Column:
    """F20."""
    return F.when(valid_article(c), F.substring(c, 1, n)).otherwise(snippet)


def resolve_url(base: Column, href: Column) -> Column:
    """an absolute URL from a link on the page ``base``; a doubled ``href:`` prefix is dropped."""
    link = F.trim(F.regexp_replace(href, r"^(?i)href:\s*", ""))
    plain = F.regexp_replace(base, r"[?#].*$", "")
    site = F.regexp_extract(base, r"^([a-zA-Z][\w+.-]*://[^/?#]*)", 1)
    folder = F.when(plain == site, F.concat(plain, F.lit("/"))).otherwise(F.regexp_replace(plain, r"[^/]*$", ""))
    return (
        F.when(link == "", base).when(link.rlike(r"^[a-zA-Z][\w+.-]*:"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, r"^([a-zA-Z][\w+.-]*:)", 1), link))
        .when(link.startswith("/"), F.concat(site, link)).when(link.startswith("?"), F.concat(plain, link))
        .when(link.startswith("#"), F.concat(F.regexp_replace(base, r"#.*$", ""), link)).otherwise(F.concat(folder, link))
    )


def has_extension(url: Column, exts: list[str]) -> Column:
    """ignoring the query string."""
    path = F.lower(F.substring_index(F.substring_index(url, "?", 1), "#", 1))
    return reduce(lambda a, b: a | b, [path.endswith("." + e.lower().lstrip(".")) for e in exts])


def clean_json(c: Column, schema: str) -> Column:
    """JSON out of a model's answer: code fences and thoughts dropped; null if it isn't JSON."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(c), r"(?i)^```[a-z]*\n?", ""), r"\n?```$", "")
    return F.from_json(F.trim(F.regexp_replace(bare, r"(?s)<think>.*?</think>", "")), schema)


def project_status(total: Column, done: Column, busy: Column) -> Column:
    """struct(status, percent); the percentage is cut to a whole number."""
    percent = F.floor(done / total * 100).cast("int")
    made = lambda status, p: F.struct(F.lit(status).alias("status"), p.alias("percent"))
    zero = F.lit(0)
    return F.when(total == 0, made("Not Started", zero)).when(done >= total, made("Completed", F.lit(100))).when((done > 0) | (busy > 0), made("Active", percent)).otherwise(made("Not Started", zero))


def eta(start: Column, updated: Column, pct: Column, status: Column, now: float) -> Column:
    """time left at the present pace for running tasks, time taken for completed ones; null if there is no telling."""
    clock = lambda s: (F.floor(s / 60).cast("int"), F.floor(s % 60).cast("int"))
    gone = F.lit(now) - start
    left, took = F.greatest(gone / (pct / 100.0) - gone, F.lit(0.0)), F.floor(updated - start)
    running = status.isin("Pending", "Processing", "Running") & start.isNotNull() & (start != 0)
    return (
        F.when(running & (F.coalesce(pct, F.lit(0)) > 0), F.format_string("~%dm %ds remaining", *clock(left)))
        .when(running, "Calculating...")
        .when((status == "Completed") & (updated > start), F.format_string("Took %dm %ds", *clock(took)))
    )


def split_owner(c: Column) -> Column:
    """struct(kind, id) of ``U-12`` and ``S-7``; null for anything else."""
    pattern = r"^([US])-(\d+)$"
    return F.when(c.rlike(pattern), F.struct(F.when(c.startswith("U"), "user").otherwise("stakeholder").alias("kind"), F.regexp_extract(c, pattern, 2).cast("int").alias("id")))


def drop_secrets(m: Column, n: int = 2000) -> Column:
    """a map without sensitive keys, values cut to ``n`` characters."""
    return F.transform_values(F.map_filter(m, lambda k, v: ~any_of(SENSITIVE, F.lower(k))), lambda k, v: F.substring(v, 1, n))


def mask(c: Column) -> Column:
    """first four and last two characters; short keys entirely."""
    n = F.length(c)
    return F.when(n <= 6, "****").otherwise(F.concat(F.substring(c, 1, 4), F.repeat(F.lit("*"), n - 6), F.right(c, F.lit(2))))


def title(c: Column, n: int = 60) -> Column:
    """F29."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def series_alias(c: Column, names: dict[str, str]) -> Column:
    """display name of a series, its own code if there is none."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), c), c)


def series_currency(c: Column, currencies: dict[str, str], default: str = "USD") -> Column:
    """F30."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in currencies.items() for x in kv]), c), F.lit(default))


def clean_parent(c: Column) -> Column:
    """a parent id as integer; ``NULL``, blank, 0 and anything else null."""
    return F.nullif(c.try_cast("int"), F.lit(0))


def split_list(c: Column) -> Column:
    """F32: lower-case items of a comma list, blanks dropped."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")


def word_count(c: Column) -> Column:
    """F32: words between white space."""
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda x: x != ""))


def round6(c: Column) -> Column:
    """F33."""
    return F.round(c, 6)


def to_limit(c: Column) -> Column:
    """the nearest whole limit."""
    return F.round(c).cast("long")


def norm_code(c: Column) -> Column:
    """F34."""
    return F.nullif(F.upper(F.trim(c)), F.lit(""))
