"""Queries of this package and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from .alignment import op12_token_alignment
from .decontaminate import op7_decontamination
from .jpeg import op8_media_jpeg
from .langid import op5_language_id
from .packing import op6_packing
from .phrases import op11_phrases
from .ppm import op1_ppm_scoring
from .quality import op13_quality_forest
from .secrets import op2_secret_scans
from .sharding import op4_sharding
from .simhash import op3_simhash_near_dedup
from .toxicity import op9_toxicity
from .warc import op10_warc

QUERIES = {f.__name__: f for f in (op1_ppm_scoring, op2_secret_scans, op3_simhash_near_dedup, op4_sharding, op5_language_id, op6_packing, op7_decontamination, op8_media_jpeg, op9_toxicity, op10_warc, op11_phrases, op12_token_alignment, op13_quality_forest)}
#: The other operators hash (XXH64, CRC-32), tokenise or learn, which SQL doesn't express; tests/llm compares
#: them with brute-force versions or by held-out accuracy.
ORACLE: dict[str, str] = {
    "op10_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, strlen(h) AS n, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM p)
    SELECT page_id, n AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(x, CAST(i // 4 * 5 + 1 AS INTEGER), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER), 1)), '') AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM d""",
    "op11_phrases": r"""WITH p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
    t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY 1),
    g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, i > 1 AS b, i + k - 1 < len(w) AS e FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (VALUES (1), (2), (3), (4)) x(k))),
    f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS a, count(*) FILTER (b) AS before, count(*) FILTER (e) AS behind FROM g GROUP BY 1, 2, 3), c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 30),
    cuts AS MATERIALIZED (SELECT *, array_to_string(w[1:j], ' ') AS head, array_to_string(w[j + 1:k], ' ') AS tail FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
    scores AS (SELECT x.lang, x.k, x.phrase, x.a, l.a AS l, r.a AS r, CAST(CAST(2000000 AS HUGEINT) * x.a // (l.a + r.a) AS BIGINT) AS score, x.before, x.behind FROM cuts x JOIN f l ON l.lang = x.lang AND l.phrase = x.head JOIN f r ON r.lang = x.lang AND r.phrase = x.tail
      QUALIFY row_number() OVER (PARTITION BY x.lang, x.phrase ORDER BY CAST(2000000 AS HUGEINT) * x.a // (l.a + r.a), j) = 1),
    kept AS (SELECT * FROM scores s WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = s.lang AND c.k > s.k AND contains(' ' || c.phrase || ' ', ' ' || s.phrase || ' ') AND 100 * c.a >= 80 * s.a))
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score, before, behind FROM kept JOIN t USING (lang) QUALIFY rank <= 2000""",
}
