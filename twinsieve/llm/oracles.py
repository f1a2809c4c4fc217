"""SQL counterparts, for DuckDB, of the queries that SQL can express."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from twinsieve.llm import lookalike
from twinsieve.plans.oracles import BASELINE, GRAMS, normalised_rows

_HASH = "lower(trim({0}, ' ' || chr(9)))"
_KEYS = " UNION ALL ".join(
    [
        "SELECT request_no, 'id' AS key_field, id AS k FROM prefilter_request WHERE id IS NOT NULL",
        *(f"SELECT request_no, '{f}', {_HASH.format(f)} FROM prefilter_request WHERE regexp_full_match({_HASH.format(f)}, '[0-9a-f]{{32}}')" for f in ("raw_hash", "content_hash")),
    ]
)
_SEEN = f"""k AS ({_KEYS}), f AS (SELECT key_field, k, min(request_no) AS first FROM k GROUP BY ALL),
  s AS (SELECT DISTINCT key_field, CASE WHEN key_field = 'id' THEN key_value ELSE {_HASH.format('key_value')} END AS k FROM seeded_key WHERE key_field IN ('id', 'raw_hash', 'content_hash')),
  found AS (SELECT DISTINCT k.request_no, k.key_field FROM k JOIN f ON f.key_field = k.key_field AND f.k = k.k LEFT JOIN s ON s.key_field = k.key_field AND s.k = k.k
    WHERE f.first < k.request_no OR s.k IS NOT NULL)"""
_PLAIN = r"regexp_replace(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}]', '', 'g')"
_COPIES = f"""r AS (SELECT DISTINCT record_id, payload AS j FROM raw_record WHERE json_valid(payload)),
  c AS (SELECT record_id, {_PLAIN.format("j->>'$.canonical_input.title'")} AS t, {_PLAIN.format("j->>'$.canonical_input.content'")} AS c FROM r),
  g AS (SELECT record_id, min(record_id) OVER (PARTITION BY t, c) AS first FROM c WHERE t <> '' OR c <> '')"""



@lru_cache(maxsize=1)
def _looks() -> str:
    """Every code point that does not stand for itself on the screen, with what it stands for; Hangul is left composed."""
    rows = []
    for code in range(0x80, sys.maxunicode + 1):
        c = chr(code)
        if not 0xD800 <= code <= 0xDFFF and not 0xAC00 <= code <= 0xD7A3:
            d = unicodedata.normalize("NFKD", c.translate(lookalike._BEFORE_NFKD))
            d = "".join(lookalike.FIXED.get(x, x) for x in lookalike._SPACES.sub(" ", lookalike._INVISIBLE.sub("", d)))
            if d != c and not (d == "" and 0xE0000 <= code):
                rows.append(f"({code},'{d}')")
    return ",".join(rows).replace("'''", "''''")


def _look(column: str, name: str) -> str:
    """CTEs that end in ``name`` (id, v): a text column of raw in one form."""
    return f"""c_{name} AS (SELECT id, generate_subscripts(regexp_extract_all({column}, '(?s).'), 1) AS i, unnest(regexp_extract_all({column}, '(?s).')) AS c FROM raw),
  n_{name} AS (SELECT id, nfc_normalize(string_agg(coalesce(lk.d, CASE WHEN ord(x.c) < 9 OR ord(x.c) BETWEEN 14 AND 27 OR ord(x.c) = 127 OR ord(x.c) BETWEEN 917504 AND 921599 THEN '' ELSE x.c END), '' ORDER BY i)) AS v FROM c_{name} x LEFT JOIN lk ON lk.c = x.c GROUP BY id),
  {name} AS (SELECT raw.id, coalesce(v, '') AS v FROM raw LEFT JOIN n_{name} USING (id))"""


# Pairs a < b of rows of t (id, v) whose gram sets have a Jaccard similarity of at least 0.5.
_LINKS = f"""g AS (SELECT DISTINCT id, unnest({GRAMS.format('v')}) AS gram FROM t), n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
  o AS (SELECT x.id AS a, y.id AS b, count(*) AS k FROM g x JOIN g y ON x.gram = y.gram AND x.id < y.id GROUP BY ALL),
  l AS (SELECT a, b FROM o JOIN n na ON na.id = a JOIN n nb ON nb.id = b WHERE 2 * k >= na.n + nb.n - k)"""

ORACLES = {
    "p1_found": f"WITH {_SEEN} SELECT request_no, key_field FROM found",
    "p1_marks": f"""WITH {_SEEN} SELECT r.request_no, coalesce(bool_or(key_field = 'id'), false) AS seen_id, coalesce(bool_or(key_field = 'raw_hash'), false) AS seen_raw_hash,
        coalesce(bool_or(key_field = 'content_hash'), false) AS seen_content_hash FROM (SELECT DISTINCT request_no FROM prefilter_request) r LEFT JOIN found ON found.request_no = r.request_no GROUP BY ALL""",
    "p1_counts": f"""WITH {_SEEN}, n AS (SELECT key_field, k, count(*) AS n, min(request_no) AS a, max(request_no) AS z FROM k GROUP BY ALL),
        u AS (SELECT n.* FROM n LEFT JOIN s ON s.key_field = n.key_field AND s.k = n.k WHERE s.k IS NULL), p AS (SELECT key_field, count(*) AS probes FROM k GROUP BY ALL)
        SELECT p.key_field, probes, count(u.k) FILTER (a < z) AS disproved_recurs, count(u.k) FILTER (n = 1) + count(u.k) FILTER (a = z AND n > 1) AS new_once, 0.0::DOUBLE AS wrong_mark_rate
        FROM p LEFT JOIN u ON u.key_field = p.key_field GROUP BY ALL""",
    "p2_found": f"""WITH lk AS (SELECT chr(x.c) AS c, x.d AS d FROM (VALUES {_looks()}) x(c, d)),
        raw AS (SELECT DISTINCT ON (doc_pk) doc_pk AS id, coalesce(canonical_input.title, '') AS title, coalesce(canonical_input.content, '') AS content FROM baseline_record), {_look('title', 'lt')}, {_look('content', 'lc')},
        r AS (SELECT raw.*, lt.v AS x, lc.v AS y FROM raw JOIN lt USING (id) JOIN lc USING (id) WHERE regexp_matches(lt.v || lc.v, '[^\\s]'))
        SELECT a.id AS doc_pk_a, b.id AS doc_pk_b FROM r a JOIN r b ON a.x = b.x AND a.y = b.y AND a.id < b.id WHERE a.title <> b.title OR a.content <> b.content""",
    "p3_found": f"""WITH RECURSIVE rq AS (SELECT DISTINCT ON (request_no) request_no AS id, coalesce(title, '') AS title, coalesce(content, '') AS content, coalesce(insert_on_check, false) AS ins FROM check_request),
        {normalised_rows('rq', 'rt')}, t AS (SELECT id, pt AS v FROM rt WHERE pt <> '' UNION ALL SELECT -1 - doc_pk, primary_text FROM texts WHERE primary_text <> ''), {_LINKS},
        r AS (SELECT row_number() OVER (ORDER BY id) AS no, id, ins, EXISTS (SELECT 1 FROM l WHERE b = rt.id AND a < 0) AS stored, coalesce((SELECT list(a) FROM l WHERE b = rt.id AND a >= 0), []) AS prev FROM rt WHERE pt <> ''),
        w AS (SELECT 0::BIGINT AS no, NULL::BIGINT AS id, false AS dup, []::BIGINT[] AS acc
          UNION ALL SELECT r.no, r.id, r.stored OR list_has_any(prev, acc), CASE WHEN r.ins AND NOT (r.stored OR list_has_any(prev, acc)) THEN list_append(acc, r.id) ELSE acc END FROM w JOIN r ON r.no = w.no + 1)
        SELECT id AS request_no FROM w WHERE dup""",
    "p4_found": f"WITH RECURSIVE {BASELINE}, t AS (SELECT id, pt AS v FROM b WHERE pt <> ''), {_LINKS} SELECT a AS doc_pk_a, b AS doc_pk_b FROM l",
    "p4_classes": f"""WITH RECURSIVE {BASELINE}, m AS (SELECT id AS doc_pk, min(id) OVER (PARTITION BY pt) AS class_id, pt FROM b WHERE pt <> ''), t AS (SELECT doc_pk AS id, pt AS v FROM m WHERE doc_pk = class_id), {_LINKS},
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), w AS (SELECT id, id AS r FROM t UNION SELECT w.id, e.b FROM w JOIN e ON e.a = w.r), gr AS (SELECT id, min(r) AS group_id FROM w GROUP BY id)
        SELECT doc_pk, class_id, group_id, (SELECT count(*) FROM e WHERE e.a = class_id) AS n_links FROM m JOIN gr ON gr.id = class_id""",
    "p5_found": f"WITH {_COPIES} SELECT first AS first_record_id, record_id AS copy_record_id FROM g WHERE record_id <> first",
    "p5_articles": f"WITH {_COPIES} SELECT first AS first_record_id, count(*) AS copies FROM g GROUP BY first",
}
