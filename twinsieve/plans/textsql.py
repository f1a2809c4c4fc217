"""The text rules in SQL, from tables that are built by rule: NFKC, normalisation, BLAKE2b, SimHash, MinHash.

With these the SQL counterparts of the baseline queries cover records without a stored expectation too.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from twinsieve.functions.hashing import permutations
from twinsieve.functions.text import BRACKET_MAX, EMOJI_RANGES, KEPT_RANGES

MASK = "18446744073709551615::UHUGEINT"
# Initial words and message schedule of BLAKE2b (RFC 7693).
BLAKE2B_IV = (
    0x6A09E667F3BCC908, 0xBB67AE8584CAA73B, 0x3C6EF372FE94F82B, 0xA54FF53A5F1D36F1,
    0x510E527FADE682D1, 0x9B05688C2B3E6C1F, 0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179,
)
BLAKE2B_SIGMA = (
    (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15),
    (14, 10, 4, 8, 9, 15, 13, 6, 1, 12, 0, 2, 11, 7, 5, 3),
    (11, 8, 12, 0, 5, 2, 15, 13, 10, 14, 3, 6, 7, 1, 9, 4),
    (7, 9, 3, 1, 13, 12, 11, 14, 2, 6, 5, 10, 4, 0, 15, 8),
    (9, 0, 5, 7, 2, 4, 10, 15, 14, 1, 11, 12, 6, 8, 3, 13),
    (2, 12, 6, 10, 0, 11, 8, 3, 4, 13, 7, 5, 15, 14, 1, 9),
    (12, 5, 1, 15, 14, 13, 4, 10, 0, 7, 6, 3, 9, 2, 8, 11),
    (13, 11, 7, 14, 12, 1, 3, 9, 5, 0, 15, 4, 8, 6, 2, 10),
    (6, 15, 14, 9, 11, 3, 0, 8, 12, 2, 13, 7, 1, 4, 10, 5),
    (10, 2, 8, 4, 7, 6, 1, 5, 15, 11, 9, 14, 3, 12, 13, 0),
)
ROUNDS = 12


def _class(ranges: str) -> str:
    """A class of code points in the notation of RE2."""
    out = ranges
    for width, mark in ((8, "U"), (4, "u")):
        parts = out.split(f"\\{mark}")
        out = parts[0] + "".join(f"\\x{{{p[:width]}}}{p[width:]}" for p in parts[1:])
    return out


@lru_cache(maxsize=1)
def _compatibility() -> str:
    """Every code point whose compatibility form is another than its canonical one, with that form."""
    rows = []
    for code in range(sys.maxunicode + 1):
        c = chr(code)
        if not 0xD800 <= code <= 0xDFFF and unicodedata.decomposition(c).startswith("<"):
            rows.append(f"({code},'{unicodedata.normalize('NFKD', c)}')")
    return ",".join(rows).replace("'''", "''''")


_SPACE = r"[\s\x{B}\x{1C}-\x{1F}\x{85}\p{Z}]+"


def normalized(source: str, name: str) -> str:
    """CTEs that end in ``name`` (id, v): F1 of the texts v of source (id, v)."""
    kept = _class(KEPT_RANGES)
    bare = f"regexp_replace(regexp_replace(regexp_replace(t, '[{_class(EMOJI_RANGES)}]+', '', 'g'), '\\[[^\\[\\]]{{1,{BRACKET_MAX}}}\\]', '', 'g'), '[^{kept}]+', '', 'g')"
    return f"""nfk AS (SELECT chr(x.c) AS c, x.d AS d FROM (VALUES {_compatibility()}) x(c, d)),
  ch_{name} AS (SELECT id, generate_subscripts(regexp_extract_all(v, '(?s).'), 1) AS i, unnest(regexp_extract_all(v, '(?s).')) AS c FROM {source}),
  nf_{name} AS (SELECT id, replace(replace(nfc_normalize(string_agg(coalesce(nfk.d, ch.c), '' ORDER BY i)), chr(8203), ''), chr(65279), '') AS t FROM ch_{name} ch LEFT JOIN nfk ON nfk.c = ch.c GROUP BY id),
  kp_{name} AS (SELECT id, t, CASE WHEN regexp_matches(t, '[{kept}]') THEN {bare} ELSE '' END AS k FROM nf_{name}),
  {name} AS (SELECT s.id, CASE WHEN k IS NULL THEN '' WHEN k <> '' THEN k ELSE lower(regexp_replace(t, '{_SPACE}', '', 'g')) END AS v FROM {source} s LEFT JOIN kp_{name} USING (id))"""


def _mix(v: list[int], positions: list[tuple[int, int]], inner: str) -> str:
    """Half a round of BLAKE2b: four mixings side by side, one operation of each per nested SELECT."""
    columns = [(f"v{v[i]}", f"v{v[4 + (i + s1) % 4]}", f"v{v[8 + (i + s2) % 4]}", f"v{v[12 + (i + s3) % 4]}") for i, (s1, s2, s3) in ((i, positions[0]) for i in range(4))]
    message = lambda k: f"m[sigma[r % 10 + 1][{k + 1}] + 1]"
    turn = lambda x, n: f"((({x} << {64 - n}) | ({x} >> {n})) & {MASK})"
    at = positions[1][0]
    for half, (n1, n2) in enumerate(((32, 24), (16, 63))):
        for step in range(4):
            new = []
            for i, (a, b, c, d) in enumerate(columns):
                if step == 0:
                    new.append(f"(({a} + {b} + {message(at + 2 * i + half)}) & {MASK}) AS {a}")
                elif step == 1:
                    new.append(f"{turn(f'xor({d}, {a})', n1)} AS {d}")
                elif step == 2:
                    new.append(f"(({c} + {d}) & {MASK}) AS {c}")
                else:
                    new.append(f"{turn(f'xor({b}, {c})', n2)} AS {b}")
            inner = f"(SELECT * REPLACE ({', '.join(new)}) FROM {inner})"
    return inner


def blake2b(source: str, name: str) -> str:
    """CTEs that end in ``name`` (gram, d16_hi, d16_lo, d8): digests of the distinct texts of source (gram), at most 24 bytes each."""
    byte = lambda k: f"coalesce(('0x' || nullif(substring(x, {2 * k + 1}, 2), ''))::UHUGEINT, 0::UHUGEINT)"
    word = lambda w: "(" + " + ".join(f"({byte(8 * w + k)} << {8 * k})" for k in range(8)) + ")"
    u = lambda n: f"{n}::UHUGEINT"
    words = ", ".join([word(w) for w in range(3)] + [u(0)] * 13)
    begin = [u(h) for h in BLAKE2B_IV] * 2
    begin[0] = f"xor({u(BLAKE2B_IV[0])}, xor({u(0x01010000)}, size::UHUGEINT))"
    begin[12] = f"xor({u(BLAKE2B_IV[4])}, (length(x) // 2)::UHUGEINT)"
    begin[14] = f"xor({u(BLAKE2B_IV[6])}, {MASK})"
    v = list(range(16))
    body = _mix(v, [(0, 0, 0), (0,)], f"(SELECT * FROM bl_{name} WHERE r < {ROUNDS})")
    body = _mix(v, [(1, 2, 3), (8,)], body)
    state = ", ".join(f"v{i}" for i in v)
    swap = lambda x: "(" + " + ".join(f"((({x} >> {8 * k}) & 255::UHUGEINT) << {56 - 8 * k})" for k in range(8)) + ")"
    final = lambda w: swap(f"xor(xor({u(BLAKE2B_IV[w])}, " + (f"xor({u(0x01010000)}, size::UHUGEINT)" if w == 0 else u(0)) + f"), xor(v{w}, v{w + 8}))")
    sigma = "[" + ", ".join(str(list(row)) for row in BLAKE2B_SIGMA) + "]"
    return f"""hx_{name} AS (SELECT DISTINCT gram, hex(encode(gram)) AS x FROM {source}),
  bl_{name} AS (SELECT gram, size, 0 AS r, {sigma} AS sigma, [{words}] AS m, {', '.join(f'{x} AS v{i}' for i, x in enumerate(begin))} FROM hx_{name}, (VALUES (8), (16)) s(size)
    UNION ALL SELECT gram, size, r + 1, sigma, m, {state} FROM {body}),
  dg_{name} AS (SELECT gram, size, {final(0)} AS w0, {final(1)} AS w1 FROM bl_{name} WHERE r = {ROUNDS}),
  {name} AS (SELECT gram, max(w0) FILTER (size = 16) AS d16_hi, max(w1) FILTER (size = 16) AS d16_lo, max(w0) FILTER (size = 8) AS d8 FROM dg_{name} GROUP BY gram)"""


def fingerprints(source: str, name: str, grams: str, bands: int = 32) -> str:
    """CTEs that end in ``name`` (id, hi, lo, sim, mins): unsigned halves, and both kinds of bands, of the texts v of source (id, v)."""
    factor, offset = permutations(bands)
    constants = ", ".join(f"({i}, {int(a)}::UHUGEINT, {int(b)}::UHUGEINT)" for i, (a, b) in enumerate(zip(factor, offset)))
    signed = lambda x: f"(CASE WHEN {x} >= 9223372036854775808::UHUGEINT THEN ({x}::HUGEINT - 18446744073709551616)::BIGINT ELSE {x}::BIGINT END)"
    half = lambda i: f"(({'lo' if i < 4 else 'hi'} >> {16 * (i % 4)}) & 65535::UHUGEINT)::BIGINT"
    sim = ", ".join(f"{{'band_index': {i}, 'band_value': {half(i)}}}" for i in range(8))
    return f"""gr_{name} AS (SELECT id, gram, count(*) AS w FROM (SELECT id, unnest({grams}) AS gram FROM {source}) GROUP BY ALL),
  {blake2b(f'gr_{name}', f'd_{name}')},
  vt_{name} AS (SELECT id, side, bit, sum(CASE WHEN (((CASE WHEN side = 0 THEN d16_hi ELSE d16_lo END) >> bit::UHUGEINT) & 1::UHUGEINT) = 1::UHUGEINT THEN w ELSE -w END) AS s
    FROM gr_{name} JOIN d_{name} USING (gram), (VALUES (0), (1)) sd(side), (SELECT unnest(range(64)) AS bit) bt GROUP BY ALL),
  sh_{name} AS (SELECT id, coalesce(bit_or(1::UHUGEINT << bit::UHUGEINT) FILTER (side = 0 AND s >= 0), 0::UHUGEINT) AS hi, coalesce(bit_or(1::UHUGEINT << bit::UHUGEINT) FILTER (side = 1 AND s >= 0), 0::UHUGEINT) AS lo FROM vt_{name} GROUP BY id),
  mn_{name} AS (SELECT id, i, min((d8 * a + b) & {MASK}) AS m FROM gr_{name} JOIN d_{name} USING (gram), (VALUES {constants}) pm(i, a, b) GROUP BY ALL),
  ml_{name} AS (SELECT id, list({{'band_index': i, 'band_value': {signed('m')}}} ORDER BY i) AS mins FROM mn_{name} GROUP BY id),
  hl_{name} AS (SELECT s.id, coalesce(hi, 0::UHUGEINT) AS hi, coalesce(lo, 0::UHUGEINT) AS lo, mins FROM {source} s LEFT JOIN sh_{name} USING (id) LEFT JOIN ml_{name} USING (id)),
  {name} AS (SELECT id, hi, lo, [{sim}] AS sim, coalesce(mins, [{{'band_index': i::INT, 'band_value': -1::BIGINT}} FOR i IN range({bands})]) AS mins FROM hl_{name})"""
