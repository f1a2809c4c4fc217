"""SQL counterparts of the core queries, for DuckDB over the same tables."""

from __future__ import annotations

from twinsieve.plans import textsql

_U = "(CASE WHEN {0} < 0 THEN {0}::HUGEINT + 18446744073709551616 ELSE {0}::HUGEINT END)"
GRAMS = "(CASE WHEN length({0}) = 0 THEN [] WHEN length({0}) <= 5 THEN [{0}] ELSE [substring({0}, i, 5) FOR i IN range(1, length({0}) - 3)] END)"
_LOW = r"""(length({0}) < 30 OR length(regexp_replace({0}, '[^\p{{L}}\p{{N}}]', '', 'g')) < 10
  OR (len(regexp_extract_all({0}, '\[[^\[\]]{{1,20}}\]')) > 0 AND list_sum([length(x) FOR x IN regexp_extract_all({0}, '\[[^\[\]]{{1,20}}\]')]) / length({0}) >= 0.65))"""
_RAW = "md5('title' || chr(31) || title || chr(30) || 'content' || chr(31) || content)"
_OWN = "'doc_' || md5(source || '|' || title || '|' || content)"
_LOCAL = "created_at + INTERVAL 8 HOUR"


def normalised_rows(source: str, name: str) -> str:
    """CTEs that end in ``name``: the rows of source (id, title, content, ...) with nt, nc and pt, the normalised texts and the primary one."""
    return f"""xn_{name} AS (SELECT id * 2 AS id, title AS v FROM {source} UNION ALL SELECT id * 2 + 1, content FROM {source}),
  {textsql.normalized(f'xn_{name}', f'nv_{name}')},
  {name} AS (SELECT u.*, t.v AS nt, c.v AS nc, CASE WHEN c.v <> '' THEN c.v ELSE t.v END AS pt FROM {source} u JOIN nv_{name} t ON t.id = u.id * 2 JOIN nv_{name} c ON c.id = u.id * 2 + 1)"""


def _prints(source: str, text: str, name: str) -> str:
    """CTEs that end in ``name`` (id, hi, lo, sim, mins): fingerprints of a text of source."""
    return f"tv_{name} AS (SELECT id, {text} AS v FROM {source}), {textsql.fingerprints(f'tv_{name}', name, GRAMS.format('v'))}"


def _number(start: int) -> str:
    """16 hex digits of the expected SimHash as a number."""
    return f"('0x' || substring(e.content_scope.simhash_hex, {start}, 16))::UHUGEINT"


# The distinct baseline records with their normalised texts: as expected, or by rule where nothing is.
BASELINE = f"""raw AS (SELECT DISTINCT ON (doc_pk) doc_pk AS id, coalesce(source_from, '') AS source, coalesce(canonical_input.title, '') AS title,
    coalesce(canonical_input.content, '') AS content, expected_from_canonical_input AS e FROM baseline_record),
  un AS (SELECT * FROM raw WHERE e IS NULL), {normalised_rows('un', 'ut')},
  b AS (SELECT *, e.normalized_title AS nt, e.normalized_content AS nc, e.primary_text AS pt FROM raw WHERE e IS NOT NULL UNION ALL SELECT * FROM ut),
  h AS (SELECT id, source, title, content, e, nt, nc, pt, coalesce(e.raw_hash_hex, {_RAW}) AS raw_hash, CASE WHEN e IS NOT NULL THEN e.content_hash_hex WHEN nc <> '' THEN md5(nc) END AS content_hash,
    CASE WHEN e IS NOT NULL THEN e.title_hash_hex WHEN nt <> '' THEN md5(nt) END AS title_hash, CASE WHEN e IS NOT NULL THEN e.content_scope.exact_hash WHEN pt <> '' THEN md5(pt) END AS exact_hash FROM b)"""
# The same with fingerprints of the content scope.
_B = f"""{BASELINE}, {_prints('ut', 'pt', 'fp')},
  d AS (SELECT h.*, {_number(1)} AS hi, {_number(17)} AS lo, e.content_scope.simhash_bands AS sim, e.content_scope.minhash_bands AS mins FROM h WHERE e IS NOT NULL
    UNION ALL SELECT h.*, fp.hi, fp.lo, fp.sim, fp.mins FROM h JOIN fp USING (id) WHERE e IS NULL)"""
# Probes: what the cascade asks with.
_P = f"""p AS (SELECT id AS probe, {_OWN} AS external_id, raw_hash, exact_hash, title_hash, nt, nc, pt, false AS two, hi, lo, sim, mins, 25 AS max_hamming, 1000 AS max_bucket, NULL::VARCHAR[] AS levels FROM d)"""
_STORE = f"""st AS (SELECT doc_pk, external_id, raw_hash, exact_hash, title_hash, {_U.format('simhash_hi')} AS hi, {_U.format('simhash_lo')} AS lo, {_U.format('title_simhash_hi')} AS t_hi, {_U.format('title_simhash_lo')} AS t_lo FROM fingerprints),
  bn AS (SELECT scope, kind, band_index, band_value, doc_pk FROM bands), tx AS (SELECT doc_pk, normalized_title AS nt, normalized_content AS nc FROM texts)"""
# The baseline in place of the store, each record under its own id.
_SELF = """p AS (SELECT d.id AS probe, d.id::VARCHAR AS external_id, nt, nc, pt, nt <> '' AND nc <> '' AS two, d.hi, d.lo, d.sim, d.mins{title}, 25 AS max_hamming, 1000 AS max_bucket, NULL::VARCHAR[] AS levels FROM d{join}),
  st AS (SELECT probe AS doc_pk, external_id, hi::HUGEINT AS hi, lo::HUGEINT AS lo{store} FROM p), tx AS (SELECT probe AS doc_pk, nt, nc FROM p),
  ub AS (SELECT 'content' AS scope, 'simhash' AS kind, probe AS doc_pk, unnest(sim) AS x FROM p UNION ALL SELECT 'content', 'minhash', probe, unnest(mins) FROM p{bands}),
  bn AS (SELECT scope, kind, x.band_index AS band_index, x.band_value AS band_value, doc_pk FROM ub)"""
_SELF_TITLES = _SELF.format(
    title=", tf.hi AS t_hi, tf.lo AS t_lo, tf.sim AS t_sim, tf.mins AS t_mins", join=" JOIN tf ON tf.id = d.id", store=", t_hi::HUGEINT AS t_hi, t_lo::HUGEINT AS t_lo",
    bands=" UNION ALL SELECT 'title', 'simhash', probe, unnest(t_sim) FROM p WHERE nt <> '' UNION ALL SELECT 'title', 'minhash', probe, unnest(t_mins) FROM p WHERE nt <> ''",
)
_SELF = _SELF.format(title="", join="", store="", bands="")


def _met(scope: str, kind: str, since: str = "") -> str:
    """CTEs that end in c_<scope>_<kind> (probe, doc_pk, band_hits, first_band) and sz_<scope>_<kind>, the sizes of buckets."""
    n, own = f"{scope}_{kind}", {"contentsimhash": "sim", "contentminhash": "mins", "titlesimhash": "t_sim", "titleminhash": "t_mins"}[scope + kind]
    return f"""bd_{n} AS (SELECT DISTINCT band_index, band_value, doc_pk FROM bn WHERE scope = '{scope}' AND kind = '{kind}'{since}),
  sz_{n} AS (SELECT *, count(*) OVER (PARTITION BY band_index, band_value) AS n FROM bd_{n}),
  pb_{n} AS (SELECT probe, least(coalesce(max_bucket, 1000), 2000) AS most, unnest({own}) AS s FROM p{" WHERE two" if scope == "title" else ""}),
  c_{n} AS (SELECT probe, sz.doc_pk, count(*) AS band_hits, min(sz.band_index) AS first_band FROM pb_{n} JOIN sz_{n} sz
    ON s.band_index = sz.band_index AND s.band_value = sz.band_value WHERE n <= most GROUP BY ALL)"""


def _sim(scope: str) -> str:
    """CTEs that end in sc_<scope> (probe, doc_pk, seen, hamming_distance, max_hamming): the comparisons of the SimHash matcher."""
    t = "t_" if scope == "title" else ""
    return f"""sn_{scope} AS (SELECT c.probe, c.doc_pk, max_hamming, row_number() OVER (PARTITION BY c.probe ORDER BY first_band, c.doc_pk) AS seen,
    (bit_count(xor(p.{t}hi::HUGEINT, st.{t}hi)) + bit_count(xor(p.{t}lo::HUGEINT, st.{t}lo)))::INT AS hamming_distance
    FROM c_{scope}_simhash c JOIN st ON st.doc_pk = c.doc_pk JOIN p ON p.probe = c.probe WHERE st.external_id <> p.external_id),
  sc_{scope} AS (SELECT * FROM sn_{scope} WHERE seen <= 200),
  sim_{scope} AS (SELECT probe, doc_pk, hamming_distance, row_number() OVER (PARTITION BY probe ORDER BY hamming_distance, seen)::INT AS rank FROM sc_{scope} WHERE hamming_distance <= max_hamming QUALIFY rank <= 20)"""


def _min(scope: str) -> str:
    """CTEs that end in mc_<scope> (probe, doc_pk, place, score): the comparisons of the MinHash matcher."""
    mine, held = ("p.nt", "tx.nt") if scope == "title" else ("p.pt", "tx.nc")
    return f"""rk_{scope} AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY band_hits DESC, first_band, doc_pk) AS place FROM c_{scope}_minhash QUALIFY place <= 20),
  pg_{scope} AS (SELECT p.probe, external_id, list_distinct({GRAMS.format(mine)}) AS g FROM p),
  tg_{scope} AS (SELECT tx.doc_pk, list_distinct({GRAMS.format(held)}) AS h FROM tx),
  mc_{scope} AS (SELECT r.probe, r.doc_pk, place, CASE WHEN len(g) + len(h) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(g, h))::DOUBLE / (len(g) + len(h) - len(list_intersect(g, h))) END AS score
    FROM rk_{scope} r JOIN st ON st.doc_pk = r.doc_pk JOIN pg_{scope} o ON o.probe = r.probe JOIN tg_{scope} t ON t.doc_pk = r.doc_pk WHERE st.external_id <> o.external_id),
  min_{scope} AS (SELECT probe, doc_pk, score, row_number() OVER (PARTITION BY probe ORDER BY score DESC, place)::INT AS rank FROM mc_{scope} WHERE score >= 0.4 QUALIFY rank <= 20)"""


_PRE = """hit AS (SELECT probe, 1 AS priority, 'external_id' AS reason, doc_pk FROM p JOIN st ON p.external_id = st.external_id
    UNION ALL SELECT probe, 2, 'raw_hash', doc_pk FROM p JOIN st ON p.raw_hash = st.raw_hash
    UNION ALL SELECT probe, 3, 'content_hash', doc_pk FROM p JOIN st ON p.exact_hash = st.exact_hash
    UNION ALL SELECT probe, 4, 'title_hash', doc_pk FROM p JOIN st ON p.title_hash = st.title_hash WHERE two),
  pre AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY probe ORDER BY priority, doc_pk) = 1)"""


def _cascade(scopes: tuple[str, ...]) -> str:
    """The verdict on every probe with text, with the nearest misses of new ones."""
    parts, wins = [_PRE], []
    parts += [x for s in scopes for x in (_met(s, "simhash"), _met(s, "minhash"), _sim(s), _min(s))]
    for s in scopes:
        wins += [(f"sim_{s}", "simhash", "sim_same", s, "hamming_distance"), (f"min_{s}", "minhash", "min_same", s, "score")]
    joins = "".join(f" LEFT JOIN {t} ON {t}.probe = p.probe AND {t}.rank = 1 AND (levels IS NULL OR list_contains(levels, '{level}'))" for t, level, *_ in wins)
    status = "".join(f" WHEN {t}.doc_pk IS NOT NULL THEN '{w}'" for t, _, w, *_ in wins)
    kind = "".join(f" WHEN {t}.doc_pk IS NOT NULL THEN '{s}'" for t, _, _, s, _ in wins)
    before, distance, score = ["pre.doc_pk IS NULL"], "", ""
    for t, _, _, _, value in wins:
        case = f" WHEN {' AND '.join(before)} AND {t}.doc_pk IS NOT NULL THEN {t}.{value}"
        distance, score = (distance + case, score) if value == "hamming_distance" else (distance, score + case)
        before.append(f"{t}.doc_pk IS NULL")
    new = " AND ".join(before)
    return f"""{', '.join(parts)},
  bs AS (SELECT probe, min_by(doc_pk, (hamming_distance, seen)) AS doc, min(hamming_distance) AS v FROM sc_content GROUP BY probe),
  bm AS (SELECT probe, min_by(doc_pk, (-score, place)) AS doc, max(score) AS v FROM mc_content WHERE score > 0 GROUP BY probe)
  SELECT p.probe, CASE WHEN pre.doc_pk IS NOT NULL THEN 'text_same'{status} ELSE 'new' END AS dedupe_status,
    CASE WHEN reason = 'title_hash' THEN 'title' WHEN reason = 'content_hash' THEN 'content' WHEN reason IS NOT NULL THEN 'all'{kind} END AS text_type,
    coalesce(pre.doc_pk, {', '.join(f'{t}.doc_pk' for t, *_ in wins)}) AS doc_pk, (CASE{distance} END)::INT AS hamming_distance, round(CASE{score} END, 6) AS score,
    CASE WHEN {new} AND (levels IS NULL OR list_contains(levels, 'simhash')) THEN bs.v END AS best_simhash_distance, CASE WHEN {new} AND (levels IS NULL OR list_contains(levels, 'simhash')) THEN bs.doc END AS best_simhash_doc,
    CASE WHEN {new} THEN coalesce(CASE WHEN levels IS NULL OR list_contains(levels, 'minhash') THEN round(bm.v, 4) END, 0.0) END AS best_minhash_score,
    CASE WHEN {new} AND (levels IS NULL OR list_contains(levels, 'minhash')) THEN bm.doc END AS best_minhash_doc
  FROM p LEFT JOIN pre ON pre.probe = p.probe{joins} LEFT JOIN bs ON bs.probe = p.probe LEFT JOIN bm ON bm.probe = p.probe WHERE p.pt <> ''"""


# Check requests with their own limits.
_REQUESTS = f"""rq AS (SELECT DISTINCT ON (request_no) request_no AS id, coalesce(source_from, '') AS source, coalesce(title, '') AS title, coalesce(content, '') AS content, id AS given, max_hamming,
    CASE WHEN max_bucket_size >= 1 THEN max_bucket_size END AS max_bucket, levels FROM check_request),
  {normalised_rows('rq', 'rt')}, {_prints('rt', 'pt', 'cf')}, {_prints('rt', 'nt', 'tf')},
  p AS (SELECT rt.id AS probe, coalesce(given, {_OWN}) AS external_id, {_RAW} AS raw_hash, CASE WHEN nc <> '' THEN md5(nc) END AS content_hash, CASE WHEN pt <> '' THEN md5(pt) END AS exact_hash, CASE WHEN nt <> '' THEN md5(nt) END AS title_hash,
    nt, nc, pt, nt <> '' AND nc <> '' AS two, cf.hi, cf.lo, cf.sim, cf.mins, tf.hi AS t_hi, tf.lo AS t_lo, tf.sim AS t_sim, tf.mins AS t_mins, coalesce(max_hamming, 25) AS max_hamming, coalesce(max_bucket, 1000) AS max_bucket, levels
    FROM rt JOIN cf ON cf.id = rt.id JOIN tf ON tf.id = rt.id)"""
_WINDOW = f" AND {_LOCAL} < (SELECT stop FROM w) AND {_LOCAL} >= (SELECT stop FROM w) - INTERVAL 10 DAY"
_STATS = """SELECT probe, '{kind}' AS kind, sum(least(n, 1001))::BIGINT AS candidate_rows, max(least(n, 1001)) AS largest_bucket, count(*) FILTER (n > 1000) AS skipped_buckets
    FROM pb_content_{kind} JOIN (SELECT DISTINCT band_index, band_value, n FROM sz_content_{kind}) sz ON s.band_index = sz.band_index AND s.band_value = sz.band_value GROUP BY probe"""


ORACLES = {
    "p6_found": """SELECT scope, kind, band_index, band_value FROM bands GROUP BY ALL
        HAVING count(DISTINCT doc_pk) > (SELECT min(max_bucket_size) FROM check_request WHERE max_bucket_size >= 1)""",
    "p6_bucket_sizes": "SELECT scope, kind, band_index, band_value, count(DISTINCT doc_pk) AS n_docs FROM bands GROUP BY ALL",
    "doc_normalized": f"WITH RECURSIVE {BASELINE} SELECT id AS doc_pk, nt AS normalized_title, nc AS normalized_content FROM b",
    "doc_hashes": f"WITH RECURSIVE {BASELINE} SELECT id AS doc_pk, raw_hash, content_hash, title_hash, exact_hash FROM h",
    "doc_scope_text": f"WITH RECURSIVE {BASELINE} SELECT id AS doc_pk, pt AS primary_text, length(pt)::INT AS text_len, CASE WHEN e IS NOT NULL THEN e.content_scope.low_information ELSE {_LOW.format('pt')} END AS low_information FROM b",
    "doc_simhash": f"WITH RECURSIVE {_B} SELECT id AS doc_pk, lower(lpad(to_hex(hi::UBIGINT), 16, '0') || lpad(to_hex(lo::UBIGINT), 16, '0')) AS simhash_hex FROM d",
    "doc_bands": f"""WITH RECURSIVE {_B}, s AS (SELECT id, 'simhash' AS kind, unnest(sim) AS x FROM d UNION ALL SELECT id, 'minhash', unnest(mins) FROM d)
        SELECT id AS doc_pk, kind, x.band_index AS band_index, x.band_value AS band_value FROM s""",
    "fingerprint_report": "SELECT count(DISTINCT doc_pk) AS records, 0::BIGINT AS failure_count, 'passed' AS status, '' AS failures FROM baseline_record WHERE expected_from_canonical_input IS NOT NULL",
    "stored_simhash_md5": f"""WITH g AS (SELECT doc_pk, unnest({GRAMS.format('primary_text')}) AS gram FROM texts),
        h AS (SELECT doc_pk, md5(gram) AS m, count(*) AS w FROM g GROUP BY ALL),
        d AS (SELECT doc_pk, w, d.i AS i, strpos('0123456789abcdef', substring(m, d.i, 1)) - 1 AS v FROM h, (SELECT unnest(range(1, 17)) AS i) d),
        s AS (SELECT doc_pk, i, sum(w * (v // 8 % 2)) AS b3, sum(w * (v // 4 % 2)) AS b2, sum(w * (v // 2 % 2)) AS b1, sum(w * (v % 2)) AS b0, sum(w) AS n FROM d GROUP BY ALL),
        n AS (SELECT doc_pk, i, (2 * b3 >= n)::HUGEINT * 8 + (2 * b2 >= n)::HUGEINT * 4 + (2 * b1 >= n)::HUGEINT * 2 + (2 * b0 >= n)::HUGEINT AS v FROM s),
        u AS (SELECT doc_pk, sum(v * (1::HUGEINT << (4 * (16 - i))::INT))::HUGEINT AS h FROM n GROUP BY ALL)
        SELECT t.doc_pk, CASE WHEN h IS NULL THEN 0 WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END::BIGINT AS simhash_hi FROM texts t LEFT JOIN u ON u.doc_pk = t.doc_pk""",
    "raw_text_hash": "SELECT doc_id, md5('title' || chr(31) || coalesce(title, '') || chr(30) || 'content' || chr(31) || coalesce(text, '')) AS raw_hash FROM documents",
    "stable_document_id": """SELECT DISTINCT ON (request_no) request_no, coalesce(id, 'doc_' || md5(coalesce(source_from, '') || '|' || coalesce(title, '') || '|' || coalesce(content, ''))) AS external_id
        FROM check_request""",
    "sample_text": "SELECT doc_pk, substring(primary_text, 1, 160) AS sample FROM texts",
    "stored_low_information": f"SELECT doc_pk, {_LOW.format('primary_text')} AS low_information FROM texts",
    "ngram_sizes": f"WITH g AS (SELECT doc_pk, {GRAMS.format('primary_text')} AS g FROM texts) SELECT doc_pk, len(g)::INT AS n_grams, len(list_distinct(g))::INT AS n_distinct FROM g",
    "ngram_top": f"WITH g AS (SELECT unnest({GRAMS.format('primary_text')}) AS gram FROM texts) SELECT gram, count(*) AS n FROM g GROUP BY gram ORDER BY n DESC, gram LIMIT 50",
    "stored_simhash_hex": f"""SELECT doc_pk, lower(lpad(to_hex({_U.format('simhash_hi')}::UBIGINT), 16, '0') || lpad(to_hex({_U.format('simhash_lo')}::UBIGINT), 16, '0')) AS simhash_hex FROM fingerprints""",
    "uint64_roundtrip": f"SELECT DISTINCT band_value, {_U.format('band_value')}::VARCHAR AS digits, band_value AS back FROM bands",
    "band_validity": """SELECT scope, kind, coalesce((kind = 'simhash' AND band_index BETWEEN 0 AND 7 AND band_value BETWEEN 0 AND 65535)
        OR (kind = 'minhash' AND band_index BETWEEN 0 AND 31 AND band_value IS NOT NULL), false) AS valid, count(*) AS n_rows FROM bands GROUP BY ALL""",
    "valid_hashes": """WITH r AS (SELECT DISTINCT ON (request_no) * FROM prefilter_request) SELECT count(*) FILTER (regexp_full_match(raw_hash, '[0-9a-fA-F]{32}')) AS raw_hash,
        count(*) FILTER (regexp_full_match(content_hash, '[0-9a-fA-F]{32}')) AS content_hash, count(*) FILTER (regexp_full_match(title_hash, '[0-9a-fA-F]{32}')) AS title_hash FROM r""",
    "day_buckets": f"""SELECT doc_pk, strftime({_LOCAL}, 'd%Y%m%d') AS day, date_trunc('day', {_LOCAL})::TIMESTAMP + INTERVAL 13 DAY - INTERVAL 8 HOUR AS expires_at FROM fingerprints""",
    "query_buckets": f"SELECT doc_pk, k.no::INT AS no, strftime({_LOCAL} - to_days(k.no::INT), 'd%Y%m%d') AS day FROM fingerprints, (SELECT unnest(range(3)) AS no) k",
    "date_window": f"""WITH w AS (SELECT date_trunc('day', max({_LOCAL}))::TIMESTAMP + INTERVAL 1 DAY AS stop FROM fingerprints)
        SELECT doc_pk FROM fingerprints, w WHERE {_LOCAL} < stop AND {_LOCAL} >= stop - INTERVAL 10 DAY""",
    "expire_documents": """SELECT doc_pk FROM fingerprints WHERE created_at < (SELECT max(created_at) FROM fingerprints) - INTERVAL 4 DAY ORDER BY created_at, doc_pk LIMIT 10000""",
    "bands_after_expiry": """WITH v AS (SELECT doc_pk FROM fingerprints WHERE created_at < (SELECT max(created_at) FROM fingerprints) - INTERVAL 4 DAY ORDER BY created_at, doc_pk LIMIT 10000)
        SELECT scope, kind, count(*) AS n_rows FROM bands WHERE doc_pk NOT IN (SELECT doc_pk FROM v) GROUP BY ALL""",
    "backfill_created_at": """SELECT DISTINCT scope, kind, band_index, band_value, b.doc_pk, coalesce(b.created_at, f.created_at) AS created_at FROM bands b LEFT JOIN fingerprints f ON f.doc_pk = b.doc_pk""",
    "band_counts": "SELECT scope, kind, count(*) AS n_rows, count(*) FILTER (created_at IS NULL) AS n_undated FROM bands GROUP BY ALL",
    "bands_by_day": f"SELECT scope, kind, strftime({_LOCAL}, 'd%Y%m%d') AS day, count(*) AS n_rows, count(DISTINCT doc_pk) AS n_docs FROM bands GROUP BY ALL",
    "bloom_sizing": """SELECT f AS filter, p AS error, round(-ln(p) / (ln(2) * ln(2)), 6) AS bits_per_key, ceil(-ln(p) / ln(2))::INT AS n_hashes, round(1 - pow(1 - p, 320), 6) AS union_error
        FROM (VALUES ('exact', 1e-4::DOUBLE), ('minhash', 1e-5::DOUBLE)) v(f, p)""",
    "corpus_count": "SELECT count(*) AS n_docs FROM fingerprints",
    "exact_dup_groups": f"WITH RECURSIVE {BASELINE} SELECT exact_hash, min(id) AS first_pk, count(*) AS n_copies FROM h WHERE exact_hash IS NOT NULL GROUP BY ALL HAVING count(*) > 1",
    "exact_prefilter": f"""WITH RECURSIVE {BASELINE}, p AS (SELECT id AS probe, {_OWN} AS external_id, raw_hash, exact_hash, title_hash, content_hash IS NOT NULL AS two FROM h),
        st AS (SELECT doc_pk, external_id, raw_hash, exact_hash, title_hash FROM fingerprints), {_PRE} SELECT probe, priority, reason, doc_pk FROM pre""",
    "lookup_requests": """WITH w AS (SELECT id, min(request_no) AS ordinal FROM check_request WHERE id IS NOT NULL GROUP BY id)
        SELECT ordinal, doc_pk, external_id FROM fingerprints f JOIN w ON w.id = f.external_id""",
    "keyset_page": """SELECT doc_pk, external_id FROM fingerprints WHERE doc_pk > (SELECT floor((min(doc_pk) + max(doc_pk)) / 2) FROM fingerprints) ORDER BY doc_pk LIMIT 100""",
    "raw_payloads": """WITH r AS (SELECT record_id, CASE WHEN json_valid(payload) THEN payload END AS j FROM raw_record)
        SELECT record_id, j->>'$.canonical_input.title' AS title, j->>'$.canonical_input.content' AS content FROM r""",
    "bucket_stats": """WITH s AS (SELECT scope, kind, band_index, band_value, count(DISTINCT doc_pk) AS n_docs FROM bands GROUP BY ALL)
        SELECT scope, kind, count(*) AS n_buckets, max(n_docs) AS largest, sum(n_docs)::BIGINT AS n_rows FROM s GROUP BY ALL""",
    "candidate_stats": f"""WITH RECURSIVE {_B}, {_P}, {_STORE}, {_met('content', 'simhash')} SELECT probe, candidate_rows, largest_bucket, skipped_buckets FROM ({_STATS.format(kind='simhash')})""",
    "band_hits": f"WITH RECURSIVE {_B}, {_P}, {_STORE}, {_met('content', 'minhash')} SELECT * FROM c_content_minhash",
    "match_simhash": f"WITH RECURSIVE {_B}, {_SELF}, {_met('content', 'simhash')}, {_sim('content')} SELECT * FROM sim_content",
    "match_minhash": f"WITH RECURSIVE {_B}, {_SELF}, {_met('content', 'minhash')}, {_min('content')} SELECT probe, doc_pk, round(score, 6) AS score, rank FROM min_content",
    "check_content": f"WITH RECURSIVE {_B}, {_P}, {_STORE}, {_cascade(('content',))}",
    "match_titles": f"""WITH RECURSIVE {_B}, {_prints('b', 'nt', 'tf')}, {_SELF_TITLES}, {_met('title', 'simhash')}, {_sim('title')}, {_met('title', 'minhash')}, {_min('title')}
        SELECT probe, doc_pk, 'simhash' AS method, hamming_distance::DOUBLE AS value, rank FROM sim_title UNION ALL SELECT probe, doc_pk, 'minhash', round(score, 6), rank FROM min_title""",
    "check_cascade": f"WITH RECURSIVE {_REQUESTS}, {_STORE}, {_cascade(('content', 'title'))}",
    "check_answers": f"""WITH RECURSIVE v AS (WITH RECURSIVE {_REQUESTS}, {_STORE}, {_cascade(('content', 'title'))}), {_REQUESTS}
        SELECT v.probe, p.raw_hash, p.content_hash, p.title_hash, f.external_id AS match_id, CASE WHEN v.dedupe_status = 'new' THEN p.raw_hash ELSE f.raw_hash END AS match_raw_hash, f.exact_hash AS match_content_hash,
          f.title_hash AS match_title_hash, CASE WHEN v.doc_pk IS NOT NULL THEN substring(CASE WHEN text_type = 'title' THEN t.normalized_title ELSE t.normalized_content END, 1, 160) END AS sample_text
        FROM v JOIN p ON p.probe = v.probe LEFT JOIN fingerprints f ON f.doc_pk = v.doc_pk LEFT JOIN texts t ON t.doc_pk = v.doc_pk""",
    "match_stats": f"""WITH RECURSIVE {_B}, {_P}, {_STORE}, {_met('content', 'simhash')}, {_met('content', 'minhash')}, {_sim('content')}, {_min('content')},
        bk AS ({_STATS.format(kind='simhash')} UNION ALL {_STATS.format(kind='minhash')}),
        dn AS (SELECT probe, 'simhash' AS kind, count(*) AS unique_docs, count(*) AS checks, count(*) FILTER (hamming_distance <= 25) AS matched, count(*) >= 200 AS limit_reached FROM sc_content GROUP BY probe
          UNION ALL SELECT u.probe, 'minhash', u.n, coalesce(k.n, 0), coalesce(k.m, 0), u.n > 20 FROM (SELECT probe, count(*) AS n FROM c_content_minhash GROUP BY probe) u
          LEFT JOIN (SELECT probe, count(*) AS n, count(*) FILTER (score >= 0.4) AS m FROM mc_content GROUP BY probe) k ON k.probe = u.probe)
        SELECT bk.*, coalesce(unique_docs, 0) AS unique_docs, coalesce(checks, 0) AS checks, coalesce(matched, 0) AS matched, coalesce(limit_reached, false) AS limit_reached FROM bk LEFT JOIN dn USING (probe, kind)""",
    "ranking_summary": f"""WITH RECURSIVE {_B}, {_P}, {_STORE}, {_met('content', 'minhash')} SELECT probe, count(*) AS unique_before_limit, max(band_hits) AS top_band_hits, count(*) > 20 AS truncated FROM c_content_minhash GROUP BY probe""",
    "recent_band_hits": f"""WITH RECURSIVE w AS (SELECT date_trunc('day', max({_LOCAL}))::TIMESTAMP + INTERVAL 1 DAY AS stop FROM fingerprints), {_B}, {_P}, {_STORE.replace('band_value, doc_pk FROM', 'band_value, doc_pk, created_at FROM')}, {_met('content', 'minhash', _WINDOW)}
        SELECT * FROM c_content_minhash""",
    "batch_ingest": f"""WITH RECURSIVE {BASELINE}, own AS (SELECT id, {_OWN} AS x, exact_hash AS y FROM h WHERE exact_hash IS NOT NULL),
        fresh AS (SELECT *, row_number() OVER (ORDER BY id) AS no FROM own WHERE x NOT IN (SELECT external_id FROM fingerprints WHERE external_id IS NOT NULL) AND y NOT IN (SELECT exact_hash FROM fingerprints WHERE exact_hash IS NOT NULL)),
        g AS (SELECT 0::BIGINT AS no, false AS kept, NULL::BIGINT AS id, []::VARCHAR[] AS xs, []::VARCHAR[] AS ys
          UNION ALL SELECT f.no, ok, f.id, CASE WHEN ok THEN list_append(xs, x) ELSE xs END, CASE WHEN ok THEN list_append(ys, y) ELSE ys END
          FROM (SELECT g.xs, g.ys, f.*, NOT list_contains(xs, x) AND NOT list_contains(ys, y) AS ok FROM g JOIN fresh f ON f.no = g.no + 1) f)
        SELECT id AS doc_pk, x AS external_id, y AS exact_hash FROM g JOIN own USING (id) WHERE kept""",
    "prefilter_documents": f"""WITH RECURSIVE {BASELINE}, a AS (SELECT DISTINCT exact_hash FROM h WHERE exact_hash IS NOT NULL) SELECT f.doc_pk, f.exact_hash, normalized_title, normalized_content FROM fingerprints f JOIN a USING (exact_hash) JOIN texts USING (doc_pk)""",
    "missing_band_rows": """WITH k AS (SELECT DISTINCT scope, kind, band_index, band_value, doc_pk FROM bands) SELECT scope, kind, count(*) AS n_stored, 0::BIGINT AS n_missing FROM k GROUP BY ALL""",
    "gram_jaccard": f"""WITH g AS (SELECT doc_pk, list_distinct({GRAMS.format('normalized_title')}) AS a, list_distinct({GRAMS.format('primary_text')}) AS b FROM texts)
        SELECT doc_pk, round(CASE WHEN len(a) + len(b) = 0 THEN 1.0 ELSE len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))) END, 4) AS score FROM g""",
    "strict_requests": """WITH r AS (SELECT record_id, payload AS body FROM raw_record)
        SELECT record_id, CASE WHEN NOT json_valid(body) OR json_type(body) <> 'OBJECT' THEN 'no JSON object' WHEN octet_length(encode(body)) > 1048576 THEN 'body too large'
          ELSE 'unknown field: ' || array_to_string(list_sort([k FOR k IN json_keys(body) IF k NOT IN ('id', 'source_from', 'title', 'content', 'max_hamming', 'max_bucket_size', 'limit', 'levels', 'insert_on_check')]), ', ') END AS error FROM r""",
    "exact_maybe": f"""WITH RECURSIVE {BASELINE}, p AS (SELECT id AS probe, {_OWN} AS external_id, raw_hash, exact_hash, title_hash FROM h)
        SELECT probe FROM p WHERE EXISTS (SELECT 1 FROM fingerprints f WHERE f.external_id = p.external_id OR f.raw_hash = p.raw_hash OR f.exact_hash = p.exact_hash OR f.title_hash = p.title_hash)""",
    "band_maybe": f"""WITH RECURSIVE w AS (SELECT date_trunc('day', max({_LOCAL}))::TIMESTAMP + INTERVAL 1 DAY AS stop FROM fingerprints), {_B}, s AS (SELECT id AS probe, unnest(mins) AS x FROM d),
        k AS (SELECT DISTINCT band_index, band_value FROM bands WHERE scope = 'content' AND kind = 'minhash'{_WINDOW})
        SELECT probe, x.band_index AS band_index FROM s JOIN k ON k.band_index = x.band_index AND k.band_value = x.band_value""",
    "ingest_resolved": f"""WITH RECURSIVE {BASELINE}, own AS (SELECT id, {_OWN} AS x, exact_hash AS y FROM h WHERE exact_hash IS NOT NULL),
        fresh AS (SELECT *, row_number() OVER (ORDER BY id) AS no FROM own WHERE x NOT IN (SELECT external_id FROM fingerprints WHERE external_id IS NOT NULL) AND y NOT IN (SELECT exact_hash FROM fingerprints WHERE exact_hash IS NOT NULL)),
        g AS (SELECT 0::BIGINT AS no, false AS kept, NULL::BIGINT AS id, []::VARCHAR[] AS xs, []::VARCHAR[] AS ys
          UNION ALL SELECT f.no, ok, f.id, CASE WHEN ok THEN list_append(xs, x) ELSE xs END, CASE WHEN ok THEN list_append(ys, y) ELSE ys END
          FROM (SELECT g.xs, g.ys, f.*, NOT list_contains(xs, x) AND NOT list_contains(ys, y) AS ok FROM g JOIN fresh f ON f.no = g.no + 1) f),
        w AS (SELECT own.* FROM g JOIN own USING (id) WHERE kept), al AS (SELECT doc_pk AS id, external_id AS x, exact_hash AS y FROM fingerprints UNION ALL SELECT * FROM w),
        bx AS (SELECT x, min(id) AS id FROM al GROUP BY x), hy AS (SELECT y, min(id) AS id FROM al GROUP BY y)
        SELECT own.id AS doc_pk, CASE WHEN w.id IS NOT NULL THEN w.id ELSE coalesce(bx.id, hy.id) END AS resolved_pk, w.id IS NOT NULL AS inserted
        FROM own LEFT JOIN w ON w.id = own.id LEFT JOIN bx ON bx.x = own.x LEFT JOIN hy ON hy.y = own.y""",
    "simhash_hits": f"WITH RECURSIVE {_B}, {_P}, {_STORE}, {_met('content', 'simhash')} SELECT * FROM c_content_simhash",
    "lookup_hashes": """WITH w AS (SELECT lower(content_hash) AS h, min(request_no) AS ordinal FROM prefilter_request WHERE regexp_full_match(content_hash, '[0-9a-fA-F]{32}') GROUP BY ALL)
        SELECT ordinal, doc_pk, exact_hash FROM fingerprints f JOIN w ON w.h = f.exact_hash""",
    "hash_documents": """SELECT f.doc_pk, title_hash, normalized_title, normalized_content FROM fingerprints f LEFT JOIN texts t ON t.doc_pk = f.doc_pk
        WHERE title_hash = (SELECT min(title_hash) FROM fingerprints) ORDER BY f.doc_pk LIMIT 20""",
    "band_page": """SELECT band_value, doc_pk FROM (SELECT DISTINCT band_value, created_at, doc_pk FROM bands WHERE scope = 'content' AND kind = 'minhash' AND band_index = 0 AND created_at IS NOT NULL AND band_value > 0)
        ORDER BY band_value, created_at, doc_pk LIMIT 100""",
}
