"""Queries over the whole baseline: records without a stored expectation take part like any other."""

import hashlib

import pytest
from pyspark.sql import functions as F
from test_matching import LEVELS, Doc, check, world  # noqa: F401

from twinsieve.functions.hashing import fingerprint_of
from twinsieve.functions.text import normalize
from twinsieve.plans.queries import QUERIES

# Each record is judged by itself or against the store.
ROWWISE = {"doc_normalized": "doc_pk", "doc_hashes": "doc_pk", "doc_scope_text": "doc_pk", "doc_simhash": "doc_pk", "doc_bands": "doc_pk", "exact_prefilter": "probe", "band_hits": "probe", "check_content": "probe"}


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def records(duck):
    """doc_pk -> (document, expected?) of all distinct records."""
    out = {}
    for pk, source, title, content, known in duck.execute("""SELECT DISTINCT ON (doc_pk) doc_pk, coalesce(source_from, ''), coalesce(canonical_input.title, ''), coalesce(canonical_input.content, ''),
        expected_from_canonical_input IS NOT NULL FROM baseline_record ORDER BY doc_pk""").fetchall():
        t, c = normalize(title), normalize(content)
        raw = md5(f"title\x1f{title}\x1econtent\x1f{content}")
        out[pk] = Doc(pk, "doc_" + md5(f"{source}|{title}|{content}"), raw, md5(c or t) if c or t else None, md5(t) if t else None, t, c, c or t), known
    assert any(not known and d.primary for d, known in out.values())
    return out


def test_rows_without_an_expectation(spark, sf, records, world):  # noqa: F811
    stored, _ = world
    rest = {pk: d for pk, (d, known) in records.items() if not known}
    got = {n: {r[ROWWISE[n]]: r for r in QUERIES[n](spark, sf).filter(F.col(ROWWISE[n]).isin(list(rest))).collect()} for n in ROWWISE}
    for pk, d in rest.items():
        assert (got["doc_normalized"][pk]["normalized_title"], got["doc_normalized"][pk]["normalized_content"]) == (d.title, d.content)
        assert (got["doc_hashes"][pk]["raw_hash"], got["doc_hashes"][pk]["exact_hash"], got["doc_hashes"][pk]["title_hash"]) == (d.raw, d.exact, d.title_hash)
        assert got["doc_scope_text"][pk]["primary_text"] == d.primary
        hi, lo, _ = fingerprint_of(d.primary)
        assert got["doc_simhash"][pk]["simhash_hex"] == f"{hi & (1 << 64) - 1:016x}{lo & (1 << 64) - 1:016x}"
        if d.primary:
            own = Doc(pk, d.external, d.raw, d.exact, None, "", d.content, d.primary)  # no title chain
            want = check(own, stored, 25, None, LEVELS)
            assert (got["check_content"][pk]["dedupe_status"], got["check_content"][pk]["doc_pk"]) == want[:2]


def test_groups_and_ingest(spark, sf, records, duck):
    docs = [d for _, (d, _) in sorted(records.items()) if d.primary]
    groups = {}
    for d in docs:
        groups.setdefault(d.exact, []).append(d.pk)
    got = {tuple(r) for r in QUERIES["exact_dup_groups"](spark, sf).select("exact_hash", "first_pk", "n_copies").collect()}
    assert got == {(h, min(v), len(v)) for h, v in groups.items() if len(v) > 1}
    ids, hashes = (set(x[0] for x in duck.execute(f"SELECT {c} FROM fingerprints WHERE {c} IS NOT NULL").fetchall()) for c in ("external_id", "exact_hash"))
    want = set()
    for d in docs:
        if d.external not in ids and d.exact not in hashes:
            want.add(d.pk)
            ids.add(d.external)
            hashes.add(d.exact)
    assert {r["doc_pk"] for r in QUERIES["batch_ingest"](spark, sf).collect()} == want


def test_matches_among_all_records(spark, sf, records):
    docs = [d for d, _ in records.values() if d.primary]
    best = {n: {r["probe"]: r for r in QUERIES[n](spark, sf).filter("rank = 1").collect()} for n in ("match_simhash", "match_minhash")}
    titles = {(r["probe"], r["method"]): r["doc_pk"] for r in QUERIES["match_titles"](spark, sf).filter("rank = 1").collect()}
    for d in docs:
        for level in ("simhash", "minhash"):
            one = Doc(d.pk, str(d.pk), None, None, None, "", d.content, d.primary)  # content scope only, no hashes
            others = [Doc(x.pk, str(x.pk), -1, -1, -1, x.title, x.content, x.primary) for x in docs]
            want = check(one, [x for x in others if x.pk != d.pk], 25, None, [level])
            hit = best[f"match_{level}"].get(d.pk)
            assert (hit and hit["doc_pk"]) == want[1]
    asked = {d.pk for d in docs if d.title and d.content}
    with_twin = {d.pk for d in docs if d.pk in asked and any(x.pk != d.pk and x.title == d.title for x in docs)}
    assert {p for p, _ in titles} <= asked and {(p, m) for p in with_twin for m in ("simhash", "minhash")} <= set(titles)


def test_candidate_stats_have_the_limit_of_the_service(spark, sf, records, duck):
    sizes = {(i, v): n for i, v, n in duck.execute("SELECT band_index, band_value, count(DISTINCT doc_pk) FROM bands WHERE scope = 'content' AND kind = 'simhash' GROUP BY ALL").fetchall()}
    got = {r["probe"]: r for r in QUERIES["candidate_stats"](spark, sf).collect()}
    for pk, (d, _) in records.items():
        met = [min(sizes[b], 1001) for b in d.bands("content", "simhash") if b in sizes]
        assert (pk in got) == bool(met)
        if met:
            assert (got[pk]["candidate_rows"], got[pk]["largest_bucket"], got[pk]["skipped_buckets"]) == (sum(met), max(met), sum(n > 1000 for n in met))
