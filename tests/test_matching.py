"""The cascade against a plain Python one, request by request, over the small tables."""

import pytest

from twinsieve.functions.hashing import fingerprint_of, gram_list
from twinsieve.functions.text import normalize
from twinsieve.plans import queries

LEVELS = ["content_hash", "simhash", "minhash"]


class Doc:
    def __init__(self, pk, external, raw, exact, title_hash, title, content, primary):
        self.pk, self.external, self.raw, self.exact, self.title_hash = pk, external, raw, exact, title_hash
        self.title, self.content, self.primary = title, content, primary
        self.prints = {"content": fingerprint_of(primary), "title": fingerprint_of(title) if title else None}
        self.text = {"content": content, "title": title}
        self.own = {"content": primary, "title": title}

    def bands(self, scope, kind):
        if self.prints[scope] is None:
            return set()
        hi, lo, sig = self.prints[scope]
        if kind == "minhash":
            return {(i, int(sig[i])) for i in range(32)}
        whole = (hi & (1 << 64) - 1) << 64 | lo & (1 << 64) - 1
        return {(i, whole >> 16 * i & 65535) for i in range(8)}


def check(doc, stored, max_hamming, max_bucket, levels, capped=True):
    both = bool(doc.title and doc.content)
    keys = [("external", doc.external), ("raw", doc.raw), ("exact", doc.exact)] + ([("title_hash", doc.title_hash)] if both else [])
    for name, value in keys:
        hit = [d.pk for d in stored if value is not None and getattr(d, name) == value]
        if hit:
            return "text_same", min(hit), None, None
    limit = min(max_bucket or 1000, 2000) if capped else 10**9
    for scope in ("content", "title") if both else ("content",):
        for kind in ("simhash", "minhash"):
            if kind not in levels:
                continue
            buckets = {b: sorted(d.pk for d in stored if b in d.bands(scope, kind)) for b in doc.bands(scope, kind)}
            seen = {}
            for b in sorted(buckets):
                if len(buckets[b]) <= limit:
                    for pk in buckets[b]:
                        first, hits = seen.get(pk, ((b[0], pk), 0))
                        seen[pk] = first, hits + 1
            by = {d.pk: d for d in stored}
            if kind == "simhash":
                order = sorted((v[0], k) for k, v in seen.items() if by[k].external != doc.external)[: 200 if capped else None]
                near = []
                for place, (_, k) in enumerate(order):
                    a, b = doc.prints[scope], by[k].prints[scope]
                    d = sum(bin((x ^ y) & (1 << 64) - 1).count("1") for x, y in zip(a[:2], b[:2]))
                    if d <= max_hamming:
                        near.append((d, place, k))
                if near:
                    return "sim_same", min(near)[2], min(near)[0], None
            else:
                order = [k for _, _, k in sorted((-v[1], v[0], k) for k, v in seen.items())][: 20 if capped else None]
                scored = []
                for place, k in enumerate(order):
                    if by[k].external == doc.external:
                        continue
                    x, y = set(gram_list(doc.own[scope])), set(gram_list(by[k].text[scope]))
                    s = len(x & y) / len(x | y) if x | y else 1.0
                    if s >= 0.4:
                        scored.append((-s, place, k))
                if scored:
                    return "min_same", min(scored)[2], None, -min(scored)[0]
    return "new", None, None, None


@pytest.fixture(scope="module")
def world(duck):
    import hashlib

    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    stored = [Doc(*r) for r in duck.execute("""SELECT f.doc_pk, external_id, raw_hash, exact_hash, title_hash, normalized_title, normalized_content, primary_text
        FROM fingerprints f JOIN texts t ON t.doc_pk = f.doc_pk""").fetchall()]
    requests = []
    for no, i, source, title, content, h, b, levels, insert in duck.execute("""SELECT DISTINCT ON (request_no) request_no, id, source_from, title, content, max_hamming, max_bucket_size, levels, insert_on_check
        FROM check_request ORDER BY request_no""").fetchall():
        t, c = normalize(title), normalize(content)
        if c or t:
            raw = md5(f"title\x1f{title or ''}\x1econtent\x1f{content or ''}")
            external = i if i is not None else "doc_" + md5(f"{source or ''}|{title or ''}|{content or ''}")
            doc = Doc(no, external, raw, md5(c or t), md5(t) if t else None, t, c, c or t)
            requests.append((doc, h, b if b and b >= 1 else None, LEVELS if levels is None else levels, bool(insert)))
    return stored, requests


def close(got, want):
    assert got["dedupe_status"] == want[0], (got, want)
    assert got["hamming_distance"] == want[2] and (got["score"] is None) == (want[3] is None)
    assert want[3] is None or abs(got["score"] - want[3]) < 1e-9


def test_check_cascade(spark, sf, world):
    stored, requests = world
    got = {r["probe"]: r for r in queries.check_cascade(spark, sf).collect()}
    assert set(got) == {d.pk for d, *_ in requests}
    for doc, h, b, levels, _ in requests:
        want = check(doc, stored, h, b, levels)
        close(got[doc.pk], want)
        assert got[doc.pk]["doc_pk"] == want[1]


def test_check_insert(spark, sf, world):
    stored, requests = world
    got = {r["probe"]: r for r in queries.check_insert(spark, sf).collect()}
    assert set(got) == {d.pk for d, *_ in requests}
    accepted = []
    for doc, h, b, levels, insert in requests:
        want = check(doc, stored, h, b, levels)
        inside = want[0] == "new"
        if inside:
            want = check(doc, accepted, h, None, levels, capped=False)
        close(got[doc.pk], want)
        assert got[doc.pk]["match_probe" if inside else "doc_pk"] == want[1]
        assert got[doc.pk]["inserted"] == (want[0] == "new" and insert)
        if want[0] == "new" and insert:
            accepted.append(doc)
    assert accepted


def test_check_insert_holds_store_and_batch_together(spark, sf, world):
    """A request that the store answers late in the cascade meets an accepted one first."""
    from pyspark.sql import functions as F

    from twinsieve.operators import fingerprint, matching
    from twinsieve.sources.tables import table

    stored, _ = world
    old = next(d for d in stored if len(d.content) > 300)
    near = old.content + " and one more word"
    assert check(Doc(2, "twice", "-", "-", None, "", near, near), stored, 25, None, LEVELS)[0] == "sim_same"
    fresh = "nothing in the store is like this sentence about seventeen violet umbrellas and a slow brass kettle"
    rows = [(1, "twice", None, fresh, True), (2, "twice", None, near, True), (3, "other", None, near, True), (4, "own", "a title that only one holds", "a second sentence with wholly different words, of harbours, ladders and cold marble", True), (5, "late", "a title that only one holds", near, False)]
    asked = spark.createDataFrame(rows, "probe long, external_id string, title string, content string, insert boolean")
    got = {r["probe"]: r for r in matching.check_and_insert(fingerprint.fingerprints(asked), *[table(spark, sf, t) for t in ("bands", "fingerprints", "texts")]).collect()}
    assert {n: (r["dedupe_status"], r["match_probe"], r["inserted"]) for n, r in got.items()} == {
        1: ("new", None, True), 2: ("text_same", 1, False), 3: ("sim_same", None, False), 4: ("new", None, True), 5: ("text_same", 4, False)
    }
    assert got[3]["doc_pk"] is not None and got[2]["doc_pk"] is None and got[5]["text_type"] == "title"
