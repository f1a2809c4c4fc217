import random

import numpy as np
import pytest
import regex
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from twinsieve.llm import mixing, queries, splitting, tokenizer


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(f"{tokenizer.TOKENIZER_DIR}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoder():
    return tokenizer.Encoder(tokenizer.Vocabulary.load())


ODD = ["", "a" * 5000, "!" * 999, " \n\n  \t x", "<|endoftext|>hi", "it's 've''s", "\x00\x01", "👍🏽👨‍👩‍👧", "中" * 4000, "x'sy 'll  're's'd", "'", "a'", " 's", "''s", "a\n\n b\t\tc ", "'r e", "'\n's", "1２३ x", " a　b"]


def encode(encoder, texts):
    e = encoder.block(texts)
    return [e.ids[a:b].tolist() for a, b in zip(e.text_tokens[:-1], e.text_tokens[1:])]


def test_equals_the_library(encoder, library, duck):
    texts = ODD + [t or "" for (t,) in duck.execute("SELECT text FROM documents").fetchall()]
    assert encode(encoder, texts) == [library(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.text(alphabet=" '\nabsdtrevml中1.", max_size=20)), max_size=5))
def test_pretokens_and_round_trip(texts):
    enc = test_pretokens_and_round_trip.encoder
    for t, ids in zip(texts, encode(enc, texts) if texts else []):
        assert b"".join(enc.v.tokens[i] for i in ids).decode() == t
    if "".join(texts):
        e = enc.block(texts)
        want = [m.start() + int(s) for t, s in zip(texts, e.text_chars) for m in regex.finditer(tokenizer.PATTERN, t)]
        assert e.pretoken_chars.tolist() == want


test_pretokens_and_round_trip.encoder = tokenizer.Encoder(tokenizer.Vocabulary.load())


def test_perfect_hash(encoder):
    assert sorted(encoder.v.id_at.tolist()) == list(range(len(encoder.v.tokens)))
    keys = np.random.default_rng(1).integers(0, 2**64, 1000, dtype=np.uint64)
    h, slots = tokenizer.PerfectHash.build(keys)
    assert sorted(slots.tolist()) == list(range(1000)) and (h.slot(keys) == slots).all()


def test_encode_rows(spark, sf, library):
    rows = [(1, "hello world"), (2, None), (3, ""), (3, ""), (None, "x"), (4, "长" * 30000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, ids string")
    got = [(r["doc_id"], r["ids"]) for r in tokenizer.encode(df).collect()]
    assert sorted(got, key=str) == sorted([(k, library(t or "")) for k, t in rows], key=str)
    assert tokenizer.encode(df.limit(0)).count() == 0
    assert queries.p7_ids(spark, sf).count() == 100


LIMITS = "limit_name string, max_tokens int, overlap_tokens int"


def check_pieces(pieces, docs, limits, library):
    by = {}
    for p in pieces:
        by.setdefault((p["limit_name"], p["doc_id"]), []).append(p)
    assert set(by) == {(n, d) for n, m, _ in limits for d, t in docs.items() if len(library(t)) > m}
    bounds = {n: (m, o) for n, m, o in limits}
    for (name, d), own in by.items():
        own.sort(key=lambda p: p["piece_no"])
        most, overlap = bounds[name]
        assert own[0]["char_start"] == 0 and own[-1]["char_end"] == len(docs[d])
        for k, p in enumerate(own):
            assert p["piece_no"] == k and p["text"] == docs[d][p["char_start"] : p["char_end"]]
            assert p["n_tokens"] == len(library(p["text"])) <= most
            if k:
                assert own[k - 1]["char_start"] < p["char_start"] <= own[k - 1]["char_end"] < p["char_end"]
                shared = len(library(docs[d][p["char_start"] : own[k - 1]["char_end"]]))
                assert overlap - 4 <= shared <= most


def test_split(spark, library, duck):
    docs = {d: t or "" for d, t in duck.execute("SELECT doc_id, text FROM documents").fetchall()}
    docs |= {10**6 + i: t for i, t in enumerate(ODD)}
    r = random.Random(4)
    docs |= {10**7 + i: "".join(r.choices(["ab", "c'd", "\n", "\n\n", " ", "。", "中文", "xyz" * 60, "3.14", "’"], k=200)) for i in range(10)}
    limits = [("small", 128, 16), ("medium", 512, 64), ("tiny", 16, 4)]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs.items()] + [(5 * 10**7, None, 1)], "doc_id long, text string, piece_no int")
    pieces = splitting.split(df, spark.createDataFrame(limits, LIMITS)).collect()
    check_pieces(pieces, docs, limits, library)
    assert splitting.split(df.limit(0), spark.createDataFrame(limits, LIMITS)).count() == 0
    assert splitting.split(df, spark.createDataFrame([], LIMITS)).count() == 0
    with pytest.raises(ValueError):
        splitting.split(df, spark.createDataFrame([("bad", 16, 8)], LIMITS))


def test_split_prefers_strong_places(spark):
    text = "word " * 60 + "\n\n" + "word " * 60
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    first = splitting.split(df, spark.createDataFrame([("x", 100, 10)], LIMITS)).orderBy("piece_no").first()
    assert first["text"].endswith("\n\n")


@pytest.mark.parametrize("run", ["鬱" * 60, "qxz" * 60, "쀍" * 60])
def test_split_prefers_an_early_boundary_to_none(spark, run):
    text = "one two three four five six, " + run + " and so on"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    first = splitting.split(df, spark.createDataFrame([("x", 40, 2)], LIMITS)).orderBy("piece_no").first()
    assert first["text"] == "one two three four five six, " or first["text"] == "one two three four five six,"


def test_range_max():
    r = np.random.default_rng(3)
    values = r.integers(0, 4, 300)
    t = splitting.RangeMax(values, 40)
    for _ in range(300):
        a, b = sorted(r.integers(0, 300, 2).tolist())
        best = max(values[a : b + 1])
        assert t.argmax(a, b) == max(i for i in range(a, b + 1) if values[i] == best)


WEIGHTS = "source string, target_share double, max_repeats int"


def test_mix(spark):
    r = random.Random(6)
    docs = [(i, " ".join(["word"] * r.randrange(1, 60)), r.choice(["big"] * 8 + ["mid", "small", None, "unlisted"])) for i in range(1500)] + [(2000, None, "big"), (2001, "", "big")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, source string, repeats int")
    weights = [("big", 0.5, 1), ("mid", 0.3, 3), ("small", 0.2, 2), ("absent", 0.1, 5), (None, 0.1, 1)]
    w = spark.createDataFrame(weights, WEIGHTS)
    used, shares = mixing.mix(df, w)
    rows = used.collect()
    assert len({x["doc_id"] for x in rows}) == len(rows) and {x["source"] for x in rows} <= {"big", "mid", "small"}
    most = {s: m for s, _, m in weights}
    assert all(1 <= x["repeats"] <= most[x["source"]] for x in rows)
    got = {x["source"]: x for x in shares.collect()}
    assert set(got) == {"big", "mid", "small", "absent"} and got["absent"]["mixed_tokens"] == 0
    for s in ("big", "mid", "small"):
        own = [x for x in rows if x["source"] == s]
        assert sum(x["n_tokens"] * x["repeats"] for x in own) == got[s]["mixed_tokens"]
        assert abs(got[s]["mixed_tokens"] - got[s]["budget"]) <= 30
        # Complete epochs come before the sample: repeats of a source differ by one at most.
        if got[s]["epochs"]:
            assert {x["repeats"] for x in own} <= {got[s]["epochs"], got[s]["epochs"] + 1}
    assert {x["doc_id"]: x["repeats"] for x in mixing.mix(df, w)[0].collect()} == {x["doc_id"]: x["repeats"] for x in rows}
    capped = {x["source"]: x for x in mixing.mix(df, w, total_tokens=10**9)[1].collect()}
    assert all(capped[s]["mixed_tokens"] == capped[s]["tokens"] * most[s] for s in ("big", "mid", "small"))
    none, zero = mixing.mix(df.limit(0), w)
    assert none.count() == 0 and all(x["mixed_tokens"] == 0 for x in zero.collect())
    assert mixing.mix(df, w.limit(0))[0].count() == 0


def test_sample_follows_quality(spark):
    rows = [(i, "good words in here" if i % 2 else "!!!! ???? ---- ####", "s") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    used, _ = mixing.mix(df, spark.createDataFrame([("s", 1.0, 1)], WEIGHTS), total_tokens=2000)
    ids = [x["doc_id"] for x in used.collect()]
    assert sum(i % 2 for i in ids) > 0.7 * len(ids)
