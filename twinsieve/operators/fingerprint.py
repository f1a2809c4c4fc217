"""Q1 and Q7: fingerprints of documents, and their verification against expectations."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, functions as F

from twinsieve.functions import hashing, scalars, text
from twinsieve.operators.memory import memory
from twinsieve.params import DEFAULTS, Params
from twinsieve.session import distinct_by


def fingerprints(docs: DataFrame, title: str = "title", content: str = "content", p: Params = DEFAULTS, family: str = "blake2b", title_scope: bool = True) -> DataFrame:
    """All columns of docs but the two texts, and their fingerprints.

    Adds raw_hash, normalized_title, normalized_content, content_hash, title_hash, primary_text,
    exact_hash, text_len, low_information, and per scope <scope>_simhash_hi, _lo, _simhash_bands,
    _minhash_bands; those of the title are null without a title. Null texts count as empty. Each text
    is normalised once and each scope hashed once, in Arrow batches; everything else stays in the JVM.
    """
    added = ("raw_hash", "normalized_title", "normalized_content")
    keep = [c for c in docs.columns if c not in (title, content, *added, *DERIVED)]
    raw = F.md5(scalars.raw_hash_text(F.col(title), F.col(content)))
    out = docs.select(*keep, raw.alias("raw_hash"), text.normalized(F.col(title)).alias("normalized_title"), text.normalized(F.col(content)).alias("normalized_content"))
    return _derived(out, p, family, title_scope)


DERIVED = ("content_hash", "title_hash", "primary_text", "exact_hash", "text_len", "low_information")


def of_normalized(texts: DataFrame, title: str = "title", content: str = "content", p: Params = DEFAULTS, family: str = "blake2b", title_scope: bool = True) -> DataFrame:
    """fingerprints() of texts that are normalised already; without raw_hash."""
    keep = [c for c in texts.columns if c not in (title, content, "normalized_title", "normalized_content", *DERIVED)]
    own = lambda c: F.coalesce(c, F.lit(""))
    return _derived(texts.select(*keep, own(title).alias("normalized_title"), own(content).alias("normalized_content")), p, family, title_scope)


def _derived(out: DataFrame, p: Params, family: str, title_scope: bool) -> DataFrame:
    out = out.withColumns({"content_hash": scalars.text_hash(F.col("normalized_content")), "title_hash": scalars.text_hash(F.col("normalized_title"))})
    out = out.withColumns({
        "primary_text": text.scope_text(F.col("normalized_content"), F.col("normalized_title")),
        "exact_hash": scalars.exact_hash(F.col("content_hash"), F.col("title_hash")),
    })
    out = out.withColumns({"text_len": F.length("primary_text"), "low_information": text.low_information(F.col("primary_text"))})
    for scope, column in (("content", "primary_text"), ("title", "normalized_title")) if title_scope else (("content", "primary_text"),):
        out = out.withColumn("_f", hashing.fingerprint(F.col(column), p.ngram, p.minhash_perms, family))
        there = F.lit(True) if scope == "content" else F.col("normalized_title") != ""
        hi, lo = F.col("_f.simhash_hi"), F.col("_f.simhash_lo")
        out = out.withColumns({
            f"{scope}_simhash_hi": F.when(there, hi),
            f"{scope}_simhash_lo": F.when(there, lo),
            f"{scope}_simhash_bands": F.when(there, hashing.simhash_bands(hi, lo)),
            f"{scope}_minhash_bands": F.when(there, hashing.minhash_bands(F.col("_f.minhash"), p.minhash_bands)),
        }).drop("_f")
    return out


def _tagged(bands: str, kind: str) -> Column:
    return F.transform(bands, lambda b: F.struct(F.lit(kind).alias("kind"), b["band_index"].alias("band_index"), b["band_value"].alias("band_value")))


def band_rows(prints: DataFrame, key: str, scope: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """key, kind, band_index, band_value of a scope, 40 rows a document; none without that scope."""
    bands = F.concat(*[_tagged(f"{scope}_{kind}_bands", kind) for kind in ("simhash", "minhash")])
    return prints.select(key, *carry, F.explode(bands).alias("_b")).select(key, *carry, "_b.kind", "_b.band_index", "_b.band_value")


def verify(records: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Q7 of baseline records: doc_pk, first_mismatch (null where all compared fields agree), title_checked.

    The title scope is compared too where the expectation has a title_scope. Fields of a scope that the
    expectation's type does not have are not compared. Records without an expectation are left out; a
    record exported twice counts once.
    """
    known = records.filter(F.col("expected_from_canonical_input").isNotNull())
    known = distinct_by(known, "doc_pk")
    rows = known.select("doc_pk", F.col("canonical_input.title").alias("title"), F.col("canonical_input.content").alias("content"), F.col("expected_from_canonical_input").alias("e"))
    expected = rows.schema["e"].dataType
    got = fingerprints(rows, p=p, title_scope="title_scope" in expected.names)
    place = {"raw_hash": "e.raw_hash_hex", "content_hash": "e.content_hash_hex", "title_hash": "e.title_hash_hex"}
    place |= {c: f"e.{c}" for c in ("normalized_title", "normalized_content", "primary_text")}
    checks = [(c, F.col(c), F.col(at), F.lit(True)) for c, at in place.items()]
    for scope in ("content", "title"):
        if f"{scope}_scope" not in expected.names:
            continue
        own = F.col("primary_text") if scope == "content" else F.col("normalized_title")
        hi, lo = F.col(f"{scope}_simhash_hi"), F.col(f"{scope}_simhash_lo")
        values = {
            "text": own, "text_len": F.length(own), "low_information": text.low_information(own), "exact_hash": F.col("exact_hash" if scope == "content" else "title_hash"),
            "simhash_hex": hashing.simhash_hex(hi, lo), "simhash_hi_pg_bigint": hi, "simhash_lo_pg_bigint": lo, "simhash_bands": F.col(f"{scope}_simhash_bands"), "minhash_bands": F.col(f"{scope}_minhash_bands"),
        }
        fields = expected[f"{scope}_scope"].dataType.names
        at = F.col(f"e.{scope}_scope")
        for c, value in values.items():
            if c in fields:
                want = at[c].cast("array<struct<band_index:int,band_value:bigint>>") if c.endswith("_bands") else at[c]
                want = want.cast("long") if c.endswith("_bigint") else want
                checks.append((c if scope == "content" else f"title_scope.{c}", value, want, F.lit(True) if scope == "content" else at.isNotNull()))
    mismatch = F.lit(None).cast("string")
    for c, value, want, there in reversed(checks):
        mismatch = F.when(there & ~value.eqNullSafe(want), F.lit(c)).otherwise(mismatch)
    titles = F.col("e.title_scope").isNotNull() if "title_scope" in expected.names else F.lit(False)
    return got.select("doc_pk", mismatch.alias("first_mismatch"), titles.alias("title_checked"))


def report(verified: DataFrame, samples: int = 5, started: float | None = None) -> DataFrame:
    """Records, failure_count, status and up to five failing doc_pk (the smallest).

    With ``started``, the time.time() at which verification began, also elapsed_seconds and
    records_per_second up to now, and the memory of this process in MB (A9, A11).
    """
    bad = F.col("first_mismatch").isNotNull()
    failing = verified.filter(bad).orderBy("doc_pk").limit(samples).agg(F.sort_array(F.collect_list("doc_pk"))).scalar()
    total = verified.agg(F.count(F.lit(1)).alias("records"), F.count_if(bad).alias("failure_count"))
    status = F.when(F.col("failure_count") == 0, "passed").otherwise("failed")
    out = total.select("records", "failure_count", status.alias("status"), failing.alias("failures"))
    if started is None:
        return out
    seconds, used = max(time.time() - started, 1e-9), memory()
    return out.select("*", F.lit(round(seconds, 6)).alias("elapsed_seconds"), F.round(F.col("records") / seconds, 2).alias("records_per_second"),
                      F.lit(used["current_mb"]).alias("current_mb"), F.lit(used["peak_mb"]).alias("peak_mb"))
