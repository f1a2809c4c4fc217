"""Statistics of candidate searches, progress and memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from twinsieve.operators.fingerprint import band_rows
from twinsieve.operators.matching import bucket_sizes, candidates, minhash_checks, ranking_summary, simhash_checks
from twinsieve.operators.memory import memory
from twinsieve.params import DEFAULTS, Params


def candidate_stats(probe_bands: DataFrame, bands: DataFrame, scope: str, kind: str, p: Params = DEFAULTS, key: str = "probe") -> DataFrame:
    """A4 per probe: candidate_rows, largest_bucket, skipped_buckets over the buckets of its bands.

    A bucket above the probe's limit is skipped; its size counts as the limit plus one, since no more of
    it is looked at. Only sizes of asked buckets are counted and joined, no documents. Probes without a
    bucket are left out.
    """
    limit = F.least(F.coalesce("max_bucket", F.lit(p.max_bucket_size)), F.lit(p.max_bucket_cap))
    asks = probe_bands.filter(F.col("kind") == kind).select(key, "band_index", "band_value", limit.alias("_limit")).distinct()
    own = bands.filter((F.col("scope") == scope) & (F.col("kind") == kind)).join(asks.select("band_index", "band_value").distinct(), ["band_index", "band_value"], "left_semi")
    sizes = bucket_sizes(own).select("band_index", "band_value", "n_docs")
    seen = F.least(F.col("n_docs"), F.col("_limit") + 1)
    return asks.join(sizes, ["band_index", "band_value"]).groupBy(key).agg(
        F.sum(seen).alias("candidate_rows"), F.max(seen).alias("largest_bucket"), F.count_if(F.col("n_docs") > F.col("_limit")).alias("skipped_buckets")
    )


def match_stats(probes: DataFrame, bands: DataFrame, store: DataFrame, texts: DataFrame, scope: str = "content", p: Params = DEFAULTS, key: str = "probe") -> DataFrame:
    """A3, A4 per probe and kind: the columns of candidate_stats(), unique_docs, checks, limit_reached, matched.

    unique_docs: for simhash the documents looked at, for minhash all candidates before the cut;
    checks: comparisons made; limit_reached: candidates were left out. Probes without a bucket are left out.
    """
    if "max_bucket" not in probes.columns:
        probes = probes.withColumn("max_bucket", F.lit(None).cast("int"))
    asks = band_rows(probes, key, scope, ("max_bucket",))
    out = None
    for kind in ("simhash", "minhash"):
        stats = candidate_stats(asks, bands, scope, kind, p, key)
        if kind == "simhash":
            seen = simhash_checks(probes, bands, store, scope, p, key)
            near = F.col("hamming_distance") <= F.col("max_hamming")
        else:
            seen, near = minhash_checks(probes, bands, store, texts, scope, p, key), F.col("score") >= p.jaccard_threshold
        done = seen.groupBy(key).agg(F.count(F.lit(1)).alias("checks"), F.count_if(near).alias("matched"))
        if kind == "simhash":
            done = done.withColumns({"unique_docs": F.col("checks"), "limit_reached": F.col("checks") >= p.max_checks})
        else:
            summary = ranking_summary(candidates(asks, bands, scope, kind, p, key), p, key)
            done = summary.select(key, F.col("unique_before_limit").alias("unique_docs"), F.col("truncated").alias("limit_reached")).join(done, key, "left")
        rows = stats.join(done, key, "left").select(
            key, F.lit(kind).alias("kind"), "candidate_rows", "largest_bucket", "skipped_buckets", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("unique_docs", "checks", "matched")],
            F.coalesce("limit_reached", F.lit(False)).alias("limit_reached"))
        out = rows if out is None else out.unionByName(rows)
    return out


def observed(df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, Observation]:
    """Measures that are taken while df runs, without a pass of their own; rows are always counted."""
    o = Observation(name)
    return df.observe(o, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in measures.items()]), o


def throughput(records: int, seconds: float, scopes: int | None = None) -> dict:
    """Rates of a finished run; 0 for no time."""
    rate = lambda n: round(n / seconds, 2) if seconds > 0 else 0.0
    out = {"records": records, "elapsed_seconds": round(seconds, 3), "records_per_second": rate(records)}
    return out if scopes is None else out | {"scopes": scopes, "scopes_per_second": rate(scopes)}


def progress(done: int, expected: int, seconds: float) -> dict:
    """Share done (100 % at most), rows a second and seconds left; None where unknown."""
    rate = done / seconds if seconds > 0 else None
    share = min(100.0, round(100 * done / expected, 2)) if expected > 0 else None
    left = max(0, expected - done) / rate if rate and expected > 0 else None
    return {"percent": share, "rows_per_second": None if rate is None else round(rate, 2), "seconds_left": None if left is None else round(left, 1)}


__all__ = ["candidate_stats", "match_stats", "memory", "observed", "progress", "throughput"]
