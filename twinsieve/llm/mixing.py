"""Problem 8: mixing sources to target weights.

Every row of a source is used in complete epochs as often as its budget allows, and the rest of the
budget is filled by an Efraimidis-Spirakis sample: each row gets an exponential key scaled by its
quality weight, the rows of a source are taken in order of their keys, and the prefix sum of their
tokens is cut at the budget. The prefix sum is not run over a sorted source in one task: keys fall
into fixed ranges, the tokens per source and range are added up first, and only the rows of the one
range in which the budget ends are sorted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from twinsieve.llm import tokenizer
from twinsieve.session import written

RANGES = 1 << 16
MAX_SOURCES = 10_000


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", folder: str = tokenizer.TOKENIZER_DIR, file: str = tokenizer.RANKS_FILE) -> DataFrame:
    """key, source, n_tokens and quality of every row: 0.1 + 0.9 times the share of letters and digits.

    Null and empty texts have 0 tokens. No shuffle.
    """
    tables = tokenizer.broadcast_vocabulary(docs.sparkSession, folder, file)
    rows = docs.select(F.col(key).alias("_key"), F.col(source).alias("_source"), F.col(text).alias("_text"))
    kind = rows.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer.worker_encoder(tables)
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for a, b in tokenizer.blocks(texts):
                e = encoder.block(texts[a:b])
                good = np.concatenate([[0], np.cumsum(encoder.v.kinds[e.codes] <= tokenizer.NUMBER)])
                chars = np.diff(e.text_chars)
                quality = 0.1 + 0.9 * np.diff(good[e.text_chars]) / np.maximum(chars, 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(np.diff(e.text_tokens), pa.int64()), pa.array(quality)],
                    names=[key, source, "n_tokens", "quality"],
                )

    return rows.mapInArrow(run, f"`{key}` {kind}, `{source}` string, n_tokens long, quality double")


def plan(sizes: DataFrame, weights: DataFrame, total_tokens: float | None = None, source: str = "source") -> DataFrame:
    """One row per listed source: tokens, target_share, max_repeats, budget, epochs, rest.

    Without total_tokens the mix is the largest in which every source that has tokens meets its share
    within max_repeats. With it, a source that cannot meet its budget gives all it may. A source is
    listed once (of repeated rows the smallest share and repeats hold); a null share counts as 0, null
    or negative repeats as 0.
    """
    listed = weights.filter(F.col(source).isNotNull()).groupBy(source).agg(F.min("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    listed = listed.select(source, F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("max_repeats"))
    tokens = sizes.groupBy(source).agg(F.sum("n_tokens").alias("tokens"))
    both = listed.join(tokens, source, "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    can = F.when((F.col("target_share") > 0) & (F.col("tokens") > 0), F.col("tokens") * F.col("max_repeats") / F.col("target_share"))
    total = F.lit(float(total_tokens)) if total_tokens is not None else F.coalesce(both.agg(F.min(can)).scalar(), F.lit(0.0))
    out = both.withColumn("budget", F.col("target_share") * total)
    full = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens") + 1e-9)).otherwise(0)
    out = out.withColumn("epochs", F.least(full, F.col("max_repeats")).cast("int"))
    rest = F.when(F.col("epochs") < F.col("max_repeats"), F.greatest(F.col("budget") - F.col("epochs") * F.col("tokens"), F.lit(0.0))).otherwise(0.0)
    return out.select(source, "target_share", "max_repeats", "tokens", "budget", "epochs", rest.alias("rest"))


def sampling_key(key: Column, quality: Column, seed: int) -> Column:
    """-ln(u) / quality with u in (0, 1) drawn from the key and the seed, so that reruns draw alike."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.ln(u) / F.greatest(quality, F.lit(1e-6))


def mix(docs: DataFrame, weights: DataFrame, total_tokens: float | None = None, seed: int = 7, key: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """(used, shares). used: key, source, n_tokens, repeats of every row that is in the mix.

    shares: one row per listed source with target_share, the tokens it gives and the share reached.
    Rows without a source, of a source that is not listed, or without tokens stay out. Ties of the
    sampling key go by the key. The row at which the budget ends is taken if at least half of it fits, so
    a source misses its budget by at most half a row. An empty table gives no rows and shares of 0.
    """
    if weights.limit(MAX_SOURCES + 1).count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sizes = written(sized(docs, key, text, source), "sizes")
    plans = written(plan(sizes, weights, total_tokens, source), "mix-plan")  # at most MAX_SOURCES rows
    order = sampling_key(F.col(key), F.col("quality"), seed)
    rows = sizes.filter("n_tokens > 0").join(F.broadcast(plans.select(source, "epochs", "rest")), source).withColumn("_order", order)
    # A monotone function of the sampling key: for qualities from 0.1 to 1 no range gets more than about
    # 1 / 10,000 of a source.
    rows = rows.withColumn("_range", F.floor(F.col("_order") / (F.col("_order") + 1) * RANGES).cast("int"))
    sums = rows.filter("rest > 0").groupBy(source, "_range").agg(F.sum("n_tokens").alias("_sum"), F.first("rest").alias("_rest"))
    upto = F.sum("_sum").over(Window.partitionBy(source).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0))  # at most RANGES rows
    ends = sums.withColumn("_upto", upto).filter(F.col("_upto") > F.col("_rest"))
    ends = ends.groupBy(source).agg(F.min_by(F.struct("_range", (F.col("_rest") - F.col("_upto") + F.col("_sum")).alias("_left")), "_range").alias("_end"))
    ends = written(ends.select(source, F.col("_end._range").alias("_end"), F.col("_end._left").alias("_left")), "mix-ends")
    placed = rows.join(F.broadcast(ends), source, "left")
    wants = F.col("rest") > 0
    inside = F.sum("n_tokens").over(Window.partitionBy(source).orderBy("_order", key).rowsBetween(Window.unboundedPreceding, 0))
    edge = placed.filter(wants & (F.col("_range") == F.col("_end"))).withColumn("_more", (inside - F.col("n_tokens") / 2 <= F.col("_left")).cast("int"))
    plain = placed.filter(~wants | F.col("_end").isNull() | (F.col("_range") != F.col("_end")))
    plain = plain.withColumn("_more", F.when(wants & (F.col("_end").isNull() | (F.col("_range") < F.col("_end"))), 1).otherwise(0))
    used = plain.unionByName(edge).withColumn("repeats", F.col("epochs") + F.col("_more")).filter("repeats > 0").select(key, source, "n_tokens", "repeats")
    given = used.groupBy(source).agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("mixed_tokens"), F.max("repeats").alias("most_repeats"))
    shares = plans.join(given, source, "left").withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0)))
    whole = F.sum("mixed_tokens").over(Window.partitionBy(F.lit(1)))  # over the listed sources, at most MAX_SOURCES rows
    shares = shares.withColumn("reached_share", F.coalesce(F.try_divide(F.col("mixed_tokens"), whole), F.lit(0.0)))
    return used, shares.select(source, "target_share", "max_repeats", "tokens", "budget", "epochs", "mixed_tokens", F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), "reached_share")
