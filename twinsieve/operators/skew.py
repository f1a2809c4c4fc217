"""Operators for keys that hold a large share of the rows.

Every operator bounds what it broadcasts by a proof, not by a guess: at most ``limit`` keys can each
hold more than 1/limit of all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

HOT_KEYS = 1024


def heavy_keys(rows: DataFrame, keys: Sequence[str], limit: int = HOT_KEYS, at_least: int = 1024) -> DataFrame:
    """The keys that hold at least 1/limit of all rows and at_least rows; never more than limit of them.

    Counted exactly with map-side partial sums, so one hot key costs one row per map task. Columns:
    the keys and ``n_rows``. Nulls are a key of their own. An empty table gives no keys.
    """
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    total = rows.agg(F.count(F.lit(1))).scalar()
    return counts.filter((F.col("n_rows") >= at_least) & (F.col("n_rows") * limit >= total))


def _same(a: str, b: str, keys: Sequence[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def salted_count_distinct(
    rows: DataFrame,
    keys: Sequence[str],
    value: str,
    alias: str = "n_distinct",
    salts: int = 64,
    limit: int = HOT_KEYS,
    at_least: int = 1024,
) -> DataFrame:
    """Distinct values per key in two stages, so that a hot key is spread over ``salts`` tasks.

    Heavy keys get a salt, other keys the salt 0; stage one counts distinct values per key and salt,
    stage two adds the partial counts per key. The salt is a pseudo-random function of the value and
    not a fresh random number: equal values of a key then meet in one salt, the partial counts can be
    added, and a task that runs again after a lost executor salts alike.

    Nulls in the value are not counted, as in count(distinct); a key with nulls only gives 0. Nulls in
    a key form a group. Repeated rows count once. Columns: the keys and ``alias``.
    """
    if salts < 1:
        raise ValueError("salts must be at least 1")
    rows = rows.select(*keys, F.col(value).alias("_value"))
    heavy = F.broadcast(heavy_keys(rows, keys, limit, at_least).withColumn("_hot", F.lit(1)).drop("n_rows"))
    flagged = rows.alias("r").join(heavy.alias("h"), _same("r", "h", keys), "left")
    salt = F.when(F.col("h._hot").isNotNull(), F.pmod(F.xxhash64("r._value"), F.lit(salts))).otherwise(0).cast("int")
    salted = flagged.select(*[F.col(f"r.{k}").alias(k) for k in keys], F.col("r._value").alias("_value"), salt.alias("_salt"))
    partial = salted.groupBy(*keys, "_salt").agg(F.count_distinct("_value").alias("_partial"))
    return partial.groupBy(*keys).agg(F.sum("_partial").alias(alias))


def attach_by_key(rows: DataFrame, per_key: DataFrame, keys: Sequence[str], weight: str, limit: int = HOT_KEYS, at_least: int = 1024) -> DataFrame:
    """Inner join of many rows with one row per key, safe when a key holds a large share of the rows.

    ``weight`` is a column of per_key with the number of rows of its key. Keys of at least 1/limit of
    the total weight are at most limit and are broadcast; the others meet in a shuffle join. per_key
    is read twice: it should be a written table, or an aggregate whose shuffle Spark can use again. Null keys
    never match.
    """
    total = per_key.agg(F.sum(weight)).scalar()
    is_hot = F.coalesce((F.col(weight) >= at_least) & (F.col(weight) * limit >= total), F.lit(False))
    hot = per_key.filter(is_hot).withColumn("_is_hot", F.lit(True))
    cold = per_key.filter(~is_hot)
    extra = [c for c in per_key.columns if c not in keys]
    tried = rows.join(F.broadcast(hot), list(keys), "left")
    near = tried.filter(F.col("_is_hot").isNotNull()).drop("_is_hot")
    far = tried.filter(F.col("_is_hot").isNull()).drop("_is_hot", *extra).join(cold, list(keys))
    return near.unionByName(far)


def pairs_within_groups(members: DataFrame, key: str, item: str, size: str, carry: Sequence[str] = (), block: int = 512) -> DataFrame:
    """All pairs of different items that share a key, item_a < item_b.

    A group of n members is split into ceil(n / block) salts: the left side takes one of them, the
    right side is copied to each, so no task gets more than about block members of one group times the
    whole group. ``size`` is a column with the group's number of members. ``carry`` columns come out as
    <name>_a and <name>_b. Null keys make no pair.
    """
    salts = F.greatest(F.ceil(F.col(size) / F.lit(block)), F.lit(1)).cast("int")
    base = members.select(key, item, *carry, salts.alias("_salts"))
    left = base.select(F.col(key), F.pmod(F.xxhash64(item), F.col("_salts")).cast("int").alias("_salt"), *[F.col(c).alias(f"{c}_a") for c in (item, *carry)])
    right = base.select(F.col(key), F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"), *[F.col(c).alias(f"{c}_b") for c in (item, *carry)])
    return left.join(right, [key, "_salt"]).filter(F.col(f"{item}_a") < F.col(f"{item}_b")).drop("_salt")
