"""Ordered first-wins decisions: a row is accepted if nothing accepted before it stands against it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from twinsieve.session import counted, ship, written

AT_ONCE = 1 << 20
ROUNDS = 8


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walks the rows of one closed set of nodes in order of rank; gives the ids that are accepted, and refused.

    rows: id, rank, kind, other. kind 0 is the node itself, 1 a smaller node it is linked to, 2 a value it asks for,
    3 one it holds.
    """
    got = list(batches)
    rows = pa.Table.from_batches(got).select(_STEPS.names).cast(_STEPS) if got else _STEPS.empty_table()
    rows = rows.sort_by([("rank", "ascending"), ("kind", "ascending")])
    accepted: set[int] = set()
    lost: list[int] = []
    taken: set[int] = set()
    at: int | None = None
    refused, holds = False, []

    def close() -> None:
        if at is None:
            return
        if refused:
            lost.append(at)
        else:
            accepted.add(at)
            taken.update(holds)

    for node, kind, other in zip(*(rows.column(c).to_pylist() for c in ("id", "kind", "other"))):
        if node != at:
            close()
            at, refused, holds = node, False, []
        if kind == 1:
            refused = refused or other in accepted
        elif kind == 2:
            refused = refused or other in taken
        elif kind == 3:
            holds.append(other)
    close()
    ids = pa.array([*sorted(accepted), *lost], pa.int64())
    yield pa.RecordBatch.from_arrays([ids, pa.array([True] * len(accepted) + [False] * len(lost))], names=["id", "won"])


_STEPS = pa.schema([("id", pa.int64()), ("rank", pa.int64()), ("kind", pa.int32()), ("other", pa.int64())])


def first_wins(nodes: DataFrame, links: DataFrame, asks: DataFrame | None = None, holds: DataFrame | None = None, at_once: int = AT_ONCE) -> DataFrame:
    """The rows of nodes (id, rank; both distinct numbers, ids not negative) that are accepted in order of rank.

    A node is refused if an accepted node of smaller rank is linked to it, or holds a value it asks for.
    links: a, b in any order; ends that are no nodes play no role. asks, holds: id, value. Values that one
    node only has to do with are dropped at once, and nodes that nothing stands against are accepted.

    What is left, if it is at most ``at_once`` rows, is walked through by one task in order of rank.
    Beyond that it is settled in rounds: all open nodes are accepted that no open node of smaller rank
    stands against, and what they stand against is refused. After ROUNDS of them the open nodes are
    cut into connected components, each walked through by a task of its own, so a chain of edited
    versions takes one walk instead of a round a link; only components above at_once need more rounds.
    """
    spark = nodes.sparkSession
    ship(spark)
    ranks = nodes.select(F.col("id").cast("long").alias("id"), F.col("rank").cast("long").alias("rank"))
    ra, rb = ranks.select(F.col("id").alias("a"), F.col("rank").alias("ra")), ranks.select(F.col("id").alias("b"), F.col("rank").alias("rb"))
    ends = links.select("a", "b").join(ra, "a").join(rb, "b").filter("ra <> rb")
    late, early, rank = (F.when(F.col("ra") < F.col("rb"), F.col(x)).otherwise(F.col(y)) for x, y in (("b", "a"), ("a", "b"), ("rb", "ra")))
    steps = ends.select(late.alias("id"), rank.alias("rank"), F.lit(1).alias("kind"), early.alias("other")).distinct()
    if asks is not None and holds is not None:
        hashed = lambda rows, kind: rows.filter("value is not null").select(F.col("id").cast("long").alias("id"), F.lit(kind).alias("kind"), F.xxhash64("value").alias("other"), "value").distinct()
        both = hashed(asks, 2).unionByName(hashed(holds, 3)).join(ranks, "id")
        per_value = both.groupBy("value").agg(F.min("id").alias("_one"), F.max("id").alias("_two"), F.count_if(F.col("kind") == 2).alias("_asks"), F.count_if(F.col("kind") == 3).alias("_holds"))
        shared = per_value.filter("_one <> _two and _asks > 0 and _holds > 0").select("value", F.xxhash64("value").alias("other"))
        # Two values of one 64-bit hash would be taken for one; the smaller value then stands for its own hash plus one.
        shared = shared.groupBy("other").agg(F.sort_array(F.collect_set("value")).alias("values")).select(F.posexplode("values").alias("_n", "value"), "other").select("value", (F.col("other") + F.col("_n")).alias("other"))
        steps = steps.unionByName(both.drop("other").join(shared, "value").select("id", "rank", "kind", "other"))
    steps, size = counted(steps, "first-wins-steps")
    if size == 0:
        return ranks
    bound = steps.select("id", "rank").unionByName(steps.filter("kind = 1").select(F.col("other").alias("id")).join(ranks, "id")).distinct()
    if size <= at_once:
        walk = written(steps.unionByName(_itself(bound)).coalesce(1).mapInArrow(_decide, "id long, won boolean"), "walk")
        return ranks.join(walk.filter("not won").select("id"), "id", "left_anti")
    bound = written(bound, "first-wins-open")
    accepted, number = ranks.join(bound.select("id"), "id", "left_anti"), 0
    while size > at_once:
        if number and number % ROUNDS == 0:
            steps, bound, won = _by_component(steps, bound, at_once)
        else:
            steps, bound, won = _round(steps, bound)
        accepted, number, size = accepted.unionByName(ranks.join(won, "id", "left_semi")), number + 1, steps.count()
    walk = written(steps.unionByName(_itself(bound)).coalesce(1).mapInArrow(_decide, "id long, won boolean"), "walk")
    return accepted.unionByName(ranks.join(walk.filter("won").select("id"), "id", "left_semi"))


def first_wins_of_few(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """first_wins() by links only, in one task: for nodes and links that the caller knows to be at most AT_ONCE."""
    ship(nodes.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks: dict[int, int] = {}
        near: dict[int, list[int]] = {}
        for batch in batches:
            for a, b, rank in zip(*(c.to_pylist() for c in batch.columns)):
                if rank is not None:
                    ranks[a] = rank
                else:
                    near.setdefault(a, []).append(b)
                    near.setdefault(b, []).append(a)
        won: dict[int, int] = {}
        for node in sorted(ranks, key=ranks.__getitem__):
            if not any(other in won for other in near.get(node, ())):
                won[node] = ranks[node]
        yield pa.RecordBatch.from_arrays([pa.array(won.keys(), pa.int64()), pa.array(won.values(), pa.int64())], names=["id", "rank"])

    none = F.lit(None).cast("long")
    rows = nodes.select(F.col("id").alias("a"), none.alias("b"), "rank").unionByName(links.select("a", "b", none.alias("rank")))
    return rows.coalesce(1).mapInArrow(run, "id long, rank long")


def _itself(rows: DataFrame) -> DataFrame:
    return rows.select("id", "rank", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("other"))


def _without(steps: DataFrame, bound: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Open steps and nodes without those that are settled."""
    left = steps.join(gone, "id", "left_anti")
    links = left.filter("kind = 1").join(gone.select(F.col("id").alias("other")), "other", "left_anti").select(steps.columns)
    return written(links.unionByName(left.filter("kind <> 1")), "first-wins-steps"), written(bound.join(gone, "id", "left_anti"), "first-wins-open")


def _round(steps: DataFrame, bound: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Accepts the open nodes that nothing open of smaller rank stands against, and settles what they refuse.

    Values are reduced to the smallest open rank per value by partial minima, so a value of many nodes is
    no burden and makes no pairs.
    """
    asks, holds = steps.filter("kind = 2"), steps.filter("kind = 3")
    least = holds.groupBy("other").agg(F.min("rank").alias("_least"))
    blocked = steps.filter("kind = 1").select("id").unionByName(asks.join(least, "other").filter("_least < rank").select("id"))
    won = written(bound.join(blocked.distinct(), "id", "left_anti").select("id"), "won")
    lost = steps.filter("kind = 1").join(won.select(F.col("id").alias("other")), "other", "left_semi").select("id")
    taken = holds.join(won, "id", "left_semi").groupBy("other").agg(F.min("rank").alias("_least"))
    lost = lost.unionByName(asks.join(taken, "other").filter("_least < rank").select("id"))
    gone = written(lost.unionByName(won).distinct(), "settled")
    return *_without(steps, bound, gone), won


def _by_component(steps: DataFrame, bound: DataFrame, at_once: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Walks through the connected components of at most at_once rows, one task each; larger ones stay open."""
    # A value is a node of its own below all ids: it connects those that ask for it or hold it.
    keys = steps.filter("kind <> 1").select("other").distinct()
    keys = written(keys.select("other", (-F.monotonically_increasing_id() - 2).alias("_key")), "value-keys")
    links = steps.filter("kind = 1").select(F.col("id").alias("a"), F.col("other").alias("b"))
    links = links.unionByName(steps.filter("kind <> 1").join(keys, "other").select(F.col("id").alias("a"), F.col("_key").alias("b")))
    labels = components(links)
    rows = steps.unionByName(_itself(bound)).join(labels, "id", "left").withColumn("group", F.coalesce("group", "id"))
    rows = written(rows, "component-steps")
    small = rows.groupBy("group").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") <= at_once).select("group")
    chosen = rows.join(small, "group", "left_semi")
    run = lambda table: pa.Table.from_batches(_decide(iter(table.select(_STEPS.names).cast(_STEPS).to_batches())))
    won = written(chosen.select("group", *_STEPS.names).groupBy("group").applyInArrow(run, "id long, won boolean").filter("won").select("id"), "won")
    gone = written(chosen.select("id").distinct(), "settled")
    return *_without(steps, bound, gone), won


def components(links: DataFrame) -> DataFrame:
    """id, group: the smallest id that each linked id is connected with.

    In each round every id takes the smallest group of its neighbours and then that of its group, so
    the rounds grow as the logarithm of the longest path. Each round is written to the shared folder.
    """
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("group")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "group"), "b").groupBy(F.col("a").alias("id")).agg(F.min("group").alias("_near"))
        taken = labels.join(near, "id").select("id", F.col("group").alias("_old"), F.least("group", "_near").alias("group"))
        jump = labels.select(F.col("id").alias("group"), F.col("group").alias("_far"))
        new = written(taken.join(jump, "group", "left").select("id", "_old", F.least("group", F.coalesce("_far", "group")).alias("group")), "labels")
        labels = new.select("id", "group")
        if new.filter(F.col("_old") != F.col("group")).isEmpty():
            return labels
