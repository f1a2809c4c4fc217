"""Problem 4: near-duplicate records with small edits.

An exact join of all pairs of texts whose n-gram sets have a Jaccard similarity of at least a
threshold. Grams are ordered rare first, and texts meet on the grams of their prefixes, once shuffled.
Two sets that share o grams share the first k of those in their first n - o + k grams, whatever k is:
at least o - k shared grams lie behind it. So each meeting passes

- the length filter: the smaller set is at least threshold times the larger,
- the positional filter: the gram lies in the first n - o + k grams of both, where o is the overlap
  that the two lengths need,

and each pair then the suffix filter: with fewer than k meetings in those prefixes the suffixes behind
them cannot make up the overlap. k = 1 is the plain prefix filter; HITS = 8 costs 9 % more prefix grams
and leaves a hundredth of its candidates. Each pair that is left is verified once, on the texts. No
filter loses a pair. Equal texts are joined as one class before. Grams that provably one text only
holds are not sent. The order comes from a sketch of bounded size: the fuller it is, the less it tells
rare grams apart, which costs candidates but no pair. How many prefixes hold a gram is counted exactly
where the sketch allows more than BLOCK; a gram that more of them hold is cut into blocks of bounded
size, and each pair of blocks is a group of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from twinsieve.functions.text import NGRAM, gram_hashes
from twinsieve.llm.filters import FrequencySketch
from twinsieve.operators.greedy import components
from twinsieve.operators.skew import attach_by_key, pairs_within_groups
from twinsieve.session import distinct_by, ship, written

THRESHOLD = 0.5
SKETCH_BITS = 25
BLOCK = 8192
HITS = 8
PAIRS_AT_ONCE = 1 << 22


def needed_overlap(a, b, threshold: float):
    """Grams that sets of a and b grams must share for the threshold."""
    return np.ceil(threshold / (1 + threshold) * (a + b) - 1e-9)


def prefix_rows(grams: np.ndarray, counts: np.ndarray, threshold: float, hits: int) -> tuple[np.ndarray, np.ndarray]:
    """(grams, positions) of the longest prefix that any partner asks for, rare grams first."""
    order = np.argsort(counts, kind="stable")  # grams are sorted, so ties go by hash
    last = len(grams) - math.ceil(threshold * len(grams) - 1e-9) + hits
    return grams[order[:last]], np.arange(min(last, len(grams)))


def _postings(texts: DataFrame, sketch: Broadcast, threshold: float, n: int, hits: int) -> DataFrame:
    """Prefix grams of all texts (columns id, text) that may meet others: gram, id, at, hot.

    at: the size of the set in the upper, the position of the gram in the lower 32 bits. hot: more than BLOCK
    texts may hold the gram.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: FrequencySketch = sketch.value
        limit = table.may_exceed(BLOCK)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            sets = gram_hashes(batch.column(1).to_pylist(), n)
            if not any(map(len, sets)):
                continue
            counts = np.split(table.of(np.concatenate(sets)), np.cumsum([len(s) for s in sets])[:-1])
            columns: list[list[np.ndarray]] = [[] for _ in range(4)]
            for i, g, c in zip(ids, sets, counts):
                if not len(g):
                    continue
                grams, pos = prefix_rows(g, c, threshold, hits)
                held = table.of(grams)
                keep = held > 1  # a count of 1: no other text holds the gram
                for column, v in zip(columns, (grams[keep].view(np.int64), np.full(int(keep.sum()), i), pos[keep] + (len(g) << 32), held[keep] >= limit)):
                    column.append(v)
            if columns[0]:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), type=k) for c, k in zip(columns, kinds)], names=["gram", "id", "at", "hot"])

    return texts.select("id", "text").mapInArrow(run, "gram long, id long, at long, hot boolean")


def spread_hot(postings: DataFrame, block: int) -> DataFrame:
    """gram, id, at of all postings, with grams of more than ``block`` postings once per pair of blocks.

    Only postings flagged hot are counted, exactly and with partial sums. A gram with c of them gets
    ceil(c / block) blocks; a posting goes to every pair of blocks with its own, under a gram of its own.
    Texts of one block meet in several pairs of blocks, which can only count their hits too high.
    """
    columns = ["gram", "id", "at"]
    big = postings.filter("hot").groupBy("gram").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > block)
    big = written(big.select("gram", F.ceil(F.col("_n") / block).cast("int").alias("_m")), "hot-grams")
    if big.isEmpty():
        return postings.select(columns)
    met = postings.filter("hot").join(big, "gram", "left")
    own = F.pmod(F.xxhash64("id"), "_m").cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("_m") - 1), lambda o: o != F.col("_own"))
    pairs = met.filter("_m is not null").withColumn("_own", own).select("*", F.explode(others).alias("_other"))
    pair = F.xxhash64("gram", F.least("_own", "_other"), F.greatest("_own", "_other"))
    cold = postings.filter("not hot").select(columns).unionByName(met.filter("_m is null").select(columns))
    return cold.unionByName(pairs.select(pair.alias("gram"), "id", "at"))


def _counted(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs with the sum of their weights."""
    order = np.lexsort((b, a))
    a, b, weight = a[order], b[order], weight[order]
    fresh = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return a[fresh], b[fresh], np.add.reduceat(weight, fresh)


def candidates(postings: DataFrame, threshold: float, parts: int | None, hits: int) -> DataFrame:
    """Pairs (a < b) that pass all filters; groups of a gram are streamed in sorted order.

    parts is None where the postings lie by gram already.
    """
    names = ["a", "b", "weight"]

    def close(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(parts).combine_chunks()
        gram, ids, at = (whole.column(c).to_numpy() for c in ("gram", "id", "at"))
        n, pos = at >> 32, at & 0xFFFFFFFF
        fresh = np.ones(len(whole), dtype=bool)
        fresh[1:] = gram[1:] != gram[:-1]
        start = np.append(np.flatnonzero(fresh), len(whole))
        end = np.repeat(start[1:], np.diff(start))
        found: list[tuple[np.ndarray, ...]] = []
        live, step = np.flatnonzero(end > np.arange(len(end)) + 1), 1
        while len(live):
            # Rows of a group are sorted by n, so once the length filter fails for a row it stays so.
            live = live[n[live] >= threshold * n[live + step] - 1e-9]
            one, two = n[live], n[live + step]
            need = needed_overlap(one, two, threshold)
            k = np.minimum(hits, need)
            ok = (pos[live] < one - need + k) & (pos[live + step] < two - need + k)
            a, b, k = ids[live[ok]], ids[live[ok] + step], k[ok]
            if len(a):
                # Where small sets need fewer hits, each counts for more, so that hits is the mark for all.
                found.append((np.minimum(a, b), np.maximum(a, b), np.ceil(hits / k).astype(np.int64)))
            if sum(len(x[0]) for x in found[-64:]) > PAIRS_AT_ONCE:
                yield from send(found)
                found = []
            step += 1
            live = live[live + step < end[live]]
        if found:
            yield from send(found)

    def send(found: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        a, b, weight = _counted(*(np.concatenate(c) for c in zip(*found)))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(weight, pa.int64())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            gram = batch.column(0).to_numpy()
            goes_on = bool(held) and held[0].column(0)[-1].as_py() == gram[0]
            other = np.flatnonzero(gram != gram[-1])
            cut = int(other[-1]) + 1 if len(other) else 0  # the last group may go on in the next batch
            if goes_on and cut == 0:
                held.append(batch)
                continue
            lead = int(np.flatnonzero(gram != gram[0])[0]) if goes_on else 0
            if lead:
                held.append(batch.slice(0, lead))
            if held:
                yield from close(held)
            if cut > lead:
                yield from close([batch.slice(lead, cut - lead)])
            held = [batch.slice(cut)]
        if held:
            yield from close(held)

    placed = (postings.repartition(parts, "gram") if parts else postings).sortWithinPartitions("gram", "at", "id")
    met = placed.mapInArrow(run, "a long, b long, weight long").filter("a <> b")
    return met.groupBy("a", "b").agg(F.sum("weight").alias("weight")).filter(F.col("weight") >= hits).select("a", "b")


def jaccard_rows(pairs: DataFrame, threshold: float, n: int = NGRAM) -> DataFrame:
    """pairs: a, b, text_a, text_b. Keeps a, b and the exact ``jaccard`` where it reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = gram_hashes(batch.column(2).to_pylist(), n), gram_hashes(batch.column(3).to_pylist(), n)
            score = np.zeros(len(left))
            for i, (x, y) in enumerate(zip(left, right)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                either = len(x) + len(y) - both
                score[i] = both / either if either else 1.0
            ok = np.flatnonzero(score >= threshold - 1e-12)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ok)), batch.column(1).take(pa.array(ok)), pa.array(score[ok])], names=["a", "b", "jaccard"])

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, jaccard double")


def with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) with text_a and text_b from texts (id, text)."""
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")


def similar_texts(texts: DataFrame, threshold: float = THRESHOLD, n: int = NGRAM, sketch_bits: int = SKETCH_BITS, hits: int = HITS) -> DataFrame:
    """All pairs a < b of rows with Jaccard >= threshold, with ``jaccard``.

    texts: id (distinct), text (distinct, not empty); it is read four or five times, so it should be written.
    Empty and null texts pair with nothing. The sketch has at most 2^sketch_bits counters of a byte.
    """
    spark = texts.sparkSession
    ship(spark)
    texts = texts.select(F.col("id").cast("long").alias("id"), "text").filter("text <> ''")
    size = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = min(sketch_bits, max(12, int(size * 2).bit_length()))
    sketch = FrequencySketch.build(texts.select("text"), lambda v: np.concatenate([*gram_hashes(v, n), np.zeros(0, np.uint64)]), bits)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _postings(texts, spark.sparkContext.broadcast(sketch), threshold, n, hits)
    rows = spread_hot(rows, BLOCK) if int(sketch.counts.max()) >= sketch.may_exceed(BLOCK) else rows.select("gram", "id", "at")
    return jaccard_rows(with_texts(candidates(rows, threshold, parts, hits), texts), threshold, n)


def near_duplicates(records: DataFrame, key: str, text: str, threshold: float = THRESHOLD, n: int = NGRAM) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links, members, classes) of records by the similarity of their texts.

    The texts of a key are equal, or any one of them will do.
    links: a < b of classes of equal texts, jaccard; members: key, id, n_members; classes: id, n_members.
    """
    rows = records.select(F.col(key).cast("long").alias(key), F.col(text).alias("text")).filter(F.col(key).isNotNull() & (F.col("text") != ""))
    rows = written(distinct_by(rows, key), "texts")
    digest = rows.select(key, F.unhex(F.md5("text")).alias("_digest"))
    classes = written(digest.groupBy("_digest").agg(F.min(key).alias("id"), F.count(F.lit(1)).alias("n_members")), "classes")
    # Each class keeps the text of its first member; the join is on the key, so no class is hot in it.
    texts = written(rows.join(classes.select(F.col("id").alias(key)), key, "left_semi").select(F.col(key).alias("id"), "text"), "class-texts")
    members = attach_by_key(digest, classes, ["_digest"], "n_members").select(key, "id", "n_members")
    return similar_texts(texts, threshold, n), members, classes.select("id", "n_members")


def expand_links(links: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """<key>_a < <key>_b: all pairs of records of linked or equal classes, once each."""
    left = members.select(F.col("id").alias("a"), F.col(key).alias("_x"))
    right = members.select(F.col("id").alias("b"), F.col(key).alias("_y"))
    across = links.join(left, "a").join(right, "b").select(F.least("_x", "_y").alias(f"{key}_a"), F.greatest("_x", "_y").alias(f"{key}_b"))
    within = pairs_within_groups(members.filter("n_members > 1"), "id", key, "n_members").select(f"{key}_a", f"{key}_b")
    return across.unionByName(within)


def grouped(links: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """One row per record with text: key, class_id (equal texts), group_id (connected texts), n_links.

    n_links is the number of other texts that reach the threshold; copies of the own text do not count.
    """
    ends = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id")))
    per_class = ends.groupBy("id").agg(F.count(F.lit(1)).alias("n_links")).join(components(links), "id")
    out = members.join(per_class, "id", "left")
    return out.select(key, F.col("id").alias("class_id"), F.coalesce("group", "id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
