"""Problem 5: duplicates hidden by formatting differences.

The canonical form of a record is the sequence of letters and digits of its title and of its content,
letter case aside. Once- and repeatedly-seen canonical hashes go into partition-merged Bloom filters;
only records whose hash may repeat are shuffled and grouped exactly, all others leave as singletons.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from twinsieve.llm.filters import Layout, RepeatFilter, flag_by_filter
from twinsieve.operators.skew import attach_by_key
from twinsieve.session import ship, written

_REST = regex.compile(r"[^\p{L}\p{N}]+")


def canonical(text: str | None) -> str:
    """Letters and digits of a text in order, case folded; null gives ''."""
    return _REST.sub("", text.casefold()) if text else ""


def parse(payload: str | None) -> tuple[str | None, str | None] | None:
    """Title and content of a payload; None for broken JSON. What is missing or no string is null."""
    try:
        value = json.loads(payload) if payload is not None else None
    except (ValueError, RecursionError):
        return None
    if not isinstance(value, dict):
        return None
    value = value.get("canonical_input")
    if not isinstance(value, dict):
        return None, None
    title, content = value.get("title"), value.get("content")
    return title if isinstance(title, str) else None, content if isinstance(content, str) else None


def canonical_hashes(records: DataFrame, key: str = "record_id", payload: str = "payload") -> DataFrame:
    """key, digest (16 bytes of title and content in canonical form) and h (its first 8 bytes).

    Broken JSON, and records without a letter or digit in both, are left out; so are null keys.
    """
    ship(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, digests, firsts = [], [], []
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = parse(raw)
                if got is None or k is None:
                    continue
                title, content = canonical(got[0]), canonical(got[1])
                if title or content:
                    # The separator is no letter or digit, so title and content cannot run together.
                    d = hashlib.blake2b(f"{title}\x1e{content}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
                    keys.append(k)
                    digests.append(d)
                    firsts.append(int.from_bytes(d[:8], "little", signed=True))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(digests, pa.binary()), pa.array(firsts, pa.int64())], names=[key, "digest", "h"])

    return records.select(F.col(key).cast("long"), payload).mapInArrow(run, f"`{key}` long, digest binary, h long")


def collapse(records: DataFrame, key: str = "record_id", payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(groups, members): one row per article, and every record with its article.

    groups: digest, first (smallest key), copies (number of distinct keys). members: key, first.
    Rows that repeat a key count once. An empty table gives empty results.
    """
    spark = records.sparkSession
    hashed = written(canonical_hashes(records, key, payload), "canonical")
    layout, judged = Layout.of(hashed.count()), None
    for number in range(layout.slices):
        filters = spark.sparkContext.broadcast(RepeatFilter.build(hashed, "h", layout, number))
        part = flag_by_filter(hashed.filter(layout.in_slice(F.col("h"), number)), "h", filters, twice=True)
        if layout.slices > 1:
            part = written(part, "judged-slice")
            filters.destroy()
        judged = part if judged is None else judged.unionByName(part)
    maybe = judged.filter("maybe").select(key, "digest")
    # Partial sums and minima first: a group of a third of all rows is one row per map task.
    grouped = written(maybe.groupBy("digest").agg(F.min(key).alias("first"), F.count_distinct(key).alias("copies"), F.count(F.lit(1)).alias("n_rows")), "groups")
    single = judged.filter("not maybe").select("digest", F.col(key).alias("first"), F.lit(1).cast("long").alias("copies"), key)
    groups = grouped.select("digest", "first", "copies").unionByName(single.select("digest", "first", "copies"))
    members = attach_by_key(maybe, grouped, ["digest"], "n_rows").select(key, "first").distinct()
    return groups, members.unionByName(single.select(key, "first"))


def copies(records: DataFrame, key: str = "record_id", payload: str = "payload") -> DataFrame:
    """first_<key>, copy_<key>: the smallest key of each group of copies with every other one."""
    _, members = collapse(records, key, payload)
    return members.filter(F.col(key) != F.col("first")).select(F.col("first").alias(f"first_{key}"), F.col(key).alias(f"copy_{key}"))
