"""The functions of the engine for SQL text (the counterpart of native extension functions)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession, functions as F, types as T

from twinsieve.functions import hashing, text
from twinsieve.session import ship

MASK = (1 << 64) - 1
BANDS = "kind string, band_index int, band_value bigint"


def _texts(values: pd.Series) -> list[str]:
    return [t if isinstance(t, str) else "" for t in values]


@F.pandas_udf(hashing.FINGERPRINT)
def _fingerprint(texts: pd.Series) -> pd.DataFrame:
    halves, signatures = hashing.fingerprints_of(_texts(texts))
    return pd.DataFrame({"simhash_hi": halves[:, 0], "simhash_lo": halves[:, 1], "minhash": list(signatures.view("int64"))})


@F.pandas_udf(T.StringType())
def _simhash(texts: pd.Series) -> pd.Series:
    halves, _ = hashing.fingerprints_of(_texts(texts), perms=1)
    return pd.Series([f"{int(h) & MASK:016x}{int(lo) & MASK:016x}" for h, lo in halves], dtype="object")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _minhash(texts: pd.Series) -> pd.Series:
    return pd.Series([[str(v) for v in row.tolist()] for row in hashing.fingerprints_of(_texts(texts))[1]], dtype="object")


def _score(x: set[str], y: set[str]) -> float:
    both = len(x & y)
    return both / (len(x) + len(y) - both) if x or y else 1.0


def _grams(text: object) -> set[str]:
    """Set of grams; a text that is no valid Unicode has none."""
    if not isinstance(text, str):
        return set()
    try:
        text.encode()
    except UnicodeEncodeError:
        return set()
    return set(hashing.gram_list(text))


@F.pandas_udf(T.DoubleType())
def _jaccard(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([_score(_grams(x), _grams(y)) for x, y in zip(left, right)], dtype="float64")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _jaccard_many(left: pd.Series, rights: pd.Series) -> pd.Series:
    """One text against several; the set of the left text is made once a row."""
    out = []
    for text, others in zip(left, rights):
        own = _grams(text)
        out.append(None if others is None else [_score(own, _grams(x)) for x in others])
    return pd.Series(out, dtype="object")


@F.udtf(returnType=BANDS)
class _Bands:
    def eval(self, normalized: str) -> Iterator[tuple]:
        hi, lo, signature = hashing.fingerprint_of(normalized or "")
        whole = (hi & (1 << 64) - 1) << 64 | lo & (1 << 64) - 1
        for i in range(8):
            yield "simhash", i, whole >> 16 * i & 65535
        for i in range(32):
            yield "minhash", i, int(signature[i].view("int64"))


def register(spark: SparkSession) -> list[str]:
    """Registers the functions; null texts count as empty, but normalised and hashed nulls: see each.

    dedupe_normalize, dedupe_blake2b8, dedupe_blake2b16 (null for null), dedupe_fingerprint,
    dedupe_simhash (32 hex digits), dedupe_minhash (128 unsigned decimals), dedupe_uint64_decimals
    (array of BIGINT as unsigned decimals), dedupe_jaccard, dedupe_jaccard_many (one text, array of texts),
    and the table function dedupe_bands(normalised text). All but the hashes take normalised texts.
    """
    ship(spark)
    named = {
        "dedupe_normalize": text.normalize_udf, "dedupe_blake2b8": hashing.blake2b_hex8, "dedupe_blake2b16": hashing.blake2b_hex16, "dedupe_fingerprint": _fingerprint, "dedupe_simhash": _simhash,
        "dedupe_minhash": _minhash, "dedupe_jaccard": _jaccard, "dedupe_jaccard_many": _jaccard_many,
    }
    for name, f in named.items():
        spark.udf.register(name, f)
    spark.udtf.register("dedupe_bands", _Bands)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION dedupe_uint64_decimals(numbers ARRAY<BIGINT>) RETURNS ARRAY<STRING> RETURN transform(numbers, v -> conv(hex(v), 16, 10))")
    return [*named, "dedupe_uint64_decimals", "dedupe_bands"]
