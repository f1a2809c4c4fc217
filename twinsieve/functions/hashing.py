"""BLAKE2b and MD5 hash families, SimHash and MinHash (F10 to F16) in Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from twinsieve.functions.text import NGRAM

MEMO_LIMIT = 500_000
BLOCK = 4096
_MEMO: dict[str, dict[str, tuple[bytes, int]]] = {"blake2b": {}, "md5": {}}


def blake2b(text: str, size: int) -> bytes:
    """Unkeyed BLAKE2b with a digest of so many bytes; a shorter digest is no prefix of a longer one."""
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=size).digest()


def gram_list(text: str, n: int = NGRAM) -> list[str]:
    """F8 in Python."""
    if not text:
        return []
    return [text] if len(text) <= n else [text[i : i + n] for i in range(len(text) - n + 1)]


def _digest(gram: str, family: str) -> tuple[bytes, int]:
    """16 bytes for SimHash and a 64-bit number for MinHash."""
    if family == "blake2b":
        return blake2b(gram, 16), int.from_bytes(blake2b(gram, 8), "big")
    whole = hashlib.md5(gram.encode("utf-8", "surrogatepass")).digest()
    return whole, int.from_bytes(whole[:8], "big")


def _digests(grams: list[str], family: str) -> tuple[np.ndarray, np.ndarray]:
    """Digests of grams as rows of 16 bytes and as numbers; those of the last MEMO_LIMIT grams are kept."""
    memo = _MEMO.get(family)
    if memo is None:
        raise ValueError(f"unknown hash family {family}")
    if len(memo) > MEMO_LIMIT:
        memo.clear()
    long, short = bytearray(), []
    for gram in grams:
        got = memo.get(gram)
        if got is None:
            got = memo[gram] = _digest(gram, family)
        long += got[0]
        short.append(got[1])
    return np.frombuffer(bytes(long), dtype=np.uint8).reshape(-1, 16), np.array(short, dtype=np.uint64)


@lru_cache(maxsize=4)
def permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and offsets of the permutations h * a + b modulo 2^64."""
    number = lambda name: int.from_bytes(blake2b(name, 8), "big")
    a = np.array([number(f"minhash-perm-{i}") | 1 for i in range(count)], dtype=np.uint64)
    b = np.array([number(f"minhash-offset-{i}") for i in range(count)], dtype=np.uint64)
    return a, b


def _gram_blocks(texts: list[str], n: int) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """Grams of the texts in blocks of bounded size: (grams, where a text begins in the block, which text).

    A long text goes on over several blocks, short ones share a block; no list of all grams is made.
    """
    grams: list[str] = []
    starts: list[int] = []
    owners: list[int] = []
    for owner, text in enumerate(texts):
        count = max(1, len(text) - n + 1) if text else 0
        at = 0
        while at < count:
            take = min(count - at, BLOCK - len(grams))
            starts.append(len(grams))
            owners.append(owner)
            grams.extend(text[i : i + n] for i in range(at, at + take))
            at += take
            if len(grams) == BLOCK:
                yield grams, np.array(starts), np.array(owners)
                grams, starts, owners = [], [], []
    if grams:
        yield grams, np.array(starts), np.array(owners)


def fingerprints_of(texts: list[str], n: int = NGRAM, perms: int = 128, family: str = "blake2b") -> tuple[np.ndarray, np.ndarray]:
    """SimHashes as signed (hi, lo) and MinHash signatures of normalised texts, a row each.

    SimHash counts repeated grams, a tie of a bit gives 1, an empty text 0. MinHash takes the unsigned
    minimum over the set of grams, an empty text gives the largest value everywhere. Votes and minima are
    added up block by block, so memory does not depend on the length of a text.
    """
    votes = np.zeros((len(texts), 128), dtype=np.int64)
    signatures = np.full((len(texts), perms), 2**64 - 1, dtype=np.uint64)
    factor, offset = permutations(perms)
    for grams, starts, owners in _gram_blocks(texts, n):
        long, short = _digests(grams, family)
        votes[owners] += np.add.reduceat(np.unpackbits(long, axis=1), starts, axis=0, dtype=np.int64)
        permuted = np.multiply.outer(short, factor)
        permuted += offset
        signatures[owners] = np.minimum(signatures[owners], np.minimum.reduceat(permuted, starts, axis=0))
    totals = np.array([max(1, len(t) - n + 1) if t else 0 for t in texts], dtype=np.int64)[:, None]
    set_bits = (votes + votes >= totals) & (totals > 0)
    return np.packbits(set_bits, axis=1).view(">i8").astype(np.int64), signatures


def fingerprint_of(text: str, n: int = NGRAM, perms: int = 128, family: str = "blake2b") -> tuple[int, int, np.ndarray]:
    """fingerprints_of() one text: (hi, lo, signature)."""
    halves, signatures = fingerprints_of([text], n, perms, family)
    return int(halves[0, 0]), int(halves[0, 1]), signatures[0]


FINGERPRINT = T.StructType([T.StructField("simhash_hi", T.LongType()), T.StructField("simhash_lo", T.LongType()), T.StructField("minhash", T.ArrayType(T.LongType()))])


def fingerprint(text: Column, n: int = NGRAM, perms: int = 128, family: str = "blake2b") -> Column:
    """Q1: one pass over a normalised text gives STRUCT<simhash_hi, simhash_lo, minhash>. Null counts as empty."""

    def run(texts: pd.Series) -> pd.DataFrame:
        halves, signatures = fingerprints_of([t if isinstance(t, str) else "" for t in texts], n, perms, family)
        return pd.DataFrame({"simhash_hi": halves[:, 0], "simhash_lo": halves[:, 1], "minhash": list(signatures.view(np.int64))})

    return F.pandas_udf(run, FINGERPRINT)(text)


def simhash_hex(hi: Column, lo: Column) -> Column:
    """32 lower-case hex digits."""
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def simhash_bands(hi: Column, lo: Column) -> Column:
    """8 bands of 16 bits, band 0 the lowest."""
    part = lambda i: F.shiftrightunsigned(lo if i < 4 else hi, 16 * (i % 4)).bitwiseAND(F.lit(65535).cast("long"))
    return F.array(*[F.struct(F.lit(i).alias("band_index"), part(i).alias("band_value")) for i in range(8)])


def minhash_bands(signature: Column, bands: int = 32) -> Column:
    """F16: the first values of the signature, one row a band. A shorter signature is an error."""
    checked = F.when(F.size(signature) >= bands, signature).otherwise(F.raise_error(F.lit("the signature is too short")).cast("array<bigint>"))
    return F.transform(F.slice(checked, 1, bands), lambda v, i: F.struct(i.cast("int").alias("band_index"), v.alias("band_value")))


@F.pandas_udf(T.StringType())
def blake2b_hex8(texts: pd.Series) -> pd.Series:
    """BLAKE2b with 8 bytes as hex."""
    return texts.map(lambda t: blake2b(t, 8).hex() if isinstance(t, str) else None)


@F.pandas_udf(T.StringType())
def blake2b_hex16(texts: pd.Series) -> pd.Series:
    """BLAKE2b with 16 bytes as hex."""
    return texts.map(lambda t: blake2b(t, 16).hex() if isinstance(t, str) else None)
