"""Scalar functions on hashes, bits, sets and days."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, functions as F

MIN_LONG = -(1 << 63)


def raw_hash_text(title: Column, content: Column) -> Column:
    """F2, of the texts as they came."""
    return F.concat(F.lit("title\x1f"), F.coalesce(title, F.lit("")), F.lit("\x1econtent\x1f"), F.coalesce(content, F.lit("")))


def text_hash(normalized: Column) -> Column:
    """MD5 of a normalised text, null for an empty one."""
    return F.when(normalized != "", F.md5(normalized))


def exact_hash(content_hash: Column, title_hash: Column, scope: str = "content") -> Column:
    """F5."""
    return F.coalesce(content_hash, title_hash) if scope == "content" else title_hash


def stable_document_id(given: Column, source: Column, title: Column, content: Column) -> Column:
    """the given id, else doc_ and an MD5 of source, title and content."""
    parts = [F.coalesce(c, F.lit("")) for c in (source, title, content)]
    return F.coalesce(given, F.concat(F.lit("doc_"), F.md5(F.concat_ws("|", *parts))))


def sample_text(text: Column, length: int = 160) -> Column:
    """F23."""
    return F.substring(text, 1, length)


def hash_hex(value: Column, strict: bool = False) -> Column:
    """32 hex digits in lower case; otherwise null, or an error when strict."""
    other = F.raise_error(F.concat(F.lit("no hash of 32 hex digits: "), value)).cast("string") if strict else F.lit(None).cast("string")
    return F.when(value.isNull(), F.lit(None).cast("string")).when(value.rlike("^[0-9a-fA-F]{32}\\z"), F.lower(value)).otherwise(other)


def valid_band(kind: Column, index: Column, value: Column) -> Column:
    """F25 on stored values: SimHash index 0 to 7 and value 0 to 65535; MinHash index 0 to 31, any 64 bits."""
    sim = (kind == "simhash") & index.between(0, 7) & value.between(0, 65535)
    return F.coalesce(sim | ((kind == "minhash") & index.between(0, 31) & value.isNotNull()), F.lit(False))


def parse_band(kind: Column, index: Column, value: Column) -> Column:
    """F25 on bands as requests write them: the stored value of a band, null where it is not valid.

    SimHash values are 1 to 4 hex digits in any case, MinHash values unsigned decimals of 64 bits.
    """
    sim = F.when(value.rlike("^[0-9a-fA-F]{1,4}\\z"), F.conv(value, 16, 10).cast("long"))
    stored = F.when(kind == "simhash", sim).when(kind == "minhash", from_unsigned(value))
    return F.when(valid_band(kind, index, stored), stored)


def to_unsigned(value: Column) -> Column:
    """decimal digits of the 64 bits read as an unsigned number."""
    return F.conv(F.hex(value), 16, 10)


def from_unsigned(digits: Column) -> Column:
    """signed bit pattern of an unsigned decimal number of at most 64 bits; null beyond."""
    number = digits.cast("decimal(20,0)")
    half, whole = (F.lit(str(v)).cast("decimal(20,0)") for v in (2**63, 2**64))
    fits = digits.rlike("^[0-9]{1,20}$") & (number < whole)
    return F.when(fits, F.when(number < half, number).otherwise(number - whole).cast("long"))


def unsigned_order(value: Column) -> Column:
    """A signed number that sorts as the unsigned 64 bits."""
    return value.bitwiseXOR(F.lit(MIN_LONG))


_LOW = (1 << 32) - 1


def _halves(value: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(value, 32), value.bitwiseAND(F.lit(_LOW))


def _joined(high: Column, low: Column) -> Column:
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(F.lit(_LOW)))


def add_u64(a: Column, b: Column) -> Column:
    """the sum of two 64-bit patterns modulo 2^64, in halves so that nothing overflows."""
    (ah, al), (bh, bl) = _halves(a), _halves(b)
    low = al + bl
    return _joined(ah + bh + F.shiftrightunsigned(low, 32), low)


def multiply_u64(a: Column, b: Column) -> Column:
    """the product of two 64-bit patterns modulo 2^64, from products of 16 by 32 bits."""
    (ah, al), (bh, bl) = _halves(a), _halves(b)
    quarter = F.lit((1 << 16) - 1).cast("long")
    upper = lambda x, y: F.shiftrightunsigned(x, 16) * y
    lower = lambda x, y: x.bitwiseAND(quarter) * y
    low = lambda x, y: (lower(x, y) + F.shiftleft(upper(x, y), 16)).bitwiseAND(F.lit(_LOW))
    middle = F.shiftleft((low(al, bh) + low(ah, bl)).bitwiseAND(F.lit(_LOW)), 32)
    return add_u64(add_u64(lower(al, bl), F.shiftleft(upper(al, bl), 16)), middle)


def rotate_right_u64(a: Column, bits: int) -> Column:
    """rotation of a 64-bit pattern by 0 to 63 bits."""
    if not 0 <= bits <= 63:
        raise ValueError("a rotation is by 0 to 63 bits")
    return F.shiftrightunsigned(a, bits).bitwiseOR(F.shiftleft(a, 64 - bits)) if bits else a


def less_u64(a: Column, b: Column) -> Column:
    """whether the first pattern is the smaller unsigned number."""
    return unsigned_order(a) < unsigned_order(b)


def hamming(a_hi: Column, a_lo: Column, b_hi: Column, b_lo: Column) -> Column:
    """F19."""
    return F.bit_count(a_hi.bitwiseXOR(b_hi)) + F.bit_count(a_lo.bitwiseXOR(b_lo))


def jaccard(a: Column, b: Column) -> Column:
    """F20 of two arrays as sets: both empty 1, one empty 0."""
    left, right = F.array_distinct(a), F.array_distinct(b)
    both = F.size(F.array_intersect(left, right))
    return F.when((F.size(left) == 0) & (F.size(right) == 0), F.lit(1.0)).otherwise(both / (F.size(left) + F.size(right) - both))


def day_bucket(at: Column, timezone: str = "Asia/Shanghai") -> Column:
    """F26 of a UTC time without zone."""
    return F.date_format(F.from_utc_timestamp(at, timezone), "'d'yyyyMMdd")


def query_buckets(at: Column, days: int, timezone: str = "Asia/Shanghai") -> Column:
    """the day of the time and the days - 1 before it, latest first."""
    if days < 1:
        raise ValueError("days must be at least 1")
    day = F.to_date(F.from_utc_timestamp(at, timezone))
    return F.transform(F.sequence(F.lit(0), F.lit(days - 1)), lambda i: F.date_format(F.date_sub(day, i), "'d'yyyyMMdd"))


def bucket_expiry(at: Column, days: int, grace: int, timezone: str = "Asia/Shanghai") -> Column:
    """the midnight after the day, plus the days kept and the grace, as a UTC time; it never slides."""
    day = F.to_date(F.from_utc_timestamp(at, timezone))
    return F.to_utc_timestamp(F.date_add(day, 1 + days + grace).cast("timestamp_ntz"), timezone)


def in_window(at: Column, as_of: Column, days: int, timezone: str = "Asia/Shanghai") -> Column:
    """at lies in the days that end with the day of as_of."""
    end = F.date_add(F.to_date(F.from_utc_timestamp(as_of, timezone)), 1)
    bound = lambda d: F.to_utc_timestamp(d.cast("timestamp_ntz"), timezone)
    return (at >= bound(F.date_sub(end, days))) & (at < bound(end))


def bloom_bits_per_key(error: float) -> float:
    """Bits of a Bloom filter per key."""
    return -math.log(error) / math.log(2) ** 2


def bloom_hashes(error: float) -> int:
    return math.ceil(bloom_bits_per_key(error) * math.log(2))


def bloom_union_error(error: float, bands: int = 32, days: int = 10) -> float:
    """Probability of at least one false answer in bands times days probes."""
    return 1 - (1 - error) ** (bands * days)


_GENERATION, _BUCKET, _NAME = re.compile(r"g[0-9]{6,20}"), re.compile(r"d[0-9]{8}"), re.compile(r"[A-Za-z0-9:_-]+")


def valid_generation(name: str) -> str:
    """F31."""
    if not _GENERATION.fullmatch(name):
        raise ValueError(f"no generation: {name!r}")
    return name


def valid_bucket(name: str) -> str:
    if not _BUCKET.fullmatch(name):
        raise ValueError(f"no day bucket: {name!r}")
    return name


def index_key(prefix: str, generation: str, *parts: str | int) -> str:
    """the name of a part of an index: prefix, generation and further parts, joined by colons.

    A day bucket among the parts (d and digits) must be a valid one.
    """
    prefix = prefix.strip(": ")
    names = [str(p) for p in parts]
    for name in (prefix, *names):
        if not _NAME.fullmatch(name):
            raise ValueError(f"no name for a part of an index: {name!r}")
        if re.fullmatch(r"d[0-9]+", name):
            valid_bucket(name)
    return ":".join([prefix, valid_generation(generation), *names])
