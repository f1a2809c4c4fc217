"""Text rules F1 to F9: normalisation, scope text, low information, n-grams."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Code-point ranges of emoji and enclosed characters that normalisation drops.
EMOJI_RANGES = (
    r"\U0001F600-\U0001F64F\U0001F300-\U0001F5FF\U0001F680-\U0001F6FF\U0001F1E0-\U0001F1FF\U0001F900-\U0001F9FF"
    r"\U0001FA00-\U0001FA6F\U0001FA70-\U0001FAFF\u2600-\u26FF\u2700-\u27BF\u231A-\u231B\u23E9-\u23F3\u23F8-\u23FA"
    r"\u25AA-\u25AB\u25B6-\u25C0\u25FB-\u25FE\u2934-\u2935\u2B05-\u2B07\u2B1B-\u2B1C\u2B50\u2B55\u3030\u303D"
    r"\u3297\u3299\uFE00-\uFE0F\u200D\u20E3\u24C2\u24B6-\u24E9\u2460-\u24FF"
)
# The scripts and marks that normalisation keeps.
KEPT_RANGES = r"\u4E00-\u9FFF\u3000-\u303F\uFF00-\uFFEF"
NGRAM = 5
BRACKET_MAX = 20

_EMOJI = re.compile(f"[{EMOJI_RANGES}]+")
_BRACKET = re.compile(r"\[[^\[\]]{1,%d}\]" % BRACKET_MAX)
_KEPT = re.compile(f"[{KEPT_RANGES}]")
_NOT_KEPT = re.compile(f"[^{KEPT_RANGES}]+")
_SPACE = re.compile(r"\s+")


def normalize(value: str | None) -> str:
    """F1 of one text. Null and empty give ''.

    No decimal digit lies in the kept ranges and NFKC leaves neither white space nor cased letters
    there, so the digit, space and case steps matter only for the fallback.
    """
    if not isinstance(value, str) or not value:
        return ""
    text = value if value.isascii() else unicodedata.normalize("NFKC", value)
    text = text.replace("\u200B", "").replace("\uFEFF", "")
    if _KEPT.search(text):
        kept = _NOT_KEPT.sub("", _BRACKET.sub("", _EMOJI.sub("", text)))
        if kept:
            return kept
    return _SPACE.sub("", text).lower()


@F.pandas_udf(T.StringType())
def normalize_udf(values: pd.Series) -> pd.Series:
    return values.map(normalize, na_action=None)


def normalized(value: Column) -> Column:
    """F1 as a column, in Arrow batches."""
    return normalize_udf(value)


def scope_text(content: Column, title: Column, scope: str = "content") -> Column:
    """F4 on normalised texts: content falls back to the title, the title scope never falls back."""
    title = F.coalesce(title, F.lit(""))
    if scope == "title":
        return title
    return F.coalesce(F.nullif(content, F.lit("")), title)


def low_information(text: Column, min_length: int = 30, min_alnum: int = 10, ratio: float = 0.65) -> Column:
    """F7. Null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    tokens = F.regexp_extract_all(text, F.lit(r"(\[[^\[\]]{1,%d}\])" % BRACKET_MAX), 1)
    chars = F.aggregate(tokens, F.lit(0), lambda a, x: a + F.length(x))
    return (
        (F.length(text) < min_length)
        | ((F.size(tokens) > 0) & (chars / F.greatest(F.length(text), F.lit(1)) >= ratio))
        | (F.regexp_count(text, F.lit(r"[\p{L}\p{N}]")) < min_alnum)
    )


def ngrams(text: Column, n: int = NGRAM) -> Column:
    """F8: overlapping code-point n-grams in order, duplicates kept; '' and null give an empty list.

    The search for the next gram goes on by UTF-16 units, hence the look at low surrogates.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    return (
        F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.array().cast("array<string>"))
        .when(F.length(text) <= n, F.array(text))
        .otherwise(F.regexp_extract_all(text, F.lit(r"(?s)(?![\x{DC00}-\x{DFFF}])(?=(.{%d}))" % n), 1))
    )


def gram_hashes(texts: list[str], n: int = NGRAM) -> list[np.ndarray]:
    """The set of n-grams (F9) of each text as sorted distinct 64-bit hashes; '' gives an empty array.

    The hash mixes all code points of the gram; two different grams agree with probability 2^-64.
    """
    lens = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    pad = np.uint64(0xFFFFFFFF)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    codes = np.concatenate([codes, np.full(n, pad, dtype=np.uint64)])
    total = int(lens.sum())
    mixed = np.zeros(total, dtype=np.uint64)
    for k in range(n):
        mixed ^= codes[k : total + k]
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    out, at = [], 0
    for size in lens.tolist():
        if size > n:
            out.append(np.unique(mixed[at : at + size - n + 1]))
        elif size:
            short = np.full(n, pad, dtype=np.uint64)
            short[:size] = codes[at : at + size]
            h = np.uint64(0)
            with np.errstate(over="ignore"):
                for c in short:
                    h = (h ^ c) * np.uint64(0x9E3779B97F4A7C15)
                    h ^= h >> np.uint64(29)
                h *= np.uint64(0xBF58476D1CE4E5B9)
                h ^= h >> np.uint64(32)
            out.append(np.array([h], dtype=np.uint64))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
        at += size
    return out


def jaccard_texts(a: Column, b: Column, n: int = NGRAM) -> Column:
    """Jaccard similarity of the n-gram sets of two texts, in Arrow batches; null counts as empty.

    Both empty give 1, one empty 0. Sets are sorted 64-bit gram hashes, made once per batch and text.
    """

    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        which, texts = pd.factorize(pd.concat([left, right]).fillna(""), use_na_sentinel=False)
        sets = gram_hashes(texts.tolist(), n)
        score = np.ones(len(left))
        for i, (x, y) in enumerate(zip(which[: len(left)].tolist(), which[len(left) :].tolist())):
            if x != y:
                both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                score[i] = both / (len(sets[x]) + len(sets[y]) - both)
        return pd.Series(score)

    return F.pandas_udf(run, T.DoubleType())(a, b)
