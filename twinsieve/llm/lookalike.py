"""Problem 2: one form for texts that look alike but differ in their characters.

Compatibility forms and composition are settled first, invisible characters go and every kind of space
becomes a space. Then each token's letters are looked at: for every letter the set of scripts in which
a letter of the same shape exists is known, and the sets are intersected over the token. A script that
is left can spell the whole token: Latin if it is among them, else the first of the others. If none is
left, the token mixes scripts and every letter that has a Latin shape is read as Latin. The set of a
letter depends on its shape alone, so tokens of the same look always get the same spelling.

Which letters share a shape is taken from the public Unicode table of confusable characters, as far as it
maps a letter of another alphabet to one Latin letter; the JVM of the session has it. The fixed values
below go before it, and stand alone where it is missing.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from twinsieve.operators.skew import attach_by_key, pairs_within_groups
from twinsieve.session import ship, written

# Letters of other alphabets and, position by position, the Latin letters of their shape.
CYRILLIC = "АВСЕНІӀЈКМОРԚЅТԜХУҮаԁеһіјӏорԛѕѵԝхусү"
CYRILLIC_AS = "ABCEHIIJKMOPQSTWXYYadehijlopqsvwxycy"
GREEK = "ΑΒϹΕΗΙͿΚΜΝΟΡΤΧΥΖαϲιϳνορυ"
GREEK_AS = "ABCEHIJKMNOPTXYZacijvopu"
ARMENIAN = "ՕՏՍհոօզցսյ"
ARMENIAN_AS = "OSUhnoqguj"
PHONETIC = "ɑɡɩ"
PHONETIC_AS = "agi"
# Fixed value: code points that show nothing (default ignorables and controls other than white space).
INVISIBLE = (
    r"\u0000-\u0008\u000E-\u001B\u007F-\u0084\u0086-\u009F­͏؜ᅟᅠ឴឵᠋-᠏"
    r"​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ￰-￻"
    r"\U0001BCA0-\U0001BCA3\U0001D173-\U0001D17A\U000E0000-\U000E0FFF"
)

FIXED = {c: shape for own, shapes in ((CYRILLIC, CYRILLIC_AS), (GREEK, GREEK_AS), (ARMENIAN, ARMENIAN_AS), (PHONETIC, PHONETIC_AS)) for c, shape in zip(own, shapes, strict=True)}
FIRST_SCRIPTS = ("LATIN", "CYRILLIC", "GREEK", "ARMENIAN")
LATIN = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

_INVISIBLE = re.compile(f"[{INVISIBLE}]+")
_SPACES = re.compile(r"[    -   　]")
_SYLLABLES = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}\p{Bopomofo}\p{Yi}]"  # no alphabets; their texts have no tokens
_TOKEN = regex.compile(rf"(?V1)[[\p{{L}}\p{{M}}]--{_SYLLABLES}]+")
_FOREIGN = regex.compile(rf"(?V1)[[\p{{L}}--\p{{Latin}}]--{_SYLLABLES}]|[\u0250-\u02AF\u1D00-\u1D7F\uA700-\uA7FF]")
_BEFORE_NFKD = str.maketrans({"Ϲ": "C", "ϲ": "c"})  # compatibility forms of sigma that are shaped like c


@lru_cache(maxsize=1 << 16)
def script_of(letter: str) -> str | None:
    """The alphabet of a letter, by its Unicode name; None for marks and all that goes with any script.

    Small capitals and phonetic letters count as alphabets of their own.
    """
    if unicodedata.combining(letter) or not letter.isalpha():
        return None
    name = unicodedata.name(letter, "UNNAMED")
    if letter in PHONETIC:
        return "PHONETIC"
    return "SMALL CAPITAL" if name.startswith("LATIN LETTER SMALL CAPITAL ") else name.split()[0]


class Look:
    """Letters of other alphabets with the Latin letters of their shape."""

    def __init__(self, shape: dict[str, str]):
        self.shape = shape
        others: dict[str, dict[str, str]] = {}
        for letter, latin in shape.items():
            others.setdefault(script_of(letter) or "LATIN", {}).setdefault(latin, letter)
        #: script -> Latin shape -> the letter of that script (the first listed), Latin and the common ones first.
        self.spelling = {s: others.get(s, {}) for s in (*FIRST_SCRIPTS, *sorted(others.keys() - set(FIRST_SCRIPTS)))}
        self._resolved: dict[str, frozenset[str]] = {}

    def resolved_scripts(self, letter: str) -> frozenset[str]:
        """The scripts that have a letter of this shape; all scripts for marks."""
        got = self._resolved.get(letter)
        if got is None:
            own, shape = script_of(letter), self.shape.get(letter, letter)
            if own is None:
                got = frozenset(self.spelling)
            elif shape == letter and own != "LATIN":
                got = frozenset([own])
            else:
                got = frozenset(["LATIN", *(s for s, table in self.spelling.items() if shape in table)])
            self._resolved[letter] = got
        return got

    def consistent_token(self, token: str) -> tuple[str, str]:
        """(spelling, kind): kind is 'mixed' (letters of several scripts), 'whole' (all letters of one other
        script, and Latin could spell it) or ''."""
        used = {s for c in token if (s := script_of(c)) is not None}
        left = frozenset.intersection(*(self.resolved_scripts(c) for c in token))
        kind = "mixed" if len(used) > 1 else "whole" if used != {"LATIN"} and "LATIN" in left else ""
        target = next((s for s in self.spelling if s in left), None)
        shapes = [self.shape.get(c, c) for c in token]
        if target is None and left:  # an alphabet without any Latin shape
            return token, kind
        if target in (None, "LATIN"):
            return "".join(shapes), kind
        return "".join(self.spelling[target].get(s, s) for s in shapes), kind


FIXED_LOOK = Look(FIXED)
_LOOKS: dict[str, Look] = {}


def unicode_look(spark: SparkSession) -> Look:
    """The letters of the Unicode table of confusables that are shaped like one Latin letter, beside the fixed ones.

    Only letters of alphabets are taken, so digits and punctuation stay what they are. Where a shape
    stands for I and l, capitals and letters without case are I. Small capitals that the table leaves
    alone are read as capitals.
    """
    app = spark.sparkContext.applicationId
    if app not in _LOOKS:
        letters = [c for c in map(chr, range(0x250, sys.maxunicode + 1)) if unicodedata.category(c)[0] == "L" and _FOREIGN.match(c) and unicodedata.normalize("NFKD", c) == c]
        try:
            checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
            bones = checker.getSkeleton("\n".join([*LATIN, *letters])).split("\n")
        except TypeError:  # the package is not on the class path
            bones = []
        shape = {}
        if len(bones) == len(LATIN) + len(letters):
            by_bone: dict[str, list[str]] = {}
            for latin, bone in zip(LATIN, bones):
                by_bone.setdefault(bone, []).append(latin)
            for c, bone in zip(letters, bones[len(LATIN) :]):
                found = by_bone.get(bone, [])
                if found and (script_of(c) != "LATIN"):
                    shape[c] = found[-1] if c.islower() else found[0]
        for c in letters:
            if script_of(c) == "SMALL CAPITAL":
                last = unicodedata.name(c).rpartition(" ")[2]
                if len(last) == 1:
                    shape.setdefault(c, last)
        _LOOKS[app] = Look(shape | FIXED)
    return _LOOKS[app]


def normalize_look(text: str | None, look: Look = FIXED_LOOK) -> tuple[str, int, int]:
    """(text in consistent form, mixed-script tokens, whole-script confusables). Null gives ''.

    Case, accents, digits, punctuation and the number of spaces stay; line breaks and tabs stay too.
    """
    if not text:
        return "", 0, 0
    if text.isascii() and not _INVISIBLE.search(text):
        return text, 0, 0
    text = unicodedata.normalize("NFKD", text.translate(_BEFORE_NFKD))
    text = _SPACES.sub(" ", _INVISIBLE.sub("", text))
    kinds = {"mixed": 0, "whole": 0, "": 0}
    if _FOREIGN.search(text):

        def spell(m: re.Match) -> str:
            if not _FOREIGN.search(m[0]):
                return m[0]
            out, kind = look.consistent_token(m[0])
            kinds[kind] += 1
            return out

        text = _TOKEN.sub(spell, text)
    return unicodedata.normalize("NFKC", text), kinds["mixed"], kinds["whole"]


def normalized_records(records: DataFrame, key: str, title: str, content: str) -> DataFrame:
    """Every row's title and content in consistent form, with counts of confusable tokens.

    Columns: key, title_look, content_look, mixed_tokens, whole_tokens. Null texts give ''. No shuffle.
    """
    ship(records.sparkSession)
    look = unicode_look(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            titles = [normalize_look(t, look) for t in batch.column(1).to_pylist()]
            contents = [normalize_look(t, look) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([t[0] for t in titles], pa.string()),
                    pa.array([t[0] for t in contents], pa.string()),
                    pa.array([a[1] + b[1] for a, b in zip(titles, contents)], pa.int32()),
                    pa.array([a[2] + b[2] for a, b in zip(titles, contents)], pa.int32()),
                ],
                names=[key, "title_look", "content_look", "mixed_tokens", "whole_tokens"],
            )

    schema = f"`{key}` long, title_look string, content_look string, mixed_tokens int, whole_tokens int"
    return records.select(F.col(key).cast("long"), F.col(title), F.col(content)).mapInArrow(run, schema)


def look_digests(records: DataFrame, key: str, title: str, content: str) -> DataFrame:
    """key, look and raw: 16-byte digests of both texts in consistent form and as they are.

    Rows with a null key or without any text (nothing but white space and invisible characters) are left out.
    """
    ship(records.sparkSession)
    look = unicode_look(records.sparkSession)

    def digest(a: str, b: str) -> bytes:
        h = hashlib.blake2b(len(a).to_bytes(8, "little"), digest_size=16)
        h.update(a.encode("utf-8", "surrogatepass") + b.encode("utf-8", "surrogatepass"))
        return h.digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, t, c in zip(*(batch.column(i).to_pylist() for i in range(3))):
                look_t, look_c = normalize_look(t, look)[0], normalize_look(c, look)[0]
                if k is not None and (look_t.strip() or look_c.strip()):
                    rows.append((k, digest(look_t, look_c), digest(t or "", c or "")))
            keys, looks, raws = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(looks, pa.binary()), pa.array(raws, pa.binary())], names=[key, "look", "raw"])

    return records.select(F.col(key).cast("long"), F.col(title), F.col(content)).mapInArrow(run, f"`{key}` long, look binary, raw binary")


def lookalike_groups(records: DataFrame, key: str, title: str, content: str) -> tuple[DataFrame, DataFrame]:
    """(groups, members) of records that look the same while their characters differ.

    groups: look, first (smallest key), n_records, n_rows; only groups with more than one spelling.
    members: key, look, raw, n_records. Repeated rows count once.
    """
    digests = written(look_digests(records, key, title, content).distinct(), "looks")
    groups = (
        digests.groupBy("look")
        .agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("n_records"), F.min("raw").alias("_a"), F.max("raw").alias("_b"))
        .filter(F.col("_a") != F.col("_b"))
        .drop("_a", "_b")
    )
    groups = written(groups, "look-groups")
    return groups, attach_by_key(digests, groups, ["look"], "n_records")


def lookalike_pairs(records: DataFrame, key: str, title: str, content: str) -> DataFrame:
    """<key>_a < <key>_b: pairs of records that look the same and differ in a code point."""
    _, members = lookalike_groups(records, key, title, content)
    pairs = pairs_within_groups(members, "look", key, "n_records", carry=["raw"])
    return pairs.filter(F.col("raw_a") != F.col("raw_b")).select(f"{key}_a", f"{key}_b").distinct()
