"""Exact prefilter, band candidates, SimHash and MinHash matching and the check cascade."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from twinsieve.functions import scalars, text
from twinsieve.operators.fingerprint import band_rows
from twinsieve.operators.greedy import first_wins
from twinsieve.operators.skew import attach_by_key
from twinsieve.params import DEFAULTS, Params
from twinsieve.session import written

@dataclass(frozen=True)
class Since:
    """P5: the days that end with the day of as_of; what was created outside of them, or at no known time, is no candidate."""

    as_of: Column
    days: int
    timezone: str = DEFAULTS.timezone


REASONS = ("external_id", "raw_hash", "content_hash", "title_hash")


def prefilter(probes: DataFrame, store: DataFrame, key: str = "probe", earlier: bool = False) -> DataFrame:
    """The stored document with the same id or hash, per probe: key, priority, reason, doc_pk.

    probes: key, external_id, raw_hash, exact or content hash as content_hash, title_hash (null where it
    plays no role). Of several the first of REASONS wins, then the smallest doc_pk. Only stored values that
    a probe asks for are grouped, and each is joined as one row. Null values match nothing; probes without
    a match are left out. With ``earlier`` only documents whose doc_pk is below the
    key of the probe count.
    """
    columns = {"external_id": "external_id", "raw_hash": "raw_hash", "content_hash": "exact_hash", "title_hash": "title_hash"}
    wanted = F.array(*[F.struct(F.lit(i + 1).alias("priority"), F.col(r).alias("value")) for i, r in enumerate(REASONS)])
    held = F.array(*[F.struct(F.lit(i + 1).alias("priority"), F.col(columns[r]).alias("value")) for i, r in enumerate(REASONS)])
    asks = probes.select(key, F.explode(wanted).alias("w")).filter("w.value is not null").select(key, "w.priority", "w.value")
    first = store.select("doc_pk", F.explode(held).alias("h")).filter("h.value is not null").select("doc_pk", "h.priority", "h.value")
    first = first.join(asks.select("priority", "value").distinct(), ["priority", "value"], "left_semi")
    first = first.groupBy("priority", "value").agg(F.min("doc_pk").alias("doc_pk"))
    met = asks.join(first, ["priority", "value"])
    if earlier:
        met = met.filter(F.col("doc_pk") < F.col(key))
    best = met.groupBy(key).agg(F.min(F.struct("priority", "doc_pk")).alias("m"))
    reason = F.element_at(F.array(*[F.lit(r) for r in REASONS]), F.col("m.priority"))
    return best.select(key, F.col("m.priority").alias("priority"), reason.alias("reason"), F.col("m.doc_pk").alias("doc_pk"))


def bucket_sizes(bands: DataFrame) -> DataFrame:
    """A4: documents of every bucket, repeated rows once, with partial sums before the shuffle."""
    keys = ["scope", "kind", "band_index", "band_value"]
    return bands.select(*keys, "doc_pk").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n_docs"))


def eligible_bands(asks: DataFrame, bands: DataFrame, scope: str, kind: str, largest: int, since: Since | None = None) -> DataFrame:
    """Band rows in the buckets that are asked for, with their sizes; buckets above ``largest`` are gone.

    The store is cut down to the asked buckets before anything of it is grouped. Since no bucket left is
    larger than ``largest``, no later join on a bucket can be skewed.
    """
    own = bands.filter((F.col("scope") == scope) & (F.col("kind") == kind))
    if since is not None:
        own = own.filter(scalars.in_window(F.col("created_at"), since.as_of, since.days, since.timezone))
    own = own.select("band_index", "band_value", "doc_pk").join(asks.select("band_index", "band_value").distinct(), ["band_index", "band_value"], "left_semi").distinct()
    sizes = own.groupBy("band_index", "band_value").agg(F.count(F.lit(1)).alias("n_docs"))
    return attach_by_key(own, sizes, ["band_index", "band_value"], "n_docs").filter(F.col("n_docs") <= largest)


def candidates(probe_bands: DataFrame, bands: DataFrame, scope: str, kind: str, p: Params = DEFAULTS, key: str = "probe", since: Since | None = None) -> DataFrame:
    """Key, doc_pk, band_hits, first_band of all documents in eligible buckets of the probe.

    probe_bands: key, kind, band_index, band_value, max_bucket (null: the default). The effective limit
    of a probe is the smaller of its own and the cap; a bucket above it is skipped as a whole. With
    ``since`` only band rows created in its days count, also for the size of a bucket.
    """
    limit = F.least(F.coalesce("max_bucket", F.lit(p.max_bucket_size)), F.lit(p.max_bucket_cap))
    asks = probe_bands.filter(F.col("kind") == kind).select(key, "band_index", "band_value", limit.alias("_limit")).distinct()
    met = asks.join(eligible_bands(asks, bands, scope, kind, p.max_bucket_cap, since), ["band_index", "band_value"]).filter(F.col("n_docs") <= F.col("_limit"))
    return met.groupBy(key, "doc_pk").agg(F.count(F.lit(1)).alias("band_hits"), F.min("band_index").alias("first_band"))


def ranking_summary(met: DataFrame, p: Params = DEFAULTS, key: str = "probe") -> DataFrame:
    """A3 of candidates(): key, unique_before_limit, top_band_hits, truncated (more than max_candidates)."""
    out = met.groupBy(key).agg(F.count(F.lit(1)).alias("unique_before_limit"), F.max("band_hits").alias("top_band_hits"))
    return out.withColumn("truncated", F.col("unique_before_limit") > p.max_candidates)


def _top(rows: DataFrame, key: str, order: list[Column], limit: int, alias: str) -> DataFrame:
    """Rank per probe; the window is over candidates of one probe, which the bucket limits bound."""
    return rows.withColumn(alias, F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col(alias) <= limit)


def simhash_checks(probes: DataFrame, bands: DataFrame, store: DataFrame, scope: str = "content", p: Params = DEFAULTS, key: str = "probe", earlier: bool = False, since: Since | None = None) -> DataFrame:
    """The comparisons of Q2: key, doc_pk, hamming_distance, max_hamming, seen (place), band_hits, first_band.

    probes: key, external_id, <scope>_simhash_hi, _lo and both <scope>_*_bands, optional max_hamming and
    max_bucket. Candidates are looked at in the order of band and doc_pk, at most max_checks that are
    not the probe itself.
    """
    hi, lo = ("simhash_hi", "simhash_lo") if scope == "content" else ("title_simhash_hi", "title_simhash_lo")
    probes = _with_limits(probes)
    asks = band_rows(probes, key, scope, ("max_bucket",))
    held = store.select("doc_pk", F.col("external_id").alias("_external"), F.col(hi).alias("_hi"), F.col(lo).alias("_lo"))
    own = probes.select(key, "external_id", F.coalesce("max_hamming", F.lit(p.max_hamming)).alias("max_hamming"), F.col(f"{scope}_simhash_hi").alias("_own_hi"), F.col(f"{scope}_simhash_lo").alias("_own_lo"))
    met = _earlier(candidates(asks, bands, scope, "simhash", p, key, since), key, earlier).join(held, "doc_pk").join(own, key)
    met = met.filter(~F.col("external_id").eqNullSafe(F.col("_external")))
    seen = _top(met, key, [F.col("first_band"), F.col("doc_pk")], p.max_checks, "seen")
    distance = scalars.hamming(F.col("_own_hi"), F.col("_own_lo"), F.col("_hi"), F.col("_lo"))
    return seen.select(key, "doc_pk", distance.alias("hamming_distance"), "max_hamming", "seen", "band_hits", "first_band")


def match_simhash(probes: DataFrame, bands: DataFrame, store: DataFrame, scope: str = "content", p: Params = DEFAULTS, key: str = "probe", earlier: bool = False, since: Since | None = None) -> DataFrame:
    """Q2: matches by SimHash: key, doc_pk, hamming_distance, rank (1 is best); see simhash_checks().

    Ties in distance go by the order in which candidates are looked at.
    """
    near = simhash_checks(probes, bands, store, scope, p, key, earlier, since).filter(F.col("hamming_distance") <= F.col("max_hamming"))
    return _top(near, key, [F.col("hamming_distance"), F.col("seen")], p.result_limit, "rank").select(key, "doc_pk", "hamming_distance", "rank")


def minhash_checks(probes: DataFrame, bands: DataFrame, store: DataFrame, texts: DataFrame, scope: str = "content", p: Params = DEFAULTS, key: str = "probe", earlier: bool = False, since: Since | None = None) -> DataFrame:
    """The comparisons of Q3: key, doc_pk, score, place, band_hits, first_band.

    Candidates are ranked by bands hit, then by first band and doc_pk, and cut to max_candidates; the
    probe itself takes a place there and goes afterwards. The score is taken on the stored text of the
    scope (normalized_content, also for documents whose bands came from the title). Texts are joined
    after the cut only.
    """
    column, own_text = ("normalized_content", "primary_text") if scope == "content" else ("normalized_title", "normalized_title")
    probes = _with_limits(probes)
    asks = band_rows(probes, key, scope, ("max_bucket",))
    met = _earlier(candidates(asks, bands, scope, "minhash", p, key, since), key, earlier)
    ranked = _top(met, key, [F.desc("band_hits"), F.col("first_band"), F.col("doc_pk")], p.max_candidates, "place")
    held = store.select("doc_pk", F.col("external_id").alias("_external"))
    met = ranked.join(held, "doc_pk").join(probes.select(key, "external_id", F.col(own_text).alias("_own")), key)
    met = met.filter(~F.col("external_id").eqNullSafe(F.col("_external")))
    met = met.join(texts.select("doc_pk", F.col(column).alias("_text")), "doc_pk", "left").withColumn("_text", F.coalesce("_text", F.lit("")))
    return met.select(key, "doc_pk", text.jaccard_texts(F.col("_own"), F.col("_text"), p.ngram).alias("score"), "place", "band_hits", "first_band")


def match_minhash(probes: DataFrame, bands: DataFrame, store: DataFrame, texts: DataFrame, scope: str = "content", p: Params = DEFAULTS, key: str = "probe", earlier: bool = False, since: Since | None = None) -> DataFrame:
    """Q3: matches by MinHash and exact Jaccard: key, doc_pk, score, rank; see minhash_checks()."""
    near = minhash_checks(probes, bands, store, texts, scope, p, key, earlier, since).filter(F.col("score") >= p.jaccard_threshold)
    return _top(near, key, [F.desc("score"), F.col("place")], p.result_limit, "rank").select(key, "doc_pk", "score", "rank")


def _earlier(rows: DataFrame, key: str, earlier: bool) -> DataFrame:
    return rows.filter(F.col("doc_pk") < F.col(key)) if earlier else rows


def _with_limits(probes: DataFrame) -> DataFrame:
    for name in ("max_bucket", "max_hamming"):
        if name not in probes.columns:
            probes = probes.withColumn(name, F.lit(None).cast("int"))
    return probes


def check(probes: DataFrame, bands: DataFrame, store: DataFrame, texts: DataFrame, p: Params = DEFAULTS, key: str = "probe", title_chain: bool = True, earlier: bool = False, since: Since | None = None, stages: dict[str, float] | None = None) -> DataFrame:
    """Q4: the verdict on every probe that has text: text_same, sim_same, min_same or new, first hit wins.

    probes: fingerprints() with key and external_id, optional levels (null: all), and optional exact_maybe of
    membership.exact_maybe(): probes known to be absent skip the exact lookup, but never those with
    ``insert`` (B6). Columns: key, dedupe_status, text_type, doc_pk, hamming_distance, score, and for new probes the nearest document
    of the content scope that did not reach the limit (A5): best_simhash_distance, best_simhash_doc,
    best_minhash_score (4 digits; 0 where none shares a gram), best_minhash_doc. Content goes before
    title; the title chain runs where the probe has content and a title. The cheap levels settle most
    probes; the costly ones run on what is left, each on a written table. details() adds the texts.
    ``stages`` gets the milliseconds of each level (Q9).
    """
    return _cascade(probes, bands, store, texts, p, key, title_chain, earlier, since, stages).drop("_order")


BEST = {"best_simhash_distance": "int", "best_simhash_doc": "long", "best_minhash_score": "double", "best_minhash_doc": "long"}


def _cascade(probes: DataFrame, bands: DataFrame, store: DataFrame, texts: DataFrame, p: Params, key: str, title_chain: bool = True, earlier: bool = False, since: Since | None = None, stages: dict[str, float] | None = None) -> DataFrame:
    """check() with _order: of two hits of a probe in different stores, the one of the smaller _order comes first.

    It holds the level, and within it priority, or distance and first band, or score, bands hit and
    first band; null where the probe is new. A level's nearest document is its match if it reaches the
    limit, so one minimum per probe gives both.
    """
    probes = probes.filter(F.col("primary_text") != "")
    both = (F.col("normalized_content") != "") & (F.col("normalized_title") != "") & F.lit(title_chain)
    if "levels" not in probes.columns:
        probes = probes.withColumn("levels", F.lit(None).cast("array<string>"))

    def level_of(rows: DataFrame, name: str) -> DataFrame:
        began = time.time()
        out = written(rows, name)
        if stages is not None:
            stages[name] = round((time.time() - began) * 1000, 3)
        return out

    probes = level_of(probes.withColumn("_both", both), "probes")
    asking = probes
    if "exact_maybe" in probes.columns:
        inserts = F.coalesce(F.col("insert"), F.lit(False)) if "insert" in probes.columns else F.lit(False)
        asking = probes.filter(inserts | F.coalesce("exact_maybe", F.lit(True)))
    exact = prefilter(asking.select(key, "external_id", "raw_hash", F.col("exact_hash").alias("content_hash"), F.when(F.col("_both"), F.col("title_hash")).alias("title_hash")), store, key, earlier)
    kind = F.when(F.col("reason") == "title_hash", "title").when(F.col("reason") == "content_hash", "content").otherwise("all")
    none = lambda t: F.lit(None).cast(t)
    columns = [key, "dedupe_status", "text_type", "doc_pk", "hamming_distance", "score", "_order"]
    order = lambda level, *by: F.array(F.lit(float(level)), *[c.cast("double") for c in by]).alias("_order")
    found = level_of(exact.select(key, F.lit("text_same").alias("dedupe_status"), kind.alias("text_type"), "doc_pk", none("int").alias("hamming_distance"), none("double").alias("score"), order(0, F.col("priority"))), "text-same")
    missed = {}
    for n, scope in enumerate(("content", "title")):
        for level in ("simhash", "minhash"):
            wanted = F.col("levels").isNull() | F.array_contains("levels", level)
            left = probes.filter(wanted if scope == "content" else wanted & F.col("_both")).join(found.select(key), key, "left_anti")
            if level == "simhash":
                seen = simhash_checks(left, bands, store, scope, p, key, earlier, since)
                nearest = F.min(F.struct("hamming_distance", "seen", "doc_pk", "first_band", "max_hamming")).alias("m")
                hit = seen.groupBy(key).agg(nearest).select(key, "m.*").withColumn("_matched", F.col("hamming_distance") <= F.col("max_hamming"))
                hit = hit.select("*", order(1 + 2 * n, F.col("hamming_distance"), F.col("first_band")), none("double").alias("score"), F.lit("sim_same").alias("dedupe_status"))
            else:
                seen = minhash_checks(left, bands, store, texts, scope, p, key, earlier, since)
                nearest = F.min(F.struct((-F.col("score")).alias("_less"), "place", "doc_pk", "band_hits", "first_band")).alias("m")
                hit = seen.groupBy(key).agg(nearest).select(key, "m.*").withColumn("score", -F.col("_less")).withColumn("_matched", F.col("score") >= p.jaccard_threshold)
                hit = hit.select("*", order(2 + 2 * n, F.col("_less"), -F.col("band_hits"), F.col("first_band")), none("int").alias("hamming_distance"), F.lit("min_same").alias("dedupe_status"))
            hit = level_of(hit.withColumn("text_type", F.lit(scope)).select(*columns, "_matched"), f"{scope}-{level}")
            found = found.unionByName(hit.filter("_matched").select(*columns))
            if scope == "content":
                missed[level] = hit.filter("not _matched")
    sim = missed["simhash"].select(key, F.col("hamming_distance").alias("best_simhash_distance"), F.col("doc_pk").alias("best_simhash_doc"))
    near = missed["minhash"].filter("score > 0").select(key, F.round("score", 4).alias("best_minhash_score"), F.col("doc_pk").alias("best_minhash_doc"))
    new = probes.select(key).join(found.select(key), key, "left_anti").join(sim, key, "left").join(near, key, "left")
    blank = [F.lit("new").alias("dedupe_status"), none("string").alias("text_type"), none("long").alias("doc_pk"), none("int").alias("hamming_distance"), none("double").alias("score"), none("array<double>").alias("_order")]
    new = new.select(key, *blank, "best_simhash_distance", "best_simhash_doc", F.coalesce("best_minhash_score", F.lit(0.0)).alias("best_minhash_score"), "best_minhash_doc")
    return found.select(*columns, *[none(t).alias(c) for c, t in BEST.items()]).unionByName(new)


def details(verdicts: DataFrame, probes: DataFrame, store: DataFrame, texts: DataFrame, p: Params = DEFAULTS, key: str = "probe") -> DataFrame:
    """The full answers to check(): its columns, the hashes of the probe, and id, hashes and sample text of the match.

    Adds raw_hash, content_hash, title_hash, match_id, match_raw_hash, match_content_hash,
    match_title_hash, sample_text. A match in the title scope shows the stored title, otherwise the
    content; a new probe has null there, but for match_raw_hash, which is its own raw hash as in the service.
    """
    own = probes.select(key, "raw_hash", "content_hash", "title_hash")
    held = store.select("doc_pk", F.col("external_id").alias("match_id"), F.col("raw_hash").alias("match_raw_hash"), F.col("exact_hash").alias("match_content_hash"), F.col("title_hash").alias("match_title_hash"))
    held = held.join(texts.select("doc_pk", "normalized_title", "normalized_content"), "doc_pk", "left")
    out = verdicts.join(own, key).join(held, "doc_pk", "left")
    shown = F.when(F.col("text_type") == "title", F.col("normalized_title")).otherwise(F.col("normalized_content"))
    out = out.withColumns({"match_raw_hash": F.when(F.col("dedupe_status") == "new", F.col("raw_hash")).otherwise(F.col("match_raw_hash")),
                           "sample_text": scalars.sample_text(F.when(F.col("doc_pk").isNotNull(), F.coalesce(shown, F.lit(""))), p.sample_text_length)})
    added = ["raw_hash", "content_hash", "title_hash", "match_id", "match_raw_hash", "match_content_hash", "match_title_hash", "sample_text"]
    return out.select(*verdicts.columns, *added)


UNCAPPED = Params(max_bucket_size=1 << 30, max_bucket_cap=1 << 30, max_checks=1 << 30, max_candidates=1 << 30, result_limit=1 << 30)


def check_and_insert(probes: DataFrame, bands: DataFrame, store: DataFrame, texts: DataFrame, p: Params = DEFAULTS, key: str = "probe") -> DataFrame:
    """Q5: check() in order of key, where each new probe with ``insert`` is stored before the next is checked.

    Columns: those of check(), inserted, and match_probe, the earlier probe of the batch that a probe
    repeats. Each level looks at the store and the accepted probes together; between equal hits the
    store goes first. Within the batch equal texts are compared once, as a class. A probe that neither holds is new, so what is accepted does not depend on the
    probes that the store answers. Against the store the limits of p hold; within the batch no
    bucket is skipped and no candidate cut, since what is in a bucket depends on what was accepted.
    Probes that cannot be stored still are checked against those that were stored before them.
    """
    probes = written(probes.filter("primary_text <> ''"), "batch-probes")
    outside = written(_cascade(probes, bands, store, texts, p, key), "batch-outside")
    fresh = written(probes.join(outside.filter("dedupe_status = 'new'").select(key), key, "left_semi").withColumn("max_bucket", F.lit(None).cast("int")), "batch-new")
    wants = fresh.filter(F.coalesce("insert", F.lit(False)))
    both = (F.col("normalized_content") != "") & (F.col("normalized_title") != "")
    levels = F.col("levels") if "levels" in fresh.columns else F.lit(None).cast("array<string>")
    # Equal texts are one class: those of a class refuse each other by their hash, those of another by the class.
    own_class = {"content": F.concat(F.lit("content:"), F.col("exact_hash"), F.col("content_hash").isNull().cast("string")), "title": F.concat(F.lit("title:"), F.col("title_hash"))}
    limit = F.coalesce("max_hamming", F.lit(p.max_hamming)) if "max_hamming" in fresh.columns else F.lit(p.max_hamming)
    members = wants.select(key, limit.alias("_limit"), levels.alias("_levels"), both.alias("_both"), *[c.alias(f"_{s}") for s, c in own_class.items()])
    members = written(members, "batch-members")
    asked = None
    for scope in ("content", "title"):
        near = written(_class_links(wants.withColumn("_class", own_class[scope]), scope, key), f"{scope}-class-links")
        rows = members.filter(F.lit(True) if scope == "content" else F.col("_both")).join(near.withColumnRenamed("_class", f"_{scope}"), f"_{scope}")
        fits = F.col("_levels").isNull() | F.array_contains("_levels", F.col("_level"))
        rows = rows.filter(fits & ((F.col("_level") == "minhash") | (F.col("_distance") <= F.col("_limit")))).select(F.col(key).alias("id"), F.col("_other").alias("value"))
        asked = rows if asked is None else asked.unionByName(rows)
    tag = lambda *pairs: F.array(*[F.when(c.isNotNull(), F.concat(F.lit(f"{t}="), c)) for t, c in pairs])
    col = F.col
    keys = (("id", col("external_id")), ("raw", col("raw_hash")), ("exact", col("exact_hash")))
    holds = wants.select(col(key).alias("id"), F.explode(F.concat(tag(*keys, ("title", col("title_hash"))), F.array(*own_class.values()))).alias("value"))
    asks = wants.select(col(key).alias("id"), F.explode(tag(*keys, ("title", F.when(both, col("title_hash"))))).alias("value")).unionByName(asked)
    none = probes.select(col(key).alias("a"), col(key).alias("b")).limit(0)
    accepted = written(first_wins(wants.select(col(key).alias("id"), col(key).alias("rank")), none, asks, holds).select(col("id").alias(key)), "batch-accepted")
    in_bands, in_store, in_texts = _as_store(wants.join(accepted, key, "left_semi"), key)
    rest = probes.join(accepted, key, "left_anti").withColumn("max_bucket", F.lit(None).cast("int"))
    inside = _cascade(rest, written(in_bands, "accepted-bands"), in_store, in_texts, UNCAPPED, key, earlier=True)
    verdict = lambda side: F.struct(col("_order").isNull().alias("new"), "_order", F.lit(side).alias("side"), *[c for c in outside.columns if c not in (key, "_order", *BEST)])
    both_sides = outside.select(key, verdict(0).alias("v")).unionByName(inside.select(key, verdict(1).alias("v")))
    best = both_sides.groupBy(key).agg(F.min("v").alias("v")).select(key, "v.*").join(accepted.withColumn("_accepted", F.lit(True)), key, "left")
    own = (col("side") == 1) & ~col("new")
    return best.select(key, "dedupe_status", "text_type", F.when(~own, col("doc_pk")).alias("doc_pk"), "hamming_distance", "score",
                       F.when(own, col("doc_pk")).alias("match_probe"), F.coalesce("_accepted", F.lit(False)).alias("inserted"))


def _class_links(wants: DataFrame, scope: str, key: str) -> DataFrame:
    """_class, _other, _level, _distance: for each class of equal texts the classes that match it in a scope, whatever their buckets hold.

    One document stands for its class, so a text that many have is compared once. Every SimHash candidate is given with
    its distance, since each probe has a limit of its own; MinHash candidates have reached the threshold.
    """
    there = wants.filter(F.col("_class").isNotNull())
    first = there.groupBy("_class").agg(F.min(key).alias(key))
    reps = there.join(first.select(key), key, "left_semi").withColumns({"external_id": F.col(key).cast("string"), "max_hamming": F.lit(UNCAPPED.simhash_bits), "max_bucket": F.lit(None).cast("int")})
    reps = written(reps, f"{scope}-representatives")
    bands, store, texts = _as_store(reps, key)
    bands = written(bands.filter(F.col("scope") == scope), f"{scope}-bands")
    farthest = there.agg(F.max(F.coalesce("max_hamming", F.lit(UNCAPPED.max_hamming)))).scalar() if "max_hamming" in wants.columns else F.lit(UNCAPPED.max_hamming)
    sim = simhash_checks(reps, bands, store, scope, UNCAPPED, key).filter(F.col("hamming_distance") <= farthest)
    near = minhash_checks(reps, bands, store, texts, scope, UNCAPPED, key).filter(F.col("score") >= UNCAPPED.jaccard_threshold)
    links = sim.select(key, "doc_pk", F.lit("simhash").alias("_level"), F.col("hamming_distance").alias("_distance")).unionByName(near.select(key, "doc_pk", F.lit("minhash").alias("_level"), F.lit(0).alias("_distance")))
    names = reps.select(key, "_class")
    return links.join(names, key).join(names.select(F.col(key).alias("doc_pk"), F.col("_class").alias("_other")), "doc_pk").select("_class", "_other", "_level", "_distance")


def _as_store(prints: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(bands, store, texts) of fingerprints, numbered by their key."""
    docs = prints.withColumn("doc_pk", F.col(key))
    bands = None
    for scope in ("content", "title"):
        rows = band_rows(docs, "doc_pk", scope).withColumn("scope", F.lit(scope))
        bands = rows if bands is None else bands.unionByName(rows)
    store = docs.select("doc_pk", "external_id", "raw_hash", "exact_hash", "title_hash", F.col("content_simhash_hi").alias("simhash_hi"), F.col("content_simhash_lo").alias("simhash_lo"), "title_simhash_hi", "title_simhash_lo")
    return bands, store, docs.select("doc_pk", "normalized_title", "normalized_content")
