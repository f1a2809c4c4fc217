"""Readers: baseline JSON, raw lines, strict requests, sidecar of parameters."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from twinsieve.params import Params

BASELINE_FORMAT = "dedupe-php-compat-baseline/v1"  # fixed value: the format tag of baseline files
_SCOPE = """STRUCT<text: STRING, text_len: INT, low_information: BOOLEAN, exact_hash: STRING, simhash_hex: STRING, simhash_hi_pg_bigint: STRING,
 simhash_lo_pg_bigint: STRING, simhash_bands: ARRAY<ARRAY<STRING>>, minhash_signature_uint64: ARRAY<STRING>, minhash_bands_uint64: ARRAY<ARRAY<STRING>>>"""
BASELINE = f"""format STRING, records ARRAY<STRUCT<doc_pk: BIGINT, canonical_input: STRUCT<title: STRING, content: STRING>,
 expected_from_canonical_input: STRUCT<raw_hash_hex: STRING, content_hash_hex: STRING, title_hash_hex: STRING, normalized_title: STRING,
 normalized_content: STRING, primary_text: STRING, content_scope: {_SCOPE}, title_scope: {_SCOPE}>>>"""


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """Records of baseline files; unsigned numbers stay strings. Files of another format are an error."""
    files = spark.read.schema(BASELINE).json(path, multiLine=True)
    tag = F.when(F.col("format").eqNullSafe(BASELINE_FORMAT), F.col("records")).otherwise(F.raise_error(F.concat(F.lit("unknown baseline format: "), F.coalesce("format", F.lit("none")))))
    return files.select(F.explode(tag.cast(files.schema["records"].dataType)).alias("r")).select("r.*")


REQUEST = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("source_from", T.StringType()), T.StructField("title", T.StringType()), T.StructField("content", T.StringType()),
    T.StructField("max_hamming", T.IntegerType()), T.StructField("max_bucket_size", T.IntegerType()), T.StructField("limit", T.IntegerType()),
    T.StructField("levels", T.ArrayType(T.StringType())), T.StructField("insert_on_check", T.BooleanType()),
])
MAX_BODY = 1 << 20


def decode_requests(lines: DataFrame, column: str = "value") -> DataFrame:
    """All columns of lines, ``request`` and ``error`` (null where the request is fine).

    Refused are bodies above 1 MiB, broken JSON, unknown fields, requests without title and content, and limits
    out of range.
    """
    known = F.array(*[F.lit(f.name) for f in REQUEST])
    body = F.col(column)
    fields = F.json_object_keys(body)
    parsed = F.from_json(body, REQUEST)
    empty = (F.coalesce(parsed["title"], F.lit("")) == "") & (F.coalesce(parsed["content"], F.lit("")) == "")
    error = (
        F.when(body.isNull() | fields.isNull(), "no JSON object")
        .when(F.octet_length(body) > MAX_BODY, "body too large")
        .when(F.size(F.array_except(fields, known)) > 0, F.concat(F.lit("unknown field: "), F.array_join(F.array_sort(F.array_except(fields, known)), ", ")))
        .when(empty, "title/content are all empty")
        .when((parsed["max_hamming"] < 0) | (parsed["max_bucket_size"] < 1) | (parsed["limit"] < 1), "a limit is out of range")
    )
    return lines.withColumns({"request": parsed, "error": error})


def payload_fields(records: DataFrame, column: str = "payload") -> DataFrame:
    """Title and content of raw baseline lines, parsed once in the JVM; null where the JSON is broken."""
    parsed = records.withColumn("_v", F.try_parse_json(column))
    return parsed.withColumns({c: F.try_variant_get("_v", f"$.canonical_input.{c}", "string") for c in ("title", "content")}).drop("_v")


def write_meta(spark: SparkSession, path: str, p: Params) -> None:
    """Parameters beside a stored index."""
    spark.createDataFrame([(json.dumps(p.meta(), sort_keys=True),)], "meta string").coalesce(1).write.mode("errorifexists").json(f"{path}/_params")


def check_meta(spark: SparkSession, path: str, p: Params) -> None:
    """Refuses an index that was stored under other parameters."""
    stored = json.loads(spark.read.schema("meta string").json(f"{path}/_params").first()["meta"])
    if stored != p.meta():
        raise ValueError(f"the index was stored with {stored}")
