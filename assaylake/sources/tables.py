"""Table sources: contributor manifests, stored engine results and hash-linked records from JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.chain import ChainSpec
from .files import relative_path

MANIFEST_COLUMNS = ("file", "contributor", "class", "timestamp")


def contributor_rows(raw: DataFrame) -> DataFrame:
    """S4 trimmed manifest rows; rows without a file are dropped, blank names become UNKNOWN."""
    missing = sorted(set(MANIFEST_COLUMNS) - set(raw.columns))
    if missing:
        raise ValueError(f"contributor manifest is missing required columns: {missing}")
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    named = lambda c: F.coalesce(F.nullif(text(c), F.lit("")), F.lit("UNKNOWN")).alias(c)
    extra = [c for c in ("row_number",) if c in raw.columns]
    return raw.where(text("file") != "").select(
        *extra, text("file").alias("file"), named("contributor"), named("class"), text("timestamp").alias("timestamp"))


def read_contributor_manifest(spark: SparkSession, path: str) -> DataFrame:
    """S4 manifest CSV with a required header."""
    return contributor_rows(spark.read.option("header", "true").csv(path))


def read_engine_results(spark: SparkSession, results_root: str, evidence_root: str | None = None) -> DataFrame:
    """S6 stored engine results as `assessment_id, engine, payload, storage_status`.

    Result files lie at `<assessment_id>/<engine>.json`; an evidence object of the same name wins.
    """
    def load(root: str, name: str) -> DataFrame:
        texts = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(root, wholetext=True)
        path = relative_path(root, F.col("_metadata.file_path"))
        parts = F.split(path, "/")
        keyed = texts.select(F.element_at(parts, -2).alias("assessment_id"),
                             F.regexp_replace(F.element_at(parts, -1), r"\.json$", "").alias("engine"), F.col("value").alias(name))
        return keyed.where((F.size(parts) >= 2) & ~F.contains(path, F.lit("..")))

    files = load(results_root, "file_payload")
    if evidence_root is None:
        return pick_engine_payload(files.withColumn("evidence_payload", F.lit(None).cast("string")))
    return pick_engine_payload(files.join(load(evidence_root, "evidence_payload"), ["assessment_id", "engine"], "full"))


def pick_engine_payload(rows: DataFrame) -> DataFrame:
    """S6 evidence object first, then the result file; text that is no JSON object is reported, not dropped."""
    parsed = lambda c: F.when(F.try_parse_json(F.col(c)).isNotNull(), F.col(c))
    payload = F.coalesce(parsed("evidence_payload"), parsed("file_payload"))
    status = (F.when(parsed("evidence_payload").isNotNull(), "evidence_object").when(payload.isNotNull(), "result_file")
              .otherwise("stored result could not be interpreted"))
    return rows.select("assessment_id", "engine", payload.alias("payload"), status.alias("storage_status"))


def record_schema(spec: ChainSpec) -> T.StructType:
    names = [*spec.fields, spec.previous, spec.hash]
    fields = [T.StructField(n, T.LongType() if n == "sequence" else T.StringType()) for n in names]
    if spec.unique == "nonce":
        fields.append(T.StructField("signature", T.StringType()))
    return T.StructType(fields)


def parse_records(texts: DataFrame, spec: ChainSpec, column: str = "json") -> tuple[DataFrame, DataFrame]:
    """S7 records from JSON texts and the rejected texts with their missing fields."""
    required = [*spec.fields, spec.previous, spec.hash]
    parsed = texts.withColumn("_r", F.from_json(F.col(column), record_schema(spec)))
    absent = F.filter(F.array(*[F.when(F.col("_r").isNull() | F.col(f"_r.{n}").isNull(), F.lit(n)) for n in required]),
                      lambda n: n.isNotNull())
    marked = parsed.withColumn("missing_fields", absent)
    others = [c for c in texts.columns if c != column]
    return (marked.where(F.size("missing_fields") == 0).select(*others, "_r.*"),
            marked.where(F.size("missing_fields") > 0).select(*texts.columns, "missing_fields"))


def records_from_arrays(results: DataFrame, spec: ChainSpec, field: str) -> DataFrame:
    """Records listed in an engine result (`records` / `entries`), one row each with its position."""
    schema = T.StructType([T.StructField(field, T.ArrayType(record_schema(spec)))])
    return results.select(F.col("assessment_id").alias("chain_id"), F.posexplode(F.from_json("payload", schema)[field]).alias("pos", "r")).select(
        "chain_id", F.col("pos").cast("long").alias("pos"), "r.*")


def blank_as_unknown(value: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(value), F.lit("")), F.lit("UNKNOWN"))
