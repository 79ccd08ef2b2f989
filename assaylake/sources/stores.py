"""Result, evidence, asset and assessment tables on plain Parquet / JSON folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.hashing import canonical_json, sha256_text


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def write_result(df: DataFrame, root: str, assessment_id: str, engine: str, *, fmt: str = "json") -> str:
    """S8 one folder per assessment and engine, replaced as a whole when the engine runs again."""
    path = f"{root.rstrip('/')}/{assessment_id}/{engine}"
    df.write.mode("overwrite").format(fmt).save(path)
    return path


def evidence_rows(payloads: DataFrame) -> DataFrame:
    """S9 content-addressed rows from `payload` texts."""
    digest = sha256_text(F.col("payload"))
    return payloads.select(
        digest.alias("sha256"), F.octet_length("payload").cast("long").alias("size_bytes"), "payload",
        F.lit("canonical-json").alias("serialization"), F.substring(digest, 1, 2).alias("prefix")).dropDuplicates(["sha256"])


def append_evidence(spark: SparkSession, payloads: DataFrame, root: str) -> DataFrame:
    """S9 add evidence that is not stored yet; stored content is never overwritten. Gives all rows offered."""
    rows = evidence_rows(payloads)
    stored = _read(spark, root)
    fresh = rows if stored is None else rows.join(stored.select("sha256"), "sha256", "left_anti")
    fresh.write.mode("append").partitionBy("prefix").parquet(root)
    return rows


def asset_rows(files: DataFrame) -> DataFrame:
    """S10 asset identity from `local_path, kind, sha256, size_bytes, registered_at`."""
    identity = sha256_text(canonical_json(path="local_path", kind="kind", sha256="sha256", size="size_bytes"))
    return files.select(
        identity.alias("asset_id"), "kind", F.element_at(F.split("local_path", "/"), -1).alias("display_name"), "local_path",
        "size_bytes", "sha256", "registered_at", F.when(F.col("sha256").isNotNull(), "trusted_for_hashing").otherwise("untrusted").alias("trust_state"))


def register_assets(spark: SparkSession, files: DataFrame, root: str) -> DataFrame:
    """S10 insert or ignore by identity; the earliest registration of a batch is kept."""
    rows = asset_rows(files)
    kept = rows.groupBy("asset_id").agg(F.min(F.struct("registered_at", *[c for c in rows.columns if c not in ("asset_id", "registered_at")])).alias("r"))
    fresh = kept.select("asset_id", "r.*").select(*rows.columns)
    stored = _read(spark, root)
    if stored is not None:
        fresh = fresh.join(stored.select("asset_id"), "asset_id", "left_anti")
    fresh.write.mode("append").parquet(root)
    return spark.read.parquet(root)


def list_assets(assets: DataFrame) -> DataFrame:
    return assets.orderBy(F.desc("registered_at"), "asset_id")


def save_assessments(rows: DataFrame, root: str) -> None:
    """S11 append a version of each assessment: `assessment_id, name, status, created_at, updated_at, payload`."""
    rows.write.mode("append").parquet(root)


def latest_assessments(versions: DataFrame) -> DataFrame:
    """S11 newest version per assessment; the first creation time is kept."""
    newest = F.max(F.struct("updated_at", "name", "status", "payload"))
    return versions.groupBy("assessment_id").agg(F.min("created_at").alias("created_at"), newest.alias("v")).select(
        "assessment_id", "v.name", "v.status", "created_at", "v.updated_at", "v.payload")


def list_assessments(versions: DataFrame) -> DataFrame:
    return latest_assessments(versions).orderBy(F.desc("updated_at"), "assessment_id")


def export_lines(lines: DataFrame, path: str) -> None:
    """S12 ordered text export from `part, key, line_no, line`; part files follow the line order."""
    lines.orderBy("part", "key", "line_no").select("line").write.mode("overwrite").text(path)
