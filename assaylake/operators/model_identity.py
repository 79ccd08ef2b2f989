"""B1 identity of model files from their raw bytes; nothing is parsed or loaded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import EXTENSION_FORMATS, SAFETENSORS_MAX_HEADER
from ..functions.hashing import normalize_digest
from ..functions.text import extension


def _header_length(content: Column) -> Column:
    """First eight bytes as a little-endian number (decimal, it may exceed a bigint)."""
    hexed = F.hex(F.substring(content, 1, 8))
    swapped = F.concat(*[F.substring(hexed, 15 - 2 * i, 2) for i in range(8)])
    return F.conv(swapped, 16, 10).cast("decimal(20,0)")


def content_signature(content: Column, size: Column) -> Column:
    """B1.2 leading-byte signature, tested in this order: safetensors-like, zip, pickle 2-5."""
    head = F.hex(F.substring(content, 1, 9))
    length = _header_length(content)
    limit = F.least(size - 8, F.lit(SAFETENSORS_MAX_HEADER))
    tensors = (size >= 9) & (length > 0) & (length <= limit) & (F.substring(head, 17, 2) == "7B")
    pickled = (F.substring(head, 1, 2) == "80") & F.substring(head, 3, 2).isin("02", "03", "04", "05")
    return (F.when(tensors, "safetensors_like_header").when(F.startswith(head, F.lit("504B0304")), "zip_container")
            .when(pickled, "pickle_stream"))


def model_identity(files: DataFrame) -> DataFrame:
    """B1.1 `path, content` to identity columns; the extension is only a hint for the format.

    `content` may be replaced by `sha256, size_bytes, head` for files hashed in chunks.
    """
    chunked = "head" in files.columns
    head = F.col("head") if chunked else F.col("content")
    digest = F.col("sha256") if chunked else F.sha2("content", 256)
    size = F.col("size_bytes") if chunked else F.length("content").cast("long")
    formats = F.create_map(*[F.lit(v) for e, (f, c) in EXTENSION_FORMATS.items() for v in (e, f"{f}|{c}")])
    hint = F.split(F.coalesce(F.try_element_at(formats, extension(F.col("path"))), F.lit("unknown|unknown")), r"\|")
    return files.select(
        "path", F.concat(F.lit("sha256:"), digest).alias("model_id"), digest.alias("sha256"), size.alias("file_size_bytes"),
        extension(F.col("path")).alias("extension"), hint[0].alias("format"), hint[1].alias("format_confidence"),
        content_signature(head, size).alias("content_signature"))


def verify_models(identities: DataFrame, expected: DataFrame) -> DataFrame:
    """B1.3 against `path, expected_sha256`: completed (no request), verified, mismatch or error."""
    joined = identities.join(expected, "path", "left")
    wanted = normalize_digest(F.col("expected_sha256"))
    status = (F.when(F.col("expected_sha256").isNull(), "completed").when(wanted.isNull(), "error")
              .when(wanted == F.col("sha256"), "verified").otherwise("mismatch"))
    return joined.withColumn("expected", wanted).withColumn("status", status).withColumn(
        "error_code", F.when(F.col("status") == "error", "invalid_expected_sha256"))
