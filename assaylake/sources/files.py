"""File sources: discovery, bytes, images, label texts, manifests and record files."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed_values import IMAGE_EXTENSIONS
from ..functions.text import extension
from ..session import shuffle_partitions

ROW_BYTES = 2_000_000_000
CHUNK_BYTES = 1 << 20
HEAD_BYTES = 16


def relative_path(root: str, path: Column | None = None) -> Column:
    """Path below `root` without the scheme."""
    column = path if path is not None else F.col("path")
    prefix = root.rstrip("/") + "/"
    at = F.position(F.lit(prefix), column)
    return F.when(at > 0, F.substring(column, at + len(prefix), F.length(column))).otherwise(column)


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """S3 every file below the root: `path, content, length, modificationTime`, path made relative."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
            .withColumn("full_path", F.col("path")).withColumn("path", relative_path(root)))


def discover_images(spark: SparkSession, root: str) -> DataFrame:
    """S1 image files by suffix."""
    return read_files(spark, root).where(extension(F.col("path")).isin(*IMAGE_EXTENSIONS))


def read_images(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """S2 decoded images (`path, height, width, channels, mode, data`) and the files that did not decode."""
    raw = (spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").load(root)
           .select("image.*").withColumn("path", relative_path(root, F.col("origin"))))
    raw = raw.where(extension(F.col("path")).isin(*IMAGE_EXTENSIONS))
    good = raw.where("width > 0").select("path", "height", "width", F.col("nChannels").alias("channels"), "mode", "data")
    skipped = raw.where("width <= 0 or width is null").select("path", F.lit("unreadable_or_unsupported").alias("reason"))
    return good, skipped


def _open(path: str):
    """A file of the listing as a stream."""
    from pyarrow import fs
    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    system, place = fs.FileSystem.from_uri(quote(path, safe=":/@"))
    return system.open_input_file(place)


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 and first bytes of each listed file, read in chunks."""
    for pdf in batches:
        found = []
        for path in pdf["full_path"]:
            digest, head = hashlib.sha256(), None
            with _open(path) as file:
                while chunk := file.read(CHUNK_BYTES):
                    head = chunk[:HEAD_BYTES] if head is None else head
                    digest.update(chunk)
            found.append((digest.hexdigest(), head or b""))
        yield pdf[["path"]].assign(sha256=[d for d, _ in found], size_bytes=pdf["size_bytes"], head=[h for _, h in found])


def hash_files(spark: SparkSession, root: str, *, row_bytes: int = ROW_BYTES) -> DataFrame:
    """S3 / A1.1 `path, sha256, size_bytes, head` of all files, of any size; no content column leaves this step.

    Files that fit a row are read and hashed in the JVM; larger ones are listed without their content and each is read
    in chunks by the task that gets it. The digest is the same either way.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    fits = F.col("length") < row_bytes
    hashed = listed.where(fits).select(relative_path(root).alias("path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"),
                                       F.substring("content", 1, HEAD_BYTES).alias("head"))
    large = listed.where(~fits).select(relative_path(root).alias("path"), F.col("path").alias("full_path"), F.col("length").alias("size_bytes"))
    chunked = large.repartition(shuffle_partitions(spark), "path").mapInPandas(_digests, "path string, sha256 string, size_bytes long, head binary")
    return hashed.unionByName(chunked)


def read_label_texts(spark: SparkSession, root: str) -> DataFrame:
    """S5 whole label files as `stem, text`, stem relative to the label folder."""
    texts = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(root, wholetext=True)
    path = relative_path(root, F.col("_metadata.file_path"))
    return texts.select(F.regexp_replace(path, r"\.txt$", "").alias("stem"), F.col("value").alias("text"))


def attach_label_texts(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Images with their label text by relative path without suffix; null text when there is none."""
    stem = F.regexp_replace("image", r"\.[^./]*$", "")
    return images.select("image", stem.alias("stem")).join(labels, "stem", "left").select("image", "text")
