"""Operator inputs derived from the given tables, in Spark and in SQL.

The tables hold no images: documents stand for asset files, their text for the pixels, embeddings for
features, tensors and model outputs, and events for record streams.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import chain as chains
from ..operators.ordering import position_in_group
from ..session import widen
from .catalog import Tables

# --- files and hashes -----------------------------------------------------------------------
MANIFEST = """manifest AS (
  SELECT source || '/' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || '.txt' AS path, sha256(text) AS sha256,
         CAST(strlen(text) AS BIGINT) AS size_bytes FROM documents)"""

_BRIGHT = "aeiou "
# 8 x 9 cells of equal length over the whole text; a cell is as bright as its number of vowels and blanks
HASHED = f"""cells AS (
  SELECT doc_id, list_transform(range(72), lambda c: length(substring(text, CAST(c * length(text) // 72 AS BIGINT) + 1,
      CAST((c + 1) * length(text) // 72 - c * length(text) // 72 AS BIGINT)))
      - length(translate(substring(text, CAST(c * length(text) // 72 AS BIGINT) + 1,
      CAST((c + 1) * length(text) // 72 - c * length(text) // 72 AS BIGINT)), '{_BRIGHT}', ''))) AS b FROM documents),
bits AS (
  SELECT doc_id, list_sum(list_transform(range(64), lambda i: CASE
      WHEN b[CAST(i // 8 * 9 + i % 8 + 1 AS BIGINT)] > b[CAST(i // 8 * 9 + i % 8 + 2 AS BIGINT)]
      THEN CAST(1 AS HUGEINT) << CAST(63 - i AS INTEGER) ELSE 0 END)) AS v FROM cells),
hashed AS (
  SELECT d.doc_id, d.source || '/' || lpad(CAST(d.doc_id AS VARCHAR), 8, '0') || '.txt' AS path, d.lang, d.source, d.n_chars,
         CAST(CASE WHEN v >= CAST(9223372036854775808 AS HUGEINT) THEN v - CAST(18446744073709551616 AS HUGEINT) ELSE v END AS BIGINT) AS hash
  FROM bits JOIN documents d USING (doc_id))"""


def doc_path():
    return F.format_string("%s/%08d.txt", "source", "doc_id").alias("path")


def manifest(t: Tables) -> DataFrame:
    return t.documents.select(doc_path(), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"),
                              F.octet_length("text").cast("long").alias("size_bytes"))


_IS_BRIGHT = np.array([chr(c) in _BRIGHT for c in range(128)] + [False])


@F.pandas_udf(T.LongType())
def _grid_hash(texts: pd.Series) -> pd.Series:
    """The 64 comparisons of neighbouring cells of each text, first one highest; a missing text has none."""
    def of(text: str | None) -> int:
        if text is None:
            return 0
        points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
        before = np.concatenate([[0], np.cumsum(_IS_BRIGHT[np.minimum(points, 128)])])
        cells = np.diff(before[np.arange(73) * len(points) // 72]).reshape(8, 9)
        return int.from_bytes(np.packbits(cells[:, :-1] > cells[:, 1:]).tobytes(), "big", signed=True)

    return pd.Series([of(text) for text in texts], dtype="int64")


def hashed(t: Tables) -> DataFrame:
    """Documents with the difference hash of their text grid."""
    return widen(t.documents).select("doc_id", doc_path(), "lang", "source", "n_chars", _grid_hash("text").alias("hash"))


# --- labels ---------------------------------------------------------------------------------
_LABEL_TEXT = """CASE
    WHEN l.doc_id IS NULL THEN NULL
    WHEN d.n_chars < 200 THEN '   '
    WHEN d.n_chars > 20000 THEN CAST(quality AS VARCHAR) || ' 0.5 0.5 0.25'
    WHEN d.n_chars > 10000 THEN CAST(quality AS VARCHAR) || ' 0.5 wide 0.25 0.25'
    WHEN d.n_chars > 6000 THEN CAST(quality AS VARCHAR) || ' 0.5 1.5 0 0.25'
    WHEN toxic = 1 THEN CAST(quality AS VARCHAR) || ' 0.5 0.5 0.25 0.25' || chr(10) || '2 0.12345678 0.5 0.5 0.5'
    ELSE CAST(quality AS VARCHAR) || ' 0.5 0.5 0.25 0.25' END"""
LABEL_FILES = f"""label_files AS (
  SELECT d.source || '/' || lpad(CAST(d.doc_id AS VARCHAR), 8, '0') || '.txt' AS image, d.n_chars, l.quality, l.toxic,
         {_LABEL_TEXT} AS text FROM documents d LEFT JOIN labels l USING (doc_id))"""
# letter counts of the whole text stand for an appearance histogram
_LETTERS = "aeinortsl "
FEATURES = """features AS (
  SELECT doc_id, [""" + ", ".join(
    f"CAST(length(text) - length(replace(text, '{c}', '')) AS DOUBLE)" for c in _LETTERS) + """] AS features FROM documents)"""


def label_files(t: Tables) -> DataFrame:
    labels = t.labels.select("doc_id", "quality", "toxic", F.lit(True).alias("has_label"))
    quality = F.col("quality").cast("string")
    n = F.col("n_chars")
    text = (F.when(F.col("has_label").isNull(), F.lit(None)).when(n < 200, F.lit("   "))
            .when(n > 20000, F.concat(quality, F.lit(" 0.5 0.5 0.25")))
            .when(n > 10000, F.concat(quality, F.lit(" 0.5 wide 0.25 0.25")))
            .when(n > 6000, F.concat(quality, F.lit(" 0.5 1.5 0 0.25")))
            .when(F.col("toxic") == 1, F.concat(quality, F.lit(" 0.5 0.5 0.25 0.25\n2 0.12345678 0.5 0.5 0.5")))
            .otherwise(F.concat(quality, F.lit(" 0.5 0.5 0.25 0.25"))))
    return t.documents.join(labels, "doc_id", "left").select(doc_path().alias("image"), text.alias("text"))


_LETTER_BYTES = np.frombuffer(_LETTERS.encode("ascii"), dtype=np.uint8)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _letter_counts(texts: pd.Series) -> pd.Series:
    """How often each of _LETTERS is in a text, all in one pass over its bytes (no other character of UTF-8 has those); nulls for a missing text."""
    def of(text: str | None) -> list[float | None]:
        if text is None:
            return [None] * len(_LETTER_BYTES)
        counts = np.bincount(np.frombuffer(text.encode("utf-8"), dtype=np.uint8), minlength=256)
        return counts[_LETTER_BYTES].astype(float).tolist()

    return pd.Series([of(text) for text in texts], dtype=object)


def features(t: Tables) -> DataFrame:
    return widen(t.documents).select(doc_path().alias("image"), "source", _letter_counts("text").alias("features"))


# --- contributors and metadata --------------------------------------------------------------
CONTRIBUTORS = """contributors AS (
  SELECT source || '/' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || '.txt' AS file,
         CASE WHEN n_chars < 120 THEN 'UNKNOWN' ELSE source END AS contributor, lang AS class,
         CASE WHEN n_chars > 1000 THEN '2024-01-01' ELSE '' END AS timestamp, sha256(text) AS sha256 FROM documents)"""


def contributors(t: Tables) -> DataFrame:
    n = F.col("n_chars")
    return t.documents.select(
        doc_path().alias("file"), F.when(n < 120, F.lit(" ")).otherwise(F.col("source")).alias("contributor"),
        F.col("lang").alias("class"), F.when(n > 1000, F.lit("2024-01-01")).otherwise(F.lit("")).alias("timestamp"),
        F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


METADATA = """metadata AS (
  SELECT source || '/' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || CASE WHEN n_chars > 8000 THEN '.png' WHEN lang = 'en' THEN '.JPEG' ELSE '.jpg' END AS file,
    source AS contributor, CASE WHEN lang = 'es' THEN 'PNG' ELSE 'JPEG' END AS format,
    CAST(least(n_chars // 500, 12) AS VARCHAR) || 'x' || CAST(least(n_chars // 2000, 4) AS VARCHAR) AS resolution,
    CASE WHEN n_chars > 1500 THEN 'RGB' ELSE 'L' END AS mode, 'Cam' || upper(lang) AS camera,
    CASE WHEN contains(lower(text), 'license') THEN 'Adobe Photoshop 25' WHEN n_chars < 300 THEN 'GIMP 2.10' ELSE 'none' END AS software,
    substr(sha256(text), 1, 1) AS quant_hash, CASE WHEN n_chars > 700 THEN 'yes' ELSE 'no' END AS has_exif,
    CASE WHEN n_chars > 700 THEN 1700000000.0 + n_chars * 3600.0 END AS capture_epoch FROM documents)"""


def metadata(t: Tables) -> DataFrame:
    n = F.col("n_chars")
    suffix = F.when(n > 8000, ".png").when(F.col("lang") == "en", ".JPEG").otherwise(".jpg")
    return t.documents.select(
        F.concat(F.format_string("%s/%08d", "source", "doc_id"), suffix).alias("file"), F.col("source").alias("contributor"),
        F.when(F.col("lang") == "es", "PNG").otherwise("JPEG").alias("format"),
        F.concat(F.least(F.floor(n / 500), F.lit(12)).cast("string"), F.lit("x"), F.least(F.floor(n / 2000), F.lit(4)).cast("string")).alias("resolution"),
        F.when(n > 1500, "RGB").otherwise("L").alias("mode"), F.concat(F.lit("Cam"), F.upper("lang")).alias("camera"),
        F.when(F.contains(F.lower("text"), F.lit("license")), "Adobe Photoshop 25").when(n < 300, "GIMP 2.10").otherwise("none").alias("software"),
        F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 1).alias("quant_hash"),
        F.when(n > 700, "yes").otherwise("no").alias("has_exif"),
        F.when(n > 700, F.lit(1700000000.0) + n * 3600.0).alias("capture_epoch"))


# --- region candidates ----------------------------------------------------------------------
# every document is one file with one region; its hash is the descriptor, its centre lies on the window grid
REGIONS = HASHED + """,
regions AS (
  SELECT path AS file, 0 AS region_no, CAST(20 + least(n_chars // 50, 60) AS DOUBLE) AS peak_hf, CAST(least(n_chars // 200, 14) * 8 AS INTEGER) AS y0,
         CAST(length(source) * 8 AS INTEGER) AS x0, (length(source) * 8 + 8) / 128.0 AS cx, (least(n_chars // 200, 14) * 8 + 8) / 128.0 AS cy,
         CASE WHEN n_chars < 100 THEN NULL ELSE hash END AS descriptor, lang AS label FROM hashed)"""


def regions(t: Tables) -> DataFrame:
    n = F.col("n_chars")
    return hashed(t).select(
        F.col("path").alias("file"), F.lit(0).alias("region_no"), (F.least(F.floor(n / 50), F.lit(60)) + 20).cast("double").alias("peak_hf"),
        (F.least(F.floor(n / 200), F.lit(14)) * 8).cast("int").alias("y0"), (F.length("source") * 8).cast("int").alias("x0"),
        ((F.length("source") * 8 + 8) / 128.0).alias("cx"), ((F.least(F.floor(n / 200), F.lit(14)) * 8 + 8) / 128.0).alias("cy"),
        F.when(n >= 100, F.col("hash")).alias("descriptor"), F.col("lang").alias("label"))


# --- predictions, tensors -------------------------------------------------------------------
def _softmax_sql(scale: str) -> str:
    return (f"list_transform(embedding, lambda x: exp({scale} * CAST(x AS DOUBLE) - list_max(list_transform(embedding, lambda y: {scale} * CAST(y AS DOUBLE)))))")


def _prediction_select(model: str, probe: str, scale: str) -> str:
    return f"SELECT '{model}' AS model_id, '{probe}' AS probe, vec_id AS image_idx, {_softmax_sql(scale)} AS e FROM embeddings"


_MODELS = (
    ("reference", "clean", 8.0), ("reference", "inverted", -8.0), ("reference", "sharpened", 16.0),
    ("assessed", "clean", 8.0), ("assessed", "inverted", -2.0), ("assessed", "sharpened", 12.0),
)
PREDICTIONS = "raw_predictions AS (" + " UNION ALL ".join(_prediction_select(m, p, f"({s})") for m, p, s in _MODELS) + """),
predictions AS (
  SELECT model_id, probe, image_idx, probs, CAST(list_position(probs, list_max(probs)) - 1 AS INTEGER) AS predicted_class
  FROM (SELECT model_id, probe, image_idx, list_transform(e, lambda x: x / list_sum(e)) AS probs FROM raw_predictions))"""


def predictions(t: Tables) -> DataFrame:
    """Two models and three probes over all embeddings: softmax of the vector at different temperatures."""
    from ..functions.numeric import argmax, softmax
    variants = F.array(*[F.struct(F.lit(m).alias("model_id"), F.lit(p).alias("probe"), F.lit(s).alias("scale")) for m, p, s in _MODELS])
    scaled = F.transform("embedding", lambda x: x.cast("double") * F.col("scale"))
    return (widen(t.embeddings).select("vec_id", "embedding", F.explode(variants).alias("v"))
            .select("v.*", F.col("vec_id").alias("image_idx"), "embedding")
            .select("model_id", "probe", "image_idx", softmax(scaled).alias("probs"))
            .withColumn("predicted_class", argmax(F.col("probs"))))


# a tensor per label; the assessed model differs by rule in scale, zeros and non-finite values
CHUNKS = """chunks AS (
  SELECT 'reference' AS model_id, 'layer' || CAST(label AS VARCHAR) || '.weight' AS tensor_name, vec_id AS chunk_no,
         list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vals FROM embeddings
  UNION ALL
  SELECT 'assessed', 'layer' || CAST(label AS VARCHAR) || CASE WHEN label = 9 THEN '.bias' ELSE '.weight' END, vec_id,
         list_transform(embedding, lambda x: CASE WHEN label = 1 AND x > 0.35 THEN CAST('inf' AS DOUBLE)
           WHEN label = 2 AND x > 0.35 THEN CAST('nan' AS DOUBLE) WHEN label = 3 AND abs(x) < 0.02 THEN 0.0
           WHEN label = 4 THEN CAST(x AS DOUBLE) * 1.5 ELSE CAST(x AS DOUBLE) END) FROM embeddings)"""


def chunks(t: Tables) -> DataFrame:
    name = F.concat(F.lit("layer"), F.col("label").cast("string"))
    plain = t.embeddings.select(
        F.lit("reference").alias("model_id"), F.concat(name, F.lit(".weight")).alias("tensor_name"), F.col("vec_id").alias("chunk_no"),
        F.transform("embedding", lambda x: x.cast("double")).alias("values"))
    label = F.col("label")
    changed = F.transform("embedding", lambda x: (
        F.when((label == 1) & (x > 0.35), F.lit(float("inf"))).when((label == 2) & (x > 0.35), F.lit(float("nan")))
        .when((label == 3) & (F.abs(x) < 0.02), F.lit(0.0)).when(label == 4, x.cast("double") * 1.5).otherwise(x.cast("double"))))
    other = t.embeddings.select(
        F.lit("assessed").alias("model_id"), F.concat(name, F.when(label == 9, ".bias").otherwise(".weight")).alias("tensor_name"),
        F.col("vec_id").alias("chunk_no"), changed.alias("values"))
    return plain.unionByName(other)


# --- shift ----------------------------------------------------------------------------------
_FEATURE_SQL = {
    "brightness": "least({v} / 200.0, 1.0)", "contrast": "CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100.0",
    "saturation": "hour(ts) / 24.0", "edge_density": "least({v} * {v} / 40000.0, 1.0)",
}


def shift_rows_sql(name: str, scale: str) -> str:
    """First half of the month as reference, second half as candidates with values times `scale`."""
    late = "day(ts) > 15"
    value = f"(CASE WHEN {late} THEN value * {scale} ELSE value END)"
    columns = ", ".join(f"{sql.format(v=value)} AS {f}" for f, sql in _FEATURE_SQL.items())
    return f"{name} AS (SELECT CASE WHEN {late} THEN 'candidate' ELSE 'reference' END AS population, event_id AS file, {columns} FROM events)"


def shift_rows(t: Tables, scale: float = 1.0) -> DataFrame:
    from ..fixed_values import SHIFT_FEATURES, SHIFT_HISTOGRAMS
    from ..functions.numeric import histogram_bin
    late = F.dayofmonth("ts") > 15
    value = F.when(late, F.col("value") * scale).otherwise(F.col("value"))
    rows = t.events.select(
        F.when(late, "candidate").otherwise("reference").alias("population"), F.col("event_id").alias("file"),
        F.least(value / 200.0, F.lit(1.0)).alias("brightness"),
        (F.get_json_object("props", "$.k").cast("double") / 100.0).alias("contrast"), (F.hour("ts") / 24.0).alias("saturation"),
        F.least(value * value / 40000.0, F.lit(1.0)).alias("edge_density"))

    def one_hot(feature):
        return F.transform(F.sequence(F.lit(0), F.lit(15)), lambda b: (histogram_bin(F.col(feature), 16) == b).cast("double"))

    hists = [one_hot(f).alias(h) for f, h in zip(SHIFT_FEATURES, SHIFT_HISTOGRAMS)]
    return rows.select("*", *hists)


# --- hash-linked records --------------------------------------------------------------------
RECORDS = """numbered AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events),
unlinked AS (
  SELECT CAST(user_id AS VARCHAR) AS chain_id, pos, event_type, value, pos + 1 AS sequence, substr(sha256('n' || CAST(event_id AS VARCHAR)), 1, 32) AS nonce,
    strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS timestamp, sha256(props) AS input_digest, 'model-' || event_type AS model_id,
    sha256(event_type) AS preprocessing_digest, sha256(CAST(event_id AS VARCHAR)) AS output_digest FROM numbered),
linked AS (
  SELECT chain_id, pos, repeat('0', 64) AS previous_record_hash, record_hash FROM (
    SELECT chain_id, pos, sha256('{"input_digest":"' || input_digest || '","model_id":"' || model_id || '","nonce":"' || nonce || '","output_digest":"' || output_digest
      || '","preprocessing_digest":"' || preprocessing_digest || '","previous_record_hash":"' || repeat('0', 64) || '","sequence":' || CAST(sequence AS VARCHAR)
      || ',"timestamp":"' || timestamp || '"}') AS record_hash FROM unlinked WHERE pos = 0)
  UNION ALL
  SELECT u.chain_id, u.pos, l.record_hash, sha256('{"input_digest":"' || input_digest || '","model_id":"' || model_id || '","nonce":"' || nonce || '","output_digest":"' || output_digest
      || '","preprocessing_digest":"' || preprocessing_digest || '","previous_record_hash":"' || l.record_hash || '","sequence":' || CAST(sequence AS VARCHAR)
      || ',"timestamp":"' || timestamp || '"}') FROM linked l JOIN unlinked u ON u.chain_id = l.chain_id AND u.pos = l.pos + 1),
records AS (
  SELECT u.chain_id, u.pos, u.event_type, u.value, u.sequence, u.nonce, u.timestamp, u.input_digest, u.model_id, u.preprocessing_digest, u.output_digest,
         l.previous_record_hash, l.record_hash FROM unlinked u JOIN linked l USING (chain_id, pos))"""

# changed after linking, by event type and value: another model, another link, a gap, a reused nonce
TAMPERED = RECORDS + """,
tampered AS (
  SELECT chain_id, pos, timestamp, input_digest, preprocessing_digest, output_digest, record_hash,
    CASE WHEN event_type = 'error' AND value > 150 THEN 'model-other' ELSE model_id END AS model_id,
    CASE WHEN event_type = 'click' AND value > 200 THEN repeat('f', 64) ELSE previous_record_hash END AS previous_record_hash,
    CASE WHEN event_type = 'view' AND value > 200 THEN sequence + 1 ELSE sequence END AS sequence,
    CASE WHEN event_type = 'purchase' AND value > 120 THEN 'reused' ELSE nonce END AS nonce FROM records)"""

RECORD_HASH_SQL = """sha256('{"input_digest":"' || input_digest || '","model_id":"' || model_id || '","nonce":"' || nonce || '","output_digest":"' || output_digest
      || '","preprocessing_digest":"' || preprocessing_digest || '","previous_record_hash":"' || previous_record_hash || '","sequence":' || CAST(sequence AS VARCHAR)
      || ',"timestamp":"' || timestamp || '"}')"""


def unlinked(t: Tables) -> DataFrame:
    text = lambda c: F.sha2(c.cast("string").cast("binary"), 256)
    placed = position_in_group(t.events, ["user_id"], [F.col("ts"), F.col("event_id")])
    return placed.select(
        F.col("user_id").cast("string").alias("chain_id"), "pos", "event_type", "value", (F.col("pos") + 1).alias("sequence"),
        F.substring(text(F.concat(F.lit("n"), F.col("event_id"))), 1, 32).alias("nonce"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("timestamp"), text(F.col("props")).alias("input_digest"),
        F.concat(F.lit("model-"), F.col("event_type")).alias("model_id"), text(F.col("event_type")).alias("preprocessing_digest"),
        text(F.col("event_id")).alias("output_digest"))


def records(t: Tables) -> DataFrame:
    return chains.build_chain(unlinked(t), chains.PROVENANCE)


def tampered(t: Tables) -> DataFrame:
    kind, value = F.col("event_type"), F.col("value")
    hit = lambda k, v: (kind == k) & (value > v)
    return records(t).withColumns({
        "model_id": F.when(hit("error", 150), "model-other").otherwise(F.col("model_id")),
        "previous_record_hash": F.when(hit("click", 200), "f" * 64).otherwise(F.col("previous_record_hash")),
        "sequence": F.when(hit("view", 200), F.col("sequence") + 1).otherwise(F.col("sequence")),
        "nonce": F.when(hit("purchase", 120), "reused").otherwise(F.col("nonce"))}).drop("event_type", "value")
