"""Concatenate and cut: the token stream of all documents in windows of fixed length.

Pass 1 encodes every document once and writes its ids with its offset inside its partition. The totals of the
partitions (one number each) give the partitions' offsets in the whole stream by a prefix sum, and pass 2 cuts: window
`w` holds the stream's tokens from w * length on, and a document that crosses a window's edge gives a boundary record
for each window it touches. All windows are full except the last.

Defined cases: null and empty texts are the end id alone; repeated rows are packed each; an empty table gives no
record; null ids are carried through.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from . import words as W
from .staging import arrow_rows, staged

_ENCODED = "part int, local_start long, doc_tokens long, ids binary"


def encoded(docs: DataFrame, *, doc_id: str, text: str, end_id: int, vocabulary: str) -> DataFrame:
    """Pass 1: ids of each document (little-endian unsigned 32 bits, end id last) and their place in the partition."""
    def encode(batches):
        encoder, part, at = tokens.encoder(vocabulary), TaskContext.get().partitionId(), 0
        for batch in batches:
            column, done = W.text_column(batch.column("text")), 0
            for _, piece in tokens.slices(column):
                ids, offsets = encoder.encode(piece)
                ids = np.insert(ids, offsets[1:], end_id).astype("<u4")
                offsets = offsets + np.arange(len(offsets))
                start = at + offsets[:-1]
                at += int(offsets[-1])
                binary = pa.Array.from_buffers(pa.binary(), len(piece), [None, pa.py_buffer((4 * offsets).astype(np.int32).tobytes()), pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(done, len(piece)), pa.array(np.full(len(piece), part, np.int32)),
                                                  pa.array(start.astype(np.int64)), pa.array(np.diff(offsets).astype(np.int64)), binary],
                                                 ["doc_id", "part", "local_start", "doc_tokens", "ids"])
                done += len(piece)

    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    schema = T.StructType([rows.schema["doc_id"], *T._parse_datatype_string(_ENCODED).fields])
    with arrow_rows(docs.sparkSession, 4000):
        return staged(rows.mapInArrow(encode, schema), "encoded", "zstd")


def packed(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = 2048, end_id: int = 1, vocabulary: str | None = None) -> DataFrame:
    """A row for each piece: doc_id, start and length in its document, its ids, doc_tokens, sequence_id and offset there."""
    stream = encoded(docs, doc_id=doc_id, text=text, end_id=end_id, vocabulary=vocabulary or tokens.vocabulary_path())
    totals = sorted(tuple(r) for r in stream.groupBy("part").agg(F.sum("doc_tokens")).collect())  # one row for each partition
    bases = itertools.accumulate([0, *(n for _, n in totals)])
    base = docs.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(totals, bases)], "part int, base long")
    rows = stream.join(F.broadcast(base), "part").withColumn("at", F.col("base") + F.col("local_start"))
    window = F.lit(length).cast("long")

    def piece(w):
        start = F.greatest(F.lit(0).cast("long"), w * window - F.col("at"))
        size = F.least(F.col("doc_tokens"), (w + 1) * window - F.col("at")) - start
        return F.struct(start.alias("start"), size.alias("length"), w.alias("sequence_id"), (F.col("at") + start - w * window).alias("offset"),
                        F.substring("ids", (4 * start + 1).cast("int"), (4 * size).cast("int")).alias("ids"))

    last = F.floor((F.col("at") + F.col("doc_tokens") - 1) / window).cast("long")
    pieces = rows.select("doc_id", "doc_tokens", F.explode(F.transform(F.sequence(F.floor(F.col("at") / window).cast("long"), last), piece)).alias("p"))
    return pieces.select("doc_id", "p.start", "p.length", "p.ids", "doc_tokens", "p.sequence_id", "p.offset")


def packing_report(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The pieces with the CRC-32 of their ids instead of the ids."""
    return packed(docs, doc_id=doc_id).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
