"""Token counts of whole texts: Arrow batches in, lengths out; ids never leave the task.

Input partitions hold about equal bytes of files; inside a task texts are taken in slices of bounded bytes, cut at safe
boundaries and encoded in batches of bounded bytes (`tokens`), so a very long text is many short encodings.

Defined cases: null and empty texts have 0 bytes and 0 tokens; repeated rows are counted each; an empty table gives
none; null ids are carried through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from . import words as W


def token_counts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", limit: int = 2048, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit for every row."""
    path = vocabulary or tokens.vocabulary_path()

    def count(batches):
        encoder = tokens.encoder(path)
        for batch in batches:
            column = W.text_column(batch.column("text"))
            found = [encoder.counts(part) for _, part in tokens.slices(column)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pc.binary_length(column).cast(pa.int64()),
                 pa.array(np.concatenate([*found, np.zeros(0, np.int64)]).astype(np.int64))], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    counted = rows.mapInArrow(count, T.StructType([rows.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
