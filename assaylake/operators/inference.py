"""U1 model inference on batches: a user's predict function run by Spark over the rows of a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def predicted(rows: DataFrame, column: str, make_predict: Callable, classes: int, *, width: int, batch_size: int = 1024) -> DataFrame:
    """The rows with `scores` (array of `classes` doubles) and `predicted_class` (first of the highest).

    `make_predict()` runs once for each Python worker and returns a function from a (batch, width) array to a
    (batch, classes) array; that is where a model is loaded. Rows without input get nulls.
    """
    run = predict_batch_udf(make_predict, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size, input_tensor_shapes=[[width]])
    usable = F.col(column).isNotNull() & (F.size(column) == width)
    zeros = F.array_repeat(F.lit(0.0), width)
    scored = rows.withColumn("scores", run(F.when(usable, F.col(column).cast("array<double>")).otherwise(zeros)))
    scored = scored.withColumn("scores", F.when(usable, F.col("scores")))
    best = F.array_position("scores", F.array_max("scores")) - 1
    return scored.withColumn("predicted_class", F.when(usable, best).cast("int"))
