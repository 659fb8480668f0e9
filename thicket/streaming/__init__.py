"""Models over streams: prediction is a stateless projection, so a batch-trained model runs unchanged on readStream."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def predict_stream(stream: DataFrame, model: Column | str, out: str = "prediction") -> DataFrame:
    """stream has `have`, the features of a row; model is the expression of a model, as a column or as SQL."""
    return stream.withColumn(out, (F.expr(model) if isinstance(model, str) else model).cast("int"))
