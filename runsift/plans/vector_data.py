"""Vector rows from the embeddings table: 8 depths of 8 numbers, label, group."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def vectors(embeddings: DataFrame) -> DataFrame:
    return embeddings.select(
        F.col("vec_id").alias("row_id"), (F.col("vec_id") % 29).alias("group_id"),
        F.when(F.col("label") < 5, 1).otherwise(0).alias("label"),
        F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda d: F.slice("embedding", d * 8 + 1, F.lit(8)))).alias("depth", "vec"),
    )


VECTORS_SQL = """
WITH v AS (SELECT vec_id AS row_id, vec_id % 29 AS group_id, CASE WHEN label < 5 THEN 1 ELSE 0 END AS label, d AS depth,
  list_transform(embedding[d * 8 + 1 : d * 8 + 8], lambda x: CAST(x AS DOUBLE)) AS vec FROM embeddings, (SELECT unnest(range(8)) AS d))
"""
