"""Tables written to the shared checkpoint folder, so that a lost executor re-reads files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from maskweave.session import checkpoint_dir


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet into the session's checkpoint folder and read back; this cuts the lineage."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
