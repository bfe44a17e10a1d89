"""Tables between steps of a loop, in the folder that driver and executors share, and sides of a checked size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a list of configuration is broadcast.
LIST_ROWS = 20_000
_OWN: dict[str, str] = {}


def listed(df: DataFrame, rows: int = LIST_ROWS) -> DataFrame:
    """``df``, marked for broadcast if it has at most so many rows, which is checked; beyond them Spark chooses."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def scratch_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _OWN.setdefault(spark.sparkContext.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="veldra-")
        _OWN[spark.sparkContext.applicationId] = root
    return root.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """``df`` written to ``spark.checkpoint.dir`` and read again: lineage ends there and lost executors lose nothing.
    Only on a single machine, where that is unset, a temporary folder takes its place."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/veldra/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
