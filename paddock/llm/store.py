"""Intermediate tables in the shared folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from paddock.llm.memory import released
from paddock.session import SHUFFLE_CLEANUP, shared_dir, with_conf


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet below the shared folder and read again: later jobs survive lost executors. The shuffled files
    of the write go as it ends."""
    path = f"{shared_dir(df.sparkSession)}/paddock-llm/{name}-{uuid.uuid4().hex}"
    with with_conf(df.sparkSession, {SHUFFLE_CLEANUP: "true"}):
        df.write.parquet(path)
    released()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(columns: list[str], name: str) -> str:
    """name, or the first of name_, name__, ... that no column has (Spark compares names without case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
