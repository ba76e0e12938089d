"""Shared working storage.

Everything an operator keeps between two jobs goes to the folder that the session names in
``spark.checkpoint.dir``, which the driver and all executors share.  A lost executor therefore
costs only the tasks it was running.
"""

from __future__ import annotations

import itertools
import uuid

from pyspark.sql import DataFrame

from quillspark.storage import opened, shared_folder


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (f"_{name}{'_' * i}" for i in itertools.count()) if n not in taken)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to shared storage and read it back: cuts the lineage and fixes the rows."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class AtomicFile:
    """A file that appears under its name only when complete, so that a retried task simply replaces it."""

    def __init__(self, folder: str, name: str):
        self.fs, base = opened(folder)
        self.fs.create_dir(base, recursive=True)
        self.final, self.temporary = f"{base}/{name}", f"{base}/.{name}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temporary, compression=None)

    def write(self, data: bytes) -> None:
        self.out.write(data)

    def commit(self) -> None:
        self.out.close()
        self.fs.move(self.temporary, self.final)

    def discard(self) -> None:
        self.out.close()
        self.fs.delete_file(self.temporary)
