"""Working storage that the driver and all executors share."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession


#: Folders made within each open ``temporary`` block, the innermost last.
_MADE: list[list[str]] = []


@contextlib.contextmanager
def temporary():
    """A list of the folders that the driver makes in shared storage meanwhile; those that are still in it at the end are deleted."""
    made: list[str] = []
    _MADE.append(made)
    try:
        yield made
    finally:
        _MADE.remove(made)
        for folder in made:
            fs, path = opened(folder)
            if fs.get_file_info(path).type == pafs.FileType.Directory:
                fs.delete_dir(path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``; where that is unset, below a temporary folder if all of Spark runs on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "quillspark-shared")
    folder = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _MADE:
        _MADE[-1].append(folder)
    return folder


def kept(df: DataFrame, name: str = "kept") -> DataFrame:
    """``df``, written once to shared storage and read back: cuts the lineage, so a lost executor repeats nothing before it."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread_out(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores where its input comes in fewer splits than there are cores, as a small file does; a large input is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path in it that a URI names; a bare path is local."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def write_shared(path: str, data: bytes) -> None:
    """A file that appears under its name only when complete, so that a retried task simply replaces it."""
    fs, final = opened(path)
    folder, name = final.rsplit("/", 1)
    fs.create_dir(folder, recursive=True)
    temporary = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(temporary, compression=None) as f:
        f.write(data)
    fs.move(temporary, final)


def read_shared(path: str) -> bytes:
    fs, p = opened(path)
    with fs.open_input_file(p) as f:
        return f.read()


def shared_files(folder: str) -> list[str]:
    """The names of the complete files of a folder, sorted; none where it isn't there."""
    fs, p = opened(folder)
    found = fs.get_file_info(pafs.FileSelector(p, allow_not_found=True))
    return sorted(f.base_name for f in found if f.is_file and not f.base_name.startswith("."))


def read_arrow(path: str) -> pa.Table:
    return pa.ipc.open_stream(read_shared(path)).read_all().combine_chunks()


def grouped_files(df: DataFrame, group: str, order: list[str], rows: int, name: str, whole: bool = True) -> str:
    """A shared folder to which tasks write ``df`` in files of about ``rows`` rows, each group whole in one file and sorted; ``group`` is the first
    column.  Without ``whole`` a group may go over several files and tasks, whatever its size.  Files are named by place, so a repeated task writes the same ones again."""
    folder = shared_folder(df.sparkSession, name)

    def write(batches):
        task, held, n = TaskContext.get().partitionId(), [], 0

        def put(table: pa.Table, all_of_it: bool) -> pa.Table:
            nonlocal n
            while table.num_rows >= (1 if all_of_it else 2 * rows):
                cut, groups = min(rows, table.num_rows), table.column(0)
                while whole and cut < table.num_rows and groups[cut].as_py() == groups[cut - 1].as_py():
                    cut += 1
                if whole and cut == table.num_rows and not all_of_it:
                    break  # the group may go on
                out = pa.BufferOutputStream()
                with pa.ipc.new_stream(out, table.schema) as f:
                    f.write_table(table.slice(0, cut))
                write_shared(f"{folder}/{task:06d}-{n:06d}.arrow", out.getvalue().to_pybytes())
                table, n = table.slice(cut), n + 1
            return table

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= 2 * rows:
                held = put(pa.Table.from_batches(held), False).to_batches()
        if held:
            put(pa.Table.from_batches(held), True)
        yield from ()

    dealt = df.repartition(group) if whole else df.repartitionByRange(group, *order)
    dealt.sortWithinPartitions(group, *order).mapInArrow(write, "done boolean").write.format("noop").mode("overwrite").save()
    return folder
