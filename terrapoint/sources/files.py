"""Opening files in tasks by path, wherever they are, and the footers of Parquet files without their data."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _local(path: str) -> str | None:
    """The local path that a plain or file: path names, None for a URI of a store."""
    scheme, _, rest = path.partition(":")
    if not rest or "/" in scheme:
        return path
    return "/" + rest.lstrip("/") if scheme == "file" else None


def _store(path: str):
    """Arrow's file system of a URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path.replace("s3a:", "s3:", 1) if path.startswith("s3a:") else path)


def opened(path: str):
    """A seekable binary file: a plain or file: path, or a URI of a store that Arrow knows (s3, s3a, gs, hdfs, abfs)."""
    if (local := _local(path)) is not None:
        return open(local, "rb")
    store, inner = _store(path)
    return store.open_input_file(inner)


def created(path: str):
    """A new binary file, written from front to back, with the folders above it; paths as for opened()."""
    if (local := _local(path)) is not None:
        os.makedirs(os.path.dirname(os.path.abspath(local)), exist_ok=True)
        return open(local, "wb")
    store, inner = _store(path)
    store.create_dir(inner.rpartition("/")[0], recursive=True)
    return store.open_output_stream(inner)


def files_below(spark: SparkSession, path: str, suffix: str = ".parquet") -> list[str]:
    """Paths of the data files below a folder, by Hadoop's file systems; folders and files that begin with _ or . are skipped."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    store = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out, left = [], [top]
    while left:
        for x in store.listStatus(left.pop()):
            name = x.getPath().getName()
            if name[0] in "_.":
                continue
            if x.isDirectory():
                left.append(x.getPath())
            elif name.endswith(suffix):
                out.append(x.getPath().toString())
    return sorted(out)


CHUNKS = "file string, row_group int, rows long, column_name string, compressed_bytes long, encodings string, least long, greatest long"


def footers(spark: SparkSession, path: str) -> DataFrame:
    """A row for each column of each row group of the files below path: its place in the file, rows, compressed bytes, encodings, and the
    least and greatest value of its statistics where they are integers. Tasks seek to the footers and read nothing else."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for batch in batches:
            for name in batch.column("file").to_pylist():
                with opened(name) as f:
                    meta = pq.ParquetFile(f).metadata
                out = []
                for i in range(meta.num_row_groups):
                    group = meta.row_group(i)
                    for k in range(group.num_columns):
                        c = group.column(k)
                        s = c.statistics
                        known = s is not None and s.has_min_max and isinstance(s.min, int) and not isinstance(s.min, bool)
                        out.append((name, i, group.num_rows, c.path_in_schema, c.total_compressed_size, ",".join(sorted(c.encodings)), s.min if known else None, s.max if known else None))
                kinds = (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [()] * 8, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in CHUNKS.split(", ")])

    names = files_below(spark, path)
    tasks = max(1, min(len(names), spark.sparkContext.defaultParallelism * 4))
    listed = spark.createDataFrame([(n,) for n in names], "file string").repartition(tasks, F.col("file"))
    return listed.mapInArrow(read, CHUNKS)
