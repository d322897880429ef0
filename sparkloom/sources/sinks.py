"""Writers: JSON lines, token streams, case files and Markdown reports."""

from __future__ import annotations

import json
import os
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows a report may have; reports are read by people.
MOST_REPORT_ROWS = 10_000


def write_json_lines(df: DataFrame, path: str, *, drop: tuple[str, ...] = (), ascii_only: bool = False) -> None:
    """One JSON object a line, keys in order, nulls left out, written by the executors."""
    cols = sorted(c for c in df.columns if c not in drop)
    line = F.to_json(F.struct(*cols))
    if ascii_only:
        line = _escape(line)
    df.select(line.alias("value")).write.mode("overwrite").text(path)


@F.pandas_udf(T.StringType())
def _escape(s):
    return s.map(lambda x: None if x is None else json.dumps(json.loads(x), sort_keys=True))


def write_cases(df: DataFrame, path: str) -> None:
    """{"cases": […]} for a bounded table of cases."""
    rows = [json.loads(r[0]) for r in df.select(F.to_json(F.struct(*df.columns))).limit(MOST_REPORT_ROWS + 1).collect()]
    if len(rows) > MOST_REPORT_ROWS:
        raise ValueError("too many cases for one file")
    save_json(path, {"cases": rows})


def save_json(path: str, payload) -> None:
    """Atomic write on the driver: a file beside it, then a rename."""
    files, root = _filesystem(path)
    files.create_dir(os.path.dirname(root), recursive=True)
    temporary = f"{root}.{uuid.uuid4().hex}"
    with files.open_output_stream(temporary) as f:
        f.write(json.dumps(payload, indent=2, sort_keys=True).encode())
    files.move(temporary, root)


def _filesystem(folder: str):
    """(file system, path) of a folder named by a path or by any URI that Arrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if ":/" in folder else (fs.LocalFileSystem(), os.path.abspath(folder))


def write_token_parts(stream: DataFrame, folder: str, parts: int) -> None:
    """Flat int32 files part-NNNNN.bin of a stream (pos, token): range-partitioned by pos, so the parts in name order are the stream.

    ``folder`` is a path or URI that the executors share. A part is written
    under a name of its attempt and renamed when it is whole.
    """
    ordered = stream.select(F.col("pos").cast("bigint"), F.col("token").cast("int")).repartitionByRange(parts, "pos").sortWithinPartitions("pos")

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        files, root = _filesystem(folder)
        n, name = 0, f"{root}/part-{TaskContext.get().partitionId():05d}.bin"
        temporary = f"{name}.{TaskContext.get().taskAttemptId()}"
        with files.open_output_stream(temporary) as f:
            for b in batches:
                f.write(b.column(1).to_numpy().astype("<i4").tobytes())
                n += b.num_rows
        files.move(temporary, name)
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    files, root = _filesystem(folder)
    files.create_dir(root, recursive=True)
    ordered.mapInArrow(write, "n bigint").collect()


def read_token_parts(folder: str) -> np.ndarray:
    names = sorted(n for n in os.listdir(folder) if n.endswith(".bin"))
    return np.concatenate([np.fromfile(os.path.join(folder, n), "<i4") for n in names]) if names else np.zeros(0, np.int32)


def write_files(df: DataFrame, folder: str) -> None:
    """One file per row (name, text), written by the executors, any number of them; a name may hold folders.

    ``folder`` is a path or URI that the executors share. Rows of one name meet
    in one task. A file is written under a name of its attempt, which hidden
    files have, and renamed when it is whole.
    """

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        files, root = _filesystem(folder)
        made, attempt = set(), TaskContext.get().taskAttemptId()
        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                inside, _, last = f"{root}/{name}".rpartition("/")
                if inside not in made:
                    files.create_dir(inside, recursive=True)
                    made.add(inside)
                temporary = f"{inside}/.{last}.{attempt}"
                with files.open_output_stream(temporary) as f:
                    f.write((text or "").encode())
                files.move(temporary, f"{inside}/{last}")
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    files, root = _filesystem(folder)
    files.create_dir(root, recursive=True)
    rows = df.select(F.col("name").cast("string"), F.col("text").cast("string")).repartition(df.sparkSession.sparkContext.defaultParallelism, "name")
    rows.mapInArrow(write, "n bigint").agg(F.sum("n")).collect()


def format_value(value) -> str:
    if value is None:
        return ""
    return f"{value:.6g}" if isinstance(value, float) else str(value)


def markdown(df: DataFrame) -> str:
    """Report table of a bounded result; floats with six digits, nulls empty, pipes escaped."""
    rows = df.limit(MOST_REPORT_ROWS + 1).collect()
    if len(rows) > MOST_REPORT_ROWS:
        raise ValueError("too many rows for a report")
    head = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(head + ["| " + " | ".join(format_value(v).replace("|", "\\|") for v in r) + " |" for r in rows]) + "\n"
