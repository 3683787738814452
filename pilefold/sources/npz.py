"""Tensors with labels as .npz files: spark.dataSource.register(NpzSource); df.write.format("npz").option("shape", "100,70,5").mode("append").save(folder)."""

from __future__ import annotations

import io
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


def _system(path: str):
    """(file system, path in it); a path without a scheme is a local or mounted one that all executors see."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    return FileSystem.from_uri(path) if "://" in path else (LocalFileSystem(), os.path.abspath(path))


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class NpzWriter(DataSourceWriter):
    """Files of `rows` sites (1,000 unless given) with arrays X (rows, *shape), Y (label; NaN without one), chrom and pos.

    A task writes into a folder of the job that readers don't look at; only when all tasks have ended are the
    files of those that count moved into place, and the folder goes with whatever killed or repeated tasks left.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.rows = options["path"], int(options.get("rows", 1000))
        self.shape = tuple(int(x) for x in options["shape"].split(","))
        self.overwrite, self.job = overwrite, f"_job-{uuid.uuid4().hex}"
        system, base = _system(self.path)
        system.create_dir(f"{base}/{self.job}", recursive=True)  # by the driver: a task that goes on after the job was given up finds no folder

    def write(self, iterator: Iterator[Row]) -> Written:
        system, base = _system(self.path)
        context, held, files = TaskContext.get(), [], []
        task = f"{context.partitionId():05d}-{context.taskAttemptId()}" if context else "0"

        def flush() -> None:
            if held:
                out = io.BytesIO()
                x = np.stack([np.asarray(r["data"], "f4").reshape(self.shape) for r in held])
                y = np.array([np.nan if "label" not in r or r["label"] is None else r["label"] for r in held], "f8")
                np.savez_compressed(out, X=x, Y=y, chrom=np.array([r["chrom"] for r in held], str), pos=np.array([r["pos"] for r in held], "i8"))
                files.append(f"part-{task}-{len(files):04d}.npz")
                with system.open_output_stream(f"{base}/{self.job}/{files[-1]}") as f:
                    f.write(out.getvalue())
                held.clear()

        for row in iterator:
            held.append(row)
            if len(held) == self.rows:
                flush()
        flush()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow.fs import FileSelector, FileType

        system, base = _system(self.path)
        old = []
        if self.overwrite and system.get_file_info(base).type == FileType.Directory:
            old = [f.path for f in system.get_file_info(FileSelector(base)) if f.type == FileType.File and f.path.endswith(".npz")]
        for m in messages:
            for name in m.files if m else ():
                system.move(f"{base}/{self.job}/{name}", f"{base}/{self.job[5:13]}-{name}")
        for path in old:
            system.delete_file(path)
        self.abort([])

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow.fs import FileType

        system, base = _system(self.path)
        if system.get_file_info(f"{base}/{self.job}").type == FileType.Directory:
            system.delete_dir(f"{base}/{self.job}")


class NpzSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npz"

    def writer(self, schema: StructType, overwrite: bool) -> NpzWriter:
        return NpzWriter(self.options, overwrite)
