"""Files written from tasks, on any file system that pyarrow opens (local paths, file:, hdfs:, s3:, gs:).

Each is written under another name and then moved, so a task that is lost and run again leaves whole files only.
"""

from __future__ import annotations

import posixpath
import uuid

import pandas as pd
from pyspark.sql import DataFrame


def file_system(path: str):
    """(pyarrow file system, path in it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{posixpath.abspath(path)}")


def safe_name(name: str) -> str:
    """A relative name that stays below its root."""
    parts = [p for p in name.replace("\\", "/").split("/") if p not in ("", ".")]
    if not parts or ".." in parts:
        raise ValueError(f"{name!r} leaves its folder")
    return "/".join(parts)


class Output:
    """A file being written; it gets its name when it is closed without an error."""

    def __init__(self, root: str, name: str):
        self.system, base = file_system(root)
        self.name = f"{base}/{safe_name(name)}"
        self.system.create_dir(posixpath.dirname(self.name), recursive=True)
        self.part = f"{posixpath.dirname(self.name)}/.{uuid.uuid4().hex}.part"
        self.stream, self.n = self.system.open_output_stream(self.part, compression=None), 0

    def write(self, data):
        data = data.encode() if isinstance(data, str) else data
        self.n += len(data)
        self.stream.write(data)

    def __enter__(self):
        return self

    def __exit__(self, kind, value, trace):
        self.stream.close()
        if kind is None:
            self.system.move(self.part, self.name)
        else:
            self.system.delete_file(self.part)


def put(root: str, name: str, data) -> int:
    with Output(root, name) as f:
        f.write(data)
    return f.n


def write_files(df: DataFrame, root: str) -> None:
    """Writes rows (name, content) as files below root."""
    def run(batches):
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"], strict=True):
                put(root, name, bytes(content))
        yield pd.DataFrame({"n": [0]})

    df.mapInPandas(run, "n int").write.format("noop").mode("overwrite").save()
