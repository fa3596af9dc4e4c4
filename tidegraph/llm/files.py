"""Files in the shared folder, opened by URI from executors."""

from __future__ import annotations

import uuid


def filesystem(uri: str):
    """(filesystem, inner path); local files are memory-mapped."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(uri)
    if isinstance(system, fs.LocalFileSystem):
        system = fs.LocalFileSystem(use_mmap=True)
    return system, inner


def create(uri: str):
    """A new file for writing; its folder is made if need be."""
    system, inner = filesystem(uri)
    system.create_dir(inner.rpartition("/")[0], recursive=True)
    return system.open_output_stream(inner, compression=None)


def open_input(uri: str):
    system, inner = filesystem(uri)
    return system.open_input_file(inner)


def read_bytes(uri: str) -> bytes:
    with open_input(uri) as f:
        return f.read()


def attempt_name(kind: str) -> str:
    """A name no other attempt of the task uses; only attempts whose row is committed get read."""
    from pyspark import TaskContext

    ctx = TaskContext.get()
    return f"{kind}-{ctx.partitionId() if ctx else 0:06d}-{uuid.uuid4().hex[:12]}"


def one_per_task(spark, n: int):
    """n rows (id), one in each of n partitions."""
    return spark.range(0, max(n, 1), 1, max(n, 1)) if n else spark.range(0, 0, 1, 1)
