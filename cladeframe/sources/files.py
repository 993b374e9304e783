"""Service folders: listings and lookups of files by inode, on the driver."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def by_inode(folder: str, inode: int) -> Path | None:
    """The first file below a folder with an inode (its low 32 bits)."""
    for at, _, names in os.walk(folder):
        for name in sorted(names):
            path = Path(at, name)
            if path.stat().st_ino & 0xFFFFFFFF == inode:
                return path
    return None


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(name, modified, size) of the files below a folder, by name; metadata only, contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return found.select(name.alias("name"), F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("modified"), F.col("length").alias("size")).where("name <> ''").orderBy("name")


def entries(folder: Path) -> list[dict]:
    """The files below a folder, and links that lead to something, by name with those of subfolders first; metadata only."""
    found = []
    for at, folders, names in os.walk(folder, topdown=False):
        linked = [x for x in folders if Path(at, x).is_symlink()]
        for path in (Path(at, x) for x in sorted([*names, *linked])):
            if path.exists() and (path.is_file() or path.is_symlink()):
                s = path.stat()
                times = {k: datetime.fromtimestamp(t, UTC).isoformat() for k, t in (("updatedAt", s.st_mtime), ("accessedAt", s.st_atime))}
                found.append({"id": s.st_ino & 0xFFFFFFFF, "name": str(path.relative_to(folder)), "createdAt": None, **times, "size": s.st_size})
    return found


def new_work_dir(serve: str) -> str:
    """Makes a work folder whose name sorts by time."""
    from time import time_ns

    stamp = (time_ns() // 1_000_000) & ((1 << 48) - 1)
    value = stamp << 80 | 7 << 76 | (uuid.uuid4().int & ((1 << 76) - 1))
    value = value & ~(3 << 62) | 2 << 62
    name = str(uuid.UUID(int=value))
    Path(serve, name).mkdir(parents=True)
    return name


def store(serve: str, work_dir: str, name: str, data: bytes | Iterable[bytes], force: bool = False, folder: str = "input") -> Path:
    """Stores an uploaded query file, whole or not at all; one that exists is replaced only by force."""
    at = Path(serve, work_dir, folder, Path(name).name)
    if not at.parent.parent.is_dir():
        raise FileNotFoundError(f"no such work folder: {work_dir}")
    if at.exists() and not force:
        raise FileExistsError(at.name)
    at.parent.mkdir(exist_ok=True)
    part = at.with_name(f".{uuid.uuid4().hex}.part")
    try:
        with part.open("wb") as out:
            out.writelines([data] if isinstance(data, bytes) else data)
        if force:
            part.replace(at)
        else:
            try:
                os.link(part, at)  # fails if the name was taken meanwhile
            except FileExistsError:
                raise FileExistsError(at.name) from None
    finally:
        part.unlink(missing_ok=True)
    return at
