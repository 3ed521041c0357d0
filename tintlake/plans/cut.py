"""Tables that end a lineage, in the folder that driver and executors share, and their removal."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

#: Paths of the tables that the innermost open ``scratch`` owns; the first list is of those that nothing owns.
_OPEN: list[list[str]] = [[]]


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary one, as all its tasks run on this machine; a cluster raises,
    as each executor would write to a disk of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tintlake-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A new name below the shared folder; what is put there goes with the open ``scratch``, or else when the driver ends."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _OPEN[-1].append(path)
    return path


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """What is run inside deletes its shuffle files at its end."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialise(df: DataFrame, label: str, tidy: bool = False) -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage ends there, and later uses don't compute it again.

    An executor that is lost takes nothing with it, as the files are not its own. ``tidy``: the shuffles of the write are
    deleted when it ends; without that they lie on disk until the driver's next garbage collection.
    """
    path = new_folder(df.sparkSession, label)
    with shuffles_deleted(df.sparkSession) if tidy else nullcontext():
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.materialised_at = path
    return out


def remove(paths: list[str]) -> None:
    """Deletes folders; one that is gone, or that this machine can't reach, is left."""
    for path in paths:
        try:
            where, at = fs.FileSystem.from_uri(path)
            where.delete_dir(at)
        except OSError:
            continue


@contextmanager
def scratch() -> Iterator:
    """Tables that are materialised inside are deleted at the end, but for those that went through ``keep``.

    Use it as ``with scratch() as keep``; what leaves the block may read kept tables only.
    """
    mine: list[str] = []
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df.materialised_at)
        return df

    _OPEN.append(mine)
    try:
        yield keep
    finally:
        _OPEN.remove(mine)
        _OPEN[-1].extend(kept)
        remove([p for p in mine if p not in kept])


def clear() -> None:
    """Deletes all tables of this driver that are left; call it when results are written. It runs when the driver ends."""
    gone, _OPEN[0][:] = list(_OPEN[0]), []
    remove(gone)


atexit.register(clear)
