"""Where intermediate tables go: the folder the cluster shares, never a worker's own disk."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

_LOCAL_FOLDERS: dict[str, str] = {}
_TRIED_FOLDERS: set[tuple[str, str]] = set()


def in_one_process(master: str) -> bool:
    return re.fullmatch(r"local(\[.*\])?", master) is not None


def local_by_default(spark: SparkSession) -> bool:
    """Whether a path without a scheme is one on the machine's own disk."""
    named = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
    return named.lower().startswith("file:")


def check_shared(folder: str, master: str, local_paths: Callable[[], bool]) -> None:
    """Refuse a folder that each machine of a cluster would look for on its own disk.

    That is a path without a scheme where such paths are local, and ``file:`` on a master of several machines.
    ``local-cluster[..]`` runs its executors on one machine, so there ``file:`` is shared, but it has to be said.
    """
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", folder)
    named = scheme[1].lower() if scheme else None
    on_one_machine = in_one_process(master) or (named == "file" and master.startswith("local-cluster["))
    if not on_one_machine and (named == "file" or (named is None and local_paths())):
        raise ValueError(f"spark.checkpoint.dir {folder} is a machine's own disk; name a folder that all executors share")


def try_shared(spark: SparkSession, folder: str) -> None:
    """Refuse a local folder unless the machines share it, as a mount: what tasks write below it is tried once in an application.

    As many tasks as run at once write a row each, and tasks read the rows back by the files that the driver lists. On disks of
    their own rows are missing, or files that are listed are not found.
    """
    context = spark.sparkContext
    tried = (context.applicationId, folder)
    if tried in _TRIED_FOLDERS:
        return
    try:
        tasks = max(context.defaultParallelism, 2)
        path = f"{folder}/shared-{uuid.uuid4().hex}"
        spark.range(0, tasks, 1, tasks).write.parquet(path)
        found = spark.read.schema("id long").parquet(path).count()
    except Exception as failed:
        raise ValueError(f"tasks could not write and read in spark.checkpoint.dir {folder}; name a folder that all executors share") from failed
    if found != tasks:
        raise ValueError(f"spark.checkpoint.dir {folder} is a machine's own disk; name a folder that all executors share")
    _TRIED_FOLDERS.add(tried)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a session in one process (``local`` or ``local[..]``) may leave it unset; it then gets one temporary folder. On a cluster, a
    path that is local to a machine is taken if it is a mount that all machines share.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if configured:
        if not in_one_process(context.master) and configured.startswith("/") and local_by_default(spark):
            configured = f"file://{configured}"
        folder = configured.rstrip("/")
        try:
            # The executors of local-cluster[..] run on this machine: a path that is local here is the same folder to them.
            check_shared(configured, context.master, lambda: local_by_default(spark))
        except ValueError:
            if not configured.lower().startswith("file:"):
                raise
            try_shared(spark, folder)
        return folder
    if not in_one_process(context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="tillbook-")
    return _LOCAL_FOLDERS[context.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
