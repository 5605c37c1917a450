"""Shared tables that outlive a session: built once per name, arguments and input files.

A table's folder is named by a fingerprint of what it is made from, so a later session reads it, and a changed
input or argument has a folder of its own. It gets that name by one rename when it is complete: of several
sessions that build it at once one wins and the others read what it wrote. Within a session each table has
one builder at a time, and different tables are built side by side.
"""

from __future__ import annotations

import hashlib
import json
import threading
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starpath.sources import versions


class StoredTables:
    """Tables in ``folder``, which all sessions and executors reach."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._spark, self._folder = spark, folder.rstrip("/")
        self._locks: dict[str, threading.Lock] = defaultdict(threading.Lock)
        self._guard = threading.Lock()

    def get(self, name: str, build: Callable[..., DataFrame], inputs: list[str], **arguments) -> DataFrame:
        """The table ``build(spark, *inputs, **arguments)``; ``name`` stands for the code, so give changed code a new one.

        ``inputs`` are paths; their files count by path, length and time of change. Arguments must be plain values.
        """
        path = f"{self._folder}/{name}-{self._fingerprint(name, inputs, arguments)}"
        with self._guard:
            lock = self._locks[path]
        with lock:
            if not versions.exists(self._spark, path):
                draft = versions.unfinished(self._folder)
                build(self._spark, *inputs, **arguments).write.parquet(draft)
                if not versions.take_name(self._spark, draft, path):
                    versions.remove(self._spark, draft)
        return self._spark.read.parquet(path)

    def _fingerprint(self, name: str, inputs: list[str], arguments: dict) -> str:
        said = hashlib.sha256(json.dumps([name, inputs, arguments], sort_keys=True).encode())
        for path in inputs:
            data = F.col("_metadata")
            files = self._spark.read.format("binaryFile").load(path).select(F.concat_ws(
                "|", data["file_path"], data["file_size"], F.unix_millis(data["file_modification_time"])).alias("file"))
            # order-free, and of fixed size whatever the number of files
            digest = files.agg(F.count("*"), F.bit_xor(F.xxhash64("file")), F.sum(F.xxhash64("file").cast("decimal(38,0)"))).first()
            said.update(repr(tuple(digest)).encode())
        return said.hexdigest()[:32]
