"""Publishing in one step: what writers put into a store is seen when, and only when, their record is in the commit log.

A writer first writes its files under names that no one else uses, then publishes one small record
that names them. Records are numbered; a number is taken by moving a finished file to it, which fails if the number is
taken. Readers look at the records alone, so files of a writer that failed before its record do not exist for
them, and two writers that started from the same state cannot both publish the next one.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

FOLDER = "_commits"


class Conflict(Exception):
    """Another writer has published since the state that a change was made from was read."""


class CommitLog:
    """The commit log of the store at ``path``. Records are JSON objects of one line."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder = spark, f"{path.rstrip('/')}/{FOLDER}"
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._files = hadoop.FileContext.getFileContext(hadoop.Path(self.folder).toUri(), self._conf)

    def _fs(self):
        return self._path(self.folder).getFileSystem(self._conf)

    def records(self) -> list[dict]:
        """The published records in order: one per change, each naming whole tables' folders."""
        if not self._fs().exists(self._path(self.folder)):
            return []
        rows = self.spark.read.option("pathGlobFilter", "[0-9]*.json").text(self.folder).selectExpr("_metadata.file_name AS name", "value").collect()
        return [json.loads(r["value"]) for r in sorted(rows, key=lambda r: int(r["name"].split(".")[0]))]

    def publish(self, record: dict, version: int) -> None:
        """Make ``record`` the one with number ``version`` (the number of records that the change was made from).

        Raises ``Conflict`` if that number is taken."""
        fs = self._fs()
        fs.mkdirs(self._path(self.folder))
        draft = self._path(f"{self.folder}/draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write((json.dumps(record, sort_keys=True) + "\n").encode())
        out.close()
        try:
            none = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
            options = self.spark._sc._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
            options[0] = none
            self._files.rename(self._files.makeQualified(draft), self._files.makeQualified(self._path(f"{self.folder}/{version:012d}.json")), options)
        except Py4JJavaError as ex:
            fs.delete(draft, False)
            if "FileAlreadyExists" in ex.java_exception.getClass().getName():
                raise Conflict(f"{self.folder}: version {version} is taken") from None
            raise
