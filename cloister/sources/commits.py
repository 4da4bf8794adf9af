"""Small files that are committed once: of several writers of a name, one succeeds and the others are told.

A file is written under a name of its own and then takes its place by an atomic step that fails if the place is taken: a
link on local and POSIX file systems, a rename without overwriting on others (HDFS; object stores need a layer with such a rename).
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import SparkSession


def _hadoop(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def read_bytes(spark: SparkSession, path: str) -> bytes | None:
    """A small file; None if there is none."""
    system, hadoop_path = _hadoop(spark, path)
    if not system.exists(hadoop_path):
        return None
    stream = system.open(hadoop_path)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def commit_bytes(spark: SparkSession, path: str, data: bytes) -> bool:
    """Make ``path`` a file with this content; False, with nothing changed, if it exists."""
    system, final = _hadoop(spark, path)
    if system.getUri().getScheme() == "file":
        place = final.toUri().getPath()
        os.makedirs(os.path.dirname(place), exist_ok=True)
        draft = f"{os.path.dirname(place)}/.draft-{uuid.uuid4().hex}"
        with open(draft, "wb") as out:
            out.write(data)
            out.flush()
            os.fsync(out.fileno())
        try:
            os.link(draft, place)
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
        return True
    _, draft = _hadoop(spark, f"{path.rpartition('/')[0]}/.draft-{uuid.uuid4().hex}")
    out = system.create(draft, False)
    out.write(bytearray(data))
    out.close()
    hdfs = spark._jvm.org.apache.hadoop.fs
    options = spark.sparkContext._gateway.new_array(hdfs.Options.Rename, 1)
    options[0] = hdfs.Options.Rename.NONE
    try:
        hdfs.FileContext.getFileContext(system.getUri(), spark._jsc.hadoopConfiguration()).rename(draft, final, options)
    except Exception:
        system.delete(draft, False)
        if system.exists(final):
            return False
        raise
    return True


def children(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder but for hidden ones, in order; none if there is no folder."""
    system, hadoop_path = _hadoop(spark, folder)
    if not system.exists(hadoop_path):
        return []
    return sorted(n for n in (f.getPath().getName() for f in system.listStatus(hadoop_path)) if not n.startswith("."))


class Journal:
    """Numbered entries in a folder, each a JSON object; an entry is added by the one writer who knows the last.

    With ``keep`` only so many of the last entries stay.
    """

    def __init__(self, spark: SparkSession, folder: str, keep: int | None = None):
        self.spark, self.folder, self.keep, self._known = spark, folder.rstrip("/"), keep, 0

    def _path(self, number: int) -> str:
        return f"{self.folder}/{number:010d}.json"

    def last(self) -> tuple[int, dict | None]:
        """The last entry's number and content; (0, None) if there is none.  The folder is listed once, later entries are looked for by number."""
        while True:
            if not self._known:
                self._known = max((int(n[:-5]) for n in children(self.spark, self.folder) if n.endswith(".json") and n[:-5].isdigit()), default=0)
            while (found := read_bytes(self.spark, self._path(self._known + 1))) is not None:
                self._known += 1
            if not self._known:
                return 0, None
            if (found := read_bytes(self.spark, self._path(self._known))) is not None:
                return self._known, json.loads(found)
            self._known = 0  # it has been removed, as there are later ones

    def append(self, entry: dict, after: int) -> bool:
        """Add the entry that follows number ``after``; False if another writer has done so."""
        if not commit_bytes(self.spark, self._path(after + 1), json.dumps(entry).encode()):
            return False
        self._known = after + 1
        if self.keep and after + 1 > self.keep:
            system, old = _hadoop(self.spark, self._path(after + 1 - self.keep))
            system.delete(old, False)
        return True

    def add(self, entry: dict) -> int:
        """Add an entry after whatever is last."""
        while not self.append(entry, after := self.last()[0]):
            continue
        return after + 1
