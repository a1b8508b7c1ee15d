"""Small files on whatever file system Spark can reach: listing, atomic publication, locks."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import SparkSession

from keyloom.errors import CorruptManifest, TableLocked


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._jvm = spark._jvm
        self._gateway = spark.sparkContext._gateway
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def url(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def names(self, folder: str) -> list[str]:
        if not self.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(folder)))

    def size(self, name: str) -> int:
        return self._fs.getContentSummary(self._path(name)).getLength() if self.exists(name) else 0

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """All or nothing: into a file of its own, then renamed over the old one."""
        fresh = f"{name}.{uuid.uuid4().hex}"
        stream = self._fs.create(self._path(fresh), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        kind = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self._gateway.new_array(kind, 1)
        options[0] = kind.OVERWRITE
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self._conf).rename(self._path(fresh), self._path(name), options)

    def publish(self, name: str, body: dict) -> None:
        text = json.dumps(body, sort_keys=True)
        self.write(name, json.dumps({"checksum": hashlib.sha256(text.encode()).hexdigest(), "body": text}))

    def published(self, name: str) -> dict | None:
        if not self.exists(name):
            return None
        try:
            found = json.loads(self.read(name))
            good = hashlib.sha256(found["body"].encode()).hexdigest() == found["checksum"]
        except (ValueError, KeyError, TypeError) as e:
            raise CorruptManifest(self.url(name)) from e
        if not good:
            raise CorruptManifest(self.url(name))
        return json.loads(found["body"])

    def lock(self, name: str) -> None:
        """One writer at a time: the file is made only if it isn't there."""
        try:
            self._fs.create(self._path(name), False).close()
        except Exception as e:
            if self.exists(name):
                raise TableLocked(self.url(name)) from e
            raise

    def unlock(self, name: str) -> None:
        self.delete(name)
