"""File operations on any file system that Spark reaches."""

from __future__ import annotations

import json
import os
import time
import uuid

from pyspark.sql import SparkSession

from graphloom.errors import ConflictError


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self.fs = self._path("").getFileSystem(self.conf)
        self.local = self.fs.getScheme() == "file"

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def url(self, name: str) -> str:
        return f"{self.root}/{name}"

    def list(self, name: str) -> list[str]:
        p = self._path(name)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)

    def size(self, name: str) -> int:
        p = self._path(name)
        return self.fs.getContentSummary(p).getLength() if self.fs.exists(p) else 0

    def age(self, name: str) -> float:
        """Seconds since anything in a file or folder was written."""
        p, newest = self._path(name), 0
        if self.fs.exists(p):
            newest = self.fs.getFileStatus(p).getModificationTime()
            if self.fs.getFileStatus(p).isDirectory():
                newest = max([newest, *(s.getModificationTime() for s in self.fs.listStatus(p))])
        return time.time() - newest / 1000

    def put(self, name: str, value: object) -> None:
        """Write a JSON file, over one that is there."""
        out = self.fs.create(self._path(name), True)
        out.write(bytearray(json.dumps(value, ensure_ascii=False).encode()))
        out.close()

    def create(self, name: str, value: object) -> None:
        """Put a JSON file in place, whole or not at all; ConflictError if it is there already."""
        data = json.dumps(value, ensure_ascii=False).encode()
        if self.local:
            at = self._path(name).toUri().getPath()
            os.makedirs(os.path.dirname(at), exist_ok=True)
            tmp = f"{at}.{uuid.uuid4().hex}.tmp"
            with open(tmp, "wb") as f:
                f.write(data)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(tmp, at)
            except FileExistsError:
                raise ConflictError(f"{name} was committed by another writer") from None
            finally:
                os.unlink(tmp)
            return
        tmp = f"{name}.{uuid.uuid4().hex}.tmp"
        out = self.fs.create(self._path(tmp), False)
        out.write(bytearray(data))
        out.close()
        # Renaming onto a file that is there fails on HDFS and the stores that speak its protocol.
        if self.fs.exists(self._path(name)) or not self.fs.rename(self._path(tmp), self._path(name)):
            self.fs.delete(self._path(tmp), False)
            raise ConflictError(f"{name} was committed by another writer")
