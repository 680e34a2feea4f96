"""File operations by URI, through the session's Hadoop file systems."""

from __future__ import annotations

import os
from uuid import uuid4

from pyspark.sql import SparkSession

from ..errors import CommitConflict


class Files:
    def __init__(self, spark: SparkSession):
        self.spark, self.jvm, self.conf = spark, spark._jvm, spark._jsc.hadoopConfiguration()

    def path(self, uri: str):
        return self.jvm.org.apache.hadoop.fs.Path(uri)

    def fs(self, uri: str):
        return self.path(uri).getFileSystem(self.conf)

    def names(self, uri: str) -> list[str]:
        fs, p = self.fs(uri), self.path(uri)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, uri: str) -> bytes:
        stream = self.fs(uri).open(self.path(uri))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write(self, uri: str, data: bytes) -> None:
        stream = self.fs(uri).create(self.path(uri), True)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()

    def create(self, uri: str, data: bytes) -> None:
        """Writes a file whole or not at all; raises CommitConflict if it exists.

        Local files are linked into place (atomic, refuses an existing name), others renamed without overwriting.
        """
        folder, _, name = uri.rpartition("/")
        temporary = f"{folder}/.{name}.{uuid4().hex}.tmp"
        self.write(temporary, data)
        try:
            if self.fs(uri).getScheme() == "file":
                local = lambda u: self.path(u).toUri().getPath()
                try:
                    os.link(local(temporary), local(uri))
                except FileExistsError as e:
                    raise CommitConflict(uri) from e
            else:
                options = self.jvm.org.apache.hadoop.fs.Options.Rename
                array = self.spark.sparkContext._gateway.new_array(options, 1)
                array[0] = options.NONE
                try:
                    self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path(uri).toUri(), self.conf).rename(self.path(temporary), self.path(uri), array)
                except Exception as e:
                    if self.fs(uri).exists(self.path(uri)):
                        raise CommitConflict(uri) from e
                    raise
        finally:
            self.fs(uri).delete(self.path(temporary), False)

    def delete(self, uri: str) -> None:
        self.fs(uri).delete(self.path(uri), True)
