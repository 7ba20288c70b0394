"""Files in any store that Spark reaches: small JSON documents, created once and never overwritten."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer was first."""


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where it is unset in a local session, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        if kept.isEmpty():
            if spark.sparkContext.master.split("[")[0] != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidelog-"))
            kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = kept.get()
    return base.rstrip("/")


class Store:
    """Documents below a root path, through Hadoop's file system interface on the driver.

    Local files are the driver's own and are reached directly: Hadoop starts a process for the mode of each file it makes.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        gateway = spark.sparkContext._gateway
        self._no_options = gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        self._scheme = self._fs.getUri().getScheme()
        self._local = str(self._path("").toUri().getPath()) if self._scheme == "file" else None

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _file(self, name: str) -> str:
        return f"{self._local}/{name}" if name else self._local

    @staticmethod
    def _drop_sum(file: str) -> None:
        """Without the checksum that Hadoop keeps beside a file, which would refuse another content of that name."""
        folder, base = os.path.split(file)
        try:
            os.unlink(f"{folder}/.{base}.crc")
        except FileNotFoundError:
            pass

    def create(self, name: str, document: dict) -> None:
        """Fails with Conflict if the document exists with another content; equal bytes are fine.

        A document appears whole or not at all. Where a file is seen while it is written, it is written under another
        name and then linked (local files) or renamed without overwriting; object stores show a file when it is closed.
        """
        raw = json.dumps(document, sort_keys=True, separators=(",", ":"))
        folder, _, base = name.rpartition("/")
        at_once = self._scheme in ("file", "hdfs", "viewfs")
        written = f"{folder}/.{base}.{uuid.uuid4().hex}".lstrip("/") if at_once else name
        try:
            self.put_bytes(written, raw.encode())
            if at_once:
                self._publish(written, name)
        except Exception as e:
            if self.exists(name) and self.read_text(name) == raw:
                return
            raise Conflict(name) from e
        finally:
            if at_once:
                self.delete(written)

    def _publish(self, written: str, name: str) -> None:
        if self._local:
            os.link(self._file(written), self._file(name))
        else:
            renames = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
            renames.rename(self._path(written), self._path(name), self._no_options)

    def exists(self, name: str) -> bool:
        if self._local:
            return os.path.exists(self._file(name))
        return bool(self._fs.exists(self._path(name)))

    def read_text(self, name: str) -> str:
        if self._local:
            return self.read_bytes(name).decode()
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put_bytes(self, name: str, raw: bytes, overwrite: bool = False) -> None:
        if self._local:
            file = self._file(name)
            os.makedirs(os.path.dirname(file), exist_ok=True)
            with open(file, "wb" if overwrite else "xb") as out:
                self._drop_sum(file)
                out.write(raw)
            return
        out = self._fs.create(self._path(name), overwrite)
        try:
            out.write(bytearray(raw))
        finally:
            out.close()

    def read_bytes(self, name: str) -> bytes:
        if self._local:
            with open(self._file(name), "rb") as stream:
                return stream.read()
        stream = self._fs.open(self._path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def read(self, name: str) -> dict:
        return json.loads(self.read_text(name))

    def names(self, folder: str) -> list[str]:
        if not self.exists(folder):
            return []
        found = os.listdir(self._file(folder)) if self._local else (s.getPath().getName() for s in self._fs.listStatus(self._path(folder)))
        return sorted(n for n in found if not n.startswith("."))

    def delete(self, name: str = "") -> None:
        if self._local:
            file = self._file(name)
            if os.path.isdir(file) and not os.path.islink(file):
                return shutil.rmtree(file, onexc=self._gone)
            try:
                os.unlink(file)
            except FileNotFoundError:
                return
            return self._drop_sum(file)
        self._fs.delete(self._path(name), True)

    @staticmethod
    def _gone(run, file: str, error: Exception) -> None:
        if not isinstance(error, FileNotFoundError):
            raise error
