"""Files by any path that Spark reaches: local ones, or those of a shared store."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Storage:
    """A thin layer over the file systems that the session knows."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def _at(self, path: str):
        context = self.spark.sparkContext
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(context._jsc.hadoopConfiguration()), target

    def is_file(self, path: str) -> bool:
        system, target = self._at(path)
        return system.exists(target) and system.getFileStatus(target).isFile()

    def make_folder(self, path: str) -> None:
        system, target = self._at(path)
        system.mkdirs(target)

    def remove(self, path: str) -> None:
        """Delete a file or folder; what isn't there is nothing."""
        system, target = self._at(path)
        system.delete(target, True)

    def read_text(self, path: str) -> str | None:
        """The file's text; None where there is none."""
        if not self.is_file(path):
            return None
        system, target = self._at(path)
        stream = system.open(target)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_text(self, path: str, text: str) -> None:
        """Write beside the file and rename, so a reader sees the old text or the new one."""
        system, target = self._at(path)
        context = self.spark.sparkContext
        new = f"{path}.{uuid.uuid4().hex}"
        _, temporary = self._at(new)
        stream = system.create(temporary, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        rename = context._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        modes = context._gateway.new_array(context._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        modes[0] = rename
        files = context._jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), context._jsc.hadoopConfiguration())
        files.rename(temporary, target, modes)


def joined(folder: str, path: str) -> str:
    """path within folder; an absolute path, or one with a scheme, stands for itself."""
    return path if path.startswith("/") or "://" in path else f"{folder.rstrip('/')}/{path}"
