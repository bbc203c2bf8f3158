"""Documents in any file system that Spark reaches: whole replacement, presence, removal.

Paths are strings of the session's Hadoop file systems, as those of tables are, so documents lie beside tables and
every reader of reports finds them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _on(path: str):
    """(the JVM, the Hadoop configuration, the path as Hadoop's) in the active session."""
    spark = SparkSession.active()
    jvm = spark.sparkContext._jvm
    return jvm, spark.sparkContext._jsc.hadoopConfiguration(), jvm.org.apache.hadoop.fs.Path(str(path))


def join(folder: object, *names: str) -> str:
    return "/".join([str(folder).rstrip("/"), *names])


def exists(path: object) -> bool:
    _, conf, at = _on(str(path))
    return at.getFileSystem(conf).exists(at)


def make_folder(path: object) -> None:
    _, conf, at = _on(str(path))
    at.getFileSystem(conf).mkdirs(at)


def remove(path: object) -> None:
    """Remove a file or folder; one that isn't there is left alone."""
    _, conf, at = _on(str(path))
    at.getFileSystem(conf).delete(at, True)


def replace(path: object, text: str) -> str:
    """Make text the content of the file at path: readers find the old content or the new one, never a part."""
    jvm, conf, at = _on(str(path))
    draft = jvm.org.apache.hadoop.fs.Path(at.getParent(), f"_{uuid.uuid4().hex}.draft")
    files = jvm.org.apache.hadoop.fs.FileSystem.newInstance(at.toUri(), conf)
    files.setWriteChecksum(False)  # no side files beside documents
    out = files.create(draft, True)
    out.write(bytearray(text, "utf-8"))
    out.close()
    options = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = SparkSession.active().sparkContext._gateway.new_array(options, 1)
    how[0] = options.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), conf).rename(draft, at, how)
    return str(path)
