"""Small documents, locks and renames on any file system that Spark can write to.

Paths without a scheme belong to the cluster's default file system. Nothing
here handles rows; those are Spark's business.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import SparkSession


def _jvm():
    return SparkSession.active().sparkContext._jvm


def _conf():
    return SparkSession.active().sparkContext._jsc.hadoopConfiguration()


def _at(path: str):
    """(file system, Hadoop path)"""
    p = _jvm().org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(_conf()), p


def exists(path: str) -> bool:
    fs, p = _at(path)
    return fs.exists(p)


def names(path: str) -> list[str]:
    """Sorted names in a folder, none where it is missing."""
    fs, p = _at(path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def read_text(path: str) -> str:
    fs, p = _at(path)
    stream = fs.open(p)
    try:
        return _jvm().org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def replace(source: str, target: str) -> None:
    """Rename a file over another one, or into its place."""
    fs, p = _at(target)
    fs.mkdirs(p.getParent())
    options = SparkSession.active().sparkContext._gateway.new_array(_jvm().org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = _jvm().org.apache.hadoop.fs.Options.Rename.OVERWRITE
    uri = fs.makeQualified(p).toUri()
    _jvm().org.apache.hadoop.fs.FileContext.getFileContext(uri, _conf()).rename(fs.makeQualified(_at(source)[1]), fs.makeQualified(p), options)


def join(parts: list[str], target: str) -> None:
    """The bytes of files, one after the other, as one file; it takes its place when it is complete."""
    fs, p = _at(f"{target}.tmp")
    fs.mkdirs(p.getParent())
    out = fs.create(p, True)
    try:
        for part in parts:
            there, at = _at(part)
            stream = there.open(at)
            try:
                _jvm().org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 20, False)
            finally:
                stream.close()
    finally:
        out.close()
    replace(f"{target}.tmp", target)


def write_text(path: str, content: str) -> None:
    """Write beside the target, then rename over it."""
    fs, p = _at(f"{path}.tmp")
    fs.mkdirs(p.getParent())
    stream = fs.create(p, True)
    stream.write(content.encode())
    stream.close()
    replace(f"{path}.tmp", path)


def delete(path: str) -> None:
    fs, p = _at(path)
    fs.delete(p, True)


def sha256(path: str) -> str:
    """Digest of a file, streamed inside the JVM."""
    fs, p = _at(path)
    stream = fs.open(p)
    try:
        return _jvm().org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()


@contextmanager
def exclusive(path: str):
    """A lock file that only one holder can create; an existing one raises FileExistsError."""
    fs, p = _at(path)
    fs.mkdirs(p.getParent())
    try:
        made = fs.createNewFile(p)
    except Exception as e:
        if fs.exists(p):
            raise FileExistsError(path) from e
        raise
    if not made:
        raise FileExistsError(path)
    try:
        yield
    finally:
        fs.delete(p, False)
