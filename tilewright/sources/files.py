"""Small file actions through Hadoop's file system layer, for any scheme that Spark can read."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it doesn't exist. Checksum and marker files don't count."""
    fs, p = _at(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName()[0] not in "._"] if fs.exists(p) else []


def qualified(spark: SparkSession, path: str) -> str:
    """The path as its file system writes it in listings."""
    fs, p = _at(spark, path)
    return fs.makeQualified(p).toString()


def status(spark: SparkSession, path: str) -> tuple[int, float] | None:
    """Size and time of a file; None if there is none."""
    fs, p = _at(spark, path)
    if not fs.exists(p):
        return None
    s = fs.getFileStatus(p)
    return None if s.isDirectory() else (s.getLen(), s.getModificationTime() / 1000)


def create_once(spark: SparkSession, path: str, data: str | bytes) -> bool:
    """Creates the file unless it exists; False if it does. Exclusive on file systems whose create() is."""
    fs, p = _at(spark, path)
    try:
        out = fs.create(p, False)
    except Exception as e:
        if "exist" in str(e).lower():
            return False
        raise
    out.write(bytearray(data.encode() if isinstance(data, str) else data))
    out.close()
    return True


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    fs, p = _at(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(data))
    out.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    write_bytes(spark, path, text.encode())


def read_bytes(spark: SparkSession, path: str, offset: int, length: int) -> bytes:
    if not length:
        return b""
    fs, p = _at(spark, path)
    stream = fs.open(p)
    try:
        stream.seek(offset)
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, length))
    finally:
        stream.close()


def read_text(spark: SparkSession, path: str) -> str:
    found = status(spark, path)
    if found is None:
        raise FileNotFoundError(path)
    return read_bytes(spark, path, 0, found[0]).decode()


def rename(spark: SparkSession, old: str, new: str) -> None:
    fs, p = _at(spark, old)
    q = spark._jvm.org.apache.hadoop.fs.Path(new)
    fs.mkdirs(q.getParent())
    if not fs.rename(p, q):
        raise OSError(f"can't rename {old} to {new}")


def delete(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.delete(p, True)


def copy(spark: SparkSession, old: str, new: str, overwrite: bool = True) -> None:
    fs, p = _at(spark, old)
    other, q = _at(spark, new)
    conf = spark._jsc.hadoopConfiguration()
    if not spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, p, other, q, False, overwrite, conf):
        raise OSError(f"can't copy {old} to {new}")
