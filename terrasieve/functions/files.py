"""Small files on whatever store Spark reads, by its Hadoop file systems.

Driver-side and bounded: heads of files, manifests, reports, names of files.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _open(spark, path)
    return fs.exists(p)


def files_below(spark: SparkSession, root: str) -> list[str]:
    """Paths of the files below a folder (of a file: itself), in order of
    name, hidden ones and what lies in hidden folders left out."""
    fs, p = _open(spark, root)
    if not fs.exists(p):
        return []
    base, out = fs.makeQualified(p).toString().rstrip("/"), []
    found = fs.listFiles(p, True)
    while found.hasNext():
        name = found.next().getPath().toString()
        if not any(part[:1] in "._" for part in name[len(base) :].split("/") if part):
            out.append(name)
    return sorted(out)


def head(spark: SparkSession, path: str, n: int) -> bytes:
    """The first ``n`` bytes of a file, or of the first file of a folder."""
    found = files_below(spark, path)
    if not found:
        raise FileNotFoundError(path)
    fs, p = _open(spark, found[0])
    stream = fs.open(p)
    try:
        size = min(n, fs.getFileStatus(p).getLen())
        buffer = spark._jvm.java.nio.ByteBuffer.allocate(size)
        channel = spark._jvm.java.nio.channels.Channels.newChannel(stream)
        while buffer.hasRemaining() and channel.read(buffer) >= 0:
            pass
        return bytes(buffer.array())[: buffer.position()]
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str, encoding: str = "utf-8") -> None:
    """One file, replaced where it exists."""
    fs, p = _open(spark, path)
    stream = fs.create(p, True)
    try:
        stream.write(bytearray(text.encode(encoding)))
    finally:
        stream.close()


def read_text(spark: SparkSession, path: str, most: int = 16 << 20) -> str:
    """A small UTF-8 file; one of ``most`` bytes or more raises."""
    data = head(spark, path, most)
    if len(data) >= most:
        raise ValueError(f"{path} is no small file")
    return data.decode("utf-8-sig")
