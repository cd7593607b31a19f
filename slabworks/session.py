"""What a session needs to run this package's functions on its workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def shared_path(spark: SparkSession, what: str) -> str:
    """The path of a new folder that the driver and all executors see: below ``spark.checkpoint.dir``, or, where that isn't set, of this machine alone until the driver ends."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="slabworks-")
        atexit.register(shutil.rmtree, root, True)
    return f"{root.rstrip('/')}/slabworks-{what}-{uuid.uuid4().hex}"


def shared_folder(spark: SparkSession, what: str) -> str:
    """``shared_path`` as a folder that exists, by a path that ``open`` takes."""
    path = posix(shared_path(spark, what))
    os.makedirs(path)
    return path


def posix(path: str) -> str:
    """The path of a folder on a mounted file system, as ``open`` takes it."""
    path = "/" + path[5:].lstrip("/") if path.startswith("file:") else path
    if "://" in path:
        raise ValueError(f"this needs a folder on a mounted file system, not {path}")
    return path


def importable(spark: SparkSession) -> SparkSession:
    """Put the package on the path of Python workers, for sessions begun in another folder.

    Executors that don't share the folder need the package installed or sent along
    with ``--py-files``.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file whole or not at all, on whatever file system Spark reaches by the path."""
    fs, p = _file_system(spark, path)
    tmp = p.suffix(f".{uuid.uuid4().hex}.tmp")
    out = fs.create(tmp, True)
    out.write(text.encode())
    out.close()
    if fs.exists(p):
        fs.delete(p, False)
    if not fs.rename(tmp, p):
        raise OSError(f"can't write {path}")


def write_once(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file whole unless there is one; whether this call wrote it, of all that try at once.

    A file written beside it is renamed, which fails where the name is taken: by a hard
    link on a mounted file system, elsewhere by a rename of Hadoop's without overwriting.
    """
    fs, p = _file_system(spark, path)
    fs.mkdirs(p.getParent())
    if fs.getUri().getScheme() != "file":
        return rename_new(spark, path, text)
    tmp = f"{posix(path)}.{uuid.uuid4().hex}.tmp"
    with open(tmp, "w", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    try:
        os.link(tmp, posix(path))
        return True
    except FileExistsError:
        return False
    finally:
        os.unlink(tmp)


def rename_new(spark: SparkSession, path: str, text: str) -> bool:
    """``write_once`` by a rename that doesn't overwrite; as atomic as the file system's rename is."""
    sc, (fs, p) = spark.sparkContext, _file_system(spark, path)
    tmp = p.suffix(f".{uuid.uuid4().hex}.tmp")
    out = fs.create(tmp, False)
    out.write(text.encode())
    out.close()
    kind = getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename")
    options = sc._gateway.new_array(kind, 1)
    options[0] = kind.NONE
    try:
        sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), sc._jsc.hadoopConfiguration()).rename(fs.makeQualified(tmp), fs.makeQualified(p), options)
        return True
    except Exception:
        if not fs.exists(p):
            raise
        return False
    finally:
        fs.delete(tmp, False)


def names_in(spark: SparkSession, path: str) -> dict[str, int]:
    """What a folder holds, each with its time of change in milliseconds; nothing if there is no folder."""
    fs, p = _file_system(spark, path)
    return {s.getPath().getName(): s.getModificationTime() for s in fs.listStatus(p)} if fs.exists(p) else {}


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _file_system(spark, path)
    found = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(found, "UTF-8")
    finally:
        found.close()


def modified(spark: SparkSession, path: str) -> int:
    """When a file was last changed, in milliseconds."""
    fs, p = _file_system(spark, path)
    return fs.getFileStatus(p).getModificationTime()


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    fs, p = _file_system(spark, path)
    fs.delete(p, True)


def plain(path: str) -> str:
    """A path as text that is the same however Spark spells it."""
    return "/" + path[5:].lstrip("/") if path.startswith("file:") else path.rstrip("/")
