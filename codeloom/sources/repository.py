"""Source files of a checked-out repository, listed, read and hashed by Spark tasks.

Spark's own file sources leave out names that begin with ``_`` or ``.``, and with
them every ``__init__.py``; so folders are listed level by level in the tasks, and
the bytes are read in the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.sources.workspace import Workspace

PYTHON_FILES = ("py",)
CPP_FILES = ("cpp", "cc", "cxx", "hpp", "hh", "hxx", "h")
#: Folders that are never searched, at any depth below the root.
PRUNED = frozenset({".git", ".venv", "__pycache__", "build", "dist"})
FILES_PER_TASK = 500
_ENTRY = "path string, uri string, folder boolean"


def _open(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(uri if not uri.startswith("file:/") or uri.startswith("file://") else "file://" + uri[5:])


def _wanted(name: str, extensions: Sequence[str]) -> bool:
    return "." in name and name.rpartition(".")[2].lower() in extensions


def _list(extensions: Sequence[str], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Folders and wanted files directly within each folder."""
    for pdf in batches:
        out = []
        for path, uri in zip(pdf["path"], pdf["uri"]):
            system, inner = _open(uri)
            for info in system.get_file_info(arrow_fs.FileSelector(inner)):
                below = (f"{path}/{info.base_name}".lstrip("/"), f"{uri.rstrip('/')}/{info.base_name}")
                if info.type == arrow_fs.FileType.Directory and info.base_name not in PRUNED:
                    out.append((*below, True))
                elif info.type == arrow_fs.FileType.File and _wanted(info.base_name, extensions):
                    out.append((*below, False))
        yield pd.DataFrame(out, columns=["path", "uri", "folder"])


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for path, uri in zip(pdf["path"], pdf["uri"]):
            system, inner = _open(uri)
            with system.open_input_stream(inner) as stream:
                data = stream.read()
            out.append((path, data.decode("utf-8", "replace"), data))
        yield pd.DataFrame(out, columns=["path", "content", "bytes"])


def list_repository(spark: SparkSession, root: str, extensions: Sequence[str] = PYTHON_FILES) -> DataFrame:
    """(path, uri) of the files of :func:`scan_repository`; one job per level of folders."""
    extensions = tuple(e.lower() for e in extensions)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        raise FileNotFoundError(root)
    uri = fs.makeQualified(path).toString()
    if fs.getFileStatus(path).isFile():
        found = spark.createDataFrame([(path.getName(), uri)], "path string, uri string")
        return found if _wanted(path.getName(), extensions) else found.limit(0)
    work = Workspace(spark, "listing")
    level, depth = spark.createDataFrame([("", uri, True)], _ENTRY), 0
    while True:
        # Folders of a level are spread by name, so that no task lists them all.
        entries = work.write(level.where("folder").repartition("uri").mapInPandas(lambda it: _list(extensions, it), _ENTRY), f"level{depth}")
        if entries.where("folder").isEmpty():
            break
        level, depth = entries, depth + 1
    every = spark.read.schema(_ENTRY).parquet(*[f"{work.root}/level{k}" for k in range(depth + 1)])
    return every.where("not folder").select("path", "uri")


def scan_repository(spark: SparkSession, root: str, extensions: Sequence[str] = PYTHON_FILES) -> DataFrame:
    """(path, content, content_sha256) of the files whose suffix, in either case, is one of ``extensions``.

    Paths are relative to ``root`` with forward slashes; a root that is one file
    gives that file, a missing one raises.  The digest is over the raw bytes;
    bytes that are not UTF-8 become replacement characters.
    """
    listed = list_repository(spark, root, extensions)
    listed = listed.repartition(max(1, -(-listed.count() // FILES_PER_TASK)), "path")
    read = listed.mapInPandas(_read, "path string, content string, bytes binary")
    return read.select("path", "content", F.sha2("bytes", 256).alias("content_sha256"))
