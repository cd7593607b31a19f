"""A folder of datasets: which files are datasets, under which keys, and how each is opened."""

from __future__ import annotations

import logging
import os
from collections.abc import Iterator

from pyspark.sql import SparkSession

from ..operators.catalog import Catalog
from .aggregate import JoinedSource, read_description
from .base import ArraySource, Dataset
from .chunks import SCHEMA_FILE, ChunkStore, open_stores
from .hdf5 import Hdf5Source
from .snapshots import VERSIONS, Snapshot

log = logging.getLogger(__name__)

# Extensions of array files, and of descriptions of several; case counts.
ARRAY_FILES = ("nc4", "nc", "h5")
DESCRIPTION = "ncml"
STORE = "slab"


def dataset_files(folder: str) -> Iterator[tuple[str, str]]:
    """``key, path`` of each dataset below a folder; names that start with a dot are skipped, but for the folder's own."""
    for top, folders, files in os.walk(folder, followlinks=True):
        stores = [d for d in folders if any(os.path.exists(os.path.join(top, d, x)) for x in (SCHEMA_FILE, VERSIONS))]
        folders[:] = sorted(d for d in folders if not d.startswith(".") and d not in stores)
        for name in sorted([*files, *stores]):
            extension = os.path.splitext(name)[1].removeprefix(".")
            wanted = extension == STORE if name in stores else extension in (*ARRAY_FILES, DESCRIPTION)
            if wanted and not name.startswith("."):
                path = os.path.join(top, name)
                yield os.path.relpath(path, folder), path


def open_source(spark: SparkSession, path: str) -> ArraySource:
    if os.path.isdir(path):
        return Snapshot(spark, path) if os.path.exists(os.path.join(path, VERSIONS)) else ChunkStore(spark, path)
    if path.endswith(f".{DESCRIPTION}"):
        dim, members = read_description(path)
        stores = all(os.path.exists(os.path.join(m, SCHEMA_FILE)) for m in members)
        opened = open_stores(spark, members) if stores else [open_source(spark, m) for m in members]
        return JoinedSource(opened, dim, lambda: os.stat(path).st_mtime_ns)
    return Hdf5Source(spark, path)


def open_dataset(spark: SparkSession, path: str, key: str | None = None) -> Dataset:
    return Dataset(os.path.basename(path) if key is None else key, open_source(spark, path))


def open_folder(spark: SparkSession, folder: str) -> Catalog:
    """All datasets below a folder; one that doesn't open is told of and left out."""
    found = {}
    for key, path in dataset_files(folder):
        try:
            found[key] = open_dataset(spark, path, key)
        except Exception as e:
            log.warning("can't open %s: %s", path, e)
    return Catalog(found)
