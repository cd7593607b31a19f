"""Keys of datasets as folders."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class NotListed(KeyError):
    """No dataset or folder of that name."""


def _prefix(folder: str) -> str:
    return folder if not folder or folder.endswith("/") else f"{folder}/"


class Catalog:
    """Open datasets by key."""

    def __init__(self, datasets: Mapping[str, object] | Iterable[str]):
        self.datasets = dict(datasets) if isinstance(datasets, Mapping) else dict.fromkeys(datasets)

    def __len__(self) -> int:
        return len(self.datasets)

    def paths(self) -> list[str]:
        return list(self.datasets)

    def get(self, key: str):
        if key not in self.datasets:
            raise NotListed(key)
        return self.datasets[key]

    def folder(self, folder: str = "") -> tuple[list[str], list[str]]:
        """Names of the folders and of the datasets in a folder, each sorted.

        A folder without either is an error, as is a dataset's own key.
        """
        inside = [k.removeprefix(_prefix(folder)) for k in self.datasets if k.startswith(_prefix(folder))]
        folders = sorted({k[: k.index("/", 1)] for k in inside if "/" in k[1:]})
        names = sorted(k for k in inside if "/" not in k[1:])
        if not folders and not names:
            raise NotListed(folder)
        return folders, names

    def as_json(self) -> str:
        return json.dumps(self.paths())


def list_folder(keys: DataFrame, folder: str = "", key: str = "key") -> DataFrame:
    """``kind, name`` (``folder`` or ``dataset``) of what is in a folder, for catalogs that are tables.

    The prefix is a predicate of the scan; a name is one row however many keys have it.
    """
    prefix = _prefix(folder)
    inside = keys.where(F.col(key).startswith(prefix)).select(F.substring(key, len(prefix) + 1, 1 << 30).alias("rest"))
    deeper = F.instr("rest", "/") > 1
    return inside.select(F.when(deeper, "folder").otherwise("dataset").alias("kind"), F.when(deeper, F.substring_index("rest", "/", 1)).otherwise(F.col("rest")).alias("name")).distinct()
