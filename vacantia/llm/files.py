"""Files that tasks write to and read from the cluster's shared folder."""

from __future__ import annotations

import uuid

import pyarrow.fs
from pyspark.sql import SparkSession

from ..session import checkpoint_dir


def new_folder(spark: SparkSession, kind: str) -> str:
    """A folder name of its own in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def opened(place: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI, and the path within it."""
    if "://" not in place and not place.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), place
    return pyarrow.fs.FileSystem.from_uri(place if "://" in place else place.replace("file:", "file://", 1))


def own_name(folder: str, stem: str) -> str:
    """A name no other attempt of the task takes; readers learn it from what the task returns."""
    return f"{folder}/{stem}-{uuid.uuid4().hex}"
