"""Source name to reader.  A new board is one function and one entry."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..schemas import OBSERVATION
from . import boards, cards, embedded
from .landing import good, rejects

Reader = Callable[[DataFrame, DataFrame, DataFrame | None], DataFrame]


def _card_reader(source: str) -> Reader:
    return lambda landing, companies, jobs: cards.fetch(landing, companies, jobs, source).items


READERS: dict[str, Reader] = {
    "greenhouse": lambda landing, companies, jobs: boards.greenhouse(landing),
    "lever": lambda landing, companies, jobs: boards.lever(landing),
    "ashby": lambda landing, companies, jobs: boards.ashby(landing),
    "workday": lambda landing, companies, jobs: boards.workday(landing, companies),
    "wellfound": lambda landing, companies, jobs: embedded.wellfound(landing),
    "linkedin": _card_reader("linkedin"),
    "wuzzuf": _card_reader("wuzzuf"),
    "bayt": _card_reader("bayt"),
}

# Readers that look at one landing row at a time, so they also run on a stream.
STATELESS = ("greenhouse", "lever", "ashby", "wellfound")


def reader(source: str) -> Reader:
    if source not in READERS:
        raise ValueError(f"no reader for source {source!r}")
    return READERS[source]


def read_items(landing: DataFrame, companies: DataFrame, jobs: DataFrame | None = None, sources=None) -> DataFrame:
    """All sources' items in one frame, rejected ones marked."""
    parts = [reader(s)(landing, companies, jobs) for s in (sources or READERS)]
    return reduce(DataFrame.unionByName, parts)


def no_items(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], T.StructType([*OBSERVATION.fields, T.StructField("reject", T.StringType())]))


def read_observations(landing, companies, jobs=None, sources=None) -> DataFrame:
    return good(read_items(landing, companies, jobs, sources))


def read_rejects(landing, companies, jobs=None, sources=None) -> DataFrame:
    return rejects(read_items(landing, companies, jobs, sources))
