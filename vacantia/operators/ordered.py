"""Running values along an order within a key, also where one key is huge.

The plain form is one window per key.  A key with more rows than one task should
hold is cut into blocks of its own order: each block runs alone, the blocks' ends
run over the blocks, and what they carry is joined back.  Blocks nest, so no
level ever puts more than a block's worth of one key into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOT_ROWS = 100_000


def running(
    df: DataFrame, key: str, order: Sequence[str], last: Sequence[str], first: Sequence[str] = (),
    blocks: Sequence[str] = (),
) -> DataFrame:
    """Add ``prior_<c>``, the last non-null c on earlier rows of the key, and
    ``first_<c>``, the value of c on the key's first row.

    ``blocks`` are columns, coarse to fine, that cut a key along its order: sorting
    by blocks and order is sorting by order.
    """
    w = Window.partitionBy(key, *blocks).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    own = df.select(
        "*",
        *[F.last(c, ignorenulls=True).over(before).alias(f"prior_{c}") for c in last],
        *[F.first(c).over(upto).alias(f"first_{c}") for c in first],
    )
    if not blocks:
        return own

    at = F.struct(*order)
    ends = df.groupBy(key, *blocks).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in last],
        *[F.min_by(c, at).alias(c) for c in first],
    )
    carried = running(ends, key, [blocks[-1]], last, first, blocks[:-1]).select(
        key, *blocks, *[F.col(f"prior_{c}").alias(f"_prior_{c}") for c in last],
        *[F.col(f"first_{c}").alias(f"_first_{c}") for c in first],
    )
    joined = own.join(carried, [key, *blocks], "left")
    return joined.select(
        *df.columns,
        *[F.coalesce(f"prior_{c}", f"_prior_{c}").alias(f"prior_{c}") for c in last],
        *[F.col(f"_first_{c}").alias(f"first_{c}") for c in first],
    )


def hot_keys(df: DataFrame, key: str, rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``rows`` rows; there are at most count / rows of them."""
    return df.groupBy(key).count().where(F.col("count") > rows).select(key)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key, by an aggregate: repeats are dropped before the shuffle."""
    kept = df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("row"))
    return kept.select("row.*")


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    kept = df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("row"))
    return kept.select("row.*")
