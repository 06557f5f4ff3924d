"""Row filters over lines and samples."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def allow(df: DataFrame, names: DataFrame | Sequence[str], col: str = "name") -> DataFrame:
    """Exact allow-list: literals, or a dimension with the same column."""
    if isinstance(names, DataFrame):
        wanted = names.select(F.col(names.columns[0]).alias(col)).distinct()
        return df.join(wanted, col, "left_semi")
    return df.filter(F.col(col).isin(*names))


def any_of(col: Column, texts: Sequence[str]) -> Column:
    return reduce(or_, [col.contains(t) for t in texts], F.lit(False))


def contains_any(df: DataFrame, col: str, texts: Sequence[str]) -> DataFrame:
    """Rows whose text holds any of the substrings."""
    return df.filter(any_of(F.col(col), texts))


def line_filter(
    df: DataFrame, starts: Sequence[str], excludes: Sequence[str] = (), col: str = "line"
) -> DataFrame:
    """Lines with one of the prefixes and none of the substrings; comments dropped."""
    line = F.col(col)
    keep = ~line.startswith("#")
    if starts:
        keep = keep & reduce(or_, [line.startswith(s) for s in starts])
    if excludes:
        keep = keep & ~any_of(line, excludes)
    return df.filter(keep)


def require(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows in which all the columns are present."""
    return df.filter(reduce(and_, [F.col(c).isNotNull() for c in cols]))


def positive(col: Column) -> Column:
    return col > 0


def non_negative(col: Column) -> Column:
    return col >= 0


def digits_only(col: Column) -> Column:
    return col.rlike("^[0-9]+$")


# Names of block devices that are no whole disk, by kind.
NOT_A_DISK = {
    "partition": r"(?:sd|hd|vd|xvd)[a-z]+\d+",
    "numbered partition": r"(?:nvme\d+n|mmcblk|md|nbd)\d+p\d+",
    "boot area": r"mmcblk\d+boot\d+",
    "optical drive": r"sr\d+",
    "in memory or a file": r"(?:zram|ram|loop)\d+",
}


def whole_disk(device: Column) -> Column:
    return ~device.rlike(f"^(?:{'|'.join(NOT_A_DISK.values())})$")


def not_loopback(interface: Column) -> Column:
    return ~interface.startswith("lo")


def allow_or_all(
    df: DataFrame, wanted: DataFrame | Sequence[str] | None, col: str
) -> DataFrame:
    """Entity allow-list; an empty or missing list lets everything through.

    A list that is a frame is read by the query itself: no job runs while it is built.
    """
    if wanted is None:
        return df
    if not isinstance(wanted, DataFrame):
        return allow(df, wanted, col) if wanted else df
    listed = wanted.select(F.col(wanted.columns[0]).alias("_listed")).filter(F.col("_listed").isNotNull()).distinct()
    nothing = wanted.agg(F.count(F.lit(1)) == 0).scalar()
    marked = df.join(listed, F.col(col) == F.col("_listed"), "left")
    return marked.filter(F.col("_listed").isNotNull() | nothing).drop("_listed")
