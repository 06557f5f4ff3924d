"""User extractors for payloads that no column expression reads: vectorised table functions."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.checks.registry import Extract
from tidemark.sources.base import PAYLOAD, finish, scrape_columns

# The functions travel to the executors with the query, no installation needed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Payloads of one batch to their samples: `row` (place of the payload in the batch), `name`,
# `value_raw` (text) and, if there are any, `tags` (a map of texts).
Parse = Callable[[pa.Array], pa.Table]

_FOUND = [
    T.StructField("seq", T.LongType()), T.StructField("name", T.StringType()),
    T.StructField("tags", T.MapType(T.StringType(), T.StringType())), T.StructField("value_raw", T.StringType()),
]
_TAGS = pa.map_(pa.string(), pa.string())


def _numbered(places: np.ndarray) -> np.ndarray:
    """The number of each sample within its payload, in the order found."""
    order = np.argsort(places, kind="stable")
    ordered, at = places[order], np.arange(len(places))
    begins = np.r_[True, ordered[1:] != ordered[:-1]][: len(places)]
    out = np.empty(len(places), np.int64)
    out[order] = at - np.maximum.accumulate(np.where(begins, at, 0))
    return out


def _handler(parse: Parse, keep: list[str]) -> type:
    class Extractor:
        def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
            found = parse(batch.column(PAYLOAD))
            at = found.column("row").combine_chunks()
            n = len(at)
            columns = {c: batch.column(c).take(at) for c in keep}
            columns["seq"] = pa.array(_numbered(at.to_numpy(zero_copy_only=False)), pa.int64())
            columns["name"] = found.column("name").cast(pa.string())
            columns["tags"] = found.column("tags").cast(_TAGS) if "tags" in found.column_names else pa.array([[]] * n, _TAGS)
            columns["value_raw"] = found.column("value_raw").cast(pa.string())
            yield pa.table(columns)

    return Extractor


def table_function(parse: Parse, scrape: T.StructType):
    """`parse` as a table function over a table of scrapes: the columns of `scrape`, seq, name, tags, value_raw."""
    return F.arrow_udtf(_handler(parse, scrape.names), returnType=T.StructType([*scrape.fields, *_FOUND]))


def table_extract(parse: Parse) -> Extract:
    """`parse` as the extraction job of a check: `register("mine", Check("mine", table_extract(parse), ...))`.

    It gets whole batches of payloads as Arrow arrays and finds its samples with vectorised functions. Missing
    payloads are kept from it; what it does not return gives no sample.
    """

    def extract(df: DataFrame) -> DataFrame:
        keep = scrape_columns(df)
        rows = df.select(*keep, PAYLOAD).filter(F.col(PAYLOAD).isNotNull())
        found = table_function(parse, T.StructType([df.schema[c] for c in keep]))(rows.asTable())
        return finish(found, keep)

    return extract


def register_table_function(spark: SparkSession, name: str, parse: Parse, scrape: T.StructType) -> None:
    """Make `parse` known to SQL: `SELECT * FROM name(TABLE(raw_scrapes))`."""
    spark.udtf.register(name, table_function(parse, scrape))
