"""Payloads opened once: parsed or split in one pass, what cannot be used set aside with a reason."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.shared import stored
from tidemark.sources.base import DOCUMENT, PAYLOAD
from tidemark.sources.exposition import page_lines, usable_lines

# How a check wants the payloads of its source: as text, as exposition samples, as a parsed
# document, or as text that has to be JSON.
LINES, EXPOSITION, PARSED, JSON_TEXT = "lines", "exposition", "document", "json"
HEAD = 120

REJECTED = ("reason", "position", "head")


def opening(raw: DataFrame, forms: dict[str, str]) -> DataFrame:
    """`raw` with `_form`, `_doc`, `_reason` and `_position`: one scan, every payload parsed at most once."""
    form = F.create_map(*[F.lit(x) for pair in forms.items() for x in pair])[F.col("source")]
    rows = raw.filter(F.col("source").isin(*forms)).withColumn("_form", form)
    as_json = F.col("_form").isin(PARSED, JSON_TEXT)
    rows = rows.withColumn(DOCUMENT, F.when(as_json, F.try_parse_json(PAYLOAD)))
    bare = F.trim(F.translate(PAYLOAD, "\r\n\t", "   "))
    broken = as_json & F.col(DOCUMENT).isNull()
    reason = (
        F.when(F.col(PAYLOAD).isNull(), "missing")
        .when(bare == "", "empty")
        .when(broken & ~F.left(bare, F.lit(1)).isin("{", "["), "not JSON")
        .when(broken & ~F.right(bare, F.lit(1)).isin("}", "]"), "cut off")
        .when(broken, "malformed JSON")
    )
    rows = rows.withColumn("_reason", reason)
    position = F.when(F.col("_reason") == "not JSON", 0).when(F.col("_reason") == "cut off", F.length(PAYLOAD))
    keep_text = F.col("_reason").isNotNull() | (F.col("_form") != PARSED)
    return rows.withColumns({
        "_position": position.cast("bigint"),
        DOCUMENT: F.when(F.col("_form") == PARSED, F.col(DOCUMENT)),
        PAYLOAD: F.when(keep_text, F.col(PAYLOAD)),
    })


def _rejected(df: DataFrame, columns: list[str], position: Column, text: Column) -> DataFrame:
    return df.select(*columns, F.col("_reason").alias("reason"), position.alias("position"), F.left(text, F.lit(HEAD)).alias("head"))


@dataclass(frozen=True)
class Opened:
    """Opened payloads, stored by form and source: a check reads its own source only."""

    landed: DataFrame
    columns: list[str]

    @cached_property
    def _pages(self) -> DataFrame:
        """Exposition lines of all sources, split once for all checks."""
        pages = self.landed.filter((F.col("_form") == EXPOSITION) & F.col("_reason").isNull())
        return stored(page_lines(pages.select(*self.columns, PAYLOAD)), "pages", partition_by=("source",))

    def of(self, source: str, form: str) -> DataFrame:
        """The usable payloads of a source."""
        if form == EXPOSITION:
            return usable_lines(self._pages).filter(F.col("source") == source)
        rows = self.landed.filter((F.col("_form") == form) & (F.col("source") == source) & F.col("_reason").isNull())
        return rows.select(*self.columns, DOCUMENT if form == PARSED else PAYLOAD)

    @property
    def rejects(self) -> DataFrame:
        """What could not be used: the scrape's columns, reason, position and the head of the text.

        Payloads that are missing, empty or no JSON, with the place where they end or fail to begin
        if that is known; and malformed lines of exposition pages, with their number.
        """
        whole = _rejected(self.landed.filter(F.col("_reason").isNotNull()), self.columns, F.col("_position"), F.col(PAYLOAD))
        bad = self._pages.filter(F.col("_reason").isNotNull())
        return whole.unionByName(_rejected(bad, self.columns, F.col("seq"), F.col("value_raw")))


def open_payloads(raw: DataFrame, forms: dict[str, str]) -> Opened:
    """Open the payloads of the sources in `forms`; others are left out. Runs the one job that reads `raw`."""
    columns = [c for c in raw.columns if c != PAYLOAD]
    return Opened(stored(opening(raw, forms), "opened", partition_by=("_form", "source")), columns)
