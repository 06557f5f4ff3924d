"""String column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.numbers import float_text

# Host-name limits and default ports.
HOST_MAX = 255
LABEL_PATTERN = r"^(?!-)[a-zA-Z0-9-]{1,63}(?<!-)$"
DEFAULT_PORTS = {"http": "80", "https": "443"}
MESSAGE_REPLACEMENTS = [("\n", ""), (":", " "), (",", " "), (";", "|"), ("%", " Percent")]

URL_PATTERN = r"^(?:([a-zA-Z]+)://)?([^:/?#]+)(?::([0-9]+))?"


def snake(col: Column) -> Column:
    """camelCase to snake_case, lower case."""
    return F.lower(F.regexp_replace(col, "([A-Z])", "_$1"))


def replace_chain(col: Column, pairs: list[tuple[str, str]]) -> Column:
    """Literal replacements, applied in order."""
    for old, new in pairs:
        col = F.replace(col, F.lit(old), F.lit(new))
    return col


def gc_name(col: Column) -> Column:
    """Collector display name to a tag: `G1 Young Generation` becomes `g1_young`."""
    short = replace_chain(col, [(" Generation", ""), ("ConcurrentMarkSweep", "cms")])
    return F.replace(F.lower(short), F.lit(" "), F.lit("_"))


def path_tag(col: Column, root: str = "rootfs") -> Column:
    """Mount point to a tag: outer slashes dropped, inner ones become `_`, `/` becomes `root`."""
    inner = F.replace(F.btrim(col, F.lit("/")), F.lit("/"), F.lit("_"))
    return F.when(inner == "", F.lit(root)).otherwise(inner)


def valid_host(col: Column) -> Column:
    """At most 255 characters (one trailing dot ignored), every label well formed."""
    bare = F.regexp_replace(col, r"\.$", "")
    return (F.length(col) <= HOST_MAX) & F.forall(
        F.split(bare, r"\."), lambda label: label.rlike(LABEL_PATTERN)
    )


def short_host(col: Column) -> Column:
    """First label of a valid host name, otherwise dots become underscores."""
    return F.when(valid_host(col), F.split(col, r"\.")[0]).otherwise(
        F.replace(col, F.lit("."), F.lit("_"))
    )


def url_host(url: Column) -> Column:
    """Host part; the scheme may be missing."""
    return F.regexp_extract(F.replace(url, F.lit(" "), F.lit("")), URL_PATTERN, 2)


def url_port(url: Column) -> Column:
    """Port in the URL, else the default of its scheme (http when missing)."""
    bare = F.replace(url, F.lit(" "), F.lit(""))
    port = F.regexp_extract(bare, URL_PATTERN, 3)
    secure = F.lower(F.regexp_extract(bare, URL_PATTERN, 1)) == "https"
    default = F.when(secure, DEFAULT_PORTS["https"]).otherwise(DEFAULT_PORTS["http"])
    return F.when(port != "", port).otherwise(default)


def url_endpoint(url: Column) -> Column:
    """`host_port` with dots replaced, usable as a tag; NULL if the URL has no host."""
    host = url_host(url)
    tag = F.concat(F.replace(host, F.lit("."), F.lit("_")), F.lit("_"), url_port(url))
    return F.when(host != "", tag)


def percent_from_text(col: Column) -> Column:
    """Number between `(` and `)` without `%`; 0.0 if there is none."""
    inside = F.regexp_extract(col, r"\(([^)]*)\)", 1)
    return F.coalesce(float_text(F.replace(inside, F.lit("%"), F.lit(""))), F.lit(0.0))


def clean_message(col: Column) -> Column:
    """Plug-in output on one line, without characters that break a message."""
    return replace_chain(col, MESSAGE_REPLACEMENTS)

