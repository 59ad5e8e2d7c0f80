"""Scalar functions: column expressions for data, plain ones for options and reports."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = {"": 1, "K": 1 << 10, "M": 1 << 20, "G": 1 << 30}
ROTATE_SIZE = (1 << 20, 64 << 30)


def iso_timestamp(seconds: Column, offset_minutes: Column) -> Column:
    """Unix seconds and an offset in minutes (east positive) as ``YYYY-MM-DDThh:mm:ss±hh:mm``; null if either is null.

    Made by date arithmetic on the epoch, so the session's time zone has no say.
    """
    local = seconds + offset_minutes * 60
    days = F.floor(local / 86_400)
    clock = local - days * 86_400
    two = lambda c: F.lpad(c.cast("long").cast("string"), 2, "0")
    date = F.date_add(F.to_date(F.lit("1970-01-01")), days.cast("int"))
    time = F.concat(F.lit("T"), two(F.floor(clock / 3600)), F.lit(":"), two(F.floor(clock / 60) % 60), F.lit(":"), two(clock % 60))
    sign = F.when(offset_minutes < 0, "-").otherwise("+")
    zone = F.abs(offset_minutes)
    return F.concat(F.date_format(date, "yyyy-MM-dd"), time, sign, two(F.floor(zone / 60)), F.lit(":"), two(zone % 60))


def session_stamp(at: Column) -> Column:
    """A time as ``YYYYMMDDThhmmssZ``, fractions cut off; takes a timestamp without zone in UTC."""
    return F.date_format(at, "yyyyMMdd'T'HHmmss'Z'")


def repository_name(url: Column, path: Column, override: Column | None = None) -> Column:
    """The override, else the last segment of the URL without ``.git``, else the last segment of the path."""
    segment = F.regexp_replace(F.element_at(F.split(url, "/"), -1), r"\.git$", "")
    base = F.element_at(F.filter(F.split(path, "/"), lambda p: p != ""), -1)
    derived = F.coalesce(F.when(segment != "", segment), base)
    return F.coalesce(override, derived) if override is not None else derived


def fact_id(oid: Column, path: Column | None = None) -> Column:
    """``oid``, or ``oid/path`` for a file change."""
    return oid if path is None else F.concat_ws("/", oid, path)


def message_lines(message: Column) -> Column:
    return F.split(message, r"\r?\n", -1)


def is_oid(column: Column, object_format: str = "sha1") -> Column:
    from chronoweave.schemas import OID_PATTERNS

    return F.coalesce(column.rlike(OID_PATTERNS[object_format]), F.lit(False))


def humanized_bytes(size: Column) -> Column:
    """A size with one decimal in steps of 1,024, up to GB."""
    scaled = lambda shift, unit: F.concat(F.format_string("%.1f", size / (1 << shift)), F.lit(unit))
    return (
        F.when(size.isNull(), F.lit(None)).when(size < 1 << 10, F.concat(size.cast("string"), F.lit("B"))).when(size < 1 << 20, scaled(10, "KB")).when(size < 1 << 30, scaled(20, "MB")).otherwise(scaled(30, "GB"))
    )


def parse_byte_size(text: str, least: int = 1, most: int | None = None) -> int:
    """``100``, ``100K``, ``1M``, ``2G`` in bytes; raises ValueError for anything else or beyond the limits."""
    if not (m := re.fullmatch(r"(\d+)([KMG]?)", text, re.I | re.A)):
        raise ValueError(f"not a size in bytes: {text!r}")
    size = int(m.group(1)) * UNITS[m.group(2).upper()]
    if size < least or most is not None and size > most:
        raise ValueError(f"size out of range: {text!r}")
    return size


def parse_positive(text: str) -> int:
    """A positive integer without leading zeros, in the safe range of a double."""
    if not re.fullmatch(r"[1-9]\d*", text, re.A) or int(text) > 2**53 - 1:
        raise ValueError(f"not a positive integer: {text!r}")
    return int(text)


def format_count(n: int) -> str:
    return f"{n:,}"


def format_size(n: int) -> str:
    """Bytes for people, as ``size_label`` has them."""
    for shift, unit in ((30, "GB"), (20, "MB"), (10, "KB")):
        if n >= 1 << shift:
            return f"{n / (1 << shift):.1f}{unit}"
    return f"{n}B"


def format_elapsed(milliseconds: float) -> str:
    return f"{milliseconds / 1000:.1f}s"
