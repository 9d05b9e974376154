"""Strings, dates in text, digests and display formats as columns, and canonical JSON."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

DATE_TOKEN = r"(?<!\d)(\d{4}-\d{2}-\d{2})(?!\d)"
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def rfc3339(value: Column) -> Column:
    """An instant; digits beyond microseconds are cut off."""
    return F.to_timestamp(F.regexp_replace(value, r"(\.\d{6})\d*", "$1"))


def dates_in(text: Column) -> Column:
    """All real ISO dates in a text, in order."""
    found = F.transform(F.regexp_extract_all(text, F.lit(DATE_TOKEN), F.lit(1)), lambda d: F.try_to_timestamp(d, F.lit("yyyy-MM-dd")).cast("date"))
    return F.filter(found, lambda d: d.isNotNull())


def feed_path(pair: Column, date: Column, hour: Column) -> Column:
    """Relative address of an hour's file; months count from zero."""
    return F.format_string("%s/%04d/%02d/%02d/%02dh_ticks.bi5", pair, F.year(date), F.month(date) - 1, F.dayofmonth(date), hour)


def hour_file(pair: Column, date: Column, hour: Column) -> Column:
    return F.format_string("%s_%s_%02dh.bi5", pair, date.cast("string"), hour)


def percent(part: Column, whole: Column, places: int = 2) -> Column:
    """``12.34%``, or a dash for an empty whole."""
    return F.when(whole == 0, "-").otherwise(F.concat(F.format_number(100.0 * part / whole, places), F.lit("%")))


def grouped(n: Column) -> Column:
    return F.format_number(n, 0)


def gib(size: Column) -> Column:
    return F.concat(F.format_number(size / float(1 << 30), 2), F.lit(" GiB"))


def mib(size: Column) -> Column:
    return F.concat(F.format_number(size / float(1 << 20), 1), F.lit(" MiB"))


def hours(seconds: Column) -> Column:
    return F.concat(F.format_number(seconds / 3600.0, 1), F.lit(" h"))


def years_between(first: Column, last: Column) -> Column:
    """Inclusive days over 365.25, to two places."""
    return F.round((F.datediff(last, first) + 1) / 365.25, 2)


def canonical_json(document: Any) -> str:
    """Sorted keys, no spaces, numbers rounded to six places."""

    def plain(x: Any) -> Any:
        if isinstance(x, float):
            return round(x, 6)
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, list | tuple) else x

    return json.dumps(plain(document), sort_keys=True, separators=(",", ":"), default=str)


def sha256_of(document: Any) -> str:
    return hashlib.sha256(canonical_json(document).encode()).hexdigest()


def sha256_column(content: Column) -> Column:
    return F.sha2(content, 256)
