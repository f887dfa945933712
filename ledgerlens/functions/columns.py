"""Column helpers shared by all reports.

Every helper returns a built-in Spark ``Column`` expression, so it runs inside
whole-stage codegen on the executors; nothing here calls back into Python per row.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, datetime, time, timedelta

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..params import LABEL_FAILED, LABEL_SUCCEEDED, as_date, check_grain

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def in_date_range(ts: ColumnOrName, start: date | str, end: date | str) -> Column:
    """``cast(ts as date)`` between ``start`` and ``end``, both ends inclusive.

    Written as a half-open range on the raw timestamp (``start 00:00 <= ts <
    end+1 00:00``) so that the comparison stays on the stored column and reaches
    the Parquet scan as a pushed filter (row-group / file pruning). The bounds are
    typed ``timestamp_ntz`` (wall-clock), matching how the ledger stores UTC times.
    """
    lo = datetime.combine(as_date(start), time.min)
    hi = datetime.combine(as_date(end) + timedelta(days=1), time.min)
    c = _col(ts)
    # Bounds are built from text, not from Python datetimes: a datetime literal would
    # pass through the Python process's local zone and then the session zone.
    return (c >= _ntz(lo)) & (c < _ntz(hi))


def _ntz(moment: datetime) -> Column:
    return F.lit(moment.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")


def date_bucket(d: ColumnOrName, grain: str) -> Column:
    """Start of the day / week (Monday) / month holding date ``d``, as a ``date``.

    Pure date arithmetic (``trunc`` for week and month, the date itself for day;
    ``trunc(d, 'day')`` would be NULL), so no session time zone is involved.
    """
    g = check_grain(grain)
    c = _col(d).cast("date")
    return c if g == "day" else F.trunc(c, g)


def time_bucket(ts: ColumnOrName, grain: str) -> Column:
    """Start of the day / week (Monday) / month holding timestamp ``ts``, as
    ``timestamp_ntz`` (midnight of the bucket's first day)."""
    return date_bucket(F.to_date(_col(ts)), grain).cast("timestamp_ntz")


def safe_double(text: ColumnOrName) -> Column:
    """Text to double, or NULL when the text is not a plain decimal number.

    ``try_cast`` already gives NULL for arrays / objects rendered as JSON text,
    booleans, empty or non-numeric text. Java's float parser also accepts a
    ``d``/``f`` type suffix (``"1d"``), which is not a number in SQL, so such text
    is turned to NULL first. The text is evaluated twice, once for the test, once cast.
    """
    t = _col(text)
    return F.when(~F.rtrim(t).rlike("[0-9.][dDfF]$"), t).try_cast("double")


def contains_any_ci(c: ColumnOrName, needles: Iterable[str]) -> Column:
    """True when ``c`` contains any needle, ignoring case; NULL input gives NULL (dropped).

    One regular expression of quoted literals over one ``lower(c)``: the input is
    evaluated once per row, which matters when it is a JSON leaf (an OR of
    ``contains`` terms would re-evaluate the leaf per needle after predicate pushdown).
    """
    quoted = []
    for n in needles:
        if "\\E" in n:
            raise ValueError(f"needle {n!r} contains the regex quote terminator")
        quoted.append("\\Q" + n.lower() + "\\E")
    if not quoted:
        raise ValueError("needles must not be empty")
    return F.lower(_col(c)).rlike("|".join(quoted))


def status_label(flag: ColumnOrName) -> Column:
    """'Succeeded' for a true flag, 'Failed' for false **and for NULL**."""
    return F.when(_col(flag), F.lit(LABEL_SUCCEEDED)).otherwise(F.lit(LABEL_FAILED))


def rounded_ratio(num: ColumnOrName, den: ColumnOrName) -> Column:
    """``round(num / den)`` half away from zero; NULL instead of an error when ``den`` is 0."""
    return F.round(F.try_divide(_col(num), _col(den)))


def share_within(n: ColumnOrName, *partition_cols: str) -> Column:
    """``n`` divided by the sum of ``n`` over its partition; 0.0 when that sum is 0 or NULL.

    With no partition columns the share is of the grand total (one window partition),
    which callers only use on results with a fixed, tiny number of rows.
    """
    w = Window.partitionBy(*partition_cols)
    return F.coalesce(F.try_divide(_col(n), F.sum(_col(n)).over(w)), F.lit(0.0))


def hash_part(id_col: ColumnOrName, sep: str = "_") -> Column:
    """Text before the first ``sep`` (the whole text if there is none)."""
    return F.split_part(_col(id_col), F.lit(sep), F.lit(1))
