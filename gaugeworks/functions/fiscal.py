"""Fiscal calendar algebra as columns, and the parsing of period tokens."""

from __future__ import annotations

import re
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"FY(\d{4})(?:-Q([1-4])|-M(0[1-9]|1[0-2]))?")


def fiscal_month(d: Column, start: int = 4) -> Column:
    """1 in the month the fiscal year starts with."""
    return F.pmod(F.month(d) - start, F.lit(12)) + 1


def fiscal_quarter(d: Column, start: int = 4) -> Column:
    return (F.floor((fiscal_month(d, start) - 1) / 3) + 1).cast("int")


def fiscal_year(d: Column, start: int = 4) -> Column:
    """Named after the calendar year it ends in (a year that starts in January is that year)."""
    return F.year(d) + F.when((F.month(d) >= start) & F.lit(start > 1), 1).otherwise(0)


def period_token(d: Column, grain: str = "quarter", start: int = 4) -> Column:
    head = F.format_string("FY%04d", fiscal_year(d, start))
    if grain == "quarter":
        return F.concat(head, F.format_string("-Q%d", fiscal_quarter(d, start)))
    return head if grain == "year" else F.concat(head, F.format_string("-M%02d", fiscal_month(d, start)))


def month_bounds(d: Column) -> tuple[Column, Column]:
    return F.trunc(d, "month"), F.last_day(d)


def quarter_bounds(d: Column, start: int = 4) -> tuple[Column, Column]:
    first = F.add_months(F.trunc(d, "month"), -F.pmod(fiscal_month(d, start) - 1, F.lit(3)).cast("int"))
    return first, F.date_sub(F.add_months(first, 3), 1)


def year_bounds(d: Column, start: int = 4) -> tuple[Column, Column]:
    first = F.add_months(F.trunc(d, "month"), -(fiscal_month(d, start) - 1).cast("int"))
    return first, F.date_sub(F.add_months(first, 12), 1)


def describe(df: DataFrame, column: str, start: int = 4) -> DataFrame:
    """The date's fiscal coordinates as columns."""
    d = F.col(column)
    (ms, me), (qs, qe), (ys, ye) = month_bounds(d), quarter_bounds(d, start), year_bounds(d, start)
    return df.select(
        d.alias("d"), fiscal_year(d, start).alias("fiscal_year"), fiscal_quarter(d, start).alias("fiscal_quarter"), fiscal_month(d, start).cast("int").alias("fiscal_month"),
        period_token(d, "quarter", start).alias("quarter_token"), period_token(d, "month", start).alias("month_token"),
        ms.alias("month_start"), me.alias("month_end"), qs.alias("quarter_start"), qe.alias("quarter_end"), ys.alias("year_start"), ye.alias("year_end"),
    )


def add_months(d: date, n: int) -> date:
    """First of a month, n months on."""
    k = d.year * 12 + d.month - 1 + n
    return date(k // 12, k % 12 + 1, 1)


def period_bounds(token: str, start: int = 4) -> tuple[date, date]:
    """First and last day of FYyyyy, FYyyyy-Qn or FYyyyy-Mnn; anything else is an error."""
    m = _TOKEN.fullmatch(token)
    if not m:
        raise ValueError(f"not a fiscal period: {token!r}")
    first = date(int(m[1]) - (1 if start > 1 else 0), start, 1)
    at, n = (first, 12) if not m[2] and not m[3] else (add_months(first, 3 * (int(m[2]) - 1)), 3) if m[2] else (add_months(first, int(m[3]) - 1), 1)
    return at, add_months(at, n) - timedelta(days=1)


def describe_window(first: date, last: date, start: int = 4) -> dict:
    """Whether a window crosses fiscal periods."""
    year = lambda d: d.year + (1 if start > 1 and d.month >= start else 0)
    quarter = lambda d: ((d.month - start) % 12) // 3 + 1
    return {"days": (last - first).days + 1, "crosses_year": year(first) != year(last), "crosses_quarter": (year(first), quarter(first)) != (year(last), quarter(last))}


def months_in_window(windows: DataFrame, first: str = "ws", last: str = "we", start: int = 4) -> DataFrame:
    """Each calendar month that a window touches, with the days of overlap and of the month."""
    ws, we = F.col(first), F.col(last)
    rows = windows.withColumn("month_start", F.explode(F.sequence(F.trunc(ws, "month"), we, F.expr("interval 1 month")))).withColumn("month_start", F.to_date("month_start"))
    end = F.last_day("month_start")
    return rows.select(
        *windows.columns, "month_start", F.year("month_start").alias("year"), F.month("month_start").alias("month"), fiscal_month(F.col("month_start"), start).cast("int").alias("fiscal_month"),
        (F.datediff(F.least(end, we), F.greatest("month_start", ws)) + 1).alias("overlap_days"), F.dayofmonth(end).alias("days_in_month"),
    )
