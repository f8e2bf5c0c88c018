"""Amounts, periods and dates of ledger documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalize

#: Spanish month names and their short forms.
MONTHS = {
    "ENE": 1, "ENERO": 1, "FEB": 2, "FEBRERO": 2, "MAR": 3, "MARZO": 3, "ABR": 4, "ABRIL": 4, "MAY": 5, "MAYO": 5, "JUN": 6, "JUNIO": 6,
    "JUL": 7, "JULIO": 7, "AGO": 8, "AGOSTO": 8, "SEP": 9, "SEPT": 9, "SEPTIEMBRE": 9, "OCT": 10, "OCTUBRE": 10, "NOV": 11, "NOVIEMBRE": 11, "DIC": 12, "DICIEMBRE": 12,
}
MONTH_NAMES = ["enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"]
DATE = r"(?<!\d)(\d{1,2})([-/.])(\d{1,2}|[A-Za-zÁÉÍÓÚÜÑáéíóúüñ]{3,12})([-/.])(\d{2,4})(?!\d)"
YEAR_MONTH = r"(?<!\d)(\d{4})([-/])(\d{1,2})(?!\d)"


def decimal_value(c: Column) -> Column:
    """Commas dropped, blank and ``-`` are zero; null for anything that isn't a DECIMAL(38,10)."""
    bare = F.replace(F.trim(c), F.lit(","), F.lit(""))
    return F.when(bare.isin("", "-"), F.lit(0).cast("decimal(38,10)")).otherwise(bare.try_cast("decimal(38,10)"))


def period_index(year: Column, month: Column) -> Column:
    """Months since year 0; null unless the month is 1 to 12."""
    return F.when(month.between(1, 12), year * 12 + month - 1)


def month_number(text: Column) -> Column:
    name = F.regexp_replace(normalize(text), r"\.+$", "")
    table = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    return F.when(name.rlike(r"^\d+$"), name.cast("int")).otherwise(F.try_element_at(table, name))


def full_year(text: Column) -> Column:
    """Two digits below 70 are of this century."""
    y = text.cast("int")
    return F.when(F.length(text) == 2, y + F.when(y < 70, 2000).otherwise(1900)).otherwise(y)


def date_of(match: Column) -> Column:
    """The date of one day-first match; a day past the month's end is that end; null for no month."""
    part = lambda i: F.regexp_extract(match, DATE, i)
    month = month_number(part(3))
    first = F.when(month.between(1, 12), F.make_date(full_year(part(5)), month, F.lit(1)))
    day = F.least(part(1).cast("int"), F.dayofmonth(F.last_day(first)))
    return F.when(day >= 1, F.date_add(first, day - 1)).otherwise(F.last_day(first))


def dates_in(text: Column) -> Column:
    """Array of (raw, value): the day-first dates of a text, in order."""
    found = F.transform(F.regexp_extract_all(text, F.lit(DATE), F.lit(0)), lambda m: F.struct(m.alias("raw"), date_of(m).alias("value")))
    return F.filter(found, lambda x: x["value"].isNotNull())


def is_print_context(text: Column) -> Column:
    n = normalize(text)
    return n.contains("IMPRESION") | n.contains("CREACION") | n.contains("FECHA:")


def format_date_like(template: Column, value: Column) -> Column:
    """The first date of ``template`` replaced by ``value`` in its own format; null without one."""
    match = F.regexp_extract(template, DATE, 0)
    day, s1, month, s2, year = (F.regexp_extract(match, DATE, i) for i in range(1, 6))
    names = F.array(*[F.lit(x) for x in MONTH_NAMES])
    name = F.element_at(names, F.month(value))
    name = F.when(F.length(month) <= 4, F.substring(name, 1, 3)).otherwise(name)
    name = F.when(month == F.upper(month), F.upper(name)).when(F.substring(month, 1, 1) == F.upper(F.substring(month, 1, 1)), F.initcap(name)).otherwise(name)
    pad = lambda x, like: F.lpad(x.cast("string"), F.greatest(F.length(like), F.length(x.cast("string"))), F.lit("0"))
    made = F.concat(
        pad(F.dayofmonth(value), day), s1, F.when(month.rlike(r"^\d+$"), pad(F.month(value), month)).otherwise(name), s2,
        F.when(F.length(year) == 4, F.year(value).cast("string")).otherwise(F.lpad((F.year(value) % 100).cast("string"), 2, "0")),
    )
    at = F.call_function("instr", template, match)
    return F.when(match != "", F.concat(F.substring(template, F.lit(1), at - 1), made, F.substring(template, at + F.length(match), F.length(template))))


def shifted_period(shift, start: Column, year: Column, month: Column) -> tuple[Column, Column, Column]:
    """(start, year, month) moved by ``shift``; year and month follow the start, or, without one, the middle of their month."""
    moved = shift(start)
    base = F.coalesce(moved, shift(F.make_date(year, month, F.lit(15))))
    return moved, F.year(base), F.month(base)
