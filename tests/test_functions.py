"""Expressions against plain Python versions of the same rules."""

from __future__ import annotations

import calendar
import hashlib
import hmac
import re
import unicodedata
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quillstone.functions import descriptions, text, values
from quillstone.functions.keyed import Pseudonyms

SEED = "a seed of sixteen or more characters"


def plain_normalize(v):
    v = "".join(c for c in unicodedata.normalize("NFD", v.upper()) if unicodedata.category(c) != "Mn")
    return re.sub(r"\s+", " ", v).strip()


NAMES = ["Ñandú  S.A. de C.V.", "straße", "été", " a\tb c ", "", "Ångström Ő", "Грузия й", "SOCIEDAD CIVIL", "Casa Uno, S. de R.L. de C.V.", "mac", "x A.C."]


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame([(i, n) for i, n in enumerate(NAMES)], "i int, n string")


def column(df, c):
    return [r[0] for r in df.orderBy("i").select(c).collect()]


def test_normalize(names):
    assert column(names, text.normalize(F.col("n"))) == [plain_normalize(n) for n in NAMES]


def test_legal_suffix(names):
    assert column(names, text.legal_suffix(F.col("n"))) == ["S.A. DE C.V.", "", "", "", "", "", "", "S.C.", "S. DE R.L. DE C.V.", "", "A.C."]


def test_account_codes(spark):
    raw = [" 001-02 ", "1.2", "001", "1 0 1-3", "A-1", "1--2", ""]
    df = spark.createDataFrame(list(enumerate(raw)), "i int, n string")
    codes = column(df, text.account_code(F.col("n")))
    assert codes == ["001.02", "1.2", "001", "101.3", "A-1", "1--2", ""]
    assert column(df, text.account_alias(text.account_code(F.col("n")))) == ["1.2", "1.2", "1", "101.3", None, None, None]


def test_association_keys(spark):
    rows = [(0, "BANCO DEMO CTA.", "12-34"), (1, "Banco  Demo", "1234"), (2, "Casa Ñu cuenta:", "x-9&")]
    df = spark.createDataFrame(rows, "i int, e string, d string")
    got = column(df, text.association_key(F.col("e"), F.col("d")))
    assert got == ["BANCO DEMO:1234", "BANCO DEMO:1234", "CASA NU:9"]


def test_digest_and_month_offset(spark, names):
    p = Pseudonyms(spark, SEED, scope="Scope É")
    want = [hmac.new(SEED.encode(), f"ns:{plain_normalize(n)}".encode(), hashlib.sha256).hexdigest() for n in NAMES]
    assert column(names, p.digest("ns", F.col("n"))) == want
    candidates = [-v for v in range(13, 121) if v % 12]
    for n, got in zip(NAMES, column(names, p.month_offset(F.col("n")))):
        d = hmac.new(SEED.encode(), f"date-offset:{plain_normalize(n)}".encode(), hashlib.sha256).digest()
        assert got == candidates[int.from_bytes(d[:2], "big") % 99]
    with pytest.raises(ValueError):
        Pseudonyms(spark, "short")
    assert "spark_seed" not in SEED and SEED.encode().hex() not in names.select(p.digest("ns", F.col("n")))._jdf.queryExecution().toString()


def test_numeric_identifiers_differ_in_every_digit(spark):
    raw = ["4-55 1", "0000000000", "12" * 40, "no digits", "7"]
    df, p = Pseudonyms(spark, SEED).bound(spark.createDataFrame(list(enumerate(raw)), "i int, n string"))
    got = column(df, p.numeric_identifier(F.col("n"), F.lit("key")))
    assert got[3] is None
    for a, b in zip(raw, got):
        if b is not None:
            assert len(a) == len(b) and all((x != y) if x.isdigit() else x == y for x, y in zip(a, b))
    stream = b"".join(hmac.new(SEED.encode(), f"numeric-identifier:KEY:{'12' * 40}:{k}".encode(), hashlib.sha256).digest() for k in range(3))
    assert got[2] == "".join(str(n + (n >= int(c))) for c, n in zip("12" * 40, (b % 9 for b in stream)))


def test_shift_keeps_month_ends(spark):
    p = Pseudonyms(spark, SEED)
    days = [date(2024, 2, 29), date(2023, 2, 28), date(2024, 1, 31), date(2024, 3, 30), date(2024, 5, 15)]
    df = spark.createDataFrame(list(enumerate(days)), "i int, d date")
    off = column(df, p.month_offset())[0]
    for d, got in zip(days, column(df, p.shift_date(F.col("d")))):
        y, m = divmod(d.year * 12 + d.month - 1 + off, 12)
        last = calendar.monthrange(y, m + 1)[1]
        assert got == date(y, m + 1, last if d.day == calendar.monthrange(d.year, d.month)[1] else min(d.day, last))
    assert -120 <= off <= -13 and off % 12


def test_exercise_and_period_change(spark):
    p = Pseudonyms(spark, SEED)
    df = spark.createDataFrame([(i, "2024", str(m) if m < 10 and i % 2 else f"{m:02d}") for i, m in enumerate(range(1, 13))], "i int, y string, m string")
    y, m = p.exercise_and_period(F.col("y"), F.col("m"))
    for r in df.select("y", "m", y.alias("ny"), m.alias("nm")).collect():
        assert r.ny != r.y and int(r.nm) != int(r.m) and 1 <= int(r.nm) <= 12


def test_decimal_values(spark):
    raw = ["1,234.50", "-", " ", "-0001.2300", "1e2", "abc", "9" * 40, None]
    df = spark.createDataFrame(list(enumerate(raw)), "i int, n string")
    assert column(df, values.decimal_value(F.col("n"))) == [Decimal("1234.5"), 0, 0, Decimal("-1.23"), 100, None, None, None]


def test_dates(spark):
    rows = ["Fecha: 31/02/24", "del 1-ene-2020 al 31-Diciembre-2020", "1/13/2020", "no date", "05.06.69 y 05.06.70"]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, n string")
    got = [[x.value for x in f] for f in column(df, values.dates_in(F.col("n")))]
    assert got == [[date(2024, 2, 29)], [date(2020, 1, 1), date(2020, 12, 31)], [], [], [date(2069, 6, 5), date(1970, 6, 5)]]
    shown = column(df, values.format_date_like(F.col("n"), F.lit(date(2001, 9, 7))))
    assert shown == ["Fecha: 07/09/01", "del 7-sep-2001 al 31-Diciembre-2020", "7/09/2001", None, "07.09.01 y 05.06.70"]


SPANS = [
    ("Proveedor Uno XAXX010101000", "rfc_entidad_descripcion", "XAXX010101000"), ("HSBC Mexico CUENTA 41-78629", "banco_identificador_descripcion", "41-78629"), ("Cliente Grande 123456", "rfc_entidad_descripcion", "123456"),
    ("Servicios Generales 2026", None, None), ("IVA 16%", None, None), ("Saldo por 12,345.67", None, None), ("Banco solo", None, None), ("Uno 123456", None, None), ("", None, None),
]


def test_description_spans(spark):
    df = spark.createDataFrame([(i, s[0]) for i, s in enumerate(SPANS)], "i int, n string")
    got = column(df, descriptions.cell_rules(F.col("n")))
    assert [(g.category, g.identifier) if g else (None, None) for g in got] == [s[1:] for s in SPANS]
    bound, p = Pseudonyms(spark, SEED).bound(df.withColumn("s", descriptions.cell_rules(F.col("n"))))
    out = column(bound, descriptions.masked(F.col("n"), F.col("s"), p))
    for (raw, kind, ident), new in zip(SPANS, out):
        assert new == raw if kind is None else ident not in new and new != raw


def test_replace_first_and_case(spark):
    df = spark.createDataFrame([(0, "a.b a.b", "a.b", "X"), (1, "none", "q", "X"), (2, "x", "", "X")], "i int, t string, o string, n string")
    assert column(df, text.replace_first(F.col("t"), F.col("o"), F.col("n"))) == ["X a.b", "none", "x"]
    df = spark.createDataFrame([(0, "ENERO"), (1, "enero"), (2, "Enero"), (3, "eNeRo")], "i int, t string")
    assert column(df, text.case_like(F.col("t"), F.lit("mayO"))) == ["MAYO", "mayo", "Mayo", "mayO"]
