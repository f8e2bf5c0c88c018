from pyspark.sql import functions as F

from quillstone.functions import descriptions
from quillstone.functions.keyed import Pseudonyms
from quillstone.sources import xml


def spans(spark, rule, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.s for r in df.select("i", rule(F.col("t")).alias("s")).orderBy("i").collect()]


def test_identifiers_are_cut_where_they_were_found(spark):
    a, b, c = spans(spark, descriptions.cell_rules, "Saldo 1,234.50 Cliente Uno Dos ref 234", "Comercial Ejemplo ñab010101ab1", "Gastos generales 2024")
    assert (a.identifier, a.entity, a.at) == ("234", "Saldo 1,234.50 Cliente Uno Dos ref", 36)
    assert (b.identifier, b.entity) == ("ñab010101ab1", "Comercial Ejemplo")
    assert c is None


def test_bank_context_of_lines(spark):
    parent = lambda c: descriptions.line_rules(c, F.lit(True), F.lit("BANCO NORTE"))
    assert [s.entity for s in spans(spark, parent, "0012345678", "Sucursal centro 55512")] == ["BANCO NORTE", "Sucursal centro"]
    assert spans(spark, parent, "Saldos 2026") == [None]
    assert spans(spark, descriptions.line_rules, "BANCO 2026")[0].identifier == "2026"


def test_amounts_stay_in_masked_texts(spark):
    text = "Saldo 1,234.50 Cliente Uno Dos ref 234"
    df, p = Pseudonyms(spark, "a seed of sixteen or more characters").bound(spark.createDataFrame([(text,)], "t string").select("t", descriptions.cell_rules(F.col("t")).alias("s")))
    got = df.select(descriptions.masked(F.col("t"), F.col("s"), p).alias("m")).first().m
    assert "Cliente Uno" not in got and not got.endswith(" 234") and len(got.split()[-1]) == 3


ROOT = '<?xml version="1.0" encoding="{e}"?><b:Balanza xmlns:b="urn:x" Version="1.3" RFC="AAA010101AB1" Anio="2024" Mes="05" TipoEnvio="N" FechaModBal="2024-05-31" Sello="abc"><b:Ctas NumCta="101" SaldoIni="1" Debe="2" Haber="3" SaldoFin="0"/></b:Balanza>'


def test_encodings_dates_and_signatures_of_xml(spark):
    files = [("u", ROOT.format(e="UTF-8").encode()), ("l", ROOT.format(e="ISO-8859-1").replace("urn:x", "urn:ñ").encode("latin-1")), ("bad", ROOT.format(e="UTF-8").encode() + b"\xff\xfe")]
    df = spark.createDataFrame([(p, len(c), bytearray(c)) for p, c in files], "path string, length long, content binary")
    docs = {r.path: r for r in xml.documents(df).collect()}
    assert (docs["u"].error_code, docs["l"].error_code, docs["bad"].error_code) == (None, None, "XML_ENCODING_UNSUPPORTED")
    assert 'encoding="UTF-8"' in docs["l"].text and "urn:ñ" in docs["l"].text and docs["u"].modified == "2024-05-31"
    moved = lambda c: F.add_months(c, -14)
    days = spark.createDataFrame([("2024-05-30",), ("2024-05-30T10:00:00",), ("30/05/2024",), ("mayo",), (None,)], "d string")
    assert [r.n for r in days.select(xml.shifted_day(F.col("d"), moved, F.lit("drawn")).alias("n")).collect()] == ["2023-03-30", "2023-03-30T10:00:00", "30/03/2023", "drawn", None]
    bare = spark.createDataFrame([(docs["u"].text,)], "t string").select(xml.without_signature(F.col("t")).alias("t")).first().t
    assert "Sello" not in bare and xml.NOTICE in bare and 'RFC="AAA010101AB1"' in bare
