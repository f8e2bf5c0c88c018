"""XML trial balances: gate, parse, rewrite, in SQL functions over ``binaryFile`` rows.

The gate comes before any parsing: XML functions expand internal entities.  Broken documents get an ``error_code`` and
no rows; nothing is raised on executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import decimal_value

MAX_BYTES, MAX_DEPTH = 50 << 20, 64
ROOT = r"(?s)<(?:[\w.-]+:)?Balanza\b[^>]*>"
DECLARED = r"^(\s*<\?xml[^>]*?encoding\s*=\s*[\"'])[^\"']*"
ONE_BYTE = r"(?i)^\s*<\?xml[^>]*?encoding\s*=\s*[\"'](?:iso-8859-1|latin-?1|us-ascii)[\"']"
SIGNATURE = ("Sello", "Certificado", "noCertificado")
NOTICE = '<?balance-anonymizer status="anonymized-not-for-fiscal-submission"?>'
_LINE = "_NumCta string, _SaldoIni string, _Debe string, _Haber string, _SaldoFin string"
SCHEMA = f"_Version string, _RFC string, _Anio string, _Mes string, _TipoEnvio string, _FechaModBal string, _Sello string, _Certificado string, _noCertificado string, Ctas array<struct<{_LINE}>>"


def gate(files: DataFrame) -> DataFrame:
    """files(path, length, content) with text and error_code (null: may be parsed)."""
    raw = F.col("content").cast("string")
    # every byte string is valid in a one-byte encoding; the text that is written is UTF-8, and says so
    one_byte = F.regexp_replace(F.decode("content", "ISO-8859-1"), DECLARED, "$1UTF-8")
    is_one_byte = F.decode(F.substring(F.col("content"), 1, 200), "ISO-8859-1").rlike(ONE_BYTE)
    text = F.when(F.col("length") <= MAX_BYTES, F.when(is_one_byte, one_byte).when(F.is_valid_utf8(raw), raw))
    out = files.withColumn("text", F.explode(F.array(text)))
    up = F.upper("text")
    depth = F.aggregate(
        F.regexp_extract_all(F.col("text"), F.lit(r"<(/?)[A-Za-z_][^<>]*?(/?)>"), F.lit(0)),
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")),
        lambda a, t: F.when(t.startswith("</"), F.struct((a["now"] - 1).alias("now"), a["most"].alias("most")))
        .when(t.endswith("/>"), F.struct(a["now"].alias("now"), F.greatest(a["most"], a["now"] + 1).alias("most")))
        .otherwise(F.struct((a["now"] + 1).alias("now"), F.greatest(a["most"], a["now"] + 1).alias("most"))),
        lambda a: a["most"],
    )
    root = F.regexp_extract("text", ROOT, 0)
    code = (
        F.when(F.col("length") > MAX_BYTES, "XML_TOO_LARGE")
        .when(F.col("text").isNull(), "XML_ENCODING_UNSUPPORTED")
        .when(F.instr(up, "<!DOCTYPE") + F.instr(up, "<!ENTITY") > 0, "XML_UNSAFE")
        .when(root == "", "XML_ROOT_UNSUPPORTED")
        .when(~root.contains("xmlns"), "XML_NAMESPACE_MISSING")
        .when(depth > MAX_DEPTH, "XML_TOO_DEEP")
    )
    return out.withColumn("error_code", code)


def documents(files: DataFrame) -> DataFrame:
    """path, the root's fields, lines (array), error_code."""
    gated = gate(files)
    x = F.when(F.col("error_code").isNull(), F.from_xml("text", F.lit(SCHEMA), {"ignoreNamespace": "true", "attributePrefix": "_", "mode": "PERMISSIVE"}))
    out = gated.select("path", "text", "error_code", x.alias("x"))
    missing = F.col("x").isNull()
    for f in ("Version", "RFC", "Anio", "Mes", "TipoEnvio"):
        missing = missing | F.col(f"x._{f}").isNull()
    year, month = F.col("x._Anio").try_cast("int"), F.col("x._Mes").try_cast("int")
    code = F.coalesce(
        "error_code", F.when(missing, "XML_ATTRIBUTES_MISSING"), F.when(year.isNull() | ~month.between(1, 12) | month.isNull(), "XML_PERIOD_INVALID"),
        F.when(F.coalesce(F.size("x.Ctas"), F.lit(0)) <= 0, "XML_LEDGER_EMPTY"),
    )
    return out.select("path", "text", F.col("x._RFC").alias("owner_rfc"), year.alias("year"), month.alias("month"), F.col("x._Version").alias("version"), F.col("x._TipoEnvio").alias("send_type"), F.coalesce(*[F.col(f"x._{a}") for a in SIGNATURE]).isNotNull().alias("is_signed"), F.col("x._FechaModBal").alias("modified"), F.col("x.Ctas").alias("lines"), code.alias("error_code"))


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, line_ord, account_code, amounts as exact decimals and as written, line_error."""
    each = docs.where("error_code is null").select(F.col("path").alias("doc_id"), F.posexplode("lines").alias("line_ord", "c"))
    fields = {"saldo_inicial": "_SaldoIni", "debe": "_Debe", "haber": "_Haber", "saldo_final": "_SaldoFin"}
    raw = F.create_map(*[x for k, f in fields.items() for x in (F.lit(k), F.col(f"c.{f}"))])
    amounts = [decimal_value(F.col(f"c.{f}")).alias(k) for k, f in fields.items()]
    out = each.select("doc_id", "line_ord", F.col("c._NumCta").alias("account_code"), F.lit(None).cast("string").alias("nature"), *amounts, raw.alias("amount_text"))
    bad = F.col("account_code").isNull()
    for k in fields:
        bad = bad | F.col(k).isNull()
    return out.withColumn("line_error", F.when(bad, "AMOUNT_INVALID"))


def with_attribute(text: Column, name: str, value: Column) -> Column:
    """One attribute of the root element set; every other character stays."""
    root = F.regexp_extract(text, ROOT, 0)
    at = F.call_function("instr", text, root)
    pattern = rf"(?s)^(.*?\b{name}\s*=\s*[\"'])[^\"']*(.*)$"
    new = F.concat(F.regexp_extract(root, pattern, 1), value, F.regexp_extract(root, pattern, 2))
    changed = F.concat(F.substring(text, F.lit(1), at - 1), new, F.substring(text, at + F.length(root), F.length(text)))
    return F.when(value.isNull() | ~root.rlike(pattern), text).otherwise(changed)


def without_signature(text: Column) -> Column:
    """The signature attributes of the root element removed, and a notice before it that says so."""
    root = F.regexp_extract(text, ROOT, 0)
    at = F.call_function("instr", text, root)
    bare = F.regexp_replace(root, rf"\s+(?:[\w.-]+:)?(?:{'|'.join(SIGNATURE)})\s*=\s*(?:\"[^\"]*\"|'[^']*')", "")
    return F.when(bare == root, text).otherwise(F.concat(F.substring(text, F.lit(1), at - 1), F.lit(NOTICE), bare, F.substring(text, at + F.length(root), F.length(text))))


def shifted_day(written: Column, moved: Column, drawn: Column) -> Column:
    """An ISO or day-first date, with or without a time of day, as ``moved(date)`` in its own format; anything else becomes ``drawn``."""
    iso, day_first = r"^(\d{4})-(\d{2})-(\d{2})(T[\d:.+Z-]*)?$", r"^(\d{1,2})([/.-])(\d{1,2})\2(\d{4})$"
    part = lambda pattern, i: F.regexp_extract(written, pattern, i)
    a = moved(F.try_to_date(F.concat_ws("-", part(iso, 1), part(iso, 2), part(iso, 3)), "yyyy-MM-dd"))
    b = moved(F.try_to_date(F.concat_ws("-", part(day_first, 4), F.lpad(part(day_first, 3), 2, "0"), F.lpad(part(day_first, 1), 2, "0")), "yyyy-MM-dd"))
    sep = part(day_first, 2)
    like_b = F.concat(F.date_format(b, "dd"), sep, F.date_format(b, "MM"), sep, F.date_format(b, "yyyy"))
    return F.when(written.rlike(iso) & a.isNotNull(), F.concat(F.date_format(a, "yyyy-MM-dd"), part(iso, 4))).when(written.rlike(day_first) & b.isNotNull(), like_b).when(written.isNotNull(), drawn)


def rewritten(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """docs with new_text, the owner and period of ``plan`` (path, new_rfc, new_year, new_month, optionally new_modified) in place of their own."""
    out = docs.join(plan, "path")
    text = with_attribute(F.col("text"), "RFC", F.col("new_rfc"))
    text = with_attribute(text, "Anio", F.col("new_year").cast("string"))
    text = with_attribute(text, "Mes", F.lpad(F.col("new_month").cast("string"), 2, "0"))
    return out.withColumn("new_text", with_attribute(text, "FechaModBal", F.col("new_modified")) if "new_modified" in plan.columns else text)
