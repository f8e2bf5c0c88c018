"""Text keys of ledger documents: normalisation, account codes, association keys, legal forms."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _marked_letters() -> tuple[str, str]:
    """Precomposed letters of the Latin, Greek and Cyrillic blocks and their bare letters, by Unicode decomposition."""
    found = []
    for code in [*range(0xC0, 0x530), *range(0x1E00, 0x2000)]:
        bare = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if unicodedata.category(c) != "Mn")
        if len(bare) == 1 and bare != chr(code):
            found.append((chr(code), bare))
    return "".join(a for a, _ in found), "".join(b for _, b in found)


_MARKED, _BARE = _marked_letters()


def normalize(c: Column) -> Column:
    """Upper case without marks, white space runs as one space, trimmed.  ASCII text skips the mark removal."""
    up = F.upper(c)
    bare = F.when(F.octet_length(up) == F.char_length(up), up).otherwise(F.regexp_replace(F.translate(up, _MARKED, _BARE), r"\p{Mn}", ""))
    return F.trim(F.regexp_replace(bare, r"(?U)\s+", " "))


def compact(c: Column) -> Column:
    """Normalised letters A-Z and digits only."""
    return F.regexp_replace(normalize(c), "[^A-Z0-9]", "")


def account_code(c: Column) -> Column:
    """Numeric segments joined by ``.``; other codes normalised.  Leading zeros stay."""
    bare = F.regexp_replace(c, r"(?U)\s+", "")
    return F.when(bare.rlike(r"^\d+(?:[.-]\d+)*$"), F.translate(bare, "-", ".")).otherwise(normalize(c))


def account_alias(code: Column) -> Column:
    """A normalised code whose segments lost leading zeros; null for codes that aren't numeric."""
    return F.when(code.rlike(r"^\d+(?:\.\d+)*$"), F.regexp_replace(code, r"(^|\.)0+(?=\d)", "$1"))


def association_key(entity: Column, identifier: Column) -> Column:
    """One key for an entity and its identifier however they are punctuated."""
    name = F.regexp_replace(normalize(entity), r"\b(?:CTA|CUENTA|CLABE|TARJETA|CLIENTE)\.?\s*[:.#-]?\s*$", "")
    name = F.btrim(name, F.lit(" :-;,.\t"))
    digits = F.regexp_replace(identifier, r"\D", "")
    own = F.when(digits != "", digits).otherwise(F.regexp_replace(normalize(identifier), "[^A-Z0-9&Ñ]", ""))
    return normalize(F.concat(name, F.lit(":"), own))


#: Legal suffixes (words, canonical form); the first that fits counts.
LEGAL_SUFFIXES = [
    ("SOCIEDAD ANONIMA PROMOTORA DE INVERSION DE CAPITAL VARIABLE", "S.A.P.I. DE C.V."),
    ("SAPI DE CV", "S.A.P.I. DE C.V."),
    ("S A P I DE C V", "S.A.P.I. DE C.V."),
    ("SOCIEDAD DE RESPONSABILIDAD LIMITADA DE CAPITAL VARIABLE", "S. DE R.L. DE C.V."),
    ("S DE RL DE CV", "S. DE R.L. DE C.V."),
    ("S DE R L DE C V", "S. DE R.L. DE C.V."),
    ("SOCIEDAD ANONIMA DE CAPITAL VARIABLE", "S.A. DE C.V."),
    ("SA DE CV", "S.A. DE C.V."),
    ("S A DE C V", "S.A. DE C.V."),
    ("SOCIEDAD POR ACCIONES SIMPLIFICADA", "S.A.S."),
    ("SAS", "S.A.S."),
    ("S A S", "S.A.S."),
    ("ASOCIACION CIVIL", "A.C."),
    ("AC", "A.C."),
    ("A C", "A.C."),
    ("SOCIEDAD CIVIL", "S.C."),
    ("SC", "S.C."),
    ("S C", "S.C."),
    ("SOCIEDAD ANONIMA", "S.A."),
    ("SA", "S.A."),
    ("S A", "S.A."),
]


def legal_suffix(c: Column) -> Column:
    """The canonical legal form at the end of a name, or ''."""
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(normalize(c), "[^A-Z]+", " ")))
    out = F.lit("")
    for suffix, form in reversed(LEGAL_SUFFIXES):
        out = F.when(F.endswith(words, F.lit(" " + suffix)), form).otherwise(out)
    return F.coalesce(out, F.lit(""))


def case_like(template: Column, value: Column) -> Column:
    """``value`` in the case of the letters of ``template``: upper, lower, capitalised or as it is."""
    letters = F.regexp_replace(template, r"\P{L}", "")
    first = F.substring(letters, 1, 1)
    rest = F.substring(letters, F.lit(2), F.greatest(F.length(letters) - 1, F.lit(0)))
    capital = F.concat(F.upper(F.substring(value, 1, 1)), F.lower(F.substring(value, F.lit(2), F.length(value))))
    return (
        F.when((letters != "") & (letters == F.upper(letters)), F.upper(value))
        .when((letters != "") & (letters == F.lower(letters)), F.lower(value))
        .when((first == F.upper(first)) & (rest != "") & (rest == F.lower(rest)), capital)
        .otherwise(value)
    )


def replace_first(text: Column, old: Column, new: Column) -> Column:
    """The first occurrence of ``old`` replaced, literally."""
    at = F.call_function("instr", text, old)
    return F.when((at > 0) & (old != ""), F.concat(F.substring(text, F.lit(1), at - 1), new, F.substring(text, at + F.length(old), F.length(text)))).otherwise(text)
