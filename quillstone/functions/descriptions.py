"""Sensitive spans in account descriptions: detection and masking, in SQL functions.

Two rule sets: ``cell_rules`` for spreadsheet cells, ``line_rules`` for laid-out text lines, in which a bank context may
be inherited from a parent row.  Both give a struct (category, identifier, entity, entity_key, confidence) or null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .keyed import Pseudonyms
from .text import association_key, normalize, replace_first

#: The patterns of tax ids, labelled and bare identifiers, legal forms and banks.
RFC = r"(?iu)(?<![A-Z0-9&Ñ])([A-Z&Ñ]{3,4}\d{6}[A-Z0-9]{3})(?![A-Z0-9])"
RFC_GLUED = r"(?iu)([A-Z&Ñ]{3,4}\d{6}[A-Z0-9]{3})(?![A-Z0-9])"
EXPLICIT = r"(?i)\b(?:CTA\.?|CUENTA|CLABE|TARJETA|(?:N[ÚU]M(?:ERO)?\.?\s+DE\s+)?CLIENTE)\s*[:.#-]?\s*(\d(?:[\d .-]*\d)?)(?!\d)"
GENERIC = r"(?<![\d,.])\d(?:[\d-]*\d){2,}(?![\d,.])"
GENERIC_LINE = r"(?<![\d,./:-])\d(?:[\d /-]*\d){2,}(?![\d,.%/:])"
LEGAL = r"(?i)\b(?:S\.?\s*A\.?|S\.?\s+DE\s+R\.?\s*L\.?|A\.?\s*C\.?|S\.?\s*C\.?)\b"
BANK = r"(?i)\b(?:BANCO|BANCOS|BANCARIA|BANCARIO|HSBC|BBVA|BANAMEX|SANTANDER|BANORTE)\b"
BANK_CONTEXT = r"\b(?:BANCO|BANCOS|BANCARIA|BANCARIO|CTA|CUENTA|CLABE|CHEQUE)\b"
WORD = r"[A-Za-zÁÉÍÓÚÜÑáéíóúüñ]{2,}"
EDGES = " :-;,.\t"
ENTITY, BANK_ID = "rfc_entidad_descripcion", "banco_identificador_descripcion"


def _letters(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"\P{L}", ""))


def _edge(c: Column) -> Column:
    return F.btrim(c, F.lit(EDGES))


def _place(text: Column, pattern: str) -> Column:
    return F.regexp_instr(text, F.lit(pattern))


def _without(text: Column, match: Column, at: Column) -> tuple[Column, Column]:
    """What comes before and after the match at position ``at``."""
    return F.substring(text, F.lit(1), at - 1), F.substring(text, at + F.length(match), F.length(text))


def _span(category: Column | str, identifier: Column, entity: Column, key: Column, confidence: float, at: Column) -> Column:
    kind = F.lit(category) if isinstance(category, str) else category
    return F.struct(kind.alias("category"), identifier.alias("identifier"), entity.alias("entity"), key.alias("entity_key"), F.lit(confidence).alias("confidence"), at.alias("at"))


def _bank_or_entity(entity: Column) -> Column:
    return F.when(entity.rlike(BANK), BANK_ID).otherwise(ENTITY)


def is_year(digits: Column) -> Column:
    return digits.rlike(r"^(?:19|20)\d{2}$")


def no_year(pattern: str, separators: str) -> str:
    """``pattern`` for digits with separators, whose matches are no year (19xx, 20xx)."""
    gap = f"[{separators}]*"
    behind, rest = pattern.split(")", 1)
    return rf"{behind})(?!(?:1{gap}9|2{gap}0)(?:{gap}\d){{2}}(?!{gap}\d)){rest}"


GENERIC_ID = no_year(GENERIC, "-")
GENERIC_LINE_ID = no_year(GENERIC_LINE, " /-")


def first_generic(text: Column, pattern: str = GENERIC_ID) -> Column:
    """The first bare identifier that counts, or null."""
    return F.nullif(F.regexp_extract(text, pattern, 0), F.lit(""))


def _tax_rule(text: Column, pattern: str, confidence: float) -> Column:
    rfc, at = F.regexp_extract(text, pattern, 1), _place(text, pattern)
    before, after = _without(text, rfc, at)
    entity = _edge(F.concat(before, F.lit(" "), after))
    return F.when((rfc != "") & (_letters(entity) >= 3), _span(ENTITY, rfc, entity, normalize(rfc), confidence, at))


def _generic_rule(text: Column, pattern: str, confidence: float) -> Column:
    raw, at = first_generic(text, pattern), _place(text, pattern)
    before, after = _without(text, raw, at)
    whole = _edge(F.concat(before, F.lit(" "), after))
    words = F.size(F.regexp_extract_all(whole, F.lit(WORD), F.lit(0)))
    return F.when(raw.isNotNull() & (_letters(whole) >= 7) & (words >= 2), _span(_bank_or_entity(whole), raw, whole, association_key(whole, raw), confidence, at))


def cell_rules(text: Column) -> Column:
    """Tax id, then labelled identifier, then bare identifier."""
    number = F.trim(F.regexp_extract(text, EXPLICIT, 1))
    label, at = F.regexp_extract(text, EXPLICIT, 0), _place(text, EXPLICIT)
    before, after = _without(text, label, at)
    entity = F.when(_edge(before) != "", _edge(before)).otherwise(_edge(after))
    explicit = F.when(
        (F.length(F.regexp_replace(number, r"\D", "")) > 2) & (_letters(entity) >= 3),
        _span(_bank_or_entity(entity), number, entity, association_key(entity, number), 0.99, at + F.length(label) - F.length(number)),
    )
    return F.coalesce(_tax_rule(text, RFC, 0.995), explicit, _generic_rule(text, GENERIC_ID, 0.92))


def line_rules(text: Column, parent_bank: Column | None = None, parent_text: Column | None = None) -> Column:
    """Tax id, glued or not, then bank context of the row or its parent, then bare identifier.

    Under a bank context the row's first identifier counts, a year only where the row itself has the context; a row
    with hardly a letter beside it takes its parent's text, or ``BANCO``, as the entity.  A first identifier that is a
    year without it gives nothing.
    """
    own = normalize(text).rlike(BANK_CONTEXT)
    bank = own | F.coalesce(parent_bank, F.lit(False)) if parent_bank is not None else own
    raw, at = first_generic(text, GENERIC_LINE), _place(text, GENERIC_LINE)
    year = is_year(F.regexp_replace(raw, r"\D", ""))
    before, after = _without(text, raw, at)
    name = _edge(F.concat(before, F.lit(" "), after))
    name = F.when(_letters(name) >= 3, name).otherwise(F.coalesce(parent_text if parent_text is not None else F.lit(None).cast("string"), F.lit("BANCO")))
    banked = F.when(bank & raw.isNotNull() & (~year | own), _span(BANK_ID, raw, name, association_key(name, raw), 0.98, at))
    return F.coalesce(_tax_rule(text, RFC_GLUED, 0.995), banked, F.when(~year, _generic_rule(text, GENERIC_LINE, 0.91)))


def masked(text: Column, span: Column, pseudo: Pseudonyms) -> Column:
    """The identifier replaced where it was found, then the entity where it first occurs; text without a span stays.  Needs ``bound``."""
    entity, identifier, key, at = span["entity"], span["identifier"], span["entity_key"], span["at"]
    tax = identifier.rlike(r"(?iu)^[A-Z&Ñ]{3,4}\d{6}[A-Z0-9]{3}$")
    person = F.length(F.regexp_replace(identifier, r"[^\p{L}\p{N}_]", "")) == 13
    new_id = F.when(tax, pseudo.rfc(identifier, key)).otherwise(pseudo.numeric_identifier(identifier, key))
    new_name = (
        F.when(tax & person, pseudo.person(key)[0])
        .when(tax, pseudo.company(key)[0])
        .when(span["category"] == BANK_ID, pseudo.bank(key)[0])
        .when(entity.rlike(LEGAL), pseudo.company(key)[0])
        .otherwise(pseudo.person(key)[0])
    )
    before, after = _without(text, identifier, at)
    # one side of the identifier at a time: what replaces it is never looked at
    left = replace_first(before, entity, new_name)
    right = F.when(left == before, replace_first(after, entity, new_name)).otherwise(after)
    return F.when(span.isNull(), text).otherwise(F.concat(left, new_id, right))


#: Patterns of a plain scan of free text (kind, pattern).
SCAN = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    ("date", r"\b\d{1,2}[./-]\d{1,2}[./-]\d{2,4}\b"),
    ("digits", r"\b\d{5,}\b"),
]


def scan(text: Column) -> Column:
    """Array of (kind, n): how often each kind of span occurs in a text."""
    return F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_count(text, F.lit(p)).cast("long").alias("n")) for k, p in SCAN])
