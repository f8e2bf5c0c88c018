"""Keyed pseudonyms: HMAC-SHA256 in SQL functions, and the synthetic values made from it.

The two padded keys come from a scalar subquery over a one-row table, so that the secret is not part of a plan's text.
"""

from __future__ import annotations

import copy

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import legal_suffix, normalize

#: Fixed value: letters of synthetic codes.
ALPHABET = "ABCDEFGHJKLMNPQRSTUVWXYZ23456789"


def padded_keys(seed: str) -> tuple[bytes, bytes]:
    """The inner and outer padded keys of HMAC-SHA256."""
    import hashlib

    if len(seed.strip()) < 16:
        raise ValueError("a seed needs at least 16 characters")
    key = seed.encode()
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    key = key.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def byte(hexed: Column, i: Column | int) -> Column:
    """Byte i, from 0, of a hexadecimal string."""
    at = F.lit(2 * i + 1) if isinstance(i, int) else i * 2 + 1
    return F.conv(F.substring(hexed, at, F.lit(2)), 16, 10).cast("int")


def two_bytes(hexed: Column) -> Column:
    return F.conv(F.substring(hexed, 1, 4), 16, 10).cast("int")


def letters_at(value: Column) -> Column:
    return F.substring(F.lit(ALPHABET), F.pmod(value, F.lit(len(ALPHABET))) + 1, F.lit(1))


class Pseudonyms:
    """Column functions under one secret; ``scope`` sets the month offset."""

    def __init__(self, spark: SparkSession, seed: str, scope: str = "batch"):
        inner, outer = padded_keys(seed)
        keys = spark.createDataFrame([(bytearray(inner), bytearray(outer))], "i binary, o binary")
        self._inner, self._outer = keys.select("i").scalar(), keys.select("o").scalar()
        self.scope = F.lit(scope)

    def bound(self, df: DataFrame) -> tuple[DataFrame, "Pseudonyms"]:
        """df with a column ``__keys`` and functions that use it: ``certificate`` and ``numeric_identifier`` work on
        arrays, in whose lambdas subqueries may not stand.  A generator, as a projection would be folded back."""
        keys = F.struct(self._inner.alias("i"), self._outer.alias("o"))
        own = copy.copy(self)
        own._inner, own._outer = F.col("__keys.i"), F.col("__keys.o")
        return df.select("*", F.explode(F.array(keys)).alias("__keys")), own

    def digest(self, namespace: str, value: Column) -> Column:
        """HMAC of ``namespace:normalised value``, 64 lower-case hexadecimal digits."""
        message = F.encode(F.concat(F.lit(f"{namespace}:"), normalize(value)), "UTF-8")
        return F.sha2(F.concat(self._outer, F.unhex(F.sha2(F.concat(self._inner, message), 256))), 256)

    def token(self, namespace: str, value: Column, length: int = 8) -> Column:
        return F.upper(F.substring(self.digest(namespace, value), 1, length))

    def _forms(self, token: Column, *formats: tuple[str, str]) -> list[Column]:
        return [F.concat(F.lit(a), token, F.lit(b)) for a, b in formats]

    def company(self, key: Column, suffix: Column | None = None) -> list[Column]:
        """From the longest to the shortest form."""
        form = legal_suffix(suffix) if suffix is not None else F.lit("")
        tail = F.when(form != "", F.concat(F.lit(" "), form)).otherwise("")
        return [F.concat(x, tail) for x in self._forms(self.token("company", key), ("ENTIDAD SINTETICA ", ""), ("ENTIDAD ", ""), ("E-", ""))]

    def compact_company(self, key: Column) -> Column:
        return self._forms(self.token("company", key), ("E-SINT-", ""))[0]

    def person(self, key: Column) -> list[Column]:
        return self._forms(self.token("person", key), ("PERSONA SINTETICA ", ""), ("PERSONA ", ""), ("P-", ""))

    def compact_person(self, key: Column) -> Column:
        return self._forms(self.token("person", key), ("P-SINT-", ""))[0]

    def user(self, key: Column) -> list[Column]:
        return self._forms(self.token("user", key), ("USUARIO SINTETICO ", ""), ("USUARIO ", ""), ("U-", ""))

    def bank(self, key: Column) -> list[Column]:
        return self._forms(self.token("bank", key), ("BANCO FICTICIO NEXORA ", ""), ("BANCO FICTICIO ", ""), ("B-FICT-", ""))

    def address(self, key: Column) -> list[Column]:
        number = (two_bytes(self.digest("address", key)) % 8900 + 100).cast("string")
        return self._forms(number, ("VIA SINTETICA #", " ZONA NEUTRA"), ("VIA SINT. #", ""), ("V-", ""))

    def population(self, key: Column) -> list[Column]:
        return self._forms(self.token("population", key), ("CIUDAD NEXORA, ", ""), ("NEXORA, ", ""), ("NX-", ""))

    def rfc(self, original: Column, key: Column) -> Column:
        """A synthetic tax id of the same length; null unless that is 12, 13 or 14."""
        bare = F.regexp_replace(normalize(original), "[^A-Z0-9&Ñ]", "")
        d = self.digest("rfc", key)
        two = lambda x: F.lpad(x.cast("string"), 2, "0")
        head = F.concat(F.repeat(F.lit("Z"), F.length(bare) - 9), two(byte(d, 0) % 30 + 70), two(byte(d, 1) % 12 + 1), two(byte(d, 2) % 28 + 1), letters_at(byte(d, 3)), letters_at(byte(d, 4)))
        made = F.concat(head, letters_at(byte(d, 5)))
        return F.when(F.length(bare).isin(12, 13, 14), F.when(made == bare, F.concat(head, letters_at(byte(d, 5) + 1))).otherwise(made))

    def certificate(self, original: Column, key: Column) -> Column:
        """Letters and digits replaced, separators kept; the digest's bytes repeat.  Needs ``bound``."""
        d = self.digest("certificate", F.concat(key, F.lit(":"), original))
        chars = F.filter(F.split(original, ""), lambda x: x != "")
        alnum = r"^[\p{L}\p{N}]$"
        beside = F.arrays_zip(chars.alias("c"), F.array_repeat(d, F.size(chars)).alias("d"))
        rank = lambda i: F.length(F.regexp_replace(F.substring(original, F.lit(1), i), r"[^\p{L}\p{N}]", ""))
        return F.array_join(F.transform(beside, lambda x, i: F.when(x["c"].rlike(alnum), letters_at(byte(x["d"], F.pmod(rank(i), F.lit(32))))).otherwise(x["c"])), "")

    def numeric_identifier(self, original: Column, key: Column) -> Column:
        """Every digit replaced by another one, separators kept; null without a digit.  Needs ``bound``."""
        digits = F.regexp_replace(original, r"\D", "")
        value = F.concat(key, F.lit(":"), digits)
        blocks = F.sequence(F.lit(0), F.greatest(F.ceil(F.length(digits) / 32).cast("int") - 1, F.lit(0)))
        beside = F.arrays_zip(blocks.alias("b"), F.array_repeat(self._inner, F.size(blocks)).alias("i"), F.array_repeat(self._outer, F.size(blocks)).alias("o"))
        message = lambda b: F.encode(F.concat(F.lit("numeric-identifier:"), normalize(F.concat(value, F.lit(":"), b.cast("string")))), "UTF-8")
        blocks_hex = F.transform(beside, lambda x: F.sha2(F.concat(x["o"], F.unhex(F.sha2(F.concat(x["i"], message(x["b"])), 256))), 256))
        stream = F.array_join(blocks_hex, "")
        chars = F.filter(F.split(original, ""), lambda x: x != "")
        held = F.arrays_zip(chars.alias("c"), F.array_repeat(stream, F.size(chars)).alias("s"))
        rank = lambda i: F.length(F.regexp_replace(F.substring(original, F.lit(1), i), r"\D", ""))

        def other(x: Column, i: Column) -> Column:
            n = byte(x["s"], rank(i)) % 9
            return F.when(x["c"].rlike(r"^\d$"), (n + (n >= x["c"].try_cast("int")).cast("int")).cast("string")).otherwise(x["c"])

        return F.when(digits != "", F.array_join(F.transform(held, other), ""))

    def bank_pair(self, bank: Column, identifier: Column, key: Column | None = None) -> tuple[Column, Column]:
        common = key if key is not None else F.concat(normalize(bank), F.lit("|"), normalize(identifier))
        return self.bank(common)[0], self.numeric_identifier(identifier, common)

    def month_offset(self, scope: Column | None = None) -> Column:
        """13 to 120 months into the past, never whole years."""
        index = two_bytes(self.digest("date-offset", normalize(scope if scope is not None else self.scope))) % 99
        #: the 99 values are eleven of every twelve from 13 on
        return -(13 + index + F.floor(index / 11).cast("int"))

    def shift_date(self, date: Column, scope: Column | None = None) -> Column:
        """Moved by the month offset; the end of a month stays one."""
        moved = F.add_months(date, self.month_offset(scope))
        return F.when(date == F.last_day(date), F.last_day(moved)).otherwise(moved)

    def exercise_and_period(self, year: Column, period: Column, scope: Column | None = None) -> tuple[Column, Column]:
        """Both strings moved together, each different from its source; widths kept."""
        start = F.expr("date '2000-01-15'")
        shifted = self.shift_date(F.add_months(start, (year.cast("int") - 2000) * 12 + period.cast("int") - 1), scope)
        limit = F.when(F.length(period) == 1, 9).otherwise(12)
        y = F.year(shifted) - (F.year(shifted) == year.cast("int")).cast("int")
        m = F.when(F.month(shifted) == period.cast("int"), F.month(shifted) % limit + 1).otherwise(F.month(shifted))
        return y.cast("string"), F.when(F.length(period) > 1, F.lpad(m.cast("string"), 2, "0")).otherwise(m.cast("string"))
