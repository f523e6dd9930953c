"""Masked forms of entity texts: how much of each type stays readable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .checks import digits


def stars(n: Column) -> Column:
    return F.repeat(F.lit("*"), F.greatest(n.cast("int"), F.lit(0)))


def ends(x: Column, head: int, tail: int) -> Column:
    """The first `head` and last `tail` characters, stars between."""
    last = F.right(x, F.lit(tail)) if tail else F.lit("")
    return F.concat(F.substring(x, 1, head), stars(F.length(x) - head - tail), last)


def email(x: Column) -> Column:
    user, domain = F.split_part(x, F.lit("@"), F.lit(1)), F.split_part(x, F.lit("@"), F.lit(2))
    return F.concat(F.when(F.length(user) <= 2, stars(F.length(user))).otherwise(ends(user, 1, 1)), F.lit("@"), domain)


def ip(x: Column) -> Column:
    parts = F.split(x, "[.]")
    return F.when(x.contains("."), F.concat_ws(".", F.transform(parts, lambda o, i: F.when(i < 2, stars(F.length(o))).otherwise(o)))).otherwise("[REDACTED]")


def last(prefix: str, n: int):
    return lambda x: F.concat(F.lit(prefix), F.right(digits(x), F.lit(n)))


MASKS = {
    "EMAIL": email,
    "CARD": last("**** **** **** ", 4),
    "PHONE": lambda x: F.concat(stars(F.length(digits(x)) - 2), F.right(digits(x), F.lit(2))),
    "IP_ADDRESS": ip,
    "NAME": lambda x: ends(x, 1, 0),
    "AADHAAR": last("******** ", 4),
    "PAN": lambda x: ends(F.upper(x), 3, 1),
    "SECRET_TOKEN": lambda x: ends(x, 4, 0),
    "IBAN": lambda x: ends(F.upper(x), 4, 4),
    "MRZ_PASSPORT": lambda x: F.lit("[MRZ REDACTED]"),
    "MRZ_PASSPORT_NAME": lambda x: F.lit("[MRZ NAME REDACTED]"),
    "SSN": last("***-**-", 4),
    "UK_NINO": lambda x: ends(F.upper(x), 2, 1),
    "EU_VAT": lambda x: ends(F.upper(x), 2, 0),
    "CHINA_ID": lambda x: ends(F.upper(x), 6, 4),
    "JAPAN_MYNUMBER": last("********", 4),
    "BRAZIL_CPF": last("***.***.***-", 2),
    "MEXICO_CURP": lambda x: ends(F.upper(x), 4, 0),
    "MEXICO_RFC": lambda x: ends(F.upper(x), 4, 0),
    "CANADA_SIN": last("***-***-", 3),
    "AU_TFN": last("***-***-", 3),
    "AU_ABN": last("**-***-***-", 3),
}


def masked(kind: Column, x: Column) -> Column:
    out = F.lit("[REDACTED]")
    for name, mask in reversed(MASKS.items()):
        out = F.when(kind == name, mask(x)).otherwise(out)
    return F.when(x.isNotNull(), out)
