"""Checksums and structural tests of identifiers, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def numbers(x: Column) -> Column:
    """The decimal digits of a string, in order."""
    return F.transform(F.filter(F.split(x, ""), lambda c: c != ""), lambda c: F.ascii(c) - 48)


def weighted(values: Column, weights: list[int]) -> Column:
    products = F.zip_with(F.slice(values, 1, len(weights)), F.array(*map(F.lit, weights)), lambda v, w: v * w)
    return F.aggregate(products, F.lit(0), lambda s, v: s + v)


def luhn(x: Column) -> Column:
    """Every second digit from the right doubled, digit sums added: a multiple of ten."""
    values = F.transform(F.reverse(numbers(x)), lambda d, i: F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda s, d: s + d) % 10 == 0


def _dihedral() -> list[int]:
    """Multiplication in the dihedral group of ten elements: rotations 0 to 4, reflections 5 to 9."""

    def times(a: int, b: int) -> int:
        if a < 5:
            return (a + b) % 5 if b < 5 else 5 + (a + b) % 5
        return 5 + (a - b) % 5 if b < 5 else (a - b) % 5

    return [times(a, b) for a in range(10) for b in range(10)]


def _permutations() -> list[int]:
    """Powers of the Verhoeff permutation, place by place."""
    first = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]
    rows = [list(range(10))]
    for _ in range(7):
        rows.append([first[i] for i in rows[-1]])
    return [x for row in rows for x in row]


def verhoeff(x: Column) -> Column:
    product, moved = F.array(*map(F.lit, _dihedral())), F.array(*map(F.lit, _permutations()))
    placed = F.transform(F.reverse(numbers(x)), lambda d, i: F.get(moved, (i % 8) * 10 + d))
    return F.aggregate(placed, F.lit(0), lambda c, d: F.get(product, c * 10 + d)) == 0


def iban(x: Column) -> Column:
    """ISO 7064 mod 97: the first four characters last, letters as two digits."""
    turned = F.split(F.concat(F.substring(x, 5, 40), F.substring(x, 1, 4)), "")
    value = F.aggregate(
        F.filter(turned, lambda c: c != ""),
        F.lit(0),
        lambda r, c: F.when(F.ascii(c) >= 65, (r * 100 + F.ascii(c) - 55) % 97).otherwise((r * 10 + F.ascii(c) - 48) % 97),
    )
    return F.length(x).between(15, 34) & (value == 1)


def mrz_digit(field: Column) -> Column:
    """ICAO 9303 check digit: weights 7, 3, 1; letters from 10, filler 0."""
    values = F.transform(F.filter(F.split(field, ""), lambda c: c != ""), lambda c, i: F.when(c == "<", 0).when(F.ascii(c) >= 65, F.ascii(c) - 55).otherwise(F.ascii(c) - 48) * F.get(F.array(F.lit(7), F.lit(3), F.lit(1)), i % 3))
    return (F.aggregate(values, F.lit(0), lambda s, v: s + v) % 10).cast("string")


def mrz_line2(x: Column) -> Column:
    part = lambda at, n: F.substring(x, at, n)
    whole = F.concat(part(1, 10), part(14, 7), part(22, 22))
    return (
        (F.length(x) == 44)
        & (mrz_digit(part(1, 9)) == part(10, 1))
        & part(14, 6).rlike("^[0-9]{6}$") & (mrz_digit(part(14, 6)) == part(20, 1))
        & part(22, 6).rlike("^[0-9]{6}$") & (mrz_digit(part(22, 6)) == part(28, 1))
        & (mrz_digit(whole) == part(44, 1))
        & part(11, 3).rlike("^[A-Z<]{3}$") & part(21, 1).isin("M", "F", "<")
    )


def mrz_line1(x: Column) -> Column:
    names = F.substring(x, 6, 39)
    return F.substring(x, 1, 1).isin("P", "I", "A", "C") & names.contains("<<") & (F.length(F.regexp_replace(names, "[^A-Z]", "")) >= 4)


def ssn(x: Column) -> Column:
    d = digits(x)
    area = F.substring(d, 1, 3).cast("int")
    return ~area.isin(0, 666) & (area < 900) & (F.substring(d, 4, 2) != "00") & (F.substring(d, 6, 4) != "0000")


def german_vat(x: Column) -> Column:
    """ISO 7064 mod 11, 10 over nine digits."""
    d = numbers(F.substring(x, 3, 9))
    product = F.aggregate(F.slice(d, 1, 8), F.lit(10), lambda p, v: (2 * F.when((v + p) % 10 == 0, 10).otherwise((v + p) % 10)) % 11)
    return F.substring(x, 3, 20).rlike("^[0-9]{9}$") & ((11 - product) % 10 == F.get(d, F.lit(8)))


def eu_vat(x: Column) -> Column:
    return F.when(F.substring(x, 1, 2) == "DE", german_vat(x)).otherwise(F.lit(True))


def china_id(x: Column) -> Column:
    """GB 11643: position weights are the powers of two modulo 11."""
    weights = [pow(2, 17 - i, 11) for i in range(17)]
    check = (12 - weighted(numbers(F.substring(x, 1, 17)), weights) % 11) % 11
    return F.upper(F.substring(x, 18, 1)) == F.when(check == 10, "X").otherwise(check.cast("string"))


def eleven(d: Column, weights: list[int], place: int) -> Column:
    """The digit at `place` (from 0) is 11 less the weighted sum modulo 11, or 0 above 9."""
    rest = weighted(d, weights) % 11
    return F.get(d, F.lit(place)) == F.when(rest < 2, 0).otherwise(11 - rest)


def japan_number(x: Column) -> Column:
    return eleven(numbers(x), [n + 1 if n <= 6 else n - 5 for n in range(1, 12)], 11)


def brazil_cpf(x: Column) -> Column:
    d = numbers(digits(x))
    return ~digits(x).rlike(r"^(\d)\1{10}$") & eleven(d, list(range(10, 1, -1)), 9) & eleven(d, list(range(11, 1, -1)), 10)


def tax_file_number(x: Column) -> Column:
    return weighted(numbers(digits(x)), [10, 7, 8, 4, 6, 3, 5, 2, 1]) % 11 == 0


def business_number(x: Column) -> Column:
    """The first digit less one; weights 10, 1, 3, ... 19; a multiple of 89."""
    return (weighted(numbers(digits(x)), [10, *range(1, 20, 2)]) - 10) % 89 == 0


def entropy(x: Column) -> Column:
    """Shannon entropy in bits a character."""
    chars = F.filter(F.split(x, ""), lambda c: c != "")
    n = F.size(chars).cast("double")
    shares = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda d: d == c)) / n)
    return F.aggregate(shares, F.lit(0.0), lambda s, p: s - p * F.log2(p))


def secret(x: Column) -> Column:
    kinds = sum((F.when(x.rlike(k), 1).otherwise(0) for k in ("[A-Z]", "[a-z]", "[0-9]")), F.lit(0))
    bar = F.when(x.rlike("^[A-Fa-f0-9]+$"), P.SECRET_HEX_BAR).otherwise(P.SECRET_BAR)
    return x.rlike(P.SECRET_PREFIX) | ((kinds >= 2) & (entropy(x) >= bar))


def phone(x: Column) -> Column:
    return F.length(digits(x)).between(10, 15)
