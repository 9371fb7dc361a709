"""Deterministic synthetic identifiers with valid check digits, from an index column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Splits of the 200 samples of a type.
TRAIN, DEV = 140, 170


def digest_number(seed: str, label: str, index: Column, width: int) -> Column:
    """The first 16 hex digits of the hash of ``seed:label:index``, modulo 10 to the width."""
    hexes = F.substring(F.sha2(F.concat(F.lit(f"{seed}:{label}:"), index.cast("string")), 256), 1, 16)
    return (F.conv(hexes, 16, 10).cast("decimal(20,0)") % F.lit(10**width).cast("decimal(20,0)")).cast("bigint")


def digits(seed: str, label: str, index: Column, width: int) -> Column:
    return F.lpad(digest_number(seed, label, index, width).cast("string"), width, "0")


def _sum(body: Column, weights: str) -> Column:
    products = F.zip_with(F.split(body, ""), F.expr(f"array({weights})"), lambda c, w: F.coalesce(c.try_cast("int") * w, F.lit(0)))
    return F.aggregate(products, F.lit(0), lambda a, p: a + p)


def with_tax_digit(nine: Column) -> Column:
    """A tax id of ten digits from its first nine."""
    return F.concat(nine, (_sum(nine, "2,4,10,3,5,9,4,6,8") % 11 % 10).cast("string"))


def with_registration_digit(body: Column, person: bool = False) -> Column:
    """A registration number from its first 12 digits (14 of a person's)."""
    return F.concat(body, (body.cast("bigint") % (13 if person else 11) % 10).cast("string"))


def with_insurance_digits(nine: Column) -> Column:
    """An insurance number, as 000-000-000 00, from its first nine digits."""
    check = F.lpad((_sum(nine, "9,8,7,6,5,4,3,2,1") % 101 % 100).cast("string"), 2, "0")
    return F.concat(F.substring(nine, 1, 3), F.lit("-"), F.substring(nine, 4, 3), F.lit("-"), F.substring(nine, 7, 3), F.lit(" "), check)


def with_luhn_digit(body: Column) -> Column:
    """A number with its Luhn digit."""
    doubled = F.transform(F.reverse(F.split(body, "")), lambda c, i: F.coalesce(c.try_cast("int"), F.lit(0)) * (2 - i % 2))
    total = F.aggregate(doubled, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d))
    return F.concat(body, ((10 - total % 10) % 10).cast("string"))


def split_of_index(index: Column) -> Column:
    return F.when(index < TRAIN, "train").when(index < DEV, "dev").otherwise("test")
