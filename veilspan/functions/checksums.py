"""Check-digit and shape predicates as Columns; null and malformed values are false."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def digits_of(value: Column) -> Column:
    return F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"\D", "")


def _weighted(digits: Column, weights: list[int]) -> Column:
    parts = F.zip_with(F.split(digits, ""), F.expr(f"array({', '.join(map(str, weights))})"), lambda c, w: F.coalesce(c.try_cast("int") * w, F.lit(0)))
    return F.aggregate(parts, F.lit(0), lambda total, part: total + part)


def _digit(digits: Column, place: int) -> Column:
    return F.coalesce(F.substring(digits, place, 1).try_cast("int"), F.lit(-1))


def valid_inn(value: Column) -> Column:
    """Tax id of 10 or 12 digits: weighted sums modulo 11, then 10."""
    d = digits_of(value)
    ten = _weighted(d, [2, 4, 10, 3, 5, 9, 4, 6, 8]) % 11 % 10 == _digit(d, 10)
    first = _weighted(d, [7, 2, 4, 10, 3, 5, 9, 4, 6, 8]) % 11 % 10
    second = (_weighted(d, [3, 7, 2, 4, 10, 3, 5, 9, 4, 6]) + first * 8) % 11 % 10
    return F.when(F.length(d) == 10, ten).when(F.length(d) == 12, (first == _digit(d, 11)) & (second == _digit(d, 12))).otherwise(False)


def valid_ogrn(value: Column) -> Column:
    """Registration number: 13 digits modulo 11, or 15 (of leading 3 or 4) modulo 13, then 10."""
    d = digits_of(value)
    thirteen = F.coalesce(F.substring(d, 1, 12).try_cast("bigint"), F.lit(0))
    fifteen = F.coalesce(F.substring(d, 1, 14).try_cast("bigint"), F.lit(0))
    return (
        F.when(F.length(d) == 13, ~d.startswith("0") & (thirteen % 11 % 10 == _digit(d, 13)))
        .when(F.length(d) == 15, F.substring(d, 1, 1).isin("3", "4") & (fifteen % 13 % 10 == _digit(d, 15)))
        .otherwise(False)
    )


def valid_snils(value: Column) -> Column:
    """Insurance number: weights 9 to 1, modulo 101, with 100 and 101 as zero."""
    d = digits_of(value)
    total = _weighted(d, list(range(9, 0, -1)))
    return (F.length(d) == 11) & (total % 101 % 100 == F.coalesce(F.substring(d, 10, 2).try_cast("int"), F.lit(-1)))


def valid_luhn(value: Column) -> Column:
    d = digits_of(value)
    return F.length(d).between(12, 19) & F.call_function("luhn_check", d)


def valid_card(value: Column) -> Column:
    """Payment card: length, issuer range and Luhn."""
    d = digits_of(value)
    two, four = (F.coalesce(F.substring(d, 1, n).try_cast("int"), F.lit(0)) for n in (2, 4))
    issuer = d.startswith("4") | two.between(51, 55) | four.between(2221, 2720) | d.startswith("220") | two.isin(50, 56, 57, 58, 34, 37) | two.between(60, 69)
    return F.length(d).isin(13, 15, 16, 18, 19) & ~d.rlike("^(0+|1+)$") & issuer & F.call_function("luhn_check", d)


def valid_bik(value: Column) -> Column:
    d = digits_of(value)
    return (F.length(d) == 9) & d.startswith("04") & (F.substring(d, 3, 2) != "00")


def valid_oms(value: Column) -> Column:
    d = digits_of(value)
    return (F.length(d) == 16) & F.call_function("luhn_check", d)


def valid_iban(value: Column) -> Column:
    """Shape and modulo 97 (no country table); the remainder runs along the characters."""
    clean = F.upper(F.regexp_replace(F.coalesce(value, F.lit("")), r"[\s-]+", ""))
    turned = F.concat(F.substr(clean, F.lit(5)), F.substring(clean, 1, 4))
    code = lambda c: F.when(c.rlike("^[0-9]$"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).when(code(c) > 9, (acc * 100 + code(c)) % 97).otherwise((acc * 10 + code(c)) % 97))
    return F.when(clean.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"), rest == 1).otherwise(False)


def valid_swift(value: Column) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(value, F.lit("")), r"[\s-]+", "")).rlike("^[A-Z]{6}[A-Z0-9]{2}([A-Z0-9]{3})?$")


def valid_passport(series: Column, number: Column) -> Column:
    s, n = digits_of(series), digits_of(number)
    year = F.coalesce(F.substring(s, 3, 2).try_cast("int"), F.lit(-1))
    return (F.length(s) == 4) & (F.length(n) == 6) & (F.substring(s, 1, 2) != "00") & (year.between(97, 99) | year.between(0, 30))


def valid_division_code(value: Column) -> Column:
    d = digits_of(value)
    return (F.length(d) == 6) & (F.substring(d, 1, 2) != "00") & (F.substring(d, 4, 3) != "000") & ~d.rlike(r"^(\d)\1{5}$")


def valid_court_case(value: Column) -> Column:
    """Arbitration and general-jurisdiction case numbers; short bare fractions are law references."""
    c = F.replace(F.trim(F.coalesce(value, F.lit(""))), F.lit(" "), F.lit(""))
    whole = c.rlike(r"(?i)^[аА]\d{1,2}-\d{1,8}/((19|20)\d{2}|\d{2})$") | c.rlike(r"^\d{1,2}[а-яёА-ЯЁ]?-\d{1,8}/((19|20)\d{2}|\d{2})$")
    left, year = F.split(c, "/")[0], F.coalesce(F.get(F.split(c, "/"), F.lit(1)).try_cast("int"), F.lit(-1))
    other = (F.size(F.split(c, "/")) == 2) & (year.between(1990, 2035) | year.between(0, 35)) & c.contains("-") & left.rlike(r"\d")
    return whole | other


def inn_problem(value: Column) -> Column:
    """Why a tax id is refused (format, length, checksum); null if it is valid."""
    raw = F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"[\s\u00a0-]", ""))
    return F.when(~raw.rlike(r"^\d+$"), "format").when(~F.length(raw).isin(10, 12), "length").when(~valid_inn(raw), "checksum")


def ogrn_problem(value: Column) -> Column:
    """Why a registration number is refused (format, component, length, checksum); null if it is valid."""
    raw = F.replace(F.coalesce(value, F.lit("")), F.lit(" "), F.lit(""))
    n, first = F.length(raw), F.substring(raw, 1, 1)
    return (
        F.when(~raw.rlike(r"^\d+$"), "format").when((n == 13) & (first == "0") | (n == 15) & ~first.isin("3", "4"), "component")
        .when(~n.isin(13, 15), "length").when(~valid_ogrn(raw), "checksum")
    )


# Lengths of account numbers by country.
IBAN_LENGTHS = {
    "AL": 28, "AD": 24, "AT": 20, "AZ": 28, "BH": 22, "BY": 28, "BE": 16, "BA": 20, "BR": 29, "BG": 22, "CR": 22, "HR": 21, "CY": 28, "CZ": 24, "DK": 18, "DO": 28, "EE": 20, "FO": 18,
    "FI": 18, "FR": 27, "GE": 22, "DE": 22, "GI": 23, "GR": 27, "GL": 18, "GT": 28, "HU": 28, "IS": 26, "IE": 22, "IL": 23, "IT": 27, "JO": 30, "KZ": 20, "XK": 20, "KW": 30, "LV": 21,
    "LB": 28, "LI": 21, "LT": 20, "LU": 20, "MK": 19, "MT": 31, "MR": 27, "MU": 30, "MD": 24, "MC": 27, "ME": 22, "NL": 18, "NO": 15, "PK": 24, "PS": 29, "PL": 28, "PT": 25, "QA": 29,
    "RO": 24, "LC": 32, "SM": 27, "ST": 25, "SA": 24, "RS": 22, "SC": 31, "SK": 24, "SI": 19, "ES": 24, "SE": 24, "CH": 21, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "AE": 23, "GB": 22,
    "VA": 22, "VG": 24, "RU": 33,
}


def iso_countries() -> tuple[str, ...]:
    """The two-letter codes of ISO 3166 that are in use, from the Java runtime's table."""
    codes = SparkSession.getActiveSession()._jvm.java.util.Locale.getISOCountries()
    return tuple(sorted(set(codes) - {"AN"}))  # withdrawn, kept by some runtimes


def iban_problem(value: Column, countries: tuple[str, ...] | None = None) -> Column:
    """Why an international account number is refused (format, component, length, checksum); null if it is
    valid: a country of ISO 3166, that country's length, and the remainder."""
    clean = F.upper(F.regexp_replace(F.coalesce(value, F.lit("")), r"[\s-]+", ""))
    country = F.substring(clean, 1, 2)
    known = F.lit(list(countries or iso_countries()))
    length = F.try_element_at(F.expr("map(" + ", ".join(f"'{k}', {v}" for k, v in IBAN_LENGTHS.items()) + ")"), country)
    return (
        F.when(~clean.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"), "format").when(~F.array_contains(known, country), "component")
        .when(length != F.length(clean), "length").when(~valid_iban(clean), "checksum")
    )


def swift_problem(value: Column, countries: tuple[str, ...] | None = None) -> Column:
    """Why a bank code is refused (format, component); null if it is valid."""
    clean = F.upper(F.regexp_replace(F.coalesce(value, F.lit("")), r"[\s-]+", ""))
    return F.when(~valid_swift(clean), "format").when(~F.array_contains(F.lit(list(countries or iso_countries())), F.substring(clean, 5, 2)), "component")
