"""Checks of single values as columns. Each takes a string column and gives a boolean one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import patterns as P
from ..patterns import java


def found(value: Column, pattern: str, flags: str = "") -> Column:
    return value.rlike(java(pattern, flags))


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def distinct_characters(value: Column) -> Column:
    return F.size(F.array_distinct(F.split(value, "")))


def _weighted(numbers: Column, weight) -> Column:
    """Sum of ``weight(digit, place)`` over the digits."""
    return F.aggregate(F.transform(F.split(numbers, ""), lambda c, i: weight(c.cast("int"), i)), F.lit(0), lambda s, x: s + x)


def is_luhn(numbers: Column) -> Column:
    """Not empty, ASCII digits only, and the Luhn sum is a multiple of ten."""
    doubled = lambda d, i: F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))
    return numbers.rlike("^[0-9]+$") & (_weighted(F.reverse(numbers), doubled) % 10 == 0)


def is_card_number(value: Column) -> Column:
    return F.length(digits(value)).between(13, 19) & is_luhn(digits(value))


def is_ssn_number(value: Column) -> Column:
    return digits(value).rlike("^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}$")


def is_my_number(value: Column) -> Column:
    """Twelve digits whose last is the modulo-11 check digit of the others."""
    d = digits(value)
    # Weights from the left: 6 5 4 3 2 7 6 5 4 3 2.
    total = _weighted(F.substring(d, 1, 11), lambda x, i: x * F.when(i < 5, 6 - i).otherwise(12 - i))
    check = F.when(total % 11 <= 1, 0).otherwise(11 - total % 11)
    return F.when(d.rlike("^[0-9]{12}$"), check == F.substring(d, 12, 1).cast("int")).otherwise(False)


def is_ipv6(value: Column) -> Column:
    """An IPv6 address: eight groups, or fewer around one ``::``; the last two can be an IPv4 address."""
    plain = F.regexp_replace(value, r"(?<=:)(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?!$)|$)){4}$", "0:0")
    group = "[0-9A-Fa-f]{1,4}"
    short = plain.rlike(f"^(?:{group}(?::{group})*)?::(?:{group}(?::{group})*)?$") & (F.size(F.filter(F.split(plain, ":"), lambda g: g != "")) <= 7)
    return plain.rlike(f"^{group}(?::{group}){{7}}$") | short


def is_maskable_ipv6(value: Column) -> Column:
    """An IPv6 address with three groups or more written out."""
    return is_ipv6(value) & (F.size(F.filter(F.split(value, ":"), lambda g: g != "")) >= 3)


def is_ipv4(value: Column) -> Column:
    return value.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?!$)|$)){4}$")


def has_token_chars(value: Column) -> Column:
    return value.rlike(r"[0-9\-_+/=.]")


def has_digit(value: Column) -> Column:
    return value.rlike("[0-9]")


def is_person_name(value: Column) -> Column:
    return ~found(value, P.NO_NAME, "iu") & ~found(F.trim(value), P.NO_NAME_WORDS, "iu")


def is_phone_value(value: Column) -> Column:
    return F.length(digits(F.regexp_replace(value, java(P.EXTENSION, "iu"), ""))).between(9, 15)


def is_account_value(value: Column) -> Column:
    return ~found(value, P.NO_ACCOUNT_WORDS, "iu")


def is_secret_value(value: Column) -> Column:
    return ~found(value, P.NO_SECRET, "i")


def _hex_key(value: Column) -> Column:
    return value.rlike("^[0-9A-Fa-f]{32}$") & (distinct_characters(F.lower(value)) >= 8)


def is_ai_key(value: Column) -> Column:
    """The first shape that fits decides; 32 hexadecimal digits need eight different ones, the general shape its prefix."""
    out = F.lit(False)
    for name, (pattern, _) in reversed(P.AI_KEY_VALUES.items()):
        hit = found(value, pattern)
        if name == "azure_openai":
            whole = value.rlike("^[0-9A-Fa-f]{32}$")
            out = F.when(hit & whole, distinct_characters(F.lower(value)) >= 8).otherwise(out)
        elif name == "generic_ai_key":
            out = F.when(hit & F.octet_length(value).between(20, 100) & value.rlike("^(?i:sk-|ai-|api-)"), True).otherwise(out)
        else:
            out = F.when(hit, True).otherwise(out)
    return out


def ai_provider(value: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, (pattern, provider) in reversed(P.AI_KEY_VALUES.items()):
        hit = found(value, pattern)
        if name == "azure_openai":
            hit = hit & _hex_key(value)
        elif name == "generic_ai_key":
            hit = hit & value.rlike("^(?i:sk-|ai-|api-)")
        out = F.when(hit, provider).otherwise(out)
    return out


def hosting_provider(value: Column) -> Column:
    out = F.lit(None).cast("string")
    for pattern, flags, provider in reversed(P.HOSTING.values()):
        out = F.when(found(value, pattern, flags), provider).otherwise(out)
    return out


# Values of form fields.


def is_email(value: Column) -> Column:
    return found(value, P.EMAIL)


def is_phone(value: Column) -> Column:
    return F.length(digits(value)).between(7, 15) & any_of([found(value, p) for p in P.PHONE_VALUES])


def is_credit_card(value: Column) -> Column:
    return is_card_number(value)


def is_ssn(value: Column) -> Column:
    """As a rule's check, but area 666 passes."""
    return found(value, P.SSN) & digits(value).rlike("^(?!000|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}$")


def is_my_number_value(value: Column) -> Column:
    return found(value, P.MY_NUMBER) & is_my_number(value)


def is_ip_address(value: Column) -> Column:
    return is_ipv4(value) | is_ipv6(value) | found(value, P.IPV4)


def is_url(value: Column) -> Column:
    return value.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[!-~]+$") | found(value, P.URL, "i")


def is_token(value: Column) -> Column:
    return value.rlike(r"^[A-Za-z0-9_\-.]{32,}$") & (distinct_characters(value) / F.length(value) > 0.3)


def is_hosting_id(value: Column) -> Column:
    """Five to fifty bytes with a provider's shape; twelve digits count only alone, a few common words don't."""
    hits = []
    for name, (pattern, flags, _) in P.HOSTING.items():
        hit = found(value, pattern, flags)
        if name == "aws_account":
            hit = value.rlike("^[0-9]{12}$")
        elif name == "gcp_project":
            hit = hit & ~F.lower(value).isin(*P.HOSTING_COMMON_WORDS)
        hits.append(hit)
    return F.octet_length(value).between(5, 50) & any_of(hits)


def is_jp_postal(value: Column) -> Column:
    return found(value, P.JP_POSTAL)


def is_date(value: Column) -> Column:
    return any_of([found(value, p) for p in P.DATE_VALUES])
