"""Masked forms of single values as columns. Each takes a string column and gives one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import patterns as P
from ..patterns import java
from . import validators as V
from .text import split_at


def _first(value: Column, n: int) -> Column:
    return F.left(value, F.lit(n))


def _last(value: Column, n: int) -> Column:
    return F.right(value, F.lit(n))


def _stars(n: Column) -> Column:
    return F.repeat(F.lit("*"), n.cast("int"))


def _keep_first(value: Column) -> Column:
    return F.concat(_first(value, 1), _stars(F.length(value) - 1))


def mask_email(value: Column) -> Column:
    parts = F.split(value, "@")
    return F.when(~V.is_email(value), value).when(F.size(parts) == 2, F.concat(_first(F.get(parts, F.lit(0)), 1), F.lit("***@"), F.get(parts, F.lit(1)))).otherwise("***@***")


def mask_phone(value: Column) -> Column:
    d = V.digits(value)
    return F.when(F.length(d) < 7, value).otherwise(F.concat(F.lit("***-***-"), _last(d, 4)))


def mask_name(value: Column) -> Column:
    parts = F.filter(F.split(F.trim(value), r"\s+"), lambda p: ~p.isin("", "0"))
    return F.array_join(F.transform(parts, _keep_first), " ")


def mask_address(value: Column) -> Column:
    parts = F.filter(F.split(F.trim(value), r"[\s,]+"), lambda p: p != "")
    n = F.length(value)
    return (
        F.when(F.size(parts) == 0, "***")
        .when(F.size(parts) > 2, F.concat(F.get(parts, F.lit(0)), F.lit(" *** ***")))
        .when(F.size(parts) == 2, F.concat(F.get(parts, F.lit(0)), F.lit(" ***")))
        .when(n > 4, F.concat(_first(value, 2), _stars(F.least(F.lit(3), n - 2))))
        .otherwise("***")
    )


def mask_credit_card(value: Column) -> Column:
    d = V.digits(value)
    return F.when(F.length(d).between(13, 19), F.concat(F.lit("****-****-****-"), _last(d, 4))).otherwise(value)


def mask_ssn(value: Column) -> Column:
    d = V.digits(value)
    return F.concat(F.lit("***-**-"), F.when(F.length(d) == 9, _last(d, 4)).otherwise("****"))


def mask_my_number(value: Column) -> Column:
    d = V.digits(value)
    return F.concat(F.lit("****-****-"), F.when(F.length(d) == 12, _last(d, 4)).otherwise("****"))


def mask_password(value: Column) -> Column:
    return F.lit("[REDACTED]")


def mask_token(value: Column) -> Column:
    n = F.octet_length(value)
    return F.when(n >= 32, F.concat(_first(value, 4), _stars(n - 8), _last(value, 4))).when(n >= 12, F.concat(_first(value, 4), F.lit("***"))).otherwise("***")


def mask_hosting_id(value: Column) -> Column:
    n = F.octet_length(value)
    kept = lambda a, b: F.concat(_first(value, a), F.lit("***"), _last(value, b))
    general = r"^[a-z][a-z0-9-]{4,28}[a-z0-9]$"
    return (
        F.when(value.rlike(r"(?i)^xs\d{5,8}$"), kept(2, 3))
        .when(value.rlike(r"(?i)^sv\d{3,5}$"), kept(2, 1))
        .when(value.rlike(r"(?i)^[a-z]{3}\d{5}$"), kept(3, 2))
        .when(value.rlike(r"(?i)\.sakura\.ne\.jp$"), "***.sakura.ne.jp")
        .when(value.rlike(r"(?i)\.lolipop\.jp$"), "***.lolipop.jp")
        .when(value.rlike(r"(?i)\.mixh\.jp$"), "***.mixh.jp")
        .when(value.rlike(r"(?i)^gnc[a-z0-9]{8,12}$"), F.concat(F.lit("gnc***"), _last(value, 4)))
        .when(value.rlike(r"^\d{12}$"), F.concat(F.lit("****-****-"), _last(value, 4)))
        .when(value.rlike(r"(?i)^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), F.concat(F.lit("****-****-****-****-"), _last(value, 12)))
        .when(value.rlike(general) & (n > 10), kept(3, 3))
        .when(value.rlike(general) | (n > 6), kept(2, 2))
        .otherwise("***")
    )


def mask_ipv6(value: Column) -> Column:
    """The first two groups of the full address, without leading zeros."""
    sides = F.split(value, "::")
    groups = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), ":"), lambda g: g != "")
    left, right = groups(F.get(sides, F.lit(0))), groups(F.get(sides, F.lit(1)))
    full = F.concat(left, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(2), 8 - F.size(left) - F.size(right))), lambda i: F.lit("0")), right)
    # Seven groups leave one zero for the colons.
    full = F.when(F.size(left) + F.size(right) == 7, F.concat(left, F.array(F.lit("0")), right)).otherwise(full)
    short = lambda g: F.regexp_replace(F.lower(g), "^0+(?=.)", "")
    return F.concat(short(full[0]), F.lit(":"), short(full[1]), F.lit(":***"))


def mask_ip(value: Column) -> Column:
    parts = F.split(value, r"\.")
    v4 = F.when(F.size(parts) == 4, F.concat(F.get(parts, F.lit(0)), F.lit(".***.***."), F.get(parts, F.lit(3)))).otherwise("***.***.***.***")
    return F.when(V.is_ipv6(value), mask_ipv6(value)).otherwise(v4)


def mask_keep_prefix(value: Column) -> Column:
    return F.concat(_first(value, 4), F.lit("***"))


def mask_id_doc(value: Column) -> Column:
    return _stars(F.greatest(F.lit(4), F.length(value)))


def mask_person_name(value: Column) -> Column:
    """Blanks and honorifics stay; of every other part the first character, of a single one nothing."""
    parts = split_at(value, "(?<= )(?=[^ ])|(?<=[^ ])(?= )")
    kept = lambda p: (F.trim(p) == "") | p.isin(*P.HONORIFICS)
    return F.array_join(F.transform(parts, lambda p: F.when(kept(p), p).when(F.length(p) == 1, "*").otherwise(_keep_first(p))), "")


def mask_labelled_address(value: Column) -> Column:
    lead = f"^(?:{P.PREFECTURES}|{P.DESIGNATED_CITIES}|{P.TOKYO_WARDS})"
    return F.concat(F.regexp_extract(value, lead, 0), F.lit("***"))


def mask_account_id(value: Column) -> Column:
    return F.concat(_first(value, 1), F.lit("***"))


def mask_url_secret(value: Column) -> Column:
    return F.concat(F.regexp_extract(value, r"(?i)^[a-z][a-z0-9+.-]*://[^/]+/", 0), F.lit("***"))


def mask_dob(value: Column) -> Column:
    return F.when(value.contains("年"), "****年**月**日").otherwise("****-**-**")


def mask_bank(value: Column) -> Column:
    return F.concat(F.lit("***"), _last(value, 4))


def excerpt(value: Column) -> Column:
    """A text without tags and line breaks, forty characters at most."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(value, "<[^>]*>", ""), r"\s+", " "))
    return F.when(F.length(plain) > 40, F.concat(_first(plain, 40), F.lit("…"))).otherwise(plain)


def anonymize_ip(value: Column) -> Column:
    """IPv4 with a zero last part, IPv6 with its first 48 bits; anything else as it is."""
    v6 = F.split(value, "::")
    groups = F.filter(F.split(F.get(v6, F.lit(0)), ":"), lambda g: g != "")
    head = F.concat(groups, F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.lit("0")))
    short = F.concat(F.array_join(F.transform(F.slice(head, 1, 3), lambda g: F.regexp_replace(F.lower(g), "^0+(?=.)", "")), ":"), F.lit("::"))
    return F.when(V.is_ipv4(value), F.regexp_replace(value, r"\.\d+$", ".0")).when(V.is_ipv6(value), short).otherwise(value)
