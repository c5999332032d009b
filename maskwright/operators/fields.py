"""Masking of form fields by their names, and by their values where the name says nothing."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Settings
from ..functions import maskers as M
from ..functions import validators as V
from ..functions.text import has_consent
from ..patterns import FIELD_NAMES, SYSTEM_FIELDS
from .masking import confidence, looks_masked

#: Types whose values have a masked form; values of other types stay as they are.
MASKERS = {
    "email": M.mask_email,
    "phone": M.mask_phone,
    "name": M.mask_name,
    "address": M.mask_address,
    "card": M.mask_credit_card,
    "ssn": M.mask_ssn,
    "password": M.mask_password,
    "token": M.mask_token,
    "hosting": M.mask_hosting_id,
    "ip": M.mask_ip,
}
#: What a value looks like, in the order of asking.
VALUE_CHECKS = (
    ("email", V.is_email),
    ("card", V.is_credit_card),
    ("ssn", lambda v: V.is_ssn(v) | V.is_my_number_value(v)),
    ("ip", V.is_ip_address),
    ("phone", V.is_phone),
    ("url", V.is_url),
    ("hosting", V.is_hosting_id),
    ("token", lambda v: V.is_ai_key(v) | V.is_token(v)),
)


@dataclass(frozen=True)
class FieldHooks:
    """Column functions around the masking of a field: (name, value) or (name, value, type) to a column.

    Around detection: ``before_detect`` changes what is looked at; what ``detect`` gives, if not null, is the type and
    nothing else is asked; ``by_name`` and ``by_value``, (type, name, value) each, change a type that the name or the value
    gave, and null from them is no type.
    """

    before: Callable[[Column, Column], Column] | None = None
    override: Callable[[Column, Column], Column] | None = None
    detect: Callable[[Column, Column], Column] | None = None
    retype: Callable[[Column, Column, Column], Column] | None = None
    mask_as: Callable[[Column, Column, Column], Column] | None = None
    after: Callable[[Column, Column, Column], Column] | None = None
    before_detect: Callable[[Column, Column], Column] | None = None
    by_name: Callable[[Column, Column, Column], Column] | None = None
    by_value: Callable[[Column, Column, Column], Column] | None = None


@dataclass(frozen=True)
class RecordHooks:
    """Functions of whole records: ``before`` changes what goes in, ``override`` gives the outcome itself where it is not null,
    ``after`` changes the masked record, seeing what went in too."""

    before: Callable[[Column], Column] | None = None
    override: Callable[[Column], Column] | None = None
    after: Callable[[Column, Column], Column] | None = None

    def around(self, record: Column, mask: Callable[[Column], Column]) -> Column:
        def outcome(given: Column) -> Column:
            masked = mask(given)
            if self.after:
                masked = self.after(masked, given)
            return F.coalesce(self.override(given), masked) if self.override else masked

        if not self.before:
            return outcome(record)
        # What goes in is bound once by an array of one.
        return F.get(F.transform(F.array(self.before(record)), outcome), F.lit(0))


def _lower(text: Column) -> Column:
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def type_of_name(name: Column) -> Column:
    """A field's type by its name: a whole name of any type first, then the first type with a part of it.

    Parts are looked for anywhere, so ``description`` holds ``ip`` and ``hotel`` ``tel``.
    """
    low = _lower(name)
    fixed = {kind: [w.translate(str.maketrans(ascii_uppercase, ascii_lowercase)) for w in words] for kind, words in FIELD_NAMES.items()}
    whole = F.lit(None).cast("string")
    part = F.lit(None).cast("string")
    for kind, words in reversed(fixed.items()):
        whole = F.when(low.isin(*words), kind).otherwise(whole)
        part = F.when(V.any_of([low.contains(w) for w in words]), kind).otherwise(part)
    return F.coalesce(whole, part)


def type_of_value(value: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, check in reversed(VALUE_CHECKS):
        out = F.when(check(value), kind).otherwise(out)
    return out


def type_of_field(name: Column, value: Column, hooks: FieldHooks | None = None) -> Column:
    """Type by a hook, else by name, else by value; null for an empty value (``0`` counts as empty)."""
    hooks = hooks or FieldHooks()
    seen = hooks.before_detect(name, value) if hooks.before_detect else value
    named, looks = type_of_name(name), type_of_value(seen)
    by_name = F.when(named.isNotNull(), hooks.by_name(named, name, seen)) if hooks.by_name else named
    by_value = F.when(looks.isNotNull(), hooks.by_value(looks, name, seen)) if hooks.by_value else looks
    found = F.when(named.isNotNull(), by_name).otherwise(by_value) if hooks.by_name else F.coalesce(named, by_value)
    if hooks.detect:
        found = F.coalesce(hooks.detect(name, seen), found)
    return F.when(value.isNull() | value.isin("", "0"), None).otherwise(found)


def is_system_field(name: Column) -> Column:
    """Names that start with an underscore or hold one of the reserved parts, in this case."""
    return name.startswith("_") | V.any_of([name.contains(s) for s in SYSTEM_FIELDS])


def mask_as(kind: Column, value: Column) -> Column:
    out = value
    for name, mask in MASKERS.items():
        out = F.when(kind == name, mask(value)).otherwise(out)
    return out


def mask_value(name: Column, value: Column, settings: Settings | None = None, hooks: FieldHooks | None = None) -> Column:
    """The masked value of a field.

    Values that look masked, types that are off, values with a consent phrase and types without a masked
    form stay; so do null and empty values.
    """
    settings, hooks = settings or Settings(), hooks or FieldHooks()
    given = hooks.before(name, value) if hooks.before else value
    kind = type_of_field(name, given, hooks)
    if hooks.retype:
        kind = hooks.retype(name, given, kind)
    off = [k for k in (*FIELD_NAMES, *settings.masks) if not settings.masked(k)]

    def of(kind: Column) -> Column:
        masked = mask_as(kind, given)
        if hooks.mask_as:
            masked = F.coalesce(hooks.mask_as(name, given, kind), masked)
        if hooks.after:
            masked = hooks.after(name, masked, kind)
        stays = kind.isNull() | (kind.isin(*off) if off else F.lit(False)) | has_consent(given, settings.consent_phrases)
        return F.when(stays, given).otherwise(masked)

    # The type, which costs the most, is found once: it is bound by an array of one.
    out = F.get(F.transform(F.array(kind), of), F.lit(0))
    if hooks.override:
        out = F.coalesce(hooks.override(name, given), out)
    return F.when(value.isNull() | value.isin("", "0") | looks_masked(value), value).otherwise(out)


def mask_record(record: Column, settings: Settings | None = None, hooks: FieldHooks | None = None, around: RecordHooks | None = None) -> Column:
    """A map of field names to values with every value masked but those of system fields."""
    mask = lambda r: F.transform_values(r, lambda k, v: F.when(is_system_field(k), v).otherwise(mask_value(k, v, settings, hooks)))
    return (around or RecordHooks()).around(record, mask)


def mask_nested(record: Column, depth: int, settings: Settings | None = None) -> Column:
    """The same for maps of maps, ``depth`` levels deep; a system field's whole map stays."""
    if depth <= 1:
        return mask_record(record, settings)
    return F.transform_values(record, lambda k, v: F.when(is_system_field(k), v).otherwise(mask_nested(v, depth - 1, settings)))


def mask_typed(value: Column, kind: T.DataType, settings: Settings | None = None, hooks: FieldHooks | None = None, around: RecordHooks | None = None, name: Column | None = None) -> Column:
    """A record of any shape, walked by its type: structs, maps and arrays in each other, at any depth.

    Strings are masked as the field whose name they stand under: a struct's field, a map's key, or the place in an
    array, from 0. What stands under a system field's name stays as a whole, as do numbers and all else that is no string. Hooks of
    records go around every map. Nulls stay at each level.
    """
    walk = lambda v, k, n: mask_typed(v, k, settings, hooks, around, n)

    def under(name: Column, v: Column, k: T.DataType) -> Column:
        return F.when(is_system_field(name), v).otherwise(walk(v, k, name)) if _holds_text(k) else v

    if not _holds_text(kind):
        return value
    if isinstance(kind, T.StringType):
        return value if name is None else mask_value(name, value, settings, hooks)
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[under(F.lit(f.name), value[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda v, i: under(i.cast("string"), v, kind.elementType))
    mask = lambda r: F.transform_values(r, lambda k, v: under(k.cast("string"), v, kind.valueType))
    return (around or RecordHooks()).around(value, mask)


def _holds_text(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_holds_text(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _holds_text(kind.elementType)
    return _holds_text(kind.valueType) if isinstance(kind, T.MapType) else isinstance(kind, T.StringType)


def mask_records(df: DataFrame, column: str, settings: Settings | None = None, hooks: FieldHooks | None = None, around: RecordHooks | None = None) -> DataFrame:
    """``mask_typed`` for a column of the frame's own type. A VARIANT column is given the type that all its values
    fit in, found by one aggregation over the table, and becomes a column of that type."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.VariantType):
        seen = df.agg(F.schema_of_variant_agg(column)).head()[0] or "VOID"
        ddl = seen.replace("OBJECT<", "STRUCT<").replace("VOID", "STRING").replace("VARIANT", "STRING")
        df = df.withColumn(column, F.try_variant_get(F.col(column), "$", ddl))
        kind = df.schema[column].dataType
    return df.withColumn(column, mask_typed(F.col(column), kind, settings, hooks, around))


def preview(name: Column, value: Column, settings: Settings | None = None) -> Column:
    """What a field is taken for: struct of type, value, confidence, enabled, maskable, was_masked."""
    settings = settings or Settings()
    kind = type_of_field(name, value)
    off = [k for k in FIELD_NAMES if not settings.masked(k)]
    return F.struct(
        kind.alias("type"),
        value.alias("value"),
        confidence(kind, type_of_name(name)).alias("confidence"),
        (kind.isNotNull() & (~kind.isin(*off) if off else F.lit(True))).alias("enabled"),
        F.coalesce(kind.isin(*MASKERS), F.lit(False)).alias("maskable"),
        (mask_value(name, value, settings) != value).alias("was_masked"),
    )
