"""Masking and detection in free text."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CustomPattern, Settings
from ..functions.text import has_consent, normalize, split_at
from ..functions.validators import any_of, found
from ..frames import free_prefix, small_functions
from ..patterns import URL, java
from ..rules import Rule, registry
from .restore import restore_width, restore_widths

#: Rules in one projection of the plan.
STEP = 9
DETECTION = "struct<type:string,value:string,provider:string>"


@dataclass(frozen=True)
class Hooks:
    """Column functions around the masking of texts: instead of it, on what goes in, on what comes out."""

    override: Callable[[Column], Column] | None = None
    before: Callable[[Column], Column] | None = None
    after: Callable[[Column], Column] | None = None


#: Shapes that rules need, which are found faster than the rules' patterns; each begins by a digit or a sign.
SHAPES = {
    "digits": r"[0-9](?:[-\s().]{0,2}[0-9]){6}",  # seven, with at most two separators between any two
    "five": "[0-9]{5}",
    "dotted": r"[0-9]\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]",
    "hex": "[0-9](?:(?<=[0-9a-fA-F]{16})|(?=[0-9a-fA-F]{15}))",  # a digit within 32 hexadecimal digits has fifteen on one side
    "labels": r"[:=\t】\]]",
}


def _about(normal: Column, rules: Iterable[Rule] | None = None) -> Column:
    """What tells cheaply which rules a text can match; found once for all rules. Of shapes, those that the rules need."""
    asked = SHAPES if rules is None else {need for r in rules for need in r.needs}
    return F.struct(F.lower(F.upper(normal)).alias("folded"), *[normal.rlike(x).alias(name) for name, x in SHAPES.items() if name in asked])


def _may_match(rule: Rule, about: Column) -> Column:
    """False for texts that lack what every match of the rule has."""
    checks = [any_of([about["folded"].contains(h) for h in rule.hints])] if rule.hints else []
    return reduce(lambda a, b: a & b, [*checks, *(about[need] for need in rule.needs)], F.lit(True))


def _candidates(rules: list[Rule], about: Column) -> Column:
    """Places in the list of the rules that a text may match; found without lambdas, so by compiled code."""
    return F.array_remove(F.array(*[F.when(_may_match(r, about), i).otherwise(-1) for i, r in enumerate(rules)]), F.lit(-1))


def _can_match(rule: Rule, text: Column, about: Column | None) -> Column:
    """False for texts in which the rule cannot match; the pattern without its edges is tried before the pattern."""
    checks = [] if about is None else [_may_match(rule, about)]
    checks += [text.rlike(x) for x in dict.fromkeys((rule.loose, rule.java))]
    return reduce(lambda a, b: a & b, checks)


def _matches(text: Column, rule: Rule) -> Column:
    """Array of (whole, value, at) of the rule's matches: whole match, value, characters before the value."""
    pattern = F.lit(rule.java)
    groups = {g: F.regexp_extract_all(text, pattern, F.lit(g)) for g in {0, rule.group, *rule.before}}
    zipped, place = F.arrays_zip(*[groups[g] for g in sorted(groups)]), {g: str(i) for i, g in enumerate(sorted(groups))}
    at = lambda x: reduce(lambda a, b: a + b, [F.length(x[place[g]]) for g in rule.before], F.lit(rule.gap))
    return F.transform(zipped, lambda x: F.struct(x["0"].alias("whole"), x[place[rule.group]].alias("value"), at(x).alias("at")))


def gave_up(text: Column, overruns: tuple[str, ...]) -> Column:
    """Whether a rule or custom pattern leaves a text alone, as a bound on its repetitions could cut a match short."""
    return any_of([text.rlike(x) for x in overruns]) if overruns else F.lit(False)


def _any_gave_up(pieces: Column, overruns: tuple[str, ...]) -> Column:
    return F.exists(pieces, lambda x: x["open"] & gave_up(x["text"], overruns))


def apply_rule(text: Column, rule: Rule, about: Column | None) -> Column:
    """The text with the rule's valid matches masked: split at the matches, mask each, join again.

    Without ``about``, what that tells has been looked at.
    """
    value = lambda x: x["value"]
    masked = (lambda x: F.lit(rule.mask)) if isinstance(rule.mask, str) else lambda x: rule.mask(value(x))

    def one(x: Column) -> Column:
        at = x["at"]
        put = F.concat(F.left(x["whole"], at), masked(x), F.substr(x["whole"], at + F.length(value(x)) + 1))
        ok = value(x) != ""
        if rule.valid:
            ok = ok & rule.valid(value(x))
        return F.when(ok, put).otherwise(x["whole"])

    pieces = F.transform(_matches(text, rule), one)
    joined = F.array_join(F.zip_with(split_at(text, rule.java), pieces, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    on = _can_match(rule, text, about)
    return F.when(on & ~gave_up(text, rule.overruns) if rule.overruns else on, joined).otherwise(text)


def _replacing(custom: CustomPattern) -> Callable[[Column], Column]:
    literal = custom.safe_replacement.replace("\\", "\\\\").replace("$", "\\$")
    replaced = lambda text: F.regexp_replace(text, custom.java, literal)
    return (lambda text: F.when(gave_up(text, custom.overruns), text).otherwise(replaced(text))) if custom.overruns else replaced


@dataclass(frozen=True)
class Step:
    """Rules applied in one projection; the one rule that may give up stands alone."""

    masked: Column
    skipped: Column | None = None


def _parts(rules: Iterable[Rule]) -> list[list[Rule]]:
    """The rules by steps; one that may give up stands alone."""
    parts: list[list[Rule]] = []
    for rule in rules:
        if not parts or len(parts[-1]) == STEP or rule.overruns or parts[-1][0].overruns:
            parts.append([])
        parts[-1].append(rule)
    return parts


def _may(rules: list[Rule], about: Column) -> Column:
    """For each step, which of its rules a text may match."""
    return F.array(*[_candidates(some, about) for some in _parts(rules)])


def _steps(rules: list[Rule], at: str, pieces: bool = False) -> list[Step]:
    """The rules as few columns over ``<at>text`` and ``<at>may``, so that plans stay short.

    A step goes from one rule that the text may match to the next; the others cost it nothing. Columns are built once
    for a session and list of rules. With ``pieces``, the text is an array of (of, open, text) and the rules run over its open texts.
    """
    session = SparkSession.active().sparkContext.applicationId
    return _built(session, tuple(rules), at, pieces)


@lru_cache(16)
def _built(session: str, rules: tuple[Rule, ...], at: str, pieces: bool) -> list[Step]:
    text = F.col(f"{at}text")

    def skipped(rule: Rule) -> Column | None:
        if not rule.overruns:
            return None
        up = _any_gave_up(text, rule.overruns) if pieces else gave_up(text, rule.overruns)
        return F.when(up, F.array(F.lit(rule.id))).otherwise(_no_ids())

    def applied(x: Column, rule: Rule) -> Column:
        one = lambda t: apply_rule(t, rule, None)
        return F.transform(x, _opened(one)) if pieces else one(x)

    def chosen(some: list[Rule]) -> Callable[[Column, Column], Column]:
        """The outcome of the rule at a place among ``some``."""
        return lambda x, i: reduce(lambda out, at: F.when(i == at[0], applied(x, at[1])).otherwise(out), reversed([*enumerate(some)]), x)

    return [Step(F.aggregate(F.get(F.col(f"{at}may"), F.lit(n)), text, chosen(some)), skipped(some[0])) for n, some in enumerate(_parts(rules))]


def _no_ids() -> Column:
    return F.array().cast("array<string>")


def _opened(change: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: F.struct(x["of"].alias("of"), x["open"].alias("open"), F.when(x["open"], change(x["text"])).otherwise(x["text"]).alias("text"))


def _run(df: DataFrame, steps: list[Step], at: str) -> DataFrame:
    """Apply steps one after the other; ``<at>skipped`` gathers the rules that gave up."""
    small_functions(df.sparkSession)
    for step in steps:
        both = {f"{at}text": step.masked}
        if step.skipped is not None:
            both[f"{at}skipped"] = F.concat(f"{at}skipped", F.coalesce(step.skipped, _no_ids()))
        df = df.withColumns(both)
    return df


def _customs(df: DataFrame, settings: Settings, column: str, at: str, pieces: bool = False) -> DataFrame:
    """Custom patterns, in order, on what the rules left."""
    for custom in settings.customs:
        change = _replacing(custom)
        both = {column: F.transform(column, _opened(change)) if pieces else change(F.col(column))}
        if custom.overruns:
            up = _any_gave_up(F.col(column), custom.overruns) if pieces else gave_up(F.col(column), custom.overruns)
            both[f"{at}skipped"] = F.concat(f"{at}skipped", F.when(up, F.array(F.lit(f"custom:{custom.label}"))).otherwise(_no_ids()))
        df = df.withColumns(both)
    return df


def _finish(df: DataFrame, given: list[str], skipped: str | None, at: str) -> DataFrame:
    """The frame's own columns, and the rules that gave up where they are asked for."""
    mine = [F.col(f"`{c}`") for c in given if c != skipped]
    return df.select(*mine, *([F.array_distinct(f"{at}skipped").alias(skipped)] if skipped else []))


def enabled_rules(settings: Settings, rules: Iterable[Rule] | None = None) -> list[Rule]:
    return [r for r in (registry() if rules is None else rules) if settings.masked(r.type)]


def mask_plain(df: DataFrame, column: str, settings: Settings | None = None, rules: Iterable[Rule] | None = None, skipped: str | None = None) -> DataFrame:
    """Replace a text column by its masked form, whatever markup it has.

    Width is folded, rules are applied in order, each on what the ones before it left, and characters
    that no rule touched come back in their original width. Custom patterns go last. Null and empty
    texts stay. A rule costs one search of the texts that have one of its hints, and nothing moves
    between executors. A rule whose repetitions a text would drive beyond their bound leaves that text alone and the
    others go on; ``skipped`` names an added column with the ids of such rules.
    """
    settings, at, given = settings or Settings(), free_prefix(df), df.columns
    chosen = enabled_rules(settings, rules)
    old, text, about, may, normal, back = (f"{at}{x}" for x in ("old", "text", "about", "may", "normal", "back"))
    df = df.withColumns({old: F.col(column), text: normalize(F.col(column)), f"{at}skipped": _no_ids()})
    df = df.withColumns({about: _about(F.col(text), chosen), normal: F.col(text)}).withColumn(may, _may(chosen, F.col(about)))
    df = _run(df, _steps(chosen, at), at)
    changed = F.col(text) != F.col(normal)
    wide = changed & (F.col(normal) != F.col(old))
    df = df.withColumn(back, restore_width(*[F.when(wide, F.col(c)) for c in (old, normal, text)]))
    df = df.withColumn(column, F.when(wide, F.col(back)).when(changed, F.col(text)).otherwise(F.col(old)))
    return _finish(_customs(df, settings, column, at), given, skipped, at)


def mask_pieces(df: DataFrame, column: str, settings: Settings, at: str) -> DataFrame:
    """``mask_plain`` for the open pieces of an array of (of, open, text); ``<at>skipped`` is there already."""
    text, normal, back = (f"{at}{x}" for x in ("text", "normal", "back"))
    old = [f"{at}{x}" for x in "abc"]
    df = df.withColumn(normal, F.transform(column, _opened(normalize))).withColumn(text, F.col(normal))
    chosen = enabled_rules(settings)
    df = df.withColumn(f"{at}about", _about(F.array_join(F.transform(normal, lambda x: F.when(x["open"], x["text"])), " ")))
    df = _run(df.withColumn(f"{at}may", _may(chosen, F.col(f"{at}about"))), _steps(chosen, at, pieces=True), at)
    wide = F.exists(F.zip_with(column, normal, lambda a, b: a["text"] != b["text"]), lambda x: x)
    texts = lambda c: F.when(wide, F.transform(c, lambda x: x["text"]))
    df = df.withColumns({c: texts(x) for c, x in zip(old, (column, normal, text), strict=True)}).withColumn(back, restore_widths(*old))
    out = F.when(F.col(back).isNotNull(), F.zip_with(text, back, lambda x, t: F.struct(x["of"].alias("of"), x["open"].alias("open"), t.alias("text")))).otherwise(F.col(text))
    df = _customs(df.withColumn(column, out), settings, column, at, pieces=True)
    return df.drop(f"{at}about", f"{at}may", normal, text, back, *old)


def detections(text: Column, settings: Settings | None = None, rules: Iterable[Rule] | None = None) -> Column:
    """Array of (type, value, provider) of everything the rules find in a text, masked types or not.

    Every rule sees the same width-folded text, so that a value can be found by several. URLs follow,
    then custom patterns with their labels. Duplicates stay. Null gives an empty array.
    """
    settings = settings or Settings()
    chosen = registry() if rules is None else tuple(rules)
    none = F.array().cast(f"array<{DETECTION}>")

    def item(kind: str, value: Column, provider) -> Column:
        named = provider(value) if callable(provider) else F.lit(provider).cast("string")
        return F.struct(F.lit(kind).alias("type"), value.alias("value"), named.alias("provider"))

    def of_rule(rule: Rule, x: Column) -> Column:
        valid = lambda v: (v != "") & (rule.valid(v) if rule.valid else F.lit(True))
        values = F.filter(F.regexp_extract_all(x["text"], F.lit(rule.java), F.lit(rule.group)), valid)
        on = _can_match(rule, x["text"], x["about"])
        on = on & ~gave_up(x["text"], rule.overruns) if rule.overruns else on
        return F.when(on, F.transform(values, lambda v: item(rule.type, v, rule.provider))).otherwise(none)

    def of_pattern(kind: str, pattern: str, label: str | None, x: Column) -> Column:
        return F.transform(F.regexp_extract_all(x["text"], F.lit(pattern), F.lit(0)), lambda v: item(kind, v, label))

    def of_custom(c: CustomPattern, x: Column) -> Column:
        made = of_pattern("custom", c.java, c.label, x)
        return F.when(gave_up(x["text"], c.overruns), none).otherwise(made) if c.overruns else made

    def every(x: Column) -> Column:
        url = F.when(x["about"]["folded"].contains("://"), of_pattern("url", java(URL, "i"), None, x)).otherwise(none)
        return F.concat(*[of_rule(r, x) for r in chosen], url, *[of_custom(c, x) for c in settings.customs])

    # The folded text, and what is found out about it, are bound once by arrays of one.
    normal = F.array(F.coalesce(normalize(text), F.lit("")))
    seen = F.transform(normal, lambda t: F.struct(t.alias("text"), _about(t).alias("about")))
    return F.get(F.transform(seen, every), F.lit(0))


def confidence(kind: Column, field_type: Column | None = None) -> Column:
    """How sure a type's detections are; surer if the field's name says the same."""
    from ..patterns import CONFIDENCE

    base = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv]), kind), F.lit(0.5))
    return base if field_type is None else F.when(field_type == kind, F.least(F.lit(1.0), base + 0.2)).otherwise(base)


def mask_text(df: DataFrame, columns: str | list[str], settings: Settings | None = None, hooks: Hooks | None = None, consent: bool = False, html: bool = True, skipped: str | None = None) -> DataFrame:
    """Replace text columns by their masked forms and keep their markup.

    All columns of a row run through the rules together. Where masking would change the tags of an HTML
    text, its text runs and attribute values are masked one by one instead; without ``html`` no tags are
    looked at. With ``consent``, texts that hold a consent phrase stay as they are. So do null and empty
    texts, and a text of ``0``. ``skipped`` names an added column with the ids of rules that gave up on
    a text of the row. Other columns stay, whatever their names.
    """
    settings, hooks, at, given_columns = settings or Settings(), hooks or Hooks(), free_prefix(df), df.columns
    names = [columns] if isinstance(columns, str) else list(columns)
    piece = lambda i, open_, text: F.struct(F.lit(i).alias("of"), open_.alias("open"), text.alias("text"))
    given, plain, parts = f"{at}given", f"{at}plain", f"{at}parts"

    def start(i: int, c: str) -> Column:
        text = hooks.before(F.col(c)) if hooks.before else F.col(c)
        open_ = F.col(c).isNotNull() & ~F.col(c).isin("", "0")
        return piece(i, open_ & ~has_consent(F.col(c), settings.consent_phrases) if consent else open_, text)

    df = _mask_given(df.withColumns({given: F.array(*[start(i, c) for i, c in enumerate(names)]), f"{at}skipped": _no_ids()}), at, settings, html)
    out = {}
    for i, c in enumerate(names):
        text = F.get(plain, F.lit(i))["text"]
        if html:
            mine = F.transform(_of(parts, i), lambda x: x["text"])
            text = F.when(F.size(mine) > 0, F.array_join(mine, "")).otherwise(text)
        if hooks.after:
            text = hooks.after(text)
        if hooks.override:
            text = F.coalesce(hooks.override(F.col(c)), text)
        out[c] = F.when(F.get(given, F.lit(i))["open"], text).otherwise(F.col(c))
    return _finish(df.withColumns(out), given_columns, skipped, at)


def _mask_given(df: DataFrame, at: str, settings: Settings, html: bool) -> DataFrame:
    """Adds the masked forms of an array of pieces, and the HTML of texts whose tags these would change, in parts (of, text)."""
    from .markup import rendered, segments, signature

    given, plain, parts, source = (f"{at}{x}" for x in ("given", "plain", "parts", "source"))
    df = mask_pieces(df.withColumn(plain, F.col(given)), plain, settings, at)
    if not html:
        return df.withColumn(parts, F.filter(given, lambda x: F.lit(False)))
    pairs = F.zip_with(given, plain, lambda a, b: F.struct(a["of"].alias("of"), a["text"].alias("a"), b["text"].alias("b")))
    broken = F.filter(pairs, lambda x: x["a"].contains("<") & (x["a"] != x["b"]) & (signature(x["a"]) != signature(x["b"])))
    split = F.flatten(F.transform(broken, lambda x: F.transform(segments(x["a"]), lambda s: F.struct(x["of"].alias("of"), s.alias("piece")))))
    df = df.withColumn(source, F.when(F.exists(plain, lambda x: x["text"].contains("<")), split))
    values = F.transform(source, lambda x: F.struct(x["of"].alias("of"), x["piece"]["open"].alias("open"), x["piece"]["value"].alias("text")))
    df = mask_pieces(df.withColumn(parts, values), parts, settings, at)
    return df.withColumn(parts, F.zip_with(source, parts, lambda s, x: F.struct(s["of"].alias("of"), rendered(s["piece"], x["text"]).alias("text"))))


def mask_texts(df: DataFrame, column: str, settings: Settings | None = None, where: Column | None = None) -> DataFrame:
    """Replace an array of texts by their masked forms, each masked alone with its markup kept; only in rows where ``where`` holds.

    Texts that hold a consent phrase stay, as do null and empty ones, ``0``, and a null array.
    """
    settings, at, columns = settings or Settings(), free_prefix(df), df.columns
    given, plain, parts = f"{at}given", f"{at}plain", f"{at}parts"
    on = F.lit(True) if where is None else F.coalesce(where, F.lit(False))

    def start(x: Column, i: Column) -> Column:
        open_ = x.isNotNull() & ~x.isin("", "0") & on & ~has_consent(x, settings.consent_phrases)
        return F.struct(i.alias("of"), F.coalesce(open_, F.lit(False)).alias("open"), x.alias("text"))

    df = _mask_given(df.withColumns({given: F.transform(column, start), f"{at}skipped": _no_ids()}), at, settings, html=True)
    mine = lambda x: F.filter(F.col(parts), lambda y: y["of"] == x["of"])
    whole = lambda x: F.when(F.size(mine(x)) > 0, F.array_join(F.transform(mine(x), lambda y: y["text"]), "")).otherwise(x["text"])
    return _finish(df.withColumn(column, F.transform(plain, whole)), columns, None, at)


def _of(parts: str, i: int) -> Column:
    return F.filter(parts, lambda x: x["of"] == i)


def looks_masked(value: Column) -> Column:
    return value.contains("***") | (value == "[REDACTED]")


__all__ = ["Hooks", "apply_rule", "confidence", "detections", "enabled_rules", "found", "looks_masked", "mask_plain", "mask_text", "mask_texts"]
