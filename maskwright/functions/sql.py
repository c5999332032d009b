"""Masking as a function of the session's catalog, to be called from SQL.

The function is a chain of SQL functions whose bodies are the same expressions that ``operators.masking`` uses, so
the optimizer sees through them. Python runs only where characters that width folding changed come back.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..operators.markup import rendered, segments, signature
from ..operators.masking import SHAPES, _about, _may, _opened, _replacing, _steps, enabled_rules
from ..operators.restore import restore_width, restore_widths
from .text import has_consent, normalize

_AT = "mw_"
_ABOUT = "STRUCT<" + ", ".join(["folded: STRING", *[f"{x}: BOOLEAN" for x in SHAPES]]) + ">"
_MAY = "ARRAY<ARRAY<INT>>"
_PIECES = "ARRAY<STRUCT<of: INT, open: BOOLEAN, text: STRING>>"
_SEGMENTS = "ARRAY<STRUCT<kind: STRING, open: BOOLEAN, text: STRING, value: STRING, name: STRING>>"
#: A string literal, or an operator in the place of a function's name.
_OPERATOR = re.compile(r"""(?s)('(?:\\.|[^'\\])*')|(?<![\w`])(<=>|>=|<=|!=|[+\-*/%=<>!&|^~]|and|or|not)\(""")


def as_sql(column: Column) -> str:
    """An expression's text as SQL reads it: operators are called by their quoted names."""
    text = repr(column)[len("Column<'") : -len("'>")]
    return _OPERATOR.sub(lambda m: m[1] or f"`{m[2]}`(", text)


def register_mask_text(spark: SparkSession, settings: Settings | None = None, name: str = "mask_text", consent: bool = False, html: bool = True) -> None:
    """Make ``name(text)`` a temporary function: the text masked as ``mask_text`` does; with ``html`` its markup is kept.

    It may stand wherever SQL takes an expression. Null, empty texts and ``0`` stay; with ``consent`` so do texts that hold a
    consent phrase. The settings are those of the moment; rules that are added later need another call. Spark analyses the
    rules' expressions when the function is made and again in each query: without ``html`` half a minute, with it, which takes the
    rules twice, about three.
    """
    settings = settings or Settings()
    rules = enabled_rules(settings)
    text, given, masked, parts = F.col(f"{_AT}text"), F.col("given"), F.col("masked"), F.col("parts")

    def define(part: str, parameters: dict[str, str], returns: str, body: Column | str) -> str:
        made = f"{name}__{part}" if part else name
        declared = ", ".join(f"{p} {t}" for p, t in parameters.items())
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {made}({declared}) RETURNS {returns} RETURN {body if isinstance(body, str) else as_sql(body)}")
        return made

    def chain(part: str, kind: str, pieces: bool) -> str:
        """One function that applies all steps."""
        both = {f"{_AT}text": kind, f"{_AT}may": _MAY}
        call = f"{_AT}text"
        for i, step in enumerate(_steps(rules, _AT, pieces)):
            call = f"{define(f'{part}{i}', both, kind, step.masked)}({call}, {_AT}may)"
        return define(f"all_{part}", both, kind, call)

    restore, restore_all = f"{name}__restore", f"{name}__restore_all"
    spark.udf.register(restore, restore_width)
    spark.udf.register(restore_all, restore_widths)
    about = define("about", {f"{_AT}text": "STRING"}, _ABOUT, _about(text))
    may = define("may", {f"{_AT}about": _ABOUT}, _MAY, _may(rules, F.col(f"{_AT}about")))
    know = define("know", {f"{_AT}text": "STRING"}, _MAY, f"{may}({about}({_AT}text))")

    run = chain("rule", "STRING", pieces=False)
    wide = "masked <> normal AND normal <> given"
    back = f"CASE WHEN {wide} THEN {restore}(CASE WHEN {wide} THEN given END, CASE WHEN {wide} THEN normal END, CASE WHEN {wide} THEN masked END) WHEN masked <> normal THEN masked ELSE given END"
    widths = define("back", {"given": "STRING", "normal": "STRING", "masked": "STRING"}, "STRING", back)
    normal = as_sql(normalize(given))
    out = f"{widths}(given, {normal}, {run}({normal}, {know}({normal})))"
    for i, custom in enumerate(settings.customs):
        out = f"{define(f'custom{i}', {'given': 'STRING'}, 'STRING', _replacing(custom)(given))}({out})"

    if html:
        run = chain("piece", _PIECES, pieces=True)
        texts = lambda c: F.transform(c, lambda x: x["text"])
        changed = F.exists(F.zip_with("given", "normal", lambda a, b: a["text"] != b["text"]), lambda x: x)
        three = {"given": _PIECES, "normal": _PIECES, "masked": _PIECES}
        arguments = ", ".join(as_sql(F.when(changed, texts(c))) for c in three)
        again = define("again", {"masked": _PIECES, "texts": "ARRAY<STRING>"}, _PIECES, F.when(F.col("texts").isNotNull(), F.zip_with("masked", "texts", lambda x, t: F.struct(x["of"].alias("of"), x["open"].alias("open"), t.alias("text")))).otherwise(masked))
        widths = define("backs", three, _PIECES, f"{again}(masked, {restore_all}({arguments}))")
        values = F.transform(parts, lambda s: F.struct(F.lit(0).alias("of"), s["open"].alias("open"), s["value"].alias("text")))
        normals = F.transform(values, _opened(normalize))
        whole = F.array_join(F.transform(normals, lambda x: F.when(x["open"], x["text"])), " ")
        pieces = f"{widths}({as_sql(values)}, {as_sql(normals)}, {run}({as_sql(normals)}, {know}({as_sql(whole)})))"
        for i, custom in enumerate(settings.customs):
            pieces = f"{define(f'customs{i}', {'given': _PIECES}, _PIECES, F.transform(given, _opened(_replacing(custom))))}({pieces})"
        joined = define("joined", {"parts": _SEGMENTS, "masked": _PIECES}, "STRING", F.array_join(F.zip_with("parts", "masked", lambda s, x: rendered(s, x["text"])), ""))
        segmented = define("segmented", {"parts": _SEGMENTS}, "STRING", f"{joined}(parts, {pieces})")
        broken = given.contains("<") & (given != masked) & (signature(given) != signature(masked))
        kept = define("html", {"given": "STRING", "masked": "STRING"}, "STRING", f"coalesce({segmented}({as_sql(F.when(broken, segments(given)))}), masked)")
        out = f"{kept}(given, {out})"
    stays = given.isNull() | given.isin("", "0")
    if consent:
        stays = stays | has_consent(given, settings.consent_phrases)
    define("", {"given": "STRING"}, "STRING", f"CASE WHEN {as_sql(stays)} THEN given ELSE {out} END")
