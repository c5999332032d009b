"""Masking that keeps the tags of HTML texts.

Patterns here repeat possessively all over, so that they run without recursion and in one pass whatever a text
holds; a tag that is not closed takes the rest of its text and is looked at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import split_at

_WS = r" \t\f\r\n"
_NAME = rf"[A-Za-z][^/>{_WS}]*+"
#: An attribute's name and value; only a quote right after the equals sign opens a quoted value.
_ATTR_NAME = rf"(?:=[^=/>{_WS}]*+|[^=/>{_WS}]++)"
_ATTR = rf"""{_ATTR_NAME}(?:[{_WS}]*+=[{_WS}]*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^>{_WS}]*+)|(?![{_WS}]*+=))"""
_ATTR_VALUE = rf"""[{_WS}]*+=[{_WS}]*+(?:"([^"]*+)"|'([^']*+)'|((?!["'])[^>{_WS}]*+))|(?![{_WS}]*+=)"""
_REST_OF_TAG = rf"(?:[/{_WS}]++|{_ATTR})*+>"
#: Elements whose content is no markup, attributes that hold addresses, and named entities.
_RAW_NAMES = "script|style|textarea|title|iframe|noembed|noframes|xmp"
URI_ATTRIBUTES = ("action", "archive", "background", "cite", "classid", "codebase", "data", "formaction", "href", "icon", "longdesc", "manifest", "poster", "profile", "src", "usemap", "xmlns")
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "commat": "@", "period": ".", "colon": ":", "sol": "/", "num": "#", "plus": "+", "lowbar": "_", "lpar": "(", "rpar": ")", "equals": "=", "comma": ",", "semi": ";", "excl": "!", "quest": "?", "Tab": "\t", "NewLine": "\n"}

#: A whole tag that is no opener of a raw element.
TAG = rf"<(?!(?:{_RAW_NAMES})[/>{_WS}])/?{_NAME}{_REST_OF_TAG}"
_TOKEN = "(?i)" + "|".join(
    (
        r"<!--(?:-?>|(?:[^-]++|-(?!-!?>))*+--!?>)",
        r"<(?:!(?!--)|\?|/(?![A-Za-z>]))[^>]*+>",
        rf"(<({_RAW_NAMES})(?=[/>{_WS}]){_REST_OF_TAG})(?:[^<]++|<(?!/\2[/>{_WS}]))*+</\2{_REST_OF_TAG}",
        rf"({TAG})",
        r"(<(?:[A-Za-z!?]|/(?!>))[\s\S]*+)",
    )
)
#: How texts are cut for masking: comments, CDATA, and from each < to the next >.
_CUT = r"<!--(?:[^-]++|-(?!->))*+(?:-->)?|<!\[CDATA\[(?:[^\]]++|\](?!\]>))*+(?:\]\]>)?|<[^>]*+>?"
_FIRST_TAG = rf"(?i)^((?:[^<]++|<(?![A-Za-z!?/]))*+)({TAG})$"
_REFERENCE = rf"&(?:#[xX][0-9a-fA-F]{{1,6}}(?![0-9a-fA-F]);?|#[0-9]{{1,7}}(?![0-9]);?|(?:{'|'.join(ENTITIES)});)"


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def signature(html: Column) -> Column:
    """Tags and closers in order with their sorted attribute names, line breaks left out; a tag that is cut off ends it with a mark."""
    tokens = F.arrays_zip(*[_all(html, _TOKEN, g) for g in (1, 3, 4)])  # raw elements' openers, other tags, what is cut off
    body = lambda t: F.regexp_replace(t, rf"^</?{_NAME}", "")
    names = lambda t: F.transform(_all(body(t), rf"\G[/{_WS}]*+({_ATTR_NAME})(?:{_ATTR_VALUE})", 1), F.lower)
    sorted_names = lambda t: F.when(t.startswith("</"), "").otherwise(F.array_join(F.array_sort(F.array_distinct(names(t))), ","))
    named = lambda t: F.concat(F.upper(F.regexp_extract(t, rf"^<(/?{_NAME})", 1)), F.lit("["), sorted_names(t), F.lit("]"))
    each = F.transform(tokens, lambda x: F.when(x["2"] != "", "#incomplete").otherwise(_of_tag(F.concat(x["0"], x["1"]), named)))
    return F.array_join(F.filter(each, lambda x: x != ""), " ")


def _of_tag(tag: Column, named) -> Column:
    return F.when((tag == "") | tag.rlike(rf"(?i)^</?br[/>{_WS}]"), "").otherwise(named(tag))


def decoded(value: Column) -> Column:
    """An attribute's value with its character references resolved."""

    def one(ref: Column) -> Column:
        digits = F.regexp_extract(ref, "^&#[xX]?([0-9a-fA-F]+)", 1)
        code = F.when(ref.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).cast("int")
        good = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        # Characters from their code points: UTF-32 bytes.
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        name = F.regexp_extract(ref, "^&([A-Za-z]+)", 1)
        table = F.create_map(*[F.lit(x) for kv in ENTITIES.items() for x in kv])
        return F.when(ref.startswith("&#"), F.when(good, char).otherwise("�")).otherwise(F.element_at(table, name))

    refs = F.transform(_all(value, _REFERENCE, 0), one)
    joined = F.array_join(F.zip_with(split_at(value, _REFERENCE), refs, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.when(value.contains("&"), joined).otherwise(value)


def escaped(text: Column) -> Column:
    """Text for HTML; references that it holds are left as they are."""
    text = F.regexp_replace(text, "&(?!(?:[A-Za-z][A-Za-z0-9]*+|#[0-9]++|#[xX][0-9a-fA-F]++);)", "&amp;")
    return reduce(lambda t, x: F.replace(t, F.lit(x[0]), F.lit(x[1])), (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")), text)


def _escaped_address(text: Column) -> Column:
    """A URL for an attribute: blanks as %20, characters that no URL has left out."""
    text = F.regexp_replace(F.replace(F.ltrim(text), F.lit(" "), F.lit("%20")), r"[^a-zA-Z0-9~+_.?#=!&;,/:%@$|*'()\[\]\x80-\x{10FFFF}\\-]", "")
    text = F.regexp_replace(text, "&(?!(?:[A-Za-z][A-Za-z0-9]*+|#[0-9]++|#[xX][0-9a-fA-F]++);)", "&#038;")
    return F.replace(text, F.lit("'"), F.lit("&#039;"))


def segments(html: Column) -> Column:
    """Pieces (kind, open, text, value, name) in order; their texts joined are the HTML.

    ``text`` runs between tags, values of ``attribute``s, decoded, and ``stray`` pieces that are no tag are open: their ``value``
    may be masked. The rest of tags, and comments, are ``fixed``.
    """

    def piece(kind: str, text: Column, value: Column | None = None, name: Column | None = None) -> Column:
        value = F.lit("") if value is None else value
        return F.struct(F.lit(kind).alias("kind"), (F.lit(kind != "fixed") & (value != "")).alias("open"), text.alias("text"), value.alias("value"), (F.lit("") if name is None else name).alias("name"))

    def attributes(body: Column) -> Column:
        pattern = rf"\G([/{_WS}]*+)({_ATTR_NAME})(?:{_ATTR_VALUE})"
        found = F.arrays_zip(*[_all(body, pattern, g) for g in range(6)])

        def one(x: Column) -> Column:
            value = F.concat(x["3"], x["4"], x["5"])
            return F.when(value == "", piece("fixed", x["0"])).otherwise(piece("attribute", x["0"], decoded(value), F.concat(x["1"], F.lower(x["2"]))))

        return F.concat(F.transform(found, one), F.array(piece("fixed", F.regexp_replace(body, rf"^(?:[/{_WS}]*+{_ATTR})*+", ""))))

    def of_tag(part: Column) -> Column:
        tag = F.regexp_extract(part, _FIRST_TAG, 2)
        name = F.regexp_extract(tag, rf"^<{_NAME}", 0)
        opener = F.concat(F.array(piece("fixed", F.concat(F.regexp_extract(part, _FIRST_TAG, 1), name))), attributes(F.substr(tag, F.length(name) + 1)))
        return F.when(tag == "", F.array(piece("stray", part, part))).when(tag.startswith("</"), F.array(piece("fixed", part))).otherwise(opener)

    parts = _all(html, _CUT, 0)
    both = F.zip_with(split_at(html, _CUT), parts, lambda a, b: F.concat(F.array(piece("text", a, a)), F.when(b.isNull() | (b == ""), F.array(piece("fixed", F.lit("")))).when(b.startswith("<!"), F.array(piece("fixed", b))).otherwise(of_tag(b))))
    return F.filter(F.flatten(both), lambda x: x["text"] != "")


def rendered(piece: Column, masked: Column) -> Column:
    """A piece as HTML after its value was masked; what did not change stays as written."""
    address = F.regexp_extract(piece["name"], rf"[^/{_WS}]*+$", 0).isin(*URI_ATTRIBUTES)
    attribute = F.concat(piece["name"], F.lit('="'), F.when(address, _escaped_address(masked)).otherwise(escaped(masked)), F.lit('"'))
    kept = F.when(masked == piece["value"], piece["text"]).otherwise(F.when(piece["kind"] == "attribute", attribute).otherwise(masked))
    return F.when(piece["kind"] == "stray", escaped(masked)).when(piece["open"], kept).otherwise(piece["text"])
