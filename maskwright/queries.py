"""Queries over the given tables, one or more for each operator, and what SQL says they return."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import patterns as P
from . import rule_cases
from .config import CustomPattern, Settings
from .frames import small_functions, spread
from .functions import maskers as M
from .functions import text as N
from .functions import validators as V
from .operators import fields, images, markup
from .operators.masking import confidence, detections, mask_plain, mask_text
from .plans import scan
from .rules import BUILT_IN, Rule
from .sources import ingest
from .streaming import masked as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_RULES = {r.id: r for r in BUILT_IN}
_BY_SQL = ("email", "card", "phone_us_paren", "ipv4")


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


#: Narrow tables, from which texts are made that cost far more than reading, and the keys to deal them by.
_DEALT_BY = {"customer": "c_custkey", "orders": "o_orderkey", "supplier": "s_suppkey", "events": "event_id"}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_functions(spark)
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(table, _DEALT_BY[name]) if name in _DEALT_BY else table


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base or tempfile.mkdtemp(prefix='maskwright-')}/{name}-{uuid.uuid4().hex}"


def _rules(*names: str) -> list[Rule]:
    return [_RULES[n] for n in names]


def _masked(df: DataFrame, column: str, *rules: str) -> DataFrame:
    return mask_plain(df, column, rules=_rules(*rules))


# What rules that can be put without looking around make of a text, as SQL.

_V = "{v}"
_D = r"regexp_replace({v}, '\D', '', 'g')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _re2(pattern: str, flags: str = "") -> str:
    r"""A pattern without looking around in SQL's dialect, whose ``\s`` lacks a blank, or Unicode's blanks."""
    blank = r"\s\x0B\x{85}\p{Z}" if "u" in flags else r"\s\x0B"
    out, inside = "", False
    for part in re.findall(r"\\.|.", pattern, re.S):
        inside = True if part == "[" else False if part == "]" else inside
        out += (blank if inside else f"[{blank}]") if part == r"\s" else part
    return ("(?i)" if "i" in flags else "") + out


def _assigned_sql(words: str) -> str:
    """``patterns.assigned`` without looking ahead or behind: a lower-case name has an underscore before, after or in the word."""
    low = words.lower()
    inside = "|".join(w.replace("_?", "_") for w in low.split("|") if "_?" in w)
    names = [f"[A-Z0-9_]*(?:{words})[A-Z0-9_]*", f"[a-z0-9_]*_[a-z0-9_]*(?:{low})[a-z0-9_]*", f"[a-z0-9_]*(?:{low})[a-z0-9_]*_[a-z0-9_]*"]
    names += [f"[a-z0-9_]*(?:{inside})[a-z0-9_]*"] if inside else []
    return rf"""(\b(?:{"|".join(names)})[\t ]*(?:=>|=|:)[\t ]*["']?)([^\s\x0B\x{{85}}\p{{Z}}"'<>,;]{{4,200}})()"""


_NO_SECRET_SQL = f"NOT regexp_matches({{v}}, '(?i){P.NO_SECRET}')"
_LUHN_SQL = f"list_sum([CASE WHEN i % 2 = 0 THEN CAST(substr(reverse({_D}), CAST(i AS INT) + 1, 1) AS INT) ELSE (2 * CAST(substr(reverse({_D}), CAST(i AS INT) + 1, 1) AS INT)) // 10 + (2 * CAST(substr(reverse({_D}), CAST(i AS INT) + 1, 1) AS INT)) % 10 END for i in range(length({_D}))]) % 10 = 0"
_IS_CARD = f"length({_D}) BETWEEN 13 AND 19 AND {_LUHN_SQL}"
_IS_SSN = f"substr({_D}, 1, 3) NOT IN ('000', '666') AND substr({_D}, 1, 1) <> '9' AND substr({_D}, 4, 2) <> '00' AND substr({_D}, 6, 4) <> '0000'"
_TOKEN_MASK = "CASE WHEN strlen({v}) >= 32 THEN left({v}, 4) || repeat('*', strlen({v}) - 8) || right({v}, 4) WHEN strlen({v}) >= 12 THEN left({v}, 4) || '***' ELSE '***' END"
_URL_MASK = "regexp_extract({v}, '(?i)^[a-z][a-z0-9+.-]*://[^/]+/', 0) || '***'"
_PHONE_MASK = f"'***-***-' || right({_D}, 4)"
_CARD_MASK = f"'****-****-****-' || right({_D}, 4)"
_DISTINCT = "len(list_distinct(string_split(lower({v}), '')))"


def _hit(pattern: str, flags: str = "") -> str:
    return f"regexp_matches({{v}}, {_quoted(_re2(pattern, flags))})"


def _ai_key_sql() -> tuple[str, str]:
    """Whether the first shape that fits takes a key, and whose it is."""
    valid, provider, whole = [], [], "regexp_matches({v}, '^[0-9A-Fa-f]{32}$')"
    for name, (pattern, owner) in P.AI_KEY_VALUES.items():
        hit, mine = _hit(pattern), "true"
        if name == "azure_openai":
            hit, mine = f"{hit} AND {whole}", f"{_DISTINCT} >= 8"
        elif name == "generic_ai_key":
            hit, mine = hit + " AND regexp_matches({v}, '^(?i:sk-|ai-|api-)')", "strlen({v}) BETWEEN 20 AND 100"
        valid.append(f"WHEN {hit} THEN {mine}")
        provider.append(f"WHEN {hit}{f' AND {mine}' if name == 'azure_openai' else ''} THEN {_quoted(owner)}")
    return f"CASE {' '.join(valid)} ELSE false END", f"CASE {' '.join(provider)} END"


def _hosting_sql() -> tuple[str, str]:
    """An identifier's masked form, and its provider."""
    kept = lambda a, b: f"left({{v}}, {a}) || '***' || right({{v}}, {b})"
    forms = [(r"^xs\d{5,8}$", kept(2, 3)), (r"^sv\d{3,5}$", kept(2, 1)), (r"^[a-z]{3}\d{5}$", kept(3, 2)), (r"\.sakura\.ne\.jp$", "'***.sakura.ne.jp'"), (r"\.lolipop\.jp$", "'***.lolipop.jp'"), (r"\.mixh\.jp$", "'***.mixh.jp'")]
    forms += [(r"^gnc[a-z0-9]{8,12}$", "'gnc***' || right({v}, 4)"), (r"^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$", "'****-****-****-****-' || right({v}, 12)")]
    mask = " ".join(f"WHEN {_hit(pattern, 'i')} THEN {form}" for pattern, form in forms)
    return f"CASE {mask} ELSE '***' END", f"CASE {' '.join(f'WHEN {_hit(p, f)} THEN {_quoted(owner)}' for p, f, owner in P.HOSTING.values())} END"


class _Stated(NamedTuple):
    """A rule as SQL says it: its pattern with groups before, of and after the value; of ``{v}``, the value, the masked form, check and provider."""

    id: str
    pattern: str
    mask: str
    valid: str = "true"
    provider: str = "NULL"


def _stated() -> list[_Stated]:
    """Rules in their order. Edges of ASCII words stand for looking behind; a rule is left out where looking around can't be put so."""
    hidden, secret = "'[REDACTED]'", "Config secret"
    of = lambda before, value, after, flags="": _re2(f"({before})({value})({after})", flags)
    whole = lambda pattern, flags="": of("", pattern, "", flags)
    words, blank, edge = f"{P.PASSWORD_WORDS}|{P.SECRET_WORDS}", r"[\s　]*", r"(?:^|[^\p{L}\p{M}\p{N}\p{Pc}])"
    password = r"(?:\b(?:password|passwd|passcode|pwd|P/W|PW|PIN)|\B(?:パスワード|パスコード|ログインパス|暗証番号))"
    key_body = r"(?:[A-Za-z0-9+/=:,.\s-]|<br\s*/?>)"
    hosting, whose = _hosting_sql()
    ai, maker = _ai_key_sql()
    rules = [
        _Stated("private_key", whole(rf"-----BEGIN [A-Z ]{{0,48}}PRIVATE KEY(?: BLOCK)?-----{key_body}{key_body}*?-----END [A-Z ]{{0,48}}PRIVATE KEY(?: BLOCK)?-----"), hidden, provider="'Private key'"),
        _Stated("labeled_password", of(rf"{password}[\s]*[:=は][\s]*", r"[\x21-\x7E]{4,64}", "", flags="iu"), hidden),
        _Stated("define_secret", of(rf"""define\(\s*["'][A-Z0-9_]*(?:{words})[A-Z0-9_]*["']\s*,\s*["']""", r"""[^"'\r\n<>]{1,200}""", "", flags="u"), hidden, _NO_SECRET_SQL, _quoted(secret)),
        _Stated("env_password", _assigned_sql(P.PASSWORD_WORDS), hidden, _NO_SECRET_SQL),
        _Stated("env_secret", _assigned_sql(P.SECRET_WORDS), hidden, _NO_SECRET_SQL, _quoted(secret)),
        _Stated("curl_user", of(r"""\bcurl\b[^\r\n]{0,200}?(?:-u|--user)[ =]+["']?[^\s:"'@]{1,64}:""", r"""[^\s"']{1,64}""", ""), hidden, provider="'Basic auth'"),
        _Stated("auth_basic", of(rf"{edge}Authorization{blank}[：:]{blank}Basic\s+", r"[A-Za-z0-9+/]{8,}={0,2}", "", flags="iu"), "left({v}, 4) || '***'", provider="'Basic auth'"),
        _Stated("url_userinfo", of(r"\b[a-z][a-z0-9+.\-]{1,20}://[^\s/:@]{1,64}:", r"[^\s/@]{1,64}", "@", flags="i"), "'***'", provider="'Basic auth'"),
        _Stated("bearer", of(rf"{edge}Bearer\b{blank}[：:]?{blank}", r"[A-Za-z0-9\-_~+/]{8,}(?:\.[A-Za-z0-9\-_~+/=]+){0,4}=*", "", flags="u"), _TOKEN_MASK, "regexp_matches({v}, '[0-9_+/=.-]')", "'Bearer token'"),
        _Stated("email", whole(P.EMAIL), "left({v}, 1) || '***@' || split_part({v}, '@', 2)"),
        _Stated("card", whole(_RULES["card"].pattern), _CARD_MASK, _IS_CARD),
        _Stated("card_amex_diners", whole(_RULES["card_amex_diners"].pattern), _CARD_MASK, _IS_CARD),
        _Stated("ssn", whole(P.SSN), f"'***-**-' || right({_D}, 4)", _IS_SSN),
        *[_Stated(x, whole(_RULES[x].pattern), _PHONE_MASK, f"length({_D}) >= 7") for x in ("phone_jp_mobile", "phone_jp_paren", "phone_jp_special", "phone_jp_landline", "phone_international", "phone_us_paren")],
        _Stated("ipv4", whole(P.IPV4), "split_part({v}, '.', 1) || '.***.***.' || split_part({v}, '.', 4)"),
        *[_Stated(f"hosting_{x}", whole(*P.HOSTING[x][:2]), hosting, provider=whose) for x in P.HOSTING_IN_TEXT],
        *[_Stated(f"secret_{x}", whole(p), _URL_MASK if x.endswith("_webhook") and "https" in p else _TOKEN_MASK, provider=_quoted(owner)) for x, (p, owner) in P.DEVELOPER_SECRETS.items()],
        *[_Stated(f"ai_{x}", whole(p), _TOKEN_MASK, ai, maker) for x, p in P.AI_KEYS_IN_TEXT.items()],
    ]
    return rules


_STATED = _stated()
#: Stands around values while they are masked; no character of any text.
_MARK = "￿"


def _masked_sql(text: str) -> str:
    """Rule by rule, values between marks; those that are valid give way to their masked forms."""
    steps = []
    for rule in _STATED:
        pattern = _quoted(rule.pattern)
        marked = f"regexp_replace(done, {pattern}, '\\1{_MARK}\\2{_MARK}\\3', 'g')"
        put = f"CASE WHEN i % 2 = 0 AND {rule.valid.replace(_V, 'v')} THEN {rule.mask.replace(_V, 'v')} ELSE v END"
        steps.append(f"WHEN rule = '{rule.id}' AND regexp_matches(done, {pattern}) THEN array_to_string(list_transform(string_split({marked}, '{_MARK}'), lambda v, i: {put}), '')")
    names = ", ".join(f"'{rule.id}'" for rule in _STATED)
    return f"list_reduce(list_prepend({text}, [{names}]), lambda done, rule: CASE {' '.join(steps)} ELSE done END)"


def _detections_sql(text: str) -> str:
    """What they find as a list of (type, value, provider), and URLs."""

    def of(rule: _Stated) -> str:
        values = f"regexp_extract_all({text}, {_quoted(rule.pattern)}, 2)"
        return f"[{{'type': '{_RULES[rule.id].type}', 'value': v, 'provider': CAST({rule.provider.replace(_V, 'v')} AS VARCHAR)}} for v in {values} if {rule.valid.replace(_V, 'v')}]"

    urls = f"regexp_extract_all({text}, {_quoted(_re2(P.URL, 'i'))}, 0)"
    return f"flatten([{', '.join([*map(of, _STATED), f"[{{'type': 'url', 'value': v, 'provider': CAST(NULL AS VARCHAR)}} for v in {urls}]"])}])"


_CONSENT_SQL = "(" + " OR ".join(f"contains(lower({{0}}), '{p.lower()}')" for p in Settings().consent_phrases) + ")"


# Masking of one kind in stored texts.


@_query("mask_email_documents", r"SELECT doc_id, regexp_replace(text, '([a-zA-Z0-9._%+-])[a-zA-Z0-9._%+-]*@([a-zA-Z0-9.-]+\.[a-zA-Z]{2,})', '\1***@\2', 'g') AS text FROM documents")
def mask_email_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _masked(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "email")


_OCTET = "(25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"


@_query("mask_ipv4_documents", rf"SELECT doc_id, regexp_replace(text, '\b{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}\b', '\1.***.***.\4', 'g') AS text FROM documents")
def mask_ipv4_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _masked(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "ipv4")


_PHONE_SQL = r"regexp_replace({}, '\((\d{{3}})\)\s?(\d{{3}})[-\s]?(\d{{4}})', '***-***-\3', 'g')"


@_query("mask_phone_us_documents", f"SELECT doc_id, {_PHONE_SQL.format('text')} AS text FROM documents")
def mask_phone_us_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _masked(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "phone_us_paren")


@_query("mask_phone_us_pages", f"SELECT page_id, {_PHONE_SQL.format('html')} AS html FROM pages")
def mask_phone_us_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _masked(_table(spark, sf_dir, "pages").select("page_id", "html"), "html", "phone_us_paren")


_CARD = r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{1,7}\b"
_CARDS_SQL = rf"""
    cards AS (
        SELECT doc_id, m, regexp_replace(m, '\D', '', 'g') AS d
        FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_CARD}')) AS m FROM documents)
    ), digits AS (SELECT doc_id, m, d, unnest(range(length(d))) AS i FROM (SELECT doc_id, m, d, row_number() OVER () AS k FROM cards)),
    numbered AS (SELECT doc_id, m, d, row_number() OVER () AS k FROM cards),
    sums AS (
        SELECT k, sum(CASE WHEN i % 2 = 0 THEN x WHEN 2 * x > 9 THEN 2 * x - 9 ELSE 2 * x END) AS s
        FROM (SELECT k, i, CAST(substr(reverse(d), CAST(i AS INT) + 1, 1) AS INT) AS x FROM (SELECT k, d, unnest(range(length(d))) AS i FROM numbered))
        GROUP BY k
    ), valid AS (SELECT n.* FROM numbered n JOIN sums USING (k) WHERE s % 10 = 0 AND length(d) BETWEEN 13 AND 19)
""".replace("digits AS (SELECT doc_id, m, d, unnest(range(length(d))) AS i FROM (SELECT doc_id, m, d, row_number() OVER () AS k FROM cards)),\n    ", "")


@_query("luhn_cards_by_lang", f"WITH {_CARDS_SQL} SELECT lang, count(*) AS cards FROM valid JOIN documents USING (doc_id) GROUP BY lang")
def luhn_cards_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return docs.select("lang", F.explode(detections(F.col("text"), rules=_rules("card"))).alias("d")).filter("d.type = 'card'").groupBy("lang").agg(F.count(F.lit(1)).alias("cards"))


@_query("mask_card_documents", rf"WITH {_CARDS_SQL}, n AS (SELECT doc_id, count(*) AS c FROM valid GROUP BY doc_id) SELECT doc_id, coalesce(c, 0) AS masked_cards, coalesce(c, 0) > 0 AS changed FROM documents LEFT JOIN n USING (doc_id)")
def mask_card_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.col("text").alias("given"))
    out = _masked(docs, "text", "card")
    made = F.size(F.regexp_extract_all("text", F.lit(r"\*{4}-\*{4}-\*{4}-[0-9]{4}"), F.lit(0))) - F.size(F.regexp_extract_all("given", F.lit(r"\*{4}-\*{4}-\*{4}-[0-9]{4}"), F.lit(0)))
    return out.select("doc_id", made.cast("long").alias("masked_cards"), (F.col("text") != F.col("given")).alias("changed"))


# Masking of values that the tables do not hold, made from their columns.


@_query("mask_bank_orders", r"SELECT o_orderkey, '口座番号：' || '***' || right(lpad(CAST(o_orderkey AS VARCHAR), 7, '0'), 4) AS text FROM orders")
def mask_bank_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("口座番号："), F.lpad(F.col("o_orderkey").cast("string"), 7, "0"))
    return _masked(_table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text")), "text", "bank_labeled", "bank_passbook")


def _ssn() -> Column:
    d = F.lpad((F.col("o_orderkey") * 7919 % 1_000_000_000).cast("string"), 9, "0")
    return F.concat_ws("-", F.substring(d, 1, 3), F.substring(d, 4, 2), F.substring(d, 6, 4))


_SSN_SQL = "lpad(CAST(o_orderkey * 7919 % 1000000000 AS VARCHAR), 9, '0')"


@_query(
    "ssn_validate_orders",
    f"""SELECT o_orderkey, ok AS valid, CASE WHEN ok THEN '***-**-' || substr(d, 6, 4) ELSE substr(d, 1, 3) || '-' || substr(d, 4, 2) || '-' || substr(d, 6, 4) END AS text FROM (
        SELECT o_orderkey, d, substr(d, 1, 3) NOT IN ('000', '666') AND substr(d, 1, 1) <> '9' AND substr(d, 4, 2) <> '00' AND substr(d, 6, 4) <> '0000' AS ok
        FROM (SELECT o_orderkey, {_SSN_SQL} AS d FROM orders))""",
)
def ssn_validate_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "orders").select("o_orderkey", _ssn().alias("text"))
    return _masked(df.withColumn("valid", V.is_ssn_number(F.col("text"))), "text", "ssn")


@_query(
    "mynumber_validate_orders",
    """SELECT o_orderkey, (CASE WHEN s % 11 <= 1 THEN 0 ELSE 11 - s % 11 END) = CAST(substr(d, 12, 1) AS INT) AS valid FROM (
        SELECT o_orderkey, d, (SELECT sum(CAST(substr(d, CAST(i AS INT), 1) AS INT) * (CASE WHEN i <= 5 THEN 7 - i ELSE 13 - i END)) FROM range(1, 12) r(i)) AS s
        FROM (SELECT o_orderkey, lpad(CAST(o_orderkey * 7654321 AS VARCHAR), 12, '0') AS d FROM orders))""",
)
def mynumber_validate_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.lpad((F.col("o_orderkey") * 7_654_321).cast("string"), 12, "0")
    return _table(spark, sf_dir, "orders").select("o_orderkey", V.is_my_number(d).alias("valid"))


@_query("mask_token_derived", "SELECT c_custkey, 'npm_' || repeat('*', 32) || substr(md5(CAST(c_custkey AS VARCHAR)) || md5(CAST(c_custkey AS VARCHAR)), 33, 4) AS text FROM customer")
def mask_token_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.md5(F.col("c_custkey").cast("string"))
    text = F.concat(F.lit("npm_"), F.substring(F.concat(h, h), 1, 36))
    return _masked(_table(spark, sf_dir, "customer").select("c_custkey", text.alias("text")), "text", "secret_npm_token")


@_query("mask_hosting_derived", "SELECT c_custkey, 'xs***' || right(lpad(CAST(c_custkey AS VARCHAR), 6, '0'), 3) || ' sv***' || right(CAST(c_custkey % 900 + 100 AS VARCHAR), 1) AS text FROM customer")
def mask_hosting_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("xs"), F.lpad(F.col("c_custkey").cast("string"), 6, "0"), F.lit(" sv"), (F.col("c_custkey") % 900 + 100).cast("string"))
    return _masked(_table(spark, sf_dir, "customer").select("c_custkey", text.alias("text")), "text", "hosting_xserver_account", "hosting_xserver_server")


@_query("dev_secret_derived", "SELECT event_id, 'glpa***' AS text, 'GitLab' AS provider FROM events")
def dev_secret_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("glpat-"), F.substring(F.md5(F.col("event_id").cast("string")), 1, 20)).alias("text"))
    found = detections(F.col("text"), rules=_rules("secret_gitlab_token"))
    return _masked(df.withColumn("provider", F.get(found, F.lit(0))["provider"]), "text", "secret_gitlab_token")


@_query(
    "ai_key_derived",
    """SELECT event_id, ok AS masked FROM (SELECT event_id,
        (SELECT count(DISTINCT substr(h, CAST(i AS INT), 1)) FROM range(1, 33) r(i)) >= 8 AS ok FROM (SELECT event_id, md5(CAST(event_id AS VARCHAR)) AS h FROM events))""",
)
def ai_key_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "events").select("event_id", F.md5(F.col("event_id").cast("string")).alias("text"))
    return _masked(df, "text", "ai_azure_openai").select("event_id", F.col("text").contains("*").alias("masked"))


@_query("dob_derived", "SELECT o_orderkey, 'birth date: ****-**-**' AS text FROM orders")
def dob_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("birth date: "), F.date_format("o_orderdate", "yyyy-MM-dd"))
    return _masked(_table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text")), "text", "dob")


@_query("id_doc_derived", "SELECT o_orderkey, 'Passport No. *********' AS text FROM orders")
def id_doc_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("Passport No. TK"), F.lpad((F.col("o_orderkey") % 10_000_000).cast("string"), 7, "0"))
    return _masked(_table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text")), "text", "passport", "drivers_license", "residence_card")


@_query("password_derived", "SELECT c_custkey, 'password: [REDACTED]' AS text FROM customer")
def password_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("password: "), F.substring(F.md5(F.col("c_custkey").cast("string")), 1, 12))
    return _masked(_table(spark, sf_dir, "customer").select("c_custkey", text.alias("text")), "text", "labeled_password", "env_password", "env_secret")


@_query("expiry_cvv_derived", "SELECT o_orderkey, 'Valid thru: **/** CVV: ***' AS text FROM orders")
def expiry_cvv_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("Valid thru: "), F.date_format("o_orderdate", "MM/yy"), F.lit(" CVV: "), F.lpad((F.col("o_orderkey") % 1000).cast("string"), 3, "0"))
    return _masked(_table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text")), "text", "contact_card_expiry", "contact_card_cvv")


@_query("contact_derived", "SELECT c_custkey, 'Your name: C******** Phone: ***-***-' || right(lpad(CAST(c_custkey AS VARCHAR), 10, '0'), 4) AS text FROM customer")
def contact_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("Your name: Customerx Phone: "), F.lpad(F.col("c_custkey").cast("string"), 10, "0"))
    return _masked(_table(spark, sf_dir, "customer").select("c_custkey", text.alias("text")), "text", "contact_name", "contact_phone")


@_query("address_derived", "SELECT c_custkey, '東京都***' AS text FROM customer")
def address_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("東京都渋谷区渋谷"), (F.col("c_custkey") % 9 + 1).cast("string"), F.lit("-8-1"))
    return _masked(_table(spark, sf_dir, "customer").select("c_custkey", text.alias("text")), "text", "jp_address", "jp_city_address", "jp_postal")


# Every rule on texts made for it, together with the other rules of its kind.


def _rules_query(name: str, *prefixes: str) -> None:
    names = [r.id for r in BUILT_IN if r.id.startswith(prefixes) and r.id in rule_cases.CASES]

    def masked(spark: SparkSession, sf_dir: str) -> DataFrame:
        texts = F.array(*[F.struct(F.lit(r).alias("rule"), F.expr(rule_cases.text_sql(r)).alias("text")) for r in names])
        rows = _table(spark, sf_dir, "customer").select("c_custkey", F.explode(texts).alias("x")).select("c_custkey", "x.rule", "x.text")
        return mask_plain(rows, "text", Settings().with_masks(name_text=True), rules=_rules(*names))

    _query(name, rule_cases.expected_sql(names))(masked)


_rules_query("rules_credentials", "private_key", "labeled_password", "define_secret", "env_", "curl_user", "auth_basic", "url_userinfo", "bearer")
_rules_query("rules_documents", "dob", "bank_", "passport", "drivers_license", "health_insurance", "pension", "residence_card")
_rules_query("rules_contact", "contact_")
_rules_query("rules_address", "jp_")
_rules_query("rules_numbers", "email", "card", "ssn", "mynumber", "phone_", "ipv")
_rules_query("rules_hosting", "hosting_")
_rules_query("rules_secrets", "secret_")
_rules_query("rules_ai_keys", "ai_")
_rules_query("rules_names", "name_")


# Normalisation.

_ASCII = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ#"
_WIDE = "".join(chr(ord(c) + 0xFEE0) for c in _ASCII)


@_query("normalize_fullwidth", f"SELECT c_custkey, translate(translate(c_name, '{_ASCII}', '{_WIDE}'), '{_WIDE}', '{_ASCII}') AS text FROM customer")
def normalize_fullwidth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").select("c_custkey", N.normalize(F.translate("c_name", _ASCII, _WIDE)).alias("text"))


@_query("restore_fullwidth", "SELECT o_orderkey, 'ＴＥＬ ***－***－' || translate(right(lpad(CAST(o_orderkey AS VARCHAR), 8, '0'), 4), '0123456789', '０１２３４５６７８９') AS text FROM orders")
def restore_fullwidth(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.lpad(F.col("o_orderkey").cast("string"), 8, "0")
    wide = F.translate(F.concat(F.substring(d, 1, 4), F.lit("-"), F.substring(d, 5, 4)), "0123456789-", "０１２３４５６７８９－")
    df = _table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("ＴＥＬ ０９０－"), wide).alias("text"))
    return _masked(df, "text", "phone_jp_mobile")


@_query("consent_bypass", "SELECT conv_id, turn, contains(lower(t), 'i consent to unmasking') AS consent FROM (SELECT conv_id, turn, text || CASE WHEN turn % 2 = 0 THEN ' I CONSENT to unmasking' ELSE '' END AS t FROM conversations)")
def consent_bypass(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("text", F.when(F.col("turn") % 2 == 0, " I CONSENT to unmasking").otherwise(""))
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", N.has_consent(text, Settings().consent_phrases).alias("consent"))


@_query("excerpt_documents", r"""SELECT doc_id, CASE WHEN length(p) > 40 THEN left(p, 40) || '…' ELSE p END AS excerpt FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '<[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS p FROM documents)""")
def excerpt_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", M.excerpt(F.col("text")).alias("excerpt"))


# Detection and reports.

_TYPES_SQL = rf"""
    WITH {_CARDS_SQL}, t AS (
        SELECT doc_id, 'email' AS type FROM documents WHERE regexp_matches(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}}')
        UNION SELECT doc_id, 'card' FROM valid
        UNION SELECT doc_id, 'phone' FROM documents WHERE regexp_matches(text, '\(\d{{3}}\)\s?\d{{3}}[-\s]?\d{{4}}')
        UNION SELECT doc_id, 'ip' FROM documents WHERE regexp_matches(text, '\b{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}\b')
    )"""


@_query("detect_types_documents", f"{_TYPES_SQL} SELECT doc_id, string_agg(type, ',' ORDER BY type) AS types FROM t GROUP BY doc_id")
def detect_types_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = F.array_sort(scan.types_of(detections(F.col("text"), rules=_rules(*_BY_SQL))))
    return _table(spark, sf_dir, "documents").select("doc_id", F.array_join(types, ",").alias("types")).filter("types <> ''")


@_query("pii_rate_by_source_lang", f"{_TYPES_SQL} SELECT source, lang, count(*) AS docs, count(DISTINCT t.doc_id) AS with_pii FROM (SELECT doc_id, source, lang FROM documents) d LEFT JOIN (SELECT DISTINCT doc_id FROM t) t ON d.doc_id = t.doc_id GROUP BY source, lang")
def pii_rate_by_source_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.size(scan.types_of(detections(F.col("text"), rules=_rules(*_BY_SQL)))) > 0
    docs = _table(spark, sf_dir, "documents").select("source", "lang", found.cast("int").alias("hit"))
    return docs.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("docs"), F.sum("hit").cast("long").alias("with_pii"))


@_query(
    "scan_report_documents",
    f"""SELECT doc_id, types, NOT consent AND masked <> text AS would_change, consent AS consent_bypassed,
        CASE WHEN consent THEN 'consent-skipped' WHEN masked <> text THEN 'would-mask' ELSE 'detected-only' END AS status
    FROM (SELECT doc_id, text, {_masked_sql("text")} AS masked, {_CONSENT_SQL.format("text")} AS consent,
            array_to_string(list_sort(list_distinct([d.type for d in {_detections_sql("text")} if d.type <> 'url'])), ',') AS types FROM documents)
    WHERE types <> '' OR NOT consent AND masked <> text""",
)
def scan_report_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules over all documents: what each holds, and whether masking changes it."""
    docs = _table(spark, sf_dir, "documents")
    rows = scan.report(docs, "documents", "doc_id", ["text"])
    return rows.select(F.col("id").alias("doc_id"), F.concat_ws(",", F.array_sort("detected_types")).alias("types"), "would_change", "consent_bypassed", "status")


@_query(
    "detections_documents",
    f"""SELECT doc_id, CAST(n - 1 AS INT) AS n, found[n].type AS type, found[n].value AS value, found[n].provider AS provider
    FROM (SELECT doc_id, found, unnest(range(1, len(found) + 1)) AS n FROM (SELECT doc_id, {_detections_sql("text")} AS found FROM documents))""",
)
def detections_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detections(F.col("text"))
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(found).alias("n", "d"))
    return rows.select("doc_id", "n", "d.type", "d.value", "d.provider")


@_query("scan_page", r"SELECT doc_id, source, regexp_matches(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}') AS has_email FROM documents ORDER BY doc_id LIMIT 100 OFFSET 50")
def scan_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.page(_table(spark, sf_dir, "documents").select("doc_id", "source", V.is_email(F.col("text")).alias("has_email")), "doc_id", 50, 100)


@_query("count_items", "SELECT 'documents' AS target, count(*) AS items FROM documents UNION ALL SELECT 'conversations', count(*) FROM conversations UNION ALL SELECT 'pages', count(*) FROM pages")
def count_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.count_items({t: _table(spark, sf_dir, t) for t in ("documents", "conversations", "pages")})


@_query("scan_status_documents", r"""SELECT doc_id, CASE WHEN contains(lower(text), 'i consent to') THEN 'consent-skipped' WHEN regexp_matches(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}') THEN 'would-mask' ELSE 'detected-only' END AS status FROM documents""")
def scan_status_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _masked(_table(spark, sf_dir, "documents").select("doc_id", "text", F.col("text").alias("given")), "text", "email")
    flags = df.select("doc_id", (F.col("text") != F.col("given")).alias("would_change"), N.has_consent(F.col("given"), ("I consent to",)).alias("consent_bypassed"))
    return flags.select("doc_id", scan.status().alias("status"))


_CONFIDENCE_SQL = "CASE type WHEN 'phone' THEN 0.7 ELSE 0.95 END"


@_query("confidence_scores", f"{_TYPES_SQL} SELECT doc_id, type, CAST({_CONFIDENCE_SQL} AS DOUBLE) AS confidence FROM t")
def confidence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = scan.types_of(detections(F.col("text"), rules=_rules(*_BY_SQL)))
    return _table(spark, sf_dir, "documents").select("doc_id", F.explode(types).alias("type")).withColumn("confidence", confidence(F.col("type")))


@_query("preview_conversations", f"SELECT conv_id, turn, CAST(len(list_distinct({_detections_sql('text')})) AS INT) AS found, {_masked_sql('text')} <> text AS changed FROM conversations")
def preview_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan.preview_text(_table(spark, sf_dir, "conversations"), "text")
    return rows.select("conv_id", "turn", F.size("preview").alias("found"), (F.col("masked") != F.col("text")).alias("changed"))


# Fields and records.

_FIELD_COLUMNS = {"c_name": "name", "c_mktsegment": "hotel", "c_acctbal": "description", "c_custkey": "transaction_id"}


def _customer_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).cast("string").alias("value")) for c, n in _FIELD_COLUMNS.items()])
    return _table(spark, sf_dir, "customer").select("c_custkey", F.explode(pairs).alias("f")).select("c_custkey", "f.name", "f.value")


@_query(
    "field_type_classify",
    """SELECT c_custkey, name, CASE name WHEN 'name' THEN 'name' WHEN 'hotel' THEN 'phone' WHEN 'description' THEN 'ip' WHEN 'client_secret' THEN 'password' WHEN 'capacity' THEN 'address' END AS type
    FROM customer, (VALUES ('name'), ('hotel'), ('description'), ('client_secret'), ('capacity'), ('zzz')) v(name)""",
)
def field_type_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ("name", "hotel", "description", "client_secret", "capacity", "zzz")))
    rows = _table(spark, sf_dir, "customer").select("c_custkey", F.explode(names).alias("name"))
    return rows.withColumn("type", fields.type_of_name(F.col("name")))


@_query(
    "mask_field_values",
    """SELECT c_custkey, 'name' AS name, left(c_name, 1) || repeat('*', length(c_name) - 1) AS value FROM customer
    UNION ALL SELECT c_custkey, 'hotel', c_mktsegment FROM customer""",
)
def mask_field_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _customer_fields(spark, sf_dir).filter(F.col("name").isin("name", "hotel"))
    return rows.withColumn("value", fields.mask_value(F.col("name"), F.col("value")))


@_query("map_record_mask", "SELECT c_custkey, left(c_name, 1) || repeat('*', length(c_name) - 1) AS name, CAST(c_custkey AS VARCHAR) AS transaction_id, '[REDACTED]' AS passwd FROM customer")
def map_record_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = F.create_map(F.lit("full_name"), "c_name", F.lit("transaction_id"), F.col("c_custkey").cast("string"), F.lit("passwd"), F.lit("hunter2"))
    rows = _table(spark, sf_dir, "customer").select("c_custkey", fields.mask_record(record).alias("r"))
    return rows.select("c_custkey", F.col("r.full_name").alias("name"), F.col("r.transaction_id").alias("transaction_id"), F.col("r.passwd").alias("passwd"))


@_query("custom_pattern_mask", "SELECT c_custkey, regexp_replace(c_name, '#[0-9]+', '[ID]', 'g') AS text FROM customer")
def custom_pattern_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = Settings(custom_patterns=(CustomPattern("Customer", "#[0-9]+", '<[ID]">'), CustomPattern("broken", "(")))
    return mask_plain(_table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("text")), "text", settings, rules=[])


_PARTS_SQL = "'10.' || CAST(user_id % 200 AS VARCHAR) || '.' || CAST(event_id % 250 AS VARCHAR) || '.'"


@_query("ip_anonymize", f"SELECT event_id, {_PARTS_SQL} || '0' AS ip FROM events")
def ip_anonymize(spark: SparkSession, sf_dir: str) -> DataFrame:
    ip = F.concat_ws(".", F.lit("10"), F.col("user_id") % 200, F.col("event_id") % 250, F.col("event_id") % 99)
    return _table(spark, sf_dir, "events").select("event_id", M.anonymize_ip(ip).alias("ip"))


@_query("comment_type_gate", "SELECT conv_id, turn, CASE role WHEN 'user' THEN 'comment' ELSE 'other' END AS grp FROM conversations")
def comment_type_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("role") == "user", "").otherwise(F.col("role"))
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", ingest.comment_group(kind).alias("grp"))


@_query("edit_diff_mask", f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN {_masked_sql("text || ' call (555) 123-4567'")} ELSE text END AS content FROM documents")
def edit_diff_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text was edited since it was stored are masked, the others stay."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    edits = docs.withColumn("content", F.when(F.col("doc_id") % 3 == 0, F.concat("content", F.lit(" call (555) 123-4567"))).otherwise(F.col("content")))
    return ingest.mask_edits(edits, docs, "doc_id", ingest.TableSpec("edits", ("content",)))


@_query(
    "mask_comments_conversations",
    f"""SELECT conv_id, turn, {_masked_sql("text")} AS content, role AS author, '' AS author_url, 'review' AS type,
        '10.1.' || CAST(conv_id % 250 AS VARCHAR) || '.0' AS author_ip FROM conversations""",
)
def mask_comments_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    made = rows.select("conv_id", "turn", F.col("text").alias("content"), F.col("role").alias("author"), F.lit("").alias("author_url"), F.lit("review").alias("type"), F.concat_ws(".", F.lit("10.1"), F.col("conv_id") % 250, F.col("turn") % 250).alias("author_ip"))
    return ingest.mask_comments(made, anonymize=True)


@_query("markup_safe_mask", f"SELECT page_id, {_masked_sql('html')} AS html, true AS same_tags FROM pages")
def markup_safe_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked pages, with their tags before and after."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "html", F.col("html").alias("given"))
    out = mask_text(pages, "html")
    return out.select("page_id", "html", (markup.signature(F.col("html")) == markup.signature(F.col("given"))).alias("same_tags"))


@_query("mask_text_documents", f"SELECT doc_id, {_masked_sql('text')} AS text FROM documents")
def mask_text_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask_text(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text")


# Images and streams.


def _packet(text: Column) -> Column:
    """JPEG bytes with an XMP packet that holds a place and an author."""
    mark = F.concat(F.encode(F.lit("http://ns.adobe.com/xap/1.0/"), "utf-8"), F.unhex(F.lit("00")))
    packet = F.encode(F.concat(F.lit('<x:xmpmeta exif:GPSLatitude="'), text, F.lit('"><dc:creator>'), text, F.lit("</dc:creator></x:xmpmeta>")), "utf-8")
    size = F.lpad(F.hex(F.length(packet) + 31), 4, "0")
    return F.concat(F.unhex(F.lit("FFD8FFE1")), F.unhex(size), mark, packet, F.unhex(F.lit("FFDA0002FFD9")))


@_query("image_scrub", "SELECT c_custkey, 'scrubbed' AS status, 'jpeg' AS format, true AS location, true AS identity, true AS same_length, false AS name_left FROM customer")
def image_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "customer").select("c_custkey", "c_name", _packet(F.col("c_name")).alias("content")).withColumn("n", F.length("content"))
    out = images.scrub(df)
    left = F.contains(F.decode("content", "ISO-8859-1"), F.col("c_name"))
    return out.select("c_custkey", "result.status", images.detect_format(F.col("content")).alias("format"), "result.location", "result.identity", (F.length("content") == F.col("n")).alias("same_length"), left.alias("name_left"))


@_query("image_rollup", "SELECT c_nationkey, 'scrubbed' AS status FROM customer GROUP BY c_nationkey")
def image_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "customer").select("c_nationkey", _packet(F.col("c_name")).alias("content"))
    return images.status_of(images.scrub(df), "c_nationkey")


@_query("stream_mask", "SELECT conv_id, turn, text || ' call ***-***-' || lpad(CAST(conv_id % 10000 AS VARCHAR), 4, '0') AS text FROM conversations")
def stream_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as a stream of files, masked and written, then read again."""
    run = work_folder(spark, "stream")
    source = _table(spark, sf_dir, "conversations")
    rows = spark.readStream.schema(source.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/conversations.parquet*")
    rows = rows.withColumn("text", F.concat("text", F.lit(" call (555) 123-"), F.lpad((F.col("conv_id") % 10_000).cast("string"), 4, "0")))
    masked = streams.mask_stream(rows, ingest.TableSpec("turns", ("text",)))
    streams.write_masked(masked.select("conv_id", "turn", "text"), f"{run}/out", f"{run}/state", once=True).awaitTermination()
    return spark.read.schema(source.select("conv_id", "turn", "text").schema).parquet(f"{run}/out")


from . import more_queries  # noqa: E402, F401  adds its queries
