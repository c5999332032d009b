"""More queries over the given tables: markup, records, hooks, audit, SQL, writing back, pages and integrations."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import queries as Q
from .config import CustomPattern, Settings
from .functions import maskers as M
from .functions.sql import register_mask_text
from .operators import fields, images
from .operators.masking import mask_plain, mask_text
from .plans import audit, scan
from .queries import _masked_sql, _query, _table
from .sources import ingest
from .streaming import masked as streams

_K = "CAST(c_custkey AS VARCHAR)"


def _made(*parts) -> F.Column:
    """Text of literals and column names (in braces)."""
    return F.concat(*[F.col(p[1:-1]).cast("string") if re.fullmatch(r"\{\w+\}", p) else F.lit(p) for p in parts])


@_query("mask_plain_documents", Q.ORACLES["mask_text_documents"])
def mask_plain_documents(spark: SparkSession, sf_dir: str):
    """The rules alone, without a look at markup."""
    return mask_plain(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text")


@_query(
    "markup_segments",
    f"""SELECT c_custkey, '<p title="u***@v.org" lang="q***@w.org" alt="n***@v.org"><i a' || {_K} || '@b.co> 1 &lt; 2 x***@y.org &gt; 3 ' || {_K}
    || '</p><!-- c' || {_K} || '@c.org --><a href="http://u:***@h/p&#038;q">z***@q.org</a>&lt;b' AS html FROM customer""",
)
def markup_segments(spark: SparkSession, sf_dir: str):
    """Texts whose tags masking would change: attributes in all quotings, references, a stray <, a comment, a tag that is cut off."""
    k = "{c_custkey}"
    html = _made('<p title = "u', k, '@v.org" lang=q', k, '@w.org alt=\'n', k, "&#64;v.org'><i a", k, "@b.co> 1 < 2 x", k, "@y.org > 3 ", k, "</p><!-- c", k, '@c.org --><a href="http://u:pw', k, '@h/p&amp;q">z', k, "@q.org</a><b")
    return mask_text(_table(spark, sf_dir, "customer").select("c_custkey", html.alias("html")), "html")


@_query("sql_mask_documents", Q.ORACLES["mask_text_documents"])
def sql_mask_documents(spark: SparkSession, sf_dir: str):
    """The mask as a function of the catalog; no document has markup."""
    register_mask_text(spark, name="maskwright_mask", html=False)
    _table(spark, sf_dir, "documents").createOrReplaceTempView("maskwright_documents")
    return spark.sql("SELECT doc_id, maskwright_mask(text) AS text FROM maskwright_documents")


@_query(
    "audit_documents",
    f"""SELECT type, CASE WHEN type = 'url' THEN 'url' WHEN consent THEN 'consent_bypass' ELSE 'masked' END AS action, count(*) AS n, count(DISTINCT doc_id) AS docs
    FROM (SELECT doc_id, consent, unnest(found).type AS type FROM (SELECT doc_id, {Q._CONSENT_SQL.format("text")} AS consent, {Q._detections_sql("text")} AS found FROM documents)) GROUP BY ALL""",
)
def audit_documents(spark: SparkSession, sf_dir: str):
    rows = audit.audit(_table(spark, sf_dir, "documents"), "doc_id", ["text"])
    return rows.groupBy("type", "action").agg(F.sum("n").alias("n"), F.count_distinct("id").alias("docs"))


_RECORD = "user struct<email:string,action:struct<email:string>,age:int>, items array<struct<q:string,n:int>>, tags array<string>, extra map<string,string>"


@_query(
    "nested_records",
    """SELECT conv_id, turn, 'u***@v.org' AS user_email, 'u' || CAST(conv_id AS VARCHAR) || '@v.org' AS action_email, CAST(turn AS INT) AS age, 'w***@x.org' AS first, 'turn ' || CAST(turn AS VARCHAR) AS second,
    't***@x.org' AS tag, '[REDACTED]' AS password, 's' || CAST(conv_id AS VARCHAR) AS token FROM conversations""",
)
def nested_records(spark: SparkSession, sf_dir: str):
    """JSON of structs, arrays and maps in each other, masked by its schema."""
    c, t = "{conv_id}", "{turn}"
    text = _made('{"user":{"email":"u', c, '@v.org","action":{"email":"u', c, '@v.org"},"age":', t, '},"items":[{"q":"w', c, '@x.org","n":1},{"q":"turn ', t, '"}],"tags":["t', c, '@x.org"],"extra":{"password":"p', c, '","_token":"s', c, '"}}')
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.from_json(text, StructType.fromDDL(_RECORD)).alias("r"))
    out = fields.mask_records(rows, "r")
    return out.select("conv_id", "turn", F.col("r.user.email").alias("user_email"), F.col("r.user.action.email").alias("action_email"), F.col("r.user.age").alias("age"), F.col("r.items")[0]["q"].alias("first"), F.col("r.items")[1]["q"].alias("second"), F.col("r.tags")[0].alias("tag"), F.col("r.extra")["password"].alias("password"), F.col("r.extra")["_token"].alias("token"))


@_query(
    "record_hooks",
    """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'u***@v.org' END AS email, CASE WHEN c_custkey % 2 = 0 THEN 'b***@c.org' END AS added,
    CASE WHEN c_custkey % 2 = 0 THEN '3' END AS n, CASE WHEN c_custkey % 2 = 1 THEN 'own' END AS other FROM customer""",
)
def record_hooks(spark: SparkSession, sf_dir: str):
    """Hooks on whole records: before, instead of and after masking."""
    around = fields.RecordHooks(
        before=lambda r: F.map_concat(r, F.create_map(F.lit("q2"), F.lit("b1@c.org"))),
        override=lambda r: F.when(r["_odd"] == "1", F.create_map(F.lit("other"), F.lit("own"))),
        after=lambda masked, given: F.map_concat(masked, F.create_map(F.lit("n"), F.size(given).cast("string"))),
    )
    record = F.create_map(F.lit("email"), _made("u", "{c_custkey}", "@v.org"), F.lit("_odd"), (F.col("c_custkey") % 2).cast("string"))
    out = _table(spark, sf_dir, "customer").select("c_custkey", fields.mask_record(record, around=around).alias("r"))
    return out.select("c_custkey", F.try_element_at("r", F.lit("email")).alias("email"), F.try_element_at("r", F.lit("q2")).alias("added"), F.try_element_at("r", F.lit("n")).alias("n"), F.try_element_at("r", F.lit("other")).alias("other"))


@_query(
    "detection_hooks",
    """SELECT c_custkey, 'email' AS before_detect, CASE WHEN c_custkey % 2 = 0 THEN 'dob' ELSE 'email' END AS detect,
    CASE WHEN c_custkey % 2 = 0 THEN 'token' ELSE 'email' END AS by_name, CASE WHEN c_custkey % 2 = 1 THEN 'email' END AS by_value, CASE WHEN c_custkey % 2 = 0 THEN 'dob' ELSE 'token' END AS stopped FROM customer""",
)
def detection_hooks(spark: SparkSession, sf_dir: str):
    """A field's type with each hook of detection, and with two: what one gives ends the asking."""
    mail, even = _made("u", "{c_custkey}", "@v.org"), F.col("c_custkey") % 2 == 0
    kind = lambda name, value, **hooks: fields.type_of_field(F.lit(name), value, fields.FieldHooks(**hooks))
    dob = lambda n, v: F.when(even, "dob")
    return _table(spark, sf_dir, "customer").select(
        "c_custkey",
        kind("q1", F.concat(F.lit("mailto "), mail), before_detect=lambda n, v: F.regexp_replace(v, "^mailto ", "")).alias("before_detect"),
        kind("q1", mail, detect=dob).alias("detect"),
        kind("email", mail, by_name=lambda t, n, v: F.when(even, "token").otherwise(t)).alias("by_name"),
        kind("q1", mail, by_value=lambda t, n, v: F.when(~even, t)).alias("by_value"),
        kind("email", mail, detect=dob, by_name=lambda t, n, v: F.lit("token")).alias("stopped"),
    )


@_query("apply_partitions", f"SELECT doc_id, source, CASE WHEN {Q._CONSENT_SQL.format('text')} THEN text ELSE {_masked_sql('text')} END AS text FROM documents")
def apply_partitions(spark: SparkSession, sf_dir: str):
    """Documents in a table by source, masked in place, read again."""
    base = Q.work_folder(spark, "apply")
    _table(spark, sf_dir, "documents").select("doc_id", "text", "source").write.partitionBy("source").parquet(f"{base}/table")
    scan.apply_partitions(spark, f"{base}/table", "doc_id", ["text"], "source", base)
    return spark.read.parquet(f"{base}/table").select("doc_id", "source", "text")


_EXCERPT = r"(CASE WHEN length(p) > 40 THEN left(p, 40) || '…' ELSE p END)"


@_query(
    "scan_page_by_key",
    f"""WITH p AS (SELECT doc_id, text, trim(regexp_replace(regexp_replace(text, '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')) AS p FROM documents WHERE doc_id > 40 ORDER BY doc_id LIMIT 100),
    r AS (SELECT doc_id, {_masked_sql(_EXCERPT)} AS label, list_distinct([d.type for d in {Q._detections_sql("text")} if d.type <> 'url']) AS types,
            NOT {Q._CONSENT_SQL.format("text")} AND {_masked_sql("text")} <> text AS would_change, {Q._CONSENT_SQL.format("text")} AS consent_bypassed FROM p)
    SELECT doc_id, label, array_to_string(list_sort(types), ',') AS types, would_change, consent_bypassed, 140 AS next_offset, (SELECT max(doc_id) FROM p) AS next_after, 100 AS processed
    FROM r WHERE len(types) > 0 OR would_change""",
)
def scan_page_by_key(spark: SparkSession, sf_dir: str):
    """The page of the scan of documents that follows id 40, with masked labels."""
    one = scan.page_by_key(_table(spark, sf_dir, "documents"), "documents", "doc_id", ["text"], after=40, offset=40, limit=100)
    rows = one.select("processed", "next_offset", "next_after", F.inline("items"))
    return rows.select(F.col("id").alias("doc_id"), "label", F.array_join(F.array_sort("detected_types"), ",").alias("types"), "would_change", "consent_bypassed", "next_offset", "next_after", "processed")


@_query(
    "integration_gate",
    """SELECT 'topics' AS name, CAST(c_custkey AS BIGINT) AS id, 'mail u***@v.org' AS content FROM customer UNION ALL SELECT 'replies', s_suppkey, 'mail u***@v.org' FROM supplier
    UNION ALL SELECT 'activity', n_nationkey, 'mail u' || CAST(n_nationkey AS VARCHAR) || '@v.org' FROM nation UNION ALL SELECT 'board_posts', r_regionkey, 'mail u' || CAST(r_regionkey AS VARCHAR) || '@v.org' FROM region""",
)
def integration_gate(spark: SparkSession, sf_dir: str):
    """Several tables: one integration on, one off, one on without all of its tables."""
    made = {"topics": ("customer", "c_custkey", "content"), "replies": ("supplier", "s_suppkey", "content"), "activity": ("nation", "n_nationkey", "content"), "messages": ("nation", "n_nationkey", "content"), "board_posts": ("region", "r_regionkey", "body")}
    tables = {name: _table(spark, sf_dir, t).select(F.col(key).cast("long").alias("id"), _made("mail u", f"{{{key}}}", "@v.org").alias(column)) for name, (t, key, column) in made.items()}
    settings = {"enable_masking": 1, "integration_bbpress": 1, "integration_buddypress": 0, "integration_wpforo": 1, "settings_version": 5}
    out = ingest.mask_tables(tables, settings)
    rows = [df.select(F.lit(name).alias("name"), "id", F.col(made[name][2]).alias("content")) for name, df in out.items() if name != "messages"]
    return scan.report_all(rows)


@_query("custom_pattern_dialect", r"SELECT c_custkey, regexp_replace(c_name, '[A-Za-z]{5}', '***', 'g') || ' [SAME] (?R)' AS text FROM customer")
def custom_pattern_dialect(spark: SparkSession, sf_dir: str):
    """Patterns in the dialect that they are written in: Unicode classes, named groups and their references, one that has no form here."""
    patterns = (CustomPattern("letters", r"\p{L}{5}"), CustomPattern("twice", r"(?P<a_b>[[:digit:]]+)=(?P=a_b)", "[SAME]"), CustomPattern("recursive", "(?R)", "never"))
    rows = _table(spark, sf_dir, "customer").select("c_custkey", _made("{c_name}", " ", "{c_custkey}", "=", "{c_custkey}", " (?R)").alias("text"))
    return mask_plain(rows, "text", Settings(custom_patterns=patterns), rules=[])


_KINDS = {
    "email": ("u", "{c_custkey}", "@v.org"),
    "ip": ("10.0.7.", "{b}"),
    "phone": ("(555) 123-", "{d}"),
    "card": ("4111-1111-1111-1111",),
    "ssn": ("123-45-", "{d}"),
    "url": ("https://h.org/", "{c_custkey}"),
    "hosting": ("xs00", "{d}"),
    "token": ("qwertzuiopasdfghjklyxcvbnm_QWERTZ_", "{d}"),
    "none": ("about ", "{c_custkey}"),
}
_NOT_ZERO = "CASE WHEN c_custkey % 9000 < 1000 THEN c_custkey % 9000 + 1000 ELSE c_custkey % 9000 END"


@_query("value_types", "SELECT c_custkey, kind, CASE WHEN kind <> 'none' THEN kind END AS found FROM customer, (SELECT unnest(['" + "', '".join(_KINDS) + "']) AS kind)")
def value_types(spark: SparkSession, sf_dir: str):
    """The type that a field's value alone gives, for values of every kind."""
    rows = _table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 250).alias("b"), F.expr(_NOT_ZERO).alias("d"))
    values = F.array(*[F.struct(F.lit(kind).alias("kind"), _made(*parts).alias("value")) for kind, parts in _KINDS.items()])
    return rows.select("c_custkey", F.inline(values)).select("c_custkey", "kind", fields.type_of_value(F.col("value")).alias("found"))


@_query(
    "preview_fields",
    """SELECT c_custkey, 'email' AS type, true AS enabled, true AS maskable, true AS was_masked, 1.0 AS confidence FROM customer WHERE c_custkey % 2 = 0
    UNION ALL SELECT c_custkey, NULL, false, false, false, 0.5 FROM customer WHERE c_custkey % 2 = 1""",
)
def preview_fields(spark: SparkSession, sf_dir: str):
    """What a field is taken for: an address under its name, and a plain text under no name."""
    name, value = F.when(F.col("c_custkey") % 2 == 0, "email").otherwise("q1"), F.when(F.col("c_custkey") % 2 == 0, _made("u", "{c_custkey}", "@v.org")).otherwise("plain text")
    seen = _table(spark, sf_dir, "customer").select("c_custkey", fields.preview(name, value).alias("p"))
    return seen.select("c_custkey", "p.type", "p.enabled", "p.maskable", "p.was_masked", "p.confidence")


@_query(
    "mask_result_documents",
    f"""SELECT doc_id, CASE WHEN NOT consent THEN masked ELSE text END AS masked, NOT consent AND masked <> text AS changed, types, consent AS consent_bypassed, CAST(NULL AS VARCHAR) AS error
    FROM (SELECT doc_id, text, {_masked_sql("text")} AS masked, {Q._CONSENT_SQL.format("text")} AS consent, array_to_string(list_sort(list_distinct([d.type for d in {Q._detections_sql("text")} if d.type <> 'url'])), ',') AS types
        FROM documents WHERE length(text) <= 10000)
    UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, 'Text is limited to 10000 characters.' FROM documents WHERE length(text) > 10000""",
)
def mask_result_documents(spark: SparkSession, sf_dir: str):
    """Each document as one call would return it; those that are too long are rows with an error."""
    out = scan.mask_result(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text", keep_long=True)
    return out.select("doc_id", "masked", "changed", F.array_join(F.array_sort("detected_types"), ",").alias("types"), "consent_bypassed", "error")


@_query("address_masks", f"SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '東京***' ELSE {_K} || ' *** ***' END AS address FROM customer")
def address_masks(spark: SparkSession, sf_dir: str):
    made = F.when(F.col("c_custkey") % 2 == 0, _made("東京都新宿区", "{c_custkey}", "番地")).otherwise(_made("{c_custkey}", " Main St"))
    return _table(spark, sf_dir, "customer").select("c_custkey", M.mask_address(made).alias("address"))


@_query(
    "scan_targets",
    f"""SELECT 'comments' AS target, CAST(conv_id * 100 + turn AS BIGINT) AS id, 'email' AS types, 'would-mask' AS status FROM conversations WHERE role = 'user'
    UNION ALL SELECT 'post', doc_id, types, CASE WHEN consent THEN 'consent-skipped' WHEN masked <> text THEN 'would-mask' ELSE 'detected-only' END
    FROM (SELECT doc_id, text, {_masked_sql("text")} AS masked, {Q._CONSENT_SQL.format("text")} AS consent, array_to_string(list_sort(list_distinct([d.type for d in {Q._detections_sql("text")} if d.type <> 'url'])), ',') AS types FROM documents WHERE doc_id % 3 > 0)
    WHERE types <> '' OR NOT consent AND masked <> text""",
)
def scan_targets(spark: SparkSession, sf_dir: str):
    """Comments and posts in one report; of posts those whose type and status are scanned."""
    talk = _table(spark, sf_dir, "conversations").filter("role = 'user'")
    comments = talk.select((F.col("conv_id") * 100 + F.col("turn")).cast("long").alias("id"), _made("u", "{conv_id}", "@v.org").alias("author"))
    status = F.when(F.col("doc_id") % 3 == 0, "trash").when(F.col("doc_id") % 3 == 1, "publish").otherwise("draft")
    posts = _table(spark, sf_dir, "documents").select("doc_id", "text", F.lit("post").alias("type"), status.alias("status"))
    reports = [scan.report(comments, "comments", "id", ["author"]), scan.report(scan.scannable_posts(posts, "post").select("doc_id", "text"), "post", "doc_id", ["text"])]
    return scan.report_all(reports).select("target", "id", F.array_join(F.array_sort("detected_types"), ",").alias("types"), "status")


@_query(
    "image_uploads",
    """SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN 'scrubbed' ELSE 'clean' END AS status, CASE WHEN c_custkey % 3 > 0 THEN 'jpeg' ELSE '' END AS format,
    c_custkey % 3 > 0 AS location, c_custkey % 3 = 0 AS name_left, CASE WHEN c_custkey % 3 > 0 THEN 'scrubbed' ELSE 'clean' END AS carried FROM customer""",
)
def image_uploads(spark: SparkSession, sf_dir: str):
    """Images as a stream, of which some are let through as they are; a second look at what is stored keeps the first one's status."""
    run = Q.work_folder(spark, "uploads")
    rows = _table(spark, sf_dir, "customer").select("c_custkey", "c_name", Q._packet(F.col("c_name")).alias("content"))
    rows.write.parquet(f"{run}/in")
    stream = streams.read_stream(spark, f"{run}/in", rows.schema)
    streams.scrub_stream(stream, f"{run}/out", f"{run}/state", allow=F.col("c_custkey") % 3 > 0).awaitTermination()
    stored = spark.read.parquet(f"{run}/out")
    again = images.scrub(stored.filter("c_custkey % 3 > 0").drop("result")).select("c_custkey", "result.status")
    again = again.unionByName(stored.filter("c_custkey % 3 = 0").select("c_custkey", "result.status"))
    carried = images.carried_status(again, streams.upload_statuses(spark, f"{run}/out", "c_custkey"), "c_custkey").select("c_custkey", F.col("status").alias("carried"))
    left = F.contains(F.decode("content", "ISO-8859-1"), F.col("c_name"))
    return stored.select("c_custkey", "result.status", "result.format", "result.location", left.alias("name_left")).join(carried, "c_custkey")
