"""Markup, custom patterns, rules that give up, audit, SQL, nested records, hooks, writing back, pages and integrations."""

from __future__ import annotations

import os
from dataclasses import replace

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from maskwright import bounded, config, dialect, queries, rules
from maskwright.frames import free_prefix
from maskwright.functions.sql import register_mask_text
from maskwright.functions.text import split_at
from maskwright.operators import fields, markup
from maskwright.operators.masking import mask_plain, mask_text, mask_texts
from maskwright.plans import audit, scan
from maskwright.sources import ingest

#: E-mail addresses, IP addresses and telephone numbers only: expressions of all rules take long to build.
FEW = config.Settings({r.type: r.type in ("email", "ip", "phone") for r in rules.BUILT_IN})
LONG = 1_000_000
OPEN_TAG = "mail a@b.com, if x <y then " + "some words " * (LONG // 11)
ANGLES = "<y " * (LONG // 3) + "a@b.com"
QUOTES = '<a title="' + "x 'y' " * (LONG // 6) + " mail a@b.com"

# (html, masked); the last of each makes masking change tags, so that pieces are masked one by one
CASES = [
    ('<p title = "u@v.org" lang=q@w.org alt=\'r@s.org\'><i a@b.co></p>', '<p title="u***@v.org" lang="q***@w.org" alt="r***@s.org"><i a@b.co></p>'),
    ("<i a@b.co> 1 < 2 & x@y.org > 3", "<i a@b.co> 1 &lt; 2 &amp; x***@y.org &gt; 3"),
    ('<i a@b.co><u title="&#106;oe&commat;x.org &lt;b&gt;">', '<i a@b.co><u title="j***@x.org &lt;b&gt;">'),
    ('<i a@b.co><u title="a &amp; b">x@y.org</u>', '<i a@b.co><u title="a &amp; b">x***@y.org</u>'),
    ("<i a@b.co><!-- c@d.org --><![CDATA[c@d.org]]>", "<i a@b.co><!-- c@d.org --><![CDATA[c@d.org]]>"),
    ("<i a@b.co><a href='http://u:pw@h/p q'>", '<i a@b.co><a href="http://u:***@h/p%20q">'),
    ("<i a@b.co>x@y.org <b", "<i a@b.co>x***@y.org &lt;b"),
    ("<i a@b.co/></i x=c@d.org>", "<i a@b.co/></i x=c@d.org>"),
    ("plain x@y.org <b>c@d.org</b>", "plain x***@y.org <b>c***@d.org</b>"),
]


@pytest.fixture(scope="module")
def markup_rows(spark):
    texts = [c[0] for c in CASES] + [OPEN_TAG, ANGLES, QUOTES, None, "", "0"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    df = df.withColumns({"__text": F.lit(1), "__given": F.lit(2), "__mw_text": F.lit(3), "given": F.col("text")})
    return texts, mask_text(df, "text", skipped="gave_up").orderBy("id").collect()


@pytest.mark.parametrize("k", range(len(CASES)))
def test_markup_is_masked_piece_by_piece(markup_rows, k):
    assert markup_rows[1][k].text == CASES[k][1]


def test_a_million_characters_after_an_open_tag(markup_rows):
    texts, rows = markup_rows
    for k, kept in ((len(CASES), "some words"), (len(CASES) + 1, "<y"), (len(CASES) + 2, "x 'y'")):
        assert "a@b.com" not in rows[k].text and kept in rows[k].text and len(rows[k].text) > LONG // 2
    assert [r.text for r in rows[-3:]] == [None, "", "0"]
    assert all(not r.gave_up for r in rows)


def test_columns_keep_their_names(markup_rows):
    assert all((r["__text"], r["__given"], r["__mw_text"]) == (1, 2, 3) for r in markup_rows[1])
    assert list(markup_rows[1][0].asDict()) == ["id", "text", "__text", "__given", "__mw_text", "given", "gave_up"]


def test_long_texts_in_every_masking_function(spark):
    df = spark.createDataFrame([(1, OPEN_TAG, "post", "publish", "text")], "id long, content string, type string, status string, basetype string")
    outs = [
        ingest.mask_table(df, "activity", FEW).first().content,
        ingest.mask_edits(df, df.withColumn("content", F.lit("old")), "id", "activity", FEW).first().content,
        mask_texts(df.withColumn("values", F.array("content")), "values", FEW).first()["values"][0],
        scan.examine(df, ["content"], FEW).first().content_masked,
    ]
    assert all("a@b.com" not in x and x.endswith("some words ") for x in outs)


def test_signatures(spark):
    html = ["<p A=1 b='x>y' c>t</P><br/><br>", '<script>if (a<b) "</p>"</script ><i>', "<b", "a < b <3 </> <?x <i> ?>", '<a b="c>', "<title>x<b></title><u/>", "<!-- <b> --><!doctype x><p a a B=2>"]
    got = [r.s for r in spark.createDataFrame(list(enumerate(html)), "i int, t string").orderBy("i").select(markup.signature(F.col("t")).alias("s")).collect()]
    assert got == ["P[a,b,c] /P[]", "SCRIPT[] I[]", "#incomplete", "", "#incomplete", "TITLE[] U[]", "P[a,b]"]


def test_references(spark):
    rows = {"&#64;&#x40;&commat;": "@@@", "a&b": "a&b", "&amp;lt;": "&lt;", "&#0;&#xD800;": "��", "&#128512;": "😀", "&unknown;": "&unknown;"}
    got = spark.createDataFrame([(x,) for x in rows], "t string").select("t", markup.decoded(F.col("t")).alias("d")).collect()
    assert {r.t: r.d for r in got} == rows


@pytest.mark.parametrize(
    ("pattern", "text", "masked"),
    [
        (r"\p{L}{3}", "12 abc", "12 ***"),
        (r"(?P<n>abc)", "xabc", "x***"),
        (r"(?P<a_b>.)(?P=a_b)", "hello", "he***o"),
        (r"(?'q'\d)\k{q}", "122", "1***"),
        (r"(a|b)\g1", "abb", "a***"),
        (r"(x)(y)\g{-1}", "xyy", "***"),
        (r"[[:alpha:]_]+\d", "é_9!", "***!"),
        (r"[]a[]+", "b[a]b", "b***b"),
        (r"\Qa.b\E", "a.b axb", "*** axb"),
    ],
)
def test_custom_patterns_run_as_written(spark, pattern, text, masked):
    custom = config.CustomPattern("c", pattern)
    assert custom.valid
    df = spark.createDataFrame([(text,)], "t string")
    assert mask_plain(df, "t", config.Settings(custom_patterns=(custom,)), rules=[]).first().t == masked


@pytest.mark.parametrize("pattern", ["(", "(?R)", r"a\Kb", "(?|a|b)", "[[:none:]]", r"(?P<n>a)(?P<n>b)", "x" * 501, "", "(?(1)a|b)"])
def test_custom_patterns_that_are_refused(spark, pattern):
    settings = config.Settings(custom_patterns=(config.CustomPattern("c", pattern),))
    assert not settings.customs
    assert mask_plain(spark.createDataFrame([("a(b",)], "t string"), "t", settings, rules=[]).first().t == "a(b"


def test_bounds(spark):
    assert bounded.bounded(r"(?:ab)+[(|)]*x{3,}") == (r"(?:ab)+[(|)]*x{3,}", ())
    assert bounded.bounded(r"(?:a|b)*c")[0] == r"(?:a|b){0,150}c"
    assert bounded.bounded(r"(?i)(?:a+x)*+") == (r"(?i)(?:a+x)*+", ())
    assert all(not r.overruns for r in rules.BUILT_IN)
    assert dialect.overruns(r"(?:\w|-)+!")


def test_a_rule_that_gives_up_leaves_the_text_to_the_others(spark):
    rule = rules.Rule("runaway", "member", r"#(?:[a-z]|[0-9])+;", "***")
    custom = config.CustomPattern("own", r"%(?:[a-z]|[0-9])+;")
    long = "#" + "a1" * 3_000 + "; a@b.com %" + "b2" * 3_000 + ";"
    df = spark.createDataFrame([(1, long), (2, "#ab; a@b.com %cd;"), (3, None)], "id int, text string")
    rules.register_rule(rule)
    try:
        settings = replace(FEW.with_masks(member=True), custom_patterns=(custom,))
        for masked in (mask_plain(df, "text", settings, skipped="gave_up"), mask_text(df, "text", settings, skipped="gave_up")):
            out = {r.id: r for r in masked.collect()}
            assert out[1].text == long.replace("a@b.com", "a***@b.com") and out[1].gave_up == ["runaway", "custom:own"]
            assert out[2].text == "*** a***@b.com ***" and out[2].gave_up == [] and out[3].text is None
    finally:
        rules.unregister_rule("runaway")


def test_free_names(spark):
    df = spark.range(1).select(F.lit(1).alias("__MW_x"), F.lit(2).alias("a"))
    assert free_prefix(df) == "___mw_" and free_prefix(df.select("a")) == "__mw_"


def test_audit_and_observation(spark, tmp_path):
    rows = [(1, "a@b.co and c@d.org", None), (2, "I consent to unmasking x@y.org", "10.0.0.7"), (3, None, ""), (1, "call (555) 123-4567", "see https://a.b/c")]
    df = spark.createDataFrame(rows, "id int, t string, u string")
    got = {(r.id, r.field, r.type, r.n, r.action) for r in audit.audit(df, "id", ["t", "u"], config.Settings().with_masks(ip=False)).collect()}
    assert got == {(1, "t", "email", 2, "masked"), (2, "t", "email", 1, "consent_bypass"), (2, "u", "ip", 1, "off"), (1, "t", "phone", 1, "masked"), (1, "u", "url", 1, "url")}
    seen = Observation("masking")
    out = audit.mask_observed(df, ["t", "u"], seen, FEW)
    assert out.columns == df.columns and len(out.collect()) == 4
    metrics = seen.get
    assert (metrics["rows"], metrics["changed"], metrics["consent_bypassed"], metrics["found_email"], metrics["found_ip"], metrics["found_card"]) == (4, 3, 1, 3, 1, 0)
    df.write.parquet(f"{tmp_path}/in")
    stream = audit.mask_observed(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), ["t", "u"], "audit", FEW)
    query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    told = [p.observedMetrics["audit"] for p in query.recentProgress if "audit" in p.observedMetrics]
    assert sum(m.rows for m in told) == 4 and sum(m.found_email for m in told) == 3


def test_sql_function(spark):
    texts = ["mail a@b.co", None, "", "0", "お名前：山田 太郎 電話：０９０－１２３４－５６７８", "ORD-77 and card 4111 1111 1111 1111", "I consent to unmasking a@b.co"]
    spark.createDataFrame(list(enumerate(texts)), "id int, text string").createOrReplaceTempView("sql_texts")
    settings = config.Settings(custom_patterns=(config.CustomPattern("Order", r"ORD-\d+"),))
    register_mask_text(spark, settings, "mask_for_test", consent=True, html=False)
    got = {r.id: r.m for r in spark.sql("SELECT id, mask_for_test(text) AS m FROM sql_texts").collect()}
    want = {r.id: r.text for r in mask_text(spark.table("sql_texts"), "text", settings, consent=True, html=False).collect()}
    assert got == want and got[0] == "mail a***@b.co" and got[5].startswith("*** and card ****")
    assert [r.id for r in spark.sql("SELECT id FROM sql_texts WHERE mask_for_test(text) <> text ORDER BY id").collect()] == [0, 4, 5]


def test_records_of_any_shape(spark):
    ddl = "user struct<email:string,deep:array<struct<q:map<string,string>>>>, _x struct<email:string>, list array<array<string>>, n int, none struct<email:string>"
    value = ({"email": "a@b.co", "deep": [{"q": {"k": "c@d.org", "action": "e@f.org", "password": "p"}}, None]}, {"email": "a@b.co"}, [["g@h.org", None, "plain"], None], 5, None)
    out = fields.mask_records(spark.createDataFrame([(value,)], f"r struct<{ddl}>"), "r").first().r.asDict(True)
    assert out == {"user": {"email": "a***@b.co", "deep": [{"q": {"k": "c***@d.org", "action": "e@f.org", "password": "[REDACTED]"}}, None]}, "_x": {"email": "a@b.co"}, "list": [["g***@h.org", None, "plain"], None], "n": 5, "none": None}
    variant = spark.createDataFrame([('{"user":{"email":"a@b.co","n":1},"tags":["c@d.org"]}',), ('{"other":"e@f.org"}',), (None,)], "j string").select(F.parse_json("j").alias("v"))
    rows = [r.v and r.v.asDict(True) for r in fields.mask_records(variant, "v").collect()]
    assert rows[0]["user"] == {"email": "a***@b.co", "n": 1} and rows[0]["tags"] == ["c***@d.org"] and rows[1]["other"] == "e***@f.org" and rows[2] is None


def test_apply_touches_only_partitions_that_change(spark, tmp_path):
    rows = [(1, "a@b.co", "x"), (1, "other", "x"), (2, None, "x"), (3, "clean", "y"), (None, "c@d.org", "z"), (None, "c@d.org", "z"), (5, "I consent to unmasking c@d.org", "z"), (6, "10.0.0.7", None)]
    spark.createDataFrame(rows, "id int, text string, part string").repartition(1).write.partitionBy("part").parquet(f"{tmp_path}/t")
    files = lambda p: {(f, os.stat(f"{tmp_path}/t/{p}/{f}").st_mtime_ns) for f in os.listdir(f"{tmp_path}/t/{p}")}
    before = files("part=y")
    found = scan.apply_partitions(spark, f"{tmp_path}/t", "id", ["text"], "part", f"{tmp_path}/work", FEW)
    assert files("part=y") == before
    out = sorted(((r.id, r.text, r.part) for r in spark.read.parquet(f"{tmp_path}/t").collect()), key=str)
    masked = {"a@b.co": "a***@b.co", "c@d.org": "c***@d.org", "10.0.0.7": "10.***.***.7"}
    assert out == sorted(((i, masked.get(t, t), p) for i, t, p in rows), key=str)
    assert sorted(r.text for r in found.collect()) == ["10.***.***.7", "a***@b.co", "c***@d.org"]
    assert scan.apply_partitions(spark, f"{tmp_path}/t", "id", ["text"], "part", f"{tmp_path}/again", FEW).count() == 0


def test_pages_by_key_together_are_the_report(spark):
    rows = [(3 * i, f"u{i}@v.org text" if i % 2 else f"clean {i}") for i in range(25)]
    df = spark.createDataFrame(rows, "id long, text string")
    seen, after, offset, sizes = [], None, 0, []
    for _ in range(4):
        page = scan.page_by_key(df, "posts", "id", ["text"], after, offset, limit=10, settings=FEW).first()
        seen += [(x.id, x.label) for x in page["items"]]
        sizes.append(page.processed)
        if page.next_after is None:
            break
        after, offset = page.next_after, page.next_offset
    assert sizes == [10, 10, 5] and offset == 20
    assert seen == [(3 * i, "u***@v.org text") for i in range(1, 25, 2)]
    with pytest.raises(ValueError, match="limit"):
        scan.page_by_key(df, "posts", "id", ["text"], limit=101)


def test_integrations(spark):
    df = spark.createDataFrame([(1, "a@b.co")], "id int, content string")
    tables = {"activity": df, "messages": df, "topics": df}
    on = {"enable_masking": 1, "integration_buddypress": 1, "integration_bbpress": 1}
    assert [i.name for i in ingest.active_integrations(tables, on)] == ["buddypress"]
    assert ingest.active_integrations(tables, on | {"enable_masking": 0}) == []
    own = ingest.Integration("own", ("topics",), available=lambda t: len(t) == 3)
    out = ingest.mask_tables(tables, on | {"integration_own": 1, "integration_buddypress": 0}, (*ingest.INTEGRATIONS, own))
    assert out["topics"].first().content == "a***@b.co" and out["activity"] is df


def test_edits_against_a_table_with_a_repeated_key(spark):
    edits = spark.createDataFrame([(1, "a@b.co")], "id int, content string")
    stored = spark.createDataFrame([(1, "x"), (1, "a@b.co")], "id int, content string")
    assert [r.content for r in ingest.mask_edits(edits, stored, "id", "activity", FEW).collect()] == ["a@b.co"]


def test_splits_at_patterns(spark):
    texts = ["", "a1b22c", "12", "1a", "a1", "none", "\uffff1a\uffff2", "é1漢", "a b  c"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for pattern in ("[0-9]+", "(?<= )(?=[^ ])|(?<=[^ ])(?= )"):
        for r in rows.select("t", F.split("t", pattern, -1).alias("slow"), split_at(F.col("t"), pattern).alias("fast")).collect():
            assert r.slow == r.fast


def test_rows_of_one_row_group_go_to_many_tasks(spark, tmp_path):
    keys = spark.range(5000).select(F.col("id").alias("c_custkey"), F.concat(F.lit("Customer#"), F.col("id")).alias("c_name"))
    keys.coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    tasks = queries.QUERIES["rules_address"](spark, str(tmp_path)).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(tasks) >= 16 and sum(r["count"] for r in tasks) == 15000
    assert max(r["count"] for r in tasks) < 1500
