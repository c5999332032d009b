from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from maskwright.config import Settings
from maskwright.plans import scan
from maskwright.sources import ingest
from maskwright.streaming import masked as streams

POSTS = [(1, "Hello", "mail a@b.co", "post", "publish"), (2, "Nothing", "here", "post", "draft"), (3, "T", "I consent to unmasking a@b.co", "post", "publish"), (4, "T", "see https://x.org/y", "post", "publish"), (5, "T", "a@b.co", "post", "trash"), (6, "T", "10.1.2.3", "page", "publish")]


@pytest.fixture(scope="module")
def posts(spark):
    return spark.createDataFrame(POSTS, "id long, title string, content string, type string, status string")


def test_report(posts):
    settings = Settings().with_masks(ip=False)
    rows = {r.id: r for r in scan.report(posts, "post", "id", ["title", "content"], settings=settings).collect()}
    assert set(rows) == {1, 3, 5, 6}
    assert [rows[i].status for i in (1, 3, 6)] == ["would-mask", "consent-skipped", "detected-only"]
    assert rows[3].types == "email" and rows[6].types == "ip"


def test_pages_targets_and_counts(posts):
    assert [r.id for r in scan.page(scan.scannable_posts(posts, "post"), "id", 1, 2).collect()] == [2, 3]
    assert scan.next_offset(0, 50, 50) == 50 and scan.next_offset(50, 50, 3) is None
    with pytest.raises(ValueError):
        scan.page(posts, "id", 0, 101)
    assert scan.targets("all", ["post"]) == ["comments", "images", "post"] and scan.targets(" post, images", ["post"]) == ["post", "images"]
    with pytest.raises(ValueError):
        scan.targets("nope", ["post"])
    assert {r.target: r.items for r in scan.count_items({"post": posts, "none": posts.limit(0)}).collect()} == {"post": 6, "none": 0}


def test_apply_writes_only_changes(posts, tmp_path):
    out = {r.id: r for r in scan.apply(posts, ["title", "content"], str(tmp_path / "out")).collect()}
    assert out[1].content == "mail a***@b.co" and out[3].content == POSTS[2][2] and out[2].title == "Nothing"


def test_preview_and_mask_result(spark):
    df = spark.createDataFrame([("a@b.co a@b.co",), ("x" * 10_001,)], "text string")
    seen = scan.preview_text(df.limit(1), "text").first().preview
    assert [(p.type, p.confidence, p.enabled, p.was_masked) for p in seen] == [("email", 0.95, True, True)]
    rows = scan.mask_result(df, "text").collect()
    assert len(rows) == 1 and rows[0].changed and rows[0].masked == "a***@b.co a***@b.co"


def test_mask_result_keeps_null_and_long_texts(spark):
    df = spark.createDataFrame([(1, "a@b.co"), (2, None), (3, "x" * 10_001), (4, "y" * 10_000)], "id int, text string")
    assert {r.id: r.masked for r in scan.mask_result(df, "text").collect()} == {1: "a***@b.co", 2: "", 4: "y" * 10_000}
    rows = {r.id: r for r in scan.mask_result(df, "text", keep_long=True).collect()}
    assert set(rows) == {1, 2, 3, 4} and not rows[2].changed and rows[2].detected_types == []
    assert rows[3].error == "Text is limited to 10000 characters." and rows[3].masked is None and len(rows[3].text) == 10_001
    assert [rows[i].error for i in (1, 2, 4)] == [None] * 3


def test_report_sinks(posts, tmp_path, spark):
    rows = scan.report(posts, "post", "id", ["content"]).cache()
    assert scan.write_report(rows, "", "count") == rows.count()
    for form, read in (("csv", lambda p: spark.read.csv(p, header=True)), ("json", spark.read.json)):
        scan.write_report(rows, str(tmp_path / form), form)
        assert read(str(tmp_path / form)).count() == rows.count()


def test_comments_edits_and_forms(spark):
    comments = spark.createDataFrame([(1, "a@b.co", "Al", "", "", "10.1.2.3"), (2, "a@b.co", "Al", "", "note", "10.1.2.3"), (3, "a@b.co", "Al", "", "pingback", "x")], "id int, content string, author string, author_url string, type string, author_ip string")
    out = {r.id: r for r in ingest.mask_comments(comments, anonymize=True).collect()}
    assert [out[i].content for i in (1, 2, 3)] == ["a***@b.co", "a@b.co", "a***@b.co"] and out[1].author_ip == "10.1.2.0"
    stored = comments.select("id", "content")
    edits = spark.createDataFrame([(1, "a@b.co"), (2, "new a@b.co"), (9, "c@d.co")], "id int, content string")
    assert {r.id: r.content for r in ingest.mask_edits(edits, stored, "id", ingest.TableSpec("c", ("content",))).collect()} == {1: "a@b.co", 2: "new a***@b.co", 9: "c***@d.co"}
    form = spark.createDataFrame([(1, "msg", ["a@b.co", "x"]), (1, "_msg", ["a@b.co"]), (1, "name", ["a@b.co"])], "form_id int, name string, values array<string>")
    types = spark.createDataFrame([(1, "msg", "textarea"), (1, "_msg", "textarea"), (1, "name", "text")], "form_id int, name string, basetype string")
    got = {r.name: r["values"] for r in ingest.mask_form(form, types).collect()}
    assert got == {"msg": ["a***@b.co", "x"], "_msg": ["a@b.co"], "name": ["a@b.co"]}


def test_stream_equals_batch(spark, posts, tmp_path):
    src = str(tmp_path / "in")
    posts.write.parquet(src)
    spec = ingest.TableSpec("posts", ("title", "content"))
    rows = streams.read_stream(spark, src, posts.schema)
    streams.write_masked(streams.mask_stream(rows, spec), str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination()
    batch = ingest.mask_table(posts, spec)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.exceptAll(batch).count() == 0 and batch.exceptAll(out).count() == 0
    streams.report_stream(streams.read_stream(spark, src, posts.schema), "post", "id", ["content"], str(tmp_path / "rep"), str(tmp_path / "cp2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "rep")).select(F.countDistinct("id")).first()[0] == 4


def test_forms_keep_repeated_rows_nulls_and_other_columns(spark):
    rows = [(1, "msg", ["a@b.co"], 7), (1, "msg", ["c@d.co", None, "", "0"], 8), (1, "msg", None, 9), (1, None, ["a@b.co"], 1), (1, "msg", ['<a href="x">a@b.co</a>', "a@b.co I consent to unmasking"], 2), (2, "msg", ["a@b.co"], 3)]
    form = spark.createDataFrame(rows, "form_id int, name string, values array<string>, seen int")
    types = spark.createDataFrame([(1, "msg", "textarea"), (1, "msg", "textarea"), (1, None, "textarea")], "form_id int, name string, basetype string")
    got = sorted((r.seen, r["values"]) for r in ingest.mask_form(form, types).collect())
    assert got == [(1, ["a@b.co"]), (2, ['<a href="x">a***@b.co</a>', "a@b.co I consent to unmasking"]), (3, ["a@b.co"]), (7, ["a***@b.co"]), (8, ["c***@d.co", None, "", "0"]), (9, None)]
    assert ingest.mask_form(form.limit(0), types, after=lambda x: x).count() == 0
    first = ingest.mask_form(form, types, before=lambda x: F.slice(x, 1, 1), after=lambda x: F.transform(x, lambda y: F.concat(y, F.lit("!")))).filter("seen = 8")
    assert first.collect()[0]["values"] == ["c***@d.co!"]
