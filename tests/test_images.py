from __future__ import annotations

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from maskwright.config import Settings
from maskwright.operators import images


def tiff(little=True):
    o = "<" if little else ">"
    artist = b"Jane Doe\0\0"
    at = 8 + 2 + 24 + 4
    gps = at + len(artist)
    main = struct.pack(o + "H", 2) + struct.pack(o + "HHII", 0x013B, 2, len(artist), at) + struct.pack(o + "HHII", 0x8825, 4, 1, gps) + struct.pack(o + "I", 0)
    place = struct.pack(o + "H", 1) + struct.pack(o + "HHII", 2, 5, 3, gps + 18) + struct.pack(o + "I", 0) + struct.pack(o + "6I", 35, 1, 40, 1, 7, 1)
    return (b"II*\0" if little else b"MM\0*") + struct.pack(o + "I", 8) + main + artist + place


XMP = b'<x:xmpmeta exif:GPSLatitude="35,40N" a="b"><dc:creator>Bob</dc:creator><photoshop:City/></x:xmpmeta>'


def jpeg(*blocks):
    return b"\xff\xd8" + b"".join(b"\xff\xe1" + struct.pack(">H", 2 + len(b)) + b for b in blocks) + b"\xff\xda\0\x02pixels\xff\xd9"


def chunk(kind, data):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def box(kind, data):
    return struct.pack(">I", 8 + len(data)) + kind + data


def heif():
    item = struct.pack(">I", 0) + tiff(False)
    infe = box(b"infe", b"\x02\0\0\0" + struct.pack(">HH", 1, 0) + b"Exif\0")
    iinf = box(b"iinf", b"\0\0\0\0" + struct.pack(">H", 1) + infe)

    def head(at):
        iloc = box(b"iloc", b"\0\0\0\0\x44\x00" + struct.pack(">H", 1) + struct.pack(">HHH", 1, 0, 1) + struct.pack(">II", at, len(item)))
        return box(b"ftyp", b"heic\0\0\0\0mif1") + box(b"meta", b"\0\0\0\0" + iinf + iloc)

    return head(len(head(0)) + 8) + box(b"mdat", item)


def webp():
    t = tiff()
    body = b"EXIF" + struct.pack("<I", len(t)) + t + b"XMP " + struct.pack("<I", len(XMP)) + XMP + b"\0" * (len(XMP) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WEBP" + body


FILES = {
    "jpeg": jpeg(b"Exif\0\0" + tiff(), images.XMP_MARK + XMP),
    "png": b"\x89PNG\r\n\x1a\n" + chunk(b"eXIf", tiff(False)) + chunk(b"iTXt", b"XML:com.adobe.xmp\0\0\0\0\0" + XMP) + chunk(b"IEND", b""),
    "webp": webp(),
    "heif": heif(),
}


@pytest.mark.parametrize("form", FILES)
def test_scrub(form):
    result, out = images.scrub_bytes(FILES[form])
    assert result == {"status": "scrubbed", "format": form, "location": True, "identity": True, "error": ""}
    assert len(out) == len(FILES[form]) and b"Jane" not in out and b"Bob" not in out and b"35,40N" not in out
    assert images.scrub_bytes(out)[0]["status"] == "clean"
    only = images.scrub_bytes(FILES[form], identity=False)
    assert b"Jane" in only[1]
    assert images.scrub_bytes(FILES[form], dry_run=True)[1] == FILES[form]


def test_png_checksums_are_right_again():
    _, out = images.scrub_bytes(FILES["png"])
    at = 8
    while at < len(out):
        n = struct.unpack_from(">I", out, at)[0]
        assert struct.unpack_from(">I", out, at + 8 + n)[0] == zlib.crc32(out[at + 4 : at + 8 + n])
        at += 12 + n


def test_unreadable_blocks_count_as_location():
    result, out = images.scrub_bytes(jpeg(b"Exif\0\0" + b"II*\0" + b"\xff" * 40))
    assert result["status"] == "scrubbed" and result["location"] and b"\xff" * 40 not in out


@pytest.mark.parametrize(("data", "status"), [(b"GIF89a", "unsupported"), (b"", "unsupported"), (FILES["jpeg"][:40], "failed"), (FILES["webp"][:-30], "failed"), (jpeg(), "clean"), (None, "failed")])
def test_other_files(data, status):
    assert images.scrub_bytes(data)[0]["status"] == status


def test_tables_of_images(spark, tmp_path):
    for name, data in FILES.items():
        (tmp_path / f"{name}.img").write_bytes(data)
    (tmp_path / "broken.img").write_bytes(FILES["jpeg"][:40])
    from maskwright.sources.ingest import image_files

    files = image_files(spark, str(tmp_path)).withColumn("id", F.when(F.col("path").contains("broken"), 2).otherwise(1))
    out = images.scrub(files, settings=Settings(strip_identity=False)).cache()
    assert {r.status for r in out.select("result.status").collect()} == {"scrubbed", "failed"}
    assert out.filter(images.detect_format(F.col("content")) != F.col("result.format")).count() == 0
    assert {r.id: r.status for r in images.status_of(out).collect()} == {1: "scrubbed", 2: "failed"}
    seen = {r.id: r for r in images.inspect(out, spark.createDataFrame([(2, "Me")], "id int, credit string")).collect()}
    assert seen[1].detected_types == ["image_location", "image_identity"] and seen[2].detected_types == ["image_identity", "unreadable"]
    att = spark.createDataFrame([(1, "a", "b", ["a", "c"]), (2, "d", None, None)], "id int, attached string, original string, sizes array<string>")
    assert sorted((r.id, r.path) for r in images.files_of(att).collect()) == [(1, "a"), (1, "b"), (1, "c"), (2, "d")]
    now = spark.createDataFrame([("p", "clean"), ("q", "clean")], "path string, status string")
    then = spark.createDataFrame([("p", "scrubbed")], "path string, status string")
    assert {r.path: r.status for r in images.carried_status(now, then).collect()} == {"p": "scrubbed", "q": "clean"}


def test_files_above_the_limit_have_failed(spark, tmp_path):
    from maskwright.sources.ingest import image_files

    (tmp_path / "large.img").write_bytes(FILES["jpeg"] + bytes(5000))
    (tmp_path / "small.img").write_bytes(FILES["jpeg"])
    files = image_files(spark, str(tmp_path), limit=len(FILES["jpeg"])).withColumn("id", F.lit(1))
    out = images.scrub(files).cache()
    got = {r.path.rsplit("/", 1)[1]: (r.result.status, r.result.error, r.content is None, r.length) for r in out.collect()}
    assert got["large.img"] == ("failed", "File is larger than the scrub size limit.", True, len(FILES["jpeg"]) + 5000)
    assert got["small.img"][:3] == ("scrubbed", "", False)
    assert [r.status for r in images.status_of(out).collect()] == ["failed"]
    assert "unreadable" in images.inspect(out).first().detected_types


def test_images_of_a_stream(spark, tmp_path):
    from maskwright.streaming import masked as streams

    (tmp_path / "in").mkdir()
    for name, data in FILES.items():
        (tmp_path / "in" / f"{name}.img").write_bytes(data)
    (tmp_path / "in" / "large.img").write_bytes(FILES["jpeg"] + bytes(50_000))
    (tmp_path / "in" / "kept.img").write_bytes(FILES["jpeg"])

    def run():
        rows = streams.image_stream(spark, str(tmp_path / "in"), limit=50_000)
        allow = ~F.col("path").contains("kept")
        streams.scrub_stream(rows, str(tmp_path / "out"), str(tmp_path / "state"), allow=allow).awaitTermination()
        return {r.path.rsplit("/", 1)[1]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    got = run()
    assert len(got) == len(FILES) + 2
    assert all(got[f"{n}.img"].result.status == "scrubbed" for n in FILES)
    assert got["large.img"].result.status == "failed" and got["large.img"].content is None
    assert got["large.img"].result.error == "File is larger than the scrub size limit."
    assert tuple(got["kept.img"].result) == ("clean", "", False, False, "") and bytes(got["kept.img"].content) == FILES["jpeg"]
    (tmp_path / "in" / "new.img").write_bytes(FILES["png"])
    got = run()  # only the new file
    assert len(got) == len(FILES) + 3 and got["new.img"].result.status == "scrubbed" and got["new.img"].batch == 1
    statuses = {r.path.rsplit("/", 1)[1]: r.status for r in streams.upload_statuses(spark, str(tmp_path / "out")).collect()}
    assert statuses == {n: r.result.status for n, r in got.items()}
    now = images.scrub(spark.read.parquet(str(tmp_path / "out")).filter("path LIKE '%new.img'").drop("result")).select("path", "result.status")
    assert [r.status for r in now.collect()] == ["clean"]
    assert [r.status for r in images.carried_status(now, streams.upload_statuses(spark, str(tmp_path / "out"))).collect()] == ["scrubbed"]
