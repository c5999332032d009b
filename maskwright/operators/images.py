"""Location and identity metadata of images: found and blanked in place, the file's length and pixels stay."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Settings

# ---- fixed values: tags, types and names of the metadata formats ----
EXIF_IFD, GPS_IFD, INTEROP_IFD = 0x8769, 0x8825, 0xA005
IDENTITY_TAGS = (0x013B, 0x9C9D, 0xA430, 0xA431, 0xA435)
GPS_TAGS = range(0x20)
TYPE_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4}
MAX_ENTRIES = 1000
HEIF_BRANDS = ("heic", "heix", "hevc", "hevx", "heim", "heis", "hevm", "hevs", "mif1", "msf1", "avif", "avis")
XMP_NAMES = {
    "location": rb"exif:GPS[A-Za-z]*|photoshop:(?:City|State|Country)|Iptc4xmpCore:(?:Location|CountryCode)|Iptc4xmpExt:(?:LocationCreated|LocationShown)",
    "identity": rb"aux:(?:SerialNumber|LensSerialNumber|OwnerName)|exifEX:(?:BodySerialNumber|LensSerialNumber|CameraOwnerName)|dc:creator",
}
EXIF_MARK, XMP_MARK, XMP_MORE = b"Exif\0\0", b"http://ns.adobe.com/xap/1.0/\0", b"http://ns.adobe.com/xmp/extension/\0"

RESULT = "struct<status:string,format:string,location:boolean,identity:boolean,error:string>"
SEVERITY = ("clean", "scrubbed", "failed")


class Malformed(Exception):
    """The file's structure contradicts itself."""


class _Image:
    """One image's bytes with what was found and the edits that would blank it."""

    def __init__(self, data: bytes, location: bool, identity: bool):
        self.data, self.wanted = data, {"location": location, "identity": identity}
        self.found = {"location": False, "identity": False}
        self.edits: dict[int, bytes] = {}

    def number(self, at: int, size: int, little: bool = False) -> int:
        """An unsigned integer; 0 beyond the end."""
        raw = self.data[at : at + size] if at >= 0 else b""
        return int.from_bytes(raw, "little" if little else "big") if len(raw) == size else 0

    def take(self, other: _Image) -> None:
        for k, yes in other.found.items():
            self.found[k] |= yes
        self.edits |= other.edits

    def note(self, kind: str, edits: list[tuple[int, bytes]]) -> None:
        self.found[kind] = True
        if self.wanted[kind]:
            self.edits |= dict(edits)

    # Containers: (kind, start, end) of each metadata block.

    def jpeg(self) -> Iterator[tuple[str, int, int]]:
        at, n = 2, len(self.data)
        while at + 4 <= n:
            if self.data[at] != 0xFF:
                raise Malformed
            marker = self.data[at + 1]
            if marker == 0xFF:
                at += 1
            elif marker in (0xD8, 0x01) or 0xD0 <= marker <= 0xD7:
                at += 2
            elif marker in (0xDA, 0xD9):
                return
            else:
                start, end = at + 4, at + 2 + self.number(at + 2, 2)
                if end < start or end > n:
                    raise Malformed
                if marker == 0xE1:
                    if self.data.startswith(EXIF_MARK, start):
                        yield "exif", start + len(EXIF_MARK), end
                    elif self.data.startswith(XMP_MARK, start):
                        yield "xmp", start + len(XMP_MARK), end
                    elif self.data.startswith(XMP_MORE, start):
                        yield "xmp", min(end, start + len(XMP_MORE) + 40), end
                at = end

    def webp(self) -> Iterator[tuple[str, int, int]]:
        at, n = 12, len(self.data)
        while at + 8 <= n:
            size, start = self.number(at + 4, 4, True), at + 8
            if start + size > n:
                raise Malformed
            kind = self.data[at : at + 4]
            if kind == b"EXIF":
                yield "exif", start + len(EXIF_MARK) * self.data.startswith(EXIF_MARK, start), start + size
            elif kind == b"XMP ":
                yield "xmp", start, start + size
            at = start + size + size % 2

    def png(self) -> Iterator[tuple[str, int, int]]:
        for kind, start, end in self._png_chunks(strict=True):
            if kind == b"IEND":
                return
            if kind == b"eXIf":
                yield "exif", start + len(EXIF_MARK) * self.data.startswith(EXIF_MARK, start), end
            elif kind == b"iTXt" and self.data.startswith(b"XML:com.adobe.xmp\0\0", start) and start + 20 <= end:
                at = start + 20  # after the flag and the method come two names, each with its end
                for _ in range(2):
                    at = self.data.find(b"\0", at, end) + 1
                    if not at:
                        raise Malformed
                yield "xmp", at, end

    def _png_chunks(self, strict: bool) -> Iterator[tuple[bytes, int, int]]:
        at, n = 8, len(self.data)
        while at + 12 <= n:
            start = at + 8
            end = start + self.number(at, 4)
            if end + 4 > n:
                if strict:
                    raise Malformed
                return
            yield self.data[at + 4 : start], start, end
            at = end + 4

    def _boxes(self, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
        while at + 8 <= end:
            size, head = self.number(at, 4), 8
            if size == 1:
                size, head = self.number(at + 8, 8), 16
            elif size == 0:
                size = end - at
            if size < head or at + size > end:
                return
            yield self.data[at + 4 : at + 8], at + head, at + size
            at += size

    def heif(self) -> Iterator[tuple[str, int, int]]:
        n = len(self.data)
        meta = next(((a, b) for k, a, b in self._boxes(0, n) if k == b"meta"), None)
        if not meta:
            return
        inner: dict[bytes, tuple[int, int]] = {}
        for k, a, b in self._boxes(meta[0] + 4, meta[1]):
            inner.setdefault(k, (a, b))
        if b"iinf" not in inner or b"iloc" not in inner:
            return
        items, (start, end) = set(), inner[b"iinf"]
        for k, a, b in self._boxes(start + (6 if self.data[start] == 0 else 8), end):
            if k == b"infe" and a + 4 <= b and self.data[a] >= 2:
                width = 2 if self.data[a] == 2 else 4
                if self.data[a + 6 + width : a + 10 + width] == b"Exif":
                    items.add(self.number(a + 4, width))
        for item, first, size in self._locations(*inner[b"iloc"]):
            if item in items and first + 4 <= n:
                stop = min(n, first + size) if size else n
                tiff = first + 4 + self.number(first, 4)
                tiff += len(EXIF_MARK) * self.data.startswith(EXIF_MARK, tiff)
                if tiff < stop:
                    yield "exif", tiff, stop

    def _locations(self, at: int, end: int) -> Iterator[tuple[int, int, int]]:
        """(item, start, length) of each item's first extent that lies in the file itself."""
        version, sizes = self.data[at], self.number(at + 4, 2)
        offset, length, base, index = sizes >> 12, sizes >> 8 & 15, sizes >> 4 & 15, sizes & 15 if version else 0
        wide = lambda p, k: self.number(p, k) if k in (4, 8) else 0
        id_size = 2 if version < 2 else 4
        count, at = self.number(at + 6, id_size), at + 6 + id_size
        while count and at < end:
            item, at, method = self.number(at, id_size), at + id_size, 0
            if version:
                method, at = self.number(at, 2) & 15, at + 2
            origin = wide(at + 2, base)
            extents, at = self.number(at + 2 + base, 2), at + 4 + base
            if extents and not method:
                yield item, origin + wide(at + index, offset), wide(at + index + offset, length)
            at += extents * (index + offset + length)
            count -= 1

    # Blocks.

    def exif(self, start: int, end: int) -> None:
        """A TIFF block; one that can't be read counts as location and is blanked whole, zeros are nothing."""
        if end <= start or not self.data[start : min(end, start + 64)].strip(b"\0"):
            return
        if not self.tiff(start, end):
            self.note("location", [(start, bytes(end - start))])

    def _ifd(self, base: int, end: int, offset: int, little: bool) -> tuple[int, int, list[tuple[int, int, int, int, int]]] | None:
        """(place, number of entries, entries as (tag, type, size, value, data place)), or None if it can't be right."""
        at = base + offset
        if offset < 8 or at + 2 > end:
            return None
        count = self.number(at, 2, little)
        if count > MAX_ENTRIES or at + 6 + 12 * count > end:
            return None
        entries = []
        for e in range(at + 2, at + 2 + 12 * count, 12):
            tag, kind, n, value = struct.unpack_from("<HHII" if little else ">HHII", self.data, e)
            if kind not in TYPE_SIZES:
                continue
            size = TYPE_SIZES[kind] * n
            place = e + 8 if size <= 4 else base + value
            if size > 4 and place + size > end:
                return None
            entries.append((tag, kind, size, value, place))
        return at, count, entries

    def tiff(self, base: int, end: int) -> bool:
        """Identity tags and the location directory of a TIFF structure; False if it can't be read."""
        order = self.data[base : base + 2]
        little = order == b"II"
        if base + 8 > end or order not in (b"II", b"MM") or self.number(base + 2, 2, little) != 42:
            return False
        part = _Image(self.data, **self.wanted)
        main = self._ifd(base, end, self.number(base + 4, 4, little), little)
        if main is None:
            return False
        pointers = {tag: value for tag, _, _, value, _ in main[2] if tag in (EXIF_IFD, GPS_IFD)}
        read = [main]
        if EXIF_IFD in pointers:
            more = self._ifd(base, end, pointers[EXIF_IFD], little)
            if more is None:
                return False
            read.append(more)
        for tag, kind, size, _, place in (e for ifd in read for e in ifd[2]):
            if tag in IDENTITY_TAGS and self.data[place : place + size].strip(b" \0"):
                blank = b" " * (size - 1) + b"\0" if kind == 2 else bytes(size)
                part.note("identity", [(place, blank)])
        if GPS_IFD in pointers:
            gps = self._ifd(base, end, pointers[GPS_IFD], little)
            if gps is None:
                return False
            for value in [e[3] for ifd in read[1:] for e in ifd[2] if e[0] == INTEROP_IFD]:
                if (more := self._ifd(base, end, value, little)) is not None:
                    read.append(more)
            kept = [(at, at + 6 + 12 * n) for at, n, _ in read] + [(p, p + s) for _, _, es in read for _, _, s, _, p in es if s > 4]
            free = lambda a, b: not any(a < y and x < b for x, y in kept)
            filled = [(p, s) for tag, _, s, _, p in gps[2] if tag in GPS_TAGS and self.data[p : p + s].strip(b"\0")]
            if filled:
                spans = [*filled, (gps[0], 6 + 12 * gps[1])]
                part.note("location", [(p, bytes(s)) for p, s in spans if free(p, p + s)])
        self.take(part)
        return True

    def xmp(self, start: int, end: int) -> None:
        text = self.data[start:end]
        for kind, names in XMP_NAMES.items():
            forms = (
                rb"(?<=[\s\"'])(?:" + names + rb")\s*=\s*(?:\"[^\"]*\"|'[^']*')",
                rb"(?s)<(" + names + rb")(?:\s[^>]*)?>.*?</\1>",
                rb"<(?:" + names + rb")(?:\s[^>]*)?/>",
            )
            for m in (m for f in forms for m in re.finditer(f, text)):
                self.note(kind, [(start + m.start(), b" " * len(m[0]))])

    def sweep(self) -> None:
        """Blocks that no container showed: TIFF after its mark, and XMP packets."""
        for m in re.finditer(re.escape(EXIF_MARK) + rb"(?=II\*\0|MM\0\*)", self.data):
            self.tiff(m.end(), len(self.data))
        for m in re.finditer(rb"(?s)<x:xmpmeta.*?</x:xmpmeta>", self.data):
            self.xmp(m.start(), m.end())

    def edited(self, png: bool) -> bytes:
        out = bytearray(self.data)
        for at, blank in self.edits.items():
            out[at : at + len(blank)] = blank
        if png:
            for _, start, end in self._png_chunks(strict=False):
                out[end : end + 4] = zlib.crc32(bytes(out[start - 4 : end])).to_bytes(4, "big")
        return bytes(out)


def image_format(data: bytes) -> str:
    if data.startswith(b"\xff\xd8\xff"):
        return "jpeg"
    if data.startswith(b"\x89PNG\r\n\x1a\n"):
        return "png"
    if data.startswith(b"RIFF") and data[8:12] == b"WEBP":
        return "webp"
    return "heif" if data[4:8] == b"ftyp" and data[8:12].decode("latin-1") in HEIF_BRANDS else ""


def scrub_bytes(data: bytes | None, location: bool = True, identity: bool = True, dry_run: bool = False) -> tuple[dict, bytes | None]:
    """(status, format, what was found, error) and the image without it.

    ``scrubbed`` (or would be), ``clean``, ``unsupported``, or ``failed`` for what can't be read or is not clean
    afterwards; only scrubbed images differ from what came in, never in length.
    """
    result = {"status": "unsupported", "format": "", "location": False, "identity": False, "error": ""}
    if data is None:
        return result | {"status": "failed", "error": "File is not readable."}, None
    form = result["format"] = image_format(data)
    if not form:
        return result, data
    image = _Image(data, location, identity)
    try:
        for kind, start, end in getattr(image, form)():
            getattr(image, kind)(start, end)
        if form != "png":
            image.sweep()
    except (Malformed, IndexError, struct.error):
        return result | image.found | {"status": "failed", "error": "Malformed image structure; left unchanged."}, data
    result |= image.found
    if not any(image.found[k] and image.wanted[k] for k in image.found):
        return result | {"status": "clean"}, data
    if dry_run:
        return result | {"status": "scrubbed"}, data
    out = image.edited(form == "png")
    if len(out) != len(data) or scrub_bytes(out, location, identity, True)[0]["status"] != "clean":
        return result | {"status": "failed", "error": "Verification after scrubbing failed; left unchanged."}, data
    return result | {"status": "scrubbed"}, out


def detect_format(data: Column) -> Column:
    """The format by its first bytes; empty for none of the four."""
    head = F.hex(F.substring(data, 1, 12))
    brand = F.substring(data, 9, 4).cast("string")
    return (
        F.when(head.startswith("FFD8FF"), "jpeg")
        .when(head.startswith("89504E470D0A1A0A"), "png")
        .when(head.startswith("52494646") & head.endswith("57454250"), "webp")
        .when((F.substring(head, 9, 8) == "66747970") & brand.isin(*HEIF_BRANDS), "heif")
        .otherwise("")
    )


def scrub(df: DataFrame, content: str = "content", settings: Settings | None = None, dry_run: bool = False, allow: Column | None = None) -> DataFrame:
    """Adds ``result`` (status, format, location, identity, error) and puts scrubbed bytes in the place of the content.

    Rows for which ``allow`` is false or null are left alone and count as clean, without a format; their bytes go to no Python
    worker. Files that ``sources.ingest.image_files`` left unread for their size (``too_large``) have failed.
    """
    settings = settings or Settings()
    location, identity = settings.strip_location, settings.strip_identity
    kind = T.StructType([T.StructField(n, T.StringType()) for n in ("status", "format")] + [T.StructField(n, T.BooleanType()) for n in ("location", "identity")] + [T.StructField("error", T.StringType()), T.StructField("bytes", T.BinaryType())])

    @F.pandas_udf(kind)
    def run(data: pd.Series) -> pd.DataFrame:
        rows = [scrub_bytes(None if d is None else bytes(d), location, identity, dry_run) for d in data]
        return pd.DataFrame([r | {"bytes": b} for r, b in rows], columns=[f.name for f in kind])

    allowed = F.lit(True) if allow is None else F.coalesce(allow, F.lit(False))
    out = df.withColumn("__allowed", allowed).withColumn("__scrubbed", run(F.when(F.col("__allowed"), F.col(content))))
    fields = {n: F.col(f"__scrubbed.{n}") for n in ("status", "format", "location", "identity", "error")}
    if "too_large" in df.columns:
        fields["error"] = F.when(F.col("too_large") & F.col(content).isNull(), "File is larger than the scrub size limit.").otherwise(fields["error"])
    alone = {"status": F.lit("clean"), "location": F.lit(False), "identity": F.lit(False)}
    result = F.struct(*[F.when(F.col("__allowed"), c).otherwise(alone.get(n, F.lit(""))).alias(n) for n, c in fields.items()])
    bytes_ = F.when(F.col("__allowed"), F.col("__scrubbed.bytes")).otherwise(F.col(content))
    return out.withColumns({"result": result, content: bytes_}).drop("__scrubbed", "__allowed")


def files_of(attachments: DataFrame) -> DataFrame:
    """``id, path`` for each distinct file of an attachment: attached, original, and every size."""
    paths = F.array_distinct(F.array_compact(F.concat(F.array("attached", "original"), F.coalesce("sizes", F.array().cast("array<string>")))))
    return attachments.select("id", F.explode(paths).alias("path"))


def status_of(results: DataFrame, key: str = "id") -> DataFrame:
    """The worst status of an attachment's files: failed, scrubbed, clean."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITY)), F.col("result.status")), F.lit(0))
    worst = results.groupBy(key).agg(F.greatest(F.lit(1), F.max(rank)).alias("rank"))
    return worst.select(key, F.element_at(F.array(*map(F.lit, SEVERITY)), F.col("rank").cast("int")).alias("status"))


def inspect(results: DataFrame, credits: DataFrame | None = None, key: str = "id", settings: Settings | None = None) -> DataFrame:
    """Per attachment: location, identity (a stored credit counts), failed, types, would_change."""
    settings = settings or Settings()
    seen = results.groupBy(key).agg(*[F.bool_or(f"result.{c}").alias(c) for c in ("location", "identity")], F.bool_or(F.col("result.status") == "failed").alias("failed"))
    if credits is not None:
        named = credits.select(F.col(key).alias("__key"), (F.coalesce("credit", F.lit("")) != "").alias("__credit"))
        seen = seen.join(named, F.col(key) == F.col("__key"), "left").withColumn("identity", F.col("identity") | F.coalesce("__credit", F.lit(False))).drop("__key", "__credit")
    kinds = F.array(*[F.when(F.col(c), F.lit(n)) for c, n in (("location", "image_location"), ("identity", "image_identity"), ("failed", "unreadable"))])
    change = (F.col("location") & settings.strip_location) | (F.col("identity") & settings.strip_identity)
    return seen.withColumns({"detected_types": F.array_compact(kinds), "would_change": change})


def carried_status(now: DataFrame, uploads: DataFrame, key: str = "path") -> DataFrame:
    """A file that is clean now but was not when it came in keeps the status that it got then."""
    then = uploads.select(F.col(key).alias("__key"), F.col("status").alias("__then"))
    both = now.join(then, F.col(key) == F.col("__key"), "left")
    return both.withColumn("status", F.when((F.col("status") == "clean") & F.col("__then").isNotNull(), F.col("__then")).otherwise(F.col("status"))).drop("__key", "__then")


def without_credit(meta: DataFrame, column: str = "image_meta") -> DataFrame:
    """Stored image metadata without the author's name."""
    return meta.withColumn(column, F.col(column).withField("credit", F.lit("")))
