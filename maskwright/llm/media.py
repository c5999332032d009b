"""Sound columns: WAV bytes, short-time Fourier transforms and spectral-peak fingerprints."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, slices

#: Samples in a frame; payloads are padded to a multiple of it.
FRAME = 192
HOP = 96
RATE = 8000
#: Edges of the frequency bands; each gives one peak a frame.
BANDS = (2, 8, 20, 44, 97)
#: A peak is paired with those of so many later frames.
REACH = 3
_WINDOW = np.hanning(FRAME).astype(np.float32)


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def peaks(samples: np.ndarray) -> np.ndarray:
    """The loudest bin of each band in each frame of 8-bit samples, as (frames, bands)."""
    x = (samples.astype(np.float32) - 128) / 128
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    out = np.empty((len(frames), len(BANDS) - 1), np.int64)
    for i in range(0, len(frames), 4096):  # a long recording is transformed part by part
        power = np.abs(np.fft.rfft(frames[i : i + 4096] * _WINDOW, axis=1))
        for b, (low, high) in enumerate(zip(BANDS, BANDS[1:], strict=False)):
            out[i : i + 4096, b] = low + power[:, low:high].argmax(1)
    return out


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """Pairs of peaks as time-coded integers: frame << 32 | band << 24 | bin << 16 | later bin << 8 | frames between."""
    p = peaks(samples)
    band = np.arange(p.shape[1]) << 24
    codes = [((np.arange(len(p) - d) << 32)[:, None] | band | p[:-d] << 16 | p[d:] << 8 | d).ravel() for d in range(1, REACH + 1) if len(p) > d]
    return np.sort(np.concatenate(codes)) if codes else np.zeros(0, np.int64)


def text_to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, n_bytes, media``: each text's UTF-8 bytes, padded by spaces to whole frames, as 8-bit mono WAV.

    A null text counts as empty and gives one frame of spaces. Every row gives one row, repeated ones too; an
    empty table gives none. Texts are read whole; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, text = columns(batch, "id", "text")
            for row, end, data, offsets in slices(text):
                raw = data.tobytes()
                parts = [raw[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]
                media = [to_wav(x.ljust(max(1, -(-len(x) // FRAME)) * FRAME, b" ")) for x in parts]
                yield pa.record_batch([ids.slice(row, end - row), pa.array(map(len, parts), pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def media_features(media: DataFrame, media_col: str = "media", keep_fingerprint: bool = True) -> DataFrame:
    """Adds payload figures read back from the WAV bytes, and the fingerprint with its digest in ``feature``.

    A null or unreadable recording gives nulls. Equal bytes give equal values. The added columns are
    ``payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature`` and, if wanted,
    ``fingerprint array<long>``; the recording itself goes, all other columns stay, but for those that have the name
    of an added one, in any case, which give way to it.
    """
    added = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", fingerprint array<long>" * keep_fingerprint

    def one(m: bytes | None) -> tuple:
        try:
            payload = from_wav(m) if m is not None else None
        except (wave.Error, EOFError):
            payload = None
        if payload is None:
            return (None,) * 7
        f = fingerprint(np.frombuffer(payload, np.uint8)) if len(payload) >= FRAME else np.zeros(0, np.int64)
        digest = f"{len(f)}:{hashlib.sha256(f.astype('<i8').tobytes()).hexdigest()[:32]}"
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(m), hashlib.sha256(m).hexdigest(), digest, f if keep_fingerprint else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(media_col)
            stay = [batch.schema.get_field_index(c) for c in rest]
            for i in range(0, len(batch), 500):
                part = batch.slice(i, 500)
                rows = [one(m.as_py()) for m in part.column(at)]
                made = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=False)]
                yield pa.record_batch([part.column(j) for j in stay] + made, names)

    new = {x.split()[0] for x in added.split(", ")}
    rest = [c for c in media.columns if c != media_col and c.lower() not in new]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.list_(pa.int64())] * keep_fingerprint
    names = rest + [x.split()[0] for x in added.split(", ")]
    schema = ", ".join(f"`{c}` {k}" for c, k in media.dtypes if c in rest) + ", " + added
    return media.mapInArrow(run, schema)
