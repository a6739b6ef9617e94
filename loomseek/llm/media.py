"""Media columns: texts as 8-bit WAV, read back and fingerprinted by pairs of spectral peaks.

The UTF-8 bytes of a text, padded with spaces to a positive multiple of 192, are the samples of a mono
8-bit WAV file, which the wave module writes and reads. The samples that were read go through a short-time Fourier
transform (Hann window of 192 samples, 96 apart). Of each frame, the strongest bin of each frequency band is a
peak if it is stronger than in the frames before and after; a peak is paired with the ``FAN`` peaks that follow it in its own frame
and in the next ones (at most ``REACH`` frames away). A pair is one integer of two bins and a time distance,
stored beside the frame it starts in: two arrays of equal length, the time-coded fingerprint. A payload of one frame has pairs too.

The files are a binary column of a table in the shared folder (``store``); all features come from a second pass over what that table has
(``describe_media``), so nothing is computed from bytes that were not stored and read back.

A null text is empty: its payload is 192 spaces. A null doc_id is kept, repeated rows have a file and a row each, an empty table gives none,
and other columns, whatever their names, are not read. Frames are transformed in blocks, so long texts need
no more memory than their own bytes and arrays. Equal texts have equal values.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomseek.llm import common

FRAME, HOP, UNIT, RATE = 192, 96, 192, 8000
#: Bins of the bands, and how pairs are built.
BANDS = ((2, 24), (24, 48), (48, 97))
FAN, REACH, BLOCK = 2, 8, 4096
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, fingerprint_time array<int>, fingerprint_hash array<int>"
_HANN = np.hanning(FRAME + 1)[:-1].astype(np.float32)


def to_wav(data: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(data)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames and bins of the peaks, by frame."""
    x = samples.astype(np.float32) - 128
    n = max(1, (len(x) - FRAME) // HOP + 1)
    bins, power = np.empty((n, len(BANDS)), np.int64), np.empty((n, len(BANDS)), np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    for at in range(0, n, BLOCK):
        spectrum = np.fft.rfft(frames[at : at + BLOCK] * _HANN, axis=1)
        energy = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        for k, (low, high) in enumerate(BANDS):
            best = energy[:, low:high].argmax(axis=1)
            bins[at : at + BLOCK, k] = best + low
            power[at : at + BLOCK, k] = energy[np.arange(len(best)), best + low]
    edge = np.full((1, len(BANDS)), -1, np.float32)
    top = (power > np.vstack([edge, power[:-1]])) & (power >= np.vstack([power[1:], edge])) & (power > 0)
    frame, band = np.nonzero(top)
    return frame, bins[frame, band]


def pairs(frame: np.ndarray, bin_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Time-coded pairs: the first peak's frame, and (first bin, second bin, distance) as one integer."""
    times, codes = [], []
    start = np.arange(1, len(frame) + 1)  # peaks come by frame, and by band within it
    for step in range(FAN):
        other = start + step
        ok = other < len(frame)
        a, b = np.nonzero(ok)[0], other[ok]
        gap = frame[b] - frame[a]
        near = gap <= REACH
        a, b, gap = a[near], b[near], gap[near]
        times.append(frame[a])
        codes.append((bin_[a] << 11) | (bin_[b] << 4) | gap)
    t, c = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((c, t))
    return t[order].astype(np.int32), c[order].astype(np.int32)


def payload(text: str | None) -> tuple[int, bytes]:
    """How many bytes a text has in UTF-8, and these padded to a positive multiple of UNIT."""
    raw = (text or "").encode()
    return len(raw), raw + b" " * ((-len(raw)) % UNIT or (0 if raw else UNIT))


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        made = [payload(t) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array([to_wav(data) for _, data in made], pa.binary())], names=["doc_id", "n_bytes", "media"])


def store(docs: DataFrame) -> DataFrame:
    """Writes doc_id, n_bytes and the file of every row of docs to the shared folder, and reads that table."""
    common.small_batches(docs.sparkSession)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return common.staged(rows.mapInArrow(_stored, "doc_id long, n_bytes long, media binary"), "media", compression="zstd")


def describe(media: bytes) -> tuple:
    """What SCHEMA has of a stored file, without id and n_bytes."""
    back = from_wav(media)
    t, c = pairs(*peaks(np.frombuffer(back, np.uint8)))
    feature = f"{len(t)}:{hashlib.sha256(t.tobytes() + c.tobytes()).hexdigest()}"
    return len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, t, c


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    for b in batches:
        rows = [describe(m) for m in b.column(2).to_pylist()]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names)


def describe_media(stored: DataFrame) -> DataFrame:
    """Sizes, digests and fingerprint of every stored file (doc_id, n_bytes, media)."""
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(_described, SCHEMA)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row of docs: sizes and digests of payload and WAV file, and the fingerprint, all from the stored column."""
    return describe_media(store(docs))


def op9(spark, sf_dir: str) -> DataFrame:
    """All documents as media columns."""
    return fingerprints(common.table(spark, sf_dir, "documents"))
