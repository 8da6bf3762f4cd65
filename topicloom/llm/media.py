"""Media columns: WAV written and read by the wave module, spectral-peak pair fingerprints.

A payload of bytes is stored as 8-bit mono samples. Features come from the samples read back: a short-time
Fourier transform with a Hann window, the strongest bin of each band in each frame, kept where it is a local
maximum in time, and pairs of such peaks: each with every peak of its band that follows within ``AHEAD`` frames.
Frames overlap by three quarters, so a passage at another offset still gives part of its pairs. A pair is the code
``f1 << 20 | f2 << 8 | dt`` at the time (frame) of its first peak: an array of time-coded landmarks, as in public
audio fingerprinting.
A payload too short for pairs in time pairs the peaks of each frame (dt 0).

Defined results: a null text counts as empty (64 zero bytes); equal texts give equal values; silence (all
samples equal) has no landmarks; repeated rows are handled one by one; extra columns are left alone.
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
from pyspark.sql import functions as F

from topicloom.llm.common import bound_batches

RATE = 8000
FRAME = 512
HOP = 128
BANDS = ((2, 32), (32, 96), (96, 257))
#: The target zone of a peak, in frames.
AHEAD = 8
#: Frames transformed at a time, so a very long payload needs little more than itself.
BLOCK = 4096
_WINDOW = np.hanning(FRAME).astype(np.float32)


def padded(data: bytes, unit: int = 64) -> bytes:
    """Zero bytes appended up to a positive multiple of unit."""
    return data + bytes(-len(data) % unit or (unit if not data else 0))


def to_wav(payload: bytes) -> bytes:
    with io.BytesIO() as out:
        with wave.open(out, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(1)
            w.setframerate(RATE)
            w.writeframes(payload)
        return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getsampwidth(), w.getnchannels()) != (1, 1):
            raise ValueError("8-bit mono is expected")
        return w.readframes(w.getnframes())


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strongest bin and its magnitude for each frame and band."""
    n = max(1, -(-(len(samples) - FRAME) // HOP) + 1)
    bins, power = [], []
    for lo in range(0, n, BLOCK):
        hi = min(n, lo + BLOCK)
        part = samples[lo * HOP : (hi - 1) * HOP + FRAME].astype(np.float32) - 128
        part = np.pad(part, (0, (hi - lo - 1) * HOP + FRAME - len(part)))
        frames = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP]
        mag = np.abs(np.fft.rfft(frames * _WINDOW, axis=1)).astype(np.float32)
        best = [mag[:, a:b].argmax(axis=1) + a for a, b in BANDS]
        bins.append(np.stack(best, 1))
        power.append(np.stack([mag[np.arange(hi - lo), x] for x in best], 1))
    return np.concatenate(bins), np.concatenate(power)


def landmarks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Times (frames) and codes of the pairs of peaks, in time order."""
    bins, power = peaks(samples)
    if samples.min() == samples.max():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.full((1, len(BANDS)), -1, np.float32)
    high = np.concatenate([edge, power, edge])
    top = (high[1:-1] > high[:-2]) & (high[1:-1] >= high[2:])
    times, codes = [], []
    for dt in range(1, AHEAD + 1):
        for band in range(len(BANDS)):
            at = np.flatnonzero(top[:-dt, band] & top[dt:, band]) if len(top) > dt else np.zeros(0, np.int64)
            times.append(at)
            codes.append(bins[at, band] << 20 | bins[at + dt, band] << 8 | dt)
    t, c = np.concatenate(times), np.concatenate(codes)
    if not len(t):  # too short for pairs in time: the peaks of a frame are paired with each other
        frame = np.arange(len(bins))
        t = np.concatenate([frame] * (len(BANDS) - 1))
        c = np.concatenate([bins[:, b] << 20 | bins[:, b + 1] << 8 for b in range(len(BANDS) - 1)])
    order = np.lexsort((c, t))
    return t[order], c[order]


def store(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_bytes and media (the WAV file) of every row."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, raw), pa.int64()), pa.array([to_wav(padded(x)) for x in raw], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", F.col(text).cast("string").alias("t")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def features(stored: DataFrame) -> DataFrame:
    """Digests of what is read back from media, and its landmarks array<struct<t int, code int>>."""
    bound_batches(stored.sparkSession)
    kind = pa.list_(pa.struct([("t", pa.int32()), ("code", pa.int32())]))
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "landmarks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(5)]
            sizes, all_t, all_c = [0], [], []
            for media in batch.column(2).to_pylist():
                payload = from_wav(media)
                for col, x in zip(cols, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest()), strict=True):
                    col.append(x)
                t, c = landmarks(np.frombuffer(payload, dtype=np.uint8))
                sizes.append(sizes[-1] + len(t))
                all_t.append(t)
                all_c.append(c)
            flat = [pa.array(np.concatenate(x or [np.zeros(0)]).astype(np.int32)) for x in (all_t, all_c)]
            marks = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays(flat, names=["t", "code"]))
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(cols, types, strict=True)), marks.cast(kind)], names=names)

    id_kind = stored.schema["doc_id"].dataType.simpleString()
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {id_kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, landmarks array<struct<t:int,code:int>>")
