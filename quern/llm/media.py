"""Media columns (operator 6): bytes stored as WAV, and spectral-peak pair fingerprints.

A payload becomes an 8-bit mono WAV written and read by the wave module. In the short-time Fourier
transforms of the samples a peak is a bin that none of its neighbours in frequency and time exceeds
and that stands out from its neighbours' mean. Peaks are paired with the next few peaks of later frames; each
pair is hashed as (frequency, frequency, distance in frames) and stored with the frame of its first
peak: a time-coded array, as used for finding a recording again by aligned offsets.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import arrow_map, read

RATE = 8_000
FRAME, HOP, FAN = 512, 256, 8
#: Frames that the hop is made smaller for, and the smallest hop.
FEW, LEAST_HOP = 4, 16
#: The lowest bins carry only the mean level and are no peaks; bins and frames to each side that a peak is held against.
LOWEST, NEAR_BINS, NEAR_FRAMES = 4, 8, 1
BLOCK = 512
PAD = 64


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def pad(data: bytes, unit: int = PAD) -> bytes:
    """Zero bytes up to the next positive multiple of unit; whole multiples stay, nothing becomes one unit."""
    return data + bytes(-len(data) % unit if data else unit)


_WINDOW = np.hanning(FRAME).astype(np.float32)


def peaks(samples: np.ndarray) -> np.ndarray:
    """Rows (frame, bin): bins that are the largest of all near them and above the mean of those in their frame.

    Of equal neighbours all count. Frames less than HOP apart are no neighbours. The hop is HOP, halved where there would be fewer than FEW frames.
    Frames are transformed a block at a time, with the frames next to it, so that the working memory
    doesn't grow with the length and the peaks don't depend on where the blocks end.
    """
    hop = HOP
    while hop > LEAST_HOP and len(samples) <= (FEW - 1) * hop:
        hop //= 2
    n = max(1, -(-len(samples) // hop))
    near = NEAR_FRAMES * hop // HOP  # frames that overlap almost wholly aren't held against each other
    found = []
    for at in range(0, n, BLOCK):
        first, last = max(0, at - near), min(n, at + BLOCK + near)
        part = samples[first * hop : (last - 1) * hop + FRAME].astype(np.float32) - 128.0
        part = np.pad(part, (0, (last - first - 1) * hop + FRAME - len(part)))
        frames = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::hop]
        power = np.log1p(np.abs(np.fft.rfft(frames * _WINDOW, axis=1)))
        top = _largest_near(_largest_near(power, NEAR_BINS, 1), near, 0)
        peak = (power >= top) & (power > _mean_near(power, NEAR_BINS) + 1e-6)
        at_frame, at_bin = np.nonzero(peak[at - first : at - first + BLOCK, LOWEST:])
        found.append(np.stack([at_frame + at, at_bin + LOWEST], axis=1))
    return np.concatenate(found)


def _mean_near(x: np.ndarray, reach: int) -> np.ndarray:
    """For each entry of a row the mean of those at most reach away."""
    sums = np.pad(np.cumsum(x, axis=1, dtype=np.float64), ((0, 0), (1, 0)))
    at = np.arange(x.shape[1])
    lo, hi = np.maximum(at - reach, 0), np.minimum(at + reach + 1, x.shape[1])
    return (sums[:, hi] - sums[:, lo]) / (hi - lo)


def _largest_near(x: np.ndarray, reach: int, axis: int) -> np.ndarray:
    """For each entry the largest of those at most reach away along an axis."""
    x = np.moveaxis(x, axis, 0)
    padded = np.pad(x, ((reach, reach), (0, 0)), constant_values=-1.0)
    width, size = 2 * reach + 1, 1
    while 2 * size <= width:
        padded, size = np.maximum(padded[: len(padded) - size], padded[size:]), 2 * size
    out = np.maximum(padded[: len(x)], padded[width - size : width - size + len(x)])
    return np.moveaxis(out, 0, axis)


def pairs(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, frames): each peak with the next FAN peaks of later frames, of those the ones less than 64 frames away."""
    hashes, times = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    later = np.searchsorted(p[:, 0], p[:, 0], side="right")
    for step in range(FAN):
        ok = later + step < len(p)
        a, b = p[ok], p[later[ok] + step]
        ok = b[:, 0] - a[:, 0] < 64
        a, b = a[ok], b[ok]
        hashes.append((a[:, 1] << 15) | (b[:, 1] << 6) | (b[:, 0] - a[:, 0]))
        times.append(a[:, 0])
    h, t = np.concatenate(hashes), np.concatenate(times)
    order = np.lexsort((h, t))
    return h[order], t[order]


FIELDS = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, n_peaks bigint, hashes array<int>, frames array<int>"


def media_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """One row per row of df: the WAV form of its text's bytes, what was read back, and fingerprints.

    hashes and frames have one entry per peak pair, sorted by frame. keep_media adds the stored WAV
    bytes as column media. A null text counts as empty and gives one unit of zero bytes. Equal texts
    give equal values. A null id is kept, repeated rows each give a row, an empty table gives an
    empty result, and other columns are ignored.
    """
    small = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("payload"))
    schema = f"doc_id {small.schema['doc_id'].dataType.simpleString()}, {FIELDS}" + ", media binary" * keep_media
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())] + [pa.binary()] * keep_media
    names = [x.strip().split(" ")[0] for x in FIELDS.split(", ")] + ["media"] * keep_media

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            for raw in batch.column("payload").to_pylist():
                media = to_wav(pad(raw))
                back = from_wav(media)
                p = peaks(np.frombuffer(back, np.uint8))
                h, t = pairs(p)
                got = [len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-PAD:]), len(media), hashlib.sha256(media).hexdigest(), len(p), h.astype(np.int32), t.astype(np.int32)]
                for c, v in zip(cols, [*got, media], strict=False):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", *names])

    return arrow_map(small, rows, schema)


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feature: pairs, peaks and a digest of the time-coded array, whose hashes and frames are the last two columns."""
    d = media_columns(read(spark, sf_dir, "documents"))
    coded = F.sha2(F.concat_ws(";", F.array_join("hashes", ","), F.array_join("frames", ",")), 256)
    feature = F.concat_ws(":", F.size("hashes").cast("string"), F.col("n_peaks").cast("string"), coded)
    return d.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), "hashes", "frames")


QUERIES = {"op6_media_columns": op6_media_columns}
ORACLE: dict[str, str] = {}
