"""Audio columns: 8-bit WAV files, polyphase resampling, log-mel filterbanks and hysteresis energy segments (numpy)."""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.lineage import settled, sliced

RATE, UP, DOWN, TAPS = 16_000, 2, 3, 16
FRAME, HOP, MELS = 256, 128, 32
TENSOR_FRAMES = 64
BLOCK = 576
FLOOR = 1e-8
_AT_ONCE = 1 << 19


def padded(text: str | None, block: int = BLOCK) -> bytes:
    """The text in UTF-8 (null: empty) with bytes 255 up to a positive multiple of `block`."""
    raw = (text or "").encode("utf-8")
    size = max(1, -(-len(raw) // block)) * block
    return raw + b"\xff" * (size - len(raw))


def wav_bytes(samples: bytes, rate: int = RATE) -> bytes:
    """A mono WAV file of unsigned 8-bit samples."""
    pad = b"\0" * (len(samples) % 2)
    return b"RIFF" + struct.pack("<I", 36 + len(samples) + len(pad)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(samples)) + samples + pad


def wav_samples(data: bytes) -> tuple[bytes, int]:
    """Samples and rate of a mono 8-bit WAV file; other chunks are skipped.  ValueError if it is none."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("only mono 8-bit PCM is read")
        elif name == b"data":
            if rate is None or at + 8 + size > len(data):
                raise ValueError("WAV file is cut")
            return data[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("WAV file without samples")


@lru_cache
def _phases(up: int, down: int, taps: int) -> np.ndarray:
    """Windowed-sinc low-pass at the lower of the two rates, one row of taps for each phase."""
    t = np.arange(up * taps) - (up * taps - 1) / 2
    cut = 1 / max(up, down)
    kernel = np.sinc(t * cut) * np.hamming(len(t)) * cut * up
    return np.ascontiguousarray(kernel.reshape(taps, up).T).astype(np.float32)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """Polyphase resampling by up/down: only samples that are kept are computed."""
    n = -(-len(x) * up // down)
    out = np.empty(n, np.float32)
    ext = np.concatenate([np.zeros(taps, np.float32), x.astype(np.float32, copy=False), np.zeros(taps, np.float32)])
    for first in range(min(up, n)):
        place, phase = divmod(first * down, up)
        many = -(-(n - first) // up)
        row = np.zeros(many, np.float32)
        for k, weight in enumerate(_phases(up, down, taps)[phase]):
            at = place - k + taps + taps // 2
            row += weight * ext[at : at + (many - 1) * down + 1 : down]
        out[first::up] = row
    return out


@lru_cache
def mel_filters(rate: float, size: int = FRAME, mels: int = MELS) -> np.ndarray:
    """Triangular filters, evenly spaced on the mel scale, from the bins of a real FFT of `size`."""
    to_mel, to_hz = lambda f: 2595 * np.log10(1 + f / 700), lambda m: 700 * (10 ** (m / 2595) - 1)
    edges = to_hz(np.linspace(0, to_mel(rate / 2), mels + 2))
    bins = np.linspace(0, rate / 2, size // 2 + 1)[:, None]
    rise, fall = (bins - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - bins) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def log_mel(x: np.ndarray, rate: float) -> np.ndarray:
    """Log-mel energies (frames, MELS) of overlapping Hann frames; a shorter signal is padded with zeros to one frame."""
    if len(x) < FRAME:
        x = np.concatenate([x, np.zeros(FRAME - len(x), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    window, filters = np.hanning(FRAME).astype(np.float32), mel_filters(rate)
    out = np.empty((len(frames), MELS), np.float32)
    for at in range(0, len(frames), 4096):
        spectrum = np.fft.rfft(frames[at : at + 4096] * window, axis=1)
        out[at : at + 4096] = np.log((spectrum.real**2 + spectrum.imag**2).astype(np.float32) @ filters + FLOOR)
    return out


def energy_segments(mel: np.ndarray, seconds_per_frame: float) -> list[tuple[float, float]]:
    """Time spans of loud stretches: one begins where a frame's energy reaches the mean plus half a deviation and lasts until it falls below the mean."""
    energy = mel.mean(axis=1)
    low = float(energy.mean())
    high = low + 0.5 * float(energy.std())
    mark = np.where(energy >= high, 1, np.where(energy < low, 0, -1))
    if high - low < 1e-6:
        mark[:] = 0
    known = np.maximum.accumulate(np.where(mark >= 0, np.arange(len(mark)), -1))
    loud = np.where(known >= 0, mark[np.maximum(known, 0)], 0)
    edges = np.diff(np.concatenate([[0], loud, [0]]))
    return [(round(a * seconds_per_frame, 6), round(b * seconds_per_frame, 6)) for a, b in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1))]


@dataclass(frozen=True)
class Features:
    mel: np.ndarray
    segments: list[tuple[float, float]]
    seconds_per_frame: float

    def tensors(self):
        """(start, end, frames, tensor of shape (TENSOR_FRAMES, MELS)): the last one is filled up with the log of the floor."""
        for at in range(0, len(self.mel), TENSOR_FRAMES):
            part = self.mel[at : at + TENSOR_FRAMES]
            whole = np.full((TENSOR_FRAMES, MELS), np.log(FLOOR), np.float32)
            whole[: len(part)] = part
            yield at * self.seconds_per_frame, (at + len(part)) * self.seconds_per_frame, len(part), whole


def features(samples: bytes, rate: int = RATE) -> Features:
    """All features of one file.  Long files are resampled in stretches, so that memory stays near one float for each sample."""
    raw, parts = np.frombuffer(samples, np.uint8), []
    stretch, edge = _AT_ONCE * DOWN, TAPS * DOWN
    for at in range(0, max(1, len(raw)), stretch):
        lead = min(at, edge)
        x = (raw[at - lead : at + stretch + edge].astype(np.float32) - 128) / 128
        y = resample(x)
        parts.append(y[lead * UP // DOWN : lead * UP // DOWN + -(-min(stretch, len(raw) - at) * UP // DOWN)])
    y = parts[0] if len(parts) == 1 else np.concatenate(parts)
    new_rate = rate * UP / DOWN
    mel = log_mel(y, new_rate)
    return Features(mel, energy_segments(mel, HOP / new_rate), HOP / new_rate)


TENSOR = pa.fixed_shape_tensor(pa.float16(), (TENSOR_FRAMES, MELS), dim_names=["frame", "band"])
SPANS = pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64())]))
STORED = pa.schema([("start", pa.float64()), ("end", pa.float64()), ("frames", pa.int32()), ("mel", TENSOR), ("segments", SPANS)])


def store_tensors(f: Features) -> bytes:
    """An Arrow stream of one batch: a fixed-shape tensor (TENSOR_FRAMES x MELS, 16-bit floats) a row with the seconds it covers, its frames and
    the loud spans that meet it."""
    rows = list(f.tensors())
    flat = np.concatenate([whole.reshape(-1) for *_, whole in rows]).astype(np.float16)
    mel = pa.ExtensionArray.from_storage(TENSOR, pa.FixedSizeListArray.from_arrays(pa.array(flat), TENSOR_FRAMES * MELS))
    spans = [[{"start": a, "end": b} for a, b in f.segments if a < end and b > start] for start, end, _, _ in rows]
    columns = [pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.int32()), mel, pa.array(spans, SPANS)]
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, STORED) as out:
        out.write_batch(pa.RecordBatch.from_arrays(columns, schema=STORED))
    return sink.getvalue().to_pybytes()


def load_tensors(data: bytes) -> pa.RecordBatch:
    """What store_tensors wrote; its tensors are views of `data`."""
    batch = pa.ipc.open_stream(data).read_next_batch()
    if batch.schema.field("mel").type != TENSOR:
        raise ValueError("not a stream of these tensors")
    return batch


def digest(stored: pa.RecordBatch) -> str:
    """A short text, equal for equal stored features: counts, loud seconds, mean energy and a hash of energies, times and spans."""
    frames = stored.column("frames").to_numpy()
    mel = stored.column("mel").to_numpy_ndarray()
    held = np.concatenate([m[:n] for m, n in zip(mel, frames)])
    segments = sorted({(x["start"], x["end"]) for row in stored.column("segments").to_pylist() for x in row})
    whole = hashlib.sha256(held.astype("<f2").tobytes())
    whole.update(repr((segments, stored.column("start").to_pylist(), stored.column("end").to_pylist())).encode())
    loud = sum(b - a for a, b in segments)
    return f"frames={len(held)};tensors={len(mel)};segments={len(segments)};loud={loud:.3f};mean={held.astype(np.float64).mean():.2f};{whole.hexdigest()[:32]}"


def _encode(batches):
    for batch in sliced(batches, "text"):
        texts = batch.column("text").to_pylist()
        files = [wav_bytes(padded(t)) for t in texts]
        sizes = [len((t or "").encode("utf-8")) for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], names=["id", "n_bytes", "media"])


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_bytes, media): each text as a WAV file whose samples are its padded UTF-8 bytes.  Null counts as empty; every row, repeated or not,
    has its file; other columns are ignored; an empty table gives an empty result."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(_encode, T.StructType([source.schema["id"], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())]))


def _tensors(batches):
    for batch in sliced(batches, "media", 200):
        rows = {k: [] for k in ("row", "tensor_no", "start", "end", "frames", "mel", "segments")}
        for row, media in enumerate(batch.column("media").to_pylist()):
            if media is None:
                continue
            f = features(*wav_samples(media))
            for i, (start, end, frames, whole) in enumerate(f.tensors()):
                inside = [{"start": a, "end": b} for a, b in f.segments if a < end and b > start]
                for k, v in zip(rows, (row, i, start, end, frames, whole.reshape(-1), inside)):
                    rows[k].append(v)
        mel = pa.ListArray.from_arrays(pa.array(np.arange(len(rows["mel"]) + 1) * TENSOR_FRAMES * MELS, pa.int32()), pa.array(np.concatenate(rows["mel"]) if rows["mel"] else np.empty(0, np.float32)))
        span = pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64())]))
        yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows["row"], pa.int64())), pa.array(rows["tensor_no"], pa.int32()), pa.array(rows["start"], pa.float64()), pa.array(rows["end"], pa.float64()), pa.array(rows["frames"], pa.int32()), mel, pa.array(rows["segments"], span)], names=["id", "tensor_no", "start", "end", "frames", "mel", "segments"])


def audio_tensors(media: DataFrame) -> DataFrame:
    """Rows (id, tensor_no, start, end, frames, mel, segments) from WAV files (id, media): mel is a TENSOR_FRAMES x MELS tensor, row by row, that
    covers the seconds start to end; segments are the loud spans that meet it.  Null media has no rows; a damaged file raises; repeated ids are
    files of their own."""
    span = T.ArrayType(T.StructType([T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType())]))
    schema = T.StructType([media.schema["id"], T.StructField("tensor_no", T.IntegerType()), T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType()), T.StructField("frames", T.IntegerType()), T.StructField("mel", T.ArrayType(T.FloatType())), T.StructField("segments", span)])
    return media.select("id", "media").mapInArrow(_tensors, schema)


def as_tensor_array(mel: pa.Array) -> pa.ExtensionArray:
    """The mel column of audio_tensors, read with pyarrow, as Arrow's fixed-shape tensors without a copy of the numbers."""
    flat = mel.combine_chunks() if isinstance(mel, pa.ChunkedArray) else mel
    kind = pa.fixed_shape_tensor(pa.float32(), (TENSOR_FRAMES, MELS))
    return pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(flat.flatten().cast(pa.float32()), TENSOR_FRAMES * MELS))


def _stored(batches):
    names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "tensors")
    for batch in sliced(batches, "media", 200):
        out = {k: [] for k in names}
        for media in batch.column("media").to_pylist():
            samples, rate = wav_samples(media)
            for k, v in zip(names, (len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(media), hashlib.sha256(media).hexdigest(), store_tensors(features(samples, rate)))):
                out[k].append(v)
        kinds = {"payload_sha256": pa.string(), "media_sha256": pa.string(), "tensors": pa.binary()}
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), *(pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items())], names=["id", "n_bytes", *names])


def _features(batches):
    for batch in sliced(batches, "tensors"):
        feature = [digest(load_tensors(x)) for x in batch.column("tensors").to_pylist()]
        kept = [n for n in batch.schema.names if n != "tensors"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(feature, pa.string())], names=[*kept, "feature"])


def stored_tensors(media: DataFrame) -> DataFrame:
    """Rows (id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, tensors) of WAV files (id, n_bytes, media): what
    each file holds, and its features as an Arrow stream of fixed-shape tensors with time spans (see store_tensors).

    Ids may be null or repeated: rows come out as they come in.  media must not be null (a text that is null has a file of one padded block); other columns are
    ignored; an empty table gives an empty result."""
    numbers = ("payload_bytes", "tail_crc32", "media_bytes")
    names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")
    fields = [T.StructField(k, T.LongType() if k in numbers else T.StringType()) for k in names]
    return media.mapInArrow(_stored, T.StructType([media.schema["id"], media.schema["n_bytes"], *fields, T.StructField("tensors", T.BinaryType())]))


def media_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every text as a WAV file in a table of the shared folder, reads the files back, stores their features as tensors in a second table and
    returns one row each from that: id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature (see digest).

    Nulls, repeats, other columns and empty tables as text_media."""
    stored = settled(stored_tensors(settled(text_media(docs, id_col, text_col), "media")), "tensors")
    schema = T.StructType([f for f in stored.schema.fields if f.name != "tensors"] + [T.StructField("feature", T.StringType())])
    return stored.mapInArrow(_features, schema).withColumnRenamed("id", id_col)
