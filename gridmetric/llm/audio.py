"""Audio features: 8-bit PCM in WAV, polyphase resampling, overlapped log-mel filterbanks and hysteresis energy segments.

Features of a clip are an Arrow table of fixed-shape tensors (frames x mels), one row per span, with its time span, as IPC bytes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridmetric.llm.common import numbered, pieces, quoted, table

RATE, UP, DOWN = 12_000, 2, 3
WINDOW, HOP, FFT, MELS, FRAMES = 400, 160, 512, 40, 64
UNIT = 192


def wav_bytes(samples: bytes, rate: int = RATE) -> bytes:
    """A mono WAV file of unsigned 8-bit samples (odd lengths get the pad byte that RIFF asks for)."""
    pad = b"\0" * (len(samples) % 2)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples + pad


def wav_samples(data: bytes) -> tuple[bytes, int]:
    """Samples and rate of a mono 8-bit PCM WAV file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, None
    while at + 8 <= len(data):
        name, size = struct.unpack_from("<4sI", data, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("only mono 8-bit PCM is read")
        elif name == b"data":
            return bytes(data[at + 8 : at + 8 + size]), rate
        at += 8 + size + size % 2
    raise ValueError("no samples")


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, taps_per_phase: int = 16) -> np.ndarray:
    """x at up/down of its rate, by a windowed-sinc low-pass in polyphase form: only kept outputs are computed, no zeros stuffed."""
    if len(x) == 0:
        return x.astype(np.float32)
    taps = taps_per_phase * up
    k = np.arange(taps) - taps // 2
    cut = 1 / max(up, down)
    h = (np.sinc(k * cut) * cut * np.hamming(taps) * up).astype(np.float32)
    n_out = -(-len(x) * up // down)
    half = taps_per_phase // 2
    padded = np.concatenate([np.zeros(half, np.float32), x.astype(np.float32), np.zeros(taps_per_phase + down, np.float32)])
    out = np.empty(n_out, np.float32)
    view = np.lib.stride_tricks.sliding_window_view(padded, taps_per_phase)
    for first in range(up):  # outputs first, first + up, ... share a phase and step by down inputs
        at = first * down
        phase, begin = at % up, at // up
        n = len(range(first, n_out, up))
        out[first::up] = view[begin + 1 :: down][:n] @ np.ascontiguousarray(h[phase::up][::-1])
    return out


def _mel_bank(rate: float, n_fft: int = FFT, mels: int = MELS) -> np.ndarray:
    """Triangular filters, even on the mel scale from 0 to half the rate."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, mels + 2) / 2595) - 1)
    f = np.arange(n_fft // 2 + 1) * rate / n_fft
    left, mid, right = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.maximum(0, np.minimum((f - left) / (mid - left), (right - f) / (right - mid))).T.astype(np.float32)


_banks: dict[float, np.ndarray] = {}
_HANN = np.hanning(WINDOW).astype(np.float32)


def log_mel(x: np.ndarray, rate: float) -> np.ndarray:
    """Log-mel energies of overlapped windows; zeros are added at the end so that each sample lies in a frame."""
    if rate not in _banks:
        _banks[rate] = _mel_bank(rate)
    whole = WINDOW + max(0, -(-(len(x) - WINDOW) // HOP)) * HOP
    x = np.concatenate([x, np.zeros(whole - len(x), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(x, WINDOW)[::HOP]
    parts = []
    for k in range(0, len(frames), 1024):  # blocks bound the memory of a very long clip
        power = np.abs(np.fft.rfft(frames[k : k + 1024] * _HANN, FFT)).astype(np.float32) ** 2
        parts.append(np.log(power @ _banks[rate] + np.float32(1e-6)))
    return np.concatenate(parts)


def segments(energy: np.ndarray, high: float = 0.6, low: float = 0.4) -> list[tuple[int, int]]:
    """Runs of frames that stay above the low level and reach the high one; levels are shares of the clip's energy range."""
    span = energy.max() - energy.min()
    if span <= 0:
        return [(0, len(energy))]
    level = (energy - energy.min()) / span
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (level >= low).astype(np.int8), [0]])))
    return [(a, b) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()) if level[a:b].max() >= high]


def features(samples: bytes, rate: int) -> tuple[pa.Table, list[tuple[float, float]]]:
    """Fixed-shape tensors with time spans, and the spans of the active segments in seconds."""
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    new_rate = rate * UP / DOWN
    mel = log_mel(resample(x), new_rate)
    n = -(-len(mel) // FRAMES)
    padded = np.concatenate([mel, np.full((n * FRAMES - len(mel), MELS), np.log(np.float32(1e-6)), np.float32)]).reshape(n, FRAMES, MELS)
    tensors = pa.FixedShapeTensorArray.from_numpy_ndarray(padded)
    begin = np.arange(n) * FRAMES * HOP / new_rate
    stop = np.minimum(begin + ((FRAMES - 1) * HOP + WINDOW) / new_rate, len(x) / rate)
    spans = [(a * HOP / new_rate, min(((b - 1) * HOP + WINDOW) / new_rate, len(x) / rate)) for a, b in segments(mel.mean(axis=1))]
    return pa.table({"start_s": begin, "stop_s": stop, "log_mel": tensors}), spans


def ipc_bytes(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes()


def digest(t: pa.Table, spans: list[tuple[float, float]]) -> str:
    """A short text of features: frames' tensors, segments, and a hash of the values rounded to eighths."""
    values = np.round(t["log_mel"].combine_chunks().to_numpy_ndarray().astype(np.float64) * 8).astype("<i2")
    return f"{len(t)}x{FRAMES}x{MELS};{len(spans)};{hashlib.sha256(values.tobytes() + repr([(round(a, 3), round(b, 3)) for a, b in spans]).encode()).hexdigest()[:32]}"


def store_audio(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes and media: each text's bytes, padded with spaces to a positive multiple of 192, as 8-bit samples of a WAV.

    A null text is the empty one, which is 192 spaces. Texts are whole, of any length; rows stand alone, so repeated rows,
    ties and further columns change nothing; an empty table gives an empty one.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in pieces(batches, "text"):
            raw = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column("text")]
            media = [wav_bytes(x + b" " * (max(UNIT, -(-len(x) // UNIT) * UNIT) - len(x))) for x in raw]
            yield pa.record_batch({"id": batch.column("id"), "n_bytes": pa.array([len(x) for x in raw], pa.int64()), "media": pa.array(media, pa.binary())})

    return docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def audio_features(clips: DataFrame, media_col: str = "media", keep_tensors: bool = True) -> DataFrame:
    """Columns of clips besides payload_bytes, payload_sha256, tail_crc32 (of the samples read back), feature, spans and, with
    keep_tensors, tensors (Arrow IPC of fixed-shape tensors, read back for the feature).

    A null clip has null in all of them; an empty one has a single frame of silence. Columns of clips with one of these names are replaced. Clips
    may have any length; rows stand alone, so ties and repeated rows give equal values, and an empty table gives an empty one.
    """
    added = ["payload_bytes", "payload_sha256", "tail_crc32", "feature", "spans", "tensors"]
    clips = clips.drop(*added)
    source, media = numbered(clips), f"c{clips.columns.index(media_col)}"
    more = "payload_bytes long, payload_sha256 string, tail_crc32 long, feature string, spans array<struct<start_s: double, stop_s: double>>" + ", tensors binary" * keep_tensors
    schema = StructType([*source.schema.fields, *StructType.fromDDL(more).fields])
    span_type = pa.list_(pa.struct([("start_s", pa.float64()), ("stop_s", pa.float64())]))

    def run(batches):
        for batch in pieces(batches, media):
            rows = []
            for clip in batch.column(media):
                if not clip.is_valid:
                    rows.append((None,) * 6)
                    continue
                samples, rate = wav_samples(clip.as_py())
                t, spans = features(samples, rate)
                stored = ipc_bytes(t) if keep_tensors else None
                t = pa.ipc.open_stream(stored).read_all() if keep_tensors else t
                seconds = [{"start_s": a, "stop_s": b} for a, b in spans]
                rows.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), digest(t, spans), seconds, stored))
            cols = list(zip(*rows))
            arrays = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string()), pa.array(cols[4], span_type)]
            if keep_tensors:
                arrays.append(pa.array(cols[5], pa.binary()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *added[: len(arrays)]])

    return source.mapInArrow(run, schema).toDF(*clips.columns, *added[: 5 + keep_tensors])


def op2_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored bytes, their digests, features and the digest of the stored tensors of every document's text."""
    clips = store_audio(table(spark, sf_dir, "documents").select("doc_id", "text"))
    done = audio_features(clips)
    media = [F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256")]
    tensors = [F.length("tensors").cast("long").alias("tensor_bytes"), F.sha2("tensors", 256).alias("tensors_sha256")]
    return done.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", *media, "feature", F.size("spans").alias("n_segments"), *tensors)
