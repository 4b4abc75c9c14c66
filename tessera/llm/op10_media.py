"""Audio features of media columns.

A text's UTF-8 bytes, padded with zero bytes to a positive multiple of 64, are kept as the samples
of an 8-bit mono WAV file. The files are stored as a binary column of a Parquet table, read back,
and the samples found there are resampled by a polyphase filter, cut into overlapped frames, turned
into log-mel energies, and segmented by energy with hysteresis (a segment starts above the upper
threshold and lasts until the energy falls below the lower one).

``audio_features`` keeps the log-mel frames as fixed-shape Arrow tensors (blocks of
``BLOCK_FRAMES`` x ``MELS``, the last one padded with zeros) with the time span of each block, and
the segments' spans. The query stores these and makes its ``feature`` from the tensors and spans that
it reads back. A recording of hours is worked through in runs of frames, so memory stays bounded by
one recording's samples and its small feature matrix.

Defined results: null and empty texts become 64 zero samples; equal texts give equal values; a
repeated row is worked as often as it occurs; an empty table gives an empty result; other columns
of the input are not read; an unreadable recording gives null features.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .shared import arrow_of, id_and_text, read, slices, stored

RATE = 16_000
UP, DOWN = 5, 8  # five phases: 16 kHz to 10 kHz
TAPS = 8  # of each phase
FRAME, HOP = 256, 128
MELS = 20
BLOCK_FRAMES = 32
RUN_FRAMES = 4096  # frames transformed at once
RISE, FALL = 0.5, 0.25  # thresholds above the mean, in standard deviations
SLICE_BYTES = 4 << 20
FLOOR = np.float32(1e-10)


def pad64(raw: bytes) -> bytes:
    return raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))


def wav(payload: bytes, rate: int = RATE) -> bytes:
    """An 8-bit mono PCM WAV file; its samples are the payload's bytes."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload


def wav_samples(media: bytes) -> tuple[int, bytes]:
    """Sample rate and the data chunk of an 8-bit mono WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        kind, size = struct.unpack_from("<4sI", media, at)
        if kind == b"fmt ":
            coding, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (coding, channels, bits) != (1, 1, 8):
                raise ValueError("only 8-bit mono PCM is read")
        elif kind == b"data":
            return rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def lowpass(up: int, down: int, taps: int) -> np.ndarray:
    """Hann-windowed sinc, ``taps`` for each of the ``up`` phases, with gain ``up``."""
    n = up * taps
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(up, down)) * np.hanning(n + 2)[1:-1]
    return (h * up / h.sum()).astype(np.float32)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, taps: int = TAPS * max(1, DOWN // UP)) -> np.ndarray:
    """Polyphase resampling by up/down: phase p filters the input with every up-th tap from p on."""
    h, total = lowpass(up, down, taps), -(-len(x) * up // down)
    padded = np.concatenate([np.zeros(taps - 1, np.float32), x.astype(np.float32), np.zeros(1, np.float32)])
    y = np.zeros(total, np.float32)
    for r in range(min(up, total)):  # outputs r, r + up, ... share a phase
        phase, first = (r * down) % up, (r * down) // up
        m = len(y[r::up])
        part = np.zeros(m, np.float32)
        for k, tap in enumerate(h[phase::up]):
            at = taps - 1 + first - k
            part += tap * padded[at : at + (m - 1) * down + 1 : down]
        y[r::up] = part
    return y


def mel_bank(rate: float, frame: int = FRAME, mels: int = MELS) -> np.ndarray:
    """Triangular filters, evenly spaced on the mel scale, as (bins, mels)."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(0), mel(rate / 2), mels + 2) / 2595) - 1)
    bins = np.fft.rfftfreq(frame, 1 / rate)[:, None]
    rise, fall = (bins - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - bins) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


_WINDOW = np.hanning(FRAME).astype(np.float32)
_BANKS: dict[float, np.ndarray] = {}


def log_mel(y: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel energies (frames, mels) and log energy of each frame."""
    bank = _BANKS.setdefault(rate, mel_bank(rate))
    n = max(1, -(-max(len(y) - FRAME, 0) // HOP) + 1)
    y = np.concatenate([y, np.zeros((n - 1) * HOP + FRAME - len(y), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
    out, energy = np.empty((n, MELS), np.float32), np.empty(n, np.float32)
    for at in range(0, n, RUN_FRAMES):
        spectrum = np.fft.rfft(frames[at : at + RUN_FRAMES] * _WINDOW, axis=1)
        power = spectrum.real**2 + spectrum.imag**2
        out[at : at + RUN_FRAMES] = np.log(power @ bank + FLOOR)
        energy[at : at + RUN_FRAMES] = np.log(power.sum(axis=1) + FLOOR)
    return out, energy


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Frame ranges [a, b) that start above the upper threshold and end below the lower one."""
    mean, spread = energy.mean(dtype=np.float64), energy.std(dtype=np.float64)
    mark = np.where(energy > mean + RISE * spread, 1, np.where(energy < mean + FALL * spread, -1, 0))
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = np.concatenate([[False], (last >= 0) & (mark[last] == 1), [False]])
    edges = np.flatnonzero(on[1:] != on[:-1])
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def features(media: bytes) -> dict:
    rate, samples = wav_samples(media)
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    y, rate = resample(x), rate * UP / DOWN
    mel, energy = log_mel(y, rate)
    spans = [(a * HOP / rate, ((b - 1) * HOP + FRAME) / rate) for a, b in segments(energy)]
    return {"mel": mel, "rate": rate, "segments": spans, "samples": samples}


def tensor_blocks(mel: np.ndarray, rate: float) -> pa.RecordBatch:
    """Fixed-shape tensors of BLOCK_FRAMES x MELS with their time spans and numbers of real frames."""
    n = -(-len(mel) // BLOCK_FRAMES)
    whole = np.zeros((n, BLOCK_FRAMES, MELS), np.float32)
    whole.reshape(-1, MELS)[: len(mel)] = mel
    first = np.arange(n) * BLOCK_FRAMES
    real = np.minimum(BLOCK_FRAMES, len(mel) - first)
    columns = [pa.FixedShapeTensorArray.from_numpy_ndarray(whole), pa.array(first * HOP / rate), pa.array(((first + real - 1) * HOP + FRAME) / rate), pa.array(real.astype(np.int32))]
    return pa.record_batch(columns, names=["log_mel", "start_s", "end_s", "frames"])


def as_ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_ipc(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(raw).read_all()


def text_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the WAV file of each text."""
    ddl = "doc_id long, n_bytes long, media binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_of(ddl)
        for b in slices(batches, "text", SLICE_BYTES):
            raw = [x.encode() for x in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), pa.array([len(x) for x in raw], pa.int64()), pa.array([wav(pad64(x)) for x in raw], pa.binary())], schema=schema)

    return id_and_text(docs).mapInArrow(run, ddl)


def audio_features(media: DataFrame) -> DataFrame:
    """Digests of a media column, its log-mel tensors with time spans (an Arrow stream), and its segments."""
    ddl = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, tensors binary, segment_start_s array<double>, segment_end_s array<double>"

    def row(media: bytes | None) -> list:
        try:
            f = features(media or b"")
        except ValueError:
            return [None] * 8
        payload, spans = f["samples"], f["segments"]
        digests = [len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest()]
        return [*digests, as_ipc(tensor_blocks(f["mel"], f["rate"])), [a for a, _ in spans], [b for _, b in spans]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_of(ddl)
        for b in slices(batches, "media", SLICE_BYTES):
            rows = [row(x) for x in b.column("media").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), b.column("n_bytes"), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types[2:], strict=True))], schema=schema)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, ddl)


def feature_strings(found: DataFrame) -> DataFrame:
    """The digests of ``audio_features`` and a short feature string, made from its tensors and spans.

    It holds the number of frames, the end of the last block, number and length of the segments, and
    each mel band's mean over the frames; it is null where the tensors are."""
    kept = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"]

    def words(raw: bytes, starts: list[float], ends: list[float]) -> str:
        blocks = from_ipc(raw).combine_chunks()
        real = blocks["frames"].to_numpy()
        mel = blocks["log_mel"].combine_chunks().to_numpy_ndarray().reshape(-1, BLOCK_FRAMES, MELS)
        mean = mel.sum(axis=(0, 1), dtype=np.float64) / real.sum()  # frames that pad a block are zero
        loud = sum(b - a for a, b in zip(starts, ends, strict=True))
        return f"frames={real.sum()};end_s={blocks['end_s'][-1].as_py():.4f};segments={len(starts)};loud_s={loud:.3f};mel=" + ",".join(f"{x:.2f}" for x in mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "tensors", SLICE_BYTES):
            made = [None if x is None else words(x, a, z) for x, a, z in zip(*(b.column(c).to_pylist() for c in ("tensors", "segment_start_s", "segment_end_s")), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(made, pa.string())], names=[*kept, "feature"])

    types = {f.name: f for f in found.schema.fields}
    return found.mapInArrow(run, T.StructType([*(types[c] for c in kept), T.StructField("feature", T.StringType())]))


def op10_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = stored(text_media(read(spark, sf_dir, "documents")), "media")
    return feature_strings(stored(audio_features(media), "tensors"))
