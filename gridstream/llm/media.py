"""Audio columns: bytes as 8-bit samples, and features over them.

``encode_media`` stores a payload as an uncompressed mono wave file in a binary
column; ``media_features`` reads the stored bytes back, resamples them with a
polyphase filter, takes overlapped log-mel frames, and finds active spans by
energy with hysteresis. Frames are stored as Arrow tensors of one fixed shape.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstream.llm.common import clash_free, give_back, ship

RATE = 8000
UP, DOWN = 2, 3
TAPS = 9
FRAME, HOP = 128, 64
MELS = 16
BLOCK = 32  # frames in a tensor
UNIT = 192
CHUNK = 1 << 16  # filter steps at once
STEP = HOP * DOWN / (RATE * UP)  # seconds a frame

TENSOR = pa.fixed_shape_tensor(pa.float16(), (BLOCK, MELS))  # half precision, in row order


def payload_of(text: str | None) -> bytes:
    """UTF-8 bytes, filled up with blanks to a positive multiple of UNIT."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (-len(raw) % UNIT if raw else UNIT)


def to_wave(payload: bytes) -> bytes:
    """A RIFF/WAVE file of unsigned 8-bit mono samples."""
    fmt = struct.pack("<HHIIHH", 1, 1, RATE, RATE, 1, 8)
    return b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", len(payload)) + payload


def from_wave(stored: bytes) -> bytes:
    """The samples of such a file, found by walking its chunks."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("not a wave file")
    at = 12
    while at + 8 <= len(stored):
        name, size = stored[at : at + 4], struct.unpack_from("<I", stored, at + 4)[0]
        if name == b"data":
            return stored[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def _filters() -> np.ndarray:
    """The polyphase branches, one column for each of the UP outputs of a step."""
    n = TAPS * UP
    t = np.arange(n) - (n - 1) / 2
    cut = 1.0 / max(UP, DOWN)
    h = np.sinc(cut * t) * cut * np.hamming(n) * UP
    out = np.zeros((TAPS + DOWN, UP))
    for m in range(UP):
        phase, first = (m * DOWN) % UP, (m * DOWN) // UP
        out[first : first + TAPS, m] = h[phase::UP][::-1]
    return out.astype(np.float32)


def _mel_bank() -> np.ndarray:
    rate = RATE * UP / DOWN
    mel = lambda f: 2595.0 * math.log10(1 + f / 700.0)
    edges = 700.0 * (10 ** (np.linspace(mel(40.0), mel(rate / 2), MELS + 2) / 2595.0) - 1)
    freq = np.arange(FRAME // 2 + 1) * rate / FRAME
    up = (freq[:, None] - edges[None, :-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[None, 2:] - freq[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


FILTERS, BANK = _filters(), _mel_bank()
HANN = np.hanning(FRAME + 1)[:-1].astype(np.float32)


def resample(samples: np.ndarray) -> np.ndarray:
    """UP/DOWN times as many samples; the input length is a multiple of DOWN.
    Unsigned 8-bit samples are taken as -1 to 1. Works in steps of bounded memory."""
    width, n = FILTERS.shape[0], len(samples) // DOWN
    out = np.empty((n, UP), np.float32)
    for a in range(0, n, CHUNK):
        k = min(CHUNK, n - a)
        begin = a * DOWN - TAPS // 2
        part = samples[max(0, begin) : begin + k * DOWN + width]
        padded = np.zeros(k * DOWN + width, np.float32)
        padded[max(0, -begin) : max(0, -begin) + len(part)] = (part.astype(np.float32) - 128) / 128 if part.dtype == np.uint8 else part
        windows = np.lib.stride_tricks.as_strided(padded, (k, width), (4 * DOWN, 4))
        out[a : a + k] = windows @ FILTERS
    return out.reshape(-1)


def log_mel(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel frames (half overlapped, the end filled with silence) and each frame's energy in dB."""
    padded = np.zeros(len(samples) + FRAME - HOP, np.float32)
    padded[: len(samples)] = samples
    n = len(samples) // HOP
    mels, power = [], []
    for a in range(0, n, 4096):  # bounds the memory of very long payloads
        k = min(4096, n - a)
        frames = np.lib.stride_tricks.as_strided(padded[a * HOP :], (k, FRAME), (4 * HOP, 4)) * HANN
        spectrum = np.fft.rfft(frames, axis=1)
        energy = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        mels.append(np.log(energy @ BANK + np.float32(1e-6)))
        power.append(10 * np.log10(np.einsum("ij,ij->i", frames, frames) / FRAME + 1e-9))
    return np.concatenate(mels), np.concatenate(power)


def segments(power: np.ndarray, above: float = 0.5, below: float = 0.25) -> list[tuple[int, int]]:
    """Half-open frame spans that begin over the mean plus ``above`` deviations
    and end under the mean minus ``below`` deviations."""
    mean, dev = float(power.mean()), float(power.std())
    mark = np.where(power > mean + above * dev, 1, np.where(power < mean - below * dev, -1, 0))
    known = np.maximum.accumulate(np.where(mark != 0, np.arange(1, len(mark) + 1), 0))
    on = np.concatenate([[0], np.where(known > 0, np.concatenate([[0], mark])[known] > 0, 0), [0]])
    edges = np.diff(on)
    return list(zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True))


def features(payload: bytes) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Log-mel frames (in half precision, as they are stored), their energy and the active spans of one payload."""
    mel, power = log_mel(resample(np.frombuffer(payload, np.uint8)))
    return mel.astype(np.float16), power, segments(power)


@clash_free
def encode_media(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """Add the stored wave file of each text as a binary column.

    A null or empty text is UNIT blanks. Rows are handled alone and all stay;
    an input column named like the result is replaced.
    """
    ship(docs.sparkSession)

    @F.pandas_udf("binary")
    def wave(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([to_wave(payload_of(x)) for x in batch], dtype=object)

    return docs.withColumn(media, wave(F.col(text)))


PAYLOAD_KINDS = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"
FEATURE_KINDS = "feature string, frames long, active_s double"
DIGEST_KINDS = f"{PAYLOAD_KINDS}, {FEATURE_KINDS}"
PAYLOAD, FEATURE, DIGEST = ([x.split()[0] for x in kinds.split(", ")] for kinds in (PAYLOAD_KINDS, FEATURE_KINDS, DIGEST_KINDS))


def _payload_digest(stored: bytes | None) -> tuple:
    if stored is None:
        return (None,) * len(PAYLOAD)
    payload = from_wave(stored)
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest()


def _described(mel: np.ndarray, spans: list[tuple[int, int]]) -> tuple[str, int, float]:
    active = sum(b - a for a, b in spans)
    mean = ",".join(f"{x:.2f}" for x in mel.mean(axis=0, dtype=np.float64) + 0.0)
    return f"frames={len(mel)};segments={len(spans)};active={active};mel={mean}", len(mel), active * HOP * DOWN / (RATE * UP)


@clash_free
def payload_digest(docs: DataFrame, media: str = "media") -> DataFrame:
    """Add digests of the stored file and of the payload read back from it. A null
    file gives nulls; every row stays, and input columns named like results are replaced."""
    ship(docs.sparkSession)

    @F.pandas_udf(PAYLOAD_KINDS)
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([_payload_digest(x) for x in batch], columns=PAYLOAD)

    rest = [c for c in docs.columns if c not in PAYLOAD]
    return docs.select(*rest, digest(F.col(media)).alias("_d")).select(*rest, "_d.*")


@clash_free
def media_digest(docs: DataFrame, media: str = "media") -> DataFrame:
    """Add digests of the stored file, of the payload read back from it, and of
    its features. A null file gives nulls; every row stays, equal files give
    equal values, and input columns named like results are replaced."""
    ship(docs.sparkSession)

    @F.pandas_udf(DIGEST_KINDS)
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for stored in batch:
                found = (None,) * len(FEATURE)
                if stored is not None:
                    mel, _, spans = features(from_wave(stored))
                    found = _described(mel, spans)
                rows.append((*_payload_digest(stored), *found))
            yield pd.DataFrame(rows, columns=DIGEST)

    rest = [c for c in docs.columns if c != media and c not in DIGEST]
    return docs.select(*rest, digest(F.col(media)).alias("_d")).select(*rest, "_d.*")


def _blocks(stored: bytes) -> tuple[np.ndarray, list[int], list[list[list[float]]]]:
    """Log-mel frames of a file in blocks of (BLOCK, MELS), the last filled with
    zeros; frames of each block and the active spans in it (seconds)."""
    mel, _, spans = features(from_wave(stored))
    n = -(-len(mel) // BLOCK)
    full = np.zeros((n * BLOCK, MELS), np.float16)
    full[: len(mel)] = mel
    sizes = [min(BLOCK, len(mel) - i * BLOCK) for i in range(n)]
    inside: list[list[list[float]]] = [[] for _ in range(n)]
    for a, b in spans:
        for i in range(a // BLOCK, (b - 1) // BLOCK + 1):
            inside[i].append([max(a, i * BLOCK) * STEP, min(b, (i + 1) * BLOCK) * STEP])
    return full.reshape(n, BLOCK, MELS), sizes, inside


SPANS = "array<struct<start_s: double, end_s: double, n_frames: long, active: array<array<double>>>>"


def _tensors(values: np.ndarray) -> pa.Array:
    """Half-precision values as an Arrow array of the fixed-shape tensor type."""
    return pa.ExtensionArray.from_storage(TENSOR, pa.FixedSizeListArray.from_arrays(pa.array(values.reshape(-1)), BLOCK * MELS))


def to_cell(blocks: np.ndarray) -> bytes:
    """Tensors as an Arrow stream, whose schema names their type and shape."""
    batch = pa.RecordBatch.from_arrays([_tensors(blocks)], ["mel"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_cell(cell: bytes) -> np.ndarray:
    """The tensors of such a stream, as an array of (blocks, BLOCK, MELS)."""
    with pa.ipc.open_stream(cell) as stream:
        column = stream.read_all()["mel"]
    if column.type != TENSOR:
        raise ValueError(f"tensors of another type: {column.type}")
    return column.combine_chunks().storage.flatten().to_numpy().reshape(-1, BLOCK, MELS)


@clash_free
def with_tensors(docs: DataFrame, media: str = "media", tensors: str = "tensors") -> DataFrame:
    """Add the tensors of each file as a struct: ``spans``, per block start_s, end_s,
    n_frames and active as in ``media_tensors``, and ``mel``, the blocks' tensors as an
    Arrow stream of one column of the fixed-shape tensor type (see ``to_cell``). A null
    file has none; an input column named like the result is replaced."""
    ship(docs.sparkSession)
    docs = docs.drop(tensors)
    k = docs.columns.index(media)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 100):  # tensors are as large as their files
                batch = whole.slice(at, 100)
                offsets, cells, starts, ends, sizes, active = [0], [], [], [], [], []
                for stored in batch.column(k):
                    cells.append(None)
                    if stored.is_valid:
                        blocks, frames, inside = _blocks(stored.as_py())
                        cells[-1] = to_cell(blocks)
                        starts += [i * BLOCK * STEP for i in range(len(frames))]
                        ends += [(i * BLOCK + x) * STEP for i, x in enumerate(frames)]
                        sizes += frames
                        active += inside
                    offsets.append(len(sizes))
                block = pa.StructArray.from_arrays(
                    [pa.array(starts, pa.float64()), pa.array(ends, pa.float64()), pa.array(sizes, pa.int64()), pa.array(active, pa.list_(pa.list_(pa.float64())))],
                    ["start_s", "end_s", "n_frames", "active"],
                )
                mask = batch.column(k).is_null() if batch.column(k).null_count else None
                spans = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), block, mask=mask)
                both = pa.StructArray.from_arrays([spans, pa.array(cells, pa.binary())], ["spans", "mel"], mask=mask)
                yield pa.RecordBatch.from_arrays([*batch.columns, both], [*batch.schema.names, tensors])
        give_back()

    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return docs.mapInArrow(add, f"{kinds}, `{tensors}` struct<spans: {SPANS}, mel: binary>")


@clash_free
def tensor_features(docs: DataFrame, tensors: str = "tensors") -> DataFrame:
    """Replace stored tensors by the features that they hold (those of ``media_digest``).
    Null tensors give nulls; input columns named like results are replaced."""
    ship(docs.sparkSession)

    @F.pandas_udf(FEATURE_KINDS)
    def describe(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for cells, sizes, active in batches:
            rows = []
            for cell, frames, inside in zip(cells, sizes, active, strict=True):
                if cell is None:
                    rows.append((None,) * len(FEATURE))
                    continue
                mel = from_cell(cell).reshape(-1, MELS)[: int(sum(frames))]
                spans: list[tuple[int, int]] = []
                for a, b in ((round(x[0] / STEP), round(x[1] / STEP)) for block in inside for x in block):
                    if spans and spans[-1][1] == a:
                        a = spans.pop()[0]  # goes on across the edge of a block
                    spans.append((a, b))
                rows.append(_described(mel, spans))
            yield pd.DataFrame(rows, columns=FEATURE)

    rest = [c for c in docs.columns if c != tensors and c not in FEATURE]
    t = F.col(tensors)
    found = describe(t["mel"], t["spans"]["n_frames"], t["spans"]["active"])
    return docs.select(*rest, found.alias("_d")).select(*rest, "_d.*")


@clash_free
def stored_digest(docs: DataFrame, media: str = "media", tensors: str = "tensors") -> DataFrame:
    """The columns of ``media_digest``, its features taken from stored tensors
    instead of being computed again; both columns are left out, and input columns
    named like results."""
    kept = docs.drop(*FEATURE)
    return tensor_features(payload_digest(kept, media).drop(media), tensors)


def media_tensors(docs: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """One row per block of BLOCK frames: key, block, start_s, end_s, n_frames,
    active spans inside the block (seconds) and ``mel``, the half-precision
    values of a (BLOCK, MELS) tensor in row order, the last block filled with
    zeros. ``tensor_column`` gives the Arrow tensor of such a column. Null files
    give no row, repeated rows their blocks each; other columns are left out."""

    @F.pandas_udf("array<binary>")
    def cells(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if x is None else [b.tobytes() for b in from_cell(x)] for x in batch], dtype=object)

    stored = with_tensors(docs.select(F.col(key).alias("key"), F.col(media).alias("_media")), "_media", "_tensors")
    both = F.arrays_zip(F.col("_tensors.spans").alias("span"), cells("_tensors.mel").alias("mel"))
    blocks = stored.where(F.col("_tensors").isNotNull()).select("key", F.posexplode(both).alias("block", "_t"))
    return blocks.select("key", F.col("block").cast("long").alias("block"), "_t.span.*", "_t.mel")


def tensor_column(mel: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A collected ``mel`` column as an Arrow array of the fixed-shape tensor type."""
    return _tensors(np.frombuffer(b"".join(mel.to_pylist()), np.float16))
