"""Telephony audio: G.711 mu-law and A-law, IMA ADPCM blocks, resampling, and WAVE storage.

Decoders work on numpy arrays: companded bytes through 256-entry tables, ADPCM across all blocks of
many files at once (one step a sample position, every block in parallel).  ``store`` keeps payloads as
WAVE bytes in a table in the shared folder: as mu-law or A-law samples or as the codes of ADPCM blocks, by the
payload's CRC-32 modulo 3.  ``resampled`` reads them back, expands and resamples them and stores 16-bit PCM;
``describe`` takes the features from the PCM that was stored.

* A null text counts as empty; an empty payload is padded to one unit of 64 bytes.
* Equal texts give equal values; repeated rows are stored each.  A null doc_id keeps its row.
* Very long texts: a WAVE file states lengths in 32 bits, so a payload of 4 GiB is refused (a Spark
  string holds at most 2 GiB).  Work is done ``SLICE`` samples or blocks at a time; what is held of a text is
  its bytes, its file and its 16-bit samples.
* Other columns of the input are not read, whatever their names; an empty table gives no row.

Scale: nothing is shuffled; ``described`` does a part of the documents at a time, to halve the disk that it takes;
memory is one Arrow batch and the samples of ``GROUP`` bytes or one longer text.
PCM is stored at ``STORED_RATE`` (a parameter of ``resampled``): below the source's rate samples are averaged
over the target's period, above it interpolated.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import appended, fresh, remove, staged, utf8

UNIT = 64
RATE = 8000  # samples a second, of the telephone network
STORED_RATE = 4000
MULAW, ALAW, IMA, PCM = 7, 6, 17, 1  # WAVE format tags
BLOCK = 4 + UNIT  # an ADPCM block: its header and a unit of codes
SLICE = 1 << 16
GROUP = 1 << 20  # payload bytes of files that are decoded together


def mulaw_table() -> np.ndarray:
    """16-bit samples of the 256 mu-law codes (ITU-T G.711): inverted bits, sign, exponent, mantissa."""
    code = ~np.arange(256) & 0xFF
    magnitude = (((code & 0x0F) << 3) + 0x84 << ((code >> 4) & 7)) - 0x84
    return np.where(code & 0x80, -magnitude, magnitude).astype(np.int16)


def alaw_table() -> np.ndarray:
    """16-bit samples of the 256 A-law codes (ITU-T G.711): even bits inverted, linear lowest segment."""
    code = np.arange(256) ^ 0x55
    segment, step = (code >> 4) & 7, ((code & 0x0F) << 4) + 8
    magnitude = np.where(segment == 0, step, (step + 0x100) << np.maximum(segment - 1, 0))
    return np.where(code & 0x80, magnitude, -magnitude).astype(np.int16)


MULAW_PCM, ALAW_PCM = mulaw_table(), alaw_table()

#: Fixed values of IMA ADPCM: the quantiser's steps, and the change of the step's index by code.
STEPS = np.array(
    [
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143,
        157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411,
        1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442,
        11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ],
    np.int32,
)
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)


def ima_decode(blocks: np.ndarray) -> np.ndarray:
    """Mono IMA ADPCM: rows of bytes (int16 first sample, index, 0, then codes low nibble first) to rows of samples."""
    blocks = np.ascontiguousarray(blocks, np.uint8)
    count, size = blocks.shape
    if size < 4:
        raise ValueError("a block has a header of four bytes")
    out = np.empty((count, 2 * (size - 4) + 1), np.int16)
    step = max(1, SLICE // size)
    for at in range(0, count, step):
        out[at : at + step] = _ima_slice(blocks[at : at + step])
    return out


def _ima_slice(blocks: np.ndarray) -> np.ndarray:
    count, size = blocks.shape
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), len(STEPS) - 1)
    codes = np.empty((2 * (size - 4), count), np.int32)
    codes[::2], codes[1::2] = (blocks[:, 4:] & 15).T, (blocks[:, 4:] >> 4).T
    out = np.empty((len(codes) + 1, count), np.int16)
    out[0] = value
    for k, code in enumerate(codes):  # a sample position at a time, across the blocks
        step = STEPS[index]
        change = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        value = np.clip(value + np.where(code & 8, -change, change), -32768, 32767)
        index = np.clip(index + INDEX_CHANGE[code], 0, len(STEPS) - 1)
        out[k + 1] = value
    return out.T


def resample(samples: np.ndarray, source: int, target: int) -> np.ndarray:
    """Whole-number resampling.

    Up: linear interpolation, sample k of the target standing at k * source / target.  Down: the mean, rounded
    down, of the source over the time from k / target to (k + 1) / target.
    """
    n = len(samples)
    out = np.empty(n * target // source, np.int16)
    for low in range(0, len(out), SLICE):
        k = np.arange(low, min(low + SLICE, len(out)), dtype=np.int64)
        first = int(k[0]) * source // target
        x = samples[first : min(n, (int(k[-1]) + 1) * source // target + 2)].astype(np.int64)
        if target >= source:
            left, part = k * source // target - first, k * source % target
            out[low : low + len(k)] = (x[left] * (target - part) + x[np.minimum(left + 1, len(x) - 1)] * part) // target
        else:
            sums = np.concatenate([[0], np.cumsum(x)])
            x = np.append(x, 0)
            edge = np.append(k, k[-1] + 1) * source
            whole = edge // target - first
            out[low : low + len(k)] = np.diff(sums[whole] * target + x[whole] * (edge % target)) // source
    return out


def wave(tag: int, data: bytes, rate: int = RATE, align: int = 1, extra: bytes = b"") -> bytes:
    """A mono RIFF WAVE file of the data."""
    bits = {MULAW: 8, ALAW: 8, IMA: 4, PCM: 16}[tag]
    form = struct.pack("<HHIIHHH", tag, 1, rate, rate * align, align, bits, len(extra)) + extra
    fact = b"" if tag == PCM else b"fact" + struct.pack("<II", 4, len(data) if tag != IMA else len(data) // align * ((align - 4) * 2 + 1))
    pad = b"\0" * (len(data) % 2)
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + fact + b"data" + struct.pack("<I", len(data)) + data + pad
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse_wave(media: bytes) -> tuple[int, int, int, memoryview]:
    """(format tag, rate, block size, data) of a WAVE file."""
    view = memoryview(media)
    if view[:4] != b"RIFF" or view[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, form = 12, None
    while at + 8 <= len(view):
        kind, size = bytes(view[at : at + 4]), struct.unpack("<I", view[at + 4 : at + 8])[0]
        if kind == b"fmt ":
            form = struct.unpack("<HHIIHH", view[at + 8 : at + 24])
        elif kind == b"data":
            if form is None:
                raise ValueError("data before its format")
            return form[0], form[2], form[4], view[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data")


def decode(media: bytes) -> tuple[np.ndarray, int]:
    """16-bit samples and rate of a mono WAVE file of any of the four formats."""
    tag, rate, align, data = parse_wave(media)
    codes = np.frombuffer(data, np.uint8)
    if tag == MULAW:
        return MULAW_PCM[codes], rate
    if tag == ALAW:
        return ALAW_PCM[codes], rate
    if tag == IMA:
        return ima_decode(codes[: len(codes) // align * align].reshape(-1, align)).ravel(), rate
    if tag == PCM:
        return codes[: len(codes) // 2 * 2].view("<i2"), rate
    raise ValueError(f"unknown format {tag}")


def features(samples: np.ndarray) -> str:
    """Whole-number features of PCM: samples, mean square, mean, peak, sign changes, and a CRC of it all."""
    n = len(samples)
    if not n:
        return "n=0"
    squares = total = peak = changes = crc = 0
    for at in range(0, n, SLICE):
        part = samples[at : at + SLICE]
        x = part.astype(np.int64)
        squares, total, peak = squares + int(x @ x), total + int(x.sum()), max(peak, int(np.abs(x).max()))
        below = samples[max(0, at - 1) : at + SLICE] < 0
        changes += int(np.count_nonzero(below[1:] != below[:-1]))
        crc = zlib.crc32(part.astype("<i2").tobytes(), crc)
    return f"n={n};ms={squares // n};mean={total // n};peak={peak};zc={changes};crc={crc}"


def _pad(text: bytes) -> bytes:
    return text + b"\0" * (max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def encapsulate(payload: bytes) -> bytes:
    """A WAVE file whose samples, or ADPCM codes, are the payload's bytes (a multiple of ``UNIT``)."""
    tag = (MULAW, ALAW, IMA)[zlib.crc32(payload) % 3]
    if tag != IMA:
        return wave(tag, payload)
    blocks = np.zeros((len(payload) // UNIT, BLOCK), np.uint8)  # a block starts at sample 0 and the first step
    blocks[:, 4:] = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    return wave(IMA, blocks.tobytes(), align=BLOCK, extra=struct.pack("<H", 2 * UNIT + 1))


def payload_of(media: bytes) -> bytes:
    """The payload that ``encapsulate`` was given."""
    tag, _, align, data = parse_wave(media)
    return bytes(data) if tag != IMA else np.frombuffer(data, np.uint8).reshape(-1, align)[:, 4:].tobytes()


def decode_all(files: list[bytes]) -> list[tuple[np.ndarray, int]]:
    """What ``decode`` gives for each file; ADPCM blocks of one size are decoded together, whatever file they are from."""
    parsed = [parse_wave(f) for f in files]
    out: list = [None if p[0] == IMA else decode(f) for f, p in zip(files, parsed, strict=True)]
    for align in {p[2] for p in parsed if p[0] == IMA}:
        some = [k for k, p in enumerate(parsed) if p[0] == IMA and p[2] == align]
        blocks = [np.frombuffer(parsed[k][3], np.uint8) for k in some]
        blocks = [b[: len(b) // align * align].reshape(-1, align) for b in blocks]
        samples = ima_decode(np.concatenate(blocks))
        for k, part in zip(some, np.split(samples, np.cumsum([len(b) for b in blocks])[:-1]), strict=True):
            out[k] = part.ravel(), parsed[k][1]
    return out


def _groups(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, files) of runs of rows with about ``GROUP`` bytes."""
    first, held, size = 0, [], 0
    for k in range(batch.num_rows):
        held.append(batch.column(column)[k].as_py())
        size += len(held[-1])
        if size >= GROUP:
            yield first, held
            first, held, size = k + 1, [], 0
    if held:
        yield first, held


def _store_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, texts in _groups(batch, 1):
            media = pa.array([encapsulate(_pad(t)) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(list(map(len, texts)), pa.int64()), media], ["doc_id", "n_bytes", "media"])


def store(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The stored table (doc_id, n_bytes, media) of WAVE files that hold each text's padded bytes."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text"))
    return staged(rows.mapInArrow(_store_batches, "doc_id long, n_bytes long, media binary"), "telephony", path)


STORED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"
_ARROW = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _pcm_batches(rate: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names, types = zip(*(c.split() for c in (STORED + ", pcm binary").split(", ")), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, files in _groups(batch, 2):
                rows = []
                for k, (media, (samples, source)) in enumerate(zip(files, decode_all(files), strict=True), first):
                    payload = payload_of(media)
                    pcm = wave(PCM, resample(samples, source, rate).astype("<i2").tobytes(), rate, 2)
                    digests = len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest()
                    rows.append((batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), *digests, pcm))
                yield pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, t in zip(zip(*rows, strict=True), types, strict=True)], list(names))

    return run


def resampled(media: DataFrame, rate: int = STORED_RATE) -> DataFrame:
    """The stored table of digests of what is stored and of its payload, and ``pcm``: the file expanded, resampled, as 16-bit WAVE."""
    return staged(media.mapInArrow(_pcm_batches(rate), STORED + ", pcm binary"), "pcm")


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [features(decode(cell.as_py())[0]) for cell in batch.column(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.string())], [*batch.schema.names[:-1], "feature"])


def describe(media: DataFrame, rate: int = STORED_RATE) -> DataFrame:
    """Digests of what is stored and of its payload, and features of the resampled PCM that is stored beside it."""
    return resampled(media, rate).mapInArrow(_feature_batches, STORED + ", feature string")


def described(docs: DataFrame, rate: int = STORED_RATE, parts: int = 4) -> DataFrame:
    """What ``describe`` gives for ``store``, a part of the documents after another: the files of a part are removed
    once its PCM is stored, so that disk holds the PCM of all and the files of one part."""
    spark = docs.sparkSession
    paths: list[str] = []

    def pcm() -> Iterator[DataFrame]:
        part = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))), F.lit(parts))
        for k in range(parts):
            if paths:
                remove(spark, paths.pop())
            paths.append(fresh(spark, "telephony"))
            yield store(docs.where(part == k), paths[-1]).mapInArrow(_pcm_batches(rate), STORED + ", pcm binary")

    out = appended(pcm(), "pcm", STORED + ", pcm binary")
    remove(spark, paths.pop())
    return out.mapInArrow(_feature_batches, STORED + ", feature string")
