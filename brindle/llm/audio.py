"""Audio fingerprints of pitch-class frames, and alignment of recordings by them.

A recording's frames hold the energy of the twelve pitch classes. Filters compare sums of rectangles (time by pitch class) of the image of
frames, each sum from four values of its integral image; a filter's sign is a bit, and BITS filters around a frame make its packed integer. Equal
integers give candidates; the most common offset of a pair of recordings aligns them, and the share of bits that differ along it decides.
"""

from __future__ import annotations

import io
import math
import struct
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, staged

RATE, FRAME, HOP = 4000, 512, 256
PITCHES, BITS, SPAN = 12, 16, 8
#: Of the bits along an alignment, at most this share may differ; an alignment has at least so many frames.
MOST_ERRORS, LEAST_FRAMES = 0.15, 24
#: Share of the loudest frame's energy up to which a frame is silent, and what stands for the integer of a place in silence: it matches nothing.
FLOOR, NO_CODE = 1e-4, -1
#: Zero crossings on each side of the resampling kernel.
LOBES = 16
#: Recordings whose id this divides are the queries.
QUERY_STEP = 100


def _bins() -> np.ndarray:
    """Pitch class of each bin of the spectrum, -1 outside 55 to 1760 Hz."""
    hz = np.fft.rfftfreq(FRAME, 1 / RATE)
    note = np.round(12 * np.log2(np.maximum(hz, 1.0) / 440)).astype(int)
    return np.where((hz >= 55) & (hz <= 1760), note % PITCHES, -1)


_BINS = _bins()
_WINDOW = np.hanning(FRAME).astype(np.float32)


def chroma(samples: np.ndarray) -> np.ndarray:
    """Frames by pitch classes, each frame of unit length; zeros for a silent one, FLOOR below the recording's loudest."""
    n = 1 + (len(samples) - FRAME) // HOP if len(samples) >= FRAME else 0
    if not n:
        return np.zeros((0, PITCHES), np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP][:n] * _WINDOW
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
    out = np.stack([power[:, p == _BINS].sum(axis=1) for p in range(PITCHES)], axis=1)
    loud = out.sum(axis=1, keepdims=True)
    silent = loud <= max(FLOOR * float(loud.max()), 1e-9)
    return np.where(silent, 0, out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def _filters() -> np.ndarray:
    """Per bit: kind (halves by time, halves by pitch, or middle against sides), first pitch class, height, width."""
    rnd = np.random.default_rng(11)
    return np.stack([rnd.integers(0, 3, BITS), rnd.integers(0, PITCHES, BITS), rnd.integers(1, 4, BITS) * 2, rnd.integers(1, SPAN // 2 + 1, BITS) * 2], axis=1)


_FILTERS = _filters()


def codes(frames: np.ndarray) -> np.ndarray:
    """A packed integer for each place that SPAN frames fit; NO_CODE where more than half of them are silent."""
    n = len(frames) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.int32)
    image = np.concatenate([frames, frames], axis=1)  # pitch classes go round
    sums = np.zeros((len(frames) + 1, 2 * PITCHES + 1))
    sums[1:, 1:] = image.cumsum(axis=0).cumsum(axis=1)
    at = np.arange(n)

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return sums[at + t1, p1] - sums[at + t0, p1] - sums[at + t1, p0] + sums[at + t0, p0]

    out = np.zeros(n, np.int64)
    for bit, (kind, low, height, width) in enumerate(_FILTERS.tolist()):
        if kind == 0:
            value = area(0, width // 2, low, low + height) - area(width // 2, width, low, low + height)
        elif kind == 1:
            value = area(0, width, low, low + height // 2) - area(0, width, low + height // 2, low + height)
        else:
            third = max(1, width // 3)
            value = 2 * area(third, 2 * third, low, low + height) - area(0, 3 * third, low, low + height) + area(third, 2 * third, low, low + height)
        out |= (value > 0).astype(np.int64) << bit
    voiced = np.concatenate([[0], frames.any(axis=1).cumsum()])
    return np.where(2 * (voiced[SPAN:] - voiced[:-SPAN]) >= SPAN, out, NO_CODE).astype(np.int32)


def sonify(vector: np.ndarray) -> np.ndarray:
    """A recording of a vector: each value is a note of 128 ms, its rank's pitch, its size the loudness."""
    notes = np.argsort(np.argsort(vector, kind="stable"), kind="stable")
    t = np.arange(RATE * 128 // 1000) / RATE
    hz = 110 * 2 ** (notes % 36 / 12)
    loud = 0.2 + np.abs(vector) / (np.abs(vector).max() + 1e-9)
    return (np.sin(2 * np.pi * hz[:, None] * t) * loud[:, None]).ravel().astype(np.float32)


def wav(samples: np.ndarray) -> bytes:
    """A WAV file of one channel of 16 bits at RATE; the loudest sample is full scale."""
    held = io.BytesIO()
    with wave.open(held, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(RATE)
        f.writeframes((samples / max(1e-9, float(np.abs(samples).max(initial=0))) * 32767).astype("<i2").tobytes())
    return held.getvalue()


def resampled(samples: np.ndarray, rate: int) -> np.ndarray:
    """samples at RATE: a windowed sinc that lets through what both rates can hold, one set of weights for each phase of the two rates."""
    common = math.gcd(rate, RATE)
    step, phases = rate // common, RATE // common
    cutoff = min(1.0, RATE / rate)
    half = math.ceil(LOBES / cutoff)
    taps = np.arange(-half + 1, half + 1)
    away = (np.arange(phases)[:, None] * step % phases) / phases - taps  # of each tap from the place of a phase's output
    weights = (cutoff * np.sinc(cutoff * away) * np.where(np.abs(away) < half, np.cos(np.pi * away / (2 * half)) ** 2, 0)).astype(np.float32)
    n = len(samples) * phases // step
    padded = np.concatenate([np.zeros(half, np.float32), samples.astype(np.float32), np.zeros(half + step, np.float32)])
    out = np.empty(n, np.float32)
    windows = np.lib.stride_tricks.sliding_window_view(padded, 2 * half)
    for begin in range(0, n, 1 << 14):
        k = np.arange(begin, min(n, begin + (1 << 14)))
        out[k] = np.einsum("ij,ij->i", windows[k * step // phases + 1], weights[k % phases])
    return out


def samples_of(file: bytes | None) -> np.ndarray | None:
    """Samples at RATE of a WAV file: integers of 8, 16, 24 or 32 bits or floats of 32 or 64, the mean of the channels. None for what is no such file.

    A chunk that is cut short counts as far as it goes. Samples that aren't finite are silence.
    """
    file = file or b""
    if len(file) < 12 or file[:4] != b"RIFF" or file[8:12] != b"WAVE":
        return None
    at, layout, raw = 12, None, None
    while at + 8 <= len(file) and raw is None:
        name, size = file[at : at + 4], int.from_bytes(file[at + 4 : at + 8], "little")
        body = file[at + 8 : at + 8 + size]
        if name == b"fmt " and len(body) >= 16:
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
            kind = int.from_bytes(body[24:26], "little") if kind == 0xFFFE and len(body) >= 26 else kind  # the extensible form names its kind further on
            layout = kind, channels, rate, bits
        elif name == b"data":
            raw = body
        at += 8 + size + size % 2
    if layout is None or raw is None or not layout[1] or not layout[2]:
        return None
    kind, channels, rate, bits = layout
    if (kind, bits) not in {(1, 8), (1, 16), (1, 24), (1, 32), (3, 32), (3, 64)}:
        return None
    width = bits // 8 * channels
    raw = raw[: len(raw) // width * width]
    if bits == 24:  # as the upper three bytes of 32 bits
        wide = np.zeros((len(raw) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        found = wide.view("<i4").ravel() / 2.0**31
    elif kind == 3:
        found = np.nan_to_num(np.frombuffer(raw, f"<f{bits // 8}").astype(np.float64), nan=0.0, posinf=0.0, neginf=0.0)
    else:
        found = (np.frombuffer(raw, np.uint8) - 128.0) / 128 if bits == 8 else np.frombuffer(raw, f"<i{bits // 8}") / 2.0 ** (bits - 1)
    found = found.reshape(-1, channels).mean(axis=1)
    return resampled(found, rate) if rate != RATE and len(found) else found.astype(np.float32)


_AUDIO = pa.schema([("rec_id", pa.int64()), ("audio", pa.binary())])


def _sonified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for batch in batches:
            for rec_id, vector in zip(batch.column("rec_id").to_pylist(), batch.column("vector").to_pylist(), strict=True):
                usable = [v for v in vector or () if v is not None and np.isfinite(v)]
                yield rec_id, wav(sonify(np.array(usable))) if usable else None

    yield from arrow_batches(rows(), _AUDIO)


def sonified(vectors: DataFrame) -> DataFrame:
    """rec_id, audio (WAV) of vectors (rec_id, vector): stands for a media column where tables hold none. A null or empty vector has null audio."""
    return vectors.select("rec_id", "vector").mapInArrow(_sonified, "rec_id long, audio binary")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = (samples_of(x.as_py()) for x in batch.column("audio"))
        prints = [codes(chroma(x)).tolist() if x is not None else [] for x in found]
        yield pa.RecordBatch.from_arrays([batch.column("rec_id"), pa.array(prints, pa.list_(pa.int32()))], names=["rec_id", "codes"])


def fingerprints(recordings: DataFrame) -> DataFrame:
    """rec_id, codes of recordings (rec_id, audio: bytes of a WAV file). Null, empty, too short or unreadable audio has no codes; places in
    silence have NO_CODE, which matches nothing. Rows that repeat
    an id keep a row each; other columns are ignored; an empty table gives no rows. A recording is decoded in the memory of one task."""
    return recordings.select(F.col("rec_id").cast("long").alias("rec_id"), "audio").mapInArrow(_fingerprints, "rec_id long, codes array<int>")


def alignments(prints: DataFrame, step: int = QUERY_STEP) -> DataFrame:
    """Queries (rec_id divisible by step) against all recordings. Per pair of classes that align: query_class, class, offset (frames
    by which the query starts later), frames (where both are heard), errors (bits), with membership in the classes of classes().

    Recordings with the same codes are one class, named by its smallest rec_id, so copies are neither compared nor listed pairwise. Candidates share a
    run of three integers, at any places: every offset of a pair with a hit is checked, and of those that pass, that with the most hits (of equal
    ones the smallest) is listed. A stretch of one integer is one run with a length, so that it meets another in rows for its offsets alone.
    Rows without rec_id or codes are in no class.
    """
    named = classes(prints)
    one = staged(named.filter("rec_id = class").dropDuplicates(["class"]).select("class", "codes"), "audio-classes")
    queries = named.filter(F.col("rec_id") % step == 0).select("class").distinct()
    last, code = F.greatest(F.lit(1), F.size("codes") - 2), (lambda i: F.get("codes", i - 1))
    goes_on = lambda i: (code(i - 1) == code(i)) & (code(i) == code(i + 1)) & (code(i) == code(i + 2))
    starts = one.select("class", "codes", last.alias("last"), F.filter(F.sequence(F.lit(1), last), lambda i: (i == 1) | ~goes_on(i)).alias("starts"))
    silent = lambda s: F.exists(F.slice("codes", s, 3), lambda x: x == NO_CODE)
    run = lambda s, k: F.struct((s - 1).alias("at"), (F.coalesce(F.get("starts", k + 1), F.col("last") + 1) - s).alias("len"), F.xxhash64(F.slice("codes", s, 3)).alias("run"), silent(s).alias("silent"))
    runs = starts.select("class", F.inline(F.filter(F.transform("starts", run), lambda r: ~r["silent"]))).drop("silent")
    asked = runs.join(queries, "class").select(F.col("class").alias("query_class"), "run", F.col("at").alias("q_at"), F.col("len").alias("q_len"))
    met = asked.join(runs, "run").filter("query_class <> class").withColumn("d", F.explode(F.sequence(1 - F.col("q_len"), F.col("len") - 1)))
    shared = F.least(F.col("q_len") - 1, F.col("len") - 1 - F.col("d")) - F.greatest(F.lit(0), -F.col("d")) + 1
    hits = met.groupBy("query_class", "class", (F.col("at") - F.col("q_at") + F.col("d")).alias("offset")).agg(F.sum(shared).alias("hits"))
    some = hits.groupBy("query_class", "class").agg(F.collect_list(F.struct("hits", (-F.abs("offset")).alias("near"), (-F.col("offset")).alias("early"), "offset")).alias("offsets"))
    pairs = some.join(one.select(F.col("class").alias("query_class"), F.col("codes").alias("q")), "query_class").join(one.select("class", F.col("codes").alias("c")), "class")

    def framed(o: Column) -> Column:
        frames = F.least(F.size("q") - F.greatest(F.lit(0), -o["offset"]), F.size("c") - F.greatest(F.lit(0), o["offset"]))
        return F.struct(o["hits"].alias("hits"), o["near"].alias("near"), o["early"].alias("early"), o["offset"].alias("offset"), frames.alias("frames"))

    def tested(o: Column) -> Column:
        a, b = (F.slice(x, F.greatest(F.lit(0), way * o["offset"]) + 1, o["frames"]) for x, way in (("q", -1), ("c", 1)))
        bits = F.filter(F.zip_with(a, b, lambda x, y: F.when((x != NO_CODE) & (y != NO_CODE), F.bit_count(x.bitwiseXOR(y)))), lambda x: x.isNotNull())
        return F.struct(o["hits"].alias("hits"), o["near"].alias("near"), o["early"].alias("early"), o["offset"].alias("offset"), F.size(bits).alias("frames"), F.aggregate(bits, F.lit(0), lambda a, x: a + x).alias("errors"))

    long = F.filter(F.transform("offsets", framed), lambda o: o["frames"] >= LEAST_FRAMES)
    passed = F.filter(F.transform(long, tested), lambda o: (o["frames"] >= LEAST_FRAMES) & (o["errors"] <= o["frames"] * BITS * MOST_ERRORS))
    best = pairs.select("query_class", "class", F.array_max(passed).alias("m")).filter("m is not null")
    return best.select("query_class", "class", "m.offset", "m.frames", "m.errors")


def classes(prints: DataFrame) -> DataFrame:
    """rec_id, codes, class: the smallest rec_id with the same codes. A recording that is silent throughout is in none."""
    known = prints.filter(F.col("rec_id").isNotNull() & F.exists("codes", lambda x: x != NO_CODE)).withColumn("name", F.sha2(F.array_join("codes", ","), 256))
    first = known.groupBy("name").agg(F.min("rec_id").alias("class"))
    return known.join(first, "name").select("rec_id", "codes", "class")


def match_report(recordings: DataFrame, step: int = QUERY_STEP) -> DataFrame:
    """Per recording (rec_id, audio): rec_id, class (null without codes), n_codes, and aligned: how many other classes a query's class aligns with (null where the
    class holds no query), the best one's id, offset, and bit error rate. Recordings of one class align without errors."""
    prints = staged(fingerprints(recordings), "audio-prints")
    found = alignments(prints, step)
    rate = F.col("errors") / (F.col("frames") * BITS)
    top = found.groupBy("query_class").agg(F.count("*").alias("n"), F.min(F.struct(rate.alias("rate"), "class", "offset")).alias("best"))
    named = classes(prints)
    asked = named.filter(F.col("rec_id") % step == 0).select("class").distinct().join(top, F.col("class") == F.col("query_class"), "left")
    per = asked.select("class", F.coalesce("n", F.lit(0)).alias("aligned"), F.col("best.class").alias("best_class"), F.col("best.offset").alias("offset"), F.round("best.rate", 6).alias("error_rate"))
    rows = prints.select("rec_id", F.size(F.filter("codes", lambda x: x != NO_CODE)).alias("n_codes")).join(named.select("rec_id", "class").distinct(), "rec_id", "left")
    return rows.join(per, "class", "left").select("rec_id", "class", "n_codes", "aligned", "best_class", "offset", "error_rate")
