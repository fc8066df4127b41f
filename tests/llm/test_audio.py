import numpy as np
from brindle.llm import audio


def test_integral_image_filters_match_plain_sums():
    frames = np.random.default_rng(0).random((40, 12)).astype(np.float32)
    got = audio.codes(frames)
    image = np.concatenate([frames, frames], axis=1).astype(float)
    for at in (0, 13, len(got) - 1):
        code = 0
        for bit, (kind, low, height, width) in enumerate(audio._FILTERS.tolist()):
            w = image[at : at + width, low : low + height]
            if kind == 0:
                v = w[: width // 2].sum() - w[width // 2 :].sum()
            elif kind == 1:
                v = w[:, : height // 2].sum() - w[:, height // 2 :].sum()
            else:
                t = max(1, width // 3)
                v = 2 * image[at + t : at + 2 * t, low : low + height].sum() - image[at : at + t, low : low + height].sum() - image[at + 2 * t : at + 3 * t, low : low + height].sum()
            code |= int(v > 0) << bit
        assert got[at] == code


def brute(prints, step):
    named = {}
    for r, c in prints:
        if r is not None and c:
            named.setdefault(tuple(c), []).append(r)
    one = {min(v): list(k) for k, v in named.items()}
    queries = {min(v) for v in named.values() if any(r % step == 0 for r in v)}
    out = []
    for q in queries:
        for c in one:
            if c == q:
                continue
            a, b = one[q], one[c]
            first = lambda x: {k: min(i for i in range(len(x) - 2) if tuple(x[i : i + 3]) == k) for k in {tuple(x[i : i + 3]) for i in range(len(x) - 2)}}
            fa, fb = first(a), first(b)
            hits = {}
            for k in fa.keys() & fb.keys():
                hits[fb[k] - fa[k]] = hits.get(fb[k] - fa[k], 0) + 1
            if not hits:
                continue
            off = max(hits, key=lambda o: (hits[o], -abs(o), -o))
            s, t = max(0, -off), max(0, off)
            n = min(len(a) - s, len(b) - t)
            errors = sum(bin((x ^ y) & 0xFFFFFFFF).count("1") for x, y in zip(a[s : s + n], b[t : t + n], strict=True))
            if n >= audio.LEAST_FRAMES and errors <= n * audio.BITS * audio.MOST_ERRORS:
                out.append((q, c, off, n, errors))
    return sorted(out)


def test_alignment_finds_shifted_and_noisy_recordings(spark):
    rnd = np.random.default_rng(3)
    song = rnd.normal(size=64)
    rows = [(0, song), (1, song), (2, np.concatenate([rnd.normal(size=10), song])), (3, song[20:]), (4, song + rnd.normal(scale=1e-4, size=64)), *((i, rnd.normal(size=64)) for i in range(5, 60))]
    frame = audio.sonified(spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows] + [(90, None), (None, [1.0, 2.0]), (91, [])], "rec_id long, vector array<double>"))
    prints = audio.fingerprints(frame)
    got = sorted(map(tuple, audio.alignments(prints, 10).collect()))
    assert got == brute([(r.rec_id, r.codes) for r in prints.collect()], 10)
    report = {r.rec_id: r for r in audio.match_report(frame, 10).collect()}
    assert report[0]["class"] == report[1]["class"] == 0 and (report[0].aligned >= 1 or report[4]["class"] == 0) and report[5].aligned is None and report[90]["class"] is None
    assert len(report) == 63
    assert audio.match_report(frame.limit(0)).count() == 0


def test_media_columns_of_all_kinds(spark):
    """Stereo, other rates and widths, broken files, clashing columns, a long recording."""
    import io
    import wave

    def file(samples, rate, width, channels):
        held = io.BytesIO()
        with wave.open(held, "wb") as f:
            f.setparams((channels, width, rate, 0, "NONE", ""))
            scaled = {1: lambda x: (x * 100 + 128).astype("u1"), 2: lambda x: (x * 30000).astype("<i2"), 4: lambda x: (x * 2e9).astype("<i4")}[width](samples)
            f.writeframes(np.repeat(scaled, channels).tobytes())
        return held.getvalue()

    song = audio.sonify(np.random.default_rng(1).normal(size=64))
    song /= np.abs(song).max()
    fast = np.interp(np.arange(len(song) * 2) / 2, np.arange(len(song)), song)
    rows = [(0, file(song, 4000, 2, 1)), (1, file(song, 4000, 2, 2)), (2, file(fast, 8000, 4, 1)), (3, file(song, 4000, 1, 1)), (4, b"no wav"), (5, b""), (6, None), (7, file(song[:100], 4000, 2, 1)), (8, file(np.tile(song, 200), 4000, 2, 1))]
    frame = spark.createDataFrame([(*r, [1]) for r in rows], "rec_id long, audio binary, codes array<int>")
    got = {r.rec_id: r.codes for r in audio.fingerprints(frame).collect()}
    assert got[0] == got[1] and len(got[8]) > 100 * len(got[0]) and not any(got[i] for i in (4, 5, 6, 7))
    report = {r.rec_id: r for r in audio.match_report(frame, 10).collect()}
    assert report[0].aligned >= 2 and report[0].best_class in (2, 3, 8) and report[4]["class"] is None
    assert audio.fingerprints(frame.limit(0)).count() == 0


def every_offset(a, b):
    """Whether some offset of two recordings has few enough bit errors over enough frames."""
    a, b = np.array(a), np.array(b)
    for off in range(-len(a) + audio.LEAST_FRAMES, len(b) - audio.LEAST_FRAMES + 1):
        x, y = a[max(0, -off) :], b[max(0, off) :]
        n = min(len(x), len(y))
        if n >= audio.LEAST_FRAMES and np.bitwise_count(x[:n] ^ y[:n]).sum() <= n * audio.BITS * audio.MOST_ERRORS:
            return True
    return False


def test_recall_against_all_offsets(spark):
    """Recordings cut at whole and broken frames, with noise, against every offset of every pair."""
    rnd = np.random.default_rng(5)
    prints = []
    for i in range(0, 160, 4):
        song = audio.sonify(rnd.normal(size=64))
        other = np.concatenate([audio.sonify(rnd.normal(size=8)), song])
        for j, s in enumerate((song, song[20 * audio.HOP :], other + rnd.normal(scale=0.05, size=len(other)), song[10 * audio.HOP + 40 :])):
            prints.append((i + j, audio.codes(audio.chroma(s.astype(np.float32))).tolist()))
    found = {(r.query_class, r["class"]) for r in audio.alignments(spark.createDataFrame(prints, "rec_id long, codes array<int>"), 4).collect()}
    want = {(q, c) for q, x in prints if q % 4 == 0 for c, y in prints if c != q and every_offset(x, y)}
    assert {(i, i + 1) for i in range(0, 160, 4)} <= want
    assert len(want & found) >= 0.9 * len(want) and found <= want


def song(seed, notes=64):
    return audio.sonify(np.random.default_rng(seed).normal(size=notes))


def test_silence_aligns_with_nothing(spark):
    quiet = np.zeros(6 * audio.RATE, np.float32)
    hiss = np.random.default_rng(0).normal(scale=1e-3, size=len(quiet)).astype(np.float32)
    rows = [(i, audio.wav(np.concatenate([quiet if i % 2 else hiss, song(i), quiet]))) for i in range(12)]
    rows += [(100, audio.wav(np.concatenate([quiet, quiet, song(3)]))), (101, audio.wav(quiet)), (102, audio.wav(np.concatenate([quiet, quiet])))]
    prints = audio.fingerprints(spark.createDataFrame(rows, "rec_id long, audio binary"))
    found = {(r.query_class, r["class"]) for r in audio.alignments(prints, 1).collect()}
    assert found == {(3, 100), (100, 3)}
    report = {r.rec_id: r for r in audio.match_report(spark.createDataFrame(rows, "rec_id long, audio binary"), 1).collect()}
    assert report[101]["class"] is None and report[102].n_codes == 0 and report[0].aligned == 0 and report[100].best_class == 3


def test_wav_of_every_width():
    import struct

    tune = song(2).astype(np.float64)
    tune /= np.abs(tune).max() * 1.01

    def file(kind, bits, raw, extensible=False):
        body = struct.pack("<HHIIHH", 0xFFFE if extensible else kind, 1, audio.RATE, audio.RATE * bits // 8, bits // 8, bits)
        body += struct.pack("<HHIH14s", 22, bits, 0, kind, b"") if extensible else b""
        return b"RIFF" + struct.pack("<I", 0) + b"WAVE" + b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"fmt " + struct.pack("<I", len(body)) + body + b"data" + struct.pack("<I", len(raw)) + raw

    deep = (tune * (2**31 - 1)).astype("<i4")
    three = deep.view(np.uint8).reshape(-1, 4)[:, 1:].tobytes()
    forms = [file(1, 24, three), file(1, 24, three, True), file(1, 32, deep.tobytes()), file(3, 32, tune.astype("<f4").tobytes()), file(3, 64, tune.tobytes()), file(1, 24, three + b"\1")]
    plain = audio.codes(audio.chroma(audio.samples_of(file(1, 16, (tune * 32767).astype("<i2").tobytes()))))
    assert len(plain) > 100
    for form in forms:
        got = audio.codes(audio.chroma(audio.samples_of(form)))
        assert len(got) == len(plain) and np.bitwise_count((got ^ plain).astype(np.uint32)).mean() < 0.1
    assert audio.samples_of(file(1, 12, b"ab")) is None and audio.samples_of(b"RIFF") is None and len(audio.samples_of(file(1, 16, b""))) == 0
    assert np.isfinite(audio.samples_of(file(3, 32, np.array([np.nan, np.inf, 1], "<f4").tobytes()))).all()


def test_other_rates_keep_what_lies_above_out():
    rate = 44_100
    t = np.arange(8 * rate) / rate
    notes = [110 * 2 ** (n / 12) for n in (0, 4, 7, 9, 12, 16)]
    low = sum(np.sin(2 * np.pi * f * t) * (np.floor(t * (i + 1)) % 2) for i, f in enumerate(notes))
    high = low + 0.8 * sum(np.sin(2 * np.pi * f * t) for f in (2_450, 3_300, 5_100, 9_000))
    a, b = (audio.codes(audio.chroma(audio.resampled(x.astype(np.float32), rate))) for x in (low, high))
    assert len(a) == len(b) > 100 and np.bitwise_count((a ^ b).astype(np.uint32)).mean() / audio.BITS < 0.02
    exact = np.sin(2 * np.pi * 440 * np.arange(8 * audio.RATE) / audio.RATE)
    assert np.abs(audio.resampled(np.sin(2 * np.pi * 440 * t).astype(np.float32), rate)[500:-500] - exact[500:-500]).max() < 0.01
    for other in (1_000, 3_999, 8_000, 22_050, 192_000):
        up = audio.resampled(np.sin(2 * np.pi * 300 * np.arange(other) / other).astype(np.float32), other)
        assert abs(len(up) - audio.RATE) <= 1 and np.abs(up[400:-400] - np.sin(2 * np.pi * 300 * np.arange(len(up)) / audio.RATE)[400:-400]).max() < 0.02
