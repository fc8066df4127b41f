import random

import pytest
from brindle.llm.bpe import Encoder, chunks, decode, encode, encode_digests, tokenizer_json
from brindle.llm.lexicon import Lexicon, compile_lexicon
from brindle.llm.token_store import read_tokens, round_trip, write_tokens
from brindle.llm.wavelet import WaveletMatrix, build
from hypothesis import given, settings
from hypothesis import strategies as st

FILE = tokenizer_json()
ODD = [
    "", " ", "Don't o'sullivan'll 'S WE'VE", "a<|endoftext|>b <|ENDOFTEXT|> <|startoftext|>", "İSTANBUL ΣΊΣΥΦΟΣ straße T̈ ǅ", "1234 ½ Ⅷ x\x1cy\x1f z w\u0085v",
    "日本語 テスト 👩‍👩‍👧 é ​﻿", "x" * 3000 + "!?" * 500, "tab\tnew\nline\x0b\x0c\r end\x00\x7f", "... --- ,,, $$$ %%% ***", "idiot's house",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(__import__("public_tokenizers").path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def own(tmp_path_factory):
    plain = Encoder(FILE)
    words = ["the", "of", "lexicon", "lexicons", "minimal", "don", "house", "houses", "a"]
    path = tmp_path_factory.mktemp("lexicon") / "l.bin"
    path.write_bytes(compile_lexicon({w: tuple(plain.merge(w)) for w in words}))
    return Encoder(FILE, Lexicon(path))


def both(own, library, text):
    known = own.ids_of(chunks(text))
    ids = [i for c in chunks(text) for i in known[c]]
    want = library.encode(text, add_special_tokens=False).ids
    assert ids == want
    assert own.decode(ids) == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", ODD)
def test_odd_texts_encode_as_the_library_does(own, library, text):
    both(own, library, text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("the of'sSA <|end́ \x1c\t12!")), max_size=60))
def test_any_text_encodes_as_the_library_does(own, library, text):
    both(own, library, text)


def test_merging_all_at_once_is_merging_each(own):
    rnd = random.Random(4)
    pieces = ["".join(rnd.choice("abcdeinorst") for _ in range(rnd.randrange(1, 40))) for _ in range(400)] + ["a", "house", "x" * 40]
    assert own.merge_all(pieces) == [own.merge(p) for p in pieces] == [own._merge_long(p) for p in pieces]
    assert own.merge_all([]) == []


def test_lexicon_shares_suffixes_and_finds_just_its_words(tmp_path):
    words = {f"{a}{b}{c}": (i, i + 1) for i, (a, b, c) in enumerate((a, b, c) for a in "abcd" for b in "xyz" for c in ("", "ing", "ings"))}
    (tmp_path / "l").write_bytes(compile_lexicon(words))
    lexicon = Lexicon(tmp_path / "l")
    assert all(lexicon.get(w) == ids for w, ids in words.items())
    assert [lexicon.get(w) for w in ("", "a", "axin", "axingsx", "é")] == [None] * 5
    assert lexicon.states < 10


@pytest.mark.parametrize("n", [0, 1, 7, 512, 70_000, 200_001])
def test_wavelet_matrix_answers_as_a_list_does(n):
    import numpy as np

    rnd = random.Random(n)
    ids = np.array([rnd.choice([1, 5, 49407, rnd.randrange(50), rnd.randrange(40_000)]) for _ in range(n)], np.uint16)
    m = WaveletMatrix(build(ids, [3, None], [n, 0]))
    assert m.tokens().tolist() == ids.tolist()
    assert m.rows()[0] == [3, None] and m.rows()[1].tolist() == [n, 0]
    some = sorted({0, n - 1, *rnd.sample(range(n), min(n, 300))}) if n else []
    assert m.access_many(np.array(some, int)).tolist() == ids[some].tolist()
    for i in some[:20]:
        assert m.access(i) == ids[i]
        assert m.count(5, 0, i) == (ids[:i] == 5).sum()
    for token in (1, 17, 49407, 60000, 1 << 20):
        assert m.count(token) == (ids == token).sum()
        assert m.occurrences(token).tolist() == np.flatnonzero(ids == token).tolist()
    assert m.occurrences(5, n // 2, n - n // 8).tolist() == [i for i in range(n // 2, n - n // 8) if ids[i] == 5]
    with pytest.raises(IndexError):
        m.access(n)


def test_a_wavelet_file_is_mapped_and_smaller_than_its_ids(tmp_path):
    import mmap

    import numpy as np

    ids = np.random.default_rng(0).zipf(1.3, 300_000) % 49_000
    (tmp_path / "t.wm").write_bytes(build(ids.astype(np.uint16), [1], [len(ids)]))
    with open(tmp_path / "t.wm", "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as held:
        m = WaveletMatrix(held)
        assert m.access(123_456) == ids[123_456] and m.count(7) == (ids == 7).sum()
        assert len(held) < 1.6 * len(ids)
        del m


ROWS = [(5, "the lexicon of houses", "x"), (2, None, None), (None, "no id", "y"), (9, "", "z"), (5, "the lexicon of houses", "x"), (1, "Don't " * 4000, "w")]


def test_digests_and_ids(spark, library):
    import hashlib

    docs = spark.createDataFrame(ROWS, "doc_id long, text string, ids string")
    got = sorted(map(tuple, encode_digests(docs).collect()), key=repr)
    want = []
    for d, t, _ in ROWS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    back = decode(encode(docs)).select("doc_id", "decoded").collect()
    assert {r[0]: r[1] for r in back}[5] == library.decode(library.encode(ROWS[0][1], add_special_tokens=False).ids)
    assert encode_digests(docs.limit(0)).count() == 0


def test_token_files_hold_every_document(spark, library, monkeypatch):
    import zlib

    import numpy as np

    docs = spark.createDataFrame(ROWS, "doc_id long, text string, start string")
    want, start = [], 0
    for d, t, _ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, round_trip(docs).collect()), key=lambda r: r[1]) == want
    assert round_trip(docs.limit(0)).count() == 0


def test_token_files_in_parts(spark, monkeypatch, tmp_path):
    from brindle.llm import token_store

    monkeypatch.setattr(token_store, "PART_DOCUMENTS", 50)
    docs = spark.range(400).selectExpr("id * 3 as doc_id", "repeat(concat('word', id, ' '), 20) as text")
    files = write_tokens(docs, f"file://{tmp_path}/t")
    assert files.count() > 4
    rows = read_tokens(spark, f"file://{tmp_path}/t").join(files, ["part", "shard"]).selectExpr("doc_id", "start + at as s", "n_tokens").orderBy("doc_id").collect()
    assert len(rows) == 400
    assert [r.s for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(400)]
