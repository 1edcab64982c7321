"""Memoised encoding against the library itself, and Elias-Fano against plain offsets."""
import os
import random

import numpy as np
import pyarrow as pa
import pytest

P = pytest.importorskip("public_tokenizers")
from tessera.llm import tokens  # noqa: E402
from tessera.llm.token_files import EliasFano, decode_block, encode_block  # noqa: E402
from tessera.llm.tokens import Encoder  # noqa: E402

PATH = P.path("byte_bpe_50k.json")


def direct(texts):
    lib = Encoder.of(PATH).lib
    return [lib.encode(t or "", add_special_tokens=False).ids for t in texts]


def check(texts):
    got = Encoder.of(PATH).encode(pa.array(texts, pa.string()))
    assert [g.tolist() for g in got] == direct(texts)


def test_edges():
    check(["", None, " ", "\n\n", "a", " a  b\n c", "\n\nfoo \n bar", "x   y ", "don't I'll", "été çà ×÷ ñ",
           "日本語 text", "a b c", "a\x1cb \x1f c", "12 34abc $$$%% ..", "<|endoftext|> x",
           "tab\t\tend\r\n", "  lead", "trail  ", "a" * 9000 + " b", "\x00\x85 ok"])


def test_unlike_words_with_one_hash():
    """Thue-Morse words collide under every polynomial hash modulo a power of two."""
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    check([word, other, f"{other} {word} {other}", f"x {word}"])


def test_random_texts():
    rng = random.Random(3)
    alphabet = "abAB12 .,!?#\n\t\r  éèñß×'日 \x1c"
    check(["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(3000)])


def test_whole_long_text_is_split_safely(monkeypatch):
    monkeypatch.setattr(tokens, "SPLIT_BYTES", 200)
    rng = random.Random(4)
    words = ["word", "then", "x1", "été", "don't", "end.\n", "日本", "  two"]
    check([" ".join(rng.choices(words, k=400)) for _ in range(30)])


def test_added_tokens_as_the_library_takes_them(monkeypatch, tmp_path):
    from tokenizers import Tokenizer
    rng = random.Random(5)
    parts = ["<|endoftext|>", "<|endoftext|", "|>", " plain words", "word", "x1\n", " <", "don't", "été "]
    texts = ["a<|endoftext|> x", "<|endoftext|>", "<|endoftext|><|endoftext|>"]
    texts += ["".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(300)]
    texts += ["one two three " * 40 + "<|endoftext|>" + " four five" * 40]
    lib = Tokenizer.from_file(PATH)
    assert lib.encode(texts[0], add_special_tokens=False).ids == [64, 50256, 2124]
    for size in (tokens.SPLIT_BYTES, 100):
        monkeypatch.setattr(tokens, "SPLIT_BYTES", size)
        got = Encoder(PATH).encode(pa.array(texts, pa.string()))
        assert [g.tolist() for g in got] == [lib.encode(t, add_special_tokens=False).ids for t in texts]
    lib.add_tokens(["one two", " lead"])  # tokens of letters and spaces
    path = str(tmp_path / "more.json")
    lib.save(path)
    texts += ["zero one", "a two", "x lead", "one two three", "mis leading", " one", " two", " zero one", " so two"]
    got = Encoder(path).encode(pa.array(texts, pa.string()))
    assert [g.tolist() for g in got] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_memo_stays_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_ENTRIES", 50)
    check([f"w{i} q{i * 7} common words here" for i in range(400)])


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="testdata not present")
def test_table():
    import pyarrow.parquet as pq
    check(pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist())


def test_elias_fano():
    rng = np.random.default_rng(1)
    for sizes in ([1], [1] * 300, [5_000_000, 1, 1], rng.integers(1, 5000, 700).tolist(), [1] * 70 + [90_000]):
        ends = np.cumsum(sizes)
        ef = EliasFano.of(ends)
        assert ef.all().tolist() == ends.tolist()
        assert [ef.select(i) for i in range(len(ends))] == ends.tolist()
        assert ef.select_many(np.arange(len(ends))).tolist() == ends.tolist()
        some = np.array([len(ends) - 1, 0, len(ends) // 2] if len(ends) else [], np.int64)
        assert ef.select_many(some).tolist() == ends[some].tolist()


def test_block_round_trip():
    docs = [np.arange(n, dtype=np.uint32) % 50_000 for n in (1, 7, 1, 3000, 2)]
    ends, ids = decode_block(encode_block(docs, 2))
    assert ends.all().tolist() == np.cumsum([len(d) for d in docs]).tolist()
    assert ids.tolist() == np.concatenate(docs).tolist()
