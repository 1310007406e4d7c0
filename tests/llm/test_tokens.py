"""Ids found piece by piece are those of whole texts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evkit.llm import tokens
from evkit.llm.tokens import PieceEncoder, load_tokenizer

END = (1).to_bytes(4, "little")


@pytest.fixture(scope="module")
def tokenizer():
    return load_tokenizer()


def plain(tokenizer, text):
    return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes() + END


def test_pieces_give_the_ids_of_the_whole_text(tokenizer, monkeypatch):
    rng = random.Random(4)
    signs = ["a", "B", "é", "ñ", "×", "²", "3", "'", "'s", "'ll", ".", ",", "!", "|", "_", "%%", " ", " ", "  ", "\n",
             "\r\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", " ", "　", "​", "漢字", "🙂", "́", "Ⅷ",
             "the", " word", "<|endoftext|>", "\x00", "ſ", "ʯ", "ʰ", "Я", "x" * 70]
    texts = ["", " ", "\n\n", "word", " word ", "<|endoftext|>", "a<|endoftext|>, b"]
    texts += ["".join(rng.choices(signs, k=rng.randint(1, 40))) for _ in range(4000)]
    want = [plain(tokenizer, t) for t in texts]
    for kept in (1 << 19, 200):
        monkeypatch.setattr(tokens, "KEPT_PIECES", kept)
        encoder = PieceEncoder(tokenizer)
        for low in range(0, len(texts), 256):
            assert encoder.encode(texts[low : low + 256], END) == want[low : low + 256]


def test_pieces_end_where_words_end_for_every_sign(tokenizer):
    """Each code point between two letters, two spaces and two commas."""
    encoder = PieceEncoder(tokenizer)
    points = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"{c}, a{c} {c}  b{c}.{c}\n" for c in points[low : low + 8]) for low in range(0, len(points), 8)]
    assert encoder.encode(texts, END) == [plain(tokenizer, t) for t in texts]


def test_a_piece_is_found_once_and_long_ones_are_not_kept(tokenizer):
    seen = []

    class Counting:
        get_vocab = tokenizer.get_vocab

        def encode_batch_fast(self, texts, **settings):
            seen.extend(texts)
            return tokenizer.encode_batch_fast(texts, **settings)

    encoder = PieceEncoder(Counting())
    long = "x" * 1000
    for _ in range(3):
        encoder.encode([f"one two two, {long}", "two one one"], END)
    assert sum(t.count(" two") for t in seen) == 1 and sum(t.count(" one") for t in seen) == 1
    assert sum(long in t for t in seen) == 3 and not any(long in p for p in encoder.known)


def test_the_jvm_finds_the_ids_of_the_library(spark, tokenizer):
    rng = random.Random(6)
    signs = ["a", "B", "é", "ñ", "×", "²", "3", "'", "'s", "'ll", "'re", ".", ",", "!", "%%", " ", "  ", "\n", "\r\n",
             "\t", "the", " word", "ſ", "ǅ", "¼", "x" * 70, "\xa0", "\x0b", "漢", "<|endoftext|>"]
    texts = ["", " ", "\n\n", "word", " word ", "x" * 20_000, "abc" * 5000, None]
    texts += ["".join(rng.choices(signs[: rng.choice([26, 30])], k=rng.randint(1, 40))) for _ in range(3000)]
    points = [chr(c) for c in range(0x300) if chr(c) != "\x00"]
    texts += [f"{c}, a{c} {c}  b{c}.{c}\n {c}1{c}" for c in points]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, text string").coalesce(2)
    rows = docs.select("i", tokens.plain_ids(spark, F.col("text"), 1).alias("ids")).collect()
    found = {r["i"]: r["ids"] for r in rows if r["ids"] is not None}
    assert all(bytes(ids) == plain(tokenizer, texts[i] or "") for i, ids in found.items())
    # Left to the library: texts with signs of which the two may think otherwise, and no others.
    odd = [t or "" for i, t in enumerate(texts) if i not in found]
    assert len(found) > 2000 and odd
    assert all("<|endoftext|>" in t or any(ord(c) >= 0x250 or not c.isprintable() and c not in "\n\r\t" for c in t) for t in odd)
    # Both ways together, in their places.
    rows = tokens.encoded(docs, "text", 1, keep=("i",)).collect()
    assert {r["i"]: bytes(r["ids"]) for r in rows} == {i: plain(tokenizer, t or "") for i, t in enumerate(texts)}
    for part in {r["part"] for r in rows}:
        own = sorted((r["local_start"], r["n_tokens"]) for r in rows if r["part"] == part)
        assert [s for s, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1]]


def test_a_vocabulary_of_another_kind_is_left_to_the_library(monkeypatch, tmp_path):
    import json

    import public_tokenizers

    with open(public_tokenizers.path(tokens.VOCABULARY), encoding="utf-8") as file:
        whole = json.load(file)
    whole["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "other.json").write_text(json.dumps(whole), encoding="utf-8")
    monkeypatch.setattr(public_tokenizers, "path", lambda name: str(tmp_path / name))
    assert tokens.packed_vocabulary("other.json") is None
