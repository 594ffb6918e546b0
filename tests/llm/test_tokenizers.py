"""Byte-level BPE against tiktoken, token counts against sentencepiece."""

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from heliopanel.llm import bpe
from heliopanel.llm.token_counts import add_token_counts, count_texts, transducer

BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.vocabulary(BPE).ranks, special_tokens={})


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


ALPHABETS = ["ab '", "'srevltmd x1", "'s 're\n\t  a1!", "  \n 　x", "é中1²½ ́'’ \x1c\x85ſ١", "abcdefghij <|>_.,"]


@pytest.mark.parametrize("alphabet", ALPHABETS)
def test_bpe_like_tiktoken(encoding, alphabet):
    random.seed(alphabet)
    texts = ["".join(random.choice(alphabet) for _ in range(random.randint(0, 80))) for _ in range(500)]
    assert [i.tolist() for i in bpe.vocabulary(BPE).encode(texts)] == [encoding.encode_ordinary(t) for t in texts]


def test_bpe_long_slices(encoding):
    random.seed(3)
    texts = ["a" * 5000, "ab" * 3000 + "'s", "".join(random.choice("etaoin") for _ in range(20_000)), "", " ", "\n", "x" * 300 + " " * 700]
    assert [i.tolist() for i in bpe.vocabulary(BPE).encode(texts)] == [encoding.encode_ordinary(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(blacklist_categories=("Cs", "Cn")), max_size=40), max_size=5))
def test_bpe_round_trip(texts):
    words = bpe.vocabulary(BPE)
    for text, ids in zip(texts, words.encode(texts)):
        lengths = words.lengths[ids]
        assert words.decode(ids, np.cumsum(lengths) - lengths, int(lengths.sum())) == text.encode()


def rows(spark):
    data = [(1, "It's a test, isn't it?\n\n  Yes", "x"), (2, None, None), (3, "", "y"), (None, "été " * 30_000, "z"), (1, "It's a test, isn't it?\n\n  Yes", "x")]
    return spark.createDataFrame(data, "doc_id long, text string, token_ids string").withColumnRenamed("token_ids", "n_tokens")


def test_encode_and_decode_rows(spark, encoding):
    df = rows(spark)
    out = bpe.decode(bpe.encode(df, BPE), BPE).collect()
    assert len(out) == 5
    for r in out:
        assert r.token_ids == encoding.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
        assert len(r.token_offsets) == len(r.token_ids)
    assert {bytes(r.decoded) for r in bpe.round_trip(df, BPE, keep=("doc_id",)).collect()} == {bytes(r.decoded) for r in out}
    assert bpe.encode(df.limit(0), BPE).count() == 0


@pytest.mark.parametrize("alphabet", ["ab", "aab eh", "in er ▁ the on", "abcdefghijklmnopqrstuvwxyz    \n\t.,'éß中国日本<>|0123456789", "  x", "\x00​𝔸a"])
def test_counts_like_sentencepiece(pieces, alphabet):
    random.seed(alphabet)
    texts = ["".join(random.choice(alphabet) for _ in range(random.randint(0, 60))) for _ in range(500)] + ["", " ", alphabet * 2000]
    assert count_texts(texts, PIECES).tolist() == [len(p) for p in pieces.encode(texts)]


def test_counts_of_joined_pieces(pieces):
    random.seed(8)
    names = [pieces.id_to_piece(i).replace("▁", " ") for i in range(259, 32_000)]
    texts = ["".join(random.choice(names) for _ in range(random.randint(0, 20))) for _ in range(2000)] + ["<s> </s> <unk> <0x0A>"]
    assert count_texts(texts, PIECES).tolist() == [len(p) for p in pieces.encode(texts)]
    machine = transducer(PIECES)
    machine.clear()
    machine.allot(4)  # the table grows while texts are read
    assert count_texts(texts[:200], PIECES).tolist() == [len(p) for p in pieces.encode(texts[:200])]


def test_count_rows(spark, pieces):
    out = add_token_counts(rows(spark), PIECES).collect()
    assert len(out) == 5
    for r in out:
        n = len(pieces.encode(r.text or ""))
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((r.text or "").encode()), n > 4096)
    assert add_token_counts(rows(spark).limit(0), PIECES).count() == 0
