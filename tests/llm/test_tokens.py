import hashlib
import random

import numpy as np
import pytest

from quarryflow.llm import byte_bpe, token_counts

from .conftest import EDGES

vocabularies = pytest.importorskip("public_tokenizers")
BYTES, PIECES = vocabularies.path("byte_bpe_50k.json"), vocabularies.path("piece_bpe_32k.model")


def samples():
    rnd = random.Random(9)
    letters = [chr(i) for i in range(0x3000)] + ["😀", "<|endoftext|>", "<s>", "▁", "　"]
    out = ["x" * 9000, "ab" * 3000 + " end", "'s't'LL don't", "  a \n\n b  ", "a<0x41>▁▁b ▁ c", " " * 40, *(t or "" for _, t in EDGES)]
    for _ in range(120):
        out.append("".join(rnd.choice(letters) if rnd.random() < 0.3 else rnd.choice("  etaoinshrdlu'\n0123.") for _ in range(rnd.randrange(150))))
    out += ["".join(rnd.choice("etaoinshrdlu") for _ in range(5000)) for _ in range(5)]
    return out


def test_byte_bpe_is_the_library(spark, corpus):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTES)
    library.no_padding()
    library.no_truncation()
    for text in samples():
        ids = library.encode(text, add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert byte_bpe.digest(BYTES, text) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
    ids = byte_bpe.encode_column(corpus, BYTES)
    assert {(r["doc_id"], r["text"]) for r in byte_bpe.decode_column(ids, BYTES).collect()} == {(r["doc_id"], r["text"] or "") for r in corpus.collect()}
    assert byte_bpe.digest_column(corpus, BYTES).count() == corpus.count()


def test_streaming_needs_only_the_lookahead():
    t = byte_bpe.tokenizer(BYTES).transducer
    rnd = random.Random(4)
    for alphabet in (b"ab", b"the ", bytes(range(256))):
        data = bytes(rnd.choice(alphabet) for _ in range(3 * t.window + 17))
        whole = t.merge([t.byte_ids[b] for b in data])
        for step in (1, 100, len(data)):
            assert list(t.stream(data[i : i + step] for i in range(0, len(data), step))) == whole
    toy = byte_bpe.Transducer([0, 1, *range(2, 256)], [(0, 1, 300), (1, 300, 301), (300, 0, 302)], {**{i: 1 for i in range(256)}, 300: 2, 301: 3, 302: 3}, window=1)
    assert 0 < toy.lookahead <= 4 and list(toy.stream([b"\0\1\1\0\1\0"])) == toy.merge([0, 1, 1, 0, 1, 0])


def test_tokens_longer_than_the_window_end():
    made, merges, length = 1000, [], {i: 1 for i in range(256)}
    left = 0
    for k in range(700):  # each token is the one before and a byte more
        merges.append((left, 1, made + k))
        left, length[made + k] = made + k, (length[left] + 1)
    t = byte_bpe.Transducer(list(range(256)), merges, length)
    assert t.window >= t.lookahead + 701
    data = bytes([0] + [1] * 700) * 3
    assert list(t.stream(data[i : i + 50] for i in range(0, len(data), 50))) == [left] * 3


def test_counts_are_the_library(corpus):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    count = token_counts.counter(PIECES).count
    assert [count(t) for t in samples()] == [len(library.encode(t)) for t in samples()] and count(None) == 0
    for r in token_counts.token_counts(corpus, PIECES, limit=20).join(corpus.select("doc_id", "text"), "doc_id").collect():
        if r["doc_id"] != 3:
            assert r["n_tokens"] == len(library.encode(r["text"] or "")) and r["over_limit"] == (r["n_tokens"] > 20) and r["n_bytes"] == len((r["text"] or "").encode())
