"""Words that a polynomial hash modulo 2^64 cannot tell apart, whatever its base, against the libraries and brute force."""

import numpy as np
import public_tokenizers as tokenizers
import pytest

from caseloom.llm import ngram_join, sentencepiece_fst, token_ids, words


def thue_morse(n, a="a", b="b"):
    word = np.array([bin(k).count("1") % 2 for k in range(n)])
    return "".join(np.where(word, b, a)), "".join(np.where(word, a, b))


PAIRS = [thue_morse(n) for n in (8, 64, 1024, 4096)]
TEXTS = [f"{w} tail" for pair in PAIRS for w in pair] * 2


@pytest.mark.parametrize("letters_only", [False, True])
def test_hashes_differ(letters_only):
    flat = [w.encode() for pair in PAIRS for w in pair]
    assert len(set(words.split_words(flat, letters_only).hash.tolist())) == len(flat)


def test_hash_depends_on_bytes_alone():
    rng = np.random.default_rng(0)
    parts = [bytes(rng.integers(97, 99, n, dtype=np.uint8)) for n in (1, 7, 8, 9, 16, 17, 255, 256, 257, 900) for _ in range(20)]
    a, b = words.split_words(parts), words.split_words([b"xx " + b" ".join(parts)])
    assert (a.hash == b.hash[1:]).all()
    assert len(set(a.hash.tolist())) == len(set(parts))


def test_tokenizer_ids():
    from tokenizers import Tokenizer

    path = tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    for t, ids in zip(TEXTS, token_ids.RunEncoder(path).encode([t.encode() for t in TEXTS]), strict=True):
        assert tokenizer.encode(t, add_special_tokens=False).ids == ids.tolist()


def test_remembered_runs_are_compared_byte_by_byte(monkeypatch):
    """Even if all runs of one length had one hash."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_ids, "hash_ranges", lambda raw, start, end: (end - start).astype(np.uint64))
    path = tokenizers.path("word_bpe_49k.json")
    tokenizer, rng = Tokenizer.from_file(path), np.random.default_rng(1)
    texts = [" ".join("".join(rng.choice(list("abcdé1"), rng.integers(1, 20))) for _ in range(30)) for _ in range(20)] * 2
    for t, ids in zip(texts, token_ids.RunEncoder(path).encode([t.encode() for t in texts]), strict=True):
        assert tokenizer.encode(t, add_special_tokens=False).ids == ids.tolist()


def test_sentencepiece_ids():
    import sentencepiece

    path = tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    machine = sentencepiece_fst.Encoder(sentencepiece_fst.Transducer(sentencepiece_fst.Model.read(path)))
    for t, ids in zip(TEXTS, machine.encode([t.encode() for t in TEXTS]), strict=True):
        assert model.encode(t) == ids.tolist()


def test_no_false_links(spark):
    texts = [w for pair in PAIRS for w in pair]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert all(r.component_id == r.doc_id for r in ngram_join.ngram_components(docs).collect())
