"""Texts made to mislead: hash collisions among letters, odd page mark-up, labels without meaning."""

import time

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from caseloom.llm import html_extract, sentencepiece_fst, toxicity


def test_letters_decide_not_their_hash():
    """Eight letters whose polynomial hash is that of a piece."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    machine = sentencepiece_fst.Encoder(sentencepiece_fst.Transducer(sentencepiece_fst.Model.read(path)))
    hashed = sentencepiece_fst.Transducer._piece_hash
    odd = "ӄθρѡЃљѴЩ"
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [odd, "a" + odd, f"x {odd} y", odd + "ственной", "ственной" + odd]
    assert hashed(odd) == hashed("ственной")
    for t, ids in zip(texts, machine.encode([t.encode() for t in texts]), strict=True):
        assert ids.tolist() == library.encode(t)


def text_of(spark, *bodies):
    rows = [(k, f"http://h{k}.org/x", f"<html><body><nav>menu</nav>{b}<footer>foot</footer></body></html>") for k, b in enumerate(bodies)]
    got = html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return [r.text for r in sorted(got, key=lambda r: r.page_id)]


def test_article_text_stays_and_comments_go(spark):
    kept = [
        '<h2 class="section-header">Title</h2><p>Body.</p>', '<h1 class="header">Title</h1><p>Body.</p>', '<table class="menu"><tr><td>Title</td></tr></table><p>Body.</p>',
        '<p class="social">Title</p><p>Body.</p>', "<p><label>Title</label></p><p>Body.</p>", "<p><math>Title</math></p><p>Body.</p>", '<div data-id="sidebar">Title</div><p>Body.</p>',
        '<div data-role="dialog">Title</div><p>Body.</p>', '<div data-class="ad">Title</div><p>Body.</p>', """<div title='x class="ad" y'>Title</div><p>Body.</p>""",
    ]
    gone = ['<div class="ad">Buy</div>', '<div id="sidebar">Side</div>', '<section class="comments"><p>Reader</p></section>', '<article class="comment"><p>Reader</p></article>', '<ol class="comments"><li class="comment">Reader</li></ol>', '<div role="dialog">Accept</div>', "<form><label>Name</label></form>"]
    got = text_of(spark, *[f"<article>{k}</article>" for k in kept], *[f"<article><p>Title</p><p>Body.</p>{g}</article>" for g in gone], '<article><p>Title</p><p>Body.</p></article><article class="comment"><p>Reader</p></article>')
    assert got == ["Title\n\nBody."] * (len(kept) + len(gone) + 1)


@pytest.mark.parametrize("html", ["<a x " * 200_000, "<span>" * 60_000 + "</b>" * 60_000, "<div><p>" * 30_000 + "</i></p>" * 30_000, "</script " * 50_000, "<p>" * 100_000, "<a '" * 100_000 + ">"])
def test_broken_pages_take_linear_time(html):
    began = time.perf_counter()
    html_extract.parse(html)
    assert time.perf_counter() - began < 8


def test_labels_without_meaning_are_not_learnt(spark):
    """Random features and labels: models that did not see a row know nothing of it."""
    rng = np.random.default_rng(11)
    words = np.array([f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(400)])
    rows = [(k, " ".join(rng.choice(words, 30)), int(rng.random() < 0.5), int(rng.random() < 0.5)) for k in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, first int, second int")
    categories = {"first": F.col("first"), "second": F.col("second")}
    sample = toxicity.gather(frame.select("doc_id", "text"), frame.select("doc_id", "first", "second"), categories, "first")
    _, labels, outside = toxicity.fit_chain(sample.toArrow(), list(categories))
    for c in range(2):
        order = np.argsort(outside[:, c])
        place = np.empty(len(order))
        place[order] = np.arange(len(order))
        y = labels[:, c] == 1
        auc = (place[y].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (~y).sum())
        assert abs(auc - 0.5) < 0.05


def test_known_pairs_are_copied_seldom(monkeypatch):
    """Pairs worked out go in among the known ones in bulk (all known ones were copied for every few before); ids stay the same."""
    import public_tokenizers

    model = sentencepiece_fst.Model.read(public_tokenizers.path("piece_bpe_32k.model"))
    rng = np.random.default_rng(3)
    letters = np.array(list("etaoinshrdlucmfwypvbgk"))
    texts = [("  ".join("".join(rng.choice(letters, rng.integers(1, 9))) for _ in range(60)) + "   ☃").encode() for _ in range(100)]
    copied, insert = [], np.insert

    def counted(old, place, more):
        if old.dtype == np.int64 and len(old):
            copied.append(len(old))
        return insert(old, place, more)

    monkeypatch.setattr(sentencepiece_fst.np, "insert", counted)
    got = []
    for fresh, known in ((8, 40), (1 << 15, 2_000_000), (512, 2_000_000)):
        monkeypatch.setattr(sentencepiece_fst, "FRESH_PAIRS", fresh, raising=False)
        monkeypatch.setattr(sentencepiece_fst, "KNOWN_PAIRS", known, raising=False)
        machine = sentencepiece_fst.Transducer(model)
        copied.clear()
        encoder = sentencepiece_fst.Encoder(machine)
        got.append([ids.tolist() for k in range(0, 100, 10) for ids in encoder.encode(texts[k : k + 10])])
        assert [machine.decode(np.array(ids)) for ids in got[-1]] == texts
    assert sum(copied) < 100 * max(copied)
    assert got[0] == got[1] == got[2]
