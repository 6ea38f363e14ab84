"""The near-duplicate stage of the pipeline on pairs close to its threshold."""

import numpy as np

import corpus_pipeline


def prose(rng, n):
    return " ".join("".join(rng.choice(list("abcdefg"), rng.integers(2, 6))) for _ in range(n))


def frame(spark, texts):
    rows = [(k, t, "en", "s", len(t)) for k, t in texts.items()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def planted_pairs(rng):
    """Originals of 200 words; copies with a block of new words that makes up 18 to 28 percent."""
    texts = {}
    for k, more in enumerate((36, 40, 44, 48, 52, 56)):
        texts[k] = prose(rng, 200)
        texts[1000 + k] = f"{texts[k]} {prose(rng, more)}"
    return texts


def one_of_each(texts, n=5, percent=80):
    sets = {k: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for k, t in texts.items() for w in [t.split()]}
    root = {k: k for k in texts}

    def find(k):
        return k if root[k] == k else find(root[k])

    for a in texts:
        for b in texts:
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {k: t for k, t in texts.items() if find(k) == k}


def test_near_duplicates_of_five_words_and_80_percent(spark):
    texts = planted_pairs(np.random.default_rng(3))
    kept = {r.doc_id for r in corpus_pipeline.one_of_each_group(spark, frame(spark, texts), "").collect()}
    assert kept == set(one_of_each(texts))
    assert 6 <= len(kept) < 12
