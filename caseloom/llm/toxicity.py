"""Toxicity categories by a chain of linear classifiers.

Categories are predicted one after the other; each model reads the words of the
text and the probabilities of the categories before it. While training, those
probabilities come from models that did not see the row (out of fold), so later
models meet inputs as uncertain as they will be in use.

Features are the presence of words and of word beginnings. Models are fitted on
a bounded sample of labelled rows (``max_rows`` of either class, by hash order,
weighted to their shares among all labels); every row of the corpus is scored on its whole text. Null and empty texts have
no features and get the intercept's probabilities. Null labels are not used.
Rows with the same id are joined with every label row of that id; a text
labelled twice counts twice. Without rows of both classes, a category's
probability is its share in the sample (0 without rows). Other columns are
ignored, or kept where :func:`score` is told to; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import chunks, split_words

#: Labelled rows used at most: toxic and other. Weights restore their shares among all labels.
MAX_ROWS = (3000, 5000)
FOLDS = 5
#: Features kept for each category.
MAX_FEATURES = 6000
PREFIX_BYTES = (6, 9)
MIN_DOCS = 3


def text_features(texts: list[bytes | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, text of each feature, feature hash), in chunks; repeats included."""
    for first, part in chunks(texts):
        words = split_words(part, letters_only=True)
        owner = np.repeat(np.arange(len(part)), words.per_text)
        owners, keys = [owner], [words.hash]
        for size in PREFIX_BYTES:
            long = words.end - words.start > size
            owners.append(owner[long])
            keys.append(words.range_hash(words.start[long], words.start[long] + size) ^ np.uint64(size))
        yield first, np.concatenate(owners), np.concatenate(keys)


def _binary(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def gather(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], main: str, max_rows: tuple[int, int] = MAX_ROWS) -> DataFrame:
    """Sampled labelled rows: 0/1 targets, weight and the distinct features of the text.

    ``main`` names the category by whose classes rows are sampled.
    """
    rows = labels.select("doc_id", *[c.cast("int").alias(f"y_{n}") for n, c in categories.items()]).dropna()
    there = {r[0]: r[1] for r in rows.groupBy(f"y_{main}").count().collect()}  # two rows
    picked = None
    for value, most in ((1, max_rows[0]), (0, max_rows[1])):
        weight = there.get(value, 0) / max(1, min(most, there.get(value, 0)))
        part = rows.where(F.col(f"y_{main}") == value).orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(most).withColumn("weight", F.lit(float(weight)))
        picked = part if picked is None else picked.unionByName(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[bytes] = []
            for _, owner, key in text_features(_binary(batch.column(0))):
                order = np.argsort(owner, kind="stable")
                owner, key = owner[order], key[order]
                n = int(owner.max(initial=-1)) + 1
                cuts = np.searchsorted(owner, np.arange(n + 1))
                found += [np.unique(key[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
            found += [b""] * (batch.num_rows - len(found))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, pa.binary())], names=[*batch.schema.names[1:], "features"])

    names = [*[f"y_{n}" for n in categories], "weight"]
    schema = ", ".join(f"{n} int" for n in names[:-1]) + ", weight double, features binary"
    picked = F.broadcast(picked)  # max_rows bounds it
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(picked, "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), *names).mapInArrow(run, schema)


def probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Chain:
    """names; sorted feature hashes; weights [category, feature]; weights on earlier categories' probabilities; intercepts."""

    names: list[str]
    features: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: np.ndarray

    def probabilities(self, n: int, owner: np.ndarray, feature: np.ndarray) -> np.ndarray:
        """[n, category] for n texts with (owner, feature number) pairs, each pair once."""
        out = np.zeros((n, len(self.names)))
        for c in range(len(self.names)):
            out[:, c] = probability(self.bias[c] + np.bincount(owner, weights=self.weights[c][feature], minlength=n) + out @ self.earlier[c])
        return out


def _fit(rows: np.ndarray, cols: np.ndarray, n: int, dims: int, extra: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 0.02, steps: int = 250):
    """Logistic regression by Nesterov's gradient on sparse 0/1 features and some dense ones."""
    if y.min(initial=1) == y.max(initial=0) or not n:
        share = float(np.clip(np.average(y, weights=weight) if n else 0.0, 1e-6, 1 - 1e-6))
        return np.zeros(dims), np.zeros(extra.shape[1]), float(np.log(share / (1 - share)))
    w, v, b = np.zeros(dims), np.zeros(extra.shape[1]), 0.0
    sums = [np.zeros(dims), np.zeros(extra.shape[1]), 0.0]
    weight = weight / weight.sum()
    for _ in range(steps):
        z = np.bincount(rows, weights=w[cols], minlength=n) + extra @ v + b
        g = (probability(z) - y) * weight
        grads = (np.bincount(cols, weights=g[rows], minlength=dims) + l2 * w / n, extra.T @ g + l2 * v / n, g.sum())
        steps_out = []
        for k, grad in enumerate(grads):
            sums[k] = sums[k] + grad * grad
            steps_out.append(0.5 * grad / (np.sqrt(sums[k]) + 1e-9))
        w, v, b = w - steps_out[0], v - steps_out[1], b - steps_out[2]
    return w, v, float(b)


def _select(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, mask: np.ndarray, size: int, most: int) -> np.ndarray:
    """Features by strength of association (z of the log-odds ratio) among the texts in ``mask``, sorted."""
    total = np.bincount(cols, minlength=size)
    pos = np.bincount(cols, weights=y[rows], minlength=size)
    neg = total - pos
    p = max(y[mask].sum(), 1)
    q = max(mask.sum() - y[mask].sum(), 1)
    ratio = np.log((pos + 0.5) / (p - pos + 0.5)) - np.log((neg + 0.5) / (q - neg + 0.5))
    z = ratio / np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))
    good = np.flatnonzero((total >= MIN_DOCS) & (np.abs(z) >= 2.5))
    return np.sort(good[np.argsort(-np.abs(z[good]), kind="stable")][:most])


def train(sample: DataFrame, categories: list[str], folds: int = FOLDS, max_features: int = MAX_FEATURES) -> Chain:
    """Fit the chain on the gathered sample (bounded by its ``max_rows``)."""
    return fit_chain(sample.toArrow(), categories, folds, max_features)[0]


def fit_chain(got: pa.Table, categories: list[str], folds: int = FOLDS, max_features: int = MAX_FEATURES) -> tuple[Chain, np.ndarray, np.ndarray]:
    """The chain, and of the sample's rows the labels and the probabilities by models that did not see them."""
    blobs = got["features"].to_pylist()
    order = sorted(range(len(blobs)), key=lambda k: (blobs[k], *(got[f"y_{c}"][k].as_py() for c in categories)))
    ys = [got[f"y_{c}"].to_numpy()[order].astype(float) if len(order) else np.zeros(0) for c in categories]
    weight = got["weight"].to_numpy()[order] if len(order) else np.zeros(0)
    n = len(blobs)
    rows = np.repeat(np.arange(n, dtype=np.int32), [len(blobs[k]) // 8 for k in order]) if n else np.empty(0, np.int32)
    keys = np.frombuffer(b"".join(blobs[k] for k in order), np.uint64)
    del blobs, got, order
    # What too few texts of the sample have is never chosen; no label has a say in that.
    features = np.unique(keys)
    cols = np.empty(len(keys), np.int32)
    for at in range(0, len(keys), 1 << 20):
        cols[at : at + (1 << 20)] = np.searchsorted(features, keys[at : at + (1 << 20)])
    del keys
    common = np.bincount(cols, minlength=len(features)) >= MIN_DOCS
    number = (np.cumsum(common) - 1).astype(np.int32)
    use = common[cols]
    rows, cols, features = rows[use], number[cols[use]], features[common]
    del common, number, use
    fold = np.arange(n) % folds
    weights = np.zeros((len(ys), len(features)))
    earlier = np.zeros((len(ys), len(ys)))
    bias = np.zeros(len(ys))
    outside = np.zeros((n, len(ys)))  # probabilities by models that did not see the row

    def fit(mask: np.ndarray, c: int):
        """Features are chosen from the rows in ``mask`` alone, so a model knows nothing of the labels of others."""
        part = mask[rows]
        some, which = rows[part], cols[part]
        chosen = _select(some, which, ys[c], mask, len(features), max_features)
        place = np.full(len(features), -1, np.int32)
        place[chosen] = np.arange(len(chosen))
        use = place[which] >= 0
        renum = (np.cumsum(mask) - 1).astype(np.int32)
        w, v, b = _fit(renum[some[use]], place[which[use]], int(mask.sum()), len(chosen), outside[mask][:, :c], ys[c][mask], weight[mask])
        full = np.zeros(len(features))
        full[chosen] = w
        return full, v, b

    for c in range(len(ys)):
        for f in range(folds):
            held = fold == f
            if not held.any():
                continue
            w, v, b = fit(~held, c)
            z = b + np.bincount(rows, weights=w[cols], minlength=n) + outside[:, :c] @ v
            outside[held, c] = probability(z[held])
        weights[c], v, bias[c] = fit(np.ones(n, bool), c)
        earlier[c, :c] = v
    used = (weights != 0).any(axis=0)
    return Chain(list(categories), features[used], weights[:, used], earlier, bias), np.stack(ys, axis=1) if ys else np.zeros((n, 0)), outside


def score(docs: DataFrame, chain: Chain, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` (doc_id by default) and a probability for each category, p_<name>."""
    keep = keep or ["doc_id"]
    taken = {f"p_{c}" for c in chain.names} & set(keep)
    if taken:
        raise ValueError(f"columns {sorted(taken)} are made here")
    sent = docs.sparkSession.sparkContext.broadcast(chain)  # bounded by MAX_FEATURES for each category
    names = [f"p_{c}" for c in chain.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        table = np.zeros(1 << 20, dtype=bool)  # a first sieve on the low bits of known features
        table[(model.features & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        for batch in batches:
            probs = np.zeros((batch.num_rows, len(model.names)))
            texts = _binary(batch.column(place))
            for first, owner, key in text_features(texts):
                n = min(len(texts) - first, int(owner.max(initial=-1)) + 1)
                hit = table[(key & np.uint64((1 << 20) - 1)).astype(np.int64)]
                owner, key = owner[hit], key[hit]
                at = np.searchsorted(model.features, key)
                ok = at < len(model.features)
                ok[ok] = model.features[at[ok]] == key[ok]
                pair = np.unique(owner[ok].astype(np.int64) * (len(model.features) + 1) + at[ok])
                probs[first : first + n] = model.probabilities(n, pair // (len(model.features) + 1), pair % (len(model.features) + 1))[:n]
            empty = np.fromiter((not t or not t.strip() for t in texts), bool, len(texts))
            if empty.any():
                probs[empty] = model.probabilities(1, np.empty(0, np.int64), np.empty(0, np.int64))[0]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *[pa.array(probs[:, c]) for c in range(len(names))]], names=[*keep, *names])

    kinds = dict(docs.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + [f"`{c}` double" for c in names])
    sent_columns = keep if "text" in keep else [*keep, "text"]
    place = sent_columns.index("text")
    return docs.select(*sent_columns).mapInArrow(run, schema)


#: Categories of the labelled tables, in chain order: 0/1 columns made from quality and toxic.
def categories() -> dict[str, Column]:
    toxic, quality = F.col("toxic"), F.col("quality")
    return {"junk": (quality == 0), "toxic": (toxic == 1), "toxic_prose": (toxic == 1) & (quality == 1)}


THRESHOLD = 0.5


def fit_corpus(docs: DataFrame, labels: DataFrame, max_rows: tuple[int, int] = MAX_ROWS) -> Chain:
    """The chain for documents (doc_id, text) and labels (doc_id, quality, toxic)."""
    cats = categories()
    return train(gather(docs, labels, cats, "toxic", max_rows), list(cats))


def is_toxic() -> Column:
    return F.greatest("p_toxic", "p_toxic_prose") >= F.lit(THRESHOLD)
