"""Toxicity by classifier chains over bags of words.

A chain predicts categories one after another: the linear model of a category sees the words and the
probabilities of the categories before it. Those probabilities are out-of-fold ones while training, so that a
later model learns from what an earlier one says of texts it has not seen. The vocabulary comes from word counts
over the labelled sample, made in Spark; the models are fitted on that bounded sample; every document is scored
whole, in its own task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows to learn from, and words of the vocabulary, at most.
MAX_LABELLED, MAX_WORDS, FOLDS = 12_000, 384, 5
#: A word, in Spark and in Python alike: a run of letters of the lower-cased text.
WORD = r"\p{L}+"
_WORD = regex.compile(WORD)


def words(text: str | None) -> set[str]:
    """Different lower-cased words."""
    return set(_WORD.findall((text or "").lower()))


def words_column(text: Column) -> Column:
    """``words`` as an expression."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_linear(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 150) -> np.ndarray:
    """Logistic regression by accelerated gradient steps; the last weight is the intercept (not penalised)."""
    n, d = x.shape
    w, v = np.zeros(d + 1, np.float32), np.zeros(d + 1, np.float32)
    rate = np.float32(1 / (0.25 * max(1.0, float((x**2).sum(axis=1).mean()) + 1) + l2 / max(1, n)))
    for t in range(1, steps + 1):
        p = _sigmoid(x @ v[:-1] + v[-1])
        g = np.append(x.T @ (p - y) / n + l2 / n * v[:-1], (p - y).mean()).astype(np.float32)
        new = v - rate * g
        v = new + np.float32((t - 1) / (t + 2)) * (new - w)
        w = new
    return w


def _folds(keys: np.ndarray, k: int) -> np.ndarray:
    """Equal keys (copies of a text) share a fold; the order of rows does not matter."""
    return (keys.astype(np.uint64) % np.uint64(k)).astype(np.int64)


@dataclass(frozen=True)
class Chain:
    categories: tuple[str, ...]
    vocabulary: dict[str, int]
    weights: tuple[np.ndarray, ...]
    thresholds: tuple[float, ...]
    held_out: dict[str, float] = field(default_factory=dict)  # F1 of out-of-fold predictions

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = np.zeros((len(texts), len(self.vocabulary)), np.float32)
        for i, t in enumerate(texts):
            x[i, [j for w in words(t) if (j := self.vocabulary.get(w)) is not None]] = 1
        out = np.zeros((len(texts), 0), np.float32)
        for w in self.weights:
            full = np.hstack([x, out])
            out = np.hstack([out, _sigmoid(full @ w[:-1] + w[-1])[:, None].astype(np.float32)])
        return out


def _threshold(p: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The cut of the best F1 on out-of-fold probabilities, midway between neighbouring scores; and that F1."""
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + max(1, y.sum()))
    last = np.append(p[order][1:] < p[order][:-1], True)  # ties are cut together
    i = int(np.argmax(np.where(last, f1, -1)))
    s = p[order]
    return float((s[i] + (s[i + 1] if i + 1 < len(s) else 0)) / 2), float(f1[i])


def train(texts: list[str | None], labels: np.ndarray, categories: tuple[str, ...], vocabulary: list[str], keys: np.ndarray, folds: int = FOLDS) -> Chain:
    """A chain over (n, categories) 0/1 labels. A category with one label only is always predicted so."""
    vocab = {w: i for i, w in enumerate(vocabulary)}
    x = np.zeros((len(texts), len(vocab)), np.float32)
    for i, t in enumerate(texts):
        x[i, [j for w in words(t) if (j := vocab.get(w)) is not None]] = 1
    fold, weights, cuts, held = _folds(keys, folds), [], [], {}
    for c, name in enumerate(categories):
        y = labels[:, c].astype(np.float32)
        p = np.zeros(len(y), np.float32)
        for f in range(folds):
            test = fold == f
            if test.any() and (~test).any():
                w = fit_linear(x[~test], y[~test])
                p[test] = _sigmoid(x[test] @ w[:-1] + w[-1])
        weights.append(fit_linear(x, y) if len(y) else np.append(np.zeros(x.shape[1]), -9).astype(np.float32))
        cut, held[name] = _threshold(p, y) if 0 < y.sum() < len(y) else (1.1 if not y.sum() else -0.1, 1.0)
        cuts.append(cut)
        x = np.hstack([x, p[:, None]])
    return Chain(categories, vocab, tuple(weights), tuple(cuts), held)


def vocabulary(sample: DataFrame, categories: tuple[str, ...], size: int = MAX_WORDS) -> list[str]:
    """The words of the largest chi-squared score for any category, of those in three or more texts.

    ``sample``: ``text`` and a 0/1 column for each category. Counted in Spark; ``size`` words come back.
    """
    w = sample.select(F.explode(words_column(F.col("text"))).alias("w"), *categories)
    n = sample.agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in categories)).first()
    counts = w.groupBy("w").agg(F.count("*").alias("df"), *(F.sum(c).alias(c) for c in categories)).where("df >= 3")
    score = F.lit(0.0)
    for c in categories:
        if n[c] and n[c] < n.n:
            a, expected = F.col(c).cast("double"), F.col("df") * (n[c] / n.n)
            score = F.greatest(score, (a - expected) ** 2 / (expected * (1 - n[c] / n.n)))
    top = counts.select("w", score.alias("s")).orderBy(F.desc("s"), "w").limit(size)
    return [r.w for r in top.collect()]


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, str], id_col: str = "doc_id", text: str = "text", max_labelled: int = MAX_LABELLED, max_words: int = MAX_WORDS) -> Chain:
    """Learn a chain from at most ``max_labelled`` labelled documents, those of the least id hashes.

    ``categories`` maps a name to a boolean SQL expression over ``labels``, in the chain's order. Labelled rows
    without a document, and rows with a null id or label, are left out; of documents that share an id the one of the
    least hash is taken. The sample's ids, at most
    ``max_labelled`` of them, are broadcast; its texts come to the driver in slices.
    """
    names = tuple(categories)
    picked = labels.select(F.col(id_col).alias("__i"), *(F.expr(e).cast("int").alias(n) for n, e in categories.items())).dropna()
    picked = picked.distinct().orderBy(F.xxhash64("__i"), "__i", *names).limit(max_labelled)
    sample = docs.select(F.col(f"`{id_col}`").alias("__i"), F.col(f"`{text}`").cast("string").alias("text")).join(F.broadcast(picked), "__i")
    vocab = vocabulary(sample, names, max_words)
    known = set(vocab)
    # Only words of the vocabulary reach the driver, at most max_words a row; a row for each label.
    seen = F.array_join(F.array_intersect(words_column(F.col("text")), F.array(*map(F.lit, vocab)) if vocab else F.array().cast("array<string>")), " ")
    rows = sample.groupBy("__i", *names).agg(F.min(F.struct(F.xxhash64("text").alias("key"), seen.alias("text"))).alias("r")).select("__i", *names, "r.*").collect()
    rows.sort(key=lambda r: (r.key, str(r["__i"])))
    y = np.array([[r[n] for n in names] for r in rows], np.float32).reshape(len(rows), len(names))
    return train([r.text for r in rows], y, names, vocab, np.array([r.key for r in rows], np.int64)) if known or rows else train([], y, names, [], np.zeros(0, np.int64))


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_col``, ``p_<category>`` and the boolean ``<category>`` for every row.

    Null and empty texts have no words. Rows are scored one by one, so repeated rows are alike. Null ids are
    kept; other columns are not read; an empty table gives an empty result. The chain is bounded by its
    vocabulary and travels with the tasks.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("t"))
    names = [f"p_{c}" for c in chain.categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = chain.scores(b.column(1).to_pylist())
            # Rounded so that the order of a batch's rows cannot show.
            cols = [pa.array(np.round(p[:, i].astype(np.float64), 4)) for i in range(p.shape[1])]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["id", *names])

    out = src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, " + ", ".join(f"{n} double" for n in names))
    flags = [(F.col(f"p_{c}") >= t).alias(c) for c, t in zip(chain.categories, chain.thresholds)]
    return out.select(F.col("id").alias(id_col), *names, *flags)
