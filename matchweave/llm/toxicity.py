"""Toxicity: averaged subword embeddings under a linear softmax, trained jointly in numpy.

A text's features are the character n-grams inside its words (with a mark at
both ends of a word), hashed into buckets.  Each bucket has an embedding; a text
is the average of its n-grams' embeddings, and a softmax over two classes sits on it.
Embeddings and softmax are learned together.  A misspelling shares most n-grams with
the word, so it need not have been seen.

As averaging is linear, a trained model folds into one number per bucket: the
difference of the two classes' logits.  Scoring a text is the mean of these numbers
over its n-grams, a few vector operations for many texts at once.

Labels are learned from at most ``positive`` and ``negative`` labelled rows of the two classes, a documented bound: those
with the smallest hash of their id.  Null and empty texts have no n-grams and get the score of the bias
alone.  Conflicting labels of one id count as the larger; null labels and labels of null ids are not used; of rows with one id the
text with the smallest hash is learned.  Rows are scored one by one, repeated and null ids too; an empty table gives an empty result, and
without two classes to learn from all texts get the share of class 1.  Texts of any length are taken whole, in memory that grows with
one text; columns that are not named are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchweave.llm.shared import SPACE_CODES, lean, text_groups

#: n-gram lengths, log2 of the buckets, embedding size, the gain of the average (it keeps gradients of long texts from vanishing),
#: and n-grams of weight 0 that every text has besides its own (they keep a few words from deciding).
LENGTHS, BITS, DIM, GAIN, PRIOR = (3, 4, 5), 17, 8, 20.0, 400


def ngram_buckets(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram length: (bucket of each n-gram that starts at some character, first n-gram of each text and the end)."""
    lowered = [x.lower() for x in texts]
    codes = np.frombuffer((" " + " ".join(lowered) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    starts = np.concatenate(([0], np.cumsum([len(x) + 1 for x in lowered])))
    space = np.isin(codes, SPACE_CODES)
    codes[space] = 32
    inner = np.concatenate(([0], np.cumsum(space)))
    out, h = [], codes
    with np.errstate(over="ignore"):
        for n in range(2, max(LENGTHS) + 1):
            h = h[:-1] * np.uint64(0x100000001B3) + codes[n - 1 :]
            if n in LENGTHS:
                at = np.arange(len(h))
                whole = np.flatnonzero(inner[at + n - 1] == inner[at + 1])  # no space but at the ends
                bucket = ((h[whole] ^ np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
                out.append((bucket.astype(np.int64), np.searchsorted(whole, starts)))
    return out


def mean_weights(texts: list[str], weights: np.ndarray) -> np.ndarray:
    """The mean of the weights of each text's n-grams and PRIOR zeros."""
    total, count = np.zeros(len(texts)), np.zeros(len(texts))
    for bucket, starts in ngram_buckets(texts):
        sums = np.concatenate(([0.0], np.cumsum(weights[bucket], dtype=np.float64)))
        total += sums[starts[1:]] - sums[starts[:-1]]
        count += np.diff(starts)
    return total / (count + PRIOR)


class Model:
    """One weight per bucket and a bias: log-odds of class 1 is their mean over a text's n-grams plus the bias."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def score(self, texts: list) -> np.ndarray:
        parts = [mean_weights(g, self.weights) for g in text_groups(texts)]
        return 1 / (1 + np.exp(-np.clip((np.concatenate(parts) if parts else np.zeros(0)) + self.bias, -60, 60)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 12, steps: int = 400, batch: int = 128, rate: float = 0.3, start: float = 2.0, seed: int = 7) -> Model:
    """Embeddings and softmax trained together by Adagrad on sparse averages: rows of (distinct buckets, their counts).  There are ``steps`` steps at least.  The bias starts at ``start`` times the log shares of the classes."""
    random = np.random.default_rng(seed)
    embedding = random.uniform(-1, 1, (1 << BITS, DIM)) / DIM
    out, bias = random.uniform(-1, 1, (DIM, 2)) / DIM, np.log(np.maximum(np.bincount(labels, minlength=2), 1) / len(labels)) * start
    seen_e, seen_o, seen_b = np.full(1 << BITS, 1e-8), np.full(out.shape, 1e-8), np.full(2, 1e-8)
    for _ in range(max(epochs, -(-steps * batch // max(1, len(rows))))):
        order = random.permutation(len(rows))
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            index = np.concatenate([rows[i][0] for i in part])
            sizes = np.array([len(rows[i][0]) for i in part])
            value = np.concatenate([GAIN * rows[i][1] / (rows[i][1].sum() + PRIOR) for i in part])
            text = np.repeat(np.arange(len(part)), sizes)
            average = np.stack([np.bincount(text, value * embedding[index, d], minlength=len(part)) for d in range(DIM)], 1)
            logits = average @ out + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), labels[part]] -= 1
            p /= len(part)
            back = p @ out.T
            used, where = np.unique(index, return_inverse=True)
            gradient = np.stack([np.bincount(where, value * back[text, d], minlength=len(used)) for d in range(DIM)], 1)
            seen_e[used] += (gradient**2).mean(1)
            embedding[used] -= rate * gradient / np.sqrt(seen_e[used])[:, None]
            for value_, seen, g, step in ((out, seen_o, average.T @ p, 0.3), (bias, seen_b, p.sum(0), 1.0)):
                seen += g**2
                value_ -= step * rate * g / np.sqrt(seen)
    return Model((GAIN * (embedding @ (out[:, 1] - out[:, 0]))).astype(np.float32), float(bias[1] - bias[0]))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether crc32 of the id as text is divisible by ``folds``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def _features(batches):
    for batch in batches:
        buckets, counts = [], []
        for x in batch.column(1).to_pylist():
            b, n = np.unique(np.concatenate([bucket for bucket, _ in ngram_buckets([x or ""])]), return_counts=True)
            buckets.append(b.astype(np.int32))
            counts.append(n.astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(buckets, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32())), batch.column(2)], names=["id", "buckets", "counts", "label"])


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", positive: int = 1000, negative: int = 3000, doc_id: str = "doc_id", text: str = "text") -> Model:
    """A model from the labelled documents that are not held out, at most ``positive`` of class 1 and ``negative`` of class 0.

    The rows are chosen on ids alone; executors turn the chosen texts into counts of buckets (at most
    2**BITS numbers a text, however long it is), and only these reach the driver.
    """
    known = labels.filter(F.col(label).isin(0, 1) & ~held_out(F.col(doc_id)) & F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.max(label).cast("int").alias("label"))
    order = [F.xxhash64(F.lit("train"), F.col(doc_id)), F.col(doc_id)]
    # both limits are the documented bound, so the chosen ids can be broadcast
    chosen = known.filter("label = 1").orderBy(*order).limit(positive).unionByName(known.filter("label = 0").orderBy(*order).limit(negative))
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen.withColumnRenamed(doc_id, "id")), "id")
    rows = rows.groupBy("id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("r")).select("id", "r.text", "label")
    rows = rows.mapInArrow(lean(_features), f"id {kind}, buckets array<int>, counts array<int>, label int").toArrow()
    rows = rows.sort_by("id")
    target = np.asarray(rows.column("label"), np.int64) if len(rows) else np.zeros(0, np.int64)
    if len(np.unique(target)) < 2:  # nothing to tell apart: the share of class 1, for every text
        p = (target.sum() + 0.5) / (len(target) + 1)
        return Model(np.zeros(1 << BITS, np.float32), float(np.log(p / (1 - p))))
    part = [(b.values.to_numpy(), c.values.to_numpy().astype(np.float32)) for b, c in zip(rows.column("buckets"), rows.column("counts"), strict=True)]
    return fit(part, target)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: id, held_out, score, predicted (score >= 0.5), and the columns in ``keep``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(texts.to_pylist()), pa.float64())

    out = docs.select(F.col(doc_id), held_out(F.col(doc_id)).alias("held_out"), scored(F.col(text)).alias("score"), *keep)
    return out.select(doc_id, "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *keep)
