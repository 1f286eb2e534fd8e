"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

A text is folded to lower case; ASCII signs other than letters become word ends. Every subword of two, three and four
bytes is hashed to a bucket with an embedding; the text is the average of its subwords' embeddings, a softmax layer gives the languages.
Because average and layer are linear, prediction uses the product of both tables. A temperature fitted on validation
rows calibrates the score; ``rejected`` marks scores under the level that keeps 99.5 % of the correct validation rows.

Defined cases: a null text, an empty one or one without letters is ``und`` with score 0; without labelled rows every
text is ``und``; texts are read whole, in chunks; equal texts get equal answers; lang, source and doc_id are never
inputs of a prediction; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS, DIM, CHUNK = 1 << 14, 16, 1 << 20
LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.array([c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256)], np.uint32)


def subword_counts(text: str) -> np.ndarray:
    """Occurrences of the hashed subwords of the whole text, by bucket."""
    data = _FOLD[np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b" ", np.uint8)]
    counts = np.zeros(BUCKETS, np.float32)
    for at in range(0, len(data), CHUNK):
        part = data[at : at + CHUNK + 3]
        code = part[:-1] * np.uint32(0x9E3779B1) + part[1:] * np.uint32(0x85EBCA6B)
        inner = (part[:-1] != 32) | (part[1:] != 32)
        for n in (2, 3, 4):
            if n > 2:
                if len(part) < n:
                    break
                code = code[: len(part) - n + 1] * np.uint32(0x27D4EB2F) + part[n - 1 :] * np.uint32(0xC2B2AE3D)
                inner = inner[: len(code)] & (part[n - 2 : n - 2 + len(code)] != 32)  # no subword spans a word end
            full = len(data) - at > CHUNK + 3
            use = slice(0, CHUNK) if full else slice(None)
            counts += np.bincount(((code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(18))[use][inner[use]], minlength=BUCKETS).astype(np.float32)
    return counts


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # BUCKETS x languages: embeddings times the softmax layer
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def logits(self, text: str) -> np.ndarray:
        counts = subword_counts(text)
        return counts @ self.table / max(float(counts.sum()), 1.0) + self.bias

    def predict(self, text) -> tuple[str, float]:
        if not self.langs or not isinstance(text, str) or not LETTER.search(text):
            return "und", 0.0
        p = softmax(self.logits(text)[None] / self.temperature)[0]
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, str]], epochs: int = 30, rate: float = 20.0, batch: int = 16, seed: int = 7) -> Model:
    """Stochastic gradient descent on (subword counts, language) rows; every fifth row validates."""
    langs = sorted({lang for _, lang in rows})
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32))
    x = np.stack([c / max(float(c.sum()), 1.0) for c, _ in rows]).astype(np.float32)
    y = np.array([langs.index(lang) for _, lang in rows])
    train = [i for i in range(len(rows)) if i % 5] or list(range(len(rows)))
    check = [i for i in range(len(rows)) if i % 5 == 0]
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = rng.normal(0, 0.1, (DIM, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)
    for epoch in range(epochs):
        step = np.float32(rate * (1 - epoch / epochs))
        order = rng.permutation(train)
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            used = np.flatnonzero(x[pick].any(axis=0))
            part = x[np.ix_(pick, used)]
            hidden = part @ embed[used]
            error = softmax(hidden @ layer + bias)
            error[np.arange(len(pick)), y[pick]] -= 1
            error /= len(pick)
            back = error @ layer.T
            layer -= step * 0.05 * (hidden.T @ error)
            bias -= step * 0.05 * error.sum(axis=0)
            embed[used] -= step * (part.T @ back)
    model = Model(langs, (embed @ layer).astype(np.float32), bias)
    z = x[check] @ model.table + bias
    losses = {t: -np.log(softmax(z / t)[np.arange(len(check)), y[check]] + 1e-12).mean() for t in 2.0 ** np.arange(-4, 3.1, 0.25)}
    model.temperature = float(min(losses, key=losses.get))
    p = softmax(z / model.temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == y[check]]
    model.reject_below = float(np.quantile(right, 0.005)) if len(right) else 0.0
    return model


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def learn(docs: DataFrame, most: int = 2_000) -> Model:
    """Fit on at most ``most`` labelled rows that are not held out, the lowest by a hash of the text.

    Rows are chosen by hash alone first; only the chosen texts are read again, and what reaches the driver is their
    sparse subword counts.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    part = max(1, usable.count() // most)
    rows = usable.where(F.pmod(F.xxhash64("text"), F.lit(part)) == 0).select("text", "lang").distinct()

    def features(batches):
        for pdf in batches:
            out = []
            for text, lang in zip(pdf["text"], pdf["lang"]):
                counts = subword_counts(text)
                at = np.flatnonzero(counts)
                out.append((lang, at.astype(np.uint16).tobytes(), counts[at].tobytes()))
            yield pd.DataFrame(out, columns=["lang", "at", "n"])

    got = rows.orderBy(F.xxhash64("text"), "lang").limit(most).repartition(16).mapInPandas(features, "lang string, at binary, n binary").collect()

    def dense(row):
        counts = np.zeros(BUCKETS, np.float32)
        counts[np.frombuffer(row.at, np.uint16)] = np.frombuffer(row.n, np.float32)
        return counts, row.lang

    return fit([dense(r) for r in sorted(got, key=lambda r: (bytes(r.at), bytes(r.n), r.lang))])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Doc_id, held_out, lang_pred, score and rejected of every row."""

    def run(batches):
        for batch in batches:
            found = [model.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64()),
                 pa.array([s < model.reject_below for _, s in found], pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
