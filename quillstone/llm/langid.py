"""Language identification: averaged hashed subword embeddings with a linear softmax.

Features are hashed subwords of 2 to 4 UTF-8 bytes of the lower-cased text, in which everything but letters (ASCII
ones and all non-ASCII characters) is a space; a subword may start or end with a space but has none inside.  A text is
the mean of its subwords' embeddings; a linear layer and softmax give the language.  Embeddings and layer are trained
by stochastic gradient descent in numpy, on whole texts and on random short pieces of them.  Temperature and
rejection threshold are fitted on documents kept out of the descent: the threshold is the lower of ``most_threshold``
and the confidence that all but ``rejected_share`` of the correctly named documents reach.

The sample is bounded: at most about ``per_language`` labelled documents a language and ``sample`` in all, taken by a
hash of id and text (documented bound; prediction covers every row and the whole text).

Cases: null text or text without a letter is ``und`` with score 0 and is not accepted; without labelled documents
everything is ``und``; null lang rows are not learned from; repeated rows are predicted each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS, WIDTH = 14, 16
LETTER = regex.compile(r"\p{L}")
_TO_SPACE = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Odd multipliers of the subword hash.
_MULTIPLIERS = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917), np.uint32(668265263))


def subwords(text: str) -> np.ndarray:
    """Hashed subwords of a whole text."""
    clean = b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_TO_SPACE).split())
    b = np.frombuffer(b" " + clean + b" ", np.uint8)
    space = b == 32
    terms = [(b.astype(np.uint32) + np.uint32(1)) * m for m in _MULTIPLIERS]
    out = []
    for n in (2, 3, 4):
        if len(b) < n:
            break
        h = terms[0][: len(b) - n + 1].copy()
        for i in range(1, n):
            h += terms[i][i : len(b) - n + 1 + i]
        inner = np.zeros(len(h), bool)
        for i in range(1, n - 1):
            inner |= space[i : i + len(h)]
        h = h[~inner]
        out.append((h ^ (h >> np.uint32(15))) * np.uint32(2246822519) >> np.uint32(32 - BITS))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def bag(text: str) -> np.ndarray:
    """Shares of the hashed subwords."""
    counts = np.bincount(subwords(text), minlength=1 << BITS).astype(np.float32)
    return counts / max(1.0, counts.sum())


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    weights: np.ndarray  # embeddings times layer: (1 << BITS, languages)
    bias: np.ndarray
    temperature: float
    threshold: float

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not self.langs or not text or not LETTER.search(text):
            return "und", 0.0, False
        p = softmax((bag(text) @ self.weights + self.bias)[None] / self.temperature)[0]
        k = int(p.argmax())
        return self.langs[k], float(p[k]), bool(p[k] >= self.threshold)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], labels: list[str], epochs: int = 6, rate: float = 6.0, batch: int = 32, rejected_share: float = 0.002, most_threshold: float = 0.5, seed: int = 7) -> Model:
    langs = tuple(sorted(set(labels)))
    if not langs:
        return Model((), np.zeros((1 << BITS, 0), np.float32), np.zeros(0, np.float32), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    y = np.array([langs.index(x) for x in labels])
    order = rng.permutation(len(y))
    held, used = order[: len(order) // 5], order[len(order) // 5 :]
    emb = rng.normal(0, 0.1, (1 << BITS, WIDTH)).astype(np.float32)
    layer, bias = rng.normal(0, 0.3, (WIDTH, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)
    shares = np.bincount(y[used], minlength=len(langs))
    weight = (len(used) / np.maximum(1, shares) / max(1, (shares > 0).sum())).astype(np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for at in np.array_split(rng.permutation(used), max(1, len(used) // batch)):
            if not len(at):
                continue
            pieces = []
            for i in at:
                t = texts[i]
                if rng.random() < 0.5 and len(t) > 12:
                    n = min(len(t), int(rng.integers(8, 200)))
                    start = int(rng.integers(0, len(t) - n + 1))
                    t = t[start : start + n]
                pieces.append(bag(t))
            x = np.stack(pieces)
            mean = x @ emb
            d = softmax(mean @ layer + bias)
            d[np.arange(len(at)), y[at]] -= 1
            d *= weight[y[at]][:, None] / len(at)
            back = d @ layer.T
            layer -= step / 12 * (mean.T @ d)
            bias -= step / 12 * d.sum(axis=0)
            emb -= step * 40 * (x.T @ back)
    weights = emb @ layer
    temperature, threshold = 1.0, 0.0
    if len(held):
        z, t = np.stack([bag(texts[i]) @ weights + bias for i in held]), y[held]
        nll = lambda c: -np.log(np.maximum(softmax(z / c)[np.arange(len(t)), t], 1e-12)).mean()
        temperature = float(min(np.geomspace(0.2, 5, 33), key=nll))
        p = softmax(z / temperature)
        right = p.max(axis=1)[p.argmax(axis=1) == t]
        threshold = float(min(most_threshold, np.quantile(right, rejected_share))) if len(right) else 0.0
    return Model(langs, weights.astype(np.float32), bias, temperature, threshold)


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1


def fitted(docs: DataFrame, per_language: int = 1200, sample: int = 6000, languages: int = 200, **options) -> Model:
    """A model from the rows of docs that aren't held out; the ``languages`` most frequent labels are learned."""
    known = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    top = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()
    each = min(per_language, sample // max(1, len(top)))
    point = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / (1 << 30)
    wanted = F.lit(False)
    for r in top:
        wanted = wanted | ((F.col("lang") == r["lang"]) & (point < each / r["count"]))
    rows = known.where(wanted).select("text", "lang", point.alias("point")).orderBy("point", "lang", "text").limit(2 * sample).collect() if top else []
    return train([r["text"] for r in rows], [r["lang"] for r in rows], **options)


def identified(docs: DataFrame, keep: list[str], model: Model) -> DataFrame:
    """Columns ``keep`` of docs with lang_pred, score and accepted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())])

    def run(batches):
        for batch in batches:
            got = [sent.value.predict(t.as_py()) for t in batch.column("text")]
            more = [pa.array([g[i] for g in got], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *more], names=schema.names)

    return docs.select(*keep, *({"text"} - set(keep))).mapInArrow(run, schema)


def accepted(docs: DataFrame) -> DataFrame:
    """The rows and columns of docs whose language is not rejected."""
    out = docs.select(*(F.col(c).alias(f"{c}__own" if c in ("lang_pred", "score", "accepted") else c) for c in docs.columns))
    kept = identified(out, out.columns, fitted(docs)).where("accepted").drop("lang_pred", "score", "accepted")
    return kept.toDF(*docs.columns)


def result(docs: DataFrame) -> DataFrame:
    """The columns of query op2."""
    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    return identified(rows, ["doc_id", "held_out"], fitted(docs))
