"""Quality rules by line sequence labelling.

The lines of a text are labelled content or boilerplate by Viterbi decoding of a linear-chain conditional random
field over simple line features; a document is kept if it passes the base rules and content lines hold at least
``least_share`` of its words.  The field is trained by stochastic gradient ascent on the likelihood (forward-backward),
on labelled documents: the lines of a document of quality 1 count as content but for those that mostly repeat within
it, the lines of a document of quality 0 as boilerplate.

The training sample is bounded: ``per_class`` labelled documents a class, chosen by a hash of the id (documented
bound); every row is judged, over its whole text.  Without labels of both classes the fixed ``PRIOR`` weights hold.

Cases: null text is an empty one: no words, base rules failed; lines without a word have no label; ties of the
two labels go to content; repeated rows are judged each.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
FEATURES = ("bias", "words", "short", "symbols", "upper", "digits", "marks", "sentence", "lower_start", "word_length", "again")


def repeated(words: list[bytes]) -> np.ndarray:
    """Of each word, whether it is in a 5-word window found twice or more."""
    n = len(words)
    out = np.zeros(n, bool)
    if n < 6:
        return out
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, n)
    v = len(names)
    if v <= 4096:
        key = ids[: n - 4].copy()
        for k in range(1, 5):
            key = key << 12 | ids[k : n - 4 + k]
    else:
        key = ids
        for k in range(1, 5):
            key = np.unique(key[: n - k] * v + ids[k:], return_inverse=True)[1]
    _, at, counts = np.unique(key, return_inverse=True, return_counts=True)
    twice = counts[at] > 1
    for k in range(5):
        out[k : n - 4 + k] |= twice
    return out


def line_features(line: str, words: list[bytes], again: float) -> tuple[float, ...]:
    size = max(1, len(line))
    n = len(words)
    letters = max(1, sum(map(len, words)))
    bare = line.strip(SPACES)
    marks = line.count("!") + line.count("?") + line.count("=") + line.count("_") + line.count("~")
    upper = sum(map(str.isupper, line)) if not line.islower() else 0
    symbols = sum(map(line.count, SYMBOLS))
    digits = sum(map(line.count, "0123456789"))
    return (
        1.0, math.log1p(n) / 4, float(n < 4), min(1.0, 5 * symbols / size), min(1.0, 2 * upper / size), min(1.0, 4 * digits / size), min(1.0, 10 * marks / size),
        float(bare[-1:] in ".!?…\"»”"), float(bare[:1].islower()), min(3.0, letters / n / 6), again,
    )


@dataclass(frozen=True)
class Field:
    """Scores of the label content against boilerplate (0), and of moves between labels [from][to]."""

    weights: tuple[float, ...]
    moves: tuple[tuple[float, float], tuple[float, float]]

    def viterbi(self, rows: list[tuple[float, ...]]) -> list[bool]:
        back: list[tuple[int, int]] = []
        best = [0.0, 0.0]
        (m00, m01), (m10, m11) = self.moves
        for k, f in enumerate(rows):
            s = sum(a * b for a, b in zip(self.weights, f))
            if k:
                to0, to1 = (best[0] + m00, best[1] + m10), (best[0] + m01, best[1] + m11)
                from0, from1 = int(to0[1] >= to0[0]), int(to1[1] >= to1[0])
                back.append((from0, from1))
                best = [to0[from0], to1[from1] + s]
            else:
                best = [0.0, s]
        if not rows:
            return []
        label = int(best[1] >= best[0])
        out = [label]
        for b in reversed(back):
            label = b[label]
            out.append(label)
        return [bool(x) for x in reversed(out)]


#: Weights where there is nothing to learn from: symbols, capitals and marks speak against a line.
PRIOR = Field((1.5, 1.0, -0.5, -4.0, -3.0, -1.0, -3.0, 0.5, 0.0, 0.3, -2.0), ((0.5, -0.5), (-0.5, 0.5)))


def line_labels(features: list[tuple[float, ...]], good: bool) -> list[int]:
    """Weak labels of the lines of a labelled document."""
    return [int(good and f[-1] <= 0.5) for f in features]


def train(samples: list[tuple[list[tuple[float, ...]], bool]], epochs: int = 8, rate: float = 0.3, decay: float = 1e-3, move_decay: float = 0.3, seed: int = 5) -> Field:
    """samples: the line features of a document and whether its lines are content."""
    if len({y for _, y in samples}) < 2:
        return PRIOR
    rng, w, m = np.random.default_rng(seed), np.zeros(len(FEATURES)), np.zeros((2, 2))
    rows = [(np.array(f), np.array(line_labels(f, y))) for f, y in samples if f]
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for k in rng.permutation(len(rows)):
            x, y = rows[k]
            n = len(x)
            emit = np.stack([np.zeros(n), x @ w], axis=1)
            ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
            ahead[0] = emit[0]
            for i in range(1, n):
                ahead[i] = emit[i] + np.logaddexp(ahead[i - 1, 0] + m[0], ahead[i - 1, 1] + m[1])
            for i in range(n - 2, -1, -1):
                behind[i] = np.logaddexp(m[:, 0] + emit[i + 1, 0] + behind[i + 1, 0], m[:, 1] + emit[i + 1, 1] + behind[i + 1, 1])
            z = np.logaddexp(*ahead[-1])
            at = np.exp(ahead + behind - z)
            dw = ((y - at[:, 1])[:, None] * x).sum(axis=0)
            dm = np.zeros((2, 2))
            np.add.at(dm, (y[:-1], y[1:]), 1)
            if n > 1:
                pair = ahead[:-1, :, None] + m[None] + (emit + behind)[1:, None, :] - z
                dm -= np.exp(pair).sum(axis=0)
            scale = step / n
            w += scale * dw - step * decay * w
            m += scale * dm - step * move_decay * m
    return Field(tuple(map(float, w)), tuple(tuple(map(float, r)) for r in m))


def lines_of(text: str) -> tuple[list[int], list[tuple[float, ...]], int, np.ndarray, list[bytes]]:
    """Word counts and features of the lines with a word; lines equal to an earlier one; repeated; words."""
    split = text.split("\n")
    held = [(x, x.encode("utf-8", "surrogatepass").split()) for x in split]
    words = [w for _, ws in held for w in ws]
    rep = repeated(words)
    upto = np.concatenate([[0], np.cumsum(rep)])
    sizes, features, seen, dup, at = [], [], set(), 0, 0
    for line, ws in held:
        if not ws:
            continue
        dup += line in seen
        seen.add(line)
        n = len(ws)
        sizes.append(n)
        features.append(line_features(line, ws, (upto[at + n] - upto[at]) / n))
        at += n
    return sizes, features, dup, rep, words


def judge(text: str | None, model: Field, least_share: float) -> tuple:
    text = text or ""
    sizes, features, dup, rep, words = lines_of(text)
    n, n_rep = len(words), int(rep.sum())
    chars = len(text) - sum(map(text.count, SPACES))
    failed = n < 10 or 100 * n_rep > 20 * n
    labels = model.viterbi(features)
    share = sum(s for s, c in zip(sizes, labels) if c) / n if n else 0.0
    return n, chars, sum(map(text.count, SYMBOLS)), dup, n_rep, failed, not failed and share >= least_share, share


OUT = [("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType()), ("base_failed", T.BooleanType()), ("kept", T.BooleanType()), ("content_share", T.DoubleType())]


def fitted(docs: DataFrame, labels: DataFrame, per_class: int = 800, **options) -> Field:
    """A field trained on a bounded sample of docs with a quality label of 0 or 1."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    point = F.xxhash64("doc_id")
    parts = [known.where(F.col("quality") == q).orderBy(point, "doc_id").limit(per_class) for q in (0, 1)]
    chosen = parts[0].union(parts[1])
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").orderBy(point, "doc_id", "text").limit(4 * per_class).collect()
    return train([(lines_of(r["text"] or "")[1], r["quality"] == 1) for r in rows], **options)


def judged(docs: DataFrame, model: Field, keep: list[str], least_share: float = 0.5) -> DataFrame:
    """Columns ``keep`` of docs, the base figures, kept and content_share."""
    schema = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(n, t) for n, t in OUT)])
    arrow = (pa.int64(),) * 5 + (pa.bool_(), pa.bool_(), pa.float64())

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                got = list(zip(*(judge(t.as_py(), model, least_share) for t in part.column("text"))))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(pa.array(x, t) for x, t in zip(got, arrow))], names=schema.names)

    return docs.select(*keep, *({"text"} - set(keep))).mapInArrow(run, schema)


def result(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of query op6."""
    return judged(docs, fitted(docs, labels), ["doc_id"])
