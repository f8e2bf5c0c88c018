"""Near copies by SimHash, verified by the exact similarity of their word shingles.

A text, A-Z lower-cased, is cut into words between ASCII white space, as in ``simhash``; it is the set of its 5-word
shingles (of fewer words: one shingle).  Two texts link where the Jaccard similarity of their sets, 64-bit hashes of
the shingles, is ``threshold`` or more.  Their SimHash fingerprints find the candidates: ``CODES`` words of 64 bits, a
bit 1 if set in over half of the set's hashes, the first word from the hashes themselves and the others from mixes of
them.  At similarity 0.8 fingerprints differ in 15 % of the bits, and in 19 % at worst (sets of four and five shingles);
``odds`` has that share.  At such a distance no few blocks of bits are sure to agree, so the fingerprints are dealt out
by many samples of bits: as many bits as leave about ``HELD`` fingerprints to a value, in as many samples as let a pair
at the threshold, and at that worst share, agree in one with probability ``1 - MISS``.  A table of ``HELD`` fingerprints
or fewer is one group.

Within a group fingerprints of sets whose sizes allow a link are compared in tiles by ``simhash.near``, bit-sliced, on
the first word, and those near in it on the first two, each within the mean distance at that share and four standard
deviations.  Fingerprints that hang together by such pairs are a cluster; within a cluster every link is verified on
the whole sets, so that the fingerprints alone link nothing.

Texts of equal sets are one before any comparison.  A cluster found in several samples is verified once.  A value held by more than ``chunk`` fingerprints is split into chunks, and each
pair of chunks is a group of its own.

Cases: null texts and texts without words are equal; repeated rows stay as one.
"""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .simhash import LOWER, first_rows, labels, near, resolved

WORDS, CODES, HELD, MISS = 5, 8, 1024, 1e-4
TILE, SLAB, CELLS = 256, 255, 1 << 21
#: Offsets that tell the mixes of the hashes apart.
_ADD = np.random.default_rng(20).integers(0, 1 << 63, CODES - 1, dtype=np.uint64)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(WORDS)))) if len(words) >= WORDS else iter([b" ".join(words)])
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64))


def simhash_codes(shingles: np.ndarray) -> np.ndarray:
    """The words of the fingerprint of a set; zeros of an empty one."""
    counts = np.zeros(64 * CODES, np.int64)
    for i in range(0, len(shingles), SLAB):  # SLAB rows at most, so that a byte holds their sum
        h = shingles[i : i + SLAB, None]
        z = h + _ADD
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = np.concatenate([h, z ^ (z >> np.uint64(31))], axis=1)
        counts += np.unpackbits(z.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(shingles), bitorder="little").view("<u8")


def odds(threshold: float) -> float:
    """The share of bits that differ between sets at the threshold, at worst."""
    return math.acos(min(1.0, 2 * threshold / (1 + threshold))) / math.pi + 0.036


def reach(threshold: float, bits: int) -> int:
    """Differing bits that a pair at the threshold stays within, but for four standard deviations."""
    share = odds(threshold)
    return int(bits * share + 4 * math.sqrt(bits * share * (1 - share)))


def samples(held: int, threshold: float) -> np.ndarray:
    """Positions of the sampled bits for so many fingerprints, a row a sample; one empty sample for few of them."""
    bits = max(0, math.ceil(math.log2(max(1, held) / HELD)))
    n = math.ceil(math.log(MISS) / math.log(1 - (1 - odds(threshold)) ** bits)) if bits else 1
    rng, deck = np.random.default_rng(bits), np.zeros(0, np.int64)
    while len(deck) < n * bits:  # every bit once, before any comes again
        deck = np.concatenate([deck, rng.permutation(64 * CODES)])
    return deck[: n * bits].reshape(n, bits)


def found_links(ids: list[int], sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Pairs of ids that join what all pairs of similarity ``threshold`` or more join: each component as a star.

    The overlaps of all pairs are a matrix product over the shingles that two sets or more hold, ``CELLS`` cells at once.
    Stars to the smallest id, not chains of the pairs as they were met, so that the components settle in few rounds.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    if len(ids) < 2:
        return []
    row = np.repeat(np.arange(len(ids)), sizes)
    _, col, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = held[col] > 1
    row, col = row[shared], (np.cumsum(held > 1) - 1)[col[shared]]
    by = np.argsort(col, kind="stable")
    row, col = row[by], col[by]
    overlap, width = np.zeros((len(ids), len(ids)), np.float32), max(1, CELLS // len(ids))
    for c in range(0, col[-1] + 1 if len(col) else 0, width):
        lo, hi = np.searchsorted(col, [c, c + width])
        cells = np.zeros((len(ids), min(width, col[-1] + 1 - c)), np.float32)
        cells[row[lo:hi], col[lo:hi] - c] = 1
        overlap += cells @ cells.T
    found = []
    for r in range(0, len(ids), TILE):
        both = overlap[r : r + TILE].astype(np.float64)
        i, j = np.nonzero(both / (sizes[r : r + TILE, None] + sizes - both) >= threshold)
        found.append((i + r, j))
    label = labels(len(ids), *(np.concatenate(ends) for ends in zip(*found)))
    low = {}
    for k, x in zip(label.tolist(), ids):
        low[k] = min(x, low.get(k, x))
    return [(x, low[k]) for k, x in zip(label.tolist(), ids) if x != low[k]]


def near_clusters(fps: np.ndarray, sizes: np.ndarray, one: np.ndarray, two: np.ndarray, threshold: float) -> list[np.ndarray]:
    """The fps, sorted, of each cluster of two or more; one and two are the first words of their fingerprints."""
    order = np.lexsort((fps, sizes))
    fps, sizes, one, two = fps[order], sizes[order], one[order], two[order]
    first, both, found = reach(threshold, 64), reach(threshold, 128), []
    for r in range(0, len(fps), TILE):
        top = sizes[min(r + TILE, len(fps)) - 1]
        for c in range(r, len(fps), TILE):
            if sizes[c] * threshold > top:
                break
            i, j = near(one[r : r + TILE], one[c : c + TILE], first)
            i, j = i + r, j + c
            ahead = i < j
            i, j = i[ahead], j[ahead]
            apart = np.bitwise_count(one[i] ^ one[j]) + np.bitwise_count(two[i] ^ two[j])
            held = (apart <= both) & (sizes[j] * threshold <= sizes[i])
            if held.any():
                found.append((i[held], j[held]))
    if not found:
        return []
    nodes, ends = np.unique(np.concatenate([*(i for i, _ in found), *(j for _, j in found)]), return_inverse=True)
    label = labels(len(nodes), *np.split(ends, 2))
    by = np.argsort(label, kind="stable")
    return [np.sort(fps[nodes[part]]) for part in np.split(by, np.flatnonzero(np.diff(label[by])) + 1)]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, tid, fp (hash of the shingle set), n (its size) and codes (its SimHash)."""
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("tid", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("codes", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t.as_py()) for t in batch.column("text")]
            fps = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).astype(np.int64)
            sizes = pa.array([len(s) for s in sets], pa.int32())
            codes = pa.array([simhash_codes(s).view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tid"), pa.array(fps), sizes, codes], names=schema.names)

    return docs.select("doc_id", F.xxhash64("text").alias("tid"), "text").mapInArrow(run, schema)


def _sampled(firsts: DataFrame, positions: np.ndarray) -> DataFrame:
    """firsts(fp, n, codes): fp, n, the first two words and key (sample and value of its bits), a row a sample."""

    def run(batches):
        weights = 1 << np.arange(positions.shape[1], dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column("codes").flatten().to_numpy().reshape(-1, CODES)
            bits = np.unpackbits(np.ascontiguousarray(codes).view(np.uint8), axis=1, bitorder="little")
            one, two = pa.array(codes[:, 0]), pa.array(codes[:, 1])
            for s, at in enumerate(positions):
                key = (s << len(at)) + bits[:, at].astype(np.int64) @ weights
                yield pa.RecordBatch.from_arrays([batch.column("fp"), batch.column("n"), one, two, pa.array(key)], names=["fp", "n", "one", "two", "key"])

    return firsts.select("fp", "n", "codes").mapInArrow(run, "fp long, n int, one long, two long, key long")


def candidates(firsts: DataFrame, threshold: float = 0.8, chunk: int = 2048) -> DataFrame:
    """firsts(fp, n, codes), fp distinct: (g, fp), the members of each cluster of near fingerprints."""
    keyed = _sampled(firsts, samples(firsts.count(), threshold))
    hot = keyed.groupBy("key").agg(F.count("*").alias("held")).where(F.col("held") > chunk)
    parts = F.coalesce(F.ceil(F.col("held") / chunk), F.lit(1)).cast("int")
    dealt = keyed.join(hot, "key", "left").withColumn("parts", parts)
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    dealt = dealt.select("fp", "n", "one", "two", "key", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    group = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    dealt = dealt.select(group.alias("g"), "fp", "n", "one", "two").repartition("g").sortWithinPartitions("g")

    def run(batches):
        def found(held):
            fps, sizes, one, two = (np.concatenate([h[k] for h in held]) for k in range(4))
            got = near_clusters(fps, sizes, one.view(np.uint64), two.view(np.uint64), threshold) if len(fps) > 1 else []
            if got:
                g = np.repeat(np.array([xxhash.xxh64_intdigest(c.tobytes()) for c in got], np.uint64).view(np.int64), [len(c) for c in got])
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(np.concatenate(got))], names=["g", "fp"])

        held, open_g = [], None
        for batch in batches:
            g, *columns = (batch.column(k).to_numpy() for k in range(5))
            starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else []
            for s, e in zip(starts, [*starts[1:], len(g)]):
                if g[s] != open_g and held:
                    yield from found(held)
                    held = []
                open_g = g[s]
                held.append([c[s:e] for c in columns])
        if held:
            yield from found(held)

    return dealt.mapInArrow(run, "g long, fp long").distinct()


def _sets(docs: DataFrame) -> DataFrame:
    """docs(fp, text): fp, shingles."""

    def run(batches):
        for batch in batches:
            sets = pa.array([shingle_set(t.as_py()).view(np.int64) for t in batch.column("text")], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("fp"), sets], names=["fp", "shingles"])

    return docs.select("fp", "text").mapInArrow(run, "fp long, shingles array<long>")


def links(docs: DataFrame, fps: DataFrame, threshold: float = 0.8, chunk: int = 2048) -> DataFrame:
    """Edges (u, v) between fp, with the components of the links between their sets."""
    firsts = fps.where("n > 0").groupBy("fp").agg(F.min("tid").alias("tid"), F.first("n").alias("n"), F.first("codes").alias("codes"))
    dealt = written(candidates(firsts, threshold, chunk), "candidates")
    wanted = firsts.select("fp", F.col("tid").alias("__tid")).join(dealt.select("fp").distinct(), "fp", "left_semi")
    #: rows of one tid and different texts are not told apart, here as everywhere
    texts = docs.select(F.xxhash64("text").alias("__own"), "text").join(wanted, F.col("__own") == F.col("__tid")).select("fp", "text").dropDuplicates(["fp"])
    sets = written(_sets(texts), "shingles")
    grouped = dealt.join(sets, "fp").select("g", "fp", "shingles").repartition("g").sortWithinPartitions("g", "fp")

    def run(batches):
        ids, sets, open_g = [], [], None

        def found():
            got = found_links(ids, sets, threshold)
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in got], pa.int64()) for i in (0, 1)], names=["u", "v"])

        for batch in batches:
            for g, fp, s in zip(batch.column("g").to_pylist(), batch.column("fp").to_pylist(), batch.column("shingles")):
                if g != open_g and ids:
                    yield found()
                    ids, sets = [], []
                open_g = g
                ids.append(fp)
                sets.append(s.values.to_numpy().view(np.uint64))
        if ids:
            yield found()

    return grouped.mapInArrow(run, "u long, v long").distinct()


def near_copies(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row per row of docs: doc_id, tid, fp, component_id (smallest doc_id of the component), keep (one row of each)."""
    fps = written(fingerprints(docs.select("doc_id", "text")), "sets")
    return resolved(fps.select("doc_id", "tid", "fp"), links(docs, fps, threshold))


def deduplicated(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows of docs, all columns, of which one row of each component stays: the first by doc_id, then text hash."""
    return first_rows(docs, near_copies(docs, threshold))
