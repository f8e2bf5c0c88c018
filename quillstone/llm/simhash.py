"""SimHash near-duplicates with bit-sliced comparison.

A text, A-Z lower-cased, is cut into words between ASCII white space; its 3-word shingles, repeats included, are
hashed by XXH64 (seed 42) and a fingerprint bit is 1 if set in over half of the hashes.  Fingerprints link at
``radius`` or fewer differing bits.

Distinct fingerprints (all copies of a text are one) are dealt out by ``radius + 1`` blocks of bits: two linked ones
agree in at least one block.  Within a task they are compared in tiles: bit planes are stored vertically, 64
fingerprints a word, and the distances of all pairs of a tile are counted at once by carry-save adders; parts of the
tile in which every distance exceeds the radius are abandoned.  A tile returns a spanning forest of its links, never
all pairs.  A block value held by more than ``chunk`` fingerprints is split into chunks, and each pair of chunks is a
group of its own.

Cases: null or empty texts have fingerprint zero and are linked like any other; fewer than three words form one
shingle; a null doc_id takes no part in the minimum; repeated rows are returned as often as they come.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .components import components

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
SLAB = 1 << 15


def simhash(text: str | None) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(words, words[1:], words[2:])) if len(words) > 2 else iter([b" ".join(words)])
    n = max(1, len(words) - 2)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, SLAB):
        part = hashes[i : i + SLAB].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, tid (hash of the text, to tell rows of one id apart) and fp, a signed long."""
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("tid", T.LongType()), T.StructField("fp", T.LongType())])

    def run(batches):
        for batch in batches:
            got = np.array([simhash(t.as_py()) for t in batch.column("text")], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tid"), pa.array(got)], names=["doc_id", "tid", "fp"])

    return docs.select("doc_id", F.xxhash64("text").alias("tid"), "text").mapInArrow(run, schema)


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """(64, words): bit j of word w of plane p is bit p of fingerprint 64 w + j; padded with the last one."""
    padded = np.concatenate([fps, np.repeat(fps[-1:], -len(fps) % 64)])
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def near(rows: np.ndarray, cols: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i of rows, j of cols) at ``radius`` or fewer differing bits."""
    planes, masks = bit_planes(cols), (np.unpackbits(rows.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.uint64) * FULL)
    width = max(1, radius.bit_length())
    at_row, at_col = np.arange(len(rows)), np.arange(planes.shape[1])
    counters = [np.zeros((len(rows), planes.shape[1]), np.uint64) for _ in range(width)]
    over = np.zeros_like(counters[0])
    for p in range(0, 64, 2):
        a, b = planes[p] ^ masks[:, p, None], planes[p + 1] ^ masks[:, p + 1, None]
        both = a ^ b
        carry = (a & b) | (counters[0] & both)  # full adder of the lowest counter and two planes
        counters[0] ^= both
        for c in counters[1:]:
            carry, c[...] = c & carry, c ^ carry
        over |= carry
        if p in (14, 22, 30, 46):
            alive = over != FULL
            keep_rows, keep_cols = alive.any(axis=1), alive.any(axis=0)
            if not keep_rows.any():
                return at_row[:0], at_col[:0]
            if keep_rows.sum() * keep_cols.sum() < alive.size // 2:
                cut = np.ix_(keep_rows, keep_cols)
                counters, over = [np.ascontiguousarray(c[cut]) for c in counters], np.ascontiguousarray(over[cut])
                planes, masks = np.ascontiguousarray(planes[:, keep_cols]), np.ascontiguousarray(masks[keep_rows])
                at_row, at_col = at_row[keep_rows], at_col[keep_cols]
    above, equal = over, ~over
    for i in range(width - 1, -1, -1):  # counters > radius, from the highest bit
        if radius >> i & 1:
            equal = equal & counters[i]
        else:
            above, equal = above | (equal & counters[i]), equal & ~counters[i]
    i, w = np.nonzero(above != FULL)
    bits = np.unpackbits((~above[i, w]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    k, j = np.nonzero(bits)
    j = at_col[w[k]] * 64 + j
    real = j < len(cols)
    return at_row[i[k]][real], j[real]


def labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node of the component of each of n nodes, by the links a-b."""
    label, before = np.arange(n), None
    while before is None or not np.array_equal(label, before):
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
    return label


def forest(fps: np.ndarray, radius: int, tile: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as stars, of the links among fps: (member, smallest member found with it)."""
    out_u, out_v = [], []
    for r in range(0, len(fps), tile):
        rows = fps[r : r + tile]
        for c in range(r, len(fps), tile):
            cols = fps[c : c + tile]
            i, j = near(rows, cols, radius)
            u, v = rows[i].view(np.int64), cols[j].view(np.int64)
            differ = u != v
            if differ.any():
                nodes, ends = np.unique(np.concatenate([u[differ], v[differ]]), return_inverse=True)
                a, b = np.split(ends, 2)
                label = labels(len(nodes), a, b)
                moved = label != np.arange(len(nodes))
                out_u.append(nodes[moved])
                out_v.append(nodes[label[moved]])
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *out_u]), np.concatenate([empty, *out_v])


def links(fps: DataFrame, radius: int = 3, tile: int = 512, chunk: int = 4096) -> DataFrame:
    """fps(fp), distinct: edges (u, v) that join the same fingerprints as all links of ``radius`` or fewer bits do."""
    blocks = radius + 1
    edges = [64 * i // blocks for i in range(blocks + 1)]
    values = [F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)).alias(f"b{i}") for i, (lo, hi) in enumerate(zip(edges, edges[1:]))]
    keyed = fps.select("fp", F.posexplode(F.array(*values)).alias("block", "value"))
    hot = keyed.groupBy("block", "value").agg(F.count("*").alias("held")).where(F.col("held") > chunk)
    parts = F.coalesce(F.ceil(F.col("held") / chunk), F.lit(1)).cast("int")
    dealt = keyed.join(hot, ["block", "value"], "left").withColumn("parts", parts)
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    dealt = dealt.select("fp", "block", "value", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    group = F.xxhash64("block", "value", F.least("own", "other"), F.greatest("own", "other"))
    dealt = dealt.select("fp", group.alias("g")).repartition("g").sortWithinPartitions("g", "fp")

    def run(batches):
        def found(fps):
            u, v = forest(np.unique(np.concatenate(fps)), radius, tile)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        #: whole groups share a tile; a link found across groups is a true link too
        held, held_n, open_g = [], 0, None
        for batch in batches:
            g, fp = batch.column("g").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
            starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else []
            for s, e in zip(starts, [*starts[1:], len(g)]):
                if g[s] != open_g and held_n >= tile - tile // 8:
                    yield found(held)
                    held, held_n = [], 0
                open_g = g[s]
                held.append(fp[s:e])
                held_n += e - s
        if held:
            yield found(held)

    return dealt.select("g", "fp").mapInArrow(run, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, radius: int = 3) -> DataFrame:
    """One row per row of docs: doc_id, tid, fp, component_id (smallest doc_id of the component), keep (one row of each)."""
    fps = written(fingerprints(docs.select("doc_id", "text")), "simhash")
    return resolved(fps, links(fps.select("fp").distinct(), radius))


def resolved(fps: DataFrame, edges: DataFrame) -> DataFrame:
    """fps(doc_id, tid, fp) with component_id and keep, by the components of edges (u, v) between fps."""
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tid")
    held = fps.groupBy("fp").agg(F.min(rank).alias("first"))
    roots = components(written(edges, "links"))
    rooted = held.join(roots, held["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    firsts = rooted.groupBy("root").agg(F.min("first").alias("rep"))
    named = rooted.join(firsts, "root").select("fp", "rep")
    out = fps.join(named, "fp", "left")
    keep = F.col("doc_id").eqNullSafe(F.col("rep.doc_id")) & (F.col("tid") == F.col("rep.tid"))
    return out.select("doc_id", "tid", "fp", F.col("rep.doc_id").alias("component_id"), keep.alias("keep"))


def deduplicated(docs: DataFrame, radius: int = 3) -> DataFrame:
    """The rows of docs, all columns, of which one row of each component stays: the first by doc_id, then text hash."""
    return first_rows(docs, near_duplicates(docs, radius))


def first_rows(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs that ``found`` keeps, one each."""
    keep = found.where("keep").select(F.col("doc_id").alias("__id"), F.col("tid").alias("__tid")).distinct()
    marked = docs.withColumn("__own", F.xxhash64("text"))
    kept = marked.join(keep, marked["doc_id"].eqNullSafe(keep["__id"]) & (marked["__own"] == keep["__tid"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "__own"]).drop("__own")


def result(docs: DataFrame) -> DataFrame:
    """The columns of query op10."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
