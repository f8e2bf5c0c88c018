"""Language-model scoring by an Elias-Fano n-gram trie.

The model is an interpolated absolute-discounting trigram model of all n-grams of the training texts.  Its levels lie in
files of the shared folder and are memory-mapped by the executors:

* words: the sorted 64-bit hashes (Elias-Fano) and their counts; a word's id is its rank;
* bigrams: for each word a pointer (Elias-Fano, monotone) to its successors; successors are kept as ids made monotone by
  the prefix sum of the ranges before them (Elias-Fano); 8-bit log probabilities and back-off weights;
* trigrams: for each bigram (u, v) a pointer to its successors, a successor w being kept as its position among the
  successors of v, again made monotone by prefix sums; 8-bit log probabilities and back-off weights.

A trigram is looked up by finding v among the successors of u, w among those of v, and the position of the latter in the
range of (u, v).  Every n-gram is counted and stored, also those seen once.

The words are counted first; then each text becomes the array of its word ids, written once, from which bigrams and
trigrams are counted and texts are scored.  Tasks count in numpy and send sorted Elias-Fano blocks straight to the shard
that stores the n-gram.  A level is cut into shards of about ``LIMIT`` tokens: bigrams by ranges of (u, v), so that the
successors of one frequent word may span shards, trigrams by ranges of bigram positions weighted with their counts.
Only the sizes of shards, and the words of more than ``LIMIT`` occurrences, reach the driver.

Cases: null text is empty: one end token; an empty training set leaves every token unknown, with the probability
1 / (V + 1) = 1; unknown words break the context; rows with null doc_id count as rows of the empty id; a word is
identified by its 64-bit hash; extra columns are not read.  Corpora whose bigram positions and successor ranks do not fit
64 bits together are refused.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from dataclasses import dataclass, field, replace
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_path, written
from .elias_fano import EliasFano, mapped, packed, packed_run, unpacked_run

END = np.uint64(0x2545F4914F6CDD1D)  # stands for the end of a text
PIECE = 3 << 20  # bytes of text, or of ids, that are handled at a time; a longer text alone
SLICE = 1 << 19  # n-grams whose probabilities are worked out at a time
FLUSH = 2_500_000  # n-grams a task holds before it sends them
LIMIT = 1 << 23  # tokens whose n-grams make up a shard
SHARD_BYTES = 1 << 26  # text whose words make up a shard
DISCOUNT = 0.5
UNKNOWN = 0xFFFFFFFF
BLOB = "bucket int, keys binary, counts binary"


# --- files -------------------------------------------------------------------------------------------------------


def put(uri: str, data: bytes) -> None:
    """A whole file, visible only when complete; a task that runs twice writes the same bytes."""
    scheme = urlparse(uri).scheme
    if scheme in ("", "file"):
        path = urlparse(uri).path
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(part := f"{path}.{uuid.uuid4().hex}", "wb") as f:
            f.write(data)
        os.replace(part, path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    part = f"{path}.{uuid.uuid4().hex}"
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(part) as f:
        f.write(data)
    store.move(part, path)


_LOCAL: dict[str, str] = {}


def near(uri: str) -> str:
    """A path that can be memory-mapped: the file itself, or, for other stores, a copy kept while the worker lives."""
    if urlparse(uri).scheme in ("", "file"):
        return urlparse(uri).path
    if uri not in _LOCAL:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        folder = tempfile.mkdtemp()
        atexit.register(shutil.rmtree, folder, True)
        with store.open_input_stream(path) as src, open(f"{folder}/level", "wb") as dst:
            shutil.copyfileobj(src, dst)
        _LOCAL[uri] = f"{folder}/level"
    return _LOCAL[uri]


# --- texts to tokens ---------------------------------------------------------------------------------------------

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(33)) * _M1
    h = (h ^ h >> np.uint64(33)) * _M2
    return h ^ h >> np.uint64(33)


def hashes_of(words: pa.Array) -> np.ndarray:
    """64-bit hashes of strings, eight bytes at a time over all words; words of over 64 bytes one by one."""
    n = len(words)
    words = words.cast(pa.large_string())
    at = np.frombuffer(words.buffers()[1], np.int64, n + 1, words.offset * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer((words.buffers()[2].to_pybytes() if n and words.buffers()[2] else b"") + bytes(8), np.uint8)
    blocks = np.lib.stride_tricks.sliding_window_view(data, 8)
    size = np.diff(at)
    h = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    todo = np.arange(n)
    for j in range(0, 64, 8):
        todo = todo[size[todo] > j]
        if not len(todo):
            break
        block = np.ascontiguousarray(blocks[at[todo] + j]).view("<u8")[:, 0]
        left = np.minimum(size[todo] - j, 8).astype(np.uint64)
        h[todo] = _mixed(h[todo] ^ block & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) - left) * np.uint64(8)))
    for i in np.flatnonzero(size > 64):
        h[i] = xxhash.xxh64_intdigest(data[at[i] : at[i + 1]].tobytes())
    return h


class Tokens:
    """The tokens of some documents: ``hashes`` are the distinct ones, ``ids`` index them, ``starts`` bound documents."""

    def __init__(self, texts: pa.Array):
        words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        per = np.asarray(pc.fill_null(pc.list_value_length(words), 0), np.int64)
        flat = words.flatten()
        some = np.asarray(pc.binary_length(flat)) > 0  # white space at either end leaves empty words
        if not some.all():
            owner = np.repeat(np.arange(len(per)), per)
            flat, per = flat.filter(pa.array(some)), np.bincount(owner[some], minlength=len(per))
        coded = flat.dictionary_encode()
        self.hashes = np.append(hashes_of(coded.dictionary), END)
        self.starts = np.concatenate([[0], np.cumsum(per + 1)])
        self.ids = np.full(self.starts[-1], len(self.hashes) - 1, np.int64)
        inner = np.ones(len(self.ids), bool)
        inner[self.starts[1:] - 1] = False
        self.ids[inner] = np.asarray(coded.indices)


def slices(batch: pa.RecordBatch, column: str):
    """Slices of a batch with about ``PIECE`` bytes in the column."""
    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + PIECE, "right")))
        yield batch.slice(i, j - i)
        i = j


def flat_ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids, starts) of a column of id arrays; -1: unknown."""
    size = np.asarray(pc.binary_length(column), np.int64) // 4
    ids = np.frombuffer(b"".join(column.to_pylist()), "<u4").astype(np.int64)
    ids[ids == UNKNOWN] = -1
    return ids, np.concatenate([[0], np.cumsum(size)])


# --- distributed counts ------------------------------------------------------------------------------------------


def distinct(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts (1 each without ``counts``)."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    if counts is not None and int(counts.sum(dtype=np.int64)) <= 2 * len(keys):  # mostly ones: cheaper to sort than to carry along
        keys, counts = np.repeat(keys, counts), None
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        del order
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.diff(np.append(first, len(keys))) if counts is None else np.add.reduceat(counts, first, dtype=np.int64)


def narrow(counts: np.ndarray) -> np.ndarray:
    most = int(counts.max()) if len(counts) else 0
    return counts.astype(np.uint8 if most < 1 << 8 else np.uint32 if most < 1 << 32 else np.uint64)


def blobs(keys: np.ndarray, counts: np.ndarray, bucket: np.ndarray):
    """One row for each bucket that has keys; keys are sorted, and so is ``bucket``."""
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else []
    rows = [(int(bucket[a]), packed_run(keys[a:b]), narrow(counts[a:b]).tobytes()) for a, b in zip(cuts, [*cuts[1:], len(bucket)])]
    if rows:
        b, k, c = zip(*rows)
        yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.binary()), pa.array(c, pa.binary())], names=["bucket", "keys", "counts"])


def unblob(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint8)]
    for k, c in zip(table.column("keys"), table.column("counts")):
        if k.is_valid:
            run, held = unpacked_run(k.as_py()), c.as_py()
            keys.append(run)
            counts.append(np.frombuffer(held, {1: np.uint8, 4: np.uint32, 8: np.uint64}[len(held) // len(run)]))
    return distinct(np.concatenate(keys), np.concatenate(counts))


def counted(rows: DataFrame, column: str, keys_of, bucket_of) -> DataFrame:
    """(bucket, keys, counts): the counts of the (keys, counts or None) that ``keys_of`` finds, summed within tasks.

    ``bucket_of`` doesn't fall with the key.
    """

    def run(batches):
        keys, counts, held = [], [], 0
        for batch in batches:
            for part in slices(batch, column):
                k, c = keys_of(part.column(column))
                keys.append(k)
                counts.append(c)
                held += len(k)
                if held > FLUSH:
                    k, c = distinct(np.concatenate(keys), None if counts[0] is None else np.concatenate(counts))
                    yield from blobs(k, c, bucket_of(k))
                    keys, counts, held = [], [], 0
        if keys:
            k, c = distinct(np.concatenate(keys), None if counts[0] is None else np.concatenate(counts))
            yield from blobs(k, c, bucket_of(k))

    return rows.select(column).mapInArrow(run, BLOB)


# --- levels ------------------------------------------------------------------------------------------------------


def quantised(logs: np.ndarray, floor: float) -> np.ndarray:
    """log10 values of [floor, 0] in 256 steps."""
    return np.rint(np.clip(logs / floor, 0, 1) * 255).astype(np.uint8)


P_FLOOR, BACK_FLOOR = -12.0, -5.0


def restored(codes: np.ndarray, floor: float) -> np.ndarray:
    return codes.astype(np.float64) * (floor / 255)


def ranges_to_monotone(owner: np.ndarray, value: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """value + the last monotone value of the ranges before; owner: range of each value; starts: first index of a range."""
    ends = np.flatnonzero(np.concatenate([owner[1:] != owner[:-1], [True]])) if len(owner) else np.zeros(0, np.int64)
    base = np.zeros(len(starts), np.uint64)  # of each range: sum over earlier, non-empty ranges of last value
    tops = np.zeros(len(starts), np.uint64)
    tops[owner[ends]] = value[ends].astype(np.uint64)
    base[1:] = np.cumsum(tops)[:-1]
    return value.astype(np.uint64) + base[owner]


LOW32 = np.uint64(0xFFFFFFFF)


def pair_keys(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return u.astype(np.uint64) << np.uint64(32) | v.astype(np.uint64)


@dataclass
class Meta:
    folder: str
    shards: int  # of words, a power of two
    offsets: list[int] = field(default_factory=lambda: [0])  # of word ids by shard, and their number last
    tokens: int = 0
    bounds: list[int] = field(default_factory=lambda: [0])  # first key (u, v) of each shard of bigrams
    leads: list[int] = field(default_factory=lambda: [0])  # successors that the first word of a shard has in the shards before
    positions: list[int] = field(default_factory=lambda: [0])  # of bigrams by shard, and their number last
    firsts: list[int] = field(default_factory=list)  # first bigram position of each shard of trigrams
    limit: int = LIMIT  # tokens whose n-grams make up a shard
    rank_bits: int = 1  # for the rank of a word among the successors of another


class Trie:
    """The levels of a model, opened shard by shard as queries need them."""

    def __init__(self, meta: Meta):
        self.meta, self.open = meta, {}
        self.offsets, self.positions, self.firsts = np.array(meta.offsets), np.array(meta.positions), np.array(meta.firsts)
        self.bounds, self.leads = np.array(meta.bounds, np.uint64), np.array(meta.leads)

    def level(self, name: str, shard: int) -> dict:
        if (name, shard) not in self.open:
            held = mapped(near(f"{self.meta.folder}/{name}-{shard}"))
            for part in {k.split(".")[0] for k in held if k.endswith(".shape")}:
                held[part] = EliasFano.of(held, part)
            self.open[name, shard] = held
        return self.open[name, shard]

    def _split(self, shard: np.ndarray):
        """(shard, indices) for each shard among the queries."""
        if len(shard) and (shard[1:] < shard[:-1]).any():
            order = np.argsort(shard, kind="stable")
            s = shard[order]
        else:
            order, s = np.arange(len(shard)), shard
        cuts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else []
        for a, b in zip(cuts, [*cuts[1:], len(s)]):
            yield int(s[a]), order[a:b]

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and counts."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        for s, at in self._split(shard_of_hash(hashes, self.meta.shards)):
            if self.offsets[s + 1] > self.offsets[s]:
                w = self.level("words", s)
                k = w["hash"].find(hashes[at])
                ids[at] = np.where(k >= 0, k + self.offsets[s], -1)
                counts[at] = np.where(k >= 0, w["count"][np.maximum(k, 0)], 0)
        return ids, counts

    def counts(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), np.int64)
        for s, at in self._split(np.searchsorted(self.offsets, ids, "right") - 1):
            out[at] = self.level("words", s)["count"][ids[at] - self.offsets[s]]
        return out

    def _of_key(self, keys: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, keys, "right") - 1

    def _among(self, level: dict, node: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions (-1: none) of the values among the successors of the nodes, which don't fall, and the first position of each."""
        if not len(node):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        new = np.concatenate([[True], node[1:] != node[:-1]])
        of, sequence = np.cumsum(new) - 1, level["next"]
        begin, end = (x.astype(np.int64) for x in level["pointer"].two(node[new]))
        base, only = np.zeros(len(begin), np.uint64), np.zeros(len(begin), np.uint64)
        some = np.flatnonzero((begin > 0) & (end > begin))
        base[some], only[some] = sequence.two(begin[some] - 1)
        if begin[0] == 0 and end[0] > 0:
            only[begin == 0] = sequence.at(np.zeros(1, np.int64))
        k = np.full(len(node), -1, np.int64)
        want, start = value.astype(np.uint64) + base[of], begin[of]
        several = (end - begin > 1)[of]
        one = np.flatnonzero((end - begin == 1)[of])
        one = one[only[of[one]] == want[one]]
        k[one] = start[one]
        many = np.flatnonzero(several)
        k[many] = sequence.find(want[many], start[many], end[of[many]])
        return k, start

    def bigrams(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions (-1: not stored) of bigrams of known words, sorted, and their ranks among the successors of the first."""
        pos, rank = np.full(len(keys), -1, np.int64), np.full(len(keys), -1, np.int64)
        for s, at in self._split(self._of_key(keys)):
            u = (keys[at] >> np.uint64(32)).astype(np.int64) - int(self.bounds[s] >> np.uint64(32))
            k, start = self._among(self.level("bigrams", s), u, keys[at] & LOW32)
            hit = np.flatnonzero(k >= 0)
            pos[at[hit]] = k[hit] + self.positions[s]
            rank[at[hit]] = k[hit] - start[hit] + np.where(u[hit] == 0, self.leads[s], 0)
        return pos, rank

    def back_of_word(self, u: np.ndarray) -> np.ndarray:
        out = np.zeros(len(u))
        keys = pair_keys(u, np.zeros(len(u)))
        for s, at in self._split(self._of_key(keys)):
            out[at] = restored(self.level("bigrams", s)["back"][u[at] - int(self.bounds[s] >> np.uint64(32))], BACK_FLOOR)
        return out

    def p_of_bigram(self, pos: np.ndarray) -> np.ndarray:
        out = np.zeros(len(pos))
        for s, at in self._split(np.searchsorted(self.positions, pos, "right") - 1):
            out[at] = restored(self.level("bigrams", s)["p"][pos[at] - self.positions[s]], P_FLOOR)
        return out

    def first_successor(self, u: np.ndarray) -> np.ndarray:
        """Position of the first stored bigram of each word."""
        out = np.zeros(len(u), np.int64)
        keys = pair_keys(u, np.zeros(len(u)))
        for s, at in self._split(self._of_key(keys)):
            out[at] = self.level("bigrams", s)["pointer"].at(u[at] - int(self.bounds[s] >> np.uint64(32))).astype(np.int64) + self.positions[s]
        return out

    def bigrams_of(self, s: int, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Counts and second words of the bigrams at a to b of shard s."""
        held, level = self.level("counts", s), self.level("bigrams", s)
        count = held["count"][a:b].astype(np.int64)
        big = np.flatnonzero((held["big"] >= a) & (held["big"] < b))
        count[held["big"][big] - a] = held["of_big"][big]
        value, starts = level["next"].values(), level["pointer"].values().astype(np.int64)
        some = starts[:-1][np.diff(starts) > 0]  # first positions of the ranges, each upon the last value of the one before
        before = np.concatenate([[0], value])[some].astype(np.uint64)
        return count, (value[a:b] - before[np.searchsorted(some, np.arange(a, b), "right") - 1]).astype(np.int64)

    def trigrams(self, pos: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of the trigrams, sorted (bigram position, rank of w among the successors of v), nan if not stored;
        and the back-off weight of the bigrams."""
        p, back = np.full(len(pos), np.nan), np.zeros(len(pos))
        for s, at in self._split(np.searchsorted(self.firsts, pos, "right") - 1):
            level = self.level("trigrams", s)
            node = pos[at] - self.firsts[s]
            back[at] = restored(level["back"][node], BACK_FLOOR)
            asked = np.flatnonzero(rank[at] >= 0)
            k, _ = self._among(level, node[asked], rank[at[asked]])
            hit = k >= 0
            p[at[asked[hit]]] = restored(level["p"][k[hit]], P_FLOOR)
        return p, back

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        """log10 of the unigram probabilities, from counts (0: unknown)."""
        n, v = max(1, self.meta.tokens), self.meta.offsets[-1]
        spare = DISCOUNT * v / n if v else 1.0
        return np.log10(np.maximum(counts - DISCOUNT, 0) / n + spare / (v + 1))

    def numbered(self, texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Word ids, tokens, known tokens and base score of each text."""
        t = Tokens(texts)
        word_ids, word_counts = self.words(t.hashes)
        base = np.log10((word_counts + 1) / (self.meta.tokens + self.meta.offsets[-1] + 1))
        ids = np.where(word_ids < 0, UNKNOWN, word_ids).astype("<u4")[t.ids].tobytes()
        s = t.starts[:-1]
        cuts = (t.starts * 4).tolist()
        sums = (np.add.reduceat(x[t.ids], s) if len(s) else np.zeros(0) for x in ((word_counts > 0).astype(np.int64), base))
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])], np.diff(t.starts), *sums

    def known_pairs(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions (-1: not stored) and ranks of the bigrams that end at each token, and the tokens with a stored one by its position."""
        pos, rank = np.full(len(ids), -1, np.int64), np.full(len(ids), -1, np.int64)
        first = np.zeros(len(ids) + 1, bool)
        first[starts] = True
        two = np.flatnonzero((ids[1:] >= 0) & (ids[:-1] >= 0) & ~first[1:-1]) + 1 if len(ids) else np.zeros(0, np.int64)
        if not len(two):
            return pos, rank, two
        keys = pair_keys(ids[two - 1], ids[two])
        order = np.argsort(keys)
        two, keys = two[order], keys[order]
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        at = np.cumsum(new) - 1
        p, r = self.bigrams(keys[new])
        p = p[at]
        pos[two], rank[two] = p, r[at]
        return pos, rank, two[p >= 0]

    def score(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The log10 probability of each text."""
        if not len(ids):
            return np.zeros(0)
        pos, rank, stored = self.known_pairs(ids, starts)
        first = np.zeros(len(ids) + 1, bool)
        first[starts] = True
        three = stored + 1
        three = three[~first[three]]
        log = np.full(len(ids), np.nan)
        back = np.zeros(len(ids))
        if len(three):
            log[three], back[three] = self.trigrams(pos[three - 1], rank[three])
        rest = np.isnan(log)
        two = np.flatnonzero(rest & (pos >= 0))
        log[two] = self.p_of_bigram(pos[two])
        one = np.flatnonzero(rest & (pos < 0))
        counts = np.zeros(len(one), np.int64)
        known = ids[one] >= 0
        counts[known] = self.counts(ids[one[known]])
        log[one] = self.unigram(counts)
        after = one[~first[one]]
        after = after[ids[after - 1] >= 0]
        log[after] += self.back_of_word(ids[after - 1])
        log[rest] += back[rest]
        return np.add.reduceat(log, starts[:-1])


def shard_of_hash(hashes: np.ndarray, shards: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - (shards.bit_length() - 1))).astype(np.int32) if shards > 1 else np.zeros(len(hashes), np.int32)


_TRIES: dict[tuple, Trie] = {}


def trie(meta: Meta) -> Trie:
    """The worker's open levels; a worker keeps one model, at one stage of its building."""
    key = (meta.folder, len(meta.bounds), len(meta.positions), len(meta.firsts))
    if key not in _TRIES:
        _TRIES.clear()
        _TRIES[key] = Trie(meta)
    return _TRIES[key]


# --- building ----------------------------------------------------------------------------------------------------


def _words_level(folder: str, shards: int, limit: int):
    def run(table):
        s = table.column("bucket")[0].as_py()
        h, c = unblob(table)
        put(f"{folder}/words-{s}", packed(EliasFano.build(h).arrays("hash") | {"count": c}))
        often = np.flatnonzero(c > limit)
        return pa.table({"shard": pa.array([s], pa.int32()), "n": pa.array([len(h)]), "total": pa.array([int(c.sum())]), "often": pa.array([often.tolist()], pa.list_(pa.int64())), "uses": pa.array([c[often].tolist()], pa.list_(pa.int64()))})

    return run


def _bounds(words: int, shards: int, often: dict[int, int], limit: int) -> list[int]:
    """First keys of the shards of bigrams: equal ranges of words, and words of more than ``limit`` tokens cut by successor."""
    cuts = {words * i // shards << 32 for i in range(shards)}
    for u, n in often.items():
        parts = -(-n // limit)
        cuts |= {u << 32 | words * i // parts for i in range(parts)} | {u + 1 << 32}
    return sorted(c for c in cuts if c < max(1, words) << 32)


def _last_word(meta: Meta, s: int) -> int:
    return (meta.bounds[s + 1] - 1 >> 32) if s + 1 < len(meta.bounds) else meta.offsets[-1] - 1


def _shared_words(meta: Meta, s: int) -> list[int]:
    """The words that shard s shares with a neighbour."""
    cut = lambda i: 0 < i < len(meta.bounds) and meta.bounds[i] & 0xFFFFFFFF > 0
    return sorted(({meta.bounds[s] >> 32} if cut(s) else set()) | ({_last_word(meta, s)} if cut(s + 1) else set()))


def _put_bigrams(meta: Meta, t: Trie, s: int, k: np.ndarray, c: np.ndarray, spread: dict[int, int]) -> None:
    """The files of shard s; ``spread``: successors in all shards of the words it shares."""
    lo, hi = meta.bounds[s] >> 32, _last_word(meta, s) + 1
    u, v = (k >> np.uint64(32)).astype(np.int64) - lo, (k & LOW32).astype(np.int64)
    starts = np.searchsorted(u, np.arange(hi - lo + 1))
    total, kinds = t.counts(np.arange(lo, hi)), np.diff(starts)
    for word, n in spread.items():
        kinds[word - lo] = n
    spare = np.where(kinds > 0, DISCOUNT * kinds / np.maximum(1, total), 1.0)
    p = np.empty(len(k), np.uint8)
    for i in range(0, len(k), SLICE):
        x = slice(i, i + SLICE)
        p[x] = quantised(np.log10((c[x] - DISCOUNT) / total[u[x]] + spare[u[x]] * 10 ** t.unigram(t.counts(v[x]))), P_FLOOR)
    held = EliasFano.build(starts).arrays("pointer") | EliasFano.build(ranges_to_monotone(u, v, starts[:-1])).arrays("next")
    put(f"{meta.folder}/bigrams-{s}", packed(held | {"p": p, "back": quantised(np.log10(spare), BACK_FLOOR)}))
    big = np.flatnonzero(c > 255)
    put(f"{meta.folder}/counts-{s}", packed({"count": np.minimum(c, 255).astype(np.uint8), "big": big, "of_big": c[big]}))


def _bigrams_level(meta: Meta):
    def run(key, table):
        s = key[0].as_py()
        k, c = unblob(table)
        words = (k >> np.uint64(32)).astype(np.int64)
        shared = _shared_words(meta, s)
        if shared:  # their back-off weights need the successors in other shards
            put(f"{meta.folder}/pairs-{s}", packed({"k": k, "c": c}))
        else:
            _put_bigrams(meta, Trie(meta), s, k, c, {})
        most = int(np.bincount(words - int(words[0])).max()) if len(words) else 0
        cuts = np.unique(np.searchsorted(np.cumsum(c), np.arange(0, max(1, int(c.sum())), meta.limit), "right")) if len(c) else np.zeros(0, np.int64)
        return pa.table({
            "shard": pa.array([s], pa.int32()), "n": pa.array([len(k)]), "most": pa.array([most]), "cuts": pa.array([cuts.tolist()], pa.list_(pa.int64())),
            "shared": pa.array([shared], pa.list_(pa.int64())), "kinds": pa.array([[int((words == w).sum()) for w in shared]], pa.list_(pa.int64())),
        })

    return run


def _trigrams_level(meta: Meta):
    def run(key, table):
        s, t = key[0].as_py(), Trie(meta)
        k, c = unblob(table)
        lo, hi = meta.firsts[s], meta.firsts[s + 1] if s + 1 < len(meta.firsts) else meta.positions[-1]
        bits = np.uint64(meta.rank_bits)
        node, rank = (k >> bits).astype(np.int64) - lo, (k & (np.uint64(1) << bits) - np.uint64(1)).astype(np.int64)
        starts = np.searchsorted(node, np.arange(hi - lo + 1))
        owner = int(np.searchsorted(t.positions, lo, "right")) - 1
        total, v = t.bigrams_of(owner, lo - meta.positions[owner], hi - meta.positions[owner])
        kinds = np.diff(starts)
        spare = np.where(kinds > 0, DISCOUNT * kinds / np.maximum(1, total), 1.0)
        p = np.empty(len(k), np.uint8)
        for i in range(0, len(k), SLICE):
            x = slice(i, i + SLICE)
            lower = 10 ** t.p_of_bigram(t.first_successor(v[node[x]]) + rank[x])
            p[x] = quantised(np.log10((c[x] - DISCOUNT) / total[node[x]] + spare[node[x]] * lower), P_FLOOR)
        out = EliasFano.build(starts).arrays("pointer") | EliasFano.build(ranges_to_monotone(node, rank, starts[:-1])).arrays("next")
        put(f"{meta.folder}/trigrams-{s}", packed(out | {"p": p, "back": quantised(np.log10(spare), BACK_FLOOR)}))
        return pa.table({"shard": pa.array([s], pa.int32()), "n": pa.array([len(k)])})

    return run


def _every_shard(spark: SparkSession, rows: DataFrame, shards: int) -> DataFrame:
    """rows and one empty row a shard, so that every shard gets its file."""
    empty = spark.range(shards).select(F.col("id").cast("int").alias("bucket"), F.lit(None).cast("binary").alias("keys"), F.lit(None).cast("binary").alias("counts"))
    return rows.unionByName(empty).repartition(shards, "bucket")  # a task's share stays that of a shard as the corpus grows


def _sums(sizes: list[int]) -> list[int]:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(int).tolist()


def words_model(docs: DataFrame, limit: int = LIMIT) -> Meta:
    """The level of words of the texts of docs, in the shared folder."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = 1 << max(4, (size // SHARD_BYTES).bit_length())
    folder = shared_path(spark, "trie")

    def keys_of(texts: pa.Array):
        t = Tokens(texts)
        return t.hashes, np.bincount(t.ids, minlength=len(t.hashes))

    words = counted(docs, "text", keys_of, lambda k: shard_of_hash(k, shards))
    rows = {r["shard"]: r for r in words.groupBy("bucket").applyInArrow(_words_level(folder, shards, limit), "shard int, n long, total long, often array<long>, uses array<long>").collect()}  # a row a shard
    offsets = _sums([rows[s]["n"] if s in rows else 0 for s in range(shards)])
    if offsets[-1] >= UNKNOWN:
        raise ValueError("too many distinct words for 32-bit ids")
    often = {offsets[s] + i: n for s, r in rows.items() for i, n in zip(r["often"], r["uses"])}
    return Meta(folder, shards, offsets, sum(r["total"] for r in rows.values()), _bounds(offsets[-1], shards, often, limit), limit=limit)


def numbered(docs: DataFrame, meta: Meta, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of docs, the word ids of each text, n_tokens, n_known, train_tokens and base_score."""
    more = [("ids", T.BinaryType(), pa.binary()), ("n_tokens", T.LongType(), pa.int64()), ("n_known", T.LongType(), pa.int64()), ("train_tokens", T.LongType(), pa.int64()), ("base_score", T.DoubleType(), pa.float64())]
    schema = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(n, t) for n, t, _ in more)])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                ids, tokens, known, base = trie(meta).numbered(part.column("text"))
                made = (ids, tokens, known, np.full(len(ids), meta.tokens), base)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(pa.array(x, t) for x, (_, _, t) in zip(made, more))], names=schema.names)

    return docs.select(*keep, *({"text"} - set(keep))).mapInArrow(run, schema)


def completed(ids: DataFrame, meta: Meta) -> Meta:
    """The model with the levels of bigrams and trigrams, from the word ids of its training texts."""
    spark = ids.sparkSession

    def key_pairs(column: pa.Array):
        of, starts = flat_ids(column)
        last = np.zeros(len(of), bool)
        last[starts[1:] - 1] = True
        i = np.flatnonzero(~last)
        return pair_keys(of[i], of[i + 1]), None

    bounds = np.array(meta.bounds, np.uint64)
    pairs = counted(ids, "ids", key_pairs, lambda k: (np.searchsorted(bounds, k, "right") - 1).astype(np.int32))
    shards = len(meta.bounds)
    found = _every_shard(spark, pairs, shards).groupBy("bucket").applyInArrow(_bigrams_level(meta), "shard int, n long, most long, cuts array<long>, shared array<long>, kinds array<long>").collect()  # a row a shard
    found.sort(key=lambda r: r["shard"])
    spread: dict[int, int] = {}
    leads = []
    for r in found:
        u = meta.bounds[r["shard"]] >> 32
        leads.append(spread.get(u, 0))
        for word, n in zip(r["shared"], r["kinds"]):
            spread[word] = spread.get(word, 0) + n
    positions = _sums([r["n"] for r in found])
    cut = [r for r in found if r["shared"]]
    if cut:
        todo = {r["shard"]: {w: spread[w] for w in r["shared"]} for r in cut}

        def finish(batches):
            for batch in batches:
                for s in batch.column("shard").to_pylist():
                    held = mapped(near(f"{meta.folder}/pairs-{s}"))
                    _put_bigrams(meta, Trie(meta), s, held["k"], held["c"], todo[s])
                yield batch

        spark.createDataFrame([(s,) for s in todo], "shard int").repartition(len(todo)).mapInArrow(finish, "shard int").count()
    most = max([1, *(r["most"] for r in found), *spread.values()])
    firsts = [positions[r["shard"]] + i for r in found for i in r["cuts"] if i < r["n"]]
    meta = replace(meta, leads=leads, positions=positions, firsts=firsts, rank_bits=most.bit_length())
    if positions[-1].bit_length() + meta.rank_bits > 64:
        raise ValueError("bigram positions and successor ranks don't fit 64 bits")
    if not firsts:
        return meta
    starts_of, bits = np.array(firsts), np.uint64(meta.rank_bits)

    def key_triples(column: pa.Array):
        pos, rank, _ = trie(meta).known_pairs(*flat_ids(column))
        j = np.flatnonzero((pos[:-1] >= 0) & (pos[1:] >= 0)) if len(pos) else np.zeros(0, np.int64)
        return pos[j].astype(np.uint64) << bits | rank[j + 1].astype(np.uint64), None

    triples = counted(ids, "ids", key_triples, lambda k: (np.searchsorted(starts_of, (k >> bits).astype(np.int64), "right") - 1).astype(np.int32))
    _every_shard(spark, triples, len(firsts)).groupBy("bucket").applyInArrow(_trigrams_level(meta), "shard int, n long").collect()  # a row a shard
    return meta


def trained(docs: DataFrame, limit: int = LIMIT) -> Meta:
    """The model of the texts of docs, in the shared folder."""
    meta = words_model(docs, limit)
    return completed(written(numbered(docs, meta, []), "ids"), meta)


def _scores(ids: DataFrame, meta: Meta, keep: list[str]) -> DataFrame:
    names = [*keep, "n_tokens", "n_known", "train_tokens", "base_score"]
    schema = T.StructType([*(ids.schema[c] for c in names), T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "ids"):
                score = trie(meta).score(*flat_ids(part.column("ids")))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(score, pa.float64())], names=schema.names)

    return ids.select(*names, "ids").mapInArrow(run, schema)


def scored(docs: DataFrame, meta: Meta, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of docs with n_tokens, n_known, train_tokens, base_score and score."""
    return _scores(numbered(docs, meta, keep), meta, keep)


def result(docs: DataFrame) -> DataFrame:
    """The columns of query op1."""
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    rows = docs.select("doc_id", "text", held_out.alias("held_out"))
    meta = words_model(rows.where(~F.col("held_out")))
    ids = written(numbered(rows, meta, ["doc_id", "held_out"]), "ids")
    return _scores(ids, completed(ids.where(~F.col("held_out")), meta), ["doc_id", "held_out"])
