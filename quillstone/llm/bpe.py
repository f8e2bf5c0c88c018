"""Byte-level BPE by DuckDB recursive queries, one in-memory database a partition.

A text is cut by the vocabulary's pattern; every distinct piece that a worker hasn't met yet and that is no entry of
the vocabulary becomes rows (word and position, token), one a byte.  A recursive query joins neighbouring tokens with
the merge table and contracts each word's leftmost pair of minimum rank, until no word has a pair left.  The ids of a document are its pieces' ids in
order.  Decoding joins (word, pos, id) rows with the vocabulary and puts the bytes together by ordered aggregation.

The merge table holds every split of a vocabulary entry into two entries: any two neighbouring tokens whose bytes
together are an entry can merge, at that entry's rank.

Bounds: pieces are taken from ``CHUNK`` characters of text at a time (a longer text alone), the cache of pieces
a worker keeps is emptied at ``CACHE`` pieces, a recursion starts from at most ``BATCH`` bytes of pieces (its statement
holds the rows of all rounds), and ``DECODED`` bytes of ids are decoded at a time (a longer text's alone).  Pieces
longer than ``LONG`` bytes would need as many rounds as they have merges; they are contracted by the same rule with a
heap, outside the query.

Cases: null and empty texts have no ids; lone surrogates cannot occur in Spark strings; repeated rows are encoded each.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

CHUNK, CACHE, BATCH, DECODED, LONG = 1 << 19, 250_000, 1 << 17, 1 << 19, 400
POSITION = (1 << 20) - 1

#: A row's key ``k`` is its word's number and its position in the word, so that a token's right neighbour is the row of
#: the next key; a pair's key is (rank, position), whose minimum is the leftmost pair of minimum rank.
ENCODE = f"""
WITH RECURSIVE step(k, tok, done) AS (
    SELECT k, tok, false FROM bytes_in
  UNION ALL
    (WITH best AS (
       SELECT s.k >> 20 AS word, min((m.merged << 20) | (s.k & {POSITION})) AS key
       FROM step s JOIN step n ON n.k = s.k + 1 JOIN merges m ON m.pair = ((s.tok::BIGINT << 20) | n.tok)
       WHERE NOT s.done GROUP BY 1)
     SELECT s.k - (CASE WHEN s.k & {POSITION} > b.key & {POSITION} THEN 1 ELSE 0 END),
            CASE WHEN s.k & {POSITION} = b.key & {POSITION} THEN (b.key >> 20)::INTEGER ELSE s.tok END, b.key IS NULL
     FROM step s LEFT JOIN best b ON b.word = s.k >> 20
     WHERE NOT s.done AND (b.key IS NULL OR s.k & {POSITION} <> (b.key & {POSITION}) + 1)))
SELECT k, tok FROM step WHERE done
"""
DECODE = "SELECT word, list(v.bytes ORDER BY pos) AS parts FROM ids_in JOIN vocab v USING (tok) GROUP BY word"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}


class Codec:
    """Ranks, pattern and the database of one worker."""

    def __init__(self, path: str, pattern: str):
        import duckdb

        self.ranks, self.pattern = read_ranks(path), regex.compile(pattern)
        self.ids: dict[str, bytes] = {}
        # no temp_directory: what a statement holds is bounded, and nothing is written beside the shared folder
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        splits = [(self.ranks[t[:i]] << 20 | self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        pair, merged = (pa.array(x, pa.int64()) for x in zip(*splits)) if splits else (pa.array([], pa.int64()),) * 2
        self._table("merges", pair=pair, merged=merged)
        self._table("vocab", tok=pa.array(list(self.ranks.values()), pa.int32()), bytes=pa.array(list(self.ranks), pa.binary()))

    def _table(self, name: str, **columns: pa.Array) -> None:
        self.db.register("arrow_in", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM arrow_in")
        self.db.unregister("arrow_in")

    def _by_heap(self, word: bytes) -> list[int]:
        toks = [self.ranks[word[i : i + 1]] for i in range(len(word))]
        parts = [word[i : i + 1] for i in range(len(word))]
        nxt, prv = [*range(1, len(word)), -1], [-1, *range(len(word) - 1)]
        rank = lambda i: self.ranks.get(parts[i] + parts[nxt[i]]) if nxt[i] >= 0 else None
        heap = [(r, i, parts[i], parts[nxt[i]]) for i in range(len(word)) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            if parts[i] is None or nxt[i] < 0 or parts[i] != a or parts[nxt[i]] != b:
                continue
            j = nxt[i]
            parts[i], toks[i], nxt[i], parts[j] = a + b, r, nxt[j], None
            if nxt[j] >= 0:
                prv[nxt[j]] = i
            for k in (prv[i], i):
                if k >= 0 and (x := rank(k)) is not None:
                    heapq.heappush(heap, (x, k, parts[k], parts[nxt[k]]))
        return [t for t, p in zip(toks, parts) if p is not None]

    def _contracted(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian 32-bit integers, by the recursive query."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        pos = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        k = np.repeat(np.arange(len(words)), sizes) << 20 | pos
        self._table("bytes_in", k=pa.array(k), tok=pa.array(self.single[np.frombuffer(b"".join(words), np.uint8)]))
        out = self.db.sql(ENCODE).to_arrow_table()
        k, tok = (out.column(c).to_numpy() for c in ("k", "tok"))
        ids = tok[np.argsort(k)].astype("<u4").tobytes()
        ends = np.cumsum(np.bincount(k >> 20, minlength=len(words)) * 4).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]

    def _merge(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word: its own where it is an entry, else by the query or, for a long one, the heap."""
        out = [[self.ranks[w]] if w in self.ranks else self._by_heap(w) if len(w) > LONG else [] for w in words]
        some = [i for i, ids in enumerate(out) if not ids and words[i]]
        for i, ids in zip(some, self._contracted([words[i] for i in some]) if some else []):
            out[i] = np.frombuffer(ids, "<u4").tolist()
        return out

    def learn(self, pieces) -> None:
        """Encode the pieces that aren't in the cache."""
        known, ranks, new, size = self.ids, self.ranks, [], 0
        for p in pieces:
            if p not in known:
                word = p.encode("utf-8", "surrogatepass")
                if word in ranks:
                    known[p] = ranks[word].to_bytes(4, "little")
                else:
                    new.append((p, word))
                    size += len(word)
                    if size >= BATCH:
                        self._keep(new)
                        new, size = [], 0
        self._keep(new)

    def _keep(self, new: list[tuple[str, bytes]]) -> None:
        short = [x for x in new if len(x[1]) <= LONG]
        if short:
            names, words = zip(*short)
            self.ids.update(zip(names, self._contracted(words)))
        for p, word in new:
            if len(word) > LONG:
                self.ids[p] = np.array(self._by_heap(word), "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        start = 0
        while start < len(texts):
            end, size = start, 0
            while end < len(texts) and (end == start or size + len(texts[end]) <= CHUNK):
                size += len(texts[end])
                end += 1
            pieces = [self.pattern.findall(t) for t in texts[start:end]]
            if len(self.ids) > CACHE:
                self.ids.clear()
            self.learn(set().union(*pieces))
            get = self.ids.__getitem__
            out += [b"".join(map(get, p)) for p in pieces]
            start = end
        return out

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes of each id sequence, by ordered aggregation."""
        out, start = [b""] * len(ids), 0
        while start < len(ids):
            end, size = start, 0
            while end < len(ids) and (end == start or size + len(ids[end]) <= DECODED):
                size += len(ids[end])
                end += 1
            counts = np.array([len(x) // 4 for x in ids[start:end]])
            toks = np.frombuffer(b"".join(ids[start:end]), "<u4").astype(np.int32)
            self._table("ids_in", word=pa.array(np.repeat(np.arange(start, end, dtype=np.int32), counts)), pos=pa.array(np.arange(len(toks), dtype=np.int32)), tok=pa.array(toks))
            found = self.db.sql(DECODE).to_arrow_table()
            parts = pa.concat_arrays(found.column("parts").chunks) if found.num_rows else pa.array([], pa.list_(pa.binary()))
            flat = parts.flatten().cast(pa.large_binary())
            at = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1] if len(flat) else np.zeros(1, np.int64)
            ends = at[np.cumsum(parts.value_lengths().to_numpy(zero_copy_only=False))] if len(parts) else at[:0]
            whole = flat.buffers()[2]
            for k, a, b in zip(found.column("word").to_pylist(), [int(at[0]), *ends.tolist()], ends.tolist()):
                out[k] = whole[a:b].to_pybytes()
            start = end
        return out


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec for a vocabulary; made once a worker."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def _mapped(docs: DataFrame, column: str, out: list[tuple[str, T.DataType]], run) -> DataFrame:
    """doc_id and the columns that ``run`` makes of each slice of ``column``."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(n, t) for n, t in out)])

    def mapped(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *run(part.column(column).to_pylist())], names=schema.names)

    return docs.select("doc_id", column).mapInArrow(mapped, schema)


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ``ids``: each text's token ids as little-endian unsigned 32-bit integers."""
    return _mapped(docs, "text", [("ids", T.BinaryType())], lambda texts: [pa.array(codec(path, pattern).encode([t or "" for t in texts]), pa.binary())])


def decoded(ids: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ``bytes``: what the ids of each row stand for; null ids: empty."""
    return _mapped(ids, "ids", [("bytes", T.BinaryType())], lambda rows: [pa.array(codec(path, pattern).decode([x or b"" for x in rows]), pa.binary())])


def result(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The digest columns of query op8: n_tokens, ids_sha256, decoded_sha256."""

    def run(texts):
        c = codec(path, pattern)
        ids = c.encode([t or "" for t in texts])
        digest = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs])
        return [pa.array([len(x) // 4 for x in ids], pa.int64()), digest(ids), digest(c.decode(ids))]

    return _mapped(docs, "text", [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())], run)
