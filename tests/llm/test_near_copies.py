"""Near copies against all pairs."""

from __future__ import annotations

import random
import re

from quillstone.llm import near_copies


def brute(data, threshold=0.8):
    sets = []
    for _, t in data:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)})
    label = list(range(len(data)))
    for a in range(len(data)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = label[a], label[b]
                label = [min(x, y) if k in (x, y) else k for k in label]
    low = {}
    for k, (i, _) in zip(label, data):
        low[k] = min(i, low.get(k, i))
    return {i: low[k] for k, (i, _) in zip(label, data)}


def made(n, rng):
    vocab = [f"w{i}" for i in range(400)]
    out = []
    for k in range(n):
        base = [rng.choice(vocab) for _ in range(rng.choice((3, 12, 60, 250, 900)))]
        out.append(" ".join(base))
        for share in (0.01, 0.02, 0.03, 0.05):  # words replaced: similarities of about 0.9 to 0.6
            out.append(" ".join(rng.choice(vocab) if rng.random() < share else w for w in base))
    return out


def test_near_copies_equal_all_pairs(spark):
    rng = random.Random(17)
    texts = [*made(40, rng), None, "", " \n", "one", "ONE", "one two"]
    data = list(enumerate(texts))
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    want = brute(data)
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(df).collect()} == want
    kept = near_copies.deduplicated(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(want.values())
    fps = near_copies.fingerprints(df).cache()
    plain = fps.select("doc_id", "tid", "fp")
    split = near_copies.resolved(plain, near_copies.links(df, fps, chunk=2))  # band values of three sets or more are split
    assert {r.doc_id: r.component_id for r in split.collect()} == want


def test_pipeline_stage_finds_copies_that_radius_3_leaves(spark):
    import corpus_pipeline

    rng = random.Random(5)
    base = [rng.choice("abcdefghijklmnopqrstuvw") + str(rng.randrange(50)) for _ in range(200)]
    other = list(base)
    for at in (20, 90, 160):
        other[at] = "changed"
    data = [(1, " ".join(base), "en", "s", 1), (2, " ".join(other), "en", "s", 1), (3, " ".join(reversed(base)), "en", "s", 1)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, df, "").collect()} == {1, 3}


def test_links_of_a_group_are_stars():
    import numpy as np

    step = [np.arange(at, at + 100, dtype=np.uint64) for at in (0, 5, 10, 15, 20, 25, 500)]  # 0.90 to the next, 0.6 from end to end
    ids = [40, 30, 20, 10, 50, 60, 70]
    assert sorted(near_copies.found_links(ids, step, 0.8)) == [(x, 10) for x in (20, 30, 40, 50, 60)]
    assert near_copies.found_links([7], step[:1], 0.8) == [] and near_copies.found_links([], [], 0.8) == []


def test_candidates_are_near_simhash_fingerprints(spark, monkeypatch):
    import xxhash

    rng = random.Random(23)
    data = list(enumerate(made(40, rng)))
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(near_copies, "HELD", 8)  # several samples of bits, as on large tables
    assert near_copies.samples(200, 0.8).shape == (22, 5) and near_copies.samples(8, 0.8).shape == (1, 0)
    fps = near_copies.fingerprints(df).cache()
    rows = {r.doc_id: r for r in fps.collect()}
    for i, t in data[:20]:
        w = t.lower().split()
        grams = {" ".join(w[k : k + 5]) for k in range(len(w) - 4)} or {" ".join(w)}
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
        assert rows[i].n == len(grams) and rows[i].codes[0] % (1 << 64) == want and len(rows[i].codes) == 8
    firsts = fps.dropDuplicates(["fp"]).select("fp", "n", "codes")
    clusters = {}
    for r in near_copies.candidates(firsts).collect():
        clusters.setdefault(r.g, []).append(r.fp)
    code = {r.fp: r.codes[:2] for r in rows.values()}
    apart = lambda a, b: sum(((x ^ y) % (1 << 64)).bit_count() for x, y in zip(code[a], code[b]))
    assert clusters and all(min(apart(a, b) for b in c if b != a) <= near_copies.reach(0.8, 128) for c in clusters.values() for a in c)
    found = near_copies.resolved(fps.select("doc_id", "tid", "fp"), near_copies.links(df, fps))
    assert {r.doc_id: r.component_id for r in found.collect()} == brute(data)


def test_links_of_a_group_equal_all_pairs(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    sets = [np.unique(np.concatenate([np.arange(n), rng.integers(1000, 1100, k)])).astype(np.uint64) for n in (4, 5, 9, 40, 200) for k in (0, 1, 2, 5, 20) for _ in range(4)]
    ids = rng.permutation(len(sets)).tolist()
    label = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            x, y = set(sets[a].tolist()), set(sets[b].tolist())
            if len(x & y) / len(x | y) >= 0.8:
                p, q = label[a], label[b]
                label = [min(p, q) if k in (p, q) else k for k in label]
    low = {k: min(i for i, z in zip(ids, label) if z == k) for k in set(label)}
    want = sorted((i, low[k]) for i, k in zip(ids, label) if i != low[k])
    for cells, tile in ((1 << 21, 256), (700, 7)):  # whole, and in many blocks and tiles
        monkeypatch.setattr(near_copies, "CELLS", cells)
        monkeypatch.setattr(near_copies, "TILE", tile)
        assert sorted(near_copies.found_links(ids, sets, 0.8)) == want
