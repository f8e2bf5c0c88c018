"""The corpus pipeline against a brute-force version of its own stages' rules."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from quillstone.llm import bpe, langid, line_dedup

from .test_operators import ROWS, SCHEMA, brute_components, brute_contamination, prose

pipeline = pytest.importorskip("corpus_pipeline")
tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


def test_pipeline(spark, tmp_path):
    shared = prose(60)
    data = [(i, t) for i, t in ROWS if i is not None and i != 10 and i != 11] + [(400 + i, prose(50) + "\n" + shared) for i in range(6)] + [(500 + i, "copies of one text with some words " + "in it " * 5) for i in range(5)]
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else "es", "s", len(t or "")) for i, t in data], SCHEMA)
    bench = [(1, ROWS[8][1][50:300])]
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pipeline.run(spark, str(tmp_path)).collect()}

    model = langid.fitted(docs)
    left = [(i, t) for i, t in data if model.predict(t)[2]]
    holder = {}  # the line stage counts documents of equal text as one, and they leave it equal
    for i, t in sorted(left):
        holder.setdefault(t, i)
    cut = {r.doc_id: r.text for r in line_dedup.result(spark.createDataFrame([(i, t) for t, i in holder.items()], "doc_id long, text string")).collect()}
    left = [(i, cut[holder[t]]) for i, t in left]
    left = [(i, cut[i]) for i, _, c in brute_components(left) if i == c]
    clean = {r[0] for r in brute_contamination(left, bench) if not r[-1]}
    enc = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = set()
    for i, t in left:
        if i in clean:
            ids = np.array(enc.encode_ordinary(t or ""), "<u4")
            want.add((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == want and 400 in clean and 9 not in clean
    assert len({i for i, *_ in got} & set(range(500, 505))) == 1  # copies end as one document
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "byte_bpe"]


def test_stages_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).collect() == []
