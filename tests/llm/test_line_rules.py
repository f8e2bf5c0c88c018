"""Which lines recur: by documents alone for full templates, whatever the length of the line."""

from __future__ import annotations

import corpus_pipeline
from quillstone.llm import line_dedup


def words(tag: str, n: int) -> str:
    return " ".join(f"{tag}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(n))


def test_lines_of_any_length_recur_by_documents(spark):
    held = {1: ["short", "x y", words("mid", 7), words("two", 60)], 2: ["short", "x y", words("mid", 7), words("two", 60)], 3: ["short", words("mid", 7), "", "12"], 4: ["", "13"], 5: ["", "14"], 6: ["page 1"], 7: ["page 2"], 8: ["page 3"]}
    data = [(i, "\n".join([*lines, words(f"own{chr(96 + i)}", 8)])) for i, lines in held.items()]
    out = {r.doc_id: r.text.split("\n")[:-1] for r in line_dedup.result(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    #: in 3 documents: gone from all but the first; in 2: long lines only; blank lines and bare numbers are no template
    assert out == {1: held[1], 2: ["x y"], 3: ["", "12"], 4: ["", "13"], 5: ["", "14"], 6: ["page 1"], 7: [], 8: []}


def test_groups_of_copies_leave_the_stages_as_one_document(spark):
    data, first = [], []
    for size in (2, 3, 4, 9, 20):
        text = "\n".join([words(f"s{size}", 2), words(f"m{size}", 9), words(f"l{size}", 70), words(f"e{size}", 4), "All rights reserved."])
        first.append(size * 100)
        data += [(size * 100 + k, text) for k in range(size)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long")
    cut = corpus_pipeline.line_dedup_stage(spark, df, "")
    left = {r.doc_id: r.text for r in corpus_pipeline.simhash_near_dedup(spark, cut, "").collect()}
    assert sorted(left) == sorted(first)
    #: a line that different texts share goes from all but the first
    assert [i for i in first if "reserved" in left[i]] == [200]
