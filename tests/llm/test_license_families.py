"""Licence families of the default list."""

from __future__ import annotations

from quillstone.llm import license_scan

SHORT = {f"Licensed under CC {k} 4.0.": f"cc-{k.lower()}-4.0-line" for k in ("BY", "BY-NC", "BY-ND", "BY-SA", "BY-NC-SA", "BY-NC-ND")}
LONG = {f"This work is licensed under a Creative Commons {n} 4.0 International License.": f"cc-{k}-4.0" for n, k in (("Attribution-NonCommercial", "by-nc"), ("Attribution-NoDerivatives", "by-nd"), ("Attribution-NonCommercial-NoDerivatives", "by-nc-nd"))}


def test_cc_families(spark):
    want = {**SHORT, **LONG, "Licensed under CC0 1.0.": "cc0-1.0-line"}
    df = spark.createDataFrame([(i, f"some words before\n{t}\nand after") for i, t in enumerate(want)], "doc_id long, text string")
    got = {r.doc_id: r.licenses.split(",") for r in license_scan.result(df).collect()}
    assert all(k in got[i] for i, k in enumerate(want.values())), got


def test_anchors_lose_nothing(spark):
    letters = " ".join("abcdefghijklmnopqrstuvwx")
    templates = spark.createDataFrame([("pt", "LICENÇA PÚBLICA"), ("again", "longword a b c d " * 7 + "longword " + letters)], "license_id string, text string")
    df = spark.createDataFrame([(1, "x LICENÇA PÚBLICA y"), (2, letters)], "doc_id long, text string")
    got = {r.doc_id: [(x.license_id, round(x.containment, 3)) for x in r.licenses] for r in license_scan.scanned(df, templates).collect()}
    assert got == {1: [("pt", 1.0)], 2: [("again", 0.8)]}
