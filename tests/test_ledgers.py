"""Relations, groups, registry, layouts and sources on small made-up documents."""

from __future__ import annotations

import io
import json
import zipfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quillstone.functions.keyed import Pseudonyms
from quillstone.operators import groups, layout, registry, relations, reports, validation
from quillstone.plans import batch
from quillstone.sources import files, xlsx, xml
from quillstone.streaming import ledgers as streaming

SEED = "a seed of sixteen or more characters"
ROW = "doc_id string, line_ord int, account_code string, nature string, saldo_inicial decimal(38,10), debe decimal(38,10), haber decimal(38,10), saldo_final decimal(38,10)"
DOC = "doc_id string, owner_rfc string, owner_name string, year int, month int, print_date date"


def ledger(spark, docs):
    """docs: {id: (rfc, year, month, [(code, initial, final) or (code, initial, final, nature)])}."""
    rows, meta = [], []
    for d, (rfc, year, month, lines) in docs.items():
        meta.append((d, rfc, None, year, month, None))
        for i, (code, a, b, *nature) in enumerate(lines):
            rows.append((d, i, code, nature[0] if nature else None, Decimal(a), Decimal(b - a), Decimal(0), Decimal(b)))
    return spark.createDataFrame(rows, ROW), spark.createDataFrame(meta, DOC)


def codes(n, start=1):
    return [f"{i:03d}.{i:02d}" for i in range(start, start + n)]


def lines(cs, a=100, b=120):
    return [(c, a, b) for c in cs]


def related(spark, docs, **options):
    out = relations.infer_relations(*ledger(spark, docs), **options).collect()
    return {(r.left, r.right): (r.relation, round(r.confidence, 4), r.shared_accounts, r.conflicts) for r in out}


def test_exact_by_code_and_alias(spark):
    dash = [(c.replace(".", "-"), 100, 120) for c in codes(3)]
    bare = [(f"{i}.{i}", 100, 120) for i in (1, 2, 3)]
    got = related(spark, {"a": ("R1", 2024, 5, lines(codes(3))), "b": ("R1", 2024, 5, dash), "c": ("R2", 2024, 6, bare)})
    assert got["a", "b"] == ("exact_equivalent", 1.0, 3, [])
    assert got["a", "c"] == ("exact_equivalent", 1.0, 3, ["OWNER_RFC_CONFLICT", "PERIOD_CONFLICT"])
    one = related(spark, {"a": (None, None, None, lines(codes(1))), "b": (None, None, None, lines(codes(1)))})
    assert one["a", "b"][0] == "exact_equivalent"


def test_alias_must_be_unique(spark):
    got = related(spark, {"a": (None, 2024, 1, [("01.1", 1, 2), ("001.1", 1, 2), ("5", 1, 2)]), "b": (None, 2024, 1, [("1.1", 1, 2), ("5", 1, 2)])})
    assert got == {}


def test_projection_boundary(spark):
    got = related(spark, {"a": ("R", 2024, 5, lines(codes(5))), "b": ("R", 2024, 5, lines(codes(4))), "c": ("R", 2024, 5, lines(codes(4, 2)) + [("900", 1, 1)])})
    assert got["a", "b"][:3] == ("projection", 0.99, 4)
    assert got["a", "c"][:2] == ("projection", round(0.80 + 0.19 * 0.8, 4))  # 4 of 5
    assert got["b", "c"][:2] == ("ambiguous", 0.75) and got["b", "c"][3] == ["CONTENT_MISMATCH"]


def test_series_and_ambiguous(spark):
    cs = codes(5)
    nxt = [(c, 120 if i < 4 else 7, 130) for i, c in enumerate(cs)]
    got = related(spark, {"a": ("R", 2023, 12, lines(cs)), "b": ("R", 2024, 1, nxt), "c": ("R", 2024, 3, nxt[:3] + [("800", 1, 1)])})
    assert got["a", "b"] == ("series", round(0.80 + 0.19 * 0.8, 4), 5, [])
    assert got["a", "c"][0] == "ambiguous" and got["a", "c"][3] == ["PERIOD_CONFLICT"]
    back = related(spark, {"z": ("R", 2023, 12, lines(cs)), "a": ("R", 2024, 1, nxt)})
    assert back["a", "z"][0] == "series"


def test_nature_is_a_wildcard(spark):
    row = lambda n: [(c, 1, 2, n) for c in codes(3)]
    got = related(spark, {"a": (None, 2024, 1, row("D")), "b": (None, 2024, 1, row(None)), "c": (None, 2024, 1, row("A"))})
    assert got["a", "b"][0] == got["b", "c"][0] == "exact_equivalent" and got["a", "c"][0] == "ambiguous"


def test_collisions_and_last_row(spark):
    docs = {"a": ("R", 2024, 1, [("001-02", 1, 2), ("001.02", 3, 4), ("9", 1, 1)]), "b": ("R", 2024, 1, [("001.02", 3, 4), ("9", 1, 1)]), "c": ("R", 2024, 1, [("777", 1, 1)])}
    got = related(spark, docs)
    assert got == {("a", "b"): ("ambiguous", 1.0, 2, [relations.COLLISION])}
    assert set(related(spark, docs, expand_collisions=True)) == {("a", "b"), ("a", "c")}
    df, meta = ledger(spark, docs)
    assert [(r.doc_id, r.codes) for r in relations.normalization_collisions(df).collect()] == [("a", ["001-02", "001.02"])]
    assert {r.left for r in relations.standalone(meta, relations.infer_relations(df, meta)).collect()} == {"a", "b", "c"}


def test_empty_inputs(spark):
    df, meta = ledger(spark, {"a": ("R", 2024, 1, lines(codes(3)))})
    assert relations.infer_relations(df.limit(0), meta.limit(0)).collect() == []
    assert relations.infer_relations(df, meta).collect() == []


def test_components_of_a_chain(spark):
    n = 40
    nodes = spark.createDataFrame([(f"{i:03d}",) for i in range(n + 2)], "doc_id string")
    edges = spark.createDataFrame([(f"{i + 1:03d}", f"{i:03d}") for i in range(n - 1)], "left string, right string")
    got = {r.doc_id: r.group_id for r in groups.connected_components(nodes, edges).collect()}
    assert {got[f"{i:03d}"] for i in range(n)} == {"000"} and got["040"] == "040" and got["041"] == "041"


def test_auto_groups_split_identities(spark):
    docs = spark.createDataFrame([("a", "R1", None, None, None), ("b", "r1", None, None, None), ("c", None, "Casa", "Calle", None), ("d", None, "CASA", "calle", None), ("e", None, "x", None, None), ("f", None, "x", None, None), ("g", "R2", None, None, None)], "doc_id string, owner_rfc string, owner_name string, owner_address string, owner_certificate string")
    rel = spark.createDataFrame([(x, y, "series") for x, y in [("a", "b"), ("b", "g"), ("c", "d"), ("e", "f")]], "left string, right string, relation string")
    got = {r.doc_id: (r.group_id, r.auto_state) for r in groups.auto_groups(docs, rel, Pseudonyms(spark, SEED)).collect()}
    assert got == {"a": ("a", "AUTO_RESOLVED_RFC"), "b": ("a", "AUTO_RESOLVED_RFC"), "g": ("g", "AUTO_RESOLVED_RFC"), "c": ("c", "AUTO_RESOLVED_METADATA"), "d": ("c", "AUTO_RESOLVED_METADATA"), "e": ("e", "AUTO_SPLIT"), "f": ("f", "AUTO_SPLIT")}


def test_registry_is_stable_and_unique(spark):
    ask = lambda rows: spark.createDataFrame([("n", i, "t", v, 1) for i, v in rows], registry.ASSIGNMENTS)
    held = ask([("i1", "v1")])
    resolved, new, bad = registry.upsert(held, ask([("i1", "other"), ("i2", "v1"), ("i3", "v3"), ("i4", "v3"), ("i3", "v3")]))
    assert {(r.identifier_hmac, r.synthetic_value) for r in resolved.collect()} == {("i1", "v1"), ("i3", "v3")}
    assert [r.identifier_hmac for r in new.collect()] == ["i3"]
    assert {(r.identifier_hmac, r.synthetic_value) for r in bad.collect()} == {("i2", "v1"), ("i4", "v3")}


def test_validation(spark):
    df, _ = ledger(spark, {"a": ("R", 2024, 1, lines(codes(3)))})
    assert validation.ledger_differences(df, df).collect() == []
    other = df.where("line_ord < 2").withColumn("debe", F.when(F.col("line_ord") == 0, F.lit(1)).otherwise(F.col("debe")).cast("decimal(38,10)"))
    assert {r.line_ord: r.differs for r in validation.ledger_differences(df, other).collect()} == {0: ["debe"], 2: ["missing"]}
    report = spark.createDataFrame([("a" * 32, True), ("b" * 32, False), ("c" * 32, True), ("c" * 32, False), ("x", False)], "file_id string, success boolean")
    assert {(r.file_id[:1], r.problem) for r in validation.failed_ids(report).collect()} == {("b", None), ("c", "CONTRADICTORY"), ("x", "BAD_ID")}


def test_words_to_ledger_rows(spark):
    page = [("101.01", 10), ("Caja", 60), ("1,000.00", 200), ("200.00", 260), ("50.00", 320), ("1,150.00", 380)]
    words = [("d", 1, float(x), 100.0, t) for t, x in page] + [("d", 1, 10.0, 120.0, "Total"), ("d", 1, 200.0, 120.5, "9.00")]
    got = layout.positioned_ledger(spark.createDataFrame(words, "doc_id string, page int, x0 double, y0 double, text string")).collect()
    assert [(r.account_code, r.amounts) for r in got] == [("101.01", ["1,000.00", "200.00", "50.00", "1,150.00"])]


def test_family_choice_and_bounds(spark):
    s = spark.createDataFrame([("a", "x", 0.8), ("a", "y", 0.75), ("b", "x", 0.6), ("b", "y", 0.5), ("c", "x", 0.4)], "doc_id string, family string, score double")
    assert {r.doc_id: r.family for r in layout.chosen_family(s).collect()} == {"a": None, "b": "x", "c": None}
    p = spark.createDataFrame([("a", 1, 10, 20, "B1"), ("a", 2, 10, 20, None), ("a", 3, 99, 20, None)], "doc_id string, page int, width int, height int, bounds string")
    assert [r.bounds for r in layout.inherited_bounds(p).orderBy("page").collect()] == ["B1", "B1", None]


# --- sources -----------------------------------------------------------------------------------------------------

XML = """<?xml version="1.0" encoding="utf-8"?>
<B:Balanza xmlns:B="http://example.org/b" Version="1.3" RFC="{rfc}" Anio="{y}" Mes="{m}" TipoEnvio="N"{more}>
  <B:Ctas NumCta="001-02" SaldoIni="-0001.2300" Debe="000.00" Haber="5.500" SaldoFin="-0006.7300"/>
  <B:Ctas NumCta="003" SaldoIni="0" Debe="1" Haber="1" SaldoFin="0"/>
  <B:Ctas NumCta="004" SaldoIni="{a}" Debe="1" Haber="0" SaldoFin="{b}"/>
</B:Balanza>
"""


@pytest.fixture
def folder(tmp_path):
    put = lambda n, t: (tmp_path / n).write_text(t, encoding="utf-8")
    put("one.XML", XML.format(rfc="ABC010101AB1", y=2024, m="05", a=1, b=2, more=""))
    put("two.xml", XML.format(rfc="ABC010101AB1", y=2024, m="05", a=1, b=2, more=""))
    put("dtd.xml", '<!DOCTYPE x [<!ENTITY e SYSTEM "file:///etc/passwd">]>' + XML.format(rfc="A", y=2024, m="05", a=1, b=2, more=""))
    put("bad.xml", "<Other/>")
    put("month.xml", XML.format(rfc="A", y=2024, m="13", a=1, b=2, more=""))
    put("amount.xml", XML.format(rfc="A", y=2024, m="01", a="x", b=2, more=""))
    put("signed.xml", XML.format(rfc="ZZZ010101AB1", y=2024, m="07", a=900, b=901, more=' Sello="s"'))
    put("note.txt", "not an input")
    return tmp_path


def test_xml_documents(spark, folder):
    d = xml.documents(files.input_files(spark, str(folder), (".xml",)))
    state = {r.path.rsplit("/", 1)[1]: r.error_code for r in d.collect()}
    assert state == {"one.XML": None, "two.xml": None, "dtd.xml": "XML_UNSAFE", "bad.xml": "XML_ROOT_UNSUPPORTED", "month.xml": "XML_PERIOD_INVALID", "amount.xml": None, "signed.xml": None}
    rows = xml.ledger(d).where("doc_id like '%one.XML'").orderBy("line_ord").collect()
    assert [(r.account_code, r.saldo_inicial, r.amount_text["saldo_inicial"]) for r in rows] == [("001-02", Decimal("-1.23"), "-0001.2300"), ("003", 0, "0"), ("004", 1, "1")]


def test_run_over_a_folder(spark, folder, tmp_path_factory):
    pseudo, out = Pseudonyms(spark, SEED), tmp_path_factory.mktemp("out")
    d = batch.discover(spark, str(folder), pseudo)
    plans = batch.group_plans(d, pseudo)
    assert sorted((r.n_documents, r.relation) for r in d.summary.collect()) == [(1, "standalone"), (2, "exact_equivalent")]
    assert {r.entity_key: r.error_code for r in plans.collect()} == {"RFC:ABC010101AB1": None, "RFC:ZZZ010101AB1": "XML_SIGNED"}
    made = batch.rewritten(d, plans, pseudo)
    assert set(batch.publish(made, str(out)).values()) == {"GROUP_COMMITTED"}
    texts = [p.read_text(encoding="utf-8") for p in out.iterdir()]
    assert len(texts) == 2 and texts[0] == texts[1] and "ABC010101AB1" not in texts[0]
    same = lambda t: t[t.index("  <B:Ctas") :]
    assert same(texts[0]) == same((folder / "one.XML").read_text(encoding="utf-8"))
    assert set(batch.publish(made, str(out)).values()) == {"GROUP_FAILED"} and len(list(out.iterdir())) == 2


def test_stream_of_files(spark, folder, tmp_path_factory):
    to = tmp_path_factory.mktemp("stream")
    q = streaming.start(streaming.stream(spark, str(folder)), f"{to}/history", f"{to}/relations", f"{to}/checkpoint")
    q.awaitTermination(120)
    assert spark.read.parquet(f"{to}/relations").where("relation = 'exact_equivalent'").count() == 1


def workbook(sheet: str, shared=("Cuenta", "a & b"), extra=()):
    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="{rel}"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{ns}">' + "".join(f"<si><t>{s.replace('&', '&amp;')}</t></si>" for s in shared) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{ns}"><sheetData>{sheet}</sheetData></worksheet>')
        for n in extra:
            z.writestr(n, "x")
    return b.getvalue()


SHEET = '<row r="1"><c r="A1" s="3" t="s"><v>0</v></c><c r="AB1"><v>0.10000000000000001</v></c><c r="C1"><f>A1+1</f><v>2</v></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2" t="inlineStr"><is><t>in</t></is></c></row>'


def test_cells(spark):
    good, rows = workbook(SHEET), [("g", workbook(SHEET)), ("b", b"no zip"), ("m", workbook(SHEET, extra=["xl/vbaProject.bin"])), ("s", workbook('<row r="1"><c r="A1" t="s"><v>9</v></c></row>'))]
    got = {(r.doc_id, r.row, r.col): (r.value, r.cell_type, r.error_code) for r in xlsx.cells(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got["g", 1, 1] == ("Cuenta", "string", None) and got["g", 1, 28][0] == "0.10000000000000001" and got["g", 1, 3] == ("=A1+1", "formula", None)
    assert got["g", 2, 1][0] == "a & b" and got["g", 2, 2][0] == "in"
    assert {k[0]: v[2] for k, v in got.items() if v[2]} == {"b": "XLSX_INVALID", "m": "XLSX_ACTIVE_CONTENT", "s": "XLSX_INVALID"}
    new = dict(((r, c), v) for _, r, c, v, _ in xlsx.cells_of(xlsx.with_texts(good, {("S", "A1"): "x < y"})))
    assert new == dict(((r, c), v) for _, r, c, v, _ in xlsx.cells_of(good)) | {(1, 1): "x < y"}


def test_manifest_rules(spark):
    ok = {"groups": [{"id": "g1", "relation": "projection", "files": ["a", "b"], "metadata_source": "a"}], "series": [{"id": "s1", "files": ["c", "d"]}]}
    assert {(r.group_id, r.relation, r.file) for r in files.manifest(spark, json.dumps(ok)).collect()} == {("g1", "projection", "a"), ("g1", "projection", "b"), ("s1", "series", "c"), ("s1", "series", "d")}
    for bad in ({"groups": [{"id": "g 1", "relation": "series", "files": ["a", "b"]}]}, {"groups": [{"id": "g", "relation": "ambiguous", "files": ["a", "b"]}]}, {"series": [{"id": "g", "files": ["a"]}]}, {"series": [{"id": "g", "files": ["a", "b"]}, {"id": "h", "files": ["b", "c"]}]}, {"series": [{"id": "ABC010101AB1", "files": ["a", "b"]}]}):
        with pytest.raises(ValueError):
            files.manifest(spark, json.dumps(bad))


def test_reports_hold_no_originals(spark, tmp_path):
    p = Pseudonyms(spark, SEED)
    rel = spark.createDataFrame([("x/secret.xml", "y/secret.xml", "series", 0.98765, ["c"]), ("y/secret.xml", "x/secret.xml", "series", 0.98765, ["c"])], "left string, right string, relation string, confidence double, conflicts array<string>")
    out = reports.relation_rows(rel, p).collect()
    assert len(out) == 1 and all(len(i) == 32 and "SECRET" not in i for i in out[0].ids) and out[0].confidence == 0.9877
    reports.write_json({"a": 1}, str(tmp_path / "r.json"))
    with pytest.raises(FileExistsError):
        reports.write_json({}, str(tmp_path / "r.json"))
