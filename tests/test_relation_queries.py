"""The relation queries against all pairs of all documents, every month and entity."""

from __future__ import annotations

import datetime

import pytest

from quillstone import queries
from quillstone.sources.ledgers import relation_fixture

MONTHS = 9


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    lines = [(p, s, float(100 * s + 7 * p + m), "RNA"[(p + m) % 3], datetime.date(2020, 1 + m, 3)) for m in range(MONTHS) for s in (1, 2, 3) for p in range(1, 8)]
    spark.createDataFrame(lines, "l_partkey long, l_suppkey long, l_extendedprice double, l_returnflag string, l_shipdate date").write.parquet(f"{at}/lineitem.parquet")
    spark.createDataFrame([(1, 10), (2, 11), (3, 12)], "s_suppkey long, s_nationkey int").write.parquet(f"{at}/supplier.parquet")
    spark.createDataFrame([(p, f"Brand#{p}") for p in range(1, 8)], "p_partkey long, p_brand string").write.parquet(f"{at}/part.parquet")
    return at


def test_fixture_holds_every_month(spark, tables):
    ledger, docs = relation_fixture(spark, tables)
    assert ledger.select("period").distinct().count() == MONTHS and docs.count() == 3 * MONTHS + 3 * 5


def test_relations_equal_all_pairs(spark, tables):
    ledger, _ = relation_fixture(spark, tables)
    maps, entity, period, raw = {}, {}, {}, {}
    for r in sorted(ledger.collect(), key=lambda r: r.line_ord):
        code = r.account_code.replace("-", ".")
        raw.setdefault((r.doc_id, code), set()).add(r.account_code)
        maps.setdefault(r.doc_id, {})[".".join(x.lstrip("0") for x in code.split("."))] = (r.saldo_inicial, r.debe, r.haber, r.saldo_final)
        entity[r.doc_id], period[r.doc_id] = r.entity, r.period
    bad = {d for (d, _), codes in raw.items() if len(codes) > 1}
    want = {}
    for a in maps:
        for b in maps:
            if a < b:
                l, r = maps[a], maps[b]
                both = l.keys() & r.keys()
                equal, step = sum(l[k] == r[k] for k in both), period[b] - period[a]
                follows = {1: sum(l[k][3] == r[k][0] for k in both), -1: sum(r[k][3] == l[k][0] for k in both)}.get(step, 0)
                owner = ["OWNER_RFC_CONFLICT", "OWNER_NAME_CONFLICT"] * (entity[a] != entity[b])
                meta = owner + ["PERIOD_CONFLICT"] * (step != 0)
                if a in bad or b in bad:
                    want[a, b] = ("ambiguous", "ACCOUNT_NORMALIZATION_COLLISION")
                elif len(both) == len(l) == len(r) == equal:
                    want[a, b] = ("exact_equivalent", ",".join(meta))
                elif len(both) >= 0.8 * min(len(l), len(r)) and equal == len(both):
                    want[a, b] = ("projection", ",".join(meta))
                elif follows >= 0.8 * len(both):
                    want[a, b] = ("series", ",".join(owner))
                else:
                    want[a, b] = ("ambiguous", ",".join(meta or ["CONTENT_MISMATCH"]))
    assert {(r.left, r.right): (r.relation, r.conflicts) for r in queries.infer_relations(spark, tables).collect()} == want
    assert any(entity[a] != entity[b] for a, b in want)
