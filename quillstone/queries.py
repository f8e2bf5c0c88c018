"""Queries over the standard tables, one for each family of operators, and their equivalents in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import descriptions, text, values
from .functions.keyed import Pseudonyms, padded_keys
from .operators import groups, layout, manifest, pages, registry, relations, reports, validation
from .sources.ledgers import derived_ledger, relation_fixture, table

#: A public seed for tests and benchmarks only.
DEMO_SEED = "public-demo-seed-0001"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- ledgers and relations ---------------------------------------------------------------------------------------

_LEDGER = r"""
mv AS (
  SELECT s_nationkey AS entity, year(l_shipdate) * 12 + month(l_shipdate) - 1 AS period, '101.' || lpad(regexp_replace(p_brand, '\D', '', 'g'), 2, '0') AS account_code,
         CAST(sum(CASE WHEN l_returnflag <> 'R' THEN CAST(round(l_extendedprice * 100) AS BIGINT) ELSE 0 END) AS BIGINT) AS debe,
         CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(round(l_extendedprice * 100) AS BIGINT) ELSE 0 END) AS BIGINT) AS haber
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY ALL),
ds AS (SELECT entity, account_code, unnest(range((SELECT min(period) FROM mv), (SELECT max(period) FROM mv) + 1)) AS period FROM (SELECT DISTINCT entity, account_code FROM mv)),
fl AS (SELECT entity, CAST(period AS INT) AS period, account_code, coalesce(debe, 0) AS debe, coalesce(haber, 0) AS haber FROM ds LEFT JOIN mv USING (entity, period, account_code)),
ld AS (
  SELECT entity || '-' || period AS doc_id, entity, period, account_code,
         CAST(coalesce(sum(debe - haber) OVER (PARTITION BY entity, account_code ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS saldo_inicial, debe, haber
  FROM fl),
ledger AS (SELECT doc_id, entity, period, account_code, saldo_inicial, debe, haber, saldo_inicial + debe - haber AS saldo_final FROM ld)"""

_FIXTURE = _LEDGER + r""",
lo AS (SELECT min(year(l_shipdate) * 12 + month(l_shipdate) - 1) AS first FROM lineitem),
fx AS (SELECT ledger.*, row_number() OVER (PARTITION BY doc_id ORDER BY account_code) - 1 AS line_ord, first FROM ledger, lo),
fk AS (SELECT *, unnest(CASE WHEN period = first THEN ['', 'x', 'z', 'p', 'a', 'c'] ELSE [''] END) AS kind FROM fx),
fr AS (
  SELECT CASE WHEN kind = '' THEN doc_id ELSE doc_id || '-' || kind END AS doc_id, entity, period, kind, line_ord,
         CASE kind WHEN 'x' THEN replace(account_code, '.', '-') WHEN 'z' THEN '0' || account_code ELSE account_code END AS account_code,
         saldo_inicial + CASE kind WHEN 'a' THEN line_ord + 1 ELSE 0 END AS i, debe + CASE kind WHEN 'a' THEN line_ord + 1 ELSE 0 END AS d,
         haber + CASE kind WHEN 'a' THEN line_ord + 1 ELSE 0 END AS h, saldo_final + CASE kind WHEN 'a' THEN line_ord + 1 ELSE 0 END AS f
  FROM fk WHERE kind <> 'p' OR line_ord % 5 <> 4),
lines AS (
  SELECT * FROM fr UNION ALL
  SELECT doc_id, entity, period, kind, 1000, replace(account_code, '.', '-'), i, d, h, f FROM fr WHERE kind = 'c' AND line_ord = 0),
coded AS (SELECT *, replace(account_code, '-', '.') AS norm_code FROM lines),
bad AS (SELECT DISTINCT doc_id FROM coded GROUP BY doc_id, norm_code HAVING count(DISTINCT account_code) > 1)"""

_RELATIONS = _FIXTURE + r""",
lm AS (SELECT doc_id, entity, period, norm_code, regexp_replace(norm_code, '(^|\.)0+([0-9])', '\1\2', 'g') AS alias, arg_max(i, line_ord) AS i, arg_max(d, line_ord) AS d, arg_max(h, line_ord) AS h, arg_max(f, line_ord) AS f
       FROM coded GROUP BY doc_id, entity, period, norm_code),
n AS (SELECT doc_id, count(*) AS n FROM lm GROUP BY doc_id),
pr AS (SELECT l.doc_id AS l, r.doc_id AS r, l.norm_code AS ln, r.norm_code AS rn, l.period AS lp, r.period AS rp, l.i AS li, l.d AS ldb, l.h AS lh, l.f AS lf, r.i AS ri, r.d AS rdb, r.h AS rh, r.f AS rf
       FROM lm l JOIN lm r ON l.entity = r.entity AND l.alias = r.alias AND l.doc_id < r.doc_id),
sm AS (SELECT * FROM pr WHERE ln = rn),
al AS (SELECT * FROM pr WHERE ln <> rn AND NOT EXISTS (SELECT 1 FROM sm WHERE sm.l = pr.l AND sm.r = pr.r AND (sm.ln = pr.ln OR sm.rn = pr.rn))),
st AS (
  SELECT l, r, any_value(lp) AS lp, any_value(rp) AS rp, count(*) AS shared, count(*) FILTER (WHERE li = ri AND ldb = rdb AND lh = rh AND lf = rf) AS equal,
         count(*) FILTER (WHERE lf = ri) AS fwd, count(*) FILTER (WHERE rf = li) AS bwd
  FROM (SELECT * FROM sm UNION ALL SELECT * FROM al) GROUP BY l, r),
jn AS (
  SELECT st.*, a.n AS an, b.n AS bn, l IN (SELECT doc_id FROM bad) OR r IN (SELECT doc_id FROM bad) AS collided,
         CASE rp - lp WHEN 1 THEN fwd WHEN -1 THEN bwd END AS cont
  FROM st JOIN n a ON a.doc_id = l JOIN n b ON b.doc_id = r),
rl AS (
  SELECT *, CASE WHEN collided THEN 'collision' WHEN shared = an AND shared = bn AND equal = shared THEN 'exact_equivalent'
    WHEN shared >= 3 AND shared / least(an, bn) >= 0.8 AND equal = shared THEN 'projection'
    WHEN shared >= 3 AND cont / shared >= 0.8 THEN 'series' WHEN shared >= 3 AND shared / least(an, bn) >= 0.5 THEN 'ambiguous' END AS rule FROM jn),
rel AS (
  SELECT l AS "left", r AS "right", CASE rule WHEN 'collision' THEN 'ambiguous' ELSE rule END AS relation,
         CASE rule WHEN 'collision' THEN 1.0 WHEN 'exact_equivalent' THEN 1.0 WHEN 'projection' THEN least(0.99, 0.80 + 0.19 * (shared / least(an, bn))) WHEN 'series' THEN least(0.99, 0.80 + 0.19 * (cont / shared)) ELSE least(0.89, shared / least(an, bn)) END AS confidence,
         shared AS shared_accounts,
         CASE rule WHEN 'collision' THEN 'ACCOUNT_NORMALIZATION_COLLISION' WHEN 'series' THEN '' WHEN 'ambiguous' THEN CASE WHEN lp <> rp THEN 'PERIOD_CONFLICT' ELSE 'CONTENT_MISMATCH' END ELSE CASE WHEN lp <> rp THEN 'PERIOD_CONFLICT' ELSE '' END END AS conflicts
  FROM rl WHERE rule IS NOT NULL
  UNION ALL
  SELECT l, r, 'ambiguous', 1.0, 0, 'ACCOUNT_NORMALIZATION_COLLISION'
  FROM (SELECT DISTINCT least(b.doc_id, d.doc_id) AS l, greatest(b.doc_id, d.doc_id) AS r
        FROM (SELECT DISTINCT doc_id, entity FROM lines WHERE doc_id IN (SELECT doc_id FROM bad)) b JOIN (SELECT DISTINCT doc_id, entity FROM lines) d ON b.entity = d.entity AND b.doc_id <> d.doc_id) w
  WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.l = w.l AND st.r = w.r))"""


@query(f"WITH {_LEDGER} SELECT * FROM ledger")
def ledger_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived_ledger(spark, sf_dir)


@query(r"""
SELECT p_partkey, ' ' || replace(c, '.', sep) || ' ' AS raw, CASE WHEN sep = '/' THEN upper(replace(c, '.', '/')) ELSE c END AS code,
       CASE WHEN sep <> '/' THEN regexp_replace(c, '(^|\.)0+([0-9])', '\1\2', 'g') END AS alias
FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '.' WHEN 1 THEN '-' ELSE '/' END AS sep, lpad(CAST(p_size AS VARCHAR), 4, '0') || '.' || lpad(regexp_replace(p_brand, '\D', '', 'g'), 2, '0') AS c FROM part)
""")
def account_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    sep = F.when(F.col("p_partkey") % 3 == 0, ".").when(F.col("p_partkey") % 3 == 1, "-").otherwise("/")
    raw = F.concat(F.lit(" "), F.lpad(F.col("p_size").cast("string"), 4, "0"), sep, F.lpad(F.regexp_replace("p_brand", r"\D", ""), 2, "0"), F.lit(" "))
    code = text.account_code(raw)
    return p.select("p_partkey", raw.alias("raw"), code.alias("code"), text.account_alias(code).alias("alias"))


@query(f"WITH {_FIXTURE} SELECT doc_id, norm_code, string_agg(DISTINCT account_code, ',' ORDER BY account_code) AS codes FROM coded GROUP BY doc_id, norm_code HAVING count(DISTINCT account_code) > 1")
def normalization_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger, _ = relation_fixture(spark, sf_dir)
    return relations.normalization_collisions(ledger).withColumn("codes", F.array_join("codes", ","))


def _related(spark: SparkSession, sf_dir: str, within: tuple[str, ...] = ("entity",)) -> DataFrame:
    ledger, docs = relation_fixture(spark, sf_dir)
    out = relations.infer_relations(ledger, docs, within=list(within), expand_collisions=True)
    return out.select("left", "right", "relation", F.round("confidence", 6).alias("confidence"), "shared_accounts", F.array_join("conflicts", ",").alias("conflicts"))


_REL_SQL = f'WITH {_RELATIONS} SELECT "left", "right", relation, round(confidence, 6) AS confidence, shared_accounts, conflicts FROM rel'


@query(_REL_SQL)
def infer_relations_within_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _related(spark, sf_dir)


def infer_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a block: documents of all entities share one chart of accounts here, so all pairs; too slow to register."""
    return _related(spark, sf_dir, ())


def _one_relation(kind: str, name: str) -> None:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _related(spark, sf_dir).where(F.col("relation") == kind)

    f.__name__ = name
    query(f"{_REL_SQL} WHERE relation = '{kind}'")(f)


for _k, _n in ((relations.EXACT, "infer_relations_exact"), (relations.PROJECTION, "infer_relations_projection"), (relations.SERIES, "infer_relations_series"), (relations.AMBIGUOUS, "infer_relations_ambiguous")):
    _one_relation(_k, _n)


@query(f"""WITH {_RELATIONS} SELECT doc_id, 'standalone' AS relation FROM (SELECT DISTINCT doc_id FROM lines)
WHERE doc_id NOT IN (SELECT unnest(["left", "right"]) FROM rel WHERE relation <> 'ambiguous')""")
def relation_standalone(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger, docs = relation_fixture(spark, sf_dir)
    return relations.standalone(docs, _related(spark, sf_dir)).select(F.col("left").alias("doc_id"), "relation")


_GROUPS = f"""WITH RECURSIVE {_RELATIONS},
ed AS (SELECT "left" AS a, "right" AS b FROM rel WHERE relation <> 'ambiguous' UNION SELECT "right", "left" FROM rel WHERE relation <> 'ambiguous'),
cc(doc_id, label) AS (SELECT doc_id, doc_id FROM (SELECT DISTINCT doc_id FROM lines) UNION SELECT ed.b, cc.label FROM cc JOIN ed ON cc.doc_id = ed.a),
grp AS (SELECT doc_id, min(label) AS group_id FROM cc GROUP BY doc_id)"""


@query(f"{_GROUPS} SELECT doc_id, group_id FROM grp")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger, docs = relation_fixture(spark, sf_dir)
    edges = _related(spark, sf_dir).where(F.col("relation").isin(*groups.LINKS)).select("left", "right")
    return groups.connected_components(docs.select("doc_id"), edges)


@query(f"""{_GROUPS} SELECT group_id, count(DISTINCT grp.doc_id) AS n_documents,
  CASE WHEN bool_or(relation = 'projection') THEN 'projection' WHEN bool_or(relation = 'exact_equivalent') THEN 'exact_equivalent' WHEN bool_or(relation = 'series') THEN 'series' WHEN count(DISTINCT grp.doc_id) = 1 THEN 'standalone' ELSE 'ambiguous' END AS relation,
  round(coalesce(min(confidence), 1.0), 6) AS confidence
FROM grp LEFT JOIN rel ON relation <> 'ambiguous' AND rel."left" = grp.doc_id GROUP BY group_id""")
def group_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger, docs = relation_fixture(spark, sf_dir)
    rel = relations.infer_relations(ledger, docs, within=["entity"], expand_collisions=True)
    edges = rel.where(F.col("relation").isin(*groups.LINKS)).select("left", "right")
    members = groups.connected_components(docs.select("doc_id"), edges)
    return groups.group_summary(members, rel).select("group_id", "n_documents", "relation", F.round("confidence", 6).alias("confidence"))


_OWNERS = r"""
own AS (SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 3 = 0 THEN 'AAA0101' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || 'XYZ' END AS owner_rfc, CASE WHEN c_custkey % 3 < 2 THEN 'Casa ' || c_nationkey END AS owner_name,
        CASE WHEN c_custkey % 2 = 0 THEN 'Calle ' || c_mktsegment END AS owner_address, CAST(NULL AS VARCHAR) AS owner_certificate, c_nationkey, c_mktsegment FROM customer)"""


def _owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    nation = F.col("c_nationkey").cast("string")
    return table(spark, sf_dir, "customer").select(
        k.alias("doc_id"), F.when(k % 3 == 0, F.concat(F.lit("AAA0101"), F.lpad(nation, 2, "0"), F.lit("XYZ"))).alias("owner_rfc"), F.when(k % 3 < 2, F.concat(F.lit("Casa "), nation)).alias("owner_name"),
        F.when(k % 2 == 0, F.concat(F.lit("Calle "), F.col("c_mktsegment"))).alias("owner_address"), F.lit(None).cast("string").alias("owner_certificate"), "c_nationkey", "c_mktsegment",
    )


@query(f"""WITH {_OWNERS}, idn AS (SELECT doc_id, CASE WHEN owner_rfc IS NOT NULL THEN 'RFC:' || upper(owner_rfc) WHEN owner_name IS NOT NULL AND owner_address IS NOT NULL THEN 'META:' || upper(owner_name) || '|' || upper(owner_address) END AS identity,
  CASE WHEN owner_rfc IS NOT NULL THEN 'AUTO_RESOLVED_RFC' WHEN owner_name IS NOT NULL AND owner_address IS NOT NULL THEN 'AUTO_RESOLVED_METADATA' ELSE 'AUTO_SPLIT' END AS auto_state FROM own)
SELECT doc_id, CASE WHEN identity IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY identity) END AS group_id, identity, auto_state FROM idn""")
def auto_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _owners(spark, sf_dir)
    known = groups.auto_identity(docs)
    first = known.where("identity is not null").groupBy("identity").agg(F.min("doc_id").alias("left"))
    edges = known.join(first, "identity").where("doc_id <> left").select("left", F.col("doc_id").alias("right"), F.lit(relations.EXACT).alias("relation"))
    other = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("left"), (F.col("c_custkey") + 1).alias("right"), F.lit(relations.SERIES).alias("relation"))
    out = groups.auto_groups(docs, edges.unionByName(other))
    return out.select("doc_id", "group_id", "identity", "auto_state")


@query(f"""WITH {_OWNERS} SELECT c_nationkey AS group_id, arg_min(doc_id, (-(CAST(owner_rfc IS NOT NULL AS INT) + CAST(owner_name IS NOT NULL AS INT) + CAST(owner_address IS NOT NULL AS INT)), -(doc_id % 3), -(doc_id % 5), doc_id)) AS source FROM own GROUP BY c_nationkey""")
def metadata_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _owners(spark, sf_dir)
    has = lambda c: F.col(c).isNotNull().cast("int")
    return groups.metadata_source(o.select(F.col("c_nationkey").alias("group_id"), "doc_id", (has("owner_rfc") + has("owner_name") + has("owner_address")).alias("identity_fields"), (F.col("doc_id") % 3).alias("temporal_fields"), (F.col("doc_id") % 5).alias("rows")))


@query(f"""WITH {_OWNERS}, g AS (SELECT c_mktsegment || '-' || c_nationkey || '-' || (doc_id % 3) AS group_id, * FROM own)
SELECT group_id, CASE WHEN count(DISTINCT owner_rfc) = 1 THEN 'RFC:' || max(owner_rfc) WHEN count(DISTINCT owner_name) = 1 THEN 'NAME:' || upper(max(owner_name)) ELSE 'GROUP:' || group_id END AS entity_key FROM g GROUP BY group_id""")
def entity_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _owners(spark, sf_dir)
    group = F.concat_ws("-", "c_mktsegment", F.col("c_nationkey").cast("string"), (F.col("doc_id") % 3).cast("string"))
    return groups.entity_key(o.select(group.alias("group_id"), F.lit(None).cast("string").alias("entity_id"), F.lit(False).alias("is_source"), "owner_rfc", "owner_name"))


@query(r"""SELECT o_orderkey, concat_ws(',', CASE WHEN col THEN 'ACCOUNT_NORMALIZATION_COLLISION' END, CASE WHEN own AND NOT (conf AND (ent OR src)) THEN 'OWNER_RFC_CONFLICT' END, CASE WHEN tmp AND NOT (conf AND src) THEN 'PERIOD_CONFLICT' END) AS blocked
FROM (SELECT o_orderkey, o_orderkey % 2 = 0 AS own, o_orderkey % 3 = 0 AS tmp, o_orderkey % 7 = 0 AS col, o_orderstatus = 'O' AS conf, o_custkey % 2 = 0 AS ent, o_custkey % 3 = 0 AS src FROM orders)""")
def blocking_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    found = F.array_compact(F.array(F.when(k % 2 == 0, "OWNER_RFC_CONFLICT"), F.when(k % 3 == 0, "PERIOD_CONFLICT"), F.when(k % 7 == 0, relations.COLLISION)))
    blocked = groups.blocking_conflicts(found, F.col("o_orderstatus") == "O", F.when(c % 2 == 0, "e"), F.when(c % 3 == 0, "s"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(blocked, ",").alias("blocked"))


# --- keyed pseudonyms --------------------------------------------------------------------------------------------

_I, _O = (k.hex() for k in padded_keys(DEMO_SEED))


def _hmac(namespace: str, value: str) -> str:
    """SQL: the digest as lower-case hexadecimal digits."""
    return f"sha256(from_hex('{_O}') || from_hex(sha256(from_hex('{_I}') || encode('{namespace}:' || upper({value})))))"


def _b(d: str, i: int) -> str:
    return f"CAST('0x' || substr({d}, {2 * i + 1}, 2) AS INT)"


def _letter(x: str) -> str:
    return f"substr('ABCDEFGHJKLMNPQRSTUVWXYZ23456789', CAST(({x}) % 32 AS INT) + 1, 1)"


def _pseudo(spark: SparkSession) -> Pseudonyms:
    return Pseudonyms(spark, DEMO_SEED)


@query(f"SELECT c_custkey, upper({_hmac('report-file', 'c_name')}) AS token FROM customer")
def hmac_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", _pseudo(spark).token("report-file", F.col("c_name"), 64).alias("token"))


_NUMBER = f"CAST(100 + CAST('0x' || substr({_hmac('address', 'c_name')}, 1, 4) AS INT) % 8900 AS VARCHAR)"
_T8 = {n: f"substr(upper({_hmac(n, 'c_name')}), 1, 8)" for n in ("company", "person", "user", "bank", "population")}


@query(f"""SELECT c_custkey, 'ENTIDAD SINTETICA ' || {_T8['company']} || ' S.A. DE C.V.' AS company, 'E-SINT-' || {_T8['company']} AS compact_company, 'PERSONA ' || {_T8['person']} AS person, 'U-' || {_T8['user']} AS "user",
  'BANCO FICTICIO NEXORA ' || {_T8['bank']} AS bank, 'VIA SINTETICA #' || {_NUMBER} || ' ZONA NEUTRA' AS address, 'CIUDAD NEXORA, ' || {_T8['population']} AS population FROM customer""")
def pseudonym_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = _pseudo(spark), F.col("c_name")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", p.company(k, F.lit("Acme Sociedad Anónima de Capital Variable"))[0].alias("company"), p.compact_company(k).alias("compact_company"), p.person(k)[1].alias("person"), p.user(k)[2].alias("user"),
        p.bank(k)[0].alias("bank"), p.address(k)[0].alias("address"), p.population(k)[0].alias("population"),
    )


_RFC_D = "d"


@query(f"""SELECT c_custkey, repeat('Z', n - 9) || lpad(CAST(70 + {_b('d', 0)} % 30 AS VARCHAR), 2, '0') || lpad(CAST(1 + {_b('d', 1)} % 12 AS VARCHAR), 2, '0') || lpad(CAST(1 + {_b('d', 2)} % 28 AS VARCHAR), 2, '0')
  || {_letter(_b('d', 3))} || {_letter(_b('d', 4))} || {_letter(_b('d', 5))} AS rfc FROM (SELECT c_custkey, CAST(12 + c_custkey % 3 AS INT) AS n, {_hmac('rfc', 'c_name')} AS d FROM customer)""")
def pseudonym_rfc(spark: SparkSession, sf_dir: str) -> DataFrame:
    original = F.rpad(F.lit("A"), (F.col("c_custkey") % 3 + 12).cast("int"), F.lit("A"))
    return table(spark, sf_dir, "customer").select("c_custkey", _pseudo(spark).rfc(original, F.col("c_name")).alias("rfc"))


@query(f"""SELECT c_custkey, string_agg(CASE WHEN regexp_matches(ch, '[0-9A-Za-z]') THEN {_letter("CAST('0x' || substr(d, CAST(2 * ((k - 1) % 32) + 1 AS INT), 2) AS INT)")} ELSE ch END, '' ORDER BY i) AS masked
FROM (SELECT *, sum(CASE WHEN regexp_matches(ch, '[0-9A-Za-z]') THEN 1 ELSE 0 END) OVER (PARTITION BY c_custkey ORDER BY i) AS k FROM (SELECT c_custkey, {_hmac('certificate', "'KEY' || ':' || c_name")} AS d, unnest(range(1, length(c_name) + 1)) AS i, substr(c_name, CAST(i AS INT), 1) AS ch FROM customer)) GROUP BY c_custkey""")
def certificate_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, p = _pseudo(spark).bound(table(spark, sf_dir, "customer"))
    return rows.select("c_custkey", p.certificate(F.col("c_name"), F.lit("key")).alias("masked"))


@query(f"""SELECT c_custkey, raw, string_agg(CASE WHEN regexp_matches(ch, '[0-9]') THEN CAST(m + CASE WHEN m >= CAST(ch AS INT) THEN 1 ELSE 0 END AS VARCHAR) ELSE ch END, '' ORDER BY i) AS masked
FROM (SELECT *, CASE WHEN regexp_matches(ch, '[0-9]') THEN CAST('0x' || substr(d, CAST(2 * (k - 1) + 1 AS INT), 2) AS INT) % 9 END AS m
  FROM (SELECT *, sum(CASE WHEN regexp_matches(ch, '[0-9]') THEN 1 ELSE 0 END) OVER (PARTITION BY c_custkey ORDER BY i) AS k
    FROM (SELECT c_custkey, raw, {_hmac('numeric-identifier', "'K' || ':' || regexp_replace(raw, '[^0-9]', '', 'g') || ':0'")} AS d, unnest(range(1, length(raw) + 1)) AS i, substr(raw, CAST(i AS INT), 1) AS ch
      FROM (SELECT c_custkey, substr(c_name, 10, 4) || '-' || substr(c_name, 14) AS raw FROM customer)))) GROUP BY c_custkey, raw""")
def numeric_identifier_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.substring("c_name", 10, 4), F.lit("-"), F.substring("c_name", 14, 99))
    rows, p = _pseudo(spark).bound(table(spark, sf_dir, "customer"))
    return rows.select("c_custkey", raw.alias("raw"), p.numeric_identifier(raw, F.lit("k")).alias("masked"))


_OFFSET = f"CAST('0x' || substr({_hmac('date-offset', 'o_orderpriority')}, 1, 4) AS INT) % 99"
_DATES = f"""d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, -(13 + {_OFFSET} + ({_OFFSET}) // 11) AS off FROM orders),
s AS (SELECT *, CASE WHEN day = last_day(day) THEN last_day(CAST(day + to_months(off) AS DATE)) ELSE CAST(day + to_months(off) AS DATE) END AS shifted FROM d)"""


@query(f"WITH {_DATES} SELECT o_orderkey, off AS month_offset, shifted FROM s")
def shift_date_eom(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, scope, day = _pseudo(spark), F.col("o_orderpriority"), F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select("o_orderkey", p.month_offset(scope).alias("month_offset"), p.shift_date(day, scope).alias("shifted"))


@query(f"""WITH {_DATES}, e AS (SELECT o_orderkey, year(day) AS y, month(day) AS m, CAST(make_date(year(day), month(day), 15) + to_months(off) AS DATE) AS t FROM d)
SELECT o_orderkey, CAST(CASE WHEN year(t) = y THEN year(t) - 1 ELSE year(t) END AS VARCHAR) AS exercise, lpad(CAST(CASE WHEN month(t) = m THEN month(t) % 12 + 1 ELSE month(t) END AS VARCHAR), 2, '0') AS period FROM e""")
def exercise_period_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, m = _pseudo(spark).exercise_and_period(F.date_format("o_orderdate", "yyyy"), F.date_format("o_orderdate", "MM"), F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select("o_orderkey", y.alias("exercise"), m.alias("period"))


# --- registry ----------------------------------------------------------------------------------------------------

_REG = f"""ask AS (SELECT c_custkey, upper({_hmac('registry-address', 'c_name')}) AS identifier_hmac, 'VIA SINTETICA #' || {_NUMBER} || ' ZONA NEUTRA' AS synthetic_value FROM customer),
ex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY synthetic_value ORDER BY identifier_hmac) AS r FROM ask WHERE c_custkey % 2 = 0) WHERE r = 1),
fresh AS (SELECT * FROM ask WHERE identifier_hmac NOT IN (SELECT identifier_hmac FROM ex)),
won AS (SELECT synthetic_value, min(identifier_hmac) AS owner FROM fresh WHERE synthetic_value NOT IN (SELECT synthetic_value FROM ex) GROUP BY synthetic_value)"""


def _registry(spark: SparkSession, sf_dir: str):
    p, k = _pseudo(spark), F.col("c_name")
    ask = table(spark, sf_dir, "customer").select("c_custkey", F.lit("address").alias("namespace"), p.token("registry-address", k, 64).alias("identifier_hmac"), F.lit("address").alias("token_type"), p.address(k)[0].alias("synthetic_value"), F.lit(1).alias("algorithm_version"))
    held = ask.where("c_custkey % 2 = 0").groupBy("namespace", "token_type", "synthetic_value", "algorithm_version").agg(F.min("identifier_hmac").alias("identifier_hmac"))
    return registry.upsert(held, ask.drop("c_custkey"))


@query(f"WITH {_REG} SELECT identifier_hmac, synthetic_value FROM ex UNION ALL SELECT owner, synthetic_value FROM won")
def registry_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _registry(spark, sf_dir)[0].select("identifier_hmac", "synthetic_value")


@query(f"WITH {_REG} SELECT identifier_hmac, synthetic_value FROM fresh WHERE identifier_hmac NOT IN (SELECT owner FROM won)")
def registry_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _registry(spark, sf_dir)[2].select("identifier_hmac", "synthetic_value")


# --- descriptions ------------------------------------------------------------------------------------------------

_N9 = "lpad(CAST(c_custkey AS VARCHAR), 9, '0')"


def _descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("c_custkey"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")
    made = (
        F.when(k % 6 == 0, F.concat(F.lit("Comercial Uno ABC0101"), F.substring(n, 8, 2), F.lit("XY1")))
        .when(k % 6 == 1, F.concat(F.lit("BANCO DEMO CTA. 7"), n))
        .when(k % 6 == 2, F.concat(F.lit("Servicios Varios 8"), n))
        .when(k % 6 == 3, F.lit("Gastos 2026 16% 12,345.67"))
        .when(k % 6 == 4, F.concat(F.lit("Banco Norte General 41-7"), n, F.lit("-4")))
        .otherwise(F.lit("Caja chica"))
    )
    return table(spark, sf_dir, "customer").select("c_custkey", made.alias("description"))


_KINDS = f"""k AS (SELECT c_custkey, CAST(c_custkey % 6 AS INT) AS k, {_N9} AS n FROM customer),
dt AS (SELECT c_custkey, CASE k WHEN 0 THEN 'rfc_entidad_descripcion' WHEN 1 THEN 'banco_identificador_descripcion' WHEN 2 THEN 'rfc_entidad_descripcion' WHEN 4 THEN 'banco_identificador_descripcion' END AS category,
  CASE k WHEN 0 THEN 'ABC0101' || substr(n, 8, 2) || 'XY1' WHEN 1 THEN '7' || n WHEN 2 THEN '8' || n WHEN 4 THEN '41-7' || n || '-4' END AS identifier,
  CASE k WHEN 0 THEN 'Comercial Uno' WHEN 1 THEN 'BANCO DEMO' WHEN 2 THEN 'Servicios Varios' WHEN 4 THEN 'Banco Norte General' END AS entity,
  CASE k WHEN 0 THEN 'ABC0101' || substr(n, 8, 2) || 'XY1' WHEN 1 THEN 'BANCO DEMO:7' || n WHEN 2 THEN 'SERVICIOS VARIOS:8' || n WHEN 4 THEN 'BANCO NORTE GENERAL:417' || n || '4' END AS entity_key FROM k)"""


@query(f"WITH {_KINDS} SELECT * FROM dt")
def detect_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = descriptions.cell_rules(F.col("description"))
    return _descriptions(spark, sf_dir).select("c_custkey", s.alias("s")).select("c_custkey", "s.category", "s.identifier", "s.entity", "s.entity_key")


@query(f"WITH {_KINDS} SELECT c_custkey, CASE WHEN category IS NOT NULL THEN identifier END AS identifier, category FROM dt")
def detect_line_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = descriptions.line_rules(F.col("description"))
    return _descriptions(spark, sf_dir).select("c_custkey", s.alias("s")).select("c_custkey", "s.identifier", "s.category")


@query()
def mask_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, p = _pseudo(spark).bound(_descriptions(spark, sf_dir).select("c_custkey", "description", descriptions.cell_rules(F.col("description")).alias("s")))
    return d.select("c_custkey", descriptions.masked(F.col("description"), F.col("s"), p).alias("masked"))


@query(r"""SELECT doc_id, kind, n FROM (SELECT doc_id, unnest(['email', 'date', 'digits']) AS kind, unnest([
  len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+')), len(regexp_extract_all(text, '\b\d{1,2}[./-]\d{1,2}[./-]\d{2,4}\b')), len(regexp_extract_all(text, '\b\d{5,}\b'))]) AS n FROM documents) WHERE n > 0""")
def pii_scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(descriptions.scan(F.col("text"))).alias("s")).select("doc_id", "s.kind", "s.n").where("n > 0")


# --- amounts and dates -------------------------------------------------------------------------------------------


@query(r"""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL WHEN 2 THEN 0 ELSE CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS DOUBLE) END AS amount FROM orders""")
def decimal_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    raw = F.when(k == 3, "12x").when(k == 2, " - ").otherwise(F.format_number("o_totalprice", 2))
    return table(spark, sf_dir, "orders").select("o_orderkey", values.decimal_value(raw).cast("double").alias("amount"))


_MONTHS_SQL = "['enero', 'febrero', 'marzo', 'abril', 'mayo', 'junio', 'julio', 'agosto', 'septiembre', 'octubre', 'noviembre', 'diciembre']"


@query(r"SELECT o_orderkey, CAST(o_orderdate AS DATE) AS value, 1 AS n, o_orderkey % 2 = 0 AS is_print FROM orders")
def parse_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate")
    name = F.element_at(F.array(*[F.lit(x) for x in values.MONTH_NAMES]), F.month(day))
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(day, "dd/MM/yyyy")).when(F.col("o_orderkey") % 3 == 1, F.concat_ws("/", F.date_format(day, "d"), name, F.date_format(day, "yy"))).otherwise(F.date_format(day, "d-M-yyyy"))
    line = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "Fecha: ").otherwise("Corte al "), raw)
    found = values.dates_in(line)
    return table(spark, sf_dir, "orders").select("o_orderkey", found.alias("f"), values.is_print_context(line).alias("is_print")).select("o_orderkey", F.get("f", F.lit(0))["value"].alias("value"), F.size("f").alias("n"), "is_print")


@query(rf"""SELECT o_orderkey, CASE o_orderkey % 2 WHEN 0 THEN 'Al ' || strftime(o_orderdate, '%d/%m/%Y') || '.' ELSE 'Al ' || day(o_orderdate) || '-' || substr(({_MONTHS_SQL})[month(o_orderdate)], 1, 3) || '-' || strftime(o_orderdate, '%y') || '.' END AS shown FROM orders""")
def format_date_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    template = F.when(F.col("o_orderkey") % 2 == 0, "Al 01/02/2020.").otherwise("Al 1-ene-20.")
    return table(spark, sf_dir, "orders").select("o_orderkey", values.format_date_like(template, F.col("o_orderdate").cast("date")).alias("shown"))


# --- layouts -----------------------------------------------------------------------------------------------------


def _anchors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("lines", "shipped by air", 1.0), ("lines", "ord er", 3.0), ("pages", "nav", 2.0), ("pages", "article", 2.0)], "family string, anchor string, weight double")


@query(r"""WITH a(family, anchor, weight) AS (VALUES ('lines', 'SHIPPEDBYAIR', 1.0), ('lines', 'ORDER', 3.0), ('pages', 'NAV', 2.0), ('pages', 'ARTICLE', 2.0)),
h AS (SELECT page_id AS doc_id, regexp_replace(strip_accents(upper(html)), '[^A-Z0-9]', '', 'g') AS c FROM pages)
SELECT doc_id, family, CAST(sum(weight) FILTER (WHERE contains(c, anchor)) / sum(weight) AS DOUBLE) AS score FROM h, a GROUP BY doc_id, family HAVING count(*) FILTER (WHERE contains(c, anchor)) > 0""")
def family_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.family_scores(table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text")), _anchors(spark))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets of layout C (even suppliers) and B (odd), with six or four amount columns."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"))
    head_c, head_b = ["No. Cuenta", "Naturaleza", "Cuenta", "Saldo inicial", "Debe", "Haber", "Saldo final"], ["Cuenta", "Saldo inicial", "Debe", "Haber", "Saldo final"]
    header = F.posexplode(F.when(F.col("doc_id") % 2 == 0, F.array(*map(F.lit, head_c))).otherwise(F.array(*map(F.lit, head_b))))
    h = s.select("doc_id", header.alias("c", "value")).select("doc_id", F.lit("S").alias("sheet"), (F.col("doc_id") % 4 + 1).cast("int").alias("row"), (F.col("c") + 1).alias("col"), "value")
    n = F.when(F.col("doc_id") % 2 == 0, 7).otherwise(5)
    r = s.select("doc_id", F.explode(F.sequence(F.lit(10), F.lit(14))).alias("row"), n.alias("n")).select("doc_id", "row", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("col"), "n")
    value = F.when(F.col("col") == 1, F.concat(F.lit("101."), F.col("row").cast("string"))).when(F.col("col") > F.col("n") - 4, F.concat((F.col("doc_id") % 9 + 1).cast("string"), F.lit(",000.50"))).otherwise("Texto")
    return h.unionByName(r.select("doc_id", F.lit("S").alias("sheet"), "row", "col", value.alias("value")))


@query("SELECT s_suppkey AS doc_id, CASE WHEN s_suppkey % 2 = 0 THEN 'C' ELSE 'B' END AS profile, 'S' AS sheet, CAST(s_suppkey % 4 + 1 AS INT) AS header_row FROM supplier")
def header_profile_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.header_profiles(_cells(spark, sf_dir))


@query("SELECT s_suppkey AS doc_id, 'S' AS sheet, CASE WHEN s_suppkey % 2 = 0 THEN '4,5,6,7' ELSE '2,3,4,5' END AS money_cols FROM supplier")
def money_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.money_columns(_cells(spark, sf_dir), header_row=5).select("doc_id", "sheet", F.array_join(F.transform("money_cols", lambda c: c.cast("string")), ",").alias("money_cols"))


_BOX = "SELECT l_orderkey AS doc_id, l_linenumber AS line_ord, CAST(l_partkey % 2 AS INT) AS page, CAST(l_partkey % 700 AS DOUBLE) AS y0, CAST(l_partkey % 700 + 12 AS DOUBLE) AS y1, CAST(l_suppkey % 700 AS DOUBLE) AS s0, CAST(l_suppkey % 700 + 30 AS DOUBLE) AS s1 FROM lineitem"


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = F.col("l_partkey") % 700, F.col("l_suppkey") % 700
    d = lambda c, n: c.cast("double").alias(n)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line_ord"), (F.col("l_partkey") % 2).cast("int").alias("page"), d(p, "y0"), d(p + 12, "y1"), d(s, "s0"), d(s + 30, "s1"))


@query(f"WITH b AS ({_BOX}) SELECT s.doc_id, s.line_ord AS span_id, s.page, min(l.line_ord) AS line_ord FROM b s JOIN b l ON s.doc_id = l.doc_id AND s.page = l.page AND least(s.s1, l.y1) > greatest(s.s0, l.y0) GROUP BY ALL")
def line_span_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _boxes(spark, sf_dir)
    return layout.attach_to_lines(b, b.select("doc_id", "page", F.col("line_ord").alias("span_id"), F.col("s0").alias("y0"), F.col("s1").alias("y1")))


@query(f"WITH b AS ({_BOX}) SELECT c.doc_id, c.line_ord AS company_id, arg_min('R' || r.line_ord, (abs(c.page - r.page) * 10000 + abs(c.y0 - r.s0), 'R' || r.line_ord)) AS rfc FROM b c JOIN b r ON c.doc_id = r.doc_id GROUP BY ALL")
def nearest_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _boxes(spark, sf_dir)
    return layout.nearest_owner(b.withColumnRenamed("line_ord", "company_id"), b.select("doc_id", "page", F.col("s0").alias("y0"), F.concat(F.lit("R"), F.col("line_ord").cast("string")).alias("rfc")))


_ROWS = "SELECT l_orderkey AS doc_id, 1 AS page, l_linenumber AS row_ord, CAST(1 + min(l_suppkey) % 2 AS VARCHAR) || CASE WHEN l_linenumber > 1 THEN CAST(min(l_partkey) % 3 AS VARCHAR) ELSE '' END AS code, max(l_quantity) > 40 AS is_bank FROM lineitem GROUP BY l_orderkey, l_linenumber"


@query(f"""WITH b AS ({_ROWS}), p AS (SELECT *, coalesce(lag(is_bank) OVER (PARTITION BY doc_id, page ORDER BY row_ord), false) AS prev FROM b)
SELECT doc_id, row_ord, code, prev OR EXISTS (SELECT 1 FROM b r WHERE r.doc_id = p.doc_id AND r.is_bank AND r.row_ord < p.row_ord AND r.code <> p.code AND starts_with(p.code, r.code)) AS parent_bank FROM p""")
def bank_parent_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.concat((F.col("l_suppkey") % 2 + 1).cast("string"), F.when(F.col("l_linenumber") > 1, (F.col("l_partkey") % 3).cast("string")).otherwise(""))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("l_suppkey"), F.min("l_partkey").alias("l_partkey"), F.max("l_quantity").alias("l_quantity"))
    rows = lines.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.col("l_linenumber").alias("row_ord"), code.alias("code"), (F.col("l_quantity") > 40).alias("is_bank"))
    return layout.bank_parents(rows).select("doc_id", "row_ord", "code", "parent_bank")


@query("SELECT l_orderkey AS doc_id, l_returnflag AS category, CAST(l_suppkey % 3 AS INT) AS page, min(l_linenumber) AS ord FROM lineitem GROUP BY ALL")
def dedupe_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("category"), (F.col("l_suppkey") % 3).cast("int").alias("page"), F.col("l_linenumber").alias("ord"), *[F.lit(v).alias(c) for c, v in (("x0", 1.01), ("y0", 2.0), ("x1", 3.0), ("y1", 4.0))], F.lit("Á b").alias("original"))
    return layout.dedupe_detections(d).select("doc_id", "category", "page", "ord")


# --- validation and reports --------------------------------------------------------------------------------------


@query(f"""WITH {_FIXTURE} SELECT doc_id, line_ord, CASE line_ord WHEN 3 THEN 'missing' ELSE 'debe' END AS differs FROM fr WHERE kind = '' AND (line_ord = 3 OR line_ord = 5)""")
def validate_ledger_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = relation_fixture(spark, sf_dir)[0].where("kind = ''")
    after = before.where("line_ord <> 3").withColumn("debe", F.when(F.col("line_ord") == 5, F.col("debe") + 1).otherwise(F.col("debe")))
    return validation.ledger_differences(before, after).withColumn("differs", F.array_join("differs", ","))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n_before, count(*) FILTER (WHERE l_quantity < 50) AS n_after FROM lineitem GROUP BY ALL HAVING count(*) <> count(*) FILTER (WHERE l_quantity < 50)""")
def multiset_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return validation.multiset_difference(li, li.where("l_quantity < 50"), ["l_returnflag", "l_linestatus"])


@query(r"""SELECT doc_id, 'text' AS part, CAST(contains(text, 'License') AS INT) + CAST(contains(text, source) AS INT) + CAST(contains(text, lang) AS INT) AS n_leaks FROM documents
WHERE contains(text, 'License') OR contains(text, source) OR contains(text, lang)""")
def leakage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    originals = d.select("doc_id", F.explode(F.array(F.lit("License"), F.col("source"), F.col("lang"))).alias("original"))
    return validation.leakage(d.select("doc_id", F.lit("text").alias("part"), "text"), originals)


@query("SELECT count(*) AS files, count(*) FILTER (WHERE o_orderstatus <> 'F') AS ok, count(*) FILTER (WHERE o_orderstatus = 'F') AS failed, count(DISTINCT o_custkey) AS groups FROM orders")
def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.summary(table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderstatus") != "F").alias("success"), F.col("o_custkey").alias("group_id")))


@query("SELECT doc_id, string_agg(category || '=' || n, ',' ORDER BY category) AS counts FROM (SELECT l_orderkey AS doc_id, l_returnflag AS category, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY doc_id")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = reports.category_counts(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("category")))
    return c.select("doc_id", F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("counts"))


@query("SELECT c_custkey FROM customer WHERE c_custkey % 4 = 1")
def retry_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = table(spark, sf_dir, "customer").select("c_custkey", _pseudo(spark).token("report-file", F.col("c_name"), 32).alias("file_id"))
    return validation.selected_for_retry(src, src.select("file_id", (F.col("c_custkey") % 4 != 1).alias("success"))).select("c_custkey")


@query(f"""{_GROUPS} SELECT group_id, count(*) AS n_files, min(grp.doc_id) AS first_file FROM grp WHERE group_id IN (SELECT g.group_id FROM grp g JOIN rel ON relation <> 'ambiguous' AND rel."left" = g.doc_id) GROUP BY group_id""")
def manifest_proposal(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger, docs = relation_fixture(spark, sf_dir)
    rel = relations.infer_relations(ledger, docs, within=["entity"], expand_collisions=True)
    members = groups.connected_components(docs.select("doc_id"), rel.where(F.col("relation").isin(*groups.LINKS)).select("left", "right"))
    kind = groups.group_summary(members, rel).select("group_id", "relation")
    rows = members.join(kind, "group_id").join(docs.select("doc_id", (F.col("year") * 12 + F.col("month")).alias("period")), "doc_id")
    return reports.proposal(rows).select("group_id", F.size("files").cast("long").alias("n_files"), F.array_min("files").alias("first_file"))


# --- manifests and pages -----------------------------------------------------------------------------------------


def _declared(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as documents; every third is declared, and every ninth of these under a name that doesn't exist."""
    o = table(spark, sf_dir, "orders")
    name = F.when(F.col("o_orderkey") % 27 == 0, -F.col("o_orderkey") - 1).otherwise(F.col("o_orderkey"))
    return o.where("o_orderkey % 3 = 0").select((F.col("o_custkey") % 50).alias("group_id"), name.alias("file")), o.select(F.col("o_orderkey").alias("doc_id"))


_DECLARED = "mf AS (SELECT o_custkey % 50 AS group_id, CASE WHEN o_orderkey % 27 = 0 THEN -o_orderkey - 1 ELSE o_orderkey END AS file FROM orders WHERE o_orderkey % 3 = 0)"


@query(f"WITH {_DECLARED} SELECT group_id, file, CASE WHEN file NOT IN (SELECT o_orderkey FROM orders) THEN 'MANIFEST_FILE_MISSING' END AS error_code FROM mf")
def manifest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.joined(*_declared(spark, sf_dir))


@query(f"WITH {_DECLARED} SELECT o_orderkey AS doc_id FROM orders WHERE o_orderkey NOT IN (SELECT file FROM mf)")
def manifest_unassigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.unassigned(*_declared(spark, sf_dir))


@query("""SELECT name, string_agg(DISTINCT rfc, ',' ORDER BY rfc) AS rfcs FROM (SELECT 'NATION ' || c_nationkey AS name, upper(c_mktsegment) AS rfc FROM customer WHERE c_custkey % 40 = c_nationkey)
GROUP BY name HAVING count(DISTINCT rfc) > 1""")
def names_with_several_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where("c_custkey % 40 = c_nationkey")
    found = manifest.names_with_several_ids(c.select(F.concat(F.lit(" Nation  "), F.col("c_nationkey").cast("string")).alias("name"), F.lower("c_mktsegment").alias("rfc")))
    return found.select("name", F.array_join("rfcs", ",").alias("rfcs"))


@query(f"""WITH {_LEDGER} SELECT doc_id, sha256(string_agg(account_code || '|' || saldo_inicial || '|' || debe || '|' || haber || '|' || saldo_final, chr(10) ORDER BY account_code)) AS content FROM ledger GROUP BY doc_id""")
def content_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("account_code"))
    return manifest.content_keys(derived_ledger(spark, sf_dir).withColumn("line_ord", order))


@query(r"""SELECT n_nationkey, CASE n_nationkey % 4 WHEN 1 THEN 'SCHEMA_LOCATION_ODD_TOKEN_COUNT' WHEN 2 THEN 'SCHEMA_LOCATION_NAMESPACE_MISMATCH' END AS warning FROM nation""")
def schema_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("n_nationkey") % 4
    where = F.when(kind == 0, "urn:a  urn:a/b.xsd").when(kind == 1, "urn:a urn:a/b.xsd urn:c").when(kind == 2, "urn:z urn:q urn:a http://other")
    return table(spark, sf_dir, "nation").select("n_nationkey", manifest.schema_warning(F.lit("urn:a"), where).alias("warning"))


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as words on three pages of a document for each nation; page 2 of every sixth document is empty."""
    c = table(spark, sf_dir, "customer").where("not (c_custkey % 3 = 2 and c_nationkey % 6 = 0)")
    x0, y0 = F.col("c_custkey") % 97, F.col("c_custkey") % 89
    return c.select(
        F.col("c_nationkey").alias("doc_id"), (F.col("c_custkey") % 3).alias("page"), "c_custkey", x0.cast("double").alias("x0"), y0.cast("double").alias("y0"),
        (x0 + F.when(F.col("c_nationkey") % 4 == 1, F.col("c_custkey") % 7).otherwise(3)).cast("double").alias("x1"), (y0 + 2).cast("double").alias("y1"),
        F.col("c_name").alias("text"), F.col("c_mktsegment").alias("font"), F.col("c_acctbal").alias("size"),
    )


_WORDS = """wd AS (SELECT c_nationkey AS doc_id, c_custkey % 3 AS page, c_custkey, c_custkey % 97 AS x0, c_custkey % 89 AS y0,
  c_custkey % 97 + CASE WHEN c_nationkey % 4 = 1 THEN c_custkey % 7 ELSE 3 END AS x1, c_custkey % 89 + 2 AS y1, c_name AS text, c_mktsegment AS font, c_acctbal AS size
  FROM customer WHERE NOT (c_custkey % 3 = 2 AND c_nationkey % 6 = 0))"""


@query(f"""WITH {_WORDS}, pg AS (SELECT n_nationkey AS doc_id, unnest([0, 1, 2]) AS page FROM nation)
SELECT doc_id, CASE WHEN bool_or(n = 0) THEN 'PAGE_WITHOUT_WORDS' ELSE 'WORD_BOX_INVALID' END AS error_code FROM (
  SELECT pg.doc_id, pg.page, count(wd.doc_id) AS n, count(*) FILTER (WHERE x1 <= x0 OR x1 > 99 OR y1 > 200) AS bad FROM pg LEFT JOIN wd USING (doc_id, page) GROUP BY ALL)
GROUP BY doc_id HAVING bool_or(n = 0) OR bool_or(bad > 0)""")
def word_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    page_rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_id"), F.explode(F.array(*map(F.lit, range(3)))).alias("page"), F.lit(99.0).alias("width"), F.lit(200.0).alias("height"))
    return pages.word_problems(_words(spark, sf_dir), page_rows)


@query(f"""WITH {_WORDS}, rg AS (SELECT n_nationkey AS doc_id, n_nationkey % 3 AS page, 10 AS x0, 10 AS y0, 60 AS x1, 50 AS y1 FROM nation)
SELECT c_custkey FROM wd WHERE NOT EXISTS (SELECT 1 FROM rg WHERE rg.doc_id = wd.doc_id AND rg.page = wd.page AND wd.x0 < rg.x1 + 1 AND wd.x1 > rg.x0 - 1 AND wd.y0 < rg.y1 + 1 AND wd.y1 > rg.y0 - 1)""")
def words_outside_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = [F.lit(float(v)).alias(e) for v, e in zip((10, 10, 60, 50), pages.EDGES)]
    regions = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_id"), (F.col("n_nationkey") % 3).alias("page"), *box)
    return pages.outside(_words(spark, sf_dir), regions, 1.0).select("c_custkey")


@query(f"WITH {_WORDS} SELECT doc_id, count(*) AS n FROM wd WHERE (c_custkey % 100) / 100.0 < 0.9 AND page = 1 GROUP BY doc_id")
def low_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.low_confidence(_words(spark, sf_dir).where("page = 1").withColumn("confidence", (F.col("c_custkey") % 100) / 100))


@query(f"WITH {_WORDS} SELECT DISTINCT doc_id, page FROM wd WHERE text LIKE '%77%'")
def header_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    spaced = F.concat_ws(" ", F.split(F.lower("text"), ""))
    return pages.header_pages(_words(spark, sf_dir).withColumn("text", spaced), "7 7")


@query(f"""WITH {_WORDS} SELECT doc_id, coalesce(median(size) FILTER (WHERE size > 0), 9) AS size, arg_max(font, (size, x1 - x0, font)) AS font FROM wd GROUP BY doc_id""")
def text_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.style(_words(spark, sf_dir))


@query(f"WITH {_DATES} SELECT o_orderkey, off * 30 AS days FROM d")
def date_offset_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", (_pseudo(spark).month_offset(F.col("o_orderpriority")) * 30).alias("days"))


@query(f"""WITH {_DATES}, t AS (SELECT s.*, CASE WHEN o_orderkey % 2 = 0 THEN shifted ELSE CAST(make_date(year(day), month(day), 15) + to_months(off) AS DATE) END AS base FROM s)
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN shifted END AS period_start, CAST(year(base) AS INT) AS year, CAST(month(base) AS INT) AS month FROM t""")
def shifted_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    day = F.col("o_orderdate").cast("date")
    rows = o.select("o_orderkey", "o_orderpriority", F.when(F.col("o_orderkey") % 2 == 0, day).alias("period_start"), F.year(day).alias("year"), F.month(day).alias("month"))
    start, year, month = values.shifted_period(lambda c: _pseudo(spark).shift_date(c, F.col("o_orderpriority")), F.col("period_start"), F.col("year"), F.col("month"))
    return rows.select("o_orderkey", start.alias("period_start"), year.alias("year"), month.alias("month"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: relations between the derived ledgers."""
    return infer_relations_within_entity(spark, sf_dir)
