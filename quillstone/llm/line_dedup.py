"""Line dedup by a log-template tree, in DataFrame functions only.

A line is cut into tokens at ASCII white space; a token with a digit is a variable field and becomes ``<*>``.  The
tree has fixed depth: token count, then the first ``depth`` tokens.  Below that, the rest of the line is cut into four
segments, and a line belongs to its full template and, from ``generalise`` tokens on, to four templates in which one
segment is a variable field.  A full template recurs by the number of different documents that hold it alone: in
``min_docs`` of them, or in two if it has ``long`` tokens or more.  A template with an open segment also needs evidence
that its lines are alike by more than chance: ``(docs - 1) * constant tokens >= evidence``.  Lines of a recurring
template are dropped from all documents but the one of the smallest doc_id that holds it, so that no passage is lost.

Nothing gathers the lines of a template: they are counted with map-side sums and dropped by a join, in which the
templates of many documents, whose number is bounded, are broadcast.

Cases: null text stays null and has no lines; blank lines are always kept; a line of fewer than ``short`` tokens that
are all variable fields is taken as it is written, as nothing else would tell such lines apart; rows with a null doc_id are returned as they are and support nothing; rows of one doc_id are
one document; a document all of whose lines go keeps an empty text; columns of any name pass through (``deduplicated``).
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, written

SEGMENTS = 4
MOST_HOT = 10_000  # templates that are broadcast, of 24 bytes each


def _parts(depth: int) -> list[Column]:
    """n, the hash of the leading tokens, and hash and size of each segment of a line with columns ``tokens`` and ``n``."""
    rest = F.greatest(F.col("n") - depth, F.lit(0))
    at = [depth + F.floor(rest * i / SEGMENTS).cast("int") for i in range(SEGMENTS + 1)]
    sizes = [b - a for a, b in zip(at, at[1:])]
    hashed = [F.xxhash64(F.slice("tokens", a + 1, F.greatest(size, F.lit(0)))).alias(f"part{i}") for i, (a, size) in enumerate(zip(at, sizes))]
    return [F.col("n"), F.xxhash64(F.slice("tokens", 1, depth)).alias("lead"), *hashed, *[size.alias(f"size{i}") for i, size in enumerate(sizes)]]


def _signatures(generalise: int) -> Column:
    """Array of (sig, constant, open): the templates of a line with the columns of ``_parts``."""
    parts = [f"part{i}" for i in range(SEGMENTS)]
    full = F.struct(F.xxhash64("n", "lead", *parts).alias("sig"), F.col("n").alias("constant"), F.lit(False).alias("open"))
    open_ = [
        F.struct(F.xxhash64("n", F.lit(f"open{i}"), "lead", *[p for j, p in enumerate(parts) if j != i]).alias("sig"), (F.col("n") - F.col(f"size{i}")).alias("constant"), F.lit(True).alias("open"))
        for i in range(SEGMENTS)
    ]
    return F.when(F.col("n") >= generalise, F.array(full, *open_)).otherwise(F.array(full))


def _blank_for(c: Column) -> Column:
    """White space other than line ends as blanks: ``split`` at one character needs no regular expression."""
    other = "\t\x0b\f\r"
    return F.when(reduce(or_, [c.contains(x) for x in other]), F.translate(c, other, " " * len(other))).otherwise(c)


def line_templates(docs: DataFrame, depth: int = 3, short: int = 5, generalise: int = 12) -> DataFrame:
    """doc_id, tid, line (from 0), sigs: one row per line that isn't blank."""
    texts = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("tid"), _blank_for(F.col("text")).alias("text"))
    lines = texts.select("doc_id", "tid", F.posexplode(F.split("text", "\n")).alias("line", "value")).where(F.trim("value") != "")
    # the look-behind lets a match begin at a token only, and the possessive runs never step back
    masked = F.when(F.col("value").rlike("[0-9]"), F.regexp_replace("value", r"(?<!\S)[^\s\d]*+\d\S*+", "<*>")).otherwise(F.col("value"))
    words = lambda c: F.array_remove(F.split(c, " "), "")
    tokens = lines.select("doc_id", "tid", "line", "value", words(masked).alias("tokens"))
    sized = tokens.select("doc_id", "tid", "line", "value", "tokens", F.size("tokens").alias("n"))
    bare = (F.col("n") < short) & (F.size(F.array_remove("tokens", "<*>")) == 0)
    sized = sized.select("doc_id", "tid", "line", "n", F.when(bare, words(F.col("value"))).otherwise(F.col("tokens")).alias("tokens"))
    return sized.select("doc_id", "tid", "line", *_parts(depth)).select("doc_id", "tid", "line", _signatures(generalise).alias("sigs"))


def recurring(sigs: DataFrame, holder: str = "doc_id", min_docs: int = 3, long: int = 12, evidence: int = 100) -> DataFrame:
    """sigs(sig, constant, open, doc_id, tid): the recurring templates, their holders, and the one that keeps them, (sig, docs, keeper)."""
    once = sigs.groupBy("sig", "constant", "open", F.col(holder).alias("holder")).agg(F.min("doc_id").alias("doc_id"))
    held = once.groupBy("sig").agg(F.count("*").alias("docs"), F.min("constant").alias("constant"), F.max("open").alias("open"), F.min(F.struct("doc_id", "holder")).alias("first"))
    full = ~F.col("open") & ((F.col("docs") >= min_docs) | ((F.col("docs") >= 2) & (F.col("constant") >= long)))
    wide = F.col("open") & (F.col("docs") >= min_docs) & ((F.col("docs") - 1) * F.col("constant") >= evidence)
    return held.where(full | wide).select("sig", "docs", F.col("first.holder").alias("keeper"))


def dropped_lines(docs: DataFrame, copies_alike: bool = False, min_docs: int = 3, long: int = 12, evidence: int = 100, **tree) -> DataFrame:
    """doc_id, tid, dropped (sorted array of line numbers) for the documents that lose lines.

    Templates that many documents hold would be hot keys of the join with their lines: as a line has at most
    ``1 + SEGMENTS`` templates, at most ``MOST_HOT`` of them can have ``hot`` holders or more, and these are broadcast.
    """
    holder = "tid" if copies_alike else "doc_id"
    lines = written(line_templates(docs, **tree), "lines")
    each = lines.select("doc_id", "tid", "line", F.explode("sigs").alias("s")).select("doc_id", "tid", "line", "s.sig", "s.constant", "s.open")
    found = written(recurring(each, holder, min_docs, long, evidence), "templates")
    hot = max(2, (1 + SEGMENTS) * lines.count() // MOST_HOT)
    each = each.drop("constant", "open")
    first = F.broadcast(found.where(F.col("docs") >= hot).select("sig", F.col("keeper").alias("kept_by")))
    seen = each.join(first, "sig", "left")
    cold = seen.where(F.col("kept_by").isNull()).drop("kept_by").join(found.where(F.col("docs") < hot).select("sig", F.col("keeper").alias("kept_by")), "sig")
    gone = seen.where(F.col("kept_by").isNotNull()).unionByName(cold).where(F.col(holder) != F.col("kept_by"))
    return gone.groupBy("doc_id", "tid").agg(F.sort_array(F.collect_set("line")).alias("dropped"))


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The rows and columns of docs, text without the dropped lines, plus ``dropped_lines`` (null if none) and ``n_lines``.

    Columns of docs keep their names and values whatever they are called; where docs has a column of these two names,
    the new one is called dropped_lines_2 or n_lines_2 (``free_name``).  With ``copies_alike`` documents of equal text
    count as one and lose the same lines, so that they stay equal.
    """
    gone = dropped_lines(docs.select("doc_id", "text"), **options).withColumnRenamed("doc_id", "of")
    # rows that can't lose lines get a number each, so that they don't meet under one key
    apart = F.col("doc_id").isNull() | F.col("text").isNull()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), F.when(apart, F.monotonically_increasing_id()).otherwise(F.xxhash64("text")).alias("row_tid"))
    joined = rows.join(gone, (F.col("id") == F.col("of")) & (F.col("row_tid") == F.col("tid")), "left")
    cut = joined.select("row", "dropped", F.split("row.text", "\n").alias("lines"))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped")), lambda i: F.get(F.col("lines"), i))
    text = F.when(F.col("dropped").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    names = [F.col("dropped").alias(free_name(docs.columns, "dropped_lines")), F.size("lines").alias(free_name(docs.columns, "n_lines"))]
    return cut.select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns], *names)


def result(docs: DataFrame) -> DataFrame:
    """The columns of query op9: doc_id, n_lines, n_dropped, text."""
    out = deduplicated(docs.select("doc_id", "text"))
    dropped = F.coalesce(F.size("dropped_lines"), F.lit(0))
    return out.select(
        "doc_id", F.when(F.col("n_lines") > 0, F.col("n_lines")).otherwise(0).cast("long").alias("n_lines"),
        F.when(dropped > 0, dropped).otherwise(0).cast("long").alias("n_dropped"), "text",
    )


#: States the rule of the docstring: recurrence by documents alone for full templates, evidence for open ones.
ORACLE_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
l AS (
  SELECT r, doc_id, unnest(lines) AS value, unnest(range(len(lines))) AS line
  FROM (SELECT r, doc_id, string_split(text, chr(10)) AS lines FROM d WHERE doc_id IS NOT NULL AND text IS NOT NULL)),
m AS (
  SELECT r, doc_id, line, regexp_extract_all(value, '[^\x20\x09-\x0D]+') AS plain,
         regexp_extract_all(regexp_replace(value, '[^\x20\x09-\x0D0-9]*[0-9][^\x20\x09-\x0D]*', '<*>', 'g'), '[^\x20\x09-\x0D]+') AS masked
  FROM l),
t AS (
  SELECT r, doc_id, line, len(masked) AS n, CASE WHEN len(masked) < 5 AND len(list_filter(masked, lambda x: x <> '<*>')) = 0 THEN plain ELSE masked END AS w
  FROM m WHERE len(masked) >= 1),
b AS (SELECT *, [3 + CAST(floor(greatest(n - 3, 0) * i / 4.0) AS INT) for i in [0, 1, 2, 3, 4]] AS a FROM t),
p AS (SELECT *, w[1:3] AS lead, [w[a[i] + 1 : a[i + 1]] for i in [1, 2, 3, 4]] AS seg FROM b),
s AS (
  SELECT r, doc_id, line, 0 AS k, n, lead, seg AS rest, n AS constant FROM p
  UNION ALL
  SELECT r, doc_id, line, k, n, lead, [CASE WHEN i = k THEN NULL ELSE seg[i] END for i in [1, 2, 3, 4]], n - (a[k + 1] - a[k])
  FROM p, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE n >= 12),
h AS (
  SELECT k, n, lead, rest, count(DISTINCT doc_id) AS docs, min(constant) AS constant, min(doc_id) AS keeper
  FROM s GROUP BY k, n, lead, rest),
g AS (
  SELECT DISTINCT s.r, s.line
  FROM s JOIN h ON s.k = h.k AND s.n = h.n AND s.lead = h.lead AND s.rest IS NOT DISTINCT FROM h.rest
  WHERE s.doc_id <> keeper
    AND CASE WHEN h.k = 0 THEN docs >= 3 OR (docs >= 2 AND h.constant >= 12) ELSE docs >= 3 AND (docs - 1) * h.constant >= 100 END),
k AS (
  SELECT r, string_agg(value, chr(10) ORDER BY line) FILTER (WHERE g.line IS NULL) AS text, count(*) AS n_lines, count(g.line) AS n_dropped
  FROM l LEFT JOIN g USING (r, line) GROUP BY r)
SELECT doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_dropped, 0) AS n_dropped,
       CASE WHEN n_dropped > 0 THEN coalesce(k.text, '') ELSE d.text END AS text
FROM d LEFT JOIN k USING (r)
"""
