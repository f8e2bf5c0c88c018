"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are lower-cased (A-Z) runs of ASCII letters, digits and non-ASCII characters.  A test item is cut into
windows of ``window`` consecutive words; an item with fewer words, but at least one, is one window.  For windows of
n words, texts are k-grams, with ``k + w - 1 = n``, and winnowing keeps, of each run of w k-gram hashes, the rightmost
minimum, once for all the runs that share it: about two of w + 1 positions.  A shared span of n words holds the same
run on both sides and so always shares a kept fingerprint at the same place.

Kept fingerprints of both sides are joined; each hit is verified word by word and extended to both sides by as many equal
words as a window around it can hold.  Extensions of n words or more are hits, so hash collisions cannot count, and as
every shared window has a kept fingerprint in it, their union is the union of all shared windows.

Cases: null text has no words; no words or no match gives ``n_hit`` 0; an empty benchmark contaminates nothing;
repeated rows give one result row each; a null ``item_id`` still marks words but is not listed among the items; columns
of any name pass ``decontaminated``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, lower_ascii

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Kept test fingerprints beyond this count are joined by shuffle instead of broadcast (about 300 bytes each).
BROADCAST_WINDOWS = 200_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def gram_length(n: int, most: int = 6) -> int:
    return min(n, most)


def hashed(df: DataFrame, *keep: Column) -> DataFrame:
    """``keep``, ``words`` and ``hashes`` (one 64-bit hash a word).

    The higher-order function ends the code-generation stage, so that both arrays are made once a row and not once
    an exploded position.
    """
    return df.select(*keep, words_of(F.col("text")).alias("words")).withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))


def with_grams(rows: DataFrame, k: int) -> DataFrame:
    """rows with ``grams``: the hash of the k words from each position on, null past the last."""
    gram = lambda h, i: F.when(i + k <= F.size("hashes"), F.xxhash64(h, *[F.get(F.col("hashes"), i + j) for j in range(1, k)]))
    return rows.withColumn("grams", F.transform("hashes", gram))


def is_kept(p: Column, w: int) -> Column:
    """Whether the k-gram at p is the rightmost minimum of some run of w."""
    at = lambda i: F.get(F.col("grams"), i)
    run = lambda tests: reduce(lambda longer, t: F.when(t, longer + 1).otherwise(0), reversed(tests), F.lit(0))
    left = run([F.coalesce(at(p - j) >= at(p), F.lit(False)) for j in range(1, w)])
    right = run([F.coalesce(at(p + j) > at(p), F.lit(False)) for j in range(1, w)])
    return at(p).isNotNull() & (left + right + 1 >= w)


def equal_run(a: Column, i: Column, b: Column, j: Column, step: int, most: int) -> Column:
    """How many elements of a from i on equal those of b from j on, going by ``step``, ``most`` at most."""
    same = [F.coalesce(F.get(a, i + step * x) == F.get(b, j + step * x), F.lit(False)) for x in range(most)]
    return reduce(lambda longer, t: F.when(t, longer + 1).otherwise(0), reversed(same), F.lit(0))


def test_fingerprints(benchmark: DataFrame, window: int) -> DataFrame:
    """Kept fingerprints by surroundings: n, fp, at (place of the k-gram in ``around``), around (words), win_items (sorted ids as strings)."""
    items = hashed(benchmark, F.col("item_id").cast("string").alias("item")).where(F.size("words") > 0).withColumn("n", F.least(F.size("words"), F.lit(window)))
    parts = []
    for n in range(1, window + 1):
        k = gram_length(n)
        rows = with_grams(items.where(F.col("n") == n), k).select("item", "words", "grams", F.posexplode("grams").alias("q", "fp")).where(is_kept(F.col("q"), n - k + 1))
        first = F.greatest(F.col("q") - (n - k), F.lit(0))
        around = F.slice("words", first + 1, F.col("q") - first + n)
        parts.append(rows.select(F.lit(n).alias("n"), "fp", (F.col("q") - first).alias("at"), around.alias("around"), "item"))
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy("n", "fp", "at", "around").agg(F.sort_array(F.collect_set("item")).alias("win_items"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, item_ids (array of strings, sorted), contaminated."""
    tests = test_fingerprints(benchmark, window)
    lengths = {r["n"]: r["c"] for r in tests.groupBy("n").agg(F.count("*").alias("c")).collect()}  # at most ``window`` rows
    small = sum(lengths.values()) <= broadcast_windows
    tok = hashed(docs, F.col("doc_id"), F.xxhash64("text").alias("tid"))
    #: position -1 stands for the row itself, so that one pass over the texts gives both the hits and the word counts
    parts = []
    for n in sorted({window, *lengths}, reverse=True):
        k = gram_length(n)
        spare = n - k
        right = tests.where(F.col("n") == n).select(F.col("fp").alias("test_fp"), "at", "around", "win_items")
        size = F.size("hashes")
        rows = with_grams(tok if n == window else tok.where(size >= n), k)
        first = F.lit(-1 if n == window else 0)
        rows = rows.select("doc_id", "tid", "words", "grams", F.explode(F.sequence(first, F.greatest(first, size - k))).alias("p"))
        rows = rows.where((F.col("p") == -1) | is_kept(F.col("p"), spare + 1)) if n == window else rows.where(is_kept(F.col("p"), spare + 1))
        rows = rows.withColumn("fp", F.when(F.col("p") >= 0, F.get("grams", F.col("p"))))
        if small:  # the words stay in the row, and are only looked at where fingerprints meet
            own, here = F.col("words"), F.col("p")
            met = rows.join(F.broadcast(right), F.col("fp") == F.col("test_fp"), "left")
        else:
            lead = F.least(F.greatest(F.col("p"), F.lit(0)), F.lit(spare))
            met = rows.select("doc_id", "tid", "p", "fp", F.when(F.col("p") == -1, F.size("words")).alias("size"), lead.alias("lead"), F.when(F.col("p") >= 0, F.slice("words", F.col("p") - lead + 1, lead + n)).alias("own"))
            marks = met.where(F.col("p") == -1)
            met = met.where(F.col("p") >= 0).join(right.hint("merge"), F.col("fp") == F.col("test_fp"))
            own, here = F.col("own"), F.col("lead")
        same = equal_run(own, here, F.col("around"), F.col("at"), 1, k) == k
        before = equal_run(own, here - 1, F.col("around"), F.col("at") - 1, -1, spare)
        after = equal_run(own, here + k, F.col("around"), F.col("at") + k, 1, spare)
        hit = (F.col("p") >= 0) & F.col("win_items").isNotNull() & same & (before + after >= spare)
        spans = [F.when(hit, F.col("p") - before).otherwise(-1).alias("start"), F.when(hit, F.col("p") + k + after).alias("end")]
        if small:
            found = met.where(hit | (F.col("p") == -1)).select("doc_id", "tid", *spans, F.when(F.col("p") == -1, F.size("words")).alias("n_words"), "win_items")
            parts.append(found)
        else:
            parts.append(met.where(hit).select("doc_id", "tid", *spans, F.lit(None).cast("int").alias("n_words"), "win_items"))
            if n == window:
                parts.append(marks.select("doc_id", "tid", F.lit(-1).alias("start"), F.lit(None).cast("int").alias("end"), F.col("size").alias("n_words"), F.lit(None).cast("array<string>").alias("win_items")))
    hits = reduce(DataFrame.unionByName, parts)
    before = Window.partitionBy("doc_id", "tid").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    hits = hits.withColumn("covered", F.coalesce(F.max("end").over(before), F.lit(0)))
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.col("covered")))
    found = hits.groupBy("doc_id", "tid").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.coalesce(F.sum(fresh), F.lit(0)).cast("long").alias("n_hit"),
        F.collect_set("win_items").alias("sets"),
        F.count("n_words").cast("int").alias("copies"),
    )
    ids = F.array_sort(F.array_distinct(F.flatten("sets")))
    return found.select("doc_id", "n_words", "n_hit", ids.alias("item_ids"), (F.col("n_hit") > 0).alias("contaminated"), F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy")).drop("copy")


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows of ``docs``, all columns, that share no window with the benchmark.

    Rows with equal doc_id, null or not, stand or fall together if one of them is contaminated.
    """
    name = free_name(docs.columns, "bad_id")
    bad = contamination(docs.select("doc_id", "text"), benchmark, window).where("contaminated").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad[name]), "left_anti")


def result(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest columns of query op7."""
    return contamination(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated",
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, list_slice(w, p, p + least(len(w), 10) - 1) AS span
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM b WHERE len(w) > 0)),
dw AS (
  SELECT r, n, p, list_slice(w, p, p + n - 1) AS span
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS (SELECT dw.r, dw.p, dw.n, bw.item FROM dw JOIN bw ON dw.n = bw.n AND dw.span = bw.span),
pos AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM hit) GROUP BY r),
its AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hit GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""
