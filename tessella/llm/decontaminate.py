"""Benchmark decontamination as a prefix-filtered containment join, in DataFrame operations alone.

An item's windows (``width`` consecutive words; an item of fewer is one window)
are sets of 3-word shingles. Shingles are ordered by rarity, counted over the
whole corpus; an exact occurrence must hold all of a window's shingles, so a
prefix of one, its rarest, is enough to find every candidate. A candidate is a
document position with that shingle; the shingle's offset in the window fixes
where the window would start, which the positional and length bounds check
before the words themselves are compared.

The corpus is scanned once: positions whose shingle is in the benchmark are kept in
a staged table with the words around them, and rarity, prefixes and verification
work on that table. Benchmark shingles are broadcast in blocks of at most ``BLOCK``
windows (about 30 MB), one scan for each block, so the broadcast is bounded
however large the benchmark is. Texts are never shuffled.

Edge cases: null or wordless texts have no words and no hits; wordless items are
ignored; repeated items count once per item_id; rows that repeat a doc_id share
the union of its hits; null ids match null ids; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import written

#: Fixed value: what a word is, once A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHINGLE = 3
BLOCK = 200_000


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; all-ASCII texts take the faster way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def split_words(text: Column) -> Column:
    """As ``words_of``, much faster, but with an empty string where a text begins or ends with no word."""
    return F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[^\p{Alnum}\P{ASCII}]++")


def n_split(words: Column) -> Column:
    """The number of words in ``split_words``."""
    edges = (F.element_at(words, 1) == "").cast("int") + (F.element_at(words, -1) == "").cast("int")
    return F.greatest(F.size(words) - edges, F.lit(0)).cast("long")


def _windows(items: DataFrame, width: int) -> DataFrame:
    """Distinct ``(item_id, win, n)``."""
    w = items.select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    n = F.least(F.lit(width), F.size("w"))
    starts = F.sequence(F.lit(1), F.size("w") - n + 1)
    return w.select("item_id", n.alias("n"), F.explode(F.transform(starts, lambda o: F.slice("w", o, n))).alias("win")).distinct()


def _key(array: Column, at: Column, length: int) -> Column:
    return F.xxhash64(F.lit(length), *[F.get(array, at + k) for k in range(length)])


def _staged(docs: DataFrame, keys: dict[int, DataFrame], width: int) -> DataFrame:
    """One scan: a row for each position with a benchmark shingle of some length, and one for each document (``n_words`` not null)."""
    d = docs.select("doc_id", split_words(F.col("text")).alias("w"))
    p = d.select("doc_id", "w", F.posexplode("w").alias("i", "word"))
    hit = F.lit(False)
    for s, of in keys.items():
        own = F.broadcast(of.select(F.col("key").alias(f"key{s}"), F.lit(True).alias(f"is{s}")))
        p = p.join(own, _key(F.col("w"), F.col("i"), s) == F.col(f"key{s}"), "left")
        hit = hit | F.col(f"is{s}").isNotNull()
    low = min(keys, default=1)
    back = F.greatest(F.col("i") - (width - low), F.lit(0))
    around = F.when(hit, F.slice("w", back + 1, 2 * width - low))
    n_words = F.when(F.col("i") == 0, n_split(F.col("w")))
    return written(p.where(hit | (F.col("i") == 0)).select("doc_id", "i", n_words.alias("n_words"), around.alias("around"), (F.col("i") - back).alias("at"), *[f"key{s}" for s in keys]), "places")


def _verified(staged: DataFrame, places: DataFrame, s: int) -> DataFrame:
    """``(doc_id, start, n, win)``: windows found by their rarest shingle and compared word by word."""
    seen = staged.where(F.col(f"key{s}").isNotNull()).select("doc_id", "i", "around", "at", F.col(f"key{s}").alias("key"))
    count_of = seen.groupBy("key").agg(F.count("*").alias("seen"))
    rarest = Window.partitionBy("win").orderBy("seen", "o")
    # a window with a shingle that the corpus lacks can't occur
    known = places.join(count_of, "key", "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
    prefix = known.withColumn("r", F.row_number().over(rarest)).where("r = 1 and seen > 0").select("key", "o", "n", "win")
    at = seen.join(F.broadcast(prefix), "key").where(F.col("at") >= F.col("o"))
    at = at.where(F.slice("around", F.col("at") - F.col("o") + 1, F.col("n")) == F.col("win"))
    return at.select("doc_id", (F.col("i") - F.col("o")).alias("start"), "n", "win")


def scanned(docs: DataFrame, windows: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Documents ``(doc_id, n_words)``, a row each, and occurrences ``(doc_id, start, n, win)``."""
    distinct = written(windows.select("win", "n").distinct(), "windows")
    lengths = distinct.groupBy(F.least(F.col("n"), F.lit(SHINGLE)).alias("s")).count().collect()  # at most SHINGLE rows
    blocks = max(1, math.ceil(sum(r["count"] for r in lengths) / BLOCK))
    sized = found = None
    for b in range(blocks):
        part = distinct.where(F.pmod(F.xxhash64("win"), F.lit(blocks)) == b)
        places = {}
        for s in sorted(r["s"] for r in lengths):
            own = part.where(F.least(F.col("n"), F.lit(SHINGLE)) == s)
            own = own.select("win", "n", F.explode(F.sequence(F.lit(0), F.col("n") - s)).alias("o"))
            places[s] = own.withColumn("key", _key(F.col("win"), F.col("o"), s))
        staged = _staged(docs, {s: x.select("key").distinct() for s, x in places.items()}, width)
        sized = staged.where("n_words is not null").select("doc_id", "n_words") if sized is None else sized
        for s, x in places.items():
            at = _verified(staged, x, s)
            found = at if found is None else found.unionByName(at)
    return sized, found if found is not None else docs.sparkSession.createDataFrame([], "doc_id long, start int, n int, win array<string>")


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """Per row of ``docs (doc_id, text)``: n_words, n_hit, n_items, item_ids (sorted strings), contaminated."""
    windows = _windows(items.select("item_id", "text"), width)
    sized, found = scanned(docs.select("doc_id", "text"), windows, width)
    # words inside any occurrence: a sweep over the sorted, distinct spans of a document
    spans = F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("stop"))))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("stop"))
    sweep = lambda a, x: F.struct((a["n"] + F.greatest(x["stop"] - F.greatest(x["start"], a["stop"]), F.lit(0))).alias("n"), F.greatest(a["stop"], x["stop"]).alias("stop"))
    hits = found.groupBy("doc_id").agg(spans.alias("spans"), F.collect_set("win").alias("wins"))
    hits = hits.select("doc_id", F.aggregate("spans", zero, sweep)["n"].alias("n_hit"), F.explode("wins").alias("win")).join(windows.select("win", "item_id"), "win")
    hits = hits.groupBy("doc_id").agg(F.max("n_hit").alias("n_hit"), F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    both = sized.join(hits.withColumnRenamed("doc_id", "hit_id"), F.col("doc_id").eqNullSafe(F.col("hit_id")), "left")
    none = F.array().cast("array<string>")
    return both.select(
        "doc_id", "n_words", F.coalesce(F.col("n_hit").cast("long"), F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.size("item_ids").cast("long"), F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("item_ids", none).alias("item_ids"), F.col("n_hit").isNotNull().alias("contaminated"),
    )


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    digest = F.sha2(F.array_join("item_ids", ","), 256)
    return decontaminate(docs, items).select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


QUERIES = {"op2_decontaminate": op2_decontaminate}
ORACLE_SQL = {
    "op2_decontaminate": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[o:o + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS o FROM b WHERE len(w) > 0)),
pos AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT pos.doc_id, pos.i, pos.n, win.item_id FROM pos JOIN win ON pos.n = win.n AND pos.win = win.win),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""
}
