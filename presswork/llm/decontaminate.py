"""Benchmark decontamination: a prefix-filtered set join of documents with benchmark items.

Items are cut into windows of 13 consecutive words (a shorter item is one window). A document contains a window
only if it contains the window's rarest word, so that word is the window's necessary prefix. Rarity is the number
of documents with the word, counted over all documents. The join:

1. count, over all documents, the words that benchmark windows consist of; order each window's words by rarity and
   keep the rarest as its prefix with its place in the window; a window with a word that no document has is dropped;
2. in each document, find the prefix words; each hit proposes a start for every (place, length) in use; starts
   before the text and ends behind it are dropped (positional and length bounds); proposals whose window hash is
   not one of the benchmark's are dropped;
3. join what is left with the windows on the hash and verify the words themselves.

Prefix words and hashes go to the tasks as literals, in blocks of at most ``BLOCK`` windows, one pass over the
documents per block: a benchmark of any size runs, and none of what is sent grows with the documents. No task holds
more than one document's words, no document meets an item it shares no window with.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.llm.common import ascii_lower, fresh, written

WINDOW = 13
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows in one block; what a block sends to the tasks is at most this many words and hashes.
BLOCK = 20_000


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; an empty array for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def windows_of(benchmark: DataFrame, item: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """(item, win, h): every window of every item, as words and as their hash. Items without words have none."""
    items = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), words_of(F.col(text)).alias("_w"))
    items = items.withColumn("_len", F.least(F.size("_w"), F.lit(size))).filter("_len > 0")
    starts = F.sequence(F.lit(1), F.size("_w") - F.col("_len") + 1)
    wins = items.withColumn("_i", F.explode(starts)).select("item", F.slice("_w", F.col("_i"), F.col("_len")).alias("win"))
    return wins.distinct().withColumn("h", F.xxhash64("win"))


def _one_of(x: Column, values: list) -> Column:
    return x.isin(values) if values else F.lit(False)


def rarity(words: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(word, n): documents that have each word of the vocabulary. ``words`` has the array ``_w``."""
    own = F.filter(F.array_distinct("_w"), lambda x: _one_of(x, vocabulary))
    return words.select(F.explode(own).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def prefixes(block: DataFrame, counts: DataFrame) -> DataFrame:
    """(h, win, word, place): the rarest word of each distinct window and where it first stands in it."""
    tokens = block.select("h", "win").distinct().select("h", "win", F.posexplode("win").alias("place", "word"))
    known = tokens.join(counts, "word", "left")
    best = known.groupBy("h", "win").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "place")).alias("b"))
    return best.filter("b.n > 0").select("h", "win", F.col("b.word").alias("word"), F.col("b.place").alias("place"))


def _start(place: int, size: int):
    return lambda p: F.struct((p - place).alias("start"), F.lit(size).alias("len"))


def proposals(words: DataFrame, chosen: list) -> DataFrame:
    """``words`` with ``_m``: (start, len, h) of the places that may hold one of the chosen windows."""
    tokens = sorted({r["word"] for r in chosen})
    combos = sorted({(r["place"], r["len"]) for r in chosen})
    hashes = sorted({r["h"] for r in chosen})
    n = F.size("_w")
    at = F.filter(F.transform("_w", lambda x, i: F.when(_one_of(x, tokens), i).otherwise(-1)), lambda i: i >= 0)
    found = words.withColumn("_at", at)
    starts = [F.transform("_at", _start(place, size)) for place, size in combos]
    starts = reduce(F.concat, starts) if starts else F.array().cast("array<struct<start:int,len:int>>")
    fits = F.filter(F.array_distinct(starts), lambda s: (s["start"] >= 0) & (s["start"] + s["len"] <= n))
    found = found.withColumn("_s", F.when(F.size("_at") > 0, fits).otherwise(F.array().cast("array<struct<start:int,len:int>>")))
    hashed = F.transform("_s", lambda s: F.struct(s["start"].alias("start"), s["len"].alias("len"),
                                                  F.xxhash64(F.slice("_w", s["start"] + 1, s["len"])).alias("h")))
    found = found.withColumn("_p", hashed)
    real = F.filter("_p", lambda p: _one_of(p["h"], hashes))
    cut = F.transform(real, lambda p: F.struct(p["start"].alias("start"), p["len"].alias("len"), p["h"].alias("h"),
                                               F.slice("_w", p["start"] + 1, p["len"]).alias("win")))
    return found.withColumn("_m", cut).drop("_at", "_s", "_p")


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
         window: int = WINDOW, block: int = BLOCK, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of each document (all by default, under ``_row``) with n_words, n_hit (words inside an
    occurrence of a window), items (sorted ids of the items with occurring windows).

    Null and empty texts have no words; repeated documents are judged one by one, repeated items count once; an
    empty benchmark or document table gives no hits or no rows; a null item id counts as an item named ''.
    """
    cols = docs.columns if keep is None else keep
    rows = docs.select(F.struct(*[F.col(c) for c in cols]).alias("_row"), F.col(text).alias("_text"))
    wins = written(windows_of(benchmark, item, item_text, window), "decon-windows")
    n_wins = wins.select("h").distinct().count()
    blocks = max(1, math.ceil(n_wins / block))
    if blocks > 1:
        rows = written(rows.withColumn("_id", F.monotonically_increasing_id()), "decon-rows")
    parts = []
    for b in range(blocks):
        own = wins if blocks == 1 else wins.filter(F.pmod(F.xxhash64("h"), F.lit(blocks)) == b)
        vocabulary = [r[0] for r in own.select(F.explode("win")).distinct().collect()]
        counts = written(rarity(rows.select(words_of(F.col("_text")).alias("_w")), vocabulary), "decon-rarity")
        best = written(prefixes(own, counts), "decon-prefixes")
        chosen = best.select("h", "word", "place", F.size("win").alias("len")).collect()
        base = rows if blocks > 1 else rows.withColumn("_id", F.monotonically_increasing_id())
        base = base.withColumn("_w", words_of(F.col("_text")))
        out = proposals(base, chosen).withColumn("n_words", F.size("_w").cast("long"))
        parts.append(written(out.select("_id", "_m", "n_words", *(["_row"] if b == 0 else [])), "decon-matches"))
    docs_out = parts[0].select("_id", "_row", "n_words")
    matches = reduce(DataFrame.unionByName, [p.select("_id", F.explode("_m").alias("m")) for p in parts])
    matches = matches.select("_id", "m.*")
    real = matches.join(wins, ["h", "win"]).groupBy("_id").agg(
        F.sort_array(F.collect_set(F.struct("start", "len"))).alias("s"), F.sort_array(F.collect_set("item")).alias("items"))
    covered = F.aggregate("s", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
                          lambda a, p: F.struct(F.greatest(p["start"] + p["len"], a["end"]).alias("end"),
                                                (a["n"] + F.greatest(F.lit(0), p["start"] + p["len"] - F.greatest(p["start"], a["end"]))).alias("n")),
                          lambda a: a["n"])
    real = real.select("_id", covered.cast("long").alias("n_hit"), "items")
    return docs_out.join(real, "_id", "left").select(
        "_row", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 (of the ids, sorted as strings, comma-joined) and
    contaminated of every document."""
    found = find(docs, benchmark, keep=["doc_id"])
    return found.select("_row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), contaminated().alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents that are not contaminated, with their columns.

    The verdict depends on the text alone, so contaminated texts are known by two 64-bit hashes and no copy of the
    documents is written. Null and empty texts have no words and stay; null and empty benchmark texts are no items;
    very long texts are searched whole; repeated rows go or stay together; an empty table gives an empty result, an empty
    benchmark leaves all rows; other columns, whatever their names, come back as they are.
    """
    one, two, bad_one, bad_two = fresh(docs, "_h1", "_h2", "_b1", "_b2")
    hashed = docs.withColumn(one, F.xxhash64(text)).withColumn(two, F.xxhash64(F.lit(1), text))
    found = find(hashed, benchmark, text=text, keep=[one, two])
    bad = written(found.filter(contaminated()).select(F.col(f"_row.{one}").alias(bad_one), F.col(f"_row.{two}").alias(bad_two)).distinct(), "decon-bad")
    kept = hashed.join(bad, (F.col(one) == F.col(bad_one)) & (F.col(two) == F.col(bad_two)), "left_anti")
    return kept.select(*docs.columns)


def digest_sql() -> str:
    """DuckDB SQL for :func:`digest` on ``documents`` and ``benchmark``."""
    words = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
             "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {words} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS x
  FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM (SELECT *, least(len(w), {WINDOW}) AS n FROM b WHERE len(w) > 0))),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS x
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT DISTINCT r, i, dw.n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.x = bw.x),
n_hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
n_items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n_hit USING (r) LEFT JOIN n_items USING (r)"""
