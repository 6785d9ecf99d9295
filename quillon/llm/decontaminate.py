"""Benchmark decontamination with a distributed positional inverted index, in DataFrame operations only.

The index holds a posting (term, document row, position) for every training token that some benchmark item contains,
and one more per document for its end, so documents without such tokens are in it too.  A window of an item can only
occur where its two rarest terms do; the postings of these terms, moved back by their offsets in the item, must meet
on a diagonal (item, document, shift).  The lists of all the item's terms, moved likewise, are intersected on the
diagonals that are left; unbroken runs of a window's length or more are exact occurrences.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import BROADCAST_ROWS, ascii_lower, ceil_div, materialize, small, table

#: Words before A to Z are lower-cased; lower-casing neither joins nor splits words.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Holds a character that no word has.
END = "\x00"
#: Rows (id and hash) up to which those to be dropped are sent to all tasks; more are shuffled with the texts.
DROPPED = 1_000_000


def words(text: Column) -> Column:
    """A text's words as written, in order; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


@dataclass
class Index:
    """postings: term long, row long, pos int, doc (set on each document's end posting, whose term is -1).
    items: item long, item_id, off int, term long, size int, one row per word of an item."""

    postings: DataFrame
    items: DataFrame


def build_index(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> Index:
    """Index docs by the benchmark's vocabulary; both tables of the index are stored.

    Each row of docs is a document of its own, whatever its id; null texts have no words.
    """
    raw = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col(item_col).alias("item_id"), words(F.col(item_text_col)).alias("w"))
    spelled = materialize(raw.select("item", "item_id", F.size("w").alias("size"), F.posexplode("w").alias("off", "w")).withColumn("word", ascii_lower(F.col("w"))).drop("w"), "items")
    vocabulary = materialize(spelled.select("word").distinct().select("word", F.monotonically_increasing_id().alias("term")), "vocabulary")
    items = materialize(spelled.join(vocabulary, "word").drop("word"), "item-terms")
    known = vocabulary.select("word", F.lower("word").alias("folded"), "term").unionByName(
        vocabulary.sparkSession.range(1).select(F.lit(END).alias("word"), F.lit(END).alias("folded"), F.lit(-1).cast("long").alias("term"))
    )
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    tokens = numbered.select("row", "doc", F.posexplode(F.concat(words(F.col("text")), F.array(F.lit(END)))).alias("pos", "w"))
    # lower() is fast but folds more than A to Z: it finds the candidates, and the exact spelling decides.
    # Tokens are never shuffled by word: a vocabulary too large for one broadcast is met part by part.
    parts = ceil_div(known.count(), BROADCAST_ROWS)
    hits = None
    for k in range(parts):
        part = F.broadcast(known.where(F.pmod(F.xxhash64("folded"), F.lit(parts)) == k))
        met = tokens.join(part, (F.lower("w") == F.col("folded")) & (ascii_lower(F.col("w")) == F.col("word")))
        hits = met if hits is None else hits.unionByName(met)
    postings = hits.select("term", "row", "pos", F.when(F.col("term") == -1, F.col("doc")).alias("doc"))
    return Index(materialize(postings, "postings"), items)


def occurrences(index: Index, window: int = 10) -> DataFrame:
    """item, item_id, row, start, length: unbroken runs of an item's words in a document, of window words or more
    (of the whole item, if it is shorter)."""
    items = index.items.withColumn("need", F.least(F.col("size"), F.lit(window)))
    frequency = index.postings.where("term >= 0").groupBy("term").agg(F.count("*").alias("n"))
    ranked = items.join(frequency, "term", "left").fillna(0, ["n"])
    starts = F.sequence(F.greatest(F.lit(0), F.col("off") - F.col("need") + 1), F.least(F.col("off"), F.col("size") - F.col("need")))
    spans = ranked.select("item", "off", "term", "n", "need", F.explode(starts).alias("at"))
    order = Window.partitionBy("item", "at").orderBy("n", "off")
    rarest = spans.withColumns({"k": F.row_number().over(order), "least": F.min("n").over(order)}).where("least > 0 and k <= 2")
    anchors = materialize(rarest.select("item", "off", "term", "need").distinct(), "anchors")
    lists = index.postings.join(small(anchors), "term").select("item", "row", (F.col("pos") - F.col("off")).alias("shift"), "off", "need")
    both = lists.groupBy("item", "row", "shift", "need").agg(F.count("*").alias("n")).where(F.col("n") >= F.least(F.col("need"), F.lit(2)))
    diagonals = both.select("item", "row", "shift")
    diagonals = materialize(diagonals, "diagonals")
    wanted = diagonals.join(small(items), "item").select("item", "item_id", "row", "shift", "off", "term", "need", (F.col("shift") + F.col("off")).alias("pos"))
    rows = small(diagonals.select("row").distinct())
    there = index.postings.join(rows, "row", "left_semi").select("row", "pos", "term")
    met = there.join(wanted, ["row", "pos", "term"])
    line = Window.partitionBy("item", "row", "shift")
    runs = met.withColumn("run", F.col("off") - F.row_number().over(line.orderBy("off"))).groupBy("item", "item_id", "row", "shift", "need", "run")
    return runs.agg((F.min("off") + F.col("shift")).alias("start"), F.count("*").cast("int").alias("length")).where("length >= need").select("item", "item_id", "row", "start", "length")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """For each row of docs: its id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words and no hits; repeated rows are reported each; null item_ids are hits but are
    not listed; an empty benchmark contaminates nothing; other columns of either table are ignored.
    """
    index = build_index(docs, benchmark, id_col, text_col, item_col, item_text_col)
    found = materialize(occurrences(index, window), "occurrences")
    places = found.select("row", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("pos")).distinct()
    hits = places.groupBy("row").agg(F.count("*").alias("n_hit"))
    named = found.groupBy("row").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("ids"))
    rows = index.postings.where("term = -1").select("row", F.col("doc").alias(id_col), F.col("pos").cast("long").alias("n_words"))
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return rows.join(hits, "row", "left").join(named, "row", "left").select(
        id_col, "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


def proximity(index: Index, span: int = 50) -> DataFrame:
    """item_id, row, pos: where all of an item's different words stand within span words of its rarest one, in any order."""
    frequency = index.postings.where("term >= 0").groupBy("term").agg(F.count("*").alias("n"))
    ranked = index.items.join(frequency, "term", "left").fillna(0, ["n"])
    rarest = ranked.groupBy("item", "item_id").agg(F.min(F.struct("n", "term")).alias("r"), F.count_distinct("term").alias("terms")).where("r.n > 0")
    anchors = index.postings.join(small(rarest.select("item", "item_id", "terms", "r.term")), "term").select("item", "item_id", "terms", "row", F.col("pos").alias("at"))
    wanted = anchors.join(small(index.items.select("item", "term").distinct()), "item")
    near = wanted.join(index.postings.select("row", "term", "pos"), ["row", "term"]).where(F.abs(F.col("pos") - F.col("at")) <= span)
    return near.groupBy("item", "item_id", "row", "at", "terms").agg(F.count_distinct("term").alias("n")).where("n = terms").select("item_id", "row", F.col("at").alias("pos"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that hold a benchmark window; rows of equal or null ids are told apart by their texts."""
    keyed = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("mark")).alias("key"), F.col(text_col).alias("text"))
    found = contamination(keyed, benchmark, id_col="key", text_col="text")
    bad = materialize(found.where("contaminated").select("key.id", "key.mark").distinct(), "contaminated")
    return docs.join(small(bad, DROPPED), docs[id_col].eqNullSafe(bad["id"]) & (F.xxhash64(docs[text_col]) == bad["mark"]), "left_anti")


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: how far every document holds benchmark passages."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


DECONTAMINATION_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bx AS (SELECT item_id, w, least(10, len(w)) AS n FROM bw WHERE len(w) > 0),
win AS (SELECT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS k FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM bx)),
sizes AS (SELECT DISTINCT n FROM win),
sh AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM dw, sizes WHERE len(w) >= n)),
occ AS (SELECT doc_id, s, sh.n AS n, item_id FROM sh JOIN win ON sh.k = win.k AND sh.n = win.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM occ) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
