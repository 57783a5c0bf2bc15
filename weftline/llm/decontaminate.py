r"""Benchmark decontamination by a positional inverted index. DataFrame functions only.

Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z. A window is ten
consecutive words of a test item (an item with fewer is one window).

1. The words of all documents are counted for the terms of the test items. Windows with
   a term that no document has are dropped; the rest are ranked by their rarest terms.
2. Postings (document, position, and the words around it) are stored for the terms
   that are rarest in some window, and for the next ones where their lists are not
   much longer. Nothing is kept for the frequent terms.
3. The lists of a window are intersected after subtracting each term's offset in the
   window, so that a document and start position is left. The stored context of the rarest
   term confirms the remaining words: matches are exact phrases.
4. Proximity: a window is near in a document where SLACK more words than it has, one after another, hold all
   of its words, each as often as the window does, in any order. Such a run holds the rarest term, so that
   its stored context, wide enough for the run, decides alone.

The index stays partitioned by document, with the test terms as the broadcast side; more
terms than BROADCAST_ROWS are worked off in blocks. Defined cases: null text or text without
words has no words and is never hit; items without words or without an id match nothing;
repeated documents each keep their row; a null doc_id is kept as a document; equal windows of
several items count for each of them; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, unused

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Lists intersected for one window, and how much longer than the rarest a further list may be.
LISTS, LONGER, ALWAYS = 3, 4, 1000
#: Words that may stand between those of a window where it is only near.
SLACK = 5
#: Up to this many rows of windows or terms are broadcast (a few dozen MB); more go block by block.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, wid, w): the windows of all items; ``wid`` names the word sequence ``w``."""
    w = items.where("item_id IS NOT NULL").select("item_id", words(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("ws") - (window - 1), F.lit(1)))
    w = w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("ws", i, window))).alias("w"))
    return w.select("item_id", F.xxhash64("w").alias("wid"), "w").distinct()


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, freq) over all documents, for the given terms."""
    return docs.select(F.explode(words(F.col("text"))).alias("term")).join(terms, "term", "left_semi").groupBy("term").agg(F.count("*").alias("freq"))


def anchors(windows: DataFrame, freqs: DataFrame) -> DataFrame:
    """(term, wid, off, rank, lists): for each window that can occur, its rarest terms and their offsets."""
    spread = windows.select("wid", F.size("w").alias("n"), F.posexplode("w").alias("off", "term")).join(freqs, "term")
    full = spread.groupBy("wid", "n").agg(F.array_sort(F.collect_list(F.struct("freq", "off", "term"))).alias("ts")).where("size(ts) = n")
    near = F.filter(F.slice("ts", 1, LISTS), lambda t: t["freq"] <= F.col("ts")[0]["freq"] * LONGER + ALWAYS)
    full = full.withColumn("near", near)
    return full.select("wid", F.size("near").alias("lists"), F.posexplode("near").alias("rank", "t")).select("t.term", "wid", "t.off", "rank", "lists")


def build_index(docs: DataFrame, terms: DataFrame, n_terms: int, reach: int = WINDOW) -> DataFrame:
    """The stored postings: (doc_id, th, n_words, pos, term, is_last, low, ctx). ``terms``: (term, lead),
    where ``lead`` asks for the context: the words less than ``reach`` away, from the position ``low``. One row per document besides, without a term, carries
    its word count. ``th`` tells rows of one doc_id with different texts apart."""
    blocks = -(-max(n_terms, 1) // BROADCAST_ROWS)
    base = docs.select("doc_id", F.xxhash64("text").alias("th"), words(F.col("text")).alias("ws"))
    spread = base.select("doc_id", "th", "ws", F.size("ws").alias("n_words"), F.posexplode_outer("ws").alias("pos", "word"))
    out = None
    for b in range(blocks):
        own = terms if blocks == 1 else terms.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == b)
        hit = spread.join(F.broadcast(own), F.col("word") == F.col("term"), "left")
        last = (F.col("pos").isNull() | (F.col("pos") == F.col("n_words") - 1)) if b == 0 else F.lit(False)
        hit = hit.where(F.col("term").isNotNull() | last)
        low = F.greatest(F.col("pos") - (reach - 1), F.lit(0))
        hit = hit.select(
            "doc_id", "th", "n_words", "pos", "term", last.alias("is_last"), low.alias("low"),
            F.when(F.col("lead"), F.slice("ws", low + 1, F.col("pos") - low + reach)).alias("ctx"),
        )
        out = hit if out is None else out.unionByName(hit)
    return cut(out, "postings")


def phrase_matches(index: DataFrame, windows: DataFrame, lists: DataFrame, small: bool) -> DataFrame:
    """(doc_id, th, start, n, wid): exact occurrences, by intersecting offset-adjusted lists."""
    side = F.broadcast if small else (lambda df: df)
    at = index.where("term IS NOT NULL").join(side(lists), "term").withColumn("start", F.col("pos") - F.col("off")).where("start >= 0")
    met = at.groupBy("doc_id", "th", "start", "wid").agg(
        F.bit_or(F.expr("shiftleft(1, rank)")).alias("met"), F.max("lists").alias("lists"),
        F.max(F.when(F.col("rank") == 0, F.struct("low", "ctx"))).alias("lead"),
    )
    met = met.where("met = shiftleft(1, lists) - 1").join(side(windows), "wid")
    exact = F.slice("lead.ctx", F.col("start") - F.col("lead.low") + 1, F.size("w")) == F.col("w")
    return met.where(exact).select("doc_id", "th", "start", F.size("w").alias("n"), "wid")


def near_matches(index: DataFrame, windows: DataFrame, lists: DataFrame, small: bool, slack: int = SLACK) -> DataFrame:
    """(doc_id, th, wid): the windows that are near in a document, exact occurrences included. The index must have been
    built with the longest window and ``slack`` as its reach."""
    side = F.broadcast if small else (lambda df: df)
    lead = lists.where("rank = 0").select("term", "wid").join(windows, "wid")
    at = index.where("term IS NOT NULL AND ctx IS NOT NULL").select("doc_id", "th", "term", "ctx").join(side(lead), "term")
    at = at.where(F.size(F.array_except("w", "ctx")) == 0)  # most places end here
    length = F.size("w") + slack
    starts = F.sequence(F.lit(1), F.greatest(F.size("ctx") - length + 1, F.lit(1)))

    def holds(start: Column) -> Column:
        run = F.slice("ctx", start, length)
        return F.forall(F.array_distinct("w"), lambda x: F.size(F.filter(run, lambda y: y == x)) >= F.size(F.filter("w", lambda y: y == x)))

    return at.where(F.exists(starts, holds)).select("doc_id", "th", "wid").distinct()


def prepare(docs: DataFrame, items: DataFrame, window: int = WINDOW, slack: int = 0) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, bool]:
    """(index, lists of the windows' rarest terms, item windows, distinct windows, small)"""
    by_item = cut(item_windows(items, window), "item-windows")
    windows = by_item.select("wid", "w").distinct()
    small = by_item.count() <= BROADCAST_ROWS
    side = F.broadcast if small else (lambda df: df)
    vocabulary = windows.select(F.explode("w").alias("term")).distinct()
    lists = cut(anchors(windows, term_counts(docs, side(vocabulary))), "anchors")
    terms = lists.groupBy("term").agg((F.min("rank") == 0).alias("lead"))
    return build_index(docs, terms, terms.count(), window + slack), lists, by_item, windows, small


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, slack: int | None = None) -> DataFrame:
    """One row per document: doc_id, th, n_words, n_hit, n_items, items_sha256, contaminated; with ``slack`` also
    n_near, the number of distinct windows that are near in the document (exact ones included)."""
    index, lists, by_item, windows, small = prepare(docs, items, window, slack or 0)
    found = cut(phrase_matches(index, windows, lists, small), "matches")
    hit = found.select("doc_id", "th", F.explode(F.expr("sequence(start, start + n - 1)")).alias("pos")).distinct()
    hit = hit.groupBy("doc_id", "th").agg(F.count("*").alias("n_hit"))
    ids = by_item.select("wid", F.col("item_id").cast("string").alias("item")).distinct()
    ids = found.select("doc_id", "th", "wid").distinct().join(F.broadcast(ids) if small else ids, "wid").select("doc_id", "th", "item").distinct()
    ids = ids.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = index.where("is_last").select("doc_id", "th", "n_words")

    def along(rows: DataFrame, part: DataFrame) -> DataFrame:
        part = part.withColumnsRenamed({"doc_id": "_d", "th": "_t"})
        return rows.join(part, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")), "left").drop("_d", "_t")

    out = along(along(out, hit), ids)
    if slack is not None:
        near = near_matches(index, windows, lists, small, slack)
        out = along(out, near.groupBy("doc_id", "th").agg(F.count("*").alias("n_near")))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "th", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size(items_of).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_of, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
        *([F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near")] if slack is not None else []),
    )


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without a hit, all columns kept."""
    own, th = unused(docs.columns, "_doc", "_hash")
    bad = contamination(docs, items).where("contaminated").select(F.col("doc_id").alias(own), F.col("th").alias(th)).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(own)) & (F.xxhash64("text") == F.col(th)), "left_anti")


def query(docs: DataFrame, items: DataFrame) -> DataFrame:
    return contamination(docs, items, slack=SLACK).drop("th")


ORACLE_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), win AS (
  SELECT DISTINCT item_id, ws[i:i + 9] AS w, least(len(ws), 10) AS n
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM bw WHERE len(ws) > 0)
), lens AS (SELECT DISTINCT n FROM win),
grams AS (
  SELECT doc_id, i, n, ws[i:i + n - 1] AS w
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM dw, lens WHERE len(ws) >= n)
), met AS (
  SELECT g.doc_id, g.i, g.n, win.item_id FROM grams g JOIN win ON g.n = win.n AND g.w = win.w
), hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM met) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM met) GROUP BY doc_id
), freqs AS (
  SELECT x, count(*) AS freq FROM (SELECT unnest(ws) AS x FROM dw) GROUP BY x
), rare AS (
  SELECT w, n, arg_min(x, (freq, x)) AS lead FROM (SELECT w, n, unnest(w) AS x FROM (SELECT DISTINCT w, n FROM win)) JOIN freqs USING (x) GROUP BY w, n
), places AS (
  SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS x FROM dw
), around AS (
  SELECT doc_id, w, n, ws[greatest(p - n - 4, 1):p + n + 4] AS ctx FROM places JOIN rare ON x = lead
), runs AS (
  SELECT doc_id, w, unnest(list_transform(range(1, greatest(len(ctx) - n - 4, 1) + 1), lambda s: ctx[s:s + n + 4])) AS run FROM around WHERE list_has_all(ctx, w)
), nears AS (
  SELECT doc_id, count(DISTINCT w) AS n_near FROM runs
  WHERE len(list_filter(list_distinct(w), lambda x: len(list_filter(run, lambda y: y = x)) < len(list_filter(w, lambda y: y = x)))) = 0 GROUP BY doc_id
)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(i.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(i.joined, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated,
  coalesce(r.n_near, 0)::BIGINT AS n_near
FROM dw d LEFT JOIN hits h USING (doc_id) LEFT JOIN items i USING (doc_id) LEFT JOIN nears r USING (doc_id)
"""
