"""Benchmark decontamination by a positional inverted index (DataFrame functions only).

The index is a stored table of postings ``(rid, doc_id, n, pos, tid)``: one row
for every occurrence, in any document, of a term that the test items use; terms
that no item uses are never looked up and get no postings. ``rid`` names an
input row, so repeated ids stay apart.

Phrases are found from their rarest terms. For each window of an item the two
terms with the shortest posting lists are looked up; their positions, less the
terms' offsets in the item, must agree, which gives alignments of items with
documents. The full lists of all terms of an item are then intersected at those
alignments alone, and runs of agreeing offsets are the exact matches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import ascii_lower, broadcast_if_small, store

SEPARATORS = "".join(map(chr, [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
SEPARATOR_RE = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Rows of a narrow table (ids, term numbers) that may be broadcast: 16 MB or so.
MAX_BROADCAST = 500_000


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; null if there are none."""
    trimmed = F.btrim(ascii_lower(text), F.lit(SEPARATORS))
    return F.when(trimmed != "", F.split(trimmed, SEPARATOR_RE))


@dataclass(frozen=True)
class Index:
    """``postings``: rid, doc_id, n, pos, tid, with a row (tid null if need be) for the
    last word of each document, or for a document without words. ``terms``: term, tid."""

    postings: DataFrame
    terms: DataFrame

    def heads(self) -> DataFrame:
        """rid, doc_id, n: one row for each input row."""
        return self.postings.where("pos is null or pos = n - 1").select("rid", "doc_id", "n")

    def lists(self) -> DataFrame:
        return self.postings.where("tid is not null").select("rid", "pos", "tid")


def item_terms(items: DataFrame) -> DataFrame:
    """Stored (iid, item_id, n, off, term) of every word of every item; items without words have none."""
    split = items.select(F.monotonically_increasing_id().alias("iid"), F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), words(F.col("text")).alias("w")).where("w is not null")
    return store(split.select("iid", "item_id", F.size("w").alias("n"), F.posexplode("w").alias("off", "term")), "decon-items")


def build_index(docs: DataFrame, used: DataFrame) -> Index:
    """Index the occurrences in ``docs`` of the terms in ``used`` (column ``term``)."""
    terms = store(used.select("term").distinct().select("term", F.monotonically_increasing_id().alias("tid")), "decon-terms")
    split = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", words(F.col("text")).alias("w"))
    tokens = split.select("rid", "doc_id", F.coalesce(F.size("w"), F.lit(0)).alias("n"), F.posexplode_outer("w").alias("pos", "term"))
    found = tokens.join(broadcast_if_small(terms, MAX_BROADCAST), "term", "left").where("tid is not null or pos is null or pos = n - 1")
    return Index(store(found.select("rid", "doc_id", F.when(F.col("pos").isNull(), 0).otherwise(F.col("n")).alias("n"), "pos", "tid"), "decon-postings"), terms)


def alignments(index: Index, items: DataFrame, window: int) -> DataFrame:
    """Stored (rid, iid, delta): the item's word ``off`` may stand at ``delta + off``.

    Every occurrence of a window of the item is among them.
    """
    counts = store(index.lists().groupBy("tid").count(), "decon-counts")
    length = F.least(F.lit(window), F.col("n"))
    in_windows = items.join(broadcast_if_small(counts, MAX_BROADCAST), "tid", "left").select(
        "iid", "off", "tid", F.coalesce("count", F.lit(0)).alias("freq"),
        F.explode(F.sequence(F.greatest(F.lit(0), F.col("off") - length + 1), F.least(F.col("off"), F.col("n") - length))).alias("ws"),
    )
    # a term that no document has rules its windows out
    by_rarity = Window.partitionBy("iid", "ws").orderBy("freq", "off")
    rare = in_windows.withColumn("rank", F.row_number().over(by_rarity)).where("rank <= 2").groupBy("iid", "ws").agg(
        F.min("freq").alias("freq"), F.min_by(F.struct("off", "tid"), "rank").alias("a"), F.max_by(F.struct("off", "tid"), "rank").alias("b")
    ).where("freq > 0").select("iid", "a", "b").distinct()
    pair = lambda side, bit: F.struct(F.col(f"{side}.tid").alias("tid"), F.col(f"{side}.off").alias("at"), F.lit(bit).alias("bit"))
    lookups = rare.select("iid", F.col("a.off").alias("a_off"), F.col("b.off").alias("b_off"), F.explode(F.array(pair("a", 1), pair("b", 2))).alias("p")).select("iid", "a_off", "b_off", "p.*")
    lookups = store(lookups, "decon-lookups")
    agreed = (
        index.lists().join(broadcast_if_small(lookups, MAX_BROADCAST), "tid").select("rid", "iid", (F.col("pos") - F.col("at")).alias("delta"), "a_off", "b_off", "bit")
        .groupBy("rid", "iid", "delta", "a_off", "b_off").agg(F.bit_or("bit").alias("bits")).where("bits = 3")
    )
    return store(agreed.select("rid", "iid", "delta").distinct(), "decon-alignments")


def phrase_spans(index: Index, items: DataFrame, window: int = 13) -> DataFrame:
    """(rid, iid, item_id, start, end): maximal runs of words, ``start`` to ``end`` inclusive,
    in which every word is within an occurrence of a window of ``window`` words of the item
    (of the whole item, if it is shorter)."""
    items = items.join(index.terms, "term").drop("term")
    at = alignments(index, items.select("iid", "n", "off", "tid"), window)
    rids = broadcast_if_small(at.select("rid").distinct(), MAX_BROADCAST)
    expected = at.join(broadcast_if_small(items, MAX_BROADCAST), "iid").withColumn("pos", F.col("delta") + F.col("off")).where("pos >= 0")
    matched = expected.join(index.lists().join(rids, "rid", "left_semi"), ["rid", "pos", "tid"])
    run = Window.partitionBy("rid", "iid", "delta").orderBy("off")
    runs = matched.withColumn("run", F.col("off") - F.row_number().over(run)).groupBy("rid", "iid", "delta", "run", "item_id", "n").agg(F.min("pos").alias("start"), F.max("pos").alias("end"))
    return runs.where(F.col("end") - F.col("start") + 1 >= F.least(F.lit(window), F.col("n"))).select("rid", "iid", "item_id", "start", "end")


def proximity_matches(index: Index, items: DataFrame, slop: int) -> DataFrame:
    """(rid, iid, item_id, pos): the item's rarest term stands at ``pos``, and each of its other
    terms at least once within ``slop`` words of it, in any order."""
    items = items.join(index.terms, "term").groupBy("iid", "item_id", "tid").agg(F.lit(1)).select("iid", "item_id", "tid")
    counts = index.lists().groupBy("tid").count()
    needed = F.count(F.lit(1)).over(Window.partitionBy("iid"))
    ranked = store(
        items.join(counts, "tid", "left").withColumns({"needed": needed, "rank": F.row_number().over(Window.partitionBy("iid").orderBy(F.coalesce("count", F.lit(0)), "tid"))}).drop("count"),
        "decon-proximity",
    )
    small = broadcast_if_small(ranked, MAX_BROADCAST)
    found = index.lists().join(small, "tid")
    block = F.floor(F.col("pos") / F.lit(slop + 1))
    anchors = found.where("rank = 1").select("rid", "iid", "item_id", "needed", F.col("pos").alias("at"), F.explode(F.array(block - 1, block, block + 1)).alias("block"))
    others = found.where("rank > 1").select("rid", "iid", "tid", "pos", block.alias("block"))
    near = anchors.join(others, ["rid", "iid", "block"], "left").where(F.col("pos").isNull() | (F.abs(F.col("pos") - F.col("at")) <= slop))
    return near.groupBy("rid", "iid", "item_id", "at", "needed").agg(F.count_distinct("tid").alias("others")).where("others = needed - 1").select("rid", "iid", "item_id", F.col("at").alias("pos"))


def report(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: float = 0.05) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_hit, n_items, item_ids, contaminated.

    Null and empty texts have no words and are clean. Items without words match
    nothing; an item with a null id is reported as ``null``; items with one id
    count once. With an empty benchmark all documents are clean. Other columns
    of the inputs are not looked at.
    """
    items = item_terms(benchmark.select("item_id", "text"))
    index = build_index(docs.select("doc_id", "text"), items)
    spans = store(phrase_spans(index, items, window), "decon-spans")
    in_order = Window.partitionBy("rid").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start") - 1, F.coalesce(F.max("end").over(in_order), F.lit(-1))))
    hits = spans.select("rid", "start", "end").distinct().withColumn("new", new).groupBy("rid").agg(F.sum("new").alias("n_hit"))
    ids = spans.groupBy("rid").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    n_words = F.col("n").cast("long")
    return index.heads().join(hits.join(ids, "rid"), "rid", "left").select(
        "doc_id", n_words.alias("n_words"), n_hit.alias("n_hit"),
        F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        ((n_hit > 0) & (n_hit * 20 >= n_words) if share == 0.05 else (n_hit > 0) & (n_hit >= n_words * share)).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, owner: str = "") -> DataFrame:
    """The rows of ``docs`` whose id has no contaminated row, with their columns unchanged.

    Contaminated is a row with 5 % or more of its words hit; passages in fewer
    words than that stay, in rows that stay whole.
    """
    found = report(docs, benchmark).where("contaminated").select(F.col("doc_id").alias("__lgd_id")).distinct()
    bad = broadcast_if_small(store(found, "decon-bad", owner), MAX_BROADCAST)
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["__lgd_id"]), "left_anti")
