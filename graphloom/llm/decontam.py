"""Benchmark decontamination with DataFrame functions only.

Benchmark items become a hash set of normalised windows of words. The places of a document's windows are exploded; the hash
of each window, its look-up and the check of a hit word by word follow in the same generated code, where the array of words is
only a reference. The set is broadcast only if its size, measured first, is within `broadcast_bytes`; beyond that, the same join shuffles. Only hits and one row for each document leave the scan.

An item of fewer words than a window, but not none, is one window of its own length. Null texts and texts without words have
no windows, no hits. Repeated rows: a row each. Texts of any length are looked through whole. Windows of several items count for each of
them, ties there are none. Columns of other names never reach the operator. Empty documents or benchmark: no rows, or no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, parts, row_key

#: ASCII that is neither digit nor (lower-case) letter parts words.
BETWEEN = "".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))

#: What stands between such characters, capitals too.
WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return parts(text, BETWEEN, lower=True)


def window_at(ws: Column, i: Column, size: Column) -> Column:
    return F.slice(ws, i + 1, size)


def benchmark_windows(benchmark: DataFrame, size: int = 10) -> DataFrame:
    """window, hash, length, items: the distinct windows and the ids, as text, of the items that have them."""
    ws = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.coalesce("text", F.lit(""))).alias("ws")).where(F.size("ws") > 0)
    length = F.least(F.size("ws"), F.lit(size))
    each = ws.select("item", length.alias("length"), F.explode(F.transform(F.sequence(F.lit(0), F.size("ws") - length), lambda i: window_at(F.col("ws"), i, length))).alias("window"))
    return each.groupBy("window", F.xxhash64("window").alias("hash"), "length").agg(F.collect_set("item").alias("items"))


def hits(docs: DataFrame, benchmark: DataFrame, size: int = 10, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """k_id, k_text, doc_id, n_words and, for each window found, pos (from 0), length, items; pos null: the document itself."""
    wanted = cut(benchmark_windows(benchmark, size))
    lengths = sorted(r[0] for r in wanted.select("length").distinct().collect())  # at most `size` numbers
    # a string in a row costs some 24 bytes besides its own
    bytes_of = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x) + 24)
    few = (wanted.agg(F.sum(bytes_of("window") + bytes_of("items") + 64)).first()[0] or 0) <= broadcast_bytes
    ws = row_key(docs).select("k_id", "k_text", "doc_id", words(F.col("text")).alias("ws"))
    # a place is pos * (size + 1) + length; -1 is the document itself
    places = [F.when(F.size("ws") >= n, F.sequence(F.lit(n), F.greatest((F.size("ws") - n) * (size + 1) + n, F.lit(n)), F.lit(size + 1))).otherwise(F.array().cast("array<int>")) for n in lengths]
    each = ws.select("k_id", "k_text", "doc_id", "ws", F.explode(F.concat(F.array(F.lit(-1)), *places)).alias("place"))
    pos, length = F.floor(F.col("place") / (size + 1)).cast("int"), F.pmod("place", F.lit(size + 1))
    each = each.withColumn("hash", F.when(F.col("place") >= 0, F.xxhash64(window_at(F.col("ws"), pos, length))))
    set_ = wanted.select("hash", "window", "items")
    itself = F.col("place") < 0
    if few:
        found = each.join(F.broadcast(set_), "hash", "left").where("place < 0 or window is not null")
        found = found.where(itself | (window_at(F.col("ws"), pos, length) == F.col("window"))).withColumn("n", F.size("ws"))
    else:  # rows that are shuffled don't carry the words: a document's hits meet them afterwards, once
        keys = ["k_id", "k_text", "doc_id"]
        met = each.where(~itself).select(*keys, "place", "hash").join(set_, "hash").distinct()
        hit = met.groupBy("k_id", "k_text").agg(F.collect_list(F.struct(pos.alias("pos"), length.alias("length"), "place", "window", "items")).alias("hits"))
        texts = ws.join(hit, ["k_id", "k_text"])
        true = texts.select(*keys, F.inline(F.filter("hits", lambda h: F.slice("ws", h["pos"] + 1, h["length"]) == h["window"])))
        none = F.lit(None)
        alone = ws.select(*keys, F.lit(-1).alias("place"), F.size("ws").alias("n"), none.cast("array<string>").alias("items"))
        found = alone.unionByName(true.select(*keys, "place", none.cast("int").alias("n"), "items"))
    return found.select("k_id", "k_text", "doc_id", F.when(~itself, pos).alias("pos"), F.when(itself, F.col("n")).otherwise(length).alias("length"), F.when(~itself, F.col("items")).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of docs; also its key k_id, k_text."""
    one = F.col("pos").isNull()
    found = hits(docs, benchmark, size, broadcast_bytes)
    spans = F.array_sort(F.collect_set(F.when(~one, F.struct(F.col("pos").alias("a"), (F.col("pos") + F.col("length")).alias("b")))))
    by_doc = found.groupBy("k_id", "k_text", "doc_id").agg(
        F.max(F.when(one, F.col("length"))).cast("long").alias("n_words"),
        F.count(F.when(one, 1)).alias("rows"),
        spans.alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("ids"),
    )
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate("spans", start, lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], s["end"]))).alias("n"), F.greatest(s["end"], x["b"]).alias("end")))["n"]
    repeated = F.explode(F.array_repeat(F.lit(1), F.col("rows").cast("int")))
    out = by_doc.select("k_id", "k_text", "doc_id", "n_words", covered.alias("n_hit"), F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("items_sha256"), repeated)
    return out.withColumn("contaminated", F.col("n_hit") > 0).drop("col")


def clean_documents(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """docs, all columns, without the rows whose text has a benchmark window."""
    bad = contamination(docs, benchmark, size).where("contaminated").select("k_id", "k_text").distinct()
    key = (F.coalesce(docs["doc_id"].cast("long"), F.lit(-(2**63))) == bad["k_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == bad["k_text"])
    return docs.join(bad, key, "left_anti")


def without_spans(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """doc_id and text: each row's text without the words that a window covers; what follows such a word up to the next goes too."""
    found = hits(docs, benchmark, size).where("pos is not null").select("k_id", "k_text", "pos", (F.col("pos") + F.col("length")).alias("end")).distinct()
    by_place = Window.partitionBy("k_id", "k_text").orderBy("pos", "end")
    before = F.max("end").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    island = found.withColumn("new", F.coalesce(F.col("pos") > before, F.lit(True)).cast("int")).withColumn("part", F.sum("new").over(by_place))
    spans = island.groupBy("k_id", "k_text", "part").agg(F.min("pos").alias("a"), F.max("end").alias("b"))
    gone = spans.groupBy("k_id", "k_text").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("gone"))
    rows = row_key(docs).join(gone, ["k_id", "k_text"], "left")
    marks = F.split("text", WORDS)  # one more than words
    pieces = F.zip_with(parts(F.col("text"), BETWEEN, lower=False), F.slice(marks, F.lit(2), F.size(marks)), lambda w, m: F.concat(w, F.coalesce(m, F.lit(""))))
    rows = rows.select("doc_id", "text", "gone", marks[0].alias("head"), pieces.alias("pieces"))
    ends, starts = F.concat(F.array(F.lit(0)), F.transform("gone", lambda x: x["b"])), F.concat(F.transform("gone", lambda x: x["a"]), F.array(F.size("pieces")))
    kept = F.flatten(F.zip_with(ends, starts, lambda a, b: F.slice("pieces", a + 1, b - a)))
    return rows.select("doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.concat("head", F.array_join(kept, ""))).alias("text"))
