"""Order MinHash fingerprints with DataFrame functions only.

A text's tokens are its words, longer ones cut to pieces of `piece` characters; its k-mers are windows of `k` tokens (one shorter
window if there are fewer), numbered by occurrence, so that repeats count. For each of `m` signature parts, `l` hash functions,
each an order of its own on the k-mer occurrences, select one smallest occurrence each; the selected ones are put back in text
order and hashed together. Two texts agree in a part if they share the selected k-mers and also their order: likeness falls
with edit distance. (One order's l smallest would do as well; but a minimum is an aggregate that needs no buffers.)

The text of a row and the head of the next document's meet by one shuffle: rows are dealt to ranges of ids whose bounds are
ids of the table (a quantile sketch), and the row at a bound is copied to the range before, where it stands last.
The k-mers are made, numbered and reduced inside that same partitioning.

Null texts are empty; an empty text has no k-mers and the empty text's own fingerprint, alike only to another such.
Rows are ordered by falling id, null ids last, then by text; repeated rows follow each other. Texts of any length count whole: a place
in a text has 31 bits, as many as any text has characters. Columns of other names never reach the operator. Rows of one id stay in
one range, so ids should be as good as unique. Empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text, parts

POS_BITS = 31
LOWEST = -(2**63)


def tokens(text: Column, piece: int = 16) -> Column:
    between, any_but = "\t\n\x0b\f\r ", r"([^\x20\x09-\x0D]{%d})" % piece
    ts = parts(text, between, lower=False)
    # without a long word, cutting changes nothing
    return F.when(F.exists(ts, lambda w: F.length(w) > piece), parts(F.regexp_replace(text, any_but, "$1 "), between, lower=False)).otherwise(ts)


def signatures(texts: DataFrame, keys: list[str], text: str, k: int = 5, m: int = 32, l: int = 2) -> DataFrame:  # noqa: E741
    """keys and signature, an array of m longs (empty for texts without tokens). texts is partitioned by keys or a part of them."""
    ts = texts.select(*keys, tokens(F.col(text)).alias("ts"))  # below, k-mers sort first: their hashes decide most comparisons
    each = ts.select(*keys, "ts", F.explode(F.sequence(F.lit(0), F.greatest(F.size("ts") - k, F.lit(0)))).alias("pos"))
    each = each.select(*keys, "pos", F.when(F.size("ts") > 0, F.xxhash64(F.slice("ts", F.col("pos") + 1, k))).alias("kmer"))
    numbered = each.withColumn("g", F.xxhash64("kmer", F.row_number().over(Window.partitionBy("kmer", *reversed(keys)).orderBy("pos"))))
    at = F.least(F.col("pos"), F.lit(2**POS_BITS - 1)).cast("long")
    smallest = [F.min(F.when(F.col("kmer").isNotNull(), F.shiftleft(F.shiftrightunsigned(F.xxhash64("g", F.lit(j)), POS_BITS + 1), POS_BITS).bitwiseOR(at))).alias(f"h{j}") for j in range(m * l)]
    found = numbered.groupBy(*keys).agg(*smallest)
    picked = [F.array_sort(F.array(*(F.struct(F.col(f"h{i * l + j}").bitwiseAND(F.lit(2**POS_BITS - 1)).alias("pos"), F.lit(j).alias("j"), F.shiftright(f"h{i * l + j}", POS_BITS).alias("h")) for j in range(l)))) for i in range(m)]
    parts = F.array(*(F.xxhash64(F.transform(p, lambda x: x["h"]), F.transform(p, lambda x: x["j"])) for p in picked))
    return found.select(*keys, F.when(F.col("h0").isNotNull(), parts).otherwise(F.array().cast("array<long>")).alias("signature"))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal parts; 1 for two empty signatures."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), lambda e: e))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(same / F.greatest(F.size(a), F.size(b)))


def shown(signature: Column) -> Column:
    return F.concat_ws("", F.transform(signature, lambda x: F.substring(F.lpad(F.lower(F.hex(x)), 16, "0"), 1, 8)))


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Rows of docs in ranges (part, n in it from 1), with the next row's text in falling order of ids; real: not a copy."""
    spark = docs.sparkSession
    ranges = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = id_and_text(docs).select("doc_id", "text", F.coalesce("doc_id", F.lit(LOWEST)).alias("id"))
    found = rows.agg(F.percentile_approx("id", F.array(*(F.lit((i + 1) / ranges) for i in range(ranges - 1))) if ranges > 1 else F.array(F.lit(1.0)), F.lit(10 * ranges)).alias("q"), F.max("id").alias("top"), F.min("id").alias("low")).first()
    if found["top"] is None:
        return rows.select(F.lit(0).alias("part"), F.lit(1).alias("n"), "doc_id", "text", F.lit("").alias("next_text"), F.lit(True).alias("real"))
    bounds = sorted({*found["q"], found["top"]})  # range i: ids over bounds[i - 1], up to bounds[i]; `ranges` numbers at most
    # the number of bounds below an id, by two short lists in place of one long one
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    coarse = F.size(F.filter(F.array(*(F.lit(g[-1]) for g in groups)), lambda b: b < F.col("id")))
    own = F.array(*(F.array(*map(F.lit, g)) for g in groups))[coarse]
    part = coarse * step + F.size(F.filter(own, lambda b: b < F.col("id")))
    top = F.struct(part.alias("part"), F.lit(0).alias("turn"))
    before = F.when(F.array_contains(own, F.col("id")), F.when(part == len(bounds) - 1, F.struct(F.lit(0).alias("part"), F.lit(2).alias("turn"))).otherwise(F.struct((part + 1).alias("part"), F.lit(1).alias("turn"))))
    dealt = rows.select("doc_id", "text", "id", F.inline(F.filter(F.array(top, before), lambda x: x.isNotNull()))).repartition(ranges, "part")
    order = Window.partitionBy("part").orderBy("turn", F.desc("id"), "text")
    return dealt.select("part", F.row_number().over(order).alias("n"), "doc_id", "text", F.lead("text").over(order).alias("next_text"), (F.col("turn") == 0).alias("real"))


def fingerprints(docs: DataFrame, k: int = 5, m: int = 32, l: int = 2) -> DataFrame:  # noqa: E741
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of docs."""
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"), F.substring(F.coalesce("next_text", "text"), F.lit(1), half))
    rows = with_next(docs).select("part", "n", "doc_id", "real", "text", edited.alias("edited"))
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("t")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("t")))
    # with doc_id, this branch needs the same columns as `facts`, so that one shuffle of the texts serves both
    both = rows.select("part", "n", "doc_id", F.inline(F.filter(sides, lambda s: F.col("real") | (s["side"] == 0))))
    signed = signatures(both.select("part", "doc_id", (F.col("n") * 2 + F.col("side")).alias("row"), "t"), ["part", "row", "doc_id"], "t", k, m, l)
    of = lambda side: F.max(F.when(F.col("row") % 2 == side, F.col("signature")))
    pair = signed.groupBy("part", F.floor(F.col("row") / 2).cast("int").alias("n")).agg(of(0).alias("s"), of(1).alias("e"))
    facts = rows.select("part", "n", "doc_id", "real", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    one = facts.join(pair, ["part", "n"])
    after = one.withColumn("next", F.lead("s").over(Window.partitionBy("part").orderBy("n"))).where("real")
    return after.select("doc_id", "n_chars", "edited_sha256", shown(F.col("s")).alias("fingerprint"), shown(F.col("e")).alias("edited_fingerprint"), likeness(F.col("s"), F.col("e")).alias("near_edited"), likeness(F.col("s"), F.coalesce("next", "s")).alias("near_next"))
