"""Mixing sources to target weights by distributed prefix sums of word counts, in DataFrame functions only.

Method. Every document gets a hash-random key; within its source it is sorted by that key, and the running sum of word
counts is cut where the source's budget ends. A budget of more than the source repeats it: whole epochs take every
document again, and the last, partial epoch takes the documents before the cut, the one at the cut in part.

Targets. The mix holds ``share`` of all words. Sources in code point order (null last) have the given weights in turn;
a target above ``most`` times its source stops there and the excess is shared out anew by weight.

Scale. The key is the MD5 of the document's id (without one, of its text's): its first hex digits split a source into
buckets, so that a source with a third of all rows is spread over ``16 ** digits`` tasks. A bucket's sum is added up before any row moves.
The running sums of the buckets are taken in two levels, coarse buckets of half the digits and buckets within them, so
that no task sees more than about the square root of a source's buckets; they become offsets, and each bucket then has its own
running sum. With ``keep_text=False`` words are counted once and the short rows are written to the shared folder; else texts move with
their rows, and words are counted again where rows move rather than writing texts twice. Sources are ranked in one
window: a row of three numbers for each.

Defined cases: a null or blank text has size 0 and takes 0. A null source is a source of its own. Null ids are ordered by
their texts' MD5, equal ids by size, so a rerun gives the same rows. With no words at all every target is 0. Input columns named like an output
column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazeframe.llm.common import fresh, materialize, without

#: Words: maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bucket_digits(rows: int, per_bucket: int) -> int:
    """Hex digits that keep a bucket of even the largest source at about ``per_bucket`` rows."""
    digits = 1
    while 16**digits * per_bucket < rows and digits < 8:
        digits += 1
    return digits


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target) for each source, from (source, size) rows summed by bucket.

    Sources are the groups of one column; their number is small next to the rows', and their order is global, so their
    sums (a row each) are ranked in one window.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    one = Window.partitionBy(F.lit(0))
    order = one.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    t = sums.withColumn("w", w).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    # Sharing out: with lambda = the level of target / weight, a source takes min(w * lambda, cap). Sources fill up in the
    # order of cap / weight; before the k-th of that order, lambda is what the filled ones leave over the rest's weight.
    t = t.withColumn("fill", F.col("cap") / F.col("w"))
    up = one.orderBy("fill", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    total = F.lit(float(share)) * F.sum("source_size").over(one)
    t = t.withColumn("level", (total - F.coalesce(F.sum("cap").over(up), F.lit(0.0))) / (F.sum("w").over(one) - F.coalesce(F.sum("w").over(up), F.lit(0.0))))
    # The level holds from the first source in that order that does not fill up.
    final = F.min(F.when(F.col("fill") >= F.col("level"), F.struct(F.col("fill"), F.col("level")))).over(one).getField("level")
    target = F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.least(F.col("cap"), F.coalesce(F.col("w") * final, F.col("cap"))))
    return t.select("source", "source_size", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    most: float = 2.0,
    per_bucket: int = 3_000,
    keep_text: bool = True,
) -> DataFrame:
    """``docs`` with its columns (the text, if ``keep_text``) and ``size, source_size, target, taken`` (words that the mix takes, repeats counted)."""
    base = without(docs, "size", "source_size", "target", "taken")
    key, src, bucket, coarse, start, s2, k2 = fresh(base, "_key", "_src", "_bucket", "_coarse", "_start", "_src2", "_bucket2")
    own = F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("n"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))))
    # A name that is never null: nulls are a group of their own.
    group = F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))
    rows = base.withColumns({"size": count_words(F.col(text)), key: F.md5(own.cast("binary")), src: group})
    kept = [c for c in base.columns if keep_text or c != text]
    if not keep_text:
        rows = materialize(rows.drop(text))
    digits = bucket_digits(rows.select(F.lit(1)).count(), per_bucket)
    rows = rows.withColumn(bucket, F.substring(key, 1, digits))

    sums = rows.groupBy(src, bucket).agg(F.sum("size").alias("sum")).withColumn(coarse, F.substring(bucket, 1, digits // 2))
    above = sums.groupBy(src, coarse).agg(F.sum("sum").alias("all"))
    before = lambda order, *of: Window.partitionBy(*of).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    above = above.withColumn("from", F.coalesce(F.sum("all").over(before(coarse, src)), F.lit(0)))
    starts = sums.withColumn("within", F.coalesce(F.sum("sum").over(before(bucket, src, coarse)), F.lit(0))).join(above, [src, coarse])
    targets = source_targets(above.select(F.when(F.col(src) != "n", F.expr(f"substring({src}, 2)")).alias("source"), F.col("all").alias("size")), weights, share, most)
    named = targets.withColumn(s2, F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    starts = starts.join(named, F.col(src) == F.col(s2)).select(F.col(src).alias(s2), F.col(bucket).alias(k2), (F.col("from") + F.col("within")).alias(start), "source_size", "target")

    got = rows.join(starts.hint("shuffle_merge"), (F.col(src) == F.col(s2)) & (F.col(bucket) == F.col(k2)))
    at = F.col(start) + F.coalesce(F.sum("size").over(Window.partitionBy(src, bucket).orderBy(key, "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    budget = F.floor(F.col("target")).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    left = budget - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left - at))
    out = got.withColumn("taken", taken.cast("long"))
    return out.select(*(f"`{c}`" for c in kept), "size", "source_size", "target", "taken")
