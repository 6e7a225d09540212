"""Scanpaths: transitions between areas, their entropy, letter sequences and similarity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gazeframe.frame import RECORDING, GazeFrame
from gazeframe.functions.aoi import AOI
from gazeframe.functions.numeric import rj
from gazeframe.operators.metrics import labelled_fixations


def transitions(gf: GazeFrame, aois: Sequence[AOI], selection=None, window: tuple | None = None, normalize: bool = True, keys: Sequence[str] = RECORDING) -> DataFrame:
    """(from_aoi, to_aoi, value) of all pairs of areas, from consecutive fixations over trials in row order.

    Fixations outside all areas break a pair. Normalised, each area's row adds up to 1, or is 0 where nothing leaves it.
    """
    fix, keys = labelled_fixations(gf.select(selection), aois, list(keys), window)
    w = Window.partitionBy(*keys).orderBy("sample_idx")
    pairs = fix.withColumn("_to", F.lead("area").over(w)).where((F.col("area") > 0) & (F.col("_to") > 0)).groupBy("area", "_to").agg(F.count(F.lit(1)).alias("n"))
    spark = gf.df.sparkSession
    names = [a.name for a in aois]
    grid = spark.createDataFrame([(i + 1, j + 1, a, b) for i, a in enumerate(names) for j, b in enumerate(names)], "area int, _to int, from_aoi string, to_aoi string")
    full = grid.join(F.broadcast(pairs), ["area", "_to"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("double"))  # areas squared rows at most
    total = F.sum("n").over(Window.partitionBy("area"))
    value = F.when(total > 0, F.col("n") / total).otherwise(0.0) if normalize else F.col("n")
    return full.select("from_aoi", "to_aoi", value.alias("value"))


def transition_entropy(matrix: DataFrame) -> DataFrame:
    """Joint entropy in bits of a matrix's values over their sum; 0 for an empty one. One row: entropy."""
    total = F.sum("value").over(Window.partitionBy(F.lit(0)))  # areas squared rows
    p = matrix.withColumn("_p", F.try_divide(F.col("value"), total)).where(F.col("_p") > 0)
    return p.agg(F.coalesce(-F.sum(F.col("_p") * F.log2("_p")), F.lit(0.0)).alias("entropy"))


def aoi_sequence(gf: GazeFrame, aois: Sequence[AOI], selection=None, window: tuple | None = None, keys: Sequence[str] = RECORDING) -> DataFrame:
    """The letters A, B, ... of the areas that fixations fall into, in order; others are skipped."""
    if len(aois) > 26:
        raise ValueError("letters name at most 26 areas")
    fix, keys = labelled_fixations(gf.select(selection), aois, list(keys), window)
    letter = F.chr(F.col("area") + 64)
    in_order = F.array_sort(F.collect_list(F.when(F.col("area") > 0, F.struct("sample_idx", letter.alias("letter")))))
    return fix.groupBy(*keys).agg(F.array_join(in_order.getField("letter"), "").alias("sequence"))


def scanpath_similarity(gf: GazeFrame, aois: Sequence[AOI], selection1, selection2, window: tuple | None = None) -> DataFrame:
    """Edit distance of two selections' sequences, and 1 - distance over the longer length. One row."""
    one = lambda s, n: aoi_sequence(gf, aois, s, window).agg(F.coalesce(F.array_join(F.array_sort(F.collect_list(F.struct("recording_id", "sequence"))).getField("sequence"), ""), F.lit("")).alias(n))
    both = one(selection1, "sequence1").crossJoin(one(selection2, "sequence2"))  # one row each
    d, n = F.levenshtein("sequence1", "sequence2"), F.greatest(F.length("sequence1"), F.length("sequence2"))
    return both.select(d.alias("distance"), F.when(n == 0, F.lit(1.0)).otherwise(rj(1 - d / n, 4)).alias("similarity"), "sequence1", "sequence2")
