"""What follows a ranking: bit analysis, frameworks, diverse picking, groups and tables of substituents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import explain
from ..functions.udfs import murcko_scaffold, r_groups
from ..runtime import materialize, prepare


def analyze(hits: DataFrame, p) -> DataFrame:
    """``hits`` (with score, c, k) with shared, query-only, candidate-only and total bits, tier and explanation. p: the query's popcount."""
    p = F.lit(p) if isinstance(p, int) else p
    out = hits.select("*", *explain.analysis("c", p, "k"))
    return out.withColumns({"tier": explain.similarity_tier("score"), "explanation": explain.explanation("score", "shared_bits", "query_unique_bits", "candidate_unique_bits")})


def with_scaffolds(rows: DataFrame) -> DataFrame:
    """``rows`` (with smiles) with the framework's columns; heavy_atoms of the rows, if there, stays."""
    prepare(rows.sparkSession)
    out = rows.withColumn("_s", murcko_scaffold(F.col("smiles")))
    names = [c for c in ("scaffold_smiles", "ring_systems", "scaffold_atoms", "linker_atoms", "framework_fraction", "scaffold_key") if c not in rows.columns]
    return out.select("*", *[F.col(f"_s.{c}").alias(c) for c in names], F.col("_s.ring_count").alias("scaffold_rings")).drop("_s")


def scaffold_groups(rows: DataFrame) -> DataFrame:
    """scaffold_key, scaffold_smiles (of the best-ranked member), count; key 0 is a group too. Order: count downwards, then text."""
    return rows.groupBy("scaffold_key").agg(F.min_by("scaffold_smiles", "rank").alias("scaffold_smiles"), F.count("*").alias("count")).orderBy(F.desc("count"), "scaffold_smiles")


def diverse(rows: DataFrame) -> DataFrame:
    """The best-ranked row of each framework; rows without one (key 0) all stay. Ranks are kept."""
    # Rows without a framework need no order: each is a group of its own, so they do not gather in one task.
    own = F.when(F.col("scaffold_key") == 0, F.col("rank")).otherwise(0)
    first = F.row_number().over(Window.partitionBy("scaffold_key", own).orderBy("rank"))
    return rows.withColumn("_first", first).filter("_first = 1").drop("_first")


def with_r_groups(rows: DataFrame) -> DataFrame:
    """``rows`` (with smiles) with r_groups (array of attach_color, attach_symbol, smiles), and the framework's key and text if they lack them."""
    prepare(rows.sparkSession)
    out = rows.withColumn("_d", r_groups(F.col("smiles")))
    names = [c for c in ("scaffold_key", "scaffold_smiles") if c not in rows.columns]
    return out.select("*", *[F.col(f"_d.{c}").alias(c) for c in names], F.col("_d.r_groups").alias("r_groups")).drop("_d")


def sar_cells(rows: DataFrame) -> DataFrame:
    """The tables of substituents in long form: scaffold_key, scaffold_smiles, members, label (R1..), attach_symbol, rank, cell (array of texts, null if empty).

    A table for each framework with two members or more; columns are the
    distinct attachment colours of its members, in order; ``rank`` names the row.
    """
    # Written, rows are decomposed once; so are tables, whose size is then known, so that few of them are sent to the rows.
    keyed = materialize(rows.filter("scaffold_key <> 0").select("scaffold_key", "scaffold_smiles", "rank", "r_groups"), "keyed")
    size = keyed.groupBy("scaffold_key").agg(F.count("*").alias("members"), F.min_by("scaffold_smiles", "rank").alias("scaffold_smiles")).filter("members > 1")
    groups = keyed.select("scaffold_key", "rank", F.explode("r_groups").alias("g"))
    labels = groups.groupBy("scaffold_key", F.col("g.attach_color").alias("color")).agg(F.min_by("g.attach_symbol", "rank").alias("attach_symbol"))
    labels = labels.groupBy("scaffold_key").agg(F.array_sort(F.collect_list(F.struct("color", "attach_symbol"))).alias("labels"))
    tables = materialize(size.join(labels, "scaffold_key"), "tables")
    grid = keyed.drop("scaffold_smiles").join(tables, "scaffold_key").select("*", F.posexplode("labels").alias("place", "of"))
    own = F.filter("r_groups", lambda g: g["attach_color"] == F.col("of.color"))
    cell = F.when(F.size(own) > 0, F.sort_array(F.transform(own, lambda g: g["smiles"])))
    label = F.concat(F.lit("R"), (F.col("place") + 1).cast("string"))
    return grid.select("scaffold_key", "scaffold_smiles", "members", label.alias("label"), F.col("of.attach_symbol").alias("attach_symbol"), "rank", cell.alias("cell"))


def sar_tables(rows: DataFrame) -> DataFrame:
    """A row per table: scaffold_key, scaffold_smiles, members, columns, rows (rank and its cells). Order: members downwards, then text."""
    cells = sar_cells(rows)
    by_row = cells.groupBy("scaffold_key", "scaffold_smiles", "members", "rank").agg(F.sort_array(F.collect_list(F.struct("label", "attach_symbol", F.coalesce("cell", F.array().cast("array<string>")).alias("cell")))).alias("cells"))
    return by_row.groupBy("scaffold_key", "scaffold_smiles", "members").agg(F.sort_array(F.collect_list(F.struct("rank", "cells"))).alias("rows")).orderBy(F.desc("members"), "scaffold_smiles")
