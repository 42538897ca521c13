"""Molecular kernels as Arrow-batched functions, for DataFrames and for SQL."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fingerprint as fp
from . import properties as props
from . import scaffold as frames

FINGERPRINT = T.ArrayType(T.LongType(), False)
PROPERTIES = T.StructType([T.StructField("mw", T.FloatType()), T.StructField("logp", T.FloatType()), *(T.StructField(c, T.IntegerType()) for c in ("rot_bonds", "heavy_atoms", "ring_count"))])
SCAFFOLD = T.StructType([T.StructField("scaffold_smiles", T.StringType()), *(T.StructField(c, T.IntegerType()) for c in ("ring_systems", "ring_count", "scaffold_atoms", "linker_atoms", "heavy_atoms")), T.StructField("framework_fraction", T.FloatType()), T.StructField("scaffold_key", T.LongType())])
R_GROUP = T.StructType([T.StructField("attach_color", T.IntegerType()), T.StructField("attach_symbol", T.StringType()), T.StructField("smiles", T.StringType())])
DECOMPOSITION = T.StructType([T.StructField("scaffold_key", T.LongType()), T.StructField("scaffold_smiles", T.StringType()), T.StructField("r_groups", T.ArrayType(R_GROUP))])


#: Results of each kernel that a worker remembers, and characters of a text that is worth it, at most.
REMEMBERED, LONGEST = 4096, 200


@lru_cache(maxsize=None)
def _remembering(kernel):
    return lru_cache(maxsize=REMEMBERED)(kernel)


def _distinct(texts: pd.Series, kernel, empty):
    """The kernel of each text, once for each distinct text of a batch, and not again for those that the worker remembers; null texts have ``empty``."""
    known = _remembering(kernel)
    done = {t: known(t) if len(t) <= LONGEST else kernel(t) for t in texts.dropna().unique()}
    return [done[t] if t in done else empty for t in texts]


def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(_distinct(texts, fp.fingerprint, [0] * fp.WORDS))


def _properties(texts: pd.Series) -> pd.DataFrame:
    out = pd.DataFrame(_distinct(texts, props.properties, props.Properties(0.0, 0.0, 0, 0, 0)), columns=PROPERTIES.names)
    return out.astype({"mw": "float32", "logp": "float32", "rot_bonds": "int32", "heavy_atoms": "int32", "ring_count": "int32"})


def _scaffolds(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(_distinct(texts, frames.analyze, frames.Scaffold()), columns=SCAFFOLD.names).astype({"framework_fraction": "float32"})


def _decomposition(text: str):
    d = frames.decompose(text)
    return d.scaffold_key, d.scaffold_smiles, [g._asdict() for g in d.r_groups]


def _decompositions(texts: pd.Series) -> pd.DataFrame:
    rows = _distinct(texts, _decomposition, (0, "", []))
    return pd.DataFrame(rows, columns=DECOMPOSITION.names)


#: By SQL name: the kernel on a batch, and its type.
KERNELS = {"morgan_fp": (_fingerprints, FINGERPRINT), "mol_props": (_properties, PROPERTIES), "murcko_scaffold": (_scaffolds, SCAFFOLD), "r_groups": (_decompositions, DECOMPOSITION)}


def _udf(name: str):
    kernel, kind = KERNELS[name]
    return F.pandas_udf(kernel, kind)


def morgan_fp(smiles) -> Column:
    """The fingerprint of a SMILES column; null has none of the bits."""
    return _udf("morgan_fp")(smiles)


def mol_props(smiles) -> Column:
    """struct(mw, logp, rot_bonds, heavy_atoms, ring_count)."""
    return _udf("mol_props")(smiles)


def murcko_scaffold(smiles) -> Column:
    """struct of ``scaffold.Scaffold``."""
    return _udf("murcko_scaffold")(smiles)


def r_groups(smiles) -> Column:
    """struct(scaffold_key, scaffold_smiles, r_groups)."""
    return _udf("r_groups")(smiles)


def register(spark: SparkSession) -> None:
    """SQL functions morgan_fp, mol_props, murcko_scaffold, r_groups and tanimoto."""
    for name in KERNELS:
        spark.udf.register(name, _udf(name))
    shared = "aggregate(zip_with(a, b, (x, y) -> bit_count(x & y)), 0, (s, n) -> s + n)"
    joint = "aggregate(zip_with(a, b, (x, y) -> bit_count(x | y)), 0, (s, n) -> s + n)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION tanimoto(a ARRAY<BIGINT>, b ARRAY<BIGINT>) RETURNS FLOAT RETURN CAST(coalesce(try_divide(CAST({shared} AS DOUBLE), CAST({joint} AS DOUBLE)), 0.0D) AS FLOAT)")
