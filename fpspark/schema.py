"""Tables of the engine."""

from __future__ import annotations

from pyspark.sql import types as T

VERSION = 1
LONG, INT, FLOAT, STRING = T.LongType(), T.IntegerType(), T.FloatType(), T.StringType()
PROPERTY_FIELDS = ("mw", "logp", "rot_bonds", "heavy_atoms", "ring_count")


def _fields(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, False) for name, kind in kinds.items()])


COMPOUNDS = _fields(doc_id=LONG, compound_id=STRING, smiles=STRING, mw=FLOAT, logp=FLOAT, rot_bonds=INT, heavy_atoms=INT, ring_count=INT, fingerprint=T.ArrayType(LONG), fp_pop=INT)
POSTINGS = _fields(bit=INT, doc_id=LONG, pop=INT)
