"""Schemas of the file formats without headers and of parsed records."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _D = T.StringType(), T.IntegerType(), T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


HITS = _struct(query=_S, target=_S, fident=_D, alnlen=_I, mismatch=_I, gapopen=_I, qstart=_I, qend=_I, tstart=_I, tend=_I, evalue=_D, bits=_D, qlen=_I, tlen=_I, qcov=_D, tcov=_D)
INTERVAL = _struct(start=_I, end=_I)
FEATURE = _struct(
    contig=_S, ord=_I, type=_S, start=_I, end=_I, strand=_I, intervals=T.ArrayType(INTERVAL),
    qualifiers=T.MapType(_S, _S), contig_sequence=_S,
)
EMBEDDING = _struct(protein_id=_S, source_db=_S, embedding=T.ArrayType(T.FloatType()))
GENE = _struct(contig=_S, start=_I, end=_I, strand=_I, protein_sequence=_S, caller=_S)
