"""Types and names of the data model.

A hypergraph is three relations: vertices ``(id, attr)``, hyperedges
``(hid, src, dst, attr)`` with sorted distinct id arrays, and incidences
``(hid, vid, is_src)``, which follow from the hyperedges without a shuffle.
"""

from __future__ import annotations

from enum import Enum

from pyspark.sql import types as T


class Direction(Enum):
    """Which side of a hyperedge must be active, or which neighbours count."""

    IN = "in"
    OUT = "out"
    EITHER = "either"
    BOTH = "both"

    def reverse(self) -> Direction:
        return {Direction.IN: Direction.OUT, Direction.OUT: Direction.IN}.get(self, self)


def vertex_schema(attr: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("id", T.LongType(), False), T.StructField("attr", attr)])


def hyperedge_schema(attr: T.DataType) -> T.StructType:
    ids = T.ArrayType(T.LongType(), False)
    return T.StructType([T.StructField("hid", T.LongType(), False), T.StructField("src", ids), T.StructField("dst", ids), T.StructField("attr", attr)])


INCIDENCE = T.StructType([T.StructField("hid", T.LongType(), False), T.StructField("vid", T.LongType(), False), T.StructField("is_src", T.BooleanType(), False)])
