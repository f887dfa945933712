"""Read leaves of a semi-structured ``data`` column as text.

Leaves may hold any JSON kind (number, text, bool, array, object, null) or be
absent, so each one is read as STRING first and converted afterwards with
:func:`ledgerlens.functions.columns.safe_double`.

Two storage forms are supported:

* ``STRING`` holding JSON text: one ``from_json`` per row with a nested schema
  whose leaves are all ``StringType``. Spark's JSON reader keeps a non-string
  leaf as its JSON text (``12.5``, ``[1]``, ``{"a":1}``, ``true``); malformed text
  gives NULL leaves. A filter on a leaf is pushed below the projection that made it and
  would parse the text a second time; so :func:`with_leaves` puts the parsed struct into an
  array of one and explodes it: no leaf's expression crosses the generator, every filter and
  projection above reads its column, and filters on other columns still go below it to the scan.
* ``VARIANT``: ``try_variant_get(v, '$.a.b', 'string')`` per leaf; Spark pushes
  variant extraction into the Parquet scan.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def leaf_schema(paths: Mapping[str, str]) -> T.StructType:
    """Nested struct type holding every dotted path in ``paths`` as a STRING leaf."""
    tree: dict = {}
    for path in paths.values():
        node = tree
        parts = path.split(".")
        for p in parts[:-1]:
            child = node.setdefault(p, {})
            if not isinstance(child, dict):
                raise ValueError(f"path {path!r} goes through leaf {p!r}")
            node = child
        if isinstance(node.get(parts[-1]), dict):
            raise ValueError(f"path {path!r} is also an object in another path")
        node[parts[-1]] = None

    def build(node: dict) -> T.StructType:
        return T.StructType(
            [
                T.StructField(k, T.StringType() if v is None else build(v), True)
                for k, v in node.items()
            ]
        )

    return build(tree)


def _fields(parsed: Column, paths: Mapping[str, str]) -> dict[str, Column]:
    out = {}
    for alias, path in paths.items():
        c = parsed
        for p in path.split("."):
            c = c.getField(p)
        out[alias] = c
    return out


def _parsed(df: DataFrame, column: str, paths: Mapping[str, str]) -> Column:
    if not isinstance(dtype := df.schema[column].dataType, T.StringType):
        raise TypeError(f"column {column!r} must be STRING (JSON text) or VARIANT, not {dtype}")
    # The option is a default: without any, Catalyst narrows each leaf's call to its own field,
    # and the calls then differ and parse the text once each.
    return F.from_json(F.col(column), leaf_schema(paths), {"mode": "PERMISSIVE"})


def json_leaves(df: DataFrame, column: str, paths: Mapping[str, str]) -> dict[str, Column]:
    """Map each alias in ``paths`` to a STRING column holding that leaf of ``df[column]``.

    Path keys are case-sensitive, as in the source system. For one projection; where leaves
    are filtered on as well, :func:`with_leaves` parses text once for both."""
    if isinstance(df.schema[column].dataType, T.VariantType):
        return {alias: F.try_variant_get(F.col(column), "$." + path, "string") for alias, path in paths.items()}
    return _fields(_parsed(df, column, paths), paths)


def with_leaves(df: DataFrame, column: str, paths: Mapping[str, str]) -> tuple[DataFrame, dict[str, Column]]:
    """(``df`` to read them from, :func:`json_leaves` of ``column``).

    Text is parsed once a row, however often its leaves are read; the frame has one column
    more (``__leaves``). VARIANT is left to the scan, which reads the leaves' own columns."""
    if isinstance(df.schema[column].dataType, T.VariantType) or not paths:
        return df, json_leaves(df, column, paths) if paths else {}
    made = df.select("*", F.explode(F.array(_parsed(df, column, paths))).alias("__leaves"))
    return made, _fields(F.col("__leaves"), paths)
