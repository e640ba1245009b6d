"""What a public reader may see of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltide.operators.integrity import private_fields


def public_view(df: DataFrame, columns: Sequence[str], private: set[str] = frozenset()) -> DataFrame:
    """A fixed public column list; a private name in it is an error."""
    out = df.select(*columns)
    if found := private_fields(out.schema, set(private)):
        raise ValueError(f"private fields in a public view: {found}")
    return out


def nulled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The same columns and types, some without values."""
    return df.withColumns({x: F.lit(None).cast(df.schema[x].dataType) for x in columns})


def rebuilt_json(**parts: Column) -> Column:
    """A new document of the named parts only, so that nothing else of a source
    document can pass."""
    return F.to_json(F.struct(*(v.alias(k) for k, v in parts.items())), {"ignoreNullFields": "false"})


def node_offsets(doc: Column, path: str = "nodes") -> Column:
    """Offsets of a curve document's nodes, without their values."""
    schema = f"struct<{path}:array<struct<offset:double>>>"
    return F.transform(F.from_json(doc, schema)[path], lambda n: n["offset"])
