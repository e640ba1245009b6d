"""Table sources and sinks: snapshots of Parquet tables in one folder."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltide.functions.canonical import canonical_json


class Files:
    """Small files and renames through Hadoop's file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path(root).getFileSystem(self.conf)

    def path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def exists(self, p: str) -> bool:
        return self.fs.exists(self.path(p))

    def names(self, p: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(p))) if self.exists(p) else []

    def read_text(self, p: str) -> str:
        stream = self.fs.open(self.path(p))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_text(self, p: str, text: str) -> None:
        """Write aside, then rename; an existing file is an error."""
        if self.exists(p):
            raise FileExistsError(p)
        aside = f"{p}.{uuid.uuid4().hex[:8]}.tmp"
        out = self.fs.create(self.path(aside), False)
        out.write(bytearray(text.encode()))
        out.close()
        self.rename(aside, p)

    def rename(self, a: str, b: str) -> None:
        if self.exists(b):
            raise FileExistsError(b)
        if not self.fs.rename(self.path(a), self.path(b)):
            raise OSError(f"can't rename {a}")

    def delete(self, p: str) -> None:
        self.fs.delete(self.path(p), True)


def load(spark: SparkSession, folder: str, name: str, schema: T.StructType | None = None) -> DataFrame:
    """Read-only scan of one table; a given schema saves the inference."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{folder}/{name}.parquet")


def attach(spark: SparkSession, folder: str, catalog: str, names: Iterable[str]) -> dict[str, DataFrame]:
    """Tables of another folder as temporary views ``catalog_name``."""
    out = {}
    for n in names:
        out[n] = load(spark, folder, n)
        out[n].createOrReplaceTempView(f"{catalog}_{n}")
    return out


def detach(spark: SparkSession, catalog: str, names: Iterable[str]) -> None:
    for n in names:
        spark.catalog.dropTempView(f"{catalog}_{n}")


def values(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """An in-memory VALUES table."""
    return spark.createDataFrame(list(rows), schema)


def publish(spark: SparkSession, tables: dict[str, DataFrame], folder: str, identity: dict | None = None) -> dict:
    """Write tables aside, add a manifest, then rename the folder into place.
    Readers see all or nothing; an existing folder is refused."""
    files = Files(spark, folder)
    if files.exists(folder):
        raise FileExistsError(folder)
    aside = f"{folder}.{uuid.uuid4().hex[:8]}.tmp"
    counts = {}
    for name, df in sorted(tables.items()):
        df.write.parquet(f"{aside}/{name}.parquet")
        counts[name] = load(spark, aside, name, df.schema).count()
    manifest = {"counts": counts, "identity": identity or {}}
    files.write_text(f"{aside}/manifest.json", canonical_json(manifest))
    files.rename(aside, folder)
    return manifest


def insert_only_merge(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows to append, one-row summary requested / inserted / unchanged).

    Rows whose key exists stay as they are. Repeated incoming keys are an
    error of the caller; only one of them would be appended.
    """
    new = incoming.dropDuplicates(list(keys)).join(existing.select(*keys), list(keys), "left_anti")
    marked = incoming.join(existing.select(*keys).distinct().withColumn("__old", F.lit(1)), list(keys), "left")
    summary = marked.agg(F.count("*").alias("requested"), F.count_if(F.col("__old").isNull()).alias("inserted"), F.count("__old").alias("unchanged"))
    return new.select(*incoming.columns), summary


def append(df: DataFrame, folder: str, name: str) -> None:
    df.write.mode("append").parquet(f"{folder}/{name}.parquet")


def json_config(spark: SparkSession, path: str, required: dict[str, type]) -> dict:
    """A validated JSON object."""
    raw = json.loads(Files(spark, path).read_text(path))
    for key, kind in required.items():
        if key not in raw:
            raise ValueError(f"config lacks {key}")
        if not isinstance(raw[key], kind) or isinstance(raw[key], bool) != (kind is bool):
            raise ValueError(f"config {key} must be {kind.__name__}")
    if extra := set(raw) - set(required):
        raise ValueError(f"config has unknown keys {sorted(extra)}")
    return raw


def write_jsonl(df: DataFrame, folder: str, order: Sequence[str]) -> None:
    """One JSON object per line, in order. Ranges keep their order in the
    names of their files, so nothing is gathered in one task."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.json(folder)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a line that doesn't parse is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def information_schema(spark: SparkSession, tables: dict[str, DataFrame], schema: str = "main", views: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Views ``tables``, ``columns``, ``views`` and ``schemata`` in the manner of
    the SQL standard; ``views`` has definitions by name."""
    views = views or {}
    names = [(schema, n, "VIEW" if n in views else "BASE TABLE") for n in sorted(tables)]
    cols = [(schema, n, f.name, i, f.dataType.simpleString().upper(), "YES" if f.nullable else "NO") for n in sorted(tables) for i, f in enumerate(tables[n].schema.fields, 1)]
    return {
        "tables": spark.createDataFrame(names, "table_schema string, table_name string, table_type string"),
        "columns": spark.createDataFrame(cols, "table_schema string, table_name string, column_name string, ordinal_position int, data_type string, is_nullable string"),
        "views": spark.createDataFrame([(schema, n, views[n]) for n in sorted(views)], "table_schema string, table_name string, view_definition string"),
        "schemata": spark.createDataFrame([(schema,)], "schema_name string"),
    }


def describe(df: DataFrame) -> DataFrame:
    """column_name, column_type, nullable."""
    rows = [(f.name, f.dataType.simpleString().upper(), "YES" if f.nullable else "NO") for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "column_name string, column_type string, nullable string")


class Migrations:
    """Upgrades between schema versions, one step at a time."""

    def __init__(self):
        self.steps: dict[str, tuple[str, object]] = {}

    def step(self, old: str, new: str):
        def add(f):
            if old in self.steps:
                raise ValueError(f"{old} has a step already")
            self.steps[old] = (new, f)
            return f

        return add

    def upgrade(self, tables: dict[str, DataFrame], version: str, target: str, status: str = "OPEN") -> dict[str, DataFrame]:
        if version != target and status == "FROZEN":
            raise ValueError("a frozen snapshot is not migrated")
        while version != target:
            if version not in self.steps:
                raise ValueError(f"no way from {version} to {target}")
            version, f = self.steps[version]
            tables = f(dict(tables))
        return tables


def add_column(df: DataFrame, name: str, kind: str) -> DataFrame:
    return df.withColumn(name, F.lit(None).cast(kind))


def with_columns(df: DataFrame, **kinds: str) -> DataFrame:
    """Columns that are not there yet, without values; those there stay."""
    for name, kind in kinds.items():
        df = df if name in df.columns else add_column(df, name, kind)
    return df


#: The columns that versions before 2.6 lack, by table; counts start at zero.
ADDED = {
    "snapshot_revisions": dict.fromkeys(("underlying_dependence_count", "option_chain_spec_count", "intraday_bridge_spec_count", "underlying_volume_model_count", "option_pricing_audit_count"), "bigint"),
    "option_contracts": {"chain_id": "string", "listing_date": "date", "listing_spot": "decimal(24,8)", "strike_moneyness": "decimal(24,8)"},
    "option_chain_specs": {"liquidity_filter": "string", "quote_model": "string"},
}
#: What versions before 2.5 did not say of a dependence.
MAPPING = ("source_dependence_spec_id", "mapping_id", "mapping_type", "risk_neutral_measure_id", "numeraire_id", "rate_path_id")
#: The tables of observation laws, which migration makes empty.
LAWS = {
    "intraday_bridge_specs": "snapshot_id string, bridge_spec_id string, steps int, stream_namespace string",
    "underlying_volume_models": "snapshot_id string, volume_spec_id string, stream_namespace string",
}


def market_migrations() -> Migrations:
    """From any of versions 2.0 to 2.5 to 2.6: rows stay as they are; a
    dependence of before 2.5 becomes one of the physical measure alone; columns
    are added without values, counts with zero; laws start empty."""
    out = Migrations()

    def to_target(tables: dict[str, DataFrame], rebuild: bool) -> dict[str, DataFrame]:
        spark = next(iter(tables.values())).sparkSession
        if rebuild and "underlying_dependence" in tables:
            tables["underlying_dependence"] = with_columns(tables["underlying_dependence"].drop(*MAPPING), **dict.fromkeys(MAPPING, "string"))
        for name, kinds in ADDED.items():
            if name in tables:
                new = [k for k in kinds if k not in tables[name].columns]
                tables[name] = with_columns(tables[name], **kinds)
                if name == "snapshot_revisions":
                    tables[name] = tables[name].withColumns({k: F.lit(0).cast(kinds[k]) for k in new})
        for name, kinds in LAWS.items():
            tables.setdefault(name, spark.createDataFrame([], kinds))
        return tables

    for version in ("2.0", "2.1", "2.2", "2.3", "2.4"):
        out.step(version, "2.6")(lambda tables: to_target(tables, True))
    out.step("2.5", "2.6")(lambda tables: to_target(tables, False))
    return out
