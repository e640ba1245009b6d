"""Training records of verified tasks, and trajectories of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltide.functions.canonical import canonical_json
from voltide.operators.integrity import multiset_digest, repeated_keys
from voltide.sources.tables import Files, read_jsonl, write_jsonl

RECORD = "schema_version string, task_id string, task_family string, metric string, snapshot_id string, prompt string, answer string, verified boolean, digest string"
EVENT = "task_id string, position long, kind string, payload string"


def write_records(records: DataFrame, folder: str) -> dict:
    """Verified records as JSON lines in task order, and a manifest. Records
    that are not verified or share a task_id are errors."""
    if records.where("verified is null or not verified").limit(1).count():
        raise ValueError("records that are not verified")
    if repeated_keys(records, ["task_id"]).limit(1).count():
        raise ValueError("a task_id repeats")
    spark = records.sparkSession
    names = [x.split()[0] for x in RECORD.split(", ")]
    write_jsonl(records.select(*names), f"{folder}/records", ["task_id"])
    found = read_records(spark, folder)
    manifest = {"records": found.count(), "digest": multiset_digest(found), "by_metric": {r.metric: r["count"] for r in found.groupBy("metric").count().orderBy("metric").collect()}}
    Files(spark, folder).write_text(f"{folder}/manifest.json", canonical_json(manifest))
    return manifest


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    return read_jsonl(spark, f"{folder}/records", RECORD)


def write_trajectories(events: DataFrame, folder: str) -> None:
    write_jsonl(events, folder, ["task_id", "position"])


def broken_trajectories(events: DataFrame) -> DataFrame:
    """Tasks whose positions are not 0, 1, 2 ... each once."""
    n = events.groupBy("task_id").agg(F.count("*").alias("n"), F.countDistinct("position").alias("d"), F.min("position").alias("low"), F.max("position").alias("high"))
    return n.where("low != 0 or high != n - 1 or d != n")
