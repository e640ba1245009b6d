"""Deterministic samples, allocations, schedules and rule lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltide.operators.numbering import with_positions


#: Rules that may be tried on every item.
MOST_RULES = 10_000


def hash_rank(contract: str, seed: int, *ids: str) -> Column:
    """SHA-256 text that orders rows by chance, yet the same everywhere."""
    return F.sha2(F.concat_ws("|", F.lit(contract), F.lit(str(seed)), *(F.col(x).cast("string") for x in ids)), 256)


def hash_sample(df: DataFrame, n: int, contract: str, seed: int, key: str) -> DataFrame:
    """``n`` rows of smallest hash, in key order: top-k on each partition
    first, then one merge."""
    return df.withColumn("__h", hash_rank(contract, seed, key)).orderBy("__h").limit(n).drop("__h").orderBy(key)


def allocate_round_robin(df: DataFrame, targets: Sequence[str], contract: str, seed: int, key: str, within: str | None = None) -> DataFrame:
    """Rows in hash order are dealt to the targets in turn, without
    replacement; ``within`` deals each group by itself, in its own task, and
    without it rows are numbered in ranges."""
    ranked = df.withColumn("__h", hash_rank(contract, seed, key))
    if within:
        dealt = ranked.withColumn("slot", F.row_number().over(Window.partitionBy(within).orderBy("__h", key)) - 1)
    else:
        dealt = with_positions(ranked, "__h", key, out="slot").withColumn("slot", F.col("slot").cast("int"))
    names = F.array(*map(F.lit, targets))
    return dealt.withColumn("target", F.element_at(names, (F.col("slot") % len(targets) + 1).cast("int"))).drop("__h")


def as_of(left: DataFrame, right: DataFrame, on: Sequence[str], time: str, values: Sequence[str]) -> DataFrame:
    """Each left row with the latest right row at or before its time.

    One union and one window instead of a range join: the last value that is
    not null within the key, in time order, right rows first on ties.
    """
    pack = F.struct(F.col(time).alias("__t"), *values)
    rows = left.withColumn("__side", F.lit(1)).withColumn("__v", F.lit(None).cast(right.select(pack.alias("v")).schema["v"].dataType))
    other = right.select(*on, time, F.lit(0).alias("__side"), pack.alias("__v"))
    both = rows.unionByName(other, allowMissingColumns=True)
    w = Window.partitionBy(*on).orderBy(time, "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__v", F.last("__v", ignorenulls=True).over(w)).where("__side = 1")
    return found.select(*left.columns, *(F.col(f"__v.{v}").alias(v) for v in values), F.col("__v.__t").alias(f"{time}_matched"))


def mastery_band(rate: Column, bands: Sequence[tuple[str, float, float]]) -> Column:
    """Name of the left-closed band (name, minimum, multiplier) in ascending
    order; the last one includes the top. Null outside [0, 1]."""
    out = F.lit(None).cast("string")
    for name, least, _ in bands:
        out = F.when(rate >= least, F.lit(name)).otherwise(out)
    return F.when(rate.between(0, 1), out)


def curriculum_weights(tasks: DataFrame, mixture: dict[str, float], bands: Sequence[tuple[str, float, float]], current_stage: int) -> DataFrame:
    """(task_id, stage, pass_rate) to (task_id, bucket, weight).

    Earlier stages are replayed, the next one explored; later ones are left
    out. Mass of empty buckets goes to the others in proportion. In a bucket,
    band multipliers share the mass; if all are zero, equally. A missing pass
    rate counts as zero.
    """
    stage = F.col("stage")
    bucket = F.when(stage < current_stage, "replay").when(stage == current_stage, "current").when(stage == current_stage + 1, "explore")
    rate = F.coalesce(F.col("pass_rate"), F.lit(0.0))
    score = F.lit(None).cast("double")
    for _, least, multiplier in bands:
        score = F.when(rate >= least, F.lit(float(multiplier))).otherwise(score)
    rows = tasks.select("task_id", bucket.alias("bucket"), score.alias("score")).where(F.col("bucket").isNotNull())
    mass = F.element_at(F.create_map(*(x for k, v in mixture.items() for x in (F.lit(k), F.lit(float(v))))), F.col("bucket"))
    totals = rows.groupBy("bucket").agg(F.sum("score").alias("total"), F.count("*").alias("n")).withColumn("mass", mass)
    active = totals.agg(F.sum("mass").alias("active"))
    # Three buckets at most: broadcast sides of a proven size.
    rows = rows.join(F.broadcast(totals), "bucket").join(F.broadcast(active))
    share = F.when(F.col("total") == 0, 1.0 / F.col("n")).otherwise(F.col("score") / F.when(F.col("total") == 0, 1.0).otherwise(F.col("total")))
    return rows.select("task_id", "bucket", (F.col("mass") / F.col("active") * share).alias("weight"))


def first_matching_rule(items: DataFrame, rules: DataFrame, key: str, matches: Column) -> DataFrame:
    """Each item with the rule of lowest ``rule_order`` that matches, or nulls.

    ``rules`` is a catalogue of at most MOST_RULES rows, which is checked before
    it travels; ``matches`` is a condition over both.
    """
    if rules.limit(MOST_RULES + 1).count() > MOST_RULES:
        raise ValueError("too many rules to try each on every item")
    hit = items.join(F.broadcast(rules), matches, "left")
    best = F.min_by(F.struct("rule_id", "reason"), "rule_order")
    return hit.groupBy(key).agg(best.alias("__r")).select(key, F.col("__r.rule_id").isNotNull().alias("compatible"), F.col("__r.rule_id").alias("rule_id"), F.col("__r.reason").alias("reason"))


def coordinate_difference(a: Column, b: Column) -> Column:
    """Names of the coordinates (map columns) that differ, sorted."""
    return F.sort_array(F.filter(F.map_keys(a), lambda k: ~F.element_at(a, k).eqNullSafe(F.element_at(b, k))))


def coordinate_rank(axis: str, value: Column, levels: dict[str, Sequence[str]]) -> Column:
    """Place of a value in its axis' declared order; numbers are their own."""
    if axis not in levels:
        return value.cast("int")
    at = F.array_position(F.array(*map(F.lit, levels[axis])), value)
    return F.when(at > 0, at - 1).cast("int")


def canonical_coordinates(axes: Sequence[str], bare: Sequence[str], **values: Column) -> Column:
    """An id of coordinates in the order of their axes: each as its name and
    value, those of ``bare`` axes without the name."""
    return F.concat_ws("-", *(values[a].cast("string") if a in bare else F.concat(F.lit(a), values[a].cast("string")) for a in axes))


def adapt_legacy(tasks: DataFrame, variants: DataFrame, keys: Sequence[str], key: str = "task_id") -> DataFrame:
    """Legacy tasks under the identity of the variant that they match in every
    one of ``keys``; a task without exactly one match is an error. Its own
    columns stay as they are."""
    adapted = tasks.join(variants, list(keys), "left")
    known = next(x for x in variants.columns if x not in keys)
    bad = adapted.groupBy(key).agg(F.count(known).alias("n")).where("n != 1")
    if bad.limit(1).count():
        raise ValueError("legacy tasks that match no variant, or several")
    return adapted


def mutate(tasks: DataFrame, changes: dict[str, int], *, allowed: Sequence[str], most_changed: int, direction: int = 1) -> DataFrame:
    """Children of tasks (task_id, coordinates map): changed axes must be
    allowed, few enough, and move in one direction. Invalid children are left
    out; each has its parent's id and an id of its own content."""
    bad = set(changes) - set(allowed)
    if bad:
        raise ValueError(f"axes may not change: {sorted(bad)}")
    if not 0 < len(changes) <= most_changed:
        raise ValueError("too many or no changes")
    new = F.create_map(*(x for k, v in changes.items() for x in (F.lit(k), F.lit(v))))
    old = F.col("coordinates")
    moved = F.lit(True)
    for k, v in changes.items():
        moved = moved & ((F.lit(v) - F.element_at(old, F.lit(k))) * direction > 0)
    child = F.map_from_entries(F.array_sort(F.map_entries(F.map_zip_with(old, new, lambda k, x, y: F.coalesce(y, x)))))
    out = tasks.where(moved).select(F.col("task_id").alias("parent_id"), child.alias("coordinates"))
    return out.withColumn("task_id", F.concat(F.lit("task-"), F.substring(F.sha2(F.concat_ws("|", F.col("parent_id"), F.to_json("coordinates")), 256), 1, 24)))


def capability_gate(tasks: DataFrame, capabilities: DataFrame, keys: Sequence[str], accepted: Sequence[str] = ("ACTIVE",)) -> DataFrame:
    """Every task with the decision on its exact semantic key."""
    found = tasks.join(capabilities.select(*keys, "status"), list(keys), "left")
    reason = F.when(F.col("status").isNull(), "no such capability").when(~F.col("status").isin(*accepted), F.concat(F.lit("status "), F.col("status"))).otherwise("ok")
    return found.withColumn("admitted", F.coalesce(F.col("status").isin(*accepted), F.lit(False))).withColumn("reason", reason)


class Registry(dict):
    """Objects by id; an id can't be registered twice."""

    def register(self, key: str, value):
        if key in self:
            raise ValueError(f"{key} is registered already")
        self[key] = value
        return value
