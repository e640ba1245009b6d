"""Restricted read-only SQL over an allowlist of relations.

The text is parsed by Spark's own parser and the unresolved plan is walked
before anything is analysed: one query, only known relations or names of WITH
clauses in scope, no table functions, no denied or qualified functions.
(The walk uses the JVM's parser, so it needs a classic session.)
"""

from __future__ import annotations

import datetime as dt
import json
import math
import threading
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from decimal import Decimal

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

from voltide.operators.integrity import multiset_digest
from voltide.sources.tables import describe, information_schema

MAX_CHARS, MAX_ROWS, MAX_BYTES, MAX_SECONDS, MAX_CALLS, MAX_MEMORY = 20_000, 1000, 1 << 20, 5.0, 10, 256 << 20
#: Functions whose value is not that of their arguments, or that reach out.
DENIED = frozenset(
    "rand random randn uuid shuffle current_user user session_user current_catalog current_database current_schema current_date current_timestamp now localtimestamp curdate unix_timestamp input_file_name input_file_block_start input_file_block_length reflect java_method try_reflect monotonically_increasing_id spark_partition_id version sleep randstr uniform".split()
)


class EndpointError(ValueError):
    """Base of all refusals; ``code`` tells them apart."""

    code = "error"


class BudgetError(EndpointError):
    code = "budget_exhausted"


class InputError(EndpointError):
    code = "invalid_input"


class SyntaxError_(EndpointError):
    code = "syntax_error"


class CapabilityError(EndpointError):
    code = "not_allowed"


class BindError(EndpointError):
    code = "bind_error"


class TimeoutError_(EndpointError):
    code = "timeout"


class ValueError_(EndpointError):
    code = "unsupported_value"


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


class Guard:
    """Walks an unresolved plan."""

    def __init__(self, relations: Iterable[str]):
        self.relations = {r.lower() for r in relations}

    def plan(self, node, scope: frozenset[str]) -> None:
        kind = node.getClass().getSimpleName()
        if kind == "UnresolvedWith":
            inner = scope
            for pair in _items(node.cteRelations()):
                name = pair._1().lower()
                body = pair._2()
                own = inner | {name} if body.getClass().getSimpleName() == "SubqueryAlias" and node.allowRecursion() else inner
                self.plan(body, own)
                inner = inner | {name}
            self.plan(node.child(), inner)
            return
        if kind == "UnresolvedRelation":
            parts = [p.lower() for p in _items(node.multipartIdentifier())]
            if len(parts) > 2 or not (".".join(parts) in self.relations or (len(parts) == 1 and parts[0] in scope)):
                raise CapabilityError(f"relation {'.'.join(parts)} is not available")
        elif kind in ("UnresolvedTableValuedFunction", "UnresolvedTVFAliases", "RelationTimeTravel", "ScriptTransformation", "InsertIntoStatement", "Sample", "UnresolvedHint") and kind != "UnresolvedTVFAliases":
            raise CapabilityError(f"{kind} is not allowed")
        for e in _items(node.expressions()):
            self.expression(e, scope)
        for child in _items(node.children()):
            self.plan(child, scope)

    def expression(self, e, scope: frozenset[str]) -> None:
        kind = e.getClass().getSimpleName()
        if kind == "UnresolvedFunction":
            parts = [p.lower() for p in _items(e.nameParts())]
            if len(parts) != 1:
                raise CapabilityError(f"qualified function {'.'.join(parts)}")
            if parts[0] in DENIED:
                raise CapabilityError(f"function {parts[0]} is not allowed")
        if kind in ("CurrentDate", "CurrentTimestamp", "CurrentUser", "CurrentCatalog", "CurrentDatabase", "LocalTimestamp", "Now"):
            raise CapabilityError(f"{kind} is not allowed")
        if any(x.getSimpleName() == "PlanExpression" for x in _supers(e)):
            self.plan(e.plan(), scope)
        for child in _items(e.children()):
            self.expression(child, scope)


def _supers(obj):
    c = obj.getClass()
    while c is not None:
        yield c
        c = c.getSuperclass()


@dataclass
class Result:
    columns: list[str]
    rows: list[list]
    truncated: bool

    def as_dict(self) -> dict:
        return {"columns": self.columns, "rows": self.rows, "row_count": len(self.rows), "truncated": self.truncated}


def encode(x):
    """A value as JSON; decimals and dates as text, nothing inexact."""
    if x is None or isinstance(x, (bool, int, str)):
        return x
    if isinstance(x, Decimal):
        return format(x, "f")
    if isinstance(x, dt.datetime):
        raise ValueError_("timestamps are not supported; cast to date or string")
    if isinstance(x, dt.date):
        return x.isoformat()
    if isinstance(x, float):
        if not math.isfinite(x):
            raise ValueError_("a number is not finite")
        return x
    raise ValueError_(f"{type(x).__name__} values are not supported")


class Endpoint:
    """A budgeted SQL endpoint over named DataFrames (``schema.table`` or
    ``table``)."""

    def __init__(
        self, spark: SparkSession, relations: dict[str, DataFrame], *, calls: int = MAX_CALLS, seconds: float = MAX_SECONDS, rows: int = MAX_ROWS, size: int = MAX_BYTES, chars: int = MAX_CHARS, memory: int = MAX_MEMORY, inventory: dict[str, str] | None = None, catalogue: bool = True
    ):
        """``inventory``: the exact relations with the digests of their contents;
        any difference, and any function that a user registered, is refused.
        ``memory``: the most bytes that a query may be estimated to read;
        ``catalogue``: whether information_schema can be asked."""
        self.spark, self.relations, self.memory = spark, {k.lower(): v for k, v in relations.items()}, memory
        if inventory is not None:
            self._check_inventory({k.lower(): v for k, v in inventory.items()})
        if catalogue:
            self.relations |= self._catalogue()
        self.calls, self.seconds, self.rows, self.size, self.chars = calls, seconds, rows, size, chars
        self.lock = threading.Lock()

    def _check_inventory(self, inventory: dict[str, str]) -> None:
        if set(inventory) != set(self.relations):
            raise CapabilityError("the relations differ from the inventory")
        own = {r[0] for r in self.spark.sql("SHOW USER FUNCTIONS").collect()}
        if own:
            raise CapabilityError(f"functions of users are there: {sorted(own)[:5]}")
        for name, df in sorted(self.relations.items()):
            if multiset_digest(df) != inventory[name]:
                raise CapabilityError(f"the contents of {name} differ from the inventory")

    def _catalogue(self) -> dict[str, DataFrame]:
        by_schema: dict[str, dict[str, DataFrame]] = {}
        for name, df in self.relations.items():
            schema, _, table = name.rpartition(".")
            by_schema.setdefault(schema or "main", {})[table] = df
        out: dict[str, DataFrame] = {}
        for schema, tables in sorted(by_schema.items()):
            for view, df in information_schema(self.spark, tables, schema).items():
                key = f"information_schema.{view}"
                out[key] = out[key].unionByName(df) if key in out else df
        return out

    def tools(self, named: dict[str, str]) -> dict[str, Callable[[], dict]]:
        """Fixed queries as functions without parameters: each may be called
        once, and takes one of the endpoint's calls."""

        def tool(name: str, sql: str) -> Callable[[], dict]:
            used = []

            def run() -> dict:
                if used:
                    raise BudgetError(f"{name} was called already")
                used.append(True)
                return self.query(sql)

            return run

        return {name: tool(name, sql) for name, sql in named.items()}

    def _spend(self) -> None:
        with self.lock:
            if self.calls < 1:
                raise BudgetError("no calls are left")
            self.calls -= 1

    def _parse(self, sql: str):
        try:
            return self.spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
        except Exception as e:
            raise SyntaxError_(str(e).splitlines()[0][:300]) from None

    def _metadata(self, sql: str) -> DataFrame | None:
        words = sql.strip().rstrip(";").split()
        head = [w.lower() for w in words[:2]]
        if head == ["show", "tables"] and len(words) == 2:
            own = sorted(n for n in self.relations if not n.startswith("information_schema."))
            return self.spark.createDataFrame([(n,) for n in own], "name string")
        if head[:1] in (["describe"], ["desc"]) and len(words) == 2:
            if words[1].lower() not in self.relations:
                raise CapabilityError(f"relation {words[1]} is not available")
            return describe(self.relations[words[1].lower()])
        return None

    def frame(self, sql: str) -> DataFrame:
        """The checked query as a DataFrame, not yet run."""
        if not isinstance(sql, str) or not sql.strip() or len(sql) > self.chars or "\0" in sql:
            raise InputError("the query must be a text of bounded length")
        if (meta := self._metadata(sql)) is not None:
            return meta
        plan = self._parse(sql)
        name = plan.getClass().getName()
        if ".command." in name or name.rpartition(".")[2].startswith(("Create", "Drop", "Insert", "Set", "Show", "Describe", "Explain", "Alter", "Delete", "Update", "Merge", "Cache", "Use")):
            raise CapabilityError("only queries are allowed")
        Guard(self.relations).plan(plan, frozenset())
        text = sql
        try:
            for rel, df in self.relations.items():
                df.createOrReplaceTempView(rel.replace(".", "__"))
            for rel in sorted(self.relations, key=len, reverse=True):
                text = _rename(text, rel, rel.replace(".", "__")) if "." in rel else text
            out = self.spark.sql(text)
            out._jdf.queryExecution().analyzed()
            return out
        except ParseException as e:
            raise SyntaxError_(str(e).splitlines()[0][:300]) from None
        except AnalysisException as e:
            raise BindError(str(e).splitlines()[0][:300]) from None

    def query(self, sql: str) -> dict:
        """Run within the budgets; at most ``rows`` rows and ``size`` bytes."""
        self._spend()
        tag, late = f"endpoint-{uuid.uuid4().hex}", threading.Event()

        def stop() -> None:
            late.set()
            self.spark.sparkContext.cancelJobsWithTag(tag)

        began = time.monotonic()  # parsing and analysis count too
        timer = threading.Timer(self.seconds, stop)
        timer.start()
        self.spark.sparkContext.addJobTag(tag)
        try:
            df = self.frame(sql)
            sizes = [int(str(x.stats().sizeInBytes())) for x in _items(df._jdf.queryExecution().optimizedPlan().collectLeaves())]
            needs = sum(n for n in sizes if n < 1 << 60)  # rows made by the driver have no known size
            if needs > self.memory:
                raise BudgetError(f"the query may read {needs} bytes")
            if late.is_set():
                raise TimeoutError_(f"stopped after {self.seconds} s")
            found = df.limit(self.rows + 1).collect()  # bounded
        except EndpointError:
            raise
        except Exception as e:
            if late.is_set():
                raise TimeoutError_(f"stopped after {self.seconds} s") from None
            raise BindError(str(e).splitlines()[0][:300]) from None
        finally:
            timer.cancel()
            self.spark.sparkContext.removeJobTag(tag)
        if late.is_set() or time.monotonic() - began > self.seconds:
            raise TimeoutError_(f"stopped after {self.seconds} s")
        rows, used, cut = [], len(json.dumps(df.columns)), len(found) > self.rows
        for r in found[: self.rows]:
            row = [encode(x) for x in r]
            used += len(json.dumps(row, ensure_ascii=False).encode()) + 1
            if used > self.size:
                cut = True
                break
            rows.append(row)
        return Result(df.columns, rows, cut).as_dict()


def _rename(sql: str, old: str, new: str) -> str:
    """Replace a dotted relation name outside quotes."""
    out, i, low = [], 0, sql.lower()
    while i < len(sql):
        ch = sql[i]
        if ch in "'\"":
            end = sql.find(ch, i + 1)
            end = len(sql) if end < 0 else end + 1
            out.append(sql[i:end])
            i = end
        elif low.startswith(old, i) and not (i and (low[i - 1].isalnum() or low[i - 1] in "_.")) and not (low[i + len(old) : i + len(old) + 1].isalnum() or low[i + len(old) : i + len(old) + 1] == "_"):
            # ``schema.table`` keeps its short name as an alias for its columns.
            out.append(new)
            i += len(old)
        else:
            out.append(ch)
            i += 1
    return "".join(out)


DECIMAL8_TEXT = r"^-?(0|[1-9][0-9]*)\.[0-9]{8}$"


def check_submission(expected: DataFrame, submitted: DataFrame, metrics: list[str], ordered: bool = False) -> list[str]:
    """Errors of a submission: fields, row ids, eight-place texts and values.

    Compared by a full join on row_id; with ``ordered`` both must also have
    their rows in the same order (column ``position``).
    """
    from pyspark.sql import functions as F

    want = ["row_id", *metrics, *(["position"] if ordered else [])]
    if sorted(submitted.columns) != sorted(want):
        return [f"fields must be {want}"]
    if submitted.groupBy("row_id").count().where("count > 1").limit(1).count():
        return ["row_id repeats"]
    errors = []
    for m in metrics:
        if submitted.where(F.col(m).isNotNull() & ~F.col(m).rlike(DECIMAL8_TEXT)).limit(1).count():
            errors.append(f"{m} is not an eight-place decimal")
    a, b = expected.select(*want).withColumn("__a", F.lit(1)), submitted.select("row_id", *(F.col(x).alias(f"__{x}") for x in want[1:])).withColumn("__b", F.lit(1))
    both = a.join(b, "row_id", "full")
    tally = both.agg(F.count_if(F.col("__b").isNull()).alias("missing"), F.count_if(F.col("__a").isNull()).alias("extra"), *(F.count_if(F.col("__a").isNotNull() & F.col("__b").isNotNull() & ~F.col(x).eqNullSafe(F.col(f"__{x}"))).alias(x) for x in want[1:])).first()
    return errors + [f"{k}: {tally[k]} rows" for k in ("missing", "extra", *want[1:]) if tally[k]]
