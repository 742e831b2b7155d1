"""Guarded query surfaces: read-only SQL, structured authoring, table functions of plugins."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType, VarcharType

from orrery.sources.relations import register_batches

#: Logical operators that change something or describe the session; a query's parsed plan holds none.
_WRITES = ("Create", "Drop", "Insert", "Append", "Overwrite", "Delete", "Update", "Merge", "Set", "Alter", "Show", "Describe", "Use", "Explain", "Cache", "Uncache", "Add", "Reset", "Truncate", "Load", "Refresh", "Repair", "Analyze", "Comment", "Replace", "Rename")


def check_read_only(spark: SparkSession, sql: str) -> None:
    """Raise ValueError unless the text is exactly one query, by Spark's own parser; nothing runs."""
    if not sql.strip():
        raise ValueError("SQL text is blank")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise ValueError(f"not one SQL statement: {str(e).splitlines()[0]}") from e
    nodes = [plan]
    while nodes:
        node = nodes.pop()
        name = node.getClass().getSimpleName()
        if name.endswith("Command") or name.endswith("Statement") or name.startswith(_WRITES):
            raise ValueError(f"not a read-only query: {name}")
        kids = node.children()
        nodes += [kids.apply(i) for i in range(kids.size())]


def run_read_only(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """A checked query; ``{name}`` in the text stands for a given table."""
    check_read_only(spark, sql.format(**{n: n for n in tables}) if tables else sql)
    return spark.sql(sql, **tables)


@dataclass(frozen=True)
class Policy:
    max_limit: int = 100
    ops: frozenset[str] = frozenset({"eq", "contains"})
    needs_filter: frozenset[str] = frozenset()


@dataclass(frozen=True)
class Spec:
    """A structured query: filters are (column, op, value), order terms (column, asc or desc)."""

    table: str
    projection: list[str]
    limit: int
    filters: list[tuple[str, str, str]] = field(default_factory=list)
    order: list[tuple[str, str]] = field(default_factory=list)


def author(tables: dict[str, DataFrame], spec: Spec, policy: Policy | None = None) -> DataFrame:
    """The rows of a spec that keeps to the policy; ValueError otherwise."""
    policy = policy or Policy()
    if spec.table not in tables:
        raise ValueError(f"unknown table {spec.table}")
    df = tables[spec.table]
    types = {f.name: f.dataType for f in df.schema.fields}
    if not spec.projection or "*" in spec.projection:
        raise ValueError("name the columns")
    if not 0 < spec.limit <= policy.max_limit:
        raise ValueError(f"limit is not within 1 and {policy.max_limit}")
    if spec.table in policy.needs_filter and not spec.filters:
        raise ValueError(f"{spec.table} needs a filter")
    used = [*spec.projection, *[f[0] for f in spec.filters], *[o[0] for o in spec.order]]
    if bad := [c for c in used if c not in types]:
        raise ValueError(f"unknown columns: {bad}")

    def condition(column: str, op: str, value: str) -> Column:
        if op not in policy.ops:
            raise ValueError(f"op {op} is not allowed")
        if op == "eq":
            return F.col(column) == F.lit(value).cast(types[column])
        if op == "contains":
            if not isinstance(types[column], (StringType, VarcharType)):
                raise ValueError(f"contains needs text, {column} is {types[column].simpleString()}")
            return F.col(column).like(f"%{value}%")
        raise ValueError(f"unknown op {op}")

    for f in spec.filters:
        df = df.where(condition(*f))
    if bad := [d for _, d in spec.order if d.lower() not in ("asc", "desc")]:
        raise ValueError(f"directions: {bad}")
    if spec.order:
        df = df.orderBy(*[F.col(c).asc_nulls_last() if d.lower() == "asc" else F.col(c).desc_nulls_first() for c, d in spec.order])
    return df.limit(spec.limit).select(*spec.projection)


PLUGINS: dict[str, tuple[Callable[[pd.DataFrame], pd.DataFrame], str]] = {}


def plugin(name: str, schema: str) -> Callable:
    """Register a function from a batch of rows to rows of a schema."""

    def add(f: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[pd.DataFrame], pd.DataFrame]:
        PLUGINS[name] = (f, schema)
        return f

    return add


def run_plugin(df: DataFrame, name: str) -> DataFrame:
    """A plugin over Arrow batches of a table; batches are independent."""
    f, schema = PLUGINS[name]

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            yield f(b)

    return df.mapInPandas(batches, schema)


def register_plugin(spark: SparkSession, name: str) -> None:
    """A plugin as a table function of SQL under its own name: ``name(TABLE(...))``, batch by batch without a shuffle."""
    f, schema = PLUGINS[name]

    def run(rows: pa.Table) -> pa.Table:
        return pa.Table.from_pandas(f(rows.to_pandas()), preserve_index=False)

    register_batches(spark, name, run, schema)


def register_aggregate(spark: SparkSession, name: str, result: str, function: Callable) -> None:
    """An aggregate function of SQL that a Python function over a group's column (a pandas Series) computes.

    A group is one column in one task: for keys of bounded groups.
    """

    def run(column: pd.Series) -> float:
        return function(column)

    spark.udf.register(name, F.pandas_udf(run, result))


def scored_by(df: DataFrame, columns: list[str], scorer: Callable[[pa.RecordBatch], list[float]], name: str = "score") -> DataFrame:
    """Rows with a score that an outside scorer gives for Arrow batches of ``columns``; batch by batch, without a shuffle."""
    schema = StructType([*df.schema.fields, StructField(name, DoubleType())])
    own = df.columns

    def run(batches):
        for b in batches:
            asked = pa.RecordBatch.from_arrays([b.column(own.index(c)) for c in columns], columns)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scorer(asked), pa.float64())], [*own, name])

    return df.mapInArrow(run, schema)


def sql_payload(spark: SparkSession, sql: str, limit: int, **tables: DataFrame) -> dict:
    """What a service answers to a read-only query: its columns and types, at most ``limit`` rows as JSON cells, and whether there are more."""
    df = run_read_only(spark, sql, **tables)
    rows = df.limit(limit + 1).select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("j")).collect()
    return {"columns": [{"name": n, "type": t} for n, t in df.dtypes], "rows": [json.loads(r["j"]) for r in rows[:limit]], "more": len(rows) > limit}


def plan_summary(df: DataFrame) -> dict[str, int]:
    """How often each operator is in the physical plan."""
    names = re.findall(r"[A-Z]\w+(?=[ (\[]|$)", "\n".join(line.split("[")[0] for line in df._jdf.queryExecution().executedPlan().toString().splitlines()), re.M)
    return dict(Counter(names))
