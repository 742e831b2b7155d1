"""Table functions of SQL: relations that the caller holds in memory, and functions over Arrow batches of a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.udtf import AnalyzeResult

#: Relations that are held have so many bytes at most together: they travel with the function.
HELD_BYTES = 32 << 20


class Relations:
    """Arrow tables by (namespace, name), for SQL as ``arrow_relation('namespace', 'name')``.

    Columns and types come from the relation that is named, when the query is analysed.  A name that is not held is an
    error then.  ``hold`` replaces what it held under a name; what a query reads is what was held at ``register``.
    """

    def __init__(self, limit: int = HELD_BYTES) -> None:
        self.limit, self.held = limit, {}

    def hold(self, namespace: str, name: str, relation: pa.Table) -> None:
        others = sum(t.nbytes for k, t in self.held.items() if k != (namespace, name))
        if others + relation.nbytes > self.limit:
            raise ValueError(f"{namespace}.{name} has {relation.nbytes} bytes, {self.limit - others} are left: write a table instead")
        self.held[namespace, name] = relation

    def release(self, namespace: str, name: str) -> bool:
        return self.held.pop((namespace, name), None) is not None

    def register(self, spark: SparkSession, function: str = "arrow_relation") -> None:
        held = dict(self.held)

        class Relation:
            @staticmethod
            def analyze(namespace, name) -> AnalyzeResult:
                key = (namespace.value, name.value)
                if key not in held:
                    raise ValueError(f"no relation {key[0]}.{key[1]} is held")
                return AnalyzeResult(from_arrow_schema(held[key].schema))

            def eval(self, namespace, name) -> Iterator[tuple]:
                for batch in held[namespace, name].to_batches(max_chunksize=4096):
                    yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        spark.udtf.register(function, F.udtf(Relation))


def register_batches(spark: SparkSession, name: str, function: Callable[[pa.Table], pa.Table], schema: str, gather: int = 8192) -> None:
    """A table function of SQL, ``name(TABLE(...))``, that a function over Arrow tables computes.

    Without PARTITION BY the table is not shuffled, and the function sees about ``gather`` rows at a time, so it has to
    treat rows one by one.  With PARTITION BY it never sees rows of two keys at once, but may see a key in several
    tables: what it returns for a key has to be such that SQL can merge it.  So no key has to fit in memory.
    """
    want = to_arrow_schema(StructType.fromDDL(schema))

    class Batches:
        def __init__(self) -> None:
            self.kept, self.rows = [], 0

        def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
            self.kept.append(batch)
            self.rows += batch.num_rows
            if self.rows >= gather:
                yield self.computed()

        def terminate(self) -> Iterator[pa.Table]:
            if self.rows:
                yield self.computed()

        def computed(self) -> pa.Table:
            rows = pa.Table.from_batches(self.kept)
            self.kept, self.rows = [], 0
            return function(rows).select(want.names).cast(want)

    spark.udtf.register(name, F.arrow_udtf(Batches, returnType=schema))
