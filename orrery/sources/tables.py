"""Tables: registration, sinks, upserts, deletes, schema changes, snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.sources.shared import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, name: str, path: str) -> bool:
    """Register a Parquet path as a table for SQL; False if the name is taken already."""
    if spark.catalog.tableExists(name):
        return False
    spark.read.parquet(path).createOrReplaceTempView(name)
    return True


def unknown_partition(metadata: Column, key: str) -> Column:
    """Partition value of a row: a metadata field, ``_unknown`` if it is missing."""
    return F.coalesce(F.get_json_object(metadata, f"$.{key}"), F.lit("_unknown"))


def write_partitioned(df: DataFrame, path: str, key: str, metadata: str = "metadata") -> None:
    """Append rows in folders by a metadata field."""
    df.withColumn(key, unknown_partition(F.col(metadata), key)).write.mode("append").partitionBy(key).parquet(path)


def write_nonempty(df: DataFrame, path: str) -> bool:
    """Write a table unless it is empty."""
    if df.isEmpty():
        return False
    df.write.mode("overwrite").parquet(path)
    return True


def upsert(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` replace those of ``base`` with the same key; others of both stay."""
    return base.join(new.select(key), key, "left_anti").unionByName(new)


def upsert_counts(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(updated, inserted) of an upsert."""
    known = base.select(key).distinct().withColumn("known", F.lit(True))
    marked = new.select(key).join(known, key, "left")
    return marked.agg(F.count_if(F.col("known").isNotNull()).alias("updated"), F.count_if(F.col("known").isNull()).alias("inserted"))


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is not true."""
    return df.where(~F.coalesce(condition, F.lit(False)))


RESERVED = frozenset({"id", "vector", "content"})


def alter(df: DataFrame, add: dict[str, Column] | None = None, rename: dict[str, str] | None = None, drop: list[str] | None = None) -> DataFrame:
    """Schema evolution; reserved columns can't be renamed or dropped."""
    if bad := RESERVED & {*(rename or {}), *(drop or [])}:
        raise ValueError(f"reserved columns: {sorted(bad)}")
    return df.withColumns(add or {}).withColumnsRenamed(rename or {}).drop(*(drop or []))


def file_hashes(df: DataFrame, path: str, digest: str) -> DataFrame:
    """One JSON map from path to hash."""
    return df.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(path, digest))))).alias("hashes"))


def new_snapshot(base: DataFrame, new: DataFrame, replaced: DataFrame, path: str = "path") -> DataFrame:
    """Rows of ``base`` whose path is not replaced, and the new rows."""
    return base.join(replaced.select(path).distinct(), path, "left_anti").unionByName(new)


def changed_paths(old: DataFrame, new: DataFrame, path: str, digest: str) -> DataFrame:
    """(path, change): added, deleted or changed between two inventories."""
    o, n = old.select(path, F.col(digest).alias("was")), new.select(path, F.col(digest).alias("now"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.col("was") != F.col("now"), "changed")
    return o.join(n, path, "full_outer").withColumn("change", change).where("change IS NOT NULL").select(path, "change")


def mutation_plan(changes: int, had_publication: bool, same_revision: bool) -> str:
    """What a staged mutation does."""
    if not had_publication:
        return "ReplaceAll"
    if changes:
        return "CloneAndMutate"
    return "Noop" if same_revision else "RefreshPublication"


def union_view(parts: dict[str, DataFrame], label: str = "repo_id") -> DataFrame:
    """UNION ALL of tables, each with its name in a literal column."""
    return reduce(lambda a, b: a.unionByName(b), [df.withColumn(label, F.lit(name)) for name, df in parts.items()])


def catalog_tables(spark: SparkSession) -> DataFrame:
    """Names and kinds of the registered tables."""
    rows = [(t.name, t.tableType) for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "sql_table_name string, sql_object_kind string")


def catalog_columns(spark: SparkSession, names: list[str]) -> DataFrame:
    rows = [(n, c.name, c.dataType, i, c.nullable) for n in names for i, c in enumerate(spark.catalog.listColumns(n), 1)]
    return spark.createDataFrame(rows, "sql_table_name string, column_name string, data_type string, ordinal_position int, is_nullable boolean")


def markdown_files(spark: SparkSession, root: str, surfaces: tuple[str, ...] = ("blueprint", "plan")) -> DataFrame:
    """(surface, path, note) of the markdown files below a folder's work surfaces; paths are relative to it."""
    base = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load([f"{base}/{s}" for s in surfaces])
    tail = F.element_at(F.split("path", rf"\Q{base}\E/", 2), 2)
    return raw.select(F.substring_index(tail, "/", 1).alias("surface"), tail.alias("path"), F.decode("content", "UTF-8").alias("note"))


def inventory(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, bytes, digest) of the files below a folder."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return raw.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("digest"))


def save_graph(entities: DataFrame, relations: DataFrame, path: str) -> None:
    """A knowledge graph as two tables; relations keep only known ends."""
    known = entities.select("name")
    kept = relations.join(known.select(F.col("name").alias("src")), "src", "left_semi").join(known.select(F.col("name").alias("dst")), "dst", "left_semi").select(*relations.columns)
    entities.write.mode("overwrite").parquet(f"{path}/entities")
    kept.write.mode("overwrite").parquet(f"{path}/relations")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/entities"), spark.read.parquet(f"{path}/relations")


def snapshot_at(log: DataFrame, key: str, order: str, until: int) -> DataFrame:
    """State of a log of saved and dropped (payload null) snapshots up to a point."""
    last = log.where(F.col(order) <= until).groupBy(key).agg(F.max_by("payload", order).alias("payload"))
    return last.where("payload IS NOT NULL")
