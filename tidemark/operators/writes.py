"""Writes as transformations: each takes a table's rows and gives the rows that it has afterwards.

Changes meet the table in one keyed join; Spark broadcasts the changes where statistics prove them small and shuffles
otherwise. All rules (keys, versions, tenants, not null) are columns or aggregates of the same job.
"""

from __future__ import annotations

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.entity import SOFT_DELETE, TENANT, Entity
from tidemark.errors import QueryError
from tidemark.functions.columns import breaks_range
from tidemark.functions.naming import quoted


def now(entity: Entity, name: str) -> SparkColumn:
    """The time of a write in UTC, in the column's own type."""
    kind = next(c for c in entity.columns if c.name == name).spark_type()
    utc = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
    return (utc if kind.typeName() in ("timestamp_ntz", "string", "date") else F.current_timestamp()).cast(kind)


def with_identities(stored: DataFrame, entity: Entity, last: int) -> DataFrame:
    """Numbers rows of Parquet files from ``last`` + 1, by file and place in it. The files stand still, so a row's number
    doesn't depend on how a run cuts them up; the table of files and their first numbers is as long as there are files."""
    key = entity.key
    placed = stored.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    first = placed.groupBy("_file").agg(F.count("*").alias("_n")).withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0)) + last + 1).drop("_n")
    numbered = placed.join(F.broadcast(first), "_file")
    return numbered.withColumn(key.name, (F.col("_first") + F.col("_row")).cast(key.spark_type())).select(*[quoted(c) for c in stored.columns])


def prepare_insert(rows: DataFrame, entity: Entity, keep_keys: bool = False) -> DataFrame:
    """New rows in the table's columns: what an insert leaves out is null, stamps are now, computed columns are computed.
    An identity stays null for ``with_identities``, unless keys are kept."""
    out = rows
    for c in entity.columns:
        if c.name not in out.columns or not (c.upsertable if keep_keys else c.insertable or c.identity):
            out = out.withColumn(c.name, (now(entity, c.name) if c.stamp else F.lit(None)).cast(c.spark_type()))
    out = out.select(*[F.col(c.name).cast(c.spark_type()).alias(c.name) for c in entity.columns])
    if entity.key.identity and not keep_keys:
        out = out.withColumn(entity.key.name, F.lit(None).cast(entity.key.spark_type()))
    return recompute(out, entity)


def recompute(rows: DataFrame, entity: Entity) -> DataFrame:
    for c in entity.columns:
        if c.computed is not None:
            rows = rows.withColumn(c.name, F.expr(c.computed).cast(c.spark_type()))
    return rows.select(*entity.names)


def _own(entity: Entity, tenant: object | None, side: str = "") -> SparkColumn:
    return F.col(f"{side}{TENANT}") == F.lit(tenant) if entity.tenant and tenant is not None else F.lit(True)


def update_where(base: DataFrame, entity: Entity, matched: SparkColumn, sets: dict[str, SparkColumn]) -> DataFrame:
    """Set-based update: the rows that match get new values, and the rest stay."""
    hit = F.coalesce(matched, F.lit(False))
    out = base.select(*[F.when(hit, sets[c.name].cast(c.spark_type())).otherwise(F.col(c.name)).alias(c.name) if c.name in sets else F.col(c.name) for c in entity.columns])
    return recompute(out, entity)


def _joined(base: DataFrame, delta: DataFrame, entity: Entity, how: str) -> DataFrame:
    renamed = delta.select(*[F.col(quoted(c)).alias(f"_new_{c}") for c in delta.columns], F.lit(True).alias("_given"))
    return base.withColumn("_there", F.lit(True)).join(renamed, F.col(quoted(entity.key.name)) == F.col(quoted(f"_new_{entity.key.name}")), how)


def update_by_key(base: DataFrame, delta: DataFrame, entity: Entity, tenant: object | None = None) -> DataFrame:
    """Rows whose key (and version, and tenant) a given row names take its updatable columns; versions grow by one."""
    hit = F.coalesce(F.col("_given"), F.lit(False)) & F.coalesce(_own(entity, tenant), F.lit(False))
    if entity.version:
        hit = hit & F.coalesce(F.col(entity.version.name) == F.col(f"_new_{entity.version.name}"), F.lit(False))
    out = []
    for c in entity.columns:
        if c.version:
            out.append(F.when(hit, F.col(c.name) + 1).otherwise(F.col(c.name)).cast(c.spark_type()).alias(c.name))
        elif c.updatable and c.name in delta.columns:
            out.append(F.when(hit, F.col(f"_new_{c.name}")).otherwise(F.col(c.name)).cast(c.spark_type()).alias(c.name))
        else:
            out.append(F.col(c.name))
    return recompute(_joined(base, delta, entity, "left").select(*out), entity)


def outdated(base: DataFrame, delta: DataFrame, entity: Entity, tenant: object | None = None) -> DataFrame:
    """Given rows that an update by key can't apply to: no row of that key, version and tenant is there."""
    on = [entity.key.name] + ([entity.version.name] if entity.version else [])
    return delta.join(base.where(F.coalesce(_own(entity, tenant), F.lit(False))).select(*on), on, "left_anti")


def delete_keys(base: DataFrame, keys: DataFrame, entity: Entity, tenant: object | None = None, when: SparkColumn | None = None) -> DataFrame:
    """Soft delete marks rows that aren't marked yet; else rows go. ``keys`` has the key column, without nulls."""
    marked = keys.select(F.col(quoted(entity.key.name)).alias("_key")).distinct().withColumn("_given", F.lit(True))
    joined = base.join(marked, F.col(quoted(entity.key.name)) == F.col("_key"), "left")
    hit = F.coalesce(F.col("_given"), F.lit(False)) & F.coalesce(_own(entity, tenant), F.lit(False))
    if not entity.soft_delete:
        return joined.where(~hit).select(*entity.names)
    fresh = hit & F.col(SOFT_DELETE).isNull()
    stamp = when if when is not None else now(entity, SOFT_DELETE)
    return joined.select(*[F.when(fresh, stamp).otherwise(F.col(c)).alias(c) if c == SOFT_DELETE else F.col(c) for c in entity.names])


def deletable(base: DataFrame, keys: DataFrame, entity: Entity, tenant: object | None = None) -> DataFrame:
    """Rows that a soft delete by these keys marks."""
    marked = keys.select(F.col(quoted(entity.key.name)).alias("_key"))
    live = base.where(F.col(SOFT_DELETE).isNull() & F.coalesce(_own(entity, tenant), F.lit(False)))
    return live.join(marked, F.col(quoted(entity.key.name)) == F.col("_key"), "left_semi")


def upsert(base: DataFrame, delta: DataFrame, entity: Entity) -> DataFrame:
    """Rows by key: given rows win in their updatable columns, new keys come in, others stay."""
    if entity.version:
        raise QueryError("an upsert would pass over the version; update by key instead")
    both, out = _joined(base, delta, entity, "full_outer"), []
    there, given = F.coalesce(F.col("_there"), F.lit(False)), F.coalesce(F.col("_given"), F.lit(False))
    for c in entity.columns:
        new = F.col(f"_new_{c.name}") if c.name in delta.columns else F.lit(None)
        if c.stamp:
            value = F.when(there, F.col(c.name)).otherwise(now(entity, c.name))
        elif c.key:
            value = F.coalesce(F.col(c.name), new)
        elif c.updatable and c.name in delta.columns:
            value = F.when(given & (there | F.lit(c.upsertable)), new).otherwise(F.col(c.name))
        else:
            value = F.when(there, F.col(c.name)).otherwise(new if c.upsertable else F.lit(None))
        out.append(value.cast(c.spark_type()).alias(c.name))
    return recompute(both.select(*out), entity)


def repeated_keys(delta: DataFrame, entity: Entity) -> DataFrame:
    return delta.groupBy(quoted(entity.key.name)).agg(F.count("*").alias("n")).where("n > 1")


def unique_violations(rows: DataFrame, entity: Entity, rules: list[tuple[str, ...]] | None = None) -> DataFrame:
    """(rule, n): for each broken uniqueness rule the number of its repeated values; nulls don't repeat."""
    found = None
    for group in entity.unique_sets() if rules is None else rules:
        present = rows.where(" AND ".join(f"{quoted(c)} IS NOT NULL" for c in group)).groupBy(*[quoted(c) for c in group]).agg(F.count("*").alias("k"))
        some = present.where("k > 1").agg(F.count("*").alias("n")).select(F.lit(",".join(group)).alias("rule"), "n")
        found = some if found is None else found.unionByName(some)
    return found.where("n > 0")


def orphans(rows: DataFrame, column: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose reference names no parent."""
    known = parents.select(F.col(quoted(parent_key)).alias("_parent")).distinct()
    return rows.where(F.col(quoted(column)).isNotNull()).join(known, F.col(quoted(column)) == F.col("_parent"), "left_anti")


def row_rules(entity: Entity) -> dict[str, SparkColumn]:
    """Not-null rules and value ranges: for each the number of rows that break it, as an aggregate."""
    rules = {}
    for c in entity.columns:
        if c.not_null and not c.computed:
            rules[f"{c.name} is null"] = F.sum(F.col(quoted(c.name)).isNull().cast("long"))
        if (wrong := breaks_range(c)) is not None:
            rules[f"{c.name} is out of range"] = F.sum(wrong.cast("long"))
    return rules
