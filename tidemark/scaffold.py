"""Entity declarations from the schemas of existing tables."""

from __future__ import annotations

import argparse
import keyword
import re

from pyspark.sql import SparkSession
from pyspark.sql.types import StructType

#: Spark type names and the column type that each becomes; anything else is kept as a string.
TYPE_OF = {
    "long": "long", "integer": "int", "short": "short", "byte": "short", "boolean": "bool", "decimal": "decimal", "double": "double", "float": "float",
    "string": "string", "timestamp_ntz": "timestamp", "timestamp": "timestamp_utc", "date": "date", "binary": "binary",
}


def python_name(table: str) -> str:
    name = re.sub(r"\W+", "_", table).strip("_").upper() or "TABLE"
    return f"T_{name}" if name[0].isdigit() or keyword.iskeyword(name.lower()) else name


def declaration(table: str, schema: StructType, key: str | None = None) -> str:
    """Python source of one entity; the key is the one named, or the first column."""
    key = key or (schema.fields[0].name if schema.fields else "")
    lines = [f"{python_name(table)} = Entity(", f"    {table!r},", "    ("]
    for f in schema.fields:
        kind = TYPE_OF.get(f.dataType.typeName(), "string")
        extra = ", key=True" if f.name == key else "" if f.nullable else ", nullable=False"
        lines.append(f"        Col({f.name!r}, {kind!r}{extra}),")
    marks = [n for n, c in (("soft_delete", "deleted_at"), ("tenant", "tenant_id")) if c in schema.fieldNames()]
    return "\n".join([*lines, "    ),", *[f"    {m}=True," for m in marks], ")"])


def scaffold(spark: SparkSession, folder: str, tables: list[str]) -> str:
    """A module of entities for Parquet tables in a folder; only their schemas are read."""
    parts = [declaration(t, spark.read.parquet(f"{folder.rstrip('/')}/{t}.parquet").schema) for t in tables]
    return "\n\n".join(["from tidemark.entity import Col, Entity", *parts]) + "\n"


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Prints entity declarations for Parquet tables.")
    p.add_argument("folder")
    p.add_argument("tables", nargs="+")
    p.add_argument("--output")
    a = p.parse_args(argv)
    text = scaffold(SparkSession.builder.getOrCreate(), a.folder, a.tables)
    if a.output:
        with open(a.output, "w") as f:
            f.write(text)
    else:
        print(text)


if __name__ == "__main__":
    main()
