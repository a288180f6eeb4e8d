"""Fixed schemas of the graph tables, and conforming of older tables to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, IntegerType, StringType, StructType

_FINDING = StructType().add("summary", StringType()).add("explanation", StringType())
_TYPES: dict[str, DataType] = {"string": StringType(), "int": IntegerType(), "double": DoubleType(), "strings": ArrayType(StringType()), "doubles": ArrayType(DoubleType()), "findings": ArrayType(_FINDING)}


def _struct(columns: str) -> StructType:
    out = StructType()
    for column in columns.split(", "):
        name, kind = column.split(" ")
        out.add(name, _TYPES[kind])
    return out


_PROVENANCE = "observed_at string, confidence double, source string"
SCHEMAS = {
    name: _struct(columns)
    for name, columns in {
        "documents": f"id string, title string, raw_content string, path string, text_unit_ids strings, category string, tags strings, attributes string, {_PROVENANCE}",
        "text_units": f"id string, text string, n_tokens int, document_id string, document_ids strings, entity_ids strings, relationship_ids strings, {_PROVENANCE}",
        "entities": f"id string, name string, title string, type string, description string, text_unit_ids strings, document_ids strings, description_embedding doubles, degree int, community_ids strings, {_PROVENANCE}",
        "relationships": "id string, source string, target string, relationship_type string, description string, weight double, text_unit_ids strings, document_ids strings, rank int, observed_at string, confidence double, source_attribution string",
        "communities": "id string, level int, community string, title string, entity_ids strings, size int, kind string",
        "community_reports": "id string, community string, level int, title string, summary string, full_content string, rank double, rank_explanation string, findings findings, source string, source_path string",
    }.items()
}
#: What a missing or null column means; all others are null.
_DEFAULTS = {"confidence": "1.0", "kind": "'leiden'", "community_ids": "array()", "tags": "array()", "relationship_type": "'RELATED'"}
_TABLE_DEFAULTS = {"community_reports": {"source": "'llm'"}}


def needs_migration(df: DataFrame, table: str) -> bool:
    return table in SCHEMAS and any(f.name not in df.columns for f in SCHEMAS[table])


def conform(df: DataFrame, table: str) -> DataFrame:
    """The table with all columns of its schema in order, defaults filled in, other columns behind them. An unknown table is unchanged; a
    column `type` of relationships stands in for a missing relationship_type."""
    if table not in SCHEMAS:
        return df
    out = []
    for f in SCHEMAS[table]:
        default = _TABLE_DEFAULTS.get(table, {}).get(f.name, _DEFAULTS.get(f.name))
        own = [F.col(f.name)] if f.name in df.columns else []
        if f.name == "relationship_type" and "type" in df.columns:
            own.append(F.col("type"))
        own += [F.expr(default).cast(f.dataType)] if default is not None else []
        out.append((F.coalesce(*own) if own else F.lit(None)).cast(f.dataType).alias(f.name))
    rest = [c for c in df.columns if c not in SCHEMAS[table].names and not (table == "relationships" and c == "type")]
    return df.select(*out, *rest)
