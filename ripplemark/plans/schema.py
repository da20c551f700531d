"""JSON Schemas of the documents, from the types that the assessment reads and writes."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from ripplemark.operators.findings import SEVERITIES
from ripplemark.plans import assess, plan

_PLAIN = {"string": "string", "boolean": "boolean", "integer": "integer", "long": "integer", "double": "number"}
_FINDINGS = "version int, base string, head string, findings array<struct<rule: string, severity: string, title: string, path: string, line: int, function: string, excerpt: string>>, counts struct<high: bigint, medium: bigint, low: bigint>"


def of_type(kind: T.DataType) -> dict:
    if isinstance(kind, T.StructType):
        return {"type": "object", "properties": {f.name: of_type(f.dataType) for f in kind.fields}}
    if isinstance(kind, T.ArrayType):
        return {"type": "array", "items": of_type(kind.elementType)}
    if isinstance(kind, T.MapType):
        return {"type": "object", "additionalProperties": of_type(kind.valueType)}
    return {"type": [_PLAIN[kind.typeName()], "null"]}


def documents(spark: SparkSession) -> dict:
    """Schemas of the plan and the assessment, with their versions."""
    parsed = lambda ddl: of_type(spark.createDataFrame([], ddl).schema)
    found = {"plan": parsed(assess.SCHEMA), "assessment": parsed(_FINDINGS)}
    found["plan"]["properties"]["version"] = {"const": plan.VERSION}
    found["assessment"]["properties"]["version"] = {"const": assess.VERSION}
    found["assessment"]["properties"]["findings"]["items"]["properties"]["severity"] = {"enum": list(SEVERITIES)}
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "$defs": found}
