"""Tools as table functions: the columns of a call come from the tool's JSON
schema, and whose session it runs in comes from the partition, never from the
arguments."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

_KINDS = {"string": StringType, "integer": LongType, "number": DoubleType, "boolean": BooleanType}


def schema_of(parameters: dict) -> StructType:
    """A JSON schema's properties as fields; arrays as arrays of their items."""

    def kind(spec: dict):
        return ArrayType(kind(spec["items"])) if spec.get("type") == "array" else _KINDS[spec["type"]]()

    return StructType([StructField(name, kind(spec)) for name, spec in parameters["properties"].items()])


def register_tool(spark: SparkSession, name: str, parameters: dict, run: Callable[[dict, dict], str], context: tuple[str, ...] = ("session_id",)) -> None:
    """``run(context, arguments)`` as the table function ``name`` of SQL:

        SELECT * FROM calls, LATERAL name(TABLE(...) PARTITION BY session_id)

    Its input table has the context's columns, ``call_id`` and the properties of
    ``parameters``; a column that the schema lacks, or a required one that is
    missing or of another type, is an error when the query is analysed. A call
    that fails gives its error as its output; so does a null required argument.
    The result is (context, call_id, output)."""
    wanted, required = schema_of(parameters), parameters.get("required", [])

    class Tool:
        @staticmethod
        def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
            if not rows.isTable:
                raise ValueError(f"{name} takes a table")
            given = {f.name: f.dataType for f in rows.dataType.fields}
            missing = [c for c in (*context, "call_id", *required) if c not in given]
            if missing:
                raise ValueError(f"{name}: missing {', '.join(missing)}")
            for column, kind in given.items():
                if column in context or column == "call_id":
                    continue
                if column not in wanted.names:
                    raise ValueError(f"{name}: no parameter {column}")
                if wanted[column].dataType != kind:
                    raise ValueError(f"{name}: {column} is {kind.simpleString()}, not {wanted[column].dataType.simpleString()}")
            out = [StructField(c, given[c]) for c in (*context, "call_id")]
            return AnalyzeResult(StructType([*out, StructField("output", StringType())]), withSinglePartition=False)

        def eval(self, rows) -> Iterator[tuple]:
            given = rows.asDict()
            own = {c: given[c] for c in context}
            arguments = {k: v for k, v in given.items() if k in wanted.names and v is not None}
            lacking = [c for c in required if c not in arguments]
            try:
                output = f"[Tool Error] Missing required argument: {lacking[0]}." if lacking else run(own, arguments)
            except Exception as e:  # noqa: BLE001  a call's failure is its output
                output = f"[Tool Execution Error]: {type(e).__name__}: {e}"
            yield (*own.values(), given["call_id"], output)

    spark.udtf.register(name, udtf(Tool))
