"""Landed JSON payloads as typed DataFrames.

Every reader takes the fixed schema of its payload, so nothing is inferred and
unused fields are never materialised.  Unreadable records do not fail a run:
they are split off with their raw text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import PAYLOADS, REJECT_COLUMN, payload


def _with_reject(kind: str) -> T.StructType:
    return T.StructType([*payload(kind).fields, T.StructField(REJECT_COLUMN, T.StringType())])


def read_payload(spark: SparkSession, kind: str, path: str | list[str], multiline: bool = False) -> DataFrame:
    """Payload files (one document per line, or per file with ``multiline``)."""
    return (
        spark.read.schema(_with_reject(kind))
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", REJECT_COLUMN)
        .option("multiLine", multiline)
        .json(path)
    )


def stream_payload(spark: SparkSession, kind: str, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = (
        spark.readStream.schema(_with_reject(kind))
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", REJECT_COLUMN)
    )
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def parse_payload(df: DataFrame, kind: str, text: Column | str) -> DataFrame:
    """Payloads that arrive as a text column of a table.

    The parse sits in a generator: filters and projections above it then share
    one parse per row instead of repeating it.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": REJECT_COLUMN}
    text = F.col(text) if isinstance(text, str) else text
    return df.select(F.inline(F.array(F.from_json(text, _with_reject(kind), options))))


EXTRA = "extra"


def _struct_paths(schema: T.StructType, path: str = "$") -> list[tuple[str, list[str]]]:
    """(path, known field names) of the payload and of every struct inside it that is not in an array."""
    found = [(path, schema.fieldNames())]
    for f in schema.fields:
        if isinstance(f.dataType, T.StructType):
            found += _struct_paths(f.dataType, f"{path}.{f.name}")
    return found


def extra_fields(kind: str, text: Column | str) -> Column:
    """Fields of a JSON text that the payload's schema does not name: dotted path to VARIANT; NULL for unreadable texts.

    Objects are searched as deep as the schema has structs; what an unknown
    field holds stays whole.
    """
    whole = F.try_parse_json(F.col(text) if isinstance(text, str) else text)

    def unknown(path: str, known: list[str]) -> Column:
        fields = F.map_filter(F.try_variant_get(whole, path, "map<string,variant>"), lambda k, _: ~k.isin(known))
        if path == "$":
            return fields
        named = F.transform_keys(fields, lambda k, _: F.concat(F.lit(path[2:] + "."), k))
        return F.coalesce(named, F.expr("cast(map() as map<string,variant>)"))

    return F.map_concat(*[unknown(path, known) for path, known in _struct_paths(payload(kind))])


def parse_open_payload(df: DataFrame, kind: str, text: str) -> DataFrame:
    """``parse_payload`` with what its schema does not name in a VARIANT column ``extra``, NULL if there is nothing."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": REJECT_COLUMN}
    parsed = F.from_json(F.col(text), _with_reject(kind), options)
    unknown = extra_fields(kind, text)
    extra = F.when(F.size(unknown) > 0, F.call_function("to_variant_object", unknown))
    both = F.struct(parsed.alias("_row"), extra.alias(EXTRA))
    return df.select(F.inline(F.array(both))).select("_row.*", EXTRA)


def appeared_fields(df: DataFrame, kind: str, text: str) -> DataFrame:
    """feed, field, type, n: the fields a feed sent that its schema does not name, with their JSON types.

    A field that comes with several types has a row for each.
    """
    found = df.select(F.explode(extra_fields(kind, text)).alias("field", "value"))
    return found.groupBy("field", F.schema_of_variant("value").alias("type")).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(kind).alias("feed"), "field", "type", "n"
    )


def split_rejects(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(readable payloads, raw text of the others)."""
    good = df.where(F.col(REJECT_COLUMN).isNull()).drop(REJECT_COLUMN)
    bad = df.where(F.col(REJECT_COLUMN).isNotNull()).select(REJECT_COLUMN)
    return good, bad


def payload_kinds() -> list[str]:
    return sorted(PAYLOADS)
