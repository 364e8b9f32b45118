"""Landed API responses: envelope unwrap, key filter, struct flatten, schema evolution.

A landed response is one JSON document: a bare array of records, or an object
with the records under ``items`` (preferred when non-empty) or ``result``.
Everything is parsed on the executors; no record passes through the driver. One JSON parse
of a body takes it apart into its records' fields, each as the text it was sent as. Text
fields are these texts. A nested field becomes a VARIANT once, of which the declared leaves
are read by path: a leaf that was sent with another type than declared is read as what it
spells, or is NULL, and never breaks the record.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructField, StructType

SEP = "__"  # one nesting level in a flattened column name


#: Column with the declared fields of a record as they were sent (a struct of JSON texts).
RAW = "_raw"
#: Column with the whole record as it was sent, undeclared fields included (a VARIANT).
RECORD = "_record"
_BROKEN = "_broken"


def _env(record_schema: StructType | None) -> StructType:
    """The envelope, its records as structs of texts (or not looked into)."""
    fields = record_schema.fields if record_schema else []
    texts = ArrayType(StructType([StructField(f.name, StringType()) for f in fields]) if fields else StringType())
    return StructType([StructField("items", texts), StructField("result", texts), StructField(_BROKEN, StringType())])


def _parsed(bodies: DataFrame, body_col: str, record_schema: StructType | None = None) -> DataFrame:
    """``body`` and ``env``: the envelope with its records, one JSON parse per body."""
    body = F.col(body_col)
    # a bare array is parsed as {"items": [...]}
    as_env = F.when(F.ltrim(body).startswith("["), F.concat(F.lit('{"items":'), body, F.lit("}"))).otherwise(body)
    return bodies.select(body.alias("body"), F.from_json(as_env, _env(record_schema), {"columnNameOfCorruptRecord": _BROKEN}).alias("env"))


def _leaf(sent: Column, path: str, dtype: DataType) -> Column:
    """A declared field of a VARIANT, by its path; a struct is NULL where nothing was sent."""
    if not isinstance(dtype, StructType):
        return F.try_variant_get(sent, path, dtype.simpleString())
    there = sent if path == "$" else F.try_variant_get(sent, path, "variant")
    return F.when(there.isNotNull() & ~F.is_variant_null(there),
                  F.struct(*[_leaf(sent, f"{path}.{f.name}", f.dataType).alias(f.name) for f in dtype.fields]))


def _typed(rows: DataFrame, record_schema: StructType) -> DataFrame:
    """Records (``RAW``) in their declared types; each nested field is parsed once."""
    nested = [f for f in record_schema.fields if not isinstance(f.dataType, StringType)]
    variants = rows.select("*", *[F.try_parse_json(F.col(RAW).getField(f.name)).alias(f"_sent_{f.name}") for f in nested])
    cols = [_leaf(F.col(f"_sent_{f.name}"), "$", f.dataType) if f in nested else F.col(RAW).getField(f.name)
            for f in record_schema.fields]
    return variants.select(*[c.alias(f.name) for c, f in zip(cols, record_schema.fields, strict=True)],
                           *[c for c in rows.columns])


def _is_broken() -> Column:
    return F.col("body").isNull() | F.col("env").isNull() | F.col(f"env.{_BROKEN}").isNotNull()


def broken_bodies(bodies: DataFrame, body_col: str = "body", record_schema: StructType | None = None) -> DataFrame:
    """The response bodies that cannot be taken apart, to be kept aside and counted."""
    return _parsed(bodies, body_col, record_schema).filter(_is_broken()).select("body")


def unwrap_envelopes(bodies: DataFrame, record_schema: StructType, body_col: str = "body", on_broken: str = "fail",
                     keep_raw: bool = False, keep_record: bool = False) -> DataFrame:
    """One row per record found in the response bodies of ``bodies[body_col]``.

    * text starting with ``[`` -> the array itself
    * an object -> ``items`` if it has at least one element, else ``result``,
      else nothing (an empty ``items`` falls through to ``result``)
    * a body that is no complete JSON document, or has an element that is neither an object nor
      null, fails the read, or, with ``on_broken="skip"``, is left to ``broken_bodies``

    ``keep_raw`` adds the record's declared fields as they were sent (``RAW``), ``keep_record``
    all of it (``RECORD``), which takes a second parse.
    """
    if on_broken not in ("fail", "skip"):
        raise ValueError(f"on_broken: {on_broken}")
    parsed = _parsed(bodies, body_col, record_schema)
    items, result = F.col("env.items"), F.col("env.result")
    if keep_record:
        whole = F.try_parse_json("body")
        bare, named = (F.try_variant_get(whole, p, "array<variant>") for p in ("$", "$.items"))
        of_items = F.coalesce(F.when(F.ltrim("body").startswith("["), bare), named)
        items = F.arrays_zip(items.alias(RAW), of_items.alias(RECORD))
        result = F.arrays_zip(result.alias(RAW), F.try_variant_get(whole, "$.result", "array<variant>").alias(RECORD))
    else:
        items, result = (F.transform(c, lambda r: F.struct(r.alias(RAW))) for c in (items, result))
    records = F.when(F.size("env.items") > 0, items).when(F.size("env.result") > 0, result)
    if on_broken == "skip":
        parsed = parsed.filter(~_is_broken())
    else:
        told = F.raise_error(F.concat(F.lit("broken response body: "), F.coalesce(F.substring("body", 1, 80), F.lit("NULL"))))
        kind = f"array<struct<{RAW}:{_env(record_schema)['items'].dataType.elementType.simpleString()}" + (f",{RECORD}:variant" if keep_record else "") + ">>"
        records = F.when(_is_broken(), told.cast(kind)).otherwise(records)
    rows = parsed.select(F.inline(records))
    out = _typed(rows, record_schema)
    return out if keep_raw else out.drop(RAW)


def landed_bodies(spark: SparkSession, path: str, per_line: bool = False) -> DataFrame:
    """The response bodies of a landed fetch: one JSON document per file (an API response
    page; ``wholetext`` keeps a page in one task while pages are parsed in parallel), or, with
    ``per_line``, one per line, split like any text file."""
    return spark.read.text(path, wholetext=not per_line).withColumnRenamed("value", "body")


def read_landed(spark: SparkSession, path: str, record_schema: StructType, per_line: bool = False,
                on_broken: str = "fail", keep_raw: bool = False, keep_record: bool = False) -> DataFrame:
    """Read landed responses and unwrap them."""
    return unwrap_envelopes(landed_bodies(spark, path, per_line), record_schema, on_broken=on_broken, keep_raw=keep_raw,
                            keep_record=keep_record)


def keyed_records(records: DataFrame, key: str = "_id") -> DataFrame:
    """Drop records without a usable key (NULL record, NULL or empty key)."""
    k = F.col(key)
    return records.filter(k.isNotNull() & (k != F.lit("")))


def _leaves(dtype, path: list[str]):
    if isinstance(dtype, StructType):
        for field in dtype.fields:
            yield from _leaves(field.dataType, path + [field.name])
    else:
        yield path


def _path_col(path: list[str]) -> Column:
    c = F.col(f"`{path[0]}`")
    for part in path[1:]:
        c = c.getField(part)
    return c


def flatten_struct(df: DataFrame, sep: str = SEP) -> DataFrame:
    """Flatten nested structs into top-level columns named ``a__b__c``.

    Schema-driven (a projection only); a NULL parent struct gives NULL leaves.
    Arrays and maps are kept as they are.
    """
    cols = [_path_col(p).alias(sep.join(p)) for f in df.schema.fields for p in _leaves(f.dataType, [f.name])]
    return df.select(*cols)


def append_evolve(*batches: DataFrame) -> DataFrame:
    """Append batches whose columns differ: match by name, missing columns become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), batches)


def envelope_bodies(records: DataFrame, shape: Column) -> DataFrame:
    """Wrap each record in a response body; ``shape`` picks the envelope per row:
    0 bare array, 1 ``items``, 2 ``result``, 3 empty ``items`` with filled ``result``."""
    rec = F.to_json(F.array(F.struct(*[F.col(f"`{c}`") for c in records.columns])))
    body = (
        F.when(shape == 0, rec)
         .when(shape == 1, F.concat(F.lit('{"items":'), rec, F.lit("}")))
         .when(shape == 2, F.concat(F.lit('{"result":'), rec, F.lit("}")))
         .otherwise(F.concat(F.lit('{"items":[],"result":'), rec, F.lit("}")))
    )
    return records.select(body.alias("body"))
