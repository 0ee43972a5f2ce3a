"""JSON records in and out: {"type", "data"} for nodes, {"edge", "from", "to", "data"} for edges."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.schema import Catalog, EntityType, PropType
from ..storage import cut

ENVELOPE = "type string, edge string, `from` string, `to` string, data string"
FIELDS = ["type", "edge", "from", "to", "data"]


class RecordError(ValueError):
    """A record that can't be loaded."""


#: of a strict source: bytes of a line, and how deep its values may be nested
LINE_LIMIT, DEPTH_LIMIT = 32 << 20, 128


def read_records(spark: SparkSession, path: str, pretty: bool = False) -> DataFrame:
    """value: one JSON text a row.  pretty: values may span lines and follow each other; a file is then read whole by one task."""
    if not pretty:
        lines = spark.read.text(path).where(F.trim("value") != "")
        # a line over the limit goes no further than this scan
        return lines.select(F.when(F.octet_length("value") > LINE_LIMIT, F.raise_error(F.concat(F.lit("a line has more than "), F.lit(LINE_LIMIT), F.lit(" bytes")))).otherwise(F.col("value")).alias("value"))

    def split(batches: Iterator) -> Iterator:
        import json

        import pandas as pd

        decoder = json.JSONDecoder()
        for batch in batches:
            out = []
            for text in batch["value"]:
                at = 0
                while at < len(text):
                    if text[at].isspace():
                        at += 1
                        continue
                    value, at = decoder.raw_decode(text, at)
                    out.append(json.dumps(value))
            yield pd.DataFrame({"value": out})

    return spark.read.text(path, wholetext=True).mapInPandas(split, "value string")


def _kind(json: Column, name: str) -> Column:
    """The type of a field of a JSON text, null where it is missing."""
    return F.schema_of_variant(F.variant_get(F.try_parse_json(json), f'$["{name}"]', "variant"))


def fits(kind: Column, p: PropType) -> Column:
    """Whether a JSON value of this type (as schema_of_variant names it) may become a property: no text as a number, no number or boolean as text."""
    whole, number, text = kind.rlike("^(BIGINT|DECIMAL\\([0-9]+,0\\))$"), kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), kind == "STRING"
    if p.list or p.scalar == "Vector":
        one = PropType("F32") if p.scalar == "Vector" else PropType(p.scalar)
        item = F.regexp_extract(kind, "^ARRAY<(.*)>$", 1)
        return kind.startswith("ARRAY<") & ((item == "VOID") | fits(item, one))
    if p.scalar in ("I32", "I64", "U32", "U64"):
        return whole
    if p.scalar in ("F32", "F64"):
        return number
    if p.scalar == "Bool":
        return kind == "BOOLEAN"
    if p.scalar in ("Date", "DateTime"):
        return text | whole
    return text


def typed(raw: Column, p: PropType) -> Column:
    """A JSON value's text as its property's type; null where it doesn't fit."""
    if p.list or p.scalar == "Vector":
        item = p.spark.elementType.simpleString()
        if p.scalar in ("Date", "DateTime"):
            one = PropType(p.scalar)
            return F.transform(F.from_json(raw, "array<string>"), lambda x: typed(x, one))
        return F.from_json(raw, f"array<{item}>")
    if p.scalar == "Date":
        return F.when(raw.rlike("^-?[0-9]+$"), F.date_from_unix_date(raw.try_cast("int"))).otherwise(raw.try_cast("date"))
    if p.scalar == "DateTime":
        return F.when(raw.rlike("^-?[0-9]+$"), F.timestamp_millis(raw.try_cast("long"))).otherwise(raw.try_cast("timestamp"))
    if p.scalar == "Blob":
        return F.when(raw.startswith("base64:"), F.try_to_binary(F.substring(raw, F.lit(8), F.length(raw)), F.lit("base64")))
    return raw.try_cast(p.spark)


def canonical(c: Column, p: PropType) -> Column:
    """A key value as text: dates in days, times in milliseconds, zero without a sign."""
    if p.scalar == "Date":
        return F.unix_date(c).cast("string")
    if p.scalar == "DateTime":
        return F.unix_millis(c).cast("string")
    if p.scalar in ("F32", "F64"):
        return F.when(c == 0, "0").otherwise(c.cast("string"))
    return c.cast("string")


def derived_id(t: EntityType) -> Column | None:
    """The id that a keyed type's rows have by their key; composite keys are a JSON array."""
    if not t.key:
        return None
    parts = [canonical(F.col(f"`{k}`"), t.props[k]) for k in t.key]
    return parts[0] if len(parts) == 1 else F.to_json(F.array(*parts))


def _depth(value: Column) -> Column:
    """How deep the brackets of a JSON text are nested, those in strings left out."""
    brackets = F.regexp_replace(value, '"(?:[^"\\\\]|\\\\.)*+"|[^\\[\\]{}]', "")
    step = lambda a, c: F.when(c.isin("[", "{"), F.struct((a["now"] + 1).alias("now"), F.greatest(a["most"], a["now"] + 1).alias("most"))).otherwise(F.struct((a["now"] - 1).alias("now"), a["most"].alias("most")))
    return F.aggregate(F.filter(F.split(brackets, ""), lambda c: c != ""), F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda a: a["most"])


#: the name under which records that can't be loaded are kept
BAD = "!"


def envelopes(records: DataFrame, catalog: Catalog) -> DataFrame:
    """name: the type, or BAD; from, to, data; value and why, where a record is no envelope, names an unknown type, or has unknown properties."""
    allowed = F.create_map(*[x for n, t in catalog.types.items() for x in (F.lit(n), F.array(*map(F.lit, ["id", *t.props])))])
    nodes, edges = [n for n, t in catalog.types.items() if t.kind == "node"], [n for n, t in catalog.types.items() if t.kind == "edge"]
    name, none = F.coalesce("type", "edge"), F.array().cast("array<string>")
    # each is parsed once: what is used several times is not folded into its uses
    parsed = records.select("value", F.from_json("value", ENVELOPE).alias("r"), F.json_object_keys("value").alias("keys"))
    parsed = parsed.select("value", "keys", *[F.col(f"r.`{c}`").alias(c) for c in FIELDS], F.when(F.col("r.edge").isNotNull(), F.try_parse_json("value")).alias("whole"))
    parsed = parsed.withColumn("props", F.coalesce(F.json_object_keys("data"), none))
    is_text = lambda c: F.coalesce(F.schema_of_variant(F.variant_get("whole", f"$.{c}", "variant")) == "STRING", F.lit(True))
    why = (
        F.when(F.col("keys").isNull() | (F.size(F.array_except("keys", F.array(*map(F.lit, FIELDS)))) > 0), "no record")
        .when(F.col("type").isNotNull() == F.col("edge").isNotNull(), "a record is a node or an edge")
        .when(F.col("type").isNotNull() & ~F.col("type").isin(*nodes), "unknown type")
        .when(F.col("edge").isNotNull() & ~F.col("edge").isin(*edges), "unknown type")
        .when(F.col("edge").isNotNull() & (F.col("from").isNull() | F.col("to").isNull()), "an edge needs from and to")
        .when(F.col("edge").isNotNull() & (~is_text("from") | ~is_text("to")), "from and to are texts")
        .when(F.size("keys") > F.size(F.array_distinct("keys")), "a field is given twice")
        .when((F.length("value") - F.length(F.translate("value", "[{", "")) > DEPTH_LIMIT) & (_depth(F.col("value")) > DEPTH_LIMIT), "nested too deep")
        .when(F.size("props") > F.size(F.array_distinct("props")), "a property is given twice")
        .when(F.size(F.array_except("props", F.element_at(allowed, name))) > 0, "unknown property")
    )
    judged = parsed.select("value", "from", "to", "data", name.alias("name"), why.alias("why"))
    bad = F.col("why").isNotNull()
    return judged.select("from", "to", "data", F.when(bad, F.col("value")).alias("value"), "why", F.when(bad, F.lit(BAD)).otherwise(F.col("name")).alias("name"))


def staged(records: DataFrame, catalog: Catalog) -> DataFrame:
    """The envelopes, written once, in a folder for each type; the records are spread first, as a few files may hold them all.  Raises for the first that can't be loaded."""
    found = cut(envelopes(records.hint("rebalance", "value"), catalog), "name")
    bad = found.where(F.col("name") == BAD).head(1)
    if bad:
        raise RecordError(f"{bad[0].why}: {bad[0].value[:200]}")
    return found


def entities(found: DataFrame, t: EntityType) -> DataFrame:
    """id, (src, dst,) properties of one type's records, and _wrong: a property whose value has another type."""
    mine = found.where(F.col("name") == t.name)
    names = ["id", *t.props]
    mine = mine.select(F.col("from").alias("src"), F.col("to").alias("dst"), F.from_json("data", ", ".join(f"`{n}` string" for n in names)).alias("d"), "data")
    cols = {n: F.when(fits(_kind(F.col("data"), n), p), typed(F.col(f"d.`{n}`"), p)) for n, p in t.props.items()}
    wrong = F.coalesce(*[F.when(F.col(f"d.`{n}`").isNotNull() & c.isNull(), F.lit(n)) for n, c in cols.items()], F.lit(None).cast("string"))
    ends = ["src", "dst"] if t.kind == "edge" else []
    out = mine.select(F.col("d.id").alias("given"), *ends, *[c.alias(n) for n, c in cols.items()], wrong.alias("_wrong"))
    own = derived_id(t)
    made = F.coalesce("given", F.expr("replace(uuid(), '-', '')")) if own is None else own
    bad_id = F.lit(False) if own is None else F.col("given").isNotNull() & (F.col("given") != made)
    return out.select(made.alias("id"), *ends, *[F.col(f"`{n}`") for n in t.props], F.when(bad_id, F.lit("id")).otherwise(F.col("_wrong")).alias("_wrong"))


def to_records(df: DataFrame, t: EntityType) -> DataFrame:
    """value: a type's rows as records, blobs as base64 text."""
    props = [(F.concat(F.lit("base64:"), F.base64(n)) if p.scalar == "Blob" else F.col(f"`{n}`")).alias(n) for n, p in t.props.items()]
    data = F.struct(F.col("id"), *props).alias("data")
    head = [F.lit(t.name).alias("type")] if t.kind == "node" else [F.lit(t.name).alias("edge"), F.col("src").alias("from"), F.col("dst").alias("to")]
    return df.select(F.to_json(F.struct(*head, data)).alias("value"))
