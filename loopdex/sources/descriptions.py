"""A2/A4: JSON-lines description records, quarantine of bad lines, done-id sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loopdex.functions.text import action_text

# Typed projection of a description record: (field, spark type, required variant kind)
STRING_FIELDS = ("id", "url", "attribution", "original_description", "literal", "source", "mood", "context")


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    from loopdex.sources.captions import read_lines

    return read_lines(spark, path)


def parse_descriptions(lines: DataFrame, text_col: str = "line", keep: tuple[str, ...] = ()) -> DataFrame:
    """Parse every line into a VARIANT, then project typed fields.

    A line is rejected (``reject`` not null) when it is not JSON, not an object, or a
    field has the wrong JSON type (string fields must be strings or null, tags an array
    of strings). ``from_json`` would silently coerce such values; the variant kind
    check keeps the strict behaviour.
    """
    from loopdex.operators.util import spread

    # As a generator's output, the value is made once a line and after the spreading: filters on what is read from it would
    # else be moved below the exchange, with a parse for each field, to the few tasks of the scan.
    v = spread(lines, "line_no").select("*", F.explode(F.array(F.try_parse_json(F.col(text_col)))).alias("_v"))
    kinds = {f: F.schema_of_variant(F.try_variant_get("_v", f"$.{f}", "variant")) for f in STRING_FIELDS}
    tag_kind = F.schema_of_variant(F.try_variant_get("_v", "$.tags", "variant"))
    bad_field = F.lit(None).cast("string")
    for f, k in reversed(list(kinds.items())):
        bad_field = F.when(k.isNotNull() & ~k.isin("STRING", "VOID"), F.lit(f"type:{f}")).otherwise(bad_field)
    bad_tags = tag_kind.isNotNull() & ~tag_kind.isin("ARRAY<STRING>", "ARRAY<VOID>", "VOID")
    reject = (F.when(F.col("_v").isNull(), F.lit("json"))
              .when(~(F.schema_of_variant("_v").startswith("OBJECT<") | (F.schema_of_variant("_v") == "VOID")),
                    F.lit("not_object"))
              .when(bad_tags, F.lit("type:tags"))
              .otherwise(bad_field))
    out = v.withColumn("reject", reject)
    cols = [F.try_variant_get("_v", f"$.{f}", "string").alias(f) for f in STRING_FIELDS]
    action_v = F.try_variant_get("_v", "$.action", "variant")
    return out.select(
        "line_no", "reject", *cols,
        action_text(action_v).alias("action"),
        F.try_variant_get("_v", "$.tags", "array<string>").alias("tags"),
        *keep,
    )


def good(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reject").isNull()).drop("reject")


def quarantine(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reject").isNotNull()).select("line_no", "reject")


def done_keys(lines: DataFrame, key: str, strict: bool = False, text_col: str = "line") -> DataFrame:
    """A4: distinct keys already in an output JSONL.

    Tolerant (manifest flavour): bad lines and missing keys are ignored. Strict (caption
    flavour): a bad line or missing key raises when the plan runs (ANSI cast error).
    """
    v = F.try_parse_json(F.col(text_col))
    k = F.try_variant_get(v, f"$.{key}", "string")
    if strict:
        k = F.coalesce(k, F.raise_error(F.concat(F.lit("bad output line: "), F.col(text_col))))
        return lines.select(k.alias(key)).distinct()
    return lines.select(k.alias(key)).where(F.col(key).isNotNull()).distinct()
