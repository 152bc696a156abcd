"""Unpivot a document into ordered (section, position, field, label, value) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loopdex import config as C


def field_label(key: str) -> str:
    """Table label, else '_' -> ' ' and the first letter of every word upper-cased
    (the rest of the word is kept, unlike SQL initcap)."""
    if key in C.DETAIL_LABELS:
        return C.DETAIL_LABELS[key]
    import re

    return re.sub(r"\b\w", lambda m: m.group(0).upper(), key.replace("_", " "))


def _value(df: DataFrame, key: str):
    dt = df.schema[key].dataType
    col = F.col(key)
    if isinstance(dt, T.ArrayType):
        return F.array_join(col.cast("array<string>"), ", ", "")
    if isinstance(dt, (T.StructType, T.MapType, T.VariantType)):
        return F.to_json(col)
    return col.cast("string")


def detail_fields(docs: DataFrame, id_col: str = "doc_id", internal: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Rows for every shown field: AI fields in order, originals (``description``
    hidden when ``original_description`` is non-empty), unknown keys, then the first
    non-empty timestamp key. Null and '' values are skipped; hidden keys never shown.
    The field list is resolved from the schema once; rows are produced by one explode."""
    cols = [c for c in docs.columns if c not in internal]
    key_of = {c: ("id" if c == id_col else c) for c in cols}
    present = {key_of[c]: c for c in cols}
    entries = []

    def add(section, pos, key, cond=None):
        c = present[key]
        v = _value(docs, c)
        ok = F.col(c).isNotNull() & (v != F.lit("") if not isinstance(docs.schema[c].dataType, T.ArrayType) else F.lit(True))
        if cond is not None:
            ok = ok & cond
        entries.append(F.when(ok, F.struct(F.lit(section).alias("section"), F.lit(pos).alias("position"),
                                           F.lit(key).alias("field"), F.lit(field_label(key)).alias("label"),
                                           v.alias("value"))))

    for i, k in enumerate(C.DETAIL_AI_FIELDS):
        if k in present:
            add(1, i, k)
    for i, k in enumerate(C.DETAIL_ORIGINAL_FIELDS):
        if k in present:
            cond = None
            if k == "description" and "original_description" in present:
                od = F.col(present["original_description"])
                cond = od.isNull() | (od == F.lit(""))
            add(2, i, k, cond)
    explicit = set(C.DETAIL_AI_FIELDS) | set(C.DETAIL_ORIGINAL_FIELDS) | set(C.DETAIL_HIDDEN_FIELDS) | set(C.DETAIL_TIMESTAMP_KEYS)
    for i, k in enumerate(sorted(k for k in present if k not in explicit)):
        add(3, i, k)
    ts = [present[k] for k in C.DETAIL_TIMESTAMP_KEYS if k in present]
    if ts:
        first_ts = F.coalesce(*[F.nullif(F.col(c).cast("string"), F.lit("")) for c in ts])
        entries.append(F.when(first_ts.isNotNull(), F.struct(F.lit(4).alias("section"), F.lit(0).alias("position"),
                                                              F.lit("timestamp").alias("field"), F.lit("Retrieved At").alias("label"),
                                                              first_ts.alias("value"))))
    return docs.select(F.col(id_col).alias(id_col), F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("e")
                       ).select(id_col, "e.*")


def _empty(v):
    """Is a VARIANT null or an empty string?"""
    return v.isNull() | F.is_variant_null(v) | F.coalesce(F.try_variant_get(v, "$", "string") == F.lit(""), F.lit(False))


def _text(v):
    """A VARIANT as it is shown: arrays joined by ', ', objects as JSON, anything else as its text."""
    one = lambda x: F.when(x.isNull() | F.is_variant_null(x), F.lit("")).when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")).otherwise(F.to_json(x))
    return F.when(F.schema_of_variant(v).startswith("ARRAY"), F.array_join(F.transform(F.try_variant_get(v, "$", "array<variant>"), one), ", ")).otherwise(one(v))


def _label(key):
    """``field_label`` as a column, for keys that are only known at run time."""
    known = F.create_map(*[F.lit(x) for pair in C.DETAIL_LABELS.items() for x in pair])
    words = F.split(F.replace(key, F.lit("_"), F.lit(" ")), "(?<=[^A-Za-z0-9])|(?<=^)(?=.)")
    upper = F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30)))
    return F.coalesce(F.element_at(known, key), F.array_join(upper, ""))


def detail_open(docs: DataFrame, fields: str, id_col: str = "doc_id") -> DataFrame:
    """C22 for open documents: (id_col, section, position, field, label, value) of ``fields``, a MAP<STRING, VARIANT> a
    document, by the rules of ``detail_fields``. Keys are read from the rows; unknown ones are shown in order of name."""
    fixed = {**{k: (1, i) for i, k in enumerate(C.DETAIL_AI_FIELDS)}, **{k: (2, i) for i, k in enumerate(C.DETAIL_ORIGINAL_FIELDS)}}
    explicit = [*fixed, *C.DETAIL_HIDDEN_FIELDS, *C.DETAIL_TIMESTAMP_KEYS]
    shown = docs.select(F.col(id_col), F.map_filter(fields, lambda _, v: ~_empty(v)).alias("_m"))
    shown = shown.withColumns({
        "_ts": F.coalesce(*[F.when(F.map_contains_key("_m", F.lit(k)), F.lit(k)) for k in C.DETAIL_TIMESTAMP_KEYS]),
        "_original": F.map_contains_key("_m", F.lit("original_description")),
        "_unknown": F.array_sort(F.filter(F.map_keys("_m"), lambda k: ~k.isin(explicit))),
    })
    rows = shown.select(id_col, "_ts", "_original", "_unknown", F.explode("_m").alias("key", "v"))
    place = F.create_map(*[x for k, (a, b) in fixed.items() for x in (F.lit(k), F.struct(F.lit(a).alias("section"), F.lit(b).alias("position")))])
    unknown = F.array_position("_unknown", F.col("key"))
    at = F.coalesce(F.element_at(place, F.col("key")), F.when(F.col("key") == F.col("_ts"), F.struct(F.lit(4).alias("section"), F.lit(0).alias("position"))),
                    F.when(unknown > 0, F.struct(F.lit(3).alias("section"), (unknown - 1).cast("int").alias("position"))))
    rows = rows.withColumn("at", at).where(F.col("at").isNotNull() & ~((F.col("key") == "description") & F.col("_original")))
    stamp = F.col("at.section") == 4
    return rows.select(id_col, "at.section", "at.position", F.when(stamp, F.lit("timestamp")).otherwise(F.col("key")).alias("field"),
                       F.when(stamp, F.lit("Retrieved At")).otherwise(_label(F.col("key"))).alias("label"), _text(F.col("v")).alias("value"))
