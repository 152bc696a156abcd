"""Scalar text expressions: tokenising, URL normalisation, ids, payload cleaning.

Every function takes and returns ``Column`` objects so Catalyst can fold them into
one whole-stage-codegen projection.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loopdex import config as C

# JavaScript/Python ``trim``/``strip`` remove every Unicode space; Spark ``trim`` only
# removes U+0020, so a regex trim is used where the reference strips.
_WS_TRIM = "(?U)^\\s+|\\s+$"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def ws_trim(col) -> Column:
    return F.regexp_replace(_c(col), _WS_TRIM, "")


def tokens(col, pattern: str = "[\\p{L}\\p{N}]+") -> Column:
    """Analysed tokens: lower-cased runs of letters/digits (null text -> [])."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(col), F.lit(""))), F.lit(pattern), 0)


def rewrite_cdn(url) -> Column:
    """Rewrite the three old CDN hosts to the canonical one (all occurrences)."""
    out = _c(url)
    for host in C.CDN_HOSTS_OLD:
        out = F.replace(out, F.lit(host), F.lit(C.CDN_HOST_NEW))
    return out


def media_id(url) -> Column:
    """First media id in the URL, '' when absent."""
    return F.regexp_extract(_c(url), C.MEDIA_ID_PATTERN, 1)


def hash_doc_id(url) -> Column:
    """C3: 'gif_' + the first 8 bytes of MD5(url) as 16 lower-case hex digits."""
    return F.concat(F.lit(C.DOC_ID_PREFIX), F.substring(F.md5(_c(url)), 1, 16))


def doc_id(id_col, url) -> Column:
    """C4: the manifest id when non-empty, else the hashed URL."""
    return F.coalesce(F.nullif(_c(id_col), F.lit("")), hash_doc_id(url))


def action_text(action_variant) -> Column:
    """A string action as is, an array of strings joined by ', ', else ''.

    The input is a VARIANT; ``schema_of_variant`` tells a string from an array of
    strings from anything else (numbers, mixed arrays, objects, missing).
    """
    v = _c(action_variant)
    kind = F.schema_of_variant(v)
    as_arr = F.try_variant_get(v, "$", "array<string>")
    return (
        F.when(v.isNull(), F.lit(""))
        .when(kind == F.lit("STRING"), F.coalesce(F.try_variant_get(v, "$", "string"), F.lit("")))
        .when(kind == F.lit("VOID"), F.lit(""))
        .when(kind.isin("ARRAY<STRING>", "ARRAY<VOID>"), F.array_join(as_arr, ", ", ""))
        .otherwise(F.lit(""))
    )


def combined_text(literal, source, mood, action_str, context, tags) -> Column:
    """The flattened searchable text; empty fields keep their label."""
    lab = C.COMBINED_LABELS

    def s(x):
        return F.coalesce(_c(x), F.lit(""))

    tag_str = F.coalesce(F.array_join(_c(tags), ", ", ""), F.lit(""))
    return F.concat_ws(
        ". ",
        s(literal),
        F.concat(F.lit(lab[0]), s(source)),
        F.concat(F.lit(lab[1]), s(mood)),
        F.concat(F.lit(lab[2]), s(action_str)),
        F.concat(F.lit(lab[3]), s(context)),
        F.concat(F.lit(lab[4]), tag_str),
    )


def default_attribution(attribution, default: str | None) -> Column:
    """Own value if non-empty, else the default if non-empty, else null (absent)."""
    dflt = F.nullif(F.lit(default or ""), F.lit(""))
    return F.coalesce(F.nullif(_c(attribution), F.lit("")), dflt)


def clean_payload(text) -> Column:
    """C14: trim; a leading code fence drops the first and the last line unconditionally."""
    t = ws_trim(text)
    lines = F.split(t, "\n")
    n = F.size(lines)
    inner = F.when(n >= 3, F.array_join(F.slice(lines, 2, n - 2), "\n")).otherwise(F.lit(""))
    return F.when(t.startswith("```"), inner).otherwise(t)


def payload_is_object(variant) -> Column:
    """Parsed payload is a non-empty JSON object."""
    kind = F.schema_of_variant(_c(variant))
    return _c(variant).isNotNull() & kind.startswith("OBJECT<") & (kind != F.lit("OBJECT<>"))


def refine_query(raw, tag) -> Column:
    """Append `tag:x` (quoted when x has a space), no leading space on empty raw."""
    t = _c(tag)
    term = F.when(t.contains(" "), F.concat(F.lit('tag:"'), t, F.lit('"'))).otherwise(F.concat(F.lit("tag:"), t))
    r = F.coalesce(_c(raw), F.lit(""))
    return F.when(r == F.lit(""), term).otherwise(F.concat(r, F.lit(" "), term))
