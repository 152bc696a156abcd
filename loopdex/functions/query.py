"""Query syntax (I1), query mode (I2) and tag-clause predicates.

Syntax: ``"quoted phrases"``, ``tag:x`` / ``tag:"x y"`` (positive tag filter) and
``-tag:x`` / ``-tag:"x y"`` (exclusion); the rest is loose text. Extraction runs in
a fixed order, each match removed before the next pattern is applied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loopdex.functions.text import tokens, ws_trim

# Extraction patterns, applied in this order.
NEG_TAG_QUOTED = '-tag:"([^"]+)"'
NEG_TAG_BARE = "(?U)-tag:(\\S+)"
TAG_QUOTED = 'tag:"([^"]+)"'
TAG_BARE = "(?U)tag:(\\S+)"
PHRASE = '"([^"]+)"'


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _take(text: Column, pattern: str) -> tuple[Column, Column]:
    return F.regexp_extract_all(text, F.lit(pattern), 1), F.regexp_replace(text, pattern, "")


def parse_query(raw) -> Column:
    """STRUCT<phrases, loose, tags, neg_tags> from the raw query string."""
    r0 = F.coalesce(_c(raw), F.lit(""))
    neg_q, r1 = _take(r0, NEG_TAG_QUOTED)
    neg_b, r2 = _take(r1, NEG_TAG_BARE)
    tag_q, r3 = _take(r2, TAG_QUOTED)
    tag_b, r4 = _take(r3, TAG_BARE)
    phr, r5 = _take(r4, PHRASE)
    return F.struct(
        F.transform(phr, lambda p: ws_trim(p)).alias("phrases"),
        ws_trim(r5).alias("loose"),
        F.transform(F.concat(tag_q, tag_b), lambda t: F.lower(t)).alias("tags"),
        F.transform(F.concat(neg_q, neg_b), lambda t: F.lower(t)).alias("neg_tags"),
    )


def with_parsed(queries: DataFrame, raw_col: str = "raw") -> DataFrame:
    """Adds the parsed fields and the I2 mode columns to a queries DataFrame."""
    p = queries.withColumn("_pq", parse_query(raw_col))
    p = p.select("*", "_pq.phrases", "_pq.loose", "_pq.tags", "_pq.neg_tags").drop("_pq")
    has_loose = F.col("loose") != F.lit("")
    has_phrase = F.size("phrases") > 0
    has_tags = F.size("tags") > 0
    return p.withColumns(
        {
            "has_text": has_loose | has_phrase,
            "use_vector": has_loose,
            "mode": F.when(has_loose, F.lit("hybrid"))
            .when(has_phrase, F.lit("text"))
            .when(has_tags, F.lit("tags"))
            .otherwise(F.lit("all")),
            "tag_role": F.when(~has_tags, F.lit("none"))
            .when(has_loose | has_phrase, F.lit("filter"))
            .otherwise(F.lit("primary")),
        }
    )


def tag_clause_tokens(tag) -> Column:
    """Token list a tag clause must find inside one tag.

    A tag with a space is a phrase clause (analysed tokens); otherwise it is an
    un-analysed term, so punctuation inside it never matches a token.
    """
    t = _c(tag)
    return F.when(t.contains(" "), tokens(t)).otherwise(F.array(t))


def exclusion_clause_tokens(tag) -> Column:
    """Exclusion clauses are phrase queries on the analysed tag text."""
    return tokens(tag)


def tag_tokens(tags) -> Column:
    """Per-document token lists, one per tag (phrase matching never crosses tags)."""
    return F.coalesce(F.transform(_c(tags), lambda t: tokens(t)), F.array().cast("array<array<string>>"))


def tags_contain(tag_toks, clause_toks) -> Column:
    """Some tag's token list contains clause_toks contiguously (empty clause -> false)."""
    needle = F.concat(F.lit(" "), F.array_join(_c(clause_toks), " "), F.lit(" "))
    return (F.size(_c(clause_toks)) > 0) & F.exists(
        _c(tag_toks), lambda tt: F.concat(F.lit(" "), F.array_join(tt, " "), F.lit(" ")).contains(needle)
    )


def all_clauses_match(tag_toks, clauses) -> Column:
    """Conjunction of positive tag clauses (array<array<string>>); no clause -> true."""
    return F.forall(_c(clauses), lambda c: tags_contain(tag_toks, c))


def any_clause_matches(tag_toks, clauses) -> Column:
    """Disjunction of exclusion clauses; no clause -> false."""
    return F.exists(_c(clauses), lambda c: tags_contain(tag_toks, c))
