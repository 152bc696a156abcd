"""Quality rules as weak supervision: rules vote good, bad or abstain; EM estimates how accurate each rule is in either
class; a document's posterior probability of being good replaces "all rules must pass".

Every rule has, for good and for bad documents, the probabilities of its three answers (Dawid and Skene), so a rule that
is silent on most bad documents can still be trusted where it speaks. EM starts from the rules' agreement (the share of
good votes among the votes cast), which also fixes which class is which, and stops where nothing moves any more. The
probabilities are smoothed by one vote of each kind and not bounded otherwise. Rules look at what the base test doesn't:
symbols, words that aren't plain, word and line shapes, and weaker repetition than the base test bears.

Main path: DataFrame functions only. Per text, every measure is an expression over that row (no shuffle of words).
The only shuffle is the count of vote patterns, at most 3 ** rules rows; EM is one expression over these, all its rounds
included, and its result becomes the literals of the verdicts.

Edge cases: a null or empty text has zero words, all rules abstain on it and it fails the base test; repeated rows each
get their own result; an empty table gives an empty result; any extra columns of the input are ignored by the query and
kept by ``judge`` (columns of the same name as a measure, and ``_w``, ``_h`` and ``_l``, are replaced or dropped).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loopdex.llm.common import SPACE, SPACE_CHARS, words, written

SYMBOLS = "#*$%&|<>"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Further measures that only the rules use.
RULE_MEASURES = ["n_lines", "n_ended_lines", "n_plain_words", "n_distinct_words"]

#: name -> (condition of a bad vote, condition of a good vote) over the measures; neither holds: the rule abstains.
RULES = {
    "vote_symbols": ("10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    "vote_plain_words": ("2 * n_plain_words < n_words", "10 * n_plain_words >= 7 * n_words"),
    "vote_word_size": ("word_chars < 3 * n_words OR word_chars > 7 * n_words", "word_chars >= 4 * n_words AND word_chars <= 6 * n_words"),
    "vote_line_ends": ("100 * n_ended_lines < 85 * n_lines", "100 * n_ended_lines >= 97 * n_lines"),
    "vote_dup_lines": ("10 * n_dup_lines > n_lines", "50 * n_dup_lines <= n_lines"),
    "vote_repeats": ("100 * n_repeat_words > 20 * n_words", "100 * n_repeat_words <= 5 * n_words"),
    "vote_distinct": ("100 * n_distinct_words < 30 * n_words", "100 * n_distinct_words >= 50 * n_words"),
}
#: A word of letters, with the punctuation after it.
PLAIN = r"\p{L}+[.,;:!?]*"
ANSWERS = (-1, 0, 1)
#: EM ends when no weight moves by more; MOST_ROUNDS only guards against a table on which it never would.
STILL, MOST_ROUNDS = 1e-12, 200
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


def _let(value: Column, body) -> Column:
    """body(value) with value computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered(h: Column) -> Column:
    """Words covered by windows of three whose hash occurs more than once in h."""

    def marked(s: Column) -> Column:
        m = F.size(s)
        nothing = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
        before, after = F.concat(nothing, F.slice(s, 1, m - 1)), F.concat(F.slice(s, 2, m - 1), nothing)
        near = F.zip_with(before, after, lambda a, b: F.struct(a["h"].alias("a"), b["h"].alias("b")))
        at = F.zip_with(s, near, lambda x, y: F.when((x["h"] == y["a"]) | (x["h"] == y["b"]), x["i"]))
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("n"))
        step = lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).cast("bigint").alias("n"))
        return F.aggregate(F.sort_array(F.filter(at, lambda p: p.isNotNull())), start, step, lambda acc: acc["n"])

    pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(_let(pairs, marked))


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """df with MEASURES and RULE_MEASURES; windows of three words are compared by 64-bit hashes."""
    df = df.drop(*MEASURES, *RULE_MEASURES, "_w", "_h", "_l")
    t = F.coalesce(F.col(text), F.lit(""))
    w = F.col("_w")
    n = F.size(w)
    solid = F.filter(F.split(t, "\n"), lambda line: line.rlike(f"[^{SPACE}]"))
    df = df.withColumns({"_w": words(F.col(text)), "_l": solid})
    pair = F.zip_with(F.slice(w, 1, n - 2), F.slice(w, 2, n - 2), lambda a, b: F.xxhash64(a, b))
    windows = F.zip_with(pair, F.slice(w, 3, n - 2), lambda a, b: F.xxhash64(a, b))
    df = df.withColumn("_h", F.when(n >= 3, windows).otherwise(F.array().cast("array<bigint>")))
    lines = F.col("_l")
    ended = F.filter(lines, lambda line: line.rlike(rf"[.!?:;\"'\)]+[{SPACE}]*$"))
    long = {
        "n_words": F.size("_w"),
        "word_chars": F.length(F.translate(t, SPACE_CHARS, "")),
        "n_symbols": F.length(t) - F.length(F.translate(t, SYMBOLS, "")),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": _covered(F.col("_h")),
        "n_lines": F.size(lines),
        "n_ended_lines": F.size(ended),
        "n_plain_words": F.size(F.filter(w, lambda x: x.rlike(rf"\A{PLAIN}\z"))),
        "n_distinct_words": F.size(F.array_distinct(w)),
    }
    return df.withColumns({k: v.cast("long") for k, v in long.items()}).drop("_w", "_h", "_l")


def voted(df: DataFrame) -> DataFrame:
    """df with a column a rule: -1 bad, 1 good, 0 abstains (bad wins where both conditions hold)."""
    return df.withColumns({k: F.when(F.col("n_words") == 0, 0).when(F.expr(bad), -1).when(F.expr(good), 1).otherwise(0) for k, (bad, good) in RULES.items()})


#: The posterior that EM starts from: the share of good votes among those cast.
AGREEMENT = f"(CAST(0.5 AS DOUBLE) + {' + '.join(f'greatest({k}, 0)' for k in RULES)}) / (1 + {' + '.join(f'abs({k})' for k in RULES)})"


def posterior(prior: float, weights: dict[str, dict[int, float]]) -> str:
    """SQL of the probability that a row is good, from its votes; weights: of each rule's answers, the log of how much
    likelier they are from a good document."""
    votes = [f"CASE {k} " + " ".join(f"WHEN {v} THEN {w!r}" for v, w in answers.items()) + " END" for k, answers in weights.items()]
    return f"1 / (1 + exp(-({' + '.join([repr(math.log(prior / (1 - prior))), *votes])})))"


def _learned(patterns: Column) -> Column:
    """What the patterns (n, x: one place an answer of each rule, 1 where it is theirs, q: probability of being good) say:
    the prior's log odds and the weight of each answer."""
    start = F.struct(F.lit(0.0).alias("good"), F.lit(0.0).alias("bad"), *[F.array_repeat(F.lit(0.0), len(RULES) * len(ANSWERS)).alias(c) for c in ("g", "b")])

    def add(s: Column, p: Column) -> Column:
        good, bad = p["n"] * p["q"], p["n"] * (1 - p["q"])
        return F.struct(
            (s["good"] + good).alias("good"), (s["bad"] + bad).alias("bad"),
            F.zip_with(s["g"], p["x"], lambda a, x: a + x * good).alias("g"), F.zip_with(s["b"], p["x"], lambda a, x: a + x * bad).alias("b"))

    def weights(s: Column) -> Column:
        weight = F.zip_with(s["g"], s["b"], lambda g, b: F.log((g + 1) / (s["good"] + 3)) - F.log((b + 1) / (s["bad"] + 3)))
        return F.struct(F.log((s["good"] + 1) / (s["bad"] + 1)).alias("odds"), weight.alias("w"))

    return _let(F.aggregate(patterns, start, add), weights)


def _judged(patterns: Column, state: Column) -> Column:
    """The patterns with the probabilities that a state (odds, w) gives them."""

    def one(p: Column) -> Column:
        logit = F.aggregate(F.zip_with(p["x"], state["w"], lambda x, w: x * w), state["odds"], lambda a, x: a + x)
        return F.struct(p["n"].alias("n"), p["x"].alias("x"), (1 / (1 + F.exp(-logit))).alias("q"))

    return F.transform(patterns, one)


def fit(votes: DataFrame) -> tuple[float, dict[str, dict[int, float]]]:
    """(prior, weights of each rule's answers) by EM over the vote patterns of all rows. The patterns, at most 3 ** rules, are
    one row, and all rounds one expression over it."""
    x = F.array(*[F.when(F.col(k) == v, 1.0).otherwise(0.0) for k in RULES for v in ANSWERS])
    rows = votes.groupBy(*RULES).agg(F.count("*").cast("double").alias("n"))
    rows = rows.select(F.struct(x.alias("x"), "n", F.expr(AGREEMENT).alias("q")).alias("p"))
    one = rows.agg(F.sort_array(F.collect_list("p")).alias("ps"))
    ps = F.transform("ps", lambda p: F.struct(p["n"].alias("n"), p["x"].alias("x"), p["q"].alias("q")))
    one = one.select(ps.alias("ps"))

    def step(s: Column) -> Column:
        def moved(new: Column) -> Column:
            apart = F.array_max(F.zip_with(s["w"], new["w"], lambda a, b: F.abs(a - b)))
            return F.struct(new["odds"].alias("odds"), new["w"].alias("w"), F.greatest(apart, F.abs(s["odds"] - new["odds"])).alias("moved"))

        return _let(_learned(_judged(F.col("ps"), s)), moved)

    first = _let(_learned(F.col("ps")), lambda s: F.struct(s["odds"].alias("odds"), s["w"].alias("w"), F.lit(float("inf")).alias("moved")))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(MOST_ROUNDS)), first, lambda s, _: F.when(s["moved"] <= STILL, s).otherwise(step(s)))
    got = one.select(end.alias("end")).first()["end"]
    answers = [(k, v) for k in RULES for v in ANSWERS]
    weights: dict[str, dict[int, float]] = {k: {} for k in RULES}
    for (k, v), w in zip(answers, got["w"], strict=True):
        weights[k][v] = w
    return 1 / (1 + math.exp(-got["odds"])), weights


def judge(df: DataFrame, text: str = "text", keep: float = 0.5, drop: tuple[str, ...] = ()) -> DataFrame:
    """df, without the columns to drop, with the measures, votes, p_good, base_failed and kept (not base_failed and
    p_good >= keep). Measures and votes are written once, so texts are measured a single time for EM and verdicts."""
    df = written(voted(measured(df, text)).drop(*drop), "votes")
    prior, weights = fit(df.select(*RULES))
    failed = F.expr(BASE_FAILED)
    return df.withColumns({"p_good": F.expr(posterior(prior, weights)), "base_failed": failed}).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= keep))


def sql(rounds: int = 70) -> str:
    """DuckDB SQL of the query: the same measures and votes, EM unrolled for more rounds than it needs."""
    spaces = " || ".join(f"chr({ord(c)})" for c in SPACE_CHARS)
    marks = [f"CASE WHEN n_words = 0 THEN 0 WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END AS {k}" for k, (bad, good) in RULES.items()]
    names = ", ".join(RULES)
    answers = " UNION ALL ".join(f"SELECT id, '{k}' AS rule, {k} AS vote FROM g" for k in RULES)
    parts = [
        "d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents)",
        f"w AS (SELECT r, regexp_extract_all(t, '[^{SPACE}]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{SPACE}]')) AS ls FROM d)",
        "x AS (SELECT r, unnest(range(len(ws) - 2)) AS i, unnest(list_transform(range(1, len(ws) - 1), lambda k: list_slice(ws, k, k + 2))) AS g FROM w WHERE len(ws) >= 3)",
        "c AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS k FROM x) WHERE k > 1)",
        "p AS (SELECT r, sum(least(3, i - before)) AS n FROM (SELECT r, i, coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -3) AS before FROM c) GROUP BY r)",
        "m AS (SELECT d.r, doc_id, len(ws) AS n_words, length(translate(t, " + spaces + ", '')) AS word_chars,"
        f" length(t) - length(translate(t, '{SYMBOLS}', '')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words,"
        f" len(ls) AS n_lines, len(list_filter(ls, lambda x: regexp_matches(x, '[.!?:;\"''\\)]+[{SPACE}]*$'))) AS n_ended_lines,"
        f" len(list_filter(ws, lambda x: regexp_full_match(x, '{PLAIN}'))) AS n_plain_words, len(list_distinct(ws)) AS n_distinct_words"
        " FROM d JOIN w USING (r) LEFT JOIN p USING (r))",
        f"v AS MATERIALIZED (SELECT *, {', '.join(marks)} FROM m)",
        f"g AS MATERIALIZED (SELECT *, row_number() OVER () AS id FROM (SELECT {names}, count(*) AS n FROM v GROUP BY {names}))",
        f"a AS MATERIALIZED ({answers})",
        f"q0 AS MATERIALIZED (SELECT id, n, {AGREEMENT} AS q FROM g)",
    ]
    for i in range(rounds):
        parts += [
            f"s{i} AS MATERIALIZED (SELECT sum(n * q) AS good, sum(n * (1 - q)) AS bad FROM q{i})",
            f"t{i} AS MATERIALIZED (SELECT rule, vote, ln((sum(n * q) + 1) / (any_value(good) + 3)) - ln((sum(n * (1 - q)) + 1) / (any_value(bad) + 3)) AS w FROM a JOIN q{i} USING (id), s{i} GROUP BY ALL)",
            f"q{i + 1} AS MATERIALIZED (SELECT id, any_value(n) AS n, 1 / (1 + exp(-(any_value(ln((good + 1) / (bad + 1))) + sum(w)))) AS q FROM a JOIN t{i} USING (rule, vote) JOIN q{i} USING (id), s{i} GROUP BY id)",
        ]
    same = " AND ".join(f"v.{k} = g.{k}" for k in RULES)
    return (
        "WITH " + ", ".join(parts) + f" SELECT doc_id, {', '.join(MEASURES)}, base_failed, NOT base_failed AND p_good >= 0.5 AS kept, round(p_good, 6) AS p_good"
        f" FROM (SELECT v.*, ({BASE_FAILED}) AS base_failed, q AS p_good FROM v JOIN g ON {same} JOIN q{rounds} USING (id))"
    )
