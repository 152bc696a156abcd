"""The posterior decides: texts that pass the base test and that it rejects, and how it separates labelled documents."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from loopdex.llm import quality_rules as q

SF = "/root/testdata/sf0.01"


def texts(seed=2, good=300, junk=40):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeioulnrst") for _ in range(r.randint(3, 7)))
    line = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    rows = [(i, "\n".join(line(r.randint(8, 14)) for _ in range(r.randint(6, 12)))) for i in range(good)]
    rows += [(1000 + i, " | ".join(word() + r.choice(["###", "&&&", "42"]) for _ in range(r.randint(60, 120)))) for i in range(junk)]
    return rows + [(2000, ""), (2001, None), (2002, "too short")]


def test_planted_junk_passes_the_base_and_is_rejected(spark):
    got = {r.doc_id: r for r in q.judge(spark.createDataFrame(texts(), "doc_id long, text string")).collect()}
    assert not any(got[i].base_failed for i in (*range(300), *range(1000, 1040)))
    assert not any(got[i].kept for i in range(1000, 1040)) and all(got[i].p_good < 0.01 for i in range(1000, 1040))
    assert all(got[i].kept for i in range(300))
    assert all(got[i].base_failed and not got[i].kept for i in (2000, 2001, 2002))
    assert {got[2000][k] for k in q.RULES} == {0}  # no words, no votes


def test_fixpoint(spark):
    """EM ends at a fixpoint: another round moves nothing; every rule that votes both ways tells the classes apart."""
    votes = q.voted(q.measured(spark.createDataFrame(texts(5), "doc_id long, text string"))).select(*q.RULES)
    prior, weights = q.fit(votes)
    assert 0.8 < prior < 0.95  # nearer to the share of good texts than to any bound
    p = votes.withColumn("p", F.expr(q.posterior(prior, weights)))
    n, good = p.count(), p.agg(F.sum("p")).first()[0]
    assert (good + 1) / (n + 2) == pytest.approx(prior, abs=1e-9)
    assert weights["vote_symbols"][1] > 1 > -1 > weights["vote_symbols"][-1] and weights["vote_plain_words"][-1] < -1


def test_separates_labels_better_than_the_base(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality"), "doc_id", "left")
    got = q.judge(docs, drop=("text",)).where("quality IS NOT NULL").groupBy("quality", "base_failed", "kept").count().collect()
    count = lambda **want: sum(r["count"] for r in got if all(r[k] == v for k, v in want.items()))
    bad, good = count(quality=0), count(quality=1)
    assert count(quality=0, base_failed=False, kept=False) > 0.4 * bad  # what the base lets through
    assert count(quality=0, kept=True) < 0.05 * bad and count(quality=1, kept=True) > 0.93 * good
