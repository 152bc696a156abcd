"""Unit cases for the scalar rules (one row per stated edge)."""

from pyspark.sql import functions as F

from loopdex.functions import media as md
from loopdex.functions.query import parse_query, with_parsed
from loopdex.functions.text import (action_text, clean_payload, combined_text, default_attribution, doc_id, hash_doc_id,
                                    media_id, refine_query, rewrite_cdn)


def one(spark, col, data, schema="x string"):
    return [r[0] for r in spark.createDataFrame(data, schema).select(col).collect()]


def test_rewrite_cdn_and_ids(spark):
    urls = [("http://38.media.tumblr.com/a/tumblr_abc123.gif",), ("http://x.com/noid.gif",),
            ("http://31.media.tumblr.com/31.media.tumblr.com/tumblr_Z9.gif",)]
    rew = one(spark, rewrite_cdn("x"), urls)
    assert rew[0] == "http://64.media.tumblr.com/a/tumblr_abc123.gif"
    assert rew[2] == "http://64.media.tumblr.com/64.media.tumblr.com/tumblr_Z9.gif"  # all occurrences
    assert one(spark, media_id("x"), urls) == ["abc123", "", "Z9"]
    import hashlib

    h = one(spark, hash_doc_id("x"), urls[:1])[0]
    assert h == "gif_" + hashlib.md5(urls[0][0].encode()).hexdigest()[:16]
    ids = spark.createDataFrame([("", "u"), (None, "u"), ("item_1", "u")], "id string, url string").select(doc_id("id", "url")).collect()
    assert ids[0][0] == ids[1][0] == "gif_" + hashlib.md5(b"u").hexdigest()[:16] and ids[2][0] == "item_1"


def test_clean_payload_fences(spark):
    data = [("```json\n{\"a\":1}\n```",), ("```json\n{\"a\":1}",), ("```{\"a\":1}```",), ("  {\"a\":1}  ",), ("\t{}\n",)]
    got = one(spark, clean_payload("x"), data)
    assert got == ['{"a":1}', "", "", '{"a":1}', "{}"]  # unclosed fence loses its last line


def test_action_text_union(spark):
    lines = ['{"action":"jump"}', '{"action":["a","b"]}', '{"action":null}', '{"action":3}', '{"action":[]}', '{}',
             '{"action":["a",null]}', '{"action":["a",1]}']
    df = spark.createDataFrame([(x,) for x in lines], "x string")
    got = [r[0] for r in df.select(action_text(F.try_variant_get(F.try_parse_json("x"), "$.action", "variant"))).collect()]
    assert got == ["jump", "a, b", "", "", "", "", "a, ", ""]


def test_combined_text_and_attribution(spark):
    df = spark.createDataFrame([("L", None, "m", "a", "c", ["t1", "t2"], "", "d")],
                               "l string, s string, m string, a string, c string, t array<string>, at string, dd string")
    r = df.select(combined_text("l", "s", "m", "a", "c", "t"), default_attribution("at", "dflt"), default_attribution("at", "")).first()
    assert r[0] == "L. Source: . Mood: m. Actions: a. Use case: c. Tags: t1, t2"
    assert r[1] == "dflt" and r[2] is None


def test_parse_query_cases(spark):
    q = spark.createDataFrame([
        (1, 'hashtag:foo ring'), (2, 'tag:"open x'), (3, '"red bolt" anvil tag:red tag:"LARGE Part"'),
        (4, '-tag:"PROMO Part" -tag:old'), (5, ''), (6, '  "  spaced  " loose '), (7, 'TAG:Up tag:Sci-Fi'),
    ], "query_id int, raw string")
    rows = {r.query_id: r for r in with_parsed(q).collect()}
    assert rows[1].tags == ["foo"] and rows[1].loose == "hash ring" and rows[1].mode == "hybrid"
    assert rows[2].tags == ['"open'] and rows[2].loose == "x"
    assert rows[3].phrases == ["red bolt"] and rows[3].loose == "anvil" and rows[3].tags == ["large part", "red"]
    assert rows[4].neg_tags == ["promo part", "old"] and rows[4].mode == "all"
    assert rows[5].mode == "all" and rows[5].loose == ""
    assert rows[6].phrases == ["spaced"] and rows[6].loose == "loose"
    assert rows[7].tags == ["sci-fi"] and rows[7].loose == "TAG:Up"  # case-sensitive syntax
    assert parse_query is not None


def test_refine_query(spark):
    df = spark.createDataFrame([("", "cat"), ("dogs", "live leak"), (None, "x")], "r string, t string")
    assert [r[0] for r in df.select(refine_query("r", "t")).collect()] == ["tag:cat", 'dogs tag:"live leak"', "tag:x"]


def test_media_plans(spark):
    df = spark.createDataFrame([(11,), (5,), (3,), (1,)], "n int")
    got = [r[0] for r in df.select(md.frame_plan("n")).collect()]
    assert got == [[0, 2, 5, 8, 10], [0, 1, 2, 3, 4], [0, 1, 2], [0]]
    r = spark.createDataFrame([(1024, 300), (512, 100), (1000, 1001)], "w int, h int").select(md.resize_plan("w", "h").alias("r")).collect()
    assert [(x.r.w, x.r.h) for x in r] == [(512, 150), (512, 100), (511, 512)]
    v = spark.createDataFrame([(0.25, 0, 30, 1), (0.0, 90, 30, 1), (0.0, 0, 0, 1), (None, 10, 0, 1)],
                              "d double, nb int, num int, den int")
    ts = [r[0] for r in v.select(md.video_plan("d", "nb", "num", "den")).collect()]
    assert ts[0] == ["0.000", "0.062", "0.125", "0.188", "0.240"]  # half-even on the binary value, last clamped
    assert ts[1] == ["0.000", "0.750", "1.500", "2.250", "2.990"]
    assert ts[2] == ts[3] == ["0.000", "0.250", "0.500", "0.750", "0.990"]
    s = [r[0] for r in spark.createDataFrame([("mp4",), ("webm",), ("gif",), (None,)], "f string").select(md.sampler_for("f")).collect()]
    assert s == ["video", "video", "frames", "frames"]
