"""Language rules, routes, references and message tags."""

import pytest

from pyspark.sql import functions as F

from voicelake.operators import routing

ENGINE = "id string, state string, capabilities array<string>, pairs array<struct<source:string,target:string>>, stt_languages array<string>, tts_languages array<string>"


def registry(spark, *rows):
    return spark.createDataFrame(list(rows), ENGINE)


@pytest.mark.parametrize("tags,asked,fits", [(["pt-BR"], "pt-PT", True), (["pt-BR"], "pt", True), (["pt"], "pt-BR", False), (["pt"], "pt", True), ([], "ja", True), (["pt-BR"], "ja", False), (["ptx-A"], "pt", False), (["fr"], None, True)])
def test_tags(spark, tags, asked, fits):
    engines = registry(spark, ("a", "ready", ["stt"], [], tags, []), ("b", "ready", ["tts"], [], [], tags))
    heard = spark.createDataFrame([(1, ["stt"], asked, "zz"), (2, ["tts"], "zz", asked)], "request_id int, asked array<string>, source_lang string, target_lang string")
    assert {r["request_id"] for r in routing.language_match(heard, engines).collect()} == ({1, 2} if fits else set())


def test_checks_are_joined(spark):
    engines = registry(spark, ("a", "ready", ["stt", "translation"], [("en", "pt")], ["en"], []))
    asks = [(1, ["stt", "translation"], "en", "pt"), (2, ["stt", "translation"], "en", "fr"), (3, ["translation"], "en", None), (4, [], None, None), (5, ["tts"], "en", "pt")]
    asked = spark.createDataFrame(asks, "request_id int, asked array<string>, source_lang string, target_lang string")
    assert {r["request_id"] for r in routing.language_match(asked, engines).collect()} == {1, 3, 4}
    assert {r["request_id"] for r in routing.find_by_capability(asked, engines, "any").collect()} == {1, 2, 3}


def test_routes(spark):
    stt, mt, tts, st, s2s = (("stt", "ready", ["stt"], [], [], []), ("mt", "ready", ["translation"], [("pt", "en")], [], []), ("tts", "ready", ["tts"], [], [], []), ("st", "starting", ["speech_translation"], [("pt", "en")], [], []), ("s2s", "ready", ["speech_to_speech"], [], [], []))
    legs = spark.createDataFrame([(1, "pt", "en")], "leg int, source_lang string, target_lang string")
    route = lambda *rows, prefs=None: tuple(routing.choose_route(legs, ["leg"], registry(spark, *rows), prefs).first())[1:]
    assert route(stt, mt, tts, st, s2s) == ("direct", None, None, "tts", "st", None)
    assert route(stt, mt, tts, s2s) == ("cascade", "stt", "mt", "tts", None, None)
    assert route(stt, mt, st, s2s) == ("s2s", None, None, None, None, "s2s")
    assert route(st)[0] == route((*st[:1], "error", *st[2:]), tts)[0] == "none"
    named = {"stt": "x", "translation": "mt", "tts": "y"}
    assert route(stt, mt, tts, st, prefs=named) == ("cascade", "x", "mt", "y", None, None)
    wrong = ("mt", "ready", ["translation"], [("de", "en")], [], [])
    assert route(stt, wrong, tts, st, prefs=named)[0] == "direct"
    assert route(st, prefs={"speech_to_speech": "unknown"}) == ("s2s", None, None, None, None, "unknown")


def test_references(spark):
    samples, known = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "one")], "k int, text string")
    assert {tuple(r) for r in routing.attach_references(samples, known, "k", strict=False).collect()} == {(1, "one", None), (2, None, "no reference for 2")}
    assert routing.attach_references(samples.filter("k = 1"), known, "k").count() == 1
    with pytest.raises(Exception, match="no reference for 2"):
        routing.attach_references(samples, known, "k").collect()


def test_dead_letters(spark):
    rows = [(1, '{"type":"error","code":"x"}'), (2, "no json"), (3, '{"code":"x"}'), (4, '{"type":"other"}'), (5, None)]
    good, dead = routing.tagged_messages(spark.createDataFrame(rows, "n int, header string"), "header", "code string")
    assert [(r["n"], r["message"]["code"]) for r in good.collect()] == [(1, "x")]
    assert {r["n"]: r["reason"] for r in dead.collect()} == {2: "unparsed", 3: "untyped", 4: "unknown type", 5: "unparsed"}


def test_demand_gate_across_spans(spark):
    """Against the latest callback by brute force: callbacks in the same span, the one before, further back, after, at the same time, and none."""
    import random

    rng = random.Random(2)
    rows = [(rng.choice([1, 1, 1, 2, None]), k, rng.randint(0, 40) * 100) for k in range(300)]
    stamp = F.timestamp_millis(F.col("ms") + 1_700_000_000_000)
    both = spark.createDataFrame(rows, "stream long, id long, ms long").withColumn("ts", stamp)
    transfers, callbacks = both.filter("id % 2 = 0").withColumn("_span", F.lit("own")), both.filter("id % 2 = 1 AND id % 3 = 0")
    got = {r["id"]: r["counts"] for r in routing.demand_gate(transfers.drop("_span"), callbacks, ["stream"], "ts", 250).collect()}
    calls = [(s, ms) for s, k, ms in rows if k % 2 == 1 and k % 3 == 0]
    assert got == {k: any(s == c and s is not None and 0 <= ms - at <= 250 for c, at in calls) for s, k, ms in rows if k % 2 == 0 and s is not None} | {k: got[k] for s, k, _ in rows if k % 2 == 0 and s is None}
