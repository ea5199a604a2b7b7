"""Transcript queries over whole texts against plain versions."""

import re
from collections import Counter, defaultdict
from math import exp, log

import pytest

from pyspark.sql import functions as F

from voicelake import catalogue
from voicelake.functions import text as T
from voicelake.sources import tables

LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 6
TURNS = [
    (1, 0, "user", LONG + "one two three four"), (1, 1, "assistant", LONG + "one too three"), (1, 2, "user", LONG + "five six, seven EIGHT nine"),
    (2, 0, "user", "short. Text"), (2, 1, "assistant", "short test"), (2, 2, "user", LONG),
]


def plain(text):
    return re.sub(r"[\W_]+", " ", text.lower()).strip()


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def pairs(turns):
    ordered = sorted(turns)
    return [(c, t, role, plain(x), plain(nxt[3])) for (c, t, role, x), nxt in zip(ordered, ordered[1:], strict=False) if nxt[0] == c]


@pytest.fixture
def at(spark, tmp_path):
    def write(table, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{table}.parquet"))
        return str(tmp_path)

    return write


def held(spark, at, turns):
    """The four queries of turn pairs against plain edit distance and counts."""
    folder, by = at("conversations", turns, "conv_id long, turn int, role string, text string"), defaultdict(list)
    for p in pairs(turns):
        by[p[2]].append(p)
    run = lambda name: catalogue.QUERIES[name](spark, folder).collect()
    assert {(r["conv_id"], r["turn"]): r["cer"] for r in run("error_rates")} == {(c, t): round(edits(a, b) / max(len(a), 1), 6) for c, t, _, a, b in pairs(turns)}
    for r in run("text_agreement"):
        scores = [1 - edits(a, b) / max(len(a), len(b), 1) for *_, a, b in by[r["role"]]]
        assert (r["pairs"], r["mean_agreement"], r["least_agreement"]) == (len(scores), pytest.approx(sum(scores) / len(scores), abs=1e-6), pytest.approx(min(scores), abs=1e-6))
    for r in run("word_error_rates"):
        assert (r["edits"], r["words"]) == (sum(edits(a.split(" "), b.split(" ")) for *_, a, b in by[r["role"]]), sum(len(a.split(" ")) for *_, a, _ in by[r["role"]]))
    for r in run("translation_quality"):
        assert (r["hyp_words"], r["ref_words"]) == tuple(sum(len(p[k].split()) for p in by[r["role"]]) for k in (4, 3))
        assert (r["bleu"], r["chrf"]) == tuple(pytest.approx(x, abs=1e-6) for x in plain_quality([p[3:] for p in by[r["role"]]]))


def shares(found, longest, parts):
    """Shared, hypothesis and reference n-grams of each length over all (reference, hypothesis) pairs."""
    out = []
    for n in range(1, longest + 1):
        grams = lambda x: Counter(tuple(parts(x)[k : k + n]) for k in range(len(parts(x)) - n + 1))
        each = [(grams(a), grams(b)) for a, b in found]
        out.append((sum((x & y).total() for x, y in each), sum(y.total() for _, y in each), sum(x.total() for x, _ in each)))
    return out


def plain_quality(found):
    """Corpus BLEU and chrF."""
    words, letters = shares(found, 4, str.split), [s for s in shares(found, 6, lambda x: x.replace(" ", "")) if s[1] or s[2]]
    bleu = 0.0
    if all(m for m, _, _ in words):
        bleu = exp(sum(log(m / h) for m, h, _ in words) / 4) * min(1.0, exp(1 - words[0][2] / words[0][1]))
    p, q = (sum(s[0] / s[k] if s[k] else 0.0 for s in letters) / len(letters) for k in (1, 2))
    return bleu, 5 * p * q / (4 * p + q) if p or q else 0.0


def test_pairs_are_compared_whole(spark, at):
    held(spark, at, TURNS)


def test_pairs_keep_letters_beyond_ascii(spark, at):
    held(spark, at, [(1, 0, "user", "échch straße mañana"), (1, 1, "assistant", "Échch Straße, manana"), (1, 2, "user", "日本語 テキスト"), (1, 3, "assistant", "русский текст 😀")])


def test_normal_form_is_unicode(spark, at):
    texts = ["Échch — Straße_mañana!", "日本語、テキスト 12", "ΑΒΓ the ÀÉ and x", "éthe theé the", "¡and!", "", "😀"]
    folder = at("documents", [(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    assert {r["doc_id"]: r["normalized"] for r in catalogue.QUERIES["normalize_text"](spark, folder).collect()} == {i: plain(t) for i, t in enumerate(texts)}
    got = {r["doc_id"]: r["translated_text"] for r in catalogue.QUERIES["lexical_translate"](spark, folder).collect()}
    assert got == {0: "Échch — straße_mañana!", 1: "日本語、テキスト 12", 2: "Αβγ o àé e x", 3: "Éthe theé o", 4: "¡e!", 5: "", 6: "😀"}


def test_clauses_of_long_texts(spark):
    """20,000 words without and with weak marks, against a plain fold; in seconds."""
    import random
    import time

    def plain(text):
        done, own = [], []
        for token in text.split():
            own.append(token)
            last = token.rstrip("\"')]")[-1:]
            if last in tuple(".!?") or (last in tuple(",;:—") and len(own) >= 3):
                done.append(" ".join(own))
                own = []
        if len(own) == 1 and len(own[0].encode()) <= 2 and done:
            done[-1] += " " + own[0]
        elif own:
            done.append(" ".join(own))
        return done

    rng = random.Random(3)
    texts = ["word " * 20_000, " ".join(rng.choice(["a", "bc,", "d", 'e"', "f.)", "g", "h;"]) for _ in range(20_000)), "", " ", "a", "a. b", "a. bcd", '"', "one two, three four, five", "x, y. z"]
    began = time.time()
    got = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", T.split_clauses(F.col("t")).alias("c")).collect()
    assert {r["k"]: r["c"] for r in got} == {k: plain(t) for k, t in enumerate(texts)} and time.time() - began < 60


def test_record_files(spark, tmp_path):
    """Speech rows with and without audio, metrics without text, and a stream that is written as it comes."""
    speech = spark.createDataFrame([(1, 16000, bytearray(b"x"), "t", "T", "f", "extra")], "id long, num_samples long, audio binary, transcription string, raw_transcription string, gender string, more string")
    speech.write.parquet(str(tmp_path / "speech"))
    assert tables.read_speech_parquet(spark, str(tmp_path / "speech")).columns == ["id", "num_samples", "transcription", "raw_transcription", "gender"]
    assert tables.read_speech_parquet(spark, str(tmp_path / "speech"), audio=True).first()["audio"] == b"x"
    tables.write_metrics_jsonl(spark.createDataFrame([(1, "said", 2.5)], "id long, text string, ms double"), str(tmp_path / "metrics"))
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "metrics")).select("id", "ms").collect()] == [(1, 2.5)] and "text" not in spark.read.json(str(tmp_path / "metrics")).columns
    spark.createDataFrame([(k, k * 1.0) for k in range(9)], "k long, v double").repartition(3).write.parquet(str(tmp_path / "in"))
    chunks = tables.read_chunk_stream(spark, str(tmp_path / "in"), "k long, v double", 1)
    tables.write_stream(chunks, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 9


def test_shared_grams():
    """Against counters, over few letters and over thousands of any plane, whose numbers do not fit as they are."""
    import random

    from voicelake.operators.quality import shared_grams

    rng = random.Random(1)
    for trial in range(40):
        letters = "ab c" if trial % 2 else "".join(chr(rng.randrange(0x10000, 0x20000)) for _ in range(3000)) + " "
        text = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(40)))  # noqa: B023, E731
        a = [text() for _ in range(7)]
        b = [x if rng.random() < 0.3 else text() for x in a]
        for unit, longest, parts in (("word", 4, str.split), ("character", 6, lambda x: list(x.replace(" ", "")))):
            want = [[sum((Counter(tuple(parts(x)[k : k + n]) for k in range(len(parts(x)) - n + 1)) & Counter(tuple(parts(y)[k : k + n]) for k in range(len(parts(y)) - n + 1))).values()) for n in range(1, longest + 1)] for x, y in zip(a, b, strict=True)]
            assert shared_grams(a, b, unit, longest).tolist() == want
    assert shared_grams([], [], "word", 4).shape == (0, 4) and shared_grams([""], [""], "character", 6).tolist() == [[0] * 6]
