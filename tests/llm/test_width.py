"""Near-duplicates by wider shingles than the query's."""

import itertools
import random

import corpus_pipeline
from voicelake.llm import neardup


def likeness(a, b, width):
    x, y = ({tuple(w[k : k + width]) for k in range(max(len(w) - width, 0) + 1)} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def texts():
    """Copies of one text with 0 to 11 words changed, and short ones."""
    rng, base, out = random.Random(6), [f"w{k}" for k in range(120)], []
    for n in range(12):
        words = list(base)
        for k in rng.sample(range(120), n):
            words[k] = f"x{n}-{k}"
        out.append(" ".join(words))
    return [*out, "one two three", "one two three", "one two four", "one"]


def test_stage_takes_five_words(spark):
    docs = [t for t in texts()[:6:5]]
    assert likeness(*docs, 2) >= 0.8 > likeness(*docs, 5)
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    assert neardup.near_duplicates(df).filter("kept").count() == 1
    assert corpus_pipeline.neardup_stage(spark, df, "").count() == 2


def test_widths_against_brute_force(spark):
    rows = list(enumerate(texts()))
    for width in (1, 2, 5):
        want = {i: i for i, _ in rows}
        for (i, a), (j, b) in itertools.combinations(rows, 2):
            if likeness(a, b, width) >= 0.8:
                one, two = want[i], want[j]
                want = {k: min(one, two) if x in (one, two) else x for k, x in want.items()}
        got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=width).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == want
