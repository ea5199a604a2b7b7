"""Quality verdicts where words outnumber small tables of cells."""

import random
from collections import Counter

from pyspark.sql import functions as F

from voicelake.llm import quality
from voicelake.llm.text import words


def test_junk_of_a_large_vocabulary_is_rejected(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randrange(15000)}" if i % 10 else f"j{rng.randrange(15000)}%%%" for _ in range(200))) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 10 > 0)) for i, _ in rows if i % 2], "doc_id long, quality int")
    kept = {r["doc_id"] for r in quality.quality_report(docs, marks).filter("kept").collect()}
    good = {i for i, _ in rows if i % 10}
    assert not kept - good and len(good - kept) <= 0.03 * len(good)


def test_the_threshold_is_that_of_all_trusted_documents(spark):
    """Scores without the own features by hand for every trusted document, more than any sample held; equal words and one-word texts among them."""
    from math import log

    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.randrange(60)}" if i % 9 else f"q{rng.randrange(4000)}" for _ in range(rng.randrange(1, 12)))) for i in range(3000)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 11 > 0)) for i, _ in rows], "doc_id long, quality int")
    raw, mine = quality._listed(quality.cell_counts(docs, marks))
    cells = {r["doc_id"]: r["f"] for r in docs.select("doc_id", quality.features(F.transform(words(F.col("text")), lambda w: F.xxhash64(w))).alias("f")).collect()}
    assert sum(mine) == sum(len(f) for i, f in cells.items() if i % 11)
    scores = []
    for i, f in cells.items():
        if i % 11:
            total = 0.0
            for own, all_raw, all_mine, prior in quality._kinds(raw, mine):
                here = [c for c in f if c in own]
                for c in here:
                    common = raw[c] / all_raw
                    total += log((mine[c] - f.count(c) + prior * common) / (all_mine - len(here) + prior) / common)
            scores.append(total / len(f))
    scores.sort()
    at = (len(scores) - 1) * quality.FALSE_REJECT
    want = scores[int(at)] + (at - int(at)) * (scores[int(at) + 1] - scores[int(at)])
    assert want < quality.THRESHOLD and abs(quality.calibrated(docs, marks, mine, raw) - want) < 1e-5


def test_plans_name_the_tables_and_no_row_gets_a_copy(spark, edge, labels, monkeypatch):
    """The driver keeps the text of every plan; the tables of cells as literals made it megabytes."""
    plans, table = [], quality.Scratch.table
    monkeypatch.setattr(quality.Scratch, "table", lambda self, df, name: plans.append(df._jdf.queryExecution()) or table(self, df, name))
    out = quality.quality_filter(edge, labels)._jdf.queryExecution()
    assert len(plans) == 2
    for plan in (*plans, out):
        best = plan.optimizedPlan().toString()
        assert len(plan.toString()) < 200_000 and not any(f" AS {name}#" in best for name in ("_counted", "_common", "_table"))
    assert plans[1].optimizedPlan().toString().count("scalar-subquery#") >= 2 and "scalar-subquery#" in out.optimizedPlan().toString()


def test_cells_are_counted_in_generated_code(spark, edge, labels, monkeypatch):
    """Functions on array elements are interpreted; cells counted through them, and windows hashed and sorted by such functions in every text, took more than the time allowed."""
    plans, table = [], quality.Scratch.table
    monkeypatch.setattr(quality.Scratch, "table", lambda self, df, name: plans.append(df._jdf.queryExecution()) or table(self, df, name))
    trusted = {r["doc_id"] for r in labels.filter("quality = 1 AND doc_id IS NOT NULL").collect()}
    raw, mine = Counter(), Counter()
    for r in edge.select("doc_id", quality.features(F.transform(words(F.col("text")), lambda w: F.xxhash64(w))).alias("f")).collect():
        raw.update(r["f"])
        mine.update(r["f"] if r["doc_id"] in trusted else ())
    assert {(r["cell"], r["raw"], r["mine"]) for r in quality.cell_counts(edge, labels).collect()} == {(c, n, mine[c]) for c, n in raw.items()}
    assert "lambda" not in plans[0].optimizedPlan().toString()
    base = quality.base_counts(edge, ["doc_id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "array_sort(" not in base and base.count("xxhash64(") == 3
    best = quality.quality_report(edge, labels)._jdf.queryExecution().optimizedPlan().toString()
    assert not any(f" AS {name}#" in best + plans[-1].optimizedPlan().toString() for name in ("_pair_table", "_single"))


def test_repeated_windows_among_texts_of_few_words(spark):
    """Swapped and alternating pairs, windows at both ends, overlapping ones and texts of four to six words."""
    rng = random.Random(11)
    texts = ["a b c d", "a b c d e", "a a a a a", "a a a a a a", "a b a b a b a b", "a b c d e c d a b e", "a b c d e x a b c d f", "a b c d e a b c d e"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(40))) for _ in range(200)]
    got = {r["doc_id"]: (r["n_repeat_words"], r["word_chars"]) for r in quality.base_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ["doc_id"]).collect()}
    for i, text in enumerate(texts):
        w = text.split()
        windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        seen = Counter(windows)
        assert got[i] == (len({k + d for k, x in enumerate(windows) if seen[x] > 1 for d in range(5)}), sum(map(len, w)))
