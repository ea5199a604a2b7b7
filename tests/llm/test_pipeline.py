"""The pipeline's stages, each held against the reports on its own input, and the SQL twins."""

import duckdb
import pytest

import corpus_pipeline
from voicelake.llm import bpe, mixing, neardup, quality, suffixdedup
from voicelake.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    columns, kept = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        kept.append((docs, spark.read.parquet(str(tmp_path / str(k)))))
        docs = kept[-1][1]
    assert all(out.columns == columns for _, out in kept[:-1])
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    assert ids(kept[0][1]) == ids(quality.quality_report(kept[0][0], labels).filter("kept"))
    assert ids(kept[1][1]) == ids(neardup.near_duplicates(kept[1][0], width=corpus_pipeline.SHINGLE_WORDS).filter("kept"))
    left = {r["doc_id"]: r["n_bytes"] - r["n_removed"] for r in suffixdedup.repeat_report(kept[2][0]).collect()}
    assert {r["doc_id"]: len(r["text"].encode()) for r in kept[2][1].collect()} == {i: n for i, n in left.items() if n}
    assert len(ids(kept[3][1])) == sum(r["copies"] for r in mixing.mix_report(kept[3][0]).collect())
    assert sorted(map(tuple, kept[4][1].collect())) == sorted(map(tuple, bpe.token_report(kept[4][0], bpe.vocabulary_file()).collect()))
    assert corpus_pipeline.run(spark, SF).count() == kept[4][1].count()


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "conversations", "pages"):
        db.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    want, got = db.sql(SQL[name]).df(), QUERIES[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert len(a) == len(b) and ((a == b) | (a.isna() & b.isna())).all().all()
