"""The pipeline's stages: each works on what the one before kept, and its decisions take effect."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pathloom.llm import bpe, queries

SF = "/root/testdata/sf0.001"


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeats", "decontamination", "bpe"]
    assert set(queries.oracle_sql()) <= set(queries.queries()) and "pipeline" in queries.queries()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(1)
    text = lambda n: " ".join(f"word{int(x)}" for x in rng.integers(0, 3000, n))
    passage, question = text(80), text(20)
    rows = [(i, text(60)) for i in range(40)]
    rows += [(100, text(30) + " you idiot you moron you pathetic scum you loser " + text(10))]
    rows += [(200, f"{text(20)} {passage} {text(20)}"), (201, f"{text(30)} {passage}")]
    rows += [(300, rows[0][1]), (301, rows[1][1] + " tail")]
    rows += [(400, f"{text(30)} {question} {text(30)}")]
    toxic = [(i, text(30) + " you idiot you moron you pathetic scum you loser " + text(10)) for i in range(1000, 1060)]
    clean = [(i, text(40)) for i in range(2000, 2120)]
    every = rows + toxic + clean
    out = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in every], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, 1, 1) for i, _ in toxic] + [(i, 1, 0) for i, _ in clean], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(7, question)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out, dict(every), passage


def test_pipeline_catches_and_keeps(spark, folder):
    path, texts, passage = folder
    docs, kept = spark.read.parquet(f"{path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.columns
        docs = stage(spark, docs, path)
        assert sorted(docs.columns) == sorted(before), name
        out = f"{path}/{name}"
        docs.write.parquet(out)
        docs = spark.read.parquet(out)
        kept.append({r.doc_id: r.text for r in docs.collect()})
    assert not {100, *range(1000, 1060)} & set(kept[0]) and {*range(40), 200, 201, 300, 301, 400, *range(2000, 2120)} == set(kept[0])
    assert {300, 301} & set(kept[1]) == set() and set(kept[0]) - set(kept[1]) == {300, 301}
    assert passage not in kept[2][200] and passage not in kept[2][201] and kept[2][5] == texts[5]
    assert set(kept[2]) - set(kept[3]) == {400}
    got = {r.doc_id: r for r in corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()}
    assert set(got) == set(kept[3])
    codec = bpe.Codec(tokens := bpe.read_ranks(bpe.default_vocabulary()), bpe.serialise(tokens), bpe.default_pattern())
    for i, r in got.items():
        ids = codec.encode(kept[3][i])
        assert (r.n_tokens, r.decoded_sha256) == (len(ids), hashlib.sha256(kept[3][i].encode()).hexdigest())
    assert sorted(map(tuple, corpus_pipeline.run(spark, path).collect())) == sorted(map(tuple, got.values()))


def test_stages_take_odd_rows(spark, folder):
    path = folder[0]
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "é" * 9000, "fr", "s", 9000), (2, "two", "fr", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, path)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, path).count() in (0, 4)


def test_stages_take_columns_of_any_name(spark, folder):
    """Columns that are called like those of the stages' own stay as they are."""
    path, texts, passage = folder
    names = ["_id", "_of", "_key", "_k", "_new", "_row", "_kept", "t", "n", "row", "key", "kept", "spans", "toxic_score", "text_key", "id", "words"]
    docs = spark.read.parquet(f"{path}/documents.parquet").withColumns({n: F.lit(f"own {n}") for n in names})
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert sorted(docs.columns) == sorted(columns), name
    rows = docs.collect()
    assert {r.doc_id for r in rows} == {*range(40), 200, 201, *range(2000, 2120)}
    assert all(r[n] == f"own {n}" for r in rows for n in names) and all(passage not in r.text for r in rows)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, path).count() == len(rows)
