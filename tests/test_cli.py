"""The three commands, one after the other, on a small graph."""

import json

import pytest
from pyspark.sql import functions as F

from pathloom import __main__ as cli
from pathloom.sources import jsonl, kg, schemas
from pathloom.sources.result_log import ResultLog


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Genes 0 to 5 in a ring with drugs 10 to 15, whose diseases are 20 to 25."""
    out = tmp_path_factory.mktemp("cli")
    nodes = [(i, f"{kind} {i}", kind, None) for kind, first in (("gene", 0), ("drug", 10), ("disease", 20)) for i in range(first, first + 6)]
    edges = [(i, 10 + i, 0) for i in range(6)] + [(10 + i, 20 + i, 1) for i in range(6)] + [(i, (i + 1) % 6, 2) for i in range(6)]
    store = kg.Store(spark, f"file://{out}/kg")
    store.ensure(spark.createDataFrame(nodes, schemas.NODES), spark.createDataFrame(edges, schemas.EDGES), kg.relations(spark, [("target", "acts on"), ("indication", "treats"), ("ppi", "binds")]))
    for name, own in (("train", range(4)), ("test", range(2, 6))):
        rows = [{"data_id": f"{name}{i}", "query": f"which disease does the drug of gene {i} treat", "topic_entities": {str(i): ""}, "answer_entity": {"id": 20 + i, "name": f"disease {20 + i}", "type": "disease"}, "num_hops": 2} for i in own]
        (out / f"{name}.jsonl").write_text("\n".join(map(json.dumps, rows)))
    return f"file://{out}"


def run(folder, *args):
    cli.main([*args, "--kg", f"{folder}/kg"])


def test_build_infer_evaluate(spark, folder, capsys):
    run(folder, "build", "--questions", f"{folder}/train.jsonl", "--output", f"{folder}/bank", "--order", "raw", "--ladder", "6,18", "--k", "2", "--beta", "0.5")
    bank = jsonl.path_bank(jsonl.read(spark, f"{folder}/bank", schemas.PATH_BANK)).where("pos = 0").collect()
    assert {r.data_id for r in bank} == {f"train{i}" for i in range(4)} and {(tuple(r.types), tuple(r.relations)) for r in bank} == {(("gene", "drug", "disease"), ("target", "indication"))}
    infer = ["infer", "--questions", f"{folder}/test.jsonl", "--trains", f"{folder}/train.jsonl", "--bank", f"{folder}/bank", "--output", f"{folder}/results", "--memo", f"{folder}/memo", "--generator", "pathloom.operators.generate:echo_generator", "--encoder", "pathloom.operators.generate:letter_encoder", "--batches", "2"]
    run(folder, *infer)
    run(folder, *infer)  # nothing is left to do
    said = capsys.readouterr().out
    assert "2 of 2 batches run" in said and "0 of 2 batches run" in said
    got = ResultLog(spark, f"{folder}/results", schemas.RESULT).read().collect()
    assert sorted(r.data_id for r in got) == [f"test{i}" for i in range(2, 6)] and all(r.pathbank_chosen_hop == 2 and r.pathbank_paths_success >= 1 for r in got)
    run(folder, "evaluate", "--gold", f"{folder}/test.jsonl", "--results", f"{folder}/results")
    assert "num_hops" in capsys.readouterr().out


@pytest.mark.parametrize("seeds", ["degree_inv"])
def test_build_with_one_run_for_both_ends(spark, folder, seeds):
    run(folder, "build", "--questions", f"{folder}/train.jsonl", "--limit", "2", "--output", f"{folder}/{seeds}", "--seeds", seeds, "--ladder", "18")
    bank = jsonl.read(spark, f"{folder}/{seeds}", schemas.PATH_BANK)
    assert bank.count() == 2 and bank.select(F.explode("per_topic").alias("k", "b")).where("not b.fallback").count() == 2
