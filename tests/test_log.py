"""Results are logged once, prompts are asked once, whatever is killed or run again."""

import json

import pytest
from pyspark.sql import functions as F

from pathloom.operators import generate
from pathloom.operators.memo import Memo, Remembered
from pathloom.sources import jsonl
from pathloom.sources.result_log import ResultLog

SCHEMA = "data_id string, results string"


@pytest.fixture
def log(spark, tmp_path):
    return ResultLog(spark, f"file://{tmp_path}/log", SCHEMA)


def some(spark, *ids):
    return spark.createDataFrame([(str(i), f"of {i}") for i in ids], SCHEMA)


def ids(log):
    return sorted(r.data_id for r in log.read().collect())


def test_a_batch_counts_once(spark, log):
    assert ids(log) == [] and log.batches() == {}
    assert log.append(some(spark, 1, 2), "first/batch ü") and not log.append(some(spark, 1, 2), "first/batch ü")
    assert log.append(some(spark, 3), "second") and ids(log) == ["1", "2", "3"] and len(log.batches()) == 2


def test_killed_between_write_and_commit(spark, log, tmp_path):
    lost = log.write(some(spark, 1, 2), "b")  # killed here
    assert ids(log) == [] and not log.has("b")
    assert log.append(some(spark, 1, 2), "b") and ids(log) == ["1", "2"]
    assert not log.commit("b", lost)  # a try that comes late
    assert ids(log) == ["1", "2"] and log.sweep() == 1 and ids(log) == ["1", "2"]


def test_killed_while_writing_a_manifest(spark, log, tmp_path):
    (tmp_path / "log/manifests").mkdir(parents=True)
    (tmp_path / "log/manifests/b").write_text("half-a-na")
    assert not log.has("b") and ids(log) == []
    assert log.append(some(spark, 7), "b") and ids(log) == ["7"]


def test_a_run_resumes_where_it_was_killed(spark, log):
    todo, ran = some(spark, *range(20)), []

    def step(df, stop):
        ran.append(sorted(r.data_id for r in df.collect()))
        if len(ran) == stop:
            raise KeyboardInterrupt
        return df

    with pytest.raises(KeyboardInterrupt):
        log.run(todo, lambda df: step(df, 3), "data_id", 5)
    done = ids(log)
    assert 0 < len(done) < 20 and sorted(x for part in ran[:2] for x in part) == done
    assert log.run(todo, lambda df: step(df, 0), "data_id", 5) == 3 and ids(log) == sorted(map(str, range(20)))
    assert log.run(todo, lambda df: step(df, 0), "data_id", 5) == 0
    left = jsonl.remaining(some(spark, *range(25)).withColumn("path_node_ids", F.array().cast("array<long>")), log.read().withColumn("path_node_ids", F.lit(None).cast("array<long>")))
    assert sorted(r.data_id for r in left.collect()) == ["20", "21", "22", "23", "24"]


def test_a_stream_adds_its_batches_once(spark, log, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text("\n".join(json.dumps({"data_id": str(i), "results": "x"}) for i in range(4)))
    start = lambda folder: spark.readStream.schema(SCHEMA).json(str(source)).writeStream.foreachBatch(log.sink("q")).option("checkpointLocation", str(tmp_path / folder)).trigger(availableNow=True).start().awaitTermination(60)
    start("one")
    start("two")  # a checkpoint is lost: its first batch comes again under the same number
    assert ids(log) == ["0", "1", "2", "3"]


def counted(folder):
    """A generator that leaves a file line for each prompt it is asked, and fails at some."""

    def make():
        def call(prompts):
            with open(f"{folder}/calls", "a") as f:
                f.writelines(f"{p}\n" for p in prompts)
            if any("bad" in p for p in prompts):
                raise ValueError("no answer")
            return [f"re: {p}" for p in prompts]

        return call

    return make


def test_equal_prompts_are_asked_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(generate, "PAUSE", 0.0)
    calls = lambda: (tmp_path / "calls").read_text().splitlines()
    memo = Memo(spark, f"file://{tmp_path}/memo", "model a")
    factory = Remembered(counted(str(tmp_path)), memo)
    rows = [(i, ["one", "two", "three"][i % 3]) for i in range(30)] + [(90, None)]
    df = spark.createDataFrame(rows, "i long, prompt string").repartition(5)
    ask = lambda d: {r.i: r.response for r in generate.generate(d, factory, name=str(tmp_path), batch=1).collect()}
    want = {i: "" if p is None else f"re: {p}" for i, p in rows}
    assert ask(df) == want and sorted(calls()) == ["one", "three", "two"]
    assert ask(df) == want and len(calls()) == 3  # a rerun asks nothing
    more = spark.createDataFrame([(1, "two"), (2, "four"), (3, "bad")], "i long, prompt string")
    assert ask(more) == {1: "re: two", 2: "re: four", 3: ""}
    assert sorted(calls()[3:]) == ["bad", "bad", "bad", "four"]  # as many tries as a call has
    failed = memo.failures.read().collect()
    assert [(r.prompt, r.error) for r in failed] == [("bad", "ValueError: no answer")] and memo.responses.read().count() == 4
    other = Memo(spark, f"file://{tmp_path}/memo", "model b")
    assert other.answer(more.where("i = 1"), lambda d: d.withColumns({"response": F.lit("b"), "error": F.lit(None).cast("string")})).first().response == "b"
