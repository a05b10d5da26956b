"""Jobs that break off and start again: harvest, call ledger, published runs."""

import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gradeloom.operators import scoring
from gradeloom.sources import readers, writers
from gradeloom.streaming import jobs

POSTS = "id string, n long, claim_text string"


def arrive(spark, folder, rows):
    spark.createDataFrame(rows, POSTS).write.mode("append").json(folder)


def harvest(spark, src, out, checkpoint, **kw):
    stream = jobs.file_stream(spark, src, spark.createDataFrame([], POSTS).schema, "json")
    jobs.harvest_into(stream, out, checkpoint, **kw)
    return sorted((r["id"], r["n"]) for r in spark.read.schema(POSTS).parquet(out).collect())


def test_harvest_reads_only_the_buckets_of_its_ids(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / n) for n in ("src", "out", "ckpt"))
    arrive(spark, src, [("a", 2, "x"), ("a", 1, "x"), ("b", 5, "x"), (None, 7, "x"), ("", 8, "x")])
    assert harvest(spark, src, out, ckpt) == [("a", 1), ("b", 5)]
    buckets = {r["id"]: r["_bucket"] for r in spark.read.parquet(f"{out}/_seen").select("id", "_bucket").collect()}
    assert set(buckets) == {"a", "b"} and buckets["a"] != buckets["b"]
    # an index file that cannot be read stands in the way of nobody who does not need it
    bad = tmp_path / "out" / "_seen" / f"_bucket={buckets['b']}" / "claim=other-0"
    bad.mkdir()
    (bad / "part-0.parquet").write_bytes(b"no parquet")
    arrive(spark, src, [("a", 0, "y"), (None, 9, "y")])
    assert harvest(spark, src, out, ckpt) == [("a", 1), ("b", 5)]
    arrive(spark, src, [("b", 0, "y")])
    with pytest.raises(Exception):  # noqa: B017
        harvest(spark, src, out, ckpt)


def test_harvest_batch_that_broke_off_runs_again(spark, tmp_path, monkeypatch):
    src, out, ckpt = (str(tmp_path / n) for n in ("src", "out", "ckpt"))
    arrive(spark, src, [("a", 1, "x"), ("b", 2, "x")])
    removed = jobs.delete_table

    def stop(*args):
        raise RuntimeError("lost after the rows were written")
    monkeypatch.setattr(jobs, "delete_table", stop)
    with pytest.raises(Exception):  # noqa: B017
        harvest(spark, src, out, ckpt)
    monkeypatch.setattr(jobs, "delete_table", removed)
    assert harvest(spark, src, out, ckpt) == [("a", 1), ("b", 2)]
    # claims without rows: the batch stopped between its two writes
    arrive(spark, src, [("c", 3, "x")])
    write = jobs.write_table
    monkeypatch.setattr(jobs, "write_table", lambda df, tag: stop())
    with pytest.raises(Exception):  # noqa: B017
        harvest(spark, src, out, ckpt)
    monkeypatch.setattr(jobs, "write_table", write)
    assert harvest(spark, src, out, ckpt) == [("a", 1), ("b", 2), ("c", 3)]
    # another checkpoint offers everything again
    assert harvest(spark, src, out, str(tmp_path / "ckpt2")) == [("a", 1), ("b", 2), ("c", 3)]


def test_ledger_calls_each_key_once(spark, tmp_path):
    log = str(tmp_path / "log")
    os.mkdir(log)
    items = spark.createDataFrame([(f"i{i}", f"c{i % 2}", f"request {i // 2 if i < 4 else i}") for i in range(8)], "item_id string, context_id string, request string")
    prefixes = spark.createDataFrame([("c0", "zero"), ("c1", "one")], "context_id string, prefix string")

    def flaky(batch: pd.DataFrame) -> pd.DataFrame:
        for key in batch["item_id"]:
            at = os.path.join(log, f"{key}-{len(os.listdir(log))}-{os.getpid()}")
            if "request 6" in set(batch["request"]) and not os.path.exists(os.path.join(log, "failed")):
                open(os.path.join(log, "failed"), "w").close()
                raise ConnectionError("once")
            open(at, "w").close()
        out = batch[["item_id", "sample_idx"]].copy()
        out["text"] = batch["prefix"] + ":" + batch["request"] + ":" + batch["sample_idx"].astype(str)
        out["refusal"] = [None if "5" not in r else "declined" for r in batch["request"]]
        out["input"], out["cached"], out["cache_write"], out["output"] = 1, 2, 3, 4
        return out

    def answers(scorer, prefixes=prefixes, samples=2):
        return {(r["item_id"], r["sample_idx"]): (r["text"], r["refusal"]) for r in scoring.call_once(
            items, prefixes, scorer, str(tmp_path / "ledger"), samples).collect()}
    got = answers(flaky)
    assert got == {(f"i{i}", s): (f"{['zero', 'one'][i % 2]}:request {i // 2 if i < 4 else i}:{s}", "declined" if i == 5 else None)
                   for i in range(8) for s in (0, 1)}
    keys = [n.rsplit("-", 2)[0] for n in os.listdir(log) if n != "failed"]
    assert len(keys) == len(set(keys)) == 16 and os.path.exists(os.path.join(log, "failed"))

    def never(batch):
        raise AssertionError("asked again")
    assert answers(never) == got
    assert answers(never, samples=1) == {k: v for k, v in got.items() if k[1] == 0}
    # other prefixes are other calls
    other = answers(never, prefixes.withColumn("prefix", F.upper("prefix")))
    assert set(other.values()) == {(None, "no answer")}


def test_run_is_seen_whole_or_not_at_all(spark, tmp_path):
    folder = str(tmp_path)
    part = lambda n: spark.createDataFrame([(i,) for i in range(n)], "n int")
    writers.append_run({"metrics": part(1), "predictions": part(3)}, folder, "r1")
    writers.write_run_parts({"predictions": part(5)}, folder, "r2")
    seen = lambda name: sorted(r["run_id"] for r in readers.run_part(spark, folder, name).select("run_id").distinct().collect())
    assert seen("predictions") == ["r1"] and readers.run_part(spark, folder, "predictions").count() == 3
    writers.append_run({"metrics": part(1), "predictions": part(4)}, folder, "r2")
    assert seen("predictions") == seen("metrics") == ["r1", "r2"] and readers.run_part(spark, folder, "predictions").count() == 7
    with pytest.raises(ValueError):
        writers.append_run({"metrics": part(1)}, folder, "r1")
    writers.append_run({"metrics": part(2)}, folder, "r3")
    assert seen("metrics") == ["r1", "r2", "r3"] and seen("predictions") == ["r1", "r2"]
    assert json.dumps(seen("metrics"))
