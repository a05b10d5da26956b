"""Record readers by byte ranges against plain loops over whole files."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom import schema as S
from gradeloom.session import materialise
from gradeloom.sources import ranges, readers


@pytest.fixture
def tiny_splits(spark, monkeypatch):
    """Text is read in splits of a few bytes; what the readers write is read back in usual ones."""
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def reset():
        for k, v in keep.items():
            spark.conf.set(k, v)

    def use(size):
        def written(df, tag):
            out = materialise(df, tag)
            reset()
            return out
        monkeypatch.setattr(ranges, "materialise", written)
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield use
    reset()


def plain_csv(text):
    """A character loop: quotes toggle, doubled ones inside are one, carriage returns outside are nothing."""
    rows, row, cell, quoted, i = [], [], "", False, 0
    while i < len(text):
        c = text[i]
        if quoted and c == '"' and text[i + 1:i + 2] == '"':
            cell, i = cell + '"', i + 1
        elif c == '"':
            quoted = not quoted
        elif quoted or c not in ',\n\r':
            cell += c
        elif c == ",":
            row, cell = [*row, cell], ""
        elif c == "\n":
            rows, row, cell = [*rows, [*row, cell]], [], ""
        i += 1
    return [*rows, [*row, cell]] if cell or row else rows


@pytest.mark.parametrize("size", [17, 90, 1 << 20])
def test_csv_ranges_equal_a_character_loop(spark, tmp_path, tiny_splits, size):
    rng = random.Random(size)
    names = ["id", "text", "more"]
    want = []
    for f in range(2):
        lines = ["﻿id,text,more\r\n" if f else "﻿\"id\",text,more\n"]
        for i in range(12):
            cells = [str(i), "".join(rng.choice(['a', 'é', '""', ',', '\n', '\r\n', ' ', "'"]) for _ in range(rng.randrange(20))), "z"]
            if rng.random() < 0.2:
                cells = cells[:2] if rng.random() < 0.5 else [*cells, "extra"]
            lines.append(",".join(f'"{c}"' if j == 1 or rng.random() < 0.3 else c for j, c in enumerate(cells)) + rng.choice(["\n", "\r\n"]))
        text = "".join(lines) + ('"open to the end\n,1,2' if f else "last,\"\"\"q\"\"\",")
        (tmp_path / f"f{f}.csv").write_bytes(text.encode())
        want += [r for r in plain_csv(text)[1:] if len(r) == 3]
    tiny_splits(size)
    assert spark.read.option("lineSep", "\n").text(str(tmp_path)).rdd.getNumPartitions() >= (5 if size < 100 else 1)
    got = readers.corpus_csv(spark, str(tmp_path))
    assert got.columns == names
    blank = lambda r: tuple(c if c.strip(" ") else None for c in r)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(blank, want)))


def test_csv_types_and_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("n,s\n1,x\nno number,y\n,z\n")
    typed = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("s", T.StringType())])
    assert sorted(map(str, map(tuple, readers.corpus_csv(spark, str(tmp_path / "a.csv"), typed).collect()))) == ["(1, 'x')", "(None, 'z')"]
    (tmp_path / "b.csv").write_text("")
    assert readers.corpus_csv(spark, str(tmp_path / "b.csv"), typed).collect() == []
    (tmp_path / "c.csv").write_text("only,header")
    assert readers.corpus_csv(spark, str(tmp_path / "c.csv")).collect() == []


def thread(rng, i):
    odd = ['"', "\\", "}", "{", "]", "[", ",", "\n", "é", "a", '\\"', "}{", '"}']
    text = lambda: "".join(rng.choice(odd) for _ in range(rng.randrange(12)))
    return {"t": f"t{i}", "u": text(), "b": [text() for _ in range(rng.randrange(4))], "us": [text()], "d": text()}


@pytest.mark.parametrize("size", [29, 1 << 20])
@pytest.mark.parametrize("indent", [None, 1])
def test_json_arrays_equal_a_whole_parse(spark, tmp_path, tiny_splits, size, indent):
    rng = random.Random(size)
    want = []
    for f in range(2):
        rows = [thread(rng, f"{f}-{i}") for i in range(9)]
        (tmp_path / f"f{f}.json").write_text(json.dumps(rows, indent=indent, ensure_ascii=bool(f)))
        want += rows
    (tmp_path / "none.json").write_text("[]")
    tiny_splits(size)
    got = [r.asDict() for r in readers.forum_threads(spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


@pytest.mark.parametrize("size", [31, 1 << 20])
@pytest.mark.parametrize("indent", [None, 2])
def test_members_of_an_object_keep_their_order(spark, tmp_path, tiny_splits, size, indent):
    rng = random.Random(7)
    rows = [{"id": f"i{i}{rng.choice(['', '}', '{', '[', chr(34)])}", "trueScore": i / 2, "predictedScore": 1.0, "labelSource": "x", "samples": [1.0] * (i % 3)} for i in range(10)]
    decoy = [{"id": "decoy", "trueScore": 9.0, "scores": [{"id": "deep"}]}]
    run = {"provider": "p\"}", "model": "m", "metrics": {"all": {"n": 1}}, "ladders": decoy, "predictions": rows, "failures": decoy, "predictions2": decoy}
    (tmp_path / "r.json").write_text(json.dumps(run, indent=indent))
    (tmp_path / "s.json").write_text(json.dumps({"provider": "q", "model": "n", "predictions": rows[:2]}))
    (tmp_path / "t.json").write_text(json.dumps({"provider": "q", "model": "none", "predictions": []}))
    tiny_splits(size)
    got = readers.evaluation_runs(spark, str(tmp_path / "*.json")).orderBy("run_id", "ordinal").collect()
    assert [(r["run_id"], r["provider"], r["ordinal"], r["id"], r["true_score"], r["samples"]) for r in got] == [
        *[("r.json", 'p"}', i, r["id"], r["trueScore"], r["samples"]) for i, r in enumerate(rows)],
        *[("s.json", "q", i, r["id"], r["trueScore"], r["samples"]) for i, r in enumerate(rows[:2])]]


def test_one_file_is_read_by_several_tasks(spark, tmp_path, tiny_splits):
    (tmp_path / "one.json").write_text(json.dumps([{"t": "x" * 50} for _ in range(200)]))
    tiny_splits(1000)
    rows = ranges.json_objects(spark, str(tmp_path))
    assert rows.count() == 200 and rows.select("start").distinct().count() >= 10
    assert rows.select(F.from_json("text", S.FORUM_THREAD).alias("v")).where("length(v.t) = 50").count() == 200


def test_long_csv_files_are_cut_into_several(spark, tmp_path):
    from gradeloom.sources import writers
    rows = [(None if i == 5 else i, i % 2 if i % 10 else None, f'text "{i}",\nline' * 20) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, half int, text string")
    writers.write_csv_files(df, str(tmp_path / "c"), "half", "id", file_chars=3000)
    files = sorted((tmp_path / "c").rglob("*.txt"))
    assert len(files) > 6 and max(f.stat().st_size for f in files) < 12_000
    assert all(f.read_text().startswith("\ufeffid,text\n") for f in files)
    got = readers.corpus_csv(spark, str(tmp_path / "c"))
    assert sorted((r["id"] or "", r["text"]) for r in got.collect()) == sorted(("" if i is None else str(i), t) for i, _, t in rows)
