"""JSON arrays over many file splits, against the json module."""

import json
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.errors import PythonException

from stratalog.sources.arrays import array_elements, read_json_array, scan_piece, write_json_arrays
from stratalog.sources.readers import read_json


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield spark
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def _rows(n: int, seed: int = 3) -> list[dict]:
    rnd, odd = random.Random(seed), ['}{"', "[[", "\\", '\\"}', "]},{", "é ", "\n", ""]
    return [
        {"id": i, "text": "".join(rnd.choices(odd, k=rnd.randrange(6))), "in": {"a": [{"b": i}, {"b": -i}], "c": {}},
         "long": rnd.choice(["", "x}" * 900]) if i % 17 == 0 else None}
        for i in range(n)
    ]


def _lines(spark, path) -> list[dict]:
    return sorted((json.loads(r.value) for r in spark.read.text(array_elements(spark, str(path))).collect()), key=lambda r: r["id"])


@pytest.mark.parametrize("indent", [None, 1])
def test_elements_of_many_splits_are_those_of_the_document(small_splits, tmp_path, indent):
    rows, path = _rows(300), tmp_path / "a.json"
    path.write_text(json.dumps(rows, indent=indent, ensure_ascii=False), encoding="utf-8")
    assert small_splits.read.option("lineSep", "}").text(str(path)).rdd.getNumPartitions() > 20
    assert _lines(small_splits, path) == rows
    got = read_json(small_splits, str(path)).orderBy("id").collect()
    assert [(r.id, r.text, r["in"].a[1].b) for r in got] == [(r["id"], r["text"], -r["id"]) for r in rows]


def test_a_folder_of_arrays_and_sides_that_are_merged(small_splits, tmp_path, monkeypatch):
    rows = _rows(120)
    for k in range(3):
        (tmp_path / f"{k}.json").write_text("﻿ \n" + json.dumps(rows[k * 40 : k * 40 + 40], indent=2) + "\n\n", encoding="utf-8")
    assert _lines(small_splits, tmp_path) == rows
    monkeypatch.setattr("stratalog.sources.arrays.MOST_SPLITS", 0)
    assert _lines(small_splits, tmp_path) == rows


def test_empty_arrays_and_repeated_rows(spark, tmp_path):
    (tmp_path / "none.json").write_text(" [ ]\n")
    assert read_json(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "same.json").write_text('[{"a":1},{"a":1} , {}, {"kind": "x", "a": null}]')
    got = read_json(spark, str(tmp_path / "same.json"))
    assert sorted(map(str, (r.asDict() for r in got.collect()))) == sorted(
        map(str, [{"a": 1, "kind": None}, {"a": 1, "kind": None}, {"a": None, "kind": None}, {"a": None, "kind": "x"}])
    )


def test_lines_are_still_lines(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"a": "["}\n{"a": "[{"}\n')
    assert sorted(r.a for r in read_json(spark, str(tmp_path / "l.json")).collect()) == ["[", "[{"]


def test_arrays_are_written_one_a_task(spark, tmp_path):
    rows = spark.createDataFrame([(i, None if i % 3 else "x\n}") for i in range(10)], "`a.b` long, t string").repartition(3)
    write_json_arrays(rows, f"{tmp_path}/out")
    write_json_arrays(rows.limit(0), f"{tmp_path}/none")
    got = sorted((r for p in (tmp_path / "out").glob("part-*") for r in json.loads(p.read_text())), key=lambda r: r["a.b"])
    assert got == [{"a.b": i} if i % 3 else {"a.b": i, "t": "x\n}"} for i in range(10)]
    assert read_json(spark, f"{tmp_path}/out").count() == 10 and read_json(spark, f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize("text", ['[{"a":1}', '[{"a":1', "[1, 2]", '[{"a":1}, null]', '[{"a":1}] x', '[{"a":"}]', '[[{"a":1}]]'])
def test_what_is_no_array_of_rows_is_an_error(spark, tmp_path, text):
    (tmp_path / "bad.json").write_text(text)
    with pytest.raises(PythonException, match="no object|does not end|no array"):
        read_json_array(spark, str(tmp_path / "bad.json")).collect()


@given(st.recursive(st.text() | st.integers() | st.none(), lambda c: st.lists(c) | st.dictionaries(st.text(), c), max_leaves=8))
def test_a_whole_value_is_balanced(value):
    quotes, outside, _ = scan_piece(json.dumps(value))
    assert quotes % 2 == 0 and outside == 0
