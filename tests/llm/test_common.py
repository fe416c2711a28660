import tempfile
import os
import random

import pytest

from stratalog.llm import common
from stratalog.llm.common import components, free_name, shared_dir


def union_find(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("block", [3, 200_000])
def test_components(spark, monkeypatch, block):
    monkeypatch.setattr(common, "EDGES", block)
    random.seed(1)
    chain = [(i, i + 1) for i in range(100, 170)]
    zigzag = [(300 + i // 2 if i % 2 else 400 - i // 2, 300 + (i + 1) // 2 if i % 2 == 0 else 400 - (i + 1) // 2) for i in range(60)]
    star = [(1000, i) for i in range(1001, 1060)] + [(1900, i) for i in range(1800, 1860)]
    loose = [(random.randrange(2000, 2200), random.randrange(2000, 2200)) for _ in range(120)]
    edges = chain + star + zigzag + [e for e in loose if e[0] != e[1]] + chain[:3]
    random.shuffle(edges)
    found = components(spark.createDataFrame(edges + [(5, 5)], "u long, v long").repartition(7)).collect()
    got = {r.node: r.root for r in found}
    assert len(got) == len(found) and got == {n: r for n, r in union_find(edges).items() if n != r}


def test_discarded_tables_are_gone(spark):
    table = common.stored(spark.range(3), "some")
    path = table.inputFiles()[0].removeprefix("file:").removeprefix("//")
    assert os.path.exists(path)
    common.discard(table, spark.range(2))
    assert not os.path.exists(path)


def test_clusters_need_a_shared_folder():
    class Session:
        conf = {}
        sparkContext = type("C", (), {"master": "spark://host", "getCheckpointDir": lambda self=None: None})()

    with pytest.raises(ValueError):
        shared_dir(Session)


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_shared_dir_is_the_configured_one(spark):
    assert shared_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))


def test_free_name(spark):
    assert free_name(spark.createDataFrame([(1, 2)], "Hit long, _hit long"), "hit") == "__hit"


def test_stages_keep_columns_of_any_name(spark):
    import corpus_pipeline

    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    names = ["doc_id", "a.b", "text", "A.B", "lang", "c d`e", "source", "n_chars", "Key", "id"]
    docs = spark.createDataFrame([(i, {"k": 1}, f"{text} {i} {i * 7}\nand a line", "x", "en", [1], "web", 9, "y", "z") for i in range(6)],
                                 "doc_id long, p map<string,int>, text string, q string, lang string, r array<int>, source string, n_chars long, s string, t string").toDF(*names)
    folder = tempfile.mkdtemp(prefix="spark-tables-")
    spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, text)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        assert all(r[1] == {"k": 1} and r[3] == "x" and r[5] == [1] for r in out.collect())
