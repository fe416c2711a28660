import re

import corpus_pipeline
import __spark_entry__ as entry
from stratalog.llm import quality as Q
from tests.llm import test_decontaminate, test_lines, test_packing, test_simhash
from tests.llm.test_common import union_find
from tests.llm.test_lines import row_hash


def test_stages(spark, make, corpus, tmp_path):
    good = [(i, t, "x") for i, t in corpus]
    junk = [(1000 + i, " ".join(w.upper() + "!!" for w in t.split()), "x") for i, t in corpus[:60]]
    bench = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    docs = spark.createDataFrame(good + junk + [(2000, f"see {bench} there", "x"), (2001, corpus[0][1], "x")], "doc_id long, text string, lang string")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 1000)) for i, _, _ in good + junk], "doc_id long, quality int").write.parquet(f"file://{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    sf = f"file://{tmp_path}"
    found, at = {}, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, at, sf)
        assert out.columns == docs.columns
        out.write.parquet(f"{sf}/stage-{k}")
        at = spark.read.parquet(f"{sf}/stage-{k}")
        found[name] = {r.doc_id for r in at.select("doc_id").collect()}
    assert not {i for i, _, _ in junk} & found["quality"] and len(found["quality"]) > 140
    assert 2001 not in found["line_dedup"] and 2000 not in found["benchmark_decontamination"]
    packed = {r.doc_id for r in corpus_pipeline.run(spark, sf).select("doc_id").collect()}
    assert packed == found["benchmark_decontamination"]


def test_registered():
    names = entry.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and set(entry.oracle_sql()) <= set(names)


def after_lines(rows):
    gone = test_lines.brute(rows)
    for i, t in rows:
        if g := gone.get((i is None, i, row_hash(i, t))):
            t = "\n".join(s for k, s in enumerate(t.split("\n")) if k not in g)
            if not t.strip():
                continue
        yield i, t


def after_copies(rows):
    fps = {t: test_simhash.by_definition(t) for _, t in rows}
    root = union_find([(a, b) for a in fps.values() for b in fps.values() if a > b and bin(a ^ b).count("1") <= 3])
    least = {}
    for i, t in rows:
        r = root.get(fps[t], fps[t])
        least[r] = min((i is None, i or 0, row_hash(i, t), i, t), least.get(r, (2,)))
    return [m[3:] for m in least.values()]


def after_benchmark(rows, items):
    words = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    for i, t in rows:
        n, hit, _ = test_decontaminate.brute(t, items)
        if hit and 20 * hit >= n:
            continue
        if hit:
            at = [m.span() for m in words.finditer(t)]
            own = test_decontaminate.split(items[0][1])
            starts = [k for k in range(n) if [t[a:b].lower() for a, b in at[k : k + len(own)]] == own]
            for k in reversed(starts):
                t = t[: at[k][0]] + t[at[k + len(own) - 1][1] :]
        yield i, t


def test_against_brute_force(spark, corpus, tmp_path):
    """Every stage's rows, each from its own input, by comparing everything with everything."""
    bench = "one two three four five six seven eight nine ten eleven twelve thirteen"
    good = [(i, t) for i, t in corpus] + [(5, corpus[9][1]), (None, corpus[10][1] + "\nno id"), (None, None), (900, ""), (901, corpus[11][1]), (901, f"{corpus[12][1]} tail")]
    good += [(910, f"{bench} {corpus[13][1]} end"), (911, " ".join(f"w{k}x" for k in range(400)) + f" {bench} stop"), (912, bench)]
    junk = [(1000 + i, " ".join(w.upper() + "!!" for w in t.split())) for i, t in corpus[:60]]
    docs = spark.createDataFrame([(*r, "x") for r in good + junk], "doc_id long, text string, lang string")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, int(i < 1000)) for i, _ in good + junk if i is not None], "doc_id long, quality int")
    labels.write.parquet(f"file://{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    sf, rows, at = f"file://{tmp_path}", good + junk, docs
    model = Q.train(docs, labels)
    brute = {
        "quality": lambda rows: [r for r in rows if model.scores(Q.term_vector(r[1])[None])[0] >= 0.5],
        "line_dedup": lambda rows: list(after_lines(rows)),
        "near_dedup": after_copies,
        "benchmark_decontamination": lambda rows: list(after_benchmark(rows, [(1, bench)])),
    }
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, at, sf).write.parquet(f"{sf}/brute-{k}")
        at = spark.read.parquet(f"{sf}/brute-{k}")
        want = brute[name](rows)
        rows = [(r.doc_id, r.text) for r in at.collect()]
        assert sorted(rows, key=str) == sorted(want, key=str), name
    assert 912 not in {i for i, _ in rows} and any(i == 911 and "twelve" not in t for i, t in rows)
    test_packing.check(rows, corpus_pipeline.run(spark, sf).collect())
