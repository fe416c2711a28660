import random
import zlib

from stratalog.llm import quality as Q


def held_out(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def texts(n=600):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows = []
    for i in range(n):
        body = [rng.choice(words) for _ in range(rng.randint(20, 90))]
        good = i % 3 != 0
        rows.append((i, ". ".join(body) if good else " ".join(w.upper() + "!!" for w in body), int(good)))
    return rows


def frames(spark, make, rows):
    labels = [(i, q, 0, "x") for i, _, q in rows if i % 2 == 0]
    return make([(i, t) for i, t, _ in rows]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")


def test_held_out_accuracy(spark, make):
    rows = texts()
    docs, labels = frames(spark, make, rows)
    got = {r.doc_id: r for r in Q.score_quality(docs, labels, per_class=60).collect()}
    assert len(got) == len(rows) and all(got[i].held_out == held_out(i) for i, _, _ in rows)
    assert all((r.predicted == 1) == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got.values())
    out = [(got[i].predicted, q) for i, _, q in rows if held_out(i)]
    assert sum(p == q for p, q in out) / len(out) > 0.97
    kept = Q.keep_good(docs, labels).collect()
    assert len(kept) > 350 and all(r.removed == "x" for r in kept)


def test_held_out_labels_are_not_learned(spark, make):
    docs, labels = frames(spark, make, texts())
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 3 = 1, 1 - quality, quality) AS quality")
    one, two = (sorted(map(tuple, Q.score_quality(docs, x, per_class=50).collect())) for x in (labels, flipped))
    assert one == two


def test_odd_rows(spark, make, odd_rows):
    docs, labels = frames(spark, make, texts(60))
    labels = labels.unionByName(spark.createDataFrame([(None, 1, 0, "x"), (2, None, 0, "x"), (4, 0, 0, "x"), (4, 1, 0, "x")], labels.schema))
    both = docs.unionByName(make([(None if i is None else 1000 + i, t) for i, t in odd_rows]))
    got = Q.score_quality(both, labels).collect()
    assert len(got) == 60 + len(odd_rows)
    assert all(r.score == 0 and r.predicted == 0 for r in got if r.doc_id in (1002, 1003))
    assert Q.score_quality(make([]), labels).count() == 0
    assert all(r.score == 0 for r in Q.score_quality(docs, labels.limit(0)).collect())


def test_scores_against_loops(spark, make):
    """Every labelled vector compared with every document, one number at a time."""
    rows = texts(120)
    docs, labels = frames(spark, make, rows)
    model = Q.train(docs, labels)
    assert len(model.labels) == sum(i % 2 == 0 and not held_out(i) for i, _, _ in rows)
    got = {r.doc_id: r.score for r in Q.score_quality(docs, labels).collect()}
    for i, t, _ in rows[::7]:
        v = [float(x) for x in model.latent(Q.term_vector(t)[None])[0]]
        cosine = [sum(a * float(b) for a, b in zip(v, w)) for w in model.vectors]
        near = sorted(range(len(cosine)), key=lambda k: -cosine[k])[: Q.NEIGHBOURS]
        votes = [min(max(cosine[k], 0), 1) ** Q.SHARPNESS for k in near]
        want = sum(x * model.labels[k] for x, k in zip(votes, near)) / sum(votes)
        assert abs(got[i] - want) < 1e-4, i
