import random
from dataclasses import replace

import pytest

from stratalog.config import ParsingConfig
from stratalog.operators import mining, templates

CONFIG = ParsingConfig(similarity_threshold=0.6, extra_delimiters=[])


def plain_miner(messages, config):
    """Templates as of each message: a list that is searched from its start, no tree classes."""
    levels, known, stock, clock, last, out = max(config.depth - 3, 0) + 1, {}, [], 0, 0, []
    for text in messages:
        words, clock = text.split(), clock + 1
        node = (len(words),)
        for w in words[:levels]:
            words_here = known.setdefault(node, [])
            if not any(c.isdigit() for c in w) and w not in words_here and len(words_here) < config.max_children:
                words_here.append(w)
            node += (w if w in words_here and not any(c.isdigit() for c in w) else "<*>",)
        fits = [(sum(a == b for a, b in zip(t["words"], words)) / max(len(words), 1), t["words"].count("<*>"), -t["id"], t) for t in stock if t["node"] == node]
        best = max(fits, key=lambda f: f[:3], default=None)
        if best and (best[0] >= config.similarity_threshold or not words):
            t = best[3]
            t["words"] = [a if a == b else "<*>" for a, b in zip(t["words"], words)]
        else:
            last += 1
            t = {"id": last, "node": node, "words": words}
            stock.append(t)
            if len(stock) > config.max_clusters:
                stock.remove(min(stock[:-1], key=lambda x: x["used"]))
        t["used"] = clock
        out.append((t["id"], " ".join(t["words"])))
    return out


def log(n, kinds=60, seed=5):
    """Messages of many kinds, in any order: kinds differ in half of their words, lines of one in two."""
    rng = random.Random(seed)
    fixed = [[f"verb{'abcdefgh'[k % 8]}", f"k{chr(97 + k // 26)}{chr(97 + k % 26)}", *(f"x{chr(97 + (k * j) % 26)}{chr(97 + (k // 3) % 26)}" for j in range(4))] for k in range(kinds)]
    out = []
    for _ in range(n):
        words = list(rng.choice(fixed))
        out.append(" ".join([*words, rng.choice(["red", "green", "blue"]), str(rng.randrange(9))]))
    return out


@pytest.mark.parametrize("change", [{}, {"max_clusters": 20}, {"max_children": 3}, {"similarity_threshold": 0.9}, {"depth": 6}, {"similarity_threshold": 0.3, "max_clusters": 7}])
def test_sequential_miner_against_plain_one(change):
    config = replace(CONFIG, **change)
    tree, messages = templates.TemplateTree(config), log(600)
    got = [tree.add(m.split()) for m in messages]
    assert got == plain_miner(messages, config)
    assert len({i for i, _ in got}) >= 50 or change


def frame(spark, streams):
    rows = [(s, i, m) for s, messages in streams.items() for i, m in enumerate(messages)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "datastream string, line_no long, Content string")


@pytest.mark.parametrize("change, part", [({}, 4), ({}, 1000), ({"max_children": 3}, 4), ({"depth": 3}, 7)])
def test_merged_parts_are_as_mined_in_order(spark, change, part):
    config, streams = replace(CONFIG, **change), {"a": log(500), "b": log(200, 9, 6), None: log(30, 2, 7)}
    got = {(r.datastream, r.line_no): (r.TemplateId, r.EventTemplate) for r in mining.merged_templates(frame(spark, streams), config, "datastream", part).collect()}
    assert len(got) == 730
    for s, messages in streams.items():
        ids = [i for i, _ in plain_miner(list(dict.fromkeys(messages)), config)]
        by_message = dict(zip(dict.fromkeys(messages), ids))
        last = dict(plain_miner(list(dict.fromkeys(messages)), config))
        assert [got[s, i] for i in range(len(messages))] == [(by_message[m], last[by_message[m]]) for m in messages]


def test_odd_messages(spark):
    rows = spark.createDataFrame([(1, ""), (2, None), (3, "  "), (4, "one"), (5, "two"), (6, "one"), (7, "w " * 3000)], "line_no long, Content string")
    got = {r.line_no: r.EventTemplate for r in mining.merged_templates(rows, CONFIG).collect()}
    assert set(got) == {1, 3, 4, 5, 6, 7} and got[1] == got[3] == "" and got[4] == got[6] == "one" and got[5] == "two"
    assert mining.merged_templates(rows.limit(0), CONFIG).count() == 0
    assert templates.extract_templates(rows, replace(CONFIG, mine="drain_merged")).count() == 6
