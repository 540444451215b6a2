"""Test items in documents, against brute-force alignment."""

import random

from fernweave.llm import leakage as K

DOCS, ITEMS = "doc_id long, text string, t string, words int", "item_id long, text string, t string"
WORDS = [f"w{k}x" for k in range(400)]


def sample(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


def found(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], DOCS)
    b = spark.createDataFrame([(i, t, "x") for i, t in items], ITEMS)
    return {(r.doc_id, r.item_id) for r in K.leaked_items(d, "doc_id", "text", b, "item_id", "text").collect()}


def planted(seed=7):
    rng = random.Random(seed)
    items = [(k, sample(rng, rng.randrange(38, 56))) for k in range(25)]
    docs, truth = [], set()
    for d in range(400):
        body = sample(rng, rng.randrange(5, 200))
        i, words = rng.choice(items)
        kind, at = d % 6, rng.randrange(0, len(body))
        if kind == 0:
            part = list(words)
        elif kind == 1:
            n = rng.randrange(18, 30)
            s = rng.randrange(0, len(words) - n)
            part = words[s : s + n]
            for _ in range(2):
                part[rng.randrange(1, n - 1)] = "changed"
        elif kind == 2:
            n = rng.randrange(5, 11)
            s = rng.randrange(0, len(words) - n)
            part = words[s : s + n]
        elif kind == 3:
            part = rng.sample(words, len(words))
        else:
            part = []
        if kind in (0, 1):
            truth.add((d, i))
        text = " ".join(body[:at]) + " " + " ".join(f"<b>{w.upper()}</b>," if rng.random() < 0.1 else w for w in part) + " " + " ".join(body[at:])
        docs.append((d, text))
    return docs, [(i, " ".join(w)) for i, w in items], truth


def test_planted_passages(spark):
    docs, items, truth = planted()
    got = found(spark, docs, items)
    assert len(got & truth) >= 0.97 * len(truth) and len(got - truth) <= 1


def test_many_items_are_joined_without_a_broadcast(spark, monkeypatch):
    docs, items, _ = planted()
    whole = found(spark, docs, items)
    monkeypatch.setattr(K, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(K, "BROADCAST_CANDIDATES", 0)
    assert found(spark, docs, items) == whole


def test_short_items_in_long_documents(spark):
    rng = random.Random(6)
    items = [(1, "Zebra"), (2, "blue zebra"), (3, "blue zebra runs"), (4, "the blue zebra runs home now"), (5, "zebra blue")]
    docs = [(k, " ".join(sample(rng, 300) + tail.split() + sample(rng, 300))) for k, tail in enumerate(["A ZEBRA!", "blue, zebra", "blue <b>zebra</b> runs", "the blue zebra runs home now", "nothing"])]
    assert found(spark, docs, items) == {(0, 1), (1, 1), (1, 2), (2, 1), (2, 2), (2, 3), (3, 1), (3, 2), (3, 3), (3, 4)}


def test_nulls_short_items_repeats_and_empty(spark):
    item = " ".join(WORDS[:40])
    docs = [(1, None), (2, ""), (3, "hi"), (4, item), (4, item), (5, "q " * 60_000 + item)]
    assert found(spark, docs, [(1, item), (2, None), (3, ""), (4, "two words"), (5, " ".join(WORDS[3:9]))]) == {(4, 1), (5, 1), (4, 5), (5, 5)}
    assert found(spark, [], []) == set() == found(spark, docs, []) == found(spark, [], [(1, item)])


def test_added_and_left_out_words():
    a, _ = K._codes([[f"a{k}" for k in range(20)], [f"a{k}" for k in range(10)] + ["new"] + [f"a{k}" for k in range(10, 20)]])
    assert K.longest_stretch(a[20:], a[:20]) >= 20
    assert K.longest_stretch(a[:12], a[8:20]) < 6
