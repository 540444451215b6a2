"""Joins, counts, periods, rankings, merges, clusters, changes and contracts."""

import random

import pytest
from pyspark.sql import functions as F

from fernweave.operators import aggregates, changes, clustering, joins, merging, periods, quality, ranking, rules


def test_first_and_last_match(spark):
    left = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    right = spark.createDataFrame([(1, 5, "b"), (1, 4, "a"), (2, 9, None)], "k int, seq int, v string")
    assert {tuple(r) for r in joins.with_match(left, right, ["k"], "seq").collect()} == {(1, "a"), (2, None), (3, None)}
    assert {tuple(r) for r in joins.with_match(left, right, ["k"], "seq", last=True, defaults={"v": "-"}).collect()} == {(1, "b"), (2, "-"), (3, "-")}
    assert joins.with_match(left, right.limit(0), ["k"], "seq").count() == 3


def test_both_sides_and_mismatches(spark):
    a = spark.createDataFrame([("x", 2), ("y", 1)], "k string, n long")
    b = spark.createDataFrame([("y", 5), ("z", 7)], "k string, n long")
    assert {tuple(r) for r in joins.both_sides(a, b, ["k"], ["n"]).collect()} == {("x", 2, 0), ("y", 1, 5), ("z", 0, 7)}
    got = {tuple(r) for r in joins.mismatches(a, b, "k", ["n"]).collect()}
    assert got == {("x", "row", "present", None), ("y", "n", "1", "5"), ("z", "row", None, "present")}


@pytest.mark.parametrize("width", [None, 10])
def test_as_of_against_brute_force(spark, width):
    rng = random.Random(1)
    a = [(i, rng.choice("pq"), rng.randrange(100)) for i in range(120)] + [(900, "none", 5)]
    b = list({(k, t): (k, t, j) for j, (k, t) in enumerate((rng.choice("pq"), rng.randrange(100)) for _ in range(60))}.values())
    left = spark.createDataFrame(a, "id int, k string, t long")
    right = spark.createDataFrame(b, "k string, t long, v int")
    got = {tuple(r) for r in joins.as_of(left, right, ["k"], "t", "t", ["v"], width).select("id", "v").collect()}
    want = set()
    for i, k, t in a:
        before = [x for x in b if x[0] == k and x[1] <= t]
        want.add((i, max(before, key=lambda x: x[1])[2] if before else None))
    assert got == want


def test_intervals(spark):
    points = spark.createDataFrame([("a", t) for t in range(0, 50, 3)], "k string, t long")
    spans = spark.createDataFrame([("a", 5, 21, 1), ("a", 20, 20, 2), ("b", 0, 99, 3)], "k string, s long, e long, id int")
    got = {(r.t, r.id) for r in joins.in_intervals(points, spans.where("e > s"), ["k"], "t", "s", "e", 7).collect()}
    assert got == {(t, 1) for t in range(0, 50, 3) if 5 <= t < 21}


def test_counts(spark):
    rows = spark.createDataFrame([("p", "a", 3), ("p", "a", 1), ("p", "", 2), ("p", None, 4)], "k string, v string, seq int")
    assert [tuple(r) for r in aggregates.distribution(rows, ["k"], F.col("v"), "seq").collect()] == [("p", "a", 2, 1)]
    assert rows.agg(aggregates.ordered_list(F.col("seq"), F.col("seq"), 2)).collect()[0][0] == [1, 2]
    empty = rows.select("v").limit(0)
    one = aggregates.precision_recall(empty, empty, ["v"]).collect()[0]
    assert (one.precision, one.recall) == (1.0, 1.0)
    maps = spark.sql("select map('a', 1) as x, map('a', 2, 'b', 3) as y").select(aggregates.added_maps(F.col("x"), F.col("y"))).collect()[0][0]
    assert maps == {"a": 3, "b": 3}


def test_periods(spark):
    rows = spark.createDataFrame([("x", t) for t in (89, 90, 99, 100, 109, 110, None)], "k string, t long")
    marked = rows.withColumn("period", periods.period_of(F.col("t"), 100, 10))
    assert [r.period for r in marked.orderBy("t").collect()] == [None, None, "before", "before", "after", "after", "after"]
    assert [tuple(r) for r in periods.compared(marked, ["k"]).collect()] == [("x", 2, 3, 1, "increased")]
    shift = periods.sentiment_shift(marked.withColumn("up", F.lit(True)), ["k"], F.col("up")).collect()[0]
    assert shift.direction == "insufficient_data"
    assert periods.coverage(marked, ["k"], "t", 100, 10).where("status = 'insufficient'").count() == 2
    cases = [(40, 40, "full", "full", 0.1), (40, 40, "full", "partial", 0.1), (7, 40, "full", "full", 0.0), (20, 80, "full", "full", None)]
    got = spark.createDataFrame(cases, "b int, a int, sb string, sa string, d double").select(F.round(periods.confidence(*[F.col(c) for c in ("b", "a", "sb", "sa", "d")]), 4).alias("c"))
    assert [(r.c, r.l) for r in got.select("c", periods.confidence_label(F.col("c")).alias("l")).collect()] == [(0.96, "high"), (0.69, "medium"), (0.39, "low"), (0.685, "medium")]


def test_rankings(spark):
    rows = spark.createDataFrame([(k, i, i % 3) for k in "ab" for i in range(9)], "k string, id int, v int")
    top = ranking.top_per_key(rows, ["k"], [F.col("v").desc(), F.col("id")], 2).collect()
    assert {(r.k, r.id) for r in top} == {("a", 2), ("a", 5), ("b", 2), ("b", 5)}
    sample = ranking.seeded_sample(rows, ["k"], F.col("id").cast("string"), 4, "s")
    assert sample.groupBy("k").count().where("count = 4").count() == 2
    assert {tuple(r) for r in sample.collect()} == {tuple(r) for r in ranking.seeded_sample(rows.repartition(3), ["k"], F.col("id").cast("string"), 4, "s").collect()}
    turns = [(r.turn, r.k) for r in ranking.interleaved(rows, ["k"], [F.col("id")], [F.col("k")], 5).collect()]
    assert turns == [(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "a")]


def test_merging(spark):
    rows = spark.createDataFrame([(3, "k", " ", ["b"]), (1, "k", None, ["a", "b"]), (2, "k", "v", None), (4, None, "w", []), (5, None, "w", [])], "seq int, key string, name string, tags array<string>")
    out = {(r.seq, r.name, r.records, tuple(r.tags or [])) for r in merging.merged(rows, F.col("key"), "seq", ["name"], ["tags"]).collect()}
    assert out == {(1, "v", 3, ("a", "b")), (4, "w", 1, ()), (5, "w", 1, ())}
    assert sorted(r.seq for r in merging.first_by_key(rows, F.col("key"), "seq").collect()) == [1, 4, 5]
    assert rows.where("key = 'k'").agg(merging.last_value(F.col("name"), F.col("seq"))).collect()[0][0] == " "


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)]
    parent = {k: k for k in [*range(60), *range(100, 141)]}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    nodes = spark.createDataFrame([(k,) for k in parent], "id long")
    got = {r.id: r.root for r in clustering.components(nodes, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: root(k) for k in parent}
    assert clustering.components(nodes, spark.createDataFrame([], "a long, b long")).where("id = root").count() == len(parent)


def test_similar_titles_against_all_pairs(spark):
    rng = random.Random(5)
    words = ["map", "menu", "save", "slots", "voice", "chat", "boss", "fights"]
    titles = [(i, "p", rng.sample(words, rng.randrange(1, 6))) for i in range(60)]
    frame = spark.createDataFrame(titles, "id long, block string, tokens array<string>")
    got = {tuple(r) for r in clustering.similar_titles(frame, ["block"], 0.5).collect()}
    want = {(a, b) for a, _, x in titles for b, _, y in titles if a < b and len(set(x) & set(y)) / len(set(x) | set(y)) >= 0.5}
    assert got == want


def test_greedy_pairs_against_the_sequential_rule(spark):
    rng = random.Random(9)
    scored = [(a, b, rng.choice([0.3, 0.5, 0.6, 0.7, 0.9])) for a in range(15) for b in range(100, 115) if rng.random() < 0.4]
    used, want = set(), set()
    for a, b, s in sorted(scored, key=lambda x: (-x[2], x[0], x[1])):
        if s >= 0.5 and a not in used and b not in used:
            used |= {a, b}
            want.add((a, b, s))
    got = {tuple(r) for r in clustering.greedy_pairs(spark.createDataFrame(scored, "a long, b long, score double"), 0.5).collect()}
    assert got == want


def test_snapshot_changes(spark):
    old = spark.createDataFrame([("a", 1.0, "x"), ("b", 2.0, None), ("c", 3.0, "z")], "k string, amount double, state string")
    new = spark.createDataFrame([("a", 1.5, "x"), ("b", None, "y"), ("d", 3.0, "z")], "k string, amount double, state string")
    got = {(r.k, r.change) for r in changes.snapshot_changes(old, new, "k", {"amount": ["amount"], "state": ["state"]}).collect()}
    assert got == {("a", "amountIncreased"), ("b", "amountChanged"), ("b", "stateChanged"), ("c", "removed"), ("d", "added")}


def test_contracts(spark):
    rows = spark.createDataFrame([(1, "a"), (2, ""), (3, None), (3, "x")], "id int, v string")
    rule = {"value": F.col("v") != ""}
    good, bad = quality.split_by_validity(rows, rule)
    assert good.count() == 2 and {tuple(r.violations) for r in bad.collect()} == {("value",)}
    assert [r.id for r in quality.duplicate_ids(rows, ["id"]).collect()] == [3]
    assert [r.id for r in quality.dangling(rows, rows.where("id < 3"), "id").select("id").distinct().collect()] == [3]
    with pytest.raises(Exception, match="CONTRACT"):
        quality.required(rows, rule).collect()


def test_rules(spark):
    frame = spark.createDataFrame([("the menu crashes but it is great", None), ("", True), ("x", False)], "low string, up boolean")
    got = frame.select(rules.topics_of(F.col("low"), rules.GAME_RULES), rules.sentiment_of(F.col("low"), rules.GAME_RULES, F.col("up")), rules.hits(F.col("low"), rules.GAME_RULES.positive)).collect()
    assert [tuple(r) for r in got] == [(["crashes", "userInterface"], "mixed", 1), ([], "positive", 0), ([], "negative", 0)]
    assert rules.taxonomy(["a", "b"], ["b", "c"]) == ["a", "b", "c"]


def test_patch_scores(spark):
    items = [("Patch notes 1.2", "fix a bug", True, False), ("Summer sale", "nothing", False, True), ("Update 3", "", False, None), (None, None, None, None)]
    rows = spark.createDataFrame(items, "title string, body string, latest boolean, outside boolean")
    got = rows.select(rules.patch_score(F.col("title"), F.col("body"), F.col("latest"), F.col("outside")).alias("s")).collect()
    assert [r.s for r in got] == [100, 0, 40, 15]
