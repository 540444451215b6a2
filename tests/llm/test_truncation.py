"""Cut-off texts, planted."""

import random

from fernweave.llm import truncation as T

SCHEMA = "doc_id long, text string, source string, tail string, c1 string, n long"
SENTENCES = [
    "I refunded it after {n} hours since the skill tree crashes.",
    "Nobody warned me that the photo mode would be so charming.",
    "Please rework the map editor, because right now it feels broken.",
    "Hello {name}, thank you for telling us about the loot system.",
    "只要室友进来，{n}分钟就会闪退。",
    "Играю уже {n} часов с братом, и графика всё ещё тормозит.",
]
ENDERS = [" — the {name} team", " Cheers, {name}", " #{name} #gaming", " https://{name}.example/more", " £12.50", " Rating: 8/10", " ♥", " :)", " Time will tell…", " We shall see...", "\n- {name}"]


def planted(n=900, seed=10):
    rng = random.Random(seed)
    name = lambda: "".join(rng.choice("bdfgkl") + rng.choice("aeiou") for _ in range(4)).title()
    rows, cut = [], set()
    for d in range(n):
        text = " ".join(rng.choice(SENTENCES).format(n=rng.randrange(1, 900), name=name()) for _ in range(rng.randrange(2, 6)))
        if d % 5 == 0:
            at = rng.randrange(30, len(text) - 2)
            while text[at - 1] in " .。,，" or text[:at].rstrip()[-1] in ".。":
                at -= 1
            text = text[:at] + rng.choice(["", "…", "...", " ", "\n"])
            cut.add(d)
        elif d % 3 == 0:
            text += rng.choice(ENDERS).format(name=name())
        rows.append((d, text, "s"))
    return rows, cut


def found(spark, rows):
    frame = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)
    return T.cut_texts(frame, "doc_id", "text", "source")


def test_planted_cuts(spark):
    rows, cut = planted()
    got = {r.id for r in found(spark, rows).where("cut").collect()}
    assert len(got & cut) >= 0.97 * len(cut)
    assert len(got - cut) <= 0.01 * len(rows)


def test_prefix_of_a_longer_copy(spark):
    rows = [(k, "The whole story of this restaurant is long and good.", "s") for k in range(3)] + [(9, "The whole story of this rest", "s"), (9, "The whole story of this rest", "s")]
    marked = [r for r in found(spark, rows).collect()]
    assert [(r.id, r.cut, r.longer_copy) for r in marked] == [(9, True, True)] * 2


def test_nulls_empty_and_long(spark):
    rows = [(1, None, "s"), (2, "", "s"), (3, " \n", None), (4, "…", "s"), (5, "Done.", None), (6, "word " * 50_000 + "end.", "s")]
    assert {r.id for r in found(spark, rows).where("cut").collect()} == set()
    assert found(spark, []).count() == 0


def test_share_of_each_source(spark):
    rows, cut = planted(300)
    rows += [(5000, None, None), (5001, "Fine.", None)]
    frame = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)
    got = {r.source: (r.texts, r.cut) for r in T.cut_by_source(frame, "doc_id", "text", "source").collect()}
    assert got[None] == (1, 0) and got["s"][0] == 300 and abs(got["s"][1] - len(cut)) <= 3


def test_limit_of_texts_without_source(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(4))
    rows = [(k, " ".join(word() for _ in range(7))[:60], None if k % 2 else "feed") for k in range(40)]
    got = T.cut_texts(spark.createDataFrame(rows, "doc_id long, text string, source string"), "doc_id", "text", "source").where("at_limit and cut")
    assert sorted(r.id for r in got.collect()) == list(range(40))


def test_longer_values_against_brute_force(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("ab ") for _ in range(rng.randrange(1, 9)))
    values, ends = [word() for _ in range(600)], [word() for _ in range(300)]
    want = {e for e in ends if any(v.startswith(e) and v != e for v in values)}
    frames = [spark.createDataFrame([(x,) for x in d], "value string").repartition(7) for d in (values, ends)]
    assert {r.value for r in T.has_longer(*frames).collect()} == want
    assert T.has_longer(frames[0].limit(0), frames[1]).count() == 0 == T.has_longer(frames[0], frames[1].limit(0)).count()


def test_copies_decide_most_rows(spark, monkeypatch):
    rows, cut = planted()
    with_copies = {r.id for r in found(spark, rows).where("cut and longer_copy").collect()}
    assert len(with_copies & cut) >= 0.8 * len(cut)
    monkeypatch.setattr(T, "has_longer", lambda values, ends: ends.limit(0))
    monkeypatch.setattr(T, "GOES_ON_SHARE", 2.0)
    monkeypatch.setattr(T, "PREFIX_CHARS", 0)
    assert len({r.id for r in found(spark, rows).where("cut").collect()} & cut) < len(with_copies)


def test_whole_text_beats_a_finishing_end(spark):
    rows = [(1, "See the pictures at https://x.example/galle", "s"), (2, "See the pictures at https://x.example/gallery of ours.", "s"), (3, "Look: https://y.example/a", "s"), (4, "Nice. Rating: 8/10", "s"), (5, "Other. Rating: 8/100", "s")]
    assert {r.id for r in found(spark, rows).where("cut").collect()} == {1}


def test_wording_that_several_texts_end_with_is_finished(spark):
    rows = [(k, f"Text {'x' * 9 * k} is here for all of us. No words…", "s") for k in range(6)] + [(k, f"No entiendo las {k} cosas.", "s") for k in range(10, 20)]
    assert found(spark, rows).where("cut").count() == 0
