"""Texts that look the same."""

import random
import unicodedata

from fernweave.llm import lookalikes as L

SCHEMA = "id long, grp string, t string, key string, raw string"


def found(spark, rows):
    frame = spark.createDataFrame([(i, g, t, "x", None) for i, g, t in rows], SCHEMA)
    return {(r.id_a, r.id_b) for r in L.alike_pairs(frame, "id", "grp", "t").collect()}


def test_forms_that_look_the_same_meet(spark):
    same = ["Crème de céleri", unicodedata.normalize("NFD", "Crème de céleri"), "Crème de céleri", "Cr​ème de­ céleri", "Ｃrème de céleri", "Crèmе dе célеri".replace("C", "С")]
    rows = [(k, "a", t) for k, t in enumerate(same)]
    assert found(spark, rows) == {(a, b) for a in range(6) for b in range(a + 1, 6)}


def test_visible_differences_stay(spark):
    texts = ["Creme de celeri", "Crème de céleri", "CRÈME DE CÉLERI", "Crème de céleri!", "Crème de céleri*", "10/10", "👨‍👩‍👧 10/10", "👨👩👧 10/10", "соседкой", "соседкои", "a\nb", "a b"]
    assert found(spark, [(k, "a", t) for k, t in enumerate(texts)]) == set()


def test_equal_texts_other_groups_nulls_and_empty(spark):
    rows = [(1, "a", "x y"), (2, "a", "x y"), (3, "a", "x y"), (4, "b", "x y"), (5, "a", None), (6, "a", ""), (7, None, "x y"), (8, None, "x y"), (9, "a", "​"), (10, "a", "x y")]
    assert found(spark, rows) == {(1, 3), (2, 3), (1, 10), (2, 10), (6, 9)}
    assert found(spark, []) == set()


def test_long_texts_are_read_whole(spark):
    long = "word " * 40_000
    assert found(spark, [(1, "a", long + "end"), (2, "a", long + "ｅnd"), (3, "a", long + "and")]) == {(1, 2)}


def test_canonical_spelling_comes_from_the_vocabulary(spark):
    frame = spark.createDataFrame([(1, "a", "графика держится", None, None), (2, "a", "графикa держится", None, None), (3, "a", "Нonеy ок", None, None), (4, "a", "Honey", None, None)], SCHEMA)
    forms = {r.id: r.canonical for r in L.canonical_forms(frame, "id", "grp", "t").collect()}
    assert forms[1] == forms[2] == "графика держится"
    assert forms[3].startswith("Honey ")
    words = {r.token: r.word for r in L.canonical_words(frame, "t").collect()}
    assert words["графикa"] == "графика" and words["Нonеy"] == "Honey"


def test_trie_counts_other_edits():
    trie = L.VocabularyTrie()
    for word, n in (("honey", 5), ("money", 9), ("hone", 1)):
        trie.add(word, n)
    assert trie.match("hоnеy") == "honey"
    assert trie.match("h​oney") == "honey"
    assert trie.match("hney") is None
    assert trie.match("hney", 1) == "honey"
    assert trie.match("loney", 1) == "money"


def test_skeleton_equality_against_brute_force(spark):
    rng = random.Random(4)
    other = {v: chr(k) for k, v in L.PROTOTYPE.items()}
    base = ["Smoked Tofu Bowl", "Cơm chay đặc biệt", "Überbackene Knödel", "Несмотря на цену"]
    rows, plain = [], []
    for k in range(80):
        text = rng.choice(base)
        mixed = "".join(other.get(c, c) if rng.random() < 0.2 else c for c in text)
        mixed = unicodedata.normalize(rng.choice(["NFC", "NFD"]), mixed)
        mixed = "".join(c + ("⁠" if rng.random() < 0.05 else "") for c in mixed)
        rows.append((k, "a", mixed))
        plain.append(text)
    want = {(a, b) for a in range(80) for b in range(a + 1, 80) if plain[a] == plain[b] and rows[a][2] != rows[b][2]}
    assert found(spark, rows) == want


def test_rows_come_through_the_tries(spark, monkeypatch):
    rows = [(1, "a", "графика держится"), (2, "a", "графикa держится"), (3, "a", "грaфика держитcя"), (4, "a", "Ελληνικά νερά"), (5, "a", "Ελληvικά νερά"), (6, "a", "сор"), (7, "a", "cop"), (8, "a", "соp")]
    want = {(1, 2), (1, 3), (2, 3), (4, 5), (6, 7), (6, 8), (7, 8)}
    assert found(spark, rows) == want
    monkeypatch.setattr(L, "_canonical_words", lambda split: split.select("token", L.F.col("form").alias("word")).limit(0))
    assert found(spark, rows) < want


def test_characters_that_draw_nothing_or_the_same(spark):
    plain = "first flow-chart IV"
    same = [plain, "ﬁrst ﬂow-chart Ⅳ", "first\u202a flow\u2010chart IV\u202c", "\u2066first\u2069 flow\u2011chart\ufe00 IV", "fi\U000e0041rst flow-chart IV", "first fӏow-chart IV"]
    rows = [(k, "a", t) for k, t in enumerate(same)] + [(20, "a", "\U0001f3f4 x"), (21, "a", "\U0001f3f4\U000e0067\U000e0062\U000e007f x"), (22, "a", "firſt flow-chart IV"), (23, "a", "first flow–chart IV")]
    assert found(spark, rows) == {(a, b) for a in range(6) for b in range(a + 1, 6)}


def test_blocks_hold_all_spellings_of_a_word():
    for word, other in (("графика", "гpафиka"), ("Honey", "Нοnеу"), ("crème", "cre\u0300me"), ("first", "ﬁrst"), ("ab", "a\u200bb")):
        assert L.block_of(word) == L.block_of(other)
