"""Languages of texts, on held-out rows of known languages."""

import random

from pyspark.sql import functions as F

from fernweave.llm import language as L

SCHEMA = "id long, label string, t string, lang string, segment int"
SAYINGS = {
    "english": "the game runs|my friends and I|played for hours with|a rather slow menu|but the music is|worth the money today|after the last update|nothing works at all",
    "german": "das Spiel läuft|meine Freunde und ich|haben viele Stunden|mit einem langsamen Menü|aber die Musik ist|das Geld heute wert|nach dem letzten Patch|funktioniert überhaupt nichts",
    "french": "le jeu tourne bien|mes amis et moi|avons joué des heures|avec un menu trop lent|mais la musique vaut|bien son prix aujourd'hui|après la mise à jour|plus rien ne marche",
    "spanish": "el juego funciona bien|mis amigos y yo|hemos jugado horas|con un menú muy lento|pero la música vale|su precio hoy mismo|después del último parche|ya no funciona nada",
    "russian": "игра работает хорошо|мои друзья и я|играли много часов|с медленным меню|но музыка стоит|своих денег сегодня|после последнего патча|ничего не работает",
    "japanese": "このゲームは楽しい|友達と一緒に|何時間も遊びました|メニューが遅いです|音楽は素晴らしい|値段に見合います|最新のパッチのあと|何も動きません",
}
CODES = {"english": "en", "german": "de", "french": "fr", "spanish": "es", "russian": "ru", "japanese": "ja"}


def text(rng, name):
    return " ".join(rng.sample(SAYINGS[name].split("|"), 4)) + "."


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    rows, truth = [], {}
    for k in range(n):
        name = rng.choice(list(SAYINGS))
        label, body = name, text(rng, name)
        kind = k % 10
        if kind == 0:
            label = rng.choice([None, "", "unknown", "n/a"])
        elif kind == 1:
            label = rng.choice([x for x in SAYINGS if x != name])
        elif kind == 2:
            other = rng.choice([x for x in SAYINGS if x != name])
            body += "\n" + text(rng, other)
            truth[k] = {CODES[name], CODES[other]}
        elif kind == 3:
            label = CODES[name] + "-XX"
        if kind in (0, 1):
            truth[k] = {CODES[name]}
        rows.append((k, label, body, "zz", 1))
    return rows, truth


def test_planted_labels_and_mixtures(spark):
    rows, truth = corpus()
    rows += [(9000 + k, "german", t, None, None) for k, t in enumerate([None, "", "gg", "10/10", "👍👍", "GG WP", "..."])]
    got: dict = {}
    for r in L.mislabelled(spark.createDataFrame(rows, SCHEMA), "id", "label", "t").collect():
        got.setdefault(r.id, set()).add(r.lang)
    right = sum(got.get(k) == v for k, v in truth.items())
    assert right >= 0.95 * len(truth)
    assert len(set(got) - set(truth)) <= 0.02 * len(rows)
    assert not any(k >= 9000 for k in got)


def test_held_out_accuracy_and_confidence():
    rng = random.Random(2)
    names = [rng.choice(list(SAYINGS)) for _ in range(600)]
    model = L.train([text(rng, n) for n in names], [CODES[n] for n in names])
    fresh = [rng.choice(list(SAYINGS)) for _ in range(300)]
    found = L.judge([text(rng, n) for n in fresh], model)
    assert sum(bool(f) and f[0][2] == CODES[n] for f, n in zip(found, fresh)) >= 0.97 * 300
    assert all(0 <= c <= 1.0001 for f in found for *_, c in f)


def test_segments_of_a_mixed_text():
    rng = random.Random(3)
    names = [rng.choice(list(SAYINGS)) for _ in range(600)]
    model = L.train([text(rng, n) for n in names], [CODES[n] for n in names])
    mixed = text(rng, "german") + "\n\n" + text(rng, "french") + " " + text(rng, "french")
    (a, b) = L.judge([mixed], model)[0]
    assert (a[2], b[2]) == ("de", "fr") and a[1] <= b[0] and mixed[b[0] : b[1]].startswith(mixed.split("\n\n")[1][:10])
    lone = text(rng, "german") + " Gameplay"
    assert {x[2] for x in L.judge([lone], model)[0]} == {"de"}


def test_labels(spark):
    labels = [None, " ", "n/a", "und", "ENGLISH", "en-US", "schinese ", "latam", "pt_BR", "koreana", "xx", "klingon?"]
    frame = spark.createDataFrame([(x,) for x in labels], "label string")
    got = [r[0] for r in frame.select(L.label_code(F.col("label"))).collect()]
    assert got == [None, None, None, None, "en", "en", "zh", "es", "pt", "ko", "xx", None]


def test_empty_table_and_long_text(spark):
    assert L.mislabelled(spark.createDataFrame([], SCHEMA), "id", "label", "t").count() == 0
    rows, _ = corpus()
    rows.append((5000, None, "das Spiel läuft und meine Freunde haben viele Stunden. " * 20_000, None, None))
    got = {(r.id, r.lang) for r in L.mislabelled(spark.createDataFrame(rows, SCHEMA), "id", "label", "t").collect()}
    assert (5000, "de") in got


def test_rejected_texts_keep_a_row(spark):
    rows, _ = corpus()
    rows += [(9000 + k, "german", t, None, None) for k, t in enumerate([None, "", "gg", "10/10", "👍👍", " \n"])]
    got = {r.id: (r.lang, r.confidence) for r in L.languages(spark.createDataFrame(rows, SCHEMA), "id", "label", "t").where("segment = 0").collect()}
    assert len(got) == len(rows) and all(got[k][0] is None and 0 <= got[k][1] <= 1 for k in range(9000, 9006))
