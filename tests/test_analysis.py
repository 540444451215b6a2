"""Review analysis by the rule tables, on the twelve labelled texts, and platform matches."""

from fernweave.operators import clustering, patterns, review_analysis
from pyspark.sql import functions as F

TEXTS = [
    ("The game crashes every time I open the inventory after the latest update.", False, "bugReport", "negative", "high", "Reported crash when opening the inventory"),
    ("Bad game.", False, "generalComplaint", "negative", "unknown", None),
    ("The combat feels great and the world design is excellent.", True, "positiveFeedback", "positive", "unknown", None),
    ("Please add manual save slots and a better inventory filter.", True, "featureRequest", "positive", "medium", "Reported save-system reliability problem"),
    ("The frame rate stutters badly on Steam Deck after entering a crowded area.", False, "bugReport", "negative", "high", "Reported frame-rate and stuttering problem"),
    ("Controller support is broken: the right trigger stops responding in menus.", False, "bugReport", "negative", "medium", "Reported controller input problem"),
    ("On Steam Deck the game freezes during loading and the battery drain is severe.", False, "bugReport", "negative", "high", "Reported freezes during loading"),
    ("The Vietnamese subtitles are missing and several menu strings are untranslated.", False, "bugReport", "negative", "medium", "Reported missing or unclear localization"),
    ("Trò chơi bị treo khi mở kho đồ và mất kết nối thường xuyên.", False, "bugReport", "negative", "high", "Reported network disconnects"),
    ("good", True, "positiveFeedback", "positive", "unknown", None),
    ("10/10 would let the tutorial boss destroy me again.", True, "nonActionable", "positive", "unknown", None),
    ("The save system is unreliable, matchmaking disconnects, and the UI is hard to navigate.", False, "bugReport", "negative", "medium", "Reported save-system reliability problem"),
]


def test_labelled_texts(spark):
    rows = spark.createDataFrame([(k, t, v, "x") for k, (t, v, *_) in enumerate(TEXTS)], "k int, text string, positive boolean, topic string")
    got = {r.k: r for r in review_analysis.analyse(rows, "text", "positive").collect()}
    for k, (_, _, primary, sentiment, severity, title) in enumerate(TEXTS):
        assert (got[k].primary_type, got[k].sentiment, got[k].severity, got[k].title) == (primary, sentiment, severity, title), k
    assert got[0].triggers == ["opening the inventory", "repeated occurrence", "after an update"] and got[0].points == 0.94 and got[0].actionable
    assert got[3].request_title == "manual save slots" and got[9].points == 0.08


def test_null_and_empty_texts(spark):
    rows = spark.createDataFrame([(None, None), ("", True)], "text string, positive boolean")
    got = review_analysis.analyse(rows, "text", "positive").collect()
    assert [(r.primary_type, r.sentiment, r.points) for r in got] == [("nonActionable", "neutral", 0.08), ("nonActionable", "positive", 0.08)]


def test_wishes_and_topics(spark):
    rows = spark.createDataFrame([("It would be nice to have  a photo mode!!",), ("Please add bows.\nThanks",), ("nothing",), (None,), ("the FPS drops; dropfps",)], "t string")
    got = [tuple(r) for r in rows.select(patterns.wish_in(F.col("t")), patterns.topics_in(F.col("t"))).collect()]
    assert [g[0] for g in got] == ["a photo mode", "bows", None, None, None] and got[4][1] == ["performance"]


def test_platform_scores(spark):
    rows = spark.createDataFrame([(["crashes"], ["crashes"], ["reported", "crash"], ["reported", "crash"], "high", "high", 4, 2), (["a"], ["b"], ["x"], ["y"], "high", "unknown", 1, 1)], "topics_a array<string>, topics_b array<string>, tokens_a array<string>, tokens_b array<string>, severity_a string, severity_b string, ma int, mb int")
    got = clustering.platform_score(rows).select("hundredths", clustering.dominance("ma", "mb")).collect()
    assert [tuple(r) for r in got] == [(100, "dominant_a"), (7, "shared")]


def test_ids_of_all_dishes(spark, tmp_path):
    from fernweave.plans import report_queries

    names = ["Crème brûlée", "Phở bò đặc biệt", "寿司", "", None, "Ｓoup", "寿司"]
    rows = [(k, n, "x") for k, n in enumerate(names)]
    spark.createDataFrame(rows, "item_id long, nameOriginal string, dish_id string").write.parquet(str(tmp_path / "menu_items.parquet"))
    got = {r.item_id: r.dish_id for r in report_queries.er_2_slug_ids(spark, str(tmp_path)).collect()}
    assert got[0] == "dish-creme-brulee" and got[1] == "dish-pho-bo-dac-biet" and got[4] is None
    assert got[2] == got[6] and got[2].startswith("dish-") and len({got[k] for k in (0, 1, 2, 3, 5)}) == 5
