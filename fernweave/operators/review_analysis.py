"""Analysis of a game review by rule tables: types, severity, triggers, actionability and titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernweave.operators.rules import GAME_RULES, hit, topics_of

# Further term lists of game reviews.
ISSUE_TERMS = ("crash", "freeze", "broken", "stutter", "disconnect", "missing", "unreliable", "stops", "not responding", "treo", "mất kết nối")
CRITICAL_TERMS = ("save corruption", "cannot launch", "can't launch", "account loss")
PLATFORM_TERMS = ("steam deck", "pc", "windows", "linux", "after update")
JOKE_TERMS = ("joke", "lol", "10/10", "meme")
SAVE_SLOT_TERMS = ("manual save", "save slots")
TRIGGERS = {
    "opening the inventory": ("crash", "freeze", "open", "opening"),
    "repeated occurrence": ("every time", "always", "whenever"),
    "after an update": ("after the latest update", "after update", "patch"),
    "reported trigger context": ("when ", "during ", "while "),
}
# Types of feedback with the topics that show them, in order, and the order in which one type becomes the first.
ISSUE_TOPICS = ("crashes", "freezes", "disconnects", "saveSystem", "antiCheat")
TYPE_TOPICS = {
    "performanceIssue": ("stuttering", "frameRate", "loadingTime"),
    "stabilityIssue": ("stuttering", "frameRate", "loadingTime", "crashes", "freezes"),
    "controllerIssue": ("controllerSupport",),
    "steamDeckIssue": ("steamDeck",),
    "localizationIssue": ("localization", "subtitles"),
    "matchmakingIssue": ("matchmaking",),
    "multiplayerIssue": ("matchmaking",),
    "serverIssue": ("disconnects", "servers"),
    "usabilityIssue": ("userInterface",),
}
PRIMARY = "featureRequest bugReport performanceIssue controllerIssue steamDeckIssue localizationIssue usabilityIssue positiveFeedback generalComplaint nonActionable".split()
ISSUE_TYPES = "bugReport performanceIssue controllerIssue steamDeckIssue localizationIssue usabilityIssue serverIssue matchmakingIssue".split()
SCORED_TYPES = "bugReport performanceIssue featureRequest controllerIssue localizationIssue".split()
# Titles of issues by their topics, first match wins.
TITLES = (
    (("crashes", "inventory"), "all", "Reported crash when opening the inventory"),
    (("freezes", "loadingTime"), "all", "Reported freezes during loading"),
    (("stuttering", "frameRate"), "any", "Reported frame-rate and stuttering problem"),
    (("controllerSupport",), "any", "Reported controller input problem"),
    (("localization",), "any", "Reported missing or unclear localization"),
    (("saveSystem",), "any", "Reported save-system reliability problem"),
    (("disconnects",), "any", "Reported network disconnects"),
    (("antiCheat",), "any", "Reported cheating or anti-cheat concern"),
)
SEVERITIES = ("critical", "high", "medium", "low", "unknown")
TITLE_CHARS = 80


def _any_of(items: Column, names) -> Column:
    return F.arrays_overlap(items, F.array(*map(F.lit, names)))


def _settled(rows: DataFrame, **values: Column) -> DataFrame:
    """`rows` with further columns behind a generator, so that filters on them don't repeat their expressions."""
    return rows.select("*", F.inline(F.array(F.struct(*[v.alias(n) for n, v in values.items()]))))


def analyse(rows: DataFrame, text: str, recommended: str) -> DataFrame:
    """`rows` with `topics`, `types`, `primary_type`, `sentiment`, `severity`, `triggers`, `points`, `actionable`, `title` and `request_title`.

    `points` is the actionability score. A null text counts as an empty one. Lists keep the order of the rule tables.
    """
    whole = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"^\s+|\s+$", "")
    rows = _settled(rows, _whole=whole, _low=F.lower(whole))
    low, whole, topics, types = F.col("_low"), F.col("_whole"), F.col("topics"), F.col("types")
    rows = _settled(rows, topics=topics_of(low, GAME_RULES), _good=hit(low, GAME_RULES.positive), _bad=hit(low, GAME_RULES.negative), _request=hit(low, GAME_RULES.requests))
    good, bad, request, issue = (F.col(f"_{c}") for c in ("good", "bad", "request", "issue"))
    signs = [F.when(hit(low, terms) & (F.array_contains(topics, "inventory") if k == 0 else F.lit(True)), F.lit(sign)) for k, (sign, terms) in enumerate(TRIGGERS.items())]
    rows = _settled(rows, _issue=hit(low, ISSUE_TERMS) | _any_of(topics, ISSUE_TOPICS), triggers=F.array_compact(F.array(*signs)))
    tests = {"featureRequest": request, "bugReport": issue} | {t: _any_of(topics, names) for t, names in TYPE_TOPICS.items()}
    tests |= {"positiveFeedback": good & ~bad, "generalComplaint": bad & ~issue & ~request}
    rows = _settled(rows, _types=F.array_compact(F.array(*[F.when(test, F.lit(t)) for t, test in tests.items()])))
    rows = _settled(rows, types=F.when(F.size("_types") > 0, F.col("_types")).otherwise(F.array(F.lit("nonActionable"))))
    primary = F.coalesce(*[F.when(F.array_contains(types, t), F.lit(t)) for t in PRIMARY], F.lit("nonActionable"))
    severity = (
        F.when(hit(low, CRITICAL_TERMS), "critical")
        .when(_any_of(topics, ("crashes", "freezes")) | F.array_contains(types, "performanceIssue"), "high")
        .when(_any_of(types, ("bugReport", "controllerIssue", "localizationIssue")), "medium")
        .otherwise("unknown")
    )
    vote = F.col(recommended)
    sentiment = (
        F.when(good & bad, "mixed").when(good | F.coalesce(vote, F.lit(False)), "positive").when(bad | F.coalesce(~vote, F.lit(False)), "negative").otherwise("neutral")
    )

    def worth(test: Column, n: int) -> Column:
        return F.when(test, n).otherwise(0)

    points = (
        F.lit(5)
        + worth(F.length(whole) >= 30, 18)
        + worth(F.size(topics) > 0, 28)
        + worth(_any_of(types, SCORED_TYPES), 25)
        + worth((F.size("triggers") > 0) | hit(whole, PLATFORM_TERMS), 18)
        - worth(hit(whole, JOKE_TERMS), 15)
    )
    points = F.when(F.length(whole) < 10, 8).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), points))) / 100
    first = F.trim(F.substring(whole, 1, TITLE_CHARS))
    title = F.when(F.size(topics) > 0, F.concat(F.lit("Reported problem with "), F.get(topics, F.lit(0)))).when(first == "", "Reported player concern").otherwise(first)
    for names, mode, words in reversed(TITLES):
        test = _any_of(topics, names) if mode == "any" else F.size(F.array_intersect(topics, F.array(*map(F.lit, names)))) == len(names)
        title = F.when(test, words).otherwise(title)
    wish = F.when(hit(low, SAVE_SLOT_TERMS), "manual save slots").otherwise(F.concat(F.lit("Improve "), F.coalesce(F.get(topics, F.lit(0)), F.lit("the game experience"))))
    rows = _settled(rows, primary_type=primary, severity=severity, sentiment=sentiment, points=points, title=F.when(_any_of(types, ISSUE_TYPES), title), _wish=wish)
    rows = _settled(rows, actionable=F.col("points") >= 0.45, request_title=F.when(F.col("primary_type") == "featureRequest", F.col("_wish")))
    return rows.drop("_whole", "_low", "_good", "_bad", "_request", "_issue", "_types", "_wish")
