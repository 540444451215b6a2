"""Rule sets as data: terms of topics, sentiments and requests over lower-cased text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RuleSet:
    """Topics with their terms, in order, and the terms of either sentiment and of requests."""

    topics: Mapping[str, Sequence[str]]
    positive: Sequence[str]
    negative: Sequence[str]
    requests: Sequence[str]


# Terms of the topics, sentiments and requests of game reviews.
GAME_RULES = RuleSet(
    topics={
        "crashes": ("crash", "crashes", "crashing", "crashed"),
        "freezes": ("freeze", "freezes", "freezing", "frozen", "bị treo", "đóng băng", "treo"),
        "stuttering": ("stutter", "stutters", "stuttering", "giật"),
        "frameRate": ("frame rate", "frame-rate", "fps", "frames per second"),
        "loadingTime": ("loading", "load time", "loading time", "tải"),
        "disconnects": ("disconnect", "disconnects", "disconnected", "mất kết nối"),
        "matchmaking": ("matchmaking", "match making"),
        "saveSystem": ("save", "saving", "save system", "progress lost", "lưu"),
        "combat": ("combat", "fighting", "fight", "chiến đấu"),
        "inventory": ("inventory", "backpack", "items", "kho đồ", "túi đồ"),
        "controllerSupport": ("controller", "gamepad", "right trigger", "tay cầm"),
        "steamDeck": ("steam deck", "steamdeck"),
        "localization": ("translation", "translated", "untranslated", "localization", "dịch", "tiếng việt"),
        "subtitles": ("subtitle", "subtitles", "phụ đề"),
        "userInterface": ("ui", "menu", "navigate", "navigation", "interface", "giao diện"),
        "worldDesign": ("world design", "worldbuilding", "thế giới"),
        "difficulty": ("difficulty", "difficult", "hard", "khó"),
        "antiCheat": ("anti-cheat", "anticheat", "cheater", "cheating", "gian lận"),
        "servers": ("server", "servers", "máy chủ"),
    },
    positive=("good", "great", "excellent", "love", "fun", "enjoy", "amazing", "recommend", "tốt", "tuyệt", "hay"),
    negative=("bad", "awful", "poor", "broken", "crash", "freeze", "stutter", "missing", "untranslated", "severe", "unreliable", "terrible", "treo", "mất", "gian lận"),
    requests=("please add", "add ", "i want", "would like", "request", "should have", "mong muốn", "hãy thêm", "thêm "),
)


def hit(low: Column, terms: Sequence[str]) -> Column:
    """True if any term occurs in the lower-cased text."""
    test = F.lit(False)
    for t in terms:
        test = test | low.contains(t)
    return test


def hits(low: Column, terms: Sequence[str]) -> Column:
    """How many of the terms occur."""
    total = F.lit(0)
    for t in terms:
        total = total + low.contains(t).cast("int")
    return total


def topics_of(low: Column, rules: RuleSet) -> Column:
    """Topics whose terms occur, in the order of the rules."""
    return F.array_compact(F.array(*[F.when(hit(low, terms), F.lit(topic)) for topic, terms in rules.topics.items()]))


def sentiment_of(low: Column, rules: RuleSet, recommended: Column | None = None) -> Column:
    """positive, negative, mixed or neutral by the terms that occur, else by the reader's own recommendation."""
    vote = F.lit(None).cast("boolean") if recommended is None else recommended
    good, bad = hit(low, rules.positive), hit(low, rules.negative)
    return F.when(good & bad, "mixed").when(good | F.coalesce(vote, F.lit(False)), "positive").when(bad | F.coalesce(~vote, F.lit(False)), "negative").otherwise("neutral")


def taxonomy(*lists: Sequence[str]) -> list[str]:
    """The union of lists, each name once, in order."""
    return list(dict.fromkeys(name for names in lists for name in names))


# Words of news titles and texts that speak for or against patch notes, and the score in hundredths from which an item counts.
PATCH_TITLES = ("patch", "patch notes", "hotfix", "major update", "balance update", "maintenance update", "changelog")
UPDATE_TITLES = ("update", "version", "fixes")
CHANGE_TERMS = ("fix", "bug", "balance", "change", "improvement", "crash", "stability")
PROMOTION_TERMS = ("sale", "discount", "bundle", "soundtrack", "merch", "award")
EVENT_TERMS = ("tournament", "esports", "contest", "stream", "predictions", "fantasy", "supporter")
PATCH_ACCEPTED = 65
# Networks whose domains belong to no firm.
PROFILE_HOSTS = r"(^|\.)(facebook|instagram|linkedin|twitter|x|youtube|tiktok|pinterest|yelp)\.com$|(^|\.)(social|pages)\."


def patch_score(title: Column, content: Column, is_latest: Column, external: Column | None = None) -> Column:
    """How much a news item looks like patch notes, in hundredths from 0 to 100."""
    low, body = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(content, F.lit("")))
    outside = F.lit(False) if external is None else F.coalesce(external, F.lit(False))
    score = F.when(hit(low, PATCH_TITLES), 45).when(hit(low, UPDATE_TITLES), 25).otherwise(0) + F.when(hits(body, CHANGE_TERMS) >= 2, 20).otherwise(0) + F.when(outside, -20).otherwise(15)
    score = score + F.when(title.rlike(r"(?i)\b(?:v|version\s*)?\d+\.\d+(?:[a-z])?\b"), 10).otherwise(0) + F.when(is_latest, 10).otherwise(0)
    score = score - F.when(hit(low, PROMOTION_TERMS), 40).otherwise(0) - F.when(hit(low, EVENT_TERMS), 30).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), score))
