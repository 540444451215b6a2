"""Parameters of runs: what a caller gives, brought to checked values with defaults and bounds."""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

MOST_IDS = 10
MOST_REVIEWS = 10_000
SAMPLE_BOUNDS = (10, 250)
WINDOW_BOUNDS = (1, 30)


class InvalidInput(ValueError):
    """A parameter that can't be used; the message begins with `INVALID_INPUT`."""

    def __init__(self, reason: str) -> None:
        super().__init__(f"INVALID_INPUT: {reason}")


def bounded(value: object, low: int, high: int, default: int, name: str = "value") -> int:
    """A whole number within bounds, the default for nothing."""
    if value is None or value == "":
        return default
    try:
        number = int(str(value))
    except ValueError:
        raise InvalidInput(f"{name} must be a whole number") from None
    return min(max(number, low), high)


def one_of(value: str | None, allowed: Sequence[str], default: str, name: str = "value") -> str:
    """One of the allowed words in any case, the default for nothing."""
    if not value:
        return default
    word = str(value).strip().lower()
    if word not in allowed:
        raise InvalidInput(f"{name} must be one of {', '.join(allowed)}")
    return word


def app_ids(values: Iterable[object]) -> tuple[str, ...]:
    """Distinct numeric ids out of ids and addresses, in order."""
    found = []
    for v in values:
        m = re.search(r"(?:/app/|[?&](?:id|appid)=)?(\d{1,12})(?:\D|$)", str(v).strip())
        if m is None:
            raise InvalidInput(f"no id in {v!r}")
        found.append(m[1])
    return tuple(dict.fromkeys(found))


def day(value: str | None) -> datetime.date | None:
    """A calendar day written as YYYY-MM-DD; days that don't exist are refused."""
    if not value:
        return None
    try:
        return datetime.date.fromisoformat(value)
    except ValueError:
        raise InvalidInput(f"{value!r} is no day") from None


@dataclass(frozen=True)
class ReviewRun:
    """A collection of game reviews, optionally compared around a day."""

    ids: tuple[str, ...]
    languages: tuple[str, ...] = ("english",)
    kind: str = "recent"
    start: datetime.date | None = None
    end: datetime.date | None = None
    most: int = 100
    sample: int = 80
    boundary: datetime.date | None = None
    window_days: int = 14

    @classmethod
    def of(cls, given: Mapping) -> ReviewRun:
        """A run out of loosely typed values."""
        ids = app_ids([*given.get("ids", ()), *given.get("urls", ())])
        if not 1 <= len(ids) <= MOST_IDS:
            raise InvalidInput(f"1 to {MOST_IDS} ids are needed")
        start, end = day(given.get("start")), day(given.get("end"))
        if start and end and start > end:
            raise InvalidInput("start is after end")
        languages = tuple(dict.fromkeys(x.strip().lower() for x in given.get("languages", ()) if x and x.strip())) or ("english",)
        return cls(
            ids,
            languages,
            one_of(given.get("kind"), ("recent", "updated", "all"), "recent", "kind"),
            start,
            end,
            bounded(given.get("most"), 1, MOST_REVIEWS, 100, "most"),
            bounded(given.get("sample"), *SAMPLE_BOUNDS, 80, "sample"),
            day(given.get("boundary")),
            bounded(given.get("window_days"), *WINDOW_BOUNDS, 14, "window_days"),
        )


@dataclass(frozen=True)
class ProductMapping:
    """Products with their ids on each platform, and the countries and languages to ask for."""

    products: Mapping[str, Mapping[str, str]]
    countries: tuple[str, ...] = ("us",)
    languages: tuple[str, ...] = ("en",)
    most_requests: int = 500

    @classmethod
    def of(cls, given: Mapping) -> ProductMapping:
        """A mapping in which no platform id belongs to two products and the requests stay within their budget."""
        products: dict[str, dict[str, str]] = {}
        owners: dict[tuple[str, str], str] = {}
        for p in given.get("products", ()):
            name, platforms = str(p.get("id") or "").strip(), {k: str(v).strip() for k, v in (p.get("platforms") or {}).items() if v}
            if not name or not platforms:
                raise InvalidInput("a product needs an id and a platform")
            for key in platforms.items():
                if owners.setdefault(key, name) != name:
                    raise InvalidInput(f"{key[1]} belongs to {owners[key]} and {name}")
            products.setdefault(name, {}).update(platforms)
        made = cls(products, tuple(dict.fromkeys(given.get("countries") or ("us",))), tuple(dict.fromkeys(given.get("languages") or ("en",))), bounded(given.get("most_requests"), 1, 5000, 500))
        if not products:
            raise InvalidInput("no products")
        if made.requests > made.most_requests:
            raise InvalidInput(f"{made.requests} requests are more than {made.most_requests}")
        return made

    @property
    def requests(self) -> int:
        """How many pages are asked for at least."""
        return sum(len(p) for p in self.products.values()) * len(self.countries) * len(self.languages)


def search_jobs(terms: Mapping[str, Sequence[str]], locations: Sequence[str], languages: Sequence[str]) -> list[tuple[str, str]]:
    """(term, location) for the distinct terms of all languages."""
    words = list(dict.fromkeys(t.strip() for lang in languages for t in terms.get(lang, ()) if t.strip()))
    return [(w, place) for place in dict.fromkeys(locations) for w in words]
