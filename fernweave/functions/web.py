"""Web address and contact expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Second-level labels under which registrable names stand.
SECOND_LEVELS = ("co", "com", "org", "net", "gov", "edu", "ac")


def host_of(url: Column) -> Column:
    """The host in lower case without `www.`; null where there is none."""
    host = F.regexp_extract(F.lower(F.trim(url)), r"^(?:[a-z][a-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]+)", 1)
    bare = F.regexp_replace(host, r"^(www\d*|m)\.", "")
    return F.when(bare.contains("."), bare)


def registrable_domain(url: Column) -> Column:
    """The last two labels of the host, or three under a second-level label."""
    labels = F.split(host_of(url), r"\.")
    n = F.when((F.size(labels) > 2) & F.element_at(labels, -2).isin(*SECOND_LEVELS), 3).otherwise(2)
    return F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")


def normal_url(url: Column) -> Column:
    """An http(s) address without query, fragment and closing slashes; others are null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"[?#].*$", ""), r"/+$", "")
    return F.when(F.lower(url).rlike(r"^\s*https?://[^/\s]+"), bare)


def canonical_url(url: Column) -> Column:
    """https, no `www.`, no fragment, no tracking parameters, no closing slash, host in lower case."""
    address = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"(?i)^https?://(www\.)?", "")
    host, rest = F.lower(F.regexp_extract(address, r"^([^/?]*)", 1)), F.regexp_extract(address, r"^[^/?]*(.*)$", 1)
    rest = F.regexp_replace(rest, r"(?i)([?&])(?:utm_[a-z]+|fbclid|gclid|ref)=[^&]*", "$1")
    rest = F.regexp_replace(F.regexp_replace(rest, r"([?&])&+", "$1"), r"[?&]+$", "")
    return F.concat(F.lit("https://"), host, F.regexp_replace(rest, r"/+(\?|$)", "$1"))


def query_value(url: Column, name: str) -> Column:
    """The value of a query parameter, or null."""
    value = F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1)
    return F.when(value != "", value)


def emails_in(text: Column) -> Column:
    """Distinct addresses in a text, in lower case, in the order they occur."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9._%+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)+)"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda e: ~e.rlike(r"\.(png|jpe?g|gif|webp|svg)$")))


def email_kind(address: Column) -> Column:
    """What a mailbox is for, by its local part."""
    local = F.regexp_extract(F.lower(address), r"^([^@]+)@", 1)
    return (
        F.when(local.rlike(r"^(info|hello|contact|office|desk|mail)"), "general")
        .when(local.rlike(r"^(sales|quote|orders?)"), "sales")
        .when(local.rlike(r"^(support|help|service)"), "support")
        .when(local.rlike(r"^(jobs?|careers?|hr)"), "hiring")
        .when(local.rlike(r"^(press|media|marketing)"), "press")
        .otherwise("personal")
    )


def phone_digits(value: Column) -> Column:
    """A leading plus and the digits of a number of seven digits or more; else null."""
    bare = F.regexp_replace(value, r"[^0-9+]", "")
    bare = F.concat(F.regexp_extract(bare, r"^(\+?)", 1), F.replace(bare, F.lit("+"), F.lit("")))
    return F.when(F.length(F.replace(bare, F.lit("+"), F.lit(""))) >= 7, bare)


def public_host(url: Column) -> Column:
    """True for addresses of public names: no literal address, local name, private range or credentials."""
    host = host_of(url)
    literal = host.rlike(r"^[0-9.]+$") | host.rlike(r"\.(local|localhost|internal|lan)$") | url.rlike(r"^[a-z]+://[^/]*@")
    return F.coalesce(host.isNotNull() & ~literal, F.lit(False))
