"""Word patterns as data: topics of game feedback, wishes, services and industries of firms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of each topic of game feedback; a word counts between letters and digits only.
GAME_TOPICS = {
    "performance": "fps|frame rate|frames|stutter|stutters|stuttering|lag|laggy|slow|performance|optimization|optimisation|loading",
    "crashes_stability": "crash|crashes|crashed|crashing|freeze|freezes|frozen|freezing|hang|hangs|unstable",
    "bugs": "bug|bugs|glitch|glitches|broken|issue|issues|error|errors",
    "balance": "balance|balanced|overpowered|underpowered|op|nerf|buff|unfair",
    "gameplay": "gameplay|mechanic|mechanics|combat|mission|missions|level|levels|fun",
    "controls_input": "controller|controls?|input|keyboard|mouse|gamepad|joystick|keybind|keybinds",
    "matchmaking": "matchmaking|queue|queues|ranked|rank",
    "servers_network": "server|servers|network|online|disconnect|disconnects|ping|latency|connection",
    "content": "content|map|maps|character|characters|weapon|weapons|story|campaign|mode|modes",
    "progression_grind": "progression|grind|grinding|grindy|unlock|unlocks|leveling|levelling|battle pass",
    "monetization": "microtransaction|microtransactions|monetization|monetisation|pay[- ]to[- ]win|dlc|loot box|lootbox",
    "ui_ux": "interface|menu|menus|ui|ux|hud|usability|user experience",
    "graphics_visuals": "graphics|visuals?|texture|textures|lighting|resolution|art style",
    "audio": "audio|sound|sounds|music|voice acting|voices",
    "modding": "mod|mods|modding|workshop",
    "anti_cheat": "cheat|cheating|cheaters|anti[- ]cheat|anticheat",
    "accessibility": "accessibility|subtitles|colorblind|colourblind|blind mode|difficulty options",
    "localization": "translation|translations|localization|localisation|language|languages|german|french|spanish",
    "steam_deck": "steam deck|steamdeck|deck verified|deck",
}
# Ways to ask for something; what is asked for follows.
WISHES = (
    r"please add\s+",
    r"(?:wish|希望)\s+(?:there was|we had|for)\s+",
    r"would like\s+",
    r"would be nice\s+(?:to have|to add|if there were)\s+",
    r"can we get\s+",
    r"should add\s+",
    r"(?:need|needs)\s+(?:a|an|more)\s+",
    r"option to\s+",
    r"support for\s+",
)
WISH_CHARS = 240
# Services and industries of firms by the words of their labels, in order.
SERVICES = (
    (r"\bbookkeep", "bookkeeping"), (r"\bcash[ -]?flow", "cash_flow_management"), (r"\bforecast", "budgeting_forecasting"), (r"\bbudget", "budgeting_forecasting"), (r"\bpayroll", "payroll"),
    (r"\btax preparation", "tax_preparation"), (r"\btax planning", "tax_planning"), (r"\btax", "tax"), (r"\baudit", "audit"), (r"\bassurance", "assurance"), (r"\bbusiness advis", "business_advisory"),
    (r"\bmanagement accounting", "management_accounting"), (r"\bfinancial reporting", "financial_reporting"), (r"\b(?:outsourced|virtual) cfo", "outsourced_cfo"),
    (r"\bcompany (?:formation|incorporation)", "company_formation"), (r"\baccounts payable", "accounts_payable"), (r"\baccounts receivable", "accounts_receivable"), (r"\bmigrat", "migration"),
    (r"\btraining", "training"), (r"\b(?:software|system) setup", "software_setup"), (r"\binventory accounting", "inventory_accounting"), (r"\baccounting", "accounting"),
)
INDUSTRIES = (
    (r"\b(?:e[ -]?commerce|online retail)", "ecommerce"), (r"\b(?:computer|software)", "technology"), (r"\bconstruction", "construction"), (r"\bagricultur", "agriculture"), (r"\beducation", "education"),
    (r"\bfinancial services", "financial_services"), (r"\bhealth(?:care)?", "healthcare"), (r"\b(?:hospitality|hotel|restaurant)", "hospitality"), (r"\blegal", "legal"), (r"\bmanufactur", "manufacturing"),
    (r"\b(?:nonprofit|not-for-profit|charit)", "nonprofit"), (r"\bprofessional services", "professional_services"), (r"\b(?:property|real estate)", "property_real_estate"), (r"\bretail", "retail"),
    (r"\btechnology", "technology"), (r"\b(?:transport|logistics)", "transport_logistics"), (r"\btrades?", "trades"), (r"\bwholesale(?: distribution)?", "wholesale"), (r"\bsmall business", "general_small_business"),
)


def words_in(text: Column, words: str) -> Column:
    """True if one of the words occurs in `text`, whatever its case, with no letter, digit or underscore beside it."""
    return text.rlike(rf"(?i)(?<![A-Za-z0-9_])(?:{words})(?![A-Za-z0-9_])")


def topics_in(text: Column) -> Column:
    """Topics of game feedback whose words occur, in order."""
    return F.array_compact(F.array(*[F.when(words_in(text, words), F.lit(topic)) for topic, words in GAME_TOPICS.items()]))


def wish_in(text: Column) -> Column:
    """What a text asks for by the first way of asking that occurs, or null."""
    found = [F.regexp_extract(text, rf"(?i)(?<![A-Za-z0-9_]){way}([^\n\r]+)", 1) for way in WISHES]
    wish = F.coalesce(*[F.when(f != "", f) for f in found])
    short = F.substring(F.trim(F.regexp_replace(wish, r"\s+", " ")), 1, WISH_CHARS)
    return F.trim(F.regexp_replace(short, r"[.!?]+$", ""))


def mapped(labels: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Names that the labels stand for: label by label, rule by rule, each name once."""
    each = F.transform(labels, lambda label: F.array_compact(F.array(*[F.when(F.coalesce(label.rlike(f"(?i){pattern}"), F.lit(False)), F.lit(name)) for pattern, name in rules])))
    return F.array_distinct(F.flatten(F.filter(each, lambda x: x.isNotNull())))
