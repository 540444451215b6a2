"""Text expressions: cleaning, folding, slugs and markup."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_text(value: Column) -> Column:
    """White space runs as one blank, outer blanks off, nothing as null."""
    squeezed = F.trim(F.regexp_replace(value, r"[ \t\r\n\x0B\f]+", " "))
    return F.when(squeezed != "", squeezed)


def snippet(value: Column, limit: int) -> Column:
    """The first `limit` characters of the cleaned text."""
    return F.substring(clean_text(value), 1, limit)


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str]:
    """Letters of the Latin blocks with marks, and the same letters without; built by decomposition."""
    marked, bare = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = [c for c in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(c)]
        if len(base) == 1 and base[0] != chr(code):
            marked.append(chr(code))
            bare.append(base[0])
    return "".join(marked), "".join(bare)


def without_accents(value: Column) -> Column:
    """Latin text without its marks; letters with strokes stay, as they have no mark of their own."""
    marked, bare = _accent_table()
    return F.regexp_replace(F.translate(value, marked, bare), r"[\x{0300}-\x{036F}]", "")


def normal_title(value: Column) -> Column:
    """Lower-case letters and digits of a title with single blanks, accents and strokes off."""
    plain = without_accents(F.lower(F.translate(value, "đĐ×", "dDx")))
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def slug(value: Column, limit: int = 80) -> Column:
    """Lower-case letters and digits joined by dashes, at most `limit` characters."""
    dashed = F.regexp_replace(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.substring(dashed, 1, limit)


def looks_vietnamese(value: Column) -> Column:
    """Language guess by letters that only Vietnamese uses among the handled languages."""
    return F.when(F.lower(value).rlike("[ăâđêôơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ]"), "vi").otherwise("en")


def html_to_text(value: Column) -> Column:
    """Readable text of markup: scripts and comments out, block ends as line breaks, common entities decoded."""
    text = F.regexp_replace(value, r"(?is)<(script|style|noscript)\b[^>]*>.*?</\1\s*>", " ")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?i)<br\s*/?>|</(p|div|li|h[1-6]|tr|section)\s*>", "\n")
    text = F.regexp_replace(text, r"<[^>]+>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r" ?\n[ \n]*", "\n"))


def filled(template: str, **parts: Column) -> Column:
    """`template` with each `{name}` replaced by the column of that name."""
    text = F.lit(template)
    for name, part in parts.items():
        text = F.replace(text, F.lit("{" + name + "}"), part.cast("string"))
    return text


def redacted(value: Column) -> Column:
    """Secrets in query strings masked."""
    return F.regexp_replace(value, r"(?i)([?&](?:token|key|secret|password|access_token)=)[^&#\s]+", "$1***")
