"""Address records of the same location, found by expanding and hashing their parts.

An address is folded (case, accents, widths, separators), freed of unit and country
notes and expanded into its plausible readings: house number, street name and kind of
street, and every wording that may be the town. Of several long numbers each may be the
house number or the postal code. Hashes of component combinations (number without its
suffix, street, and town or postal code) are exploded and joined; pairs with a shared
hash are kept unless house number, kind of street, town or postal code conflict. House
numbers conflict if they differ in digits or suffix; a range has the hashes of the
numbers of its side of the street and agrees with each of them. A street name may be
meant for each more frequent name of the data that is one typing error away, so a
misspelt address also has the hashes of those names.

Rows that say the same are first brought together to forms, and only forms are joined, so
a mall with a third of all listings is one form until its pairs are written out. Null,
blank and placeholder addresses, and addresses without a house number or a street, take
no part. Repeated ids pair like any rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernweave.session import cut_lineage

# Kinds of street with their usual spellings, after folding.
STREET_KINDS = {
    "street": "street st str strasse",
    "road": "road rd",
    "avenue": "avenue ave av",
    "lane": "lane la ln",
    "square": "square sq",
    "boulevard": "boulevard blvd boul bd",
    "drive": "drive dr",
    "court": "court ct",
    "place": "place pl platz",
    "terrace": "terrace ter",
    "way": "way wy weg",
    "highway": "highway hwy",
    "allee": "allee",
    "gasse": "gasse",
    "duong": "duong d",
}
# Names of countries as addresses end with them.
COUNTRIES = "united kingdom|great britain|england|uk|gb|united states of america|united states|usa|us|deutschland|germany|viet nam|vietnam|vn"

_KIND = {s: kind for kind, names in STREET_KINDS.items() for s in names.split()}
_BEFORE = {"duong", "d"}
_AFTER = set(_KIND) - _BEFORE
_GLUED = re.compile(r"^(\w{2,}?)-?(strasse|str|weg|platz|allee|gasse)$")
_UNIT = re.compile(
    r"\b(?:unit|suite|ste|apt|apartment|flat|room|rm|shop|office|level|lau|tang|phong)\b\.?\s*(?:no\.?\s*)?#?\d+[a-z]?\b"
    r"|\b(?:ground|first|second|third|fourth|\d{1,2}(?:st|nd|rd|th))\s+floor\b|\b(?:floor|fl)\.?\s*\d+\b"
    r"|\b\d{1,2}\.\s?(?:og|etage|stock)\b|\b(?:erdgeschoss|hinterhof|hinterhaus)\b"
)
_COUNTRY = re.compile(rf"(?:^|,|\s)\s*(?:{COUNTRIES})\.?\s*$")
_WARD = re.compile(r"\b(?:phuong|quan|ward|district)\s*\d+\b|(?:\bp\b|\bq\b)\.?\s*\d+\b|\b[pq]\d+\b")
_CITY_WORD = re.compile(r"\b(?:tp|thanh pho|city of)\b\.?\s*")
_GB_CODE = re.compile(r"\b(?:gb[- ]?)?([a-z]{1,2}\d[a-z\d]?)\s?(\d[a-z]{2})\b")
_DIGIT_CODE = re.compile(r"\b(?:(?:us|de|vn|d)[- ])?(\d{5,6})(?:-\d{4})?\b")
_NUMBER = re.compile(r"(?<![\w/])(?:(?:no|nr|number|so|hausnummer)\b\.?\s*|#\s*)?(\d+(?:/\d+)*(?:\s?-\s?\d+)?(?:[a-z]|\s[a-z](?=\s*(?:,|$)))?)(?![\w/])")
_RANGE = re.compile(r"(\d+)-(\d+)$")
RANGE_SPAN = 40
_STATE = re.compile(r"(?:^|,)\s*[a-z]{2}\s*(?=,|$)|\b[a-z]{2}\s*(?=#code#)")
_SEPARATORS = re.compile(r"[\n\r;|]+|\s[-–—]\s")
_SPACES = re.compile(r"\s+")
_WORDS = re.compile(r"[a-z0-9']+(?:-[a-z]+)*")


def folded(text: str) -> str:
    """`text` in lower case without accents, blanks single."""
    text = text.casefold()
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text.replace("đ", "d").replace("ß", "ss"))
        text = "".join(c for c in text if c < "̀" or not unicodedata.combining(c))
    return text


def postal_code(text: str | None) -> str:
    """The letters and digits of a postal code, without a country sign."""
    if not text:
        return ""
    code = re.sub(r"[^a-z0-9]", "", re.sub(r"^\s*(?:gb|us|de|vn|d)\s*-\s*", "", folded(text)))
    return code if re.search(r"\d", code) else ""


def _street(words: list[str]) -> tuple[str, str, list[str]]:
    """(name, kind, rest) of the words of one part of an address."""
    for i, w in enumerate(words):
        glued = _GLUED.match(w)
        if glued and w not in _KIND:
            return "".join([*words[:i], glued[1]]) if i and len(words[0]) > 2 and i < 2 else glued[1], _KIND[glued[2]], words[i + 1 :]
        if w in _BEFORE and i + 1 < len(words):
            return words[i + 1], "duong", [*words[:i], *words[i + 2 :]]
        if w in _AFTER and i:
            return " ".join(words[:i]), _KIND[w], words[i + 1 :]
    return "", "", words


def house_numbers(number: str) -> list[str]:
    """The numbers without suffix by which a house number is found: of a range those of its side of the street."""
    m = _RANGE.match(number)
    if not m:
        return [re.match(r"\d+", number)[0]]
    low, high = int(m[1]), int(m[2])
    if not low < high <= low + RANGE_SPAN:
        return sorted({m[1], m[2]})
    return [str(k) for k in range(low, high + 1, 2)] + ([m[2]] if (high - low) % 2 else [])


def read_address(address: str | None, city: str | None, code: str | None) -> list[tuple[str, str, str, tuple[str, ...], bool, str]]:
    """All plausible readings (number, street, kind, towns, town known, postal code) of an address; none if it can't be read."""
    if not address:
        return []
    text = _SEPARATORS.sub(",", folded(address))
    text = _SPACES.sub(" ", text).strip(" ,.-")
    if not re.search(r"[a-z]", text):
        return []
    text = _UNIT.sub(" ", text)
    text = _COUNTRY.sub("", text.strip(" ,"))
    found = postal_code(code)
    m = _GB_CODE.search(text)
    if m:
        return _readings_of(text[: m.start()] + " , " + text[m.end() :], city, found or m[1] + m[2])
    digits = list(_DIGIT_CODE.finditer(text))
    readings = []
    for d in reversed(digits):
        if len(digits) == 1 or not found or d[1] == found or not any(x[1] == found for x in digits):
            readings += _readings_of(text[: d.start()] + "#code#," + text[d.end() :], city, found or d[1])
    return readings or _readings_of(text, city, found)


def _readings_of(text: str, city: str | None, found: str) -> list[tuple[str, str, str, tuple[str, ...], bool, str]]:
    """The reading of an address whose postal code has been taken out, or none."""
    text = _STATE.sub(" ", text).replace("#code#", " ,")
    text = _WARD.sub(" , ", text)
    text = _CITY_WORD.sub(" ", text)
    town = _SPACES.sub(" ", folded(city)).strip() if city and city.strip(" -") else ""
    if town:
        text = re.sub(rf"(?<![a-z]){re.escape(town)}(?![a-z])", " , ", text)
    number = ""
    m = _NUMBER.search(text)
    if m:
        number = re.sub(r"\s", "", m[1])
        text = text[: m.start()] + (" , " if "," in text[: m.start()].strip(" ,") or not text[: m.start()].strip(" ,") else " ") + "\x00" + text[m.end() :]
    if not number:
        return []
    parts = [p for p in ([w for w in _WORDS.findall(p)] for p in re.split(r"[,\x00]", text)) if p]
    name, kind, rest = "", "", []
    for i, p in enumerate(parts):
        name, kind, left = _street(p)
        if name:
            rest = [*parts[:i], *([left] if left else []), *parts[i + 1 :]]
            break
    if not name:
        at = text.index("\x00")
        behind = [p for p in re.split(",", text[at + 1 :])]
        before = [p for p in re.split(",", text[:at])]
        near = _WORDS.findall(behind[0]) or _WORDS.findall(before[-1]) or next((w for w in parts), [])
        if not near:
            return []
        name, kind = near[0], ""
        rest = [near[1:]] if len(near) > 1 else []
        rest += [p for p in parts if p is not near and p != near]
    name = name.replace("-", "").replace("'", "").replace(" ", "")
    if len(name) < 2:
        return []
    towns = [town] if town else sorted({" ".join(p[k:]) for p in rest for k in range(max(0, len(p) - 3), len(p)) if len(" ".join(p[k:])) > 2})
    return [(number, name, kind, tuple(towns), bool(town), found)] if towns or found else []


def near_names(a: str, b: str) -> bool:
    """True for equal names and names one typing error apart (a letter added, left out, changed or swapped with its neighbour)."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 5:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def _readings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, streets, cities, codes = (batch.column(i).to_pylist() for i in range(4))
        out = [(i, n, house_numbers(n), s, k, list(t), *r) for i, a, c, p in zip(ids, streets, cities, codes) for n, s, k, t, *r in read_address(a, c, p)]
        cols = list(zip(*out)) if out else [[]] * 8
        text = pa.list_(pa.string())
        kinds = (pa.int64(), pa.string(), text, pa.string(), pa.string(), text, pa.bool_(), pa.string())
        names = ["id", "number", "bases", "street", "kind", "towns", "town_known", "code"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        mask = [near_names(a, b) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        yield batch.filter(pa.array(mask, pa.bool_()))


def street_spellings(streets: DataFrame) -> DataFrame:
    """(`street`, `meant`): names one typing error apart, from the rarer to the more frequent one."""
    counted = streets.groupBy("street").agg(F.count(F.lit(1)).alias("n"))
    cut = F.expr("transform(sequence(1, length(street)), i -> concat(substring(street, 1, i - 1), substring(street, i + 1)))")
    spelled = counted.where(F.length("street") >= 5).withColumn("v", F.explode(F.array_distinct(F.concat(F.array("street"), cut))))
    right = spelled.select("v", F.col("street").alias("meant"), F.col("n").alias("m"))
    pairs = spelled.join(right, "v").where("n < m or (n = m and street > meant)").select("street", "meant").distinct()
    return pairs.mapInArrow(_close, "street string, meant string")


def address_forms(rows: DataFrame, id_col: str, address: Column, city: Column, code: Column) -> DataFrame:
    """(`id`, `form`, number, bases, street, kind, towns, town_known, code): a row per reading; readings that say the same share the form."""
    read = rows.select(F.col(id_col).cast("long").alias("id"), address.alias("a"), city.alias("c"), code.alias("p")).where(F.length("a") > 1)
    read = read.mapInArrow(_readings, "id long, number string, bases array<string>, street string, kind string, towns array<string>, town_known boolean, code string")
    said = F.concat_ws("\x1f", "number", "street", "kind", F.concat_ws("\x1e", "towns"), F.col("town_known").cast("string"), "code")
    return read.withColumn("form", F.unhex(F.md5(said)))


def same_address(rows: DataFrame, id_col: str, address: Column, city: Column, code: Column) -> DataFrame:
    """(`id_a`, `id_b`): all pairs of rows, smaller id first, that denote the same postal address."""
    read = cut_lineage(address_forms(rows, id_col, address, city, code))
    parts = ["number", "bases", "street", "kind", "towns", "town_known", "code"]
    forms = read.select("form", *parts).distinct()
    meant = street_spellings(read.select("street"))
    own = forms.withColumn("name", F.col("street"))
    other = forms.join(meant, "street").withColumn("name", F.col("meant")).select(*own.columns)
    code_place = F.when(F.col("code") != "", F.array(F.concat(F.lit("p"), "code"))).otherwise(F.array().cast("array<string>"))
    places = F.concat(F.transform("towns", lambda t: F.concat(F.lit("t"), t)), code_place)
    hashed = own.unionByName(other).withColumn("place", F.explode(places)).withColumn("base", F.explode("bases"))
    several = F.when(F.size("bases") > 1, F.col("bases")).alias("bases")
    hashed = hashed.select(F.xxhash64("base", "name", "place").alias("hash"), "form", "number", several, "name", "kind", "towns", "town_known", "code")
    left, right = (hashed.select("hash", *[F.col(c).alias(f"{c}_{s}") for c in hashed.columns[1:]]) for s in "ab")
    either = F.arrays_overlap(*[F.coalesce(f"bases_{s}", F.array(f"number_{s}")) for s in "ab"]) & (F.col("bases_a").isNotNull() | F.col("bases_b").isNotNull())
    bare = F.col("number_a").rlike("^[0-9-]+$") & F.col("number_b").rlike("^[0-9-]+$")
    same_number = (F.col("number_a") == F.col("number_b")) | (bare & either)
    agree = (
        same_number
        & (F.col("name_a") == F.col("name_b"))
        & ((F.col("kind_a") == F.col("kind_b")) | (F.col("kind_a") == "") | (F.col("kind_b") == ""))
        & (F.arrays_overlap("towns_a", "towns_b") | ~(F.col("town_known_a") & F.col("town_known_b")))
        & ((F.col("code_a") == F.col("code_b")) | (F.col("code_a") == "") | (F.col("code_b") == ""))
    )
    alike = left.join(right, "hash").where((F.col("form_a") < F.col("form_b")) & agree).select("form_a", "form_b").distinct()
    both = alike.unionByName(alike.select(F.col("form_b").alias("form_a"), F.col("form_a").alias("form_b")))
    both = both.unionByName(read.groupBy("form").count().where("count > 1").select(F.col("form").alias("form_a"), F.col("form").alias("form_b")))
    ambiguous = read.groupBy("id").agg(F.count_distinct("form").alias("n")).where("n > 1").limit(1).count()
    a, b = (read.select(F.col("id").alias(f"id_{s}"), F.col("form").alias(f"form_{s}")) for s in "ab")
    pairs = a.join(both, "form_a").join(b, "form_b").where("id_a < id_b").select("id_a", "id_b")
    return pairs.distinct() if ambiguous else pairs
