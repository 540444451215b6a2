"""One form for texts that read the same but are stored with different characters.

Words of plain texts, counted over the whole corpus, are the vocabulary. Words of texts
with unusual characters are looked up in tries of that vocabulary by an automaton that
follows look-alike letters and skips ignorable characters at no cost; the word found is
the canonical spelling. Vocabulary and unusual words meet in blocks of equal length and
equal class of their outer letters, so the tries are spread over the cluster. A word
without a match is normalised by table. Two texts look the same when their canonical
forms are equal, words that are drawn alike in two scripts counting as Latin.

A null text has no form and is left out; an empty one stays empty. Ties between
spellings go to the one written in a single script, then to the more frequent, then to
the smaller string. Rows repeated with their id and text count once.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernweave.session import cut_lineage

# Letters of other scripts that are drawn like a Latin letter, each pair
# as written in other script and Latin.
LOOKALIKE_PAIRS = (
    "аa еe оo рp сc уy хx іi ѕs јj һh ԁd ԛq ԝw ӏl "
    "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX ӀI "
    "οo νv ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX"
)
# Format characters that draw a sign around what follows them, and a letter that doesn't look like its compatible form.
VISIBLE_FORMATS = (*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD, *range(0x13430, 0x13440))
UNLIKE_ITS_LETTER = (0x17F,)
# Characters outside the format class that draw nothing: joiner of graphemes, Hangul fillers, variation selectors.
UNDRAWN = (0x34F, 0x115F, 0x1160, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0))
FLAG = "\U0001f3f4"


def _tables() -> tuple[set[int], dict[int, str]]:
    """(ignorable code points, folded forms): forms of letters that differ in width, joining or ligature only."""
    ignorable, folded = set(UNDRAWN), {0x2010: "-", 0x2011: "-"}
    for c in (*range(0x80, 0x30000), *range(0xE0000, 0xE0200)):
        ch = chr(c)
        kind = unicodedata.category(ch)
        if kind == "Cf" and c not in VISIBLE_FORMATS:
            ignorable.add(c)
        if kind in ("Cn", "Co", "Cs") or c in ignorable:
            continue
        tag = unicodedata.decomposition(ch).split(" ")[0]
        shaped = tag in ("<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>")
        if shaped or (tag == "<compat>" and kind in ("Ll", "Lu", "Lt", "Nl") and c not in UNLIKE_ITS_LETTER):
            folded[c] = unicodedata.normalize("NFKC", ch)
    return ignorable - set(folded), folded | {0xFF9E: "\u3099", 0xFF9F: "\u309a"}


def _class(codes) -> str:
    """The inside of a character class of the given code points, as ranges."""
    out, listed = [], sorted(codes)
    start = 0
    for k in range(1, len(listed) + 1):
        if k == len(listed) or listed[k] != listed[k - 1] + 1:
            out.append(f"{chr(listed[start])}-{chr(listed[k - 1])}")
            start = k
    return "".join(out)


PROTOTYPE = {ord(p[0]): p[1] for p in LOOKALIKE_PAIRS.split()}
_MEMBERS: dict[str, list[str]] = {}
for _other, _latin in PROTOTYPE.items():
    _MEMBERS.setdefault(_latin, [_latin]).append(chr(_other))
_IGNORED, _WIDTH = _tables()
_DROP = dict.fromkeys(_IGNORED)
IGNORABLE = _class(_IGNORED)
# Full-width signs that plain texts of some scripts are written with.
COMMON_WIDE = "！（），：？"
_FOLDABLE = _class(_WIDTH)
_SHAPED = re.compile("[\u0600-\u08ff\u0900-\u0dff]")
_JOINED = re.compile(f"[{IGNORABLE}]+")
_ODD = re.compile(f"[{IGNORABLE}{_class(c for c in _WIDTH if chr(c) not in COMMON_WIDE)}\u00a0\u1680\u2000-\u200a\u202f\u205f\u0300-\u036f\u1100-\u11ff\u3099\u309a]")
_LATIN = re.compile("[A-Za-z]")
_OTHER = re.compile("[\u0370-\u052f]")
_BREAKS = re.compile(r"\s{2,}|[^\S \n]")
_WIDE = re.compile(f"[{_FOLDABLE}]")
_WORD = re.compile("[^\\W\\d_]+", re.UNICODE)
_ALIKE = _class(PROTOTYPE)
_ALIKE_WORD = re.compile(f"(?<![^\\W\\d_])[{_ALIKE}]+(?![^\\W\\d_])", re.UNICODE)


def is_odd(text: str) -> bool:
    """True if `text` may hold characters that its plain spelling wouldn't."""
    if text.isascii():
        return False
    if _ODD.search(text):
        return True
    return _OTHER.search(text) is not None and _LATIN.search(text) is not None


def _ignorables_out(text: str) -> str:
    """`text` without ignorables, but for joiners that shape an emoji or a cursive script, and the tags of a flag."""

    def keep(m: re.Match) -> str:
        if text[max(0, m.start() - 1) : m.start()] == FLAG:
            return "".join(c for c in m[0] if "\U000e0020" <= c <= "\U000e007f")
        if "\u200d" not in m[0] and "\u200c" not in m[0]:
            return ""
        before, after = text[max(0, m.start() - 1) : m.start()], text[m.end() : m.end() + 1]
        if "\u200d" in m[0] and before and after and unicodedata.category(before) in ("So", "Sk") and unicodedata.category(after) == "So":
            return "\u200d"
        if before and after and _SHAPED.match(before) and _SHAPED.match(after):
            return "\u200d" if "\u200d" in m[0] else "\u200c"
        return ""

    return _JOINED.sub(keep, text)


def by_table(text: str) -> str:
    """`text` in the form the tables give: widths folded, ignorables out, composed, blanks single."""
    if not text.isascii():
        if _WIDE.search(text):
            text = text.translate(_WIDTH)
        text = unicodedata.normalize("NFC", _ignorables_out(text))
    return _BREAKS.sub(lambda m: "\n" if "\n" in m[0] else " ", text).strip()


def skeleton(canonical: str) -> str:
    """The string in which all spellings that look like `canonical` are equal."""
    if canonical.isascii() or not _OTHER.search(canonical):
        return canonical
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", canonical).translate(PROTOTYPE))


def latin_alike(text: str) -> str:
    """`text` with the words that could be read in two scripts as Latin ones."""
    if text.isascii() or not _OTHER.search(text):
        return text
    return _ALIKE_WORD.sub(lambda m: m[0].translate(PROTOTYPE), text)


def block_of(word: str) -> str:
    """Length and outer letters of a word as it is drawn: equal for all spellings of a word that look alike."""
    drawn = unicodedata.normalize("NFD", word.translate(_WIDTH)).translate(_DROP).translate(PROTOTYPE) if not word.isascii() else word
    return f"{len(drawn)}{drawn[:2]}{drawn[-1:]}"


def _script(ch: str) -> str:
    return "C" if "\u0400" <= ch <= "\u052f" else "G" if "\u0370" <= ch <= "\u03ff" else "L"


class VocabularyTrie:
    """Words in a trie of decomposed characters, searched by a weighted edit automaton."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, word: str, count: int) -> None:
        node = self.root
        for ch in unicodedata.normalize("NFD", word):
            node = node.setdefault(ch, {})
        node[""] = (count, word)

    def match(self, token: str, budget: int = 0) -> str | None:
        """The best word within `budget`; look-alikes and ignorables cost nothing, other edits one each."""
        states = [(self.root, 0)]
        for ch in unicodedata.normalize("NFD", token.translate(_WIDTH)):
            if ord(ch) in _DROP:
                continue
            latin = PROTOTYPE.get(ord(ch), ch)
            alike = _MEMBERS.get(latin, (ch,))
            after: dict[int, tuple[dict, int]] = {}

            def reach(node: dict, cost: int) -> None:
                if cost <= budget and (id(node) not in after or after[id(node)][1] > cost):
                    after[id(node)] = (node, cost)

            for node, cost in states:
                for a in alike:
                    if a in node:
                        reach(node[a], cost)
                if cost < budget:
                    reach(node, cost + 1)
                    for k, child in node.items():
                        if k and k not in alike:
                            reach(child, cost + 1)
                        if k:
                            for a in alike:
                                if a in child:
                                    reach(child[a], cost + 1)
            states = list(after.values())
            if not states:
                return None
        ends = [(cost, len({_script(c) for c in node[""][1]}), -node[""][0], node[""][1]) for node, cost in states if "" in node]
        return min(ends)[3] if ends else None


_PIECE = re.compile(f"[^\\W\\d_](?:[^\\W\\d_]|[\u0300-\u036f\u3099\u309a{IGNORABLE}])*", re.UNICODE)


def _pieces(text: str) -> Iterator[tuple[str, bool]]:
    """`text` cut into words (letters with their marks and ignorables) and what stands between."""
    at = 0
    for m in _PIECE.finditer(text):
        if m.start() > at:
            yield text[at : m.start()], False
        yield m[0], True
        at = m.end()
    if at < len(text):
        yield text[at:], False


def _runs(text: str) -> Iterator[tuple[str, bool]]:
    """Words to be looked up, and everything between two of them as one run."""
    held: list[str] = []
    for piece, is_word in _pieces(text):
        if is_word and not piece.isascii():
            if held:
                yield "".join(held), False
                held = []
            yield piece, True
        else:
            held.append(piece)
    if held:
        yield "".join(held), False


def _spellings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Canonical spelling of each odd token; rows come sorted by block, whole blocks at a time."""
    held: list[tuple] = []
    found: list[tuple[str, str]] = []

    def settle(rows: list[tuple]) -> None:
        odd = [t for t, _, n in rows if n == 0]
        if not odd or len(odd) == len(rows):
            return
        trie = VocabularyTrie()
        for token, _, n in rows:
            if n:
                trie.add(token, n)
        for token in odd:
            word = trie.match(token)
            if word is not None and word != token:
                found.append((token, word))

    for batch in batches:
        rows = list(batch.itertuples(index=False, name=None))
        held += rows
        cut = len(held)
        while cut and held[cut - 1][1] == held[-1][1]:
            cut -= 1
        settle(held[:cut])
        held = held[cut:]
        if found:
            yield pd.DataFrame(found, columns=["token", "word"])
            found.clear()
    settle(held)
    if found:
        yield pd.DataFrame(found, columns=["token", "word"])


_SPLIT_KINDS = {"id": pa.int64(), "grp": pa.string(), "k": pa.int32(), "token": pa.string(), "form": pa.string(), "raw": pa.binary(), "key": pa.binary(), "n": pa.int64()}
_SPLIT_SCHEMA = "id long, grp string, k int, token string, form string, raw binary, key binary, n long"
VOCABULARY, PLAIN = -2, -1


def _split_rows(keys: bool):
    """One pass over texts: vocabulary words of the plain ones with counts (`k` is `VOCABULARY`); plain rows with
    their form, or with `keys` only the key of it (`PLAIN`); odd rows as numbered pieces, those to be looked up as `token`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, groups, texts = (batch.column(i).to_pylist() for i in range(3))
            out: list[tuple] = []
            tokens: Counter = Counter()
            for i, g, t in zip(ids, groups, texts):
                if t is None:
                    continue
                raw = _hash(t)
                if is_odd(t):
                    out += [(i, g, k, p if asked else None, by_table_piece(p), raw, None, 0) for k, (p, asked) in enumerate(_runs(by_white_space(t)))]
                    continue
                tokens.update(t.split())
                form = by_table(t)
                if keys:
                    alike = latin_alike(form)
                    out.append((i, g, PLAIN, None, None, raw, raw if alike == t else _hash(alike), 0))
                else:
                    out.append((i, g, PLAIN, None, form, raw, None, 0))
            words: Counter = Counter()
            for token, n in tokens.items():
                for w in _WORD.findall(token):
                    words[w] += n
            out += [(None, None, VOCABULARY, w, None, None, None, n) for w, n in words.items()]
            cols = list(zip(*out)) if out else [[]] * len(_SPLIT_KINDS)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _SPLIT_KINDS.values())], list(_SPLIT_KINDS))

    return run


def _blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        blocks = pa.array([block_of(t) for t in batch.column(0).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), blocks, batch.column(1)], ["token", "block", "n"])


def _canonical_words(split: DataFrame) -> DataFrame:
    """(`token`, `word`): the vocabulary spelling of each odd word that has one. Only blocks with an odd word go to the tries."""
    counted = split.where("token is not null").groupBy("token", (F.col("k") == VOCABULARY).alias("known")).agg(F.sum("n").alias("n"))
    counted = cut_lineage(counted.select("token", "n").mapInArrow(_blocked, "token string, block string, n long"))
    asked = counted.where("n = 0").select("block").distinct()
    inside = counted.join(asked, "block", "left_semi").repartition("block").sortWithinPartitions("block", "n")
    return inside.select("token", "block", "n").mapInPandas(_spellings, "token string, word string")


def canonical_words(texts: DataFrame, text: str) -> DataFrame:
    """(`token`, `word`): the vocabulary spelling of each word of an odd text that has one."""
    return _canonical_words(_split(texts.select(F.lit(0).alias("i"), F.lit("").alias("g"), F.col(text).alias("t")), "i", "g", "t", keys=True))


def by_white_space(text: str) -> str:
    return _BREAKS.sub(lambda m: "\n" if "\n" in m[0] else " ", text).strip()


def by_table_piece(piece: str) -> str:
    """A piece by table, its own outer blanks kept; look-alikes in mixed words become Latin."""
    text = unicodedata.normalize("NFC", _ignorables_out(piece.translate(_WIDTH)))
    return skeleton(text) if _LATIN.search(text) and _OTHER.search(text) else text


def _hash(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


def _split(rows: DataFrame, id_col: str, group_col: str, text: str, keys: bool) -> DataFrame:
    asked = rows.select(F.col(id_col).cast("long").alias("id"), F.col(group_col).cast("string").alias("grp"), F.col(text).alias("t"))
    return cut_lineage(asked.mapInArrow(_split_rows(keys), _SPLIT_SCHEMA))


def _odd_forms(split: DataFrame, words: DataFrame) -> DataFrame:
    """Canonical forms of odd rows: their pieces looked up and put together again, repeated rows once."""
    pieces = split.where("k >= 0")
    asked = pieces.where("token is not null").join(words, "token", "left").select("id", "grp", "raw", "k", F.coalesce("word", "form").alias("form"))
    looked = asked.unionByName(pieces.where("token is null").select("id", "grp", "raw", "k", "form"))
    odd = looked.groupBy("id", "grp", "raw").agg(F.array_sort(F.collect_set(F.struct("k", "form"))).alias("p"))
    odd = odd.select("id", "grp", F.concat_ws("", F.transform("p", lambda x: x["form"])).alias("joined"), "raw")
    return odd.mapInArrow(_recompose, "id long, grp string, canonical string, raw binary")


def canonical_forms(rows: DataFrame, id_col: str, group_col: str, text: str) -> DataFrame:
    """(`id`, `grp`, `canonical`, `raw`): each text in its one form, `raw` being a hash of the stored text."""
    split = _split(rows, id_col, group_col, text, keys=False)
    plain = split.where(F.col("k") == PLAIN).select("id", "grp", F.col("form").alias("canonical"), "raw")
    return plain.unionByName(_odd_forms(split, _canonical_words(split)))


def _recompose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        joined = pa.array([by_table(t) for t in batch.column(2).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), joined, batch.column(3)], ["id", "grp", "canonical", "raw"])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = pa.array([_hash(latin_alike(t)) for t in batch.column(2).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), keys, batch.column(3)], ["id", "grp", "key", "raw"])


def alike_pairs(rows: DataFrame, id_col: str, group_col: str, text: str) -> DataFrame:
    """(`grp`, `id_a`, `id_b`): rows of one group whose texts look the same but differ in characters.

    Only keys with two spellings or more go on. A row first meets the other spellings of
    its key, then their rows, so texts that are stored alike are never paired, and what is
    made on the way is no larger than twice the result.
    """
    split = _split(rows.where(F.col(group_col).isNotNull()), id_col, group_col, text, keys=True)
    odd = cut_lineage(_odd_forms(split, _canonical_words(split)).mapInArrow(_keyed, "id long, grp string, key binary, raw binary"))
    keyed = split.where(F.col("k") == PLAIN).select("id", "grp", "key", "raw").unionByName(odd)
    key = ["grp", "key"]
    varied = keyed.groupBy(*key).agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo <> hi").select(*key)
    inside = cut_lineage(keyed.join(varied, key, "left_semi").distinct())
    spellings = inside.select(*key, F.col("raw").alias("other")).distinct()
    left = inside.select(*key, F.col("id").alias("id_a"), "raw").join(spellings, key).where("raw <> other").drop("raw")
    right = inside.select(*key, F.col("id").alias("id_b"), F.col("raw").alias("other"))
    return left.join(right, [*key, "other"]).where("id_a < id_b").select("grp", "id_a", "id_b")
