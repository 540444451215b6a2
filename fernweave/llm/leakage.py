"""Passages of held-out test items inside corpus documents.

Items are cut into windows of `STRETCH_WORDS` words, documents into overlapping windows
that hold any such stretch; windows are put into partitions by their number of
shingles, and each partition takes as many MinHash functions as its containment
threshold needs. Minima of items and documents are tables; a document window that shares
a minimum with an item window makes the item a candidate, found by one join however many
items there are. The candidate is kept if a stretch of the document follows the item word
by word, a few changed words apart.

Shingles have three words: of a stretch of fifteen words two changed ones may leave no
shingle of five words whole, and such stretches must be found.

Items shorter than a stretch must be contained wholly; they are sought by each of their
shingles, and items of one or two words by the word or pair of words itself. Up to
`BROADCAST_KEYS` minima of items are also sent to the readers of documents, which then
write only minima that occur; beyond it all minima of documents are joined. Null and
empty texts, and items without a word, contain nothing. Repeated rows are reported once
per id and item.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernweave.session import cut_lineage

SHINGLE_WORDS = 3
STRETCH_WORDS = 15
WINDOW_SHINGLES = 22
WINDOW_STEP = 8
SIZE_LIMITS = (8, 15, WINDOW_SHINGLES)
CHANGED_WORDS = 2
RECALL = 0.999
BROADCAST_KEYS = 4_000_000
BROADCAST_CANDIDATES = 200_000
HELD_ITEMS = 20_000
CHARS_PER_STEP = 4_000_000
CHANGE_COST = 1.5
MATCHED_SHARE = 0.7

_INLINE_TAG = re.compile(r"</?(?:a|abbr|b|code|em|font|i|mark|s|small|span|strong|sub|sup|u)(?:\s[^<>]*)?>", re.I)
_TAG = re.compile(r"<[^<>]{1,200}>")
_TOKEN = re.compile(r"[぀-ヿ㐀-鿿가-힣]|[^\W_぀-ヿ㐀-鿿가-힣]+")


def words_of(text: str) -> list[str]:
    """Words without case, markup and punctuation; ideographs and syllables stand alone."""
    if "<" in text:
        text = _TAG.sub(" ", _INLINE_TAG.sub("", text))
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _TOKEN.findall(text.lower().replace("'", "").replace("’", ""))


def functions_for(size: int, stretch: int = STRETCH_WORDS) -> int:
    """How many MinHash functions find, at `RECALL`, a stretch with `CHANGED_WORDS` changes in a window of `size` shingles."""
    asked = stretch - SHINGLE_WORDS + 1
    whole = max(1, min(asked - CHANGED_WORDS * SHINGLE_WORDS, size))
    jaccard = whole / (asked + size - whole)
    return max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - jaccard))) if jaccard < 1 else 1


FUNCTIONS = tuple(functions_for(n) for n in SIZE_LIMITS)
_SEEDS = np.random.default_rng(9).integers(1, 1 << 62, (2, max(FUNCTIONS)), dtype=np.uint64) | np.uint64(1)


def _codes(word_lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, lengths): 64-bit hashes of the words of all lists."""
    lengths = np.array([len(w) for w in word_lists], np.int64)
    known: dict[str, int] = {}
    for words in word_lists:
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
    flat = np.fromiter((known[w] for words in word_lists for w in words), np.uint64, int(lengths.sum()))
    return flat, lengths


def _shingles(codes: np.ndarray) -> np.ndarray:
    """A hash for each place where a shingle of the flat word codes begins (also across texts, to be left out)."""
    n = max(0, len(codes) - SHINGLE_WORDS + 1)
    out = np.zeros(n, np.uint64)
    for k in range(SHINGLE_WORDS):
        out = (out ^ codes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _windows(lengths: np.ndarray, size: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, begin, end) of the shingle windows of each text, in places of the flat array."""
    shingles = np.maximum(lengths - SHINGLE_WORDS + 1, 0)
    number = np.where(shingles > 0, 1 + np.maximum(0, -(-(shingles - size) // step)), 0)
    text = np.repeat(np.arange(len(lengths)), number)
    place = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
    first = (np.cumsum(lengths) - lengths)[text]
    begin = first + place * step
    return text, begin, np.minimum(begin + size, first + shingles[text])


def _minima(shingles: np.ndarray, begin: np.ndarray, end: np.ndarray, k: int) -> np.ndarray:
    mixed = np.append((shingles ^ _SEEDS[0, k]) * _SEEDS[1, k], np.uint64(0))
    return np.minimum.reduceat(mixed >> np.uint64(8), np.stack([begin, end], 1).ravel())[::2]


def _grams(codes: np.ndarray, lengths: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) of every run of `n` words inside a text."""
    first = np.repeat(np.cumsum(lengths) - lengths, lengths)
    text = np.repeat(np.arange(len(lengths)), lengths)
    inside = np.arange(len(codes)) - first + n <= lengths[text]
    keys = codes.copy()
    for k in range(1, n):
        keys[:-k] = (keys[:-k] * np.uint64(0x9E3779B97F4A7C15)) ^ codes[k:]
    return text[inside], (keys[inside] ^ np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93)


def _own_shingles(shingles: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle) of every shingle that lies inside a text."""
    text, begin, _ = _windows(lengths, 1, 1)
    return text, shingles[begin]


def _distinct(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (text, key) of all parts, by text."""
    text = np.concatenate([t for t, _ in found]) if found else np.zeros(0, np.int64)
    key = np.concatenate([k for _, k in found]).astype(np.uint64) if found else np.zeros(0, np.uint64)
    order = np.lexsort((key, text))
    text, key = text[order], key[order]
    new = np.append(True, (text[1:] != text[:-1]) | (key[1:] != key[:-1]))[: len(text)]
    return text[new], key[new].view(np.int64)


def item_keys(word_lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """(item, key): minima of the windows of long items, shingles of short ones, the words of those without a shingle."""
    found = []
    sizes = np.array([len(w) for w in word_lists], np.int64)
    for least, most in ((STRETCH_WORDS, None), (SHINGLE_WORDS, STRETCH_WORDS), *((n, n + 1) for n in range(1, SHINGLE_WORDS))):
        mine = np.flatnonzero((sizes >= least) & (sizes < (most or sizes.max(initial=0) + 1)))
        if not len(mine):
            continue
        codes, lengths = _codes([word_lists[i] for i in mine])
        shingles = _shingles(codes)
        if least == STRETCH_WORDS:
            text, begin, end = _windows(lengths, STRETCH_WORDS - SHINGLE_WORDS + 1, 1)
            parts = [(text, _minima(shingles, begin, end, k)) for k in range(max(FUNCTIONS))]
        elif least == SHINGLE_WORDS:
            parts = [_own_shingles(shingles, lengths)]
        else:
            parts = [_grams(codes, lengths, least)]
        found += [(mine[t], k) for t, k in parts]
    return _distinct(found)


def document_keys(codes: np.ndarray, lengths: np.ndarray, short: frozenset[int]) -> tuple[np.ndarray, np.ndarray]:
    """(text, key): minima of the windows of documents, and what items of the `short` lengths are sought by."""
    found = []
    text, begin, end = _windows(lengths, WINDOW_SHINGLES, WINDOW_STEP)
    shingles = _shingles(codes)
    part = np.searchsorted(SIZE_LIMITS, end - begin)
    for p, functions in enumerate(FUNCTIONS):
        mine = np.flatnonzero(part == p)
        if len(mine):
            found += [(text[mine], _minima(shingles, begin[mine], end[mine], k)) for k in range(functions)]
    if SHINGLE_WORDS in short:
        found.append(_own_shingles(shingles, lengths))
    found += [_grams(codes, lengths, n) for n in range(1, SHINGLE_WORDS) if n in short]
    return _distinct(found)


def _segments(document: np.ndarray, item: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(begin in document, begin in item, length, matched words) of the best stretch of each diagonal that shares a shingle."""
    a, b = _shingles(document), _shingles(item)
    order = np.argsort(b, kind="stable")
    first, last = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    at = np.flatnonzero(last > first)
    n = last[at] - first[at]
    place = order[np.repeat(first[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    out = []
    for diagonal in np.unique(np.repeat(at, n) - place):
        low, high = max(0, -diagonal), min(len(item), len(document) - diagonal)
        same = item[low:high] == document[low + diagonal : high + diagonal]
        gain = np.concatenate([[0.0], np.cumsum(np.where(same, 1.0, -CHANGE_COST))])
        floor = np.minimum.accumulate(gain)
        stop = int(np.argmax(gain - floor))
        start = int(np.flatnonzero(gain[: stop + 1] == floor[stop])[-1])
        if stop > start:
            out.append((low + start + diagonal, low + start, stop - start, int(same[start:stop].sum())))
    return sorted(out)


def longest_stretch(document: np.ndarray, item: np.ndarray) -> int:
    """Words of the longest stretch of `document` that follows `item`, changed, added and left-out words included."""
    best = 0
    chains: list[tuple[int, int, int, int, int]] = []
    for d, i, length, matched in _segments(document, item):
        chain = (d, i, d + length, i + length, matched)
        for c in chains:
            if 0 <= d - c[2] <= 3 and 0 <= i - c[3] <= 3 and c[4] + matched > chain[4]:
                chain = (c[0], c[1], d + length, i + length, c[4] + matched)
        chains.append(chain)
        span = min(chain[2] - chain[0], chain[3] - chain[1])
        if chain[4] >= MATCHED_SHARE * max(chain[2] - chain[0], chain[3] - chain[1]):
            best = max(best, span)
    return best


def contains(document: np.ndarray, item: np.ndarray) -> int:
    """Words of the stretch by which `document` contains `item`, or 0."""
    if len(item) < SHINGLE_WORDS:
        runs = np.lib.stride_tricks.sliding_window_view(document, len(item)) if len(document) >= len(item) > 0 else np.zeros((0, 1))
        return len(item) if len(runs) and (runs == item).all(axis=1).any() else 0
    words = longest_stretch(document, item)
    return words if words >= min(STRETCH_WORDS, len(item)) else 0


def _steps(texts: list[str]) -> Iterator[tuple[int, int]]:
    """(begin, end) of parts of at most `CHARS_PER_STEP` characters or one text."""
    ends = np.cumsum([len(t) for t in texts])
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + CHARS_PER_STEP, "right")))
        yield start, stop
        start = stop


def _keyed(ids: pa.Array, text: np.ndarray, keys: np.ndarray, name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids.take(pa.array(text)), pa.array(keys)], [name, "key"])


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, key, short): the keys of items, and the class of their length if they are shorter than a stretch."""
    for batch in batches:
        listed = [words_of(t) for t in batch.column(1).to_pylist()]
        text, keys = item_keys(listed)
        short = np.array([min(len(w), SHINGLE_WORDS) if len(w) < STRETCH_WORDS else 0 for w in listed], np.int32)
        rows = _keyed(batch.column(0), text, keys, "item_id")
        yield rows.append_column("short", pa.array(short[text]))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The candidates whose document contains the item; rows of one document follow each other. Codes of up to `HELD_ITEMS` items are held."""
    last, document = None, np.zeros(0, np.uint64)
    known: dict[str, np.ndarray] = {}
    for batch in batches:
        docs, texts, ids, items = (batch.column(k) for k in range(4))
        kept = []
        for r, (doc, item) in enumerate(zip(docs.to_pylist(), items.to_pylist())):
            if doc != last:
                last, document = doc, _codes([words_of(texts[r].as_py())])[0]
            if item not in known:
                if len(known) >= HELD_ITEMS:
                    known.clear()
                known[item] = _codes([words_of(item)])[0]
            kept.append(contains(document, known[item]))
        words = np.array(kept, np.int64)
        rows = pa.RecordBatch.from_arrays([docs, ids, pa.array(words)], ["doc_id", "item_id", "words"])
        yield rows.filter(pa.array(words > 0))


def leaked_items(documents: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """(`doc_id`, `item_id`, `words`): documents that contain an item, with the length of the longest stretch."""
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t")).where(F.length("t") > 0)
    listed = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("item")).where(F.length("item") > 0).distinct()
    known = cut_lineage(listed.mapInArrow(_items, "item_id long, key long, short int").distinct())
    short = frozenset(r[0] for r in known.select("short").distinct().collect()) - {0}
    wanted = known.select("key").distinct()
    few = wanted.count() <= BROADCAST_KEYS
    shared = documents.sparkSession.sparkContext.broadcast(np.sort(np.array([r[0] for r in wanted.collect()], np.int64)) if few else None)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start, stop in _steps(texts):
                found, keys = document_keys(*_codes([words_of(t) for t in texts[start:stop]]), short)
                if only is not None:
                    place = np.searchsorted(only, keys)
                    hit = (place < len(only)) & (only[np.minimum(place, len(only) - 1)] == keys) if len(only) else np.zeros(len(keys), bool)
                    found, keys = found[hit], keys[hit]
                yield _keyed(batch.column(0), found + start, keys, "doc_id")

    candidates = docs.mapInArrow(search, "doc_id long, key long").join(known.select("item_id", "key"), "key").select("doc_id", "item_id").distinct()
    candidates = cut_lineage(candidates)
    asked = F.broadcast(candidates) if candidates.count() <= BROADCAST_CANDIDATES else candidates
    pairs = docs.join(asked, "doc_id").join(listed, "item_id") if asked is not candidates else docs.join(candidates.join(listed, "item_id"), "doc_id")
    return pairs.select("doc_id", "t", "item_id", "item").mapInArrow(_verified, "doc_id long, item_id long, words long").groupBy("doc_id", "item_id").agg(F.max("words").alias("words"))
