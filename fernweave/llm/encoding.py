"""Encoding of texts with a public byte-level BPE vocabulary, in batched numpy merge rounds.

The vocabulary file is named by a parameter and read on the driver; its arrays, of the
fixed size of the vocabulary, are broadcast. A null or empty text gets an empty list of
ids; strings of special tokens inside a text are ordinary text. Whole texts are encoded,
however long; a long batch is merged in parts of at most `CHARS_PER_STEP` characters or
one text. Rows, ties and repeated ids pass through one for one.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER_FOLDER = "/opt/tokenizers"
CHARS_PER_STEP = 4_000_000
NO_RANK = np.int64(1 << 40)

# Fixed value: the pattern that splits text before the merges of byte-level BPE.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_letters() -> list[str]:
    """The letter by which the vocabulary file writes each byte: printable ones as themselves, the rest from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in printable}
    for b in range(256):
        letters.setdefault(b, chr(0x100 + len(letters) - len(printable)))
    return [letters[b] for b in range(256)]


def read_vocabulary(path: str) -> dict[str, np.ndarray]:
    """Arrays of a vocabulary file: the id of each byte, and the sorted pair keys with rank and result."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    keys = np.array([vocab[a] * (1 << 32) + vocab[b] for a, b in pairs], np.int64)
    order = np.argsort(keys, kind="stable")
    return {
        "bytes": np.array([vocab[c] for c in _byte_letters()], np.int64),
        "keys": keys[order],
        "ranks": order.astype(np.int64),
        "merged": np.array([vocab[a + b] for a, b in pairs], np.int64)[order],
    }


def merge_words(words: list[bytes], vocabulary: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, lengths): the ids of all `words` one after another, and how many each word has."""
    keys, ranks, merged = vocabulary["keys"], vocabulary["ranks"], vocabulary["merged"]
    lengths = np.array([len(w) for w in words], np.int64)
    symbols = vocabulary["bytes"][np.frombuffer(b"".join(words), np.uint8)]
    owner = np.repeat(np.arange(len(words)), lengths)
    done_symbols, done_owner = [], []
    while len(symbols):
        pair = np.full(len(symbols), -1, np.int64)
        inside = owner[1:] == owner[:-1]
        pair[:-1][inside] = symbols[:-1][inside] * (1 << 32) + symbols[1:][inside]
        at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
        rank = np.where(keys[at] == pair, ranks[at], NO_RANK)
        starts = np.flatnonzero(np.concatenate([[True], ~inside]))
        best = np.minimum.reduceat(rank, starts)
        size = np.diff(np.append(starts, len(symbols)))
        best_here = np.repeat(best, size)
        ended = best_here == NO_RANK
        if ended.any():
            done_symbols.append(symbols[ended])
            done_owner.append(owner[ended])
        chosen = np.flatnonzero((rank == best_here) & ~ended)
        if not len(chosen):
            break
        run_start = np.concatenate([[True], np.diff(chosen) > 1])
        place = np.arange(len(chosen)) - np.flatnonzero(run_start)[np.cumsum(run_start) - 1]
        chosen = chosen[place % 2 == 0]
        symbols[chosen] = merged[at[chosen]]
        stay = ~ended
        stay[chosen + 1] = False
        symbols, owner = symbols[stay], owner[stay]
    if not done_symbols:
        return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
    owner = np.concatenate(done_owner)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(done_symbols)[order], np.bincount(owner, minlength=len(words))


def encode_texts(texts: list[str | None], vocabulary: dict[str, np.ndarray], split: regex.Pattern) -> tuple[np.ndarray, np.ndarray]:
    """(ids, lengths) of all texts; distinct words are merged once."""
    index: dict[str, int] = {}
    used: list[int] = []
    per_text = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        if text:
            found = split.findall(text)
            per_text[i] = len(found)
            used.extend(index.setdefault(w, len(index)) for w in found)
    if not used:
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    ids, size = merge_words([w.encode("utf-8", "surrogatepass") for w in index], vocabulary)
    begin = np.cumsum(size) - size
    word = np.array(used, np.int64)
    n = size[word]
    ends = np.cumsum(n)
    flat = ids[np.repeat(begin[word] - (ends - n), n) + np.arange(ends[-1])]
    text_of = np.repeat(np.arange(len(texts)), per_text)
    return flat.astype(np.int32), np.bincount(text_of, weights=n, minlength=len(texts)).astype(np.int64)


def encode(rows: DataFrame, id_col: str, text: str, vocabulary_file: str | None = None, pattern: str = SPLIT_PATTERN) -> DataFrame:
    """(`id_col`, `ids`): the ids of each row's text, without special tokens."""
    path = vocabulary_file or os.path.join(TOKENIZER_FOLDER, "byte_bpe_50k.json")
    shared = rows.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, split = shared.value, regex.compile(pattern)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            start = 0
            while start < len(texts):
                stop, chars = start, 0
                while stop < len(texts) and (stop == start or chars + len(texts[stop] or "") <= CHARS_PER_STEP):
                    chars += len(texts[stop] or "")
                    stop += 1
                ids, size = encode_texts(texts[start:stop], vocabulary, split)
                offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), lists], [id_col, "ids"])
                start = stop

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(F.col(id_col), F.col(text).alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")
