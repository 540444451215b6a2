"""Language of texts and of the segments of mixed ones, with calibrated confidence.

Hashed character n-grams have embeddings; their mean goes through a linear softmax. The
model is trained by stochastic gradient descent in numpy on a bounded sample of rows
whose label names a known language (`SAMPLE_PER_LANGUAGE`, chosen by a hash of the row's
id); labels may be noisy. A temperature fitted on held-out rows makes the softmax a
confidence, and a threshold fitted there rejects what is uncertain. For use, embedding
and softmax are folded into one table of a fixed size, which is broadcast.

A text is cut at sentence ends, line breaks and separators; each segment gets a
language. A text is mixed if a second language has a confident segment of several words.
Null texts, texts without words of a language (scores, emoji, chat shorthand) and texts
below the threshold have no language: their row has a null language and the confidence
of the likeliest one. Repeated rows are judged each for itself; very long texts are read whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernweave.llm import lookalikes

LANGUAGES = ("en", "vi", "ru", "zh", "es", "de", "fr", "pt", "ja", "ko")
SAMPLE_PER_LANGUAGE = 800
BUCKETS = 1 << 16
DIMENSIONS = 12
EPOCHS = 8
LEAST_STEPS = 600
RATE = 4.0
HELD_OUT = 5
LEAST_LETTERS = 6
LEAST_LETTERS_UNSPACED = 3
SEGMENT_WORDS = 3
ERROR_AIM = 0.005
CHARS_PER_STEP = 1_000_000
SEGMENT_CHARS = 20_000

# Names of languages as labels write them, beside the two-letter codes.
LABEL_NAMES = {
    "en": "english",
    "vi": "vietnamese",
    "ru": "russian",
    "zh": "schinese tchinese chinese",
    "es": "spanish latam",
    "de": "german",
    "fr": "french",
    "pt": "brazilian portuguese",
    "ja": "japanese",
    "ko": "koreana korean",
}
# Words by which labels say that the language isn't known.
LABEL_UNKNOWN = "unknown und n/a na none null undefined undetermined mul mis zxx other ? -".split()

_NAMES = {name: code for code, names in LABEL_NAMES.items() for name in [code, *names.split()]}
_BREAK = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])|\n+|\s/\s|\s-{2,}\s|\s[|•·]\s")
_MIXED = re.compile("[A-Za-z][Ͱ-ӿ]|[Ͱ-ӿ][A-Za-z]")
_TO_CYRILLIC = {ord(latin): chr(other) for other, latin in lookalikes.PROTOTYPE.items() if 0x400 <= other <= 0x4FF}
_SPLIT_WORD = re.compile(r"(\W+)")


def label_code(label: Column) -> Column:
    """The two-letter code a label stands for; null if it is missing, blank or a word for unknown."""
    word = F.regexp_replace(F.lower(F.trim(label)), r"^([a-z]{2,3})[-_].*$", "$1")
    names = F.create_map(*[F.lit(x) for pair in _NAMES.items() for x in pair])
    known = F.try_element_at(names, word)
    return F.when(label.isNull() | word.isin("", *LABEL_UNKNOWN), None).otherwise(F.coalesce(known, F.when(word.rlike("^[a-z]{2,3}$"), word)))


def repaired(text: str) -> str:
    """`text` with its widths, marks and the scripts of its words made regular."""
    if not lookalikes.is_odd(text):
        return text
    text = lookalikes.by_table(text)
    if not _MIXED.search(text):
        return text
    words = []
    for w in _SPLIT_WORD.split(text):
        if _MIXED.search(w):
            latin = w.translate(lookalikes.PROTOTYPE)
            w = w.translate(_TO_CYRILLIC) if any("Ѐ" <= c <= "ӿ" for c in latin) else latin
        words.append(w)
    return "".join(words)


def _letters() -> np.ndarray:
    """For each code point of the basic plane: 0 no letter, 1 letter, 2 letter of a script without word gaps."""
    kind = np.zeros(1 << 16, np.uint8)
    for c in range(1 << 16):
        if unicodedata.category(chr(c))[0] in "LM":
            kind[c] = 1
    kind[0x3041:0x3100] = 2
    kind[0x3400:0xA000] = 2
    return kind


_KIND: list[np.ndarray] = []


def features(segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, owner, letters, words): hashed n-grams of one to three characters and the segment of each; letters and words of each segment."""
    if not _KIND:
        _KIND.append(_letters())
    codes = np.frombuffer(("\n" + "\n".join(segments) + "\n").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    line = np.cumsum(codes == 10) - 1
    if line[-1] != len(segments):
        raise ValueError("segments must be single lines")
    kind = np.where(codes < 1 << 16, _KIND[0][np.minimum(codes, 0xFFFF)], np.where((codes >= 0x20000) & (codes < 0x40000), 2, 0)).astype(np.uint8)
    letter = kind > 0
    plain = np.where(letter, codes, 32).astype(np.uint32)
    a, b, c = plain[:-2], plain[1:-1], plain[2:]
    mid = letter[1:-1]
    one = b * np.uint32(0x9E3779B1) + np.uint32(1)
    two = (b * np.uint32(0x85EBCA6B)) ^ (c * np.uint32(0xC2B2AE35)) + np.uint32(2)
    three = (a * np.uint32(0x27D4EB2F)) ^ (b * np.uint32(0x165667B1)) ^ (c * np.uint32(0x9E3779B1)) + np.uint32(3)
    at = np.flatnonzero(mid)
    grams = np.stack([one[at], two[at], three[at]], 1)
    grams = (grams ^ (grams >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    buckets = (grams >> np.uint32(16)).astype(np.int64)
    owner = line[1:-1][at]
    n = len(segments)
    letters = np.bincount(owner, minlength=n)
    starts = letter[1:-1] & ((~letter[:-2]) | (kind[1:-1] == 2))
    words = np.bincount(line[1:-1][starts], minlength=n)
    dense = np.bincount(owner, weights=(kind[1:-1][at] == 2), minlength=n) * 2 > letters
    return buckets, owner, np.where(dense, -letters, letters), words


def _sums(table: np.ndarray, buckets: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sum of the table rows of each segment's n-grams."""
    out = np.zeros((n, table.shape[1]), np.float32)
    if len(owner):
        starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        each = table[buckets[:, 0]] + table[buckets[:, 1]] + table[buckets[:, 2]]
        out[owner[starts]] = np.add.reduceat(each, starts, axis=0)
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], labels: list[str], seed: int = 6) -> dict:
    """The folded model of labelled texts: table, bias, temperature and threshold."""
    rng = np.random.default_rng(seed)
    segments, target, group = [], [], []
    for g, (text, label) in enumerate(zip(texts, labels)):
        for s in segments_of(repaired(text)):
            segments.append(s[2])
            target.append(LANGUAGES.index(label))
            group.append(g)
    if not segments:
        return {"table": np.zeros((BUCKETS, len(LANGUAGES)), np.float32), "bias": np.zeros(len(LANGUAGES), np.float32), "temperature": 1.0, "threshold": 1.1}
    target, group = np.array(target), np.array(group)
    buckets, owner, letters, _ = features(segments)
    size = np.bincount(owner, minlength=len(segments))
    first = np.cumsum(size) - size
    usable = np.abs(letters) >= LEAST_LETTERS
    held = usable & (group % HELD_OUT == 0)
    chosen = np.flatnonzero(usable & ~held)
    embed = rng.normal(0, 0.05, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weight, bias = np.zeros((DIMENSIONS, len(LANGUAGES)), np.float32), np.zeros(len(LANGUAGES), np.float32)
    batches = max(1, -(-len(chosen) // 32))
    epochs = max(EPOCHS, -(-LEAST_STEPS // batches)) if len(chosen) else 0
    steps, step = epochs * batches, 0
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(chosen), batches):
            batch = np.sort(batch)
            n = size[batch]
            own = np.repeat(np.arange(len(batch)), n)
            place = np.repeat(first[batch], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            mine = buckets[place]
            mean = _sums(embed, mine, own, len(batch)) / (3 * n[:, None])
            error = _softmax(mean @ weight + bias)
            error[np.arange(len(batch)), target[batch]] -= 1
            rate = RATE * (1 - step / steps)
            back = (error @ weight.T) / (3 * n[:, None])
            weight -= rate * mean.T @ error / len(batch)
            bias -= 0.1 * rate * error.sum(axis=0) / len(batch)
            move = np.repeat((rate * back).astype(np.float32), 3 * n, axis=0)
            flat = mine.ravel()
            order = np.argsort(flat, kind="stable")
            starts = np.flatnonzero(np.concatenate([[True], np.diff(flat[order]) != 0]))
            embed[flat[order][starts]] -= np.add.reduceat(move[order], starts, axis=0)
            step += 1
    model = {"table": (embed @ weight).astype(np.float32), "bias": bias, "temperature": 1.0, "threshold": 0.0}
    check = np.flatnonzero(held) if held.any() else chosen
    keep = np.isin(owner, check)
    scores = (_sums(model["table"], buckets[keep], owner[keep], len(segments)) / np.maximum(3 * size, 1)[:, None] + bias)[check]
    truth = target[check]
    losses = [(float(-np.log(_softmax(scores / t)[np.arange(len(check)), truth] + 1e-9).clip(0, 4).mean()), t) for t in (0.1, 0.2, 0.3, 0.5, 0.7, 1.0, 1.5, 2.0)]
    model["temperature"] = min(losses)[1]
    p = _softmax(scores / model["temperature"])
    sure, right = p.max(axis=1), p.argmax(axis=1) == truth
    order = np.argsort(-sure)
    wrong = np.cumsum(~right[order]) / np.arange(1, len(order) + 1)
    accepted = np.flatnonzero(wrong <= max(ERROR_AIM, float((~right[sure > 0.99]).mean()) if (sure > 0.99).any() else 0.0) * 1.05)
    model["threshold"] = float(np.clip(sure[order][accepted[-1]] if len(accepted) else 0.9, 0.4, 0.9))
    return model


def segments_of(text: str) -> list[tuple[int, int, str]]:
    """(begin, end, segment) of the sentences of a text, in one line each; endless ones in parts of `SEGMENT_CHARS`."""
    out, at = [], 0
    for m in [*_BREAK.finditer(text), None]:
        end = m.start() if m else len(text)
        for k in range(at, end, SEGMENT_CHARS):
            s = text[k : min(k + SEGMENT_CHARS, end)]
            if not s.isspace():
                out.append((k, k + len(s), s.replace("\n", " ").replace("\r", " ")))
        at = m.end() if m else end
    return out


def _scored(segments: list[str], model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(probabilities, letters, words) of each segment."""
    buckets, owner, letters, words = features(segments)
    size = np.bincount(owner, minlength=len(segments))
    raw = _sums(model["table"], buckets, owner, len(segments))
    return _softmax((raw / np.maximum(3 * size, 1)[:, None] + model["bias"]) / model["temperature"]), letters, words


def judge(texts: list[str | None], model: dict) -> list[list[tuple[int, int, str | None, float]]]:
    """For each text its (begin, end, language, confidence): one entry, or one for each segment group of a mixed text; the language is None if it is rejected."""
    parts: list[tuple[int, int, str]] = []
    owners: list[int] = []
    for i, t in enumerate(texts):
        if t:
            p = segments_of(repaired(t))
            parts += p
            owners += [i] * len(p)
    result: list[list[tuple[int, int, str | None, float]]] = [[] for _ in texts]
    if not parts:
        return [[(0, len(t or ""), None, 0.0)] for t in texts]
    p, letters, words = (np.concatenate(x) for x in zip(*(_scored([q[2] for q in parts[a:b]], model) for a, b in _steps([q[2] for q in parts]))))
    enough = (letters >= LEAST_LETTERS) | (letters <= -LEAST_LETTERS_UNSPACED)
    sure, best = p.max(axis=1), p.argmax(axis=1)
    several = enough & (words >= SEGMENT_WORDS) & (sure >= model["threshold"])
    weight = np.abs(letters)
    text_of = np.array(owners)
    starts = np.flatnonzero(np.concatenate([[True], np.diff(text_of) != 0]))
    ends = np.append(starts[1:], len(text_of))
    total = np.add.reduceat(weight * enough, starts)
    mean = np.add.reduceat(p * (weight * enough)[:, None], starts, axis=0) / np.maximum(total, 1)[:, None]
    seen = np.zeros((len(starts), len(LANGUAGES)), bool)
    row = np.repeat(np.arange(len(starts)), ends - starts)
    seen[row[several], best[several]] = True
    kinds = seen.sum(axis=1)
    top = np.where(kinds > 0, seen.argmax(axis=1), mean.argmax(axis=1))
    level = mean[np.arange(len(starts)), top]
    one = (kinds == 1) | ((kinds == 0) & (total > 0) & (level >= model["threshold"]))
    for s, e, n, single, lang, conf in zip(starts.tolist(), ends.tolist(), kinds.tolist(), one.tolist(), top.tolist(), level.tolist()):
        i = owners[s]
        if n < 2:
            result[i].append((parts[s][0], parts[e - 1][1], LANGUAGES[lang] if single else None, conf))
            continue
        runs: list[list] = []
        for j in range(s, e):
            lang = int(best[j]) if several[j] else (runs[-1][2] if runs else None)
            if runs and (runs[-1][2] == lang or runs[-1][2] is None):
                runs[-1][1], runs[-1][2] = parts[j][1], lang
            else:
                runs.append([parts[j][0], parts[j][1], lang, []])
            if several[j]:
                runs[-1][3].append((float(sure[j]), int(weight[j])))
        for b, f, lang, c in runs:
            result[i].append((b, f, LANGUAGES[lang], sum(x * w for x, w in c) / sum(w for _, w in c)))
    return [found or [(0, len(t or ""), None, 0.0)] for t, found in zip(texts, result)]


def fit(rows: DataFrame, id_col: str, label: str, text: str) -> dict:
    """The model trained on a bounded sample of labelled rows, chosen alike at every size."""
    labelled = rows.select(F.col(id_col).alias("id"), label_code(F.col(label)).alias("code"), F.col(text).alias("t"))
    labelled = labelled.where(F.col("code").isin(*LANGUAGES) & (F.length("t") >= 20))
    place = Window.partitionBy("code").orderBy(F.xxhash64("id"), "id", "t")
    sample = labelled.withColumn("k", F.row_number().over(place)).where(F.col("k") <= SAMPLE_PER_LANGUAGE).orderBy("code", "k").collect()
    return train([r["t"] for r in sample], [r["code"] for r in sample])


def _steps(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start = 0
    while start < len(texts):
        stop, chars = start, 0
        while stop < len(texts) and (stop == start or chars + len(texts[stop] or "") <= CHARS_PER_STEP):
            chars += len(texts[stop] or "")
            stop += 1
        yield start, stop
        start = stop


def languages(rows: DataFrame, id_col: str, label: str, text: str) -> DataFrame:
    """(`id`, `label_lang`, `segment`, `begin`, `end`, `lang`, `confidence`, `mixed`): a row per text, or per segment of a mixed one.

    `lang` is null where no language is sure, also for null and empty texts. `begin` and
    `end` are places in the text in its regular form.
    """
    shared = rows.sparkSession.sparkContext.broadcast(fit(rows, id_col, label, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, codes, texts = (batch.column(i).to_pylist() for i in range(3))
            for start, stop in _steps(texts):
                out = [
                    (ids[start + i], codes[start + i], k, b, e, lang, conf, len({x[2] for x in found}) > 1)
                    for i, found in enumerate(judge(texts[start:stop], shared.value))
                    for k, (b, e, lang, conf) in enumerate(found)
                ]
                cols = list(zip(*out)) if out else [[]] * 8
                kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.bool_())
                names = ["id", "label_lang", "segment", "begin", "end", "lang", "confidence", "mixed"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    asked = rows.select(F.col(id_col).cast("long").alias("id"), label_code(F.col(label)).alias("label_lang"), F.col(text).alias("t"))
    return asked.mapInArrow(run, "id long, label_lang string, segment int, begin int, end int, lang string, confidence double, mixed boolean")


def mislabelled(rows: DataFrame, id_col: str, label: str, text: str) -> DataFrame:
    """(`id`, `lang`): each language of the texts whose label is missing or names another one, or that are mixed."""
    found = languages(rows, id_col, label, text).where(F.col("lang").isNotNull())
    asked = F.col("mixed") | F.col("label_lang").isNull() | (F.col("label_lang") != F.col("lang"))
    return found.where(asked).select("id", "lang").distinct()
