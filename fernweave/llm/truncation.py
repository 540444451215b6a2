"""Texts that were cut off by a field limit or in transfer.

A text that doesn't end in a finished sentence has an open end. Its value is the last
sentence; the text counts as cut if that value is a strict prefix of a longer copy, that
is of a longer sentence elsewhere in the corpus (`longer_copy`). All values are sorted
once by ranges: the copies of which a value is a prefix stand right behind it, so one
look at the next sentence decides, across the border of two ranges too. Before the
comparison numbers, names and addresses are masked, as a copy seldom repeats them.

An end with no copy as a whole is compared by its last words: two words of context and a
partial word that is the strict prefix of a longer one, joined by hashes of fixed-length
prefixes (`longer_part`). Two further signs hold where there is no copy at all: words
that elsewhere always go on, unless several texts end with just these words
(`goes_on`), and a length at which its source piles up open ends (`at_limit`).

An end that finishes a text without a full stop (signature, link, tag, price, rating,
emoji) is no cut, unless the whole text is a strict prefix of a longer one (`longer_text`).

Null and blank texts are never cut. Ties, repeated rows and repeated ids give one result
row for each row; a null source is a source of its own. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernweave.session import cut_lineage

PREFIX_CHARS = 3
TEXT_PREFIXES = (64, 16, 1)
GOES_ON_SHARE = 0.5
LIMIT_SHARE_OF_OPEN = 0.05
LIMIT_DEVIATIONS = 5.0
LIMIT_NEIGHBOURS = 10
NAMED_START_WORDS = 3

_BLANK = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_CLOSERS = "[\"'”’»)\\]}」』]*"
_UNSPACED = "ぁ-ヿ㐀-䶿一-鿿가-힯"
_MARK = rf"{_BLANK}*[\[(]?(?:…|\.{{3,}}|\x{{fffd}}+)[\])]?\z"
_CLOSED = rf"[.!?。！？]{_CLOSERS}\z"
_BREAK = rf"([.!?]{_CLOSERS}(?:{_BLANK}+|\z)|[。！？]{_CLOSERS}{_BLANK}*|\n+)"
_ADDRESS = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_.-]*[\p{L}\p{N}_]|[\p{L}\p{N}_.+-]+@|(?:https?://|www\.)[^ ]*"
_ONE_NAME = r"(?:\p{Lu}[\p{L}\p{M}'’]*|[0-9]+(?:[.,][0-9]+)*)"
_NAMES = rf"([ (\"'«„“/-]){_ONE_NAME}(?:[ -]{_ONE_NAME})*"
_FIRST_NAME = r"^\p{Lu}[\p{L}\p{M}'’]*(?:[ -]#)*"
_BULLET = r"^[-*•] +"
# Endings that finish a text without a full stop: signature, link, tag, price, rating, emoji.
_FINISHED = (
    r"(?:^|\s)[-–—~]\s?(?:the\s)?\p{Lu}[\p{L}\p{M}'’.]*(?:\s\p{L}[\p{L}\p{M}'’.]*){0,2}$"
    r"|(?:https?://|www\.)\S+$"
    r"|(?:^|\s)[#@][\p{L}\p{N}_]{2,}$"
    r"|[$€£¥₫]\s?\d[\d.,]*$|\d[\d.,]*\s?(?:[$€£¥₫]|USD|EUR|GBP|VND)$"
    r"|(?:^|\s)\d{1,3}(?:[.,]\d)?\s?/\s?\d{1,3}$"
    r"|[\p{So}\p{Sk}\x{200d}\x{fe0f}]$|(?:^|\s)[:;=8xX]'?-?[)(DPpdO3*/\\|]+$|<3$|\^_?\^$"
)
_CUT = "\u0001"
_NAMED = "\u0002"


def bodies(texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(texts without outer blanks, those without a mark of omission at the end, open): open if a text doesn't end in a finished sentence."""
    body = pc.utf8_trim_whitespace(pc.replace_substring_regex(texts, f"[{_CUT}{_NAMED}]", " "))
    bare = pc.replace_substring_regex(body, _MARK, "")
    return body, bare, pc.or_(pc.not_equal(body, bare), pc.invert(pc.match_substring_regex(bare, _CLOSED)))


def sentences(bare: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(sentence, text): the sentences of all texts, line by line, without blank ones, and the place of the text of each."""
    parts = pc.split_pattern(pc.replace_substring_regex(bare, _BREAK, "\\1" + _CUT), _CUT)
    flat = pc.utf8_trim_whitespace(pc.list_flatten(parts))
    kept = pc.not_equal(flat, "")
    return flat.filter(kept), pc.list_parent_indices(parts).filter(kept).to_numpy()


def masked(sentences: pa.Array) -> pa.Array:
    """Sentences without a list sign as they are compared: addresses, numbers and names masked; the first word stays."""
    out = pc.replace_substring_regex(sentences, _BULLET, "")
    if pc.any(pc.match_substring_regex(out, "@|://|www")).as_py():
        out = pc.replace_substring_regex(out, _ADDRESS, "@")
    return pc.replace_substring_regex(pc.replace_substring_regex(out, _NAMES, "\\1#"), "^[0-9]+(?:[.,][0-9]+)*", "#")


def named_start(value: Column) -> Column:
    """A masked sentence whose first word is masked as a name, too."""
    return F.concat(F.lit(_NAMED), F.regexp_replace(value, _FIRST_NAME, "#"))


def listed(value: Column) -> Column:
    """A masked sentence as an item of a list."""
    return F.concat(F.lit("- "), value)


def tokens(value: Column) -> Column:
    """Words of a masked sentence; ideographs and syllables stand alone."""
    spaced = F.when(value.rlike(f"[{_UNSPACED}]"), F.btrim(F.regexp_replace(value, f" *([{_UNSPACED}]) *", " $1 "))).otherwise(value)
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(value, item, n): masked sentences of each batch, without the last ones of open texts."""
    for batch in batches:
        _, bare, is_open = bodies(batch.column(0))
        found, text = sentences(bare)
        last = np.append(text[1:] != text[:-1], True)[: len(text)]
        found = found.filter(pa.array(~(last & is_open.to_numpy(zero_copy_only=False)[text]), pa.bool_()))
        rows = pa.table({"value": masked(found), "item": pc.match_substring_regex(found, _BULLET)})
        rows = rows.group_by(["value", "item"]).aggregate([([], "count_all")])
        yield from rows.select(["value", "item", "count_all"]).rename_columns(["value", "item", "n"]).combine_chunks().to_batches()


def _open_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with an open end, the signs of the end, and its value."""
    for batch in batches:
        body, bare, is_open = bodies(batch.column(2))
        body, bare = body.filter(is_open), bare.filter(is_open)
        found, text = sentences(bare)
        at = np.searchsorted(text, np.arange(len(bare)), "right") - 1
        at = np.where((at >= 0) & (text[np.maximum(at, 0)] == np.arange(len(bare))), at, -1) if len(text) else np.full(len(bare), -1)
        last = pc.fill_null(found.take(pa.array(at, mask=at < 0)), "")
        finishing, bullet = pc.match_substring_regex(last, _FINISHED), pc.match_substring_regex(last, _BULLET)
        finished = pc.and_(finishing, pc.equal(body, bare))
        value = masked(last)
        value = pc.if_else(pc.and_(bullet, finishing), pc.binary_join_element_wise("- ", value, ""), value)
        whole = pc.or_(pc.equal(bare, ""), pc.match_substring_regex(bare, _CLOSED))
        columns = [pc.utf8_length(batch.column(2).filter(is_open)), pc.if_else(finished, bare, None), finished, whole, pc.ends_with(body, "\ufffd"), pc.and_(bullet, pc.match_substring_regex(bare, r"\n[-*•] ")), value]
        names = ["chars", "bare", "finished", "whole", "broken", "bullet", "value"]
        kinds = [pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column(k).filter(is_open) for k in range(2)] + [c.cast(k) for c, k in zip(columns, kinds)], ["id", "source", *names])


def _bare_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([bodies(batch.column(0))[1]], ["value"])


def has_longer(values: DataFrame, ends: DataFrame) -> DataFrame:
    """(`value`): the values of `ends` that are strict prefixes of a value of `values`; both have one column, `value`.

    All are sorted by ranges. The longer copies of an end follow it directly, so the next
    of `values` decides; at the end of a range that is the first one of a later range, of
    which there is one for each range.
    """
    both = values.select("value", F.lit(True).alias("whole")).distinct().unionByName(ends.select("value", F.lit(False).alias("whole")).distinct())
    ranged = both.repartitionByRange("value").sortWithinPartitions("value", "whole")
    ranged = cut_lineage(ranged.withColumn("part", F.spark_partition_id()))
    firsts = sorted((r[0], r[1]) for r in ranged.where("whole").groupBy("part").agg(F.min("value")).collect())

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[str] = []
        part = None
        for batch in batches:
            found: list[str] = []
            for value, whole, part in zip(*(batch.column(k).to_pylist() for k in range(3))):
                while waiting and not value.startswith(waiting[-1]):
                    waiting.pop()
                if whole:
                    if waiting and waiting[-1] == value:
                        waiting.pop()
                        found += waiting
                        waiting = [value]
                    else:
                        found += waiting
                        waiting.clear()
                else:
                    waiting.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["value"])
        after = next((v for p, v in firsts if part is not None and p > part), "")
        yield pa.RecordBatch.from_arrays([pa.array([w for w in waiting if after.startswith(w) and after != w], pa.string())], ["value"])

    return ranged.mapInArrow(search, "value string").distinct()


def _longer_texts(texts: DataFrame, ends: DataFrame) -> DataFrame:
    """(`value`): whole texts of `ends` that are strict prefixes of longer texts, which are first sought by hashes of prefixes of fixed lengths."""
    asked = ends.select("value").distinct()

    def hashed(value: Column, sizes: Column) -> Column:
        return F.transform(sizes, lambda n: F.xxhash64(n, F.substring(value, F.lit(1), n)))

    sizes = F.filter(F.array(*map(F.lit, TEXT_PREFIXES)), lambda n: F.length("value") >= n)
    keys = asked.select(F.explode(hashed(F.col("value"), F.slice(sizes, 1, 1))).alias("key")).distinct()
    body = F.btrim("t")
    all_sizes = F.filter(F.array(*map(F.lit, TEXT_PREFIXES)), lambda n: F.length(body) >= n)
    near = texts.select("t", F.explode(hashed(body, all_sizes)).alias("key")).join(keys, "key", "left_semi").select("t").distinct()
    return has_longer(near.mapInArrow(_bare_only, "value string"), asked)


def _context(tokens: Column) -> list[Column]:
    """The two tokens before the last one and the last, maybe partial, one."""
    size = F.size(tokens)
    at = lambda k: F.coalesce(F.get(tokens, size - k), F.lit("^"))
    return [at(3).alias("c1"), at(2).alias("c2"), F.coalesce(F.get(tokens, size - 1), F.lit("")).alias("tail")]


def _parts(values: DataFrame, asked: DataFrame) -> DataFrame:
    """(c1, c2, tail, longer_part, share): for asked contexts, if the tail is a strict prefix of a word there, and how often the context goes on."""
    keys = asked.select("c1", "c2").distinct()
    places = values.select("n", F.concat(F.array(F.lit("^"), F.lit("^")), tokens(F.col("value"))).alias("t"))
    places = places.select("n", F.explode(F.transform(F.sequence(F.lit(2), F.size("t") - 1), lambda k: F.struct(F.get("t", k - 2).alias("c1"), F.get("t", k - 1).alias("c2"), F.get("t", k).alias("w")))).alias("g"))
    seen = places.select("g.*", "n").join(keys, ["c1", "c2"], "left_semi").groupBy("c1", "c2", "w").agg(F.sum("n").alias("n"))
    seen = cut_lineage(seen)
    sizes = F.explode(F.sequence(F.lit(0), F.least(F.length("w") - 1, F.lit(PREFIX_CHARS))))
    short = seen.select("c1", "c2", "w", sizes.alias("size")).withColumn("prefix", F.expr("substring(w, 1, size)"))
    short = short.select("c1", "c2", "size", "prefix", F.when(F.col("size") == PREFIX_CHARS, F.col("w")).alias("w")).distinct()
    tails = asked.select("c1", "c2", "tail", F.least(F.length("tail"), F.lit(PREFIX_CHARS)).alias("size"), F.expr(f"substring(tail, 1, {PREFIX_CHARS})").alias("prefix")).distinct()
    copied = tails.join(short, ["c1", "c2", "size", "prefix"]).where("w is null or (startswith(w, tail) and w <> tail)").select("c1", "c2", "tail").distinct()
    on = seen.groupBy("c1", "c2").agg(F.sum("n").alias("on"))
    ended = asked.groupBy("c1", "c2").agg(F.sum("ends").alias("ended"))
    share = on.join(ended, ["c1", "c2"]).select("c1", "c2", (F.col("on") / (F.col("on") + F.col("ended"))).alias("share"))
    return asked.select("c1", "c2", "tail").distinct().join(copied.withColumn("longer_part", F.lit(True)), ["c1", "c2", "tail"], "left").join(share, ["c1", "c2"], "left")


def _limits(ends: DataFrame) -> DataFrame:
    """(`s`, `length`): lengths at which a source has far more open ends than at the lengths around."""
    counted = ends.where("not finished and not whole").groupBy("source", "chars").agg(F.count(F.lit(1)).alias("here"))
    near = Window.partitionBy("source").orderBy("chars").rangeBetween(-LIMIT_NEIGHBOURS, LIMIT_NEIGHBOURS)
    expected = (F.sum("here").over(near) - F.col("here")) / (2 * LIMIT_NEIGHBOURS)
    rated = counted.withColumn("expected", expected).withColumn("all_open", F.sum("here").over(Window.partitionBy("source")))
    piled = (F.col("here") > F.col("expected") + LIMIT_DEVIATIONS * F.sqrt(F.col("expected") + 1)) & (F.col("here") >= LIMIT_SHARE_OF_OPEN * F.col("all_open"))
    return rated.where(piled).select(F.col("source").alias("s"), F.col("chars").alias("length"), F.lit(True).alias("at_limit"))


def cut_texts(rows: DataFrame, id_col: str, text: str, source: str | None = None) -> DataFrame:
    """(`id`, `source`, `chars`, `cut`, and the signs) for every text with an open end.

    `cut` is true if the text ends in a broken character, is a strict prefix of a longer
    text, or its end isn't a finishing one and has one of the signs of this module.
    `at_limit`: the length is one at which the source has `LIMIT_DEVIATIONS` standard
    deviations more open ends than at the lengths around it, and `LIMIT_SHARE_OF_OPEN` of
    all its open ends.
    """
    texts = rows.where(F.length(F.trim(F.col(text))) > 0)
    texts = texts.select(F.col(id_col).alias("id"), (F.col(source) if source else F.lit(None)).cast("string").alias("source"), F.col(text).alias("t"))
    values = texts.select("t").mapInArrow(_counted, "value string, item boolean, n long")
    values = cut_lineage(values.groupBy("value", "item").agg(F.sum("n").alias("n")))
    kind = rows.schema[id_col].dataType.simpleString()
    signs = "chars long, bare string, finished boolean, whole boolean, broken boolean, bullet boolean, value string"
    ends = cut_lineage(texts.mapInArrow(_open_ends, f"id {kind}, source string, {signs}"))
    distinct_ends = ends.where("not whole and value <> ''").groupBy("value").agg(F.count(F.lit(1)).alias("ends"))
    distinct_ends = distinct_ends.withColumn("named", F.when(F.size(F.split("value", " ")) >= NAMED_START_WORDS, named_start(F.col("value"))))
    value = F.col("value")
    longer = values.select(F.explode(F.array_compact(F.array(value, named_start(value), F.when(F.col("item"), listed(value))))).alias("value"))
    asked = distinct_ends.select("value").unionByName(distinct_ends.where("named is not null").select(F.col("named").alias("value")))
    copies = cut_lineage(has_longer(longer, asked))
    copied = distinct_ends.join(copies.select("value", F.lit(True).alias("by_value")), "value", "left").join(copies.select(F.col("value").alias("named"), F.lit(True).alias("by_name")), "named", "left")
    copied = cut_lineage(copied.select("value", "ends", (F.col("by_value").isNotNull() | F.col("by_name").isNotNull()).alias("longer_copy")))

    open_ends = copied.where("not longer_copy").select("value", "ends", *_context(tokens(F.col("value"))))
    parts = _parts(values, open_ends)
    flags = open_ends.join(parts, ["c1", "c2", "tail"], "left").select("value", "longer_part", ((F.col("share") >= GOES_ON_SHARE) & (F.col("ends") == 1)).alias("goes_on"))
    texts_asked = ends.where("finished").select(F.col("bare").alias("value"))
    long_texts = _longer_texts(texts, texts_asked).select(F.col("value").alias("bare"), F.lit(True).alias("longer_text"))

    flagged = ends.join(copied.drop("ends"), "value", "left").join(flags, "value", "left").join(long_texts, "bare", "left")
    flagged = flagged.join(_limits(ends), F.col("source").eqNullSafe(F.col("s")) & (F.col("chars") == F.col("length")), "left")
    sign = {c: F.coalesce(F.col(c), F.lit(False)) for c in ("longer_copy", "longer_part", "goes_on", "at_limit", "longer_text")}
    sign["goes_on"] = sign["goes_on"] & ~F.col("bullet")
    copy = sign["longer_copy"] | sign["longer_part"]
    unfinished = ~F.col("whole") & (~F.col("finished") | (F.col("bullet") & copy))
    cut = F.col("broken") | sign["longer_text"] | (unfinished & (copy | sign["goes_on"] | sign["at_limit"]))
    return flagged.select("id", "source", "chars", cut.alias("cut"), *[s.alias(c) for c, s in sign.items()])


def cut_by_source(rows: DataFrame, id_col: str, text: str, source: str) -> DataFrame:
    """(`source`, `texts`, `cut`, `cut_at_limit`): what each source holds and how much of it was cut."""
    found = cut_texts(rows, id_col, text, source)
    cut = found.where("cut").groupBy("source").agg(F.count(F.lit(1)).alias("cut"), F.count_if("at_limit").alias("cut_at_limit"))
    texts = rows.where(F.col(text).isNotNull()).groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("texts"))
    both = texts.join(cut.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left")
    return both.select("source", "texts", F.coalesce("cut", F.lit(0)).alias("cut"), F.coalesce("cut_at_limit", F.lit(0)).alias("cut_at_limit"))
