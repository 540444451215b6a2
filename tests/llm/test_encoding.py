"""Token ids against the two public libraries."""

import base64
import os
import random

import pytest
import regex

from fernweave.llm import encoding as E

FILE = os.path.join(E.TOKENIZER_FOLDER, "byte_bpe_50k.json")
RANKS = os.path.join(E.TOKENIZER_FOLDER, "byte_bpe_50k.tiktoken")
pytestmark = pytest.mark.skipif(not os.path.exists(FILE), reason="no tokenizer files")
TEXTS = ["", None, "Hello  world's   end\n\n", "tôi đã chơi 12 giờ", "日本語のテキスト", "<|endoftext|> inside", "a" * 5000, " " * 300, "👨‍👩‍👧 10/10", "ab" * 3000, "�\x00\t"]


def libraries():
    import tiktoken
    import tokenizers

    hf = tokenizers.Tokenizer.from_file(FILE)
    hf.encode_special_tokens = True
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    tt = tiktoken.Encoding("own", pat_str=E.SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda t: hf.encode(t, add_special_tokens=False).ids, tt.encode_ordinary


def test_equal_to_both_libraries():
    rng = random.Random(8)
    parts = ["a", "aa", " ", "é", "\n", "日", "🤦🏽", "1", "  ", "'s", "the", "ing", "́", "Ω"]
    texts = TEXTS + ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(500)]
    ids, sizes = E.encode_texts(texts, E.read_vocabulary(FILE), regex.compile(E.SPLIT_PATTERN))
    one, two = libraries()
    at = 0
    for t, n in zip(texts, sizes):
        got = ids[at : at + n].tolist()
        at += n
        assert got == one(t or "") == two(t or "")


def test_rows_pass_one_for_one(spark, monkeypatch):
    monkeypatch.setattr(E, "CHARS_PER_STEP", 100)
    rows = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(TEXTS)] + [(2, TEXTS[2], "x", 1)], "doc_id long, text string, ids string, _text int")
    got = [(r.doc_id, list(r.ids)) for r in E.encode(rows, "doc_id", "text").collect()]
    one, _ = libraries()
    assert sorted(got) == sorted((k, one(t or "")) for k, t in [*enumerate(TEXTS), (2, TEXTS[2])])
    assert E.encode(rows.limit(0), "doc_id", "text").count() == 0
