"""Own BPE against the tokenizers library."""

import hashlib
import random
import time

import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from streetgrove.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "\n\n  x", "a" * 5000, "ab" * 3000, "aaa aaaa aaaaa", "Hello <|endoftext|> world<|endoftext|>", "<|endoftext|>", "it's we'll THE'S",
    "élève \U0001f600‍\U0001f525 漢字かな 123456 \t\r\n", "Hello <|endoftext|> world<|endoftext|>", "x\x00y\x1cz\x85", "<|endof" + "text|", "word " * 4000,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def rows(spark, texts):
    return spark.createDataFrame([(i, t, "clash", 7) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string, ids int")


def test_counts_equal_library(spark, library):
    got = {r.doc_id: r for r in bpe.token_counts(rows(spark, TEXTS), PATH).collect()}
    for i, t in enumerate(TEXTS):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 512)


def test_ids_equal_library(spark, library):
    got = {r.doc_id: r for r in bpe.encode_decode(rows(spark, TEXTS), PATH, with_ids=True).collect()}
    for i, t in enumerate(TEXTS):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_documents_equal_library(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    ids = {r.doc_id: r.ids for r in bpe.encode_decode(docs, PATH, with_ids=True).collect()}
    counts = {r.doc_id: r.n_tokens for r in bpe.token_counts(docs, PATH).collect()}
    for r in docs.collect():
        want = library.encode(r.text, add_special_tokens=False).ids
        assert ids[r.doc_id] == want and counts[r.doc_id] == len(want)


def test_empty_table(spark):
    assert bpe.token_counts(rows(spark, []), PATH).count() == 0
    assert bpe.encode_decode(rows(spark, []), PATH).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abthe én", max_size=24), max_size=12))
def test_index_equals_merging_alone(pieces):
    v = bpe.vocabulary(PATH)
    encoded = [p.encode() for p in pieces]
    assert [len(ids) for ids in bpe.merge_all(v, encoded)] == [v.count(p) for p in encoded]
    assert [b"".join(v.bytes_of[i] for i in ids) for ids in bpe.merge_all(v, encoded)] == encoded


def test_stretches_equal_library(library):
    rng = random.Random(3)
    parts = [" ", "  ", "\n", " \n", "\n ", "\t", "\x1c", "\x85", "\u3000", "\u00a0", "a", "word", "Straße", "é", "ª", "²", "Ⅷ", "漢", "'s", " 's", "it's", ".", ",", "...", "9", "<|endoftext|>", "x" * 60]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(6000)]
    memory = bpe.Stretches(PATH)
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert memory.counts(texts[:3000]) + memory.counts(texts[3000:]) == want
    assert memory.counts(texts) == want and not any(len(s) > bpe.LONGEST for s in memory.spaced)


def test_memory_is_bounded(library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 50)
    memory, rng = bpe.Stretches(PATH), random.Random(1)
    for _ in range(20):
        texts = [" ".join("".join(rng.choice("abcé.1") for _ in range(5)) for _ in range(10)) for _ in range(10)]
        assert memory.counts(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
        assert len(memory.spaced) <= 50 + 250 and len(memory.pieces) <= memory.whole + 50 + 500


def test_repeated_words_outlive_a_full_memory(library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 50)
    memory, learned = bpe.Stretches(PATH), []
    learn = memory.learn
    monkeypatch.setattr(memory, "learn", lambda stretches, plain: learned.extend(plain) or learn(stretches, plain))
    for k in range(10):
        text = "the often word " + " ".join(chr(97 + k) + chr(97 + i) + "x" for i in range(26)) + " often word again"
        assert memory.counts([text]) == [len(library.encode(text, add_special_tokens=False).ids)]
    assert learned.count(" often") == learned.count(" again") == 1 and len(memory.spaced) <= 100


def test_one_very_long_pre_token(library):
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefgh") for _ in range(100_000))
    start = time.time()
    assert bpe.Stretches(PATH).counts([text]) == [len(library.encode(text, add_special_tokens=False).ids)]
    assert time.time() - start < 20


def test_shortcut_is_proved(library):
    whole = bpe.whole_tokens(PATH)
    assert len(whole) > 40_000
    for piece in sorted(whole)[::500]:
        assert len(library.encode(piece, add_special_tokens=False).ids) == 1


def test_words_are_counted_from_arrow(library):
    """Texts are given as Arrow has them; blanks of every kind, special strings and empty texts count as the library counts them."""
    rng, special = random.Random(4), next(iter(bpe.vocabulary(PATH).special))
    parts = ("a", "bc", " ", "  ", "\n", "\t", " ", "é", "1", ".", "'s", special, "Ж", "x.", " the")
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(400)] + ["", " ", special, special + special, " a  b "]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    memory = bpe.Stretches(PATH)
    assert memory.counts(pa.array(texts)) == want and memory.counts(pa.array(texts[7:]).slice(3)) == want[10:]
    assert memory.counts(pa.array([], pa.string())) == []
