"""Best-fit packing by histogram against the walk piece by piece."""

import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from streetgrove.llm import packing as p
from streetgrove.llm import queries


def walk(lengths, sizes, cost):
    """Contents of each bin, sequentially."""
    sizes = sorted(sizes)
    order = sorted(lengths, reverse=True)
    bins = []  # [size, used, contents]
    k = 0
    while k < len(order):
        length = order[k]
        fits = [b for b in bins if b[0] - b[1] >= length]
        if fits:
            b = min(fits, key=lambda b: b[0] - b[1])
            b[1] += length
            b[2].append(length)
            k += 1
            continue
        n = order[k:].count(length)
        smaller = sum(x for x in order[k:] if x < length)

        def price(s, length=length, n=n, smaller=smaller):
            each = min(s // length, n)
            return cost(s) / (each * length + min(s - each * length, smaller / -(-n // each)))

        bins.append([min((s for s in sizes if s >= length), key=lambda s: (price(s), s)), 0, []])
        size = bins[-1][0]
        # The price holds for all pieces of this length.
        while k < len(order) and order[k] == length:
            if bins[-1][0] - bins[-1][1] < length:
                bins.append([size, 0, []])
            bins[-1][1] += length
            bins[-1][2].append(length)
            k += 1
    return Counter((next(s for s in sizes if s >= used), tuple(sorted(content))) for _, used, content in bins)


def contents(rows):
    bins = defaultdict(list)
    for r in rows:
        if r.bin_id is not None:
            bins[r.bin_id].append(r)
    found = Counter()
    for own in bins.values():
        assert len({(r.bin_size, r.bin_used) for r in own}) == 1
        at = 0
        for r in sorted(own, key=lambda r: r.bin_start):
            assert r.bin_start == at
            at += r.length
        assert at == own[0].bin_used <= own[0].bin_size
        found[own[0].bin_size, tuple(sorted(r.length for r in own))] += 1
    return found


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_walk(spark, seed):
    rng = random.Random(seed)
    sizes = rng.choice([(8, 16, 32), (10,), (5, 7, 50)])
    rows = [(k, rng.choice([0, None, 1, 2, 3, rng.randint(1, 40), rng.randint(1, 120), 9, 9, 9])) for k in range(300)]
    docs = spark.createDataFrame([(i, n, "x") for i, n in rows], "doc_id long, n long, bin_id string").repartition(3)
    got = p.best_fit(docs, sizes=sizes, tokens=F.col("n")).collect()
    largest = max(sizes)
    assert Counter({i: sum(r.length for r in got if r.doc_id == i) for i, _ in rows}) == Counter({i: n or 0 for i, n in rows})
    lengths = [x for _, n in rows if n for x in [largest] * (n // largest) + [n % largest] * (n % largest > 0)]
    assert sorted(r.length for r in got if r.length) == sorted(lengths)
    found = contents(got)
    assert found == walk(lengths, sizes, p.sequence_cost)


def test_texts_empty_and_repeated(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "é" * 5000), (3, "é" * 5000), (None, "abc")], "doc_id long, text string")
    got = p.best_fit(docs).collect()
    assert sum(r.length for r in got) == 2500 * 2 + 1 and sum(r.bin_id is None for r in got) == 2
    contents(got)
    assert p.best_fit(docs.limit(0)).count() == 0


def test_plan_is_bounded():
    rows = p.plan({length: 10**9 // length for length in range(1, 4097)})
    assert len(rows) < 60_000
    assert sum(last - first + 1 for _, first, last, *_ in rows) == sum(10**9 // length for length in range(1, 4097))


@pytest.mark.parametrize("pack", [queries.op8_best_fit_packing, lambda spark, sf: corpus_pipeline.pack(spark, queries.table(spark, sf, "documents"), sf)])
def test_bins_hold_library_tokens(spark, tmp_path, pack):
    texts = [None, "", "Straßenbäume überwölben die Gehwege. " * 900, "naïve façade déjà vu " * 40, "word " * 300, "<|endoftext|>x", "word " * 300]
    ids = [0, 1, 2, 3, 4, 5, 4]
    spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, t in zip(ids, texts, strict=True):
        want[i] += len(library.encode(t or "", add_special_tokens=False).ids)
    got = pack(spark, str(tmp_path)).collect()
    assert Counter({i: sum(r.length for r in got if r.doc_id == i) for i in ids}) == want
    contents(got)
