"""Patricia owners against a dictionary."""

import hashlib
import random

from streetgrove.llm import exact


def brute(rows, largest=True):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").encode().lower(), []).append(i)
    out = []
    for key, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = (max if largest else min)(known) if known else None
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(key).hexdigest()) for i in ids]
    return sorted(out, key=str)


def docs(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, owner string, copies int").repartition(parts)


def test_equals_dictionary(spark):
    rng = random.Random(5)
    rows = [(1, None), (2, ""), (3, ""), (4, "ABC"), (5, "abc"), (6, "abcd"), (7, "É"), (8, "é"), (9, "ab"), (None, "abc"), (None, "solo"), (4, "ABC"), (4, "other")]
    rows += [(100 + k, "x" * rng.randint(0, 4) + rng.choice(["", "y", "Y" * 3000, "zé"])) for k in range(200)]
    rows += [(1000 + k, "hot copy") for k in range(300)]
    got = sorted([tuple(r) for r in exact.exact_duplicates(docs(spark, rows)).collect()], key=str)
    assert got == brute(rows)
    got = sorted([tuple(r) for r in exact.exact_duplicates(docs(spark, rows), largest=False, trie_bytes=50).collect()], key=str)
    assert got == brute(rows, largest=False)


def test_empty_table(spark):
    assert exact.exact_duplicates(docs(spark, [], 1)).count() == 0


def test_spill_keeps_every_string():
    rng = random.Random(1)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    for limit in (10, 200, 1 << 30):
        trie = exact.Patricia(limit)
        for i, s in enumerate(strings):
            trie.insert(s, i, 1, (i,))
            assert trie.held <= limit + 200
        found = {key: (o.best, o.copies, sorted(o.members)) for key, o in trie.items()}
        want = {}
        for i, s in enumerate(strings):
            want.setdefault(s, []).append(i)
        assert found == {s: (ids[-1], len(ids), ids) for s, ids in want.items()}
