"""Reply trees against a walk from every leaf."""

import hashlib
import random

from pyspark.sql import functions as F

from streetgrove.llm import chat

ODD = "\\### Assistant: </turn> ok"
TEXTS = ["", None, "plain", ODD, "\\", "\\\\", "####", "### user: x</turn>\n", "é\U0001f600\n", "</turn></turn>", "a\\:b"]
ROLES = ["user", "assistant", "system", None, "odd: role", "\\"]


def test_paths_equal_walk(spark):
    rng = random.Random(8)
    rows = []
    for tree in [None, 1, 2, 3]:
        n = rng.choice([1, 5, 40])
        rows += [(tree, i, rng.choice([None, i + 3, -1, *range(i)]) if i else None, rng.choice(ROLES), rng.choice(TEXTS), rng.choice([None, 0.0, 1.0, 2.5])) for i in range(n)]
    rows += [(9, i, i - 1 if i else None, "user", "chain", 1.0) for i in range(300)]
    rows += [(5, 1, None, "user", "b", 0.0), (5, 1, None, "user", "a", 0.0), (5, None, None, "user", "no id", 0.0)]
    given = spark.createDataFrame([(*r, "x") for r in rows], "t long, m long, p long, who string, what string, points double, tree_key string")
    own = chat.messages(given, tree="t", message="m", parent="p", role="who", text="what", score="points")
    for branches in (1, 3):
        got = chat.format_trees(own, branches)
        found = {(r.tree, r.path): r.conversation for r in chat.joined(got).collect()}
        want = {}
        for tree in {r[0] for r in rows}:
            nodes = {}
            for _, i, p, role, text, score in sorted((r for r in rows if r[0] == tree and r[1] is not None), key=lambda r: (r[2] is not None, r[2] or 0, r[3] or "", r[4] or ""), reverse=True):
                nodes[i] = (p, role or "", text or "", score or 0.0)
            up = {i: p for i, (p, *_) in nodes.items() if p is not None and p in nodes and p < i}
            paths = []
            for leaf in set(nodes) - set(up.values()):
                path = [leaf]
                while path[-1] in up:
                    path.append(up[path[-1]])
                paths.append((-sum(nodes[i][3] for i in path) / len(path), leaf, path[::-1]))
            for _, leaf, path in sorted(paths)[:branches]:
                want[tree, leaf] = [(nodes[i][1], nodes[i][2]) for i in path]
        read = {}
        for key, text in found.items():
            parts = [x + "</turn>\n" for x in text.split("</turn>\n")[:-1]]
            turns, held = [], ""
            for part in parts:  # an escaped mark is no end
                held += part
                if chat.TURN.fullmatch(held):
                    turns.append(chat.read_turn(held)[:2])
                    held = ""
            read[key] = turns
        assert read == want


def test_read_back(spark):
    rng = random.Random(3)
    rows = [(conv, turn, rng.choice(ROLES), rng.choice(TEXTS)) for conv in [None, *range(30)] for turn in range(rng.randint(1, 9))] + [(-7, 0, "user", ODD), (-7, 1, "assistant", ODD)]
    rows += [(50, 3, "user", "again"), (50, 3, "user", "again"), (50, None, "assistant", "first")]
    given = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, path string").repartition(3)
    pieces = chat.format_trees(chat.linear(given))
    got = {r.tree: tuple(r)[2:] for r in chat.read_back(pieces).collect()}
    size = {r.tree: r.n for r in pieces.groupBy("tree").agg(F.sum(F.char_length("piece")).alias("n")).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv, values in got.items():
        turns = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv))
        loss = "".join(text for *_, role, text in turns if role == "assistant")
        digest = hashlib.sha256("".join(f"{role}\n{text}\n" for *_, role, text in turns).encode()).hexdigest()
        assert values == (len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), size[conv])


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_trees(chat.linear(none))).count() == 0
