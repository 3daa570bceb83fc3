"""Reply trees to formatted conversations.

Messages point to the message they answer. Iterative self-joins double the known stretch of each path until every
message knows its root; branches are ranked by the scores on their path, and each chosen root-to-leaf path is written
as one conversation. A conversation is a row for each turn, so that one of any length is never gathered in a group.

The template writes ``### role: text</turn>`` and a line break. In texts and roles the escape character, ``###`` and
``</turn>`` get a backslash before them, in roles a colon too, so that reading back gives the very text.

A null role or text is empty. A parent that is null, missing or not smaller than the message's own id makes a root,
which leaves no cycles. Of rows that repeat an id within a tree, the first by (parent, role, text) counts. A null
tree is a tree of its own. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streetgrove.llm.common import slices
from streetgrove.session import cut

#: Fixed values of the template.
HEAD, COLON, END = "### ", ": ", "</turn>\n"
LEARNED = "assistant"
CHUNK = 4 << 20


def escaped(text: Column, also: str = "") -> Column:
    return F.regexp_replace(text, rf"(\\|###|</turn>{also})", r"\\$1")


def unescape(text: str) -> str:
    return re.sub(r"\\(\\|###|</turn>|:)", r"\1", text)


TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\]|\\.)*)</turn>\n", re.DOTALL)


def read_turn(piece: str) -> tuple[str, str, int, int]:
    """(role, text, start, end) of a written turn; start and end bound the escaped text."""
    found = TURN.fullmatch(piece)
    if found is None:
        raise ValueError("no turn of this template")
    return unescape(found[1]), unescape(found[2]), found.start(2), found.end(2)


def messages(rows: DataFrame, *, tree: str, message: str, parent: str, role: str, text: str, score: str | None = None) -> DataFrame:
    """(tree, tree_key, id, parent, role, text, score) with one row an id; ``tree_key`` is never null."""
    key = F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit("null"))
    points = F.coalesce(F.col(score).cast("double"), F.lit(0.0)) if score else F.lit(0.0)
    own = rows.select(
        F.col(tree).alias("tree"), key.alias("tree_key"), F.col(message).cast("long").alias("id"), F.col(parent).cast("long").alias("parent"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"), points.alias("score"),
    ).where("id is not null")
    first = F.min(F.struct("parent", "role", "text", "score", "tree")).alias("m")
    return own.groupBy("tree_key", "id").agg(first).select("m.tree", "tree_key", "id", "m.parent", "m.role", "m.text", "m.score")


def chosen_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """(tree_key, path, id, depth): the messages of the ``branches`` best paths of each tree; a path is named by its leaf.

    ``nodes`` has (tree_key, id, parent, score). Paths are ranked by their mean score, then by the smaller leaf. Round
    k joins each message with the one 2**k above it, so rounds grow with the logarithm of the depth, and a message
    leaves the rounds when its root is known.
    """
    ids = nodes.select("tree_key", F.col("id").alias("up"))
    parents = nodes.where("parent < id").select("tree_key", "id", F.col("parent").alias("up")).join(ids, ["tree_key", "up"])
    jumps = [cut(parents.select("tree_key", "id", "up"), "reply-jumps")]
    roots = nodes.select("tree_key", "id", "score").join(jumps[0], ["tree_key", "id"], "left")
    state = cut(roots.select("tree_key", "id", "up", F.lit(1).cast("long").alias("depth"), F.col("score").alias("total")), "reply-state")
    done = [state.where("up is null")]
    state = state.where("up is not null")
    while not jumps[-1].isEmpty():
        # (depth, total) of a stretch is added to that of the stretch which begins at its upper end.
        everyone = done[0]
        for part in done[1:]:
            everyone = everyone.unionByName(part)
        above = everyone.unionByName(state).select("tree_key", F.col("id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("total").alias("plus"))
        stepped = cut(
            state.join(above, ["tree_key", "up"]).select("tree_key", "id", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("total") + F.col("plus")).alias("total")),
            "reply-state",
        )
        done.append(stepped.where("up is null"))
        state = stepped.where("up is not null")
        jumps.append(state.select("tree_key", "id", "up"))
    known = done[0]
    for part in done[1:]:
        known = known.unionByName(part)
    leaves = known.join(jumps[0].select("tree_key", F.col("up").alias("id")).distinct(), ["tree_key", "id"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("tree_key").orderBy(F.desc(F.col("total") / F.col("depth")), "id"))
    paths = leaves.withColumn("rank", rank).where(F.col("rank") <= branches).select("tree_key", F.col("id").alias("path"), "id", "depth")
    # Every distance from the leaf is a sum of powers of two, taken from the largest down; so each message comes once.
    paths = cut(paths, "reply-paths")
    for k in reversed(range(len(jumps) - 1)):
        higher = paths.join(jumps[k], ["tree_key", "id"]).select("tree_key", "path", F.col("up").alias("id"), (F.col("depth") - (1 << k)).alias("depth"))
        paths = cut(paths.unionByName(higher), "reply-paths")
    return paths


def formatted(own: DataFrame, paths: DataFrame) -> DataFrame:
    """(tree, tree_key, path, depth, role, piece, loss_start, loss_end): one row a turn of each path.

    The pieces of a path in order of depth are the conversation. The loss covers the code points from ``loss_start``
    up to ``loss_end`` of a piece that the model learns, nulls elsewhere.
    """
    turns = paths.join(own, ["tree_key", "id"])
    head = F.concat(F.lit(HEAD), escaped(F.col("role"), "|:"), F.lit(COLON))
    body = escaped(F.col("text"))
    written = turns.select("tree", "tree_key", "path", "depth", "role", head.alias("head"), body.alias("body"))
    learned = F.col("role") == LEARNED
    return written.select(
        "tree", "tree_key", "path", "depth", "role", F.concat("head", "body", F.lit(END)).alias("piece"),
        F.when(learned, F.char_length("head")).alias("loss_start"), F.when(learned, F.char_length("head") + F.char_length("body")).alias("loss_end"),
    )


def joined(pieces: DataFrame) -> DataFrame:
    """(tree, path, conversation): whole conversations, for those that fit into a cell."""
    rows = F.array_sort(F.collect_list(F.struct("depth", "piece")))
    return pieces.groupBy("tree_key", "path").agg(F.first("tree").alias("tree"), F.array_join(F.transform(rows, lambda x: x["piece"]), "").alias("conversation")).drop("tree_key")


def read_back(pieces: DataFrame) -> DataFrame:
    """(tree, path, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of each conversation, read from its pieces.

    Rows come sorted by conversation and depth; a task reads them one after the other and keeps two running digests,
    whatever the length of the conversation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["tree", "path", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        now = None
        out: list[tuple] = []
        kind = None

        def close() -> None:
            if now is not None:
                _, tree, path, n, turns, chars, loss, size = now
                out.append((tree, path, n, turns.hexdigest(), chars, loss.hexdigest(), size))

        def batch_of() -> pa.RecordBatch:
            kinds = [kind, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

        for batch in slices(batches, "piece", CHUNK):
            kind = batch.schema.field("tree").type
            columns = (batch.column(c).to_pylist() for c in ("tree_key", "path", "tree", "piece", "loss_start", "loss_end"))
            for key, path, tree, piece, start, end in zip(*columns, strict=True):
                if now is None or now[0] != (key, path):
                    close()
                    now = [(key, path), tree, path, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text, *_ = read_turn(piece)
                now[3] += 1
                now[4].update(f"{role}\n{text}\n".encode())
                now[7] += len(piece)
                if start is not None:
                    learned = unescape(piece[start:end])
                    now[5] += len(learned)
                    now[6].update(learned.encode())
            if out:
                yield batch_of()
                out.clear()
        close()
        if out:
            yield batch_of()

    kind = pieces.schema["tree"].dataType.simpleString()
    ordered = pieces.repartition("tree_key", "path").sortWithinPartitions("tree_key", "path", "depth")
    return ordered.select("tree_key", "path", "tree", "piece", "loss_start", "loss_end").mapInArrow(
        run, f"tree {kind}, path long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def linear(rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Messages of conversations without branches: each turn answers the one before it.

    Turns are numbered in the order of (turn, role, text), so rows that repeat a turn are turns of their own.
    """
    own = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    number = F.row_number().over(Window.partitionBy("conv").orderBy("turn", "role", "text")).cast("long")
    numbered = own.withColumn("id", number).withColumn("parent", F.when(F.col("id") > 1, F.col("id") - 1))
    key = F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit("null"))
    return numbered.select(F.col("conv").alias("tree"), key.alias("tree_key"), "id", "parent", "role", "text", F.lit(0.0).alias("score"))


def format_trees(own: DataFrame, branches: int = 1) -> DataFrame:
    """The pieces of the chosen paths of ``messages(...)`` or ``linear(...)``."""
    own = cut(own, "reply-messages")
    return formatted(own, chosen_paths(own.select("tree_key", "id", "parent", "score"), branches))


CHECKING_SQL = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7::bigint, 0::bigint, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e as (select *, regexp_replace(text, '(\\|###|</turn>)', 'x\1', 'g') as t, regexp_replace(role, '(\\|###|</turn>|:)', 'x\1', 'g') as r from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length(r) + length(t) + 14)::bigint as formatted_chars
from e group by conv_id"""
