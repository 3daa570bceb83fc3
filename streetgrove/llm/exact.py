"""Exact duplicates by Patricia-trie owners.

Two texts are equal when they are the same bytes after lower-casing A-Z; a null text is empty, and empty texts are
equal to each other. Rows that repeat a doc_id with the same text count and get the same answer. A null doc_id is
the smallest. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
import shutil
import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetgrove.llm.common import slices, small_batches
from streetgrove.session import cut

#: Bytes of edges that one trie keeps in memory.
TRIE_BYTES = 48 << 20
#: Bytes of text whose copies are combined before the shuffle.
LOCAL_BYTES = 16 << 20


class Owner:
    """What a terminal node knows of its string: the identifier that stays, copies, and who brought them."""

    __slots__ = ("best", "copies", "members")

    def __init__(self) -> None:
        self.best: int | None = None
        self.copies = 0
        self.members: list[int | None] = []

    def add(self, best: int | None, copies: int, members: Iterable[int | None], largest: bool) -> None:
        if best is not None and (self.best is None or (best > self.best if largest else best < self.best)):
            self.best = best
        self.copies += copies
        self.members.extend(members)


class Node:
    __slots__ = ("edges", "label", "owner", "spilled")

    def __init__(self, label: bytes) -> None:
        self.label = label
        self.edges: dict[int, Node] = {}
        self.owner: Owner | None = None
        self.spilled = None


def shared(a: bytes, at: int, label: bytes) -> int:
    """Length of the prefix that ``a[at:]`` and ``label`` have in common."""
    low, high = 0, min(len(a) - at, len(label))
    while low < high:
        mid = (low + high + 1) // 2
        if a[at + low : at + mid] == label[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Patricia:
    """A radix trie of byte strings with compressed edges; beyond ``limit`` bytes whole subtrees go to files.

    Strings under a spilled subtree are appended to its file and put into a trie of their own at the end, which may
    spill again one branch further down. The files have no name and vanish when they are closed.
    """

    def __init__(self, limit: int = TRIE_BYTES, largest: bool = True) -> None:
        self.limit, self.largest = limit, largest
        self.root, self.held = Node(b""), 0

    def insert(self, key: bytes, best: int | None, copies: int = 1, members: Iterable[int | None] = ()) -> None:
        node, at = self.root, 0
        while True:
            if node.spilled is not None:
                pickle.dump((key, best, copies, list(members)), node.spilled)
                return
            if at == len(key):
                break
            child = node.edges.get(key[at])
            if child is None:
                child = node.edges[key[at]] = Node(key[at:])
                self.held += len(child.label)
                node = child
                break
            if key.startswith(child.label, at):
                at += len(child.label)
                node = child
                continue
            n = shared(key, at, child.label)
            middle = Node(child.label[:n])
            child.label = child.label[n:]
            middle.edges[child.label[0]] = child
            node.edges[key[at]] = middle
            node, at = middle, at + n
        if node.owner is None:
            node.owner = Owner()
        node.owner.add(best, copies, members, self.largest)
        while self.held > self.limit and self._spill():
            pass

    def _strings(self, top: Node, prefix: bytes) -> Iterator[tuple]:
        """(string, owner, file) of every node under ``top`` that has an owner or was spilled."""
        stack = [(top, prefix)]
        while stack:
            node, key = stack.pop()
            if node.owner is not None or node.spilled is not None:
                yield key, node.owner, node.spilled
            stack += [(x, key + x.label) for x in node.edges.values()]

    def _spill(self) -> bool:
        """Moves the heaviest branch below the first fork to a file; False if nothing can be moved."""
        node, prefix = self.root, b""
        while len(node.edges) == 1:
            (node,) = node.edges.values()
            prefix += node.label

        def weight(top: Node) -> int:
            total, stack = 0, [top]
            while stack:
                x = stack.pop()
                total += len(x.label)
                stack += x.edges.values()
            return total

        branches = [(weight(x), x) for x in node.edges.values() if x.spilled is None]
        if not branches:
            return False
        size, branch = max(branches, key=lambda x: x[0])
        file = tempfile.TemporaryFile()  # noqa: SIM115
        for key, owner, older in self._strings(branch, prefix + branch.label):
            if owner is not None:
                pickle.dump((key, owner.best, owner.copies, owner.members), file)
            if older is not None:
                older.seek(0)
                shutil.copyfileobj(older, file)
                older.close()
        # The branch is cut at its first byte: any string that begins with it goes to the file.
        stub = Node(branch.label[:1])
        stub.spilled = file
        node.edges[branch.label[0]] = stub
        self.held -= size - 1
        return True

    def items(self) -> Iterator[tuple[bytes, Owner]]:
        """Every string once with its owner. The trie is used up."""
        files = []
        for key, owner, file in self._strings(self.root, b""):
            if file is not None:
                files.append(file)
            else:
                yield key, owner
        self.root = Node(b"")
        for file in files:
            own = Patricia(self.limit, self.largest)
            file.seek(0)
            while True:
                try:
                    own.insert(*pickle.load(file))
                except EOFError:
                    break
            file.close()
            yield from own.items()


LOCAL = "doc_id long, owner long, copies long, length long, content_hash long, text_sha256 string, content binary"


def combine_locally(docs: DataFrame, *, largest: bool, id_col: str, text_col: str) -> DataFrame:
    """Every row with its owner among the rows of the same slice; only one row of equal ones carries the bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "content", LOCAL_BYTES):
            trie = Patricia(1 << 62, largest)
            ids, keys = batch.column("doc_id").to_pylist(), [(x or b"").lower() for x in batch.column("content").to_pylist()]
            for row, (i, key) in enumerate(zip(ids, keys, strict=True)):
                trie.insert(key, i, 1, (row,))
            out: list[list] = [[None] * len(ids) for _ in range(6)]
            for key, owner in trie.items():
                digest, hashed = hashlib.sha256(key).hexdigest(), xxhash.xxh64_intdigest(key) - (1 << 63)
                for k, row in enumerate(owner.members):
                    values = (owner.best, 0 if k else owner.copies, len(key), hashed, digest, None if k else key)
                    for column, value in zip(out, values, strict=True):
                        column[row] = value
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            arrays = [batch.column("doc_id"), *(pa.array(x, kind) for x, kind in zip(out, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "owner", "copies", "length", "content_hash", "text_sha256", "content"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("content"))
    return rows.mapInArrow(run, LOCAL)


def owners(local: DataFrame, *, largest: bool, trie_bytes: int) -> DataFrame:
    """(owner, text_sha256, keep_id, group_size) from one full byte string for each slice and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Patricia(trie_bytes, largest)
        for batch in slices(batches, "content", LOCAL_BYTES):
            for key, owner, copies in zip(*(batch.column(c).to_pylist() for c in ("content", "owner", "copies")), strict=True):
                trie.insert(key, owner, copies, (owner,))
        rows: list[tuple] = []

        def emit() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["owner", "text_sha256", "keep_id", "group_size"])

        for key, owner in trie.items():
            digest = hashlib.sha256(key).hexdigest()
            for member in dict.fromkeys(owner.members):
                rows.append((member, digest, owner.best, owner.copies))
                if len(rows) >= 10_000:
                    yield emit()
                    rows.clear()
        if rows:
            yield emit()

    dealt = local.where("copies > 0").select("owner", "copies", "length", "content_hash", "content").repartition("length", "content_hash")
    return dealt.select("owner", "copies", "content").mapInArrow(run, "owner long, text_sha256 string, keep_id long, group_size long")


def exact_duplicates(
    docs: DataFrame, *, largest: bool = True, trie_bytes: int = TRIE_BYTES, id_col: str = "doc_id", text_col: str = "text",
    checkpoint: Callable[[DataFrame, str], DataFrame] = cut,
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): which row of each group of equal texts stays.

    Copies within a slice of a task are combined first, so that a text with any number of copies sends one string a
    slice. Those strings are dealt by length and content hash; each task puts them whole into its trie, whose
    terminal nodes keep the identifier that stays. The answer goes back by the owner in the slice, a key with no
    more rows than a slice has, so no join is skewed.
    """
    local = checkpoint(combine_locally(docs, largest=largest, id_col=id_col, text_col=text_col), "exact")
    found = owners(local, largest=largest, trie_bytes=trie_bytes)
    l, r = local.select("doc_id", "owner", "text_sha256").alias("l"), found.alias("r")
    same = F.col("l.owner").eqNullSafe(F.col("r.owner")) & (F.col("l.text_sha256") == F.col("r.text_sha256"))
    return l.join(r, same).select(
        "l.doc_id", "r.keep_id", "r.group_size", F.col("l.doc_id").eqNullSafe(F.col("r.keep_id")).alias("kept"), "l.text_sha256"
    )
