"""Byte-level BPE without a tokenizer library: token counts by whole-token shortcut, encoding by pair occurrence index.

The vocabulary file stays where it is; its path is a parameter. Every executor reads it once per worker process.
Texts are cut at the added special strings of the file, which are one token each, and then into pre-tokens by the
file's own pattern. A null text is empty; an empty text has no tokens. Repeated rows get equal answers.

Pre-tokens are cut by the Unicode tables of the ``regex`` module. Code points assigned after the tables that the
tokenizers library carries (letters and digits of the newest Unicode version) may be cut differently.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from streetgrove.llm.common import slices, texts

#: Fixed value: the pre-token pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Counts of distinct stretches remembered by a worker before it forgets all of them.
MEMORY = 400_000
#: Distinct pre-tokens whose ids and bytes are remembered.
ENCODED = 250_000
#: Code points of the longest stretch that is remembered.
LONGEST = 48
#: Before it every letter of Unicode is old enough for all tables to agree on it.
LATIN_END = "\u0250"
MARKS = frozenset(".,;:!?)\"'-")
#: UTF-8 bytes of text whose pre-tokens are merged together.
CHUNK = 6 << 20
#: The same where texts are only counted: their words stay in Arrow.
COUNTED_CHUNK = 10 << 20


def byte_chars() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """What the file says: ids of the bytes, merges with rank and result, bytes of every token, special strings."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, chars = spec["model"]["vocab"], byte_chars()
        back = {c: b for b, c in enumerate(chars)}
        self.byte_id = np.array([vocab[c] for c in chars], dtype=np.int32)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = [b""] * (max(*vocab.values(), *self.special.values()) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.left, self.right, self.made = (
            np.array([vocab[x] for x in xs], dtype=np.int32)
            for xs in ((a for a, _ in pairs), (b for _, b in pairs), (a + b for a, b in pairs))
        )
        self.merges = {(int(a), int(b)): (rank, int(c)) for rank, (a, b, c) in enumerate(zip(self.left, self.right, self.made, strict=True))}
        keys = self.left.astype(np.int64) << 32 | self.right
        self.order = np.argsort(keys).astype(np.int32)
        self.keys = keys[self.order]
        self.pieces = regex.compile(PATTERN)
        self.cuts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def pre_tokens(self, text: str) -> list[str]:
        """The pre-tokens in order; a special string is one of them."""
        if self.cuts is None or not any(s in text for s in self.special):
            return self.pieces.findall(text)
        found: list[str] = []
        for k, part in enumerate(self.cuts.split(text)):
            found += [part] if k % 2 else self.pieces.findall(part)
        return found

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where none merges it."""
        keys = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.order[at], -1)

    def count(self, piece: bytes) -> int:
        """Tokens of one pre-token, by merging its lowest pair again and again."""
        ids, merges = [int(self.byte_id[b]) for b in piece], self.merges
        while len(ids) > 1:
            best = min((merges[p] for p in zip(ids, ids[1:], strict=False) if p in merges), default=None)
            if best is None:
                break
            a, b, made = int(self.left[best[0]]), int(self.right[best[0]]), best[1]
            out, i = [], 0
            while i < len(ids):
                if ids[i] == a and i + 1 < len(ids) and ids[i + 1] == b:
                    out.append(made)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return len(ids)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=2)
def whole_tokens(path: str) -> frozenset[str]:
    """The shortcut, proved before any text is read: vocabulary strings that the merges turn into one token.

    Only strings that are valid UTF-8 can equal a pre-token. A special string is one token by definition.
    """
    v = vocabulary(path)
    valid = []
    for piece in v.bytes_of:
        try:
            valid.append(piece.decode())
        except UnicodeDecodeError:
            continue
    counts = merged_counts(v, [text.encode() for text in valid])
    proved = set(v.special) | {text for text, n in zip(valid, counts, strict=True) if n == 1}
    return frozenset(proved)


class Stretches:
    """Token counts of texts by stretches, most of which come again and again.

    A space before a non-space always begins a pre-token, so a text divides there into stretches whose tokens do not depend
    on each other: mostly a space and a word. Counts of stretches are remembered, up to ``MEMORY`` of them, then those that
    the texts at hand do not repeat are forgotten. Only stretches not met before are cut into pre-tokens; of these the proved whole tokens count one each, and
    the rest, of all texts given together, is merged in one call.
    """

    def __init__(self, path: str) -> None:
        self.v = vocabulary(path)
        self.spaced: dict[str, int] = {}
        self.pieces: dict[str, int] = dict.fromkeys(whole_tokens(path), 1)
        self.whole = len(self.pieces)
        self.blank = pa.array(["", *sorted(blanks())], pa.large_string())

    def learn(self, stretches: list[str], plain: list[str]) -> tuple[list[int], list[int]]:
        """Counts of ``stretches`` as they stand in the text, and of ``plain``, a space and letters each; all merged in one call."""
        if len(self.pieces) > self.whole + MEMORY // 2:
            self.pieces = dict(list(self.pieces.items())[: self.whole])
        known = self.pieces
        cut = [self.v.pieces.findall(s) for s in stretches]
        rest = [s for s in plain if s not in known]
        new = list(set().union(*cut).difference(known, rest))
        counted = merged_counts(self.v, [s.encode() for s in (*rest, *new)])
        found = dict(zip(rest, counted, strict=False))
        known.update(zip(new, counted[len(rest) :], strict=True))
        totals = [sum([known[p] if p in known else found[p] for p in pieces]) for pieces in cut]
        return totals, [found[s] if s in found else known[s] for s in plain]

    def divide(self, parts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(distinct stretches, the stretch at every place, where each part begins): words between spaces, put together where a space is not before a non-space."""
        split = pc.split_pattern(parts, " ")
        begins, words = split.offsets.to_numpy()[:-1].astype(np.int64), split.flatten().dictionary_encode()
        known, at = words.dictionary.to_pylist(), words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        odd = pc.is_in(pc.utf8_slice_codeunits(words.dictionary, 0, 1), self.blank).to_numpy(zero_copy_only=False)[at]
        odd[begins] = False
        if odd.any():
            own = np.flatnonzero(~odd)
            size = np.diff(own, append=len(at))
            place = dict[str, int]()
            at_own = at[own]
            several = np.flatnonzero(size > 1)
            upto = np.cumsum(size[several])
            of_word = np.arange(upto[-1] if len(upto) else 0) + np.repeat(own[several] - upto + size[several], size[several])
            spelt, start, new = [known[c] for c in at[of_word].tolist()], 0, []
            for stop in upto.tolist():
                new.append(place.setdefault(" ".join(spelt[start:stop]), len(known) + len(place)))
                start = stop
            at_own[several] = new
            begins, at, known = np.searchsorted(own, begins), at_own, known + list(place)
        return known, at, begins

    def counts(self, texts: pa.Array | list[str]) -> list[int]:
        """Tokens of every text; a special string is one. Words are split and numbered by Arrow, so only distinct ones become objects."""
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        found, owner, parts = np.zeros(len(texts), np.int64), np.arange(len(texts)), texts
        special = np.zeros(len(texts), bool)
        for s in self.v.special:
            special |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        if special.any():
            cut = [(k, self.v.cuts.split(texts[k].as_py())) for k in np.flatnonzero(special).tolist()]
            for k, pieces in cut:
                found[k] = len(pieces) // 2
            owner = np.concatenate((np.flatnonzero(~special), np.repeat([k for k, _ in cut], [len(pieces) // 2 + 1 for _, pieces in cut])))
            parts = pa.concat_arrays([texts.filter(pa.array(~special)), pa.array([p for _, pieces in cut for p in pieces[::2]], pa.large_string())])
        if not len(parts):
            return found.tolist()
        known, at, begins = self.divide(parts)
        head = np.zeros(len(at), bool)
        head[begins] = True
        tail, first = at[~head], np.unique(at[head])
        codes = np.flatnonzero(np.bincount(tail, minlength=len(known)))
        words = [known[c] for c in codes.tolist()]
        if len(self.spaced) > MEMORY:
            self.spaced = {w: self.spaced[w] for w in words if w in self.spaced}
        new = set(words).difference(self.spaced)
        # A word of long known letters is one pre-token; an ASCII mark after it is another, and one token as every single byte is.
        letters = {w for w in new if w.isalpha() and (w.isascii() or max(w) < LATIN_END)}
        marked = {w: w[:-1] for w in new - letters if w[-1] in MARKS and w[:-1].isalpha() and (w.isascii() or max(w) < LATIN_END)}
        letters |= set(marked.values()) - self.spaced.keys()
        heads, plain = [known[c] for c in first.tolist()], list(letters)
        other = list(new - letters - marked.keys())
        mixed, alone = self.learn(heads + [" " + w for w in other], [" " + w for w in plain])
        self.spaced.update(zip(plain, alone, strict=True))
        self.spaced.update(zip(other, mixed[len(heads) :], strict=True))
        self.spaced.update((w, self.spaced[core] + 1) for w, core in marked.items())
        tokens, of = np.zeros(len(at), np.int64), np.zeros(len(known), np.int64)
        of[codes] = np.fromiter(map(self.spaced.__getitem__, words), np.int64, len(words))
        tokens[~head] = of[tail]
        of[first] = mixed[: len(heads)]
        tokens[head] = of[at[head]]
        np.add.at(found, owner, np.add.reduceat(tokens, begins))
        for word in [w for w in new | letters if len(w) > LONGEST]:
            del self.spaced[word]
        return found.tolist()


@lru_cache(maxsize=1)
def stretches(path: str) -> Stretches:
    """What a worker remembers from task to task."""
    return Stretches(path)


@lru_cache(maxsize=1)
def blanks() -> frozenset[str]:
    """Code points that the pattern takes for white space."""
    return frozenset(regex.findall(r"\s", "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))))


def gathered(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Slices of about ``max_bytes`` of ``column``, small batches put together."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in slices(batches, column, max_bytes):
        n = pa.compute.sum(pa.compute.binary_length(batch.column(column))).as_py() or 0
        if held and size + n > max_bytes:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        if batch.num_rows:
            held.append(batch)
            size += n
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def token_counts(docs: DataFrame, vocab_path: str, *, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit): tokens of each whole text.

    Pre-tokens in the proved set count one each without any merging; only the rest is merged. No shuffle; a task
    holds one chunk of texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = stretches(vocab_path)
        for batch in gathered(batches, "text", COUNTED_CHUNK):
            n_bytes = pa.compute.cast(pa.compute.binary_length(batch.column("text")), pa.int64())
            tokens = pa.array(memory.counts(batch.column("text")), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), n_bytes, tokens, pa.compute.greater(tokens, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def merge_all(v: Vocabulary, pieces: list[bytes]) -> list[np.ndarray]:
    """Token ids of every piece, all pieces merged together."""
    ids, upto = merged(v, pieces)
    return np.split(ids, upto[:-1]) if len(pieces) else []


def merged_counts(v: Vocabulary, pieces: list[bytes]) -> list[int]:
    """Tokens of every piece."""
    return np.diff(merged(v, pieces)[1], prepend=0).tolist()


def merged(v: Vocabulary, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all pieces one after another, and where each piece ends.

    Every pair of neighbours is indexed to the list of all its positions. Active ranks are taken in ascending order;
    one rank is applied at all its positions at once, and only the neighbours of a merged place enter new lists. A
    merge makes a token that occurs in higher ranks only, so a rank comes up once. Places that an earlier rank
    changed are dropped when their list is taken.
    """
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(pieces) else 0
    if total == 0:
        return np.zeros(0, np.int32), ends
    symbols = v.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
    nxt = np.arange(1, total + 1, dtype=np.int64)
    prv = np.arange(-1, total - 1, dtype=np.int64)
    starts = (ends - sizes)[sizes > 0]
    prv[starts] = -1
    nxt[ends[sizes > 0] - 1] = -1

    lists: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def index(at: np.ndarray) -> None:
        """Enters the pairs that begin at ``at``."""
        ranks = v.rank(symbols[at], symbols[nxt[at]])
        keep = ranks >= 0
        at, ranks = at[keep], ranks[keep]
        if not len(at):
            return
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        edge = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        for rank, places in zip(ranks[np.concatenate(([0], edge))].tolist(), np.split(at, edge) if len(edge) else [at], strict=True):
            if rank in lists:
                lists[rank].append(places)
            else:
                lists[rank] = [places]
                heapq.heappush(active, rank)

    index(np.flatnonzero(nxt >= 0))
    while active:
        rank = heapq.heappop(active)
        found = lists.pop(rank)
        at = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
        a, b, made = v.left[rank], v.right[rank], v.made[rank]
        after = nxt[at]
        fits = (symbols[at] == a) & (after >= 0)
        fits &= symbols[after] == b
        at = at[fits]
        if a == b and len(at) > 1:
            # In a run of equal symbols the pairs overlap; from the left, every second one is taken.
            at.sort()
            first = np.concatenate(([True], nxt[at[:-1]] != at[1:]))
            begin = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - begin) % 2 == 0]
        if not len(at):
            continue
        gone = nxt[at]
        beyond = nxt[gone]
        symbols[at], symbols[gone] = made, -1
        nxt[at] = beyond
        prv[beyond[beyond >= 0]] = at[beyond >= 0]
        before = prv[at]
        fresh = np.concatenate((before[before >= 0], at[beyond >= 0]))
        if len(fresh):
            fresh.sort()
            index(fresh[np.append(True, fresh[1:] != fresh[:-1])])
    alive = symbols >= 0
    return symbols[alive], np.concatenate(([0], np.cumsum(alive)))[ends]


def lengths(docs: DataFrame, vocab_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens) of each whole text, one row a row; a chunk's new pre-tokens are merged together. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = stretches(vocab_path)
        for batch in gathered(batches, "text", COUNTED_CHUNK):
            n_tokens = pa.array(memory.counts(batch.column("text")), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n_tokens], ["doc_id", "n_tokens"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long")


def encode_decode(docs: DataFrame, vocab_path: str, *, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids array<int>]) of each whole text.

    The ids are decoded again from the tokens' bytes; what is no UTF-8 becomes the replacement character. A worker
    merges the new pre-tokens of one chunk together and remembers a bounded number of them. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(vocab_path)
        known: dict[str, tuple[int, str, bytes]] = {}
        for batch in slices(batches, "text", CHUNK):
            cut = [v.pre_tokens(text) for text in batch.column("text").to_pylist()]
            if len(known) > ENCODED:
                known.clear()
            for special, i in v.special.items():
                known[special] = (1, str(i), v.bytes_of[i])
            new = list({p for pieces in cut for p in pieces if p not in known})
            for piece, ids in zip(new, merge_all(v, [p.encode() for p in new]), strict=True):
                own = ids.tolist()
                known[piece] = (len(own), ",".join(map(str, own)), b"".join([v.bytes_of[i] for i in own]))
            counts, id_digests, text_digests, id_lists = [], [], [], []
            for pieces in cut:
                entries = [known[p] for p in pieces]
                joined = ",".join([e[1] for e in entries])
                counts.append(sum([e[0] for e in entries]))
                id_digests.append(hashlib.sha256(joined.encode()).hexdigest())
                decoded = b"".join([e[2] for e in entries]).decode("utf-8", "replace")
                text_digests.append(hashlib.sha256(decoded.encode()).hexdigest())
                if with_ids:
                    id_lists.append([int(x) for x in joined.split(",")] if joined else [])
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(id_digests, pa.string()), pa.array(text_digests, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(id_lists, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return texts(docs, id_col, text_col).mapInArrow(run, schema)
