"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding by retained offsets.

Text is cut without a regular expression. Every code point gets one of eight classes (letter, number, other, three
kinds of white space, two kinds of apostrophe), and a finite automaton over these classes says where a piece begins.
Its transition functions compose associatively, so the states of a long array are found by a scan: compose the functions of
each block of characters, scan the blocks' functions, then run each block from its true first state. All blocks
advance together as numpy arrays.

Pieces are hashed, and only pieces that the worker has not met are merged, all of them at once: each step merges the
lowest-ranked pair of every piece. Known pieces are kept in sorted arrays of bounded size. Pieces are told apart by
64-bit hashes: in a task with a million different pieces, the chance that two are confused is about 3e-8.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashgrove.llm import vec

LETTER, NUMBER, OTHER, WHITE, BLANK, LAST_WHITE, SHORT, LONG = range(8)
FREE, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_WHITE, AFTER_BLANK, ONE_MORE, TWO_MORE = range(8)
BLOCK = 128
KNOWN = 1 << 19
NARROW = 48
NONE = np.int32(2**31 - 1)

#: White_Space of the Unicode standard; fixed values.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a piece begins, by (class + 8 if a text's first character, state)."""
    following = np.zeros((16, 8), np.uint8)
    begins = np.ones((16, 8), bool)
    for state in range(8):
        following[LETTER, state] = {ONE_MORE: FREE, TWO_MORE: ONE_MORE}.get(state, IN_LETTERS)
        begins[LETTER, state] = state not in (IN_LETTERS, AFTER_BLANK, ONE_MORE, TWO_MORE)
        following[NUMBER, state] = IN_NUMBERS
        begins[NUMBER, state] = state not in (IN_NUMBERS, AFTER_BLANK)
        following[OTHER, state] = IN_OTHER
        begins[OTHER, state] = state not in (IN_OTHER, AFTER_BLANK)
        following[WHITE, state] = IN_WHITE
        begins[WHITE, state] = state != IN_WHITE
        following[BLANK, state] = AFTER_BLANK
        following[LAST_WHITE, state] = FREE
        for kind, then in ((SHORT, ONE_MORE), (LONG, TWO_MORE)):
            following[kind, state] = IN_OTHER if state in (IN_OTHER, AFTER_BLANK) else then
            begins[kind, state] = state not in (IN_OTHER, AFTER_BLANK)
    following[8:] = following[:8, :1]
    begins[8:] = True
    return following, begins


FOLLOWING, BEGINS = _automaton()
_kinds: np.ndarray | None = None


def kinds() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    global _kinds
    if _kinds is None:
        first = {"L": LETTER, "N": NUMBER}
        _kinds = np.fromiter((first.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
        _kinds[WHITE_SPACE] = WHITE
    return _kinds


def classes(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Automaton classes of code points; what follows a character is looked up here, so that the automaton needs none."""
    n = len(points)
    kind = kinds()[points]
    ends = np.zeros(n + 1, bool)
    ends[offsets] = True
    white = kind == WHITE
    solid_next = np.zeros(n, bool)
    solid_next[:-1] = ~white[1:]
    solid_next &= ~ends[1:]
    kind[white & solid_next] = LAST_WHITE
    kind[white & solid_next & (points == 0x20)] = BLANK
    quotes = np.flatnonzero(points == 0x27)
    if len(quotes):
        padded = np.append(points, [0, 0])
        one, two = padded[quotes + 1], padded[quotes + 2]
        inside = ~ends[quotes + 1]
        wide = inside & ~ends[np.minimum(quotes + 2, n)]
        kind[quotes[inside & np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
        pair = np.zeros(len(quotes), bool)
        for text in ("re", "ve", "ll"):
            pair |= (one == ord(text[0])) & (two == ord(text[1]))
        kind[quotes[wide & pair]] = LONG
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    kind[first] += 8
    return kind


def starts_of_pieces(kind: np.ndarray) -> np.ndarray:
    """Positions where pieces begin: a scan over the associative composition of transition functions."""
    n = len(kind)
    blocks = -(-n // BLOCK)
    if not blocks:
        return np.empty(0, np.int64)
    grid = np.full(blocks * BLOCK, OTHER, np.uint8)
    grid[:n] = kind
    grid = np.ascontiguousarray(grid.reshape(blocks, BLOCK).T)
    table = FOLLOWING.ravel()
    # compose: state of each block after its last character, for each of the eight states before it
    reach = np.broadcast_to(np.arange(8, dtype=np.uint8), (blocks, 8))
    for column in grid:
        reach = table[(column.astype(np.uint16) << 3)[:, None] + reach]
    # exclusive scan of the blocks' functions by doubling
    prefix, step = reach, 1
    while step < blocks:
        prefix = np.concatenate([prefix[:step], np.take_along_axis(prefix[step:], prefix[:-step], 1)])
        step *= 2
    state = np.zeros(blocks, np.uint8)
    state[1:] = prefix[:-1, FREE]
    begins = np.empty((BLOCK, blocks), bool)
    flags = BEGINS.ravel()
    for i, column in enumerate(grid):
        at = (column.astype(np.uint16) << 3) + state
        begins[i] = flags[at]
        state = table[at]
    return np.flatnonzero(begins.T.ravel()[:n])


class Merger:
    """Merges of a rank file. Worker-side; build once per task."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        tokens = sorted(self.ranks.items(), key=lambda item: item[1])
        self.size = tokens[-1][1] + 1
        lengths = np.zeros(self.size, np.int64)
        lengths[[rank for _, rank in tokens]] = [len(token) for token, _ in tokens]
        self.token_lengths = lengths
        self.token_starts = np.cumsum(lengths) - lengths
        self.token_bytes = np.frombuffer(b"".join(token for token, _ in tokens), np.uint8)
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        keys, merged = [], []
        for token, rank in tokens:
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    merged.append(rank)
        # open addressing, at most a quarter full
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        keys, merged = np.array(keys, np.uint64), np.array(merged, np.int32)
        self.slots = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.values = np.full(1 << self.bits, NONE)
        left, at = np.arange(len(keys)), self._place(keys)
        while len(left):
            free = self.slots[at] == np.uint64(2**64 - 1)
            took, chosen = np.unique(at[free], return_index=True)
            chosen = np.flatnonzero(free)[chosen]
            self.slots[took], self.values[took] = keys[left[chosen]], merged[left[chosen]]
            rest = np.ones(len(left), bool)
            rest[chosen] = False
            left, at = left[rest], (at[rest] + 1) & ((1 << self.bits) - 1)
        self.forget()

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        at = self._place(keys)
        out = np.full(len(keys), NONE)
        todo = np.arange(len(keys))
        while len(todo):
            seen = self.slots[at]
            hit = seen == keys[todo]
            out[todo[hit]] = self.values[at[hit]]
            on = ~hit & (seen != np.uint64(2**64 - 1))
            todo, at = todo[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out

    def merge_all(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece. Short pieces are merged together, a step at a time; long ones with a heap."""
        out: list[np.ndarray | None] = [None] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if len(piece) > NARROW:
                out[i] = self.merge_long(piece)
            else:
                by_width.setdefault(-(-len(piece) // 4) * 4, []).append(i)
        for width, members in by_width.items():
            for k in range(0, len(members), 1 << 16):
                chosen = members[k : k + (1 << 16)]
                for i, ids in zip(chosen, self._merge_grid([pieces[i] for i in chosen], width), strict=True):
                    out[i] = ids
        return out

    def _merge_grid(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        lengths = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(len(pieces), width)
        columns = np.arange(width)
        ids = np.where(columns < lengths[:, None], self.of_byte[raw], -1)
        pair = np.full((len(pieces), width), NONE)
        real = columns[:-1] + 1 < lengths[:, None]
        pair[:, :-1][real] = self.pair_ranks(ids[:, :-1][real], ids[:, 1:][real])
        done: list[np.ndarray | None] = [None] * len(pieces)
        rows = np.arange(len(pieces))
        while len(rows):
            best = pair.argmin(1)
            rank = pair[np.arange(len(rows)), best]
            stop = rank == NONE
            for i in np.flatnonzero(stop):
                done[rows[i]] = ids[i, : lengths[i]].copy()
            go = ~stop
            rows, ids, pair, lengths, best, rank = rows[go], ids[go], pair[go], lengths[go], best[go], rank[go]
            if not len(rows):
                break
            each = np.arange(len(rows))
            source = np.minimum(columns + (columns > best[:, None]), width - 1)
            ids, pair = np.take_along_axis(ids, source, 1), np.take_along_axis(pair, source, 1)
            pair[:, -1] = NONE
            lengths = lengths - 1
            ids[each, best] = rank
            pair[each, best] = NONE
            right = each[best + 1 < lengths]
            pair[right, best[right]] = self.pair_ranks(rank[right], ids[right, best[right] + 1])
            left = each[best > 0]
            pair[left, best[left] - 1] = self.pair_ranks(ids[left, best[left] - 1], rank[left])
        return done

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The same for one long piece, in n log n."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        before, after = list(range(-1, len(piece) - 1)), list(range(1, len(piece) + 1))
        heap = []

        def push(i: int) -> None:
            j = after[i]
            if j < len(parts) and (rank := self.ranks.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (rank, i, len(parts[i]) + len(parts[j])))

        for i in range(len(parts) - 1):
            push(i)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i]
            if not parts[i] or j >= len(parts) or len(parts[i]) + len(parts[j]) != size:
                continue
            parts[i], parts[j] = parts[i] + parts[j], b""
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return np.array([self.ranks[p] for p in parts if p], np.int32)

    def forget(self) -> None:
        self.hashes, self.at, self.counts, self.ids = (np.empty(0, k) for k in (np.uint64, np.int64, np.int64, np.int32))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all documents, the first id of each document (one more at the end), each id's piece start in bytes."""
        points, at, point_offsets = vec.code_points(data, offsets)
        begins = at[starts_of_pieces(classes(points, point_offsets))]
        ends = np.append(begins[1:], len(data)) if len(begins) else begins
        hashes, first, inverse = np.unique(vec.span_hashes(data, begins, ends), return_index=True, return_inverse=True)
        where = np.searchsorted(self.hashes, hashes)
        known = np.zeros(len(hashes), bool)
        inside = where < len(self.hashes)
        known[inside] = self.hashes[where[inside]] == hashes[inside]
        if not known.all():
            if len(self.hashes) > KNOWN:
                self.forget()
                known[:] = False
            fresh = np.flatnonzero(~known)
            raw = data.tobytes()
            merged = self.merge_all([raw[begins[i] : ends[i]] for i in first[fresh]])
            counts = np.array([len(m) for m in merged], np.int64)
            self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(counts) - counts])
            self.ids = np.concatenate([self.ids, *merged])
            self.counts = np.concatenate([self.counts, counts])
            self.hashes = np.concatenate([self.hashes, hashes[fresh]])
            order = np.argsort(self.hashes, kind="stable")
            self.hashes, self.at, self.counts = self.hashes[order], self.at[order], self.counts[order]
            where = np.searchsorted(self.hashes, hashes)
        slot = where[inverse]
        counts = self.counts[slot]
        ids = self.ids[vec.ragged(self.at[slot], counts)]
        before = np.zeros(len(counts) + 1, np.int64)
        np.cumsum(counts, out=before[1:])
        return ids, before[vec.owners(begins, offsets)], np.repeat(begins, counts)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of ids and the byte at which each id begins (one more at the end)."""
        counts = self.token_lengths[ids]
        before = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(counts, out=before[1:])
        return self.token_bytes[vec.ragged(self.token_starts[ids], counts)], before


_mergers: dict[str, Merger] = {}


def merger(path: str) -> Merger:
    if path not in _mergers:
        _mergers[path] = Merger(path)
    return _mergers[path]


def _slices(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Rows of a binary column, cut from one buffer."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def encode(docs: DataFrame, ranks: str, text: str = "text", id_column: str = "doc_id", piece_offsets: bool = False) -> DataFrame:
    """Rows (id, ids, n_tokens) for every row of ``docs``; ids are little-endian unsigned 32-bit integers.

    ``ranks`` is the path of a rank file, on every machine. With ``piece_offsets`` there is a column ``offsets`` as well:
    for each id the byte where its piece begins, so that a run of ids is decoded to its place in the text. A null or
    empty text has no ids; repeated rows and null identifiers are kept as they are; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = merger(ranks)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for first, last, data, offsets in vec.pieces(texts):
                ids, bounds, begins = model.encode(data, offsets)
                arrays = [keys.slice(first, last - first), _slices(ids.astype("<u4"), bounds * 4), pa.array(np.diff(bounds))]
                if piece_offsets:
                    begins = begins - np.repeat(offsets[:-1], np.diff(bounds))
                    arrays.append(_slices(begins.astype("<u4"), bounds * 4))
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    names = ["id", "ids", "n_tokens"] + ["offsets"] * piece_offsets
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"id {kind}, ids binary, n_tokens bigint" + ", offsets binary" * piece_offsets
    out = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_column)


def decode(encoded: DataFrame, ranks: str, ids: str = "ids", to: str = "bytes") -> DataFrame:
    """``encoded`` with a binary column of the decoded bytes in place of the ids."""
    kept = [c for c in encoded.columns if c != ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = merger(ranks)
        for batch in batches:
            for first, last, data, offsets in vec.pieces(batch.column(0)):
                found, begins = model.decode(np.frombuffer(data.tobytes(), "<u4").astype(np.int64))
                arrays = [batch.column(i + 1).slice(first, last - first) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*arrays, _slices(found, begins[offsets // 4])], names=[*kept, to])

    fields = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in kept)
    return encoded.select(ids, *[F.col(f"`{c}`") for c in kept]).mapInArrow(run, f"{fields}, `{to}` binary")
