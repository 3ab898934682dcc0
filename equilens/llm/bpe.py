"""Byte-level BPE encoding and decoding with numpy inside Arrow batches.

A batch's distinct pieces are sorted into buckets by length and laid out as
padded integer matrices, a row for each piece. In every round each row merges
its leftmost pair of least rank, looked up in an open-addressing hash table of
pairs; the rows are then compacted and finished rows leave the matrix. A piece
longer than a row is a matrix of its own.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of a matrix row; a longer piece is a matrix of its own.
WIDE = 1024
#: Distinct pieces that a worker remembers; on overflow it starts anew.
CACHE = 300_000
#: Matrix cells of one bucket.
CELLS = 2_000_000
NONE = np.int32(2**31 - 1)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Bpe:
    """Encoder and decoder of one vocabulary; `ranks` maps a token's bytes to its id."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.token = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.token[i] = token
        self.of_byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = {(ranks[t[:i]], ranks[t[i:]]): r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        keys = np.array([a << 32 | b for a, b in pairs], np.int64)
        values = np.fromiter(pairs.values(), np.int32, len(pairs))
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):  # each free slot takes the last key that asks for it, the others move on by one
            free = self.keys[at[left]] == -1
            self.keys[at[left[free]]] = keys[left[free]]
            done = self.keys[at[left]] == keys[left]
            self.values[at[left[done]]] = values[left[done]]
            left = left[~done]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
        self.reset()

    def reset(self) -> None:
        """Forgets all pieces. Piece k has the ids flat[start[k] : start[k] + length[k]]."""
        self.known: dict[str, int] = {}
        self.flat, self.length = np.empty(0, np.int32), np.empty(0, np.int64)
        self.start = np.empty(0, np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank_of_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = self._slot(key)
        found = self.keys[at]
        out = np.where(found == key, self.values[at], NONE)
        open_ = np.flatnonzero((found != key) & (found != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out

    def _matrix(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For pieces of nearly the same length: all their ids, piece after piece, and how many each has."""
        n, width = len(pieces), max(map(len, pieces))
        length = np.fromiter(map(len, pieces), np.int64, n)
        cells = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        ids = self.of_byte[cells]
        rank = np.full((n, width), NONE, np.int32)
        if width > 1:
            rank[:, :-1] = self.rank_of_pairs(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        rank[np.arange(width) >= length[:, None] - 1] = NONE
        out, ends = np.zeros((n, width), np.int32), np.zeros(n, np.int64)
        row, column = np.arange(n), np.arange(width)
        while len(row):
            at = rank.argmin(1)  # the leftmost of the least
            every = np.arange(len(row))
            least = rank[every, at]
            over = least == NONE
            if over.any():
                out[row[over], : ids.shape[1]], ends[row[over]] = ids[over], length[over]
                keep = ~over
                row, ids, rank, length, at, least = row[keep], ids[keep], rank[keep], length[keep], at[keep], least[keep]
                if not len(row):
                    break
                width = int(length.max())
                ids, rank, column, every = ids[:, :width], rank[:, :width], column[:width], np.arange(len(row))
            ids[every, at] = least
            if width > 1:  # compaction: what stands right of the merged pair moves one to the left
                moved = column[:-1] > at[:, None]
                ids[:, :-1] = np.where(moved, ids[:, 1:], ids[:, :-1])
                rank[:, :-1] = np.where(moved, rank[:, 1:], rank[:, :-1])
                rank[:, -1] = NONE
            length -= 1
            for shift in (-1, 0):
                p = at + shift
                ok = np.flatnonzero((p >= 0) & (p < length - 1))
                rank[ok, p[ok]] = self.rank_of_pairs(ids[ok, p[ok]], ids[ok, p[ok] + 1])
            last = at >= length - 1
            rank[every[last], at[last]] = NONE
        return out[np.arange(out.shape[1]) < ends[:, None]], ends

    def _wide(self, piece: bytes) -> np.ndarray:
        """The ids of one long piece, laid out as a matrix of many rows that are one chain of cells.

        A round takes the pairs of least rank of the whole chain from the left
        and merges them, up to the first merge that makes a pair of lesser rank:
        the same merges, in the same order, as one leftmost pair a round. Only
        rows that hold such a pair are looked at; when half of all cells have
        been merged away the chain is compacted.
        """
        ids = self.of_byte[np.frombuffer(piece, np.uint8)]
        while True:
            n = len(ids)
            rows = -(-(n + 1) // WIDE)
            cells = np.full(rows * WIDE, -1, np.int32)
            cells[:n] = ids
            rank = np.full(rows * WIDE, NONE, np.int32)
            rank[: n - 1] = self.rank_of_pairs(ids[:-1], ids[1:])
            after, before, alive = np.arange(1, n + 2), np.arange(-1, n), n
            after[n - 1 :] = n  # cell n stands for the end
            table = rank.reshape(rows, WIDE)
            least = table.min(1)
            while 2 * alive > n or alive < WIDE:
                r = least.min()
                if r == NONE:
                    return cells[:n][cells[:n] >= 0]
                hit = np.flatnonzero(least == r)
                i, j = np.nonzero(table[hit] == r)
                at = hit[i] * WIDE + j
                # of pairs that share a token every second one counts, from the left
                chained = np.concatenate([[False], after[at[:-1]] == at[1:]])
                first = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - first) % 2 == 0]
                right = after[at]
                left, beyond = before[at], after[right]
                # what a merge meets: the merge before it on the left, the token as it is on the right
                merged = np.concatenate([[False], (left[1:] == right[:-1])])
                left_id = np.where(merged, r, np.where(left >= 0, cells[left], -1))
                made_left = np.where(left >= 0, self.rank_of_pairs(left_id, np.full(len(at), r)), NONE)
                made_right = np.where(beyond < n, self.rank_of_pairs(np.full(len(at), r), cells[beyond]), NONE)
                lesser = np.flatnonzero((made_left < r) | (made_right < r))
                if len(lesser):
                    k = int(lesser[0]) + 1
                    at, right, left, beyond = at[:k], right[:k], left[:k], beyond[:k]
                cells[at], cells[right], rank[right] = r, -1, NONE
                after[at], before[beyond] = beyond, at
                alive -= len(at)
                left = before[at]
                touched = np.concatenate([at, left[left >= 0]])
                end = after[touched]
                rank[touched] = np.where(end < n, self.rank_of_pairs(cells[touched], cells[end]), NONE)
                stale = np.unique(np.concatenate([touched, right]) // WIDE)
                least[stale] = table[stale].min(1)
            ids = cells[:n][cells[:n] >= 0]

    def learn(self, pieces: set[str]) -> None:
        """Encodes pieces that are new."""
        todo: list[tuple[int, str, bytes]] = []
        names: list[str] = []
        flat, length = [], []
        for p in pieces:
            raw = p.encode("utf-8", "surrogatepass")
            if (whole := self.ranks.get(raw)) is not None or len(raw) > WIDE:
                ids = np.array([whole], np.int32) if whole is not None else self._wide(raw)
                names.append(p)
                flat.append(ids)
                length.append(len(ids))
            else:
                todo.append((len(raw), p, raw))
        length = [np.array(length, np.int64)]
        todo.sort(key=lambda x: x[0])
        first = 0
        while first < len(todo):
            stop, shortest = first + 1, todo[first][0]
            while stop < len(todo) and todo[stop][0] <= max(shortest + 2, shortest * 5 // 4) and (stop - first + 1) * todo[stop][0] <= CELLS:
                stop += 1
            ids, ends = self._matrix([x[2] for x in todo[first:stop]])
            names += [x[1] for x in todo[first:stop]]
            flat.append(ids)
            length.append(ends)
            first = stop
        base = len(self.length)
        self.flat, self.length = np.concatenate([self.flat, *flat]), np.concatenate([self.length, *length])
        self.start = np.cumsum(self.length) - self.length
        self.known.update(zip(names, range(base, base + len(names))))

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, and the offsets at which each text's ids start and the last end."""
        found = [self.find(t) for t in texts]
        get, unknown = self.known.get, repeat(-1)
        k = [np.fromiter(map(get, pieces, unknown), np.int64, len(pieces)) for pieces in found]
        new = {pieces[i] for pieces, own in zip(found, k) for i in np.flatnonzero(own < 0).tolist()}
        if new:
            if over := len(self.known) + len(new) > CACHE:
                self.reset()
                new = {p for pieces in found for p in pieces}
            self.learn(new)
            get = self.known.__getitem__
            k = [np.fromiter(map(get, pieces), np.int64, len(pieces)) if over or (own < 0).any() else own for pieces, own in zip(found, k)]
        k = np.concatenate(k) if k else np.empty(0, np.int64)
        n = self.length[k]
        ends = np.cumsum(n)
        ids = self.flat[np.repeat(self.start[k] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)] if len(k) else np.empty(0, np.int32)
        pieces = np.cumsum([0, *map(len, found)])
        return ids, np.concatenate([[0], ends])[pieces].astype(np.int32)

    def encode(self, texts: list[str]) -> list[list[int]]:
        ids, at = self.encode_flat(texts)
        return [x.tolist() for x in np.split(ids, at[1:-1])] if texts else []

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


#: Characters of text that are encoded at once; a longer text is a step of its own.
STEP = 750_000


def _steps(texts: list[str]) -> Iterator[list[str]]:
    step, size = [], 0
    for t in texts:
        if step and size + len(t) > STEP:
            yield step
            step, size = [], 0
        step.append(t)
        size += len(t)
    if step:
        yield step


def _prepared(docs: DataFrame, text: str, ids: str) -> tuple[DataFrame, list]:
    """`docs` with its text last, empty for null, and the fields of all other columns."""
    kept = docs.drop(*({ids} - {text})).withColumn(text, F.coalesce(F.col(text).cast("string"), F.lit("")))
    rest = [f for f in kept.schema.fields if f.name != text]
    return kept.select(*(f.name for f in rest), text), rest


def _encoded(batches: Iterator[pa.RecordBatch], bpe: Bpe, text: str, ids: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        whole = pa.Table.from_batches([batch])
        for step in _steps(batch.column(batch.schema.get_field_index(text)).to_pylist()):
            part = whole.slice(at, len(step)).drop_columns([text])
            flat, offsets = bpe.encode_flat(step)
            out = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            yield from part.append_column(ids, out).to_batches()
            at += len(step)


def _decoded(batches: Iterator[pa.RecordBatch], token: list[bytes], ids: str, out: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = pa.array([b"".join(map(token.__getitem__, r)) for r in rows_of_ids(batch.column(batch.schema.get_field_index(ids)))], pa.binary())
        yield from pa.Table.from_batches([batch]).append_column(out, made).to_batches()


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """`docs` with the column `ids` (array<int>) instead of `text`; all other columns stay.

    A null text counts as empty and has no ids. A text of any length is taken
    whole. Rows are encoded where they are read: no shuffle. A column that is
    already named `ids` is replaced.
    """
    spark, shared = docs.sparkSession, docs.sparkSession.sparkContext.broadcast((ranks, pattern))  # a vocabulary file: about 1 MB
    kept, rest = _prepared(docs, text, ids)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), f"`{ids}` array<int>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _encoded(batches, Bpe(*shared.value), text, ids)

    return kept.mapInArrow(run, schema)


def rows_of_ids(column: pa.ListArray) -> Iterator[list[int]]:
    """The ids of each row; none for null."""
    ids = column.flatten().to_numpy(zero_copy_only=False)
    at = 0
    for n in column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).tolist():
        yield ids[at : at + n].tolist()
        at += n


def token_table(ranks: dict[bytes, int]) -> list[bytes]:
    """The bytes of each id."""
    token = [b""] * (max(ranks.values()) + 1)
    for t, i in ranks.items():
        token[i] = t
    return token


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds `out` (binary), the bytes of the ids, in the place of a column of that name.

    Null and empty lists of ids give no bytes; repeated rows are decoded one by one.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)
    rest = encoded.drop(out)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields), f"`{out}` binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _decoded(batches, token_table(shared.value), ids, out)

    return rest.mapInArrow(run, schema)


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """The same as `decode` of `encode`, in one worker for each task: rows are decoded as they are encoded, a step of texts at a time."""
    shared, (kept, rest) = docs.sparkSession.sparkContext.broadcast((ranks, pattern)), _prepared(docs.drop(*({out} - {text})), text, ids)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), f"`{ids}` array<int>", f"`{out}` binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(*shared.value)
        yield from _decoded(_encoded(batches, bpe, text, ids), bpe.token, ids, out)

    return kept.mapInArrow(run, schema)
