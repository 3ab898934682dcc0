"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are joined on shared runs of tokens (seeds). For
each pair that could reach the threshold, running Karp-Rabin finds the longest
matches that don't overlap, marks them and goes on with shorter ones; the share
of the item's tokens under tiles is its coverage. Tiles may stand in any order,
so a reordered passage is caught too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equilens.llm.common import shared_dir
from equilens.llm.shingles import words_of

#: Tokens of a seed, and so of the shortest tile.
SEED = 5
#: Share of an item's tokens under tiles from which a document counts as contaminated.
COVERAGE = 0.6
#: Bytes of benchmark text that are broadcast at once; a larger benchmark takes several passes over the documents.
BLOCK_BYTES = 32_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


class Windows:
    """Karp-Rabin hashes of all windows of a sequence, of any size, from prefix sums of powers (modulo 2^64).

    Windows are compared after division by their first power, which an odd base
    makes possible; a size costs one subtraction and one product a window.
    """

    def __init__(self, ids: np.ndarray):
        self.n = len(ids)
        power = np.cumprod(np.full(self.n, _BASE, np.uint64))
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(ids) * power)])
        self.inverse = np.cumprod(np.full(self.n, np.uint64(pow(int(_BASE), -1, 2**64)), np.uint64))

    def of(self, size: int) -> np.ndarray:
        if self.n < size:
            return np.empty(0, np.uint64)
        return (self.total[size:] - self.total[:-size]) * self.inverse[: self.n - size + 1]


def mixed(ids: np.ndarray) -> np.ndarray:
    x = (ids.astype(np.int64).astype(np.uint64) + np.uint64(1)) * _BASE
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return x ^ (x >> np.uint64(27))


def equal_windows(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, size: int) -> np.ndarray:
    """Whether the windows of `a` at i and of `b` at j have the same tokens: equal hashes alone don't count."""
    same = np.ones(len(i), bool)
    for k in range(size if len(i) else 0):
        same &= a[i + k] == b[j + k]
    return same


def _free(open_: np.ndarray, size: int) -> np.ndarray:
    """Places of the windows without a marked token."""
    upto = np.concatenate([[0], np.cumsum(open_)])
    return np.flatnonzero(upto[size:] - upto[:-size] == size)


def greedy_tiles(item: np.ndarray, text: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """Tiles (length, start in item, start in text) of two arrays of token ids, longest first; ids below 0 match nothing.

    The length of the longest match that is left is found by bisection, as a
    match has matches of all smaller lengths in it. At this length the text is
    walked from its start: a window takes the first free one of the item that
    equals it, both are marked, and afterwards only shorter matches are left.
    Memory is linear in item and text however often they repeat their words:
    pairs of equal windows are never listed.
    """
    free_i, free_t = np.ones(len(item), bool), text >= 0
    windows_i, windows_t = Windows(item), Windows(text)
    tiles: list[tuple[int, int, int]] = []

    def shared(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Free windows of the item in the order of their hashes, with these, and free windows of the text that have one of them."""
        at_i, at_t = _free(free_i, size), _free(free_t, size)
        hi, ht = windows_i.of(size)[at_i], windows_t.of(size)[at_t]
        order = np.argsort(hi, kind="stable")
        at_i, hi = at_i[order], hi[order]
        place = np.minimum(np.searchsorted(hi, ht), max(len(hi) - 1, 0))
        hit = hi[place] == ht if len(hi) else np.zeros(len(ht), bool)
        return at_i, hi, at_t[hit], place[hit]

    top = min(len(item), len(text))
    while top >= least:
        low, high = least - 1, top  # matches of `low` are there, or none at all
        while low < high:
            middle = (low + high + 1) // 2
            if len(shared(middle)[2]):
                low = middle
            else:
                high = middle - 1
        if low < least:
            break
        at_i, hi, at_t, place = shared(low)
        ends = np.searchsorted(hi, hi, "right")
        nexts: dict[int, int] = {}
        until = 0
        for j, first in zip(at_t.tolist(), place.tolist()):
            if j < until:
                continue
            k, end = nexts.get(first, first), int(ends[first])
            while k < end and not free_i[at_i[k] : at_i[k] + low].all():
                k += 1  # what is marked stays marked
            nexts[first] = k
            if k < end and free_t[j : j + low].all() and (item[at_i[k] : at_i[k] + low] == text[j : j + low]).all():
                i, until = int(at_i[k]), j + low
                free_i[i : i + low] = free_t[j:until] = False
                tiles.append((low, i, j))
        top = low - 1
    return tiles


@dataclass
class Seeds:
    """Windows of one size of all items of this size: `keys` are their distinct hashes; windows of key k are `item` and `place` from begin[k] to begin[k + 1]."""

    keys: np.ndarray
    begin: np.ndarray
    item: np.ndarray
    place: np.ndarray


class Tiler:
    """Finds the items of one block of the benchmark in texts."""

    def __init__(self, items: list[tuple[object, str | None]], least: int, coverage: float):
        self.least, self.coverage = least, coverage
        self.names, self.vocabulary, self.items = [], {}, []
        for name, text in items:
            tokens = words_of(text or "")
            if tokens:
                self.names.append(name)
                self.items.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in tokens], np.int64))
        self.flat = np.concatenate([*self.items, np.empty(0, np.int64)])
        self.starts = np.cumsum([0, *map(len, self.items)])
        self.seeds = {}
        for size in {min(least, len(x)) for x in self.items}:
            own = [k for k, x in enumerate(self.items) if min(least, len(x)) == size]
            h = [Windows(self.items[k]).of(size) for k in own]
            flat, item = np.concatenate(h), np.repeat(own, [len(x) for x in h])
            place = np.concatenate([np.arange(len(x)) for x in h])
            order = np.argsort(flat, kind="stable")
            keys, begin = np.unique(flat[order], return_index=True)
            seeds = Seeds(keys, np.append(begin, len(flat)), item[order], place[order])
            heads = np.repeat(seeds.begin[:-1], np.diff(seeds.begin))
            at, head = (self.starts[seeds.item[k]] + seeds.place[k] for k in (slice(None), heads))
            if not equal_windows(self.flat, self.flat, at, head, size).all():
                raise ValueError("two different seeds of the benchmark have the same hash")
            self.seeds[size] = seeds

    def __call__(self, text: str | None) -> list[tuple[object, float, int, int]]:
        """(item, coverage, tiles, longest tile) of the items that reach the threshold; linear in the text and the seeds that it has."""
        words = words_of(text or "")
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))
        if not (ids >= 0).any():
            return []
        found = []
        windows = Windows(ids)
        for size, seeds in self.seeds.items():
            full = _free(ids >= 0, size)
            if not len(full):
                continue
            h = windows.of(size)[full]
            key = np.minimum(np.searchsorted(seeds.keys, h), len(seeds.keys) - 1)
            hit = seeds.keys[key] == h
            full, key = full[hit], key[hit]
            head = seeds.begin[key]
            same = equal_windows(ids, self.flat, full, self.starts[seeds.item[head]] + seeds.place[head], size)
            full, key = full[same], key[same]
            present = np.unique(key)  # each seed counts once, however often the text has it
            n = seeds.begin[present + 1] - seeds.begin[present]
            at = np.repeat(seeds.begin[present] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            item, place, of_key = seeds.item[at], seeds.place[at], np.repeat(present, n)
            order = np.argsort(item, kind="stable")
            item, place, of_key = item[order], place[order], of_key[order]
            cuts = np.flatnonzero(np.diff(item)) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(item)]):
                if s == e:
                    continue
                k = int(item[s])
                own = self.items[k]
                if _under(place[s:e], size, len(own)).sum() < self.coverage * len(own):
                    continue
                inside = np.flatnonzero(_under(full[np.isin(key, of_key[s:e])], size, len(ids)))
                gaps = np.flatnonzero(np.diff(inside) > 1) + 1
                tiles = greedy_tiles(own, np.insert(ids[inside], gaps, -1), size)
                share = sum(t[0] for t in tiles) / len(own)
                if share >= self.coverage:
                    found.append((self.names[k], share, len(tiles), max(t[0] for t in tiles)))
        return found


def _under(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n places lie in a window of `size` from one of `starts`."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    return np.cumsum(edge)[:-1] > 0


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", least: int = SEED, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, item, coverage, tiles, longest): pairs whose tiles cover at least `coverage` of the item's tokens.

    Tokens are words in lower case. Null and empty texts and items without a
    word match nothing; an item shorter than a seed must occur whole. Keys and
    items may be of any type; null ones are values like others. Repeated items
    or documents give repeated pairs, and of equally long tiles the first in
    the document counts first. Without items or documents there are no pairs.

    The benchmark is the stated query set: it is cut into blocks of about
    `block_bytes`, and each is broadcast and met by all documents where they
    are read, without a shuffle. The pairs of each block but a single one are
    written to the shared folder before the next block is read, so that the
    driver never holds more than one.
    """
    spark = docs.sparkSession
    rows = benchmark.select(F.col(item).alias("item"), F.col(item_text).cast("string").alias("item_text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("item_text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    kept = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    id_type, item_type = kept.schema["id"].dataType.simpleString(), rows.schema["item"].dataType.simpleString()
    schema = f"id {id_type}, item {item_type}, coverage double, tiles int, longest int"

    def pairs(n: int) -> tuple[DataFrame, Broadcast]:
        own = rows.where(F.pmod(F.xxhash64("item", "item_text"), F.lit(blocks)) == n).toArrow()  # about block_bytes
        shared = spark.sparkContext.broadcast((own.column("item").combine_chunks(), own.column("item_text").to_pylist()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, texts = shared.value
            tiler = Tiler(list(enumerate(texts)), least, coverage)
            for b in batches:
                found = [(k, *x) for k, t in enumerate(b.column("text").to_pylist()) for x in tiler(t)]
                cells = list(zip(*found)) or [()] * 5
                at, which = (pa.array(cells[i], pa.int64()) for i in (0, 1))
                measures = [pa.array(cells[i], kind) for i, kind in ((2, pa.float64()), (3, pa.int32()), (4, pa.int32()))]
                yield pa.RecordBatch.from_arrays([b.column("id").take(at), names.take(which), *measures], ["id", "item", "coverage", "tiles", "longest"])

        return kept.mapInArrow(run, schema), shared

    if blocks == 1:
        out, _ = pairs(0)
    else:
        path = shared_dir(spark, "contaminated")
        for n in range(blocks):
            part, shared = pairs(n)
            part.write.parquet(f"{path}/block={n}")
            shared.destroy()
        out = spark.read.schema(part.schema).parquet(*(f"{path}/block={n}" for n in range(blocks)))
    return out.select(F.col("id").alias(key), F.col("item").alias(item), "coverage", "tiles", "longest")
