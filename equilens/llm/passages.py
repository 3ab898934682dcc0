"""A quality classifier that learns from labels of documents which passages matter.

Attention-based multiple-instance learning: a document is a bag of passages.
Every passage is encoded, a gated attention gives it a weight within its
document, and the weighted representation is scored. Only documents have
labels; what the attention looks at follows from them.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equilens.llm.common import removed, written_at

#: Labelled documents that are learned from, at most about.
TRAIN_DOCS = 20_000
#: Of these, so many are learned from in one task.
SHARD_DOCS = 2500
#: Tokens of a passage.
WORDS = 64
#: Buckets for the shapes of tokens.
SHAPES = 64
STATISTICS = ("upper", "digits", "marks", "length", "lettered", "distinct", "repeated", "size")
INPUTS = SHAPES + len(STATISTICS)
#: Units of a passage's representation, and of its attention.
HIDDEN, GATES = 24, 12
#: Rounds of training; the steps of a round in each task, and the documents of a step.
ROUNDS, STEPS, STEP_DOCS = 8, 60, 64
RATE, DECAY = 0.02, 1e-4
#: Tokens that a task remembers, and tokens that are encoded at once.
CACHE, TOGETHER = 200_000, 200_000
#: Characters that are split into tokens at once.
SLICE = 1_000_000
#: Characters of a token that is remembered as it is.
LONGEST = 64
_SPACE = re.compile(r"\s")


def shape_of(token: str) -> str:
    """Letters, capitals and digits as l, U and d, other characters as they are, each run once."""
    out, last = [], ""
    for c in token:
        kind = "U" if c.isupper() else "l" if c.isalpha() else "d" if c.isdigit() else c
        if kind != last:
            out.append(kind)
            last = kind
    return "".join(out)


class _Known(dict):
    """Numbers of tokens; a new token's properties are appended to `table`."""

    def __init__(self):
        super().__init__()
        self.table = np.zeros((1024, 6))

    def __missing__(self, token: str) -> int:
        n = len(token)
        key = token if n <= LONGEST else f"{token[:LONGEST]} {n} {zlib.crc32(token.encode())}"
        if n > LONGEST and (had := self.get(key)) is not None:
            return had
        at = self[key] = len(self)
        if at == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        upper, digits, letters = (sum(map(f, token)) for f in (str.isupper, str.isdigit, str.isalpha))
        self.table[at] = zlib.crc32(shape_of(token).encode()) % SHAPES, upper / n, digits / n, (n - letters - digits) / n, np.log1p(n) / 4, letters > 0
        return at


def _slices(text: str) -> Iterator[str]:
    """The text in slices of about SLICE characters that end at white space."""
    at = 0
    while at < len(text):
        cut = _SPACE.search(text, at + SLICE)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


class Encoder:
    """Passages of texts as vectors of INPUTS numbers."""

    def __init__(self):
        self.known = _Known()

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Vectors of all passages, and the place of each text's first one; a text without a token has one passage, of zeros."""
        vectors, sizes = [np.empty((0, INPUTS))], []
        ids: list[np.ndarray] = []
        pending = tokens = 0
        for t in texts:
            own = [np.fromiter(map(self.known.__getitem__, s.split()), np.int64) for s in _slices(t or "")]
            ids.append(np.concatenate([np.empty(0, np.int64), *own]))
            pending, tokens = pending + 1, tokens + len(ids[-1])
            if tokens >= TOGETHER:
                vectors.append(self._encode(ids, sizes))
                ids, pending, tokens = [], 0, 0
        if pending:
            vectors.append(self._encode(ids, sizes))
        return np.concatenate(vectors), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)[:-1]

    def _encode(self, ids: list[np.ndarray], sizes: list[int]) -> np.ndarray:
        lengths = np.array([len(x) for x in ids])
        passages = np.maximum(1, -(-lengths // WORDS))
        sizes.extend(passages.tolist())
        first = np.cumsum(passages) - passages
        p = int(passages.sum())
        at = np.concatenate([f + np.arange(n) // WORDS for f, n in zip(first, lengths)]).astype(np.int64)
        flat = np.concatenate(ids)
        own = self.known.table[flat]
        n = np.bincount(at, minlength=p)
        shapes = np.bincount(at * SHAPES + own[:, 0].astype(np.int64), minlength=p * SHAPES).reshape(p, SHAPES)
        sums = [np.bincount(at, own[:, k], p) for k in range(1, 6)]
        distinct = np.bincount(np.unique(at << 32 | flat) >> 32, minlength=p)
        again = np.bincount(at[1:][(flat[1:] == flat[:-1]) & (at[1:] == at[:-1])], minlength=p)
        each = np.maximum(n, 1)[:, None]
        if len(self.known) > CACHE:
            self.known = _Known()
        return np.column_stack([shapes / each, np.column_stack([*sums, distinct, again]) / each, np.log1p(n) / 5])


@dataclass
class Model:
    """h = tanh(x encode + bias); attention from tanh(h attend) * sigmoid(h gate); logit = weighted h score + offset."""

    encode: np.ndarray
    bias: np.ndarray
    attend: np.ndarray
    gate: np.ndarray
    weigh: np.ndarray
    score: np.ndarray
    offset: np.ndarray

    @classmethod
    def start(cls, seed: int = 11) -> Model:
        r = np.random.default_rng(seed)
        draw = lambda *s: r.normal(0, 1 / np.sqrt(s[0]), s)
        return cls(draw(INPUTS, HIDDEN) * 3, np.zeros(HIDDEN), draw(HIDDEN, GATES), draw(HIDDEN, GATES), draw(GATES, 1)[:, 0], draw(HIDDEN, 1)[:, 0], np.zeros(1))

    @classmethod
    def constant(cls, p: float) -> Model:
        zero = cls.from_flat(np.zeros(len(cls.start().flat())))
        zero.offset[0] = np.log(p / (1 - p))
        return zero

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, f.name).ravel() for f in fields(self)])

    @classmethod
    def from_flat(cls, values: np.ndarray) -> Model:
        shapes = [(INPUTS, HIDDEN), (HIDDEN,), (HIDDEN, GATES), (HIDDEN, GATES), (GATES,), (HIDDEN,), (1,)]
        ends = np.cumsum([int(np.prod(s)) for s in shapes])
        return cls(*(x.reshape(s).copy() for x, s in zip(np.split(np.asarray(values, float), ends[:-1]), shapes)))

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        """Probabilities of the bags that start at `first`, with what led to them: attention `a`, representation `z`."""
        size = np.diff(np.append(first, len(x)))
        h = np.tanh(x @ self.encode + self.bias)
        t, g = np.tanh(h @ self.attend), _sigmoid(h @ self.gate)
        s = (t * g) @ self.weigh
        e = np.exp(s - np.repeat(np.maximum.reduceat(s, first), size))
        a = e / np.repeat(np.add.reduceat(e, first), size)
        z = np.add.reduceat(a[:, None] * h, first)
        return {"size": size, "h": h, "t": t, "g": g, "a": a, "z": z, "p": _sigmoid(z @ self.score + self.offset[0])}

    def gradient(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Of the mean log loss over the bags, in the order of `flat`."""
        f = self.forward(x, first)
        d = (f["p"] - y) / len(y)
        dz = np.repeat(d[:, None] * self.score, f["size"], axis=0)
        da = (dz * f["h"]).sum(1)
        ds = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, first), f["size"]))
        du = ds[:, None] * self.weigh
        dt, dg = du * f["g"] * (1 - f["t"] ** 2), du * f["t"] * f["g"] * (1 - f["g"])
        dh = (f["a"][:, None] * dz + dt @ self.attend.T + dg @ self.gate.T) * (1 - f["h"] ** 2)
        parts = x.T @ dh, dh.sum(0), f["h"].T @ dt, f["h"].T @ dg, (f["t"] * f["g"]).T @ ds, f["z"].T @ d, np.array([d.sum()])
        return np.concatenate([p.ravel() for p in parts])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def improved(model: Model, x: np.ndarray, first: np.ndarray, y: np.ndarray, steps: int, seed: int) -> Model:
    """The model after so many steps (Adam), each over documents drawn at random."""
    r, w = np.random.default_rng(seed), model.flat()
    ends = np.append(first[1:], len(x))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        drawn = r.choice(len(y), min(STEP_DOCS, len(y)), replace=False)
        size = (ends - first)[drawn]
        starts = np.cumsum(size) - size
        rows = np.repeat(first[drawn] - starts, size) + np.arange(size.sum())
        g = Model.from_flat(w).gradient(x[rows], starts, y[drawn]) + DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model.from_flat(w)


def draw(labels: DataFrame, key: str, docs: int = TRAIN_DOCS) -> DataFrame:
    """At most about `docs` rows, by a hash of the key; all rows if there are no more."""
    n = labels.count()
    return labels.where(F.pmod(F.xxhash64(F.lit("passages"), key), F.lit(1_000_000)) < F.lit(int(1_000_000 * min(1.0, docs / max(n, 1)))))


def _learner(weights: np.ndarray, k: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def learn(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["at", "y"], kind="stable")
        own = [np.asarray(b, np.float64).reshape(-1, INPUTS) for b in part["bag"]]
        first = np.cumsum([0, *map(len, own)])[:-1]
        better = improved(Model.from_flat(weights), np.concatenate(own), first, part["y"].to_numpy(float), STEPS, 1000 * k + int(part["shard"].iloc[0]))
        return pd.DataFrame({"n": [len(part)], "weights": [better.flat()]})

    return learn


def fit(labelled: DataFrame, label: str, key: str = "doc_id", text: str = "text", docs: int = TRAIN_DOCS, rounds: int = ROUNDS) -> Model:
    """A model of `label` (0 or 1), from whole texts of at most about `docs` rows, drawn by a hash of the key.

    Rows with a null label are left out; a null text is a single passage of
    zeros; repeated rows count as often as they occur; the order of rows with
    one key is settled by label and text. Without rows every score is one half,
    with one class only its share, kept from 0 and 1 by a thousandth.

    The drawn texts are encoded once and written to the shared folder. In each
    round every shard of about SHARD_DOCS documents improves the common model
    in a task of its own, and the mean of their weights (about 2500 numbers) is
    the next common model, so no task and not the driver gets all passages.
    """
    spark = labelled.sparkSession
    rows = draw(labelled.where(F.col(label).isNotNull()), key, docs).select(F.col(key).alias("key"), F.col(label).cast("double").alias("y"), F.col(text).cast("string").alias("text"))
    given = rows.agg(F.count("*").alias("n"), F.avg("y").alias("share")).first()
    if not given.n or given.share in (0.0, 1.0):
        return Model.constant(min(max(0.5 if not given.n else given.share, 1e-3), 1 - 1e-3))
    shards = -(-given.n // SHARD_DOCS)
    rows = rows.withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), "key"), F.lit(shards)).cast("int")).withColumn("at", F.xxhash64("key", "y", "text"))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder()
        for b in batches:
            if b.num_rows:
                x, first = encoder(b.column("text").to_pylist())
                bags = [p.astype(np.float32).ravel() for p in np.split(x, first[1:])]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("shard", "at", "y")), pa.array(bags, pa.list_(pa.float32()))], ["shard", "at", "y", "bag"])

    bags, path = written_at(rows.select("shard", "at", "y", "text").mapInArrow(encoded, "shard int, at long, y double, bag array<float>"), "bags")
    model = Model.start()
    for k in range(rounds):
        got = bags.groupBy("shard").applyInPandas(_learner(model.flat(), k), "n long, weights array<double>").collect()  # a row for each shard
        order = sorted(got, key=lambda r: (r.n, r.weights))
        model = Model.from_flat(np.average([r.weights for r in order], axis=0, weights=[r.n for r in order]))
    removed(spark, path)
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` without `text`, with `score` (0 to 1), `passages` and `attention`, the largest share that a passage has in the score.

    A null or empty text is one passage of zeros; columns of these names are
    replaced; repeated rows are answered one by one, an empty table gives none.
    """
    names = ("score", "passages", "attention")
    kept = docs.drop(*(n for n in names if n != text))
    rest = [c for c in kept.columns if c != text]
    shared = docs.sparkSession.sparkContext.broadcast(model.flat())  # about 2500 numbers
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name != text), "score double, passages int, attention double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, encoder = Model.from_flat(shared.value), Encoder()
        for b in batches:
            if not b.num_rows:
                continue
            x, first = encoder(b.column(b.schema.get_field_index("_text")).to_pylist())
            f = own.forward(x, first)
            made = [pa.array(f["p"], pa.float64()), pa.array(f["size"], pa.int32()), pa.array(np.maximum.reduceat(f["a"], first), pa.float64())]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(rest))), *made], [*rest, *names])

    return kept.select(*rest, F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)
