"""Language identification: script ranges, per-word scores, and Viterbi over the words.

The script of a word narrows its candidate languages to those that were seen
in that script; each candidate gets the mean log-probability of the word's
character n-grams; Viterbi with a penalty for each switch then labels the
words, so that a text of several languages falls into spans.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equilens.llm.common import written

#: Scripts that are written without spaces: each of their letters counts as a word.
ALONE = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
#: Characters of a word at most; a longer run of letters is several words.
LONGEST_WORD = 64
#: The first code points of script ranges, in order, and their names.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "indic"), (0x0E00, "thai"), (0x0E80, "asian"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "african"),
    (0x1780, "asian"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"),
    (0x3040, "kana"), (0x3100, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"),
    (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFF00, "latin"), (0x10000, "other"), (0x20000, "han"),
)
_FIRST = np.array([a for a, _ in SCRIPTS])
#: Labelled documents of each language that the model is fitted on, about.
TRAIN_DOCS = 3000
#: Languages that a model can have; more distinct labels than this are an error.
LANGUAGES = 1000
#: n-grams that the model keeps: those with the largest share in some language.
GRAMS = 200_000
#: What a switch of language costs, in units of log-probability.
SWITCH = 6.0
#: A word weighs its mean n-gram score times the root of its number of n-grams, up to this.
LONGEST = 4.0
#: Distinct words that a worker remembers; on overflow it starts anew.
CACHE = 200_000
#: New words that are scored at once.
CHUNK = 10_000
#: Characters of text that are labelled at once; a longer text is a step of its own.
STEP = 500_000
#: Words of a piece: all pieces of a step walk on together.
PIECE = 128
UNKNOWN = "und"

_OTHER, _LETTER, _MARK, _SINGLE = 0, 1, 2, 3


@cache
def character_kinds() -> np.ndarray:
    """For every code point: no part of a word, letter, mark, or letter that is a word by itself."""
    kinds = np.zeros(0x110000, np.uint8)
    whole = "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, 0x110000)))
    for kind, pattern in ((_LETTER, r"\p{L}"), (_MARK, r"\p{M}"), (_SINGLE, rf"(?=[{ALONE}])\p{{L}}")):
        at = np.fromiter((m.start() for m in regex.finditer(pattern, whole)), np.int64)
        kinds[at + 0x800 * (at >= 0xD800)] = kind
    return kinds


def words_in(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words: a letter with the letters and marks that follow it, LONGEST_WORD at most, or a letter that stands alone."""
    kind = character_kinds()[points]
    letter = kind == _LETTER
    # a mark belongs to a word if there are only letters and marks back to a letter
    run = letter | (kind == _MARK)
    before = np.concatenate([[False], run[:-1]])
    place = np.arange(len(run), dtype=np.int32)
    start_of_run = np.maximum.accumulate(np.where(run & ~before, place, 0))
    last_letter = np.maximum.accumulate(np.where(letter, place, -1))
    inside = run & (last_letter >= start_of_run)
    single = kind == _SINGLE
    begins = inside & ~np.concatenate([[False], inside[:-1]])
    ends = inside & ~np.concatenate([inside[1:], [False]])
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    if len(s) and (e - s).max() > LONGEST_WORD:
        s, e = _cut(s, e, letter)
    alone = np.flatnonzero(single)
    if len(alone):
        s, e = np.concatenate([s, alone]), np.concatenate([e, alone + 1])
        order = np.argsort(s, kind="stable")
        s, e = s[order], e[order]
    return s, e


def _cut(s: np.ndarray, e: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cuts runs of more than LONGEST_WORD characters; each part but the last has that many, and starts with a letter."""
    out_s, out_e = [], []
    for a, b in zip(s.tolist(), e.tolist()):
        while b - a > LONGEST_WORD:
            out_s.append(a), out_e.append(a + LONGEST_WORD)
            a += LONGEST_WORD
            while a < b and not letter[a]:
                a += 1
        if a < b:
            out_s.append(a), out_e.append(b)
    return np.array(out_s, np.int64), np.array(out_e, np.int64)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def words_of(text: str) -> list[str]:
    s, e = words_in(code_points(text))
    return [text[a:b] for a, b in zip(s.tolist(), e.tolist())]


def script_of(word: str) -> str:
    return SCRIPTS[int(np.searchsorted(_FIRST, ord(word[0]), "right")) - 1][1]


def grams_of(word: str) -> list[str]:
    """All runs of two and three characters of a word between blanks."""
    w = f" {word} "
    return [w[i : i + n] for n in (2, 3) for i in range(len(w) - n + 1)]


def key_of(gram: str) -> int:
    """An n-gram's code points, 21 bits each."""
    return sum(ord(x) << 21 * i for i, x in enumerate(reversed(gram)))


@dataclass
class Model:
    """log_p has a value for each language and each n-gram of `keys`, which are sorted; scripts[name] is the mask of its candidates."""

    langs: list[str]
    keys: np.ndarray
    log_p: np.ndarray
    floor: np.ndarray
    scripts: dict[str, np.ndarray]


def held_out(key: str = "doc_id"):
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) == 2


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-grams and scripts of each language, counted over its words."""
    words: dict[str, Counter[str]] = {}

    def flush() -> pa.RecordBatch:
        flat = []
        for l, own in words.items():
            total: Counter[str] = Counter()
            for w, n in own.items():
                for g in grams_of(w):
                    total[g] += n
                total[f"\0{script_of(w)}"] += n
            flat += [(l, g, n) for g, n in total.items()]
        words.clear()
        columns = [pa.array([x[i] for x in flat], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, ["lang", "gram", "n"])

    for b in batches:
        for l, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
            words.setdefault(l, Counter()).update(words_of(t.lower()))
        if sum(map(len, words.values())) > 300_000:
            yield flush()
    yield flush()


def fit(labelled: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", per_language: int = TRAIN_DOCS, most_grams: int = GRAMS) -> Model:
    """Fits on whole texts of about `per_language` rows of each language, drawn by a hash of the key.

    Rows without a language or text are left out; repeated rows count as often
    as they occur. Words and n-grams are counted by Spark; what reaches the
    driver is `most_grams` n-grams, those with the largest share of the n-grams
    of some language (ties: in the order of the n-grams), and a row for each
    language, of which there may be `LANGUAGES`. Without any labelled row the
    model has no languages and every text is `und`.
    """
    known = F.col(lang).isNotNull() & F.col(text).isNotNull()
    rows = labelled.where(known).select(key, F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(LANGUAGES + 1).collect()}
    if len(sizes) > LANGUAGES:
        raise ValueError(f"{lang} has more than {LANGUAGES} values: not a language column")
    if not sizes:
        return Model([], np.empty(0, np.int64), np.zeros((0, 0), np.float32), np.zeros(0, np.float32), {})
    share = F.create_map(*(x for l, n in sizes.items() for x in (F.lit(l), F.lit(min(1.0, per_language / n)))))
    drawn = rows.where(F.pmod(F.xxhash64(F.lit("langid"), key), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)
    counts = drawn.select("lang", "text").mapInArrow(_counted, "lang string, gram string, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    counts = written(counts, "n-grams")  # read twice
    is_script = F.col("gram").startswith("\0")
    totals = counts.where(~is_script).groupBy("lang").agg(F.sum("n").alias("all"))  # a row for each language
    shared = counts.join(F.broadcast(totals), "lang", "left").withColumn("share", F.when(is_script, 2.0).otherwise(F.col("n") / F.col("all")))
    wide = shared.groupBy("gram").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"), F.max("share").alias("share"))
    top = wide.orderBy(F.desc("share"), "gram").limit(most_grams).select("gram", "by").collect()
    langs = sorted(sizes)
    at = {l: i for i, l in enumerate(langs)}
    grams, scripts, table = [], {}, []
    for r in top:
        row = np.zeros(len(langs))
        for l, n in r["by"].items():
            row[at[l]] = n
        if r["gram"].startswith("\0"):
            scripts[r["gram"][1:]] = row
        else:
            grams.append(key_of(r["gram"]))
            table.append(row)
    seen = sum(scripts.values(), np.zeros(len(langs)))
    scripts = {k: (v / np.maximum(seen, 1) > 1e-3) for k, v in scripts.items()}
    n = np.array(table).reshape(len(table), len(langs))
    whole = n.sum(0) + 0.5 * (len(table) + 1)
    keys = np.array(grams, np.int64)
    order = np.argsort(keys)
    log_p, floor = np.log((n + 0.5) / whole).astype(np.float32), np.log(0.5 / whole).astype(np.float32)
    return Model(langs, keys[order], log_p[order], floor, {k: v for k, v in scripts.items() if v.any()})


class Labeller:
    """Scores distinct words once and finds the best path of languages over the words of texts."""

    def __init__(self, model: Model, switch: float = SWITCH):
        self.m, self.switch = model, np.float32(switch)
        none = np.zeros(len(model.langs), bool)
        self.script = np.array([model.scripts.get(name, none) for _, name in SCRIPTS]).reshape(len(SCRIPTS), len(none))
        self.reset()

    def reset(self) -> None:
        """Row 0 is the score of no word; `seen` tells whether training saw the word's script."""
        self.known: dict[str, int] = {}
        self.scores, self.seen, self.used = np.zeros((1, len(self.m.langs)), np.float32), np.zeros(1, bool), 1

    def values_of(self, keys: np.ndarray) -> np.ndarray:
        """The log-probabilities of n-grams."""
        m = self.m
        if not len(m.keys):
            return np.tile(m.floor, (len(keys), 1))
        at = np.minimum(np.searchsorted(m.keys, keys), len(m.keys) - 1)
        return np.where((m.keys[at] == keys)[:, None], m.log_p[at], m.floor)

    def learn(self, words: list[str]) -> None:
        """Scores of new words: a row of `scores` each, very low for languages that aren't candidates."""
        m, lower = self.m, [w.lower() for w in words]
        length = np.fromiter(map(len, lower), np.int64, len(words))
        c = code_points(" " + " ".join(lower) + " ").astype(np.int64)
        pairs = c[:-1] << 21 | c[1:]
        triples = np.flatnonzero(c[1:-1] != 32)  # a blank in the middle joins two words
        starts = np.cumsum(length + 1) - length - 1
        each = self.values_of(pairs)
        each[triples] += self.values_of(pairs[triples] << 21 | c[triples + 2])
        n = 2 * length + 1
        mean = np.add.reduceat(each, starts) / n[:, None] * np.minimum(np.sqrt(n)[:, None], LONGEST)
        first = np.fromiter((ord(w[0]) for w in words), np.int64, len(words))
        script = self.script[np.searchsorted(_FIRST, first, "right") - 1]
        seen = script.any(1)
        mean[seen[:, None] & ~script] = -1e6
        base = self.used
        if base + len(words) > len(self.scores):  # grows by doubling
            more = max(base, len(words)) + CHUNK
            self.scores = np.concatenate([self.scores[:base], np.empty((more, len(m.langs)), np.float32)])
            self.seen = np.concatenate([self.seen[:base], np.empty(more, bool)])
        self.scores[base : base + len(words)], self.seen[base : base + len(words)] = mean, seen
        self.used = base + len(words)
        self.known.update(zip(words, range(base, self.used)))

    def rows_of(self, words: list[str]) -> np.ndarray:
        """The row of `scores` of each word."""
        if len(self.known) > CACHE:
            self.reset()
        k = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(k < 0)
        if len(missing):
            new = list(dict.fromkeys(words[i] for i in missing.tolist()))
            for first in range(0, len(new), CHUNK):
                self.learn(new[first : first + CHUNK])
            k[missing] = np.fromiter((self.known[words[i]] for i in missing.tolist()), np.int64, len(missing))
        return k

    def viterbi(self, rows: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The language of every word; text i has the words up to ends[i].

        A text whose words all have the same best language needs no walk: no
        other path is better. All others are cut into pieces of PIECE words.
        First all pieces walk on together from every language that the word
        before a piece may have, then the pieces of a text are put together,
        then all pieces are walked once more from the language that was found.
        """
        if not len(rows):
            return np.empty(0, np.int64)
        top = self.scores[: self.used].argmax(1)
        labels = top[rows]
        begins = np.concatenate([[0], ends[:-1]])
        full = np.flatnonzero(ends > begins)
        at = begins[full]
        mixed = full[np.minimum.reduceat(labels, at) != np.maximum.reduceat(labels, at)]
        n_langs = len(self.m.langs)
        group = max(1, 8_000_000 // (PIECE * n_langs * n_langs)) * PIECE  # words whose pieces fit in memory
        first = 0
        while first < len(mixed):
            stop, size = first, 0
            while stop < len(mixed) and (stop == first or size + ends[mixed[stop]] - begins[mixed[stop]] <= group):
                size += ends[mixed[stop]] - begins[mixed[stop]]
                stop += 1
            self._walk(rows, begins[mixed[first:stop]], ends[mixed[first:stop]], labels)
            first = stop
        return labels

    def _walk(self, rows: np.ndarray, begins: np.ndarray, ends: np.ndarray, labels: np.ndarray) -> None:
        n_langs, s = len(self.m.langs), self.switch
        pieces = -(-(ends - begins) // PIECE)
        order = np.argsort(-pieces, kind="stable")  # texts of many pieces first
        begins, ends, pieces = begins[order], ends[order], pieces[order]
        offset = np.cumsum(pieces) - pieces
        text = np.repeat(np.arange(len(pieces)), pieces)
        first = begins[text] + (np.arange(len(text)) - offset[text]) * PIECE
        length = np.minimum(ends[text] - first, PIECE)
        steps = int(length.max())
        cells = first + np.arange(steps)[:, None]
        word = np.where(np.arange(steps)[:, None] < length, rows[np.minimum(cells, len(rows) - 1)], 0)  # row 0 changes no path
        value = np.broadcast_to(-s * (1 - np.eye(n_langs, dtype=np.float32)), (len(text), n_langs, n_langs)).copy()
        for t in range(steps):
            if t:
                np.maximum(value, value.max(2, keepdims=True) - s, out=value)
            value += self.scores[word[t]][:, None, :]
        # put the pieces of each text together: the best language before each piece
        start, state = np.zeros((len(text), n_langs), np.int64), np.zeros((len(pieces), n_langs), np.float64)
        for k in range(int(pieces[0])):
            live = int(np.searchsorted(-pieces, -k, "left"))  # pieces is in falling order
            own = offset[:live] + k
            paths = state[:live, :, None] + value[own]
            start[own] = paths.argmax(1)
            state[:live] = np.take_along_axis(paths, start[own][:, None, :], 1)[:, 0]
        end = np.zeros(len(text), np.int64)
        last = state.argmax(1)
        for k in range(int(pieces[0]) - 1, -1, -1):
            live = int(np.searchsorted(-pieces, -k, "left"))
            own = offset[:live] + k
            end[own] = last[:live]
            last[:live] = start[own, last[:live]]
        before = start[np.arange(len(text)), end]
        v = np.full((len(text), n_langs), -s, np.float32)
        v[np.arange(len(text)), before] = 0
        every, came, best = np.arange(len(text)), np.zeros((steps, len(text), n_langs), bool), np.zeros((steps, len(text)), np.int64)
        for t in range(steps):
            if t:
                best[t] = v.argmax(1)
                jump = (v[every, best[t]] - s)[:, None]
                came[t] = v >= jump
                v = np.maximum(v, jump)
            v = v + self.scores[word[t]]
        here = end
        for t in range(steps - 1, -1, -1):
            on = t < length
            labels[first[on] + t] = here[on]
            if t:
                here = np.where(came[t][every, here], here, best[t])

    def label(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """For each text the language of most letters (-1: none), its share of the letters, and the spans."""
        n_texts, n_langs = len(texts), len(self.m.langs)
        whole = "\n".join(texts)
        length = np.fromiter(map(len, texts), np.int64, n_texts)
        offset = np.cumsum(length + 1) - length - 1
        s, e = words_in(code_points(whole)) if n_langs else (np.empty(0, np.int64),) * 2
        rows = self.rows_of([whole[a:b] for a, b in zip(s.tolist(), e.tolist())])
        ends = np.searchsorted(s, offset + length, "left")
        own = self.viterbi(rows, ends)
        text = np.repeat(np.arange(n_texts), np.diff(ends, prepend=0))
        cell = text * n_langs + own
        weight = np.bincount(cell, e - s, minlength=n_texts * n_langs).reshape(n_texts, n_langs)
        counted = np.bincount(cell, (e - s) * self.seen[rows], minlength=n_texts * n_langs).reshape(n_texts, n_langs)
        total = weight.sum(1) if n_langs else np.zeros(n_texts)
        pred = np.where(total > 0, counted.argmax(1), -1) if n_langs else np.full(n_texts, -1)
        share = np.where(total > 0, counted.max(1, initial=0) / np.maximum(total, 1), 0.0) if n_langs else np.zeros(n_texts)
        turn = np.flatnonzero((np.diff(own, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
        stop = np.concatenate([turn[1:], [len(own)]]) - 1 if len(turn) else turn
        names = pa.array(self.m.langs, pa.string()).take(pa.array(own[turn], pa.int64()))
        columns = [names, *(pa.array((x[i] - offset[text[turn]]).astype(np.int32)) for x, i in ((s, turn), (e, stop)))]
        spans = pa.StructArray.from_arrays(columns, ["lang", "start", "end"])
        at = np.searchsorted(text[turn], np.arange(n_texts + 1), "left").astype(np.int32)
        return pred, share, pa.ListArray.from_arrays(pa.array(at), spans)


def steps_of(texts: list[str]) -> Iterator[list[str]]:
    step, size = [], 0
    for t in texts:
        if step and size + len(t) > STEP:
            yield step
            step, size = [], 0
        step.append(t)
        size += len(t)
    if step:
        yield step


def identify(docs: DataFrame, model: Model, text: str = "text", switch: float = SWITCH) -> DataFrame:
    """`docs` with lang_pred, score and spans (array<struct<lang,start,end>>, code points, end exclusive) instead of same-named columns.

    `lang_pred` is the language of most letters (marks of a word count as
    letters) and `score` its share of all of them; ties go to the first
    language by name. Letters of a script that training has not seen count for
    no language: a text of nothing else has score 0. A null text, or one without
    a letter, is `und` with score 0 and no spans. Spans reach from a run's first
    letter to its last. Texts are taken whole, where they are read; repeated
    rows are answered one by one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # most_grams rows of the fit
    made = ["lang_pred", "score", "spans"]
    kept = docs.drop(*made)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields), "lang_pred string, score double, spans array<struct<lang:string,start:int,end:int>>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lab = Labeller(shared.value, switch)
        names = pa.array([*shared.value.langs, UNKNOWN], pa.string())
        for b in batches:
            whole, at = pa.Table.from_batches([b]), 0
            texts = [t or "" for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            for step in steps_of(texts):
                pred, share, spans = lab.label(step)
                out = whole.slice(at, len(step))
                at += len(step)
                found = names.take(pa.array(np.where(pred < 0, len(names) - 1, pred), pa.int64()))
                for name, column in zip(made, (found, pa.array(share, pa.float64()), spans)):
                    out = out.append_column(name, column)
                yield from out.to_batches()

    return kept.mapInArrow(run, schema)
