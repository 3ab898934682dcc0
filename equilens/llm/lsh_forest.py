"""N-gram Jaccard self-join by a MinHash LSH forest with exact verification.

1. Every text becomes a set of word shingles; equal sets form one class and go
   on as one representative with its number of copies.
2. A tree of the forest is a sorted trie over its own part of the signature,
   DEPTH levels of one byte. Subtries below a prefix meet in a task, sorted.
   There matched prefixes start at full depth and are shortened level by level.
3. Members of a matched prefix are compared by the rest of their signatures;
   what can't be excluded at that accuracy is tied together. Pairs that a longer
   prefix has compared or tied aren't compared again. A prefix with many members
   is dealt to several tasks as pairs of blocks.
4. The texts of tied representatives are read once for their shingles, which
   tied groups gather, again in pairs of blocks; every pair is verified exactly.
   A block pair returns each text's number of links and a spanning forest of
   them, never the pairs, and counts the links by the number of trees in which
   they met.
5. The first walk ends at the depth at which a pair at the threshold meets in
   some tree with the target recall: a shallower end can't be excused by easy
   pairs. From the counts the links that no tree has met are estimated; while
   the recall is below the target, prefixes are shortened further.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equilens.llm.common import connected_components, hot_join, removed, written, written_at
from equilens.llm.shingles import Shingler, fingerprint, minhash

log = logging.getLogger(__name__)
TREES = 24
DEPTH = 8
RECALL = 0.9995
#: Members of one block; two blocks meet in a task.
BLOCK = 256
#: Standard deviations below the threshold at which an estimate excludes a pair.
SLACK = 4.5


def prefix_depth(threshold: float, trees: int, deepest: int, recall: float) -> int:
    """The longest prefix for which 1 - (1 - s^d)^trees reaches the recall at s = threshold: no walk may end above it."""
    for d in range(deepest, 0, -1):
        if 1 - (1 - threshold**d) ** trees >= recall:
            return d
    raise ValueError("no prefix reaches this recall: use more trees")


def signatures(docs: DataFrame, key: str, text: str, size: int, trees: int) -> DataFrame:
    """(key, fp, bits binary): DEPTH bytes for each tree, its key in sorted order; null fp and bits for a text without words."""
    kept = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    key_type = kept.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(size)
        for b in batches:
            sets = [shingle(t) for t in b.column("text").to_pylist()]
            full = [i for i, s in enumerate(sets) if len(s)]
            fps, bits = [None] * len(sets), [None] * len(sets)
            if full:
                low = (minhash([sets[i] for i in full], trees * DEPTH) & np.uint64(255)).astype(np.uint8)
                for k, i in enumerate(full):
                    fps[i], bits[i] = fingerprint(sets[i]), low[k].tobytes()
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(fps, pa.binary()), pa.array(bits, pa.binary())], ["key", "fp", "bits"])

    return kept.mapInArrow(run, f"key {key_type}, fp binary, bits binary")


def shingled(texts: DataFrame, size: int) -> DataFrame:
    """`texts` with `shingles` (sorted 64-bit hashes) instead of `text`, and only those whose shingles have the fingerprint `fp`."""
    rest = [f for f in texts.schema.fields if f.name not in ("text", "fp")]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rest), "shingles binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(size)
        for b in batches:
            sets = [shingle(t) for t in b.column("text").to_pylist()]
            same = np.flatnonzero([fingerprint(s) == fp for s, fp in zip(sets, b.column("fp").to_pylist())])
            part = b.select([f.name for f in rest]).take(pa.array(same, pa.int64()))
            made = pa.array([sets[i].tobytes() for i in same.tolist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns, made], [*part.schema.names, "shingles"])

    return texts.mapInArrow(run, schema)


def prefixes(hashes: DataFrame, trees: int, depth: int) -> DataFrame:
    """(id, tree, bucket): the roots at `depth` of the subtries in which a text lies, by a hash."""
    each = (F.struct(F.lit(t).alias("tree"), F.xxhash64(F.lit(t), F.substring("bits", t * DEPTH + 1, depth)).alias("bucket")) for t in range(trees))
    return hashes.select("id", F.inline(F.array(*each)))


def tree_keys(bits: np.ndarray) -> np.ndarray:
    """The key in each tree, one column for a tree; keys with a common prefix follow each other in their order."""
    return np.ascontiguousarray(bits).view(">u8").astype(np.uint64)


def recall_of(met: dict[int, int], trees: int) -> float:
    """Estimated share of the links that some tree has met, from the numbers of links met in 0, 1, 2 and more trees.

    Links met in no tree are those verified by way of others, or as many as
    Chao's estimator expects from those met once and twice, if that is more.
    """
    n = [met.get(i, 0) for i in range(4)]
    unseen = max(n[0], (trees - 1) / trees * n[1] * (n[1] - 1) / (2 * (n[2] + 1)))
    return sum(n[1:]) / (sum(n[1:]) + unseen) if sum(n) else 1.0


def in_blocks(rows: DataFrame, group: str, size: str, block: int = BLOCK) -> DataFrame:
    """Adds (_i, _j, _block): a row meets every block of its group, its own included.

    `size` is the number of rows in the group. A row belongs to block `_block`
    by a hash of its id; it is sent to the tasks of all block pairs with it. A
    group of at most `block` rows is one block and isn't multiplied.
    """
    n = F.ceil(F.col(size) / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64(F.lit("block"), "id"), n).cast("int")
    partner = F.explode(F.sequence(F.lit(0), n - 1)).alias("_other")
    return rows.select("*", own.alias("_block"), partner).select(*rows.columns, "_block", F.least("_block", "_other").alias("_i"), F.greatest("_block", "_other").alias("_j"))


def _runs(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    at = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
    return zip([0, *at.tolist()], [*at.tolist(), len(keys)])


def _by_group(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[pa.Table]:
    """Tables of whole groups from sorted batches; a group's rows follow each other. Many small groups share a table."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        if held:
            last = [held[-1].column(c)[-1] for c in columns]
            keys = [b.column(c).to_numpy(zero_copy_only=False) for c in columns]
            same = np.logical_and.reduce([k == x.as_py() for k, x in zip(keys, last)])
            head = len(same) if same.all() else int(np.argmin(same))
            if head:
                held.append(b.slice(0, head))
            if head == b.num_rows:
                continue
            yield pa.Table.from_batches(held)
            held = []
            b = b.slice(head)
        # the last group may go on in the next batch
        keys = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in columns], 1)
        differs = np.flatnonzero(np.any(keys != keys[-1], axis=1))
        cut = int(differs[-1]) + 1 if len(differs) else 0
        if cut:
            yield pa.Table.from_batches([b.slice(0, cut)])
        held = [b.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def _forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node of its component, given the edges."""
    root = np.arange(n)
    while True:
        least = root.copy()
        np.minimum.at(least, left, root[right])
        np.minimum.at(least, right, root[left])
        least = least[least]
        if (least == root).all():
            return root
        root = least


def walk(bits: np.ndarray, key: np.ndarray, depth: int, floor: int) -> np.ndarray:
    """For each member of a subtrie the first one that it is tied with, prefixes being shortened from DEPTH to `depth`.

    Two members are compared once, at their longest common prefix, and only if they aren't tied by then.
    """
    order = np.argsort(key, kind="stable")
    x, k = bits[order], key[order]
    comp, longer = np.arange(len(k)), None
    for d in range(DEPTH, depth - 1, -1):
        prefix = k >> np.uint64(8 * (DEPTH - d))
        for s, e in _runs(prefix[:, None]):
            if e - s < 2 or (longer is not None and longer[s] == longer[e - 1]):
                continue
            for i in range(s, e - 1):
                new = comp[i + 1 : e] != comp[i]
                if longer is not None:
                    new &= longer[i + 1 : e] != longer[i]
                at = np.flatnonzero(new) + i + 1
                hit = at[(x[at] == x[i]).sum(1) >= floor]
                if len(hit):
                    comp[np.isin(comp, comp[hit])] = comp[i]
        longer = prefix
    root = np.empty(len(k), np.int64)
    least = np.full(len(k), len(k))
    np.minimum.at(least, comp, order)
    root[order] = least[comp]
    return root


def tie(members: DataFrame, threshold: float, perms: int, depth: int) -> DataFrame:
    """(a, b): spanning edges between members of a prefix whose signatures may belong to a pair at the threshold.

    `members` has (bucket, tree, _i, _j, _block, id, bits).
    """
    chance = threshold + (1 - threshold) / 256
    floor = int(np.floor(perms * chance - SLACK * np.sqrt(perms * chance * (1 - chance))))
    id_type = members.schema["id"].dataType.simpleString()
    dealt = members.repartition(F.col("bucket"), F.col("_i"), F.col("_j")).sortWithinPartitions("bucket", "_i", "_j", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_group(batches, ("bucket", "_i", "_j")):
            keys = np.stack([t.column(c).to_numpy() for c in ("bucket", "_i", "_j")], 1)
            bits = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint8).reshape(-1, perms)
            tree = t.column("tree").to_numpy()
            ids, out_a, out_b = t.column("id").to_pylist(), [], []
            for s, e in _runs(keys):
                if e - s < 2:
                    continue
                if e - s == 2:
                    if int((bits[s] == bits[s + 1]).sum()) >= floor:
                        out_a.append(ids[s]), out_b.append(ids[s + 1])
                    continue
                root = walk(bits[s:e], tree_keys(bits[s:e, DEPTH * tree[s] : DEPTH * (tree[s] + 1)])[:, 0], depth, floor)
                for i in np.flatnonzero(root != np.arange(e - s)).tolist():
                    out_a.append(ids[s + i]), out_b.append(ids[s + root[i]])
            yield pa.RecordBatch.from_arrays([pa.array(out_a, t.schema.field("id").type), pa.array(out_b, t.schema.field("id").type)], ["a", "b"])

    return dealt.mapInArrow(run, f"a {id_type}, b {id_type}").distinct()


def _common(sets: list[np.ndarray], rows: int) -> np.ndarray:
    """Sizes of the intersections of the first `rows` sets with all sets."""
    n = len(sets)
    if n <= 6:
        out = np.zeros((rows, n), np.int64)
        for i in range(rows):
            for j in range(n):
                at = np.minimum(np.searchsorted(sets[j], sets[i]), len(sets[j]) - 1)
                out[i, j] = int((sets[j][at] == sets[i]).sum())
        return out
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, word, count = np.unique(flat, return_inverse=True, return_counts=True)
    keep = count[word] > 1
    word, owner = word[keep], owner[keep]
    out = np.zeros((rows, n), np.float32)
    if not len(word):
        return out.astype(np.int64)
    _, word = np.unique(word, return_inverse=True)
    order = np.argsort(word, kind="stable")
    word, owner = word[order], owner[order]
    width = max(64, 4_000_000 // n)
    for first in range(0, int(word[-1]) + 1, width):
        s, e = np.searchsorted(word, (first, first + width))
        m = np.zeros((n, width), np.float32)
        m[owner[s:e], word[s:e] - first] = 1
        out += m[:rows] @ m.T
    return out.astype(np.int64)


def verify(members: DataFrame, threshold: float, depth: int) -> DataFrame:
    """(a, b, links, met, depth): rows (a, root, 0) are spanning edges, rows (a, null, links) a text's links in this block pair.

    Rows (null, null, links, met, d) count the links by the number of trees (3: or more) in which they share a prefix of
    d, for all d up to `depth`. `members` has (comp, _i, _j, _block, id, copies, prev, bits, shingles); an id that is
    repeated counts once, and pairs with the same `prev` (but -1) were verified before.
    """
    id_type = members.schema["id"].dataType.simpleString()
    dealt = members.repartition(F.col("comp"), F.col("_i"), F.col("_j")).sortWithinPartitions("comp", "_i", "_j", "_block", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_group(batches, ("comp", "_i", "_j")):
            keys = np.stack([t.column(c).to_numpy() for c in ("comp", "_i", "_j", "id")], 1)
            once = np.concatenate([[True], np.any(keys[1:] != keys[:-1], axis=1)])
            if not once.all():
                t, keys = t.filter(pa.array(once)), keys[once]
            keys = keys[:, :3]
            blocks, copies, prev = (t.column(c).to_numpy() for c in ("_block", "copies", "prev"))
            ids, shingles = t.column("id"), t.column("shingles")
            bits = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint8).reshape(t.num_rows, -1)
            a, b, links, seen = [], [], [], np.zeros((depth, 4), np.int64)
            for s, e in _runs(keys):
                if e - s < 2:
                    continue
                sets = [np.frombuffer(x, np.uint64) for x in shingles.slice(s, e - s).to_pylist()]
                own = ids.slice(s, e - s).to_pylist()
                n = np.array([len(x) for x in sets])
                twin = int((blocks[s:e] == keys[s, 1]).sum()) if keys[s, 1] != keys[s, 2] else e - s
                common = _common(sets, twin)
                near = common >= threshold * (n[:twin, None] + n[None, :] - common) - 1e-9
                if twin < e - s:  # two different blocks: only pairs across them
                    near[:, :twin] = False
                else:
                    near[np.arange(twin), np.arange(twin)] = False
                before = prev[s:e]
                near &= (before[:twin, None] != before[None, :]) | (before[None, :] < 0)
                c = copies[s:e]
                got = np.zeros(e - s, np.int64)
                got[:twin] += near @ c
                if twin < e - s:
                    got += near.T @ c[:twin]
                left, right = np.nonzero(near)
                root = _forest(e - s, left, right)
                if len(left):
                    key = tree_keys(bits[s:e])
                    once = left < right  # a single block has each pair twice
                    for d in range(depth):
                        prefix = key >> np.uint64(8 * (DEPTH - d - 1))
                        seen[d] += np.bincount(np.minimum((prefix[left[once]] == prefix[right[once]]).sum(1), 3), minlength=4)
                for i in np.flatnonzero(got).tolist():
                    a.append(own[i]), b.append(None), links.append(int(got[i]))
                for i in np.flatnonzero(root != np.arange(e - s)).tolist():
                    a.append(own[i]), b.append(own[root[i]]), links.append(0)
            kind, counts = t.schema.field("id").type, list(np.ndindex(depth, 4))
            met, at = [None] * len(a) + [m for _, m in counts], [None] * len(a) + [d + 1 for d, _ in counts]
            a, b, links = a + [None] * len(counts), b + [None] * len(counts), links + seen.ravel().tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind), pa.array(links, pa.int64()), pa.array(met, pa.int32()), pa.array(at, pa.int32())], ["a", "b", "links", "met", "depth"])

    return dealt.mapInArrow(run, f"a {id_type}, b {id_type}, links long, met int, depth int")


def similarity_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8, size: int = 5, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """The classes of `classes_and_recall`; a recall that stays below the target is logged."""
    return classes_and_recall(docs, key, text, threshold, size, trees, recall)[0]


def classes_and_recall(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8, size: int = 5, trees: int = TREES, recall: float = RECALL) -> tuple[DataFrame, float]:
    """(key, class_id, n_links), one row for each row of `docs`, and the estimated recall.

    Two rows are linked if the Jaccard similarity of their shingle sets is at
    least `threshold`; `n_links` counts the other rows that a row is linked
    with, copies included, and `class_id` is the least key that links lead to
    (its own key without any). A null text counts as empty; a text without
    words links with nothing, one of fewer than `size` words is one shingle.
    `key` may be of any type that has an order; rows that share a key are rows
    of their own, and a null key is less than none: a class of null keys only
    has the id null. An empty table gives no rows.

    Prefixes are shortened until the estimated recall reaches `recall`, at most
    to one level; if it is lower then, the figure that is returned says so.
    After a shortening only pairs that were never in one component before are
    verified, and only texts of components that have grown are read again.
    """
    spark = docs.sparkSession
    depth = prefix_depth(threshold, trees, DEPTH, recall)
    perms = trees * DEPTH
    sig = written(signatures(docs, key, text, size, trees), "signatures")
    sets = sig.where("fp IS NOT NULL").groupBy("fp").agg(F.min("key").alias("key"), F.count("*").alias("copies"), F.first("bits").alias("bits"))
    reps, reps_at = written_at(sets.withColumn("id", F.monotonically_increasing_id()), "representatives")  # ids are those of the written rows
    hashes, rows, n_reps = reps.select("id", "bits"), sig.count(), reps.count()
    texts = docs.select(F.col(key).alias("_key"), F.col(text).alias("text"))
    prev, spent, checked = None, [reps_at], None
    while True:
        roots = prefixes(hashes, trees, depth)
        shared = roots.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
        met = hot_join(roots, shared, "bucket", "members", trees * n_reps)
        found, found_at = connected_components(tie(in_blocks(met, "bucket", "members").join(hashes, "id"), threshold, perms, depth))
        comps = found.select("id", F.col("component").alias("comp"))
        known = comps.join(prev, "id", "left") if prev is not None else comps.withColumn("prev", F.lit(None).cast("long"))
        known = known.withColumn("prev", F.coalesce("prev", F.lit(-1)))
        grown = (F.min("prev") < 0) | (F.min("prev") < F.max("prev"))
        sizes = known.groupBy("comp").agg(F.count("*").alias("members"), grown.alias("grown")).where("grown").drop("grown")
        own = hot_join(known, sizes, "comp", "members", comps.count()).join(reps, "id")
        read = shingled(own.join(texts, F.col("key").eqNullSafe(F.col("_key"))).drop("key", "_key"), size)
        part, part_at = written_at(verify(in_blocks(read, "comp", "members"), threshold, depth), "verified")
        checked = part if checked is None else checked.unionByName(part)
        spent += [found_at, part_at]
        seen = {r.met: r.links for r in checked.where(F.col("depth") == depth).groupBy("met").agg(F.sum("links").alias("links")).collect()}  # four rows
        reached = recall_of(seen, trees)
        if depth == 1 or reached >= recall:
            break
        depth, prev = depth - 1, comps.select("id", F.col("comp").alias("prev"))
    if reached < recall:
        log.warning("the estimated recall is %.4f, below the target of %.4f", reached, recall)
    links = checked.where("a IS NOT NULL AND b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    linked, linked_at = connected_components(checked.where("b IS NOT NULL").select("a", "b"))
    classes = linked.join(reps.select("id", "key"), "id").groupBy("component").agg(F.min("key").alias("class_id"), F.count("*").alias("members"))
    named = hot_join(linked, classes, "component", "members", linked.count()).select("id", "class_id")
    per_rep = reps.select("id", "fp", "key", "copies").join(links, "id", "left").join(named, "id", "left")
    n_links = (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long")
    per_rep = written(per_rep.select("fp", F.coalesce("class_id", "key").alias("class_id"), n_links.alias("n_links"), "copies"), "classes")
    removed(spark, *spent, linked_at)  # the result reads signatures and classes alone
    joined = hot_join(sig.select("key", "fp"), per_rep, "fp", "copies", rows, "left")
    return joined.select(F.col("key").alias(key), F.coalesce("class_id", "key").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), reached


def one_of_each(docs: DataFrame, classes: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of `docs` whose class bears their own key; rows that share this key all stay, those with a null key go."""
    return docs.join(classes.where(F.col("class_id") == F.col(key)).select(key), key, "left_semi").select(*docs.columns)
