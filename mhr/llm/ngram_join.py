"""Operator 3: exact Jaccard self-join of documents over their sets of word n-grams, by PartEnum signatures.

Size bands.  Band c holds the sets of L_c <= size < L_{c+1} (its home sets); a set also takes part in every lower
band that holds sizes down to threshold * size, so any two similar sets meet in the band of the smaller one.

Signatures.  Two sets of sizes a and b with Jaccard >= t differ in at most k = (1-t)/(1+t) * (a+b) n-grams.  Every band
cuts the hash domain into the same partitions, in n1 groups of n2, and enumerates subsets of the partitions of a group.
* Small k (ENUMERATE at most): n1 is 1 or 2, and in some group at most k2 = k // n1 partitions differ; each subset of 3 of
  its k2 + 3 partitions makes a signature, so one subset agrees.
* Larger k: n1 groups of one partition, each a signature (the subsets of size one); at least n1 - k agree.
  Signatures are ordered by how many n-grams they hold, which is the same for both sets where they agree, and by the
  prefix principle two sets share l of the first k + l of each: poor partitions are not sent at all, and pairs
  that share fewer than l signatures (LEVEL, or what the band allows) aren't looked at.  The low bits of a signature hold l.
* A signature of empty partitions only says nothing and would be shared by unlike sets, so it isn't sent.  Both sets of a
  pair that meets there alone know it, and either is cut again by the next of SEEDS hash functions.  The last one sends
  its empty partitions too: the join is exact at every threshold, and no signature is hot for thresholds of 0.75 and more.
All are exact; there is no cap on bucket sizes, candidates or partners.

Clusters.  Sets that share ROWS min-hashes in one of GROUPS groups are linked, and connected sets make a cluster.  Pairs
inside a cluster are all compared where the cluster's texts are brought together, a tile of TILE x TILE sets at a time;
signatures need only find the pairs between clusters.  So the many pairs of a large group of copies are never shuffled as
candidates, nor, for classes, as results: a tile gives a spanning forest of its links and each set's number of them.
Clusters decide where a pair is found, not whether.  Equal sets (64-bit digests) are one node, however many have it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import combinations
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed_text, mix, split_words, stored, text_chunks, words

N, THRESHOLD = 2, 0.8
RATIO, ENUMERATE, LEVEL, SEEDS, LARGEST = 1.6, 7, 3, 16, 1 << 40
#: Rows of signatures for one task, candidate pairs for one verification task, rows of two or three numbers that are broadcast.
SIGNATURES, PAIRS, BROADCAST = 2_000_000, 20_000, 500_000
GROUPS, ROWS, TILE, TEXTS = 8, 6, 1500, 4000

_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_LOW, _32 = np.uint64(0xFFFFFFFF), np.uint64(32)


def bands() -> np.ndarray:
    out = [1]
    while out[-1] < LARGEST:
        out.append(max(out[-1] + 1, ceil(out[-1] * RATIO)))
    return np.array(out)


BANDS = bands()


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct n-gram hashes of one text; a text of fewer than n words is a single n-gram."""
    n = min(n, len(h))
    if not n:
        return h
    g = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        g = g * _C1 + mix(h[i : len(h) - n + 1 + i] + _C2)
    g = np.sort(mix(g + np.uint64(n)))
    return g[np.append(True, g[1:] != g[:-1])]


def node_of(g: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(g.tobytes(), digest_size=8).digest(), "little", signed=True)


def _most(size: int, top: int, t: float) -> int:
    """How many n-grams a set of `size` and a partner of at most `top` may differ in."""
    largest = min(top, int(size / t + 1e-9))
    return int((1 - t) / (1 + t) * (size + largest) + 1e-9)


def signatures(g: np.ndarray, t: float) -> np.ndarray:
    """The signatures of one sorted set of n-gram hashes, over all bands in which it takes part."""
    size, out = len(g), []
    home = int(np.searchsorted(BANDS, size, "right")) - 1
    lowest = int(np.searchsorted(BANDS, max(1, ceil(t * size - 1e-9)), "right")) - 1
    for c in range(lowest, home + 1):
        low, high = int(BANDS[c]), int(BANDS[c + 1]) - 1  # the smaller of a pair is a home set
        limit = _most(high, LARGEST, t)
        if not limit:
            continue  # here only equal sets are similar, and equal sets are one node
        groups = 0 if limit > ENUMERATE else 1 if limit <= 4 else 2
        width = limit // groups + 3 if groups else 1
        n = groups * width or max(limit + 2, ceil(low * 0.5))
        top = high if size > high else LARGEST  # a set above the band has its partners in it
        level = 1 if groups else min(LEVEL, n - limit)
        keep = min(n, _most(size, top, t) + level)
        for seed in range(SEEDS):
            x = mix(g + np.uint64(c + 1 + (seed << 32)))
            part = (((x >> _32) * np.uint64(n)) >> _32).astype(np.int64)
            y = mix(x ^ _C2)
            count = np.bincount(part, minlength=n)
            a = np.bincount(part, (y & _LOW).astype(float), n).astype(np.uint64)
            b = np.bincount(part, (y >> _32).astype(float), n).astype(np.uint64)
            h = mix((a ^ (b << np.uint64(22))) * _C1 + b + mix(np.arange(n, dtype=np.uint64) + np.uint64((c << 40) + (seed << 50))))
            if groups:
                sets = _subsets(groups, width)
                full, h = count[sets].any(1), mix(h[sets].sum(1))
            else:
                order = (count.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20))
                first = np.argpartition(order, n - keep)[n - keep :]
                full, h = count[first] > 0, h[first]
            done = bool(full.all())
            if not done and seed + 1 < SEEDS:
                h = h[full]
            out.append((h << np.uint64(2)) | np.uint64(level))
            if done:
                break
    return np.concatenate(out) if out else np.empty(0, np.uint64)


@cache
def _subsets(groups: int, width: int) -> np.ndarray:
    """Each subset of 3 partitions of a group."""
    return np.array([[g * width + i for i in s] for g in range(groups) for s in combinations(range(width), 3)])


def _sets(batches: Iterator[pa.RecordBatch], n: int, also: str | None = None) -> Iterator[tuple]:
    """(id, or (id, value of the column `also`); set) of each text with a word."""
    for batch in batches:
        ids = batch.column(0).to_pylist()
        if also:
            ids = list(zip(ids, batch.column(batch.schema.get_field_index(also)).to_pylist()))
        for lo, hi, buf, offs in text_chunks(batch, "text"):
            h, _, _, ptr = words(buf, offs)
            for i in range(hi - lo):
                if ptr[i + 1] > ptr[i]:
                    yield ids[lo + i], grams(h[ptr[i] : ptr[i + 1]], n)


_ODD = mix(np.arange(1, GROUPS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def cluster_keys(g: np.ndarray) -> np.ndarray:
    """A key for each group of min-hashes; long sets a piece at a time, to bound memory."""
    least = np.full(GROUPS * ROWS, ~np.uint64(0))
    for i in range(0, len(g), 4096):
        x = g[i : i + 4096, None] * _ODD
        least = np.minimum(least, (x ^ (x >> np.uint64(29))).min(0))
    least = mix(least).reshape(GROUPS, ROWS)
    return mix((least * mix(np.arange(ROWS, dtype=np.uint64) + _C1)).sum(1) + np.arange(GROUPS, dtype=np.uint64)).view(np.int64)


_KEYS = [f"k{i}" for i in range(GROUPS)]


def _nodes(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, row, node_of(g), len(g), *cluster_keys(g).tolist()) for (i, row), g in _sets([batch], n, "row")]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], ["doc_id", "row", "node", "size", *_KEYS])

    return run


def _signed(n: int, t: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, nodes, labels, held = [], [], [], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (sigs, nodes, labels)], ["sig", "node", "label"])

        for (_, label), g in _sets(batches, n, "label"):
            s = signatures(g, t)
            if len(s):
                sigs.append(s)
                nodes.append(np.full(len(s), node_of(g), np.int64).view(np.uint64))
                labels.append(np.full(len(s), label or 0, np.int64).view(np.uint64))
                held += len(s)
            if held > 100_000:
                yield out()
                sigs, nodes, labels, held = [], [], [], 0
        if held:
            yield out()

    return run


def _collide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of nodes that share signatures of this partition, each once, with how many and the least level."""
    got = [tuple(c.to_numpy() for c in b.columns) for b in batches]
    if not got:
        return
    sig, node, label = (np.concatenate(x) for x in zip(*got))
    del got
    order = np.argsort(sig)
    sig, node, label = sig[order], node[order], label[order]
    edge = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
    size, level = np.diff(np.append(edge, len(sig))), sig[edge] & 3
    apart = lambda x, y: (label[x] != label[y]) | (label[x] == 0)
    two = edge[size == 2]
    ok = apart(two, two + 1)
    two = two[ok]
    found, held = [_pairs(np.minimum(node[two], node[two + 1]), np.maximum(node[two], node[two + 1]), level[size == 2][ok])], 0
    for lo, k, l in zip(edge[size > 2], size[size > 2], level[size > 2]):
        _, at = np.unique(node[lo : lo + k], return_index=True)
        at += lo
        if len(at) > 1 and label[at[0]] and (label[at] == label[at[0]]).all():
            continue
        for i in range(len(at) - 1):  # a row of the pair triangle at a time
            more = at[i + 1 :][apart(at[i], at[i + 1 :])]
            found.append(_pairs(np.full(len(more), node[at[i]]), node[more], l))
            held += len(more)
            if held > 2_000_000:
                found, held = [_counted(found)], 0
    pairs = _counted(found)
    for i in range(0, pairs.shape[1], 200_000):
        yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 200_000]) for x in pairs], ["a", "b", "n", "level"])


def _pairs(a: np.ndarray, b: np.ndarray, level) -> np.ndarray:
    return np.stack([a, b, np.ones(len(a), np.int64), np.broadcast_to(level, a.shape)])


def _counted(found: list[np.ndarray]) -> np.ndarray:
    p = np.concatenate(found, axis=1)
    p = p[:, p[0] != p[1]]
    p = p[:, np.lexsort((p[1], p[0]))]
    if not p.shape[1]:
        return p
    at = np.flatnonzero(np.append(True, (p[:2, 1:] != p[:2, :-1]).any(0)))
    return np.stack([p[0, at], p[1, at], np.add.reduceat(p[2], at), np.minimum.reduceat(p[3], at)])


def _verify(n: int, t: float):
    def run(key, texts: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        sets, held = {}, {}
        batch = pa.RecordBatch.from_pydict({"w": texts["w"].to_numpy(), "text": pa.array(texts["text"], pa.string())})
        for w, g in _sets([batch], n):
            sets[node_of(g)], held[node_of(g)] = g, w
        out = []
        for a, b in zip(pairs["a"].to_numpy(), pairs["b"].to_numpy()):
            x, y = sets[a], sets[b]
            if len(x) > len(y):
                x, y = y, x
            if len(x) < t * len(y) - 1e-9:
                continue
            at = np.searchsorted(y, x)
            at[at == len(y)] = 0
            both = int((y[at] == x).sum())
            j = both / (len(x) + len(y) - both)
            if j >= t - 1e-12:
                out.append((a, b, j, held[b], held[a]))
        return pd.DataFrame(out, columns=_COLUMNS).astype(dict(zip(_COLUMNS, ("int64", "int64", "float64", "int64", "int64"))))

    return run


_COLUMNS, _SCHEMA = ["a", "b", "jaccard", "links", "back"], "a bigint, b bigint, jaccard double, links bigint, back bigint"


def _inside(n: int, t: float, every: bool):
    """Links in a task's tiles: rows (label, i, j, c, w, text), c being the chunk of the set, i or j, and w its documents.

    With `every`, all similar pairs.  Else (a, b) of a spanning forest of them, and for each set a row a = b with the
    documents that it is linked to in the tile.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, i, j), part in pdf.groupby(["label", "i", "j"], sort=False):
            batch = pa.RecordBatch.from_pydict({"c": pa.array(part["c"], pa.int64()), "w": pa.array(part["w"], pa.int64()), "text": pa.array(part["text"], pa.string())})
            found = {node_of(g): (c, w, g) for (c, w), g in _sets([batch], n, "w")}
            nodes = sorted(found)
            chunk, held, size = (np.array([x(found[v]) for v in nodes]) for x in (lambda f: f[0], lambda f: f[1], lambda f: len(f[2])))
            names = np.array(nodes, np.int64)
            distinct, flat = np.unique(np.concatenate([found[v][2] for v in nodes]), return_inverse=True)
            ptr, mark = np.append(0, np.cumsum(size)), np.zeros(len(distinct), np.int64)
            links, tree = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
            for x in range(len(nodes) - 1):
                mark[flat[ptr[x] : ptr[x + 1]]] = 1
                both = np.add.reduceat(mark[flat[ptr[x + 1] :]], ptr[x + 1 : -1] - ptr[x + 1])
                mark[flat[ptr[x] : ptr[x + 1]]] = 0
                jac = both / (size[x] + size[x + 1 :] - both)
                hit = x + 1 + np.flatnonzero((jac >= t - 1e-12) & ((i == j) | (chunk[x] != chunk[x + 1 :])))
                links[x] += held[hit].sum()
                links[hit] += held[x]
                if not every:
                    trees, at = np.unique(tree[hit], return_index=True)
                    hit = hit[at[trees != tree[x]]]
                    tree[np.isin(tree, trees)] = tree[x]
                if len(hit):
                    out.append((np.full(len(hit), names[x]), names[hit], jac[hit - x - 1], np.zeros(len(hit), np.int64), np.zeros(len(hit), np.int64)))
            if not every:
                at = np.flatnonzero(links)
                out.append((names[at], names[at], np.ones(len(at)), links[at], np.zeros(len(at), np.int64)))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, x) for x in (np.int64, np.int64, float, np.int64, np.int64)]
        return pd.DataFrame(dict(zip(_COLUMNS, cols)))

    return run


def row_key(doc_id: Column, text: Column) -> Column:
    """Tells rows apart: rows of one key repeat each other."""
    return F.xxhash64(doc_id.cast("bigint"), text.cast("string"))


def _docs_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, row): row tells texts of one id apart."""
    return keyed_text(docs, id_col, text_col).where("doc_id is not null and text is not null").withColumn("row", row_key(F.col("doc_id"), F.col("text")))


def _small(side: DataFrame) -> DataFrame:
    """A stored side of a join: broadcast up to BROADCAST rows, beyond it hashed in a shuffle."""
    return F.broadcast(side) if side.count() <= BROADCAST else side.hint("shuffle_hash")


def clusters(nodes: DataFrame) -> DataFrame:
    """(node, label), stored: nodes that share a key are linked; connected nodes have one label, those alone none."""
    keys = nodes.select("node", F.explode(F.array(*_KEYS)).alias("key"))
    shared = stored(keys.groupBy("key").agg(F.min("node").alias("u"), F.max("node").alias("last")).where("u < last").select("key", "u"), "shared")
    edges = keys.join(_small(shared), "key").where("node <> u").select("u", F.col("node").alias("v"))
    # Labels are node ids, which are hashes; 0 stands for none.
    return stored(components(edges).select(F.col("id").alias("node"), F.when(F.col("root") == 0, 1).otherwise(F.col("root")).alias("label")), "clusters")


def _links(docs: DataFrame, n: int, t: float, id_col: str, text_col: str, every: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, nodes, links), all stored.  members(doc_id, row, node) are the rows with a word; nodes(node, rep, row, w) the
    distinct sets, rep the least of their w documents and row one of it; links(a, b, jaccard, links, back) as `_inside` has
    them, and all similar pairs between clusters, with the documents that a and b have from it."""
    texts = _docs_of(docs, id_col, text_col)
    longs = ", ".join(f"{c} bigint" for c in ("doc_id", "row", "node", "size", *_KEYS))
    marked = stored(texts.mapInArrow(_nodes(n), longs), "marked")
    again = stored(marked.groupBy("row").count().where("count > 1").select("row"), "repeated")
    if not again.isEmpty():  # of repeated rows one text is read
        texts = texts.join(_small(again), "row", "left_anti").unionByName(texts.join(_small(again), "row", "left_semi").dropDuplicates(["row"]))
    nodes = stored(marked.groupBy("node").agg(F.min("doc_id").alias("rep"), F.min_by("row", "doc_id").alias("row"), F.count_distinct("doc_id").alias("w"), F.min("size").alias("size"), *(F.min(k).alias(k) for k in _KEYS)), "nodes")
    total, = nodes.agg(F.sum(F.col("size"))).first()
    label = clusters(nodes)
    known = stored(nodes.join(label, "node").select("label", "row", "w"), "known")
    # Of the rows that have a set together only one is signed; label -1 marks the others.
    spare = marked.join(nodes.where("w > 1").select("node", F.col("row").alias("own")), "node").where("row <> own").select("row", F.lit(-1).cast("bigint").alias("label"))
    labels = stored(known.select("row", "label").unionByName(spare.distinct()), "labels")
    found = _between(texts, labels, nodes, total or 0, n, t).unionByName(_within(texts, known, n, t, every))
    return marked.select("doc_id", "row", "node"), nodes, stored(found, "links")


def _within(texts: DataFrame, known: DataFrame, n: int, t: float, every: bool) -> DataFrame:
    """Links inside clusters."""
    sized = known.join(known.groupBy("label").agg(F.ceil(F.count("*") / F.lit(TILE)).alias("k")), "label").withColumn("c", F.pmod(F.xxhash64("row"), F.col("k")))
    other = sized.select("label", "row", "w", "c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1)).alias("d"))
    tiles = stored(other.select("label", "row", "w", "c", F.least("c", "d").alias("i"), F.greatest("c", "d").alias("j")), "tiles")
    tasks = max(1, ceil(tiles.count() / TEXTS))
    tiles = tiles.withColumn("task", F.pmod(F.xxhash64("label", "i", "j"), F.lit(tasks)))
    return texts.join(_small(tiles), "row").select("task", "label", "i", "j", "c", "w", "text").groupBy("task").applyInPandas(_inside(n, t, every), _SCHEMA)


def _between(texts: DataFrame, labels: DataFrame, nodes: DataFrame, total: int, n: int, t: float) -> DataFrame:
    """Similar pairs of which no cluster holds both."""
    width = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    signed = texts.join(_small(labels), "row", "left").where("label is null or label <> -1").mapInArrow(_signed(n, t), "sig bigint, node bigint, label bigint")
    pairs = signed.repartition(max(width, ceil(total * 0.4 / SIGNATURES)), "sig").mapInArrow(_collide, "a bigint, b bigint, n bigint, level bigint")
    pairs = stored(pairs.groupBy("a", "b").agg(F.sum("n").alias("n"), F.min("level").alias("level")).where("n >= level").select("a", "b"), "candidates")
    count = pairs.count()
    # A pair goes to the task of the least neighbour of its first node, so that a group's texts are sent about once.
    least = pairs.groupBy("a").agg(F.min("b").alias("least_b")).join(pairs.groupBy(F.col("b").alias("a")).agg(F.min(F.col("a")).alias("least_a")), "a", "full")
    label = least.select("a", F.least("a", F.coalesce("least_a", "a"), F.coalesce("least_b", "a")).alias("label"))
    tasks = max(1, ceil(count / PAIRS))
    labelled = stored(pairs.join(label, "a"), "labelled")
    wide = labelled.groupBy("label").agg(F.ceil(F.count("*") / F.lit(4 * PAIRS)).alias("wide"))
    keyed = labelled.join(wide, "label")
    keyed = stored(keyed.select("a", "b", F.pmod(F.xxhash64("label", F.pmod(F.xxhash64("a"), F.col("wide"))), F.lit(tasks)).alias("task")), "tasks")
    need = stored(keyed.select("task", F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "row", "w"), "node").select("task", "row", "w"), "need")
    sent = texts.join(_small(need), "row").select("task", "w", "text")
    return sent.groupBy("task").cogroup(keyed.select("a", "b", F.col("task").alias("at")).groupBy("at")).applyInPandas(_verify(n, t), _SCHEMA)


def ngram_jaccard_join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_a, doc_b, jaccard): all pairs of different sets of word n-grams with Jaccard >= threshold, each set named by the
    least document that has it (doc_a < doc_b).  `memberships` says which documents have which set, and `expand_pairs`
    makes pairs of all documents of both.  Runs jobs while the result is built.

    Words are lower-cased runs of ASCII letters, digits and non-ASCII characters.  A text of fewer than n words is one n-gram.
    Null or wordless texts and null ids pair with nothing; rows that repeat an id and text count once (of an id with
    several texts each text is a set of its own); an empty table gives an empty result; other columns are ignored.
    """
    _, nodes, links = _links(docs, n, threshold, id_col, text_col, True)
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("rep").alias(f"doc_{x}"))
    near = links.join(side("a"), "a").join(side("b"), "b").where("doc_a <> doc_b")
    return near.select(F.least("doc_a", "doc_b").alias("doc_a"), F.greatest("doc_a", "doc_b").alias("doc_b"), F.round("jaccard", 6).alias("jaccard")).distinct()


def memberships(docs: DataFrame, n: int = N, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, of): the least document with the same set, for every document with a word (a row for each set of an id)."""
    longs = ", ".join(f"{c} bigint" for c in ("doc_id", "row", "node", "size", *_KEYS))
    marked = _docs_of(docs, id_col, text_col).mapInArrow(_nodes(n), longs).select("doc_id", "node").distinct()
    return marked.join(marked.groupBy("node").agg(F.min("doc_id").alias("of")), "node").select("doc_id", "of")


def expand_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Plain (doc_a < doc_b, jaccard) pairs of all documents, from `ngram_jaccard_join` and `memberships`."""
    x, y = members.select(F.col("of").alias("doc_a"), F.col("doc_id").alias("x")), members.select(F.col("of").alias("doc_b"), F.col("doc_id").alias("y"))
    near = pairs.join(x, "doc_a").join(y, "doc_b")
    same = x.join(y, F.col("doc_a") == F.col("doc_b")).withColumn("jaccard", F.lit(1.0))
    return near.select("x", "y", "jaccard").unionByName(same.select("x", "y", "jaccard")).where("x <> y").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), "jaccard").distinct()


def _classed(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, class_id, row, links), of the nodes with a link or several documents: row is the one row of the class to keep."""
    one = links.select(F.col("a").alias("node"), "links").unionByName(links.where("a <> b").select(F.col("b").alias("node"), F.col("back").alias("links")))
    each = one.groupBy("node").agg(F.sum("links").alias("links"))
    tree = components(links.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")))
    own = nodes.select("node", "rep", "row", "w").join(each, "node", "left").join(tree.select(F.col("id").alias("node"), "root"), "node", "left").where("w > 1 or links is not null")
    own = stored(own.select("node", "rep", "row", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("links"), F.coalesce("root", "node").alias("root")), "linked")
    least = own.groupBy("root").agg(F.min("rep").alias("class_id"), F.min_by("row", "rep").alias("keep"))
    return own.join(least, "root").select("node", "class_id", F.col("keep").alias("row"), "links")


def near_duplicate_classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, links), one row for each document: the least id of its class, the documents that are connected by
    similar pairs, and the number of documents that are similar to it.  Runs jobs while the result is built.

    Words and sets as in `ngram_jaccard_join`.  A null or wordless text is similar to nothing: its class is its own id.
    Null ids have no row; rows that repeat an id and text count once; an id with several texts has the least class of them
    and the links of all (a document similar to two of them counts twice).  An empty table gives an empty result; other
    columns are ignored.
    """
    marked, nodes, links = _links(docs, n, threshold, id_col, text_col, False)
    linked = stored(_classed(nodes, links).select("node", "class_id", "links"), "classes")
    seen = marked.select("doc_id", "node").distinct().join(linked, "node", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
    every = docs.select(F.col(id_col).cast("bigint").alias("doc_id")).where("doc_id is not null").select("doc_id", F.lit(None).cast("bigint").alias("class_id"), F.lit(0).cast("bigint").alias("links"))
    return seen.unionByName(every).groupBy("doc_id").agg(F.coalesce(F.min("class_id"), F.col("doc_id")).alias("class_id"), F.sum("links").alias("links"))


def drop_near_duplicates(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, without near duplicates: of each class the row of least id stays, of rows that repeat an
    id and text one.  Null and wordless texts and null ids are in no class and all stay."""
    marked, nodes, links = _links(docs, n, threshold, id_col, text_col, False)
    classed = _classed(nodes, links).select("node", F.col("row").alias("keep"))
    drop = stored(marked.join(classed, "node").where("row <> keep").select(F.col("row").alias("_row")).distinct(), "dropped")
    again = stored(marked.groupBy(F.col("row").alias("_row")).count().where("count > 1").select("_row").join(drop, "_row", "left_anti"), "repeated")
    tmp = [f"_c{i}" for i in range(len(docs.columns))]
    key = row_key(*(F.col(tmp[docs.columns.index(c)]) for c in (id_col, text_col)))
    known = F.col(tmp[docs.columns.index(id_col)]).isNotNull() & F.col(tmp[docs.columns.index(text_col)]).isNotNull()
    flat = docs.toDF(*tmp).withColumn("_row", F.when(known, key))
    kept = flat.join(_small(drop), "_row", "left_anti")
    if not again.isEmpty():
        once = kept.join(_small(again), "_row", "left_semi").dropDuplicates(["_row"])
        kept = kept.join(_small(again), "_row", "left_anti").unionByName(once)
    return kept.select(*tmp).toDF(*docs.columns)


def components(edges: DataFrame) -> DataFrame:
    """(id, root): least id of each connected component of edges (u, v), by alternating large-star and small-star steps."""
    now, before = stored(edges.distinct(), "edges"), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        down = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(down, "v")
        small = small.select(F.col("m").alias("u"), "v").unionByName(small.where("u <> m").select(F.col("m").alias("u"), F.col("u").alias("v"))).distinct()
        now = stored(small, "edges")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if mark == before:
            return now.groupBy(F.col("v").alias("id")).agg(F.min("u").alias("root")).unionByName(now.select(F.col("u").alias("id"), F.col("u").alias("root")).distinct())
        before = mark


def brute_force(rows: list[tuple[int | None, str | None]], n: int = N, threshold: float = THRESHOLD) -> set[tuple[int, int]]:
    """All pairs by comparing every two sets; for tests."""
    sets = []
    for i, text in rows:
        w = split_words(text)
        if i is not None and w:
            k = min(n, len(w))
            sets.append((i, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}))
    return {(min(i, j), max(i, j)) for a, (i, x) in enumerate(sets) for j, y in sets[a + 1 :] if i != j and len(x & y) >= (threshold - 1e-12) * len(x | y)}


#: Sets of 2-grams, all similar pairs, classes by least id until nothing changes.
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^0-9a-z\x{80}-\x{10FFFF}]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS gram FROM d),
s AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
k AS (SELECT g.doc_id, gram, n FROM g JOIN s USING (doc_id)),
p AS (SELECT x.doc_id AS a, y.doc_id AS b FROM k x JOIN k y ON x.gram = y.gram AND x.doc_id <> y.doc_id AND x.n >= 0.8 * y.n - 1e-9 AND y.n >= 0.8 * x.n - 1e-9 GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING count(*) >= 0.8 * (x.n + y.n - count(*)) - 1e-9),
c(doc_id, class_id) AS (SELECT DISTINCT doc_id, doc_id FROM documents WHERE doc_id IS NOT NULL UNION SELECT p.b, c.class_id FROM c JOIN p ON p.a = c.doc_id AND p.b > c.class_id)
SELECT doc_id, min(class_id) AS class_id, coalesce(any_value(l.links), 0)::BIGINT AS links FROM c LEFT JOIN (SELECT a AS doc_id, count(*) AS links FROM p GROUP BY a) l USING (doc_id) GROUP BY doc_id
"""
