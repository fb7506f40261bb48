"""MinHash near-duplicates with sequential Bayesian verification.

A document's set holds its distinct word shingles, as 64-bit hashes. Documents of equal sets form a class, and one document
stands for each class. Classes that agree in a band of their MinHash signature are candidates. A candidate pair is compared
one batch of the signature at a time and dropped as soon as the posterior probability that its similarity reaches the
threshold falls below `MISS`; the survivors are verified on their full sets.

No group is expanded into all its pairs. In each bucket the members are compared with a few leaders, one at first, the
heaviest; connected components of the confirmed links follow; then only buckets that still hold members of different
components are left, without the leaders, which have met all of theirs. After two rounds those who are still apart meet block by block
with their full sets, and only links that join components are emitted, so that no component is lost.

Null and empty texts have no shingles and are linked with nothing; a text of fewer words than a shingle has its whole word
sequence as one. A null doc_id stands alone (null component). Rows with equal doc_ids count as one document with one row
each; of its different texts those links count that the least key's set has, or that another document shares. Empty tables give no rows; extra columns are not read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import as_bytes, dropped, mix, sieved, stored, window_hash, word_hashes

#: Signature: BANDS bands of ROWS hashes. At similarity 0.8 a pair shares no band with probability (1 - 0.8^4)^32 = 5e-8.
BANDS, ROWS = 32, 4
#: Hashes compared at a time, and the probability of missing a pair that each batch may add.
BATCH, MISS = 16, 1e-6
#: Leaders of a bucket in each round; nodes of a block of those that are left, and bytes of their sets.
LEADERS, SIDE, SIDE_BYTES = (1, 8), 4096, 16 << 20
#: Texts that a worker holds at a time.
SLICE = 500
_SLOPE = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
_FEATURES = "doc_id long, n_shingles long, k1 long, k2 long, sig binary, bands array<long>"


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text with A-Z lowered."""
    words, _, _ = word_hashes(as_bytes(text, lower=True))
    if not len(words):
        return words
    return np.unique(window_hash(words, width) if len(words) >= width else window_hash(words, len(words)))


def signature(found: np.ndarray) -> np.ndarray:
    """MinHash values of a non-empty set: for each slope the least product, high 32 bits."""
    low = np.full(len(_SLOPE), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 2048):
        np.minimum(low, (found[at : at + 2048, None] * _SLOPE).min(0), out=low)
    return low >> np.uint64(32)


def features(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit key of the set, the signature's low bytes and the band hashes (none for empty sets)."""

    def run(it):
        for batch in (b.slice(at, SLICE) for b in it for at in range(0, b.num_rows, SLICE)):
            n, k1, k2, sig, bands = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingles(text, width)
                n.append(len(s))
                k1.append(int(s.sum(dtype=np.uint64).view(np.int64)))
                k2.append(int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)))
                if not len(s):
                    sig.append(None), bands.append([])
                    continue
                full = signature(s)
                sig.append((full & np.uint64(0xFF)).astype(np.uint8).tobytes())
                key = np.arange(BANDS, dtype=np.uint64)
                for r in range(ROWS):
                    key = mix(key ^ full[r::ROWS])
                bands.append(key.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "k1", "k2", "sig", "bands"])

    return docs.mapInArrow(run, _FEATURES)


@lru_cache
def least_matches(threshold: float) -> np.ndarray:
    """For 1, 2, ... batches: the fewest matching low bytes with which P(similarity >= threshold | matches) is still MISS or more (uniform prior)."""
    s = (np.arange(2000) + 0.5) / 2000
    p = s + (1 - s) / 256
    out = []
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        for m in range(n + 1):
            like = m * np.log(p) + (n - m) * np.log1p(-p)
            like = np.exp(like - like.max())
            if like[s >= threshold].sum() / like.sum() >= MISS:
                out.append(m)
                break
    return np.array(out)


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)


def _alive(left: np.ndarray, right: np.ndarray, x: np.ndarray, y: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs left[x], right[y] those that no batch of the signature rules out."""
    total = np.zeros(len(x), np.int64)
    for k, least in enumerate(least_matches(percent / 100)):
        cut = slice(k * BATCH, (k + 1) * BATCH)
        total += (left[x, cut] == right[y, cut]).sum(1)
        live = total >= least
        x, y, total = x[live], y[live], total[live]
    return x, y


_PAIRED = "band long, i long, j long, block long, node long, n long, comp long, sig binary, bands array<long>"


def _partners(key, table, comp: np.ndarray, percent: int):
    """(x, y): rows of two blocks that no batch of the signature rules out, of different components, in the first band that both nodes have; every x of block i with its rows y of block j. comp may change on the way."""
    band, i, j = (k.as_py() for k in key)
    node, n, block = (table.column(c).to_numpy() for c in ("node", "n", "block"))
    sig = _signatures(table.column("sig"))
    bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
    two = np.flatnonzero(block == j)
    for x in np.flatnonzero(block == i):
        alike = 100 * np.minimum(n[two], n[x]) >= percent * np.maximum(n[two], n[x])
        y = two[(comp[two] != comp[x]) & alike & ((node[two] < node[x]) | (i != j))]
        _, y = _alive(sig, sig, np.full(len(y), x), y, percent)
        y = y[bands[x, (bands[y] == bands[x]).argmax(1)] == band]
        if len(y):
            yield x, y


def _rest(rows: DataFrame, bands: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of all nodes of a band that are still apart: a band is cut into blocks of a bounded number of nodes and bytes, and each two blocks meet in a group of their own.

    They meet with their signatures first; only nodes that have a partner there fetch their full sets and meet again. What
    the signature does not rule out is verified then, and only links that join components not yet joined within the group
    come out. So a group never gives more rows than it has nodes.
    """

    def near(key, table):
        hit = np.zeros(table.num_rows, bool)
        for x, y in _partners(key, table, table.column("comp").to_numpy(), percent):
            hit[x] = hit[y] = True
        return table.filter(pa.array(hit)).select(["band", "i", "j", "block", "node", "n", "comp", "sig", "bands"])

    def run(key, table):
        node, n = (table.column(c).to_numpy() for c in ("node", "n"))
        comp = table.column("comp").to_numpy().copy()
        held = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        a, b = [], []
        for x, y in _partners(key, table, comp, percent):
            found = np.concatenate([held[k] for k in y])
            at = np.minimum(np.searchsorted(held[x], found), n[x] - 1)
            shared = np.add.reduceat((held[x][at] == found).astype(np.int64), np.cumsum(n[y]) - n[y])
            for k in y[100 * shared >= percent * (n[x] + n[y] - shared)]:
                if comp[k] != comp[x]:
                    comp[comp == comp[k]] = comp[x]
                    a.append(max(node[x], node[k]))
                    b.append(min(node[x], node[k]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    size = F.greatest(F.count("*") / SIDE, F.sum("n") * 8 / SIDE_BYTES)
    sizes = rows.groupBy("band").agg(F.ceil(size).alias("blocks"))
    dealt = rows.join(sizes, "band").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).join(bands, "node")
    each = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    each = each.select("band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "n", "comp", "sig", "bands")
    met = stored(each.groupBy("band", "i", "j").applyInArrow(near, _PAIRED))
    some = sieved(sets, "node", met.select("node").distinct())
    edges = stored(met.join(some, "node").groupBy("band", "i", "j").applyInArrow(run, "a long, b long").distinct())
    dropped(met)
    return edges


def _met(rows: DataFrame, leaders: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a row's node and a leader of its band, of different components, that no batch of the signature rules out.

    Each row is compared where it stands: what is emitted are survivors alone.
    """

    def run(it):
        for b in it:
            if not b.num_rows:
                continue
            held = b.column(4)
            leader = {k: held.flatten().field(k) for k in ("node", "n", "comp", "sig")}
            row = np.repeat(np.arange(b.num_rows), held.value_lengths().to_numpy())
            node, n, comp = (b.column(i).to_numpy() for i in range(3))
            other, m, comp_b = (leader[k].to_numpy() for k in ("node", "n", "comp"))
            alike = 100 * np.minimum(n[row], m) >= percent * np.maximum(n[row], m)
            live = np.flatnonzero((comp[row] != comp_b) & alike)
            x, y = _alive(_signatures(b.column(3)), _signatures(leader["sig"]), row[live], live, percent)
            x, y = node[x], other[y]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], names=["a", "b"])

    return rows.select("band", "node", "n", "comp", "sig").join(leaders, "band").select("node", "n", "comp", "sig", "leaders").mapInArrow(run, "a long, b long").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), stored, those whose full sets reach the threshold."""

    def run(it):
        for b in it:
            for lo in range(0, b.num_rows, 256):
                c = b.slice(lo, 256)
                ok = []
                for x, y in zip(c.column(2).to_pylist(), c.column(3).to_pylist()):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    both = np.concatenate((x, y))
                    both.sort(kind="stable")
                    shared = int((both[1:] == both[:-1]).sum())
                    ok.append(100 * shared >= percent * (len(x) + len(y) - shared))
                keep = pa.array(np.flatnonzero(ok))
                yield pa.RecordBatch.from_arrays([c.column(0).take(keep), c.column(1).take(keep)], names=["a", "b"])

    sets = sieved(sets, "node", pairs.select("a").union(pairs.select("b")).distinct())
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, comp: the least node that edges (a, b) connect each node with. Labels spread along edges and jump to their own labels, written out each round."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
    labels = stored(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("comp")))
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), F.col("comp").alias("seen")), "other").groupBy("node").agg(F.min("seen").alias("seen"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("root"))
        least = F.least("comp", "seen", "root")
        new = stored(labels.join(near, "node").join(jump, "comp", "left").select("node", least.alias("comp"), (least < F.col("comp")).alias("moved")))
        dropped(labels)
        labels = new.select("node", "comp")
        if new.where("moved").isEmpty():
            return labels


def _merged(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """labels (node, comp) after new edges: only the components that they touch are looked at."""
    if labels is None:
        return components(edges)
    one, two = (labels.select(F.col("node").alias(x), F.col("comp").alias(f"comp_{x}")) for x in "ab")
    ends = edges.join(one, "a", "left").join(two, "b", "left").select(F.coalesce("comp_a", "a").alias("a"), F.coalesce("comp_b", "b").alias("b")).where("a <> b")
    roots = components(stored(ends))
    moved = labels.join(roots.select(F.col("node").alias("comp"), F.col("comp").alias("root")), "comp", "left").select("node", F.coalesce("root", "comp").alias("comp"))
    return stored(moved.unionByName(roots.join(labels, "node", "left_anti")))


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.drop("comp").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def _sets(rows: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """node, shingles: the full sets of the given documents (of a doc_id with several texts, each)."""

    def run(it):
        for b in (x.slice(at, SLICE) for x in it for at in range(0, x.num_rows, SLICE)):
            made = [shingles(t, width) for t in b.column(1).to_pylist()]
            keys = [int(x.sum(dtype=np.uint64).view(np.int64)) for x in made]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.int64()), pa.array([x.tobytes() for x in made], pa.binary())], names=["doc_id", "k1", "shingles"])

    wanted = nodes.select(F.col("node").alias("doc_id"), "k1")
    # texts stay where they are: sets are made there of what the bitmap lets through, and only sets are shuffled
    found = sieved(rows, "doc_id", nodes.select("node")).mapInArrow(run, "doc_id long, k1 long, shingles binary").dropDuplicates(["doc_id", "k1"])
    return stored(found.join(wanted, ["doc_id", "k1"]).select(F.col("doc_id").alias("node"), "shingles"))


def _leaders(rows: DataFrame, most: int) -> DataFrame:
    """band, leaders: up to `most` nodes of each band, of each hash class the heaviest; aggregated before they are shuffled."""
    one = F.max_by(F.struct("node", "n", "comp", "sig"), F.struct("weight", (-F.col("node")).alias("last"))).alias("leader")
    if most == 1:
        return rows.groupBy("band").agg(one).select("band", F.array("leader").alias("leaders"))
    sub = F.pmod(F.xxhash64("node"), F.lit(most)).alias("sub")
    return rows.groupBy("band", sub).agg(one).groupBy("band").agg(F.collect_list("leader").alias("leaders"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, class_id (least doc_id with this set), component_id, kept."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    base = stored(features(rows, width))
    full = base.where("n_shingles > 0 and doc_id is not null")
    classes = stored(full.groupBy("k1", "k2").agg(F.min("doc_id").alias("class_id")))
    # a doc_id that stands for several texts is known by the least of their keys; signatures are shuffled once
    keys = full.select("doc_id", "k1", "k2").join(classes, ["k1", "k2"]).where("doc_id = class_id")
    keys = keys.groupBy("doc_id").agg(F.min(F.struct("k1", "k2")).alias("key")).select("doc_id", "key.k1", "key.k2")
    nodes = full.join(keys, ["doc_id", "k1", "k2"]).dropDuplicates(["doc_id", "k1", "k2"])
    nodes = stored(nodes.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "k1", "sig", "bands"))
    in_band = nodes.select("node", F.explode("bands").alias("band"))
    met = in_band.groupBy("band").agg(F.count("*").alias("members")).where("members > 1")
    shared = stored(in_band.join(met, "band"))
    # who shares bands with many stands in the middle of a group, and leads its buckets
    weights = shared.groupBy("node").agg(F.sum("members").alias("weight"))
    near = stored(nodes.drop("bands").join(weights, "node"))
    left = stored(shared.select("band", "node").join(near.select("node", "n", "sig", "weight", F.col("node").alias("comp")), "node"))
    dropped(shared)
    sets, labels = _sets(rows, near, width), None
    for most in LEADERS:
        leaders = stored(_leaders(left, most))
        pairs = stored(_met(left, leaders, percent))
        edges = stored(_verified(pairs, sets, percent))
        if labels is None or not edges.isEmpty():
            labels = _merged(labels, edges)
        # the leaders have met their bands; the others go on where they are apart
        rest = _labelled(left.join(leaders, "band").where(~F.array_contains("leaders.node", F.col("node"))).drop("leaders"), labels)
        apart = rest.groupBy("band").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 <> c2").select("band")
        new = stored(rest.join(apart, "band"))
        dropped(left, leaders, pairs, edges)
        left = new
    # two nodes that share bands meet in the first of them, so bands go along
    edges = _rest(left, nodes.select("node", "bands"), sets, percent)
    labels = labels if edges.isEmpty() else _merged(labels, edges)
    dropped(left, edges, sets, near, nodes)
    out = base.select("doc_id", "n_shingles", "k1", "k2").join(classes, ["k1", "k2"], "left").withColumn("class_id", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("class_id")))
    out = out.join(labels.withColumnRenamed("node", "class_id"), "class_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("comp", "class_id", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))
