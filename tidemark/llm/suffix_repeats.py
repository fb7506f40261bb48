"""Substring duplicates by the common-prefix interval tree of an enhanced suffix array, over bytes.

Texts are cut into content-defined segments, so that equal windows of `WIDTH` bytes always stand in segments of the same
gram. All distinct segments of a gram are brought together; their suffixes are sorted, whole, the common prefixes of
neighbours are taken, and a stack scan over them gives the intervals of the tree. An interval at least `WIDTH` deep is a
repeat with all its occurrences, and it is reported if it is left-maximal: if the bytes before its occurrences differ, or
one of them begins its segment. What these repeats cover, with segments that stand in several places, is what repeats.

A gram with more than `GROUP` distinct segments is dealt into chunks of that size, each with its own tree. Each tree then names
its distinct windows once by their fingerprints, which meet those of the other chunks, so no repeat is lost.

Null, empty and short texts have no window. Repeated rows and equal texts are occurrences of each other, also under
one doc_id or a null one. Matches never cross documents. Empty tables give no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import byte_values, dropped, stored, window_hash
from tidemark.llm._segments import Units, candidates, chosen, covered, lists, scan, with_first, with_parts

WIDTH, GRAM = 200, 40
#: Distinct segments of one gram that share a tree, and bytes of segments whose trees are built at once.
GROUP, BUFFER = 8192, 1 << 20
#: Bytes of suffixes that are sorted at once (a window's suffixes stay together).
MATRIX = 1 << 24
_OCCURRENCES = "doc_id long, text_key binary, start int, n int, gram long, segment binary, bytes binary"
_TREES = "segment binary, repeats array<struct<at:int,depth:int>>, open array<struct<at:int,window:long>>"
_HELD = "doc_id long, text_key binary, n_removed long, n_spans long, kept_sha256 string, kept binary"
_EMPTY = hashlib.sha256(b"").hexdigest()


def _occurrences(cand: DataFrame, width: int, gram: int) -> DataFrame:
    """Segments that may repeat, with their bytes."""

    def run(it):
        for big in it:
            for lo in range(0, big.num_rows, 200):
                batch = big.slice(lo, 200)
                out = [[] for _ in range(7)]
                for doc_id, key, (u, starts, counts, grams) in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), chosen(batch, False, gram, width)):
                    raw = u.data.tobytes()
                    for s, n, least in zip(starts, counts, grams):
                        piece = raw[s : s + n + width - 1]
                        row = doc_id, key, s, n, least, hashlib.md5(piece, usedforsecurity=False).digest(), piece
                        for column, x in zip(out, row):
                            column.append(x)
                kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["doc_id", "text_key", "start", "n", "gram", "segment", "bytes"])

    return cand.mapInArrow(run, _OCCURRENCES)


def intervals(lcp: list[int], least: int):
    """Intervals (first, last, depth) of the common-prefix tree that are at least `least` deep, by a stack over lcp[i] = common prefix of suffixes i - 1 and i."""
    stack: list[tuple[int, int]] = []
    for i in range(1, len(lcp) + 1):
        depth, first = lcp[i] if i < len(lcp) else 0, i - 1
        while stack and stack[-1][1] > depth:
            first, deep = stack.pop()
            yield first, i - 1, deep
        if depth >= least and (not stack or stack[-1][1] < depth):
            stack.append((first, depth))


def _suffix_groups(flat: np.ndarray, place: np.ndarray, length: np.ndarray, left: np.ndarray, width: int):
    """Left-diverse intervals of the common-prefix tree over some suffixes: (members, depth)."""
    most = int(length.max())
    text = np.lib.stride_tricks.sliding_window_view(np.concatenate((flat + 1, np.zeros(most, np.uint8))), most)[place]
    text[np.arange(most) >= length[:, None]] = 0  # UTF-8 has no byte 0xFF, so that 0 is less than all of them
    order = np.argsort(text.view(f"S{most}").ravel(), kind="stable")
    ranked = text[order]
    same = ranked[1:] == ranked[:-1]
    lcp = np.where(same.all(1), most, same.argmin(1))
    lcp = np.concatenate(([0], np.minimum(lcp, np.minimum(length[order][1:], length[order][:-1]))))
    beside = left[order]
    # outside runs of deep neighbours the scan finds nothing: it starts anew at each run
    deep = np.concatenate(([False], lcp >= width, [False]))
    for a, z in zip(np.flatnonzero(deep[1:] & ~deep[:-1]).tolist(), np.flatnonzero(deep[:-1] & ~deep[1:]).tolist()):
        for first, last, depth in intervals(lcp[a - 1 : z].tolist(), width):
            lo, hi = a - 1 + first, a + last
            if beside[lo:hi].min() < 0 or beside[lo:hi].min() != beside[lo:hi].max():
                yield order[lo:hi], depth


def tree(segments: list[bytes], width: int):
    """Maximal repeats of segments: arrays of the segment, the place in it, the depth and the repeat's number; and of all windows their segment, place, hash and whether they repeat.

    A repeat that begins with a segment counts as left-diverse: what stands before belongs to another gram. Only suffixes whose
    window repeats with different bytes before it are sorted, as all others extend to the left.
    """
    size = np.array([len(s) for s in segments])
    base = np.cumsum(size) - size
    flat = np.frombuffer(b"".join(segments), np.uint8)
    count = size - width + 1
    owner = np.repeat(np.arange(len(segments)), count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    place = base[owner] + at
    names = window_hash(byte_values(flat), width)[place]
    left = np.where(at > 0, flat[place - 1].astype(np.int16), np.int16(-1))
    order = np.argsort(names)
    first = np.flatnonzero(np.concatenate(([True], np.diff(names[order]) != 0)))
    n = np.diff(np.concatenate((first, [len(order)])))
    low, high = np.minimum.reduceat(left[order], first), np.maximum.reduceat(left[order], first)
    again = np.zeros(len(order), bool)
    again[order] = np.repeat(n > 1, n)
    cls = np.flatnonzero((n > 1) & ((low < 0) | (low != high)))
    members, depths, numbers, k = [], [], [], 0
    most = int(size.max())
    for part in np.split(cls, np.flatnonzero(np.diff(np.cumsum(n[cls]) * most // MATRIX)) + 1) if len(cls) else ():
        which = order[np.repeat(first[part] - np.cumsum(n[part]) + n[part], n[part]) + np.arange(n[part].sum())]
        for found, depth in _suffix_groups(flat, place[which], size[owner[which]] - at[which], left[which], width):
            members.append(which[found]), depths.append(np.full(len(found), depth)), numbers.append(np.full(len(found), k))
            k += 1
    which, depth, number = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (members, depths, numbers))
    return owner[which], at[which], depth, number, (owner, at, names.view(np.int64), again)


def _listed(n: int, owner: np.ndarray, fields: dict[str, np.ndarray]) -> pa.ListArray:
    """Rows' elements (ascending owners) as a list column of structs."""
    ends = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(x) for x in fields.values()], list(fields)))


def _trees(segments: DataFrame, width: int) -> DataFrame:
    """Of each distinct segment, sorted by gram and chunk: its maximal repeats, and of a dealt gram each distinct window once."""

    def flush(rows):
        owner, at, depth, number, (of, place, name, again) = tree([r[1] for r in rows], width)
        order = np.argsort(owner, kind="stable")
        found = {"at": at[order].astype(np.int32), "depth": depth[order].astype(np.int32)}
        # a dealt gram's windows go on, of a repeated one one occurrence for this tree
        _, once = np.unique(name, return_index=True)
        told = np.zeros(len(name), bool)
        told[once] = True
        told &= np.array([r[2] for r in rows])[of]
        left = {"at": place[told].astype(np.int32), "window": name[told]}
        return pa.RecordBatch.from_arrays([pa.array([r[3] for r in rows], pa.binary()), _listed(len(rows), owner[order], found), _listed(len(rows), of[told], left)], names=["segment", "repeats", "open"])

    def run(it):
        rows, held, last = [], 0, None
        for batch in it:
            for gram, chunk, piece, dealt, segment in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if (gram, chunk) != last and held >= BUFFER:
                    yield flush(rows)
                    rows, held = [], 0
                last = gram, chunk
                rows.append(((gram, chunk), piece, dealt, segment))
                held += len(piece)
        if rows:
            yield flush(rows)

    return segments.mapInArrow(run, _TREES)


def _kept(cand: DataFrame, found: DataFrame, texts: bool) -> DataFrame:
    def run(it):
        for big in it:
            for lo in range(0, big.num_rows, 200):
                b = big.slice(lo, 200)
                removed, spans, sha, kept = [], [], [], []
                ends, (start, n) = lists(b.column(3))
                for text, a, z in zip(b.column(2).to_pylist(), ends.tolist(), ends[1:].tolist()):
                    u = Units(text, False)
                    out = covered(len(u.data), start[a:z], start[a:z] + n[a:z])
                    left = u.bytes_of(~out)
                    removed.append(int(out.sum()))
                    spans.append(int((np.diff(np.concatenate(([0], out.astype(np.int8)))) == 1).sum()))
                    sha.append(hashlib.sha256(left).hexdigest())
                    kept.append(left if texts else None)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha), pa.array(kept, pa.binary())], names=["doc_id", "text_key", "n_removed", "n_spans", "kept_sha256", "kept"])

    return cand.select("doc_id", "text_key", "text").join(found, "text_key").select("doc_id", "text_key", "text", "hits").mapInArrow(run, _HELD)


def _found(docs: DataFrame, width: int, gram: int):
    """Texts, candidate documents, their segments (one row an occurrence), and known: of each segment that repeats or holds repeats, spans (at, depth)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    scanned = stored(scan(rows, False, gram, width))
    base = stored(with_first(scanned))
    dropped(scanned)
    cand = candidates(rows, base, within=True)
    seen = stored(_occurrences(cand, width, gram))
    distinct = stored(seen.groupBy("segment").agg(F.count("*").alias("times"), F.first("gram").alias("gram"), F.first("bytes").alias("bytes"), F.first("n").alias("n")))
    groups = distinct.groupBy("gram").agg(F.count("*").alias("segments")).where("segments > 1")
    dealt = distinct.join(groups, "gram").withColumn("chunk", F.pmod(F.xxhash64("segment"), F.ceil(F.col("segments") / GROUP)))
    dealt = dealt.select("gram", "chunk", "bytes", (F.col("segments") > GROUP).alias("dealt"), "segment")
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    trees = stored(_trees(dealt.repartition(n, "gram", "chunk").sortWithinPartitions("gram", "chunk"), width))
    open_ = trees.select("segment", F.explode("open").alias("o")).select("segment", "o.at", "o.window")
    again = open_.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window")
    late = open_.join(again, "window").groupBy("segment").agg(F.collect_list(F.struct("at", F.lit(width).alias("depth"))).alias("late"))
    span = "array<struct<at:int,depth:int>>"
    none = F.array().cast(span)
    early = trees.select("segment", "repeats").join(late, "segment", "left").select("segment", F.concat("repeats", F.coalesce("late", none)).alias("inside"))
    whole = F.when(F.col("times") > 1, F.array(F.struct(F.lit(0).alias("at"), (F.col("n") + F.lit(width - 1)).alias("depth"))).cast(span)).otherwise(none)
    known = distinct.select("segment", "times", "n").join(early, "segment", "left").select("segment", "times", F.concat(whole, F.coalesce("inside", none)).alias("spans")).where("size(spans) > 0")
    return base, cand, seen, known


def repeat_groups(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """group, doc_id, start, length: every occurrence of every maximal repeat of segments, in the first document of each text. A group is known by the hash of its bytes.

    Repeats longer than a segment come as one group a segment; a repeat that only meets across chunks comes as its windows.
    """
    _, _, seen, known = _found(docs, width, gram)
    known = stored(known.select("segment", "spans"))
    bytes_of = seen.groupBy("segment").agg(F.first("bytes").alias("bytes"))
    spans = known.join(bytes_of, "segment").select("segment", "bytes", F.explode(F.array_distinct("spans")).alias("r"))
    named = spans.select("segment", F.col("r.at").alias("at"), F.col("r.depth").alias("length"), F.xxhash64(F.substring("bytes", F.col("r.at") + 1, F.col("r.depth"))).alias("group"))
    return seen.select("doc_id", "start", "segment").join(named, "segment").select("group", "doc_id", (F.col("start") + F.col("at")).alias("start"), "length")


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, texts: bool = False) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if `texts`, the kept bytes of those that lose any."""
    base, cand, seen, known = _found(docs, width, gram)
    hits = F.transform("spans", lambda r: F.struct((F.col("start") + r["at"]).alias("start"), r["depth"].alias("n")))
    # each segment of a text is one row, and the whole of a copied segment covers what is inside
    lean = known.select("segment", F.when(F.col("times") > 1, F.slice("spans", 1, 1)).otherwise(F.col("spans")).alias("spans"))
    found = seen.select("text_key", "start", "segment").join(lean, "segment").select("text_key", hits.alias("hits")).groupBy("text_key").agg(F.flatten(F.collect_list("hits")).alias("hits"))
    kept = _kept(cand, found, texts).dropDuplicates(["doc_id", "text_key"])
    copy = (F.col("copies") > 1) & (F.col("n_units") >= width)
    out = with_parts(base.drop("grams", "starts"), kept)
    return out.select(
        "doc_id",
        F.col("n_units").alias("n_bytes"),
        F.when(copy, F.col("n_units")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit(_EMPTY)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        *([F.when(copy, F.lit(b"")).otherwise(F.col("kept")).alias("kept")] if texts else []),
    )
