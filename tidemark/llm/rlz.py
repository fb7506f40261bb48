"""Substring duplicates by relative Lempel-Ziv parsing of word sequences.

The reference of a document is every document with a smaller doc_id. Its text is held as content-defined blocks, each
distinct block once, with the place where it stands first, and indexed by the fingerprints of its windows of `WIDTH` words.
The index names for each window of a document its first place in the reference; windows that follow each other there, too,
are a seed. Where another seed follows at once, both texts are compared from the seed's end on, as far as that reference
document goes. A document is then parsed greedily: a factor begins at the first window that the reference holds and
takes the seed that reaches farthest; at a factor's boundary the first window that straddles it is looked up, and what
holds it begins the next factor. Factors are never shorter than a window, so each is a duplicate span, and they cover
every window that the reference holds.

Words are [^\\x20\\x09-\\x0D]+, unchanged. Null, empty and short texts have no window and lose nothing. Of rows with one doc_id
none counts as smaller than another. A null doc_id neither gives nor takes. Empty tables give no rows; extra columns are
not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import as_bytes, dropped, stored, window_hash, word_hashes
from tidemark.llm._segments import Units, candidates, chosen, covered, lists, scan, with_first, with_parts

WIDTH, GRAM = 50, 10
_BLOCKS = "doc_id long, text_key binary, start int, n int, block binary, windows array<long>"
_HELD = "doc_id long, text_key binary, n_removed long, kept_sha256 string, kept string, factors array<struct<start:int,end:int,source:long,place:int>>"
_EMPTY = hashlib.sha256(b"").hexdigest()


def _blocks(cand: DataFrame, width: int, gram: int) -> DataFrame:
    def run(it):
        for big in it:
            for lo in range(0, big.num_rows, 500):
                batch = big.slice(lo, 500)
                out = [[] for _ in range(6)]
                for doc_id, key, (u, starts, counts, _) in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), chosen(batch, True, gram, width)):
                    for s, n in zip(starts, counts):
                        words = u.piece(s, n + width - 1)
                        row = doc_id, key, s, n, hashlib.md5(words.tobytes(), usedforsecurity=False).digest(), window_hash(words, width).view(np.int64)
                        for column, x in zip(out, row):
                            column.append(x)
                kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["doc_id", "text_key", "start", "n", "block", "windows"])

    return cand.mapInArrow(run, _BLOCKS)


def seeds(starts: np.ndarray, sources: np.ndarray, places: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Runs of windows (ascending starts) that follow each other in one reference document: start, end, source, place, and whether another seed follows at once."""
    cut = np.flatnonzero(np.concatenate(([True], (np.diff(starts) != 1) | (np.diff(sources) != 0) | (np.diff(places) != 1))))
    last = np.concatenate((cut[1:], [len(starts)])) - 1
    follows = np.concatenate((starts[cut[1:]] == starts[last[:-1]] + 1, [False]))
    return starts[cut], starts[last] + width, sources[cut], places[cut], follows


def parse(found: list[tuple[int, int, int, int]], width: int) -> list[dict]:
    """Greedy factors from seeds (start, end, source, place), ascending: at each place the seed over its window that reaches farthest."""
    out, at, i, best = [], -1, 0, None
    while True:
        while i < len(found) and found[i][0] <= at:
            if best is None or found[i][1] > best[1]:
                best = found[i]
            i += 1
        if best is not None and best[1] - width >= at:
            start, end, source, place = best
            out.append({"start": at, "end": end, "source": source, "place": place + at - start})
            at = end - width + 1
        elif i < len(found):
            at = max(at, found[i][0])
        else:
            return out


def _seeds(found: DataFrame, width: int) -> DataFrame:
    def run(it):
        for b in it:
            ends, (start, n, source, place) = lists(b.column(2))
            rows, out = [], [[] for _ in range(5)]
            for a, z in zip(ends.tolist(), ends[1:].tolist()):
                k = n[a:z]
                step = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                at = np.repeat(start[a:z], k) + step
                order = np.argsort(at, kind="stable")
                made = seeds(at[order], np.repeat(source[a:z], k)[order], (np.repeat(place[a:z], k) + step)[order], width)
                rows.append(len(made[0]))
                for column, x in zip(out, made):
                    column.append(x)
            names = ("start", "end", "source", "place", "follows")
            kinds = (np.int32, np.int32, np.int64, np.int32, bool)
            flat = pa.StructArray.from_arrays([pa.array(np.concatenate([np.zeros(0, t), *c]).astype(t)) for c, t in zip(out, kinds)], list(names))
            offsets = pa.array(np.concatenate(([0], np.cumsum(rows))).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(offsets, flat)], names=["doc_id", "text_key", "seeds"])

    return found.mapInArrow(run, "doc_id long, text_key binary, seeds array<struct<start:int,end:int,source:long,place:int,follows:boolean>>")


def _extended(cand: DataFrame, seeded: DataFrame) -> DataFrame:
    """doc_id, text_key, longer: of the seeds that another follows at once, how far both texts agree."""
    follow = seeded.select("doc_id", "text_key", F.explode(F.filter("seeds", lambda s: s["follows"])).alias("s"))
    pairs = follow.groupBy("doc_id", "text_key", F.col("s.source").alias("source")).agg(F.collect_list(F.struct("s.start", "s.end", "s.place")).alias("open"))

    def run(it):
        for big in it:
            for lo in range(0, big.num_rows, 200):
                b = big.slice(lo, 200)
                ends, (start, end, place) = lists(b.column(2))
                longer = end.copy()
                for text, other, a, z in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), ends.tolist(), ends[1:].tolist()):
                    u, v = (word_hashes(as_bytes(t))[0] for t in (text, other))
                    for i in range(a, z):
                        x, y = u[start[i] :], v[place[i] :]
                        n = min(len(x), len(y))
                        apart = np.flatnonzero(x[:n] != y[:n])
                        longer[i] = max(end[i], start[i] + (int(apart[0]) if len(apart) else n))
                flat = pa.StructArray.from_arrays([pa.array(start), pa.array(longer)], ["start", "end"])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat)], names=["doc_id", "text_key", "longer"])

    mine = pairs.join(cand.select("doc_id", "text_key", "text"), ["doc_id", "text_key"])
    both = mine.join(cand.select(F.col("doc_id").alias("source"), F.col("text").alias("other")), "source")
    grown = both.select("doc_id", "text_key", "open", "text", "other").mapInArrow(run, "doc_id long, text_key binary, longer array<struct<start:int,end:int>>")
    return grown.groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("longer")).alias("longer"))


def _parsed(cand: DataFrame, seeded: DataFrame, width: int, texts: bool) -> DataFrame:
    def run(it):
        for big in it:
            for lo in range(0, big.num_rows, 500):
                b = big.slice(lo, 500)
                removed, sha, kept, factors = [], [], [], []
                for text, own, more in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()):
                    u = Units(text, True)
                    grown: dict[int, int] = {}
                    for x in more or ():
                        grown[x["start"]] = max(x["end"], grown.get(x["start"], 0))
                    found = parse([(x["start"], grown.get(x["start"], x["end"]), x["source"], x["place"]) for x in own], width)
                    out = covered(len(u.values), *(np.array([x[k] for x in found], np.int64) for k in ("start", "end")))
                    left = u.bytes_of(~out)
                    removed.append(int(out.sum()))
                    sha.append(hashlib.sha256(left).hexdigest())
                    kept.append(left.decode("utf-8", "surrogatepass") if texts else None)
                    factors.append(found)
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("source", pa.int64()), ("place", pa.int32())]))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(removed, pa.int64()), pa.array(sha), pa.array(kept, pa.string()), pa.array(factors, kind)], names=["doc_id", "text_key", "n_removed", "kept_sha256", "kept", "factors"])

    return cand.select("doc_id", "text_key", "text").join(seeded, ["doc_id", "text_key"]).select("doc_id", "text_key", "text", "seeds", "longer").mapInArrow(run, _HELD)


def factorise(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, texts: bool = False) -> DataFrame:
    """One row a document: doc_id, n_words, n_removed, kept_sha256, factors (start, end, source, place in words) and, if `texts`, the kept words of those that lose any."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    scanned = stored(scan(rows, True, gram, width))
    base = stored(with_first(scanned))
    dropped(scanned)
    cand = candidates(rows, base, within=False)
    blocks = stored(_blocks(cand, width, gram))
    held = stored(blocks.groupBy("block").agg(F.min(F.struct(F.col("doc_id").alias("source"), F.col("start").alias("place"))).alias("f"), F.first("windows").alias("windows")))
    each = stored(held.select("block", F.col("f.source").alias("source"), F.col("f.place").alias("place"), F.posexplode("windows").alias("k", "window")))
    at = F.struct("source", (F.col("place") + F.col("k")).alias("place"))
    first = each.groupBy("window").agg(F.min(at).alias("e"), F.max("source").alias("last")).where("e.source < last").select("window", "e")
    # a block's windows are held where the block is; some are held earlier still
    earlier = each.join(first, "window").where("e.source < source").groupBy("block").agg(F.collect_list(F.struct("k", "e.source", "e.place")).alias("earlier"))
    known = held.select("block", "f").join(earlier, "block", "left")
    met = blocks.select("doc_id", "text_key", "start", "n", "block").join(known, "block")
    kind = "array<struct<start:int,n:int,source:bigint,place:int>>"
    whole = F.array(F.struct("start", "n", "f.source", "f.place")).cast(kind)
    some = F.transform(F.filter("earlier", lambda e: e["source"] < F.col("doc_id")), lambda e: F.struct((F.col("start") + e["k"]).alias("start"), F.lit(1).alias("n"), e["source"], e["place"])).cast(kind)
    hits = F.when(F.col("f.source") < F.col("doc_id"), whole).otherwise(F.coalesce(some, F.array().cast(kind)))
    found = met.select("doc_id", "text_key", hits.alias("hits")).where("size(hits) > 0").groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("hits")).alias("hits"))
    seeded = stored(_seeds(found, width))
    dropped(blocks, held, each)
    longer = stored(_extended(cand, seeded))
    parsed = _parsed(cand, seeded.join(longer, ["doc_id", "text_key"], "left"), width, texts).dropDuplicates(["doc_id", "text_key"])
    copy = (F.col("first_id") < F.col("doc_id")) & (F.col("n_units") >= width)
    factor = "array<struct<start:int,end:int,source:bigint,place:int>>"
    source = F.array(F.struct(F.lit(0), F.col("n_units").cast("int"), F.col("first_id"), F.lit(0))).cast(factor)
    none = F.array().cast(factor)
    out = with_parts(base.drop("grams", "starts"), parsed)
    return out.select(
        "doc_id",
        F.col("n_units").alias("n_words"),
        F.when(copy, F.col("n_units")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(_EMPTY)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(copy, source).otherwise(F.coalesce("factors", none)).alias("factors"),
        *([F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept")] if texts else []),
    )
