"""Content-defined segments of texts, and which of them may repeat.

A window is `width` consecutive units (words or bytes). It belongs to the place of its smallest gram hash; windows that
belong to one place follow each other and form a segment. Equal windows have equal smallest grams, so a window can only
repeat in a segment of the same gram. Segments whose gram occurs once need no further look, and equal segments are looked
at once for all.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import as_bytes, byte_values, stored, window_hash, word_hashes

_BASE = "doc_id long, text_key binary, n_units long, n_bytes long, sha string, grams array<long>, starts array<int>"


class Units:
    """A text as units: words or bytes."""

    def __init__(self, text: str | None, words: bool) -> None:
        self.data = as_bytes(text)
        if words:
            self.values, self.start, self.end = word_hashes(self.data)
        else:
            self.values, self.start, self.end = byte_values(self.data), None, None

    def bytes_of(self, keep: np.ndarray | None = None) -> bytes:
        """The kept units: words joined by a blank, or bytes."""
        if self.start is None:
            return (self.data if keep is None else self.data[keep]).tobytes()
        raw = self.data.tobytes()
        return b" ".join(raw.split() if keep is None else [raw[a:z] for a, z in zip(self.start[keep].tolist(), self.end[keep].tolist())])

    def segments(self, gram: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each segment: the gram hash, the first window's place and the number of windows."""
        n = len(self.values) - width + 1
        if n <= 0:
            none = np.zeros(0, np.int64)
            return none.view(np.uint64), none, none
        grams = window_hash(self.values, gram)
        span = width - gram + 1
        key = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
        rows = np.concatenate((key, np.full(-len(key) % span, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, span)
        left = np.minimum.accumulate(rows, axis=1).ravel()
        right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        at = (np.minimum(right[:n], left[span - 1 : span - 1 + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        return grams[at[first]], first, np.diff(np.concatenate((first, [n])))

    def piece(self, start: int, n: int) -> np.ndarray:
        return self.values[start : start + n]


def text_key(text: str | None) -> bytes:
    return hashlib.md5((text or "").encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()


def scan(rows: DataFrame, words: bool, gram: int, width: int) -> DataFrame:
    """A row for each of rows (doc_id, text): a key of its whole text, its units, the sha256 of all of them, and its segments."""

    def run(it):
        for batch in it:
            for lo in range(0, batch.num_rows, 2000):
                b = batch.slice(lo, 2000)
                out = [[] for _ in range(6)]
                for text in b.column(1).to_pylist():
                    u = Units(text, words)
                    g, s, _ = u.segments(gram, width)
                    for column, x in zip(out, (text_key(text), len(u.values), len(u.data), hashlib.sha256(u.bytes_of()).hexdigest(), g.view(np.int64), s.astype(np.int32))):
                        column.append(x)
                kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(out, kinds))], names=["doc_id", "text_key", "n_units", "n_bytes", "sha", "grams", "starts"])

    return rows.mapInArrow(run, _BASE)


def candidates(rows: DataFrame, base: DataFrame, within: bool) -> DataFrame:
    """doc_id, text_key, text, starts: documents, the first of each text, with those segments whose gram occurs in another text (or, `within`, elsewhere in the same one).

    A text is known by its key, as a doc_id may be null or stand for several texts. Texts without any doc_id only count `within`.
    """
    each = base.where("doc_id <=> first_id" if within else "doc_id = first_id").select("doc_id", "text_key", F.explode(F.arrays_zip("grams", "starts")).alias("s")).select("doc_id", "text_key", F.col("s.grams").alias("gram"), F.col("s.starts").alias("start"))
    met = each.groupBy("gram").agg(F.min("text_key").alias("k1"), F.max("text_key").alias("k2"), F.min("start").alias("s1"), F.max("start").alias("s2"))
    # written out, so that the join below stands alone and Spark can split a gram that many texts hold
    met = stored(met.where("k1 <> k2 or s1 <> s2" if within else "k1 <> k2").select("gram"))
    meant = each.join(met, "gram").groupBy("doc_id", "text_key").agg(F.collect_set("start").alias("starts"))
    keyed = rows.select("doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("text_key"), "text")
    same = keyed["doc_id"].eqNullSafe(meant["doc_id"]) & (keyed["text_key"] == meant["text_key"])
    return stored(keyed.join(meant, same).select(keyed["doc_id"], keyed["text_key"], "text", "starts"))


def with_parts(base: DataFrame, parts: DataFrame) -> DataFrame:
    """base with the columns of `parts` (a row for each first document of a text, by doc_id and text_key), null where there are none."""
    found = parts.withColumnsRenamed({"doc_id": "__d", "text_key": "__k"})
    return base.join(found, base["doc_id"].eqNullSafe(found["__d"]) & (base["text_key"] == found["__k"]), "left").drop("__d", "__k")


def with_first(base: DataFrame) -> DataFrame:
    """base with first_id (the least doc_id of this text) and copies (rows with this text)."""
    firsts = stored(base.groupBy("text_key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")))
    return base.join(firsts, "text_key")


def chosen(batch, words: bool, gram: int, width: int):
    """For each row of candidates: the units and the chosen segments as lists of starts, numbers of windows and grams; none if the text isn't the one that was scanned."""
    for key, text, starts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
        u = Units(text, words)
        if text_key(text) != key:
            yield u, [], [], []
            continue
        grams, first, n = u.segments(gram, width)
        at = np.searchsorted(first, np.sort(np.array(starts, np.int64)))
        yield u, first[at].tolist(), n[at].tolist(), grams[at].view(np.int64).tolist()


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n units the spans cover."""
    edge = np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def lists(column) -> tuple[np.ndarray, list]:
    """Where each row's elements begin and end in a list column, and its fields as arrays."""
    flat = column.flatten()
    fields = [flat.field(i).to_numpy() for i in range(flat.type.num_fields)]
    return np.concatenate(([0], np.cumsum(column.value_lengths().fill_null(0).to_numpy()))), fields
