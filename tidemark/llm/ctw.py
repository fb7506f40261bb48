"""Language-model scoring by context-tree weighting over binary-decomposed byte contexts.

A byte is eight binary decisions. Each decision has a context tree over the bytes before; every node holds a
Krichevsky-Trofimov estimate of its counts, and a node's weighted probability is half its own estimate and half the product of
its children's. With the counts of the training texts, the weights give the predictive mixture over all depths, and the
code length of any text. Texts begin in a context of END bytes and end with one. A path of the tree goes `LEAST` bytes back
at least, then on to the last white space, and `DEPTH` bytes at most: where a leaf stands follows from the bytes of its path.

Work is dealt twice. Blocks of documents (about `BLOCK` bytes each, by a hash of doc_id) send their distinct grams (a
context and the byte after it) with their counts to partitions by the last two bytes of the context, as packed arrays.
There every subtree below depth two is whole; the sums that reach the top are at most 65,280 rows. The partitions then
answer each block with the log-probabilities of its grams, in the order in which it sent them, and the block scores its
documents. All statistics cover every training text, and nothing but the top of the tree is held at one place.

Null text counts as empty; a null doc_id trains. Without training texts every estimate is even. Repeated rows are scored each.
Empty tables give no rows; extra columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import LOWER, SPACE, dropped, mix, stored, word_hashes

#: Bytes of a context: at least, and at most; with the byte after it, a gram fills an integer.
LEAST, DEPTH = 5, 7
BLOCK = 16 << 20
#: Partitions of the tree at most: more than the blocks of a part would only make the packed arrays small.
PARTS = 4096
#: A byte that UTF-8 never has: before a text's beginning, and its end.
END = 0xFF
#: Keys of pieces that wait until they are merged with the others.
MERGE = 1 << 20
_CHUNK = 1 << 20
#: Rows whose texts become Python strings at a time.
_SLICE = 64
_WORD_END = np.uint64(0xE7D)
_STOP = SPACE.copy()
_STOP[END] = True
_CODEC = pa.Codec("zstd", compression_level=1)
_SENT = "block int, kind int, part int, n int, keys binary, counts binary"
_TOP = "c1 int, node int, n0 double, n1 double, s double"
_ANSWER = "block int, kind int, part int, found binary"
_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, n_bytes long, base_score double, score double"


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Log-gamma for x > 0: Stirling's series at x + 8, stepped down."""
    y = x + 8
    series = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    down = x.copy()
    for k in range(1, 8):
        down *= x + k
    return series - np.log(down)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return _lgamma(n0 + 0.5) + _lgamma(n1 + 0.5) - _lgamma(n0 + n1 + 1.0) - np.log(np.pi)


def held_out(doc_id: int | None, modulus: int, remainder: int) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % modulus == remainder


def depths(stop: np.ndarray) -> np.ndarray:
    """Bytes of the context of each place, given the places of white space and ENDs: back to the last one, within LEAST and DEPTH."""
    at = np.arange(len(stop))
    last = np.maximum.accumulate(np.where(stop, at, -DEPTH))
    return np.clip(at - np.concatenate(([-DEPTH], last[:-1])), LEAST, DEPTH)


def _gram_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For all bytes of the texts and their ends the gram as an integer: the context, most recent byte first, no bytes beyond its depth, and the byte itself last; and where each text begins."""
    head, end = bytes([END]) * DEPTH, bytes([END])
    b = np.frombuffer(b"".join(head + t + end for t in texts), np.uint8)
    size = np.array([len(t) + 1 for t in texts])
    first = np.cumsum(size) - size
    at = np.arange(size.sum()) + np.repeat(DEPTH * np.arange(1, len(texts) + 1), size)
    depth = depths(_STOP[b])[at]
    wide = b.astype(np.uint64)
    key = wide[at]
    for j in range(1, LEAST + 1):
        key |= wide[at - j] << np.uint64(64 - 8 * j)
    deep = np.arange(len(at))
    for j in range(LEAST + 1, DEPTH + 1):
        deep = deep[depth[deep] >= j]
        key[deep] |= wide[at[deep] - j] << np.uint64(64 - 8 * j)
    return key, first


def _word_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of the texts, A-Z lowered, each text's followed by the end token; and where each text begins."""
    data = np.frombuffer(b" ".join([*texts, b""]).translate(LOWER), np.uint8)
    hashes, start, _ = word_hashes(data)
    stop = np.cumsum([len(t) + 1 for t in texts])
    n = np.searchsorted(start, stop)  # words up to each text's end
    return np.insert(hashes, n, _WORD_END), np.concatenate(([0], n[:-1] + np.arange(1, len(n)))).astype(np.int64)


def _chunks(table: pa.Table):
    """doc_ids and texts in pieces of about _CHUNK bytes."""
    ids, texts, held = [], [], 0
    slices = (table.slice(at, _SLICE) for at in range(0, table.num_rows, _SLICE))
    for i, t in (x for s in slices for x in zip(s.column("doc_id").to_pylist(), s.column("text").to_pylist())):
        raw = t.encode("utf-8", "surrogatepass")
        ids.append(i)
        texts.append(raw)
        held += len(raw) + DEPTH + 1
        if held >= _CHUNK:
            yield ids, texts
            ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


class _Counts:
    """Distinct keys of pieces of text and their counts."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.fresh = 0

    def add(self, weight: int, keys: np.ndarray) -> None:
        """Counts one piece."""
        codes, found = pd.factorize(keys)
        self.parts.append((found, np.bincount(codes, minlength=len(found)) * weight))
        self.fresh += len(found)
        if self.fresh > MERGE:
            self.parts, self.fresh = [self.whole()[:2]], 0

    def whole(self) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Keys, ascending, their counts, and where the keys of each piece stand among them. The pieces are given up."""
        sizes = [len(k) for k, _ in self.parts]
        keys, n = (np.concatenate(x) for x in zip(*self.parts))
        self.parts = []
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        new = np.concatenate(([True], keys[1:] != keys[:-1]))
        at = np.empty(len(keys), np.int32)
        at[order] = np.cumsum(new, dtype=np.int32) - 1
        del order
        first = np.flatnonzero(new)
        return keys[first], np.add.reduceat(n, first), np.split(at, np.cumsum(sizes)[:-1])


class _Pieces:
    """Pieces of text: for each its distinct keys, and which of them each place holds."""

    def __init__(self) -> None:
        self.codes: list[np.ndarray] = []
        self.found: list[np.ndarray] = []

    def add(self, keys: np.ndarray) -> None:
        codes, found = pd.factorize(keys)
        self.codes.append(codes.astype(np.min_scalar_type(max(len(found) - 1, 0))))
        self.found.append(found)

    def places(self):
        """For each piece in turn what gives the values of its places from those of all keys, ascending; pieces are given up on the way."""
        while self.codes:
            found, codes = self.found.pop(0), self.codes.pop(0)
            yield lambda keys, values, found=found, codes=codes: values[np.searchsorted(keys, found)].astype(np.float64)[codes]

    def keys(self) -> np.ndarray:
        every = np.concatenate(self.found)
        every.sort()
        return every[np.concatenate(([True], every[1:] != every[:-1]))]


def _dealt(kind: int, parts: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order in which ascending keys are sent, by partition; and where each partition's begin."""
    part = (mix(keys if kind else keys >> np.uint64(48)) % np.uint64(parts)).astype(np.int16)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def _packed(x: np.ndarray) -> bytes:
    """An array, byte by byte of its elements: sorted keys have long runs of equal leading bytes."""
    planes = np.ascontiguousarray(x.astype(x.dtype.newbyteorder(">")).view(np.uint8).reshape(-1, x.itemsize).T)
    return _CODEC.compress(planes.tobytes(), asbytes=True)


def _unpacked(raw: bytes, n: int, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(_CODEC.decompress(raw, n * size), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(np.dtype(kind).newbyteorder(">")).ravel().astype(kind)


def _send(parts: int, modulus: int, remainder: int):
    def run(key, table):
        block, both = key[0].as_py(), (_Counts(), _Counts())
        for ids, texts in _chunks(table):
            for weight in (1, 0):  # held-out documents count nothing, but their keys are there
                some = [t for i, t in zip(ids, texts) if held_out(i, modulus, remainder) != bool(weight)]
                if some:
                    both[0].add(weight, _gram_keys(some)[0])
                    both[1].add(weight, _word_keys(some)[0])
        rows: list[list] = [[] for _ in range(6)]
        for kind, counts in enumerate(both):
            keys, n, _ = counts.whole()
            order, ends = _dealt(kind, parts, keys)
            keys, n = keys[order], n[order].astype(np.uint32)
            for p in np.flatnonzero(np.diff(ends)).tolist():
                cut = slice(ends[p], ends[p + 1])
                for column, x in zip(rows, (block, kind, p, int(ends[p + 1] - ends[p]), _packed(keys[cut]), _packed(n[cut]))):
                    column.append(x)
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(rows, kinds)], names=["block", "kind", "part", "n", "keys", "counts"])

    return run


class _Subtrees:
    """All context nodes from depth two down that one partition's grams reach."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.counts = counts.astype(np.float64)
        self.sym = (keys & np.uint64(0xFF)).astype(np.int64)
        self.c1 = (keys >> np.uint64(56)).astype(np.int64)
        depth = np.full(len(keys), DEPTH)
        for j in range(DEPTH - 1, 0, -1):
            byte = (keys >> np.uint64(64 - 8 * j)) & np.uint64(0xFF)
            depth[_STOP[byte.astype(np.int64)]] = max(j, LEAST)
        self.levels = []  # from the deepest: the grams whose context goes so deep, their nodes, and which are leaves
        for d in range(DEPTH, 1, -1):
            of = np.flatnonzero(depth >= d)
            if len(of):
                path = keys[of] >> np.uint64(64 - 8 * d)
                self.levels.append((of, np.concatenate(([0], np.cumsum(path[1:] != path[:-1]))), depth[of] == d))

    def bit(self, level: int):
        """For one of the eight decisions: each gram's prediction at depth two, its node, its bit, and the sums (c1, node, n0, n1, log weighted) that go up."""
        node = (1 << level) + (self.sym >> (8 - level))
        bit = (self.sym >> (7 - level)) & 1
        ones, zeros = self.counts * bit, self.counts * (1 - bit)
        guess = np.zeros(len(node))
        child_at, child_log = np.zeros(0, np.int64), np.zeros(0)
        for grams, place, leaf in self.levels:
            name, first, of = np.unique((place << 8) | node[grams], return_index=True, return_inverse=True)
            n1 = np.bincount(of, ones[grams], len(name))
            n0 = np.bincount(of, zeros[grams], len(name))
            own = log_kt(n0, n1)
            below = np.bincount(of[np.searchsorted(grams, child_at)], child_log, len(name))
            log = np.where(leaf[first], own, np.logaddexp(own, below) - np.log(2))
            w = np.where(leaf[first], 1.0, np.exp(own - np.log(2) - log))[of]
            kt = (np.where(bit[grams] == 1, n1[of], n0[of]) + 0.5) / (n0[of] + n1[of] + 1)
            guess[grams] = w * kt + (1 - w) * guess[grams]
            child_at, child_log = grams[first], log
        return guess, node, bit, (self.c1[child_at], node[child_at], n0, n1, child_log)


class _Part:
    """The keys that blocks sent to one partition, each once, ascending, their counts, and where each block's keys stand among them."""

    def __init__(self, table: pa.Table) -> None:
        counts = _Counts()
        for k, c, n in zip(*(table.column(x).to_pylist() for x in ("keys", "counts", "n"))):
            counts.parts.append((_unpacked(k, n, "u8"), _unpacked(c, n, "u4").astype(np.int64)))
        self.keys, self.counts, self.at = counts.whole()


def _sums(key, table):
    """What one partition sends to the top: sums by last byte and node; of words their number and total (c1 = -1)."""
    part = _Part(table)
    if key[0].as_py() == 1:
        rows = [[-1], [-1], [float((part.counts > 0).sum())], [float(part.counts.sum())], [0.0]]
    else:
        trees, parts = _Subtrees(part.keys, part.counts), []
        for level in range(8):
            c1, node, n0, n1, log = trees.bit(level)[3]
            name, of = np.unique((c1 << 8) | node, return_inverse=True)
            parts.append((name >> 8, name & 0xFF, *(np.bincount(of, x, len(name)) for x in (n0, n1, log))))
        rows = [np.concatenate(x) for x in zip(*parts)]
    kinds = (pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64())
    return pa.table([pa.array(np.asarray(c), type=t) for c, t in zip(rows, kinds)], names=["c1", "node", "n0", "n1", "s"])


class Top:
    """Depths zero and one: weights and counts of 255 and of 256 times 255 nodes."""

    def __init__(self, rows) -> None:
        self.n = [np.zeros((2, 256)), np.zeros((2, 256, 256))]
        below = np.zeros((256, 256))
        self.n_words = self.n_tokens = 0
        for c1, node, n0, n1, s in rows:
            if c1 < 0:
                self.n_words, self.n_tokens = int(n0), int(n1)
            else:
                self.n[1][:, c1, node] = n0, n1
                below[c1, node] = s
        self.n[0] = self.n[1].sum(1)
        own = log_kt(*self.n[1])
        log = np.logaddexp(own, below) - np.log(2)
        self.w = [None, np.exp(own - np.log(2) - log)]
        own = log_kt(*self.n[0])
        self.w[0] = np.exp(own - np.log(2) - (np.logaddexp(own, log.sum(0)) - np.log(2)))

    def finish(self, guess, c1, node, bit):
        """The prediction at the root from that at depth two."""
        for d, at in ((1, (c1, node)), (0, (node,))):
            n0, n1 = self.n[d]
            n0, n1, w = n0[at], n1[at], self.w[d][at]
            guess = w * (np.where(bit == 1, n1, n0) + 0.5) / (n0 + n1 + 1) + (1 - w) * guess
        return guess


def _answers(held):
    def run(key, table):
        part = _Part(table)
        if key[0].as_py() == 1:
            found = part.counts.astype(np.float32)
        else:
            trees, total = _Subtrees(part.keys, part.counts), np.zeros(len(part.counts))
            for level in range(8):
                guess, node, bit, _ = trees.bit(level)
                total += np.log10(held.value.finish(guess, trees.c1, node, bit))
            found = total.astype(np.float32)
        return pa.table([table.column("block"), table.column("kind"), table.column("part"), pa.array([found[x].tobytes() for x in part.at], pa.binary())], names=["block", "kind", "part", "found"])

    return run


def _score(modulus: int, remainder: int, n_words: int, n_tokens: int, parts: int):
    norm = np.log10(n_tokens + n_words + 1)

    def values(pieces: _Pieces, answers: pa.Table, kind: int):
        """What the partitions have found for the keys of each piece, at its places; a piece at a time."""
        keys = pieces.keys()
        order, _ = _dealt(kind, parts, keys)
        got = sorted((p, f) for k, p, f in zip(*(answers.column(c).to_pylist() for c in ("kind", "part", "found"))) if k == kind)
        out = np.empty(len(keys), np.float32)
        out[order] = np.frombuffer(b"".join(f for _, f in got), np.float32)
        del order, got
        return (at(keys, out) for at in pieces.places())

    def run(docs, answers):
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        out: list[list] = [[] for _ in kinds]
        if docs.num_rows:
            grams, words, pieces = _Pieces(), _Pieces(), []
            for ids, texts in _chunks(docs):
                (key, first), (word, begin) = _gram_keys(texts), _word_keys(texts)
                grams.add(key)
                words.add(word)
                pieces.append((ids, [len(t) for t in texts], first, np.append(begin, len(word))))
            for (ids, sizes, first, begin), g, c in zip(pieces, values(grams, answers, 0), values(words, answers, 1), strict=True):
                n = np.diff(begin)
                columns = (
                    ids,
                    [held_out(i, modulus, remainder) for i in ids],
                    n,
                    np.add.reduceat((c > 0).astype(np.int64), begin[:-1]),
                    sizes,
                    np.add.reduceat(np.log10(c + 1), begin[:-1]) - n * norm,
                    np.add.reduceat(g, first),
                )
                for column, x in zip(out, columns):
                    column.extend(x)
        return pa.table([pa.array(c, t) for c, t in zip(out, kinds)], names=["doc_id", "held_out", "n_tokens", "n_known", "n_bytes", "base_score", "score"])

    return run


def score(docs: DataFrame, modulus: int = 7, remainder: int = 2, block_bytes: int = BLOCK) -> DataFrame:
    """One row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probability) and bits_per_byte.

    Documents whose crc32(doc_id as text) leaves `remainder` by `modulus` are scored without having trained.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    n_blocks = max(1, -(-int(total) // block_bytes))
    parts = min(PARTS, max(n_blocks, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64(F.coalesce("doc_id", F.xxhash64("text"))), F.lit(n_blocks)).cast("int"))
    sent = stored(dealt.groupBy("block").applyInArrow(_send(parts, modulus, remainder), _SENT))
    top = sent.groupBy("kind", "part").applyInArrow(_sums, _TOP).groupBy("c1", "node").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "s")))
    top = Top(top.collect())  # at most 256 x 255 + 1 rows
    answers = stored(sent.groupBy("kind", "part").applyInArrow(_answers(spark.sparkContext.broadcast(top)), _ANSWER))
    dropped(sent)
    scored = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(modulus, remainder, top.n_words, top.n_tokens, parts), _SCORED)
    bits = -F.col("score") / F.log10(F.lit(2.0)) / (F.col("n_bytes") + 1)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(top.n_tokens).cast("long").alias("train_tokens"), "base_score", "score", bits.alias("bits_per_byte"))
