"""Token-ID output: Arrow IPC files whose batches hold fixed-size lists of ids and masks.

Every file is one range of doc_id. Its rows are sequences of `width` ids, so sequence i is the slice [i * width, (i + 1) *
width) of one flat buffer: a memory map gives it without a copy. The last sequence is padded and its mask says so. A small
index file beside it holds each document's place.

Null text counts as empty: the document is its end id alone. Equal doc_ids stand in the order of their texts, null
doc_ids first. An empty table makes no sequences. Extra columns are not read.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm._chunks import blocks, has_runs
from tidemark.llm._common import only, rested, shared_dir, stored

#: Ids of a sequence, sequences of a batch.
WIDTH, ROWS = 2048, 256
#: Words kept from chunk to chunk with their ids.
CACHE = 1 << 20
#: Characters of the texts that are encoded together, and bytes of what the library gets at a time.
CHUNK, CALL = 1 << 23, 1 << 16
#: Documents that become Python strings together.
SLICE = 128
_PARTS = "part int, path string, n_docs long, n_tokens long"
_DOCS = "doc_id long, start long, n_tokens long, ids_crc32 long"
#: Units of letters and marks, on one line or two, are pre-tokens that stand apart: no mark begins a contraction.
_LETTERS, _MARKS = "[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]+", f"[{re.escape('.,;:!?*%$&#|()[]{}<>/=+-_~^@' + chr(34))}]*"
_SPLIT = rf"\A(?P<stem>{_LETTERS})(?P<tail>{_MARKS})(?:\n(?P<next>{_LETTERS})(?P<end>{_MARKS}))?\z"
_WHITE = f"[{''.join(c for c in map(chr, range(0x3001)) if c.isspace())}]"


class _Words:
    """Ids of words that stand behind the same white space; those met before come from a bounded cache."""

    def __init__(self, ids: _Ids, lead: str, letter: str) -> None:
        self.ids, self.lead = ids, lead
        self.opens = np.zeros(len(ids.tokens), bool)  # tokens that begin with the lead, in the vocabulary's alphabet
        self.opens[[i for i, t in enumerate(ids.tokens) if t.startswith(letter)]] = True
        self.words, self.known = pa.array([], pa.string()), pa.array([], pa.binary())

    def _joined(self, words: pa.Array):
        """Ids of words without white space: the lead begins a token, which tells the words of one encoding apart."""
        call = np.cumsum(np.asarray(pc.binary_length(words)) + 1) // CALL
        cuts = [0, *(np.flatnonzero(np.diff(call)) + 1).tolist(), len(words)]
        for a, z in zip(cuts, cuts[1:]):
            part = words.slice(a, z - a).to_pylist()
            found = np.frombuffer(self.ids.call([self.lead + self.lead.join(part)])[0], self.ids.kind)
            starts = np.flatnonzero(self.opens[found])
            if len(starts) != len(part) or starts[0]:  # a vocabulary whose tokens don't tell where a word begins
                yield self.ids.alone([self.lead + w for w in part])
            else:
                ends = (np.append(starts, len(found)) * self.ids.kind.itemsize).astype(np.int32)
                yield pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(ends), pa.py_buffer(found)])

    def _learned(self, words: pa.Array) -> pa.Array:
        """Ids of distinct words."""
        apart = np.asarray(pc.or_(pc.match_substring_regex(words, _WHITE), pc.equal(words, "")))
        if any(self.lead in s for s in self.ids.special):
            apart = np.ones(len(words), bool)
        order = np.argsort(apart, kind="stable")
        n, words = len(words) - int(apart.sum()), words.take(pa.array(order))
        made = [*(self._joined(words.slice(0, n)) if n else ()), self.ids.alone([self.lead + w for w in words.slice(n).to_pylist()])]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return pa.concat_arrays(made).take(pa.array(place))

    def __call__(self, words: pa.Array) -> pa.Array:
        """Ids of words, with the lead before each; null of null."""
        # what was met comes first and is distinct, so that it keeps its places
        n = len(self.words)
        coded = pa.concat_arrays([self.words, words]).dictionary_encode()
        codes = coded.indices.slice(n)
        if len(coded.dictionary) > n:
            self.words, self.known = coded.dictionary, pa.concat_arrays([self.known, self._learned(coded.dictionary.slice(n))])
        found = self.known.take(codes)
        if len(self.words) > CACHE:
            last = codes.unique().drop_null().slice(0, CACHE)
            self.words, self.known = self.words.take(last), self.known.take(last)
        return found


class _Ids:
    """Ids of texts by the tokenizers library; the distinct units of many texts are encoded once."""

    def __init__(self, path: str) -> None:
        # one task has one core: the library's own threads only wait for each other
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        vocab = self.tokenizer.get_vocab(True)
        self.tokens = [""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            self.tokens[i] = t
        self.kind, self.code = (np.dtype("<u2"), "H") if len(self.tokens) <= 1 << 16 else (np.dtype("<u4"), "I")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words, self.lines = _Words(self, " ", "\u0120"), _Words(self, "\n", "\u010a")

    def call(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def alone(self, texts: list[str]) -> pa.Array:
        """Ids of each text, as little-endian bytes."""
        made, part, size = [], [], 0
        for text in texts:
            part.append(text)
            size += len(text)
            if size >= CALL:
                made += self.call(part)
                part, size = [], 0
        return pa.array(made + self.call(part), pa.binary())

    def _units(self, units: pa.Array) -> pa.Array:
        """Ids of distinct units, with the blank that begins each."""
        halves = pc.extract_regex(units, _SPLIT)
        stem, tail, after, end = (pc.struct_field(halves, k) for k in ("stem", "tail", "next", "end"))
        marks = pa.concat_arrays([tail, end]).dictionary_encode()
        marks = self.alone(marks.dictionary.to_pylist()).take(marks.indices)
        # RE2 gives "" where there is no second line
        lines = self.lines(pc.if_else(pc.equal(after, ""), None, after))
        return pc.binary_join_element_wise(self.words(pc.coalesce(stem, units)), marks.slice(0, len(units)), lines, marks.slice(len(units)), b"", null_handling="skip")

    def pieces(self, text: str) -> list[str]:
        """Pieces to encode one by one; a special token may take the white space around it, so that its text stays whole."""
        return [text] if not text or any(s in text for s in self.special) else list(blocks(text))

    def many(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one behind the other, and how many each has."""
        whole = [len(p) > CHUNK or any(s in p for s in self.special) for p in pieces]
        texts = pa.array(["" if w else p for w, p in zip(whole, pieces)], pa.string())
        near = pc.match_substring_regex(texts, _WHITE + " ").to_pylist()
        if any(near):
            whole = [w or n and has_runs(p) for w, n, p in zip(whole, near, pieces)]
            texts = pa.array(["" if w else p for w, p in zip(whole, pieces)], pa.string())
        split = pc.split_pattern(texts, " ")
        ends, every = np.asarray(split.offsets), split.values
        first = np.zeros(len(every), bool)
        first[ends[:-1]] = True
        heads = [p if w else h for w, p, h in zip(whole, pieces, every.take(pa.array(ends[:-1])).to_pylist())]
        coded = every.filter(pa.array(~first)).dictionary_encode()
        places = np.empty(len(every), np.int32)
        places[first] = len(coded.dictionary) + np.arange(len(pieces))
        places[~first] = np.asarray(coded.indices)
        made = pa.concat_arrays([self._units(coded.dictionary), self.alone(heads)]).take(pa.array(places))
        at = np.frombuffer(made.buffers()[1], np.int32, len(made) + 1)[ends] // self.kind.itemsize
        return np.frombuffer(made.buffers()[2] or b"", self.kind, at[-1]), np.diff(at)


_LOADED: dict[str, _Ids] = {}


def _ids(path: str) -> _Ids:
    if path not in _LOADED:
        _LOADED[path] = _Ids(path)
    return _LOADED[path]


def _chunked(it, ids: _Ids):
    """doc_ids of the documents that end in a chunk of about CHUNK characters, its pieces of texts, and which of these are a text's last."""
    keys, pieces, last, size = [], [], [], 0
    for batch in (x.slice(lo, SLICE) for x in it for lo in range(0, x.num_rows, SLICE)):
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            parts = ids.pieces(text or "")
            for k, piece in enumerate(parts, 1):
                pieces.append(piece)
                last.append(k == len(parts))
                size += len(piece)
                if last[-1]:
                    keys.append(key)
                if size >= CHUNK:
                    yield keys, pieces, np.array(last)
                    keys, pieces, last, size = [], [], [], 0
    if pieces:
        yield keys, pieces, np.array(last)


class _Writer:
    """One file of fixed-size lists; ids that don't yet fill a batch wait in `rest`."""

    def __init__(self, store: fs.FileSystem, path: str, kind: np.dtype) -> None:
        self.kind, self.rest, self.held = kind, [], 0
        item = pa.from_numpy_dtype(kind)
        self.schema = pa.schema([("ids", pa.list_(item, WIDTH)), ("mask", pa.list_(pa.bool_(), WIDTH))])
        self.sink = store.open_output_stream(path)
        self.out = pa.ipc.new_file(self.sink, self.schema)

    def _batch(self, flat: np.ndarray) -> None:
        n = -(-len(flat) // WIDTH) * WIDTH
        mask = np.arange(n) < len(flat)
        flat = np.concatenate((flat, np.zeros(n - len(flat), self.kind)))
        self.out.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(flat), WIDTH), pa.FixedSizeListArray.from_arrays(pa.array(mask), WIDTH)], schema=self.schema))

    def add(self, ids: bytes) -> None:
        self.rest.append(ids)
        self.held += len(ids)
        full = WIDTH * ROWS * self.kind.itemsize
        if self.held >= full:
            joined = b"".join(self.rest)
            cut = len(joined) // full * full
            for at in range(0, cut, full):
                self._batch(np.frombuffer(joined, self.kind, WIDTH * ROWS, at))
            self.rest, self.held = [joined[cut:]], len(joined) - cut

    def close(self) -> None:
        if self.held:
            self._batch(np.frombuffer(b"".join(self.rest), self.kind))
        self.out.close()
        self.sink.close()


class TokenFile:
    """Random access to a written file: sequences, masks and runs of ids, as views where the store can be memory-mapped."""

    def __init__(self, uri: str) -> None:
        store, path = fs.FileSystem.from_uri(uri)
        self.source = pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path)
        self.reader = pa.ipc.open_file(self.source)

    def _flat(self, batch: int, column: int):
        return self.reader.get_batch(batch).column(column).flatten()

    def sequence(self, i: int) -> np.ndarray:
        return self._flat(i // ROWS, 0).slice(i % ROWS * WIDTH, WIDTH).to_numpy()

    def mask(self, i: int) -> np.ndarray:
        return self._flat(i // ROWS, 1).slice(i % ROWS * WIDTH, WIDTH).to_numpy(zero_copy_only=False)

    def runs(self, start: int, n: int):
        """The n ids from `start` on, one view a batch."""
        size = WIDTH * ROWS
        while n > 0:
            b, at = divmod(start, size)
            k = min(n, size - at)
            yield self._flat(b, 0).slice(at, k).to_numpy()
            start, n = start + k, n - k


def write(docs: DataFrame, path: str, end_id: int = 2, uri: str | None = None, text: str = "text") -> DataFrame:
    """Writes the documents' ids in ascending doc_id order; returns the written parts: part, path, n_docs, n_tokens, start.

    A retried task writes files of its own name, and the returned table names those of the attempt that counted.
    """
    spark = docs.sparkSession
    uri = uri or shared_dir(spark)
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(it):
        ids, part = _ids(path), TaskContext.get().partitionId()
        store, root = fs.FileSystem.from_uri(uri)
        store.create_dir(root, recursive=True)
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        out, at, begun, n_docs = None, 0, 0, 0
        index = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        for keys, pieces, last in _chunked(it, ids):
            if out is None:
                out = _Writer(store, f"{root}/{name}.arrow", ids.kind)
                sink = store.open_output_stream(f"{root}/{name}.index.arrow")
                places = pa.ipc.new_file(sink, index)
            made, counts = ids.many(pieces)
            # a document's end id follows its last piece
            ends = np.cumsum(counts)[last]
            out.add(np.insert(made, ends, end_id).tobytes())
            stops = at + ends + np.arange(1, len(ends) + 1)
            starts = np.append(begun, stops)
            places.write_batch(pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts[:-1], pa.int64()), pa.array(np.diff(starts), pa.int64())], schema=index))
            at, begun = at + len(made) + len(ends), starts[-1]
            n_docs += len(keys)
        if out is not None:
            out.close()
            places.close()
            sink.close()
            rested()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [f"{uri}/{name}"], "n_docs": pa.array([n_docs], pa.int64()), "n_tokens": pa.array([at], pa.int64())})

    rows = only(docs, "doc_id", text).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    parts = stored(rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, _PARTS))
    # one row a file: the running total over them is small whatever the files hold
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_documents(parts: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files of `parts`; each file is read where its row lands."""

    def run(it):
        for batch in it:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens, places = TokenFile(f"{path}.arrow"), TokenFile(f"{path}.index.arrow").reader
                for k in range(places.num_record_batches):
                    b = places.get_batch(k)
                    sums = []
                    for start, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                        crc = 0
                        for run in tokens.runs(start, n):
                            crc = zlib.crc32(run.astype("<u4").tobytes(), crc)
                        sums.append(crc)
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.asarray(b.column(1)) + base), b.column(2), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return parts.select("path", "start").repartition(n, "path").mapInArrow(run, _DOCS)
