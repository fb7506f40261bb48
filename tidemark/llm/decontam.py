"""Benchmark decontamination: one Aho-Corasick automaton over the normalised test items, each text scanned once.

Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lowered. Each of the benchmark's words is coded by a few
letters, so a match's place is a word's place, and word bounds map it to the original text. Words that no item holds share
a code that no pattern has.

Items: null and word-less items match nothing; an item of fewer words than a window is one window; repeated items are
matched each. Documents: null and empty texts have no words. Null item_ids are ignored. Empty tables on either side give
no hits; extra columns are not read. A benchmark beyond `ITEM_BYTES` is dealt into blocks of that size (a longer item into
overlapping runs), each with its own automaton over all documents, and a row's spans and items are united.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import only

#: Bytes of items of one automaton, each with ITEM_COST more than its text: the proven bound of what a task is sent.
ITEM_BYTES, ITEM_COST = 16 << 20, 64
#: Letters of a word, and letters of each of their alphabets: more words than ITEM_BYTES can hold.
LETTERS, ALPHABET = 4, 64
WINDOW = 10
#: Lowers A-Z; every other ASCII character that isn't a letter or digit becomes a blank.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_SCHEMA = "n_words long, spans array<struct<start:int,end:int,char_start:int,char_end:int>>, items array<string>"


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class _Automaton:
    """Each word is LETTERS letters, each of an alphabet of its own: no state has more than ALPHABET ways on, and a match begins where a word begins."""

    def __init__(self, items: list[tuple[str, str]], window: int) -> None:
        import ahocorasick

        self.code: dict[bytes, str] = {}
        self.items = [i for i, _ in items]
        found: dict[str, list[int]] = {}
        for k, (_, text) in enumerate(items):
            coded = [self._coded(w) for w in words(text)]
            for at in range(max(1, len(coded) - window + 1)) if coded else ():
                held = found.setdefault("".join(coded[at : at + window]), [])
                if not held or held[-1] != k:
                    held.append(k)
        self.machine = ahocorasick.Automaton()
        for pattern, held in found.items():
            self.machine.add_word(pattern, (len(pattern) // LETTERS, tuple(held)))
        if found:
            self.machine.make_automaton()
        self.empty = not found

    def _coded(self, word: bytes) -> str:
        if word not in self.code:
            n = len(self.code)
            self.code[word] = "".join(chr(0x100 + ALPHABET * j + n // ALPHABET**j % ALPHABET) for j in range(LETTERS))
        return self.code[word]

    def scan(self, found: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged word spans of all matches, and the items matched."""
        if self.empty or len(found) == 0:
            return [], set()
        get, other, spans, hit = self.code.get, "\x01" * LETTERS, [], set()
        for last, (n, held) in self.machine.iter("".join([get(w, other) for w in found])):
            hit.update(held)
            end = (last + 1) // LETTERS
            start = end - n
            while spans and start <= spans[-1][1]:
                start = min(start, spans.pop()[0])
            spans.append((start, end))
        return spans, hit


def _bounds(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code-point starts and ends of the words."""
    raw = text.encode("utf-8", "surrogatepass")
    folded = np.frombuffer(raw.translate(_FOLD), np.uint8)
    edge = np.diff(np.concatenate(([False], folded != 32, [False])).astype(np.int8))
    chars = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    return chars[np.flatnonzero(edge == 1)], chars[np.flatnonzero(edge == -1)]


def _scan(docs: DataFrame, items, window: int) -> DataFrame:
    """docs (text, and columns that say which row it is) with the hits in place of the text."""
    keys = [f for f in docs.schema.fields if f.name != "text"]
    names = [f.name for f in keys]
    made: dict[int, _Automaton] = {}

    def run(it):
        if 0 not in made:
            made[0] = _Automaton(items.value, window)
        machine = made[0]
        for batch in it:
            n_words, spans, named = [], [], []
            for text in batch.column("text").to_pylist():
                found = words(text)
                n_words.append(len(found))
                places, hit = machine.scan(found)
                if places:
                    a, z = _bounds(text)
                    places = [{"start": s, "end": e, "char_start": int(a[s]), "char_end": int(z[e - 1])} for s, e in places]
                spans.append(places)
                named.append(sorted({machine.items[k] for k in hit}))
            kind = pa.list_(pa.struct([(n, pa.int32()) for n in ("start", "end", "char_start", "char_end")]))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(n_words, pa.int64()), pa.array(spans, kind), pa.array(named, pa.list_(pa.string()))], names=[*names, "n_words", "spans", "items"])

    return docs.mapInArrow(run, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in keys), _SCHEMA]))


def text_key(text: Column) -> Column:
    """What tells a row's text: with doc_id, which may be null or stand for several texts, it says which row this is."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def _pieces(text: str, size: int, window: int):
    """A text in runs of about `size` bytes that share window - 1 words, so that every window is whole in one of them."""
    run, held, fresh = [], 0, False
    for w in words(text):
        run.append(w)
        held, fresh = held + len(w) + 1, True
        if held >= size and len(run) >= window:
            yield b" ".join(run).decode("utf-8", "surrogatepass")
            run = run[len(run) - window + 1 :]
            held, fresh = sum(map(len, run)), False
    if fresh:
        yield b" ".join(run).decode("utf-8", "surrogatepass")


def _blocks(items: DataFrame, size: int, window: int):
    """Blocks of (item_id, text) of about `size` bytes at most; one block is on the driver at a time."""
    block, held = [], 0
    for item, text in items.toLocalIterator():
        for piece in _pieces(text, size, window):
            if block and held + len(piece.encode("utf-8", "surrogatepass")) + ITEM_COST > size:
                yield block
                block, held = [], 0
            block.append((item, piece))
            held += len(piece.encode("utf-8", "surrogatepass")) + ITEM_COST
    yield block


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """One row a document: doc_id, text_key, n_words, spans (merged hits: word and code-point places), items (ids of items with a hit)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(docs["text"]).alias("text_key"), F.col("text").alias("text"))
    items = only(benchmark, "item_id", "text").select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null and text is not null")
    found = [_scan(rows, spark.sparkContext.broadcast(block), window) for block in _blocks(items, item_bytes, window)]
    if len(found) == 1:
        return found[0]
    # equal rows are counted, so that each comes back
    each = [x.groupBy("doc_id", "text_key").agg(F.count("*").cast("int").alias("copies"), *(F.first(c).alias(c) for c in ("n_words", "spans", "items"))) for x in found]
    whole = reduce(DataFrame.unionByName, each).groupBy("doc_id", "text_key").agg(F.max("copies").alias("copies"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")).withColumn("spans", _merged(F.col("spans")))
    return whole.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc_id", "text_key", "n_words", "spans", "items")


def _merged(spans):
    """Sorted union of overlapping spans."""
    kind = "array<struct<start:int,end:int,char_start:int,char_end:int>>"

    def step(done, x):
        last = F.element_at(done, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"), last["char_start"].alias("char_start"), F.greatest(last["char_end"], x["char_end"]).alias("char_end"))
        return F.when((F.size(done) > 0) & (x["start"] <= F.try_element_at(done, F.lit(-1))["end"]), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(spans), F.lit([]).cast(kind), step)
