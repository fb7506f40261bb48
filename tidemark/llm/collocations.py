"""Phrases of two to four words that stay together, by direct-address tiling of ranked ids.

Words are ranked by frequency over all languages, a word of each language being one of its own, and the first `HEAD` ranks are
their ids. Two neighbouring ids name a cell of a pair tile: `TILE` ids by `TILE` ids. A task counts the pairs of a chunk of
text tile by tile, those of a well-filled tile in a dense array addressed by the cell (numpy's bincount), those of a sparse one
as sorted coordinates, and Spark adds the counts of a cell over all tasks. The frequent pairs are ranked in their turn and get
ids; a pair id and the word behind it name a cell of the next level, so that triples are counted as pairs, and quadruples from
frequent triples likewise. A phrase can only be frequent if both phrases of one word less in it are.

What tasks must know is bounded: the first `HEAD` words and, of each level, the first `HEAD` phrases. If all frequent ones are
among them, the others need no look. If not, a phrase of which a part is beyond the ranks is counted by its text, in rows that
Spark adds up, so that nothing is dropped; what is known to be rare is still left out.

Text is lower-cased in A-Z, cut into pieces at [.,;:!?\\x0A-\\x0D] and into words [^\\x20\\x09]+; a phrase never passes the end of a
piece or text. A null text has no words, a null language is `und`. Repeated rows count each. A language without words or without
candidates gives no rows, an empty table none. Long texts are read slice by slice. Extra columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm._common import LOWER, dropped, only, stored

#: Ids of a tile's side; words or phrases of a level that tasks know by id; words of a chunk that is counted at once.
TILE, HEAD, CHUNK = 1 << 10, 1 << 20, 1 << 21
#: A tile is dense if it has at least this share of its cells' number as occurrences.
DENSE = 1 / 16
#: Bytes of a text that are split at once.
SLICE = 1 << 20
_BREAK = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes(ord(b"\n") if c in _BREAK else ord(b" ") if c == 9 else LOWER[c] for c in range(256))
#: Ids of a chunk besides words: the end of a piece, a word that is known to be rare.
END, RARE = -1, -2


def word_lists(text: bytes, width: int = SLICE) -> Iterator[list[bytes]]:
    """The words of a text in order, with b'\\n' for the end of a piece, a slice at a time."""
    at, n = 0, len(text)
    text = text.translate(_TABLE)
    while at < n:
        cut = min(n, at + width)
        while cut < n and text[cut] not in b" \n":  # on to the next end of a word
            step = text.find(b" ", cut), text.find(b"\n", cut)
            cut = min((x for x in step if x >= 0), default=n)
        yield [w for w in text[at:cut].replace(b"\n", b" \n ").split(b" ") if w]
        at = cut


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            b = batch.slice(lo, 500)
            yield from zip(b.column(0).to_pylist(), (t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()))


def _rows(docs: DataFrame) -> DataFrame:
    return only(docs, "lang", "text").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")


def words(docs: DataFrame, least: int, chunk: int = CHUNK) -> DataFrame:
    """lang, word, n of the words with n >= least, and of each language a row with a null word and the number of all its words; stored."""

    def run(batches):
        held: dict[str, Counter[bytes]] = {}

        def rows():
            for lang, counts in held.items():
                counts.pop(b"\n", None)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["lang", "word", "n"])
            held.clear()

        for lang, text in _texts(batches):
            own = held.setdefault(lang, Counter())
            for some in word_lists(text):
                own.update(some)
            if sum(map(len, held.values())) > chunk:
                yield from rows()
        yield from rows()

    each = _rows(docs).mapInArrow(run, "lang string, word binary, n long")
    counted = each.groupBy("lang", F.col("word").cast("string").alias("word")).agg(F.sum("n").alias("n"))
    # of each language one row of all its words beside one for each word
    both = counted.select("lang", "n", F.explode(F.array(F.col("word"), F.lit(None))).alias("word")).groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return stored(both.where((F.col("n") >= least) | F.col("word").isNull()))


class Level:
    """What tasks know of the phrases of one length: ids by rank, and whether these are all frequent ones."""

    def __init__(self, frequent: DataFrame, order: list[Column], head: int) -> None:
        ranked = frequent.orderBy(F.desc("n"), *order).limit(head + 1).toArrow()
        self.complete = ranked.num_rows <= head
        self.rows = ranked.slice(0, head)


class Words(Level):
    def __init__(self, frequent: DataFrame, head: int) -> None:
        super().__init__(frequent.select("lang", F.col("word").cast("binary").alias("word"), "n"), [F.col("lang"), F.col("word")], head)
        self.langs, self.names = self.rows["lang"].to_pylist(), self.rows["word"].to_pylist()
        self.made: dict[str, dict[bytes, int]] = {}
        del self.rows

    def ids(self, lang: str) -> dict[bytes, int]:
        """Ids of a language's words, and END for the end of a piece; made once a worker."""
        if not self.made:
            for i, (own, w) in enumerate(zip(self.langs, self.names)):
                self.made.setdefault(own, {})[w] = i
        known = self.made.setdefault(lang, {})
        known[b"\n"] = END
        return known


class Phrases(Level):
    """Phrases by code: the id of the phrase without its last word, and that word's id."""

    def __init__(self, frequent: DataFrame, head: int, complete: bool) -> None:
        super().__init__(frequent.where("code is not null").select("code", "n"), [F.col("code")], head)
        self.complete = self.complete and complete
        codes = self.rows["code"].to_numpy()
        self.by_rank = codes
        self.order = np.argsort(codes, kind="stable")
        self.sorted = codes[self.order]
        del self.rows

    def of(self, codes: np.ndarray) -> np.ndarray:
        """Ids of codes, -1 where there is none."""
        if not len(self.sorted):
            return np.full(len(codes), -1)
        at = np.minimum(np.searchsorted(self.sorted, codes), len(self.sorted) - 1)
        return np.where(self.sorted[at] == codes, self.order[at], -1)


def tiled(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes (two ids of 32 bits each) and how often each occurs, counted tile by tile."""
    a, b = codes >> 32, codes & 0xFFFFFFFF
    tile = (a // TILE) << 32 | (b // TILE)
    by = np.argsort(tile, kind="stable")
    a, b, tile = a[by], b[by], tile[by]
    first = np.flatnonzero(np.concatenate(([True], tile[1:] != tile[:-1]))) if len(tile) else np.zeros(0, int)
    size = np.diff(np.concatenate((first, [len(tile)])))
    out, n, sparse = [], [], np.ones(len(tile), bool)
    for lo, count in zip(first[size >= DENSE * TILE * TILE].tolist(), size[size >= DENSE * TILE * TILE].tolist()):
        own = slice(lo, lo + count)
        cells = np.bincount((a[own] % TILE) * TILE + b[own] % TILE, minlength=TILE * TILE)
        at = np.flatnonzero(cells)
        out.append((a[lo] // TILE * TILE + at // TILE) << 32 | (b[lo] // TILE * TILE + at % TILE))
        n.append(cells[at])
        sparse[own] = False
    rest, m = np.unique(a[sparse] << 32 | b[sparse], return_counts=True)
    return np.concatenate([*out, rest]), np.concatenate([*n, m])


class _Chunk:
    """Ids of words in text order, with the words themselves where an id is beyond the ranks."""

    def __init__(self, known: dict[bytes, int], complete: bool) -> None:
        self.known, self.complete = known, complete
        self.parts: list[np.ndarray] = []
        self.n, self.beyond = 0, {}
        self.names: list[bytes] = []

    def add(self, some: list[bytes]) -> None:
        known = self.known
        if self.complete:
            ids = [known.get(w, RARE) for w in some]
        else:
            ids = [known[w] if w in known else self._beyond(w) for w in some]
        if ids:
            self.parts.append(np.array(ids, np.int64))
            self.n += len(ids)

    def _beyond(self, w: bytes) -> int:
        i = self.beyond.setdefault(w, len(self.beyond))
        if i == len(self.names):
            self.names.append(w)
        return -3 - i

    def end(self) -> None:
        self.parts.append(np.array([END], np.int64))
        self.n += 1


def _counted(ids: np.ndarray, levels: list[Phrases]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of phrases of len(levels) + 2 words in text order, and the places of those that only their text tells."""
    size = len(levels) + 2
    n = len(ids) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # state of each phrase of the length so far at each place: its id, or -1 rare, or -2 unknown
    state = np.where(ids >= 0, ids, np.where(ids <= -3, -2, -1))
    for level in levels:
        known = (state[:-1] >= 0) & (state[1:] >= 0) & (ids[len(ids) - len(state) + 1 :] >= 0)
        last = ids[len(ids) - len(state) + 1 :]
        found = np.full(len(state) - 1, -1 if level.complete else -2)
        at = np.flatnonzero(known)
        got = level.of(state[at] << 32 | last[at])
        found[at] = np.where(got >= 0, got, -1 if level.complete else -2)
        found[(state[:-1] == -1) | (state[1:] == -1)] = -1
        found[~known & (found != -1)] = -2
        state = found
    last = ids[size - 1 :]
    a, b = state[:-1], state[1:]
    known = (a >= 0) & (b >= 0) & (last >= 0)
    unknown = ~known & (a != -1) & (b != -1)
    return a[known] << 32 | last[known], np.flatnonzero(unknown)


def phrases(docs: DataFrame, vocabulary: Words, levels: list[Phrases], least: int, chunk: int = CHUNK) -> DataFrame:
    """code or lang and phrase, n of all phrases of len(levels) + 2 words with n >= least; stored."""
    size = len(levels) + 2
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary, levels))  # `HEAD` words and phrases of a length at most

    def run(batches):
        vocabulary, levels = sent.value
        chunks: dict[str, _Chunk] = {}

        def rows(lang):
            held = chunks.pop(lang)
            at = np.concatenate(held.parts)
            codes, places = _counted(at, levels)
            codes, n = tiled(codes)
            yield codes, None, None, n
            if len(places):
                spans, m = np.unique(at[places[:, None] + np.arange(size)], axis=0, return_counts=True)
                name = lambda i: vocabulary.names[i] if i >= 0 else held.names[-3 - i]
                for lo in range(0, len(spans), 1 << 16):
                    some = spans[lo : lo + (1 << 16)]
                    yield None, lang, [b" ".join(map(name, x)) for x in some.tolist()], m[lo : lo + (1 << 16)]

        def made(lang):
            for codes, name, text, n in rows(lang):
                k = len(n)
                yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()) if codes is not None else pa.nulls(k, pa.int64()), pa.array([name] * k, pa.string()) if name is not None else pa.nulls(k, pa.string()), pa.array(text, pa.binary()) if text is not None else pa.nulls(k, pa.binary()), pa.array(n, pa.int64())], names=["code", "lang", "phrase", "n"])

        for lang, text in _texts(batches):
            if lang not in chunks:
                chunks[lang] = _Chunk(vocabulary.ids(lang), vocabulary.complete)
            for some in word_lists(text):
                chunks[lang].add(some)
                if chunks[lang].n > chunk:  # the last words go on to the next chunk, so that no phrase is lost or counted twice
                    held = chunks[lang]
                    tail = np.concatenate(held.parts[-4:])[1 - size :]
                    names = [None if i == END or i == RARE else vocabulary.names[i] if i >= 0 else held.names[-3 - i] for i in tail.tolist()]
                    yield from made(lang)
                    chunks[lang] = _Chunk(vocabulary.ids(lang), vocabulary.complete)
                    for i, w in zip(tail.tolist(), names):
                        chunks[lang].add([w]) if w is not None else chunks[lang].parts.append(np.array([i], np.int64))
            chunks[lang].end()
        for lang in list(chunks):
            yield from made(lang)

    each = _rows(docs).mapInArrow(run, "code long, lang string, phrase binary, n long")
    coded = each.select("code", F.col("lang"), F.col("phrase").cast("string").alias("phrase"), "n")
    return stored(coded.groupBy("code", "lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least))


def named(frequent: DataFrame, vocabulary: Words, levels: list[Phrases]) -> DataFrame:
    """lang, phrase, n of phrases by code or text."""

    sent = frequent.sparkSession.sparkContext.broadcast((vocabulary, levels))

    def run(batches):
        vocabulary, levels = sent.value
        for b in batches:
            ids, tails = b.column(0).to_numpy(), []
            for level in reversed([None, *levels]):
                tails.append(ids & 0xFFFFFFFF)
                ids = ids >> 32 if level is None else level.by_rank[ids >> 32]
            rows = [ids.tolist(), *(t.tolist() for t in reversed(tails))]
            text = [b" ".join(map(vocabulary.names.__getitem__, r)) for r in zip(*rows)]
            yield pa.RecordBatch.from_arrays([pa.array([vocabulary.langs[i] for i in rows[0]], pa.string()), pa.array(text, pa.binary()), b.column(1)], names=["lang", "phrase", "n"])

    coded = frequent.where("code is not null").select("code", "n").mapInArrow(run, "lang string, phrase binary, n long")
    return coded.select("lang", F.col("phrase").cast("string").alias("phrase"), "n").unionByName(frequent.where("code is null").select("lang", "phrase", "n"))


def _scored(facts: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score of the candidates among the facts (lang, phrase, size, n): the lowest-scoring cut, of equal ones the first."""
    cut = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    part = F.split("phrase", " ")
    cuts = facts.where("size > 1").select("lang", "phrase", F.col("n").alias("a"), "size", cut)
    cuts = cuts.withColumns({"left": F.array_join(F.slice(part, F.lit(1), F.col("k")), " "), "right": F.array_join(F.slice(part, F.col("k") + 1, F.col("size")), " ")})
    f = facts.select("lang", "phrase", "n")
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(f.select("lang", F.col("phrase").alias(side), F.col("n").alias(name)), ["lang", side])
    score = F.expr("cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("m")
    return cuts.groupBy("lang", "phrase", "size", "a").agg(lowest).select("lang", "phrase", "size", "a", "m.l", "m.r", "m.score")


def _inside(facts: DataFrame) -> DataFrame:
    """lang, phrase, longer: the count of the commonest longer candidate that holds the phrase."""
    part, size = F.split("phrase", " "), F.col("size")
    at = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: F.array_join(F.slice(part, i, m), " "))))
    held = facts.where("size > 2").select("lang", F.explode(at).alias("phrase"), "n")
    return held.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))


def mine(docs: DataFrame, least: int = 30, most: int = 4, share: int = 80, top: int = 2000, head: int = HEAD, chunk: int = CHUNK) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: of each language the `top` candidates by score.

    Candidates are phrases of two to `most` words that occur `least` times; one inside a longer candidate of at least `share`
    percent of its count is dropped.
    """
    found = words(docs, least, chunk)
    single = found.where("word is not null")
    vocabulary, levels = Words(single, head), []
    facts, made = [single.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("size"), "n")], [found]
    for size in range(2, most + 1):
        frequent = phrases(docs, vocabulary, levels, least, chunk)
        facts.append(named(frequent, vocabulary, levels).select("lang", "phrase", F.lit(size).alias("size"), "n"))
        made.append(frequent)
        if size < most:
            complete = vocabulary.complete and all(x.complete for x in levels)
            levels = [*levels, Phrases(frequent, head, complete)]
    every = stored(reduce(DataFrame.unionByName, facts))
    total = found.where("word is null").select("lang", F.col("n").alias("total"))
    kept = _scored(every).join(_inside(every), ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * share))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = kept.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    out = stored(first.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score"))
    dropped(*made, every)
    return out
