"""BPE encoding and decoding: a bounded-lookahead streaming transducer and an incremental byte-to-text decoder.

Encoding reads the text in slices and emits a token as soon as no text to its right can change it. Two lookaheads say when
that is. Two characters decide where a pre-token ends (`EDGE`). Within a pre-token the merge list alone decides
(`Merges.lookahead`): a byte on the right changes a boundary on its left only through a chain of merges of rising rank, each
of which reaches left by its left part. So no more than a slice, `OPEN` characters and a few lookaheads of bytes are held,
whatever the text looks like. Short pre-tokens met before come from a bounded cache, which holds what the transducer gave.

Null text counts as empty: no ids, decoded text ''. Null, empty and very long texts, repeated rows and empty tables
give one output row for each input row; extra columns stay, but for those named like an output.
"""

from __future__ import annotations

import codecs
import heapq
import json
from array import array
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm._chunks import BLOCK, units
from tidemark.llm._common import rested

#: The byte-level pre-tokeniser's pattern (fixed value); White_Space is what its \s means.
_W = r"\p{White_Space}"
PATTERN = regex.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_W}\p{{L}}\p{{N}}]+|{_W}+(?!\P{{White_Space}})|{_W}+")
#: Characters behind a pre-token that decide its end: "'r" may go on to "'re", and a run of white space leaves its last to a word.
EDGE = 2
#: Characters of a pre-token without an end in sight, from which on its tokens are emitted before its end is known.
OPEN = 1024
#: What an open pre-token goes on with, by the kind of its first character.
_KINDS = [regex.compile(p) for p in (rf"{_W}*+", r"\p{L}*+", r"\p{N}*+", rf"[^{_W}\p{{L}}\p{{N}}]*+")]
#: Units kept with their tokens; when full it starts anew, so that memory stays bounded.
CACHE = 600_000
#: The same where the cache lives as long as a task.
TASK_CACHE = 150_000
_NONE = 1 << 60


def _alphabet() -> dict[str, int]:
    """The vocabulary file's letter for each byte: printable bytes stand for themselves, the rest follow from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """The merge list of a byte-level BPE vocabulary file."""

    def __init__(self, path: str) -> None:
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        letters, vocab = _alphabet(), spec["model"]["vocab"]
        self.bytes_of = {i: bytes(map(letters.__getitem__, t)) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.byte_id = [0] * 256
        for s, b in letters.items():
            self.byte_id[b] = vocab[s]
        self.rank: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []
        self.parts: list[tuple[int, int]] = []
        for pair in spec["model"]["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[a], vocab[b]] = len(self.merged)
            self.merged.append(vocab[a + b])
            self.parts.append((vocab[a], vocab[b]))
        self.lookahead = self._lookahead()

    def _lookahead(self) -> int:
        """Bytes to the right of a boundary that decide it.

        reach[m] is how far left of merge m's start a change can get that m carries: its left part x, then the merges of
        higher rank whose right part begins with x. Ranks are visited from the last to the first, so `best` holds those of
        higher rank alone.
        """
        first_part = {}
        for m, (a, _) in zip(self.merged, self.parts, strict=True):
            first_part.setdefault(m, a)
        best: dict[int, int] = {}
        most = 1
        for a, b in reversed(self.parts):
            reach = len(self.bytes_of[a]) + best.get(a, 0)
            most = max(most, reach)
            while b is not None:
                if best.get(b, 0) < reach:
                    best[b] = reach
                b = first_part.get(b)
        return most

    def merge(self, piece: bytes) -> list[int]:
        """Tokens of a whole pre-token."""
        ids = [self.byte_id[b] for b in piece]
        if len(ids) > 48:
            return self._merge_long(ids)
        rank, merged = self.rank.get, self.merged
        ranks = [rank(p, _NONE) for p in zip(ids, ids[1:])]
        while ranks:
            low = min(ranks)
            if low == _NONE:
                break
            i = ranks.index(low)
            made = ids[i] = merged[low]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank((ids[i - 1], made), _NONE)
            if i < len(ranks):
                ranks[i] = rank((made, ids[i + 1]), _NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, rank = len(ids), self.rank.get
        after, before, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := rank((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = self.merged[r], False, after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if (q := rank((ids[i], ids[after[i]]))) is not None:
                    heapq.heappush(heap, (q, i, ids[i], ids[after[i]]))
            if (p := before[i]) >= 0 and (q := rank((ids[p], ids[i]))) is not None:
                heapq.heappush(heap, (q, p, ids[p], ids[i]))
        return [x for x, ok in zip(ids, alive) if ok]


class Transducer:
    """Bytes of one pre-token in, its tokens out once they are stable; `end` gives the last ones and starts anew."""

    def __init__(self, merges: Merges) -> None:
        self.merges, self.held = merges, b""
        self.size = {i: len(b) for i, b in merges.bytes_of.items()}
        self.room = 4 * merges.lookahead + 1024

    def push(self, data: bytes) -> list[int]:
        out = []
        for at in range(0, len(data), self.room):
            self.held += data[at : at + self.room]
            if len(self.held) > self.room:
                out += self._stable()
        return out

    def _stable(self) -> list[int]:
        """Tokens that end a lookahead before what is held does; BPE of the rest goes on as if they had never been there."""
        found, done, last = self.merges.merge(self.held), 0, len(self.held) - self.merges.lookahead
        for n, t in enumerate(found):
            if done + self.size[t] > last:
                break
            done += self.size[t]
        self.held = self.held[done:]
        return found[:n]

    def end(self, data: bytes = b"") -> list[int]:
        out = self.push(data) if data else []
        out += self.merges.merge(self.held)
        self.held = b""
        return out


class Encoder:
    """Text to ids, a slice at a time. Units met before come from a bounded cache, as their ids' bytes.

    `push` gives the ids that are stable after a slice; what it holds back begins at a pre-token's start, or belongs to an open
    pre-token whose bytes are in the transducer already. `end` gives the rest.
    """

    def __init__(self, merges: Merges, cache: int = CACHE) -> None:
        self.merges, self._most = merges, cache
        self._run, self._held, self._open = Transducer(merges), "", None
        self._inner: dict[str, bytes] = {}  # of what follows a blank, with that blank
        self._first: dict[str, bytes] = {}
        self._special = regex.compile("|".join(map(regex.escape, sorted(merges.special, key=len, reverse=True)))) if merges.special else None

    def _piece(self, piece: str) -> bytes:
        """Ids of one pre-token."""
        known, key = (self._inner, piece[1:]) if piece[0] == " " else (self._first, piece)
        held = known.get(key)
        if held is None:
            raw = piece.encode("utf-8", "surrogatepass")
            held = array("i", self._run.end(raw)).tobytes()
            if len(raw) < 64:
                if len(known) > self._most:
                    known.clear()
                known[key] = held
        return held

    def _unit(self, unit: str) -> bytes:
        """Ids of a unit; one that is a pre-token as it stands needs no pattern."""
        if unit[1:].isalpha() and (unit[0] == " " or unit[0].isalpha()):
            return self._piece(unit)
        return b"".join(map(self._piece, PATTERN.findall(unit)))

    def _block(self, block: str) -> bytes:
        first, *rest = units(block)
        found = list(map(self._inner.get, rest))
        if None in found:
            if len(self._inner) > self._most:
                self._inner.clear()
            for i, hit in enumerate(found):
                if hit is None:
                    word = rest[i]
                    found[i] = hit = self._inner.get(word) or self._unit(" " + word)
                    if len(word) < 64:
                        self._inner[word] = hit
        return b"".join([self._unit(first) if first else b"", *found])

    def _go_on(self, held: str, final: bool) -> tuple[bytes, str]:
        """What an open pre-token takes of `held`, as ids, and what is left; it stays open if there is no end to it."""
        stop = self._open.match(held).end()
        over = stop < len(held)
        if self._open is _KINDS[0] and (over or not final):
            stop -= 1  # the last white space may belong to a word
        data = held[:stop].encode("utf-8", "surrogatepass")
        if not over and not final:
            return array("i", self._run.push(data)).tobytes(), held[stop:]
        self._open = None
        return array("i", self._run.end(data)).tobytes(), held[stop:]

    def push(self, chars: str) -> bytes:
        """Ids that are stable with these characters."""
        held, out = self._held + chars, []
        if self._open:
            ids, held = self._go_on(held, False)
            out.append(ids)
            if self._open:
                self._held = held
                return ids
        # a blank between two non-spaces ends what is before it
        cut = held.rfind(" ", 0, -1)
        while cut > 0 and (held[cut - 1].isspace() or held[cut + 1].isspace()):
            cut = held.rfind(" ", 0, cut)
        if cut > 0:
            out.append(self._block(held[:cut]))
            held = held[cut:]
        if len(held) > OPEN:
            at = 0
            for m in PATTERN.finditer(held):
                if m.end() > len(held) - EDGE:
                    break
                out.append(self._piece(m[0]))
                at = m.end()
            held = held[at:]
            if len(held) > OPEN:
                blank = held[0] == " " and not _KINDS[0].fullmatch(held[1])
                self._open = next(k for k in _KINDS if k.fullmatch(held[blank]))
                if blank:
                    out.append(array("i", self._run.push(b" ")).tobytes())
                    held = held[1:]
                ids, held = self._go_on(held, False)
                out.append(ids)
        self._held = held
        return b"".join(out)

    def end(self, chars: str = "") -> bytes:
        """Ids of these last characters and of all that is held."""
        held, out, self._held = self._held + chars, b"", ""
        if self._open:
            out, held = self._go_on(held, True)
        return out + self._block(held) if held else out

    def feed(self, text: str):
        """Ids as bytes of 32-bit integers, each slice's when it is read."""
        at = 0
        for m in self._special.finditer(text) if self._special and any(s in text for s in self.merges.special) else ():
            yield from self._part(text, at, m.start())
            yield array("i", [self.merges.special[m[0]]]).tobytes()
            at = m.end()
        yield from self._part(text, at, len(text))

    def _part(self, text: str, start: int, stop: int):
        while stop - start > BLOCK:
            yield self.push(text[start : start + BLOCK])
            start += BLOCK
        yield self.end(text[start:stop])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join(self.feed(text)), np.int32).tolist()


class Decoder:
    """Ids to text, a slice at a time; bytes of an unfinished character wait for the next slice."""

    def __init__(self, merges: Merges) -> None:
        self.table = [merges.bytes_of.get(i, b"") for i in range(max(merges.bytes_of) + 1)]

    def decode(self, ids, step: int = 1 << 16) -> str:
        state, out = codecs.getincrementaldecoder("utf-8")("replace"), []
        for at in range(0, len(ids), step):
            out.append(state.decode(b"".join(map(self.table.__getitem__, np.asarray(ids[at : at + step]).tolist()))))
        out.append(state.decode(b"", True))
        return "".join(out)


_LOADED: dict[tuple[type, str], Encoder | Decoder] = {}


def _one(kind: type, path: str) -> Encoder | Decoder:
    """One encoder or decoder a process: a worker that only decodes keeps no merges."""
    if (kind, path) not in _LOADED:
        _LOADED[kind, path] = kind(Merges(path))
    return _LOADED[kind, path]


def loaded(path: str) -> tuple[Encoder, Decoder]:
    return _one(Encoder, path), _one(Decoder, path)


def _added(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*(f for f in schema.fields if f.name != name), T.StructField(name, kind)])


def _batches(it, name, make, limit=2_000):
    for batch in it:
        for at in range(0, batch.num_rows, limit):
            b = batch.slice(at, limit)
            kept = [(n, b.column(i)) for i, n in enumerate(b.schema.names) if n != name]
            yield pa.RecordBatch.from_arrays([*(c for _, c in kept), make(b)], [*(n for n, _ in kept), name])


def _encoded(it, encoder: Encoder, text: str, ids: str):
    def make(b):
        rows = [b"".join(encoder.feed(t)) if t else b"" for t in b.column(text).to_pylist()]
        ends = np.concatenate(([0], np.cumsum([len(r) // 4 for r in rows]))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(rows), np.int32)))

    return _batches(it, ids, make, 500)


def _decoded(it, decoder: Decoder, ids: str, text: str):
    def make(b):
        col = b.column(ids)
        flat, ends = col.values.to_numpy(), col.offsets.to_pylist()
        return pa.array([decoder.decode(flat[a:z]) for a, z in zip(ends, ends[1:])], pa.string())

    return _batches(it, text, make, 500)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with the token ids of `text` as array<int> in `ids`; null text gives an empty array."""

    def run(it):
        yield from _encoded(it, _one(Encoder, path), text, ids)

    return docs.mapInArrow(run, _added(docs.schema, ids, T.ArrayType(T.IntegerType())))


def decode(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """docs with the text of `ids` in `text`; null ids give ''."""

    def run(it):
        yield from _decoded(it, _one(Decoder, path), ids, text)

    return docs.mapInArrow(run, _added(docs.schema, text, T.StringType()))


def _both(it, path: str, text: str, ids: str, decoded: str):
    """Batches with ids and decoded text; the merges and what was met go when the task ends, as its worker lives on for other stages."""
    merges = Merges(path)
    yield from _decoded(_encoded(it, Encoder(merges, TASK_CACHE), text, ids), Decoder(merges), ids, decoded)
    del merges
    rested()


def encode_and_decode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """decode(encode(docs)), in one worker a task instead of two, which keeps nothing of it."""

    def run(it):
        yield from _both(it, path, text, ids, decoded)

    return docs.mapInArrow(run, _added(_added(docs.schema, ids, T.ArrayType(T.IntegerType())), decoded, T.StringType()))
