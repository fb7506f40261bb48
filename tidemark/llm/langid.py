"""Language identification: script ranges narrow the languages of each word, then Viterbi over per-word scores with a switching penalty labels the spans of mixed text.

The model holds, for each language, counts of hashed letter trigrams (words padded by blanks) and of letters by script. It is fit on
labelled documents, all of them up to `FIT_DOCS` and else a share of them chosen by a hash of doc_id; its size is fixed by the
number of languages. Prediction covers every whole text.

Null text, text without a letter and a model without labels give `und`, score 0 and no spans. Repeated rows are answered
each; ties go to the language first in order. A row with a null doc_id is answered like any other; in the query it is neither
learned from nor held out. An empty table gives no rows; extra columns stay, but for those named like an output.
"""

from __future__ import annotations

from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labelled documents that the model is fit on at most (as an expectation).
FIT_DOCS = 50_000
BUCKETS = 1 << 16
#: What a change of language between two words costs, in natural log units.
SWITCH = 12.0
#: A word in a script that a language is not written in costs that language this much.
FOREIGN = 40.0
#: Share of a language's letters that makes a script its own.
SHARE = 0.01
#: First code points of Unicode script ranges, in order (fixed values): basic and extended Latin, Greek, Cyrillic, Armenian, Hebrew, Arabic, Indic and South-East Asian blocks, Hangul, Kana, Han.
SCRIPTS = ((0x0041, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "indic"), (0x0E00, "thai"), (0x0E80, "asian"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "han"), (0xA000, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "other"), (0x20000, "han"))
_NAMES = sorted({n for _, n in SCRIPTS})
_STARTS = np.array([s for s, _ in SCRIPTS], np.uint32)
_SCRIPT = np.array([_NAMES.index(n) for _, n in SCRIPTS], np.int64)
#: Code points looked at, and characters of documents labelled, at a time.
_PIECE = 1 << 18
#: Documents of a slice that are labelled alone if they are much longer than all others.
ALONE = 16


class _Letters:
    """Which code points are letters; made once a process."""

    table: np.ndarray | None = None

    @classmethod
    def of(cls, points: np.ndarray) -> np.ndarray:
        if cls.table is None:
            cls.table = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        return cls.table[points]


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # BUCKETS x languages, natural log
    foreign: np.ndarray  # scripts x languages, 0 or -FOREIGN

    @classmethod
    def of(cls, counts: dict[tuple[str, int], int]) -> Model:
        langs = sorted({lang for lang, _ in counts})
        at = {lang: i for i, lang in enumerate(langs)}
        raw = np.zeros((BUCKETS + len(_NAMES), max(1, len(langs))), np.float64)
        for (lang, bucket), n in counts.items():
            raw[bucket, at[lang]] = n
        grams, scripts = raw[:BUCKETS] + 0.25, raw[BUCKETS:]
        own = scripts >= SHARE * np.maximum(scripts.sum(0), 1)
        own[~own.any(1)] = True  # a script that no language has narrows nothing
        return cls(langs, np.log(grams / grams.sum(0)).astype(np.float32), np.where(own, 0, -FOREIGN).astype(np.float32))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _features(points: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the letters in points[lo:hi]: their places, their trigram buckets (lower case, with the neighbours outside), and which of them begin a word."""
    base = max(lo - 1, 0)
    p = points[base : hi + 1]
    letter = _Letters.of(p)
    low = np.where((p >= 65) & (p <= 90) | (p >= 0xC0) & (p <= 0xDE) & (p != 0xD7) | (p >= 0x391) & (p <= 0x3A9) | (p >= 0x410) & (p <= 0x42F), p + 32, p)
    padded = np.zeros(len(p) + 2, np.uint32)
    padded[1:-1] = np.where(letter, low, 0)
    at = np.flatnonzero(letter[lo - base : hi - base]) + (lo - base)
    a, b, c = padded[at], padded[at + 1], padded[at + 2]
    h = a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77) + c * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return at + base, (h >> np.uint32(16)).astype(np.int64), a == 0


def _scripts(points: np.ndarray) -> np.ndarray:
    return _SCRIPT[np.maximum(np.searchsorted(_STARTS, points, "right") - 1, 0)]


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", fit_docs: int = FIT_DOCS) -> Model:
    """The model of `labelled` rows; rows with null text or label are left out."""
    rows = labelled.select(F.col(key).alias("k"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("text is not null and lang is not null")
    n = rows.count()
    if n > fit_docs:
        rows = rows.where(F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < int(fit_docs / n * (1 << 30)))

    def run(it):
        sums: dict[str, np.ndarray] = {}
        for batch in it:
            for t, name in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                total = sums.setdefault(name, np.zeros(BUCKETS + len(_NAMES), np.int64))
                points = _points(t)
                for lo in range(0, len(points), _PIECE):
                    places, bucket, _ = _features(points, lo, lo + _PIECE)
                    np.add.at(total, bucket, 1)
                    total[BUCKETS:] += np.bincount(_scripts(points[places]), minlength=len(_NAMES))
        for name, total in sums.items():
            kept = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(kept), pa.string()), pa.array(kept.astype(np.int32)), pa.array(total[kept])], names=["lang", "bucket", "n"])

    counts = rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    return Model.of({(r[0], r[1]): r[2] for r in counts.toLocalIterator()})


def _path_alone(scores: np.ndarray) -> np.ndarray:
    """Viterbi labels of one document's words."""
    n_lang = scores.shape[1]
    best, came = scores[0].tolist(), array("h", range(n_lang))
    for lo in range(1, len(scores), 1 << 14):
        for now in scores[lo : lo + (1 << 14)].tolist():
            top = max(best)
            k, change = best.index(top), top - SWITCH
            came.extend([i if b >= change else k for i, b in enumerate(best)])
            best = [(b if b >= change else change) - top + x for b, x in zip(best, now)]
    out = np.empty(len(scores), np.int16)
    label = best.index(max(best))
    for t in range(len(scores) - 1, -1, -1):
        out[t] = label
        label = came[t * n_lang + label]
    return out


def _paths(scores: list[np.ndarray]) -> list[np.ndarray]:
    """Viterbi labels of each document's words. A few documents much longer than the rest go alone; the others advance together, a word a step."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    out: list[np.ndarray] = [None] * len(scores)  # type: ignore[list-item]
    few = [i for i in order[:ALONE] if len(scores[i]) > 2 * len(scores[order[min(ALONE, len(order) - 1)]])]
    for i in few:
        out[i] = _path_alone(scores[i])
    order = order[len(few) :]
    if not order:
        return out
    n_lang = scores[0].shape[1]
    active = np.array([len(scores[i]) for i in order])
    flat = np.concatenate([scores[i] for i in order])
    first = np.concatenate(([0], np.cumsum(active)))[:-1]
    came = np.zeros(flat.shape, np.int16)  # language of the word before, if this word has this language
    best = np.zeros((len(order), n_lang), np.float32)
    own = np.arange(n_lang, dtype=np.int16)
    for t in range(int(active[0])):
        n = int(np.searchsorted(-active, -t, "left"))
        at = first[:n] + t
        now = flat[at]
        if t:
            top = best[:n].argmax(1)
            change = np.take_along_axis(best[:n], top[:, None], 1) - SWITCH
            stay = best[:n] >= change
            came[at] = np.where(stay, own, top[:, None].astype(np.int16))
            now = now + np.where(stay, best[:n], change)
            now -= now.max(1, keepdims=True)
        best[:n] = now
    label = best.argmax(1).astype(np.int16)
    flat_path = np.zeros(len(flat), np.int16)
    for t in range(int(active[0]) - 1, -1, -1):
        n = int(np.searchsorted(-active, -t, "left"))
        at = first[:n] + t
        flat_path[at] = label[:n]
        label[:n] = came[at, label[:n]] if t else label[:n]
    for k, i in enumerate(order):
        out[i] = flat_path[first[k] : first[k] + active[k]]
    return out


def _words(text: str, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores, code-point starts and ends of the words of a text, which is looked at in pieces; a word that runs over a piece's end goes on in the next."""
    points = _points(text)
    scores, starts, ends = [], [], []
    for lo in range(0, len(points), _PIECE):
        at, bucket, begins = _features(points, lo, lo + _PIECE)
        if not len(at):
            continue
        b = np.flatnonzero(begins) if begins[0] else np.concatenate(([0], np.flatnonzero(begins)))
        s = np.add.reduceat(model.weights[bucket], b, axis=0)
        s += np.where(begins[b, None], model.foreign[_scripts(points[at[b]])], 0)
        end = at[np.concatenate((b[1:], [len(at)])) - 1] + 1
        over = int(not begins[0])
        if over:
            scores[-1][-1] += s[0]
            ends[-1][-1] = end[0]
        if len(b) > over:
            scores.append(s[over:]), starts.append(at[b[over:]]), ends.append(end[over:])
    if not scores:
        return _none(model), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(scores), np.concatenate(starts), np.concatenate(ends)


def _none(model: Model) -> np.ndarray:
    return np.zeros((0, max(1, len(model.langs))), np.float32)


def _slices(batch: pa.RecordBatch, text: int):
    """Slices of a batch of about 4 * _PIECE characters of text."""
    lo = held = 0
    for i, n in enumerate(pc.utf8_length(batch.column(text)).to_pylist()):
        held += (n or 0) + 64
        if held >= 4 * _PIECE:
            yield batch.slice(lo, i + 1 - lo)
            lo, held = i + 1, 0
    if lo < batch.num_rows:
        yield batch.slice(lo)


def identify(docs: DataFrame, model: Model, text: str = "text", names: tuple[str, ...] = ("lang_pred", "score", "lang_spans")) -> DataFrame:
    """docs with lang_pred, score (the share of letters in words of that language) and lang_spans (start, end, lang in code points), or under other names; with two names, without the spans."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)
    kept = [f for f in docs.schema.fields if f.name not in names]
    at = [docs.columns.index(f.name) for f in kept]
    text_at = docs.columns.index(text)
    kinds = ("string", "double", "array<struct<start:int,end:int,lang:string>>")
    added = [T.StructField(n, T.StructType.fromDDL(f"x {k}")[0].dataType) for n, k in zip(names, kinds)]
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(it):
        m = held.value
        for big in it:
            for batch in _slices(big, text_at):
                found = [_words(t, m) if t and m.langs else (_none(m), None, None) for t in batch.column(text_at).to_pylist()]
                pred, score, spans = [], [], []
                for path, (_, start, end) in zip(_paths([f[0] for f in found]), found):
                    if not len(path):
                        pred.append("und"), score.append(0.0), spans.append([])
                        continue
                    share = np.bincount(path, weights=end - start, minlength=len(m.langs))
                    top = int(share.argmax())
                    pred.append(m.langs[top]), score.append(float(share[top] / share.sum()))
                    if len(names) > 2:
                        cut = np.flatnonzero(np.concatenate(([True], path[1:] != path[:-1])))
                        stop = np.concatenate((cut[1:], [len(path)])) - 1
                        spans.append([{"start": int(start[a]), "end": int(end[z]), "lang": m.langs[path[a]]} for a, z in zip(cut, stop)])
                made = [pa.array(pred, pa.string()), pa.array(score, pa.float64())]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in at), *made, *([pa.array(spans, span)] if len(names) > 2 else [])], names=[*(f.name for f in kept), *names])
                found = made = spans = None
            pa.default_memory_pool().release_unused()  # the worker lives on for later stages

    return docs.mapInArrow(run, T.StructType([*kept, *added]))
