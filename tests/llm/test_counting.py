"""Collocations, centroids and exact duplicates against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import centroids, collocations, exact_dup
from tidemark.llm.queries import QUERIES

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


# collocations


def mined(rows, least, share=80, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, t in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for m in range(1, 5):
                f[lang or "und"].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, counts in f.items():
        c = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        gone = {q[i : i + m] for q, a in c.items() for m in range(2, len(q)) for i in range(len(q) - m + 1) if 100 * a >= share * c[q[i : i + m]]}
        found = []
        for p in c.keys() - gone:
            score, _, left, right = min((2000000 * c[p] // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -c[p], " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def phrase_texts():
    rng = random.Random(2)
    words = ["New", "york", "city", "hall", "née", "\x01", "a" * 300, *"abcdefgh"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ", ", "\n", "."]) for _ in range(n))
    fixed = [None, "", " \t\n", "...", "new york city hall " * 60, "a a a a a a a a", "new york. city hall"]
    rows = [(rng.choice(["en", "de", None, "und"]), t) for t in [*fixed, *(text(rng.randint(1, 80)) for _ in range(60)), text(6000)]]
    return [*rows, rows[10], rows[10]]


@pytest.fixture(scope="module")
def phrases(spark):
    rows = phrase_texts()
    return rows, spark.createDataFrame(rows, "lang string, text string").withColumns({"n": F.lit("x"), "word": F.lit(1), "code": F.lit(2), "rank": F.lit(3), "phrase": F.lit("p")}).repartition(3).cache()


@pytest.mark.parametrize("options", [{}, {"chunk": 50}, {"head": 5}, {"head": 12, "chunk": 64}, {"head": 1}, {"top": 3, "least": 4}])
def test_collocations(phrases, options):
    rows, docs = phrases
    options = {"least": 6, **options}
    got = sorted(tuple(r) for r in collocations.mine(docs, **options).collect())
    assert got == mined(rows, options["least"], top=options.get("top", 2000)) and got


def test_collocations_of_nothing(phrases):
    _, docs = phrases
    assert collocations.mine(docs.where("false")).count() == collocations.mine(docs.where("text is null")).count() == 0


def test_words_in_slices():
    rng = random.Random(7)
    for _ in range(200):
        t = "".join(rng.choice(["ab", "é", " ", "\t", ".", "\n", "c" * 9]) for _ in range(rng.randint(0, 60))).encode()
        want = [w for p in re.findall(rb"[.,;:!?\n\x0b\x0c\r]|[^\x20\x09.,;:!?\n\x0b\x0c\r]+", t) for w in [b"\n" if p in b".,;:!?\n\x0b\x0c\r" else p]]
        for width in (1, 3, 8, 1000):
            assert [w for some in collocations.word_lists(t, width) for w in some] == want


def test_tiles_count_as_a_counter_does():
    rng = np.random.default_rng(1)
    near = rng.integers(0, 40, 200_000) << 32 | rng.integers(0, 3000, 200_000)
    far = rng.integers(0, 1 << 30, 500) << 32 | rng.integers(0, 1 << 31, 500)
    codes, n = collocations.tiled(np.concatenate((near, far, far[:50])))
    assert dict(zip(codes.tolist(), n.tolist())) == Counter([*near.tolist(), *far.tolist(), *far[:50].tolist()]) and len(set(codes.tolist())) == len(codes)
    assert len(collocations.tiled(np.zeros(0, np.int64))[0]) == 0


# centroids


def clustered(rows, k=8, rounds=10, dims=64):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    c = [v for _, v in sorted(((sha(f"3:{i}"), v) for i, v in kept if i is not None))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, x)), j) for j, x in enumerate(c))

    for _ in range(rounds if c else 0):
        own = defaultdict(list)
        for _, v in kept:
            own[nearest(v)[1]].append(v)
        for j, vs in own.items():
            c[j] = [sum(x) // len(vs) for x in zip(*vs)]
    return [(i, nearest(v)[1], nearest(v)[0]) for i, v in kept] if c else [], c


def vectors(n=160, dims=64):
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(6, dims)) + np.arange(6)[:, None]
    rows = [(i, (middle[i % 6] + rng.normal(scale=0.4, size=dims)).astype(np.float32).tolist()) for i in range(n)]
    rows += [(n, rows[0][1]), (n, rows[0][1]), (None, rows[1][1]), (n + 1, None), (n + 2, []), (n + 3, [1.0] * (dims - 1)), (n + 4, [None] + [0.0] * (dims - 1)), (n + 5, [float("nan")] * dims), (n + 6, [float("inf")] * dims), (n + 7, [0.0] * dims), (n + 8, [-0.0005] * dims)]
    return rows


def test_centroids(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"id": F.lit(1), "v": F.lit("x"), "cluster": F.lit(2), "distance": F.lit(3)}).repartition(3)
    found, final = centroids.cluster(df)
    want, c = clustered(rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    out = centroids.with_inertia(found, final).collect()
    assert final == c and sorted(((r.id, r.cluster, r.distance) for r in out), key=key) == sorted(want, key=key)
    assert sum(r.n_tried for r in out) < 0.8 * len(out) * len(c)  # means tell these apart
    by = Counter()
    for _, j, d in want:
        by[j] += d
    assert all((r.cluster_inertia, r.inertia, r.centroid_sha256) == (by[r.cluster], sum(by.values()), sha(",".join(map(str, c[r.cluster])))) for r in out)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.5] * 64), (2, [0.5] * 64), (3, [0.25] * 64)], [(None, [0.5] * 64)]])
def test_few_vectors(spark, rows):
    found, final = centroids.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    want, c = clustered(rows)
    assert final == c and sorted((r.id, r.cluster, r.distance) for r in centroids.with_inertia(found, final).collect()) == sorted(want)


@pytest.mark.parametrize("k,dims", [(1, 3), (40, 4), (200, 16)])
def test_search_is_exact(k, dims):
    rng = np.random.default_rng(k)
    c, v = rng.integers(-50, 50, (k, dims)), rng.integers(-60, 60, (500, dims))
    c[k // 2] = c[0]  # a tie
    which, best, tried = centroids.Searcher(c.tolist()).nearest(v)
    d = ((v[:, None] - c[None]) ** 2).sum(axis=2)
    assert (which == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all() and (k < 40 or tried.mean() < k)


def test_large_components(spark):
    with pytest.raises(Exception, match="after scaling"):
        centroids.cluster(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<float>"))


# exact duplicates


def copies():
    rng = random.Random(9)
    texts = [None, "", " ", "a", "A", "a ", "é", "é", "long " * 40_000, *(f"text {i}" for i in range(150))]
    rows = [(i, rng.choice(texts)) for i in range(600)] + [(i, "hot") for i in range(1000, 1400)]
    return [*rows, rows[3], rows[3], (None, "text 3"), (None, "no id"), (None, "no id"), (7, "second text of one id")]


@pytest.mark.parametrize("options", [{}, {"capacity": 4, "depth": 9}, {"capacity": 1, "depth": 3, "bits": 1 << 15, "heavy": 4}])
def test_exact_duplicates(spark, options):
    rows = copies()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit(1), "sha": F.lit("s"), "row": F.lit(2), "n": F.lit(3), "page": F.lit(4), "kept": F.lit(5)}).repartition(3)
    groups, copy = defaultdict(list), Counter()
    for i, t in rows:
        groups[sha(t or "")].append(i)
    for r in exact_dup.exact_duplicates(df, **options).collect():
        own = groups[bytes(r.sha).hex()]
        assert r.group_size == len(own) and r.keep_id == max((i for i in own if i is not None), default=None)
        assert not r.kept or r.doc_id == r.keep_id
        copy[bytes(r.sha).hex(), r.kept] += 1
    assert all(copy[t, True] == 1 and copy[t, False] == len(own) - 1 for t, own in groups.items())
    assert exact_dup.exact_duplicates(df.where("false"), **options).count() == 0


def test_directory_doubles(spark):
    rng = random.Random(3)
    slots = [rng.choice([rng.randrange(256), rng.randrange(8)]) for _ in range(3000)]
    count = Counter(slots)
    got = {r.slot: (r.local_depth, r.bucket) for r in exact_dup.directory(spark.createDataFrame([(s,) for s in slots], "slot int"), capacity=100, depth=8).collect()}

    def split(prefix, d):
        own = [s for s in count if s >> (8 - d) == prefix]
        if sum(count[s] for s in own) > 100 and d < 8:
            return split(2 * prefix, d + 1) | split(2 * prefix + 1, d + 1)
        return {s: (d, (1 << d) + prefix) for s in own}

    assert got == split(0, 0)


@pytest.mark.parametrize("n", (11, 12, 13))
def test_queries(spark, n, tmp_path):
    spark.createDataFrame([(i, t, "en") for i, t in copies()], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(vectors(40), "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    (query,) = (q for name, q in QUERIES.items() if name.startswith(f"op{n}_"))
    out = query(spark, str(tmp_path))
    if n == 11:
        assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(tuple(r) for r in out.collect()) == mined([("en", t) for _, t in copies()], 30)
    elif n == 12:
        want, c = clustered(vectors(40))
        assert Counter((r.vec_id, r.cluster, r.distance, r.centroid_sha256) for r in out.collect()) == Counter((i, j, d, sha(",".join(map(str, c[j])))) for i, j, d in want)
    else:
        by = Counter(t or "" for _, t in copies())
        assert Counter((r.text_sha256, r.group_size) for r in out.collect()) == Counter({(sha(t), n): n for t, n in by.items()})
