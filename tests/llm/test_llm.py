"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeated rows and extra columns."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, ctw, decontam, fingerprint, langid, near_dup, pii, rlz, suffix_repeats, token_files
from tidemark.llm.queries import QUERIES, vocabulary

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def corpus():
    rng = random.Random(5)
    vocab = ["the", "of", "Été", "maß", "niño", *("".join(rng.choice("aeiorstnl") for _ in range(rng.randint(2, 8))) for _ in range(300))]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    shared, base = prose(70), prose(150)
    texts = [None, "", " \n\t ", "one", "two words", "Mail a.b@c.example.org, x@y.z..q@r.s", "999.1.1.1 10.0.0.255 4111 1111 1111 1111 +1 (212) 555-0100", base, base, base]
    for k in range(12):
        w = base.split(" ")
        for i in rng.sample(range(len(w)), 1 + k):
            w[i] = rng.choice(vocab)
        texts.append(" ".join(w))
    texts += [f"{prose(rng.randint(3, 60))}  {shared}\n{prose(rng.randint(0, 60))}" for _ in range(8)]
    texts += [prose(rng.randint(1, 200)) for _ in range(25)] + [prose(20_000), "a" * 3000, shared + " " + shared, "x\x00y \x1c z w <|endoftext|> end"]
    return [(10 * i + 3, t, ("en", "de", None)[i % 3]) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"n": F.lit(1), "comp": F.lit("x"), "start": F.lit(0), "terms": F.lit("t"), "ids": F.lit("i"), "score": F.lit("s")}).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# PII

BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: luhn(v)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= sum(c.isdigit() for c in v) <= 15),
]


def luhn(v):
    d = [int(c) for c in v if c.isdigit()][::-1]
    return 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


def base_spans(t):
    return [(k, m.start(), m.end()) for k, p, ok in BASE for m in re.finditer(p, t or "") if ok(m[0])]


def test_pii_base(spark, docs, rows, empty):
    rng = random.Random(1)
    odd = ["".join(rng.choice("a1.@+- ()é4") for _ in range(60)) for _ in range(150)] + ["1" * 20_000, "a" * 20_000 + "@b.c", "é🙂 q@w.e 1.2.3.4"]
    more = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    got = by_id(pii.findings(docs.select("doc_id", "text").unionByName(more)))
    for i, t in [(i, t) for i, t, _ in rows] + [(10_000 + i, t) for i, t in enumerate(odd)]:
        assert [(pii.KINDS[s.kind], s.start, s.end) for s in got[i].spans] == base_spans(t), t
    assert pii.findings(empty).count() == 0


def test_pii_terms(spark):
    near = [(i, f"case {i} {'word' * i} Jonquil wrote to keeper@box.org about it") for i in range(1, 6)]
    rest = [(100 + i, "in this case we wrote to someone about it") for i in range(60)]
    d = spark.createDataFrame([*near, *rest, (500, None)], "doc_id long, text string")
    got = by_id(pii.findings(d))
    for i, t in near:
        assert [t[x.start : x.end] for x in got[i].terms] == ["Jonquil"]
    assert all(not got[i].terms for i, _ in rest)
    clean = by_id(pii.sanitise(d.withColumn("extra", F.lit(1))))
    assert clean[1].text == "case 1 word  wrote to [EMAIL] about it" and clean[1].extra == 1
    assert clean[100].text == rest[0][1] and clean[500].text is None


def test_pii_terms_everywhere(spark):
    """A telling term goes wherever a document that holds the entity has it, and stays in the others."""
    far = " and so on it went for a while" * 4
    near = [(i, f"case {i} {'word' * i} Jonquil wrote to keeper@box.org{far}. JONQUIL left; Jonquils, jonquil") for i in range(1, 6)]
    apart = [(None, f"Jonquil came{far} to keeper@box.org"), (7, f"only Jonquil{far}")]
    rest = [(100 + i, f"in this case we wrote to someone about it{far}") for i in range(60)]
    got = by_id(pii.findings(spark.createDataFrame([*near, *apart, *rest], "doc_id long, text string")))
    for i, t in near:
        assert [t[x.start : x.end] for x in got[i].terms] == ["Jonquil", "JONQUIL", "jonquil"]
    assert [(x.start, x.end) for x in got[None].terms] == [(0, 7)] and not got[7].terms


def test_pii_disclosure_against_brute_force(spark):
    """Secrets, classes and parts: every rated pair and every span of the query, with plain Python."""
    rng = random.Random(6)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    vocab = [chr(97 + i // 26) + chr(97 + i % 26) + "word" for i in range(90)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    data = [(i, f'{prose(30)} token = "{key()}" {prose(20)}. The token again') for i in range(6)]
    data += [(20 + i, f"{prose(20)} curator box{i}@museum.example.org {prose(20)}") for i in range(5)]
    data += [(40 + i, prose(40)) for i in range(80)] + [(200, "a" * 50 + " 12345678901234567890123 plain"), (201, None), (202, "")]
    d = spark.createDataFrame(data, "doc_id long, text string")
    got = by_id(pii.findings(d))
    texts = {i: t or "" for i, t in data}
    words = {i: set(re.findall("[a-z]+", t.lower())) for i, t in texts.items()}
    own = {i: re.findall(r"[0-9a-f]{40}", t) for i, t in texts.items() if i < 6} | {i: re.findall(r"\S+@\S+", t) for i, t in texts.items() if 20 <= i < 40}
    entities = {i: {"secret", f"secret:{v[0]}"} if i < 6 else {"email", f"email:{v[0]}", f"email account:{v[0].split('@')[0]}", "email host:museum.example.org"} for i, v in own.items()}
    near, want = {}, {}
    for i, (v,) in own.items():
        at = texts[i].index(v)
        lo, hi = max(0, at - pii.REACH), at + len(v) + pii.REACH
        for m in re.finditer("[A-Za-z]+", texts[i]):
            if len(m[0]) >= pii.TERM and (lo < m.start() or lo == 0) and m.end() < hi and lo <= m.start() and not at <= m.start() < at + len(v):
                near.setdefault(m[0].lower(), {}).setdefault(i, None)
    n = len(data)
    for term, docs_ in near.items():
        for e in {e for i in docs_ for e in entities[i]}:
            n_et, n_e, n_t = sum(e in entities[i] for i in docs_), sum(e in x for x in entities.values()), sum(term in w for w in words.values())
            if n_et >= pii.SUPPORT and np.log(n * n_et / (n_e * n_t)) / np.log(n / n_e) >= pii.GENERALISE:
                want.setdefault(e, set()).add(term)
    assert "token" in want["secret"] and {"email", "email host:museum.example.org"} <= want.keys()
    for i, t in texts.items():
        terms = {x for e in entities.get(i, ()) for x in want.get(e, ())}
        at = [(m.start(), m.end()) for m in re.finditer("[A-Za-z]+", t) if m[0].lower() in terms and not any(t.index(v) <= m.start() < t.index(v) + len(v) for v in own.get(i, ()))]
        assert [(x.start, x.end) for x in got[i].terms] == at, i
        assert [(x.start, x.end) for x in got[i].secrets] == ([(t.index(own[i][0]), t.index(own[i][0]) + 40)] if i < 6 else []), i
    clean = by_id(pii.sanitise(d))
    assert not any(v[0] in clean[i].text for i, v in own.items()) and all(clean[i].text == t for i, t in data if i >= 40)


# near duplicates


def components(rows, width, percent):
    sets = {}
    for d, t, _ in rows:
        w = WORD.findall((t or "").translate(LOW))
        sets[d] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            k = len(sets[a] & sets[b])
            if a < b and k and 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(s), root(d)) for d, s in sets.items()}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(docs, rows, empty, width):
    want = components(rows, width, 80)
    got = by_id(near_dup.near_duplicates(docs, width=width))
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == want
    assert all(r.kept == (r.component_id == d) for d, r in got.items())
    assert near_dup.near_duplicates(empty).count() == 0


def test_near_duplicates_block_by_block(docs, rows, monkeypatch):
    """Buckets of many nodes that leaders leave apart are cut into blocks."""
    monkeypatch.setattr(near_dup, "SIDE", 2)
    monkeypatch.setattr(near_dup, "LEADERS", (1,))
    got = by_id(near_dup.near_duplicates(docs, width=2))
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == components(rows, 2, 80)


def test_near_duplicates_repeated_and_null_ids(spark):
    d = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, "a b c")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in near_dup.near_duplicates(d, 2).collect()) == [(0, 0), (1, 1), (1, 1), (2, 1)]


def test_sieved_rows_stay_where_they_are(spark):
    """Texts of near duplicates are found without a shuffle of all texts."""
    from tidemark.llm._common import sieved

    some = spark.createDataFrame([(i, "x" * 9) for i in [*range(2000), None]], "doc_id long, text string")
    got = sieved(some, "doc_id", spark.range(0, 2000, 20).select(F.col("id").alias("node")))
    found = {r.doc_id for r in got.collect()}
    assert found >= set(range(0, 2000, 20)) and len(found) < 300 and got.columns == some.columns
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert all("text" not in line for line in plan.splitlines() if "Exchange" in line) and "SortMergeJoin" not in plan
    assert sieved(some, "doc_id", spark.range(0).select("id")).count() == 0


def test_posterior_bounds():
    least = near_dup.least_matches(0.8)
    assert (np.diff(least) > 0).all() and least[-1] < 0.8 * 128


# fingerprints


def test_fingerprints(docs, rows, empty):
    got = by_id(fingerprint.edited(docs))
    order = sorted(rows, reverse=True)
    err = []
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [WORD.findall(t.translate(LOW))] for i in range(len(w) - 4)}
    for i, (d, t, _) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        cut = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert (got[d].n_chars, sha(got[d].edited_text)) == (len(t), sha(cut))
        a, b = shingles(t), shingles(cut)
        if len(a) > 30:
            x, y = got[d].fingerprint, got[d].edited_fingerprint
            same = sum(p == q for p, q in zip(x, y)) / 256
            err.append((same - 1 / 16) / (15 / 16) - len(a & b) / len(a | b))
    assert abs(np.mean(err)) < 0.03 and np.max(np.abs(err)) < 0.15
    by_text = {}
    for d, t, _ in rows:
        assert by_text.setdefault(t or "", got[d].fingerprint) == got[d].fingerprint
    assert fingerprint.edited(empty).count() == 0


# substring duplicates


def test_rlz(docs, rows, empty):
    first, want = {}, {}
    for d, t, _ in sorted(rows):
        w = WORD.findall(t or "")
        out = [False] * len(w)
        for i in range(len(w) - 49):
            if first.setdefault(tuple(w[i : i + 50]), d) < d:
                out[i : i + 50] = [True] * 50
        want[d] = (len(w), sum(out), sha(" ".join(x for x, o in zip(w, out) if not o)))
    got = by_id(rlz.factorise(docs, texts=True))
    assert {d: (r.n_words, r.n_removed, r.kept_sha256) for d, r in got.items()} == want
    words = {d: WORD.findall(t or "") for d, t, _ in rows}
    for d, r in got.items():
        for f in r.factors:  # each is in its source, word for word
            assert f.end - f.start >= 50 and f.source < d and words[d][f.start : f.end] == words[f.source][f.place : f.place + f.end - f.start]
    assert rlz.factorise(empty).count() == 0


def test_rlz_goes_as_far_as_a_document(spark):
    """A factor goes on where its document does, though another document holds the middle earlier; greedy parses against brute force."""
    rng = random.Random(8)
    prose = lambda n: [rng.choice("abcdefgh") + str(rng.randrange(10**6)) for _ in range(n)]
    long, mid, tail = prose(500), prose(60), prose(70)
    data = [(0, prose(9) + long[150:350] + prose(20)), (1, long), (5, prose(8) + mid + tail[:55]), (9, prose(30) + long + prose(11)), (11, mid[:-3] + prose(5) + long[340:420] + tail + long[100:160])]
    got = by_id(rlz.factorise(spark.createDataFrame([(d, " ".join(w)) for d, w in data], "doc_id long, text string")))
    assert [(f.start, f.end, f.source, f.place) for f in got[9].factors] == [(30, 530, 1, 0)]
    texts = dict(data)
    for d, w in data:
        want, at = [], 0
        while at + 50 <= len(w):
            reach = [(k, -o, -p) for o, x in texts.items() if o < d for p in range(len(x) - 49) if x[p : p + 50] == w[at : at + 50] for k in [next((k for k in range(50, len(w) - at) if w[at + k : at + k + 1] != x[p + k : p + k + 1]), len(w) - at)]]
            if reach:
                want.append((at, at + max(reach)[0]))
                at += max(reach)[0] - 50
            at += 1
        assert [(f.start, f.end) for f in got[d].factors] == want


def test_repeat_groups(docs, rows, monkeypatch):
    """Of every window that repeats, one group has all occurrences."""
    some = [(d, t) for d, t, _ in rows if t and len(t) < 8000]
    places: dict[bytes, set] = {}
    first: dict[str, int] = {}
    for d, t in some:
        first.setdefault(t, d)
    for t, d in first.items():
        b = t.encode()
        for i in range(len(b) - 199):
            places.setdefault(b[i : i + 200], set()).add((d, i))
    for group in (8192, 2):
        monkeypatch.setattr(suffix_repeats, "GROUP", group)
        out = suffix_repeats.repeat_groups(docs.where(F.length("text") < 8000)).collect()
        groups: dict[tuple, set] = {}
        for r in out:
            groups.setdefault((r.group, r.length), set()).add((r.doc_id, r.start))
        have = {frozenset((d, s + k) for d, s in found) for (_, n), found in groups.items() for k in range(n - 199)}
        again = {frozenset(x) for x in places.values() if len(x) > 1}
        assert again and (again <= have if group == 8192 else {x for y in again for x in y} <= {x for y in have for x in y})


def test_repeats(docs, rows, empty, monkeypatch):
    seen = Counter()
    for _, t, _ in rows:
        b = (t or "").encode()
        seen.update(b[i : i + 200] for i in range(len(b) - 199))
    want = {}
    for d, t, _ in rows:
        b = (t or "").encode()
        out = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                out[i : i + 200] = True
        spans = int((np.diff(np.r_[0, out.astype(int)]) == 1).sum())
        want[d] = (len(b), int(out.sum()), spans, sha(np.frombuffer(b, np.uint8)[~out].tobytes()))
    for group in (2048, 2):  # with 2, every gram of more segments is dealt into chunks
        monkeypatch.setattr(suffix_repeats, "GROUP", group)
        got = by_id(suffix_repeats.remove_repeats(docs))
        assert {d: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for d, r in got.items()} == want
    assert suffix_repeats.remove_repeats(empty).count() == 0


def odd_ids():
    """Texts under repeated and null ids, some of them copies, in rows of different lengths."""
    rng = random.Random(9)
    prose = lambda n: " ".join("".join(rng.choice("aeiorstnl") for _ in range(rng.randint(2, 8))) for _ in range(n))
    shared, other = prose(70), prose(60)
    data = [(1, f"{prose(40)} {shared}"), (2, f"{prose(300)} {shared} {prose(5)}"), (2, prose(9)), (2, f"{shared} {prose(80)}"), (None, f"{prose(10)} {other}"), (None, f"{other} {prose(30)}"), (None, None), (3, f"x {prose(120)} {shared}")]
    return data + [data[3], data[4], (2, None)]


def test_rlz_odd_ids(spark):
    data = odd_ids()
    first, want = {}, Counter()
    for d, t in sorted((x for x in data if x[0]), key=lambda x: x[0]):
        w = WORD.findall(t or "")
        for i in range(len(w) - 49):
            first.setdefault(tuple(w[i : i + 50]), d)
    for d, t in data:
        w = WORD.findall(t or "")
        out = [False] * len(w)
        for i in range(len(w) - 49):
            if d and first[tuple(w[i : i + 50])] < d:
                out[i : i + 50] = [True] * 50
        want[d, len(w), sum(out), sha(" ".join(x for x, o in zip(w, out) if not o))] += 1
    d = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    got = rlz.factorise(d).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
    assert all((len(r.factors) > 0) == (r.n_removed > 0) for r in got)


@pytest.mark.parametrize("group", [2048, 2])
def test_repeats_odd_ids(spark, monkeypatch, group):
    data = odd_ids()
    raw = [(d, (t or "").encode()) for d, t in data]
    seen, want = Counter(b[i : i + 200] for _, b in raw for i in range(len(b) - 199)), Counter()
    for d, b in raw:
        out = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            out[i : i + 200] |= seen[b[i : i + 200]] > 1
        want[d, len(b), int(out.sum()), sha(np.frombuffer(b, np.uint8)[~out].tobytes())] += 1
    monkeypatch.setattr(suffix_repeats, "GROUP", group)
    got = suffix_repeats.remove_repeats(spark.createDataFrame(data, "doc_id long, text string").repartition(5)).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in got) == want


def test_decontamination_odd_ids(spark):
    data = odd_ids()
    bench = [(str(k), " ".join(t.split()[:12])) for k, (_, t) in enumerate(data) if t]
    d, b = spark.createDataFrame(data, "doc_id long, text string").repartition(5), spark.createDataFrame(bench, "item_id string, text string")
    one, many = (Counter((r.doc_id, r.n_words, tuple(r["items"]), tuple((s.start, s.end) for s in r.spans)) for r in decontam.contamination(d, b, item_bytes=size).collect()) for size in (decontam.ITEM_BYTES, 700))
    assert one == many and one.total() == len(data)


def test_interval_tree():
    assert sorted(suffix_repeats.intervals([0, 3, 5, 5, 2, 0, 4], 2)) == [(0, 3, 3), (0, 4, 2), (1, 3, 5), (5, 6, 4)]


# language


def test_language(spark, empty):
    rng = random.Random(2)
    words = {"en": "the of and with this that from have which".split(), "ru": "и в не на что он как это".split(), "de": "der und nicht auch werden eine über für".split()}
    text = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    train = spark.createDataFrame([(i, text(lang, 40), lang) for i in range(40) for lang in words], "doc_id long, text string, lang string")
    model = langid.fit(train)
    d = spark.createDataFrame([(1, text("en", 30)), (2, text("ru", 30)), (3, text("de", 20) + " " + text("ru", 9) + " " + text("de", 20)), (4, None), (5, "12 34 !!"), (6, ""), (7, text("en", 30_000))], "doc_id long, text string").withColumn("score", F.lit("x"))
    got = by_id(langid.identify(d, model))
    assert [got[i].lang_pred for i in range(1, 8)] == ["en", "ru", "de", "und", "und", "und", "en"]
    assert [s.lang for s in got[3].lang_spans] == ["de", "ru", "de"] and got[4].score == 0 and 0.5 < got[3].score < 1
    assert {r.lang_pred for r in langid.identify(d, langid.fit(train.where("false"))).collect()} == {"und"}
    assert langid.identify(empty, model).count() == 0


def test_language_pieces(spark, monkeypatch):
    """Words over the ends of pieces, and documents labelled alone, count as in one piece; a repeated row is answered twice."""
    rng = random.Random(3)
    words = {"en": "the of and with this that from have which".split(), "de": "der und nicht auch werden eine über für".split()}
    text = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    train = spark.createDataFrame([(i, text(lang, 40), lang) for i in range(40) for lang in words], "doc_id long, text string, lang string").cache()
    data = [(i, f"{text('en', 3 * i)} {text('de', i)} {'wort' * i} {text('en', i)}") for i in range(1, 40)]
    data += [(40, text("de", 3000)), (40, text("de", 3000)), (41, data[3][1]), (41, data[3][1])]
    d = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    answers = lambda: sorted((r.doc_id, r.lang_pred, r.score, tuple((s.start, s.end, s.lang) for s in r.lang_spans)) for r in langid.identify(d, langid.fit(train)).collect())
    one = answers()
    monkeypatch.setattr(langid, "_PIECE", 7)
    assert answers() == one and len(one) == len(data)
    monkeypatch.setattr(langid, "ALONE", 0)
    assert answers() == one


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(1)
    for n_lang, n in ((2, 9), (3, 7), (300, 2)):
        for _ in range(5):
            s = (rng.random((n, n_lang)) * 30).round(2).astype(np.float32)
            best = max(itertools.product(range(n_lang), repeat=n), key=lambda p: sum(s[t, x] for t, x in enumerate(p)) - langid.SWITCH * sum(a != b for a, b in zip(p, p[1:])))
            assert langid._path_alone(s).tolist() == list(best) == langid._paths([s])[0].tolist()


def test_language_held_out(spark):
    """Held-out accuracy of the registered query on the given labels."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = QUERIES["op5_language_id"](spark, "/root/testdata/sf0.01").join(d.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert got[0] > 0.97 and got[1] > 50


# decontamination


def test_decontamination(spark, docs, rows, empty):
    ITEM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    texts = [t for _, t, _ in rows if t and len(t.split()) > 30][:6]
    bench = [("b1", " ".join(texts[1].split()[5:25]).upper()), ("b2", " ".join(texts[3].split()[:14])), ("b3", "two, WORDS!"), ("b4", ""), ("b5", None), ("b3x", "two words"), ("b6", "never seen anywhere at all by any of these documents here")]
    b = spark.createDataFrame(bench, "item_id string, text string").withColumn("doc_id", F.lit(1))
    want = {}
    for d, t, _ in rows:
        w = ITEM.findall((t or "").translate(LOW))
        hit, items = set(), set()
        for name, x in bench:
            p = ITEM.findall((x or "").translate(LOW))
            for i in range(max(1, len(p) - 9)) if p else ():
                q = p[i : i + 10]
                for j in range(len(w) - len(q) + 1):
                    if w[j : j + len(q)] == q:
                        hit.update(range(j, j + len(q)))
                        items.add(name)
        want[d] = (len(w), len(hit), sorted(items))
    for size in (decontam.ITEM_BYTES, 100):  # with 100, the items are dealt into blocks, and long ones into runs
        got = by_id(decontam.contamination(docs, b, item_bytes=size))
        assert {d: (r.n_words, sum(s.end - s.start for s in r.spans), r["items"]) for d, r in got.items()} == want
    for d, t, _ in rows:
        assert all(len(ITEM.findall(t[s.char_start : s.char_end].translate(LOW))) == s.end - s.start for s in got[d].spans)
    assert decontam.contamination(empty, b).count() == 0
    assert all(not r["items"] for r in decontam.contamination(docs, b.where("false")).collect())


# language model


def test_ctw(docs, rows, empty, spark):
    got = by_id(ctw.score(docs, block_bytes=50_000))
    tokens = {d: [*WORD.findall((t or "").translate(LOW)), None] for d, t, _ in rows}
    c = Counter(x for d, w in tokens.items() if zlib.crc32(str(d).encode()) % 7 != 2 for x in w)
    n, v = sum(c.values()), len(c)
    for d, w in tokens.items():
        r = got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(c[x] > 0 for x in w), n, zlib.crc32(str(d).encode()) % 7 == 2)
        assert r.base_score == pytest.approx(sum(np.log10((c[x] + 1) / (n + v + 1)) for x in w))
    assert ctw.score(empty).count() == 0


def test_ctw_scores_a_block_in_bounded_memory(monkeypatch):
    """Beside its texts a block holds little more than a code a place and its distinct keys."""
    import tracemalloc

    import pyarrow as pa

    monkeypatch.setattr(ctw, "_CHUNK", 1 << 15)
    rng, parts = np.random.default_rng(3), 7
    texts = ["".join(map(chr, rng.integers(97, 122, 4000))) + " end" for _ in range(300)]
    docs = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts})
    zero = type("Key", (), {"as_py": lambda self: 0})()
    sent = ctw._send(parts, 7, 2)((zero,), docs)
    found = [np.full(n, -1.5 if kind == 0 else 3, np.float32).tobytes() for kind, n in zip(sent.column("kind").to_pylist(), sent.column("n").to_pylist())]
    answers = pa.table({"kind": sent.column("kind"), "part": sent.column("part"), "found": found})
    tracemalloc.start()
    try:
        got = ctw._score(7, 2, 10, 100, parts)(docs, answers)
        peak = tracemalloc.get_traced_memory()[1] / sum(map(len, texts))
    finally:
        tracemalloc.stop()
    assert got.column("score").to_pylist() == [-1.5 * (len(t) + 1) for t in texts] and got.column("n_known").to_pylist() == [3] * len(texts)
    assert peak < 60, peak


def test_ctw_against_recursion(spark):
    """The mixture of one small text, node by node."""
    texts = [(0, "abab abba incomprehensibilities-incomprehensibilities"), (1, "abab comprehensibilities é\0\t x"), (2, None)]
    got = by_id(ctw.score(spark.createDataFrame(texts, "doc_id long, text string"), modulus=1, remainder=5))
    nodes = {}
    leaf = lambda c: len(c) == ctw.DEPTH or len(c) >= ctw.LEAST and any(x in b" \t\n\x0b\x0c\r\xff" for x in c)

    def steps(t):
        b = bytes([0xFF]) * ctw.DEPTH + (t or "").encode() + bytes([0xFF])
        for i in range(ctw.DEPTH, len(b)):
            path = b[i - ctw.DEPTH : i][::-1]
            path = next(path[:d] for d in range(ctw.DEPTH + 1) if leaf(path[:d]))
            for k in range(8):
                yield path, (1 << k) + (b[i] >> (8 - k)), (b[i] >> (7 - k)) & 1

    for _, t in texts:
        for ctx, node, bit in steps(t):
            for d in range(len(ctx) + 1):
                nodes.setdefault((ctx[:d], node), [0, 0])[bit] += 1
    kt = lambda n: float(ctw.log_kt(np.array(float(n[0])), np.array(float(n[1]))))

    def weighted(ctx, node):
        own = kt(nodes[ctx, node])
        if leaf(ctx):
            return own
        below = sum(weighted(c, n) for c, n in nodes if n == node and len(c) == len(ctx) + 1 and c[: len(ctx)] == ctx)
        return np.logaddexp(own, below) - np.log(2)

    for d, t in texts:
        total = 0.0
        for ctx, node, bit in steps(t):
            p = None
            for k in range(len(ctx), -1, -1):
                n = nodes[ctx[:k], node]
                own = (n[bit] + 0.5) / (sum(n) + 1)
                w = np.exp(kt(n) - np.log(2) - weighted(ctx[:k], node))
                p = own if p is None else w * own + (1 - w) * p
            total += np.log10(p)
        assert got[d].score == pytest.approx(total, rel=1e-5)


# BPE


def test_bpe(docs, rows, empty):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(vocabulary())
    got = by_id(bpe.decode(bpe.encode(docs, vocabulary()), vocabulary()))
    for d, text, _ in rows:
        want = t.encode(text or "", add_special_tokens=False).ids
        assert got[d].ids == want and got[d].decoded == t.decode(want, skip_special_tokens=False)
    assert bpe.encode(empty, vocabulary()).count() == 0


def test_bpe_stream():
    tokenizers = pytest.importorskip("tokenizers")
    t, (enc, dec) = tokenizers.Tokenizer.from_file(vocabulary()), bpe.loaded(vocabulary())
    rng = random.Random(4)
    parts = ["a", " ", "  ", "\n", "'s", "'ll", "é", "日本", "1", "!!", "-----", "\x1c", "\x85", " ", "<|endoftext|>", "🙂", "\r\n", "aaaa"]
    odd = ["".join(rng.choice(parts) for _ in range(40)) for _ in range(800)] + ["a" * 9000, "-=" * 5000, "".join(rng.choice("abcdehilnorst") for _ in range(20_000))]
    for s in odd:
        ids = enc.encode(s)
        assert ids == t.encode(s, add_special_tokens=False).ids
        assert dec.decode(ids, step=3) == t.decode(ids, skip_special_tokens=False)


def test_bpe_slices(monkeypatch):
    """However a text is cut into slices, the ids are the library's; every pre-token goes through the transducer."""
    tokenizers = pytest.importorskip("tokenizers")
    t, (enc, _) = tokenizers.Tokenizer.from_file(vocabulary()), bpe.loaded(vocabulary())
    rng = random.Random(8)
    parts = ["a", " ", "  ", "\n", "'s", "'ll", "'", "é", "日", "1", "!!", "\x1c", "\x85", "\u3000", "🙂", " b", "aaaa", "-" * 9, " " * 9, "abc" * 5, "7" * 7, "<|endoftext|>"]
    monkeypatch.setattr(bpe, "OPEN", 6)
    small = bpe.Encoder(enc.merges)
    small._run.room = enc.merges.lookahead + 8
    for _ in range(1500):
        s = "".join(rng.choice(parts) * rng.choice((1, 1, 1, 30)) for _ in range(rng.randint(1, 30))).replace("<|endoftext|>", " " if rng.random() < 0.5 else "x")
        ids, at = b"", 0
        while at < len(s):
            step = rng.randint(1, 12)
            ids += small.push(s[at : at + step])
            at += step
        assert np.frombuffer(ids + small.end(), np.int32).tolist() == t.encode(s, add_special_tokens=False).ids
    monkeypatch.undo()
    through = []
    real = bpe.Transducer.end
    monkeypatch.setattr(bpe.Transducer, "end", lambda self, data=b"": through.append(data) or real(self, data))
    one = "Die Größe 12 it's"
    assert bpe.Encoder(enc.merges).encode(one) == t.encode(one, add_special_tokens=False).ids
    assert sorted(through) == sorted(p.encode() for p in bpe.PATTERN.findall(one))


@pytest.mark.parametrize("kind", ["ab", "-=", "42", " \n"])
def test_bpe_holds_little(kind):
    """A text without a safe blank is encoded in the memory of a slice."""
    import tracemalloc

    tokenizers = pytest.importorskip("tokenizers")
    t, (enc, _) = tokenizers.Tokenizer.from_file(vocabulary()), bpe.loaded(vocabulary())
    rng = random.Random(1)
    text = "".join(rng.choice(kind) for _ in range(150_000)) + "x y"
    want, got = t.encode(text, add_special_tokens=False).ids, []
    tracemalloc.start()
    for ids in enc.feed(text):
        assert len(enc._held) <= bpe.OPEN and len(enc._run.held) <= 2 * enc._run.room
        got.append(ids)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.frombuffer(b"".join(got), np.int32).tolist() == want
    assert peak < 8 << 20


def test_pipeline_tokens_leave_nothing_in_a_worker(docs, rows, spark, monkeypatch):
    """A task is one worker's, with a bounded cache, and what it loaded goes with it."""
    import gc

    import corpus_pipeline
    import pyarrow as pa

    df = corpus_pipeline.tokens(spark, docs, "")
    assert df._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    want = by_id(bpe.decode(bpe.encode(docs, vocabulary()), vocabulary()))
    assert all(r.ids == want[r.doc_id].ids and r.round_trip for r in df.collect())

    def held():
        gc.collect()
        return sum(isinstance(x, bpe.Merges | bpe.Encoder | bpe.Decoder) for x in gc.get_objects())

    monkeypatch.setattr(bpe, "TASK_CACHE", 50)
    monkeypatch.setattr(bpe, "_LOADED", {})
    before = held()
    batch = pa.RecordBatch.from_pydict({"doc_id": [d for d, _, _ in rows], "text": pa.array([t for _, t, _ in rows], pa.string())})
    most = 0
    for b in bpe._both(iter([batch] * 2), vocabulary(), "text", "ids", "decoded"):
        most = max(most, *(len(x._inner) for x in gc.get_objects() if isinstance(x, bpe.Encoder) and x._most == 50))
        assert b.column("ids").to_pylist() == [want[d].ids for d in b.column("doc_id").to_pylist()]
        assert b.column("decoded").to_pylist() == [want[d].decoded for d in b.column("doc_id").to_pylist()]
    assert held() == before and not bpe._LOADED and most


# token files


def test_token_files(docs, rows, empty):
    tokenizers = pytest.importorskip("tokenizers")
    t, at, want = tokenizers.Tokenizer.from_file(vocabulary()), 0, {}
    flat = []
    for d, text, _ in sorted(rows):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want[d] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
        flat += ids
    parts = token_files.write(docs, vocabulary())
    assert {d: (r.start, r.n_tokens, r.ids_crc32) for d, r in by_id(token_files.read_documents(parts)).items()} == want
    for p in parts.collect():
        f = token_files.TokenFile(f"{p.path}.arrow")
        mask = f.mask(0)
        n = min(p.n_tokens, token_files.WIDTH)
        assert f.sequence(0)[:n].tolist() == flat[p.start : p.start + n] and mask.sum() == n
    assert token_files.read_documents(token_files.write(empty, vocabulary())).count() == 0


class _Counted:
    """A tokenizer that counts the characters it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.chars = tokenizer, 0

    def encode_batch_fast(self, texts, **kw):
        self.chars += sum(map(len, texts))
        return self.tokenizer.encode_batch_fast(texts, **kw)


def test_token_files_give_each_word_to_the_library_once():
    """Not each mix of a word with marks or with the first word of the next line."""
    pytest.importorskip("tokenizers")
    ids = token_files._Ids(vocabulary())
    ids.tokenizer = counted = _Counted(ids.tokenizer)
    words = [a + b for a in ("reth", "onder", "chlich", "\u00f6tze", "an", "im") for b in ("ing", "eau", "keit", "\u00fcst", "or")]
    texts = [" ".join(["of", *(f"{w}{m}\n{v.title()}{m}" for v in words)]) for w in words for m in (".", "###", "")]
    for _ in range(3):
        ids.many(texts)
    # the first word of a text has no blank before it, and is not kept
    assert counted.chars - 3 * len("of") * len(texts) < 3 * sum(len(w) + 1 for w in words)


@pytest.mark.parametrize("told", [True, False])
def test_token_files_ids_are_the_librarys(told, monkeypatch):
    """Odd white space, contractions, special tokens, texts beyond a chunk and without a blank, with small chunks, calls and caches."""
    import pyarrow as pa

    tokenizers = pytest.importorskip("tokenizers")
    t, ids, rnd = tokenizers.Tokenizer.from_file(vocabulary()), token_files._Ids(vocabulary()), random.Random(5)
    if not told:  # as with a vocabulary whose tokens don't tell where a word begins
        ids.words.opens[:] = ids.lines.opens[:] = False
    odd = [" ", " ", " ", " ", "\n", "\n", "\t", "\r\n", "\x1c", "\x85", "\u00a0", "\u2003", "\u3000", "  ", "'s", "'re", "'", "\u00b2", "1", "42", "\u0301", "\u4e2d\u6587", "\u0416", "\U0001f600", "<|endoftext|>", "."]
    odd += ["word", "Word", "\u00e9t\u00e9", "\u00aa", "\u0180x", "###", "a.", "x\ny", "of.\nThe", "the,", "\u0120", "\u010a", "\x00"]
    texts = [None, "", " ", "\n", " a", "a ", "a\n", "a\n b", "a \nb", "a.\nB c.\nD", "x" * 3000, "ab " * 2000, "ab\n " * 2000]
    texts += ["".join(rnd.choices(odd, k=rnd.randrange(1, 60))) for _ in range(1500)]
    want, cut = [t.encode(x or "", add_special_tokens=False).ids for x in texts], token_files.blocks
    for chunk, call, cache in ((1 << 23, 1 << 16, 1 << 20), (500, 40, 30), (1, 1, 0)):
        for name, value in (("CHUNK", chunk), ("CALL", call), ("CACHE", cache)):
            monkeypatch.setattr(token_files, name, value)
        monkeypatch.setattr(token_files, "blocks", partial(cut, size=min(chunk, 1 << 16)))
        batch = pa.RecordBatch.from_pydict({"doc_id": range(len(texts)), "text": pa.array(texts, pa.string())})
        got, keys, rest = [], [], []
        for ks, pieces, last in token_files._chunked(iter([batch]), ids):
            keys += ks
            made, counts = ids.many(pieces)
            for part, end in zip(np.split(made, np.cumsum(counts)[:-1]), last, strict=True):
                rest += part.tolist()
                if end:
                    got.append(rest)
                    rest = []
        assert got == want and keys == list(range(len(texts))) and not rest
        assert len(ids.words.words) <= cache


def test_token_files_documents_over_chunks(spark, tmp_path, monkeypatch):
    """Starts, counts and sums of documents whose pieces are in several chunks of the default size."""
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(vocabulary())
    rows = [(1, "first one"), (2, "Some long text, of words. " * 400_000), (3, None), (4, "after it")]
    assert len(rows[1][1]) > token_files.CHUNK
    got = by_id(token_files.read_documents(token_files.write(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), vocabulary())))
    at, unit = 0, t.encode("Some long text, of words. Some long text, of words.", add_special_tokens=False).ids
    assert len(unit) == 14
    for d, text in rows:
        # a period of the long text is encoded alike wherever it stands, but for its first word
        ids = unit[:7] + unit[7:] * 399_999 + t.encode(" ", add_special_tokens=False).ids if d == 2 else t.encode(text or "", add_special_tokens=False).ids
        ids = [*ids, 2]
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


# pipeline


def test_pipeline_shuffles_texts_once_in_near_dedup(docs, spark):
    import corpus_pipeline

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = corpus_pipeline.near_dedup(spark, docs, "")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # the rows that the join leaves are numbered where they are
    assert "Exchange" not in plan[plan.index("Window [") : plan.index("SortMergeJoin")]


def test_pipeline(spark, rows, tmp_path):
    import corpus_pipeline

    bench = " ".join(rows[40][1].split()[:12])
    data = [(d, t, lang, "src", len(t or "")) for d, t, lang in rows] + [(rows[45][0], rows[45][1], "en", "src", 1), (None, "some words of no number at all", None, None, None)]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = [r.doc_id for r in out]
    want = components([r for r in rows if any(c.isalpha() for c in r[1] or "")], 5, 80)
    kept = {d for d, (_, c) in want.items() if c == d} - {rows[40][0]}
    assert {i for i in ids if i is not None} == kept and len(ids) == len(kept) + 1
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in out)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(str(tmp_path / "none" / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("n", range(1, 14))
def test_registered(n):
    assert sum(q.startswith(f"op{n}_") for q in QUERIES) == 1
