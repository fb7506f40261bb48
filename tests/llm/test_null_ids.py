"""Rows without an id, repeated rows and several texts under one id: every row is answered once, and equal texts alike."""

import hashlib
from collections import Counter

import pytest

from tidemark.llm.queries import QUERIES

TEXTS = [(None, "der Hund und die Katze gehen heute nach Hause"), (None, "the cat and the dog walk home today"), (None, None), (5, "the same words twice"), (5, "the same words twice"), (5, "another text of that id"), (7, "")]
ROWS = [(i, t, ("de", "en", None)[n % 3], "web", len(t or "")) for n, (i, t) in enumerate(TEXTS)] + [(100 + n, f"the words of document {n} are in english", "en", None, 1) for n in range(6)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("ids")
    spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(str(d / "documents.parquet"))
    return str(d)


def answers(spark, folder, n):
    (query,) = (q for name, q in QUERIES.items() if name.startswith(f"op{n}_"))
    return query(spark, folder).collect()


@pytest.mark.parametrize("n", [3, 5, 8, 9, 10, 13])
def test_every_row_is_answered(spark, folder, n):
    assert Counter(r.doc_id for r in answers(spark, folder, n)) == Counter(r[0] for r in ROWS)


def test_digests_of_repeated_rows(spark, folder):
    sha = Counter(hashlib.sha256((t or "").encode()).hexdigest() for _, t, *_ in ROWS)
    assert Counter(r.decoded_sha256 for r in answers(spark, folder, 9)) == sha == Counter(r.text_sha256 for r in answers(spark, folder, 13))


def test_no_id_is_not_held_out(spark, folder):
    assert all(r.held_out is False for r in answers(spark, folder, 5) if r.doc_id is None)
