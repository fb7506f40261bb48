"""Tables out and back in, and the rules of statement pages."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import quality, text
from tidemark.sources import landed, sinks

ROLES = {"y": ("target", "target"), "gap": ("price", "past")}


@pytest.fixture
def features(spark):
    return spark.createDataFrame([("a", date(2024, 1, 2), 0.5, None), ("a", date(2024, 1, 3), None, 1.0), ("b", date(2024, 1, 2), 0.25, 2.0)], "k string, date date, y double, gap double")


def test_feature_table_comes_back(spark, features, tmp_path):
    sinks.write_feature_table(features, str(tmp_path), ROLES, by="k")
    df, roles = sinks.read_feature_table(spark, str(tmp_path))
    assert roles == ROLES and df.columns == features.columns
    assert sorted(map(tuple, df.collect()), key=str) == sorted(map(tuple, features.collect()), key=str)


def test_changed_table_is_refused(spark, features, tmp_path):
    sinks.write_feature_table(features, str(tmp_path), ROLES)
    features.limit(1).write.mode("append").parquet(str(tmp_path / "table"))
    with pytest.raises(ValueError, match="changed"):
        sinks.read_feature_table(spark, str(tmp_path))
    with pytest.raises(ValueError, match="roles"):
        sinks.write_feature_table(features, str(tmp_path), {"lost": ("a", "past")})


def test_statements_as_lines(spark, tmp_path):
    df = spark.createDataFrame([(date(2024, 1, 31), "/a", 'two\nlines "quoted"'), (date(2024, 3, 20), "/b", None)], "date date, url string, text string")
    sinks.write_statements(df, str(tmp_path / "s"))
    assert sorted(map(tuple, sinks.read_statements(spark, str(tmp_path / "s")).collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.json").write_text("not json\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        sinks.read_statements(spark, str(tmp_path / "bad")).collect()


def test_cells_by_file_name(spark, tmp_path):
    for name in ("r0-fold2019-seed1", "r20-fold2020-seed2", "r20-fold2020-broken"):
        spark.range(2).write.parquet(str(tmp_path / name))
    out = sinks.read_files(spark, [str(p) for p in sorted(tmp_path.iterdir())], r"/r([0-9]+)-fold([0-9]{4})-seed([0-9]+)/", ["rung", "fold", "seed"])
    assert sorted(map(tuple, out.groupBy("rung", "fold", "seed").count().collect())) == [("0", "2019", "1", 2), ("20", "2020", "2", 2)]


def test_changed_sources(spark):
    kind = "table string, n_rows long, digest_a string, digest_b string"
    now = spark.createDataFrame([("a", 1, "x", "y"), ("b", 2, "x", "y"), ("c", 1, "x", "y")], kind)
    before = spark.createDataFrame([("a", 1, "x", "y"), ("b", 1, "x", "y"), ("d", 1, "x", "y")], kind)
    assert sorted(map(tuple, sinks.changed_sources(now, before).collect())) == [("b", "changed"), ("c", "added"), ("d", "removed")]


def test_sentences(spark):
    page = "  The committee will keep watching the data. Voting for the action were all of its members present. Short one here. Rates stay where they have been for long; Risks are about balanced in its view.  \n"
    df = spark.createDataFrame([(page,)], "t string").select(scalars.sentences(F.col("t")))
    assert df.first()[0] == ["The committee will keep watching the data.", "Rates stay where they have been for long;", "Risks are about balanced in its view."]


def test_article_div(spark):
    html = '<div><p>before</p></div><div class="x" id="article"><p class="l">one</p><div><div><p>two</p></div></div><p>three</p></div><div><p>after</p></div>'
    plain = "<div><p>only</p><p> </p></div>"
    df = spark.createDataFrame([(html,), (plain,), (None,)], "h string").select(text.page_paragraphs(F.col("h")))
    assert [r[0] for r in df.collect()] == [["one", "two", "three"], ["only"], None]


def test_statement_links(spark):
    html = '<a href="/newsevents/pressreleases/monetary20240131a.htm">Statement</a><a href="/newsevents/pressreleases/monetary20240131a.htm">PDF</a><a href="/newsevents/press/monetary/20080122b.htm">HTML</a><a href="/other/monetary20240131a.txt">Statement</a>'
    df = spark.createDataFrame([(html,)], "h string").select(text.statement_links(F.col("h"), ["Statement", "HTML"]))
    assert [tuple(x) for x in df.first()[0]] == [(date(2024, 1, 31), "/newsevents/pressreleases/monetary20240131a.htm"), (date(2008, 1, 22), "/newsevents/press/monetary/20080122b.htm")]


def test_flags_only_of_entities_with_a_hit(spark):
    df = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (2, "a", "y")], "d int, e string, f string")
    assert quality.flags(df, "d", "e", F.col("f") == "x", "e_").orderBy("d").collect() == [(1, 1), (2, 0)]


def test_tone_is_a_mean(spark):
    df = spark.createDataFrame([("t", "20240131T000000Z", 2.0, 1), ("t", "20240131T060000Z", 4.0, 3), ("t", "20240201T000000Z", None, 1)], "topic string, stamp string, value double, norm int")
    assert [tuple(r) for r in landed.timeline(df, ["topic"], tone=True).select("date", "value", "norm").orderBy("date").collect()] == [(date(2024, 1, 31), 3.0, 4), (date(2024, 2, 1), None, 1)]
