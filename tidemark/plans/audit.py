"""Selection, set operations, text and quality queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import scalars
from tidemark.functions.scalars import ratio
from tidemark.operators import digest, quality, text
from tidemark.operators.rolling import by
from tidemark.plans.base import CTE, bars, query, r, rets, session_map, sessions, signals, table, ticks
from tidemark.plans.evaluation import CELL, predictions, targets
from tidemark.plans.market import _FEATS, _filed, feature_frame
from tidemark.sources import sinks

# selection -------------------------------------------------------------------------------------------------------------


def in_range(df, column: str, start: str | None, end: str | None):
    """Rows from start to end, both included; a reversed range raises."""
    if start and end and start > end:
        raise ValueError(f"{start} is after {end}")
    for bound, op in ((start, ">="), (end, "<=")):
        if bound:
            df = df.where(F.expr(f"{column} {op} DATE '{bound}'"))
    return df


@query("date_range_filter", "SELECT k, date, round(close, 6) AS close FROM bars WHERE date BETWEEN DATE '1996-03-01' AND DATE '1997-02-28'")
def date_range_filter(spark, d):
    return in_range(bars(spark, d), "date", "1996-03-01", "1997-02-28").select("k", "date", r("close"))


@query("tail_n_per_series", "SELECT k, date, round(close, 6) AS close FROM bars QUALIFY row_number() OVER (PARTITION BY k ORDER BY date DESC) <= 250")
def tail_n_per_series(spark, d):
    w = Window.partitionBy("k").orderBy(F.desc("date"))
    return bars(spark, d).withColumn("n", F.row_number().over(w)).where("n <= 250").select("k", "date", r("close"))


@query("coverage_mask", "SELECT event_type AS topic, CAST(ts AS DATE) AS date, CASE WHEN count(*) FILTER (event_id % 5 <> 0) > 8 THEN round(count(*) FILTER (event_id % 2 = 0) / count(*) FILTER (event_id % 5 <> 0), 6) END AS share FROM events GROUP BY ALL")
def coverage_mask(spark, d):
    norm, hits = F.count_if(F.col("event_id") % 5 != 0), F.count_if(F.col("event_id") % 2 == 0)
    return table(spark, d, "events").groupBy(F.col("event_type").alias("topic"), F.col("ts").cast("date").alias("date")).agg(r(F.when(norm > 8, ratio(hits, norm)), "share"))


@query("policy_filter", "SELECT doc_id FROM documents WHERE contains(lower(left(text, 400)), 'the') AND NOT contains(lower(left(text, 400)), 'license')")
def policy_filter(spark, d):
    head = F.lower(F.left("text", F.lit(400)))
    return table(spark, d, "documents").where(F.contains(head, F.lit("the")) & ~F.contains(head, F.lit("license"))).select("doc_id")


@query("lowest_coverage", "SELECT c AS \"column\", round(s, 6) AS share FROM (UNPIVOT (SELECT " + ", ".join(f"count({c}) / count(*) AS {c}" for c in [*_FEATS, "v1_lag1", "news_mean"]) + " FROM ftable) ON " + ", ".join([*_FEATS, "v1_lag1", "news_mean"]) + " INTO NAME c VALUE s) ORDER BY round(s, 9), c LIMIT 5")
def lowest_coverage(spark, d):
    m = quality.melted(feature_frame(spark, d), [], [*_FEATS, "v1_lag1", "news_mean"]).groupBy("column").agg((F.count("value") / F.count("*")).alias("s"))
    return m.orderBy(F.round("s", 9), "column").limit(5).select("column", r("s", "share"))


@query("date_set_ops", "SELECT date, 'either' AS kind FROM (SELECT CAST(o_orderdate AS DATE) AS date FROM orders UNION SELECT CAST(l_shipdate AS DATE) FROM lineitem) UNION ALL SELECT date, 'orders_only' FROM (SELECT CAST(o_orderdate AS DATE) AS date FROM orders EXCEPT SELECT CAST(l_shipdate AS DATE) FROM lineitem)")
def date_set_ops(spark, d):
    a = table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("date"))
    b = table(spark, d, "lineitem").select(F.col("l_shipdate").cast("date").alias("date"))
    return a.union(b).distinct().withColumn("kind", F.lit("either")).unionByName(a.subtract(b).withColumn("kind", F.lit("orders_only")))


# filings ---------------------------------------------------------------------------------------------------------------

_FORMS = ("click", "error", "purchase", "view", "signup")


@query("form_counts_pivot", "SELECT available AS date, " + ", ".join(f"count(*) FILTER (form = '{f}') AS {f}_count" for f in _FORMS) + ", " + " + ".join(f"count(*) FILTER (form = '{f}')" for f in _FORMS) + " AS total FROM filed_at WHERE available IS NOT NULL GROUP BY available")
def form_counts_pivot(spark, d):
    wide = _filed(spark, d).where("available is not null").groupBy(F.col("available").alias("date")).pivot("form", list(_FORMS)).count().fillna(0)
    return wide.select("date", *(F.col(f).alias(f"{f}_count") for f in _FORMS), reduce(lambda a, b: a + b, map(F.col, _FORMS)).alias("total"))


@query("conditional_counts", "SELECT entity, available AS date, count(*) FILTER (form = 'purchase') AS n_earnings, count(*) FILTER (form = 'purchase' AND phase = 'pre') AS n_pre, count(*) FILTER (form = 'purchase' AND phase = 'post') AS n_post, CAST(1 AS INT) AS filing_event FROM filed_at WHERE available IS NOT NULL GROUP BY entity, available")
def conditional_counts(spark, d):
    hit = F.col("form") == "purchase"
    g = _filed(spark, d).where("available is not null").groupBy("entity", F.col("available").alias("date"))
    return g.agg(F.count_if(hit).alias("n_earnings"), F.count_if(hit & (F.col("phase") == "pre")).alias("n_pre"), F.count_if(hit & (F.col("phase") == "post")).alias("n_post"), F.lit(1).alias("filing_event"))


@query("entity_flags", "SELECT date, " + ", ".join(f"CAST(coalesce(max(CASE WHEN entity = {e} AND n > 0 THEN 1 END), 0) AS INT) AS entity_{e}" for e in range(10)) + " FROM (SELECT entity, available AS date, count(*) FILTER (form = 'purchase') AS n FROM filed_at WHERE available IS NOT NULL GROUP BY entity, available) GROUP BY date")
def entity_flags(spark, d):
    f = _filed(spark, d).where("available is not null").withColumn("date", F.col("available"))
    return quality.flags(f, "date", "entity", F.col("form") == "purchase", "entity_")


@query("item_flag", "SELECT event_id, list_contains(list_transform(string_split(form || ', ' || CAST(k AS VARCHAR), ','), lambda x: trim(x)), '7') AS has_item FROM (SELECT event_id, event_type AS form, CAST(json_extract(props, '$.k') AS INT) % 10 AS k FROM events)")
def item_flag(spark, d):
    k = F.get_json_object("props", "$.k").cast("int") % 10
    return table(spark, d, "events").select("event_id", text.has_item(F.concat_ws(", ", "event_type", k.cast("string")), "7").alias("has_item"))


@query("seasonality_share", "SELECT event_type AS k, CAST(hour(ts) AS INT) AS hour, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY event_type), 6) AS share FROM events GROUP BY event_type, hour(ts)")
def seasonality_share(spark, d):
    g = table(spark, d, "events").groupBy(F.col("event_type").alias("k"), F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("k")), 6))


# text ------------------------------------------------------------------------------------------------------------------

#: Words that count for and against.
UP, DOWN = ["the", "der", "que"], ["and", "und", "est"]


def _hits_sql(words, t="text"):
    return " + ".join(f"CAST((length(lower({t})) - length(replace(lower({t}), '{w}', ''))) / {len(w)} AS BIGINT)" for w in words)


@query("keyword_counts", f"SELECT doc_id, CAST(length(text) AS INT) AS text_length, {_hits_sql(UP)} AS up_count, {_hits_sql(DOWN)} AS down_count FROM documents")
def keyword_counts(spark, d):
    k = text.keyword_counts(table(spark, d, "documents").select("doc_id", "text"), "text", {"up": UP, "down": DOWN})
    return k.select("doc_id", F.length("text").alias("text_length"), "up_count", "down_count")


CTE["sents"] = f"SELECT doc_id, s AS sentence FROM (SELECT doc_id, regexp_replace(unnest(string_split(regexp_replace(text, '([.;!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1))), '^\\s+|\\s+$', '', 'g') AS s FROM documents) WHERE length(s) > 25 AND NOT regexp_matches(lower(s), '{'|'.join(scalars.BOILERPLATE)}')"


def _sentences(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(scalars.sentences(F.col("text"))).alias("sentence"))


@query("sentences", "SELECT doc_id, count(*) AS n_sentences, CAST(sum(length(sentence)) AS BIGINT) AS n_chars FROM sents GROUP BY doc_id")
def sentences(spark, d):
    return _sentences(spark, d).groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.sum(F.length("sentence")).alias("n_chars"))


CTE["lab"] = f"SELECT doc_id, sentence, CASE WHEN net > 0 THEN 'up' WHEN net < 0 THEN 'down' ELSE 'neutral' END AS label FROM (SELECT doc_id, sentence, ({_hits_sql(UP, 'sentence')}) - ({_hits_sql(DOWN, 'sentence')}) AS net FROM sents)"


@query("label_sentences", "SELECT doc_id, label, count(*) AS n FROM lab GROUP BY doc_id, label")
def label_sentences(spark, d):
    probes = {"the the": "up", "and est": "down", "": "neutral"}
    return text.labelled(_sentences(spark, d), "sentence", lambda: text.lexicon(UP, DOWN), probes).groupBy("doc_id", "label").agg(F.count("*").alias("n"))


@query("tone_shares", "SELECT source, doc_id, n, round(up, 6) AS up_share, round(down, 6) AS down_share, round(up - down, 6) AS net, round((up - down) - lag(up - down) OVER (PARTITION BY source ORDER BY doc_id), 6) AS change FROM (SELECT source, doc_id, count(*) AS n, avg(CAST(label = 'up' AS INT)) AS up, avg(CAST(label = 'down' AS INT)) AS down FROM lab JOIN documents USING (doc_id) GROUP BY source, doc_id)")
def tone_shares(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id", F.explode(scalars.sentences(F.col("text"))).alias("sentence"))
    share = lambda x: F.avg((F.col("label") == x).cast("int"))
    s = docs.withColumn("label", text.net_label(F.col("sentence"), UP, DOWN)).groupBy("source", "doc_id").agg(F.count("*").alias("n"), share("up").alias("up"), share("down").alias("down"))
    net = F.col("up") - F.col("down")
    return s.withColumn("net", net).select("source", "doc_id", "n", r("up", "up_share"), r("down", "down_share"), r("net"), r(F.col("net") - F.lag("net").over(by("source", order="doc_id")), "change"))


@query("printed_date", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) ELSE CAST(o_orderdate AS DATE) + 9 END AS date FROM orders")
def printed_date(spark, d):
    o = table(spark, d, "orders")
    day = F.col("o_orderdate").cast("date")
    head = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.date_format(day, "MMMM d, yyyy"), F.lit(" For immediate release: rates stay."))).otherwise(F.concat(F.lit("x" * 300), F.date_format(day, "MMMM d, yyyy")))
    return o.select(F.col("o_orderkey").alias("id"), scalars.printed_date(head, F.date_add(day, 9)).alias("date"))


@query("heading_dates", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 3 THEN NULL WHEN o_orderkey % 4 = 2 THEN CAST(o_orderdate AS DATE) ELSE CAST(o_orderdate AS DATE) + 1 END AS date FROM orders")
def heading_dates(spark, d):
    a = F.col("o_orderdate").cast("date")
    b = F.date_add(a, 1)
    same = F.month(a) == F.month(b)
    year, m, n = F.date_format(b, "yyyy"), F.date_format(a, "MMMM"), F.date_format(b, "MMMM")
    two = F.when(same, F.concat(m, F.lit(" "), F.dayofmonth(a), F.lit("-"), F.dayofmonth(b), F.lit(" Meeting - "), year)).otherwise(F.concat(m, F.lit(" "), F.dayofmonth(a), F.lit("-"), n, F.lit(" "), F.dayofmonth(b), F.lit("  Meeting - "), year))
    short = F.when(same, two).otherwise(F.concat(F.date_format(a, "MMM"), F.lit("/"), F.date_format(b, "MMM"), F.lit(" "), F.dayofmonth(a), F.lit("-"), F.dayofmonth(b), F.lit(" Meeting - "), year))
    one = F.concat(m, F.lit(" "), F.dayofmonth(a), F.lit(" Meeting - "), F.year(a))
    case = F.col("o_orderkey") % 4
    heading = F.when(case == 0, two).when(case == 1, short).when(case == 2, one).otherwise("Meeting minutes")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), scalars.heading_date(heading).alias("date"))


CTE["links"] = "SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">([^<]*)</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">([^<]*)</a>', 2)) AS anchor, unnest(range(1, len(regexp_extract_all(html, '<a href=\"([^\"]*)\">([^<]*)</a>', 1)) + 1)) AS pos FROM pages"


@query("page_links", "SELECT page_id, href, anchor, CAST(pos AS INT) AS pos FROM links")
def page_links(spark, d):
    links = table(spark, d, "pages").select("page_id", F.posexplode(text.page_links(F.col("html"))).alias("p", "x"))
    return links.select("page_id", "x.href", "x.anchor", (F.col("p") + 1).alias("pos"))


@query("first_link_per_date", "SELECT href, page_id, anchor FROM links QUALIFY row_number() OVER (PARTITION BY href ORDER BY page_id, pos) = 1")
def first_link_per_date(spark, d):
    w = Window.partitionBy("href").orderBy("page_id", "pos")
    return page_links(spark, d).withColumn("n", F.row_number().over(w)).where("n = 1").select("href", "page_id", "anchor")


@query("page_text", r"SELECT page_id, CAST(len(p) AS INT) AS n_paragraphs, array_to_string(p, chr(10)) AS body FROM (SELECT page_id, list_filter(list_transform(regexp_extract_all(regexp_replace(coalesce(nullif(regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1), ''), html), '(?s)<(?:script|style)[^>]*>.*?</(?:script|style)>', '', 'g'), '(?s)<p(?:\s[^>]*)?>(.*?)</p>', 1), lambda x: trim(regexp_replace(x, '<[^>]+>', '', 'g'))), lambda x: x <> '') AS p FROM pages)")
def page_text(spark, d):
    p = table(spark, d, "pages").select("page_id", text.page_paragraphs(F.col("html")).alias("p"))
    return p.select("page_id", F.size("p").alias("n_paragraphs"), F.array_join("p", "\n").alias("body"))


# quality ---------------------------------------------------------------------------------------------------------------

_AUDITED = [*_FEATS, "v1_lag1", "v2_lag1", "news_mean"]
CTE["melt"] = " UNION ALL ".join(f"SELECT k, date, y, '{c}' AS col, CAST({c} AS DOUBLE) AS v FROM ftable" for c in _AUDITED)


def _melted(spark, d):
    return quality.melted(feature_frame(spark, d), ["k", "date", "y"], _AUDITED)


@query("column_audit", "SELECT col AS \"column\", count(*) AS n_rows, round(1 - count(v) / count(*), 6) AS missing_share, round(min(v), 4) AS low, round(max(v), 4) AS high, coalesce(min(v) = max(v), true) AS is_constant FROM melt GROUP BY col")
def column_audit(spark, d):
    return quality.column_audit(feature_frame(spark, d), _AUDITED).select("column", "n_rows", r("missing_share"), r("low", places=4), r("high", places=4), "is_constant")


@query("leakage_screen", "SELECT col AS \"column\", n, round(r2, 5) AS r2, r2 > 0.02 AND col NOT IN ('overnight_gap') AS flagged FROM (SELECT col, count(*) AS n, corr(y, v) ** 2 AS r2, stddev_samp(v) AS s FROM melt WHERE y IS NOT NULL AND v IS NOT NULL GROUP BY col) WHERE n >= 200 AND s > 0")
def leakage_screen(spark, d):
    m = _melted(spark, d).where("y is not null and value is not null").groupBy("column").agg(F.count("*").alias("n"), F.pow(F.corr("y", "value"), 2).alias("r2"), F.stddev_samp("value").alias("s"))
    return m.where("n >= 200 and s > 0").select("column", "n", r("r2", places=5), ((F.col("r2") > 0.02) & ~F.col("column").isin("overnight_gap")).alias("flagged"))


@query("redundant_pairs", "SELECT a.col AS a, b.col AS b, round(corr(a.v, b.v), 5) AS corr FROM melt a JOIN melt b ON a.k = b.k AND a.date = b.date AND a.col < b.col WHERE a.v IS NOT NULL AND b.v IS NOT NULL GROUP BY a.col, b.col HAVING abs(corr(a.v, b.v)) > 0.3")
def redundant_pairs(spark, d):
    return quality.pairwise_corr(feature_frame(spark, d), ["k", "date"], sorted(_AUDITED)).where("abs(corr) > 0.3").select("a", "b", r("corr", places=5))


@query("contract_violations", "SELECT k, n_duplicate_dates, n_no_target, n_no_future, n_infinite FROM (SELECT k, count(*) - count(DISTINCT date) AS n_duplicate_dates FROM ticks GROUP BY k) JOIN (SELECT k, count(*) FILTER (y IS NULL) AS n_no_target, count(*) FILTER (days_to_event IS NULL OR is_event_day IS NULL) AS n_no_future, count(*) FILTER (isinf(coalesce(momentum_21, 0))) AS n_infinite FROM ftable GROUP BY k) USING (k)")
def contract_violations(spark, d):
    """Repeated dates are counted on the rows as they landed, before anything groups them by date."""
    landed = ticks(spark, d).groupBy("k").agg((F.count("*") - F.count_distinct("date")).alias("n_duplicate_dates"))
    g = feature_frame(spark, d).groupBy("k")
    return landed.join(g.agg(F.count_if(F.col("y").isNull()).alias("n_no_target"), F.count_if(F.col("days_to_event").isNull() | F.col("is_event_day").isNull()).alias("n_no_future"), F.count_if(F.abs(F.coalesce("momentum_21", F.lit(0.0))) == float("inf")).alias("n_infinite")), "k")


_RULES = [("momentum_21", "mean", -1.0, 1.0), ("range_vol", "mean", 0.2, 5.0), ("volume_z", "mean", -0.5, 0.5), ("volume_z", "std", 0.5, 1.5), ("dist_ma50", "median", -0.5, 0.5)]


@query("range_rules", "SELECT rc AS \"column\", stat, round(CASE stat WHEN 'mean' THEN m WHEN 'std' THEN s ELSE md END, 4) AS value, CASE WHEN CASE stat WHEN 'mean' THEN m WHEN 'std' THEN s ELSE md END BETWEEN lo AND hi THEN 'PASS' ELSE 'FAIL' END AS status FROM (VALUES " + ", ".join(f"('{c}', '{s}', {lo}, {hi})" for c, s, lo, hi in _RULES) + ") t(rc, stat, lo, hi) JOIN (SELECT col, avg(v) AS m, stddev_samp(v) AS s, quantile_cont(v, 0.5) AS md FROM melt GROUP BY col) ON col = rc")
def range_rules(spark, d):
    s = _melted(spark, d).groupBy("column").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.percentile("value", 0.5).alias("median"))
    rules = spark.createDataFrame(_RULES, "column string, stat string, lo double, hi double")
    j = s.join(F.broadcast(rules), "column")
    v = F.when(F.col("stat") == "mean", F.col("mean")).when(F.col("stat") == "std", F.col("std")).otherwise(F.col("median"))
    return j.select("column", "stat", r(v, "value", 4), F.when(v.between(F.col("lo"), F.col("hi")), "PASS").otherwise("FAIL").alias("status"))


@query("quality_checks", "SELECT chk AS \"check\", CASE WHEN n = 0 THEN 'PASS' WHEN chk = 'zero_volume' THEN 'WARN' ELSE 'FAIL' END AS status, n AS value FROM (SELECT 'duplicate_dates' AS chk, (SELECT count(*) FROM (SELECT k, date FROM ticks GROUP BY k, date HAVING count(*) > 1)) AS n UNION ALL SELECT 'high_below_low', count(*) FROM bars WHERE high < low UNION ALL SELECT 'zero_volume', count(*) FROM bars WHERE volume <= 20 UNION ALL SELECT 'closed_days', count(*) FROM bars WHERE date NOT IN (SELECT session_date FROM sessions))")
def quality_checks(spark, d):
    open_days = sessions(spark, d).select(F.col("session_date").alias("date"), F.lit(True).alias("is_open"))
    b = bars(spark, d, F.count("*").alias("copies")).join(F.broadcast(open_days), "date", "left")  # copies: rows that landed for a key and day
    found = {"duplicate_dates": F.col("copies") > 1, "high_below_low": F.col("high") < F.col("low"), "zero_volume": F.col("volume") <= 20, "closed_days": F.col("is_open").isNull()}
    counts = b.agg(*(F.count_if(c).alias(n) for n, c in found.items()))
    long = counts.select(F.explode(F.array(*(F.struct(F.lit(n).alias("check"), F.col(n).alias("value")) for n in found))).alias("x")).select("x.*")
    return long.select("check", F.when(F.col("value") == 0, "PASS").when(F.col("check") == "zero_volume", "WARN").otherwise("FAIL").alias("status"), "value")


@query("price_validation", "SELECT k, CAST(sum(copies) AS BIGINT) - count(*) AS n_repeated, count(*) FILTER (close <= 0) AS n_not_positive, count(*) FILTER (volume IS NULL OR volume <= 0) AS n_no_volume, count(*) FILTER (gap > 5) AS n_gaps FROM (SELECT *, date - lag(date) OVER (PARTITION BY k ORDER BY date) AS gap FROM bars JOIN (SELECT k, date, count(*) AS copies FROM ticks GROUP BY k, date) USING (k, date)) GROUP BY k")
def price_validation(spark, d):
    b = bars(spark, d, F.count("*").alias("copies")).withColumn("gap", F.datediff("date", F.lag("date").over(by("k"))))
    return b.groupBy("k").agg((F.sum("copies") - F.count("*")).alias("n_repeated"), F.count_if(F.col("close") <= 0).alias("n_not_positive"), F.count_if(F.col("volume").isNull() | (F.col("volume") <= 0)).alias("n_no_volume"), F.count_if(F.col("gap") > 5).alias("n_gaps"))


@query("recompute_checks", "SELECT k, round(max(abs(y - (ln(close) - ln(before)))), 6) AS target_gap, round(max(abs(overnight_gap - (ln(open) - ln(before)))), 6) AS overnight_gap FROM (SELECT *, lag(close) OVER (PARTITION BY k ORDER BY date) AS before FROM feats) GROUP BY k")
def recompute_checks(spark, d):
    f = feature_frame(spark, d).withColumn("before", F.lag("close").over(by("k")))
    return f.groupBy("k").agg(r(F.max(F.abs(F.col("y") - (F.ln("close") - F.ln("before")))), "target_gap"), r(F.max(F.abs(F.col("overnight_gap") - (F.ln("open") - F.ln("before")))), "overnight_gap"))


@query("changes_on_release_only", "SELECT k, date FROM (SELECT k, date, v1_lag1 IS DISTINCT FROM lag(v1_lag1) OVER (PARTITION BY k ORDER BY date) AS changed, lag(date) OVER (PARTITION BY k ORDER BY date) AS before FROM ftable) f WHERE changed AND before IS NOT NULL AND NOT EXISTS (SELECT 1 FROM signals s JOIN daymap m ON m.date = s.avail WHERE s.k = f.k AND s.v1 IS NOT NULL AND m.next_after = f.date)")
def changes_on_release_only(spark, d):
    w = by("k")
    f = feature_frame(spark, d).select("k", "date", (~F.col("v1_lag1").eqNullSafe(F.lag("v1_lag1").over(w))).alias("changed"), F.lag("date").over(w).alias("before")).where("changed and before is not null")
    m = F.broadcast(session_map(spark, d).select(F.col("date").alias("avail"), F.col("next_after").alias("date")))
    known = signals(spark, d).where("v1 is not null").join(m, "avail").select("k", "date")
    return f.select("k", "date").join(known, ["k", "date"], "left_anti")


@query("event_day_ratio", "SELECT k, round(avg(abs(y)) FILTER (is_event_day = 1) / avg(abs(y)) FILTER (is_event_day = 0), 5) AS event_ratio, round(avg(abs(y)) FILTER (after = 1) / avg(abs(y)) FILTER (is_event_day_before = 1), 5) AS after_before FROM (SELECT *, lag(is_event_day) OVER (PARTITION BY k ORDER BY date) AS after FROM ftable) GROUP BY k")
def event_day_ratio(spark, d):
    f = feature_frame(spark, d).withColumn("after", F.lag("is_event_day").over(by("k")))
    mean = lambda c: F.avg(F.when(c, F.abs("y")))
    return f.groupBy("k").agg(r(ratio(mean(F.col("is_event_day") == 1), mean(F.col("is_event_day") == 0)), "event_ratio", 5), r(ratio(mean(F.col("after") == 1), mean(F.col("is_event_day_before") == 1)), "after_before", 5))


@query("coverage_boundary", "SELECT k, round(avg(CAST(dist_ma200 IS NOT NULL AS INT)) FILTER (idx < 150), 6) AS before, round(avg(CAST(dist_ma200 IS NOT NULL AS INT)) FILTER (idx >= 150), 6) AS after FROM feats GROUP BY k")
def coverage_boundary(spark, d):
    there = F.col("dist_ma200").isNotNull().cast("int")
    return feature_frame(spark, d).groupBy("k").agg(r(F.avg(F.when(F.col("idx") < 150, there)), "before"), r(F.avg(F.when(F.col("idx") >= 150, there)), "after"))


@query("drift_screen", "SELECT k, col AS \"column\", n, round(abs(avg(v) FILTER (i <= n / 2) - avg(v) FILTER (i > n / 2)) / stddev_samp(v), 4) AS shift FROM (SELECT k, col, v, row_number() OVER (PARTITION BY k, col ORDER BY date) AS i, count(*) OVER (PARTITION BY k, col) AS n FROM melt WHERE v IS NOT NULL) WHERE n >= 1000 GROUP BY k, col, n")
def drift_screen(spark, d):
    w = Window.partitionBy("k", "column")
    m = _melted(spark, d).where("value is not null").withColumn("i", F.row_number().over(w.orderBy("date"))).withColumn("n", F.count("*").over(w)).where("n >= 1000")
    half = lambda c: F.avg(F.when(c, F.col("value")))
    return m.groupBy("k", "column", "n").agg(r(ratio(F.abs(half(F.col("i") <= F.col("n") / 2) - half(F.col("i") > F.col("n") / 2)), F.stddev_samp("value")), "shift", 4))


@query("corr_shift", "SELECT k, round(corr(overnight_gap, y) FILTER (date < DATE '1998-07-01'), 5) AS early, round(corr(overnight_gap, y) FILTER (date >= DATE '1998-07-01'), 5) AS late FROM feats GROUP BY k")
def corr_shift(spark, d):
    early = F.col("date") < "1998-07-01"
    part = lambda c: F.corr(F.when(c, F.col("overnight_gap")), F.when(c, F.col("y")))
    return feature_frame(spark, d).groupBy("k").agg(r(part(early), "early", 5), r(part(~early), "late", 5))


@query("extreme_days", "SELECT k, arg_max(date, round(y, 9)) AS best_day, arg_min(date, round(y, 9)) AS worst_day, round(max(y), 6) AS best, round(min(y), 6) AS worst FROM rets WHERE y IS NOT NULL GROUP BY k")
def extreme_days(spark, d):
    y = F.round("y", 9)
    return rets(spark, d).where("y is not null").groupBy("k").agg(F.max_by("date", y).alias("best_day"), F.min_by("date", y).alias("worst_day"), r(F.max("y"), "best"), r(F.min("y"), "worst"))


@query("freshness_report", "SELECT k, col AS \"column\", max(date) FILTER (v IS NOT NULL) AS last_date, CAST(DATE '2001-10-31' - max(date) FILTER (v IS NOT NULL) AS INT) AS age, coalesce(DATE '2001-10-31' - max(date) FILTER (v IS NOT NULL) > 4, true) AS stale FROM melt WHERE date <= DATE '2001-10-31' GROUP BY k, col")
def freshness_report(spark, d):
    cutoff = F.lit("2001-10-31").cast("date")
    m = _melted(spark, d).where(F.col("date") <= cutoff).groupBy("k", "column").agg(F.max(F.when(F.col("value").isNotNull(), F.col("date"))).alias("last_date"))
    age = F.datediff(cutoff, "last_date")
    return m.select("k", "column", "last_date", age.alias("age"), F.coalesce(age > 4, F.lit(True)).alias("stale"))


@query("readiness_gate", "SELECT event_type AS k, last_session, last_event, last_session = last_event AS ready FROM (SELECT event_type, max(CAST(ts AS DATE)) AS last_event, (SELECT max(session_date) FROM sessions24 WHERE close_s <= epoch(max(ts))) AS last_session FROM events GROUP BY event_type)")
def readiness_gate(spark, d):
    e = table(spark, d, "events").groupBy(F.col("event_type").alias("k")).agg(F.max("ts").alias("at"))
    s = sessions(spark, d, "spine24")
    ends = s.agg(F.array_sort(F.collect_list(F.struct("close_ts", "session_date"))).alias("ends"))  # a calendar of a few months
    j = e.crossJoin(F.broadcast(ends))
    last = F.try_element_at(F.filter("ends", lambda x: x["close_ts"] <= F.col("at")), F.lit(-1))["session_date"]
    return j.select("k", last.alias("last_session"), F.to_date("at").alias("last_event"), (last == F.to_date("at")).alias("ready"))


@query("inventory_match", "SELECT doc_id, 'unlabelled' AS kind FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'unknown' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def inventory_match(spark, d):
    a, b = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id")
    return a.join(b, "doc_id", "left_anti").withColumn("kind", F.lit("unlabelled")).unionByName(b.join(a, "doc_id", "left_anti").withColumn("kind", F.lit("unknown")))


#: The columns of the given tables and their kinds, as the SQL needs them: whole number, string, double, time.
_TABLES = {
    "region": {"r_regionkey": "i", "r_name": "s"},
    "nation": {"n_nationkey": "i", "n_name": "s", "n_regionkey": "i"},
    "customer": {"c_custkey": "i", "c_name": "s", "c_nationkey": "i", "c_acctbal": "d", "c_mktsegment": "s"},
    "supplier": {"s_suppkey": "i", "s_name": "s", "s_nationkey": "i", "s_acctbal": "d"},
    "part": {"p_partkey": "i", "p_name": "s", "p_brand": "s", "p_type": "s", "p_size": "i", "p_retailprice": "d"},
    "orders": {"o_orderkey": "i", "o_custkey": "i", "o_orderstatus": "s", "o_totalprice": "d", "o_orderdate": "t", "o_orderpriority": "s"},
    "lineitem": {"l_orderkey": "i", "l_partkey": "i", "l_suppkey": "i", "l_linenumber": "i", "l_quantity": "d", "l_extendedprice": "d", "l_discount": "d", "l_tax": "d", "l_returnflag": "s", "l_linestatus": "s", "l_shipdate": "t"},
    "events": {"event_id": "i", "ts": "t", "user_id": "i", "event_type": "s", "value": "d", "props": "s"},
    "documents": {"doc_id": "i", "text": "s", "lang": "s", "source": "s", "n_chars": "i"},
    "embeddings": {"vec_id": "i", "embedding": "ad", "label": "i"},
    "pages": {"page_id": "i", "url": "s", "html": "s"},
    "benchmark": {"item_id": "i", "text": "s"},
    "labels": {"doc_id": "i", "quality": "i", "toxic": "i"},
    "conversations": {"conv_id": "i", "turn": "i", "role": "s", "text": "s"},
}


def _canonical_sql(c: str, kind: str) -> str:
    if kind == "d":
        x = f"CAST({c} AS DOUBLE)"
        g = f"floor(log2(abs({x})))"
        e = f"(CASE WHEN power(2.0, {g}) > abs({x}) THEN {g} - 1 WHEN power(2.0, {g} + 1) <= abs({x}) THEN {g} + 1 ELSE {g} END)"
        text = f"CASE WHEN isnan({x}) THEN 'nan' WHEN abs({x}) > 1e-250 AND abs({x}) < 1e250 THEN CASE WHEN {x} < 0 THEN '-' ELSE '' END || CAST(floor(abs({x}) * power(2.0, 52 - {e})) AS BIGINT) || 'p' || CAST({e} AS BIGINT) ELSE CAST({x} AS VARCHAR) END"
    elif kind == "ad":
        text = f"'[' || array_to_string([{_canonical_sql('x', 'd')} FOR x IN {c}], ',') || ']'"
    else:
        text = {"i": f"CAST({c} AS VARCHAR)", "t": f"CAST(epoch_us({c}) AS VARCHAR)", "s": f"strlen({c}) || ':' || {c}"}[kind]
    return f"coalesce({text}, '~')"


def _digest_sql(t, where="true"):
    text = "md5(concat_ws('|', " + ", ".join(_canonical_sql(c, k) for c, k in sorted(_TABLES[t].items())) + "))"
    half = lambda k: f"CAST(coalesce(sum(CAST(CAST('0x' || substr(h, {k}, 15) AS BIGINT) AS HUGEINT)), 0) AS VARCHAR)"
    return f"SELECT '{t}' AS \"table\", count(*) AS n_rows, {half(1)} AS digest_a, {half(16)} AS digest_b FROM (SELECT {text} AS h FROM {t} WHERE {where})"


def _digests(spark, d, parts):
    return reduce(lambda a, b: a.unionByName(b), [digest.digest(table(spark, d, t).where(w)).withColumn("table", F.lit(t)) for t, w in parts.items()])


@query("table_fingerprint", " UNION ALL ".join(map(_digest_sql, _TABLES)))
def table_fingerprint(spark, d):
    return _digests(spark, d, dict.fromkeys(_TABLES, "true"))


#: An earlier snapshot: it lacked some orders and all events, and had a table more.
_NOW, _BEFORE = ("orders", "events", "labels"), {"orders": "o_orderkey > 10", "labels": "true", "region": "true"}


@query("changed_sources", f"SELECT \"table\", CASE WHEN b.n_rows IS NULL THEN 'added' WHEN a.n_rows IS NULL THEN 'removed' ELSE 'changed' END AS change FROM ({' UNION ALL '.join(map(_digest_sql, _NOW))}) a FULL JOIN ({' UNION ALL '.join(_digest_sql(t, w) for t, w in _BEFORE.items())}) b USING (\"table\") WHERE (a.n_rows, a.digest_a, a.digest_b) IS DISTINCT FROM (b.n_rows, b.digest_a, b.digest_b)")
def changed_sources(spark, d):
    return sinks.changed_sources(_digests(spark, d, dict.fromkeys(_NOW, "true")), _digests(spark, d, _BEFORE))


def _column_digest_sql(t, edits):
    cells = lambda c, k: f"CAST(sum(CAST(CAST('0x' || substr(md5({_canonical_sql(c, k)}), 1, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR)"
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {cells(edits.get(c, c), k)} AS dg FROM {t}" for c, k in _TABLES[t].items())


#: An earlier state of one column: a price of one order that was a cent less.
_EDIT = "CASE WHEN o_orderkey = 5 THEN o_totalprice - 0.01 ELSE o_totalprice END"


@query("changed_columns", f"SELECT \"column\" FROM ({_column_digest_sql('orders', {})}) a JOIN ({_column_digest_sql('orders', {'o_totalprice': _EDIT})}) b USING (\"column\") WHERE a.dg <> b.dg")
def changed_columns(spark, d):
    o = table(spark, d, "orders")
    before = digest.by_column(o.withColumn("o_totalprice", F.expr(_EDIT))).withColumnRenamed("digest", "before")
    return digest.by_column(o).join(F.broadcast(before), "column").where("digest <> before").select("column")  # a row a column


@query("missing_dates", "SELECT k, date, CAST((v1_lag1 IS NULL)::INT + (v2_lag1 IS NULL)::INT + (news_mean IS NULL)::INT AS INT) AS n_missing FROM ftable WHERE v1_lag1 IS NULL OR v2_lag1 IS NULL OR news_mean IS NULL")
def missing_dates(spark, d):
    cols = ["v1_lag1", "v2_lag1", "news_mean"]
    n = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in cols])
    return feature_frame(spark, d).select("k", "date", n.alias("n_missing")).where("n_missing > 0")


@query("run_completeness", "SELECT rung, p.fold, seed, bool_and(p.n = e.n) AND count(*) = 2 AS complete FROM (SELECT rung, fold, seed, model, count(*) AS n FROM preds GROUP BY ALL) p JOIN (SELECT fold, count(*) AS n FROM tgt GROUP BY fold) e ON e.fold = p.fold GROUP BY rung, p.fold, seed")
def run_completeness(spark, d):
    n = predictions(spark, d).groupBy(*CELL, "model").agg(F.count("*").alias("n"))
    expected = targets(spark, d).groupBy("fold").agg(F.count("*").alias("expected"))  # a row for each window and step of the fold
    return n.join(expected, "fold").groupBy(*CELL).agg((F.bool_and(F.col("n") == F.col("expected")) & (F.count("*") == 2)).alias("complete"))

