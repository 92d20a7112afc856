"""Queries over the driver's tables, one or more for each operator, and the SQL that must give the same rows.

Doubles are rounded on both sides where the order of a sum may show.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats, text
from ..operators import categories, causal, events, matching, models, panel, quality, reports, shared, synthetic
from ..sources import files, portals
from . import capsule

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "panel_person_period"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _r(c: Column, places: int = 6) -> Column:
    return F.round(c, places)


# Person-period panel: suppliers are the subjects, shipping years the periods, regions the places.

TIES = ("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice", "l_discount", "l_tax")
PANEL = panel.Panel("subject", "period", "place_now", "place_last", ("mh", "sr", "sw"), "n", ("gender", "age"), TIES)

SOURCE_SQL = """
SELECT l.l_suppkey AS subject, year(l.l_shipdate) AS period, rs.r_name AS place_now, rc.r_name AS place_last,
  l.l_returnflag = 'R' AS mh, l.l_linestatus = 'F' AS sr, l.l_discount > 0.05 AS sw, CAST(l.l_quantity AS INTEGER) AS n,
  CASE WHEN l.l_suppkey % 2 = 0 THEN 'Male' ELSE 'Female' END AS gender,
  CASE WHEN l.l_suppkey % 3 = 0 THEN '18 to 24' WHEN l.l_suppkey % 3 = 1 THEN '25 to 49' ELSE '50+' END AS age,
  l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_shipdate, l.l_extendedprice, l.l_discount, l.l_tax
FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation ns ON s.s_nationkey = ns.n_nationkey JOIN region rs ON ns.n_regionkey = rs.r_regionkey
JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation nc ON c.c_nationkey = nc.n_nationkey JOIN region rc ON nc.n_regionkey = rc.r_regionkey
"""
MOVES_SQL = f"""
SELECT *, CASE WHEN mh AND NOT sr AND NOT sw THEN 'a1' WHEN NOT mh AND sr AND NOT sw THEN 'a2' WHEN mh AND sr AND NOT sw THEN 'a4'
  WHEN NOT mh AND sr AND sw THEN 'a5' WHEN mh AND sr AND sw THEN 'a7' WHEN NOT mh AND NOT sr AND NOT sw THEN 'a8' ELSE 'other' END AS code,
  CASE WHEN place_now <> place_last THEN 1 ELSE 0 END AS moved_within,
  CASE WHEN lag(place_now) OVER w IS NOT NULL AND place_now <> lag(place_now) OVER w THEN 1 ELSE 0 END AS moved_across
FROM ({SOURCE_SQL}) WINDOW w AS (PARTITION BY subject, period ORDER BY place_now, {", ".join(TIES)})
"""
PANEL_SQL = f"""
SELECT p.*, CASE WHEN ac >= 2 THEN 1 ELSE 0 END AS treat FROM (
SELECT subject, period, sum(moved_within + moved_across) AS vm, count(DISTINCT code) FILTER (WHERE code <> 'other') AS ac, sum(n) AS np, min(gender) AS gender, min(age) AS age,
  array_to_string(list_sort(list_distinct(list_concat(list(DISTINCT place_now), list(DISTINCT place_last)))), ' + ') AS rc
FROM ({MOVES_SQL}) GROUP BY subject, period) p
"""


def panel_source(spark: SparkSession, d: str) -> DataFrame:
    nations = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    supplier = t(spark, d, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("r_name").alias("place_now"))
    customer = t(spark, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("r_name").alias("place_last"))
    orders = t(spark, d, "orders").select("o_orderkey", "o_custkey").join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "place_last")
    lines = t(spark, d, "lineitem").join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    key = F.col("l_suppkey")
    return lines.select(
        key.alias("subject"), F.year("l_shipdate").alias("period"), "place_now", "place_last",
        (F.col("l_returnflag") == "R").alias("mh"), (F.col("l_linestatus") == "F").alias("sr"), (F.col("l_discount") > 0.05).alias("sw"), F.col("l_quantity").cast("int").alias("n"),
        F.when(key % 2 == 0, "Male").otherwise("Female").alias("gender"), F.when(key % 3 == 0, "18 to 24").when(key % 3 == 1, "25 to 49").otherwise("50+").alias("age"), *TIES,
    )


def _persons(spark: SparkSession, d: str) -> DataFrame:
    """The panel without its places, joined and shuffled once for all that reads it."""
    return shared.kept(panel.person_period(panel_source(spark, d), PANEL).select("subject", "period", "treat", "gender", "age", "vm", "np"), "persons")


@query(PANEL_SQL)
def panel_person_period(spark, d):
    return panel.person_period(panel_source(spark, d), PANEL)


@query(f"""SELECT count(*) AS n, sum(np) AS total, round(avg(vm), 6) AS mean, round(stddev_samp(vm), 6) AS sd, min(vm) AS min, max(vm) AS max,
  round(sum(vm * np) / sum(np), 6) AS w_mean, round(sqrt((sum(np * vm * vm) - power(sum(np * vm), 2) / sum(np)) / (sum(np) - 1)), 6) AS w_sd, round(avg(treat), 6) AS treated_share,
  round(avg(vm) FILTER (WHERE treat = 1), 6) AS mean_1, round(avg(vm) FILTER (WHERE treat = 0), 6) AS mean_0,
  round(sum(vm * np) FILTER (WHERE treat = 1) / sum(np) FILTER (WHERE treat = 1), 6) AS w_mean_1, round(sum(vm * np) FILTER (WHERE treat = 0) / sum(np) FILTER (WHERE treat = 0), 6) AS w_mean_0
  FROM ({PANEL_SQL})""")
def panel_descriptives(spark, d):
    out = panel.descriptives(panel.person_period(panel_source(spark, d), PANEL))
    return out.select(*(_r(c).alias(n) if k == "double" else c.alias(n) for n, k in out.dtypes for c in (F.col(n),)))


@query(f"SELECT 'full' AS scope, statistic, round(value, 6) AS value FROM (UNPIVOT (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(np) AS DOUBLE) AS total, avg(CAST(vm AS DOUBLE)) AS mean FROM ({PANEL_SQL})) ON n, total, mean INTO NAME statistic VALUE value)")
def panel_long_table(spark, d):
    one = panel.descriptives(panel.person_period(panel_source(spark, d), PANEL)).select("n", "total", "mean")
    return panel.long_table(one, "full").withColumn("value", _r(F.col("value")))


@query(f"SELECT subject, period, round(mid, 2) AS midpoint, CASE WHEN gender = 'Male' THEN 1 ELSE 2 END AS sg FROM (SELECT *, CASE age WHEN '18 to 24' THEN 21.0 WHEN '25 to 49' THEN 42.0 WHEN '50+' THEN 57.5 END AS mid FROM ({PANEL_SQL}))")
def panel_codes(spark, d):
    p = panel.person_period(panel_source(spark, d), PANEL)
    return p.select("subject", "period", _r(panel.age_midpoint(F.col("age")), 2).alias("midpoint"), F.when(F.col("gender") == "Male", 1).otherwise(2).alias("sg"))


@query("SELECT year(o_orderdate) AS period, count(*) AS n, round(sum(CAST(o_totalprice AS DECIMAL(18,2))), 2) AS total FROM orders GROUP BY GROUPING SETS ((), (year(o_orderdate)))")
def pooled_and_by_year(spark, d):
    o = t(spark, d, "orders")
    return panel.pooled_and_by(o, F.year("o_orderdate"), n=F.count("*"), total=F.sum(F.col("o_totalprice").cast("decimal(18,2)")))


@query("SELECT event_id, user_id, event_type, lag(event_type) OVER w AS previous, CASE WHEN lag(event_type) OVER w IS NOT NULL AND event_type <> lag(event_type) OVER w THEN 1 ELSE 0 END AS changed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def lag_change_flag(spark, d):
    return panel.change_flag(t(spark, d, "events").select("event_id", "user_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"], "event_type").drop("ts")


@query("SELECT l_orderkey, l_linenumber, l_partkey, unnest(range(1, CAST(l_quantity AS INTEGER) + 1)) AS copy FROM lineitem WHERE CAST(l_quantity AS INTEGER) > 0")
def expand_by_count(spark, d):
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("int").alias("n"))
    return panel.expand_by_count(rows, "n").select("l_orderkey", "l_linenumber", "l_partkey", F.col("copy").cast("long").alias("copy"))


@query("SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ' + ') AS priorities, count(DISTINCT o_orderpriority) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) AS urgent FROM orders GROUP BY o_custkey")
def sorted_distinct_concat(spark, d):
    p = F.col("o_orderpriority")
    return t(spark, d, "orders").groupBy("o_custkey").agg(F.concat_ws(" + ", F.array_sort(F.collect_set(p))).alias("priorities"), F.size(F.collect_set(F.when(p.isin("1-URGENT", "2-HIGH"), p))).cast("long").alias("urgent"))


@query("SELECT conv_id, arg_min(text, turn) AS text FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def first_match_by_position(spark, d):
    return panel.first_match(t(spark, d, "conversations"), ["conv_id"], "text", ["turn"], F.col("role") == "assistant")


@query("SELECT o_custkey, value, times FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY times DESC, length(value) DESC, value) AS rn FROM (SELECT o_custkey, o_orderpriority AS value, count(*) AS times FROM orders GROUP BY ALL)) WHERE rn = 1")
def modal_phrase(spark, d):
    return panel.most_frequent(t(spark, d, "orders").select("o_custkey", F.col("o_orderpriority").alias("value")), ["o_custkey"], "value")


@query("SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen FROM events")
def nearest_preceding(spark, d):
    e = t(spark, d, "events").withColumn("mark", F.when(F.col("event_type") == "purchase", F.col("event_id")))
    return panel.last_seen(e, ["user_id"], ["ts", "event_id"], "mark").select("event_id", "user_id", "seen")


@query("SELECT o_orderkey, printf('%d-%05d', year(o_orderdate), row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_orderkey)) AS label FROM orders")
def seq_id_pattern(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").alias(synthetic.ROW), F.year("o_orderdate").alias("year"))
    return synthetic.add_column(o, "label", {"type": "id_pattern", "pattern": "{year}-{seq:05d}", "year_col": "year"}, 1, ["year"]).select("o_orderkey", "label")


# Statistics and mathematics.


@query("SELECT l_returnflag, round(avg(l_quantity), 6) AS mean, round(var_samp(l_quantity), 6) AS var, round(stddev_pop(l_quantity), 6) AS sd0, round(corr(l_quantity, l_extendedprice), 6) AS cor FROM lineitem GROUP BY l_returnflag")
def core_stats(spark, d):
    return t(spark, d, "lineitem").groupBy("l_returnflag").agg(
        _r(stats.core_mean("l_quantity")).alias("mean"), _r(stats.core_var("l_quantity")).alias("var"), _r(stats.core_std("l_quantity", 0)).alias("sd0"), _r(stats.core_cor("l_quantity", "l_extendedprice")).alias("cor")
    )


@query("SELECT event_id, round(exp(-0.5 * power((value - 0.3) / 1.7, 2)) / (1.7 * sqrt(2 * pi())), 9) AS pdf, round(-0.5 * power((value - 0.3) / 1.7, 2) - ln(1.7) - 0.5 * ln(2 * pi()), 6) AS logpdf FROM events")
def normal_densities(spark, d):
    return t(spark, d, "events").select("event_id", _r(stats.normal_pdf("value", 0.3, 1.7), 9).alias("pdf"), _r(stats.normal_logpdf("value", 0.3, 1.7)).alias("logpdf"))


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: power(CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE), 2)))), 5) AS dist FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id = a.vec_id + 10")
def euclid_pairs(spark, d):
    e = t(spark, d, "embeddings")
    a, b = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x"), "label"), e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y"), "label", (F.col("vec_id") - 10).alias("a"))
    return a.join(b, ["a", "label"]).select("a", "b", _r(stats.euclid_dist(F.col("x"), F.col("y")), 5).alias("dist"))


@query("SELECT c_custkey, round(CASE WHEN c_nationkey % 2 = 1 THEN 1 / greatest(0.05, least(0.95, c_acctbal / 10000)) ELSE 1 / (1 - greatest(0.05, least(0.95, c_acctbal / 10000))) END, 6) AS weight FROM customer")
def ipw_weights(spark, d):
    return t(spark, d, "customer").select("c_custkey", _r(stats.trimmed_ipw_weights(F.col("c_nationkey") % 2, F.col("c_acctbal") / 10000, 0.05, 0.95)).alias("weight"))


@query(f"""SELECT CAST(k AS INTEGER) AS replicate, round(sum(x * w) / sum(w), 4) AS mean FROM (SELECT k, x, len(list_filter({stats.POISSON_ONE}, lambda s: u >= s)) AS w FROM (SELECT k, CAST(o_totalprice AS DOUBLE) AS x,
  CAST(CAST('0x' || left(md5(o_orderkey || ':' || k || ':7'), 13) AS BIGINT) AS DOUBLE) / 4503599627370496 AS u FROM orders, range(20) r(k))) GROUP BY k""")
def bootstrap_mean(spark, d):
    return stats.bootstrap_means(t(spark, d, "orders"), "o_totalprice", "o_orderkey", 20, 7).select("replicate", _r(F.col("mean"), 4).alias("mean"))


@query("""SELECT event_id, round(CASE WHEN x = 0 THEN 0 ELSE list_sum(list_transform(range(CAST(x + 12 * sqrt(x) + 80 AS BIGINT)), lambda k: exp((shape + k) * ln(x) - x - lgamma(shape + k + 1)))) END, 9) AS p
  FROM (SELECT event_id, abs(value) AS x, 0.5 + event_id % 40 / 2.0::DOUBLE AS shape FROM events)""")
def gamma_cdf(spark, d):
    return t(spark, d, "events").select("event_id", _r(stats.gamma_cdf_regularized(0.5 + F.col("event_id") % 40 / 2.0, F.abs("value")), 9).alias("p"))


# Text.


@query("SELECT doc_id, sha256(text) AS digest, CASE WHEN lang = 'en' THEN true ELSE false END AS match FROM documents")
def sha256_text(spark, d):
    x = t(spark, d, "documents").withColumn("actual", text.sha256(F.col("text"))).withColumn("pinned", F.when(F.col("lang") == "en", F.col("actual")).otherwise(""))
    return x.select("doc_id", F.col("actual").alias("digest"), text.sha256_check(F.col("actual"), F.col("pinned"))["match"].alias("match"))


def _fold_sql(x: str) -> str:
    out = f"translate({x}, '{text.FOLD_FROM}', '{text.FOLD_TO}')"
    for a, b in text.FOLD_PAIRS:
        out = f"replace({out}, '{a}', '{b}')"
    return rf"regexp_replace({out}, '[^\x00-\x7F]', '', 'g')"


@query(rf"SELECT doc_id, sha256({_fold_sql('text')}) AS folded, sha256(regexp_replace({_fold_sql('text')}, '[^\x20-\x7E]', '', 'g')) AS printable FROM documents")
def ascii_fold(spark, d):
    x = t(spark, d, "documents")
    return x.select("doc_id", text.sha256(text.fold_latin(F.col("text"))).alias("folded"), text.sha256(text.to_ascii(F.col("text"))).alias("printable"))


HTML_SQL = "html"
for _p, _b in ((r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", " "), (r"(?i)</(?:p|div|h[1-6]|tr|li|br)>|<br\s*/?>", "\n"), ("<[^>]+>", " "), ("&nbsp;", " "), ("&amp;", "&"), ("&#8217;|&rsquo;", "''"), (r"[ \t]+", " "), (r" ?\n ?", "\n"), (r"\n{3,}", "\n\n")):
    HTML_SQL = f"regexp_replace({HTML_SQL}, '{_p}', '{_b}', 'g')"


@query(f"SELECT page_id, sha256(body) AS digest, length(body) AS size FROM (SELECT page_id, {HTML_SQL} AS body FROM pages)")
def html_to_text(spark, d):
    p = t(spark, d, "pages").select("page_id", text.html_to_text(F.col("html")).alias("body"))
    return p.select("page_id", text.sha256(F.col("body")).alias("digest"), F.length("body").cast("long").alias("size"))


MONTH_SQL = "['" + "','".join(text.MONTHS) + "']"


@query(rf"""SELECT o_orderkey, CASE WHEN p = '' THEN CASE WHEN regexp_full_match(s, '\d{{4}}-\d{{2}}-\d{{2}}') THEN s ELSE '' END WHEN list_position({MONTH_SQL}, lower(regexp_extract(s, p0, 1))) IS NULL THEN ''
  ELSE printf('%s-%02d-%02d', regexp_extract(s, p0, 3), list_position({MONTH_SQL}, lower(regexp_extract(s, p0, 1))), CAST(regexp_extract(s, p0, 2) AS INTEGER)) END AS iso
  FROM (SELECT *, regexp_extract(s, p0, 0) AS p FROM (SELECT o_orderkey, '([A-Za-z]+)\s+(\d{{1,2}}),?\s+(\d{{4}})' AS p0,
  CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, 'on %B %-d, %Y at noon') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN 'Brumaire 9 1799' ELSE 'undated' END AS s FROM orders))""")
def iso_date(spark, d):
    k = F.col("o_orderkey") % 4
    s = F.when(k == 0, F.date_format("o_orderdate", "'on 'MMMM d, yyyy' at noon'")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 2, "Brumaire 9 1799").otherwise("undated")
    return t(spark, d, "orders").select("o_orderkey", text.to_iso_date(s).alias("iso"))


@query(r"SELECT event_id, CAST(regexp_extract(props, '\d+') AS BIGINT) AS k FROM events")
def json_path(spark, d):
    return t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


MESSAGES = ("HTTP 429 too many requests", "TLS handshake failed: could not resolve host; timed out", "403 Forbidden", "disk full")
_MESSAGE_SQL = "CASE event_id % 4 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(MESSAGES)) + " END"


@query("SELECT event_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(m, '(?i){p}') THEN '{c}' END" for c, p in text.DOWNLOAD_CAUSES) + f"], lambda x: x IS NOT NULL), ',') AS causes FROM (SELECT event_id, {_MESSAGE_SQL} AS m FROM events)")
def error_classifier(spark, d):
    m = F.get(F.array(*(F.lit(x) for x in MESSAGES)), (F.col("event_id") % 4).cast("int"))
    return t(spark, d, "events").select("event_id", F.array_join(text.download_causes(m), ",").alias("causes"))


@query("SELECT url, arg_min(title, k) AS title, arg_min(format, k) AS format, arg_min(page, k) AS page FROM (SELECT page_id * 100000 + i AS k, page_id AS page, regexp_extract(l, 'href=\"([^\"]+)\"', 1) AS url, trim(regexp_replace(regexp_replace(regexp_replace(l, '<[^>]+>', '', 'g'), '&amp;', '&', 'g'), '\\s+', ' ', 'g')) AS title, lower(regexp_extract(regexp_extract(l, 'href=\"([^\"]+)\"', 1), '\\.([^.]+)$', 1)) AS format FROM (SELECT page_id, unnest(ls) AS l, unnest(range(len(ls))) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?is)<a\\b[^>]*href=\"[^\"]+\"[^>]*>.*?</a>') AS ls FROM pages))) GROUP BY url")
def link_catalogue(spark, d):
    return portals.link_catalogue(t(spark, d, "pages"), "page_id", "page_id")


@query("SELECT p_partkey, CASE WHEN regexp_matches(v, '[,\"\\n]') THEN '\"' || replace(v, '\"', '\"\"') || '\"' ELSE v END AS field FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name || ', \"' || p_brand || '\"' ELSE p_name END AS v FROM part)")
def csv_quoting(spark, d):
    v = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"'))).otherwise(F.col("p_name"))
    return t(spark, d, "part").select("p_partkey", files.csv_field(v).alias("field"))


_TO_CYRILLIC, _FROM_LATIN = "абвгдезийклмнопрстуфхц", "abvgdezijklmnoprstufhc"
_TO_GREEK, _GREEK_LATIN, _GREEK_BACK = "αβγδεζηικλμνξοπρστω", "abgdezyiklmnxoprstw", "abgdezeiklmnxoprsto"


@query(f"""SELECT p_partkey, p_name AS cyrillic, translate(p_name, '{_GREEK_LATIN}hfqu', '{_GREEK_BACK}') AS greek, 'Moskva, Athena' AS fixed FROM part""")
def romanise_names(spark, d):
    """Names spelled in Cyrillic and in Greek letters, and back."""
    name = F.col("p_name")
    cyrillic, greek = F.translate(name, _FROM_LATIN, _TO_CYRILLIC), F.translate(F.translate(name, "hfqu", ""), _GREEK_LATIN, _TO_GREEK)
    greek = F.replace(greek, F.lit("γκ"), F.lit("γ́κ"))  # a letter of its own: no pair
    return t(spark, d, "part").select("p_partkey", text.to_ascii(cyrillic).alias("cyrillic"), text.to_ascii(greek).alias("greek"), text.to_ascii(F.lit("Москва, Αθήνα")).alias("fixed"))


@query("""SELECT p_partkey, upper(left(p_brand, 1)) || substr(p_brand, 2) AS first, trim(regexp_replace(p_type, '[^A-Za-z0-9]+', ' ', 'g')) AS words, lower(regexp_extract(f, '\\.([^.]+)$', 1)) AS extension, regexp_extract(f, '([^/]*)$', 1) AS base,
  replace(url_encode(f), '+', '%20') AS encoded, f AS valid, strftime(TIMESTAMP '2026-01-02 03:04:05' + INTERVAL (p_partkey) SECOND, '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM (SELECT *, 'data files/' || p_brand || '/é ' || p_partkey || '.Tar.GZ' AS f FROM part)""")
def text_helpers(spark, d):
    f = F.concat(F.lit("data files/"), "p_brand", F.lit("/é "), F.col("p_partkey").cast("string"), F.lit(".Tar.GZ"))
    stamp = F.timestamp_add("SECOND", F.col("p_partkey"), F.lit("2026-01-02 03:04:05").cast("timestamp_ntz"))
    return t(spark, d, "part").select(
        "p_partkey", text.upper_first(F.col("p_brand")).alias("first"), text.words_only(F.col("p_type")).alias("words"), text.file_extension(f).alias("extension"), text.base_name(f).alias("base"),
        text.url_encode(f).alias("encoded"), text.ascii_fallback(f).alias("valid"), text.utc_stamp(stamp).alias("stamp"),
    )


# Addresses: replies of portals, made from suppliers.


@query("""SELECT s_suppkey, CASE WHEN k % 3 <> 0 THEN 'https://p.org/' || s_suppkey || '.csv' END AS shown, CASE WHEN k % 4 = 1 THEN 'https://p.org/x.csv' WHEN k % 4 = 3 THEN 'https://p.org/x.xlsx' END AS searched,
  'https://p.org/api/3/action/package_search?q=' || replace(url_encode(trim(regexp_replace(s_name, '[^A-Za-z0-9]+', ' ', 'g'))), '+', '%20') AS search_request, CASE WHEN k % 2 = 0 THEN 'https://host.org/api/views/d-' || s_suppkey || '/rows.csv?accessType=DOWNLOAD' END AS socrata,
  CASE WHEN k % 5 IN (0, 1) THEN 'https://gis.org/layer/' || s_suppkey || '/query?where=1%3D1&outFields=*&f=geojson' END AS arcgis, 'https://archive.org/wayback/available?url=https%3A%2F%2Fp.org%2F' || s_suppkey || CASE WHEN k % 2 = 0 THEN '&timestamp=20260102' ELSE '' END AS asked,
  CASE WHEN k % 3 = 1 THEN 'https://web.archive.org/' || s_suppkey END AS snapshot, CASE WHEN s_suppkey - 5 > 0 THEN 'https://www.siu.on.ca/fr/directors_report_details.php?drid=' || (s_suppkey - 5) END AS report,
  CASE WHEN k % 2 = 0 THEN 'https://p.org/a' ELSE 'https://q.org/a' END AS absolute FROM (SELECT *, s_suppkey AS k FROM supplier)""")
def portal_addresses(spark, d):
    k, n = F.col("s_suppkey"), F.col("s_suppkey").cast("string")
    c = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v for v in x))
    show = c('{"success": ', F.when(k % 3 != 0, "true").otherwise("false"), ', "result": {"resources": [{"name": "Notes", "url": "no"}, {"name": "The DATA 2014", "format": "csv", "url": "https://p.org/', n, '.csv"}, {"name": "data", "url": "late"}]}}')
    kind = F.when(k % 4 == 1, "CSV").when(k % 4 == 3, "XLSX").otherwise("PDF")
    search = c('{"result": {"results": [{"resources": null}, {"resources": [{"name": "data", "format": "', kind, '", "url": "https://p.org/x.', F.lower(kind), '"}]}]}}')
    closest = c('{"archived_snapshots": {', F.when(k % 3 != 0, c('"closest": {"available": ', F.when(k % 3 == 1, "true").otherwise("false"), ', "url": "http://web.archive.org/', n, '"}')).otherwise(""), "}}")
    gis = F.when(k % 5 < 2, F.lit('{"name": "roads"}')).when(k % 5 == 2, '{"name": "roads", "error": {"code": 4}}').otherwise("{}")
    return t(spark, d, "supplier").select(
        "s_suppkey", portals.package_show_url(show, "data 20").alias("shown"), portals.package_search_url(search, "data", "xlsx").alias("searched"),
        portals.search_address(F.lit("https://p.org/api/3/action/package_show?id=1"), F.lit(""), F.col("s_name")).alias("search_request"),
        portals.socrata_url(F.when(k % 2 == 0, '{"id": "d"}').otherwise("{}"), F.lit("host.org"), c("d-", n)).alias("socrata"), portals.arcgis_url(gis, c("https://gis.org/layer/", n, "//")).alias("arcgis"),
        portals.snapshot_address(c("https://p.org/", n), F.when(k % 2 == 0, "20260102")).alias("asked"), portals.snapshot_url(closest).alias("snapshot"), portals.report_address(k - 5, "fr").alias("report"),
        portals.absolute(F.when(k % 2 == 0, "/a").otherwise("https://q.org/a"), "https://p.org").alias("absolute"),
    )


# Reports, made from customers so that all rules occur.

CASES = (
    "Subject Officials\nSO #1 Interviewed\nSO #2 Declined interview\nSO #3 Interviewed\n\nWitness Officials\nWO #1 Interviewed\n",
    "The SO was interviewed. He also spoke to a witness who was not a subject official.",
    "No subject official was designated in this case.",
    "The weather was fine.",
    "The two subject officials left.",
    "Later SO #7 of another force came. The SO was interviewed.",
    "SO #1 and SO #2 were present. The Investigation began. Number of SIU Investigators assigned: 4. A 35-year-old man was hurt.",
    "Notification of the SIU\nThe Investigation\nNumber of SIU Forensic Investigators assigned: 2. A 7 year old Girl waved. Subject Officers\nSO\n",
)
COUNTS = (3, 1, 0, None, 2, 1, 2, None)
_CASE_SQL = "CASE c_custkey % 8 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CASES)) + " END"


def _case() -> Column:
    return F.get(F.array(*(F.lit(c) for c in CASES)), (F.col("c_custkey") % 8).cast("int"))


@query("SELECT c_custkey, CASE c_custkey % 8 " + " ".join(f"WHEN {i} THEN {'NULL' if c is None else c}" for i, c in enumerate(COUNTS)) + " END AS subject_officials FROM customer")
def resolve_subject_count(spark, d):
    return t(spark, d, "customer").select("c_custkey", reports.subject_officials(_case())["count"].alias("subject_officials"))


def _markers_sql(marks: tuple[str, ...]) -> str:
    return " + ".join("CAST(contains(s, '" + m.replace("'", "''") + "') AS INTEGER)" for m in marks)


@query(rf"""SELECT c_custkey, CASE WHEN e >= 2 AND e > f THEN 'en' WHEN f >= 2 AND f > e THEN 'fr' ELSE 'unknown' END AS language, regexp_extract(s, '(?i)Number of SIU Investigators[^0-9\n]{{0,30}}(\d+)', 1) AS investigators,
  regexp_extract(s, '(?i)\b(\d{{1,3}})[\s\-]year[\s\-]old\s+(woman|man|female|male|girl|boy|person|individual|youth|child|adult)\b', 1) AS age,
  lower(regexp_extract(s, '(?i)\b(\d{{1,3}})[\s\-]year[\s\-]old\s+(woman|man|female|male|girl|boy|person|individual|youth|child|adult)\b', 2)) AS sex
  FROM (SELECT *, {_markers_sql(reports.ENGLISH)} AS e, {_markers_sql(reports.FRENCH)} AS f FROM (SELECT c_custkey, {_CASE_SQL} AS s FROM customer))""")
def report_scalars(spark, d):
    s = _case()
    f = reports.fields(s)
    return t(spark, d, "customer").select("c_custkey", f["_language"].alias("language"), f["siu_investigators"].alias("investigators"), f["age_affected"].alias("age"), f["sex_gender_affected"].alias("sex"))


CHARGE_TEXTS = ("There is no basis for charges.", "He was charged with assault.", "Charges shall issue.", "The file is closed.", "")


@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'FALSE' WHEN 1 THEN 'TRUE' WHEN 2 THEN 'FALSE' ELSE '' END AS charges FROM orders")
def charges_class(spark, d):
    body = F.get(F.array(*(F.lit(c) for c in CHARGE_TEXTS)), (F.col("o_orderkey") % 5).cast("int"))
    report = F.when(body == "", "").otherwise(F.concat(F.lit("Analysis and Director’s Decision\n"), body, F.lit("\nEndnotes\nnone\n")))
    return t(spark, d, "orders").select("o_orderkey", reports.charges(report).alias("charges"))


@query("SELECT c_custkey, 'Body of ' || c_name || chr(10) AS section FROM customer")
def section_slice(spark, d):
    s = F.concat(F.lit("Intro\n  Evidence  \nBody of "), F.col("c_name"), F.lit("\nThe Team\nMore\n"))
    return t(spark, d, "customer").select("c_custkey", reports.section(s, "Evidence", ("The Team", "Endnotes")).alias("section"))


@query()
def parse_reports(spark, d):
    return reports.parse_reports(t(spark, d, "pages").select("page_id", "html")).drop("html")


# Whole reports, made from customers: every field is known beforehand from the customer's number k, and some reports leave it out.

SERVICES, CITIES, SEXES = ("Harbour City Police", "North Vale Police Service", "Ontario Provincial Police"), ("Ashford", "Port Elm", "Grand Lake", "Stony Creek"), ("man", "woman", "boy", "youth")
INJURIES, ACTS = ("fractured left wrist", "broken right arm", "lacerated lower leg"), ("Criminal Code", "Mental Health Act", "Highway Traffic Act")
#: Pages that are made and read in one task: a small table of keys has few splits, its pages are long work.
REPORTS_A_TASK = 2000
CLOSINGS = ("there are no reasonable grounds to proceed", "the driver was charged with assault", "the file remains with the office")


def _pick(values: tuple[str, ...], by: Column) -> Column:
    return F.get(F.array(*(F.lit(v) for v in values)), by.cast("int"))


def _pick_sql(values: tuple[str, ...], by: str) -> str:
    return "['" + "','".join(v.replace("'", "''") for v in values) + f"'][{by} + 1]"


def report_html(k: Column) -> Column:
    """A report page about case ``k``."""
    day = F.date_add(F.lit("1995-01-01").cast("date"), (k % 2000).cast("int"))
    said = lambda d: F.date_format(d, "MMMM d, yyyy")
    tagged = lambda tag, n: F.array_join(F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: F.concat(F.lit(f"<p>{tag} #"), i.cast("string"), F.lit(" Interviewed</p>"))), "")
    part = lambda met, *body: F.when(met, F.concat(*(F.lit(b) if isinstance(b, str) else b.cast("string") for b in body))).otherwise("")
    always = F.lit(True)
    return F.concat(
        F.lit("<html><head><style>p { color: red }</style><script>var Director = 'SO #9';</script></head><body><h2>The Investigation</h2>"),
        part(always, "<p>On ", said(F.date_add(day, 1)), ", the ", _pick(SERVICES, k % 3), " notified the SIU of an injury in the City of ", _pick(CITIES, k % 4), ".</p>"),
        part(always, "<h3>The Team</h3><p>Number of SIU Investigators assigned: ", k % 5 + 1, "</p>"),
        part(k % 4 != 3, "<p>Number of SIU Forensic Investigators assigned:&nbsp;", k % 3, "</p>"),
        part(k % 3 != 0, "<h3>Civilian Witnesses</h3>", tagged("CW", k % 3)),
        part(always, "<h3>Subject Officials</h3>", tagged("SO", k % 2 + 1)),
        part(k % 5 != 0, "<h3>Witness Officials</h3>", tagged("WO", k % 5)),
        part(k % 5 == 0, "<h3>Witness Officials</h3><p>No police officers witnessed the event.</p>"),
        part(always, "<h3>Incident Narrative</h3><p>The evidence of what took place is clear, and it can be told in a few words as set out here.</p><p>On ", said(day), ", at noon, a ", k % 60 + 18, "-year-old ", _pick(SEXES, k % 4), " fell from a wall."),
        part(k % 6 != 5, " Doctors found a ", _pick(INJURIES, k % 3)),
        part(always, "</p><h3>Evidence</h3><p>None.</p>"),
        part(k % 7 != 0, "<h3>Relevant Legislation</h3><p>Section 25(1), ", _pick(ACTS, k % 3), " - Protection</p><p>Section 88, ", _pick(ACTS, (k + 1) % 3), "</p><p>Section 90, ", _pick(ACTS, k % 3), "</p>"),
        part(always, "<h3>Analysis and Director&rsquo;s Decision</h3><p>On this evidence ", _pick(CLOSINGS, k % 3), ".</p><p>Date: ", F.when(k % 2 == 0, said(F.date_add(day, 90))).otherwise(F.date_format(F.date_add(day, 90), "yyyy-MM-dd")), "</p>"),
        part(k % 8 != 7, "<p>Jane O'Brien-Quill<br/>Director<br/>Special Investigations Unit</p>"),
        F.lit("<h3>Endnotes</h3><p>none</p></body></html>"),
    )


@query(f"""SELECT c_custkey, 'en' AS _language, {_pick_sql(SERVICES, "k % 3")} AS police_service, strftime(day, '%Y-%m-%d') AS date_of_incident_iso, strftime(day + 1, '%Y-%m-%d') AS date_siu_notified_iso, strftime(day + 90, '%Y-%m-%d') AS date_of_director_decision_iso,
  CAST(k % 5 + 1 AS VARCHAR) AS siu_investigators, CASE WHEN k % 4 <> 3 THEN CAST(k % 3 AS VARCHAR) ELSE '' END AS siu_forensics_investigators, CAST(k % 2 + 1 AS VARCHAR) AS number_of_subject_officers, CAST(k % 5 AS VARCHAR) AS number_of_witness_officials,
  CASE WHEN k % 3 = 0 THEN '' ELSE CAST(k % 3 AS VARCHAR) END AS number_of_civilian_witnesses, CAST(k % 60 + 18 AS VARCHAR) AS age_affected, {_pick_sql(SEXES, "k % 4")} AS sex_gender_affected, ['FALSE', 'TRUE', ''][k % 3 + 1] AS charges_recommended,
  CASE WHEN k % 8 <> 7 THEN 'Jane O''Brien-Quill' ELSE '' END AS directors_name, 'City of ' || {_pick_sql(CITIES, "k % 4")} AS location_of_call, CASE WHEN k % 6 <> 5 THEN {_pick_sql(INJURIES, "k % 3")} ELSE '' END AS specific_injuries,
  CASE WHEN k % 7 <> 0 THEN {_pick_sql(ACTS, "k % 3")} || '; ' || {_pick_sql(ACTS, "(k + 1) % 3")} ELSE '' END AS relevant_legislation FROM (SELECT c_custkey, c_custkey AS k, DATE '1995-01-01' + CAST(c_custkey % 2000 AS INTEGER) AS day FROM customer)""")
def report_corpus(spark, d):
    """All fields of whole pages, each against what the page was made from."""
    keys = shared.spread(t(spark, d, "customer").select("c_custkey"), REPORTS_A_TASK)
    pages = keys.select("c_custkey", report_html(F.col("c_custkey")).alias("html"))
    return reports.parse_reports(pages).drop("html")


REASONS = (
    "section: max(ordinal 2, entries 1)", "singular present: 'the SO'x1 'the subject official'x0", "zero: witness-officer-only / 'not a subject official'", "UNRESOLVED: 'the SO'x0 'the subj off'x0",
    "plural cue 'the three subject officials'", "max ordinal SO #4", "zero: witness-officer-only / 'not a subject official'",
)


@query(f"SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 0 WHEN 3 THEN NULL WHEN 4 THEN 3 WHEN 5 THEN 4 ELSE 0 END AS subject_officials, {_pick_sql(REASONS, 'o_orderkey % 7')} AS reason FROM orders")
def subject_count_reasons(spark, d):
    """Every rule with its reason, behind hard blanks, a privacy notice and a glossary line that must not count."""
    blank, notice = "\u00a0", "This information may include the subject officer and SO #7 and evidence. "
    cases = (
        f"Subject{blank}Officials\nSO #1 Interviewed, SO #2 left\n\nWitness Officials\nSO #6\n", f"{notice}The{blank}SO sat down.", "There was no subject official here.", "Rain fell.",
        "By then the three subject officials had gone.", "SO #1 saw SO #4.", "An officer who, in the opinion of the SIU Director, had a part is not a subject official. The force did not designate a subject official.",
    )
    found = reports.subject_officials(_pick(cases, F.col("o_orderkey") % 7))
    return t(spark, d, "orders").select("o_orderkey", found["count"].alias("subject_officials"), found["reason"].alias("reason"))


# Quality.


@query("SELECT 'missing_columns' AS issue, 'fatal' AS severity, 'Missing required columns: l_color' AS message UNION ALL SELECT 'row_count_high', 'warning', 'Row count ' || count(*) || ' above expected maximum 10' FROM lineitem UNION ALL SELECT 'unexpected_l_returnflag', 'warning', 'Column ''l_returnflag'' has unexpected values: ' || array_to_string(list_sort(list(DISTINCT l_returnflag)), ', ') FROM lineitem WHERE l_returnflag NOT IN ('A', 'N')")
def validate_schema(spark, d):
    e = quality.Expected(("l_orderkey", "l_color"), {"l_returnflag": ["A", "N"], "l_linestatus": ["O", "F"], "l_ghost": [1]}, 1, 10)
    return quality.validate_schema(t(spark, d, "lineitem"), e)


_CHECK_SQL = "SELECT n_name AS name, CAST(n_nationkey AS DOUBLE) AS observed, n_nationkey + CASE n_nationkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 0.00005 ELSE 1.5 END AS expected, n_nationkey % 7 = 0 AS synthetic FROM nation"


def _checks(spark, d) -> DataFrame:
    k = F.col("n_nationkey")
    return t(spark, d, "nation").select(
        F.col("n_name").alias("name"), k.cast("double").alias("observed"), (k + F.when(k % 3 == 0, 0.0).when(k % 3 == 1, 0.00005).otherwise(1.5)).alias("expected"), F.lit(quality.TOLERANCE).alias("tol"), (k % 7 == 0).alias("synthetic")
    )


@query(f"SELECT name, round(abs(observed - expected), 6) AS diff, CASE WHEN synthetic THEN 'INFO' WHEN abs(observed - expected) <= 0.0001 THEN 'PASS' ELSE 'DIFFER' END AS status FROM ({_CHECK_SQL})")
def record_status(spark, d):
    return quality.record(_checks(spark, d)).select("name", _r(F.col("diff")).alias("diff"), "status")


@query(f"SELECT count(*) AS total, count(*) FILTER (WHERE s = 'PASS') AS pass, count(*) FILTER (WHERE s = 'DIFFER') AS differ, 0 AS warn, count(*) FILTER (WHERE s = 'INFO') AS info FROM (SELECT CASE WHEN synthetic THEN 'INFO' WHEN abs(observed - expected) <= 0.0001 THEN 'PASS' ELSE 'DIFFER' END AS s FROM ({_CHECK_SQL}))")
def status_histogram(spark, d):
    return quality.summarise(quality.record(_checks(spark, d)))


@query(f"SELECT name, 'PASS' AS status, 'DIFFER' AS recomputed FROM ({_CHECK_SQL}) WHERE NOT synthetic AND abs(observed - expected) > 0.0001")
def manifest_recheck(spark, d):
    stored = quality.record(_checks(spark, d)).withColumn("status", F.when(F.col("status") == "DIFFER", "PASS").otherwise(F.col("status")))
    return quality.stale(stored)


@query("SELECT coalesce(a.k, b.k) AS k, a.value AS observed, b.value AS expected, abs(a.value - b.value) AS diff, coalesce(abs(a.value - b.value) <= 2, false) AS ok FROM (SELECT s_nationkey AS k, count(*) AS value FROM supplier GROUP BY 1) a FULL JOIN (SELECT c_nationkey AS k, count(*) // 10 AS value FROM customer GROUP BY 1) b ON a.k = b.k")
def tolerance_join(spark, d):
    a = t(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("value"))
    b = t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.floor(F.count("*") / 10).cast("long").alias("value"))
    return quality.within_tolerance(a, b, "k", 2)


@query("""SELECT 'except' AS kind, k FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_nationkey < 12) UNION ALL SELECT 'intersect', k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_nationkey < 12)
  UNION ALL SELECT 'union', k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey + 100 FROM supplier) UNION ALL SELECT 'bind', k FROM (SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region)""")
def set_operations(spark, d):
    c = t(spark, d, "customer").select(F.col("c_nationkey").alias("k"))
    s = t(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    few, far = s.filter("k < 12"), s.select((F.col("k") + 100).alias("k"))
    parts = {"except": c.distinct().exceptAll(few.distinct()), "intersect": c.intersect(few), "union": c.union(far).distinct(), "bind": t(spark, d, "nation").select(F.col("n_nationkey").alias("k")).unionByName(t(spark, d, "region").select(F.col("r_regionkey").alias("k")))}
    out = None
    for name, p in parts.items():
        p = p.select(F.lit(name).alias("kind"), "k")
        out = p if out is None else out.unionByName(p)
    return out


@query("""SELECT level, CAST(i AS INTEGER) AS index, count(o_orderkey) AS rows, CAST(CASE level WHEN '5-LOW' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '1-URGENT' THEN 3 END AS INTEGER) AS kept FROM (SELECT unnest(['5-LOW', 'none', '2-HIGH', '1-URGENT']) AS level, unnest(range(1, 5)) AS i)
  LEFT JOIN orders ON o_orderpriority = level GROUP BY level, i""")
def ordered_levels(spark, d):
    """Orders by priority in an order of our own, and the indices that are left when the unused level goes."""
    o = categories.with_levels(t(spark, d, "orders"), "o_orderpriority", ["5-LOW", "none", "2-HIGH", "1-URGENT"])
    fewer = categories.drop_unused(o, "o_orderpriority")
    kept = fewer.filter("o_orderpriority is not null").select(F.col("o_orderpriority").alias("level"), categories.level_index(fewer, "o_orderpriority").alias("kept")).distinct()
    return categories.counts(o, "o_orderpriority").join(kept, "level", "left")


@query("SELECT l_orderkey AS \"order\", CAST(l_quantity AS INTEGER) AS number, l_returnflag AS flag FROM lineitem")
def renamed_columns(spark, d):
    return panel.selected(t(spark, d, "lineitem"), {"order": "l_orderkey", "number": "l_quantity", "flag": "l_returnflag"}, {"number": "int"})


@query("SELECT * FROM (SELECT CAST(NULL AS VARCHAR) AS \"column\", CAST(NULL AS VARCHAR) AS value, count(*) AS rows FROM lineitem UNION ALL SELECT 'l_returnflag', l_returnflag, count(*) FROM lineitem WHERE l_returnflag NOT IN ('A', 'N') GROUP BY l_returnflag UNION ALL SELECT 'l_quantity', CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), count(*) FROM lineitem WHERE l_quantity > 40 GROUP BY l_quantity)")
def schema_facts(spark, d):
    """Row count and every value outside its set, counted in one scan."""
    lines = t(spark, d, "lineitem").withColumn("l_quantity", F.col("l_quantity").cast("int"))
    return quality.schema_facts(lines, quality.Expected((), {"l_returnflag": ["A", "N"], "l_quantity": list(range(41))}))


@query(f"SELECT name, CASE WHEN observed % 5 = 0 THEN 'INFO' WHEN observed % 4 = 1 THEN 'WARN' WHEN observed % 4 = 2 THEN 'INFO' WHEN abs(observed - expected) <= 0.0001 THEN 'PASS' ELSE 'DIFFER' END AS status FROM ({_CHECK_SQL})")
def forced_status(spark, d):
    """Statuses that are given, of values that are not finite or missing, and by difference."""
    c = _checks(spark, d).withColumn("synthetic", F.lit(False))
    odd = F.when(F.col("observed") % 4 == 1, float("inf")).when(F.col("observed") % 4 == 2, None).otherwise(F.col("observed"))
    c = c.withColumn("force_status", F.when(F.col("observed") % 5 == 0, "INFO")).withColumn("expected", F.when(F.col("observed") % 4 == 1, float("inf")).otherwise(F.col("expected"))).withColumn("observed", odd)
    return quality.record(c, warn_not_finite=True).select("name", "status")


# Events.


def _timed(spark, d) -> DataFrame:
    return t(spark, d, "events").select("event_id", "user_id", "value", (F.timestamp_diff("MICROSECOND", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("ts")) / 86_400e6).alias("t"))


DAYS_SQL = "SELECT event_id, user_id, value, date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 86400000000.0 AS t FROM events"
HORIZON = 400.0


@query(f"SELECT user_id, count(*) AS pairs, round(sum(a.t - b.t), 3) AS lag FROM ({DAYS_SQL}) a JOIN ({DAYS_SQL}) b USING (user_id) WHERE b.t < a.t GROUP BY user_id")
def prior_pairs(spark, d):
    return events.prior_pairs(_timed(spark, d), "user_id", "t", "event_id").groupBy("user_id").agg(F.count("*").alias("pairs"), _r(F.sum("lag"), 3).alias("lag"))


@query(f"SELECT user_id, a.event_id AS event, b.event_id AS earlier FROM ({DAYS_SQL}) a JOIN ({DAYS_SQL}) b USING (user_id) WHERE b.t < a.t AND a.t - b.t <= 0.5")
def banded_pairs(spark, d):
    return events.banded_pairs(_timed(spark, d), "user_id", "t", "event_id", 0.5).select("user_id", "event", "earlier")


@query(f"SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 2.0 PRECEDING AND CURRENT ROW), 5) AS trailing FROM ({DAYS_SQL})")
def trailing_sum(spark, d):
    return events.trailing_sum(_timed(spark, d), "user_id", "t", "value", 2.0).select("event_id", _r(F.col("trailing"), 5).alias("trailing"))


@query(f"""WITH e AS ({DAYS_SQL}), p AS (SELECT a.user_id, a.event_id, sum(0.9 * exp(-0.9 * (a.t - b.t))) AS s FROM e a JOIN e b ON a.user_id = b.user_id AND b.t < a.t GROUP BY ALL)
  SELECT user_id, round(exp(-0.5) * {HORIZON} + sum(0.4 * (1 - exp(-0.9 * ({HORIZON} - t)))) - sum(ln(exp(-0.5) + 0.4 * coalesce(s, 0))), 4) AS nll FROM e LEFT JOIN p USING (user_id, event_id) GROUP BY user_id""")
def hawkes_exponential(spark, d):
    return events.sequences(_timed(spark, d), "user_id", "t").select("user_id", _r(events.exponential_nll(F.col("times"), HORIZON, -0.5, 0.4, 0.9), 4).alias("nll"))


@query(f"""WITH e AS ({DAYS_SQL}), p AS (SELECT a.user_id, a.event_id, sum(1.5 / 2.0 * power((a.t - b.t) / 2.0, 0.5) * exp(-power((a.t - b.t) / 2.0, 1.5))) AS s FROM e a JOIN e b ON a.user_id = b.user_id AND b.t < a.t AND power((a.t - b.t) / 2.0, 1.5) < 700 GROUP BY ALL)
  SELECT user_id, round(exp(-0.5) * {HORIZON} + sum(0.4 * (1 - exp(-power(({HORIZON} - t) / 2.0, 1.5)))) - sum(ln(exp(-0.5) + 0.4 * coalesce(s, 0))), 4) AS nll FROM e LEFT JOIN p USING (user_id, event_id) GROUP BY user_id""")
def hawkes_weibull_by_join(spark, d):
    return events.weibull_nll_by_join(_timed(spark, d), "user_id", "t", "event_id", HORIZON, -0.5, 0.4, 1.5, 2.0).select("user_id", _r(F.col("nll"), 4).alias("nll"))


@query(f"""WITH e AS ({DAYS_SQL}), p AS (SELECT a.user_id, a.event_id, sum(2 / 0.1 * ((a.t - b.t) / 0.1) * exp(-power((a.t - b.t) / 0.1, 2))) AS s FROM e a JOIN e b ON a.user_id = b.user_id AND b.t < a.t AND a.t - b.t <= 0.1 * sqrt(700) GROUP BY ALL)
  SELECT user_id, round(exp(-0.5) * {HORIZON} + sum(0.4 * (1 - exp(-power(({HORIZON} - t) / 0.1, 2)))) - sum(ln(exp(-0.5) + 0.4 * coalesce(s, 0))), 4) AS nll FROM e LEFT JOIN p USING (user_id, event_id) GROUP BY user_id""")
def hawkes_weibull_window(spark, d):
    """A kernel that is 0 beyond 2.6 days: the band holds a small part of all pairs."""
    return events.weibull_nll_by_join(_timed(spark, d), "user_id", "t", "event_id", HORIZON, -0.5, 0.4, 2.0, 0.1).select("user_id", _r(F.col("nll"), 4).alias("nll"))


CONSTANT_SQL = ("exp(-0.5)", f"exp(-0.5) * {HORIZON}")
_WAVE_SQL = f"exp(-0.5 + 0.1 * {{0}} / {HORIZON} + 0.2 * sin(2 * pi() / 365.25 * {{0}}) + 0.1 * cos(2 * pi() / 365.25 * {{0}}))"
WAVE_SQL = (_WAVE_SQL.format("t"), f"(SELECT (sum(v) - (first(v ORDER BY k) + last(v ORDER BY k)) / 2) * {HORIZON} / 2000 FROM (SELECT k, {_WAVE_SQL.format(f'(k * {HORIZON} / 2000)')} AS v FROM range(2001) r(k)))")
_SHARE = (0.3 + 0.1j) / (0.8 + 0.5j)
#: Density of a lag u and its integral up to v, with the rate they go with.
KERNELS_SQL = {
    "weibull": ("0.75 * power(u / 2, 0.5) * exp(-power(u / 2, 1.5))", "1 - exp(-power(v / 2, 1.5))", CONSTANT_SQL),
    "lomax": ("1.5 * power(u + 1, -2.5)", "1 - power(v + 1, -1.5)", CONSTANT_SQL),
    "gamma": ("u * exp(-u)", "1 - (1 + v) * exp(-v)", CONSTANT_SQL),
    "exponential_wave": ("0.9 * exp(-0.9 * u)", "1 - exp(-0.9 * v)", WAVE_SQL),
    "weibull_wave": ("0.75 * power(u / 2, 0.5) * exp(-power(u / 2, 1.5))", "1 - exp(-power(v / 2, 1.5))", WAVE_SQL),
    "lomax_wave": ("1.5 * power(u + 1, -2.5)", "1 - power(v + 1, -1.5)", WAVE_SQL),
    "poles": ("2 * exp(-0.8 * u) * (0.3 * cos(0.5 * u) + 0.1 * sin(0.5 * u))", f"2 * ({_SHARE.real} - exp(-0.8 * v) * ({_SHARE.real} * cos(0.5 * v) + ({_SHARE.imag}) * sin(0.5 * v)))", CONSTANT_SQL),
    "split_gamma": ("CASE WHEN u <= 3 THEN u * exp(-u) ELSE 0.1 * exp(-0.9 * (u - 3)) END", "CASE WHEN v <= 3 THEN 1 - (1 + v) * exp(-v) ELSE 1 - 4 * exp(-3) + 0.1 / 0.9 * (1 - exp(-0.9 * (v - 3))) END", CONSTANT_SQL),
    "own": ("CASE WHEN u < 1 THEN 2 * (1 - u) ELSE 0 END", "least(v, 1) * (2 - least(v, 1))", CONSTANT_SQL),
    "exponential_sum": ("0.5 * exp(-0.9 * u) + 0.2 * exp(-0.2 * u)", "0.5 / 0.9 * (1 - exp(-0.9 * v)) + (1 - exp(-0.2 * v))", ("0.6", f"0.6 * {HORIZON}")),
}


def _hawkes_sql(*names: str) -> str:
    """Likelihoods from all pairs of a user's events, one column a kernel; a single one is called nll."""
    kernels = {(n if len(names) > 1 else "nll"): KERNELS_SQL[n] for n in names}
    sums = ", ".join(f"sum({g}) AS s_{n}" for n, (g, _, _) in kernels.items())
    out = ", ".join(f"round({whole} + sum(0.4 * ({big})) - sum(ln({rate} + 0.4 * coalesce(s_{n}, 0))), 4) AS {n}" for n, (_, big, (rate, whole)) in kernels.items())
    pairs = "SELECT user_id, a.event_id, a.t - b.t AS u FROM e a JOIN e b USING (user_id) WHERE b.t < a.t"
    return f"WITH e AS ({DAYS_SQL}), p AS (SELECT user_id, event_id, {sums} FROM ({pairs}) GROUP BY ALL) SELECT user_id, {out} FROM (SELECT *, {HORIZON} - t AS v FROM e) LEFT JOIN p USING (user_id, event_id) GROUP BY user_id"


def _sequences(spark, d) -> DataFrame:
    return events.sequences(_timed(spark, d), "user_id", "t")


@query(_hawkes_sql("exponential_sum"))
def hawkes_exponential_sum(spark, d):
    return _sequences(spark, d).select("user_id", _r(events.exponentials_nll(F.col("times"), HORIZON, 0.6, 0.4, [0.5, 0.2], [0.9, 0.2]), 4).alias("nll"))


@query(ORACLE_SQL["hawkes_exponential"])
def hawkes_exponential_blocks(spark, d):
    """As hawkes_exponential, from blocks of at most about two thousand events of any users."""
    return events.exponential_nll_by_blocks(_timed(spark, d), "user_id", "t", HORIZON, -0.5, 0.4, 0.9, 2000).select("user_id", _r(F.col("nll"), 4).alias("nll"))


@query(_hawkes_sql("exponential_sum"))
def hawkes_exponential_sum_blocks(spark, d):
    return events.exponentials_nll_by_blocks(_timed(spark, d), "user_id", "t", HORIZON, 0.6, 0.4, [0.5, 0.2], [0.9, 0.2], 2000).select("user_id", _r(F.col("nll"), 4).alias("nll"))


@query(_hawkes_sql("exponential_wave"))
def hawkes_exponential_wave(spark, d):
    return _sequences(spark, d).select("user_id", _r(events.exponential_wave_nll(F.col("times"), HORIZON, -0.5, 0.1, 0.2, 0.1, 0.4, 0.9), 4).alias("nll"))


@query(_hawkes_sql("poles"))
def hawkes_poles(spark, d):
    return _sequences(spark, d).select("user_id", _r(events.poles_nll(F.col("times"), HORIZON, math.exp(-0.5), 0.4, [0.3 + 0.1j, 0.3 - 0.1j], [0.8 + 0.5j, 0.8 - 0.5j]), 4).alias("nll"))


@query(_hawkes_sql("split_gamma"))
def hawkes_split_gamma(spark, d):
    return _sequences(spark, d).select("user_id", _r(events.split_gamma_nll(F.col("times"), HORIZON, -0.5, 0.4, 2.0, 1.0, 3.0, [0.1], [0.9]), 4).alias("nll"))


@query(_hawkes_sql("weibull", "lomax", "gamma", "exponential_wave", "weibull_wave", "lomax_wave", "poles", "split_gamma", "own"))
def hawkes_kernels(spark, d):
    base, wave = events.constant(-0.5), events.sinusoidal(-0.5, 0.1, 0.2, 0.1)
    own = events.custom(lambda u: np.where(u < 1, 2 * (1 - u), 0.0), lambda v: np.minimum(v, 1) * (2 - np.minimum(v, 1)), 1.0)
    kernels = {
        "weibull": (base, events.weibull(1.5, 2.0)), "lomax": (base, events.lomax(2.5, 1.0)), "gamma": (base, events.gamma(2.0, 1.0)), "exponential_wave": (wave, events.exponential(0.9)),
        "weibull_wave": (wave, events.weibull(1.5, 2.0)), "lomax_wave": (wave, events.lomax(2.5, 1.0)), "poles": (base, events.poles([0.3 + 0.1j, 0.3 - 0.1j], [0.8 + 0.5j, 0.8 - 0.5j])),
        "split_gamma": (base, events.split_gamma(2.0, 1.0, 3.0, [0.1], [0.9])), "own": (base, own),
    }
    return _sequences(spark, d).select("user_id", *(_r(events.nll(F.col("times"), HORIZON, b, 0.4, k), 4).alias(n) for n, (b, k) in kernels.items()))


# Synthetic tables, matching, effects, citations.

RECIPE = {
    "columns": {
        "year": {"type": "sample", "values": [2023, 2024, 2025], "weights": [1, 2, 1]},
        "id": {"type": "id_pattern", "pattern": "{year}-{seq:05d}", "year_col": "year"},
        "alert": {"type": "bernoulli", "p": 0.1, "p_with_baserate": 0.2},
        "watch": {"type": "bernoulli", "p": 0.05, "p_with_baserate": 0.2},
        "placements": {"type": "poisson", "lambda": 2, "min": 1},
        "row": {"type": "sequence", "from": 1},
    },
    "row_replication": {"values": [1, 2, 3], "weights": [5, 3, 1]},
}


_PERSONS_SQL = f"SELECT *, CASE WHEN treat = 1 THEN vm END AS v1, CASE WHEN treat = 0 THEN vm END AS v0, CASE WHEN treat = 1 THEN np END AS n1, CASE WHEN treat = 0 THEN np END AS n0 FROM ({PANEL_SQL})"
_FACTS_SQL = {
    "structural": {"person_year_n": "count(*)", "total_placements_sum": "sum(np)"},
    "descriptive_full": {
        "vm_full_unweighted_mean": "avg(vm)", "vm_full_unweighted_sd": "stddev_samp(vm)", "vm_full_unweighted_max": "max(vm)", "vm_full_np_weighted_mean": "sum(vm * np) / sum(np)",
        "vm_full_np_weighted_sd": "sqrt((sum(np * vm * vm) - power(sum(np * vm), 2) / sum(np)) / (sum(np) - 1))", "D1_proportion_full": "avg(treat)",
    },
    "bivariate_full": {"vm_full_unweighted_D1_mean": "avg(v1)", "vm_full_unweighted_D0_mean": "avg(v0)", "vm_full_npweighted_D1_mean": "sum(v1 * n1) / sum(n1)", "vm_full_npweighted_D0_mean": "sum(v0 * n0) / sum(n0)"},
    "matched": {k: f"{n} * least(sum(treat), sum(1 - treat))" for k, n in (("matched_sample_n", 2), ("matched_D1_count", 1), ("matched_D0_count", 1))},
}


@query(" UNION ALL ".join(f"SELECT '{g}' AS grp, '{n}' AS name, round(CAST({x} AS DOUBLE), 6) AS observed, CASE WHEN '{n}' = 'person_year_n' THEN 'PASS' WHEN '{n}' = 'D1_proportion_full' THEN 'DIFFER' ELSE 'INFO' END AS status FROM ({_PERSONS_SQL})" for g, f in _FACTS_SQL.items() for n, x in f.items()))
def capsule_facts(spark, d):
    """What a capsule's run records of the panel and the sizes of its matched sample; two of the facts have references."""
    p = _persons(spark, d)
    matched = causal.nearest_match(p, "treat", ["age", "gender"], ["subject", "period"])
    facts = shared.kept(capsule.facts_of(p, matched).filter(F.col("grp").isin(*_FACTS_SQL)), "facts")
    n = facts.filter("name = 'person_year_n'").first()["observed"]
    return capsule.checked(facts, {"person_year_n": (n, 0), "D1_proportion_full": (2.0, 0.01)}).select("grp", "name", _r(F.col("observed")).alias("observed"), "status")


def _unit_sql(*keys: str) -> str:
    return f"CAST(CAST('0x' || left(md5({' || chr(58) || '.join(keys)}), 13) AS BIGINT) AS DOUBLE) / 4503599627370496"


def _poisson_sql(u: str, rate: float) -> str:
    return f"len(list_filter({synthetic.poisson_steps(rate)}, lambda s: {u} >= s))"


_ROW_UNIT = lambda name: _unit_sql("r", "42", f"'{name}'")


@query(f"""WITH b AS (SELECT o_orderkey AS r FROM orders), u AS (SELECT r, CASE WHEN {_ROW_UNIT("year")} < 0.25 THEN 2023 WHEN {_ROW_UNIT("year")} < 0.75 THEN 2024 ELSE 2025 END AS year,
  CASE WHEN {_ROW_UNIT("alert")} < 0.1 + 0.2 * {_ROW_UNIT("_baserate")} THEN 'Yes' ELSE 'No' END AS alert, CASE WHEN {_ROW_UNIT("watch")} < 0.05 + 0.2 * {_ROW_UNIT("_baserate")} THEN 'Yes' ELSE 'No' END AS watch,
  greatest({_poisson_sql(_ROW_UNIT("placements"), 2.0)}, 1) AS placements, CASE WHEN {_ROW_UNIT("_copies")} < 5.0 / 9 THEN 1 WHEN {_ROW_UNIT("_copies")} < 8.0 / 9 THEN 2 ELSE 3 END AS copies FROM b)
  SELECT CAST(year AS INTEGER) AS year, printf('%d-%05d', year, row_number() OVER (PARTITION BY year ORDER BY r, copy)) AS id, alert, watch, CAST(placements AS INTEGER) AS placements, r + 1 AS row FROM (SELECT *, unnest(range(copies)) AS copy FROM u)""")
def synthetic_table(spark, d):
    """A made row, once or more, for each order."""
    return synthetic.make_table(spark, RECIPE, rows=t(spark, d, "orders").select("o_orderkey"), seed=42)


@query("""WITH x AS (SELECT c_nationkey AS cell, sum(CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END) AS a, sum(CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 1 END) AS b FROM customer GROUP BY 1)
  SELECT cell, CAST(least(a, b) AS BIGINT) AS pairs FROM x WHERE least(a, b) > 0""")
def match_pairs(spark, d):
    c = t(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("cell"), (F.col("c_custkey") % 3 == 0).cast("int").alias("treat"))
    return causal.match_within_cells(c, "treat", ["cell"], ["c_custkey"]).groupBy("cell").agg(F.countDistinct("pair").alias("pairs"))


@query()
def nearest_match(spark, d):
    p = _persons(spark, d)
    p = p.withColumn("treat", (F.pmod(F.xxhash64("subject", "period"), F.lit(3)) == 0).cast("int"))
    return causal.nearest_match(p, "treat", ["age", "gender", "period"], ["subject", "period"])


@query()
def effect_estimates(spark, d):
    s = panel_source(spark, d).select("subject", F.col("sr").cast("int").alias("y"), F.col("mh").cast("int").alias("treat"), "gender", "age", "place_now", "place_last", "period", "n")
    s = s.withColumn("treat", F.when(F.pmod(F.xxhash64("subject", "n", "period"), F.lit(3)) == 0, 1).otherwise(0))
    return causal.effects_table(s, "treat", "y", ["gender", "age", "place_now", "place_last"], "subject", "period", F.col("n"))


def _newton_sql(rows: str, folds: str, used: str) -> str:
    """Coefficients b0 and b1 of a logistic fit of t on x, for each fold f, after twelve Newton steps."""
    return f"""n AS (SELECT 0 AS k, f, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1 FROM ({folds}) UNION ALL
  SELECT k + 1, f, b0 + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b1 + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) FROM (
  SELECT k, f, b0, b1, sum(t - m) AS g0, sum((t - m) * x) AS g1, sum(m * (1 - m)) AS h00, sum(m * (1 - m) * x) AS h01, sum(m * (1 - m) * x * x) AS h11
  FROM (SELECT k, f, b0, b1, x, t, 1 / (1 + exp(-(b0 + b1 * x))) AS m FROM n JOIN {rows} ON {used} WHERE k < 12) GROUP BY k, f, b0, b1))"""


@query(f"""WITH RECURSIVE a AS (SELECT c_custkey, CASE WHEN c_acctbal + (c_custkey * 7919) % 4001 > 6000 THEN 1 ELSE 0 END AS t, CAST(c_acctbal AS DOUBLE) / 1000 AS x FROM customer),
  {_newton_sql("a", "SELECT 0 AS f", "true")} SELECT c_custkey, round(1 / (1 + exp(-(b0 + b1 * x))), 6) AS score FROM a, n WHERE k = 12""")
def propensity_scores(spark, d):
    return models.propensity(_balances(spark, d), "treat", ["balance"]).select("c_custkey", _r(F.col("score")).alias("score"))


def _balances(spark, d) -> DataFrame:
    treat = (F.col("c_acctbal") + F.col("c_custkey") * 7919 % 4001 > 6000).cast("int")
    return t(spark, d, "customer").select("c_custkey", treat.alias("treat"), (F.col("c_acctbal").cast("double") / 1000).alias("balance"), "c_mktsegment")


@query("""WITH RECURSIVE a AS (SELECT c_custkey AS id, CAST(c_acctbal AS DOUBLE) AS s, c_custkey % 3 = 0 AS d FROM customer), o AS (SELECT *, row_number() OVER (ORDER BY s DESC, d DESC, id) AS p FROM a), u AS (SELECT *, row_number() OVER (ORDER BY p) AS k FROM o WHERE d),
  m AS (SELECT CAST(0 AS BIGINT) AS k, list({'s': s, 'p': p, 'id': id}) AS spare, CAST(NULL AS BIGINT) AS treated, CAST(NULL AS BIGINT) AS control FROM o WHERE NOT d UNION ALL
  SELECT k, list_filter(spare, lambda x: x.id <> best.id), id, best.id FROM (SELECT u.k, u.id, spare, list_sort(list_transform(spare, lambda x: {'far': abs(x.s - u.s), 'above': x.s > u.s, 'places': abs(x.p - u.p), 'id': x.id}))[1] AS best FROM m JOIN u ON u.k = m.k + 1 WHERE len(spare) > 0))
  SELECT treated, control FROM m WHERE k > 0""")
def matched_on_score(spark, d):
    """Every third customer and the customer with the nearest balance that is left; ranges of a few hundred rows."""
    c = t(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 3 == 0).cast("int").alias("treat"), F.col("c_acctbal").cast("double").alias("balance"))
    pairs = matching.nearest_by_score(c, "treat", "balance", ["c_custkey"], range_rows=400)
    return pairs.groupBy("pair").agg(F.max(F.when(F.col("treat") == 1, F.col("c_custkey"))).alias("treated"), F.max(F.when(F.col("treat") == 0, F.col("c_custkey"))).alias("control")).drop("pair")


@query()
def nearest_match_continuous(spark, d):
    """Customers matched on a score of their balance and segment."""
    return matching.nearest_match(_balances(spark, d), "treat", ["balance", "c_mktsegment"], ["c_custkey"]).select("c_custkey", "treat", "score", "pair")


@query(f"""WITH RECURSIVE a AS (SELECT l_orderkey % 3 AS fold, CASE WHEN l_quantity + (l_orderkey * 31) % 40 > 45 THEN 1 ELSE 0 END AS t, CAST(l_extendedprice AS DOUBLE) / 1000 AS y, CAST(l_quantity AS DOUBLE) / 10 AS x FROM lineitem),
  {_newton_sql("a", "SELECT unnest(range(3)) AS f", "a.fold <> n.f")},
  g AS (SELECT f, arm, regr_slope(y, x) AS slope, regr_intercept(y, x) AS level FROM a, (SELECT unnest(range(3)) AS f), (SELECT unnest(range(2)) AS arm) WHERE fold <> f AND t = arm GROUP BY f, arm),
  p AS (SELECT a.*, g0.level + g0.slope * x AS y0, g1.level + g1.slope * x AS y1, 1 / (1 + exp(-(b0 + b1 * x))) AS m FROM a JOIN n ON n.f = fold AND k = 12 JOIN g g0 ON g0.f = fold AND g0.arm = 0 JOIN g g1 ON g1.f = fold AND g1.arm = 1)
  SELECT round(avg(y1 - y0 + t * (y - y1) / m - (1 - t) * (y - y0) / (1 - m)), 6) AS ate, round(sum(t * (y - y0) - m * (1 - t) * (y - y0) / (1 - m)) / sum(t), 6) AS atte, count(*) AS n FROM p""")
def effect_of_rows(spark, d):
    """Price of a line by a made treatment that depends on its quantity, a number: all rows take part."""
    treat = (F.col("l_quantity") + F.col("l_orderkey") * 31 % 40 > 45).cast("int")
    rows = t(spark, d, "lineitem").select("l_orderkey", treat.alias("treat"), (F.col("l_extendedprice").cast("double") / 1000).alias("price"), (F.col("l_quantity").cast("double") / 10).alias("quantity"))
    e = models.double_ml(rows, "treat", "price", ["quantity"], "l_orderkey", fold=F.col("l_orderkey") % 3)
    return spark.createDataFrame([(round(e.ate, 6), round(e.atte, 6), int(e.n))], "ate double, atte double, n long")


@query()
def count_model(spark, d):
    """Orders of a customer, with a normal intercept for each region."""
    c = t(spark, d, "customer").join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    n = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("y"))
    rows = c.join(n, "c_custkey", "left").select(F.coalesce("y", F.lit(0)).alias("y"), F.pmod(F.xxhash64("c_custkey"), F.lit(3)).cast("int").alias("third"), "c_mktsegment", F.col("n_regionkey").alias("region"))
    model = causal.negative_binomial_mixed(rows.withColumn("treat", (F.col("third") == 0).cast("int")), "y", "treat", ["c_mktsegment"], "region")
    return spark.createDataFrame(model.table(), "term string, estimate double, std_error double, z_value double, p_value double, irr double")


@query("SELECT n_nationkey, n_name || ' (2026). Table of ' || r_name || ' [Data set].' || CASE WHEN n_nationkey % 2 = 0 THEN ' https://doi.org/10.1/' || n_nationkey ELSE ' https://x.org/' || n_nationkey END || ' Retrieved 2026-01-02. Licence: OGL.' AS text FROM nation JOIN region ON n_regionkey = r_regionkey")
def cite_template(spark, d):
    n = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("n_nationkey").cast("string")
    p = F.struct(
        F.lit("2026-01-02T03:04:05Z").alias("captured_at_utc"),
        F.struct(F.col("n_name").alias("publisher"), F.lit("t").alias("package_slug"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("10.1/"), k)).alias("doi"), F.lit("OGL").alias("licence_short")).alias("dataset"),
        F.struct(F.concat(F.lit("Table of "), "r_name").alias("name"), F.concat(F.lit("https://x.org/"), k).alias("direct_url")).alias("resource"),
    )
    return n.select("n_nationkey", files.citation(p)["text"].alias("text"))
