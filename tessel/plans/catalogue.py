"""Every query of the primitives by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.functions import arrays, calendar, classify, distance, elementwise, text
from tessel.operators import filters, order, reduce, search, series, sets
from tessel.session import capabilities
from tessel.sources.tables import fields_of, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def add(name: str, query: Query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = filters.in_range(table(spark, sf_dir, "events"), "ts", F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-20").cast("timestamp_ntz"))
    return kept.groupBy("event_type").agg(F.count("*").alias("n"), F.round(reduce.avg(F.col("value")), 6).alias("mean"), F.round(reduce.variance(F.col("value")), 4).alias("variance"), reduce.min_f64(F.col("value")).alias("lo"), reduce.max_f64(F.col("value")).alias("hi"))


add("flagship_time_range_stats", flagship, """
SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(var_pop(value), 4) AS variance, min(value) AS lo, max(value) AS hi
FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' GROUP BY event_type""")

# --- vector distances: every embedding against the one of the least identifier ---


def add_distance(name: str, f: Callable[[Column, Column], Column], made: Callable[[Column], Column], sql_made: str, sql: str) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "embeddings").select("vec_id", made(F.col("embedding")).alias("a"))
        probe = rows.agg(F.min_by("a", "vec_id").alias("b"))  # one row
        return rows.crossJoin(F.broadcast(probe)).select("vec_id", F.round(f(F.col("a"), F.col("b")), 6).alias("distance"))

    add(name, query, f"""
WITH r AS (SELECT vec_id, {sql_made} AS a FROM embeddings), p AS (SELECT arg_min(a, vec_id) AS b FROM r),
v AS (SELECT vec_id, a, b FROM r, p)
SELECT vec_id, round({sql}, 6)::DOUBLE AS distance FROM v""")


def over(expr: str) -> str:
    return f"list_sum(list_transform(range(1, len(a) + 1), lambda i: {expr}))"


AS_IS = (distance.doubles, "list_transform(embedding, lambda x: x::DOUBLE)")


def as_shares(e: Column) -> Column:
    return F.transform(distance.doubles(e), lambda x: F.abs(x) / F.aggregate(distance.doubles(e), F.lit(0.0), lambda s, y: s + F.abs(y)))


SHARES = (as_shares, "list_transform(embedding, lambda x: abs(x::DOUBLE) / list_sum(list_transform(embedding, lambda y: abs(y::DOUBLE))))")
UNITS = (lambda e: F.transform(e, lambda x: F.floor(F.abs(x.cast("double")) * 20).cast("int")), "list_transform(embedding, lambda x: floor(abs(x::DOUBLE) * 20)::INT)")

P, Q, M = "greatest(a[i], 1e-10::DOUBLE)", "greatest(b[i], 1e-10::DOUBLE)", "((greatest(a[i], 1e-10::DOUBLE) + greatest(b[i], 1e-10::DOUBLE)) / 2)"
add_distance("distance_l1_f32", distance.l1, *AS_IS, over("abs(a[i] - b[i])"))
add_distance("distance_l2_f32", distance.l2, *AS_IS, f"sqrt({over('(a[i] - b[i]) * (a[i] - b[i])')})")
add_distance("distance_dot_f32", distance.dot, *AS_IS, f"greatest(0::DOUBLE, 1 - {over('a[i] * b[i]')})")
add_distance("distance_cosine_f32", distance.cosine, *AS_IS, f"1 - {over('a[i] * b[i]')} / sqrt({over('a[i] * a[i]')} * {over('b[i] * b[i]')})")
add_distance("distance_hamming_u32", distance.hamming, *UNITS, over("CASE WHEN a[i] <> b[i] THEN 1 ELSE 0 END") + "::DOUBLE / len(a)")
add_distance("distance_hamming_u16", distance.hamming, lambda e: F.transform(e, lambda x: F.floor(F.abs(x.cast("double")) * 9).cast("smallint")), "list_transform(embedding, lambda x: floor(abs(x::DOUBLE) * 9)::INT)", over("CASE WHEN a[i] <> b[i] THEN 1 ELSE 0 END") + "::DOUBLE / len(a)")
add_distance("distance_hellinger_f32", distance.hellinger, *SHARES, f"sqrt({over('(sqrt(a[i]) - sqrt(b[i])) * (sqrt(a[i]) - sqrt(b[i]))')} / 2)")
add_distance("distance_jeffreys_f32", distance.jeffreys, *SHARES, over(f"({P} - {Q}) * (ln({P}) - ln({Q}))"))
add_distance("distance_jensen_shannon_f32", distance.jensen_shannon, *SHARES, "sqrt(greatest(0::DOUBLE, " + over(f"({P} * (ln({P}) - ln({M})) + {Q} * (ln({Q}) - ln({M}))) / 2") + "))")
add_distance("distance_jaccard_u16", distance.jaccard, *UNITS, f"1 - {over('least(a[i], b[i])')}::DOUBLE / {over('greatest(a[i], b[i])')}")
add_distance("distance_levenshtein_u16", distance.levenshtein, *UNITS, "levenshtein(array_to_string(list_transform(a, lambda x: chr(x + 48)), ''), array_to_string(list_transform(b, lambda x: chr(x + 48)), ''))")

# --- sets, deduplication: posting lists of lineitem by return flag ---


def postings(spark: SparkSession, sf_dir: str, column: str, flag: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == flag).select(F.col(column).alias("id"))


def posting_sql(column: str, flag: str) -> str:
    return f"SELECT {column} AS id FROM lineitem WHERE l_returnflag = '{flag}'"


add("intersect_sorted_u32", lambda s, d: sets.intersect(postings(s, d, "l_partkey", "R"), postings(s, d, "l_partkey", "A")), f"{posting_sql('l_partkey', 'R')} INTERSECT ALL {posting_sql('l_partkey', 'A')}")
add("intersect_sorted_u64", lambda s, d: sets.intersect(postings(s, d, "l_orderkey", "R"), postings(s, d, "l_orderkey", "A"), dedup=True), f"{posting_sql('l_orderkey', 'R')} INTERSECT {posting_sql('l_orderkey', 'A')}")
add("intersect_sorted_u32_limited", lambda s, d: sets.intersect(postings(s, d, "l_partkey", "R"), postings(s, d, "l_partkey", "A"), dedup=True, most=40, ascending=False), f"SELECT id FROM ({posting_sql('l_partkey', 'R')} INTERSECT {posting_sql('l_partkey', 'A')}) ORDER BY id DESC LIMIT 40")
add("set_difference_sorted_u32_limited", lambda s, d: sets.difference(postings(s, d, "l_orderkey", "R"), postings(s, d, "l_orderkey", "A"), dedup=True, most=25), "SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A') ORDER BY id LIMIT 25")
add("union_sorted_u32_limited", lambda s, d: sets.union([postings(s, d, "l_suppkey", f) for f in "RAN"], most=30, ascending=False), "SELECT DISTINCT l_suppkey AS id FROM lineitem ORDER BY id DESC LIMIT 30")
add("set_difference_sorted_u32", lambda s, d: sets.difference(postings(s, d, "l_orderkey", "R"), postings(s, d, "l_orderkey", "A")), f"SELECT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')")
add("union_sorted_u32", lambda s, d: sets.union([postings(s, d, "l_suppkey", f) for f in "RAN"]), "SELECT DISTINCT l_suppkey AS id FROM lineitem")
for _name, _col in (("dedup_sorted_u32", "l_suppkey"), ("dedup_sorted_u64", "l_orderkey")):
    add(_name, lambda s, d, c=_col: sets.dedup(table(s, d, "lineitem").select(F.col(c).alias("value"))), f"SELECT DISTINCT {_col} AS value FROM lineitem")
add("dedup_sorted_i64", lambda s, d: sets.dedup(table(s, d, "customer").select(F.floor("c_acctbal").alias("value"))), "SELECT DISTINCT floor(c_acctbal)::BIGINT AS value FROM customer")
add("dedup_sorted_f64", lambda s, d: sets.dedup_doubles(table(s, d, "lineitem").select((F.col("l_tax") * F.when(F.col("l_linestatus") == "O", -1.0).otherwise(1.0)).alias("value")), "value"), "SELECT DISTINCT l_tax * CASE WHEN l_linestatus = 'O' THEN -1 ELSE 1 END + 0.0::DOUBLE AS value FROM lineitem")

# --- filters ---

add("filter_range_u32", lambda s, d: filters.in_range(table(s, d, "part"), "p_size", 10, 30).select("p_partkey", "p_size"), "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 30")
add("filter_range_u64", lambda s, d: filters.in_range(table(s, d, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", 500, 5000), "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey BETWEEN 500 AND 5000")
add("filter_range_f64", lambda s, d: filters.in_range(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity", 10.0, 20.0), "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 20")
add("filter_u32", lambda s, d: sets.without_deleted(table(s, d, "orders").select("o_orderkey", "o_custkey"), table(s, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey"), "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
add("filter_u32_by_u64_range", lambda s, d: filters.in_time_range(table(s, d, "events"), "event_id", "ts", F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-20").cast("timestamp_ntz")), "SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'")
add("filter_counts_ge_threshold_u64", lambda s, d: filters.seen_at_least(table(s, d, "lineitem").select("l_partkey"), "l_partkey", 30), "SELECT l_partkey, count(*) AS count FROM lineitem GROUP BY 1 HAVING count(*) >= 30")
add("filter_counts_ge_threshold_u64_limited", lambda s, d: filters.seen_at_least(table(s, d, "lineitem").select("l_partkey"), "l_partkey", 30, most=12), "SELECT l_partkey, count(*) AS count FROM lineitem GROUP BY 1 HAVING count(*) >= 30 ORDER BY l_partkey LIMIT 12")
add("filter_u32_by_u64_range_limited", lambda s, d: filters.in_time_range(table(s, d, "events"), "event_id", "ts", F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-20").cast("timestamp_ntz"), most=15), "SELECT event_id FROM (SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' ORDER BY ts, event_id LIMIT 15)")
add("filter_regex_terms", lambda s, d: filters.where_text(table(s, d, "part").select("p_partkey", "p_name"), text.matches_regex(F.col("p_name"), "^(s|h)[a-z]+ .*(t|ring)$"), "p_name"), "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^(s|h)[a-z]+ .*(t|ring)$')")
add("filter_wildcard_terms", lambda s, d: filters.where_text(table(s, d, "pages").select("page_id", "url"), text.matches_wildcard(F.col("url"), "http*://*.EXAMPLE.?RG/*", True), "url"), "SELECT page_id, url FROM pages WHERE regexp_full_match(lower(url), 'http.*://.*[.]example[.].rg/.*')")
add("match_prefix_strings", lambda s, d: filters.where_text(table(s, d, "documents").select("doc_id", "text"), text.starts_with(F.col("text"), "TH", True), "text").select("doc_id"), "SELECT doc_id FROM documents WHERE starts_with(lower(text), 'th')")
add("match_exact_phrases", lambda s, d: filters.where_text(table(s, d, "documents").select("doc_id", "text"), text.has_phrase(F.col("text"), "the in"), "text").select("doc_id"), "SELECT doc_id FROM documents WHERE contains(text, 'the in')")
EVENT = "event_id", "event_type", "props"


def stored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", fields_of("event_type", "props", "user_id").alias("fields"))


add("match_field_phrases", lambda s, d: stored_events(s, d).where(text.field_has_phrase(F.col("fields"), None, '": 7')).select("event_id"), """SELECT event_id FROM events WHERE contains(event_type, '": 7') OR contains(props, '": 7') OR contains(user_id::VARCHAR, '": 7')""")
add("match_field_prefixes", lambda s, d: stored_events(s, d).where(text.field_starts_with(F.col("fields"), "event_type", "P", True)).select("event_id"), "SELECT event_id FROM events WHERE starts_with(lower(event_type), 'p')")
add("check_range_overlaps_f64", lambda s, d: filters.overlapping(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("lo"), (F.col("l_quantity") + F.col("l_linenumber")).alias("hi")), "lo", "hi", 20.0, 25.0), "SELECT l_orderkey, l_linenumber, l_quantity AS lo, l_quantity + l_linenumber AS hi FROM lineitem WHERE l_quantity <= 25 AND l_quantity + l_linenumber >= 20")
add("range_overlap_join", lambda s, d: filters.range_overlap_join(
    table(s, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("a"), (F.col("s_acctbal") + 50).alias("b")),
    table(s, d, "customer").select("c_custkey", F.col("c_acctbal").alias("c"), (F.col("c_acctbal") + 20).alias("e")), ("a", "b"), ("c", "e"), 70.0).select("s_suppkey", "c_custkey"),
    "SELECT s_suppkey, c_custkey FROM supplier, customer WHERE s_acctbal <= c_acctbal + 20 AND s_acctbal + 50 >= c_acctbal")

# --- order: ranks make it visible ---


def add_sort(name: str, source: str, key: str, expr: str, ties: tuple[str, ...], ascending: bool = True, dedup: bool = False) -> None:
    sql_rows = f"SELECT {'DISTINCT' if dedup else ''} {expr} AS {key}{''.join(', ' + t for t in ties)} FROM {source}"
    way = "ASC NULLS FIRST" if ascending else "DESC NULLS LAST"
    add(name, lambda s, d: order.ranked(table(s, d, source).select(F.expr(expr).alias(key), *ties), key, *ties, ascending=ascending, dedup=dedup), f"SELECT *, row_number() OVER (ORDER BY {', '.join([f'{key} {way}', *ties])}) AS rank FROM ({sql_rows})")


add_sort("sort_u32", "lineitem", "value", "l_partkey", (), dedup=True)
add_sort("sort_u64", "orders", "value", "o_orderkey", (), ascending=False)
add_sort("sort_i64", "customer", "value", "CAST(floor(c_acctbal) AS BIGINT)", ("c_custkey",))
add_sort("sort_f64", "orders", "value", "o_totalprice", ("o_orderkey",), ascending=False)
add_sort("sort_strings", "part", "value", "p_name", ("p_partkey",))
add_sort("sort_u32_by_u64", "lineitem", "value", "l_orderkey", ("l_linenumber", "l_partkey"))
add_sort("sort_u32_by_i64", "supplier", "value", "CAST(floor(s_acctbal) AS BIGINT)", ("s_suppkey",), ascending=False)
add("sort_u32_by_f64", lambda s, d: order.ranked_nan_last(table(s, d, "events").select("value", "event_id"), "value", "event_id", ascending=False), "SELECT value, event_id, row_number() OVER (ORDER BY value DESC, event_id) AS rank FROM events")
add("is_sorted_u32", lambda s, d: order.is_sorted(table(s, d, "events"), "user_id", ["ts", "event_id"], "event_id"), "SELECT user_id, bool_and(step) AS is_sorted FROM (SELECT user_id, coalesce(lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= event_id, true) AS step FROM events) GROUP BY user_id")

# --- search in each user's sorted series ---


def add_search(name: str, f, value: str, target: str, sql: str) -> None:
    add(name, lambda s, d: table(s, d, "events").groupBy("user_id").agg(f(F.expr(value), F.expr(target)).cast("bigint").alias("place")), f"SELECT user_id, ({sql})::BIGINT AS place FROM (SELECT user_id, {value} AS v, {target} AS t FROM events) GROUP BY user_id")


GE, LE = "count_if(v < t)", "CASE WHEN count_if(v <= t) = 0 THEN count(v) ELSE count_if(v <= t) - 1 END"
for _kind, _value, _target in (("u32", "event_id", "400"), ("u64", "event_id * 1000000007", "300000002100")):
    add_search(f"binary_search_ge_{_kind}", search.at_least, _value, _target, GE)
    add_search(f"exponential_search_ge_{_kind}", search.at_least, _value, _target + " + 1", GE)
    add_search(f"binary_search_le_{_kind}", search.at_most, _value, _target, LE)
    add_search(f"exponential_search_le_{_kind}", search.at_most, _value, _target + " + 1", LE)


def metric_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id")


DAY = "2024-01-15"
add("binary_search_ge_time", lambda s, d: metric_points(s, d).agg(search.at_least(F.col("ts"), F.lit(DAY).cast("timestamp_ntz")).alias("place")), f"SELECT user_id, count_if(ts < TIMESTAMP '{DAY}')::BIGINT AS place FROM events GROUP BY user_id")
add("binary_search_le_time", lambda s, d: metric_points(s, d).agg(search.after_at_most(F.col("ts"), F.lit(DAY).cast("timestamp_ntz")).alias("place")), f"SELECT user_id, count_if(ts <= TIMESTAMP '{DAY}')::BIGINT AS place FROM events GROUP BY user_id")


def asof(forward: bool) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        events = table(spark, sf_dir, "events")
        bought = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
        return search.asof(bought, events.where("event_type = 'view'").select("user_id", "ts", "value"), "user_id", "ts", "value", forward)

    return query


for _forward, _name, _test, _pick in ((False, "asof_backward", "<=", "max"), (True, "asof_forward", ">=", "min")):
    add(_name, asof(_forward), f"""
WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts AS t, max(value) AS m FROM events WHERE event_type = 'view' GROUP BY ALL),
n AS (SELECT p.event_id, {_pick}(v.t) AS t FROM p JOIN v ON p.user_id = v.user_id AND v.t {_test} p.ts GROUP BY 1)
SELECT p.*, n.t AS asof_time, v.m AS asof_value FROM p LEFT JOIN n USING (event_id) LEFT JOIN v ON v.user_id = p.user_id AND v.t = n.t""")

# --- reductions, by return flag ---


def add_reduction(name: str, value: Callable[[], list[Column]], sql: str, source: str = "lineitem", by: str = "l_returnflag") -> None:
    add(name, lambda s, d: table(s, d, source).groupBy(by).agg(*value()), f"SELECT {by}, {sql} FROM {source} GROUP BY {by}")


C = F.col
add_reduction("reduce_sum_f64", lambda: [F.round(reduce.sum_f64(C("l_extendedprice")), 2).alias("value")], "round(sum(l_extendedprice), 2) AS value")
add_reduction("reduce_sum_u64", lambda: [reduce.sum_u64(C("l_orderkey")).alias("value")], "sum(l_orderkey)::DECIMAL(20,0) AS value")
add_reduction("reduce_sum_u32", lambda: [reduce.sum_u32(C("l_linenumber")).alias("value")], "sum(l_linenumber)::BIGINT AS value")
add_reduction("reduce_weighted_sum_f64", lambda: [F.round(reduce.weighted_sum(C("l_discount"), C("l_linenumber")), 4).alias("value")], "round(sum(l_discount * l_linenumber), 4) AS value")
add_reduction("reduce_min_f64", lambda: [reduce.min_f64(C("l_extendedprice")).alias("value")], "min(l_extendedprice) AS value")
add_reduction("reduce_max_f64", lambda: [reduce.max_f64(C("l_extendedprice")).alias("value")], "max(l_extendedprice) AS value")
add_reduction("reduce_min_u32", lambda: [reduce.min_u32(C("l_partkey")).alias("value")], "min(l_partkey)::BIGINT AS value")
add_reduction("reduce_max_u32", lambda: [reduce.max_u32(C("l_partkey")).alias("value")], "max(l_partkey)::BIGINT AS value")
add_reduction("find_min_max_u32", lambda: [reduce.min_u32(C("l_suppkey")).alias("lo"), reduce.max_u32(C("l_suppkey")).alias("hi")], "min(l_suppkey)::BIGINT AS lo, max(l_suppkey)::BIGINT AS hi")
add_reduction("find_min_max_i64", lambda: [reduce.min_i64(F.floor("c_acctbal")).alias("lo"), reduce.max_i64(F.floor("c_acctbal")).alias("hi")], "min(floor(c_acctbal))::BIGINT AS lo, max(floor(c_acctbal))::BIGINT AS hi", "customer", "c_mktsegment")
add_reduction("find_min_max_f64", lambda: [reduce.min_f64(C("l_quantity")).alias("lo"), reduce.max_f64(C("l_quantity")).alias("hi")], "min(l_quantity) AS lo, max(l_quantity) AS hi")
add_reduction("avg_f64", lambda: [F.round(reduce.avg(C("l_extendedprice")), 4).alias("value")], "round(avg(l_extendedprice), 4) AS value")
add_reduction("stdvar_f64", lambda: [F.round(reduce.variance(C("l_quantity")), 6).alias("value")], "round(var_pop(l_quantity), 6) AS value")
add("mad_f64", lambda s, d: reduce.mean_deviation(table(s, d, "lineitem"), ["l_returnflag"], "l_quantity").select("l_returnflag", F.round("mad", 6).alias("mad")), "SELECT l_returnflag, round(avg(abs(l_quantity - m)), 6) AS mad FROM lineitem JOIN (SELECT l_returnflag, avg(l_quantity) AS m FROM lineitem GROUP BY 1) USING (l_returnflag) GROUP BY 1")
add_reduction("present_f64", lambda: [reduce.present(C("value")).alias("present")], "max(CASE WHEN isnan(value) THEN 0 ELSE 1 END)::DOUBLE AS present", "events", "user_id")
PS = [0.0, 5.0, 25.0, 50.0, 90.0, 99.9, 100.0]
add("calculate_multi_percentiles_f64", lambda s, d: reduce.percentiles(table(s, d, "lineitem"), ["l_returnflag"], "l_extendedprice", PS).select("l_returnflag", *[F.round(F.col("p")[i], 4).alias(f"p{i}") for i in range(len(PS))]), "SELECT l_returnflag, " + ", ".join(f"round(quantile_cont(l_extendedprice, {p / 100}), 4) AS p{i}" for i, p in enumerate(PS)) + " FROM lineitem GROUP BY 1")
add("calculate_percentiles_batch_f64", lambda s, d: reduce.percentiles(table(s, d, "events"), ["user_id"], "value", [95.0]).select("user_id", F.round(F.col("p")[0], 6).alias("p95")), "SELECT user_id, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")

# --- series: each user's events in time order ---

BY = ("user_id", ["ts", "event_id"], "value")
LAGGED = "(SELECT user_id, value AS v, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)"
add("changes_f64", lambda s, d: series.changes(table(s, d, "events"), *BY), f"SELECT user_id, count_if(v <> b)::DOUBLE AS changes FROM {LAGGED} GROUP BY 1")
add("resets_f64", lambda s, d: series.resets(table(s, d, "events"), *BY), f"SELECT user_id, count_if(v < b)::DOUBLE AS resets FROM {LAGGED} GROUP BY 1")
add("increase_f64", lambda s, d: series.increase(table(s, d, "events"), *BY), """
SELECT user_id, CASE WHEN n < 2 THEN 0 WHEN b < a THEN b ELSE b - a END AS increase FROM (
  SELECT user_id, count(*) AS n, arg_min(value, (ts, event_id)) AS a, arg_max(value, (ts, event_id)) AS b FROM events GROUP BY 1)""")
SECONDS = "unix_seconds(cast(ts AS timestamp)) - 1704067200"
SQL_SECONDS = "floor(epoch(ts)) - 1704067200"


def hours(c: str = SECONDS) -> Column:
    return (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000 - 1704067200) / 3600


add("deriv_f64", lambda s, d: table(s, d, "events").groupBy("user_id").agg(F.round(series.slope(C("value"), hours()), 6).alias("slope")), "SELECT user_id, round(coalesce(regr_slope(value, h), 0), 6) AS slope FROM (SELECT *, (epoch_us(ts) / 1000000.0::DOUBLE - 1704067200) / 3600 AS h FROM events) GROUP BY 1")
add("predict_linear_f64", lambda s, d: table(s, d, "events").groupBy("user_id").agg(F.round(series.predicted(C("value"), hours(), F.lit(800.0)), 4).alias("predicted")), "SELECT user_id, round(CASE WHEN count(value) = 1 THEN max(value) ELSE coalesce(regr_intercept(value, h) + regr_slope(value, h) * 800, avg(value)) END, 4) AS predicted FROM (SELECT *, (epoch_us(ts) / 1000000.0::DOUBLE - 1704067200) / 3600 AS h FROM events) GROUP BY 1")

# --- element-wise ---

LINE = "l_orderkey", "l_linenumber"


def add_element(name: str, value: Callable[[], Column], sql: str, keys: tuple[str, ...] = LINE, source: str = "lineitem") -> None:
    add(name, lambda s, d: table(s, d, source).select(*keys, value().alias("value")), f"SELECT {', '.join(keys)}, {sql} AS value FROM {source}")


E = elementwise
add_element("vectorized_subtract_u32", lambda: E.subtract_saturating(C("l_partkey"), 100), "greatest(l_partkey - 100, 0)")
add_element("vectorized_quantize_f64", lambda: E.quantize(C("l_quantity"), 5.0, 30.0, 100.0), "trunc(least(greatest((l_quantity - 5) / 30 * 100, 0), 100))::BIGINT")
add_element("fma_f64", lambda: F.round(E.fma(C("l_extendedprice"), C("l_discount"), C("l_tax")), 6), "round(l_extendedprice * l_discount + l_tax, 6)")
add_element("linear_interpolate_f64", lambda: F.round(E.interpolate(C("l_quantity"), C("l_extendedprice"), C("l_discount")), 6), "round(l_quantity + l_discount * (l_extendedprice - l_quantity), 6)")
add_element("usize_to_u32", lambda: E.to_u32(C("n_chars") * 1000000), "least(n_chars * 1000000, 4294967295)::BIGINT", ("doc_id",), "documents")
add_element("add_f64", lambda: E.add(C("l_quantity"), C("l_tax")), "l_quantity + l_tax")
add_element("subtract_f64", lambda: E.subtract(C("l_quantity"), C("l_tax")), "l_quantity - l_tax")
add_element("multiply_f64", lambda: E.multiply(C("l_quantity"), C("l_tax")), "l_quantity * l_tax")
add_element("divide_f64", lambda: E.divide(C("l_quantity"), C("l_discount")), "l_quantity / l_discount")
add_element("modulo_f64", lambda: E.modulo(C("l_extendedprice"), C("l_quantity")), "CASE WHEN l_quantity = 0 THEN 'nan'::DOUBLE ELSE l_extendedprice % l_quantity END")
add_element("power_f64", lambda: F.round(E.power(C("l_quantity"), C("l_discount")), 9), "round(pow(l_quantity, l_discount), 9)")
for _name, _f, _op in (("equal", E.equal, "="), ("not_equal", E.not_equal, "<>"), ("greater_than", E.greater_than, ">"), ("less_than", E.less_than, "<"), ("greater_equal", E.greater_equal, ">="), ("less_equal", E.less_equal, "<=")):
    add_element(f"{_name}_f64", lambda f=_f: f(C("l_discount"), C("l_tax")), f"(l_discount {_op} l_tax)::INT::DOUBLE")
add_element("is_nan_f64", lambda: E.is_nan(E.divide(C("l_discount"), C("l_tax"))), "(l_discount = 0 AND l_tax = 0)::INT::DOUBLE")
#: What each function of one double is applied to, in both languages; within its domain and of a moderate size.
DOMAIN = {"abs": "l_discount - l_tax", "neg": "l_quantity", "sqrt": "l_extendedprice", "acosh": "l_quantity", "atanh": "l_discount", "log": "l_quantity", "log2": "l_quantity", "log10": "l_quantity", "floor": "l_extendedprice", "ceil": "l_extendedprice", "round": "l_extendedprice - 1000", "sgn": "l_discount - l_tax", "deg": "l_discount", "rad": "l_quantity"}
NAMES = {"neg": "-({})", "deg": "degrees({})", "rad": "radians({})", "log": "ln({})", "sgn": "sign({})::DOUBLE + 0.0::DOUBLE", "floor": "floor({})::DOUBLE", "ceil": "ceil({})::DOUBLE"}
for _name, _f in {**E.SAME, **E.OWN}.items():
    _x = DOMAIN.get(_name, "l_discount * 5 - l_tax" if _name in ("sin", "cos", "tan", "exp", "asinh", "atan", "cosh", "sinh", "tanh") else "l_discount - l_tax")
    add_element(f"{_name}_f64", lambda f=_f, x=_x: F.round(f(F.expr(x)), 9) + F.lit(0.0), f"round({NAMES.get(_name, _name + '({})').format(_x)}, 9) + 0.0::DOUBLE")
add_element("clamp_f64", lambda: E.clamp(C("l_quantity"), 10.0, 40.0), "least(greatest(l_quantity, 10), 40)::DOUBLE")
add_element("clamp_min_f64", lambda: E.clamp_min(C("l_quantity"), 10.0), "greatest(l_quantity, 10)::DOUBLE")
add_element("clamp_max_f64", lambda: E.clamp_max(C("l_quantity"), 40.0), "least(l_quantity, 40)::DOUBLE")

# --- dates ---

UNIX = "floor(epoch(ts))::BIGINT"
PART_SQL = {"timestamp": UNIX, "hour": "hour(ts)", "minute": "minute(ts)", "day_of_week": "dayofweek(ts)", "day_of_month": "day(ts)", "day_of_year": "dayofyear(ts)", "days_in_month": "day(last_day(ts))", "month": "month(ts)", "year": "year(ts)"}
APPROX_SQL = {"day_of_month": "floor(epoch(ts) / 86400)::BIGINT % 30 + 1", "day_of_year": "floor(epoch(ts) / 86400)::BIGINT % 365 + 1", "days_in_month": "30", "month": "floor(floor(epoch(ts) / 86400) / 30)::BIGINT % 12 + 1", "year": "1970 + floor(floor(epoch(ts) / 86400) / 365)"}


def unix() -> Column:
    return F.unix_seconds(F.col("ts").cast("timestamp"))


for _name, _f in calendar.PARTS.items():
    add_element(f"{_name}_u64", lambda f=_f: f(unix()), f"({PART_SQL[_name]})::DOUBLE", ("event_id",), "events")
for _name, _f in calendar.APPROX.items():
    add_element(f"{_name}_u64_approx", lambda f=_f: f(unix()), f"({APPROX_SQL[_name]})::DOUBLE", ("event_id",), "events")

# --- text ---

add_element("to_lowercase", lambda: text.to_lowercase(C("text")), "lower(text)", ("doc_id",), "documents")
add("tokenize_string", lambda s, d: table(s, d, "documents").select(F.explode(text.tokenize(C("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n")), f"SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{text.TOKEN}')) AS token FROM documents) GROUP BY 1")

# --- array forms ---


def gathered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's part keys of both return flags, as arrays."""
    flag = lambda f: F.coalesce(F.array_sort(F.collect_list(F.when(C("l_returnflag") == f, C("l_partkey")))), F.array().cast("array<bigint>"))
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(flag("R").alias("a"), flag("A").alias("b"))


GATHERED = "(SELECT l_suppkey, coalesce(list(l_partkey ORDER BY l_partkey) FILTER (l_returnflag = 'R'), []) AS a, coalesce(list(l_partkey ORDER BY l_partkey) FILTER (l_returnflag = 'A'), []) AS b FROM lineitem GROUP BY 1)"


def add_array(name: str, value: Callable[[], Column], sql: str) -> None:
    add(name, lambda s, d: gathered(s, d).select("l_suppkey", value().cast("string").alias("value")), f"SELECT l_suppkey, ({sql})::VARCHAR AS value FROM {GATHERED}")


add_array("array_intersect_sorted", lambda: arrays.intersect(C("a"), C("b")), "list_sort(list_distinct(list_filter(a, lambda x: list_contains(b, x))))")
add_array("array_intersect_sorted_bag", lambda: arrays.intersect(C("a"), C("b"), dedup=False), "list_sort(flatten(list_transform(list_distinct(list_filter(a, lambda x: list_contains(b, x))), lambda v: list_transform(range(least(len(list_filter(a, lambda x: x = v)), len(list_filter(b, lambda x: x = v)))), lambda z: v))))")
add_array("array_sort", lambda: arrays.sort(F.concat(C("a"), C("b")), dedup_=True, ascending=False), "list_reverse_sort(list_distinct(list_concat(a, b)))")
add_array("array_argsort", lambda: arrays.argsort(F.reverse(F.array_distinct(C("b")))), "list_reverse(range(len(list_distinct(b))))")
add_array("array_is_sorted", lambda: arrays.is_sorted(F.concat(C("a"), F.slice(C("b"), -1, 1))), "list_concat(a, b[-1:]) = list_sort(list_concat(a, b[-1:]))")
add_array("array_after_last_at_most", lambda: arrays.after_last_at_most(C("a"), F.lit(500)), "len(list_filter(a, lambda x: x <= 500))")
add_array("array_difference_sorted", lambda: arrays.difference(C("a"), C("b")), "list_filter(a, lambda x: NOT list_contains(b, x))")
add_array("array_union_sorted", lambda: arrays.union([C("a"), C("b")]), "list_sort(list_distinct(list_concat(a, b)))")
add_array("array_dedup_sorted", lambda: arrays.dedup(C("a")), "list_sort(list_distinct(a))")
add_array("array_lower_bound", lambda: arrays.lower_bound(C("a"), F.lit(500)), "len(list_filter(a, lambda x: x < 500))")
add_array("array_last_at_most", lambda: arrays.last_at_most(C("a"), F.lit(500)), "CASE WHEN len(list_filter(a, lambda x: x <= 500)) = 0 THEN len(a) ELSE len(list_filter(a, lambda x: x <= 500)) - 1 END")
add_array("array_filter_range", lambda: arrays.in_range(C("a"), 100, 900), "list_filter(a, lambda x: x BETWEEN 100 AND 900)")

# --- classification of strings made of events, of which SQL knows the answers ---

#: A string of an event, and the type, count and values that it must have.
FORMS = [
    ("props", "'String'", "1", "0", "0"),
    ("CAST(event_id AS STRING)", "'Integer'", "1", "event_id", "0"),
    ("concat('-', user_id, '.', '25')", "'Float'", "1", "-(user_id + 0.25)", "0"),
    ("concat(event_id % 1000, 'e', 2)", "'Float'", "1", "(event_id % 1000) * 100", "0"),
    ("concat('10.0.', user_id % 256, '.', event_id % 256)", "'IPAddressV4'", "1", "167772160 + (user_id % 256) * 256 + event_id % 256", "0"),
    ("concat('2001:db8::', event_id % 10000)", "'IPAddressV6'", "1", "0", "0"),
    ("concat(event_id % 90, '.5,-', user_id % 180, '.25')", "CASE WHEN event_id % 90 < 90 THEN 'Geo' END", "1", "event_id % 90 + 0.5", "-(user_id % 180 + 0.25)"),
    ("date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")", "'ISO8601Date'", "1", "epoch_ms(date_trunc('second', ts))", "0"),
    ("date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'+01:30'\")", "'ISO8601Date'", "1", "epoch_ms(date_trunc('second', ts)) - 5400000", "0"),
    ("date_format(ts, 'yyyy-MM-dd')", "'FullDate'", "1", "epoch_ms(date_trunc('day', ts))", "0"),
    ("date_format(ts, 'yyyy/MM/dd HH:mm:ss')", "'GenericDate'", "1", "epoch_ms(date_trunc('second', ts))", "0"),
    ("date_format(ts, 'MM/dd/yyyy')", "'AmericanDate'", "1", "epoch_ms(date_trunc('day', ts))", "0"),
    ("date_format(ts, 'dd/MM/yyyy')", "CASE WHEN day(ts) > 12 THEN 'EuropeanDate' ELSE 'AmericanDate' END", "1", "CASE WHEN day(ts) > 12 THEN epoch_ms(date_trunc('day', ts)) ELSE epoch_ms(make_timestamp(year(ts), day(ts), month(ts), 0, 0, 0.0)) END", "0"),
    ("date_format(ts, 'd') || CASE WHEN day(ts) IN (1, 21, 31) THEN 'st' WHEN day(ts) IN (2, 22) THEN 'nd' WHEN day(ts) IN (3, 23) THEN 'rd' ELSE 'th' END || date_format(ts, ' MMMM yyyy')", "'FinancialDate'", "1", "epoch_ms(date_trunc('day', ts))", "0"),
    ("date_format(ts, \"'Mon' MMM dd HH:mm:ss yyyy\")", "'LogDate'", "1", "epoch_ms(date_trunc('second', ts))", "0"),
    ("date_format(ts, \"'Mon', dd MMM yyyy HH:mm:ss '+0200'\")", "'RFC2822Date'", "1", "epoch_ms(date_trunc('second', ts))", "0"),
    ("'Monday, the ' || date_format(ts, 'd') || CASE WHEN day(ts) IN (1, 21, 31) THEN 'st' WHEN day(ts) IN (2, 22) THEN 'nd' WHEN day(ts) IN (3, 23) THEN 'rd' ELSE 'th' END || date_format(ts, \" 'of' MMMM, yyyy\")", "'VerboseDate'", "1", "epoch_ms(date_trunc('day', ts))", "0"),
    ("date_format(ts, 'yyyy-MMM-dd')", "'FullDate'", "1", "epoch_ms(date_trunc('day', ts))", "0"),
    ("date_format(ts, \"yyyy-MM-'Wed'\")", "'FullDate'", "1", "epoch_ms(date_trunc('month', ts))", "0"),
    ("concat('/', event_type, '/', event_id, '.log')", "'File'", "1", "0", "0"),
    ("CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'null' END", "CASE WHEN event_id % 2 = 0 THEN 'Boolean' ELSE 'Null' END", "1", "1 - event_id % 2", "0"),
    ("concat('now+', event_id, 'h-1d/d')", "'DateMath'", "1", "1705276800000 + floor((event_id * 3600000 - 86400000 + 43200000) / 86400000.0::DOUBLE) * 86400000", "0"),
    ("concat('[', event_id, ', ', user_id, ',7]')", "'IntegerArray'", "3", "0", "0"),
    ("concat('[\"', event_type, '\", \"', event_id, ',x\"]')", "'StringArray'", "2", "0", "0"),
    ("concat('[true,[', event_id % 2 = 0, ',false]]')", "'BooleanArray'", "3", "0", "0"),
    ("concat('[10.0.0.', event_id % 256, ', 10.0.0.1]')", "'IPAddressV4Array'", "2", "0", "0"),
    ("concat('[', date_format(ts, 'yyyy-MM-dd'), ', ', date_format(ts, 'MM/dd/yyyy'), ']')", "'Array'", "2", "0", "0"),
    ("concat('[1.5, ', event_id, ']')", "'Array'", "2", "0", "0"),
    ("concat('[1, 2, ', event_type, ', 3]')", "'String'", "2", "0", "0"),
]


#: Events whose strings a task classifies: few bytes of a table make much work.
EVENTS_A_TASK = 20_000


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "props")
    rows = events.repartition(events.count() // EVENTS_A_TASK + 1).select("event_id", F.posexplode(F.array(*[F.expr(f[0]) for f in FORMS])).alias("form", "s"))
    noon = F.lit(1705276800000 + 43200000)  # the clock of date arithmetic
    # Inlined, so that the struct is made once and not again for each of its fields.
    return rows.select("event_id", "form", F.inline(F.array(classify.classify(F.col("s"), noon))))


add("classify_string", classified, " UNION ALL ".join(f"SELECT event_id, {i} AS form, {k} AS kind, {n}::BIGINT AS element_count, ({a})::DOUBLE AS numeric_value_1, ({b})::DOUBLE AS numeric_value_2 FROM events" for i, (_, k, n, a, b) in enumerate(FORMS)))

# --- what the session offers in place of processor probes and chunk sizes ---

add("capabilities", lambda s, d: s.createDataFrame(sorted(capabilities(s).items()), "name string, value string"), None)
