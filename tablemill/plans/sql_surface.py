"""The SELECT surface: every family of relational query, sent through the guarded entry point."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablemill.operators import sketches
from tablemill.operators.query import asof_join, audit_queries, restricted_sql, sample_by_hash, sample_by_weight, top_k_per_group
from tablemill.operators.ranges import ntile, range_join, ranks, rows_frames, shifted
from tablemill.plans.registry import query, sql_query

PRICING = """
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
       round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
       round(avg(l_quantity), 6) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price,
       round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM {data} WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00'
GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus
"""


@query("q1_restricted_sql", PRICING.format(data="lineitem"))
def pricing(spark, t):
    return restricted_sql({"data": t.lineitem}, PRICING.format(data="data"))


@query("q1_empty_query_is_select_all", "SELECT * FROM nation")
def empty_query(spark, t):
    return restricted_sql({"data": t.nation}, "  ")


# Query texts built from the rows of `events`: one form per event type.
FORMS = [
    ("click", "SELECT * FROM data WHERE k > 0"),
    ("view", "with x as (select * from data) select * from x"),
    ("purchase", "DELETE FROM data"),
    ("signup", "SELECT 1; DROP TABLE data"),
    ("error", "SELECT * FROM read_csv_auto ( 'x' )"),
]
AUDIT_SQL = """
WITH q AS (SELECT event_id, trim(CASE
  WHEN event_id % 7 = 0 THEN 'SELECT * FROM ''https://x/y'''
  WHEN event_id % 11 = 0 THEN '   '
  WHEN event_id % 13 = 0 THEN 'select a from data where a = ''update'''
""" + "".join(f"  WHEN event_type = '{e}' THEN '{s.replace(chr(39), chr(39) * 2)}'\n" for e, s in FORMS) + """
  END) AS s, props FROM events),
r AS (SELECT event_id, props, CASE WHEN s = '' THEN NULL
  WHEN NOT regexp_matches(s, '(?is)^(select|with)\\b') THEN 'Only SELECT or WITH queries are allowed.'
  WHEN contains(s, ';') THEN 'Multiple SQL statements are blocked.'
  WHEN regexp_matches(s, '(?is)://|\\b(?:https?|ftp|file):') THEN 'Network/filesystem URLs are blocked.'
  WHEN regexp_matches(s, '(?is)\\b(?:install|load|attach|detach|copy|export|import|pragma|call|create|insert|replace|update|delete|drop|alter|vacuum|reindex|analyze)\\b')
    THEN 'Mutating, extension, and attachment statements are blocked.'
  WHEN regexp_matches(s, '(?is)\\b(?:read_[a-z0-9_]+|glob|sqlite_scan|parquet_scan|csv_scan|json_scan|readfile|writefile|load_extension)\\s*\\(')
    THEN 'External file-reader functions are blocked.' END AS reason FROM q)
SELECT event_id, reason IS NULL AS allowed, CASE WHEN reason IS NOT NULL THEN 'DATA_QUERY_RESTRICTED' END AS code, reason
FROM r
"""


@query("q2_audit_queries", AUDIT_SQL)
def audit(spark, t):
    text = (F.when(F.col("event_id") % 7 == 0, "SELECT * FROM 'https://x/y'")
            .when(F.col("event_id") % 11 == 0, "   ")
            .when(F.col("event_id") % 13 == 0, "select a from data where a = 'update'"))
    for event, form in FORMS:
        text = text.when(F.col("event_type") == event, form)
    return audit_queries(t.events.select("event_id", text.alias("sql")), "sql").select(
        "event_id", "allowed", "code", "reason")


sql_query("q3_projection_filter", """
SELECT l_orderkey, l_linenumber, l_quantity * 2 AS twice,
       CASE WHEN l_discount > 0.05 THEN 'high' WHEN l_discount > 0 THEN 'low' ELSE 'none' END AS band,
       l_returnflag IN ('A', 'R') AS returned
FROM lineitem
WHERE l_quantity BETWEEN 10 AND 30 AND l_returnflag LIKE '_' AND l_linestatus <> 'X' AND l_shipdate IS NOT NULL
""", "lineitem")

sql_query("q4_join_inner", """
SELECT c_mktsegment, o_orderpriority, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
GROUP BY c_mktsegment, o_orderpriority
""", "customer orders lineitem")

sql_query("q4_join_outer", """
SELECT coalesce(c_custkey, -1) AS custkey, coalesce(s_suppkey, -1) AS suppkey, c_nationkey, s_nationkey
FROM customer FULL JOIN supplier ON c_custkey = s_suppkey AND c_nationkey = s_nationkey
""", "customer supplier")

sql_query("q4_join_left_right", """
SELECT 'l' AS side, count(*) AS n, count(o_orderkey) AS matched FROM customer LEFT JOIN orders ON c_custkey = o_custkey
UNION ALL
SELECT 'r' AS side, count(*) AS n, count(c_custkey) AS matched FROM orders RIGHT JOIN customer ON c_custkey = o_custkey
""", "customer orders")

sql_query("q4_join_semi_anti", """
SELECT 'semi' AS kind, count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
UNION ALL
SELECT 'anti' AS kind, count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
""", "customer orders")

sql_query("q4_join_theta", """
SELECT s_nationkey, count(*) AS pairs FROM supplier JOIN nation
ON s_nationkey >= n_nationkey AND s_nationkey < n_nationkey + 3 GROUP BY s_nationkey
""", "supplier nation")


@query("q4_range_join", """
SELECT e.event_id, c.event_id AS click_id FROM events e JOIN events c
ON e.user_id = c.user_id AND c.ts >= e.ts - INTERVAL 86400 SECOND AND c.ts < e.ts
WHERE e.event_type = 'error' AND c.event_type = 'click'
""")
def clicks_before_errors(spark, t):
    """Clicks of the day before an error of the same user, by equal keys."""
    errors = t.events.where("event_type = 'error'").select(
        "event_id", "user_id", (F.col("ts") - F.expr("INTERVAL 86400 SECONDS")).alias("since"), F.col("ts").alias("until"))
    clicks = t.events.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), F.col("ts").alias("clicked"))
    return range_join(clicks, errors, "clicked", "since", "until", ["user_id"]).select("event_id", "click_id")


@query("q5_asof_join", """
SELECT e.event_id, e.user_id, c.event_id AS click_id, c.ts AS click_ts
FROM (SELECT * FROM events WHERE event_type = 'error') e
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON e.user_id = c.user_id AND e.ts >= c.ts
""")
def asof(spark, t):
    errors = t.events.where("event_type = 'error'").select("event_id", "user_id", "ts")
    clicks = t.events.where("event_type = 'click'").select(
        "user_id", F.col("event_id").alias("click_id"), F.col("ts").alias("click_ts"))
    return asof_join(errors, clicks, ["user_id"], "ts", "click_ts").select(
        "event_id", "user_id", "click_id", "click_ts")


sql_query("q6_aggregation", """
SELECT l_suppkey, count(*) AS n, count(DISTINCT l_partkey) AS parts, sum(l_quantity) AS qty,
       count(*) FILTER (WHERE l_returnflag = 'R') AS returned, min(l_shipdate) AS first_ship,
       max(l_shipdate) AS last_ship, round(stddev_samp(l_quantity), 6) AS sd
FROM lineitem GROUP BY l_suppkey HAVING count(*) > 5
""", "lineitem")

sql_query("q6_global_aggregation", """
SELECT count(*) AS n, count(DISTINCT l_orderkey) AS orders, round(avg(l_tax), 8) AS avg_tax FROM lineitem
""", "lineitem")


@query("q6_approx_distinct", """
SELECT l_returnflag, TRUE AS within FROM lineitem GROUP BY l_returnflag
""")
def approx_distinct(spark, t):
    """The approximate count must lie within 5 % of the exact one.

    They are grouped apart: in one grouping Spark keeps a sketch of 13 KB for each distinct value that is counted.
    """
    return restricted_sql({"lineitem": t.lineitem}, """
        SELECT a.l_returnflag, abs(a.n - e.n) <= 0.05 * e.n AS within
        FROM (SELECT l_returnflag, approx_count_distinct(l_orderkey, 0.01) AS n FROM lineitem GROUP BY l_returnflag) a
        JOIN (SELECT l_returnflag, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY l_returnflag) e
        ON a.l_returnflag <=> e.l_returnflag""")


@query("q7_sketch_rollup", """
SELECT event_type, CASE WHEN event_type IS NULL THEN 1 ELSE 0 END AS level, count(*) AS rows, TRUE AS users_within, TRUE AS median_within
FROM events GROUP BY ROLLUP (event_type)
""")
def sketch_rollup(spark, t):
    """Daily sketches rolled up without reading the events again, held against exact counts."""
    events = t.events.withColumn("day", F.to_date("ts"))
    daily = sketches.sketch_table(events, ["event_type", "day"], {"users": F.col("user_id")}, {"amounts": F.col("value")})
    by_type = sketches.merge_sketches(daily, ["event_type"], ["users"], ["amounts"])
    rolled = sketches.rollup_sketches(by_type, ["event_type"], ["users"], ["amounts"]).select(
        "event_type", "level", "rows", sketches.distinct_count("users").alias("users"), sketches.quantile("amounts", 0.5).alias("median"))
    # every event counts for its type and for the total
    seen = t.events.select(F.explode(F.array("event_type", F.lit(None).cast("string"))).alias("of"), "user_id", "value")
    both = seen.join(F.broadcast(rolled), F.col("of").eqNullSafe(F.col("event_type")))  # a row per type
    share = {"below": F.col("value") < F.col("median"), "upto": F.col("value") <= F.col("median")}
    exact = both.groupBy("event_type", "level", "rows", "users").agg(
        F.count_distinct("user_id").alias("exact"), *[F.avg(c.cast("double")).alias(n) for n, c in share.items()])
    slack = 4 * sketches.RANK_ERROR
    return exact.select(
        "event_type", "level", "rows", (F.abs(F.col("users") - F.col("exact")) <= 4 * sketches.DISTINCT_ERROR * F.col("exact")).alias("users_within"),
        ((F.col("below") <= 0.5 + slack) & (F.col("upto") >= 0.5 - slack)).alias("median_within"))


@query("q10_sketch_sets", """
SELECT TRUE AS both_within, TRUE AS only_within
""")
def sketch_sets(spark, t):
    """Users with clicks and errors, and with clicks alone, from one sketch per type."""
    table = sketches.sketch_table(t.events, ["event_type"], {"users": F.col("user_id")}, {})
    one = lambda kind: table.where(F.col("event_type") == kind)
    pair = one("click").select(F.col("users").alias("a")).join(one("error").select(F.col("users").alias("b")))  # one row on either side
    got = pair.select(F.inline(F.array(sketches.set_counts(F.col("a"), F.col("b")))))
    users = t.events.groupBy("user_id").agg(F.bool_or(F.col("event_type") == "click").alias("c"), F.bool_or(F.col("event_type") == "error").alias("e"))
    exact = users.agg(F.count_if(F.col("c") & F.col("e")).alias("b"), F.count_if(F.col("c") & ~F.col("e")).alias("o"), F.count_if(
        F.col("c") | F.col("e")).alias("u"))
    slack = 4 * sketches.DISTINCT_ERROR * F.col("u")
    return got.join(exact).select((F.abs(F.col("both") - F.col("b")) <= slack).alias("both_within"),
                                  (F.abs(F.col("left_only") - F.col("o")) <= slack).alias("only_within"))


sql_query("q7_rollup", """
SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus) AS g1, grouping(o_orderpriority) AS g2,
       count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)
""", "orders")

sql_query("q7_cube", """
SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)
""", "orders")

sql_query("q7_grouping_sets", """
SELECT o_orderstatus, o_orderpriority, count(*) AS n
FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())
""", "orders")

sql_query("q8_window_ranking", """
SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rk,
       dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dr, ntile(3) OVER w AS tile
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
""", "orders")

sql_query("q8_window_frames", """
SELECT event_id, lag(value) OVER w AS prev, lead(value) OVER w AS next, first_value(event_type) OVER w AS first_type,
       round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 4)
         AS sum4,
       count(*) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 100 PRECEDING AND CURRENT ROW) AS near
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
""", "events")

# Few keys, each with a large share of all rows.
HOT_ROWS = 5_000


@query("q8_hot_frames", """
SELECT event_id, round(sum(value) OVER (w ROWS BETWEEN 9 PRECEDING AND 2 FOLLOWING), 4) AS around,
       count(*) OVER (w ROWS BETWEEN 9 PRECEDING AND 2 FOLLOWING) AS n, lag(event_id, 3) OVER w AS third
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)
""")
def hot_frames(spark, t):
    """Frames and a shift along keys that are cut into blocks with halos."""
    events, order = t.events.select("event_id", "event_type", "ts", "value"), ["ts", "event_id"]
    framed = rows_frames(events, ["event_type"], order, {"around": F.sum("value"), "n": F.count(F.lit(1))}, 9, 2, HOT_ROWS)
    return shifted(framed, ["event_type"], order, "event_id", -3, "third", HOT_ROWS).select(
        "event_id", F.round("around", 4).alias("around"), "n", "third")


@query("q8_hot_ranks", """
SELECT event_id, rank() OVER (PARTITION BY event_type ORDER BY user_id) AS rank,
       dense_rank() OVER (PARTITION BY event_type ORDER BY user_id) AS dense_rank,
       CAST(ntile(100) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS INTEGER) AS tile FROM events
""")
def hot_ranks(spark, t):
    """Ranks and tiles from positions and prefix counts."""
    events = t.events.select("event_id", "event_type", "ts", "user_id")
    ranked = ranks(events, ["event_type"], "user_id", rows=HOT_ROWS)
    return ntile(ranked, ["event_type"], ["ts", "event_id"], 100, rows=HOT_ROWS).select("event_id", "rank", "dense_rank", "tile")


sql_query("q9_sort_limit_offset", """
SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 50 OFFSET 10
""", "lineitem")


@query("q9_top_k_per_group", """
SELECT l_returnflag, l_orderkey, l_linenumber, l_extendedprice,
       row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rn
FROM lineitem QUALIFY rn <= 5
""")
def top_k(spark, t):
    lines = t.lineitem.select("l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice")
    return top_k_per_group(lines, ["l_returnflag"],
                           [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 5)


sql_query("q10_set_operations", """
SELECT 'union' AS op, k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) a
UNION ALL
SELECT 'intersect' AS op, k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) b
UNION ALL
SELECT 'except' AS op, k FROM (SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier) c
UNION ALL
SELECT 'except_all' AS op, k FROM (SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier) d
""", "customer supplier nation")

sql_query("q11_cte_subqueries", """
WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey)
SELECT c_custkey, round(total, 2) AS total,
       (SELECT count(*) FROM orders o WHERE o.o_custkey = c_custkey) AS n
FROM customer JOIN big ON o_custkey = c_custkey
WHERE total > (SELECT avg(total) FROM big)
  AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)
""", "customer orders nation")

sql_query("q11_lateral", """
SELECT n_nationkey, s_suppkey, s_acctbal FROM nation, LATERAL (
  SELECT s_suppkey, s_acctbal FROM supplier WHERE s_nationkey = n_nationkey ORDER BY s_acctbal DESC, s_suppkey LIMIT 2) x
""", "nation supplier")

sql_query("q11_recursive_cte", """
WITH RECURSIVE steps(r_regionkey, n) AS (
  SELECT r_regionkey, 1 FROM region UNION ALL SELECT r_regionkey, n + 1 FROM steps WHERE n < 4)
SELECT r_regionkey, n, count(*) AS nations FROM steps JOIN nation ON n_regionkey = r_regionkey AND n_nationkey % 4 < n
GROUP BY r_regionkey, n
""", "region nation")

sql_query("q12_pivot", """
SELECT * FROM (SELECT user_id, event_type, value FROM events)
PIVOT (count(value) FOR event_type IN ('click' AS click, 'view' AS viewed, 'error' AS error))
""", "events", """
SELECT user_id, NULLIF(count(value) FILTER (WHERE event_type = 'click'), 0) AS click,
       NULLIF(count(value) FILTER (WHERE event_type = 'view'), 0) AS viewed,
       NULLIF(count(value) FILTER (WHERE event_type = 'error'), 0) AS error
FROM events GROUP BY user_id
""")

sql_query("q12_unpivot", """
SELECT l_orderkey, l_linenumber, measure, amount FROM lineitem
UNPIVOT (amount FOR measure IN (l_quantity, l_discount, l_tax))
""", "lineitem")


@query("q13_sample", """
SELECT o_orderkey, o_totalprice FROM orders
WHERE ('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8))::BIGINT % 10 < 3
""")
def sample(spark, t):
    return sample_by_hash(t.orders.select("o_orderkey", "o_totalprice"), "o_orderkey", 10, 3)


@query("q13_weighted_sample", """
SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE o_totalprice > 0
QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY
  ln((('0x' || substr(md5('7|' || o_orderkey), 1, 12))::BIGINT + 0.5) / 281474976710656.0::DOUBLE) / o_totalprice DESC, o_orderkey) <= 50
""")
def weighted_sample(spark, t):
    """Fifty orders of every priority, by price."""
    return sample_by_weight(t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice"), ["o_orderpriority"], 50,
                            F.col("o_totalprice"), ["o_orderkey"], 7)


sql_query("q14_scalars", """
SELECT o_orderkey, upper(o_orderstatus) AS up, lower(o_orderpriority) AS lo, substr(o_orderpriority, 3) AS tail,
       concat(o_orderstatus, '-', o_orderpriority) AS tag, length(o_orderpriority) AS len,
       regexp_extract(o_orderpriority, '([0-9])-([A-Z]+)', 2) AS word, year(o_orderdate) AS y,
       month(o_orderdate) AS m, CAST(o_orderdate AS DATE) AS d, floor(o_totalprice / 1000) AS thousands,
       abs(-o_custkey) AS k, coalesce(nullif(o_orderstatus, 'F'), '-') AS st,
       try_cast(o_orderpriority AS INTEGER) AS bad, greatest(o_custkey, 100) AS g
FROM orders
""", "orders", """
SELECT o_orderkey, upper(o_orderstatus) AS up, lower(o_orderpriority) AS lo, substr(o_orderpriority, 3) AS tail,
       concat(o_orderstatus, '-', o_orderpriority) AS tag, length(o_orderpriority) AS len,
       regexp_extract(o_orderpriority, '([0-9])-([A-Z]+)', 2) AS word, year(o_orderdate) AS y,
       month(o_orderdate) AS m, CAST(o_orderdate AS DATE) AS d, CAST(floor(o_totalprice / 1000) AS BIGINT) AS thousands,
       abs(-o_custkey) AS k, coalesce(nullif(o_orderstatus, 'F'), '-') AS st,
       try_cast(o_orderpriority AS INTEGER) AS bad, greatest(o_custkey, 100) AS g
FROM orders
""")

sql_query("q14_text_scalars", """
SELECT doc_id, char_length(text) AS chars, lower(substr(text, 1, 12)) AS head, position('the', text) AS at,
       regexp_like(text, '[0-9]{3}') AS digits, length(regexp_replace(text, '[aeiou]', '')) AS consonants,
       trim(split_part(text, '.', 1)) AS sentence
FROM documents
""", "documents", """
SELECT doc_id, length(text) AS chars, lower(substr(text, 1, 12)) AS head, strpos(text, 'the') AS at,
       regexp_matches(text, '[0-9]{3}') AS digits, length(regexp_replace(text, '[aeiou]', '', 'g')) AS consonants,
       trim(split_part(text, '.', 1), ' ') AS sentence
FROM documents
""")

sql_query("q15_nested", """
SELECT label, count(*) AS n, round(sum(x), 3) AS total, max(pos) AS last_pos
FROM (SELECT label, pos, x FROM embeddings LATERAL VIEW posexplode(embedding) p AS pos, x)
GROUP BY label
""", "embeddings", """
SELECT label, count(*) AS n, round(sum(x::DOUBLE), 3) AS total, CAST(max(pos) AS INTEGER) AS last_pos
FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)
GROUP BY label
""")

sql_query("q15_json_extract", """
SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k,
       size(array(event_id, user_id)) AS pair, named_struct('a', event_type).a AS a FROM events
""", "events", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
       CAST(len([event_id, user_id]) AS INTEGER) AS pair, {'a': event_type}.a AS a FROM events
""")

sql_query("q15_list_agg", """
SELECT o_custkey, array_join(array_sort(collect_list(CAST(o_orderkey AS STRING))), ',') AS keys
FROM orders GROUP BY o_custkey
""", "orders", """
SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY CAST(o_orderkey AS VARCHAR)) AS keys
FROM orders GROUP BY o_custkey
""")
