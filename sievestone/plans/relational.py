"""Relational queries: one text each, which Spark and DuckDB both run. Tables are written in braces."""

SQL = {
    "project_filter": "SELECT l_orderkey, l_quantity * 2 AS doubled, l_extendedprice * (1 - l_discount) AS net FROM {lineitem} WHERE l_quantity BETWEEN 10 AND 20 AND l_returnflag IN ('A', 'R') AND l_discount IS NOT NULL",
    "case_predicates": "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size_class, p_name LIKE '%a%' AS has_a, coalesce(nullif(p_brand, ''), 'none') AS brand FROM {part}",
    "join_inner": "SELECT o_orderkey, c_name, n_name FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey",
    "join_left": "SELECT c_custkey, count(o_orderkey) AS n_orders FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey GROUP BY c_custkey",
    "join_full": "SELECT c.c_custkey AS c_key, s.s_suppkey AS s_key FROM {customer} c FULL OUTER JOIN {supplier} s ON c.c_custkey = s.s_suppkey * 7",
    "join_semi": "SELECT c_custkey, c_name FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 100000)",
    "join_anti": "SELECT c_custkey, c_name FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 400000)",
    "join_theta": "SELECT a.s_suppkey AS a_key, b.s_suppkey AS b_key FROM {supplier} a JOIN {supplier} b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal",
    "join_theta_pure": "SELECT a.s_suppkey AS a_key, r.r_regionkey AS r_key FROM {supplier} a JOIN {region} r ON a.s_acctbal < 1000 * r.r_regionkey AND a.s_nationkey <> r.r_regionkey",
    "agg_pricing": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_net, round(avg(l_quantity), 6) AS avg_qty, count(*) AS n FROM {lineitem} GROUP BY l_returnflag, l_linestatus",
    "agg_grouping_sets": "SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS BIGINT) AS q, count(*) AS n FROM {lineitem} GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())",
    "agg_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "agg_rollup": "SELECT r_name, n_name, count(*) AS n FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)",
    "agg_distinct": "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship FROM {lineitem} GROUP BY l_returnflag",
    "agg_stats": "SELECT c_mktsegment, round(avg(c_acctbal), 6) AS mean, round(stddev_samp(c_acctbal), 6) AS sd, round(var_pop(c_acctbal), 4) AS v, round(corr(c_acctbal, c_nationkey), 8) AS r FROM {customer} GROUP BY c_mktsegment",
    "agg_filter_having": "SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS done FROM {orders} GROUP BY o_custkey HAVING count(*) > 3",
    "window_rank": "SELECT o_orderkey, CAST(rank() OVER w AS BIGINT) AS r, CAST(dense_rank() OVER w AS BIGINT) AS dr, CAST(ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS quarter FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderstatus)",
    "window_frames": "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 4) AS last4, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS so_far, count(*) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 100 PRECEDING AND CURRENT ROW) AS near FROM {events}",
    "window_lag_lead": "SELECT event_id, lag(event_id) OVER w AS before, lead(event_type, 2) OVER w AS after, first_value(event_id) OVER w AS first_id FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY event_id)",
    "topk_sort": "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 100",
    "topk_per_key": "SELECT o_custkey, o_orderkey, rk FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS rk FROM {orders}) t WHERE rk <= 3",
    "set_union": "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey AS k FROM {supplier}",
    "set_union_all": "SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey AS k FROM {supplier}",
    "set_intersect": "SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey AS k FROM {supplier}",
    "set_intersect_all": "SELECT c_nationkey AS k FROM {customer} INTERSECT ALL SELECT s_nationkey AS k FROM {supplier}",
    "set_except_all": "SELECT c_nationkey AS k FROM {customer} EXCEPT ALL SELECT s_nationkey AS k FROM {supplier}",
    "string_functions": "SELECT p_partkey, upper(p_name) AS u, CAST(length(p_name) AS BIGINT) AS n, substring(p_type, 1, 5) AS head, replace(p_brand, '#', '-') AS brand, concat(p_brand, '/', p_type) AS both_names, trim(p_name) AS t, reverse(p_brand) AS back FROM {part}",
    "date_functions": "SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(day(o_orderdate) AS BIGINT) AS d, CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start FROM {orders}",
    "math_functions": "SELECT s_suppkey, round(abs(s_acctbal), 2) AS a, CAST(floor(s_acctbal) AS BIGINT) AS f, CAST(ceil(s_acctbal) AS BIGINT) AS c, round(sqrt(abs(s_acctbal)), 6) AS root, round(ln(abs(s_acctbal) + 1), 6) AS l, CAST(sign(s_acctbal) AS BIGINT) AS s, s_suppkey % 7 AS m FROM {supplier}",
    "shipping_modes": "SELECT o_orderpriority, sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS large, count(*) AS n FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey GROUP BY o_orderpriority",
    "local_revenue": "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON l_orderkey = o_orderkey JOIN {supplier} ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN {nation} ON s_nationkey = n_nationkey GROUP BY n_name",
    "subquery_above_average": "SELECT p_partkey, p_retailprice FROM {part} p WHERE p_retailprice > (SELECT avg(p2.p_retailprice) FROM {part} p2 WHERE p2.p_brand = p.p_brand)",
    "cte_chain": "WITH per_day AS (SELECT CAST(ts AS DATE) AS d, event_type, count(*) AS n FROM {events} GROUP BY CAST(ts AS DATE), event_type), best AS (SELECT d, max(n) AS m FROM per_day GROUP BY d) SELECT per_day.d, event_type, n FROM per_day JOIN best ON per_day.d = best.d AND n = m",
    "distinct_rows": "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM {lineitem}",
}
#: Sums of integers are BIGINT in Spark and wider in DuckDB.
DUCKDB = {"shipping_modes": SQL["shipping_modes"].replace("sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END)", "CAST(sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS BIGINT)")}
