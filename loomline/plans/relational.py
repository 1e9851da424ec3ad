"""Relational queries, joins, sets: shared SQL texts by operator."""

REVIEWS = "(SELECT o_custkey AS user_id, l_partkey AS item_id, CAST(1 + CAST(l_quantity AS BIGINT) % 5 AS DOUBLE) AS stars, o_orderdate AS ts FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"

SHARED = {
    "a01_like_filter": "SELECT c_custkey, c_name FROM customer WHERE lower(c_mktsegment) LIKE '%build%' AND lower(c_name) LIKE '%1_'",
    "a02_left_join_distinct": "SELECT DISTINCT c_name, c_mktsegment FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 200000",
    "a03_filtered_group_count": "SELECT o_orderpriority, count(*) AS n FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1995-01-01' GROUP BY o_orderpriority ORDER BY n DESC, o_orderpriority",
    "a04_having_key_only": "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) >= 3",
    "a05_left_join_like_date": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderpriority LIKE '%URGENT%' AND CAST(o_orderdate AS DATE) > DATE '1996-03-02'",
    "a06_having_rename": "SELECT l_suppkey AS seller FROM lineitem GROUP BY l_suppkey HAVING count(*) > 500",
    "a07_anti_join": "SELECT c_custkey FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 300000) x ON c_custkey = o_custkey WHERE o_custkey IS NULL",
    "a08_filter_count": "SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_suppkey",
    "a09_rows_at_max": "SELECT DISTINCT p_partkey, p_retailprice FROM part WHERE p_retailprice = (SELECT max(p_retailprice) FROM part)",
    "a10_not_exists": "SELECT DISTINCT a.o_custkey FROM orders a WHERE a.o_orderstatus = 'F' AND NOT EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderstatus = 'P')",
    "a12_avg_over_view": "WITH sells AS (SELECT s_name, p_brand, l_extendedprice FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN part ON l_partkey = p_partkey) SELECT p_brand, round(avg(l_extendedprice), 4) AS avg_price FROM sells GROUP BY p_brand",
    "a13_group_top": "SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 10",
    "a14_join_renamed": "SELECT n_name AS country, r_name AS continent FROM nation JOIN region ON n_regionkey = r_regionkey",
    "a15_join_with_literals": "SELECT n_name, s_name FROM nation JOIN supplier ON n_nationkey = s_nationkey AND n_regionkey = 1 AND s_acctbal > 0",
    "a16_filtered_max": "SELECT max(p_retailprice) AS top FROM part WHERE p_size < 20",
    "a17_intersect": "SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45 INTERSECT SELECT l_suppkey FROM lineitem WHERE l_linestatus = 'O' AND l_quantity < 5",
    "a18_relational_division": "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(CASE WHEN o_orderstatus = 'F' THEN 1 END) > 0 AND count(CASE WHEN o_orderstatus = 'O' THEN 1 END) > 0",
    "a19_range_count": "SELECT count(*) AS n FROM part WHERE p_retailprice BETWEEN 920 AND 950",
    "a20_grouped_max": "SELECT p_brand, max(p_retailprice) AS top FROM part GROUP BY p_brand",
    "a21_join_sort_take": "SELECT c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    "a22_max_having_count": "SELECT p_brand, max(p_retailprice) AS top FROM part WHERE p_size >= 10 GROUP BY p_brand HAVING count(*) >= 5",
    "a23_row_count": "SELECT count(*) AS n FROM orders",
    "a24_year_count": "SELECT count(*) AS n FROM orders WHERE year(o_orderdate) = 1996",
    "a25_distinct_count": "SELECT count(DISTINCT o_custkey) AS n FROM orders",
    "a26_top_keys": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 10",
    "a30_left_join_undefined": "SELECT s_suppkey, coalesce(n_name, 'Undefined') AS nation FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) x ON s_nationkey = n_nationkey",
    "a31_group_average": "SELECT coalesce(n_name, 'Undefined') AS nation, round(avg(s_acctbal), 6) AS avg_bal FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey GROUP BY 1 ORDER BY avg_bal DESC, nation",
    "a32_sorted_top": f"SELECT item_id, round(avg(stars), 6) AS avg_stars FROM {REVIEWS} r GROUP BY item_id ORDER BY avg_stars DESC, item_id LIMIT 10",
    "a33_ratio_of_subqueries": "SELECT a.y AS yr, a.s AS status, round(a.total / b.total, 8) AS ratio FROM (SELECT year(o_orderdate) AS y, o_orderstatus AS s, sum(o_totalprice) AS total FROM orders GROUP BY 1, 2) a LEFT JOIN (SELECT year(o_orderdate) AS y, sum(o_totalprice) AS total FROM orders GROUP BY 1) b ON a.y = b.y ORDER BY 1, 2",
    "a34_multi_key_sum": "SELECT year(o_orderdate) AS yr, o_orderstatus, round(sum(o_totalprice), 2) AS total FROM orders WHERE year(o_orderdate) BETWEEN 1994 AND 1997 GROUP BY 1, 2 ORDER BY 1, 2",
    "a35_windowed_weighted_mean": "SELECT DISTINCT s_nationkey, round(sum(s_acctbal * s_suppkey) OVER (PARTITION BY s_nationkey) / sum(s_suppkey) OVER (PARTITION BY s_nationkey), 6) AS weighted FROM supplier",
    "a36_max_four_keys": "SELECT l_returnflag, l_linestatus, l_linenumber, year(l_shipdate) AS yr, max(l_quantity) AS top FROM lineitem GROUP BY 1, 2, 3, 4",
    "a37_conditional_counts": "SELECT event_type, count(CASE WHEN value < 10 THEN 1 END) AS low, count(CASE WHEN value >= 10 AND value < 50 THEN 1 END) AS middle, count(CASE WHEN value >= 50 THEN 1 END) AS high, count(*) AS total FROM events GROUP BY event_type",
    "a38_outer_complete": "SELECT n_nationkey, coalesce(k, 0) AS n FROM nation FULL OUTER JOIN (SELECT s_nationkey, count(*) AS k FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) s ON n_nationkey = s_nationkey",
    "a40_feature_join": "SELECT n_nationkey, coalesce(s.n, 0) AS suppliers, coalesce(c.n, 0) AS customers, coalesce(o.n, 0) AS orders_placed, coalesce(round(c.bal, 4), 0) AS balance FROM nation LEFT JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) s ON n_nationkey = s.k LEFT JOIN (SELECT c_nationkey AS k, count(*) AS n, sum(c_acctbal) AS bal FROM customer GROUP BY 1) c ON n_nationkey = c.k LEFT JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1) o ON n_nationkey = o.k",
    "b04_select_aggregates": "SELECT o_orderpriority, round(avg(o_totalprice), 4) AS mean_price, max(o_totalprice) AS top, min(o_totalprice) AS low, count(*) AS n FROM orders GROUP BY 1",
    "b06_order_by_ordinal": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 7",
    "b08_filter_project": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 100000 AND o_totalprice <= 150000 AND o_orderstatus <> 'P'",
    "c09_ancestor_walk": "WITH RECURSIVE up(node, anc, depth) AS (SELECT p_partkey, CAST(floor(p_partkey / 3) AS BIGINT), 1 FROM part UNION ALL SELECT node, CAST(floor(anc / 3) AS BIGINT), depth + 1 FROM up WHERE anc > 0) SELECT node, count(*) AS depth FROM up GROUP BY node",
    "d16_range_query": "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice BETWEEN 920 AND 950 ORDER BY p_retailprice, p_partkey",
    "d24_fallback_ladder": "SELECT c_custkey, coalesce(a.v, b.v, g.v) AS estimate FROM customer LEFT JOIN (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) a ON c_custkey = a.k LEFT JOIN (SELECT c_nationkey AS k, max(c_acctbal) AS v FROM customer WHERE c_acctbal > 9500 GROUP BY 1) b ON c_nationkey = b.k CROSS JOIN (SELECT max(c_acctbal) AS v FROM customer) g",
    "f01_inner": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey",
    "f02_inner_three_keys": "SELECT a.l_orderkey, a.l_linenumber, b.l_quantity FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND a.l_partkey = b.l_partkey WHERE a.l_quantity > 48",
    "f03_left_outer": "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P' GROUP BY c_custkey",
    "f04_feature_table": f"SELECT r.user_id, r.item_id, round(u.m, 6) AS user_avg, round(i.m, 6) AS item_avg, u.n AS user_n, i.n AS item_n FROM (SELECT DISTINCT user_id, item_id FROM {REVIEWS} x) r LEFT JOIN (SELECT user_id, avg(stars) AS m, count(*) AS n FROM {REVIEWS} x GROUP BY 1) u ON r.user_id = u.user_id LEFT JOIN (SELECT item_id, avg(stars) AS m, count(*) AS n FROM {REVIEWS} x GROUP BY 1) i ON r.item_id = i.item_id",
    "f06_anti": "SELECT s_suppkey FROM supplier WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity = 50 AND l_returnflag = 'A')",
    "f07_semi": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)",
    "f08_cross_dimensions": "SELECT r_name, p, m FROM region CROSS JOIN (SELECT DISTINCT o_orderpriority AS p FROM orders) x CROSS JOIN (SELECT DISTINCT month(o_orderdate) AS m FROM orders) y",
    "f09_nearest_target": "SELECT c_custkey, round(min(abs(c_acctbal - s_acctbal)), 6) AS gap FROM customer CROSS JOIN supplier GROUP BY c_custkey",
    "f10_cooccurrence": "SELECT a.l_suppkey AS s1, b.l_suppkey AS s2, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2",
    "f13_lookup_join": "SELECT l_orderkey, l_linenumber, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity > 49",
    "i01_full_sort": "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey",
    "i02_bounded_top": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15",
    "i03_sort_by_size": "SELECT o_custkey, count(*) AS n, min(o_orderkey) AS first_order FROM orders GROUP BY o_custkey ORDER BY n, first_order",
    "i04_distinct": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    "i05_drop_duplicates": "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey",
    "i06_union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey AS k FROM supplier",
    "i07_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier",
}
