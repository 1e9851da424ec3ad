"""Aggregates, windows, scalar functions, features, metrics: shared SQL texts by operator."""

from .relational import REVIEWS

DAILY = "(SELECT CAST(ts AS DATE) AS d, sum(value) AS v, max(CASE WHEN event_type = 'error' THEN value END) AS sparse FROM events GROUP BY 1)"
LABELLED = "(SELECT doc_id, quality AS label, CASE WHEN n_chars % 3 = 0 THEN 1 - quality ELSE quality END AS pred, CAST(n_chars % 97 AS DOUBLE) / 97 AS score FROM documents JOIN labels USING (doc_id))"

SHARED = {
    "e01_date_parts": "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, dayofmonth(o_orderdate) AS d, CAST(weekday(o_orderdate) AS BIGINT) AS wd FROM orders",
    "e05_hour_bucket": "SELECT event_id, CASE WHEN floor(h / 100) < 6 THEN 0 WHEN floor(h / 100) < 12 THEN 1 WHEN floor(h / 100) < 18 THEN 2 ELSE 3 END AS bucket FROM (SELECT event_id, hour(ts) * 100 + minute(ts) AS h FROM events) t",
    "e06_flags": "SELECT event_id, CASE WHEN month(ts) IN (6, 7, 8) THEN 1 ELSE 0 END AS summer, CASE WHEN hour(ts) IN (7, 8, 9) THEN 1 ELSE 0 END AS rush FROM events",
    "e07_code_category": "SELECT p_partkey, CASE WHEN p_size IN (1, 2, 3, 4, 5) THEN 'small' WHEN p_size IN (6, 7, 8, 9, 10, 11, 12) THEN 'medium' ELSE 'other' END AS category FROM part",
    "e08_code_names": "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' WHEN 'P' THEN 'pending' END AS status FROM orders",
    "e09_recode": "SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 3 END AS class FROM lineitem",
    "e10_prefix": "SELECT c_custkey, substring(c_name, 1, 5) AS prefix FROM customer",
    "e12_coerce_numeric": "SELECT c_custkey, TRY_CAST(CASE WHEN c_custkey % 4 = 0 THEN '(D)' WHEN c_custkey % 4 = 1 THEN '' ELSE CAST(c_custkey AS VARCHAR(20)) END AS DOUBLE) AS v FROM customer",
    "e14_clamp": "SELECT c_custkey, least(greatest(c_acctbal / 1000, 1.0), 5.0) AS v FROM customer",
    "e22_token_flags": "SELECT c_custkey, CASE WHEN regexp_like(c_name, '^[A-Z]') THEN 1 ELSE 0 END AS capital, CASE WHEN regexp_like(c_name, '.*[0-9].*') THEN 1 ELSE 0 END AS digit, CASE WHEN upper(c_name) = c_name THEN 1 ELSE 0 END AS upper_case FROM customer",
    "e25_log10": "SELECT o_orderkey, round(log10(o_totalprice), 8) AS v FROM orders",
    "e26_distances": "SELECT s_suppkey, round(sqrt(pow(s_acctbal * 57.3 / 100, 2) + pow(s_suppkey * 69.1, 2)), 6) AS euclid, round(abs(s_acctbal * 57.3 / 100) + abs(s_suppkey * 69.1), 6) AS manhattan FROM supplier",
    "e27_bounding_box": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_extendedprice BETWEEN 10000 AND 30000",
    "e32_odds": "SELECT s_suppkey, round(CASE WHEN exp(x) <= 1 THEN -1 / exp(x) ELSE exp(x) END, 8) AS odds FROM (SELECT s_suppkey, s_acctbal / 10000 AS x FROM supplier) t",
    "e33_rate": "SELECT c_nationkey, round(count(*) * 1e5 / (SELECT count(*) FROM customer), 6) AS rate FROM customer GROUP BY c_nationkey",
    "e35_line_margin": "SELECT s_suppkey, round(abs(0.6 * s_suppkey + 0.8 * s_acctbal / 100 - 40), 6) AS distance FROM supplier WHERE abs(0.6 * s_suppkey + 0.8 * s_acctbal / 100 - 40) <= 20",
    "g01_basic": "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total, min(o_totalprice) AS low, max(o_totalprice) AS high, round(avg(o_totalprice), 6) AS mean FROM orders WHERE o_custkey IS NOT NULL GROUP BY o_custkey",
    "g02_nunique": "SELECT l_suppkey, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_suppkey",
    "g03_named": "SELECT event_type, min(value) AS min_v, max(value) AS max_v, round(avg(value), 6) AS mean_v FROM events GROUP BY event_type",
    "g04_sum_count": f"SELECT item_id, round(sum(stars) / count(stars), 6) AS mean_stars FROM {REVIEWS} r GROUP BY item_id",
    "g06_group_size": "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "g07_mode": "SELECT user_id, event_type AS mode_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS rn FROM events GROUP BY 1, 2) t WHERE rn = 1",
    "g08_pivot": "SELECT user_id, sum(CASE WHEN event_type = 'click' THEN value END) AS click, sum(CASE WHEN event_type = 'view' THEN value END) AS viewed FROM (SELECT user_id, event_type, round(value, 0) AS value FROM events) t GROUP BY user_id",
    "g10_row_percent": "SELECT user_id, round(1e2 * c / nullif(c + v + e, 0), 6) AS pct_click FROM (SELECT user_id, count(CASE WHEN event_type = 'click' THEN 1 END) AS c, count(CASE WHEN event_type = 'view' THEN 1 END) AS v, count(CASE WHEN event_type = 'error' THEN 1 END) AS e FROM events GROUP BY 1) t",
    "g11_unpivot": "SELECT p_partkey, 'size' AS field, CAST(p_size AS DOUBLE) AS v FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part",
    "g12_one_hot": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS is_f, CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS is_o FROM orders",
    "g13_correlation": "SELECT round(corr(l_quantity, l_extendedprice), 8) AS qty_price, round(corr(l_quantity, l_discount), 8) AS qty_disc, round(corr(l_extendedprice, l_tax), 8) AS price_tax FROM lineitem",
    "g14_regression": "SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 8) AS r2, round(corr(l_extendedprice, l_quantity), 8) AS r FROM lineitem",
    "g15_describe": "SELECT p_brand, count(*) AS n, round(avg(p_retailprice), 6) AS mean, round(stddev_samp(p_retailprice), 6) AS sd, max(p_retailprice) - min(p_retailprice) AS spread, round(percentile(p_retailprice, 0.75) - percentile(p_retailprice, 0.25), 6) AS iqr FROM part GROUP BY p_brand",
    "g16_quantiles": "SELECT event_type, round(percentile(value, 0.25), 6) AS q1, round(percentile(value, 0.5), 6) AS q2, round(percentile(value, 0.75), 6) AS q3, min(value) AS low, max(value) AS high FROM events GROUP BY event_type",
    "g17_variation": "SELECT field, cv FROM (SELECT 'qty' AS field, round(stddev_samp(l_quantity) / avg(l_quantity), 8) AS cv FROM lineitem UNION ALL SELECT 'disc', round(stddev_samp(l_discount) / avg(l_discount), 8) FROM lineitem UNION ALL SELECT 'tax', round(stddev_samp(l_tax) / avg(l_tax), 8) FROM lineitem) t ORDER BY cv DESC, field LIMIT 2",
    "g18_null_fraction": "SELECT round(avg(CASE WHEN quality IS NULL THEN 1e0 ELSE 0e0 END), 8) AS no_quality, round(avg(CASE WHEN text IS NULL THEN 1e0 ELSE 0e0 END), 8) AS no_text FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id",
    "g19_value_counts": "SELECT lang, count(*) AS n FROM documents GROUP BY lang",
    "g20_histogram": "SELECT CAST(least(floor((value - lo) / ((hi - lo) / 10)), 9) AS BIGINT) AS bin, count(*) AS n FROM events CROSS JOIN (SELECT min(value) AS lo, max(value) AS hi FROM events WHERE value IS NOT NULL) r WHERE value IS NOT NULL GROUP BY 1",
    "g21_argmax_column": "SELECT l_orderkey, l_linenumber, CASE WHEN greatest(l_discount, l_tax) = l_discount THEN 'l_discount' ELSE 'l_tax' END AS top FROM lineitem",
    "g23_quantile_cut": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < (SELECT percentile(o_totalprice, 0.95) FROM orders)",
    "g27_confusion": f"SELECT label, pred, count(*) AS n FROM {LABELLED} t GROUP BY 1, 2",
    "g27_metrics": f"SELECT round(avg(CASE WHEN label = pred THEN 1e0 ELSE 0e0 END), 8) AS accuracy, round(count(CASE WHEN label = 1 AND pred = 1 THEN 1 END) / CAST(count(CASE WHEN pred = 1 THEN 1 END) AS DOUBLE), 8) AS precision_1, round(count(CASE WHEN label = 1 AND pred = 1 THEN 1 END) / CAST(count(CASE WHEN label = 1 THEN 1 END) AS DOUBLE), 8) AS recall_1 FROM {LABELLED} t",
    "g30_granularity": "SELECT user_id, CAST(ts AS DATE) AS d, hour(ts) AS h, round(avg(floor(value)), 6) AS v FROM events GROUP BY 1, 2, 3",
    "g32_cross_tab": f"SELECT label, round(avg(CASE WHEN pred = 1 THEN score END), 8) AS pred_1, round(avg(CASE WHEN pred = 0 THEN score END), 8) AS pred_0 FROM {LABELLED} t GROUP BY label",
    "g33_totals_ratio": "SELECT round(sum(est) / sum(act), 8) AS ratio FROM (SELECT user_id, CAST(count(DISTINCT event_type) AS DOUBLE) AS est, CAST(count(*) AS DOUBLE) AS act FROM events GROUP BY 1) t",
    "g34_class_weights": "SELECT lang, round(CAST(sum(count(*)) OVER () AS DOUBLE) / (count(*) OVER () * count(*)), 8) AS weight FROM documents GROUP BY lang",
    "g35_best_parameter": "SELECT brand, m FROM (SELECT p_brand AS brand, round(avg(p_retailprice), 6) AS m, row_number() OVER (ORDER BY avg(p_retailprice) DESC, p_brand) AS rn FROM part GROUP BY p_brand) t WHERE rn = 1",
    "h01_partition_sum": "SELECT s_suppkey, round(sum(s_acctbal) OVER (PARTITION BY s_nationkey), 4) AS total FROM supplier",
    "h02_runs": "SELECT event_id, CAST(sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM (SELECT event_id, user_id, ts, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = event_type THEN 0 ELSE 1 END AS starts FROM events) t",
    "h03_run_bounds": "SELECT event_id, min(value) OVER (PARTITION BY user_id, run) AS low, max(value) OVER (PARTITION BY user_id, run) AS high FROM (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT event_id, user_id, ts, value, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = event_type THEN 0 ELSE 1 END AS starts FROM events) t) u",
    "h04_interval_cleanup": "SELECT o_custkey, o_orderkey, CASE WHEN prior >= s THEN prior + 1 ELSE s END AS s, e FROM (SELECT o_custkey, o_orderkey, s, e, max(e) OVER (PARTITION BY o_custkey ORDER BY s, e DESC, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM (SELECT o_custkey, o_orderkey, CAST(o_orderkey % 400 AS BIGINT) AS s, CAST(o_orderkey % 400 + o_orderkey % 90 AS BIGINT) AS e FROM orders) i) t WHERE prior IS NULL OR e > prior",
    "h05_first_of_equal_dates": "SELECT event_id FROM (SELECT event_id, CAST(ts AS DATE) AS d, lag(CAST(ts AS DATE)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) t WHERE p IS NULL OR p <> d",
    "h06_forward_fill": f"SELECT d, last_value(sparse) IGNORE NULLS OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM {DAILY} t",
    "h08_presence_mask": f"SELECT d, CASE WHEN sparse IS NOT NULL THEN 1 ELSE 0 END AS present, coalesce(sparse, 0) AS v FROM {DAILY} t",
    "h10_chronological_cut": f"SELECT d, CASE WHEN rn <= floor(0.8 * n) THEN 'train' ELSE 'test' END AS part FROM (SELECT d, row_number() OVER (ORDER BY d) AS rn, count(*) OVER () AS n FROM {DAILY} t) x",
    "h11_contiguous_chunks": f"SELECT d, CAST(floor((rn - 1) / ceil(n / 4.0)) AS BIGINT) AS chunk FROM (SELECT d, row_number() OVER (ORDER BY d) AS rn, count(*) OVER () AS n FROM {DAILY} t) x",
    "h12_first_n_per_class": "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents) t WHERE rn <= 20",
    "h13_top_k_per_group": "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) t WHERE rn <= 3",
    "h14_nearest_to_line": "SELECT s_suppkey FROM supplier ORDER BY abs(0.6 * s_suppkey + 0.8 * s_acctbal / 100 - 40), s_suppkey LIMIT 10",
    "h15_best_row": "SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) t WHERE rn = 1",
    "o02_cluster_summary": "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS s1, round(sum(l_quantity * l_quantity), 2) AS q1 FROM lineitem GROUP BY l_returnflag",
    "o08_cluster_labels": "SELECT cluster, lang FROM (SELECT doc_id % 5 AS cluster, lang, row_number() OVER (PARTITION BY doc_id % 5 ORDER BY count(*) DESC, lang) AS rn FROM documents GROUP BY 1, 2) t WHERE rn = 1",
    "p12_polarity": "SELECT event_id, round(CASE WHEN event_type IN ('purchase', 'signup') THEN value / 100 ELSE 1 - value / 100 END, 8) AS score FROM events",
    "p13_outer_merge": "SELECT d, a.v AS click, b.v AS purchase FROM (SELECT CAST(ts AS DATE) AS d, round(avg(value), 6) AS v FROM events WHERE event_type = 'click' GROUP BY 1) a FULL OUTER JOIN (SELECT CAST(ts AS DATE) AS d, round(avg(value), 6) AS v FROM events WHERE event_type = 'purchase' GROUP BY 1) b USING (d)",
    "p15_columns_per_type": "SELECT CAST(ts AS DATE) AS d, round(avg(CASE WHEN event_type = 'click' THEN value END), 6) AS click, round(avg(CASE WHEN event_type = 'view' THEN value END), 6) AS viewed, round(avg(CASE WHEN event_type IN ('click', 'view') THEN value END), 6) AS either FROM events GROUP BY 1",
    "q02_cells": "SELECT l_orderkey, l_linenumber, CAST(least(floor((l_quantity - 1) / 5), 9) * 10 + least(floor(l_discount / 0.011), 9) AS BIGINT) AS cell FROM lineitem",
    "q04_normalised_rate": "SELECT m, round(n / 3e1 * CASE WHEN m IN (6, 7, 8) THEN 9e-1 ELSE 11e-1 END, 8) AS rate FROM (SELECT month(o_orderdate) AS m, count(*) AS n FROM orders GROUP BY 1) t",
    "q05_hot_blocks": "SELECT factor, count(CASE WHEN n > factor * m THEN 1 END) AS hot FROM (SELECT n, avg(n) OVER () AS m FROM (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) a) b CROSS JOIN (SELECT 1e0 AS factor UNION ALL SELECT 11e-1 UNION ALL SELECT 12e-1) f GROUP BY factor",
    "r03_mean_imputation": "SELECT event_id, round(coalesce(CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END, m), 6) AS v FROM events CROSS JOIN (SELECT avg(value) AS m FROM events WHERE event_id % 7 <> 0 AND event_id % 5 <> 0) t",
}
