"""Queries of the DataFrame operators, each with its SQL for DuckDB where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import clusters, graph, learning, mining, sequences
from ..streaming import sketches
from .analytic import LABELLED

WORDS = "list_filter(string_split_regex(trim(lower(regexp_replace(text, '[^a-zA-Z0-9]+', ' ', 'g'))), ' +'), lambda x: x <> '')"
RATINGS = "(SELECT \"user\", item, avg(stars) AS stars FROM (SELECT o_custkey AS \"user\", l_partkey AS item, CAST(1 + CAST(l_quantity AS BIGINT) % 5 AS DOUBLE) AS stars FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY 1, 2)"
EDGES = "(SELECT a.l_suppkey AS src, b.l_suppkey AS dst FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2 HAVING count(*) >= 32)"


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _ratings(spark, d):
    """Mean stars of every customer for every part bought."""
    rows = _t(spark, d, "lineitem").join(_t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    stars = (1 + F.col("l_quantity").cast("long") % 5).cast("double")
    each = rows.select(F.col("o_custkey").alias("user"), F.col("l_partkey").alias("item"), stars.alias("stars"))
    parts = mining.tasks(_t(spark, d, "lineitem"))
    if parts > spark.sparkContext.defaultParallelism:  # nearly as many pairs as lines: a task holds those of its part
        each = each.repartition(parts, "user", "item")
    return each.groupBy("user", "item").agg(F.avg("stars").alias("stars"))


def _edges(spark, d):
    return graph.cooccurrence_edges(_t(spark, d, "lineitem"), "l_suppkey", "l_orderkey", 32)


def _tokens(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.filter(T.tokens(F.col("text")), lambda x: x != "").alias("tokens"))


def _texts(spark, d):
    return _t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def _vectors(spark, d):
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")


def _tagged(spark, d):
    e = _t(spark, d, "events")
    return e.select(F.col("user_id").alias("sent"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("idx"), F.concat(F.lit("w"), F.floor(F.col("value") / 10).cast("long").cast("string")).alias("word"), F.col("event_type").alias("tag"))


TAGGED = "(SELECT user_id AS sent, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS idx, 'w' || CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR) AS word, event_type AS tag FROM events)"


def _partitions(spark, d):
    o = _t(spark, d, "orders").repartition(8, "o_custkey").withColumn("part", F.spark_partition_id())
    return o.groupBy("part").agg(F.count("*").alias("n"))


def _by_first_char(spark, d):
    s = _t(spark, d, "customer").withColumn("part", F.pmod(F.ascii("c_mktsegment"), F.lit(4)))
    return s.repartitionById(4, F.col("part")).groupBy("part", F.spark_partition_id().alias("at")).agg(F.count("*").alias("n"))


def _bootstrap(spark, d):
    v = _t(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    u = (F.pmod(F.xxhash64("s_suppkey", "b"), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    weight = F.when(u < 0.367879, 0).when(u < 0.735759, 1).when(u < 0.919699, 2).when(u < 0.981012, 3).when(u < 0.996340, 4).otherwise(5)
    w = v.crossJoin(spark.range(200).withColumnRenamed("id", "b")).withColumn("w", weight)
    sd = w.groupBy("b").agg(F.sqrt((F.sum(F.col("w") * F.col("s_acctbal") ** 2) - F.pow(F.sum(F.col("w") * F.col("s_acctbal")), 2) / F.sum("w")) / (F.sum("w") - 1)).alias("sd"))
    return sd.agg(F.percentile("sd", F.lit(0.05)).alias("low"), F.percentile("sd", F.lit(0.95)).alias("high"))


def _studentized(spark, d):
    p = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    s = p.agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"), F.regr_sxx("y", "x").alias("sxx"), (F.regr_syy("y", "x") * (1 - F.regr_r2("y", "x"))).alias("sse"))
    r = p.crossJoin(F.broadcast(s)).withColumn("r", F.col("y") - F.col("a") - F.col("b") * F.col("x")).withColumn("h", 1 / F.col("n") + (F.col("x") - F.col("mx")) ** 2 / F.col("sxx"))
    left = (F.col("sse") - F.col("r") ** 2 / (1 - F.col("h"))) / (F.col("n") - 3)
    return r.withColumn("t", F.col("r") / F.sqrt(left * (1 - F.col("h")))).where("abs(t) > 1.6").select("l_orderkey", "l_linenumber")


def _ols(spark, d):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rows = VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(_t(spark, d, "lineitem").select("l_quantity", F.col("l_extendedprice").alias("label")))
    m = LinearRegression(solver="normal").fit(rows)
    return spark.range(1).select(F.lit(round(float(m.coefficients[0]), 4)).alias("slope"), F.lit(round(float(m.intercept), 2)).alias("intercept"))


def _classifier(make):
    def run(spark, d):
        from pyspark.ml.functions import array_to_vector

        v = _vectors(spark, d).select("id", array_to_vector("v").alias("features"), (F.col("label") % 2).cast("double").alias("label"))
        train = v.where(F.pmod(F.xxhash64("id"), F.lit(5)) > 0)
        return make().fit(train).transform(v).groupBy("label", "prediction").agg(F.count("*").alias("n"))

    return run


def _ml(module, name, **kw):
    def make():
        import importlib

        return getattr(importlib.import_module(f"pyspark.ml.{module}"), name)(**kw)

    return make


def _panel(spark, d):
    grid = spark.range(10).select(F.col("id").alias("x")).crossJoin(spark.range(10).select(F.col("id").alias("y"))).select((F.col("x") * 10 + F.col("y")).alias("cell"))
    cells = _t(spark, d, "lineitem").select((F.least(F.floor((F.col("l_quantity") - 1) / 5), F.lit(9)) * 10 + F.least(F.floor(F.col("l_discount") / 0.011), F.lit(9))).cast("long").alias("cell"))
    return grid.join(cells.groupBy("cell").agg(F.count("*").alias("n")), "cell", "left").fillna(0, ["n"])


def _item_asks(r):
    """Every rated pair; its own rating takes no part in the prediction of items."""
    return r.select("user", "item")


def _knn_sets(spark, d):
    """Every vector: one fold of five is tested, the other four train."""
    v = _vectors(spark, d)
    return v.where("id % 5 > 0"), v.where("id % 5 = 0")


def _split(spark, d):
    return sequences.tiles(_t(spark, d, "supplier").select("s_suppkey", "s_name"), 5, "s_name", "s_suppkey")


def _auc(spark, d):
    """The score and label of LABELLED as frames."""
    rows = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id").select("doc_id", F.col("quality").alias("label"), (F.col("n_chars") % 97 / 97).alias("score"))
    return learning.auc(rows, "score", "label", "doc_id").select(F.round("auc", 8).alias("auc"))


def _asof(spark, d):
    """Last purchase value known at every error, by user."""
    e = _t(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return e.withColumn("known", F.last(F.when(F.col("event_type") == "purchase", F.col("value")), ignorenulls=True).over(w)).where("event_type = 'error'").select("event_id", "known")


def _daily(spark, d):
    return _t(spark, d, "events").groupBy(F.to_date("ts").alias("d")).agg(F.round(F.sum("value"), 4).alias("v"), F.max(F.when((F.col("event_type") == "error") & (F.col("value") > 95), F.col("value"))).alias("sparse"))


DAILY = "(SELECT CAST(ts AS DATE) AS d, round(sum(value), 4) AS v, max(CASE WHEN event_type = 'error' AND value > 95 THEN value END) AS sparse FROM events GROUP BY 1)"

PEARSON = f"(SELECT a.item AS a, b.item AS b, count(*) AS n, CASE WHEN count(*) < 2 THEN 0.0 ELSE coalesce((count(*) * sum(a.stars * b.stars) - sum(a.stars) * sum(b.stars)) / nullif(sqrt(greatest((count(*) * sum(a.stars * a.stars) - sum(a.stars) * sum(a.stars)) * (count(*) * sum(b.stars * b.stars) - sum(b.stars) * sum(b.stars)), 0.0)), 0), 0.0) END AS corr FROM {RATINGS} a JOIN {RATINGS} b ON a.\"user\" = b.\"user\" AND a.item < b.item GROUP BY 1, 2)"

LABELS = f"WITH u AS MATERIALIZED (SELECT src, dst FROM {EDGES} UNION SELECT dst, src FROM {EDGES}), l0 AS (SELECT DISTINCT src AS node, src AS label FROM u)" + "".join(f", l{k} AS (SELECT src AS node, label FROM (SELECT u.src, l.label, row_number() OVER (PARTITION BY u.src ORDER BY count(*) DESC, l.label) AS nth FROM u JOIN l{k - 1} l ON l.node = u.dst GROUP BY 1, 2) WHERE nth = 1)" for k in range(1, 6)) + " SELECT node, label FROM l5"

# levels by a closure, then the counts of paths level by level
PATHS = f"WITH RECURSIVE u AS MATERIALIZED (SELECT src, dst FROM {EDGES} UNION SELECT dst, src FROM {EDGES}), r AS (SELECT src AS root, src AS node, 0 AS level FROM u UNION SELECT r.root, u.dst, r.level + 1 FROM r JOIN u ON r.node = u.src WHERE r.level + 1 < (SELECT count(DISTINCT src) FROM u)), d AS MATERIALIZED (SELECT root, node, min(level) AS level FROM r GROUP BY 1, 2), p AS (SELECT root, node, level, CAST(1 AS BIGINT) AS paths FROM d WHERE level = 0 UNION ALL SELECT p.root, d.node, d.level, CAST(sum(p.paths) AS BIGINT) FROM p JOIN u ON u.src = p.node JOIN d ON d.root = p.root AND d.node = u.dst AND d.level = p.level + 1 GROUP BY 1, 2, 3)"

# name: (Spark query, SQL or None)
DERIVED = {
    "a11_create_view": (lambda s, d: (_t(s, d, "supplier").createOrReplaceTempView("sup_view"), s.sql("SELECT s_nationkey, count(*) AS n FROM sup_view GROUP BY 1"))[1], "SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1"),
    "a28_partition_sizes": (_partitions, None),
    "a29_custom_partitioner": (_by_first_char, None),
    "c03_put_split": (lambda s, d: _split(s, d).select("s_suppkey", "part_id"), "SELECT s_suppkey, ntile(5) OVER (ORDER BY s_name, s_suppkey) AS part_id FROM supplier"),
    "c05_read_partition": (lambda s, d: _split(s, d).where("part_id = 2").select("s_suppkey"), "SELECT s_suppkey FROM (SELECT s_suppkey, ntile(5) OVER (ORDER BY s_name, s_suppkey) AS part_id FROM supplier) t WHERE part_id = 2"),
    "e02_epoch_ms": (lambda s, d: _t(s, d, "orders").select("o_orderkey", T.epoch_ms(F.col("o_orderkey") * 86400123).alias("t")), "SELECT o_orderkey, strftime(make_timestamp(o_orderkey * 86400123 * 1000), '%m/%d/%Y %H:%M') AS t FROM orders"),
    "e03_date_hour": (lambda s, d: _t(s, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.date_format("ts", "HH").alias("hour")), "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%H') AS hour FROM events"),
    "e04_display_date": (lambda s, d: _t(s, d, "events").select("event_id", F.date_format("ts", "dd-MMM").alias("day")), "SELECT event_id, strftime(ts, '%d-%b') AS day FROM events"),
    "e11_permissions": (lambda s, d: s.range(512).select("id", T.permission(F.lpad(F.conv(F.col("id").cast("string"), 10, 8), 3, "0"), F.col("id") % 2 == 0).alias("p")), "SELECT id, CASE WHEN id % 2 = 0 THEN 'd' ELSE '-' END || list_aggregate([CASE WHEN (id >> (8 - i)) & 1 = 1 THEN ['r','w','x'][i % 3 + 1] ELSE '-' END for i in range(9)], 'string_agg', '') AS p FROM range(512) t(id)"),
    "e13_round_half_even": (lambda s, d: _t(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.bround(F.col("l_quantity") / 2).cast("long").alias("v")), "SELECT l_orderkey, l_linenumber, CAST(round_even(l_quantity / 2, 0) AS BIGINT) AS v FROM lineitem"),
    "e16_clean_text": (lambda s, d: _t(s, d, "pages").select("page_id", T.clean(F.col("html"), False).alias("clean")), "SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(html), '<[^>]*>', ' ', 'g'), 'https?://\\S+|www\\.\\S+', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS clean FROM pages"),
    "e17_letters_only": (lambda s, d: _t(s, d, "benchmark").select("item_id", T.letters_only(F.col("text")).alias("t")), "SELECT item_id, trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')) AS t FROM benchmark"),
    "e18_stop_words": (lambda s, d: _tokens(s, d).select("doc_id", F.size(T.without(F.col("tokens"), ["the", "of", "and", "to"])).cast("long").alias("n")), f"SELECT doc_id, CAST(len(list_filter({WORDS}, lambda y: y NOT IN ('the', 'of', 'and', 'to'))) AS BIGINT) AS n FROM documents"),
    "e20_length_stats": (lambda s, d: _tokens(s, d).select(F.size("tokens").alias("n")).agg(F.round(F.avg("n"), 6).alias("mean"), F.round(F.stddev_samp("n"), 6).alias("sd"), F.percentile("n", F.lit(0.7)).alias("p70")), f"SELECT round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS sd, CAST(quantile_cont(n, 0.7) AS DOUBLE) AS p70 FROM (SELECT len({WORDS}) AS n FROM documents)"),
    "e21_unique_words": (lambda s, d: _tokens(s, d).select(F.explode("tokens").alias("w")).agg(F.count_distinct("w").alias("n")), f"SELECT count(DISTINCT w) AS n FROM (SELECT unnest({WORDS}) AS w FROM documents)"),
    "e23_fixed_length": (lambda s, d: _tokens(s, d).select("doc_id", F.concat_ws(" ", T.fixed_length(F.col("tokens"), 6, F.lit("<pad>"))).alias("t")), f"SELECT doc_id, array_to_string(list_concat({WORDS}, ['<pad>','<pad>','<pad>','<pad>','<pad>','<pad>'])[1:6], ' ') AS t FROM documents"),
    "e28_hamming": (lambda s, d: _t(s, d, "labels").select("doc_id", T.hamming(F.array("quality", "toxic"), F.array(F.lit(1), F.lit(0))).cast("long").alias("h")), "SELECT doc_id, CAST((quality <> 1) AS BIGINT) + CAST((toxic <> 0) AS BIGINT) AS h FROM labels"),
    "e29_cosine": (lambda s, d: _vectors(s, d).crossJoin(F.broadcast(_vectors(s, d).where("id = 0").select(F.col("v").alias("w")))).select("id", F.round(T.cosine(F.col("v"), F.col("w")), 6).alias("c")), "SELECT vec_id AS id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(z.w AS DOUBLE[])), 6) AS c FROM embeddings e CROSS JOIN (SELECT embedding AS w FROM embeddings WHERE vec_id = 0) z"),
    "e31_chunks": (lambda s, d: _t(s, d, "documents").select("doc_id", F.posexplode(T.chunks(F.col("text"))).alias("i", "c")).select("doc_id", "i", F.char_length("c").alias("n")), "SELECT doc_id, CAST(i AS INTEGER) AS i, CAST(least(512, length(text) - i * 512) AS INTEGER) AS n FROM (SELECT doc_id, text, unnest(range(CAST(greatest(ceil(length(text) / 512.0), 1) AS BIGINT))) AS i FROM documents)"),
    "f11_lsh_join": (lambda s, d: mining.minhash_pairs(_t(s, d, "lineitem"), "l_orderkey", "l_suppkey", 0.5, 20, 3).agg(F.count("*").alias("n")), None),
    "f12_asof": (_asof, "SELECT event_id, last_value(p IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS known FROM (SELECT *, CASE WHEN event_type = 'purchase' THEN value END AS p FROM events) QUALIFY event_type = 'error'"),
    "g09_pivot_sum": (lambda s, d: _t(s, d, "events").groupBy("user_id").pivot("event_type", ["click", "view", "error"]).agg(F.count("event_id")).select("user_id", F.coalesce("click", F.lit(0)).alias("click"), F.coalesce("view", F.lit(0)).alias("viewed"), F.coalesce("error", F.lit(0)).alias("error")), "SELECT user_id, count(CASE WHEN event_type = 'click' THEN 1 END) AS click, count(CASE WHEN event_type = 'view' THEN 1 END) AS viewed, count(CASE WHEN event_type = 'error' THEN 1 END) AS error FROM events GROUP BY 1 HAVING true"),
    "g25_keyword_search": (lambda s, d: _tokens(s, d).select("doc_id", F.explode(F.array_distinct("tokens")).alias("w")).where(F.col("w").isin("the", "license", "of")).groupBy("doc_id").agg(F.count("*").alias("hits")).orderBy(F.desc("hits"), F.desc("doc_id")), f"SELECT doc_id, count(*) AS hits FROM (SELECT doc_id, unnest(list_distinct({WORDS})) AS w FROM documents) WHERE w IN ('the', 'license', 'of') GROUP BY 1"),
    "g28_auc": (_auc, f"SELECT round((sum(CASE WHEN label = 1 THEN r END) - count(CASE WHEN label = 1 THEN 1 END) * (count(CASE WHEN label = 1 THEN 1 END) + 1) / 2.0) / CAST(count(CASE WHEN label = 1 THEN 1 END) * count(CASE WHEN label = 0 THEN 1 END) AS DOUBLE), 8) AS auc FROM (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM {LABELLED} t) x"),
    "g29_bootstrap": (_bootstrap, None),
    "g31_studentized_outliers": (_studentized, "WITH s AS (SELECT count(*) AS n, avg(l_quantity) AS mx, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_syy(l_extendedprice, l_quantity) * (1 - regr_r2(l_extendedprice, l_quantity)) AS sse FROM lineitem), r AS (SELECT l_orderkey, l_linenumber, l_extendedprice - a - b * l_quantity AS r, 1.0 / n + pow(l_quantity - mx, 2) / sxx AS h, n, sse FROM lineitem CROSS JOIN s) SELECT l_orderkey, l_linenumber FROM r WHERE abs(r / sqrt((sse - r * r / (1 - h)) / (n - 3) * (1 - h))) > 1.6"),
    "h07_fill_limited": (lambda s, d: sequences.forward_fill(_daily(s, d), "sparse", ["d"], limit=2).select("d", "sparse"), f"SELECT d, last_value(sparse IGNORE NULLS) OVER (ORDER BY d ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS sparse FROM {DAILY}"),
    "h09_lookback": (lambda s, d: sequences.lookback(_daily(s, d), "v", ["d"], 3).select("d", "v", F.round(F.col("past")[0], 4).alias("p3"), F.round(F.col("past")[2], 4).alias("p1")), f"SELECT d, v, p3, p1 FROM (SELECT d, v, lag(v, 3) OVER (ORDER BY d) AS p3, lag(v, 1) OVER (ORDER BY d) AS p1 FROM {DAILY}) WHERE p3 IS NOT NULL"),
    "h16_vocabulary_rank": (lambda s, d: _tokens(s, d).select(F.explode("tokens").alias("w")).groupBy("w").agg(F.count("*").alias("n")).transform(sequences.positions, F.desc("n"), F.asc("w"), name="rank").withColumn("rank", F.col("rank").cast("int")), f"SELECT w, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, w) AS INTEGER) AS rank FROM (SELECT unnest({WORDS}) AS w FROM documents) GROUP BY 1"),
    "h17_tag_bigrams": (lambda s, d: _tagged(s, d).select("sent", "idx", F.lag("tag", 1, "start").over(Window.partitionBy("sent").orderBy("idx")).alias("before"), "tag"), f"SELECT sent, idx, lag(tag, 1, 'start') OVER (PARTITION BY sent ORDER BY idx) AS before, tag FROM {TAGGED}"),
    "j01_baskets": (lambda s, d: mining.baskets(_t(s, d, "lineitem"), "l_suppkey", "l_partkey").select("l_suppkey", F.size("items").cast("long").alias("n")), "SELECT l_suppkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1"),
    "j03_large_baskets": (lambda s, d: mining.baskets(_t(s, d, "lineitem"), "l_orderkey", "l_suppkey").where(F.size("items") > 6).select("l_orderkey"), "SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 6"),
    "j05_pair_buckets": (lambda s, d: mining.pair_buckets(_t(s, d, "lineitem"), "l_orderkey", "l_suppkey"), "WITH b AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS i FROM lineitem) SELECT (47 * (a.i + b.i) + 19) % 49 AS bucket, count(*) AS n FROM b a JOIN b ON a.k = b.k AND a.i < b.i GROUP BY 1"),
    "j06_frequent_buckets": (lambda s, d: mining.pair_buckets(_t(s, d, "lineitem"), "l_orderkey", "l_suppkey").where("n >= 1500").select("bucket"), "WITH b AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS i FROM lineitem) SELECT (47 * (a.i + b.i) + 19) % 49 AS bucket FROM b a JOIN b ON a.k = b.k AND a.i < b.i GROUP BY 1 HAVING count(*) >= 1500"),
    "k01_jaccard": (lambda s, d: mining.jaccard(_t(s, d, "lineitem"), "l_suppkey", "l_orderkey", 0.02).select("a", "b", F.round("similarity", 8).alias("similarity")), "WITH o AS (SELECT DISTINCT l_suppkey AS k, l_orderkey AS i FROM lineitem), n AS (SELECT k, count(*) AS n FROM o GROUP BY 1), p AS (SELECT x.k AS a, y.k AS b, count(*) AS c FROM o x JOIN o y ON x.i = y.i AND x.k < y.k GROUP BY 1, 2) SELECT a, b, round(CAST(c AS DOUBLE) / (m.n + q.n - c), 8) AS similarity FROM p JOIN n m ON m.k = a JOIN n q ON q.k = b WHERE CAST(c AS DOUBLE) / (m.n + q.n - c) >= 0.02"),
    "k03_minhash": (lambda s, d: mining.minhash_pairs(_t(s, d, "lineitem"), "l_orderkey", "l_suppkey", 0.5, 50, 3).agg(F.count("*").alias("pairs")), None),
    "k08_knn": (lambda s, d: mining.knn(*_knn_sets(s, d), 5), "WITH tr AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings WHERE vec_id % 5 > 0), te AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 5 = 0), p AS (SELECT te.vec_id AS id, tr.label, row_number() OVER (PARTITION BY te.vec_id ORDER BY list_distance(te.v, tr.v), tr.vec_id) AS nth FROM te CROSS JOIN tr), c AS (SELECT id, label, count(*) AS w FROM p WHERE nth <= 5 GROUP BY 1, 2) SELECT id, label AS prediction FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY w DESC, label) = 1"),
    "k09_knn_regression": (lambda s, d: mining.knn_regression(*_knn_sets(s, d), 5).select("id", F.round("prediction", 6).alias("prediction")), "WITH tr AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings WHERE vec_id % 5 > 0), te AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 5 = 0) SELECT id, round(avg(label), 6) AS prediction FROM (SELECT te.vec_id AS id, tr.label, row_number() OVER (PARTITION BY te.vec_id ORDER BY list_distance(te.v, tr.v), tr.vec_id) AS nth FROM te CROSS JOIN tr) WHERE nth <= 5 GROUP BY 1"),
    "k02_dense_ids": (lambda s, d: _t(s, d, "lineitem").select(F.col("l_suppkey").alias("k")).distinct().transform(sequences.positions, "k", name="nth").select("k", (F.col("nth") - 1).cast("int").alias("idx")), "SELECT k, dense_rank() OVER (ORDER BY k) - 1 AS idx FROM (SELECT DISTINCT l_suppkey AS k FROM lineitem) t"),
    "l01_pearson": (lambda s, d: mining.pearson(_ratings(s, d)).select("a", "b", "n", F.round("corr", 6).alias("corr")), f"SELECT a, b, n, round(corr, 6) AS corr FROM {PEARSON}"),
    "m01_cooccurrence_graph": (_edges, f"SELECT src, dst FROM {EDGES}"),
    "m02_adjacency": (lambda s, d: graph.adjacency(_edges(s, d)).select("src", F.concat_ws(",", F.col("neighbours").cast("array<string>")).alias("neighbours")), f"SELECT src, array_to_string(list_sort(list(dst)), ',') AS neighbours FROM (SELECT src, dst FROM {EDGES} UNION SELECT dst, src FROM {EDGES}) GROUP BY 1"),
    "m03_label_propagation": (lambda s, d: graph.label_propagation(_edges(s, d)), LABELS),
    "m04_shortest_paths": (lambda s, d: graph.shortest_paths(_edges(s, d)), f"{PATHS} SELECT root, node, level, paths FROM p"),
    "m06_betweenness": (lambda s, d: graph.betweenness(_edges(s, d)).orderBy(F.desc("betweenness"), "src", "dst"), f"{PATHS} SELECT least(u.src, u.dst) AS src, greatest(u.src, u.dst) AS dst, round(sum(CAST(a.paths * b.paths AS DOUBLE) / t.paths) / 2, 5) AS betweenness FROM u JOIN p a ON a.node = u.src JOIN p b ON b.root = u.dst JOIN p t ON t.root = a.root AND t.node = b.node AND t.level = a.level + 1 + b.level GROUP BY 1, 2"),
    "m07_girvan_newman": (lambda s, d: graph.girvan_newman(_edges(s, d)), None),
    "m08_modularity": (lambda s, d: graph.modularity(_edges(s, d), graph.both_ways(_edges(s, d)).select(F.col("src").alias("node"), (F.col("src") % 2).alias("c")).distinct()), f"WITH e AS (SELECT * FROM {EDGES}), u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), k AS (SELECT src AS node, src % 2 AS c, CAST(count(*) AS DOUBLE) AS k FROM u GROUP BY 1), m AS (SELECT count(*) / 2.0 AS m FROM u), kk AS (SELECT sum(x) AS kk FROM (SELECT (sum(k) * sum(k) - sum(k * k)) / 2 AS x FROM k GROUP BY c)), i AS (SELECT count(*) AS e FROM e WHERE src % 2 = dst % 2) SELECT round((i.e - kk.kk / (2 * m.m)) / (2 * m.m), 8) AS q FROM i, kk, m"),
    "m09_components": (lambda s, d: graph.components(_edges(s, d)), f"WITH RECURSIVE u AS (SELECT src, dst FROM {EDGES} UNION SELECT dst, src FROM {EDGES}), r AS (SELECT src AS node, src AS reach FROM u UNION SELECT r.node, u.dst FROM r JOIN u ON r.reach = u.src) SELECT node, min(reach) AS component FROM r GROUP BY 1"),
    "n02_bloom": (lambda s, d: sketches.bloom_false_positives(sketches.numbered(_t(s, d, "orders"), 1000, "o_orderdate", "o_orderkey"), "o_custkey"), None),
    "n03_flajolet_martin": (lambda s, d: sketches.flajolet_martin(sketches.numbered(_t(s, d, "orders"), 3000, "o_orderdate", "o_orderkey"), "o_custkey"), None),
    "n04_reservoir": (lambda s, d: sketches.reservoir(_t(s, d, "events"), "event_id"), None),
    "n06_windowed_counts": (lambda s, d: sketches.windowed_counts(_t(s, d, "events"), "ts", "event_type").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n"), "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
    "o01_bfr": (lambda s, d: clusters.bfr(_vectors(s, d), 64, 10)[0].groupBy("c").agg(F.count("*").alias("n")), None),
    "p01_vocabulary": (lambda s, d: _tagged(s, d).groupBy("word").agg(F.count("*").alias("n")).groupBy(F.when(F.col("n") <= 3, "< unk >").otherwise(F.col("word")).alias("word")).agg(F.sum("n").alias("n")), f"SELECT CASE WHEN n <= 3 THEN '< unk >' ELSE word END AS word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT word, count(*) AS n FROM {TAGGED} GROUP BY 1) GROUP BY 1"),
    "p02_transitions": (lambda s, d: sequences.transitions(_tagged(s, d)).select("before", "tag", F.round("p", 8).alias("p")), f"SELECT before, tag, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY before) AS DOUBLE), 8) AS p FROM (SELECT lag(tag, 1, 'start') OVER (PARTITION BY sent ORDER BY idx) AS before, tag FROM {TAGGED}) GROUP BY 1, 2"),
    "p03_emissions": (lambda s, d: sequences.emissions(_tagged(s, d)).select("tag", "word", F.round("p", 8).alias("p")), f"SELECT tag, word, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY tag) AS DOUBLE), 8) AS p FROM {TAGGED} GROUP BY 1, 2"),
    "p04_greedy_decode": (lambda s, d: sequences.decode(_tagged(s, d), _tagged(s, d).select("sent", "idx", "word"), False), None),
    "p05_viterbi_decode": (lambda s, d: sequences.decode(_tagged(s, d), _tagged(s, d).select("sent", "idx", "word")), None),
    "p07_tfidf": (lambda s, d: sequences.tfidf(_texts(s, d), 200).select("id", "word", F.round("w", 6).alias("w")), f"WITH t AS (SELECT doc_id AS id, w AS word, count(*) AS tf FROM (SELECT doc_id, unnest({WORDS}) AS w FROM documents) GROUP BY 1, 2), s AS (SELECT word, count(*) AS df FROM t GROUP BY 1 ORDER BY sum(tf) DESC, word LIMIT 200), x AS (SELECT id, t.word, tf * (ln((1.0 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM t JOIN s ON t.word = s.word) SELECT id, word, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS w FROM x"),
    "p10_stratified_sample": (lambda s, d: _t(s, d, "documents").withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64(F.lit(1), "doc_id"), "doc_id"))).where("nth <= 25").groupBy("lang").agg(F.count("*").alias("n")), "SELECT lang, least(count(*), 25) AS n FROM documents GROUP BY 1"),
    "q01_grid": (lambda s, d: s.range(8).select(F.col("id").alias("x")).crossJoin(s.range(6).select(F.col("id").alias("y"))).select((F.col("x") * 6 + F.col("y")).alias("cell"), (F.col("x") + 0.5).cast("double").alias("cx"), (F.col("y") + 0.5).cast("double").alias("cy")), "SELECT x * 6 + y AS cell, CAST(x + 0.5 AS DOUBLE) AS cx, CAST(y + 0.5 AS DOUBLE) AS cy FROM range(8) a(x) CROSS JOIN range(6) b(y)"),
    "q03_panel": (_panel, "SELECT g.cell, coalesce(n, 0) AS n FROM (SELECT x * 10 + y AS cell FROM range(10) a(x) CROSS JOIN range(10) b(y)) g LEFT JOIN (SELECT CAST(least(floor((l_quantity - 1) / 5), 9) * 10 + least(floor(l_discount / 0.011), 9) AS BIGINT) AS cell, count(*) AS n FROM lineitem GROUP BY 1) c ON g.cell = c.cell"),
    "r04_ols": (_ols, "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem"),
    "r05_logistic": (_classifier(_ml("classification", "LogisticRegression", regParam=0.01)), None),
    "r06_random_forest": (_classifier(_ml("classification", "RandomForestClassifier", numTrees=10, seed=1)), None),
    "r07_linear_svm": (_classifier(_ml("classification", "LinearSVC", maxIter=10)), None),
    "r08_naive_bayes": (_classifier(_ml("classification", "NaiveBayes", modelType="gaussian")), None),
}
