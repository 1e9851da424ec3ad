"""More queries: texts shared by both engines, and DataFrame operators with their SQL."""

from __future__ import annotations

from collections import Counter
from hashlib import md5

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import clusters, learning, mining, sequences
from ..operators.graph import checkpointed
from .analytic import REVIEWS
from .derived import PEARSON, RATINGS, TAGGED, WORDS, _knn_sets, _ratings, _t, _tagged, _texts, _tokens, _vectors
from .dialect import views

# numbered rows without a window over the whole table: places within a day, after the rows of earlier days
NUMBERED = "(SELECT e.*, earlier + row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS nth FROM events e JOIN (SELECT day, sum(c) OVER (ORDER BY day) - c AS earlier FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS c FROM events GROUP BY 1) x) o ON CAST(e.ts AS DATE) = o.day)"
# a fold of five and a share of four fifths by seeded hash within a class
RANKED = "(SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY md5(concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING), '/0')), l_extendedprice) AS nth, count(*) OVER (PARTITION BY l_returnflag) AS class_size FROM lineitem)"
FOLD_SUMS = "(SELECT fold, sum(CAST(1 AS DOUBLE)) AS n, sum(l_quantity) AS x, sum(l_extendedprice) AS y, sum(l_quantity * l_quantity) AS xx, sum(l_quantity * l_extendedprice) AS xy, sum(l_extendedprice * l_extendedprice) AS yy FROM (SELECT *, (nth - 1) % 5 AS fold FROM " + RANKED + " r) f GROUP BY fold)"

SHARED = {
    "a39_range_filter_lookups": "SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey WHERE c_nationkey BETWEEN 2 AND 20 AND c_acctbal BETWEEN 0 AND 5000 AND c_mktsegment BETWEEN 'B' AND 'H'",
    "f05_full_outer": "SELECT coalesce(a.k, b.k) AS nation, a.n AS suppliers, b.n AS customers FROM (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 8000 GROUP BY 1) a FULL OUTER JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal < -800 GROUP BY 1) b ON a.k = b.k",
    "g22_threshold_flag": "SELECT user_id, n, CASE WHEN n > 1.2 * mean THEN 1 ELSE 0 END AS hot FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) t CROSS JOIN (SELECT count(*) / CAST(count(DISTINCT user_id) AS DOUBLE) AS mean FROM events) m",
    "g26_rmse": f"SELECT round(sqrt(avg(pow(stars - coalesce(p, 3), 2))), 8) AS rmse, round(avg(pow(stars - coalesce(p, 3), 2)), 8) AS mse, count(p) AS predicted FROM {REVIEWS} r LEFT JOIN (SELECT item_id AS item, avg(stars) AS p FROM {REVIEWS} q GROUP BY 1 HAVING count(*) >= 3) m ON r.item_id = m.item",
    "l06_hybrid": f"SELECT user_id, item_id, round((p_i * n_i + 3.7107903640311 * p_m * n_b) / (n_i + 3.7107903640311 * n_b), 8) AS p FROM (SELECT user_id, item_id FROM {REVIEWS} r GROUP BY 1, 2) a JOIN (SELECT item_id AS item, avg(stars) AS p_i, count(*) AS n_i FROM {REVIEWS} r GROUP BY 1) i ON a.item_id = i.item JOIN (SELECT user_id AS u, avg(stars) AS p_m, count(*) AS n_b FROM {REVIEWS} r GROUP BY 1) b ON a.user_id = b.u",
    "l07_three_way_hybrid": f"SELECT user_id, item_id, round(0.0028 * p_i + 0.0059 * p_m + 0.99129 * (p_i + p_m - p_all), 5) AS p FROM (SELECT user_id, item_id FROM {REVIEWS} r GROUP BY 1, 2) a JOIN (SELECT item_id AS item, avg(stars) AS p_i FROM {REVIEWS} r GROUP BY 1) i ON a.item_id = i.item JOIN (SELECT user_id AS u, avg(stars) AS p_m FROM {REVIEWS} r GROUP BY 1) b ON a.user_id = b.u CROSS JOIN (SELECT avg(stars) AS p_all FROM {REVIEWS} r) g",
    "m10_paths": "WITH RECURSIVE up(node, anc, path) AS (SELECT p_partkey, CAST(floor(p_partkey / 3) AS BIGINT), CAST(p_partkey AS STRING) FROM part UNION ALL SELECT node, CAST(floor(anc / 3) AS BIGINT), concat(CAST(anc AS STRING), '/', path) FROM up WHERE anc > 0) SELECT node, concat('/', path) AS path FROM up WHERE anc = 0",
    "n01_micro_batches": f"SELECT CAST(ceil(nth / 250.0) AS BIGINT) AS batch, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM {NUMBERED} t GROUP BY 1",
    "n02_seen_before": f"SELECT batch, count(*) AS n, count(CASE WHEN first_batch < batch THEN 1 END) AS seen FROM (SELECT batch, min(batch) OVER (PARTITION BY user_id) AS first_batch FROM (SELECT user_id, CAST(ceil(nth / 100.0) AS BIGINT) AS batch FROM {NUMBERED} n) b) t GROUP BY batch",
    "n03_exact_distinct": f"SELECT batch, count(DISTINCT user_id) AS users FROM (SELECT user_id, CAST(ceil(nth / 300.0) AS BIGINT) AS batch FROM {NUMBERED} n) b GROUP BY batch",
    "r02_scaling": "SELECT s_suppkey, round((s_acctbal - mean) / sd, 6) AS z, round((s_acctbal - low) / (high - low), 8) AS minmax FROM supplier CROSS JOIN (SELECT avg(s_acctbal) AS mean, stddev_pop(s_acctbal) AS sd, min(s_acctbal) AS low, max(s_acctbal) AS high FROM supplier) m",
    "r12_power_set": "SELECT doc_id, c.class FROM labels l JOIN (SELECT quality, toxic, dense_rank() OVER (ORDER BY quality, toxic) - 1 AS class FROM (SELECT DISTINCT quality, toxic FROM labels) d) c ON l.quality = c.quality AND l.toxic = c.toxic",
    "j02_basket_keys": "SELECT concat(CAST(CAST(o_orderdate AS DATE) AS STRING), '-', CAST(o_custkey AS STRING)) AS basket, CAST(replace(concat('\"', CAST(l_partkey AS STRING), '\"'), '\"', '') AS BIGINT) AS item, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2",
    "j04_local_threshold": "SELECT part, CAST(ceil(25.0 * n / total) AS BIGINT) AS threshold FROM (SELECT l_orderkey % 4 AS part, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1) p CROSS JOIN (SELECT count(DISTINCT l_orderkey) AS total FROM lineitem) t",
    "o10_majority_label": "SELECT c, label, round(hamming / n, 8) AS hamming_loss, exact FROM (SELECT m.c, m.label, CAST(count(*) AS DOUBLE) AS n, sum(CASE WHEN p.label <> m.label THEN 1.0 ELSE 0.0 END) AS hamming, count(CASE WHEN p.label = m.label THEN 1 END) AS exact FROM (SELECT user_id % 4 AS c, event_type AS label FROM events) p JOIN (SELECT c, label FROM (SELECT user_id % 4 AS c, event_type AS label, row_number() OVER (PARTITION BY user_id % 4 ORDER BY count(*) DESC, event_type) AS rn FROM events GROUP BY 1, 2) r WHERE rn = 1) m ON p.c = m.c GROUP BY m.c, m.label) s",
    "r01_chronological_split": "SELECT train, count(*) AS n, min(event_id) AS first_id FROM (SELECT event_id, nth <= floor(0.8 * total) AS train FROM " + NUMBERED + " n CROSS JOIN (SELECT count(*) AS total FROM events) t) s GROUP BY train",
    "r01_stratified_split": f"SELECT l_returnflag, count(CASE WHEN nth <= floor(class_size * 0.8) THEN 1 END) AS train, CAST(sum(CASE WHEN nth <= floor(class_size * 0.8) THEN l_orderkey END) AS BIGINT) AS train_keys, count(*) AS n FROM {RANKED} r GROUP BY l_returnflag",
    "r11_undersampling": f"SELECT l_orderkey, l_linenumber, l_returnflag FROM {RANKED} r CROSS JOIN (SELECT min(n) AS least FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_returnflag) c) m WHERE nth <= least",
    "r15_sweep_by_key": "SELECT user_id, lag_days, rmse FROM (SELECT user_id, lag_days, rmse, row_number() OVER (PARTITION BY user_id ORDER BY rmse, lag_days) AS rn FROM (SELECT user_id, lag_days, round(sqrt(avg(pow(value - guess, 2))), 6) AS rmse FROM (SELECT user_id, value, 1 AS lag_days, lag(value, 1) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS guess FROM events UNION ALL SELECT user_id, value, 3, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) FROM events UNION ALL SELECT user_id, value, 7, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) FROM events) g WHERE guess IS NOT NULL GROUP BY 1, 2) e) b WHERE rn = 1",
    "r18_one_vs_rest_auc": "SELECT event_type, round((rank_sum - pos * (pos + 1) / 2.0) / CAST(pos * (total - pos) AS DOUBLE), 8) AS auc FROM (SELECT event_type, sum(n) AS pos, sum(n * mean_rank) AS rank_sum FROM (SELECT c.event_type, c.n, s.mean_rank FROM (SELECT event_type, floor(value) AS score, count(*) AS n FROM events GROUP BY 1, 2) c JOIN (SELECT score, sum(n) OVER (ORDER BY score) - n + (n + 1) / 2.0 AS mean_rank FROM (SELECT floor(value) AS score, count(*) AS n FROM events GROUP BY 1) x) s ON c.score = s.score) j GROUP BY event_type) a CROSS JOIN (SELECT count(*) AS total FROM events) t",
    "r19_learning_curve": f"SELECT size, round(sqrt(sum(pow(y - a - b * x, 2)) / count(*)), 4) AS rmse FROM (SELECT size, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM {RANKED} r CROSS JOIN (SELECT 20 AS size UNION ALL SELECT 60 UNION ALL SELECT 180) z WHERE nth <= size GROUP BY size) m CROSS JOIN (SELECT l_quantity AS x, l_extendedprice AS y FROM {RANKED} q WHERE nth > 180) t GROUP BY size",
    "p06_token_accuracy": f"SELECT round(avg(CASE WHEN g.tag = t.tag THEN 1e0 ELSE 0e0 END), 8) AS accuracy, count(*) AS n FROM {TAGGED} t JOIN (SELECT word, tag FROM (SELECT word, tag, row_number() OVER (PARTITION BY word ORDER BY count(*) DESC, tag) AS rn FROM {TAGGED} x GROUP BY 1, 2) r WHERE rn = 1) g ON t.word = g.word".replace("VARCHAR", "STRING"),
    "p14_entity_metrics": f"SELECT tag, round(hit / CAST(nullif(found, 0) AS DOUBLE), 8) AS precise, round(hit / CAST(nullif(there, 0) AS DOUBLE), 8) AS recall, round(2.0 * hit / CAST(found + there AS DOUBLE), 8) AS f1 FROM (SELECT tag, sum(found) AS found, sum(there) AS there, sum(hit) AS hit FROM (SELECT t.tag, 0 AS found, 1 AS there, CASE WHEN t.tag = g.tag THEN 1 ELSE 0 END AS hit FROM {TAGGED} t JOIN (SELECT word, min(tag) AS tag FROM {TAGGED} x GROUP BY 1) g ON t.word = g.word UNION ALL SELECT g.tag, 1, 0, 0 FROM {TAGGED} t JOIN (SELECT word, min(tag) AS tag FROM {TAGGED} x GROUP BY 1) g ON t.word = g.word) u GROUP BY tag) s".replace("VARCHAR", "STRING"),
}


def _ancestors(s: SparkSession, d: str) -> DataFrame:
    """(node, chain) of every part: thirds, rounded down. A bigint is below 3**40, so no chain is longer than 41."""
    node = F.col("p_partkey")
    return _t(s, d, "part").select(node.alias("node"), T.ancestors(node, lambda x: F.floor(x / 3).cast("long"), 41).alias("chain"))


def _depths(s: SparkSession, d: str) -> DataFrame:
    return _ancestors(s, d).groupBy("node").agg(F.sum(F.size("chain")).alias("depth"))


def _paths(s: SparkSession, d: str) -> DataFrame:
    """Those whose chain ends in 0, as /oldest/.../node."""
    above = F.transform(F.reverse(F.slice("chain", 1, F.size("chain") - 1)), lambda x: x.cast("string"))
    path = F.concat(F.lit("/"), F.array_join(F.concat(above, F.array(F.col("node").cast("string"))), "/"))
    return _ancestors(s, d).where(F.element_at("chain", -1) == 0).select("node", path.alias("path"))


def _nearest_target(s: SparkSession, d: str) -> DataFrame:
    points = _t(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"))
    gaps = sequences.nearest_gap(points, _t(s, d, "supplier").select(F.col("s_acctbal").alias("value")))
    return gaps.groupBy(F.col("id").alias("c_custkey")).agg(F.round(F.min("gap"), 6).alias("gap"))


def _over_ranked(name: str):
    """The text of SHARED over the rows of RANKED, ranked in parts of a class."""
    def run(s: SparkSession, d: str) -> DataFrame:
        rows = _t(s, d, "lineitem").withColumn("_id", F.concat_ws("-", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]))
        learning.ranked(rows, "_id", ["l_returnflag"], ties="l_extendedprice").withColumnRenamed("of", "class_size").createOrReplaceTempView("ranked_lineitem")
        views(s, d, "lineitem")
        return s.sql(SHARED[name].replace(RANKED, "ranked_lineitem"))

    return run


# Spark runs of texts of SHARED and of relational.SHARED that Spark's SQL does not carry out at size: recursions stop at a million rows, a cross join compares all, a window takes a whole class
NATIVE = {
    "c09_ancestor_walk": _depths,
    "m10_paths": _paths,
    "f09_nearest_target": _nearest_target,
    "r01_stratified_split": _over_ranked("r01_stratified_split"),
    "r11_undersampling": _over_ranked("r11_undersampling"),
    "r19_learning_curve": _over_ranked("r19_learning_curve"),
}


def _grid(s: SparkSession, d: str) -> DataFrame:
    rows = learning.folds(_t(s, d, "lineitem").withColumn("id", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")), "id", ["l_returnflag"], 5)
    found = learning.grid_search(rows, ["l_quantity"], "l_extendedprice", "fold", [0.0, 0.01, 0.1, 1.0])
    return s.createDataFrame([(p, round(float(e), 4)) for p, e in found], "penalty double, rmse double")


def _floor_predictions(s: SparkSession, d: str) -> DataFrame:
    rows = _t(s, d, "lineitem")
    model = learning.Moments.of(rows, ["l_quantity"], "l_extendedprice")[None].ridge()
    return learning.predict(rows.select("l_orderkey", "l_linenumber", "l_quantity"), ["l_quantity"], model, 0.0).select("l_orderkey", "l_linenumber", F.round("prediction", 3).alias("prediction"))


def _coefficients(s: SparkSession, d: str) -> DataFrame:
    out = []
    rows = _t(s, d, "lineitem")
    for name in ("l_quantity", "l_discount", "l_tax"):
        m = learning.Moments.of(rows, [name], "l_extendedprice")[None]
        out.append((name, round(float(m.ridge()[1]), 3), round(float(m.t_values()[1]), 3)))
    return s.createDataFrame(sorted(out, key=lambda r: -abs(r[2])), "feature string, slope double, t double")


def _penalised(s: SparkSession, d: str) -> DataFrame:
    names = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
    m = learning.Moments.of(_t(s, d, "lineitem"), names, "l_extendedprice")[None]
    models = {"ridge": m.ridge(0.1), "lasso": m.lasso(50.0), "components": m.principal(2)}
    rows, powers = learning.polynomial(_t(s, d, "lineitem"), "l_quantity", 2)
    models["polynomial"] = learning.Moments.of(rows, powers, "l_extendedprice")[None].ridge()
    return s.createDataFrame([(k, i, float(x)) for k, v in models.items() for i, x in enumerate(v)], "model string, place int, value double")


def _rules(s: SparkSession, d: str) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor

    names = ["l_quantity", "l_discount"]
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(_t(s, d, "lineitem").withColumnRenamed("l_extendedprice", "label"))
    text = learning.tree_rules(DecisionTreeRegressor(maxDepth=3, seed=1).fit(rows), names)
    return s.createDataFrame(list(enumerate(text.splitlines())), "line long, text string")


FEATURES = ["ua", "un", "us", "umin", "umax", "ia", "in", "is", "imin", "imax", "gap"]


def _feature_regression(s: SparkSession, d: str) -> DataFrame:
    """Stars from eleven features of user and item."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    r = _ratings(s, d)
    stats = lambda key, p: r.groupBy(key).agg(F.avg("stars").alias(p + "a"), F.count("*").cast("double").alias(p + "n"), F.coalesce(F.stddev_pop("stars"), F.lit(0.0)).alias(p + "s"), F.min("stars").alias(p + "min"), F.max("stars").alias(p + "max"))
    rows = r.join(stats("user", "u"), "user").join(stats("item", "i"), "item").withColumn("gap", F.col("ua") - F.col("ia"))
    parts = mining.tasks(_t(s, d, "lineitem"))  # the fit holds and reads its rows by part, once a level
    if parts > s.sparkContext.defaultParallelism:
        rows = rows.repartition(parts, "user", "item")
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
    model = GBTRegressor(labelCol="stars", maxIter=5, maxDepth=3, seed=1).fit(rows)
    return model.transform(rows).select("user", "item", F.round("prediction", 6).alias("prediction"))


def _self_training(s: SparkSession, d: str) -> DataFrame:
    """A fifth of the labelled suppliers teach the others by nearest class mean, a hundred a step."""
    rows = _t(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("x"), F.when(F.col("s_suppkey") <= 20, (F.col("s_acctbal") > 5000).cast("double")).alias("label"))

    def fit(known):
        means = {r["label"]: r["m"] for r in known.groupBy("label").agg(F.avg("x").alias("m")).collect()}  # two classes
        near = [F.struct(F.abs(F.col("x") - m).alias("far"), F.lit(c).alias("c")) for c, m in sorted(means.items())]
        return lambda left: left.withColumn("best", F.array_sort(F.array(*near))).withColumns({"prediction": F.col("best")[0]["c"], "margin": F.col("best")[F.lit(len(near) - 1)]["far"] - F.col("best")[0]["far"]})

    return learning.self_training(rows, fit, 20, checkpointed, 100).groupBy("label").agg(F.count("*").alias("n"))


def _smote(s: SparkSession, d: str) -> DataFrame:
    v = _vectors(s, d).where("label = 0").select("id", "v", F.col("id").alias("label"))
    near = mining.nearest_rows(v, v, 3).where("id <> other").select("id", "other")
    return learning.smote(v, near, "id", "v", 1).select("id", "other", F.round(F.col("v")[0], 6).alias("x0"))


def _analogy(s: SparkSession, d: str) -> DataFrame:
    v = _vectors(s, d)
    three = v.where("id IN (0, 1, 2)").agg(F.array_sort(F.collect_list(F.struct("id", "v"))).alias("t"))  # three rows
    target = three.select(F.zip_with(F.zip_with(F.col("t")[0]["v"], F.col("t")[1]["v"], lambda a, b: a - b), F.col("t")[2]["v"], lambda x, c: x + c).alias("w"))
    return v.where("id NOT IN (0, 1, 2)").crossJoin(F.broadcast(target)).select("id", F.round(T.cosine(F.col("v"), F.col("w")), 6).alias("c")).orderBy(F.desc("c"), "id").limit(10)


def _word_vectors(s: SparkSession, d: str) -> DataFrame:
    """Mean vector of a document's words, a word's vector being that of its length."""
    docs = _texts(s, d)
    lengths = checkpointed(sequences.by_text(docs, lambda i, cut: [(i, k, n) for k, n in Counter(map(len, cut)).items()], f"doc_id {docs.schema['id'].dataType.simpleString()}, id long, n long"))
    used = _vectors(s, d).select("id", F.slice("v", 1, 8).alias("v")).join(lengths.select("id").distinct(), "id", "left_semi")  # a row a word length
    parts = lengths.join(F.broadcast(used), "id")
    sums = [F.struct(F.lit(i).alias("i"), F.sum(F.when(F.size("v") > i, F.col("n"))).alias("n"), F.sum(F.col("n") * F.get("v", F.lit(i))).alias("x")) for i in range(8)]
    means = parts.groupBy("doc_id").agg(F.array(*sums).alias("m")).select("doc_id", F.explode("m").alias("m")).where("m.n IS NOT NULL")
    return means.select("doc_id", F.col("m.i").alias("i"), F.round(F.col("m.x") / F.col("m.n"), 6).alias("m"))


def _index_sequences(s: SparkSession, d: str) -> DataFrame:
    """Ids of the 5,000 most frequent words in the order of the text; a document is one row's work unless its id is repeated."""
    docs = _texts(s, d)
    place = {w: i + 1 for i, w in enumerate(sequences.top_words(docs, 5000))}
    kind = docs.schema["id"].dataType.simpleString()
    if docs.groupBy("id").count().where("count > 1").isEmpty():

        def one(i, cut):
            ids = [place[w] for w in cut if w in place]
            return [(i, md5(",".join(map(str, ids)).encode()).hexdigest(), len(ids))] if ids else []

        return sequences.by_text(docs, one, f"doc_id {kind}, ids string, n long")
    words = sequences.by_text(docs, lambda i, cut: [(i, at, place[w]) for at, w in enumerate(cut) if w in place], f"doc_id {kind}, at int, i int")
    lists = words.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "i"))).alias("x"))
    return lists.select("doc_id", F.md5(F.concat_ws(",", F.transform("x", lambda y: y["i"].cast("string")))).alias("ids"), F.size("x").cast("long").alias("n"))


def _flattened(s: SparkSession, d: str) -> DataFrame:
    schema = "struct<k:long,at:struct<day:string,hour:long>,flags:string>"
    text = F.to_json(F.struct(F.get_json_object("props", "$.k").cast("long").alias("k"), F.struct(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.hour("ts").cast("long").alias("hour")).alias("at"), F.concat(F.lit("{'big': "), F.when(F.col("value") > 50, "True").otherwise("False"), F.lit("}")).alias("flags")))
    parsed = _t(s, d, "events").select("event_id", F.from_json(text, schema).alias("a"))
    dicts = parsed.withColumn("a", F.col("a").withField("flags", T.parse_dict(F.col("a.flags"), "big boolean")))
    return T.flatten(dicts)


def _nested(s: SparkSession, d: str) -> DataFrame:
    """Days of hours as one JSON text a user, and back to rows."""
    hours = _t(s, d, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))
    days = hours.groupBy("user_id", "day").agg(F.collect_list(F.struct("hour", "n")).alias("hours"))
    texts = days.groupBy("user_id").agg(F.to_json(F.struct(F.collect_list(F.struct("day", "hours")).alias("forecast"))).alias("text"))
    from ..sources.readers import nested_rows

    return nested_rows(texts, "text", "forecast array<struct<day:string,hours:array<struct<hour:int,n:long>>>>", ["forecast", "hours"]).select("user_id", "forecast_day", "hours_hour", "hours_n")


def _page_numbers(s: SparkSession, d: str) -> DataFrame:
    from ..sources.readers import html_numbers

    return html_numbers(_t(s, d, "pages"), "html", "script").select("page_id", F.concat_ws(",", F.col("numbers").cast("array<string>")).alias("numbers"))


def _one_hot(s: SparkSession, d: str) -> DataFrame:
    flat = _flattened(s, d).select("event_id", "a_k", "a_at_hour", "a_flags_big")
    kind = _t(s, d, "events").select("event_id", "event_type")
    wide = flat.join(kind, "event_id")
    return wide.select("event_id", F.coalesce(F.col("a_flags_big").cast("int"), F.lit(0)).alias("big"), *[(F.col("event_type") == t).cast("int").alias(f"type_{t}") for t in ("click", "error", "purchase", "signup")], *[(F.floor(F.col("a_at_hour") / 6) == q).cast("int").alias(f"quarter_{q}") for q in range(1, 4)])


def _candidates(s: SparkSession, d: str) -> DataFrame:
    pairs = mining.itemsets(_t(s, d, "lineitem"), "l_orderkey", "l_suppkey", 8, 2).where(F.size("items") == 2).select("items")
    return mining.candidates(pairs).select(F.concat_ws(",", F.col("items").cast("array<string>")).alias("items"))


_KNN = "WITH tr AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings WHERE vec_id % 5 > 0), te AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 5 = 0), dist AS (SELECT te.vec_id AS id, tr.vec_id AS t, tr.label, {measure} AS d FROM te CROSS JOIN tr), near AS (SELECT * FROM dist QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, t) <= 3), votes AS (SELECT id, label, {vote} AS w FROM near GROUP BY 1, 2) SELECT id, label AS prediction FROM votes QUALIFY row_number() OVER (PARTITION BY id ORDER BY w DESC, label) = 1"
_APART = "list_transform(range(1, 65), lambda i: abs(te.v[i] - tr.v[i]))"
_PAIRS = "WITH b AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS i FROM lineitem), two AS (SELECT a.i AS x, b.i AS y, count(*) AS n FROM b a JOIN b ON a.k = b.k AND a.i < b.i GROUP BY 1, 2 HAVING count(*) >= {support})"
_THREE = _PAIRS + ", three AS (SELECT a.i AS x, b.i AS y, c.i AS z, count(*) AS n FROM b a JOIN b ON a.k = b.k AND a.i < b.i JOIN b c ON a.k = c.k AND b.i < c.i GROUP BY 1, 2, 3 HAVING count(*) >= {support}) SELECT CAST(i AS VARCHAR) AS items, count(*) AS n FROM b GROUP BY 1 HAVING count(*) >= {support} UNION ALL SELECT x || ',' || y, n FROM two UNION ALL SELECT x || ',' || y || ',' || z, n FROM three"
_CORR = "(SELECT a AS item, b AS other, corr FROM p WHERE corr > 0 UNION ALL SELECT b, a, corr FROM p WHERE corr > 0)"
_USER_PEARSON = PEARSON.replace("a.item AS a, b.item AS b", "a.\"user\" AS a, b.\"user\" AS b").replace("ON a.\"user\" = b.\"user\"", "ON a.item = b.item").replace("a.item < b.item", "a.\"user\" < b.\"user\"")
_MOMENTS = "(SELECT c, i, count(*) AS n, sum(x) AS s, sum(x * x) AS q FROM (SELECT label AS c, unnest(range(64)) AS i, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings) u GROUP BY 1, 2)"


def _joined(sets: DataFrame) -> DataFrame:
    return sets.select(F.array_join(F.col("items").cast("array<string>"), ",").alias("items"), "n")


# name: (Spark query, SQL or None)
DERIVED = {
    "a27_report": (lambda s, d: _report(s, d), "SELECT (SELECT count(*) FROM orders) AS n_orders, (SELECT count(*) FROM orders WHERE year(o_orderdate) = 1996) AS n_1996, (SELECT count(DISTINCT o_custkey) FROM orders) AS n_customers, (SELECT string_agg(o_custkey || ':' || n, ',' ORDER BY n DESC, o_custkey) FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 10)) AS top"),
    "d08_nested_json": (_nested, "SELECT user_id, strftime(ts, '%Y-%m-%d') AS forecast_day, CAST(hour(ts) AS INTEGER) AS hours_hour, count(*) AS hours_n FROM events GROUP BY 1, 2, 3"),
    "d10_html_numbers": (_page_numbers, "SELECT page_id, array_to_string(list_transform(regexp_extract_all(coalesce(regexp_extract(html, '(?is)<script[^>]*>(.*?)</script>', 1), ''), '[0-9]+(?:\\.[0-9]+)?'), lambda x: x), ',') AS numbers FROM pages"),
    "e15_tokens": (lambda s, d: _tokens(s, d).select("doc_id", F.size("tokens").cast("long").alias("n"), F.md5(F.concat_ws(" ", "tokens")).alias("all_tokens")), f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n, md5(array_to_string(t, ' ')) AS all_tokens FROM (SELECT doc_id, {WORDS} AS t FROM documents)"),
    "e24_flattened": (_flattened, "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS a_k, strftime(ts, '%Y-%m-%d') AS a_at_day, CAST(hour(ts) AS BIGINT) AS a_at_hour, value > 50 AS a_flags_big FROM events"),
    "e28_label_scores": (lambda s, d: _t(s, d, "labels").select("doc_id", F.array("quality", "toxic").alias("a")).select("doc_id", (T.hamming(F.col("a"), F.array(F.lit(1), F.lit(0))) / 2).alias("loss"), F.round(T.label_score(F.col("a"), F.array(F.lit(1), F.lit(0))), 6).alias("score"), (F.col("a") == F.array(F.lit(1), F.lit(0))).alias("exact")), "SELECT doc_id, (CAST(quality <> 1 AS BIGINT) + CAST(toxic <> 0 AS BIGINT)) / 2.0 AS loss, round(len(list_intersect([quality, toxic], [1, 0])) / CAST(len(list_distinct([quality, toxic, 1, 0])) AS DOUBLE), 6) AS score, quality = 1 AND toxic = 0 AS exact FROM labels"),
    "e29_analogy": (_analogy, "WITH w AS (SELECT list_transform(range(1, 65), lambda i: a.v[i] - b.v[i] + c.v[i]) AS w FROM (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0) a, (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 1) b, (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 2) c) SELECT vec_id AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), w), 6) AS c FROM embeddings CROSS JOIN w WHERE vec_id NOT IN (0, 1, 2) ORDER BY c DESC, id LIMIT 10"),
    "e30_mean_vector": (_word_vectors, f"SELECT doc_id, CAST(i AS INTEGER) AS i, round(sum(n * x) / sum(n), 6) AS m FROM (SELECT doc_id, CAST(length(w) AS BIGINT) AS id, count(*) AS n FROM (SELECT doc_id, unnest({WORDS}) AS w FROM documents) t GROUP BY 1, 2) a JOIN (SELECT vec_id AS id, unnest(range(8)) AS i, unnest(CAST(embedding AS DOUBLE[])[1:8]) AS x FROM embeddings) v USING (id) GROUP BY 1, 2"),
    "e31_chunk_scores": (lambda s, d: _t(s, d, "documents").select("doc_id", F.explode(T.chunks(F.col("text"))).alias("c")).where("c <> ''").groupBy("doc_id").agg(F.round(F.avg((F.char_length("c") - F.char_length(F.replace("c", F.lit("e"), F.lit("")))) / F.char_length("c")), 10).alias("score")), "SELECT doc_id, round(avg((length(c) - length(replace(c, 'e', ''))) / CAST(length(c) AS DOUBLE)), 10) AS score FROM (SELECT doc_id, substring(text, CAST(i * 512 + 1 AS BIGINT), 512) AS c FROM (SELECT doc_id, text, unnest(range(CAST(ceil(length(text) / 512.0) AS BIGINT))) AS i FROM documents)) WHERE c <> '' GROUP BY 1"),
    "e34_prefix_columns": (lambda s, d: T.by_prefix(_t(s, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_ret", "l_line", "l_dis"]), "SELECT l_orderkey, l_linenumber, l_discount, l_returnflag, l_linestatus FROM lineitem"),
    "g05_collect": (lambda s, d: _collected(s, d), "SELECT l_orderkey, array_to_string(list_sort(list(CAST(l_suppkey AS VARCHAR))), ',') AS list_of, array_to_string(list_sort(list_distinct(list(CAST(l_suppkey AS VARCHAR)))), ',') AS set_of, string_agg(l_linenumber || ':' || l_suppkey, ',' ORDER BY l_linenumber, l_suppkey) AS dict_of FROM lineitem GROUP BY 1"),
    "g24_inverted_index": (lambda s, d: _tokens(s, d).select("doc_id", F.explode(F.array_distinct("tokens")).alias("w")).groupBy("w").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("doc_id")).alias("p")).select("w", "n", F.concat_ws(",", F.col("p").cast("array<string>")).alias("postings")), f"SELECT w, count(*) AS n, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS postings FROM (SELECT doc_id, unnest(list_distinct({WORDS})) AS w FROM documents) GROUP BY 1"),
    "j07_candidates": (_candidates, _PAIRS.format(support=8) + " SELECT a.x || ',' || a.y || ',' || c.y AS items FROM two a JOIN two c ON a.x = c.x AND a.y < c.y JOIN two e ON e.x = a.y AND e.y = c.y"),
    "j08_son": (lambda s, d: _joined(mining.son(_t(s, d, "lineitem"), "l_orderkey", "l_suppkey", 8, 3)), _THREE.format(support=8)),
    "j10_frequent_itemsets": (lambda s, d: _joined(mining.itemsets(_t(s, d, "lineitem"), "l_orderkey", "l_suppkey", 8, 3)), _THREE.format(support=8)),
    "k08_knn_manhattan": (lambda s, d: mining.knn(*_knn_sets(s, d), 3, "manhattan", "inverse"), _KNN.format(measure=f"list_sum({_APART})", vote="sum(1 / greatest(d, 1e-12))")),
    "k08_knn_minkowski": (lambda s, d: mining.knn(*_knn_sets(s, d), 3, mining.minkowski(3)), _KNN.format(measure=f"list_sum(list_transform({_APART}, lambda x: x * x * x))", vote="count(*)")),
    "k08_knn_chebyshev": (lambda s, d: mining.knn(*_knn_sets(s, d), 3, "chebyshev"), _KNN.format(measure=f"list_max({_APART})", vote="count(*)")),
    "k08_knn_mahalanobis": (lambda s, d: mining.knn(*mining.whitened(*_knn_sets(s, d)), 3), None),
    "l02_item_based": (lambda s, d: _predicted(mining.item_predictions, s, d).select("user", "item", F.round(F.col("prediction") + 1e-9, 5).alias("prediction")), f"WITH r AS (SELECT * FROM {RATINGS} z), p AS (SELECT * FROM {PEARSON} y), near AS (SELECT q.\"user\", q.item, o.stars, c.corr FROM r q JOIN r o ON q.\"user\" = o.\"user\" JOIN {_CORR} c ON c.item = q.item AND c.other = o.item QUALIFY row_number() OVER (PARTITION BY q.\"user\", q.item ORDER BY round(c.corr, 9) DESC, c.other) <= 30), v AS (SELECT \"user\", item, count(*) AS votes, sum(corr * stars) / sum(corr) AS p FROM near GROUP BY 1, 2), ua AS (SELECT \"user\", avg(stars) AS ua FROM r GROUP BY 1), ia AS (SELECT item, avg(stars) AS ia FROM r GROUP BY 1) SELECT r.\"user\", r.item, round(CASE WHEN votes > 5 THEN p ELSE (ua + ia) / 2 END + 1e-9, 5) AS prediction FROM r LEFT JOIN v USING (\"user\", item) JOIN ua USING (\"user\") JOIN ia USING (item)"),
    "l03_cold_start": (lambda s, d: _cold(s, d), f"WITH r AS (SELECT * FROM {RATINGS} z), u AS (SELECT \"user\", avg(stars) AS ua FROM r GROUP BY 1), i AS (SELECT item, avg(stars) AS ia FROM r GROUP BY 1) SELECT \"user\", CAST(-1 AS BIGINT) AS item, round(ua, 6) AS prediction FROM u UNION ALL SELECT -1, item, round(ia, 6) FROM i UNION ALL SELECT -1, -1, 3.7"),
    "l04_user_based": (lambda s, d: _predicted(mining.user_predictions, s, d).select("user", "item", F.round(F.col("prediction") + 1e-9, 5).alias("prediction")), f"WITH r AS (SELECT * FROM {RATINGS} z), p AS (SELECT * FROM {_USER_PEARSON} y), ua AS (SELECT \"user\", avg(stars) AS ua FROM r GROUP BY 1), near AS (SELECT q.\"user\", q.item, o.stars - w.ua AS d, c.corr FROM r q JOIN r o ON q.item = o.item JOIN {_CORR} c ON c.item = q.\"user\" AND c.other = o.\"user\" JOIN ua w ON w.\"user\" = o.\"user\" QUALIFY row_number() OVER (PARTITION BY q.\"user\", q.item ORDER BY round(c.corr, 9) DESC, c.other) <= 30), v AS (SELECT \"user\", item, sum(corr * d) / sum(corr) AS d FROM near GROUP BY 1, 2) SELECT r.\"user\", r.item, round(ua + coalesce(d, 0) + 1e-9, 5) AS prediction FROM r LEFT JOIN v USING (\"user\", item) JOIN ua USING (\"user\")"),
    "l05_boosted_trees": (_feature_regression, None),
    "l08_one_hot_attributes": (_one_hot, "SELECT event_id, CAST(value > 50 AS INTEGER) AS big, CAST(event_type = 'click' AS INTEGER) AS type_click, CAST(event_type = 'error' AS INTEGER) AS type_error, CAST(event_type = 'purchase' AS INTEGER) AS type_purchase, CAST(event_type = 'signup' AS INTEGER) AS type_signup, CAST(hour(ts) // 6 = 1 AS INTEGER) AS quarter_1, CAST(hour(ts) // 6 = 2 AS INTEGER) AS quarter_2, CAST(hour(ts) // 6 = 3 AS INTEGER) AS quarter_3 FROM events"),
    "o03_assign": (lambda s, d: clusters.assign(_vectors(s, d), clusters.summaries(_vectors(s, d).withColumn("c", F.col("label")), 64), 64).select("id", "c", F.round("distance", 5).alias("distance")), f"WITH m AS (SELECT c, i, s / n AS mean, greatest(q / n - (s / n) * (s / n), 0) AS var FROM {_MOMENTS} t), x AS (SELECT vec_id AS id, unnest(range(64)) AS i, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings), far AS (SELECT id, c, sqrt(sum(CASE WHEN sqrt(var) < 1e-9 THEN 0 ELSE pow((x - mean) / sqrt(var), 2) END)) AS distance FROM x JOIN m USING (i) GROUP BY 1, 2) SELECT id, CASE WHEN distance < 16 THEN c END AS c, round(distance, 5) AS distance FROM far QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, c) = 1"),
    "o09_calinski_harabasz": (lambda s, d: clusters.calinski_harabasz(_vectors(s, d).withColumn("c", F.col("label")), 64), f"WITH m AS (SELECT * FROM {_MOMENTS} t), w AS (SELECT sum(q - s * s / n) AS within_sum, max(k) AS k FROM m CROSS JOIN (SELECT count(DISTINCT c) AS k FROM m)), a AS (SELECT sum(q - s * s / n) AS total, max(n) AS n FROM (SELECT i, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM m GROUP BY i)) SELECT round((total - within_sum) / (k - 1) / (within_sum / (n - k)), 6) AS ch FROM w CROSS JOIN a"),
    "o09_best_k": (lambda s, d: clusters.best_k(_vectors(s, d), 64, [2, 5, 10]), None),
    "p09_index_sequences": (_index_sequences, f"WITH w AS (SELECT doc_id, unnest({WORDS}) AS w, unnest(range(len({WORDS}))) AS i FROM documents), top AS (SELECT w, row_number() OVER (ORDER BY count(*) DESC, w) AS nr FROM w GROUP BY 1 QUALIFY nr <= 5000) SELECT doc_id, md5(string_agg(CAST(nr AS VARCHAR), ',' ORDER BY i)) AS ids, count(*) AS n FROM w JOIN top USING (w) GROUP BY 1"),
    "r04_penalised": (_penalised, None),
    "r10_grid_search": (_grid, f"WITH f AS (SELECT * FROM {FOLD_SUMS} z), t AS (SELECT sum(n) AS n, sum(x) AS x, sum(y) AS y, sum(xx) AS xx, sum(xy) AS xy FROM f), m AS (SELECT f.fold, penalty, ((t.xy - f.xy) / (t.n - f.n) - (t.x - f.x) / (t.n - f.n) * (t.y - f.y) / (t.n - f.n)) / (((t.xx - f.xx) / (t.n - f.n) - pow((t.x - f.x) / (t.n - f.n), 2)) * (1 + penalty)) AS b, (t.y - f.y) / (t.n - f.n) AS my, (t.x - f.x) / (t.n - f.n) AS mx FROM f CROSS JOIN t CROSS JOIN (SELECT unnest([0.0, 0.01, 0.1, 1.0]) AS penalty) p), e AS (SELECT penalty, f.n, f.yy - 2 * b * f.xy + b * b * f.xx + f.n * pow(my - b * mx, 2) - 2 * (my - b * mx) * f.y + 2 * b * (my - b * mx) * f.x AS sse FROM m JOIN f USING (fold)) SELECT CAST(penalty AS DOUBLE) AS penalty, round(sqrt(sum(sse) / sum(n)), 4) AS rmse FROM e GROUP BY 1"),
    "r11_smote": (_smote, None),
    "r13_self_training": (_self_training, None),
    "r16_tree_rules": (_rules, None),
    "r17_ranked_coefficients": (_coefficients, "SELECT feature, round(regr_slope(y, x), 3) AS slope, round(regr_slope(y, x) / sqrt(regr_syy(y, x) * (1 - regr_r2(y, x)) / (count(*) - 2) / regr_sxx(y, x)), 3) AS t FROM (SELECT 'l_quantity' AS feature, l_quantity AS x, l_extendedprice AS y FROM lineitem UNION ALL SELECT 'l_discount', l_discount, l_extendedprice FROM lineitem UNION ALL SELECT 'l_tax', l_tax, l_extendedprice FROM lineitem) GROUP BY 1"),
    "r20_predictions_floored": (_floor_predictions, "SELECT l_orderkey, l_linenumber, round(greatest(0.0, a + b * l_quantity), 3) AS prediction FROM lineitem CROSS JOIN (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem)"),
}


def _report(s: SparkSession, d: str) -> DataFrame:
    o = _t(s, d, "orders")
    counts = o.agg(F.count("*").alias("n_orders"), F.count(F.when(F.year("o_orderdate") == 1996, 1)).alias("n_1996"), F.count_distinct("o_custkey").alias("n_customers"))
    top = o.groupBy("o_custkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "o_custkey").limit(10)
    listed = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "o_custkey"))).alias("t"))
    return counts.crossJoin(listed.select(F.concat_ws(",", F.transform("t", lambda x: F.concat(x["o_custkey"].cast("string"), F.lit(":"), (-x["m"]).cast("string")))).alias("top")))


def _collected(s: SparkSession, d: str) -> DataFrame:
    g = _t(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.col("l_suppkey").cast("string"))).alias("l"), F.array_sort(F.collect_set(F.col("l_suppkey").cast("string"))).alias("u"), F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))).alias("m"))
    return g.select("l_orderkey", F.concat_ws(",", "l").alias("list_of"), F.concat_ws(",", "u").alias("set_of"), F.concat_ws(",", F.transform("m", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_suppkey"].cast("string")))).alias("dict_of"))


def _predicted(how, s: SparkSession, d: str) -> DataFrame:
    """Every rated pair; its own rating takes no part in the votes."""
    r = checkpointed(_ratings(s, d))  # read several times
    return how(r, r.select("user", "item"))


def _cold(s: SparkSession, d: str) -> DataFrame:
    """New items for every user, new users for every item, and both new."""
    r = checkpointed(_ratings(s, d))  # read several times
    asked = r.select("user").distinct().withColumn("item", F.lit(-1).cast("long")).unionAll(r.select("item").distinct().select(F.lit(-1).cast("long"), "item")).unionAll(s.range(1).select(F.lit(-1).cast("long"), F.lit(-1).cast("long")))
    return mining.item_predictions(r, asked).select("user", "item", F.round("prediction", 6).alias("prediction"))
