"""Queries on joins, set operations, rank metrics, vectors, strata and text, over the other tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import scalars
from tidemark.functions.keys import fraction
from tidemark.operators import joins, metrics, regimes
from tidemark.operators.spectra import scatter
from tidemark.plans.registry import query
from tidemark.sources.frames import read_table

DIM = 64


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    return docs.join(read_table(spark, sf_dir, "labels"), "doc_id")


_LABELLED = "labelled AS (SELECT doc_id, n_chars, lang, source, quality, toxic FROM documents JOIN labels USING (doc_id))"


@query("""SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey""")
def checked_join_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer; every order must find one."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.col("o_custkey").alias("key"))
    customers = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), "c_name", "c_mktsegment")
    out = joins.backfill(orders, customers.select("key", "c_name"), "key", "c_name").join(customers.select("key", "c_mktsegment"), "key")
    return out.select("o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"), "c_name", "c_mktsegment")


@query("""SELECT count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS n_both, count(*) FILTER (b.k IS NULL) AS n_left_only, count(*) FILTER (a.k IS NULL) AS n_right_only,
    count(*) FILTER (a.n > 1 OR b.n > 1) AS n_repeated FROM (SELECT o_orderkey AS k, count(*) AS n FROM orders GROUP BY 1) a FULL JOIN (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_linenumber = 2 GROUP BY 1) b ON a.k = b.k""")
def join_report_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    right = read_table(spark, sf_dir, "lineitem").filter("l_linenumber = 2").select(F.col("l_orderkey").alias("k"))
    return joins.join_report(left, right, "k").select("n_both", "n_left_only", "n_right_only", "n_repeated")


@query("""SELECT key, 'left_only' AS side FROM (SELECT DISTINCT c_custkey AS key FROM customer EXCEPT SELECT o_custkey FROM orders)
    UNION ALL SELECT key, 'right_only' FROM (SELECT DISTINCT o_custkey AS key FROM orders EXCEPT SELECT c_custkey FROM customer)""")
def anti_missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    b = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")).distinct()
    return joins.missing_keys(a, b, "key")


@query("""SELECT p_partkey, count(*) AS n FROM part JOIN lineitem ON p_partkey = l_partkey WHERE l_returnflag = 'R' GROUP BY p_partkey""")
def semi_join_returned_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read_table(spark, sf_dir, "part").select("p_partkey")
    items = read_table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return items.join(parts, "p_partkey", "left_semi").groupBy("p_partkey").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, coalesce(toxic, -1) AS toxic, toxic IS NOT NULL AS known FROM documents LEFT JOIN labels USING (doc_id)""")
def label_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id")
    out = docs.join(read_table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return out.select("doc_id", F.coalesce("toxic", F.lit(-1)).alias("toxic"), F.col("toxic").isNotNull().alias("known"))


@query("""SELECT src, count(*) AS n, round(sum(amount), 2) AS total, count(note) AS n_notes FROM (
    SELECT 'orders' AS src, o_totalprice AS amount, o_orderstatus AS note FROM orders UNION ALL SELECT 'lineitem', l_extendedprice, NULL FROM lineitem) GROUP BY src""")
def pooled_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read_table(spark, sf_dir, "orders").select(F.lit("orders").alias("src"), F.col("o_totalprice").alias("amount"), F.col("o_orderstatus").alias("note"))
    b = read_table(spark, sf_dir, "lineitem").select(F.lit("lineitem").alias("src"), F.col("l_extendedprice").alias("amount"))
    both = a.unionByName(b, allowMissingColumns=True)
    return both.groupBy("src").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("total"), F.count("note").alias("n_notes"))


@query("SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def id_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    pick = lambda s: o.filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("id"))
    return pick("F").subtract(pick("O"))


@query("SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def id_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    pick = lambda s: o.filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("id"))
    return joins.overlap(pick("F"), pick("O"), "id")


@query("SELECT DISTINCT l_linestatus, l_returnflag FROM lineitem")
def distinct_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "lineitem").select("l_linestatus", "l_returnflag").dropDuplicates()


@query(f"""WITH {_LABELLED}, s AS (SELECT n_chars, sum(toxic) AS pos, count(*) - sum(toxic) AS neg FROM labelled GROUP BY n_chars),
    r AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY n_chars ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s)
    SELECT CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg, round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 9) AS auc FROM r""")
def auc_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.roc_auc(_labelled(spark, sf_dir), "n_chars", F.col("toxic") == 1).select("n_pos", "n_neg", F.round("auc", 9).alias("auc"))


@query(f"""WITH {_LABELLED}, s AS (SELECT lang, n_chars, sum(quality) AS pos, count(*) - sum(quality) AS neg FROM labelled GROUP BY ALL),
    r AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY lang ORDER BY n_chars ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s)
    SELECT lang, round(sum(pos * (below + neg / 2)) / nullif(sum(pos) * sum(neg), 0), 9) AS auc FROM r GROUP BY lang""")
def auc_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.roc_auc(_labelled(spark, sf_dir), "n_chars", F.col("quality") == 1, ["lang"]).select("lang", F.round("auc", 9).alias("auc"))


@query(f"""WITH {_LABELLED}, s AS (SELECT n_chars, sum(quality) AS pos, count(*) AS n FROM labelled GROUP BY n_chars),
    r AS (SELECT *, sum(pos) OVER (ORDER BY n_chars DESC) AS tp, sum(n) OVER (ORDER BY n_chars DESC) AS seen FROM s)
    SELECT round(sum(pos * tp / seen) / sum(pos), 9) AS average_precision FROM r""")
def average_precision_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.average_precision(_labelled(spark, sf_dir), "n_chars", F.col("quality") == 1).select(F.round("average_precision", 9).alias("average_precision"))


@query(f"""WITH {_LABELLED}, r AS (SELECT quality, sum(quality) OVER w AS tp, row_number() OVER w AS n FROM labelled WINDOW w AS (ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING))
    SELECT round(sum(CASE WHEN quality = 1 THEN tp / n END) / sum(quality), 9) AS average_precision FROM r""")
def average_precision_input_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.average_precision_in_order(_labelled(spark, sf_dir), "n_chars", F.col("quality") == 1, "doc_id")
    return out.select(F.round("average_precision", 9).alias("average_precision"))


@query(f"""WITH {_LABELLED}, s AS (SELECT n_chars, sum(toxic) AS pos, count(*) - sum(toxic) AS neg FROM labelled GROUP BY n_chars)
    SELECT n_chars AS threshold, round(sum(pos) OVER (ORDER BY n_chars DESC) / (SELECT sum(pos) FROM s), 9) AS tpr, round(sum(neg) OVER (ORDER BY n_chars DESC) / (SELECT sum(neg) FROM s), 9) AS fpr FROM s""")
def roc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.roc_points(_labelled(spark, sf_dir), "n_chars", F.col("toxic") == 1).select("threshold", F.round("tpr", 9).alias("tpr"), F.round("fpr", 9).alias("fpr"))


@query(f"""WITH {_LABELLED}, b AS (SELECT n_chars FROM labelled WHERE toxic = 0), k AS (SELECT count(*) AS m, (count(*) + 1) // 20 AS k FROM b)
    SELECT m, k, CASE WHEN k > 0 THEN (SELECT n_chars FROM (SELECT n_chars, row_number() OVER (ORDER BY n_chars DESC) AS r FROM b), k WHERE r = k) END AS threshold FROM k""")
def upper_rank_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.upper_rank(_labelled(spark, sf_dir).filter("toxic = 0"), "n_chars", 20)
    return out.select(F.col("m").cast("long").alias("m"), F.col("k").cast("long").alias("k"), "threshold")


_HALF = "concat('0x', substr(sha256('9:' || doc_id), 1, 16))::UBIGINT / pow(2, 64) < 0.5"


@query(f"""WITH {_LABELLED}, c AS (SELECT n_chars FROM labelled WHERE toxic = 0 AND {_HALF})
    SELECT doc_id, round((1 + (SELECT count(*) FROM c WHERE c.n_chars >= e.n_chars)) / ((SELECT count(*) FROM c) + 1), 9) AS p_value FROM labelled e WHERE NOT ({_HALF})""")
def conformal_p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents are split in two by hash: clean ones of one part calibrate, the other part is evaluated."""
    rows = _labelled(spark, sf_dir).withColumn("calibrates", fraction(F.col("doc_id"), 9) < 0.5)
    out = metrics.conformal_p(rows.filter("calibrates AND toxic = 0"), rows.filter("NOT calibrates"), "n_chars", "doc_id")
    return out.select("doc_id", F.round("p_value", 9).alias("p_value"))


@query("""WITH d AS (SELECT l_quantity AS a, l_extendedprice AS b FROM lineitem), r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb FROM d)
    SELECT round(corr(ra, rb), 9) AS spearman, count(*) AS n FROM r""")
def spearman_price_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("a"), F.col("l_extendedprice").alias("b"))
    return metrics.spearman(rows, "a", "b").select(F.round("spearman", 9).alias("spearman"), "n")


@query("""SELECT l_linestatus, l_returnflag, count(*) AS n, CAST(sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS hits, round(avg(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END), 9) AS rate
    FROM lineitem GROUP BY GROUPING SETS ((l_linestatus, l_returnflag), (l_linestatus), ())""")
def strata_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.strata_rates(read_table(spark, sf_dir, "lineitem"), F.col("l_discount") > 0.05, [["l_linestatus", "l_returnflag"], ["l_linestatus"], []])
    return out.select("l_linestatus", "l_returnflag", "n", "hits", F.round("rate", 9).alias("rate"))


@query("""SELECT half_open, right_closed, count(*) AS n FROM (SELECT CASE WHEN l_quantity >= 0 AND l_quantity < 10 THEN 0 WHEN l_quantity >= 10 AND l_quantity < 25 THEN 1 WHEN l_quantity >= 25 AND l_quantity <= 50 THEN 2 END AS half_open,
    CASE WHEN l_quantity > 0 AND l_quantity <= 10 THEN 0 WHEN l_quantity > 10 AND l_quantity <= 25 THEN 1 WHEN l_quantity > 25 AND l_quantity <= 50 THEN 2 END AS right_closed FROM lineitem) GROUP BY ALL""")
def stratum_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, x = [0.0, 10.0, 25.0, 50.0], F.col("l_quantity")
    rows = read_table(spark, sf_dir, "lineitem").select(joins.half_open_bin(x, edges).alias("half_open"), joins.right_closed_stratum(x, edges).alias("right_closed"))
    return rows.groupBy("half_open", "right_closed").agg(F.count("*").alias("n"))


@query("""WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
    SELECT CAST(least(floor((l_extendedprice - lo) / ((hi - lo) / 12)), 11) AS INTEGER) AS bin, count(*) AS n FROM lineitem, b GROUP BY 1""")
def price_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.histogram(read_table(spark, sf_dir, "lineitem"), "l_extendedprice", 12)


@query("""SELECT l_linestatus, round(exp(avg(ln(l_extendedprice))), 4) AS geometric_mean, CAST(floor(avg(log10(l_extendedprice))) AS INTEGER) AS decade FROM lineitem GROUP BY l_linestatus""")
def geometric_mean_decade(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.log_mean_decade(read_table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_linestatus"])
    return out.select("l_linestatus", F.round("geometric_mean", 4).alias("geometric_mean"), "decade")


@query("""WITH s AS (SELECT c_nationkey, avg(c_acctbal) AS a FROM customer GROUP BY 1) SELECT c_nationkey, round(a - lag(a) OVER (ORDER BY c_nationkey), 6) AS step,
    coalesce(lag(a) OVER (ORDER BY c_nationkey) - a > 0, false) AS falls FROM s""")
def monotone_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences along an order of a few groups, and where the value falls."""
    means = read_table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("a"))
    before = F.lag("a").over(Window.orderBy("c_nationkey"))
    return means.select("c_nationkey", F.round(F.col("a") - before, 6).alias("step"), F.coalesce(before - F.col("a") > 0, F.lit(False)).alias("falls"))


@query("""WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)
    SELECT vec_id, round(sqrt(sum(x * x)), 6) AS norm, round(sum(x), 6) AS total FROM v GROUP BY vec_id""")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("embedding")
    return read_table(spark, sf_dir, "embeddings").select(
        "vec_id", F.round(scalars.norm(x), 6).alias("norm"), F.round(F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double")), 6).alias("total")
    )


_DIMS = "v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)"


def _is_hazard() -> Column:
    return F.col("label") < 3


def _direction(rows: DataFrame) -> tuple[list[float], list[float]]:
    """Mean of both class centroids and their difference, from one aggregation."""
    cells = rows.select(_is_hazard().alias("h"), F.posexplode("embedding").alias("dim", "x")).groupBy("dim").agg(
        F.avg(F.when(F.col("h"), F.col("x").cast("double"))).alias("a"), F.avg(F.when(~F.col("h"), F.col("x").cast("double"))).alias("b")
    )
    found = cells.orderBy("dim").collect()  # a row per dimension
    return [(r["a"] + r["b"]) / 2 for r in found], [r["a"] - r["b"] for r in found]


@query(f"""WITH {_DIMS}, c AS (SELECT dim, avg(x) FILTER (label < 3) AS a, avg(x) FILTER (label >= 3) AS b FROM v GROUP BY dim)
    SELECT vec_id, round(sum((x - (a + b) / 2) * (a - b)), 9) AS score FROM v JOIN c USING (dim) GROUP BY vec_id""")
def centroid_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    mid, way = _direction(rows)
    centred = F.zip_with("embedding", F.lit(mid), lambda x, m: x.cast("double") - m)
    return rows.select("vec_id", F.round(scalars.dot(centred, F.lit(way)), 9).alias("score"))


@query(f"""WITH {_DIMS}, c AS (SELECT dim, avg(x) FILTER (label < 3) AS a, avg(x) FILTER (label >= 3) AS b FROM v GROUP BY dim),
    s AS (SELECT vec_id, any_value(label) < 3 AS pos, round(sum((x - (a + b) / 2) * (a - b)), 9) AS score FROM v JOIN c USING (dim) GROUP BY vec_id),
    r AS (SELECT pos, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS rk FROM s)
    SELECT round((sum(rk) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2) / (count(*) FILTER (pos) * count(*) FILTER (NOT pos)), 6) AS auc FROM r""")
def centroid_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    mid, way = _direction(rows)
    centred = F.zip_with("embedding", F.lit(mid), lambda x, m: x.cast("double") - m)
    scored = rows.select("label", F.round(scalars.dot(centred, F.lit(way)), 9).alias("score"))
    return metrics.roc_auc(scored, "score", _is_hazard()).select(F.round("auc", 6).alias("auc"))


@query(f"""WITH {_DIMS}, p AS (SELECT a.dim AS dim_i, b.dim AS dim_j, covar_samp(a.x, b.x) AS c FROM v a JOIN v b ON a.vec_id = b.vec_id AND a.dim <= b.dim GROUP BY ALL)
    SELECT CAST(dim_i AS INTEGER) AS dim_i, CAST(dim_j AS INTEGER) AS dim_j, round(c, 9) AS covariance FROM p""")
def covariance_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample covariances of all pairs of dimensions, from partial outer products."""
    n, total, outer = scatter(read_table(spark, sf_dir, "embeddings"), "embedding")
    cov = (outer - n * (total[:, None] / n) * (total[None] / n)) / (n - 1)
    return spark.createDataFrame([(i, j, round(float(cov[i, j]), 9)) for i in range(DIM) for j in range(i, DIM)], "dim_i int, dim_j int, covariance double")


@query(f"WITH {_DIMS} SELECT CAST(dim AS INTEGER) AS dim, round(avg(x), 9) AS mean, round(CASE WHEN stddev_pop(x) < 1e-12 THEN 1.0 ELSE stddev_pop(x) END, 9) AS std FROM v GROUP BY dim")
def zscore_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings").select(F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    return metrics.zscore_stats(rows, "embedding").select("dim", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"))


@query(f"""WITH {_DIMS}, r AS (SELECT dim, label < 3 AS pos, rank() OVER (PARTITION BY dim ORDER BY x) + (count(*) OVER (PARTITION BY dim, x) - 1) / 2 AS rk FROM v),
    a AS (SELECT dim, (sum(rk) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2) / (count(*) FILTER (pos) * count(*) FILTER (NOT pos)) AS auc FROM r GROUP BY dim)
    SELECT CAST(dim AS INTEGER) AS dim, round(greatest(auc, 1 - auc), 9) AS auc, auc >= 0.5 AS rises FROM a""")
def univariate_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area of every dimension alone, in its better direction."""
    parts = read_table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    out = metrics.roc_auc(parts, "x", _is_hazard(), ["dim"])
    return out.select("dim", F.round(F.greatest(F.col("auc"), 1 - F.col("auc")), 9).alias("auc"), (F.col("auc") >= 0.5).alias("rises"))


@query()
def mahalanobis_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance from the hazards of a vector column, boundaries, labels and risk; tested against NumPy."""
    rows = read_table(spark, sf_dir, "embeddings")
    state = regimes.load(regimes.dump(regimes.fit_distance(rows, "embedding", DIM, _is_hazard())))
    scored = rows.withColumn("distance", regimes.distance(F.col("embedding"), state))
    cuts = regimes.fit_boundaries(scored, "distance", _is_hazard())
    return regimes.apply_boundaries(scored, "distance", cuts).select("vec_id", "label", "distance", "regime_label", "risk_score", "distance_to_boundary")


@query("""SELECT label, vec_id, r AS place FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY sha256(CAST(vec_id AS VARCHAR)), CAST(vec_id AS VARCHAR)) AS r FROM embeddings) WHERE r <= 5""")
def top_refs_by_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five references of each class in the order of a digest of their ids."""
    key = F.col("vec_id").cast("string")
    w = Window.partitionBy("label").orderBy(F.sha2(key, 256), key)
    ranked = read_table(spark, sf_dir, "embeddings").select("label", "vec_id", F.row_number().over(w).alias("place"))
    return ranked.filter("place <= 5").select("label", "vec_id", F.col("place").cast("long").alias("place"))


@query("""WITH m AS (SELECT l_orderkey, l_linestatus, sum(l_quantity) AS q FROM lineitem GROUP BY ALL), p AS (SELECT l_orderkey, l_linestatus, q / sum(q) OVER (PARTITION BY l_orderkey) AS w FROM m)
    SELECT l_orderkey, round(-sum(least(greatest(w, 1e-12), 1.0) * ln(least(greatest(w, 1e-12), 1.0))), 9) AS entropy, arg_max(l_linestatus, (w, l_linestatus)) AS dominant FROM p GROUP BY l_orderkey""")
def entropy_and_dominant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy of the mix of an order, and its dominant component; ties go to the last name."""
    mix = read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linestatus").agg(F.sum("l_quantity").alias("q"))
    rows = mix.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linestatus", "q")), asc=False).alias("parts"), F.sum("q").alias("total"))
    names, weights = F.transform("parts", lambda p: p["l_linestatus"]), F.transform("parts", lambda p: p["q"] / F.col("total"))
    held = rows.select("l_orderkey", names.alias("names"), weights.alias("weights"))
    return held.select("l_orderkey", F.round(scalars.entropy(F.col("weights")), 9).alias("entropy"), scalars.dominant(F.col("names"), F.col("weights")).alias("dominant"))


@query("""SELECT page_id, contains(lower(html), 'licen') OR contains(lower(html), 'cookie') AS flagged FROM pages""")
def phrase_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages").select("page_id", scalars.holds_phrase(F.col("html"), ["licen", "cookie"]).alias("flagged"))


@query("""SELECT c_mktsegment, count(*) AS n, count(*) FILTER (c_acctbal > 0) AS n_pass, CASE WHEN count(*) < 10 THEN 'unevaluable' WHEN count(*) FILTER (c_acctbal > 0) / count(*) >= 0.9 THEN 'pass' ELSE 'fail' END AS status
    FROM customer GROUP BY c_mktsegment""")
def acceptance_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = read_table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") > 0).alias("n_pass"))
    share = F.when(F.col("n") >= 10, F.col("n_pass") / F.col("n"))
    return out.withColumn("status", metrics.status(share, 0.9, at_most=False))


@query("""SELECT s_suppkey, place FROM (SELECT s_suppkey, row_number() OVER (ORDER BY CASE WHEN s_acctbal < 0 THEN 1 ELSE 0 END, abs(s_acctbal - 5000), s_nationkey, s_suppkey) AS place FROM supplier) WHERE place <= 10""")
def candidate_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best candidates by a lexicographic key: acceptable first, then nearest, then simplest."""
    x = F.col("s_acctbal")
    key = [F.when(x < 0, 1).otherwise(0), F.abs(x - 5000), F.col("s_nationkey"), F.col("s_suppkey")]
    best = read_table(spark, sf_dir, "supplier").orderBy(*key).limit(10)
    return best.select("s_suppkey", F.row_number().over(Window.orderBy(*key)).cast("long").alias("place"))
