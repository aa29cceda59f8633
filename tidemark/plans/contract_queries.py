"""Queries on contracts, keys, text and scalar functions, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import keys, scalars
from tidemark.operators import contracts, hmm, metrics
from tidemark.plans.registry import query, sql
from tidemark.sources.frames import event_frames, read_table


@query("SELECT l_orderkey, count(*) AS count FROM lineitem GROUP BY 1 HAVING count(*) > 1 ORDER BY 1 LIMIT 5")
def repeated_key_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five keys that stand more than once."""
    items = contracts.require_columns(read_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])
    return contracts.repeated_keys(items, "l_orderkey")


@query("""SELECT l_orderkey, count(*) AS n_parts, abs(sum(w) - 1) <= 1e-6 AND min(w) >= 0 AS is_distribution FROM (
    SELECT l_orderkey, l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey) - CASE WHEN l_linenumber = 7 THEN 0.5 ELSE 0 END AS w FROM lineitem) GROUP BY 1""")
def probability_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of an order's lines, spoilt in orders of seven lines."""
    rows = read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"), F.collect_list(F.struct("l_quantity", "l_linenumber")).alias("parts"))
    shares = rows.select("l_orderkey", F.transform("parts", lambda p: p["l_quantity"] / F.col("q") - F.when(p["l_linenumber"] == 7, 0.5).otherwise(0.0)).alias("w"))
    return shares.select("l_orderkey", F.size("w").cast("long").alias("n_parts"), contracts.is_probability(F.col("w")).alias("is_distribution"))


@query("""SELECT conv_id, count(*) AS n, bool_and(step IS NULL OR (step > 0 AND step = first)) AS is_uniform FROM (
    SELECT conv_id, step, max(CASE WHEN place = 2 THEN step END) OVER (PARTITION BY conv_id) AS first FROM (
      SELECT conv_id, turn - lag(turn) OVER w AS step, row_number() OVER w AS place FROM conversations WHERE turn <> 3 WINDOW w AS (PARTITION BY conv_id ORDER BY turn))) GROUP BY 1""")
def grid_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as a grid; the fourth turn is left out, which breaks the longer ones."""
    grids = read_table(spark, sf_dir, "conversations").filter("turn <> 3").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.col("turn").cast("double"))).alias("g"))
    return grids.select("conv_id", F.size("g").cast("long").alias("n"), contracts.is_uniform_grid(F.col("g")).alias("is_uniform"))


@query(sql("frames", "SELECT sample_id, CAST(sample_id AS BIGINT) % 3 = 0 AS from_t, round(timestamp, 3) AS timestamp FROM frames"))
def time_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One time column from two, of which the first is missing in every third row."""
    third = F.col("sample_id").cast("long") % 3 == 0
    rows = event_frames(spark, sf_dir).withColumn("t", F.col("timestamp")).withColumn("timestamp", F.when(~third, F.col("timestamp")))
    return contracts.unify_time(rows).select("sample_id", third.alias("from_t"), F.round("timestamp", 3).alias("timestamp"))


@query("""SELECT CAST(user_id AS VARCHAR) AS sequence_id, CAST(event_id AS VARCHAR) AS sample_id, coalesce(CASE WHEN value > 50 THEN event_type END, '') AS transition_alert FROM events""")
def typed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("sequence_id"), F.col("event_id").alias("sample_id"), F.when(F.col("value") > 50, F.col("event_type")).alias("transition_alert"))
    return contracts.common_types(rows)


@query("""SELECT vec_id, bool_and(abs(x - s) <= 1e-12 + 0.2 * abs(s)) AS matches, bool_and(abs(x - s) <= 0.01) AS near FROM (SELECT vec_id, x, round(x, 2) AS s FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings)) GROUP BY 1""")
def vector_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors against scalar columns that are rounded values of them, within a relative and an absolute tolerance."""
    rows = read_table(spark, sf_dir, "embeddings").withColumn("x", F.transform("embedding", lambda v: v.cast("double")))
    scalar = [F.round(F.col("x")[k], 2) for k in range(64)]
    return rows.select("vec_id", contracts.vector_matches(F.col("x"), scalar, rtol=0.2).alias("matches"), contracts.vector_matches(F.col("x"), scalar, rtol=0.0, atol=0.01).alias("near"))


@query(sql("actions", """SELECT sample_id, round(score, 6) AS score, round(score, 6) AS by_risk, CASE WHEN action = 'CONFIRM' THEN 1.0 ELSE 0.0 END::DOUBLE AS by_action FROM actions"""))
def score_defaulting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The column that scores an action table, from what there is: a score, a risk, or the action alone."""
    from tidemark.plans.alarms import action_frames

    rows = action_frames(spark, sf_dir)
    pick = lambda *c: contracts.score_column(list(c))
    return rows.select("sample_id", F.round(pick("action", "score", "risk_score"), 6).alias("score"), F.round(pick("action", "risk_score"), 6).alias("by_risk"), pick("action").alias("by_action"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def allow_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "nation")
    return contracts.allow_only(rows.select("n_nationkey", "n_name", "n_regionkey"), ["n_nationkey", "n_name", "n_regionkey"], ["label"])


@query("""SELECT vec_id, CAST(count(*) FILTER (x > -0.1 AND x < 0.1) AS INTEGER) AS n_valid, count(*) FILTER (x > -0.1 AND x < 0.1) >= 0.5 * count(*) AS evaluable
    FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1""")
def channel_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels strictly inside the range, and vectors with enough of them."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    return read_table(spark, sf_dir, "embeddings").select("vec_id", F.size(contracts.valid_channels(x, -0.1, 0.1)).alias("n_valid"), contracts.evaluable(x, -0.1, 0.1, 0.5).alias("evaluable"))


@query("SELECT doc_id, quality IS NOT NULL AND n_chars > 0 AS common, CASE WHEN n_chars > 0 THEN round(ln(n_chars), 6) END AS a FROM documents LEFT JOIN labels USING (doc_id)")
def common_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows on which every arm has a finite score."""
    rows = read_table(spark, sf_dir, "documents").join(read_table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    arms = rows.withColumns({"a": F.when(F.col("n_chars") > 0, F.ln("n_chars")), "b": F.col("quality").cast("double")})
    return arms.select("doc_id", contracts.common_finite(["a", "b"]).alias("common"), F.round("a", 6).alias("a"))


@query("""SELECT count(*) AS n_rows, count(*) FILTER (len(embedding) = 0) AS n_empty, 0::BIGINT AS n_not_finite, min(len(embedding))::INTEGER AS least, max(len(embedding))::INTEGER AS greatest FROM embeddings""")
def vector_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A continuous observation: vectors of one length, none empty, all finite."""
    return contracts.vector_lengths(contracts.require_vectors(read_table(spark, sf_dir, "embeddings"), "embedding"), "embedding")


@query(sql("frames", """SELECT count(*) FILTER (label = 'hazard') AS n_positive, count(*) FILTER (label = 'benign') AS n_negative, count(*) FILTER (label NOT IN ('hazard', 'benign')) AS n_other,
    count(*) FILTER (label = 'hazard') > 0 AND count(*) FILTER (label = 'benign') > 0 AND count(*) FILTER (label NOT IN ('hazard', 'benign')) = 0 AS usable FROM frames"""))
def class_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.class_counts(contracts.require_both_classes(event_frames(spark, sf_dir), "label", "hazard", "benign"), "label", "hazard", "benign")


@query("""SELECT count(*) FILTER (a IS NOT DISTINCT FROM b) AS n_same, count(*) FILTER (a IS DISTINCT FROM b) AS n_different FROM (
    SELECT CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS a, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_orderstatus END AS b FROM orders)""")
def series_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (F.when(F.col("o_orderkey") % k != 0, F.col("o_orderstatus")) for k in (3, 2))
    equal = contracts.same(a, b)
    return read_table(spark, sf_dir, "orders").agg(F.count_if(equal).alias("n_same"), F.count_if(~equal).alias("n_different"))


@query("""SELECT CAST(conv_id AS VARCHAR) AS sequence_id, count(*) AS n_frames, count(*) = 4 AND count(DISTINCT turn) = 4 AND min(turn) = 0 AND max(turn) = 3 AS complete FROM conversations GROUP BY conv_id""")
def complete_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations of exactly four turns numbered from zero."""
    rows = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("sequence_id"), F.col("turn").cast("double").alias("timestamp"), F.concat_ws("/", "conv_id", "turn").alias("sample_id"))
    return contracts.complete_sequences(rows, 4)


@query("""SELECT count(*) AS n_rows, 0::BIGINT AS n_blank, count(*) - count(DISTINCT c_nationkey) AS n_repeated, count(*) FILTER (c_acctbal < 0) AS n_bad_scores FROM customer""")
def score_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("sequence_id"), F.col("c_acctbal").cast("double").alias("score"))
    return contracts.score_faults(rows)


_HALF = "concat('0x', substr(sha256('9:' || doc_id), 1, 16))::UBIGINT / pow(2, 64) < 0.5"


@query(f"""WITH labelled AS (SELECT doc_id, n_chars, toxic FROM documents JOIN labels USING (doc_id)), c AS (SELECT n_chars FROM labelled WHERE toxic = 0 AND {_HALF})
    SELECT doc_id, (1 + (SELECT count(*) FROM c WHERE c.n_chars >= e.n_chars)) / ((SELECT count(*) FROM c) + 1) <= 0.05 AS rejected FROM labelled e WHERE NOT ({_HALF})""")
def decisions_at_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conformal p-values of held-out documents against a level agreed beforehand."""
    rows = read_table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(read_table(spark, sf_dir, "labels"), "doc_id").withColumn("calibrates", keys.fraction(F.col("doc_id"), 9) < 0.5)
    p = metrics.conformal_p(rows.filter("calibrates AND toxic = 0"), rows.filter("NOT calibrates"), "n_chars", "doc_id")
    return contracts.decided(p, 0.05).select("doc_id", "rejected")


@query("""WITH e AS (SELECT vec_id, label, CASE WHEN vec_id % 11 = 0 AND label < 5 THEN NULL ELSE embedding[1]::DOUBLE END AS log_lr, embedding FROM embeddings),
    whole AS (SELECT label FROM e GROUP BY label HAVING bool_and(log_lr IS NOT NULL))
    SELECT CAST(vec_id AS VARCHAR) AS sample_id, 9 AS channels, round(list_sum(list_transform(embedding[1:8], lambda x: x::DOUBLE)) + log_lr, 6) AS total FROM e SEMI JOIN whole USING (label)""")
def evidence_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight channels with the frame's evidence as the ninth, where no frame of the sequence lacks it."""
    rows = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("sample_id"), F.col("label").cast("string").alias("sequence_id"), F.transform(F.slice("embedding", 1, 8), lambda v: v.cast("double")).alias("x"))
    lost = (F.col("sample_id").cast("long") % 11 == 0) & (F.col("sequence_id").cast("int") < 5)
    evidence = rows.select("sample_id", "sequence_id", F.when(~lost, F.col("x")[0]).alias("log_lr"))
    out = contracts.with_evidence(rows, evidence)
    return out.select("sample_id", F.size("v").alias("channels"), F.round(F.aggregate("v", F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


@query(sql("splits", """SELECT sample_id, CASE WHEN CAST(f.sequence_id AS BIGINT) % 5 = 0 THEN 'unavailable' ELSE split END AS split, CASE WHEN score > 100 THEN 'unknown' ELSE label END AS label FROM frames f JOIN splits USING (sequence_id)"""))
def attached_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits from an assignment that lacks every fifth sequence; labels that are missing are unknown."""
    rows = event_frames(spark, sf_dir).withColumn("label", F.when(F.col("score") <= 100, F.col("label")))
    ids = rows.select(F.col("sequence_id").alias("id")).distinct().filter("cast(id AS long) % 5 <> 0")
    return contracts.attach_split(rows, ids.select("id", keys.split_of(F.col("id")).alias("split")), "sequence_id").select("sample_id", "split", "label")


@query(sql("splits", """SELECT sample_id, s.sequence_id, split FROM frames JOIN splits s USING (sequence_id) WHERE split = 'val'"""))
def split_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split of a sequence given to its samples, as an expression that a scan can filter by."""
    rows = event_frames(spark, sf_dir).withColumn("split", keys.split_of(F.col("sequence_id")))
    return rows.filter("split = 'val'").select("sample_id", "sequence_id", "split")


@query(sql("frames", """SELECT sequence_id, concat('0x', substr(sha256('42:' || sequence_id), 1, 16))::UBIGINT / pow(2, 64) < 0.9 AS is_fit FROM (SELECT DISTINCT sequence_id FROM frames)"""))
def guarded_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit and validation sequences by hash; were a side empty, one sequence would move to it."""
    ids = event_frames(spark, sf_dir).select("sequence_id").distinct()
    return keys.two_way_split(ids, "sequence_id", 0.9, 42).select("sequence_id", "is_fit")


@query(sql("frames", """SELECT sequence_id, sha256(string_agg(sha256(sample_id || '|' || CAST(CAST(round(score * 1000) AS BIGINT) AS VARCHAR)), '' ORDER BY timestamp, sample_id)) AS fingerprint FROM frames GROUP BY 1"""))
def row_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of a sequence's rows in order: a digest of the digests of its rows."""
    text = F.concat_ws("|", "sample_id", F.round(F.col("score") * 1000).cast("long").cast("string"))
    return keys.fingerprint(event_frames(spark, sf_dir), ["sequence_id"], text, ["timestamp", "sample_id"])


@query("""SELECT doc_id, 'seq_' || lpad(CAST(doc_id AS VARCHAR), 6, '0') AS padded, sha256('{"id":' || doc_id || ',"lang":"' || lang || '"}') AS json_hash, sha256(coalesce(text, '')) AS text_hash FROM documents WHERE lang IS NOT NULL""")
def ids_and_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padded ids, and digests of text and of canonical JSON (sorted keys, no spaces)."""
    rows = read_table(spark, sf_dir, "documents").filter("lang IS NOT NULL")
    canonical = F.to_json(F.struct(F.col("doc_id").alias("id"), "lang"))
    return rows.select("doc_id", keys.padded("seq_", F.col("doc_id"), 6).alias("padded"), F.sha2(canonical, 256).alias("json_hash"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_hash"))


@query("SELECT event_id, event_type || CASE WHEN event_id % 2 = 0 THEN '|X' ELSE '|Y' END AS codes, 2 AS n FROM events")
def reason_code_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes from a JSON list or from text with separators; blank ones go."""
    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('["'), "event_type", F.lit('","X"]'))).otherwise(F.concat("event_type", F.lit("; ,Y")))
    return read_table(spark, sf_dir, "events").select("event_id", F.array_join(scalars.reason_codes(text), "|").alias("codes"), F.size(scalars.reason_codes(text)).alias("n"))


@query(sql("frames", """SELECT sample_id, CASE WHEN k IS NULL THEN 'bad' ELSE 'object' END AS root, CASE WHEN score <= 300 THEN round(score, 6) END AS clean, round(least(greatest(score, 10.0), 100.0), 6) AS clipped
    FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM frames)"""))
def guarded_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON objects by their root, numbers that are not finite as null, and values clipped to a range."""
    x = F.when(F.col("score") <= 300, F.col("score")).otherwise(F.lit(float("inf")))
    k = F.from_json("props", "struct<k: bigint>")["k"]
    return event_frames(spark, sf_dir).select(
        "sample_id", F.when(k.isNull(), "bad").otherwise("object").alias("root"), F.round(scalars.null_if_not_finite(x), 6).alias("clean"), F.round(scalars.clip(F.col("score"), 10.0, 100.0), 6).alias("clipped")
    )


@query("""SELECT l_orderkey, l_linenumber, round(l_quantity / 70.7 * (1 + 0.25 * l_discount) * (1 + 0.05 * l_tax) / greatest(cos(radians(l_linenumber * 15)), 0.2), 6) AS path,
    round(l_extendedprice / 7777 * l_quantity / 70.7 * (1 + 0.25 * l_discount) * (1 + 0.05 * l_tax) / greatest(cos(radians(l_linenumber * 15)), 0.2), 5) AS dose FROM lineitem""")
def effective_dose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effective path by humidity, dust and angle, and concentration times it, with columns of the table as latents."""
    path = scalars.effective_path(F.col("l_quantity") / 70.7, F.col("l_discount"), F.col("l_tax"), F.col("l_linenumber") * 15)
    return read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(path, 6).alias("path"), F.round(F.col("l_extendedprice") / 7777 * path, 5).alias("dose"))


@query("""WITH m AS (SELECT o_custkey, o_orderstatus AS c, sum(o_totalprice) AS w FROM orders GROUP BY ALL), p AS (SELECT *, w / sum(w) OVER (PARTITION BY o_custkey) AS share FROM m)
    SELECT o_custkey, arg_max(c, (share, -ascii(c))) AS dominant, bool_or(c = 'F') AS is_hazard, round(sum(CASE WHEN c = 'F' THEN share ELSE 0 END), 6) AS hazard_share FROM p GROUP BY 1""")
def mixture_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a mixture: its dominant component, whether any component is in the hazard set, and their share."""
    m = read_table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.sum("o_totalprice").alias("w"))
    rows = m.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderstatus", "w"))).alias("p"), F.sum("w").alias("t"))
    held = rows.select("o_custkey", F.transform("p", lambda x: x["o_orderstatus"]).alias("c"), F.transform("p", lambda x: x["w"] / F.col("t")).alias("s"))
    share = F.aggregate(F.zip_with("c", "s", lambda c, s: F.when(c == "F", s).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    return held.select("o_custkey", scalars.dominant(F.col("c"), F.col("s")).alias("dominant"), F.exists("c", lambda c: c == "F").alias("is_hazard"), F.round(share, 6).alias("hazard_share"))


@query("""SELECT l_orderkey, l_linenumber, round(ln(0.9 * exp(x) + 0.1) - ln(0.1 * exp(x) + 0.9), 6) AS moved, round(ln(1 + exp(x)), 6) AS soft
    FROM (SELECT l_orderkey, l_linenumber, (l_quantity - 25) / 5 AS x FROM lineitem)""")
def log_space_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A step of the switching chain in log odds, and the logarithm of a sum of exponentials."""
    x = (F.col("l_quantity") - 25) / 5
    return read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(scalars.switch_step(x, 0.1), 6).alias("moved"), F.round(scalars.log1p_exp(x), 6).alias("soft"))


@query("""WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), r AS (SELECT i, x FROM v WHERE vec_id = (SELECT min(vec_id) FROM v))
    SELECT vec_id, round(sum(v.x * r.x), 6) AS dot, round(sum((v.x - r.x) * (v.x - r.x)), 6) AS squared FROM v JOIN r USING (i) GROUP BY vec_id""")
def vector_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dot product with, and squared distance from, the first vector."""
    rows = read_table(spark, sf_dir, "embeddings")
    first = [float(x) for x in rows.orderBy("vec_id").select("embedding").first()[0]]
    return rows.select("vec_id", F.round(scalars.dot(F.col("embedding"), F.lit(first)), 6).alias("dot"), F.round(scalars.squared_distance(F.col("embedding"), F.lit(first)), 6).alias("squared"))


@query("""SELECT c_custkey, CASE WHEN p >= 0.95 AND s >= 20 THEN 'A' WHEN p >= 0.85 AND s >= 10 THEN 'B' WHEN p >= 0.7 AND s >= 5 THEN 'C' ELSE 'D' END AS grade,
    CASE WHEN p >= 0.95 AND s >= 30 THEN 'HIGH' WHEN p >= 0.85 AND s >= 10 THEN 'MEDIUM' ELSE 'LOW' END AS priority,
    round(CASE WHEN s > 0 THEN (s - p) / s ELSE CASE WHEN p <= 0 THEN 0.0 ELSE -1.0 END END, 6) AS reduction FROM (SELECT c_custkey, (c_custkey % 100) / 99 AS p, greatest(c_acctbal, 0) / 250 AS s FROM customer)""")
def grades_and_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "customer").select("c_custkey", ((F.col("c_custkey") % 100) / 99).alias("p"), (F.greatest("c_acctbal", F.lit(0.0)) / 250).alias("s"))
    p, s = F.col("p"), F.col("s")
    return rows.select("c_custkey", hmm.grade(p, s).alias("grade"), hmm.priority(p, s).alias("priority"), F.round(scalars.toggle_reduction(p, s), 6).alias("reduction"))


@query("""SELECT CAST(user_id AS VARCHAR) AS sequence_id, count(*) AS n_breaks FROM (SELECT user_id, epoch_us(ts) / 1e6 AS t, lag(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY event_id * 7919 % 1000003) AS before FROM events) WHERE before > t GROUP BY 1""")
def time_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames whose time is before that of the frame before them, in an order that is not theirs. The order comes from the
    id itself, as nine digits of it are not all; frames at one place of the order stand by id, which SQL leaves open."""
    rows = read_table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("sequence_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("timestamp"),
        (F.col("event_id") * 7919 % 1000003).alias("position"), "event_id",
    )
    return contracts.time_breaks(rows, ("event_id", "timestamp")).groupBy("sequence_id").agg(F.count("*").alias("n_breaks"))


@query("""SELECT n_nationkey, '{"a":{"x":' || n_nationkey || ',"y":2},"b":[1,2],"name":"' || n_name || '"}' AS merged, 2::BIGINT AS leaves,
    '{"kind":"' || CASE WHEN n_nationkey % 2 = 0 THEN 'even' ELSE 'odd' END || '","size":' || CASE WHEN n_nationkey % 3 = 0 THEN 10 ELSE n_nationkey END || '}' AS checked, n_nationkey % 3 = 0 OR n_nationkey <= 20 AS valid FROM nation""")
def merged_configurations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A base patched in depth, the leaves of the patch, and a configuration checked against a schema with defaults."""
    schema = {"type": "object", "required": ["kind"], "properties": {"kind": {"type": "string", "enum": ["even", "odd"]}, "size": {"type": "integer", "default": 10}}}
    bounded = {"type": "object", "properties": {"kind": {"type": "string"}, "size": {"type": "integer", "default": 10, "maximum": 20}}}

    def rows(batches):
        import pandas as pd

        from tidemark.plans import config
        from tidemark.sources.sinks import canonical_json

        def fits(value) -> bool:
            try:
                config.validate(value, bounded)
            except config.ConfigError:
                return False
            return True

        for b in batches:
            out = []
            for k, name in zip(b["n_nationkey"].tolist(), b["n_name"]):
                patch = {"a": {"x": k}, "name": name}
                own = {"kind": "even" if k % 2 == 0 else "odd"} | ({} if k % 3 == 0 else {"size": k})
                out.append((k, canonical_json(config.merge({"a": {"x": 1, "y": 2}, "b": [1, 2]}, patch)), config.complexity(patch), canonical_json(config.validate(own, schema)), fits(own)))
            yield pd.DataFrame(out, columns=["n_nationkey", "merged", "leaves", "checked", "valid"])

    return read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name").mapInPandas(rows, "n_nationkey int, merged string, leaves long, checked string, valid boolean")


@query("SELECT n_nationkey, n_nationkey % 2 = 0 AND n_nationkey % 3 <> 0 AS settings_agree, NOT (n_nationkey % 5 = 0) AS inputs_there FROM nation")
def frozen_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of runs against a frozen model's, and whether the tables that their observations need are given."""

    def holds(check, *args) -> bool:
        try:
            check(*args)
        except ValueError:
            return False
        return True

    def rows(batches):
        frozen = {"states": ["a", "b"], "confirmable": ["a"], "ordering": ["a", "b"], "observations": "hybrid", "field": "z", "dt_seconds": 1.0, "include_smoothing": False}
        for b in batches:
            keys = b["n_nationkey"].tolist()
            agree = [holds(hmm.check_runtime, frozen | {"dt_seconds": 1.0 + k % 2, "field": "x" if k % 3 == 0 else "z"}, frozen) for k in keys]
            there = [holds(hmm.check_inputs, "continuous", "z", None if k % 5 == 0 else "table", None) for k in keys]
            yield b.assign(settings_agree=agree, inputs_there=there)

    return read_table(spark, sf_dir, "nation").select("n_nationkey").mapInPandas(rows, "n_nationkey int, settings_agree boolean, inputs_there boolean")
