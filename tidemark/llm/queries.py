"""Registered queries of the training-data operators: each over whole tables, with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chat, decontam, interaction, katz, linededup, mixing, quality, runs, secrets, sharding, simhash, tokenids, toxicity
from tidemark.llm.common import shared_dir, table, words


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    return katz.score(table(spark, sf_dir, "documents"), held_out)


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenids.read(spark, tokenids.write(table(spark, sf_dir, "documents")))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.strip_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.sql("SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text"
    )
    return chat.read_back(chat.expand(rows.union(extra)))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components_of(table(spark, sf_dir, "documents"))


def op11_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = secrets.Ledger(spark, f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}")
    ledger.update(docs)

    def count(rule: str):
        return F.size(F.filter("spans", lambda s: s["rule"] == rule)).cast("long").alias(f"n_{rule}")

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["rule"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["rule"].isin("assign", "access", "hex"))
    return ledger.by_path(docs).select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text; where the id's hash says so, the words from one place on repeat a stretch of them."""
    h, g = "crc32(CAST(CAST(doc_id AS STRING) AS BINARY))", "g"
    rows = docs.select("doc_id", "text", F.expr(f"{h} div 10").alias("g"), F.expr(f"{h} % 10").alias("d"), words(F.col("text")).alias("w"))
    rows = rows.withColumn("n", F.size("w")).withColumn("a", F.expr("CAST(g % nullif(n, 0) AS INT)")).withColumn("p", F.expr(f"CAST(1 + (n - a) div (3 + {g} % 8) AS INT)"))
    again = F.expr("array_join(concat(slice(w, 1, a), transform(sequence(a, n - 1), i -> w[a + (i - a) % p])), ' ')")
    return rows.select("doc_id", F.when((F.col("d") == 0) & (F.col("n") > 0), again).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(planted_periods(table(spark, sf_dir, "documents")))
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("less"))))
    start, length, period = -F.col("top.back"), F.col("top.length"), -F.col("top.less")
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("top", top).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_benchmark_decontamination, op3_katz_backoff, op4_token_ids, op5_line_dedup,
        op6_toxicity, op7_sharding, op8_chat_formatting, op9_mixing, op10_simhash,
        op11_secret_ledger, op12_periodic_runs, op13_filter_interaction_audit,
    )
}

_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: How SQL escapes: a backslash is doubled, then put behind the first character of each control string.
_ESCAPES = ("<|", "<\\|"), ("</s>", "<\\/s>"), ("<s>", "<\\s>"), ("[INST]", "[\\INST]"), ("[/INST]", "[\\/INST]"), ("<<SYS>>", "<\\<SYS>>"), ("<</SYS>>", "<\\</SYS>>")


def _escaped(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for a, b in _ESCAPES:
        out = f"replace({out}, '{a}', '{b}')"
    return out


def _rule_sql(n: int, rule: secrets.Rule) -> str:
    """All matches of one rule with their places: the text is cut at marks put around each match."""
    pattern = rule.pattern.replace("'", "''")
    enough = f"length(regexp_extract(m, '{pattern}', {rule.group})) >= {rule.least}"
    return f"""SELECT k, {n} AS n, '{rule.name}' AS rule, before AS start, before + length(m) AS stop FROM (
        SELECT k, nr, split_part(piece, chr(2), 1) AS m, sum(length(piece) - CASE WHEN nr > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
        FROM (SELECT k, unnest(p) AS piece, generate_subscripts(p, 1) AS nr FROM (SELECT k, string_split(regexp_replace(text, '({pattern})', chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS p FROM texts)))
        WHERE nr > 1 AND {enough}"""


_BASE = "rule IN ('assign', 'access', 'hex')"

ORACLES: dict[str, str] = {
    "op11_secret_ledger": f"""WITH texts AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
        spans AS ({" UNION ALL ".join(_rule_sql(n, r) for n, r in enumerate(secrets.RULES))}),
        shown AS (SELECT *, rule || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT) AS span FROM spans),
        found AS (SELECT k, count(*) FILTER (rule = 'assign') AS n_assign, count(*) FILTER (rule = 'access') AS n_access, count(*) FILTER (rule = 'hex') AS n_hex,
          string_agg(span, ',' ORDER BY start, n) FILTER ({_BASE}) AS base, string_agg(span, ',' ORDER BY start, n) AS spans FROM shown GROUP BY k)
        SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
        sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM texts LEFT JOIN found USING (k)""",
    "op5_line_dedup": f"""WITH lines AS (SELECT doc_id, row_number() OVER () AS k, source, string_split(text, chr(10)) AS all_lines FROM documents),
        each AS (SELECT k, source, unnest(all_lines) AS line, generate_subscripts(all_lines, 1) AS place FROM lines),
        bad AS (SELECT trim(line, {_WHITE}) AS line FROM each WHERE trim(line, {_WHITE}) <> '' GROUP BY 1 HAVING count(DISTINCT coalesce(source, chr(1))) >= {linededup.SPREAD}),
        kept AS (SELECT k, string_agg(e.line, chr(10) ORDER BY place) AS text, count(*) AS n FROM each e WHERE trim(e.line, {_WHITE}) NOT IN (SELECT line FROM bad) GROUP BY k)
        SELECT doc_id, CASE WHEN all_lines IS NOT NULL THEN coalesce(kept.text, '') END AS text, CAST(coalesce(len(all_lines), 0) AS BIGINT) AS n_lines,
        CAST(coalesce(len(all_lines), 0) - coalesce(n, 0) AS BIGINT) AS n_removed FROM lines LEFT JOIN kept USING (k)""",
    "op13_filter_interaction_audit": r"""WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        rows AS (SELECT t.*, coalesce(quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS toxic, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
          100 * len(regexp_replace(text, '[^A-Z]+', '', 'g')) > 3 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e
          FROM texts t LEFT JOIN labels l USING (doc_id)),
        failing AS (SELECT part, CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS fails,
          count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM rows GROUP BY ALL),
        letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        orders5 AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM letters p, letters q, letters r, letters s, letters t
          WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
        steps AS (SELECT filter_order, step, substr(filter_order, step, 1) AS own, substr(filter_order, 1, step - 1) AS before FROM orders5, (SELECT unnest([1, 2, 3, 4, 5])::INTEGER AS step)),
        hits AS (SELECT *, len(regexp_replace(before, '[^' || fails || '_]', '', 'g')) > 0 AS earlier, contains(fails, own) AS hit FROM steps, failing),
        counted AS (SELECT part, filter_order, step, own, sum(n) FILTER (NOT earlier AND NOT hit) AS kept, sum(n) FILTER (hit AND NOT earlier) AS removed, sum(n) FILTER (hit AND earlier) AS redundant,
          sum(n) FILTER (fails = own) AS unique_fails, sum(good) FILTER (hit AND NOT earlier) AS good_lost, sum(toxic) FILTER (hit AND NOT earlier) AS toxic_lost FROM hits GROUP BY ALL)
        SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
        CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
        CAST(coalesce(sum(removed) OVER (PARTITION BY part, own), 0) AS BIGINT) AS shapley FROM counted""",
    "op8_chat_formatting": f"""WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        placed AS (SELECT *, length({_escaped("role")}) + length({_escaped("text")}) + {len(chat.TURN + chat.SAYS + chat.END)} AS shown,
          row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS last FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
        grown AS (SELECT *, sum(shown) OVER (PARTITION BY conv_id ORDER BY n) AS so_far FROM placed)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
        CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
        CAST(sum(so_far) FILTER (role = 'assistant' OR n = last) AS BIGINT) AS formatted_chars FROM grown GROUP BY conv_id""",
}
