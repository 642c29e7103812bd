"""The registered queries of the operators, each over its whole table, and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isotrend.llm import (backoff_lm, conversation_repair, exact_dedup, language_id, licenses, mixing, packing, periodic_runs,
                          pii, quality, quality_classifier, simhash, token_files)
from isotrend.llm.common import id_hash, whole_text, words_of
from isotrend.plans.tables import table
from isotrend.session import scratch_path

QUERIES, ORACLES = {}, {}


def register(name: str, sql: str | None = None):
    def add(query):
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query
    return add


@register("op1_language_id")
def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    answered = language_id.identify(table(spark, folder, "documents"))
    return answered.select("doc_id", "held_out", "lang_pred", "score", F.size("spans").alias("n_spans"))


@register("op2_pii")
def op2_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.personal_data(table(spark, folder, "documents"))
    base = pii.listed(lambda s: s["kind"].isin(*pii.BASE))
    return found.select("doc_id", *[pii.count_of(kind).alias(f"n_{kind}") for kind in pii.BASE],
                        F.sha2(base, 256).alias("base_sha256"), pii.listed().alias("spans"),
                        F.size("spans").cast("long").alias("n_spans"))


@register("op3_simhash")
def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, folder, "documents"))
    return groups.select("doc_id", "fingerprint", "component_id")


@register("op4_token_files")
def op4_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_files.write_tokens(table(spark, folder, "documents"), path)
    return token_files.with_crc(token_files.read_tokens(spark, path))


@register("op5_license_scan")
def op5_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan(table(spark, folder, "documents"))
    return found.select("doc_id", "notice", "containment", "start", "n_shingles")


@register("op6_backoff_lm")
def op6_backoff_lm(spark: SparkSession, folder: str) -> DataFrame:
    return backoff_lm.scores(table(spark, folder, "documents"))


@register("op7_packing")
def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(table(spark, folder, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("token_ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset", "tier", "step_id")


@register("op8_quality_rules", r"""
WITH words AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
spread AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS win
  FROM words, unnest(range(1, greatest(len(w) - 1, 1))) AS r(i)),
repeated AS (
  SELECT doc_id, count(DISTINCT place) AS n_repeat_words FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS place
    FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM spread) WHERE c > 1)
  GROUP BY doc_id),
lines AS (
  SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM words),
measured AS (
  SELECT w.doc_id, source AS host, len(w.w) AS n_words, coalesce(r.n_repeat_words, 0) AS n_repeat_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(l) - len(list_distinct(l)) AS n_dup_lines, len(l) AS n_lines
  FROM words w LEFT JOIN repeated r USING (doc_id) JOIN lines USING (doc_id)),
failed AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    n_symbols > 0.1 * word_chars OR n_dup_lines > 0.5 * n_lines AS more_failed FROM measured),
hosts AS (
  SELECT host, count(*) AS n, count(*) FILTER (base_failed OR more_failed) AS f FROM failed GROUP BY host),
totals AS (
  SELECT count(*) AS h, sum(n) AS docs, sum(f) / sum(n) AS m, sum(f * f / n) AS squares, sum(1 / n) AS inverse
  FROM hosts),
spreads AS (
  SELECT *, CASE WHEN h > 1 THEN h * (squares - docs * m * m) / ((h - 1) * docs) END AS s FROM totals),
prior AS (
  SELECT m, CASE WHEN s - m * (1 - m) * inverse / h > 0
    THEN greatest((m * (1 - m) - s) / (s - m * (1 - m) * inverse / h), 0) END AS k FROM spreads),
bad AS (
  SELECT host FROM hosts, prior WHERE CASE WHEN k IS NULL THEN m ELSE (f + k * m) / (n + k) END > 0.9)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.host IS NOT DISTINCT FROM failed.host) AS kept
FROM failed""")
def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.judge(table(spark, folder, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept")


@register("op9_mixing")
def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_report(table(spark, folder, "documents"))


@register("op10_exact_dedup", r"""
WITH rows AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
grouped AS (
  SELECT doc_id, sha256(t) AS text_sha256, min(doc_id) OVER (PARTITION BY t) AS keep_id,
    count(*) OVER (PARTITION BY t) AS group_size FROM rows)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM grouped""")
def op10_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    groups = exact_dedup.exact_groups(table(spark, folder, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@register("op11_quality_classifier")
def op11_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    scored = quality_classifier.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def repeated_tails(docs: DataFrame) -> DataFrame:
    """Documents of which one in ten, by the hash of its id, repeats its words from some place on."""
    h = id_hash("doc_id")
    g = F.floor(h / 10)
    rows = docs.select("doc_id", whole_text().alias("text"), g.alias("g"),
                       F.when(h % 10 == 0, words_of(whole_text())).alias("words"))
    rows = rows.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))

    def word(_, i):
        source = F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
        return F.get(F.col("words"), source.cast("int"))

    damaged = F.array_join(F.transform("words", word), " ")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), damaged).otherwise(F.col("text")).alias("text"))


@register("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs.periodic_runs(repeated_tails(table(spark, folder, "documents")))
    # The runs are in order of start and period, so the first of equal exponents stays.
    best = F.aggregate(F.slice("runs", 2, F.greatest(F.size("runs") - 1, F.lit(0))), F.get("runs", F.lit(0)),
                       lambda b, r: F.when(r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]),
                                                   F.lit("\n")))
    shown = found.select("doc_id", "collapsed", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
                         F.array_join(lines, "").alias("lines"))
    return shown.select("doc_id", "n_runs", "best.start", "best.length", "best.period",
                        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                        F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def damaged_turns(turns: DataFrame) -> DataFrame:
    """Conversations with faults of five kinds, by a hash of conversation and turn; anything missing is one space."""
    filled = turns.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    place = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    fault = F.crc32(place.cast("binary")) % 20
    marked = filled.withColumn("fault", fault).filter("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1)))
    return marked.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("copy")).drop("copy")


@register("op13_conversation_repair")
def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    mended = conversation_repair.repair(damaged_turns(turns))
    asked = turns.select("conv_id").distinct()
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    found = mended.summary.withColumnRenamed("conv_id", "found_id")
    hashes = conversation_repair.hashed(mended.pieces).withColumnRenamed("conv_id", "hash_id")
    rows = asked.join(found, F.col("conv_id").eqNullSafe(F.col("found_id")), "left") \
        .join(hashes, F.col("conv_id").eqNullSafe(F.col("hash_id")), "left")
    return rows.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers],
                       F.coalesce("audit", F.lit("")).alias("audit"),
                       F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
