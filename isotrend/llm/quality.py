"""Quality rules per document and verdicts per host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isotrend.llm.common import keep_rows, whole_text, words_of
from isotrend.session import settle

SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_SHARE = 0.5
MAX_SYMBOL_SHARE = 0.1
MAX_DUPLICATE_LINE_SHARE = 0.5
# A host goes when its shrunk share of failing documents is above this.
MAX_HOST_FAILURE = 0.9


def rule_measures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """``doc_id, host, text_key`` and the counts the rules use, one row per input row.

    Everything is an expression on the row itself. A text whose three-word windows all differ,
    which ``array_distinct`` tells in one pass, has no repeated word; only the other texts sort
    their windows to find equal neighbours and the places those windows cover.
    A missing or empty text has no words, no lines with a word and zero everywhere.
    """
    body = F.col("__body")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), F.xxhash64(text).alias("text_key"),
                       whole_text(text).alias("__body"))
    rows = rows.withColumns({"__words": words_of(body),
                             "__lines": F.filter(F.split(body, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))})
    words = F.col("__words")
    counted = rows.withColumns({
        "n_words": F.size("__words").cast("bigint"), "n_lines": F.size("__lines").cast("bigint"),
        "word_chars": F.length(F.array_join("__words", "")).cast("bigint"),
        "n_symbols": F.regexp_count(body, F.lit(SYMBOLS)).cast("bigint"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint"),
        "__windows": F.slice(F.transform(words, lambda w, i: F.concat_ws(" ", w, F.get(words, i + 1),
                                                                         F.get(words, i + 2))),
                             F.lit(1), F.greatest(F.size("__words") - 2, F.lit(0)))}).drop("__body", "__words", "__lines")
    repeats = F.size(F.array_distinct("__windows")) < F.size("__windows")
    ordered = counted.withColumn("__ordered", F.when(repeats, F.array_sort(
        F.transform("__windows", lambda w, i: F.struct(w.alias("w"), i.alias("i")))))).drop("__windows")
    pairs = F.col("__ordered")

    def repeated(one: Column, k: Column) -> Column:
        before, after = F.get(pairs, k - 1)["w"], F.get(pairs, k + 1)["w"]
        return F.coalesce(one["w"] == before, F.lit(False)) | F.coalesce(one["w"] == after, F.lit(False))

    places = F.flatten(F.transform(F.filter("__ordered", repeated),
                                   lambda one: F.array(one["i"], one["i"] + 1, one["i"] + 2)))
    return ordered.withColumn("n_repeat_words", F.coalesce(F.size(F.array_distinct(places)), F.lit(0)).cast("bigint")) \
        .withColumn("n_repeat_words", F.greatest("n_repeat_words", F.lit(0))).drop("__ordered")


def base_failure() -> Column:
    """Too few words, or more than half of them in windows that repeat."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 100 * MAX_REPEAT_SHARE * F.col("n_words"))


def any_failure() -> Column:
    """The base rules, or too many symbols, or too many lines that repeat."""
    return base_failure() | (F.col("n_symbols") > MAX_SYMBOL_SHARE * F.col("word_chars")) \
        | (F.col("n_dup_lines") > MAX_DUPLICATE_LINE_SHARE * F.col("n_lines"))


def host_rates(measures: DataFrame) -> DataFrame:
    """``host, n, failures, host_failure``: the share of failing documents, shrunk by a beta prior.

    The prior is fitted to all hosts by moments: mean m of all documents and precision k from the
    spread of the hosts' shares beyond chance. A host's rate is (failures + k m) / (n + k); where
    the hosts differ by no more than chance, k is without bound and every rate is m.
    """
    hosts = measures.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count_if(any_failure()).alias("failures"))
    share = F.col("failures") / F.col("n")
    totals = hosts.agg(F.count(F.lit(1)).alias("h"), F.sum("n").alias("docs"), F.sum("failures").alias("failed"),
                       F.sum(F.col("n") * share * share).alias("squares"), F.sum(1 / F.col("n")).alias("inverse"))
    m = F.col("failed") / F.col("docs")
    # Spread of the shares around m, weighted by documents, with the correction for few hosts.
    spread = F.try_divide(F.col("h") * (F.col("squares") - F.col("docs") * m * m), (F.col("h") - 1) * F.col("docs"))
    beyond = spread - m * (1 - m) * F.col("inverse") / F.col("h")
    prior = totals.select(F.struct(m.alias("m"), F.when(beyond > 0, F.greatest(
        F.try_divide(m * (1 - m) - spread, beyond), F.lit(0.0))).alias("k")).alias("prior"))
    rated = hosts.withColumn("__prior", prior.scalar())
    m, k = F.col("__prior.m"), F.col("__prior.k")
    rate = F.when(k.isNull(), m).otherwise((F.col("failures") + k * m) / (F.col("n") + k))
    return rated.withColumn("host_failure", rate).drop("__prior")


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source",
          max_host_failure: float = MAX_HOST_FAILURE) -> DataFrame:
    """``doc_id, text_key``, the counts, ``base_failed``, ``host_failure`` and ``kept``, one row per input row.

    A document is kept when it passes the base rules and its host is not rejected. Documents
    without a host form one host. The measures, a few numbers per document, are written once, since
    the host totals and the verdicts both need them. Only rejected hosts are joined back; the
    documents of a hot host are spread by adaptive execution or never shuffled when the rejected
    hosts are few. An empty table gives no rows.
    """
    measures = settle(rule_measures(docs, doc_id, text, host))
    bad = host_rates(measures).filter(F.col("host_failure") > max_host_failure) \
        .select(F.col("host").alias("__bad_host"), "host_failure")
    judged = measures.join(bad, measures["host"].eqNullSafe(bad["__bad_host"]), "left")
    return judged.withColumns({"base_failed": base_failure(),
                               "kept": ~base_failure() & F.col("host_failure").isNull()}).drop("__bad_host")


def keep_good(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """The documents that pass, with all their columns."""
    kept = judge(docs, doc_id, text, host).filter("kept").select(F.col("doc_id").alias(doc_id), "text_key")
    return keep_rows(docs, kept, doc_id, text)
