"""Quality rules: base measures of each text, and lines that many documents of a host share.

Method: lines are normalised (lower case, letters and digits only) and hashed; distinct documents
are counted per host and line; lines of more documents than the limit are removed; a document is
rejected when little of it is left. The host is the ``source`` column.

Copies of one document would make all of their own lines frequent. So rows are one document if the
hash of all their lines in order is the same, and two whatever else they share if it is not. And
the first document (smallest ``doc_id``) with a line keeps it, so one of any group of alike
documents stays.

A null text has no words (and fails the base rules); null hosts form one host. Rows that repeat a
``doc_id`` are measured one by one and share the decision about their lines. An empty table gives
no rows.

Scale: base measures stay inside a row. Lines are shuffled as three integers, counted with
map-side sums over (host, line, document hash) and then (host, line). A host has at most
``lines per document / share`` frequent lines. They meet the lines in a join of stored tables,
which adaptive execution broadcasts when small and splits when a line is very common.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.llm.common import SPACES, let, narrow, stored, text_or_empty, without

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
#: A line is removed when over this share of its host's documents has it, and at least so many.
MAX_SHARE = 0.1
MIN_DOCUMENTS = 20
#: A document is rejected when fewer than this percentage of its words is left.
MIN_LEFT_PERCENT = 20


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda word: word != "")


def _repeated_words(words: Column, n_words: Column) -> Column:
    """Words inside windows of three words that occur twice or more in the text."""

    def shifted(by: int) -> Column:
        return F.slice("hashes", by + 1, F.greatest(n_words - 2, F.lit(0)))

    pairs = F.zip_with(shifted(0), shifted(1), lambda a, b: F.xxhash64(a, b))
    windows = F.zip_with(pairs, shifted(2), lambda a, b: F.xxhash64(a, b))

    def covered(ordered: Column) -> Column:
        same = F.zip_with(
            ordered,
            F.slice(ordered, 2, F.size(ordered)),
            lambda a, b: F.when(a["window"] == b["window"], F.array(a["at"], b["at"])),
        )
        starts = F.array_distinct(F.flatten(F.filter(same, lambda pair: pair.isNotNull())))
        inside = F.transform(starts, lambda at: F.array(at, at + 1, at + 2))
        return F.size(F.array_distinct(F.flatten(inside)))

    def ordered(windows: Column) -> Column:
        return F.sort_array(F.transform(windows, lambda w, at: F.struct(w.alias("window"), at.alias("at"))))

    counted = let(
        windows,
        lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(let(ordered(w), covered)),
    )
    return F.when(n_words < 4, 0).otherwise(counted)


def measured(docs: DataFrame) -> DataFrame:
    """Base measures, and for each line with a word its hash and number of words."""
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    plain = F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}\n]+", " ")
    shaped = F.filter(F.transform(F.split(plain, "\n"), lambda line: F.trim(line)), lambda line: line != "")
    split = docs.select(
        "doc_id", F.md5(text_or_empty()).alias("text_md5"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"), text_or_empty().alias("text")
    ).select(
        "doc_id",
        "text_md5",
        "host",
        F.length(F.regexp_replace("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        F.transform(words_of(F.col("text")), lambda word: F.xxhash64(word)).alias("hashes"),
        let(lines, lambda all_: F.size(all_) - F.size(F.array_distinct(all_))).cast("long").alias("n_dup_lines"),
        F.transform(
            shaped,
            lambda line: F.struct(
                F.conv(F.substring(F.md5(line), 1, 15), 16, 10).cast("long").alias("line"), (F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1).alias("words")
            ),
        ).alias("lines"),
    )
    n_words = F.size("hashes")
    return split.select(
        "doc_id",
        "text_md5",
        "host",
        n_words.cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        _repeated_words(F.col("hashes"), n_words).cast("long").alias("n_repeat_words"),
        "lines",
    )


def frequent_lines(measures: DataFrame) -> DataFrame:
    """``host, line, first_id`` of the lines over the limit."""
    each = measures.select(
        "doc_id", "host", F.xxhash64("lines.line").alias("document"), F.explode(F.array_distinct("lines.line")).alias("line")
    )
    spread = each.groupBy("host", "line", "document").agg(F.min("doc_id").alias("first_id"))
    counts = spread.groupBy("host", "line").agg(F.count("*").alias("n_documents"), F.min("first_id").alias("first_id"))
    hosts = measures.groupBy("host").agg(F.count("*").alias("host_documents"))
    common = stored(counts.filter(F.col("n_documents") >= MIN_DOCUMENTS), "common-lines")
    over = F.col("n_documents") > MAX_SHARE * F.col("host_documents")
    return common.join(hosts, "host").filter(over).select("host", "line", "first_id")


def judged(docs: DataFrame) -> DataFrame:
    """Base measures, ``base_failed`` and ``kept``, beside the ``text_md5`` of the text they are about."""
    measures = stored(measured(docs), "line-hashes")
    frequent = stored(frequent_lines(measures), "frequent-lines")
    lines = measures.select("doc_id", "host", F.explode("lines").alias("at")).select(
        "doc_id", "host", "at.line", F.col("at.words").cast("long").alias("words")
    )
    removed = (
        lines.join(frequent, ["host", "line"])
        .filter(~F.col("doc_id").eqNullSafe(F.col("first_id")))
        .groupBy("doc_id")
        .agg(F.sum("words").alias("removed"))
    )
    copies_of_id = measures.groupBy("doc_id").agg(F.sum(F.expr("aggregate(lines.words, 0L, (a, w) -> a + w)")).alias("line_words"))
    spent = stored(
        removed.join(copies_of_id, "doc_id")
        .filter(100 * (F.col("line_words") - F.col("removed")) < MIN_LEFT_PERCENT * F.col("line_words"))
        .select("doc_id", F.lit(True).alias("depleted")),
        "depleted-documents",
    )
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")
    )
    return measures.drop("host", "lines").join(spent, "doc_id", "left").select(
        "doc_id", "text_md5", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & F.col("depleted").isNull()).alias("kept"),
    )


def quality(docs: DataFrame) -> DataFrame:
    """Base measures, ``base_failed`` and ``kept`` (no frequent lines took too much of it)."""
    return judged(docs).drop("text_md5")


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    bad = judged(docs).filter("NOT kept").select("doc_id", F.col("text_md5").alias("digest"))
    return without(docs, bad, F.md5(text_or_empty()))
