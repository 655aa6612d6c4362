"""Quality rules in native DataFrame operations, with cross-document line frequency.

Base rules look at one document: too few words, or too many words in repeated
five-word windows. The cross-document rule hashes normalised lines, counts the distinct
texts of each host (column source) that have a line, and calls lines in more than a SHARE of
the host's distinct texts, and in more than FLOOR texts, boilerplate. Boilerplate is removed from every text but the first (by doc_id) that has
it, so content that many documents share survives once. A document that keeps less than
KEEP of its distinct lines' words is depleted and rejected.

Only lines (hash, host, text hash, word count) are shuffled, not texts. The count of
a line is pre-aggregated before its exchange, and the join that brings verdicts back to
lines is a plain equi-join, whose large partitions adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A line in more than this share of a host's distinct texts, and in more than FLOOR of them, is boilerplate.
SHARE, FLOOR = 0.02, 10
#: Least share of words that must be left once boilerplate lines are removed.
KEEP = 0.2
WINDOW = 5
LEAST_WORDS, MOST_REPEATED = 10, 20  # words; percent of words
SPACE = "[\\x20\\x09-\\x0D]+"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def _raw_lines(text: Column) -> Column:
    """The lines with a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))


def _lines(raw: Column) -> Column:
    """The distinct ones of lines with a word, trimmed, with single spaces."""
    return F.array_distinct(F.transform(raw, lambda x: F.trim(F.regexp_replace(x, SPACE, " "))))


def _count(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _repeated(hashes: Column) -> Column:
    """How many words lie in windows whose hash occurs twice or more, given the windows' hashes by position.

    Sorting brings equal hashes side by side; the sorted positions p of repeated ones
    cover WINDOW words each, less what the next one covers too.
    """
    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = F.zip_with(ordered, F.slice(ordered, 2, F.greatest(F.size(ordered) - 1, F.lit(0))), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    at = F.sort_array(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull()))))
    return F.aggregate(
        at,
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")),
        lambda a: a["n"],
    )


def base_metrics(docs: DataFrame, *carried: Column) -> DataFrame:
    """One row for each document with the base counts, host, text hash, the words of its distinct lines and what is carried."""
    d = docs.select("doc_id", F.coalesce("source", F.lit("\0")).alias("host"), F.coalesce("text", F.lit("")).alias("t"), *carried)
    d = d.withColumns({"words": _words(F.col("t")), "raw": _raw_lines(F.col("t")), "text_hash": F.xxhash64("t")}).withColumn("lines", _lines(F.col("raw")))
    w = F.col("words")
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW))))
    d = d.withColumns({
        "n_words": F.size("words").cast("long"),
        "word_chars": F.length(F.array_join("words", "")).cast("long"),
        "n_symbols": F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size("raw") - F.size(F.array_distinct("raw"))).cast("long"),
        "line_words": F.aggregate("lines", F.lit(0), lambda a, x: a + _count(x)),
        "windows": F.when(F.size(w) > WINDOW, windows).otherwise(F.array().cast("array<bigint>")),
    })
    twice = F.size(F.array_distinct("windows")) < F.size("windows")
    d = d.withColumn("n_repeat_words", F.when(twice, _repeated(F.col("windows"))).otherwise(0).cast("long"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rest = d.columns[3 : 3 + len(carried)]
    return d.select("doc_id", "host", "text_hash", "line_words", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), *rest)


def boilerplate(docs: DataFrame, share: float = SHARE, floor: int = FLOOR) -> DataFrame:
    """host, text_hash, line and words of the lines to remove from each text."""
    d = docs.select("doc_id", F.coalesce("source", F.lit("\0")).alias("host"), F.coalesce("text", F.lit("")).alias("t"))
    d = d.withColumn("text_hash", F.xxhash64("t"))
    lines = d.select("doc_id", "host", "text_hash", F.explode(_lines(_raw_lines(F.col("t")))).alias("line"))
    lines = lines.select("doc_id", "host", "text_hash", F.xxhash64("line").alias("line"), _count(F.col("line")).alias("words"))
    once = lines.groupBy("host", "line", "text_hash").agg(F.min("doc_id").alias("doc_id"), F.max("words").alias("words"))
    often = once.groupBy("host", "line").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "text_hash")).alias("first"))
    # Few lines pass the floor, so that the join with the hosts' sizes is small whatever a host's size.
    sizes = d.select("host", "text_hash").distinct().groupBy("host").agg(F.count("*").alias("texts"))
    often = often.where(F.col("n") > floor).join(sizes, "host").where(F.col("n") > share * F.col("texts")).select("host", "line", F.col("first.text_hash").alias("first"))
    return once.join(often, ["host", "line"]).where(F.col("text_hash") != F.col("first")).select("host", "text_hash", "line", "words")


def quality(docs: DataFrame, share: float = SHARE, floor: int = FLOOR, keep: float = KEEP) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, removed_words and kept for every row of docs.

    Needs columns doc_id, text and source; others are ignored. A null text is empty and
    fails the base rules; a null source is a host of its own. Exact copies within a
    host count once in line frequencies and share their verdict, as do repeated rows. Texts
    with the same smallest doc_id tie by text hash. Empty tables give empty results. Windows, lines
    and texts are compared by 64-bit hashes, within one document or one host.
    """
    removed = boilerplate(docs, share, floor).groupBy("host", "text_hash").agg(F.sum("words").alias("removed_words"))
    d = base_metrics(docs).join(removed, ["host", "text_hash"], "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long"))
    kept = ~F.col("base_failed") & (F.col("line_words") - F.col("removed_words") >= keep * F.col("line_words"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", kept.alias("kept"))


def cleaned(docs: DataFrame, share: float = SHARE, floor: int = FLOOR, keep: float = KEEP) -> DataFrame:
    """The rows of docs that quality() keeps, all columns, with boilerplate lines removed from text and n_chars, if there, to match.

    A verdict is one for each text of a host, so verdicts join rows by these. Nulls, repeated rows, ties and empty tables are as in
    quality(); further columns may have any name and type.
    """
    removed = boilerplate(docs, share, floor).groupBy("host", "text_hash").agg(F.sum("words").alias("removed_words"), F.collect_set("line").alias("gone"))  # lines of one text
    one = base_metrics(docs).groupBy("host", "text_hash").agg(F.max("base_failed").alias("base_failed"), F.max("line_words").alias("line_words"))
    kept = ~F.col("base_failed") & (F.col("line_words") - F.coalesce("removed_words", F.lit(0)) >= keep * F.col("line_words"))
    verdicts = one.join(removed, ["host", "text_hash"], "left").where(kept).select("host", "text_hash", "gone")
    # The row travels as a struct, so that no column of docs can meet one of these names.
    host, text_hash = F.coalesce("source", F.lit("\0")).alias("host"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")
    rows = docs.select(host, text_hash, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    left = F.filter(F.split("doc.text", "\n"), lambda x: ~F.array_contains("gone", F.xxhash64(F.trim(F.regexp_replace(x, SPACE, " ")))))
    out = rows.join(verdicts, ["host", "text_hash"]).withColumn("left", F.when(F.col("gone").isNull(), F.col("doc.text")).otherwise(F.array_join(left, "\n")))
    of = {c: F.col(f"doc.`{c}`") for c in docs.columns} | {"text": F.col("left")}
    if "n_chars" in of:
        of["n_chars"] = F.length("left").cast(docs.schema["n_chars"].dataType)
    return out.select(*(x.alias(c) for c, x in of.items()))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def sql(table: str = "documents", share: float = SHARE, floor: int = FLOOR, keep: float = KEEP) -> str:
    """The same rows in DuckDB SQL, by comparing words, lines and texts themselves."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, chr(0)) AS host, coalesce(text, '') AS t FROM {table}),
w AS (SELECT *, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS raw,
  list_distinct(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, '[\\x20\\x09-\\x0D]+', ' ', 'g'))), lambda x: x <> '')) AS lines FROM d),
g AS (SELECT r, unnest(range(1, len(ws) - 3)) AS p, ws FROM w WHERE len(ws) >= 5),
h AS (SELECT r, p, count(*) OVER (PARTITION BY r, ws[p], ws[p + 1], ws[p + 2], ws[p + 3], ws[p + 4]) AS n FROM g),
rep AS (SELECT r, count(DISTINCT q) AS n_repeat_words FROM (SELECT r, unnest(range(p, p + 5)) AS q FROM h WHERE n > 1) GROUP BY r),
l AS (SELECT DISTINCT host, t, unnest(lines) AS line FROM w),
first AS (SELECT host, t, min(doc_id) AS doc_id FROM d GROUP BY host, t),
size AS (SELECT host, count(*) AS texts FROM first GROUP BY host),
o AS (SELECT host, line, count(*) AS n, arg_min(t, doc_id) AS first FROM l JOIN first USING (host, t) JOIN size USING (host)
  GROUP BY host, line, texts HAVING count(*) > {floor} AND count(*) > {share} * texts),
gone AS (SELECT l.host, l.t, sum(len(string_split(line, ' '))) AS removed_words FROM l JOIN o USING (host, line) WHERE l.t <> o.first GROUP BY l.host, l.t),
m AS (SELECT w.*, len(ws) AS n_words, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(removed_words, 0) AS removed_words,
  coalesce(list_sum(list_transform(lines, lambda x: len(string_split(x, ' ')))), 0) AS line_words
  FROM w LEFT JOIN rep USING (r) LEFT JOIN gone ON gone.host = w.host AND gone.t = w.t),
f AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(raw) - len(list_distinct(raw)) AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  base_failed, CAST(removed_words AS BIGINT) AS removed_words,
  NOT base_failed AND line_words - removed_words >= {keep} * line_words AS kept FROM f"""


ORACLE_SQL = sql()
