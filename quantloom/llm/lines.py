"""Line dedup: repeated runs of lines by a suffix array over line ids, built by distributed prefix doubling.

1. Rows with equal texts are one document from the start: the first by doc_id stands for all, and each later
   one is, as a whole, a copy (if its words reach `min_words`; else no run of it does).
2. Lines that occur once can be in no repeated run, so only repeated lines are numbered, in sorted order:
   rank 0. Blank lines are no part of the sequences.
3. Prefix doubling: the pair (rank k of a line, rank k of the line 2^k later) is sorted and numbered into
   rank k+1, the order of suffixes by their first 2^(k+1) lines. Suffixes of equal rank are an interval of
   the suffix array whose longest common prefix is at least 2^(k+1) lines; an interval knows its first copy
   (by doc_id, then line). Intervals of one suffix end; doubling goes on until no other is left.
4. A suffix that is a later copy in an interval gives a piece: its first 2^k lines. The deepest piece of a
   run's first line and the one that ends with its last line overlap or touch, so the union of a document's
   pieces is the union of its maximal repeated runs. A piece counts from `min_words` words on. Runs that
   reach them only between two depths, 2^k < n < 2^(k+1) lines, are found by the pair of ranks of their two
   overlapping 2^k prefixes, for the windows that are just long enough, from their first or their last line.
5. Pieces merge into maximal runs, whose lines are deleted. A copy that overlaps the first copy of its run
   is no later copy: the first stays whole against its own run.

All of it is DataFrame work on narrow rows. Counts and first copies are combined before the shuffle, and a
hot line or interval is one row after it, written before it is joined, so that adaptive execution can split
the other side. A document's own pieces are the largest group that is sorted together.

Defined results: a null text stays null and has no lines; texts are compared line by line, exactly;
rows with equal doc_id and text count as one document and get equal results; rows with one doc_id but
different texts are documents of their own, ordered by a hash of the text; a null doc_id comes first;
an empty table gives an empty table; the input's other columns are returned as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.llm.common import drop_scratch, read_table, scratch

#: The fewest words of a repeated run.
MIN_WORDS = 8
#: Every repeated run, however short.
ANY_RUN = 1
_NO_ID = -(1 << 63)
WORD = r"[^\x20\x09-\x0D]+"


def _key(id_col: str, text_col: str) -> tuple[Column, Column]:
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID))
    return doc.alias("doc"), F.xxhash64(doc, F.col(text_col).cast("string")).alias("th")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once, also where body has lambdas of its own."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _digest_of(text_col: str) -> Column:
    return F.unhex(F.md5(F.col(text_col).cast("string").cast("binary"))).alias("digest")


def _texts(frame: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """digest, doc, th (of the first row), words, s (its non-blank lines: key, words): one row per distinct text."""
    found = F.filter(F.split(F.col(text_col).cast("string"), "\n"), lambda x: x.rlike(WORD))
    narrow = F.transform(found, lambda x: F.struct(F.unhex(F.md5(x.cast("binary"))).alias("key"), F.regexp_count(x, F.lit(WORD)).alias("words")))
    own = frame.select(*_key(id_col, text_col), _digest_of(text_col), narrow.alias("s")).where(F.size("s") > 0)
    one = own.groupBy("digest").agg(F.min(F.struct("doc", "th")).alias("first"), F.first("s").alias("s"))
    words = F.aggregate("s", F.lit(0).cast("long"), lambda n, x: n + x["words"])
    return scratch(one.select("digest", "first.doc", "first.th", words.alias("words"), "s"), "line-texts")


def _intervals(rows: DataFrame, *by: str) -> DataFrame:
    """by, rank (in the order of `by`), first (doc, th, seq): the intervals of several suffixes, written once."""
    held = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min(F.struct("doc", "th", "seq")).alias("first")).where("n > 1")
    return scratch(held.orderBy(*by).select(*by, "first", F.monotonically_increasing_id().alias("rank")), "line-ranks")


def _is_later(n: int | Column) -> Column:
    """The n lines from seq on don't touch the first copy."""
    return (F.col("first.doc") != F.col("doc")) | (F.col("first.th") != F.col("th")) | (F.col("seq") >= F.col("first.seq") + n)


def repeated_runs(frame: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """doc, th, runs (array of start, stop among the non-blank lines, disjoint and in order): what is a later copy.

    A null array stands for all lines: the document is a copy of another one.
    """
    spark = frame.sparkSession
    texts = _texts(frame, id_col, text_col)
    keys = frame.select(*_key(id_col, text_col), _digest_of(text_col))
    other = texts.where(F.col("words") >= min_words).select("digest", F.struct("doc", "th").alias("first"))
    copies = keys.join(other, "digest").where((F.col("first.doc") != F.col("doc")) | (F.col("first.th") != F.col("th"))).select("doc", "th").distinct()

    lines = texts.select("doc", "th", F.posexplode("s").alias("seq", "s")).select("doc", "th", "seq", "s.key", "s.words")
    ranks = _intervals(lines, "key")
    held = lines.join(ranks, "key").select("doc", "th", "seq", F.col("rank").alias("r"), "first", F.col("words").alias("held"), F.col("words").alias("tail"))
    rows, old, pieces, k = scratch(held, "line-rows"), ranks, [], 0
    own = W.partitionBy("doc", "th").orderBy("seq")

    def ahead(distance: int, *columns: str) -> Column:
        """The columns of the suffix so many lines later, if it is in an interval of this depth."""
        return F.first(F.struct(*columns)).over(own.rangeBetween(distance, distance))

    while True:
        depth = 1 << k
        pieces.append(rows.where((F.col("held") >= min_words) & _is_later(depth)).select("doc", "th", "seq", (F.col("seq") + depth).alias("stop")))
        # tail: words of the last of the 2^k lines, held: words of all of them
        between = [n for n in range(depth + 1, 2 * depth) if n <= min_words]
        spans = []
        for n in between:
            far = ahead(n - depth, "r", "held", "tail", "upto")
            total = far["upto"] - F.col("upto") + far["held"]
            short = (total - far["tail"] < min_words) | (total - F.col("words") < min_words)
            spans.append(F.when(far["r"].isNotNull() & (total >= min_words) & short, F.struct(F.lit(n).alias("n"), F.col("r").alias("a"), far["r"].alias("b"))))
        if k == 0:
            upto = F.sum("held").over(own.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("held")
            rows_now = rows.withColumn("words", F.col("held")).withColumn("upto", upto)
        else:
            rows_now = rows
        paired = rows_now.withColumn("next", ahead(depth, "r", "held", "tail"))
        if spans:
            paired = paired.withColumn("spans", F.filter(F.array(*spans), lambda w: w.isNotNull()))
        paired = scratch(paired.drop("first").where("next is not null" + (" or size(spans) > 0" if spans else "")), "line-pairs")
        if spans:
            found = paired.select("doc", "th", "seq", F.explode("spans").alias("w")).select("doc", "th", "seq", "w.n", "w.a", "w.b")
            first = F.min(F.struct("doc", "th", "seq")).alias("first")
            firsts = scratch(found.groupBy("n", "a", "b").agg(first, F.count("*").alias("m")).where("m > 1").drop("m"), "line-firsts")
            later = found.join(firsts, ["n", "a", "b"]).where(_is_later(F.col("n")))
            pieces.append(scratch(later.select("doc", "th", "seq", (F.col("seq") + F.col("n")).alias("stop")), "line-between"))
            drop_scratch(spark, firsts)
        pairs = paired.where("next is not null").select("doc", "th", "seq", "r", F.col("next.r").alias("after"), (F.col("held") + F.col("next.held")).alias("held"), F.col("next.tail").alias("tail"), "words", "upto")
        ranks = _intervals(pairs, "r", "after")
        drop_scratch(spark, old)
        if not ranks.limit(1).count():
            drop_scratch(spark, ranks, paired)
            break
        rows = scratch(pairs.join(ranks, ["r", "after"]).select("doc", "th", "seq", F.col("rank").alias("r"), "first", "held", "tail", "words", "upto"), "line-rows")
        drop_scratch(spark, paired)
        old, k = ranks, k + 1

    # pieces that go beyond those before them, cut to what is new
    every = reduce(DataFrame.unionAll, pieces)
    before = F.max("stop").over(W.partitionBy("doc", "th").orderBy("seq", F.desc("stop")).rowsBetween(W.unboundedPreceding, -1))
    cut = every.withColumn("before", F.coalesce(before, F.lit(0))).where("stop > before").select("doc", "th", F.struct(F.greatest("seq", "before").alias("start"), "stop").alias("run"))
    runs = cut.groupBy("doc", "th").agg(F.array_sort(F.collect_list("run")).alias("runs"))
    whole = copies.select("doc", "th", F.lit(None).cast("array<struct<start:int,stop:int>>").alias("runs"))
    return runs.unionAll(whole)


def dedup_lines(frame: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, deleted_col: str = "_ql_deleted") -> DataFrame:
    """frame with the lines of later copies taken out of its text, and `deleted_col` with their numbers (or null)."""
    runs = repeated_runs(frame, id_col, text_col, min_words).withColumn("hit", F.lit(True))
    joined = frame.select(F.struct("*").alias("row"), *_key(id_col, text_col)).join(runs, ["doc", "th"], "left")
    split = F.split(F.col("row").getField(text_col).cast("string"), "\n")

    def numbers(lines: Column) -> Column:
        """Numbers of the deleted lines: of all that aren't blank, or of those in the runs."""
        full = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(WORD), i)), lambda i: i.isNotNull())
        return _let(full, lambda own: F.coalesce(F.flatten(F.transform("runs", lambda r: F.slice(own, r["start"] + 1, r["stop"] - r["start"]))), own))

    def rest(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("deleted"))
        return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")

    out = joined.select("row", "hit", F.when(F.col("hit"), _let(split, numbers)).alias("deleted"))
    columns = [F.col("row").getField(c).alias(c) for c in frame.columns]
    at = frame.columns.index(text_col)
    columns[at] = F.when(F.col("hit"), _let(split, rest)).otherwise(columns[at]).alias(text_col)
    return out.select(*columns, F.col("deleted").alias(deleted_col))


def without_repeated_lines(frame: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", min_words: int = MIN_WORDS) -> DataFrame:
    """frame's columns, later copies of line runs deleted; rows of which no word is left go; length_col follows the text."""
    mark = "_" * (1 + max(map(len, frame.columns)))  # a name that no column has
    out = dedup_lines(frame, id_col, text_col, min_words, mark)
    emptied = F.col(mark).isNotNull() & ~F.col(text_col).rlike(WORD)
    kept = out.where(~emptied)
    if length_col in frame.columns:
        kind = frame.schema[length_col].dataType
        kept = kept.withColumn(length_col, F.when(F.col(mark).isNull(), F.col(length_col)).otherwise(F.length(text_col)).cast(kind))
    return kept.drop(mark)


def _digest(spark: SparkSession, sf_dir: str, min_words: int) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))).cast("long").alias("n_lines"))
    out = dedup_lines(docs, min_words=min_words)
    return out.select(
        "doc_id",
        F.greatest("n_lines", F.lit(0)).alias("n_lines"),
        F.coalesce(F.size("_ql_deleted"), F.lit(0)).cast("long").alias("n_deleted"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(spark, sf_dir, MIN_WORDS)


def op2_line_dedup_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repeated run, however short."""
    return _digest(spark, sf_dir, ANY_RUN)


_WINDOWS = ", ".join(
    f"CASE WHEN sum(words) OVER (w ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) >= {MIN_WORDS} AND lead(seq, {n - 1}) OVER w IS NOT NULL"
    + (f" AND (sum(words) OVER (w ROWS BETWEEN CURRENT ROW AND {n - 2} FOLLOWING) < {MIN_WORDS} OR sum(words) OVER (w ROWS BETWEEN 1 FOLLOWING AND {n - 1} FOLLOWING) < {MIN_WORDS})" if n > 1 else "")
    + f" THEN {{'n': {n}, 'x': array_to_string(list(x) OVER (w ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING), chr(10))}} END"
    for n in range(1, MIN_WORDS + 1)
)
ORACLE_SQL = {
    "op2_line_dedup": rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents),
s AS (SELECT doc_id, line, x, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS seq, len(regexp_extract_all(x, '{WORD}')) AS words
  FROM l WHERE regexp_matches(x, '{WORD}')),
v AS (SELECT doc_id, seq, unnest(list_filter([{_WINDOWS}], lambda e: e IS NOT NULL)) AS e FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY seq)),
f AS (SELECT e.n AS n, e.x AS x, min({{'d': doc_id, 's': seq}}) AS first FROM v GROUP BY 1, 2),
d AS (SELECT DISTINCT doc_id, unnest(range(seq, seq + v.e.n)) AS seq FROM v JOIN f ON f.n = v.e.n AND f.x = v.e.x WHERE doc_id <> f.first.d OR seq >= f.first.s + f.n),
g AS (SELECT s.doc_id, s.line FROM s JOIN d USING (doc_id, seq)),
k AS (SELECT l.doc_id, string_agg(CASE WHEN g.line IS NULL THEN l.x END, chr(10) ORDER BY l.line) AS text, count(g.line) AS n_deleted
  FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.line = g.line GROUP BY l.doc_id)
SELECT o.doc_id, (SELECT count(*) FROM s WHERE s.doc_id = o.doc_id) AS n_lines, coalesce(k.n_deleted, 0) AS n_deleted, sha256(coalesce(k.text, '')) AS text_sha256
FROM documents o LEFT JOIN k ON o.doc_id = k.doc_id""",
    "op2_line_dedup_whole": rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents),
s AS (SELECT doc_id, line, row_number() OVER (PARTITION BY x ORDER BY doc_id, line) > 1 AS later FROM l WHERE regexp_matches(x, '{WORD}')),
k AS (SELECT l.doc_id, string_agg(CASE WHEN s.later IS NOT TRUE THEN l.x END, chr(10) ORDER BY l.line) AS text, count(*) FILTER (s.later) AS n_deleted, count(s.line) AS n_lines
  FROM l LEFT JOIN s ON l.doc_id = s.doc_id AND l.line = s.line GROUP BY l.doc_id)
SELECT o.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_deleted, 0) AS n_deleted, sha256(coalesce(k.text, '')) AS text_sha256
FROM documents o LEFT JOIN k ON o.doc_id = k.doc_id""",
}
QUERIES = {"op2_line_dedup": op2_line_dedup, "op2_line_dedup_whole": op2_line_dedup_whole}
