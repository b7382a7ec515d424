"""Quality rules with cross-document line frequency, in DataFrame operations only.

Lines are normalised (A-Z lower-cased, white space collapsed) and hashed with their host; the number
of different documents that have a line on a host is counted, exact copies of a document as one.
Lines in more documents than the limit are boilerplate: they go from every document but one, the
carrier whose text has the smallest digest, so that a line's content is never lost.  A document that
keeps too small a share of its words is depleted and rejected.  Simple counts of each text form the
base rules.

Each text is split into lines once: their keys, places and words are a written table that counting and
removal both read.  Words are split once, for all base rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exact_dedup import LOWER, UPPER
from .store import Scratch, broadcast_if_below

WHITE = r"[\x20\x09-\x0D]+"
#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, WHITE, -1), "")


def content_digest(text: Column) -> Column:
    """60 bits of SHA-256 as a long."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def with_repeat_words(df: DataFrame, words: str, out: str) -> DataFrame:
    """Adds the number of words in 3-word windows that occur twice or more in the text.

    Only where two windows have one hash, hashes and places are packed into longs and sorted as primitives;
    neighbours with equal hashes are candidates, whose wording is then compared itself.  n log n in a text's words."""
    n = F.size(words)
    bits = F.when(n < 1 << 20, F.lit(20)).otherwise(F.lit(32))
    at = lambda a, i: F.get(F.col(a), i)
    gram = lambda i: (at(words, i), at(words, i + 1), at(words, i + 2))
    left = lambda x: F.call_function("shiftleft", x, F.col("__bits"))
    right = lambda x: F.call_function("shiftright", x, F.col("__bits"))
    same = lambda a, b: F.coalesce(a == b, F.lit(False))
    none = F.array().cast("array<bigint>")
    own = [F.col(f"`{c}`") for c in df.columns]
    df = df.select(*own, bits.alias("__bits"), F.when(n >= 3, F.transform(words, lambda w: F.xxhash64(w))).otherwise(none).alias("__h"))
    two = F.zip_with(F.slice("__h", 1, F.size("__h") - 2), F.slice("__h", 2, F.size("__h") - 2), lambda a, b: F.xxhash64(a, b))
    three = F.zip_with(two, F.slice("__h", 3, F.size("__h") - 2), lambda a, b: F.xxhash64(a, b))
    df = df.select(*own, "__bits", F.when(F.size("__h") >= 3, three).otherwise(none).alias("__three"))
    packed = F.sort_array(F.transform("__three", lambda x, i: left(x).bitwiseOR(i.cast("long"))))
    df = df.select(*own, "__bits", F.when(F.size(F.array_distinct("__three")) < F.size("__three"), packed).otherwise(none).alias("__sorted"))
    alike = F.zip_with("__sorted", F.slice("__sorted", 2, F.size("__sorted")), lambda a, b: F.when(right(a.bitwiseXOR(b)) == 0, F.array(a, b)))
    place = lambda x: (x - left(right(x))).cast("int")
    near = F.transform(F.array_distinct(F.flatten(F.array_compact(alike))), place)
    df = df.select(*own, F.when(F.size("__sorted") > 0, near).otherwise(F.array().cast("array<int>")).alias("__places"))
    df = df.select(*own, F.sort_array(F.transform("__places", lambda p: F.struct(F.concat_ws(" ", *gram(p)).alias("g"), p.alias("p")))).alias("__grams"))
    twice = F.filter("__grams", lambda x, i: same(x["g"], at("__grams", i - 1)["g"]) | same(x["g"], at("__grams", i + 1)["g"]))
    starts = F.sort_array(F.transform(twice, lambda x: x["p"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"],
    )
    return df.select(*own, covered.alias(out))


def document_lines(docs: DataFrame, host: str) -> DataFrame:
    """doc_id, digest (of the text), pos, key (of host and normalised line), n (words) for each line with a word."""
    text = F.coalesce("text", F.lit(""))
    # white space is collapsed before the text is split; single blanks need no change, so most texts are only looked through
    normal = F.regexp_replace(F.translate(text, UPPER, LOWER), r"[\x20\x09\x0B-\x0D]{2,}|[\x09\x0B-\x0D]", " ")
    lines = docs.select("doc_id", content_digest(text).alias("digest"), F.coalesce(F.col(host), F.lit("")).alias("host"), F.posexplode(F.split(normal, "\n", -1)).alias("pos", "line"))
    lines = lines.select("doc_id", "digest", "host", "pos", F.trim("line").alias("line")).filter("line <> ''")
    blanks = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit("")))
    return lines.select("doc_id", "digest", "pos", F.xxhash64("host", "line").alias("key"), (blanks + 1).cast("int").alias("n"))


def line_limits(lines: DataFrame, limit: int) -> DataFrame:
    """key, first (digest of the one carrier that keeps it): lines in more than ``limit`` different documents of a host."""
    each = lines.select("digest", "key").distinct()
    return each.groupBy("key").agg(F.count("*").alias("n"), F.min("digest").alias("first")).filter(F.col("n") > limit).select("key", "first")


def quality_rules(docs: DataFrame, host: str = "source", limit: int = 100, least_left_percent: int = 30, most_broadcast_bytes: int = 8 << 20, with_text: bool = True) -> DataFrame:
    """doc_id, ``row`` (a struct of all columns of ``docs``), and in a struct ``quality``: n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, n_removed_lines, n_removed_words, base_failed, kept, clean_text.  Without
    ``with_text`` there are no row and no clean_text, so that no text is shuffled.

    clean_text is the text without its boilerplate lines (null where the text is null).  A null or
    empty text has no words and fails the base rules (fewer than 50 words).  Lines without a word are
    never counted nor removed.  A null host is a host of its own.  Repeated rows count as one document
    and get equal results; rows that share a doc_id but not the text are judged each by its own text.
    Texts of any length are taken whole.  Columns of ``docs`` stand in ``row`` and may have any names.
    An empty table gives an empty result.  Needs the columns doc_id, text and ``host``.
    """
    scratch = Scratch(docs.sparkSession)
    lines = scratch.written(document_lines(docs, host), "lines")
    over = scratch.written(line_limits(lines, limit), "lines-over-limit")
    removed = (
        lines.join(broadcast_if_below(over, 48, most_broadcast_bytes), "key")
        .filter("digest <> first")
        .select("doc_id", "digest", "pos", "n")
        .distinct()
        .groupBy(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"))
        .agg(F.sum("n").alias("__words"), F.count("*").alias("__lines"), *([F.collect_list("pos").alias("__pos")] if with_text else []))
    )
    removed = scratch.written(removed, "lines-removed")
    scratch.drop(lines, over)
    own = ["doc_id", "row"] if with_text else ["doc_id"]
    row = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if with_text else []
    t = docs.select("doc_id", *row, F.coalesce("text", F.lit("")).alias("__text"))
    if with_text:
        t = _with_removed(t, removed, most_broadcast_bytes)
        t = _counted(t, [*own, "__text", "__pos", "__words", "__lines"])
    else:  # counts alone are joined
        small = broadcast_if_below(removed, 64, most_broadcast_bytes)
        t = _counted(t.withColumn("__d", content_digest(F.col("__text"))), [*own, "__d"])
        t = t.join(small, t["doc_id"].eqNullSafe(small["__id"]) & (t["__d"] == small["__digest"]), "left")
    gone = F.coalesce("__words", F.lit(0)).cast("long")
    failed = (F.col("__n") < 50) | (100 * F.col("__repeat") > 50 * F.col("__n"))
    stats = [
        F.col("__n").alias("n_words"),
        F.col("__chars").alias("word_chars"),
        F.col("__symbols").alias("n_symbols"),
        F.col("__dup").alias("n_dup_lines"),
        F.col("__repeat").alias("n_repeat_words"),
        F.coalesce("__lines", F.lit(0)).cast("long").alias("n_removed_lines"),
        gone.alias("n_removed_words"),
        failed.alias("base_failed"),
        # always true; it keeps later filters from being moved below, where all counts would be written out again
        (~failed & (100 * (F.col("__n") - gone) >= least_left_percent * F.col("__n")) & (F.monotonically_increasing_id() >= 0)).alias("kept"),
    ]
    if not with_text:
        return t.select(*own, F.struct(*stats).alias("quality"))
    t = t.withColumn("__split", F.when(F.col("__pos").isNotNull(), F.split("__text", "\n", -1)))
    left = F.array_except(F.sequence(F.lit(0), F.size("__split") - 1), F.col("__pos"))
    clean = F.when(F.col("__pos").isNull(), F.col("row")["text"]).otherwise(F.array_join(F.transform(F.sort_array(left), lambda i: F.get(F.col("__split"), i)), "\n"))
    return t.select(*own, F.struct(*stats, clean.alias("clean_text")).alias("quality"))


def _with_removed(t: DataFrame, removed: DataFrame, most_broadcast_bytes: int) -> DataFrame:
    """``t`` with the removed lines of each text.  If the ids that lose lines are few enough to be sent, only their texts are shuffled."""
    joined = lambda t: t.withColumn("__d", content_digest(F.col("__text"))).join(
        removed, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__d") == F.col("__digest")), "left"
    ).select(*t.columns, "__pos", "__words", "__lines")
    if removed.count() * 32 > most_broadcast_bytes:
        return joined(t)
    losing = F.broadcast(removed.select(F.col("__id").alias("__losing")).distinct())
    loses = F.col("doc_id").eqNullSafe(F.col("__losing"))
    rest = t.join(losing, loses, "left_anti")
    for name in ("__pos", "__words", "__lines"):
        rest = rest.withColumn(name, F.lit(None).cast(removed.schema[name].dataType))
    return joined(t.join(losing, loses, "left_semi")).unionByName(rest)


def _counted(t: DataFrame, own: list[str]) -> DataFrame:
    """The base counts of ``__text`` beside the columns ``own``."""
    t = t.select(*own, *([] if "__text" in own else ["__text"]), words_of(F.col("__text")).alias("__w"), F.filter(F.split("__text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__l"))
    t = with_repeat_words(t, "__w", "__repeat")
    return t.select(
        *own,
        F.size("__w").cast("long").alias("__n"),
        F.length(F.array_join("__w", "")).cast("long").alias("__chars"),
        F.regexp_count("__text", F.lit(f"[{SYMBOLS}]")).cast("long").alias("__symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("__dup"),
        "__repeat",
    )
