"""Order MinHash fingerprints, sensitive to edit distance.

A text becomes pieces: its words, those over ``PIECE`` code points cut up. Its
k-mers are runs of K pieces, numbered by occurrence, so that a k-mer that
comes twice counts as two. Each of M hash functions takes the L = 2 smallest
numbered k-mers, puts them back in text order and hashes the tuple. Two texts
agree in a component if they share these k-mers and their order, so likeness
falls with edits and with moves.

The M hash functions are rotations of one: function b orders by hash minus
b/M of the range, so one sort serves all, and function b's smallest are those
that follow b's mark on the circle. White space only separates pieces, so
texts that differ in it alone have likeness 1.

Everything is array expressions on one row; whole texts are used.

Defined results: a null text is empty; empty texts have equal fingerprints (of
zeros); a text under K pieces is one k-mer; the next document is the one with
the next smaller id, null ids come last, equal ids follow by hash of the text,
and after the last comes the first, so a single document follows itself; rows
equal in id and text follow each other; an empty table gives an empty result;
columns besides doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voicelake.llm.scratch import Scratch
from voicelake.llm.successor import with_next
from voicelake.llm.text import code_points, whole

PIECE, K, L, M = 12, 2, 2, 64
#: Low bits of a packed value hold a position (texts up to 268 million pieces), the others the hash.
LOW = 28
_LOW_MASK = (1 << LOW) - 1


def _top(x: Column) -> Column:
    return x.bitwiseAND(F.lit(~_LOW_MASK))


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_LOW_MASK))


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the fingerprint of a text column as an array of M integers."""
    df = df.withColumn("_t", F.transform(F.regexp_extract_all(F.col(text), F.lit(rf"[^\x20\x09-\x0D]{{1,{PIECE}}}"), F.lit(0)), lambda w: F.xxhash64(w)))
    pairs = F.transform("_t", lambda h, i: _top(F.xxhash64(h, F.get("_t", i + 1))).bitwiseOR(i.cast("long")))
    df = df.withColumn("_s", F.array_sort(F.slice(pairs, 1, F.when(F.size("_t") > 1, F.size("_t") - 1).otherwise(F.size("_t")))))
    # a run of equal k-mers starts where the value before differs; the distance from there is the occurrence number
    starts = F.filter(F.sequence(F.lit(0), F.size("_s") - 1), lambda i: (i == 0) | (_top(F.get("_s", i)) != _top(F.get("_s", i - 1))))
    df = df.withColumn("_r", F.when(F.size("_s") > 0, starts).otherwise(F.array().cast("array<int>")))
    numbered = lambda i, s: _top(F.xxhash64(_top(F.get("_s", i)), i - s)).bitwiseOR(_low(F.get("_s", i)) + 1)
    runs = F.transform("_r", lambda s, j: F.transform(F.sequence(s, F.coalesce(F.get("_r", j + 1), F.size("_s")) - 1), lambda i: numbered(i, s)))
    marks = F.array(*[F.lit((b << (64 - 6)) - (1 << 63)) for b in range(M)])  # position 0, so a mark sorts before k-mers
    df = df.withColumn("_c", F.array_sort(F.concat(F.flatten(runs), marks)))
    df = df.withColumn("_e", F.filter("_c", lambda x: _low(x) != 0))
    df = df.withColumn("_m", F.filter(F.transform("_c", lambda x, i: F.when(_low(x) == 0, i)), lambda i: i.isNotNull()))

    def component(at: Column, b: Column) -> Column:
        one, two = (F.get("_e", F.pmod(at - b + k, F.size("_e"))) for k in range(L))
        in_order = _low(one) <= _low(two)
        early, late = F.when(in_order, one).otherwise(two), F.when(in_order, two).otherwise(one)
        return F.xxhash64(_top(early), _top(late)).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")

    filled = F.transform("_m", component)
    df = df.withColumn(out, F.when(F.size("_e") > 0, filled).otherwise(F.array_repeat(F.lit(0), M)))
    return df.drop("_t", "_s", "_r", "_c", "_e", "_m")


def as_text(print_: str) -> Column:
    return F.lower(F.array_join(F.transform(print_, lambda x: F.lpad(F.hex(x), 8, "0")), ""))


def likeness(one: str, two: str) -> Column:
    """The share of components that agree."""
    return F.size(F.filter(F.zip_with(one, two, lambda a, b: a == b), lambda same: same)) / F.lit(float(M))


_KEY = ["_null", "_id", "_h", "_g"]
#: Repeats of one id and text that one task writes.
CHUNK = 100_000


def _report(rows: DataFrame) -> DataFrame:
    """_null, _id, text, mark, other (what the edit takes from), next_mark and times -> the report, a row each and ``times``."""
    size = code_points(F.col("text"))
    third = F.floor(size / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (size - third).cast("int")), F.substring("other", F.lit(1), third))
    rows = rows.select(*_KEY, "chunk", "times", size.alias("n_chars"), "mark", "next_mark", F.when(third > 0, edited).otherwise(F.col("text")).alias("edited"))
    done = with_fingerprint(rows, "edited", "edited_mark")
    return done.select(
        *_KEY, "chunk", "times", F.when(~F.col("_null"), F.col("_id")).alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text("mark").alias("fingerprint"),
        as_text("edited_mark").alias("edited_fingerprint"), likeness("mark", "edited_mark").alias("near_edited"), likeness("mark", "next_mark").alias("near_next"),
    )


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints and likenesses of every row.

    The order is found on keys alone: id and a 128-bit hash of the text. Rows equal in id and text are one row with a
    count, combined before the exchange, since all but the last of them are followed by their own text. Whole texts move
    once, to their key; each then lends its beginning, no longer than the edit asks for, to the key that it follows.
    """
    scratch = Scratch(docs.sparkSession, "fingerprint")
    text, null = whole(F.col("text")), F.col("doc_id").cast("long").isNull()
    keyed = docs.select(null.alias("_null"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).cast("long").alias("_id"), text.alias("text"), F.xxhash64(text).alias("_h"), F.xxhash64(F.lit(1), text).alias("_g"))
    order = [F.col("_null").asc(), F.col("_id").desc(), F.col("_h").asc(), F.col("_g").asc()]
    keys = keyed.groupBy(*_KEY).agg(F.max(F.floor(code_points(F.col("text")) / 3).cast("int")).alias("asks"))
    links = scratch.table(with_next(keys, order, _KEY, scratch).select("next.*", F.struct(*_KEY).alias("before"), "asks"), "links")

    # every use below reads text, mark and n, so that one exchange serves all
    own = with_fingerprint(keyed, "text", "mark").groupBy(*_KEY).agg(F.max("text").alias("text"), F.max("mark").alias("mark"), F.count(F.lit(1)).alias("n")).filter("n > 0")
    lent = own.join(links, _KEY).select("before.*", F.substring("text", F.lit(1), F.col("asks")).alias("other"), F.col("mark").alias("next_mark"))
    followed = own.join(lent.hint("merge"), _KEY).withColumns({"chunk": F.lit(0).cast("long"), "times": F.lit(1).cast("long")})
    repeated = own.filter("n > 1").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 2) / CHUNK))))
    repeated = repeated.withColumns({"times": F.least(F.lit(CHUNK).cast("long"), F.col("n") - 1 - F.col("chunk") * CHUNK), "other": F.col("text"), "next_mark": F.col("mark")})
    copies = _report(repeated).repartition(*_KEY, "chunk").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return _report(followed).drop(*_KEY, "chunk", "times").unionByName(copies.drop(*_KEY, "chunk", "times", "copy"))


def op2_fingerprints(spark, sf_dir):
    return fingerprint_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
