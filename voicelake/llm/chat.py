"""Preference formatting of chosen and rejected conversations.

The turns that both conversations share from the start are rendered once, as
the prompt; what follows is rendered as two completions. A completion carries
the spans (start, end in code points) that training counts: the text and end
mark of its assistant turns. All other code points are masked.

Defined results: null roles and texts are rendered empty; turns go by number,
null numbers first, equal numbers by role and text; repeated rows are repeated
turns; a pair with equal conversations has empty completions; a pair with one
side only has that side and an empty other; rows with a null pair id make one
pair of their own; further columns are not carried; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voicelake.llm.scratch import Scratch
from voicelake.llm.successor import with_next

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


_TURNS = "array<struct<role:string,text:string>>"


def _clean(turns: DataFrame, key: str) -> DataFrame:
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)
    return turns.select(F.col(key).alias("pair_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"))


def _gathered(when: Column | None = None) -> Column:
    row = F.struct("turn", "role", "text")
    return F.transform(F.array_sort(F.collect_list(row if when is None else F.when(when, row))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE))), "")


def _spans(turns: Column) -> Column:
    """(start, end) of each assistant turn's text and end mark in the rendered turns."""
    lengths = F.transform(turns, lambda t: F.struct((F.length(t["role"]) + len(OPEN) + 1).alias("head"), (F.length(t["text"]) + len(CLOSE)).alias("body"), (t["role"] == "assistant").alias("own")))
    seed = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    step = lambda a, x: F.struct(
        (a["at"] + x["head"] + x["body"]).alias("at"),
        F.when(x["own"], F.concat(a["spans"], F.array(F.struct((a["at"] + x["head"]).alias("start"), (a["at"] + x["head"] + x["body"]).alias("end"))))).otherwise(a["spans"]).alias("spans"),
    )
    return F.aggregate(lengths, seed, step, lambda a: a["spans"])


def formatted(pairs: DataFrame) -> DataFrame:
    """(pair_id, turns c and r) -> prompt, both completions and their spans."""
    differs = F.filter(F.sequence(F.lit(0), F.least(F.size("c"), F.size("r"))), lambda i: ~F.coalesce(F.get("c", i) == F.get("r", i), F.lit(False)))
    pairs = pairs.withColumn("n_shared", F.get(differs, F.lit(0)))
    rest = lambda side: F.slice(side, F.col("n_shared") + 1, F.greatest(F.size(side) - F.col("n_shared"), F.lit(0)))
    pairs = pairs.select("pair_id", "n_shared", F.slice("c", F.lit(1), F.col("n_shared")).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    return pairs.select(
        "pair_id", "n_shared", _rendered(F.col("p")).alias("prompt"), _rendered(F.col("c")).alias("chosen"), _rendered(F.col("r")).alias("rejected"),
        _spans(F.col("c")).alias("chosen_spans"), _spans(F.col("r")).alias("rejected_spans"),
    )


def format_preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """(pair_id, turn, role, text) on both sides -> prompt, both completions and their spans, a row a pair."""
    sides = _clean(chosen, "pair_id").withColumn("side", F.lit("c")).unionByName(_clean(rejected, "pair_id").withColumn("side", F.lit("r")))
    return formatted(sides.groupBy("pair_id").agg(_gathered(F.col("side") == "c").alias("c"), _gathered(F.col("side") == "r").alias("r")))


def with_swapped_reply(turns: DataFrame) -> DataFrame:
    """(pair_id, c, r) of every conversation (conv_id, turn, role, text): its turns as chosen; as rejected, its last assistant turn with another's reply.

    The other conversation is the next by id that has a reply, null ids last, the first after the last. A conversation
    without a reply has equal sides; where no other has one, the rejected reply is empty.
    """
    scratch = Scratch(turns.sparkSession, "chat")
    known = _clean(turns, "conv_id").groupBy("pair_id").agg(_gathered().alias("c"))
    at = F.array_max(F.filter(F.transform("c", lambda t, i: F.when(t["role"] == "assistant", i)), lambda i: i.isNotNull()))
    key = [F.col("pair_id").isNull().alias("_null"), F.coalesce(F.col("pair_id").cast("long"), F.lit(0).cast("long")).alias("_id")]
    known = scratch.table(known.select(*key, "pair_id", "c", at.alias("at"), F.get("c", at)["text"].alias("reply")), "known")
    replied = known.filter("at IS NOT NULL")
    links = with_next(replied.select("_null", "_id"), [F.col("_null").asc(), F.col("_id").asc()], ["_null", "_id"], scratch)
    links = links.select("next.*", F.struct("_null", "_id").alias("before"))
    own = (F.col("before._null") == F.col("_null")) & (F.col("before._id") == F.col("_id"))
    other = replied.join(links, ["_null", "_id"]).select("before.*", F.when(own, F.lit("")).otherwise(F.col("reply")).alias("other"))
    pairs = known.join(other, ["_null", "_id"], "left")
    swapped = F.transform("c", lambda t, i: F.struct(t["role"].alias("role"), F.when(i == F.col("at"), F.col("other")).otherwise(t["text"]).alias("text")))
    return pairs.select("pair_id", "c", F.when(F.col("at").isNull(), F.col("c")).otherwise(swapped).alias("r"))


def op4_preferences(spark, sf_dir):
    done = formatted(with_swapped_reply(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    flat = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return done.select("pair_id", "n_shared", "prompt", "chosen", "rejected", flat("chosen_spans").alias("chosen_spans"), flat("rejected_spans").alias("rejected_spans"))


OP4_SQL = r"""
WITH turns AS (
  SELECT conv_id AS pair_id, coalesce(role, '') AS role, coalesce(text, '') AS chosen,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn ASC NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations
), last AS (
  SELECT pair_id, arg_max(chosen, place) AS reply, max(place) AS spot FROM turns WHERE role = 'assistant' GROUP BY pair_id
), other AS (
  SELECT pair_id, spot, CASE WHEN count(*) OVER () = 1 THEN ''
         ELSE coalesce(lead(reply) OVER w, first_value(reply) OVER (ORDER BY pair_id ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) END AS other
  FROM last WINDOW w AS (ORDER BY pair_id ASC NULLS LAST)
), both_sides AS (
  SELECT t.*, CASE WHEN t.place = o.spot THEN o.other ELSE t.chosen END AS rejected FROM turns t LEFT JOIN other o ON t.pair_id IS NOT DISTINCT FROM o.pair_id
), shared AS (
  SELECT pair_id, coalesce(min(CASE WHEN chosen <> rejected THEN place END) - 1, count(*)) AS n_shared FROM both_sides GROUP BY pair_id
), placed AS (
  SELECT t.*, s.n_shared, '<|im_start|>' || role || chr(10) || chosen || '<|im_end|>' || chr(10) AS c, '<|im_start|>' || role || chr(10) || rejected || '<|im_end|>' || chr(10) AS r
  FROM both_sides t JOIN shared s ON t.pair_id IS NOT DISTINCT FROM s.pair_id
), ends AS (
  SELECT *, sum(CASE WHEN place > n_shared THEN length(c) ELSE 0 END) OVER w AS c_end, sum(CASE WHEN place > n_shared THEN length(r) ELSE 0 END) OVER w AS r_end
  FROM placed WINDOW w AS (PARTITION BY pair_id ORDER BY place)
)
SELECT pair_id, CAST(any_value(n_shared) AS INTEGER) AS n_shared,
       coalesce(string_agg(c, '' ORDER BY place) FILTER (place <= n_shared), '') AS prompt,
       coalesce(string_agg(c, '' ORDER BY place) FILTER (place > n_shared), '') AS chosen,
       coalesce(string_agg(r, '' ORDER BY place) FILTER (place > n_shared), '') AS rejected,
       coalesce(string_agg((c_end - length(chosen) - 11) || '-' || c_end, ',' ORDER BY place) FILTER (place > n_shared AND role = 'assistant'), '') AS chosen_spans,
       coalesce(string_agg((r_end - length(rejected) - 11) || '-' || r_end, ',' ORDER BY place) FILTER (place > n_shared AND role = 'assistant'), '') AS rejected_spans
FROM ends GROUP BY pair_id
"""
