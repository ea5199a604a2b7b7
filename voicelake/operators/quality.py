"""Transcript measures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def text_agreement(pairs: DataFrame, expected: str, heard: str, by: list[str]) -> DataFrame:
    """1 - edits / longer length, a group."""
    score = 1 - F.levenshtein(expected, heard) / F.greatest(F.length(expected), F.length(heard), F.lit(1))
    return pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg(score), 6).alias("mean_agreement"), F.round(F.min(score), 6).alias("least_agreement"))


def character_error_rate(reference: Column, hypothesis: Column) -> Column:
    return F.levenshtein(reference, hypothesis) / F.greatest(F.length(reference), F.lit(1))


def word_edits(reference: Column, hypothesis: Column) -> Column:
    """Edits between word sequences: each distinct word of the pair becomes one code point above the surrogates, then characters are compared."""
    a, b = F.split(reference, " "), F.split(hypothesis, " ")
    as_points = lambda words, known: F.array_join(F.transform(words, lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(known, w) + 0xFFFF), 8, "0")), "UTF-32")), "")
    # as a lambda's argument the distinct words are gathered once a pair, not once a word
    return F.get(F.transform(F.array(F.array_distinct(F.concat(a, b))), lambda known: F.levenshtein(as_points(a, known), as_points(b, known))), F.lit(0))


def word_error_rate(pairs: DataFrame, reference: str, hypothesis: str, by: list[str]) -> DataFrame:
    words = F.size(F.split(F.col(reference), " "))
    return pairs.groupBy(*by).agg(F.sum(word_edits(F.col(reference), F.col(hypothesis))).alias("edits"), F.sum(words).alias("words")).withColumn("wer", F.round(F.col("edits") / F.col("words"), 6))


#: Longest n-grams: words in BLEU, characters in chrF; chrF weighs recall BETA times as much as precision.
BLEU_N, CHRF_N, BETA = 4, 6, 2.0


#: Texts of about so many bytes are matched at a time.
MATCH_BYTES = 1 << 20


def _parts(texts: list[str], unit: str) -> tuple[np.ndarray, np.ndarray]:
    """The words or characters of texts, without blanks, as numbers, and the text that each is of."""
    if unit == "word":
        parts = [[w for w in text.split(" ") if w] for text in texts]
        known: dict[str, int] = {}
        codes = np.array([known.setdefault(w, len(known)) for ws in parts for w in ws], np.int64)
        return codes, np.repeat(np.arange(len(texts)), [len(ws) for ws in parts])
    texts = [text.replace(" ", "") for text in texts]
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    used = np.zeros(0x110000, bool)
    used[points] = True
    return (np.cumsum(used) - 1)[points], np.repeat(np.arange(len(texts)), [len(text) for text in texts])


def shared_grams(reference: list[str], hypothesis: list[str], unit: str, longest: int) -> np.ndarray:
    """Pairs x lengths: n-grams that both texts of a pair have, each as often as in the one that has it less often.

    The grams of a text are exact numbers, made longer by a part a length; those of all pairs are sorted together.
    """
    pairs = len(reference)
    codes, text = _parts([*reference, *hypothesis], unit)
    found, kinds = np.zeros((pairs, longest), np.int64), int(codes.max(initial=0)) + 1
    place, grams, size = np.arange(len(codes)), codes, kinds
    for n in range(1, longest + 1):
        if n > 1:
            inside = text[place] == text[np.minimum(place + n - 1, len(text) - 1)]
            inside &= place + n - 1 < len(text)
            place, grams = place[inside], grams[inside]
            if size * kinds * max(pairs, 1) >= 1 << 62:
                grams = np.unique(grams, return_inverse=True)[1]
                size = int(grams.max(initial=0)) + 1
            grams, size = grams * kinds + codes[place + n - 1], size * kinds
        if size * max(pairs, 1) >= 1 << 62:
            grams = np.unique(grams, return_inverse=True)[1]
            size = int(grams.max(initial=0)) + 1
        of = text[place]
        ours, theirs = (np.unique(t * size + g, return_counts=True) for t, g in ((of[of < pairs], grams[of < pairs]), (of[of >= pairs] - pairs, grams[of >= pairs])))
        if len(ours[0]) and len(theirs[0]):
            at = np.minimum(np.searchsorted(theirs[0], ours[0]), len(theirs[0]) - 1)
            both = theirs[0][at] == ours[0]
            found[:, n - 1] = np.bincount(ours[0][both] // size, np.minimum(ours[1][both], theirs[1][at[both]]), pairs)
    return found


def _matches(pairs: DataFrame, by: str, reference: str, hypothesis: str) -> DataFrame:
    """by, unit, n -> n-grams of the hypotheses, of the references, and shared ones, each at most as often as in the reference.

    Grams are matched where their pair lies; only sums a group are exchanged.
    """
    units = (("word", BLEU_N), ("character", CHRF_N))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            rows = max(1, int(whole.num_rows * MATCH_BYTES / max(whole.nbytes, 1)))
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                a, b = ([x or "" for x in batch.column(k).to_pylist()] for k in (1, 2))
                columns = []
                for unit, longest in units:
                    sizes = [np.array([len(t.replace(" ", "")) if unit == "character" else sum(w != "" for w in t.split(" ")) for t in texts], np.int64) for texts in (b, a)]
                    m = shared_grams(a, b, unit, longest)
                    columns += [x for n in range(longest) for x in (*(np.maximum(s - n, 0) for s in sizes), m[:, n])]
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], names=names)

    parts = [(unit, n) for unit, longest in units for n in range(1, longest + 1)]
    names = ["by", *[f"{c}_{unit}_{n}" for unit, n in parts for c in "hrm"]]
    narrow = pairs.select(F.col(by).alias("by"), F.col(reference).cast("string"), F.col(hypothesis).cast("string"))
    counted = narrow.mapInArrow(run, f"by {dict(pairs.dtypes)[by]}, {', '.join(f'{c} long' for c in names[1:])}")
    sums = counted.groupBy("by").agg(*[F.sum(c).alias(c) for c in names[1:]])
    rows = F.array(*[F.struct(F.lit(unit).alias("unit"), F.lit(n).alias("n"), *[F.col(f"{c}_{unit}_{n}").alias(c) for c in "hrm"]) for unit, n in parts])
    return sums.select(F.col("by").alias(by), F.inline(rows)).filter("h + r > 0")


def translation_quality(pairs: DataFrame, by: str, reference: str, hypothesis: str) -> DataFrame:
    """Corpus BLEU (clipped n-grams up to BLEU_N, brevity penalty) and chrF (character n-grams up to CHRF_N) of each group.

    A group without any n-gram of some length has BLEU 0; lengths that neither side has do not count in chrF; groups
    without a word are left out.
    """
    word, letter = F.col("unit") == "word", F.col("unit") == "character"
    first = lambda c: F.max(F.when(word & (F.col("n") == 1), F.col(c)))
    share = lambda c: F.avg(F.when(letter, F.coalesce(F.try_divide("m", c), F.lit(0.0))))
    found = _matches(pairs, by, reference, hypothesis).groupBy(by).agg(
        first("h").alias("hyp_words"), first("r").alias("ref_words"), F.exp(F.sum(F.when(word, F.log(F.try_divide("m", "h")))) / BLEU_N).alias("precision"), F.count_if(word & (F.col("m") > 0)).alias("found"),
        share("h").alias("p"), share("r").alias("q"),
    )
    penalty = F.least(F.lit(1.0), F.exp(1 - F.try_divide("ref_words", "hyp_words")))
    bleu = F.when(F.col("found") == BLEU_N, F.col("precision") * penalty).otherwise(0.0)
    chrf = F.coalesce(F.try_divide((1 + BETA**2) * F.col("p") * F.col("q"), BETA**2 * F.col("p") + F.col("q")), F.lit(0.0))
    return found.select(by, "hyp_words", "ref_words", bleu.alias("bleu"), chrf.alias("chrf"))


def privacy_projection(df: DataFrame, sensitive: set[str], include: bool = False) -> DataFrame:
    """Drops text and audio unless they are asked for; columns tagged ``sensitive`` in their metadata count as well."""
    tagged = {f.name for f in df.schema.fields if f.metadata.get("sensitive")}
    return df if include else df.drop(*(sensitive | tagged))


def joined_text(df: DataFrame, by: list[str], order: list[str], text: str = "text") -> DataFrame:
    """The texts of a group, in order and joined by blanks, for reports that were asked to show them; nulls are left out."""
    rows = F.array_sort(F.collect_list(F.when(F.col(text).isNotNull(), F.struct(*order, text))))
    return df.groupBy(*by).agg(F.array_join(F.transform(rows, lambda x: x[text]), " ").alias(text))


def drop_empty_transcripts(df: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """(kept, skipped): blank transcripts are skipped, not failed."""
    blank = F.trim(F.coalesce(F.col(text), F.lit(""))) == ""
    return df.filter(~blank), df.filter(blank)


def first_audio(clauses: DataFrame, keys: list[str], order: str, ms: str) -> DataFrame:
    """Time to the first non-empty clause, at most the total."""
    upto = F.sum(ms).over(Window.partitionBy(*keys).orderBy(order))
    timed = clauses.withColumn("_upto", upto).groupBy(*keys).agg(F.min(F.when(F.col(ms) > 0, F.col("_upto"))).alias("_first"), F.sum(ms).alias("total_ms"), F.count(F.lit(1)).alias("clauses"))
    return timed.select(*keys, F.least(F.coalesce("_first", "total_ms"), "total_ms").alias("first_audio_ms"), "total_ms", "clauses")
