"""Transcript expressions."""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalize_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is named there."""
    return F.transform(F.array(value), use)[0]


def split_clauses(text: Column, min_words: int = 3) -> Column:
    """Clauses for synthesis: strong marks always close one, weak marks once it has min_words; a lone short tail joins the clause before.

    Only the places of the cuts are carried from word to word, so a long text is not copied at each.
    """
    tokens = F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda t: t != "")

    def mark(token: Column) -> Column:
        last = F.right(F.regexp_replace(token, r"[\"')\]]+$", ""), F.lit(1))
        return F.when(last.isin(".", "!", "?"), 2).when(last.isin(",", ";", ":", "—"), 1).otherwise(0)

    def step(a: Column, kind: Column) -> Column:
        n, at = a["n"] + 1, a["at"] + 1
        closes = (kind == 2) | ((kind == 1) & (n >= min_words))
        return F.struct(F.when(closes, 0).otherwise(n).alias("n"), at.alias("at"), F.when(closes, F.concat(a["cuts"], F.array(at))).otherwise(a["cuts"]).alias("cuts"))

    def clauses(words: Column, cuts: Column) -> Column:
        start = lambda i: F.coalesce(F.get(cuts, i - 1), F.lit(0))
        done = F.transform(cuts, lambda end, i: F.array_join(F.slice(words, start(i) + 1, end - start(i)), " "))
        n, left = F.size(cuts), F.size(words) - start(F.size(cuts))
        tail = F.array_join(F.slice(words, start(n) + 1, left), " ")
        lone = (left == 1) & (F.octet_length(tail) <= 2) & (n > 0)
        merged = _bound(done, lambda d: F.concat(F.slice(d, F.lit(1), n - 1), F.array(F.concat_ws(" ", F.get(d, n - 1), tail))))
        return F.when(left == 0, done).when(lone, merged).otherwise(F.concat(done, F.array(tail)))

    seed = F.struct(F.lit(0).alias("n"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("cuts"))
    return _bound(tokens, lambda words: _bound(F.aggregate(F.transform(words, mark), seed, step, lambda a: a["cuts"]), lambda cuts: clauses(words, cuts)))


def clause_plan(text: Column, chunked: bool = True, min_words: int = 3) -> Column:
    whole = F.array(F.trim(F.coalesce(text, F.lit(""))))
    parts = split_clauses(text, min_words)
    return F.when(F.size(parts) > 0, parts).otherwise(whole) if chunked else whole


def estimate_speech_ms(text: Column) -> Column:
    return F.least(F.greatest(F.octet_length(text) * 50, F.lit(50)), F.lit(5000))


def primary_language(tag: Column) -> Column:
    cut = F.lower(F.regexp_extract(F.trim(tag), "^([^-_]*)", 1))
    return F.when(cut != "", cut)


def voice_family(tag: Column, fallback: str = "a") -> Column:
    low = F.lower(F.trim(tag))
    return F.when(low == "en-gb", "b").when(low.startswith("en"), "a").when(low.startswith("pt"), "p").otherwise(fallback)


#: Fixed value: what counts as a letter of a word in translation.
WORD_LETTERS = r"[A-Za-zÀ-ÿ']"


def _swapped(text: Column, words: dict[str, str]) -> Column:
    """Each word looked up once, in lower case; an upper first letter stays upper."""
    if not words:
        return text
    known = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    upper = lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substring(t, 2, 1 << 30)))

    def swap(token: Column) -> Column:
        found, first = F.try_element_at(known, F.lower(token)), F.substring(token, 1, 1)
        return F.coalesce(F.when((F.upper(first) == first) & (F.lower(first) != first), upper(found)).otherwise(found), token)

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(f"{WORD_LETTERS}+|[^{WORD_LETTERS[1:]}+"), F.lit(0)), swap), "")


def lexical_translate(text: Column, source: Column, target: Column, phrases: dict[str, str], words: dict[str, str], inverse: dict[str, str]) -> Column:
    """en to pt: lower case, phrases in order on word bounds, then words, first letter upper; pt to en: words of ``inverse`` alone.

    Other pairs are trimmed; blank and null texts give ''.
    """
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    out = F.lower(trimmed)
    for known, said in phrases.items():
        out = F.regexp_replace(out, rf"(?U)\b{re.escape(known)}\b", said.replace("\\", "\\\\").replace("$", "\\$"))
    out = _swapped(out, words)
    tag = lambda c: F.lower(F.trim(c))
    forward, back = tag(source).startswith("en") & tag(target).startswith("pt"), tag(source).startswith("pt") & tag(target).startswith("en")
    return F.when(forward, F.concat(F.upper(F.substring(out, 1, 1)), F.substring(out, 2, 1 << 30))).when(back, _swapped(trimmed, inverse)).otherwise(trimmed)


def explode_words(df: DataFrame, keys: list[str], words: Column) -> DataFrame:
    """keys, word_idx, word of an array of words; a null array gives no rows."""
    return df.select(*keys, F.posexplode(words).alias("word_idx", "word"))


def join_segments(df: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """The trimmed segments of a key in order, joined by blanks; all of one key's segments are one row."""
    ordered = F.array_sort(F.collect_list(F.struct(order, F.trim(text).alias("text"))))
    return df.groupBy(*keys).agg(F.trim(F.array_join(F.transform(ordered, lambda t: t["text"]), " ")).alias("text"))
