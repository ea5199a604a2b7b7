"""Queries of text operators over documents and conversations."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from voicelake.functions import text as T
from voicelake.operators import quality
from voicelake.plans.registry import query, table

PHRASES = {"of the": "do", "is the": "é o"}
WORDS = {"the": "o", "and": "e", "with": "com", "that": "que", "o": "ó"}
INVERSE = {"que": "that", "el": "the", "los": "the", "y": "and"}

#: The SQL twins' normal form.
NORMAL = r"trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
#: DuckDB counts edits in bytes, so its twins give each letter beyond ASCII of the given tables one byte.
BYTES = "translate({0}, 'ßàâäçèéêëîïñôöùûüœáíóúæÿ', 'ABCDEFGHIJKLMNOPQRSTUVWX')"


CLAUSES = r"""
tokens AS (SELECT conv_id, turn, [x FOR x IN string_split_regex(text, '\s+') IF x <> ''] AS ws FROM conversations),
marked AS (SELECT conv_id, turn, list_reduce(list_prepend({'done': []::VARCHAR[], 'open': []::VARCHAR[], 'w': ''}, list_transform(ws, lambda w: {'done': []::VARCHAR[], 'open': []::VARCHAR[], 'w': w})), lambda a, b:
  CASE WHEN right(regexp_replace(b.w, '["'')\]]+$', ''), 1) IN ('.', '!', '?') OR (right(regexp_replace(b.w, '["'')\]]+$', ''), 1) IN (',', ';', ':', '—') AND len(a.open) + 1 >= 3)
  THEN {'done': list_append(a.done, array_to_string(list_append(a.open, b.w), ' ')), 'open': []::VARCHAR[], 'w': ''}
  ELSE {'done': a.done, 'open': list_append(a.open, b.w), 'w': ''} END) AS f FROM tokens),
clauses AS (SELECT conv_id, turn, CASE WHEN len(f.open) = 0 THEN f.done
  WHEN len(f.open) = 1 AND octet_length(encode(f.open[1])) <= 2 AND len(f.done) > 0 THEN list_append(f.done[1:len(f.done) - 1], f.done[len(f.done)] || ' ' || f.open[1])
  ELSE list_append(f.done, array_to_string(f.open, ' ')) END AS c FROM marked)"""


@query(f"WITH {CLAUSES} SELECT conv_id, turn, unnest(range(0, len(c)))::INT AS clause_idx, unnest(c) AS clause_text FROM clauses")
def split_clauses(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(T.split_clauses(F.col("text"))).alias("clause_idx", "clause_text"))


@query(f"WITH {CLAUSES} SELECT c.conv_id, c.turn, CASE WHEN len(c) > 0 THEN len(c) ELSE 1 END::INT AS clauses, CASE WHEN len(c) > 0 THEN c[1] ELSE trim(t.text) END AS first FROM clauses c JOIN conversations t USING (conv_id, turn)")
def clause_plan(spark, sf_dir):
    plan = T.clause_plan(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(plan).alias("clauses"), F.get(plan, F.lit(0)).alias("first"))


@query(f"SELECT doc_id, {NORMAL.format('text')} AS normalized FROM documents")
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_text(F.col("text")).alias("normalized"))


def _phrases_sql(column: str) -> str:
    """Replaced twice, since matches side by side share a bound."""
    for a, b in PHRASES.items():
        for _ in range(2):
            column = rf"regexp_replace({column}, '(^|[^\p{{L}}\p{{N}}_]){a}($|[^\p{{L}}\p{{N}}_])', '\1{b}\2', 'g')"
    return column


def _swap_sql(column: str, words: dict[str, str]) -> str:
    known = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in words.items()) + "}"
    upper = f"upper({known}[lower(w)][1]) || lower({known}[lower(w)][2:])"
    swap = f"CASE WHEN {known}[lower(w)] IS NULL THEN w WHEN upper(w[1]) = w[1] AND lower(w[1]) <> w[1] THEN {upper} ELSE {known}[lower(w)] END"
    return rf"coalesce(list_aggregate(list_transform(regexp_extract_all({column}, '[A-Za-zÀ-ÿ'']+|[^A-Za-zÀ-ÿ'']+'), lambda w: {swap}), 'string_agg', ''), '')"


TRIMMED = r"regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')"


@query(f"""WITH t AS (SELECT doc_id, lang, {TRIMMED} AS x FROM documents), p AS (SELECT *, {_phrases_sql('lower(x)')} AS y FROM t), s AS (SELECT *, {_swap_sql('y', WORDS)} AS z FROM p)
SELECT doc_id, CASE lang WHEN 'en' THEN upper(z[1]) || z[2:] WHEN 'es' THEN {_swap_sql('x', INVERSE)} ELSE x END AS translated_text FROM s""")
def lexical_translate(spark, sf_dir):
    """English to Portuguese; Spanish stands for Portuguese; the other languages pass through."""
    source = F.when(F.col("lang") == "es", "pt-BR").otherwise(F.col("lang"))
    target = F.when(F.col("lang") == "en", "pt-BR").otherwise("en-US")
    return table(spark, sf_dir, "documents").select("doc_id", T.lexical_translate(F.col("text"), source, target, PHRASES, WORDS, INVERSE).alias("translated_text"))


TURNS = f"""p AS (SELECT conv_id, turn, role, {NORMAL.format('text')} AS a, {NORMAL.format('lead(text) OVER (PARTITION BY conv_id ORDER BY turn)')} AS b FROM conversations)"""
PAIRS = f"""{TURNS},
q AS (SELECT *, levenshtein({BYTES.format('a')}, {BYTES.format('b')}) AS d FROM p WHERE b IS NOT NULL)"""


def _pairs(spark, sf_dir):
    """Each turn with the one after it, whole texts."""
    following = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    paired = table(spark, sf_dir, "conversations").withColumn("next", following).filter("next IS NOT NULL")
    return paired.select("conv_id", "turn", "role", T.normalize_text(F.col("text")).alias("a"), T.normalize_text(F.col("next")).alias("b"))


@query(f"WITH {PAIRS} SELECT role, count(*) AS pairs, round(avg(1 - d / greatest(len(a), len(b), 1)), 6) AS mean_agreement, round(min(1 - d / greatest(len(a), len(b), 1)), 6) AS least_agreement FROM q GROUP BY role")
def text_agreement(spark, sf_dir):
    return quality.text_agreement(_pairs(spark, sf_dir), "a", "b", ["role"])


@query(f"WITH {PAIRS} SELECT conv_id, turn, round(d / greatest(len(a), 1), 6) AS cer FROM q")
def error_rates(spark, sf_dir):
    return _pairs(spark, sf_dir).select("conv_id", "turn", F.round(quality.character_error_rate(F.col("a"), F.col("b")), 6).alias("cer"))


@query()
def word_error_rates(spark, sf_dir):
    """Corpus word error rate a role; tests hold it against plain edit distance."""
    return quality.word_error_rate(_pairs(spark, sf_dir), "a", "b", ["role"])


def _grams_sql(unit: str, text: str, longest: int) -> str:
    parts = f"[x FOR x IN {f"string_split({text}, ' ')" if unit == 'word' else f"string_split(replace({text}, ' ', ''), '')"} IF x <> '']"
    return " UNION ALL ".join(f"SELECT conv_id, turn, role, {n} AS n, unnest(CASE WHEN len(w) >= {n} THEN list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n} - 1], ' ')) ELSE [] END) AS g FROM (SELECT conv_id, turn, role, {parts} AS w FROM q)" for n in range(1, longest + 1))


def _matches_sql(name: str, unit: str, longest: int) -> str:
    return f"""{name}h AS (SELECT conv_id, turn, role, n, g, count(*) AS h FROM ({_grams_sql(unit, 'b', longest)}) GROUP BY ALL), {name}r AS (SELECT conv_id, turn, role, n, g, count(*) AS r FROM ({_grams_sql(unit, 'a', longest)}) GROUP BY ALL),
{name} AS (SELECT role, n, sum(coalesce(h, 0)) AS h, sum(coalesce(r, 0)) AS r, sum(least(coalesce(h, 0), coalesce(r, 0))) AS m FROM {name}h FULL JOIN {name}r USING (conv_id, turn, role, n, g) GROUP BY role, n)"""


@query(f"""WITH {TURNS}, q AS (SELECT * FROM p WHERE b IS NOT NULL), {_matches_sql('w', 'word', 4)}, {_matches_sql('c', 'character', 6)},
b AS (SELECT role, sum(h) FILTER (n = 1)::BIGINT AS hyp_words, sum(r) FILTER (n = 1)::BIGINT AS ref_words, CASE WHEN min(m) > 0 AND count(*) = 4 THEN exp(sum(ln(CASE WHEN m > 0 THEN m / h END)) / 4) ELSE 0 END AS precision FROM w GROUP BY role),
k AS (SELECT role, avg(coalesce(m / nullif(h, 0), 0)) AS p, avg(coalesce(m / nullif(r, 0), 0)) AS q FROM c GROUP BY role)
SELECT role, hyp_words, ref_words, round(precision * least(1, exp(1 - ref_words / hyp_words)), 6) AS bleu, round(5 * p * q / (4 * p + q), 6) AS chrf FROM b JOIN k USING (role)""")
def translation_quality(spark, sf_dir):
    found = quality.translation_quality(_pairs(spark, sf_dir), "role", "a", "b")
    return found.select("role", "hyp_words", "ref_words", F.round("bleu", 6).alias("bleu"), F.round("chrf", 6).alias("chrf"))


@query("SELECT conv_id, trim(string_agg(trim(text), ' ' ORDER BY turn)) AS text FROM conversations GROUP BY conv_id")
def join_segments(spark, sf_dir):
    return T.join_segments(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text")


@query("WITH w AS (SELECT doc_id, string_split(text, ' ') AS ws FROM documents) SELECT doc_id, unnest(range(0, len(ws)))::INT AS word_idx, unnest(ws) AS word FROM w")
def explode_words(spark, sf_dir):
    return T.explode_words(table(spark, sf_dir, "documents"), ["doc_id"], F.split("text", " "))


@query("SELECT conv_id, sum(least(greatest(octet_length(encode(text)) * 50, 50), 5000))::BIGINT AS speech_ms, sum(24 * least(greatest(octet_length(encode(text)) * 50, 50), 5000))::BIGINT AS samples FROM conversations GROUP BY conv_id")
def estimate_speech_ms(spark, sf_dir):
    ms = T.estimate_speech_ms(F.col("text")).cast("long")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(ms).alias("speech_ms"), F.sum(24 * ms).alias("samples"))


@query("SELECT conv_id, turn, role FROM conversations")
def privacy_projection(spark, sf_dir):
    return quality.privacy_projection(table(spark, sf_dir, "conversations"), {"text"})


@query("SELECT conv_id, coalesce(string_agg(text, ' ' ORDER BY turn), '') AS text FROM conversations GROUP BY conv_id")
def shown_text(spark, sf_dir):
    return quality.joined_text(quality.privacy_projection(table(spark, sf_dir, "conversations"), {"text"}, include=True), ["conv_id"], ["turn"])


@query("SELECT role, count(CASE WHEN trim(text) = '' THEN 1 END) AS skipped, count(CASE WHEN trim(text) <> '' THEN 1 END) AS kept FROM conversations GROUP BY role")
def drop_empty_transcripts(spark, sf_dir):
    kept, skipped = quality.drop_empty_transcripts(table(spark, sf_dir, "conversations"), "text")
    both = kept.select("role", F.lit(0).alias("s"), F.lit(1).alias("k")).unionByName(skipped.select("role", F.lit(1).alias("s"), F.lit(0).alias("k")))
    return both.groupBy("role").agg(F.sum("s").alias("skipped"), F.sum("k").alias("kept"))


@query("SELECT doc_id, CASE WHEN n_chars <= 700 THEN 'short' WHEN n_chars <= 1200 THEN 'medium' ELSE 'long' END AS category FROM documents WHERE n_chars > 700 AND n_chars <= 1200")
def only_category(spark, sf_dir):
    medium = table(spark, sf_dir, "documents").filter("n_chars > 700 AND n_chars <= 1200")
    return medium.select("doc_id", F.lit("medium").alias("category"))


@query("SELECT doc_id, lower(lang) AS primary_tag, CASE WHEN lang = 'en' THEN 'a' WHEN lang LIKE 'pt%' THEN 'p' ELSE 'a' END AS voice, CASE WHEN lang <> 'en' THEN 'UNSUPPORTED_CAPABILITY' END AS error_code FROM documents")
def language_facts(spark, sf_dir):
    tag = T.primary_language(F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", tag.alias("primary_tag"), T.voice_family(F.col("lang")).alias("voice"), F.when(tag != "en", "UNSUPPORTED_CAPABILITY").alias("error_code"))


@query(f"""WITH {CLAUSES}, x AS (SELECT conv_id, turn, unnest(range(0, len(c))) AS k, least(greatest(octet_length(encode(unnest(c))) * 50, 50), 5000) AS ms FROM clauses),
y AS (SELECT *, sum(ms) OVER (PARTITION BY conv_id, turn ORDER BY k) AS upto FROM x) SELECT conv_id, turn, min(upto)::BIGINT AS first_audio_ms, sum(ms)::BIGINT AS total_ms, count(*) AS clauses FROM y GROUP BY ALL""")
def first_audio(spark, sf_dir):
    parts = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(T.split_clauses(F.col("text"))).alias("k", "clause"))
    timed = parts.withColumn("ms", T.estimate_speech_ms(F.col("clause")).cast("long"))
    return quality.first_audio(timed, ["conv_id", "turn"], "k", "ms")


@query(f"""WITH {CLAUSES}, x AS (SELECT conv_id, turn, unnest(range(0, len(c))) AS k, unnest(c) AS t FROM clauses) SELECT conv_id, turn, string_agg(t, ' ' ORDER BY k) AS text, sum(least(greatest(octet_length(encode(t)) * 50, 50), 5000))::BIGINT AS tts_ms FROM x GROUP BY ALL""")
def reassemble_clauses(spark, sf_dir):
    parts = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(T.split_clauses(F.col("text"))).alias("k", "clause"))
    ordered = F.array_sort(F.collect_list(F.struct("k", "clause")))
    return parts.groupBy("conv_id", "turn").agg(F.array_join(F.transform(ordered, lambda x: x["clause"]), " ").alias("text"), F.sum(T.estimate_speech_ms(F.col("clause")).cast("long")).alias("tts_ms"))


@query("SELECT conv_id, arg_max(text, turn) AS text, max(turn) AS turn, CASE WHEN count(*) > 1 THEN 'revised' ELSE 'committed' END AS state FROM conversations GROUP BY conv_id")
def commit_partials(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"), F.max("turn").alias("turn"), F.when(F.count(F.lit(1)) > 1, "revised").otherwise("committed").alias("state"))


@query("SELECT conv_id, turn, direction, CASE WHEN direction = 'out' THEN 'pt' ELSE 'en' END AS source_lang, CASE WHEN direction = 'out' THEN 'en' ELSE 'pt' END AS target_lang FROM (SELECT *, CASE WHEN role = 'user' THEN 'out' ELSE 'in' END AS direction FROM conversations)")
def union_directions(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    leg = lambda df, d, a, b: df.select("conv_id", "turn", F.lit(d).alias("direction"), F.lit(a).alias("source_lang"), F.lit(b).alias("target_lang"))
    return leg(rows.filter("role = 'user'"), "out", "pt", "en").unionByName(leg(rows.filter("role <> 'user'"), "in", "en", "pt"))
