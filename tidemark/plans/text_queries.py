"""Queries over captions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.plans.register import SQL, query, rounded

_T = "coalesce(caption, '')"
_W = f"list_filter(regexp_split_to_array(lower({_T}), '\\s+'), lambda w: w <> '')"
_FIRST = f"lower(split_part({_T}, chr(10), 1))"
_EMOJI = "[\\x{1F600}-\\x{1F64F}\\x{1F300}-\\x{1F5FF}\\x{1F680}-\\x{1F6FF}\\x{1F1E0}-\\x{1F1FF}\\x{2702}-\\x{27B0}\\x{24C2}-\\x{1F251}]+"


def _has(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({_T}), '{w.lower()}')" for w in words) + ")"


def _count(words: list[str]) -> str:
    return " + ".join(f"CAST(contains(lower({_T}), '{w}') AS INT)" for w in words)


def _match(pattern: str, text: str = _FIRST) -> str:
    pattern = pattern.replace("'", "''").replace("\\w", "[\\pL\\pN_]")
    return f"CAST(regexp_matches({text}, '{pattern}', 'i') AS INT)"


@query(
    f"""SELECT post_id, length({_T}) AS caption_length, len({_W}) AS caption_words, length({_T}) - length(replace({_T}, chr(10), '')) + 1 AS caption_lines,
    round(CASE WHEN len({_W}) > 0 THEN list_sum(list_transform({_W}, lambda w: length(w))) / len({_W}) ELSE 0 END, 6) AS avg_word_length,
    round(CASE WHEN len({_W}) > 0 THEN len(list_distinct({_W})) / len({_W}) ELSE 0 END, 6) AS lexical_richness FROM captions""",
    "captions",
    reads="captions",
)
def txt_01_lengths(captions: DataFrame) -> DataFrame:
    made = T.lengths(T.text())
    counts = [made[c].cast("long").alias(c) for c in ("caption_length", "caption_words", "caption_lines")]
    return captions.select("post_id", *counts, *rounded({c: made[c] for c in ("avg_word_length", "lexical_richness")}))


@query(
    f"""SELECT post_id, CAST(regexp_matches({_T}, '\\?|¿|cuál|qué|cómo|por qué|quién|dónde|cuándo', 'i') AS INT) AS has_question, CAST({_has(T.STRONG_CTA)} AS INT) AS has_strong_cta FROM captions""",
    "captions",
    reads="captions",
)
def txt_02_appeals(captions: DataFrame) -> DataFrame:
    return captions.select("post_id", *[c.alias(k) for k, c in T.appeals(T.text()).items()])


@query(
    f"""SELECT post_id, len(regexp_extract_all({_T}, '{_EMOJI}')) AS emoji_count, round(len(regexp_extract_all({_T}, '{_EMOJI}')) / greatest(length({_T}), 1) * 100, 6) AS emoji_density FROM captions""",
    "captions",
    reads="captions",
)
def txt_03_emoji(captions: DataFrame) -> DataFrame:
    made = T.emoji(T.text())
    return captions.select("post_id", made["emoji_count"].cast("long").alias("emoji_count"), *rounded({"emoji_density": made["emoji_density"]}))


@query(
    f"""SELECT post_id, len(regexp_extract_all({_T}, '#[\\pL\\pN_]+')) AS hashtag_count, round(len(regexp_extract_all({_T}, '#[\\pL\\pN_]+')) / greatest(len({_W}), 1), 6) AS hashtag_density,
    len(regexp_extract_all({_T}, '@[\\pL\\pN_]+')) AS mention_count, array_to_string(regexp_extract_all(lower({_T}), '#[\\pL\\pN_]+'), ' ') AS tags FROM captions""",
    "captions",
    reads="captions",
)
def txt_04_cln_15_tags(captions: DataFrame) -> DataFrame:
    made = T.tag_counts(T.text())
    counts = [made[c].cast("long").alias(c) for c in ("hashtag_count", "mention_count")]
    return captions.select("post_id", *counts, F.array_join(T.tags(T.text(), lower=True), " ").alias("tags"), *rounded({"hashtag_density": made["hashtag_density"]}))


@query("SELECT post_id, " + ", ".join(f"CAST({_has(v)} AS INT) AS niche_{k}" for k, v in T.NICHES.items()) + " FROM captions", "captions", reads="captions")
def txt_05_niche_flags(captions: DataFrame) -> DataFrame:
    return captions.select("post_id", *[c.alias(k) for k, c in T.niche_flags(T.text()).items()])


@query("SELECT post_id, " + ", ".join(f"{_count(v)} AS trigger_{k}" for k, v in T.TRIGGERS.items()) + " FROM captions", "captions", reads="captions")
def txt_06_trigger_counts(captions: DataFrame) -> DataFrame:
    return captions.select("post_id", *[c.alias(k) for k, c in T.trigger_counts(T.text()).items()])


_HOOKS = {k: _match(v) for k, v in T.HOOKS.items()}


@query(
    "SELECT post_id, " + ", ".join(f"{v} AS hook_{k}" for k, v in _HOOKS.items()) + f", round(least(({' + '.join(_HOOKS.values())}) / 3, 1), 6) AS hook_regex_score FROM captions",
    "captions",
    reads="captions",
)
def txt_07_hook_flags(captions: DataFrame) -> DataFrame:
    made = T.hook_flags(T.text())
    score = made.pop("hook_regex_score")
    return captions.select("post_id", *[c.alias(k) for k, c in made.items()], *rounded({"hook_regex_score": score}))


@query(
    f"""SELECT post_id, CASE WHEN {_T} = '' THEN 0 ELSE CASE {' + '.join(_HOOKS.values())} WHEN 0 THEN 0.1 WHEN 1 THEN 0.5 WHEN 2 THEN 0.7 ELSE 0.9 END END::DOUBLE AS hook_score,
    CASE WHEN {_T} = '' THEN '' ELSE concat_ws(',', {', '.join(f"CASE WHEN {v} = 1 THEN '{k}' END" for k, v in _HOOKS.items())}) END AS hook_names FROM captions""",
    "captions",
    reads="captions",
)
def txt_08_stepped_hook_score(captions: DataFrame) -> DataFrame:
    made = T.stepped_hook_score(T.text())
    return captions.select("post_id", made["hook_score"].alias("hook_score"), F.array_join(made["hook_names"], ",").alias("hook_names"))


_CTAS = {k: _match(v, f"lower({_T})") for k, v in T.CTAS.items()}


@query("SELECT post_id, " + ", ".join(f"{v} AS cta_{k}" for k, v in _CTAS.items()) + f", {' + '.join(_CTAS.values())} AS cta_count FROM captions", "captions", reads="captions")
def txt_09_cta_flags(captions: DataFrame) -> DataFrame:
    return captions.select("post_id", *[c.alias(k) for k, c in T.cta_flags(T.text()).items()])


def _times(word: str) -> str:
    return f"(length(lower({_T})) - length(replace(lower({_T}), '{word}', ''))) // {len(word)}"


@query(
    f"""SELECT post_id, {_times('#')} AS hashtag_count, {_times('@')} AS mention_count, """
    + ", ".join(f"least({' + '.join(_times(w) for w in v)}, 5) AS trigger_{k}" for k, v in T.TRIGGERS.items())
    + " FROM captions",
    "captions",
    reads="captions",
)
def txt_10_bilingual_counts(captions: DataFrame) -> DataFrame:
    return captions.select("post_id", *[c.cast("long").alias(k) for k, c in T.bilingual(T.text()).items()])


_HOOK_TEXT = f"trim(split_part(split_part({_T}, chr(10), 1), '.', 1))"
_MATCHED = " + ".join(_match(p, _HOOK_TEXT) for p in T.OPENING_HOOKS)
_FACES = "[\\x{1F600}-\\x{1F64F}\\x{1F300}-\\x{1F5FF}\\x{1F680}-\\x{1F6FF}\\x{1F1E0}-\\x{1F1FF}]+"


@query(
    f"""SELECT post_id, {_HOOK_TEXT} AS hook_text, CASE WHEN {_HOOK_TEXT} = '' THEN 0 ELSE {_MATCHED} END AS patterns_matched,
    CASE WHEN {_HOOK_TEXT} = '' THEN 0 ELSE round(least(greatest(least(({_MATCHED}) * 0.2, 0.6) + CASE WHEN contains({_HOOK_TEXT}, '?') THEN 0.1 ELSE 0 END
      + CASE WHEN regexp_matches({_HOOK_TEXT}, '{_FACES}') THEN 0.05 ELSE 0 END + CASE WHEN contains({_HOOK_TEXT}, '...') THEN 0.05 ELSE 0 END
      - CASE WHEN len(string_split({_HOOK_TEXT}, ' ')) > 15 THEN 0.1 ELSE 0 END, 0), 1), 4) END::DOUBLE AS hook_score FROM captions""",
    "captions",
    reads="captions",
)
def txt_12_opening_hook(captions: DataFrame) -> DataFrame:
    made = T.opening_hook(T.text(), F.lit(""), F.lit(None).cast("string"))
    return captions.select("post_id", *[c.alias(k) for k, c in made.items()])


@query(
    f"""SELECT post_id, round(CASE WHEN contains({_T}, '?') OR contains({_T}, '¿') THEN 0.05 ELSE 0 END + CASE WHEN contains({_T}, '🎉') THEN 0.03 ELSE 0 END
    + CASE WHEN contains({_T}, '...') OR contains({_T}, '…') THEN 0.02 ELSE 0 END, 6)::DOUBLE AS bonus FROM captions""",
    "captions",
    reads="captions",
)
def txt_13_curiosity_bonus(captions: DataFrame) -> DataFrame:
    return captions.select("post_id", *rounded({"bonus": T.curiosity_bonus(T.text(), ["🎉"])}))


@query(
    f"""WITH f AS (SELECT post_id, content_format, {_T} AS t, least(({' + '.join(_HOOKS.values())}) / 3, 1) AS hook, {' + '.join(_CTAS.values())} AS ctas, CAST({_has(T.STRONG_CTA)} AS INT) AS strong,
      CAST(content_format IN ('reel', 'tiktok_video') AS INT) AS reel, (post_id % 5 - 2) / 2.0 AS s, post_id % 2 AS opt, repeat('x', CAST(post_id % 700 AS INT)) AS speech FROM captions)
    SELECT post_id, round(hook * s, 6) + 0.0::DOUBLE AS hook_x_sentiment, round(hook * reel, 6) AS hook_x_is_reel, round(hook * ctas, 6) AS hook_x_cta_count, round(s * ctas, 6)::DOUBLE + 0.0::DOUBLE AS sentiment_x_cta_count,
    (reel * opt)::DOUBLE AS is_reel_x_video_optimal, round(least(length(speech) / 500, 1), 6) AS transcript_richness, 0.0::DOUBLE AS ocr_richness,
    round(least((length(t) + length(speech)) / 1000, 1), 6) AS multimodal_text_density, round(hook * abs(s), 6) AS semantic_hook_x_vader, round(hook * strong, 6) AS semantic_hook_x_cta_strong FROM f""",
    "captions",
    reads="captions",
)
def txt_18_27_interactions(captions: DataFrame) -> DataFrame:
    t = T.text()
    rows = captions.withColumns(T.hook_flags(t) | T.cta_flags(t) | T.appeals(t))
    reel = F.col("content_format").isin("reel", "tiktok_video").cast("int")
    made = T.interactions(F.col("hook_regex_score"), (F.col("post_id") % 5 - 2) / 2, reel, F.col("cta_count"), F.col("post_id") % 2, F.col("has_strong_cta"), F.length(t), F.repeat(F.lit("x"), (F.col("post_id") % 700).cast("int")), F.lit(None).cast("string"))
    return rows.select("post_id", *rounded(made))


@query(
    f"""SELECT post_id, least(CASE WHEN NOT {_has(T.STRONG_CTA)} THEN 20 ELSE 0 END + CASE WHEN NOT regexp_matches({_T}, '\\?|¿|cuál|qué|cómo|por qué|quién|dónde|cuándo', 'i') THEN 15 ELSE 0 END
    + CASE WHEN NOT regexp_matches({_T}, '{_EMOJI}') THEN 10 ELSE 0 END + CASE WHEN length({_T}) < 50 OR length({_T}) > 500 THEN 10 ELSE 0 END, 50) AS potential,
    array_to_string(list_slice(list_filter([{', '.join(f"CASE WHEN {_count(T.TRIGGERS[k])} = 0 THEN '{k}' END" for k in ('question', 'urgency', 'value', 'curiosity', 'action'))}], lambda x: x IS NOT NULL), 1, 3), ',') AS missing,
    concat_ws(' ', CASE WHEN trim({_T}) <> '' THEN concat('[caption] ', trim({_T})) END, CASE WHEN post_id % 3 = 0 THEN '[speech] hola' END) AS tagged FROM captions""",
    "captions",
    reads="captions",
)
def txt_22_23_24_set_04_potential(captions: DataFrame) -> DataFrame:
    t = T.text()
    rows = captions.withColumns(T.appeals(t) | T.emoji(t))
    speech = F.when(F.col("post_id") % 3 == 0, " hola ").otherwise(F.lit("  "))
    return rows.select(
        "post_id",
        T.improvement(F.col("has_strong_cta"), F.col("has_question"), F.col("emoji_count"), F.length(t)).alias("potential"),
        F.array_join(T.missing_triggers(t), ",").alias("missing"),
        T.tagged_text({"caption": F.col("caption"), "speech": speech}).alias("tagged"),
    )


# Captions between words that strengthen, weaken or turn what follows them.
_LEXICON = ", ".join(f"('{w}', {v})" for w, v in T.valences())
_BOOSTS = ", ".join(f"('{w}', {b})" for w, b in T.BOOSTERS.items())
_TURNS = ", ".join("'" + n.replace("'", "''") + "'" for n in T.NEGATIONS)
_BEFORE = lambda k: f"lag(word, {k}) OVER (PARTITION BY post_id ORDER BY i)"


@query(
    f"""WITH t AS (SELECT post_id, concat_ws(' ', ['muy bueno, no?', 'no es muy bueno', 'nunca odio!!', 'algo triste...', 'without any very bad word', 'Perfecto!!!!!', 'neutral'][post_id % 7 + 1], caption) AS text FROM captions),
    x AS (SELECT * FROM (VALUES {_LEXICON}) x(word, valence)), g AS (SELECT * FROM (VALUES {_BOOSTS}) g(word, b)),
    w AS (SELECT post_id, least(len(text) - len(replace(text, '!', '')), 4) AS marks, list_filter(list_transform(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda c: c <> ''), lambda c: regexp_replace(c, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g')), lambda c: c <> '') AS w FROM t),
    e AS (SELECT post_id, marks, unnest(w) AS word, unnest(range(len(w))) AS i FROM w), p AS (SELECT *, {_BEFORE(1)} AS b1, {_BEFORE(2)} AS b2, {_BEFORE(3)} AS b3 FROM e),
    v AS (SELECT p.*, (coalesce(valence, 0) + sign(coalesce(valence, 0)) * (coalesce(g1.b, 0) + coalesce(g2.b, 0) * 0.95 + coalesce(g3.b, 0) * 0.9))::DOUBLE * (CASE WHEN b1 IN ({_TURNS}) THEN -0.74 ELSE 1 END)::DOUBLE * (CASE WHEN b2 IN ({_TURNS}) THEN -0.74 ELSE 1 END)::DOUBLE * (CASE WHEN b3 IN ({_TURNS}) THEN -0.74 ELSE 1 END)::DOUBLE AS v
      FROM p LEFT JOIN x USING (word) LEFT JOIN g g1 ON g1.word = b1 LEFT JOIN g g2 ON g2.word = b2 LEFT JOIN g g3 ON g3.word = b3),
    a AS (SELECT post_id, sum(CASE WHEN v > 0 THEN v + 1 ELSE 0 END) AS p, sum(CASE WHEN v < 0 THEN 1 - v ELSE 0 END) AS q, count(*) FILTER (v = 0) AS z, sum(v) + sign(sum(v)) * max(marks) * 0.292 AS s FROM v GROUP BY post_id)
    SELECT post_id, round(p / (p + q + z), 6) AS pos, round(q / (p + q + z), 6) AS neg, round(1 - p / (p + q + z) - q / (p + q + z), 6) + 0 AS neu, round(s / sqrt(s * s + 15), 6) AS compound FROM a""",
    "captions",
    reads="captions",
)
def txt_11_lexicon_sentiment(captions: DataFrame) -> DataFrame:
    lexicon = captions.sparkSession.createDataFrame(T.valences(), "word string, valence double")
    openings = F.array(*[F.lit(x) for x in ("muy bueno, no?", "no es muy bueno", "nunca odio!!", "algo triste...", "without any very bad word", "Perfecto!!!!!", "neutral")])
    told = captions.withColumn("caption", F.concat_ws(" ", F.get(openings, (F.col("post_id") % 7).cast("int")), "caption"))
    made = T.lexicon_sentiment(told, lexicon, "post_id", "caption")
    return made.select("post_id", *rounded({c: F.col(c) for c in ("pos", "neg", "neu", "compound")}))


@query(
    """SELECT vec_id, round(list_avg(embedding[1:8]::DOUBLE[]), 6) AS semantic_score, round(embedding[1]::DOUBLE, 6) AS e0, round(embedding[2]::DOUBLE, 6) AS e1, 0.0::DOUBLE AS absent FROM embeddings""",
    reads="embeddings",
)
def txt_20_21_25_vector_columns(embeddings: DataFrame) -> DataFrame:
    wide = embeddings.select("vec_id", *T.expanded("embedding", 8, "semantic_"))
    scored = T.semantic_score(wide)
    made = T.aligned(scored, ["semantic_score", "semantic_0", "semantic_1", "absent"], ["vec_id"])
    return made.select("vec_id", *rounded({"semantic_score": F.col("semantic_score"), "e0": F.col("semantic_0"), "e1": F.col("semantic_1"), "absent": F.col("absent")}))


# A hook is the mean of all vectors of a label and a twelfth of the ids; its category is the twelfth.
_HOOK_ROWS = """e AS (SELECT label * 12 + vec_id % 12 AS hook_id, unnest(range(0, len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
m AS (SELECT hook_id, i, avg(x) AS x FROM e GROUP BY 1, 2), h AS (SELECT hook_id, hook_id % 12 AS category, list(x ORDER BY i) AS hv FROM m GROUP BY 1)"""


def _hooks(embeddings: DataFrame) -> DataFrame:
    parts = embeddings.select((F.col("label") * 12 + F.col("vec_id") % 12).alias("hook_id"), F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("hook_id", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    vector = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda c: c["x"])
    return means.groupBy("hook_id").agg(vector.alias("hook_vector")).withColumn("category", F.col("hook_id") % 12)


@query(
    f"""WITH {_HOOK_ROWS}, s AS (SELECT vec_id AS text_id, hook_id, list_cosine_similarity(embedding::DOUBLE[], hv) AS sim FROM embeddings CROSS JOIN h), r AS (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY sim DESC, hook_id) AS p FROM s)
    SELECT text_id, round(max(sim), 6) AS max_similarity, round(avg(sim), 6) AS top3_avg, string_agg(hook_id::VARCHAR, ',' ORDER BY p) AS top_hooks,
    CASE WHEN max(sim) >= 0.7 THEN 'strong' WHEN max(sim) >= 0.5 THEN 'moderate' WHEN max(sim) >= 0.3 THEN 'weak' ELSE 'minimal' END AS strength FROM r WHERE p <= 3 GROUP BY text_id""",
    reads="embeddings",
)
def txt_14_hook_scores(embeddings: DataFrame) -> DataFrame:
    from tidemark.operators.nearest import hook_scores

    made = hook_scores(embeddings.select(F.col("vec_id").alias("text_id"), F.col("embedding").alias("vector")), _hooks(embeddings).drop("category"))
    return made.select("text_id", "strength", F.array_join(F.col("top_hooks").cast("array<string>"), ",").alias("top_hooks"), *rounded({c: F.col(c) for c in ("max_similarity", "top3_avg")}))


@query(
    f"""WITH {_HOOK_ROWS} SELECT vec_id AS text_id, category, round(max(list_cosine_similarity(embedding::DOUBLE[], hv)), 6) AS similarity FROM embeddings CROSS JOIN h GROUP BY 1, 2""",
    reads="embeddings",
)
def txt_15_category_scores(embeddings: DataFrame) -> DataFrame:
    from tidemark.operators.nearest import category_scores

    made = category_scores(embeddings.select(F.col("vec_id").alias("text_id"), F.col("embedding").alias("vector")), _hooks(embeddings).drop("hook_id"))
    return made.select("text_id", "category", *rounded({"similarity": F.col("similarity")}))


# Stand-ins for what an encoder and a sentiment model give; patterns are those of the captions.
_SEMANTIC, _SENTIMENT = "(post_id % 11) / 10.0", "((post_id % 5) - 2) / 2.0"
_REGEX = f"least(({' + '.join(_HOOKS.values())}) / 3, 1)"


def _with_models(captions: DataFrame) -> DataFrame:
    made = T.appeals(T.text())
    return captions.withColumns({"semantic_hook_score": F.expr(_SEMANTIC).cast("double"), "sentiment_compound": F.expr(_SENTIMENT).cast("double"), "has_strong_cta": made["has_strong_cta"]})


@query(f"SELECT post_id, round(round({_SEMANTIC} * 0.85 + {_REGEX} * 0.15, 4), 4)::DOUBLE AS combined FROM captions", "captions", reads="captions")
def txt_16_combined_hook(captions: DataFrame) -> DataFrame:
    rows = _with_models(captions)
    return rows.select("post_id", *rounded({"combined": T.combined_hook(F.col("semantic_hook_score"), T.hook_flags(T.text())["hook_regex_score"])}, 4))


_STRONG = f"CAST({_has(T.STRONG_CTA)} AS INT)"


@query(
    f"SELECT post_id, round({_REGEX}, 6)::DOUBLE AS hook_regex_score, round({_SEMANTIC} * abs({_SENTIMENT}), 6)::DOUBLE AS x_vader, round({_SEMANTIC} * {_STRONG}, 6)::DOUBLE AS x_cta FROM captions",
    "captions",
    reads="captions",
)
def txt_17_hook_training(captions: DataFrame) -> DataFrame:
    made = T.hook_training(_with_models(captions), T.text())
    names = {"hook_regex_score": "hook_regex_score", "x_vader": "interaction_semantic_hook_x_vader", "x_cta": "interaction_semantic_hook_x_cta_strong"}
    return made.select("post_id", *rounded({k: F.col(c) for k, c in names.items()}))


@query(
    f"SELECT count(*) FILTER (s >= 0.7) AS high, count(*) FILTER (s >= 0.5 AND s < 0.7) AS medium, count(*) FILTER (s < 0.5) AS low, round(avg(s), 6)::DOUBLE AS mean_score FROM (SELECT {_SEMANTIC} AS s FROM captions) x",
    "captions",
    reads="captions",
)
def txt_17_hook_bands(captions: DataFrame) -> DataFrame:
    made = T.hook_bands(_with_models(captions))
    return made.select("high", "medium", "low", *rounded({"mean_score": F.col("mean_score")}))


_TRIGGER_WORDS = [("social_proof", "clientes"), ("transformation", "antes"), ("value", "gratis")]


@query(
    f"""WITH f AS (SELECT post_id, content_format, {_T} AS t, CASE WHEN post_id % 2 = 0 THEN 'reel' ELSE 'carousel' END AS rec, 60 + post_id % 30 AS conf,
      {' + '.join(_match(p, f'lower({_T})') for p in T.CTAS.values())} AS ctas, {_HOOKS['question']} + {_HOOKS['pov']} + {_HOOKS['number']} AS hooks, len(regexp_extract_all({_T}, '{_EMOJI}')) AS em,
      list_filter([{', '.join(f"CASE WHEN NOT contains(lower({_T}), '{w}') THEN 'Incluye elementos de {k}: {w}' END" for k, w in _TRIGGER_WORDS)}], lambda x: x IS NOT NULL) AS trig FROM captions)
    SELECT post_id, array_to_string(list_concat(list_filter([CASE WHEN cur <> rec AND conf > 70 THEN concat('Considera cambiar a formato ', rec, ' para este contenido') END, CASE WHEN ctas = 0 THEN '{T.SUGGESTED_CTA.replace("'", "''")}' END,
      CASE WHEN hooks = 0 THEN '{T.SUGGESTED_HOOK}' END, CASE WHEN em < 3 THEN '{T.SUGGESTED_EMOJI}' END], lambda x: x IS NOT NULL), trig[1:2])[1:5], ' | ') AS suggestions
    FROM (SELECT *, CASE content_format WHEN 'reel' THEN 'reel' WHEN 'carousel' THEN 'carousel' ELSE 'static' END AS cur FROM f) x""",
    "captions",
    reads="captions",
)
def txt_26_suggestions(captions: DataFrame) -> DataFrame:
    t, hooks = T.text(), T.hook_flags(T.text())
    current = F.when(F.col("content_format").isin("reel", "carousel"), F.col("content_format")).otherwise("static")
    recommended = F.when(F.col("post_id") % 2 == 0, "reel").otherwise("carousel")
    triggers = F.array_compact(F.array(*[F.when(~F.contains(F.lower(t), F.lit(w)), F.struct(F.lit(k).alias("type"), F.lit(w).alias("example"))) for k, w in _TRIGGER_WORDS]))
    hooked = (hooks["hook_question"] + hooks["hook_pov"] + hooks["hook_number"]) > 0
    made = T.suggestions(current, recommended, 60 + F.col("post_id") % 30, T.cta_flags(t)["cta_count"], hooked, T.emoji(t)["emoji_count"], triggers)
    return captions.select("post_id", F.array_join(made, " | ").alias("suggestions"))


_FUSED = {"training": "content_format IN ('reel', 'video', 'tiktok')", "scoring": "content_format IN ('reel', 'video', 'tiktok', 'tiktok_video')"}


@query(
    " UNION ALL ".join(
        f"SELECT '{mode}' AS mode, '{kind}' AS tables, post_id, CASE WHEN (SELECT coalesce(bool_or({rule}), FALSE) FROM captions WHERE {kept}) THEN round(length({_T}) / 500.0, 6) ELSE 0 END::DOUBLE AS richness FROM captions WHERE {kept}"
        for mode, rule in _FUSED.items()
        for kind, kept in (("all", "TRUE"), ("tiktok", "content_format IN ('tiktok_video', 'story')"), ("still", "content_format IN ('static_image', 'carousel')"))
    ),
    "captions",
    reads="captions",
)
def txt_19_27_gated_fusion(captions: DataFrame) -> DataFrame:
    """The gate for tables with every format, with TikTok videos only, which training doesn't count, and without any video."""
    rows = captions.withColumns({"media_type": F.upper("content_format"), "whisper_transcript": T.text()})
    tables = {"all": rows, "tiktok": rows.where(F.col("content_format").isin("tiktok_video", "story")), "still": rows.where(F.col("content_format").isin("static_image", "carousel"))}
    made = None
    for mode in _FUSED:
        for kind, table in tables.items():
            fused = T.gated_fusion(table, {"richness": F.length("whisper_transcript") / 500}, training=mode == "training")
            fused = fused.select(F.lit(mode).alias("mode"), F.lit(kind).alias("tables"), "post_id", *rounded({"richness": F.col("richness")}))
            made = fused if made is None else made.unionByName(fused)
    return made


_TABLE = ["txt_01_lengths", "txt_02_appeals", "txt_03_emoji", "txt_04_cln_15_tags", "txt_05_niche_flags", "txt_06_trigger_counts", "txt_07_hook_flags", "txt_09_cta_flags"]


@query("SELECT * EXCLUDE (tags) FROM " + " JOIN ".join(f"({SQL[q]}) {q}" if i == 0 else f"({SQL[q]}) {q} USING (post_id)" for i, q in enumerate(_TABLE)), reads="captions")
def ml_16_feature_table(captions: DataFrame) -> DataFrame:
    """The caption features of a batch as one table, in one pass."""
    made = T.features(captions.select("post_id", "caption"))
    doubles = ["avg_word_length", "lexical_richness", "emoji_density", "hashtag_density", "hook_regex_score"]
    longs = ["caption_length", "caption_words", "caption_lines", "emoji_count", "hashtag_count", "mention_count"]
    others = [c for c in made.columns if c not in (*doubles, *longs, "caption")]
    return made.select(*others, *[F.col(c).cast("long").alias(c) for c in longs], *rounded({c: F.col(c) for c in doubles}))
