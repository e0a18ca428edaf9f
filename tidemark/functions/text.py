"""Caption features as column expressions. Keyword containment and Java regular expressions only; no Python on the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns and word lists, in Spanish and English, as captions use them.
EMOJI = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{2702}-\x{27B0}\x{24C2}-\x{1F251}]+"
QUESTION = r"(?iu)\?|¿|cuál|qué|cómo|por qué|quién|dónde|cuándo"
STRONG_CTA = ["comenta", "guarda", "dm", "visita", "taggea", "etiqueta", "escríbeme", "guárdalo"]
TRIGGERS = {
    "question": ["?", "cuál", "qué", "cómo", "por qué", "quién", "dónde", "cuándo"],
    "urgency": ["ahora", "hoy", "último", "limitado", "exclusivo", "ya", "rápido"],
    "social_proof": ["clientes", "testimonios", "opiniones", "reviews", "valoraciones"],
    "value": ["gratis", "regalo", "descuento", "oferta", "promoción", "ahorra"],
    "curiosity": ["secreto", "descubre", "sorpresa", "increíble", "no creerás"],
    "action": ["comenta", "guarda", "comparte", "sígueme", "dm", "escríbeme", "haz click"],
    "emotion": ["amor", "feliz", "alegría", "pasión", "sueño", "gracias"],
    "transformation": ["antes", "después", "transformación", "cambio", "resultado"],
}
NICHES = {
    "inmobiliaria": ["casa", "piso", "tour", "triana", "inmueble", "venta", "alquiler", "habitación", "propiedad", "reforma", "m²", "metros"],
    "floristeria": ["flores", "arreglo", "ramo", "bouquet", "rosas", "tulipanes", "floristería", "planta", "decoración floral", "centro de mesa"],
    "cafeteria": ["café", "coffee", "latte", "cappuccino", "barista", "espresso", "desayuno", "brunch", "pastelería", "dulce"],
    "peluqueria": ["corte", "pelo", "cabello", "tinte", "mechas", "peinado", "estilista", "look", "color", "tratamiento capilar"],
    "restaurante": ["plato", "menú", "cocina", "chef", "reserva", "cena", "comida", "gastronomía", "receta", "sabor"],
    "gimnasio": ["entreno", "fitness", "ejercicio", "músculo", "cardio", "peso", "rutina", "gym", "entrenador", "clase"],
    "clinica": ["salud", "doctor", "tratamiento", "consulta", "cita", "paciente", "bienestar", "medicina", "especialista"],
}
HOOKS = {
    "pov": r"pov[:\s]|punto de vista",
    "question": r"^[¿?]|^\w+\s*\?",
    "number": r"^\d+\s+\w+|top\s*\d+|\d+\s*(cosas|tips|errores|razones)",
    "bold_claim": r"nunca|siempre|todo|nadie|el mejor|el peor|imposible",
    "story": r"historia|storytime|cuando|un día|me pasó",
    "how_to": r"cómo\s+\w+|aprende\s+a|tutorial|paso\s+a\s+paso",
    "reveal": r"secreto|te cuento|descubre|te revelo|no sabías",
}
CTAS = {
    "comment": r"comenta|cuéntame|opina|dime|escribe",
    "save": r"guarda|guardar|guárdalo|save",
    "share": r"comparte|compartir|etiqueta|tag",
    "follow": r"sígueme|sigue|follow|seguir",
    "dm": r"dm|mensaje|escríbeme|mensaje directo",
    "link": r"link|enlace|bio|click|pincha",
}
OPENING_HOOKS = [
    r"(?:^|\s)(?:por qu[eé]|c[oó]mo|qu[eé]|cu[aá]l|d[oó]nde|cu[aá]ndo|qui[eé]n)",
    r"(?:^|\s)(?:why|how|what|which|where|when|who)\b",
    r"(?:pov|cuando|imagina|esto es|mira lo que)",
    r"(?:story time|wait for it|you won't believe)",
    r"(?:secreto|truco|hack|tip|dato|descubr[íi])",
    r"(?:secret|trick|hack|tip|discover)",
    r"(?:antes.+despu[eé]s|transforma|cambi[oó]|de.+a\s)",
    r"(?:urgente|ahora mismo|ya|no te pierdas|[úu]ltimo)",
    r"(?:urgent|right now|don't miss|last chance)",
    r"(?:\d+\s*(?:tips?|trucos?|formas?|razones?|secretos?))",
    r"(?:\d+\s*(?:ways?|tips?|tricks?|reasons?|secrets?))",
]
OPENING_EMOJI = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}]+"


def text(column: str = "caption") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def words(t: Column) -> Column:
    return F.filter(F.split(F.lower(t), r"\s+"), lambda w: w != "")


def any_of(t: Column, keywords: list[str]) -> Column:
    made = F.lit(False)
    for k in keywords:
        made = made | F.contains(t, F.lit(k.lower()))
    return made


def how_many(t: Column, keywords: list[str]) -> Column:
    return sum((F.contains(t, F.lit(k)).cast("int") for k in keywords), F.lit(0))


def lengths(t: Column) -> dict[str, Column]:
    """TXT-01."""
    w = words(t)
    n = F.size(w)
    letters = F.aggregate(w, F.lit(0), lambda s, x: s + F.length(x))
    return {
        "caption_length": F.length(t),
        "caption_words": n,
        "caption_lines": F.regexp_count(t, F.lit("\n")) + 1,
        "avg_word_length": F.when(n > 0, letters / n).otherwise(0.0),
        "lexical_richness": F.when(n > 0, F.size(F.array_distinct(w)) / n).otherwise(0.0),
    }


def appeals(t: Column) -> dict[str, Column]:
    """TXT-02."""
    return {"has_question": t.rlike(QUESTION).cast("int"), "has_strong_cta": any_of(F.lower(t), STRONG_CTA).cast("int")}


def emoji(t: Column) -> dict[str, Column]:
    """TXT-03: runs of emoji and their density for 100 characters."""
    n = F.regexp_count(t, F.lit(EMOJI))
    return {"emoji_count": n, "emoji_density": n / F.greatest(F.length(t), F.lit(1)) * 100}


def tags(t: Column, kind: str = "#", lower: bool = False) -> Column:
    """CLN-15: tags or mentions in a text, in order; word characters of any script."""
    found = F.regexp_extract_all(F.lower(t) if lower else t, F.lit(rf"(?U){kind}\w+"), 0)
    return found


def tag_counts(t: Column) -> dict[str, Column]:
    """TXT-04."""
    n = F.size(tags(t))
    return {"hashtag_count": n, "hashtag_density": n / F.greatest(F.size(words(t)), F.lit(1)), "mention_count": F.size(tags(t, "@"))}


def niche_flags(t: Column) -> dict[str, Column]:
    """TXT-05."""
    return {f"niche_{k}": any_of(F.lower(t), v).cast("int") for k, v in NICHES.items()}


def trigger_counts(t: Column) -> dict[str, Column]:
    """TXT-06: distinct trigger words present."""
    return {f"trigger_{k}": how_many(F.lower(t), v) for k, v in TRIGGERS.items()}


def first_line(t: Column) -> Column:
    return F.lower(F.substring_index(t, "\n", 1))


def hook_flags(t: Column) -> dict[str, Column]:
    """TXT-07: hooks of the first line, and a third for each, at most 1."""
    flags = {f"hook_{k}": first_line(t).rlike("(?iU)" + p).cast("int") for k, p in HOOKS.items()}
    n = sum(flags.values(), F.lit(0))
    return flags | {"hook_regex_score": F.least(n / 3.0, F.lit(1.0))}


def stepped_hook_score(t: Column) -> dict[str, Column]:
    """TXT-08: 0.1, 0.5, 0.7 or 0.9 by the number of hooks, with their names; 0 without text."""
    names = F.array_compact(F.array(*[F.when(first_line(t).rlike("(?iU)" + p), F.lit(k)) for k, p in HOOKS.items()]))
    n = F.size(names)
    score = F.when(t == "", 0.0).when(n >= 3, 0.9).when(n == 2, 0.7).when(n == 1, 0.5).otherwise(0.1)
    return {"hook_score": score, "hook_names": F.when(t == "", F.array().cast("array<string>")).otherwise(names)}


def cta_flags(t: Column) -> dict[str, Column]:
    """TXT-09."""
    flags = {f"cta_{k}": F.lower(t).rlike("(?i)" + p).cast("int") for k, p in CTAS.items()}
    return flags | {"cta_count": sum(flags.values(), F.lit(0))}


def bilingual(t: Column) -> dict[str, Column]:
    """TXT-10: counts by character, occurrences of trigger words at most 5."""
    found = {f"trigger_{k}": F.least(sum((F.regexp_count(F.lower(t), F.lit(_quoted(w))) for w in v), F.lit(0)), F.lit(5)) for k, v in TRIGGERS.items()}
    return {"hashtag_count": F.regexp_count(t, F.lit("#")), "mention_count": F.regexp_count(t, F.lit("@"))} | found


def _quoted(word: str) -> str:
    return word.replace("?", r"\?")


def opening_hook(caption: Column, overlay: Column, speech: Column) -> dict[str, Column]:
    """TXT-12: the first sentence with overlay and speech: 0.2 for each pattern up to 0.6, bonuses, and less beyond 15 words."""
    sentence = F.substring_index(F.substring_index(caption, "\n", 1), ".", 1)
    whole = F.trim(F.concat_ws(" ", sentence, F.nullif(overlay, F.lit("")), F.nullif(speech, F.lit(""))))
    n = sum((whole.rlike("(?iu)" + p).cast("int") for p in OPENING_HOOKS), F.lit(0))
    bonus = F.when(F.contains(whole, F.lit("?")), 0.1).otherwise(0.0) + F.when(whole.rlike(OPENING_EMOJI), 0.05).otherwise(0.0) + F.when(F.contains(whole, F.lit("...")), 0.05).otherwise(0.0)
    long = F.when(F.size(words(whole)) > 15, -0.1).otherwise(0.0)
    score = F.least(F.greatest(F.least(n * 0.2, F.lit(0.6)) + bonus + long, F.lit(0.0)), F.lit(1.0))
    return {"hook_text": F.substring(whole, 1, 200), "hook_score": F.when(whole == "", 0.0).otherwise(F.round(score, 4)), "patterns_matched": F.when(whole == "", 0).otherwise(n)}


def curiosity_bonus(t: Column, emoji_: list[str]) -> Column:
    """TXT-13."""
    has = lambda *xs: any_of(t, list(xs))
    return F.when(has("?", "¿"), 0.05).otherwise(0.0) + F.when(any_of(t, emoji_), 0.03).otherwise(0.0) + F.when(has("...", "…"), 0.02).otherwise(0.0)


def combined_hook(semantic: Column, regex: Column) -> Column:
    """TXT-16."""
    return F.round(semantic * 0.85 + regex * 0.15, 4)


def interactions(hook: Column, sentiment: Column, is_reel: Column, ctas: Column, optimal: Column, strong: Column, caption_length: Column, transcript: Column, overlay: Column) -> dict[str, Column]:
    """TXT-18: products across modes, and how rich each text is."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    hook, sentiment, is_reel, ctas, optimal, strong = (zero(c) for c in (hook, sentiment, is_reel, ctas, optimal, strong))
    size = lambda c: F.length(F.coalesce(c, F.lit("")))
    capped = lambda n, most: F.least(n / most, F.lit(1.0))
    return {
        "hook_x_sentiment": hook * sentiment,
        "hook_x_is_reel": hook * is_reel,
        "hook_x_cta_count": hook * ctas,
        "sentiment_x_cta_count": sentiment * ctas,
        "is_reel_x_video_optimal": is_reel * optimal,
        "transcript_richness": capped(size(transcript), 500),
        "ocr_richness": capped(size(overlay), 100),
        "multimodal_text_density": capped(zero(caption_length) + size(transcript) + size(overlay), 1000),
        "semantic_hook_x_vader": hook * F.abs(sentiment),
        "semantic_hook_x_cta_strong": hook * strong,
    }


def aligned(rows: DataFrame, wanted: list[str], keep: list[str]) -> DataFrame:
    """TXT-20: the wanted columns in order as doubles, absent ones and NULLs as 0."""
    return rows.select(*keep, *[(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in rows.columns else F.lit(0.0)).alias(c) for c in wanted])


def semantic_score(rows: DataFrame, prefix: str = "semantic_") -> DataFrame:
    """TXT-21: the mean of the columns named by ``prefix`` and a number."""
    found = sorted((c for c in rows.columns if c.startswith(prefix) and c[len(prefix) :].isdigit()), key=lambda c: int(c[len(prefix) :]))
    mean = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in found), F.lit(0.0)) / len(found) if found else F.lit(0.0)
    return rows.withColumn("semantic_score", mean)


def improvement(has_cta: Column, question: Column, emoji_count: Column, length: Column, shortest: int = 50, longest: int = 500) -> Column:
    """TXT-22: points for what a caption lacks, at most 50."""
    lack = lambda c, n: F.when(c, n).otherwise(0)
    return F.least(lack(has_cta == 0, 20) + lack(question == 0, 15) + lack(emoji_count == 0, 10) + lack((length < shortest) | (length > longest), 10), F.lit(50))


def missing_triggers(t: Column, wanted: tuple[str, ...] = ("question", "urgency", "value", "curiosity", "action")) -> Column:
    """TXT-23 and SET-04: high-value triggers that a text lacks, three at most."""
    present = F.array_compact(F.array(*[F.when(how_many(F.lower(t), TRIGGERS[k]) > 0, F.lit(k)) for k in TRIGGERS]))
    return F.slice(F.array_except(F.array(*[F.lit(w) for w in wanted]), present), 1, 3)


def tagged_text(parts: dict[str, Column]) -> Column:
    """TXT-24: the parts that aren't blank, each after its source."""
    return F.concat_ws(" ", *[F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.concat(F.lit(f"[{k}] "), F.trim(c))) for k, c in parts.items()])


def expanded(vector: str, n: int, prefix: str) -> list[Column]:
    """TXT-25: a vector's components as columns, 0 where absent."""
    return [F.coalesce(F.try_element_at(F.col(vector), F.lit(i + 1)).cast("double"), F.lit(0.0)).alias(f"{prefix}{i}") for i in range(n)]


# What is suggested, in this order.
SUGGESTED_FORMAT = "Considera cambiar a formato {} para este contenido"
SUGGESTED_CTA = "Añade un CTA claro (ej: '¿Cuál prefieres? Comenta 👇' o 'Guarda para después')"
SUGGESTED_HOOK = "Usa un hook más potente: pregunta, POV, o número en los primeros 3 segundos"
SUGGESTED_EMOJI = "Añade 3-5 emojis relevantes para mejorar el visual scanning"


def suggestions(current: Column, recommended: Column, confidence: Column, ctas: Column, hooked: Column, emoji_count: Column, triggers: Column) -> Column:
    """TXT-26: at most five texts: another format if that is sure enough, a call to action, a hook, emoji, and two triggers.

    ``hooked`` says whether the caption opens with a question, a point of view or a number; ``triggers`` are (type, example)
    of high impact, of which the first two count.
    """
    before, after = SUGGESTED_FORMAT.split("{}")
    rules = [
        F.when((current != recommended) & (confidence > 70), F.concat(F.lit(before), recommended, F.lit(after))),
        F.when(ctas == 0, F.lit(SUGGESTED_CTA)),
        F.when(~hooked, F.lit(SUGGESTED_HOOK)),
        F.when(emoji_count < 3, F.lit(SUGGESTED_EMOJI)),
    ]
    more = F.transform(F.slice(triggers, 1, 2), lambda t: F.concat(F.lit("Incluye elementos de "), t["type"], F.lit(": "), F.coalesce(t["example"], F.lit(""))))
    return F.slice(F.concat(F.array_compact(F.array(*rules)), more), 1, 5)


def hook_training(rows: DataFrame, caption: Column, semantic: str = "semantic_hook_score", sentiment: str = "sentiment_compound", strong: str = "has_strong_cta") -> DataFrame:
    """TXT-17: the pattern score of a caption's hooks and the two interactions of its semantic score; absent columns count as 0."""
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in rows.columns else F.lit(0.0)
    return rows.withColumns(
        {
            "hook_regex_score": hook_flags(caption)["hook_regex_score"],
            "interaction_semantic_hook_x_vader": value(semantic) * F.abs(value(sentiment)),
            "interaction_semantic_hook_x_cta_strong": value(semantic) * value(strong),
        }
    )


def hook_bands(rows: DataFrame, score: str = "semantic_hook_score") -> DataFrame:
    """TXT-17: how many scores are high, medium and low, and their mean, in one row."""
    s = F.coalesce(F.col(score), F.lit(0.0))
    return rows.agg(F.count_if(s >= 0.7).alias("high"), F.count_if((s >= 0.5) & (s < 0.7)).alias("medium"), F.count_if(s < 0.5).alias("low"), F.avg(s).alias("mean_score"))


# Media that count as video, in scoring; training leaves out the last.
VIDEO_KINDS = ["reel", "video", "tiktok", "tiktok_video"]


def gated_fusion(rows: DataFrame, made: dict[str, Column], training: bool = False) -> DataFrame:
    """TXT-19, and TXT-27 with ``training``: the fused columns ``made`` where the table holds any video, else zeros.

    A row is video by media_type, or by is_reel where that column is absent. Training also needs a column of transcripts or of
    text overlays. The gate is one aggregated row, so no more than a flag reaches the driver or is broadcast.
    """
    kinds = VIDEO_KINDS[:-1] if training else VIDEO_KINDS
    if "media_type" in rows.columns:
        video = F.lower("media_type").isin(kinds)
    else:
        video = F.col("is_reel") > 0 if "is_reel" in rows.columns else F.lit(False)
    if training and not {"whisper_transcript", "easyocr_text"} & set(rows.columns):
        return rows.withColumns({k: F.lit(0.0) for k in made})
    gate = rows.agg(F.coalesce(F.max(video), F.lit(False)).alias("_any_video"))
    return rows.crossJoin(F.broadcast(gate)).withColumns({k: F.when(F.col("_any_video"), c).otherwise(0.0) for k, c in made.items()}).drop("_any_video")


#: Words that turn what follows, and words that strengthen or weaken it, by how much. Parameters of ``lexicon_sentiment``.
NEGATIONS = ["no", "not", "never", "nunca", "nada", "sin", "without", "tampoco", "isn't", "don't", "can't"]
BOOSTERS = {"muy": 0.293, "very": 0.293, "super": 0.293, "really": 0.293, "tan": 0.293, "totalmente": 0.293, "extremely": 0.293, "algo": -0.293, "poco": -0.293, "somewhat": -0.293, "apenas": -0.293}
#: Valences of common Spanish and English words, -4 to 4; any table (word, valence) can take its place.
VALENCES = {
    4.0: "perfecto perfecta perfect magnífico amazing",
    3.0: "increíble excelente maravilloso maravillosa love amor excellent wonderful fantástico",
    2.0: "bueno buena feliz genial good great happy mejor best bonito bonita hermoso fácil gracias win",
    1.0: "descuento gratis free nice útil nuevo nueva fresco interesante smart ahorra",
    -1.0: "secreto caro cara difícil hard slow lento raro problema problem miedo",
    -2.0: "malo mala triste bad sad peor worst feo error fail dolor aburrido",
    -3.0: "horrible terrible odio hate fatal awful desastre asco",
}


def valences() -> list[tuple[str, float]]:
    return [(word, v) for v, group in VALENCES.items() for word in group.split()]


def lexicon_sentiment(rows: DataFrame, lexicon: DataFrame, ident: str, column: str, window: int = 3, turned: float = -0.74) -> DataFrame:
    """TXT-11: shares of positive, negative and neutral words and a compound score, by a join of words to a lexicon (word, valence).

    A word's valence is moved by a booster among the ``window`` words before it, less the farther off it stands, and then
    multiplied by ``turned`` for each negation among them; exclamation marks, four at most, add to the sum. Words are looked up
    without the signs around them. A hit weighs one more than its valence, a neutral word one. The lexicon, of one row for a
    word, may be of any size; texts without words or hits are neutral; repeated idents are one text.
    """
    plain = F.transform(words(text(column)), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    tokens = F.filter(plain, lambda w: w != "")
    listed = rows.select(ident, tokens.alias("_w"), F.least(F.regexp_count(text(column), F.lit("!")), F.lit(4)).alias("_marks"))
    before = [F.get("_w", F.col("_i") - k).alias(f"_b{k}") for k in range(1, window + 1)]
    exploded = listed.select(ident, "_w", "_marks", F.posexplode("_w").alias("_i", "word")).select(ident, "_marks", "word", *before)
    hits = exploded.join(lexicon, "word", "left")
    v, sign = F.coalesce("valence", F.lit(0.0)), F.signum(F.coalesce("valence", F.lit(0.0)))
    boost = F.create_map(*[F.lit(x) for pair in BOOSTERS.items() for x in pair])
    moved = v
    for k in range(1, window + 1):
        moved = moved + sign * F.coalesce(F.try_element_at(boost, F.col(f"_b{k}")), F.lit(0.0)) * (1 - 0.05 * (k - 1))
    for k in range(1, window + 1):
        moved = moved * F.when(F.col(f"_b{k}").isin(NEGATIONS), turned).otherwise(1.0)
    hits = hits.withColumn("_v", moved)
    x = F.col("_v")
    made = hits.groupBy(ident).agg(
        F.sum(F.when(x > 0, x + 1).otherwise(0.0)).alias("_p"), F.sum(F.when(x < 0, 1 - x).otherwise(0.0)).alias("_q"), F.count_if(x == 0).alias("_z"), F.sum(x).alias("_s"), F.max("_marks").alias("_marks")
    )
    s = F.col("_s") + F.signum("_s") * F.col("_marks") * 0.292
    whole = F.col("_p") + F.col("_q") + F.col("_z")
    share = lambda c: F.coalesce(c / whole, F.lit(0.0))
    return rows.select(ident).distinct().join(made, ident, "left").select(
        ident, share(F.col("_p")).alias("pos"), share(F.col("_q")).alias("neg"), (1 - share(F.col("_p")) - share(F.col("_q"))).alias("neu"), F.coalesce(s / F.sqrt(s * s + 15), F.lit(0.0)).alias("compound"),
    )


def features(rows: DataFrame, column: str = "caption", at: str | None = None, fmt: str | None = None) -> DataFrame:
    """ML-16: the feature table of a batch, every caption feature, and those of time and format, in one projection."""
    from tidemark.functions import cleaning as K

    t = text(column)
    made = lengths(t) | appeals(t) | emoji(t) | tag_counts(t) | niche_flags(t) | trigger_counts(t) | hook_flags(t) | cta_flags(t)
    if at:
        made |= K.hour_and_day(F.col(at))
    if fmt:
        made |= K.format_flags(F.col(fmt)) | {"post_type_encoded": K.encoded(F.col(fmt))}
    return rows.withColumns(made)
