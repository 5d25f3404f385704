"""Language choice from common function words, as in-row column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace import constants as C
from millrace.functions import text as T

# --- Fixed values: frequent function words by language ------------------------------
PROFILES = {
    "de": ["das", "dem", "den", "der", "die", "ein", "eine", "ich", "ist", "mit", "nicht", "sich", "und", "von", "zu"],
    "en": ["a", "and", "as", "for", "in", "is", "it", "of", "on", "that", "the", "this", "to", "was", "with"],
    "es": ["con", "de", "del", "el", "en", "es", "la", "las", "los", "no", "para", "por", "que", "una", "y"],
    "fr": ["au", "aux", "dans", "des", "du", "est", "et", "il", "je", "la", "le", "les", "pas", "que", "un"],
    "it": ["che", "con", "di", "e", "gli", "il", "in", "la", "le", "lo", "non", "per", "sono", "un", "una"],
    "nl": ["dat", "de", "een", "en", "het", "ik", "in", "is", "met", "niet", "op", "te", "van", "voor", "zijn"],
    "pt": ["as", "com", "da", "de", "do", "e", "em", "não", "o", "os", "para", "por", "que", "se", "uma"],
}


def _hits(words: Column, vocabulary: list[str]) -> Column:
    return T.count_where(words, lambda w: w.isin(vocabulary))


def detect(sample: Column, profiles: dict[str, list[str]] | None = None) -> Column:
    """The language with the most function words in the sample; null when none occurs.

    Ties go to the alphabetically first code. The profile table is small and fixed, so
    scoring stays inside the row: no join and no shuffle.
    """
    profiles = PROFILES if profiles is None else profiles
    def best(words: Column) -> Column:
        scored = F.array(
            *[F.struct(_hits(words, profiles[code]).alias("score"), F.lit(code).alias("code")) for code in sorted(profiles)]
        )
        start = F.struct(F.lit(0).alias("score"), F.lit(None).cast("string").alias("code"))
        return F.aggregate(scored, start, lambda top, x: F.when(x["score"] > top["score"], x).otherwise(top))["code"]

    return T.let(F.split(F.lower(sample), f"[^{C.WORD_CHAR}]+"), best)


def choose_language(
    sample: Column, allowed: list[str], detected: Column | None = None, min_chars: int = 0
) -> Column:
    """The rule around the detector: one allowed language wins outright, a detected
    language must be allowed, anything else falls back to the first allowed one."""
    if len(allowed) == 1:
        return F.lit(allowed[0])
    fallback = F.lit(allowed[0] if allowed else C.UNKNOWN_LANG)
    if not allowed:
        return fallback
    cleaned = T.strip(F.replace(sample, F.lit("\n"), F.lit(" ")))
    found = detect(cleaned) if detected is None else detected
    usable = F.length(F.coalesce(sample, F.lit(""))) > max(min_chars - 1, 0)
    return F.when(usable & found.isin(allowed), found).otherwise(fallback)
