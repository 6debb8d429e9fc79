"""Language of a text from its script, closed-class words and character profile; one expression inside the JVM.

Scripts decide where they can (Greek, Cyrillic, Arabic, Devanagari, Thai, Hangul, kana, Han). Texts in Latin letters are scored:
twice the number of a language's words among the text's words, each word once, and once for each hit of its character profile. The
language with the highest score is taken, English first among equals and where nothing scores.

Defined results: NULL gives NULL; text without any letter is English.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Articles, prepositions, conjunctions, pronouns and auxiliaries. Words that two of the languages share stay in both.
FUNCTION_WORDS = {
    "en": "the of and to in for with by from on at or is its it a an are was were be been not that this these those which as into than then their there they we you our how what when where why who can will would should has have had do does did but if so no all any each both between through during under over after before without within about against via",
    "de": "der die das den dem des ein eine einen einem einer eines und oder aber nicht kein keine für mit von vom aus im in am an auf zu zur zum über unter bei durch nach vor seit bis um ohne gegen zwischen wie was wer wo wenn dass weil als ist sind war waren wird werden wurde wurden hat haben kann sich auch es wir sie er ihr unser sein",
    "fr": "le la les l un une des du de d et ou où mais ne pas dans pour avec sans sous sur par entre vers chez en au aux à ce cet cette ces qui que qu dont comme est sont était être a ont été il elle ils elles nous vous on se sa son ses leur leurs plus très",
    "es": "el la los las lo un una unos unas de del al y e o u pero no en con sin por para sobre entre hacia desde hasta según que qué quien cual como cuando donde es son era fue ser está están ha han se su sus este esta estos estas ese esa más muy también nos",
}
#: Letters and endings that are frequent in one language and rare in the others; words stand between single spaces.
PROFILE = {
    "en": "th|wh|ck|sh|ee|oo|gh|ing |ness |ed ",
    "de": "ä|ö|ü|ß|sch|ung |ungen |keit |heit |lich|isch|pf|tz",
    "fr": "è|ê|ë|î|ï|ô|û|ç|œ|à|eux |eau|ités? |ées? ",
    "es": "ñ|á|í|ó|ú|¿|¡|ción|ciones |dad |mente |ado |ada |ll",
}
#: Scripts of one language, in the order in which they are looked for; Han counts as Japanese only beside kana.
SCRIPTS = {
    "el": r"[\p{IsGreek}]",
    "ru": r"[\p{IsCyrillic}]",
    "ar": r"[\p{IsArabic}]",
    "hi": r"[\p{IsDevanagari}]",
    "th": r"[\p{IsThai}]",
    "ko": r"[\p{IsHangul}]",
    "ja": r"[\p{IsHiragana}\p{IsKatakana}]",
    "zh": r"[\p{IsHan}]",
}
LATIN = r"[\p{IsLatin}]"


def _spaced(text: Column) -> Column:
    """Lower-cased letters and digits with the other characters as single spaces, and one at either end; signs that open Spanish questions stay, soft hyphens join."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.replace(F.lower(text), F.lit("\u00ad"), F.lit("")), r"[^\p{L}\p{M}\p{N}¿¡]+", " ")), F.lit(" "))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """An expression over a value that is used several times and worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _place_of_most(counts: Column) -> Column:
    """1-based place of the greatest number, the first among equals."""
    return F.array_position(counts, F.array_max(counts)).cast("int")


def _latin(text: Column) -> Column:
    known = {k: F.array(*[F.lit(w) for w in dict.fromkeys(ws.split())]) for k, ws in FUNCTION_WORDS.items()}

    def scores(spaced: Column) -> Column:
        return _let(F.array_distinct(F.split(F.trim(spaced), " ")), lambda words: F.array(*[2 * F.size(F.array_intersect(words, known[k])) + F.regexp_count(spaced, F.lit(PROFILE[k])) for k in FUNCTION_WORDS]))

    names = F.array(*[F.lit(k) for k in FUNCTION_WORDS])
    return F.element_at(names, _let(_let(_spaced(text), scores), _place_of_most))


def language(text: Column) -> Column:
    """ISO code of the language of a text."""
    # letters of each script, Latin first; those of Japanese and Chinese together. A Latin text often has single Greek letters.
    own = [k for k in SCRIPTS if k not in ("ja", "zh")]
    count = lambda p: F.regexp_count(text, F.lit(p))
    counts = F.array(count(LATIN), *[count(SCRIPTS[k]) for k in own], count(SCRIPTS["ja"]) + count(SCRIPTS["zh"]))
    found = F.element_at(F.array(*[F.lit(k) for k in ("", *own, "zh")]), _let(counts, _place_of_most))
    # plain ASCII, most titles, needs no count of scripts
    script = F.when(text.rlike(r"^[\x00-\x7f]*$"), "").otherwise(found)
    decide = lambda s: F.when(s == "", _latin(text)).when((s == "zh") & (count(SCRIPTS["ja"]) > 0), "ja").otherwise(s)
    return F.when(text.isNotNull(), _let(script, decide))
