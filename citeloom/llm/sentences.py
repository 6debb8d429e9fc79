"""Sentence boundaries across languages and scripts.

Ordered break and no-break rules, pairs of regular expressions for the text before and after a position, are organised as
cascading tables: the table of the language, then those of its script, then the general one. At each candidate position the
first rule that matches decides; the pattern before it is matched backwards from there, so no rule has a window. Quotations and
brackets are balanced beforehand within their paragraph, however long they are; positions inside them are no candidates.

The declared language only chooses between the languages of a script: the script is read from the text at the position, so a
wrong or missing language, or several in one text, do no harm.

Line breaks: a blank line always ends a unit; a single one is space if the text is hard-wrapped there (the next word would not
have fitted into the width of the text's own lines), otherwise it ends a unit, so that headings and list entries stand alone.

Defined results: NULL, empty and blank texts have no row; each non-blank character lies in exactly one unit; texts of any
length are taken whole; repeated documents give repeated rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.session import spread

OPEN = {"(": ")", "[": "]", "（": "）", "「": "」", "『": "』", "“": "”", "«": "»", "„": "“”", "‹": "›", "【": "】", "《": "》"}
CLOSE = set("".join(OPEN.values())) | set("\"'’")
MARKS = regex.compile(r"[()\[\]（）「」『』“”«»„‹›【】《》\"]")
#: A full stop within a word or number ends nothing in any table; a semicolon ends a question in Greek only.
TERMINATOR = regex.compile(r"\.+(?![\p{Ll}\p{N}.])|…+|[!?！？؟]+|[｡．。।॥]")
WITH_GREEK = regex.compile(TERMINATOR.pattern + "|;")

# Abbreviations that need a following word or number; fixed values.
TITLES = {
    "en": "Dr Prof Mr Mrs Ms St Messrs Gen Sen Rev Hon vs cf approx ca e.g i.e viz resp Figs Eqs Refs",
    "de": "Dr Prof Hr Fr vgl bzw ca sog insb ggf evtl inkl z.B d.h u.a z.T i.d.R o.g zzgl bspw",
    "fr": "M MM Mme Mlle Dr Pr cf env c.-à-d p.ex St Ste",
    "es": "Sr Sra Srta Dr Dra Prof Profa Ud Uds cf aprox p.ej",
    "ru": "г-н г-жа проф акад др им ср напр т.е т.к",
    "el": "κ κα Δρ Καθ δηλ βλ πρβλ π.χ λ.χ",
}
NUMBERED = {
    "en": "No Nos Fig Figs Tab Eq Eqs Sec Ch Vol Ref Refs App Art pp p Table",
    "de": "Nr Abb Tab S Bd Kap Gl Abschn Art Aufl Anm",
    "fr": "fig tab p pp vol chap no éq art",
    "es": "fig figs tab pág págs vol cap núm n.º ec art",
    "ru": "рис табл с стр гл т п разд № вып",
    "el": "εικ σελ πίν κεφ αρ τόμ",
}
MONTHS = "Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember"


def _any(words: str) -> str:
    return "|".join(regex.escape(w).replace(r"\.", r"\.[\s\p{Z}]?") for w in sorted(words.split(), key=len, reverse=True))


def _rules(*pairs: tuple[bool, str, str]) -> list:
    return [(b, regex.compile(rf"(?r)(?:{x})").match if x else None, regex.compile(y).match if y else None) for b, x, y in pairs]


S = r"[\s\p{Z}]"
WORD = r"(?<![\p{L}\p{N}])"
GO_ON = rf"{S}*[\p{{L}}\p{{N}}(\"“„«]"


def _alphabetic(lang: str, *more: tuple[bool, str, str]) -> list:
    return _rules(
        *more,
        (False, rf"{WORD}(?i:{_any(TITLES[lang])})\.", GO_ON),
        (False, rf"{WORD}(?i:{_any(NUMBERED[lang])})\.", rf"{S}*[\p{{N}}(]|{S}*[A-ZА-Я]\d"),
        (False, rf"{WORD}(?i:{_any(NUMBERED[lang])})\.", rf"{S}+(?:[IVXLC]+|[A-Z])\b"),
    )


# (True: break, False: no break; text before; text after). The first match decides.
LANGUAGE = {
    "en": _alphabetic("en"),
    "de": _alphabetic("de", (False, r"(?<!\p{N})\p{N}{1,2}\.", rf"{S}+(?:{'|'.join(MONTHS.split())}|Jahrhundert|Quartal|Auflage)\b")),
    "fr": _alphabetic("fr"),
    "es": _alphabetic("es"),
    "ru": _alphabetic("ru"),
    "el": _alphabetic("el"),
    "zh": _rules((False, r"[。！？!?…]+[”’」』\"]+", r"(?:\p{Han}{0,6}?)(?:说|說|问|問|道|写|寫|指出|认为|認為|表示|称|稱|回答|记录|記錄)(?:道|着|著)?[。，！？,.]")),
    "ja": _rules((False, r"[。！？!?…]*[」』”\"]+", r"(?:と|って|という|との|など|は|が|を|に|の|も|で)")),
    "ko": _rules((False, r"[.。！？!?…]+[”’」』\"]+", rf"{S}?(?:이?라고|이?라는|고|라며|하고|며|는|은|을|를|이|가|와|과)(?={S}|\p{{P}}|\Z)"), (False, r"[.。！？!?…]+[”’」』\"]+", r"\p{Hangul}")),
    "ar": _rules((False, rf"{WORD}\p{{Arabic}}\.", GO_ON)),
    "hi": _rules((False, r"[\p{Devanagari}\p{M}]{1,4}\.", GO_ON)),
    "th": _rules((False, r"[\p{Thai}]\.", GO_ON)),
}
#: Rules for all languages of a script; those with case, then those without.
CASED_HEAD = (
    (True, r"[。｡！？][”’」』）)]*", ""),
    (False, "", rf"{S}*[,:)\]»”]|{S}*;(?!\S)|{S}*[–—]|{S}+-{S}"),
    (False, rf"(?:^|\n){S}*[(\[]?(?:\p{{N}}{{1,3}}|\p{{L}})[.)]", rf"{S}"),
)
CASED = _rules(
    *CASED_HEAD,
    # initials, unless the letter is a unit after a number
    (False, rf"(?<![\p{{L}}\p{{N}}])(?<!\p{{N}}{S})(?:\p{{Lu}}\.-?)+", rf"{S}*(?:\p{{Lu}}|\p{{N}})"),
    (False, rf"(?<![\p{{L}}\p{{N}}])(?<!\p{{N}}{S})\p{{Ll}}\.", rf"{S}*(?:\p{{L}}\.|\p{{N}})"),
    # words that are written small even where a sentence begins
    (True, r"[.!?…][\"'”’»)\]]*", rf"{S}+(?:\p{{Ll}}\p{{Lu}}|\p{{Ll}}-\p{{Ll}}{{2}}|\p{{Ll}}\d*[-‑–]\p{{L}}{{2,}})"),
    (False, "", rf"{S}*[\"'“„«(\[]*{S}?\p{{Ll}}"),
    (True, "", rf"{S}|\Z"),
    (True, r"(?:\p{Ll}{2}|[\p{N}\p{Ll})%°])[.!?…]+[\"'”’»)\]]*", r"(?:[\"“„«(¿¡]*\p{Lu}(?:[\p{Ll}\p{Z}\s’']|\p{Lu}{2})|[“„«¿¡]|\p{Lo})"),
    (True, r"[!?]+[\"'”’»)\]]*", r"[“„«¿¡\"]?[\p{Lu}\p{Lo}]"),
    (True, r"[.!?…][”’»\"]+", r"\p{Lu}"),
    (False, "", ""),
)
#: Instead of CASED where a text has no capitals at all.
SMALL = _rules(
    *CASED_HEAD,
    (False, rf"{WORD}(?:et al|usw|etc|bzw|p\.m|a\.m|co|inc|ltd|ca|vs|др|г|т\. ?[едпк])\.", GO_ON),
    (False, r"(?:\.{2,}|…+)", rf"{S}*\p{{Ll}}"),
    (False, r"[.!?…]+[\"”’»]+", rf"{S}+(?:asked|wrote|said|noted|replied|schrieb|sagte|écrit|dit|escribió|dijo|пишет|γράφει)\b"),
    (False, r"(?<![\p{L}\p{N}])(?<!\p{N}\s)\p{Ll}\.", rf"{S}*\p{{Ll}}"),
    (True, "", rf"{S}|\Z"),
    (False, "", ""),
)
UNCASED = _rules(
    (False, "", rf"{S}*[,،，、:：)\]）»]|{S}*[–—]"),
    (False, rf"(?:^|\n){S}*[(\[]?\p{{N}}{{1,3}}[.)]", rf"{S}"),
    (False, r"(?:\.{2,}|…+)", rf"{S}*\p{{L}}"),
    (True, r"[。｡！？।॥؟!?][”’」』）)»\"]*", ""),
    (True, "", rf"{S}|\Z"),
    (True, r"\p{L}[.．][”’」』）)»\"]*", r"[\p{Lo}\p{Lu}“「『«]"),
    (False, "", ""),
)
CASCADE = {"Latin": ("en", "de", "fr", "es"), "Cyrillic": ("ru",), "Greek": ("el",), "Han": ("zh", "ja"), "Kana": ("ja",), "Hangul": ("ko",), "Arabic": ("ar",), "Devanagari": ("hi",), "Thai": ("th",)}
HAS_CASE = {"Latin", "Cyrillic", "Greek"}
#: First and last code points of the letters of each script.
RANGES = (
    (0x0041, 0x024F, "Latin"), (0x1E00, 0x1EFF, "Latin"), (0x0370, 0x03FF, "Greek"), (0x1F00, 0x1FFF, "Greek"), (0x0400, 0x052F, "Cyrillic"), (0x0600, 0x06FF, "Arabic"), (0x0750, 0x077F, "Arabic"),
    (0x0900, 0x097F, "Devanagari"), (0x0E00, 0x0E7F, "Thai"), (0x1100, 0x11FF, "Hangul"), (0xAC00, 0xD7AF, "Hangul"), (0x3040, 0x30FF, "Kana"), (0x3400, 0x4DBF, "Han"), (0x4E00, 0x9FFF, "Han"), (0xF900, 0xFAFF, "Han"),
)
SCRIPTS = (None, *CASCADE)
SCRIPT_OF = np.zeros(0x10000, np.uint8)
for _lo, _hi, _s in RANGES:
    SCRIPT_OF[_lo : _hi + 1] = [SCRIPTS.index(_s) if c > 0x02FF or chr(c).isalpha() else 0 for c in range(_lo, _hi + 1)]
ABBREVIATIONS = frozenset(w.lower() for t in (TITLES, NUMBERED) for ws in t.values() for w in ws.split())
PLAIN_NEXT = regex.compile(rf"{S}+[\"“„«(¿¡]*\p{{Lu}}").match
PLAIN_WORD = regex.compile(r"(?r)([^\W\d_]{4,})[.!?…\"'”’»)\]]+").match
THAI = regex.compile(r"\p{Thai}")
BULLET = regex.compile(rf"{S}*(?:[-–—*•‣◦▪·●○■]{S}|[(\[]?(?:\p{{N}}{{1,3}}|[a-zA-Z])\){S}|\p{{N}}{{1,3}}、)")
NUMBER_BULLET = regex.compile(rf"{S}*\p{{N}}{{1,3}}\.{S}")
ENDED = regex.compile(rf"[.!?…。｡！？؟।॥;][\"'”’»)\]）」』“]*{S}*\Z")
LINE = regex.compile(r"\r\n|[\n\r\x0b\x0c\x85  ]")
BREAK_RUN = regex.compile(r"[^\S\n\r\x0b\x0c\x85  ]*(?:\r\n|[\n\r\x0b\x0c\x85  ])[\s]*")
THAI_SPACE = regex.compile(r"(?<=[\p{Thai}”\"»)%])[\s\p{Z}]+(?=[\p{Thai}“\"«(])")
FIRST_WORD = regex.compile(r"\S+").match
GOES_ON = regex.compile(r"[\"'“„«(]*\p{Ll}|[!?;:»]").match
CLOSED_UP = frozenset("()[]{}<>“”„«»‹›‘’'\"-–—/=")


def _scripts(text: str, places: list[int]) -> list[str]:
    """Script of the last letter before each place, or of the first one after it; letters of no known script don't count."""
    if text.isascii():
        return ["Latin"] * len(places)
    codes = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 0xFFFF)
    kind = SCRIPT_OF[codes]
    at = np.flatnonzero(kind)
    if not len(at):
        return ["Latin"] * len(places)
    return [SCRIPTS[k] for k in kind[at[np.maximum(np.searchsorted(at, places) - 1, 0)]]]


def _spans(text: str) -> tuple[list[tuple[int, int]], set[int]]:
    """Balanced quotations and brackets within paragraphs; the positions of their closing marks.

    A straight quote closes an open one unless white space stands before it; it opens one unless white space stands after it. One
    that opens again takes the place of an open one that nothing has closed.
    """
    marks = list(MARKS.finditer(text))
    if not marks:
        return [], set()
    spans: list[tuple[int, int]] = []
    stack: list[tuple[str, int]] = []
    waiting: dict[str, list[int]] = {}  # for each closing mark the places in the stack that it would close
    para, last = text.find("\n\n"), len(text)

    def drop(k: int) -> None:
        """Forget what is open from place k of the stack on."""
        while len(stack) > k:
            c, _ = stack.pop()
            for x in OPEN.get(c, c):
                waiting[x].pop()

    def push(c: str, i: int) -> None:
        for x in OPEN.get(c, c):
            waiting.setdefault(x, []).append(len(stack))
        stack.append((c, i))

    for m in marks:
        i, c = m.start(), m.group()
        if 0 <= para < i:
            drop(0)
            at = text.rfind("\n\n", para, i)
            para = text.find("\n\n", max(at, para) + 1)
            while 0 <= para < i:
                para = text.find("\n\n", para + 1)
        opens = c in OPEN
        if c == '"':
            opens = i + 1 < last and not text[i + 1].isspace()
            closes = i > 0 and not text[i - 1].isspace()
            if not closes and waiting.get(c):
                drop(waiting[c][-1])
            if not closes and not opens:
                continue
        if waiting.get(c) and (c != '"' or closes):
            k = waiting[c][-1]
            spans.append((stack[k][1], i))
            drop(k)
        elif opens and not (c == '"' and closes and text[i - 1] not in CLOSED_UP and text[i - 1].isalnum()):
            push(c, i)
    return spans, {b for _, b in spans}


@lru_cache(maxsize=4096)
def _table(script: str, lang: str | None, small: bool) -> list:
    """The rules for a script in the order in which they are asked."""
    tables = CASCADE[script]
    if lang in tables:
        tables = (lang, *[t for t in tables if t != lang])
    return [r for table in (*[LANGUAGE[t] for t in tables], (SMALL if small else CASED) if script in HAS_CASE else UNCASED) for r in table]


def _decide(text: str, at: int, script: str, lang: str | None, small: bool) -> bool:
    # what no rule of any table but the last ones can match: a whole word that is no abbreviation, and a capital next
    if script in HAS_CASE:
        if PLAIN_NEXT(text, at) and (m := PLAIN_WORD(text, 0, at)):
            i = m.start()
            if (not i or text[i - 1].isspace() or text[i - 1] in "\"'“‘«„([") and m[1].lower() not in ABBREVIATIONS:
                return True
    elif text[at - 1] in "。！？" and text[at] not in " \t\n\xa0,،，、:：)]）»–—":
        return True
    for is_break, x, y in _table(script, lang, small):
        if (y is None or y(text, at)) and (x is None or x(text, 0, at)):
            return is_break
    return False


def _newlines(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, hard) of each run of line breaks.

    The text is wrapped if its lines break within sentences: where a small letter follows a line without an end, or the next
    word would not have fitted into a line without an end that is not itself the widest, or if at least half of the lines near
    the greatest width have no end. Paragraphs on lines of their own end in marks, whatever their length.
    """
    runs = list(BREAK_RUN.finditer(text))
    if not runs:
        return []
    edges = [0, *[x for m in runs for x in m.span()], len(text)]
    lines = [(edges[i], edges[i + 1]) for i in range(0, len(edges), 2)]
    width = max(b - a for a, b in lines)
    dense = [x in ("Han", "Kana") for x in _scripts(text, [b for _, b in lines])]
    out: list[tuple[int, int, bool] | None] = []
    single = []  # place, length of the line, whether it has an end, is full, goes on
    for n, m in enumerate(runs):
        (a, b), (c, d) = lines[n], lines[n + 1]
        if c >= d or a >= b or len(LINE.findall(m.group())) > 1 or BULLET.match(text, c, d):
            out.append((*m.span(), True))
            continue
        word = 1 if dense[n] else 1 + FIRST_WORD(text, c, d).end() - c
        ended = ENDED.search(text, max(a, b - 8), b) is not None and text[a:b].split()[-1].rstrip(".").lower() not in ABBREVIATIONS
        single.append((n, b - a, ended, b - a + word > width, GOES_ON(text, c, d) is not None and not ended))
        out.append(None)
    near = [ended for _, size, ended, full, _ in single if full or size >= 0.6 * width]
    wrapped = any(not ended and (goes_on or (full and size < width)) for _, size, ended, full, goes_on in single) or 2 * near.count(False) >= len(near) > 0
    for n, size, ended, full, goes_on in single:
        (a, b), (c, d) = lines[n], lines[n + 1]
        full = full and wrapped
        if NUMBER_BULLET.match(text, c, d) and not full:
            hard = True
        else:
            long = wrapped and not ended and size >= 0.6 * width and len(text[a:b].split()) >= 5
            hard = not (full or long or (goes_on and BULLET.match(text, a, b) is None))
        out[n] = (*runs[n].span(), hard)
    return out


def boundaries(text: str | None, lang: str | None = None) -> list[tuple[int, int]]:
    """The (start, end) of each sentence of a text."""
    if not text or text.isspace():
        return []
    lang = (lang or "").lower() or None
    spans, closing = _spans(text)
    inside = bytearray(len(text) + 1)
    for a, b in spans:
        inside[a + 1 : b + 1] = b"\x01" * (b - a)
    low = text.lower()
    small = text == low and text.upper() != low
    n = len(text)
    cuts = {a for a, _, hard in _newlines(text) if hard}
    places: list[tuple[int, int]] = []  # end of the marks with what closes behind them, and of the first mark
    for m in (TERMINATOR if text.isascii() or ";" not in text else WITH_GREEK).finditer(text):
        e = m.end()
        while e < n and text[e] in CLOSE and (e in closing or text[e] in ")]）”’»」』"):
            e += 1
        if e + 1 < n and text[e + 1] == "»" and text[e] in "\u00a0\u202f\u2009 " and e + 1 in closing:
            e += 2
        if e < n and not inside[e]:
            places.append((e, m.start()))
    if places:
        for (e, i), script in zip(places, _scripts(text, [i + 1 for _, i in places])):
            if (text[i] != ";" or script == "Greek") and _decide(text, e, script, lang, small):
                cuts.add(e)
    if not text.isascii() and THAI.search(text):
        for m in THAI_SPACE.finditer(text):
            a, b = m.span()
            if inside[a] or text[a - 1] == "ๆ" and not regex.match(r"\p{Thai}", text[b]):
                continue
            if text[b] == "ๆ" or text[a - 1] == "ๆ" or regex.search(r"(?:(?<!ก)ว่า|คือ|และ|หรือ|ที่|ของ)$", text[max(0, a - 6) : a]):
                continue
            cuts.add(a)
    out, at = [], 0
    for c in [*sorted(cuts), n]:
        piece = text[at:c]
        s = piece.strip()
        if s:
            start = at + len(piece) - len(piece.lstrip())
            out.append((start, start + len(s)))
        at = c
    return out


def split_sentences(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str | None = "lang") -> DataFrame:
    """(key, start_char, end_char) of every sentence; narrow, only the named columns are read."""
    src = df.select(F.col(key).alias("_k"), F.col(text).alias("_t"), (F.col(lang) if lang else F.lit(None).cast("string")).alias("_l"))
    src = src.where(F.col("_t").isNotNull() & (F.length("_t") > 0))
    schema = T.StructType([T.StructField("_k", src.schema["_k"].dataType), T.StructField("start_char", T.IntegerType()), T.StructField("end_char", T.IntegerType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys, starts, ends = [], [], []
            for k, t, lg in zip(b["_k"], b["_t"], b["_l"]):
                for s, e in boundaries(t, lg):
                    keys.append(k)
                    starts.append(s)
                    ends.append(e)
            yield pd.DataFrame({"_k": pd.Series(keys, dtype=b["_k"].dtype), "start_char": pd.Series(starts, dtype="int32"), "end_char": pd.Series(ends, dtype="int32")})

    return spread(src).mapInPandas(run, schema).withColumnRenamed("_k", key)
