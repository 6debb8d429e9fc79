"""Variant spellings of names typed by people.

Typing errors: surnames, given names, names of groups and unlisted journals are cut into k + 1 segments; the segments go into an
inverted index keyed by scope, length, place and text, and the substrings of every other name that a segment may have shifted
to are looked up in it. Candidates are verified by edit distance within a band. One error may be a transposition, which
touches two segments, so k is 2 and three segments are cut. Exact copies of a word are one word of the index.

The scope of surnames is the profile; that of surnames too short to tell an error from another name also has the given names,
which must be equal then; that of given names is the surname, its first letter and the profile. A surname one error away means
the same if the given names say so: all people of the rarer spelling must be people of the other. What is linked are the
connected components, however long the chain.

What people do on purpose (initials, order, titles, accents, capitals, abbreviated words, acronyms) is read from the parsed name:
spellings of one surname and first letter are put together where exactly one person fits. Nicknames are a table of common short
forms, and those that a profile itself explains, as in Guillermo "Memo" Gray.

Journals are matched word by word with a list of usual spellings, errors through the same segment index; unlisted ones by letters.

Defined results: NULL profiles, names and markers are no cases; repeated names count once; an initial that fits several people
of a profile is linked with none of them, only with its own other forms; a nickname explained in two ways is explained in none;
unlisted journals of fewer than five letters, which are acronyms, have no typing errors; an empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.operators.graph import connected
from citeloom.operators.split_values import GROUP, MISSING_MARKERS, split_values
from citeloom.session import checkpointed

SEGMENTS = 3
MIN_TYPO = 5  # shorter surnames need equal given names

# Common short forms of given names.
NICKNAMES = {
    "alexander": "alex sasha sascha xander", "alexandra": "alexa", "andrew": "andy drew", "anthony": "tony", "antonia": "toni tonia", "benjamin": "ben benny",
    "catherine": "cathy cate", "charles": "chuck charlie chaz", "christoph": "chris", "daniel": "dan danny", "david": "dave", "dmitri": "dima mitya", "edward": "ed eddie",
    "eduardo": "lalo edu", "ekaterina": "katya", "elisabeth": "lisa beth liz betty elsa", "elizabeth": "eliza lizzie", "francisco": "paco pancho fran", "gabriel": "gabe",
    "giuseppe": "beppe peppe", "gregory": "greg", "james": "jim jimmy", "jennifer": "jen jenny", "johannes": "hans jo hannes", "john": "jack johnny", "jonathan": "jon",
    "joseph": "joe", "katharina": "kathi kate käthe kathy", "kenneth": "ken", "lawrence": "larry", "margarete": "maggie greta gretchen grete", "margaret": "peggy meg",
    "matthew": "matt", "michael": "mike mick", "nicholas": "nick", "nikolaos": "nikos", "patricia": "pat tricia patty", "peter": "pete", "rebecca": "becky", "richard": "rick dick",
    "robert": "bob rob bobby robbie", "ronald": "ron", "samantha": "sam sammy", "stephen": "steve", "susanna": "sue susi sanna", "theodore": "ted theo teddy", "thomas": "tom tommy",
    "timothy": "tim", "vladimir": "vova volodya", "william": "bill will billy willy",
}
FORMAL = {n: f for f, ns in NICKNAMES.items() for n in ns.split()}
LETTERS = str.maketrans({"ø": "o", "ł": "l", "ß": "ss", "æ": "ae", "œ": "oe", "đ": "d", "ð": "d", "þ": "th", "ı": "i"})
TITLE = regex.compile(r"^(?:(?:dr|prof|professor|mr|mrs|ms|sir|dame|herr|frau|ing|dipl)\b\.?[\s-]*)+(?=\S)", regex.I)
DEGREE = regex.compile(r"[\s,]+(?:ph\.? ?d|jr|sr|ii|iii|iv|d\.?sc|m\.?sc|esq|frs|mba)\.?$|,\s*(?:m\.? ?d|prof|dr)\.?$", regex.I)
NICK = regex.compile(r"[\"“”„‘(][^\"“”„’)]{1,30}[\"“”’)]|(?<=\s)'[^']{1,30}'(?=\s)")
INITIAL = regex.compile(r"(?:\p{Lu}\p{M}*\.?[-‐‑]?){1,4}|\p{Ll}\.?")
IS_GROUP = regex.compile(GROUP.replace("(?i)", ""), regex.I)


def fold(s: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", s.lower()) if not unicodedata.combining(c)).translate(LETTERS)


def within_one(a: str, b: str) -> bool:
    """Edit distance with transpositions of at most 1, by the one diagonal band that can hold it."""
    if a == b:
        return True
    la, lb = len(a), len(b)
    if abs(la - lb) > 1:
        return False
    i = 0
    while i < min(la, lb) and a[i] == b[i]:
        i += 1
    if la == lb:
        return a[i + 1 :] == b[i + 1 :] or (i + 1 < la and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :])
    return a[i:] == b[i + 1 :] if la < lb else a[i + 1 :] == b[i:]


def parse_name(name: str) -> list[tuple[str, str]]:
    """(surname, given parts) in each order that the name allows; parts are parted by spaces: a word, -word after a hyphen, or .x for an initial."""
    if IS_GROUP.search(name):
        return [(regex.sub(r"[^\p{L}\p{N}]", "", fold(name)), "")]
    s = NICK.sub(" ", name) if " " in name.strip() else name
    s = TITLE.sub("", s.strip(" \t\n,;\"'“”"))
    while DEGREE.search(s):
        s = DEGREE.sub("", s)
    if "," in s:
        last, _, first = s.partition(",")
        return [_form([last], first.split())] if last.strip() and first.strip() else [_form([s.replace(",", " ")], [])]
    words = s.split()
    if len(words) < 2:
        return [_form(words, [])]
    small = [INITIAL.fullmatch(w) is not None and len(w.strip(".")) <= 4 and not (len(w) > 3 and w.isupper() and "." not in w) for w in words]
    if small[-1] and not small[0]:
        n = next(i for i, x in enumerate(small) if x)
        return [_form(words[:n], words[n:])]
    out = [_form(words[-1:], words[:-1])]
    if not small[0] and not small[-1]:
        surname, given = _form(words[:1], words[1:])
        out.append((surname, given.replace("-", "-=") if given[:1] == "." else "=" + given.replace(" ", " =").replace("=.", ".").replace("=-", "-=")))
    return out


def _form(last: list[str], given: list[str]) -> tuple[str, str]:
    surname = regex.sub(r"[^\p{L}\p{N}]", "", fold("".join(last)))
    parts = []
    for w in given:
        if INITIAL.fullmatch(w) and (len(w.rstrip(".")) <= 4 and (w.upper() == w or len(w.rstrip(".")) == 1)):
            parts += ["." + c for c in regex.sub(r"[^\p{L}]", "", fold(w))]
        else:
            for i, p in enumerate(regex.split(r"[-‐‑–]", fold(w))):
                p = regex.sub(r"[^\p{L}\p{N}]", "", p)
                if p:
                    p = FORMAL.get(p, p) if not i else p
                    parts.append(("-" if i else "") + p)
    return surname, " ".join(parts)


def _forms(given: str) -> list[list[str]]:
    """The parts with and without those after a hyphen."""
    parts = given.split()
    return [[p.lstrip("-") for p in parts], *([[p for p in parts if p[0] != "-"]] if any(p[0] == "-" for p in parts) else [])]


def nickname_in(name: str) -> str:
    """The nickname that a name explains itself, as in Guillermo "Memo" Gray; empty if none, or one of the table."""
    m = NICK.search(name) if " " in name.strip() else None
    words = regex.findall(r"\p{L}+", fold(m.group())) if m else []
    return words[0] if len(words) == 1 and len(words[0]) > 1 and words[0] not in FORMAL else ""


Near = set[tuple[str, str]]


def _fit(a: list[str], b: list[str], near: Near) -> bool:
    for x, y in zip(a, b):
        if x == y:
            continue
        if x[0] == "." or y[0] == ".":
            if x.lstrip(".=")[:1] != y.lstrip(".=")[:1]:
                return False
        elif x[0] == "=" and y[0] == "=":
            return False  # both read in the less usual order: no typing errors there
        elif x.lstrip("=") != y.lstrip("=") and (x.lstrip("="), y.lstrip("=")) not in near:
            return False
    return True


def compatible(a: str, b: str, near: Near) -> bool:
    """Whether two sets of given names may be one person's; near: words that are one error apart, both ways."""
    return any(_fit(x, y, near) for x in _forms(a) for y in _forms(b))


def opposed(a: str, b: str) -> bool:
    """Whether the letters after the first given name exclude each other."""
    return not any(all(p.lstrip(".=")[:1] == q.lstrip(".=")[:1] for p, q in zip(x[1:], y[1:])) for x in _forms(a) for y in _forms(b))


def people(forms: list[tuple[str, int]], near: Near) -> list[int]:
    """The number of the person that each set of given names means; all have one surname and first letter.

    Full names come first, often used ones before others, and found the sets. A name joins the one set that has a compatible
    member and no opposed one; where several do, its own forms are a set. Sets are looked up by the first given name, so only
    bare initials are held against all, until a second one fits.
    """
    order = sorted(range(len(forms)), key=lambda i: (-sum(p[0] != "." for p in forms[i][0].split()), -len(forms[i][0].split()), -forms[i][1], forms[i][0]))
    beside: dict[str, list[str]] = defaultdict(list)
    for x, y in near:
        beside[x].append(y)
    sets: list[list[str]] = []
    by_first: dict[str, set[int]] = defaultdict(set)
    out = [0] * len(forms)
    for i in order:
        g = forms[i][0]
        first = g.split()[0].lstrip("=-") if g else ""
        if first[:1] in ("", "."):
            places: Iterable[int] = range(len(sets))
        else:
            places = sorted(set().union(*(by_first[w] for w in (first, *beside[first], "."))))
        fits = []
        for n in places:
            if any(compatible(g, o, near) for o in sets[n]) and not any(opposed(g, o) for o in sets[n]):
                fits.append(n)
                if len(fits) > 1:
                    break
        if len(fits) == 1:
            n = fits[0]
            sets[n].append(g)
        else:
            n = len(sets)
            sets.append([g])
        by_first["." if first[:1] in ("", ".") else first].add(n)
        out[i] = n
    return out


def segment_join(words: DataFrame, scope: list[str], word: str = "word") -> DataFrame:
    """(scope, a, b): pairs of different words of one scope that are one typing error apart, each once, a < b.

    The middle one of the three segments is a single letter: it keeps the outer two apart, so that a transposition, like any
    other error, leaves one of these as it is, and they are as long as can be. A word has two entries in the index; it looks up
    two for its own length and two for words that are one letter shorter: their first segment at its place, their last one
    shifted by the letter that is too many.
    """
    t = words.select(*scope, F.col(word).alias("_w")).where(F.length("_w") > 0).distinct()
    # a scope of one word has no pairs; counted before the words are cut
    several = t.groupBy(*scope).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    t = t.join(several, scope, "left_semi").withColumn("_len", F.length("_w"))
    head = lambda n: F.floor((n - 1) / 2).cast("int")
    first = lambda n: F.xxhash64(*scope, n, F.lit(0), F.substring(F.col("_w"), F.lit(1), head(n)))
    last = lambda n, shift=0: F.xxhash64(*scope, n, F.lit(2), F.substring(F.col("_w"), head(n) + 2 + shift, n))
    own, less = F.col("_len"), F.col("_len") - 1
    index = t.select(*scope, F.col("_w").alias("b"), F.explode(F.array(first(own), last(own))).alias("_k"))
    probe = t.select(*[F.col(c).alias(f"_{c}") for c in scope], F.col("_w").alias("a"), F.explode(F.array(first(own), last(own), first(less), last(less, 1))).alias("_k"))
    near = probe.join(index, "_k").where((F.length("a") > F.length("b")) | (F.col("a") < F.col("b")))
    for c in scope:  # hashes may collide
        near = near.where(F.col(c) == F.col(f"_{c}"))
    d = F.levenshtein("a", "b", 2)
    swap = lambda i: F.concat(F.substr(F.col("a"), F.lit(1), i - 1), F.substr(F.col("a"), i + 1, F.lit(1)), F.substr(F.col("a"), i, F.lit(1)), F.substr(F.col("a"), i + 2))
    swapped = (F.length("a") == F.length("b")) & F.exists(F.sequence(F.lit(1), F.length("a") - 1), lambda i: swap(i) == F.col("b"))
    near = near.where((d == 1) | ((d == 2) & swapped))
    return near.select(*scope, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _roots(pairs: DataFrame) -> DataFrame:
    """(kind, p, token, canon): each word of a pair (kind, p, a, b) with the least word of its component; words and kinds have no line break."""
    key = lambda c: F.concat_ws("\n", "kind", "p", c)
    roots = connected(pairs.select(key("a").alias("a"), key("b").alias("b")))
    last = lambda c: F.regexp_extract(c, r"([^\n]*)$", 1)
    return roots.select(F.regexp_extract("node", r"^([^\n]*)\n", 1).alias("kind"), F.regexp_extract("node", r"(?s)^[^\n]*\n(.*)\n[^\n]*$", 1).alias("p"), last("node").alias("token"), last("root").alias("canon"))


# Words of journal names that are often left out.
STOP = frozenset("of and the for on in fo ofr adn und der et la de".split())


def journal_words(name: str) -> list[str]:
    """The words of a journal's name in their order, without notes on the edition and a leading article; what stands behind a comma
    goes to the front where it ends in a preposition."""
    s = regex.sub(r"\((?:online|print|electronic|web)[^)]*\)|\[(?:online|print)\]", " ", fold(name))
    if "," in s:
        head, _, tail = s.rpartition(",")
        if regex.fullmatch(r"\s*(?:the\s+)?[\p{L}.]+(?:\s+[\p{L}.]+){0,2}\s+(?:of|on|in|for)?\s*", tail) or regex.fullmatch(r"\s*[\p{L}. ]+\b(?:of|on|in|for)\s*", tail):
            s = f"{tail} {head}"
    s = regex.sub(r"^\s*the\s+", "", s)
    return regex.findall(r"[\p{L}\p{N}]+", s)


def _letter(given):
    return F.regexp_extract(given, r"\p{L}", 0)


def surname_links(forms: DataFrame) -> DataFrame:
    """(p, a, b): surnames of a profile that are one error apart and, by the given names, mean the same."""
    short = F.length("token") < MIN_TYPO
    # long ones within the profile; short ones, and those across the border of length, only beside equal given names
    alone = forms.where(~short).select("p", F.lit("").alias("g"), "token")
    beside = forms.where((F.length("token") <= MIN_TYPO) & F.col("given").rlike(r"(?:^| )=?\p{L}{2}")).select("p", F.col("given").alias("g"), "token")
    pairs = checkpointed(segment_join(alone.unionByName(beside), ["p", "g"], "token"))
    sure = pairs.where((F.col("g") != "") & (F.least(F.length("a"), F.length("b")) < MIN_TYPO)).select("p", "a", "b")
    # all people of one spelling must be people of the other
    pairs = pairs.where("g = ''").select("p", F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e")).select("p", "e.*")
    first = F.regexp_replace(F.element_at(F.split("given", " "), 1), "^=", "")
    people_of = forms.select("p", "token", _letter("given").alias("i"), F.when(~first.startswith(".") & (first != ""), first).alias("f")).groupBy("p", "token", "i").agg(F.collect_set("f").alias("fs"), F.max(F.col("f").isNull()).alias("initial"))
    mine, theirs = people_of.select("p", F.col("token").alias("x"), "i", "fs", "initial"), people_of.select("p", F.col("token").alias("y"), "i", F.col("fs").alias("gs"))
    seen = pairs.join(mine, ["p", "x"]).join(theirs, ["p", "y", "i"], "left")
    near = lambda x, f: (x == f) | ((F.levenshtein(x, f, 2).between(0, 2)) & (F.length(f) > 3) & (F.length(x) > 2))
    fits = F.when(F.col("gs").isNull(), False).when(F.size("gs") == 0, True).otherwise(F.forall("fs", lambda f: F.exists("gs", lambda x: near(x, f))))
    agreed = seen.groupBy("p", "x", "y").agg(F.min(fits).alias("ok")).where("ok").select("p", F.col("x").alias("a"), F.col("y").alias("b"))
    return agreed.unionByName(sure)


def person_forms(rows: DataFrame, profile: str, authors: str) -> DataFrame:
    """(p, name, n, token, given): the names on each profile in every order in which they can be read."""
    items = split_values(rows.where(F.col(profile).isNotNull()), authors, [profile], "name", "_no").select(F.col(profile).alias("p"), "name")
    names = items.groupBy("p", "name").agg(F.count("*").alias("n"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(p, n, c, s, g, nickname_in(n)) for p, n, c in zip(b["p"], b["name"], b["n"]) for s, g in parse_name(n) if s]
            yield pd.DataFrame(out, columns=["p", "name", "n", "token", "given", "nick"])

    forms = checkpointed(names.mapInPandas(parse, "p string, name string, n long, token string, given string, nick string"))
    # nicknames that a name explains stand for the given name wherever the profile has them with that surname
    head = F.element_at(F.split("given", " "), 1)
    told = forms.where("nick <> ''").select("p", "token", F.col("nick").alias("head"), head.alias("f")).where(F.col("f").rlike(r"^\p{L}{2}"))
    told = told.groupBy("p", "token", "head").agg(F.min("f").alias("f"), F.max("f").alias("g")).where("f = g and f <> head").drop("g")
    forms = forms.drop("nick")
    if told.isEmpty():
        return forms
    both = forms.withColumn("head", head).join(told, ["p", "token", "head"], "left")
    given = F.when(F.col("f").isNotNull(), F.concat("f", F.substr("given", F.length("head") + 1))).otherwise(F.col("given"))
    return checkpointed(both.select("p", "name", "n", "token", given.alias("given")))


def person_classes(forms: DataFrame, canon: DataFrame) -> DataFrame:
    """(p, field, c, name): the spellings of the people on each profile, c being the person; canon: surnames (p, token, canon)."""
    keyed = forms.join(canon, ["p", "token"], "left").select("p", F.coalesce("canon", "token").alias("s"), _letter("given").alias("i"), "name", "given", "n")
    keyed = checkpointed(keyed)
    # names have different forms of which a person has few; only these and the pairs of words one error apart go through Python
    scope = ["p", "s", "i"]
    distinct = keyed.groupBy(*scope, "given").agg(F.sum("n").alias("n"))
    words = distinct.select(*scope, F.explode(F.split(F.regexp_replace("given", "(^| )[-=]+", "$1"), " ")).alias("word")).where(~F.col("word").startswith(".") & (F.length("word") >= 3))
    near = segment_join(words, scope).where((F.length("a") >= 4) | (F.length("b") >= 4))
    rows_of = distinct.select(*scope, F.lit(1).alias("kind"), F.col("given").alias("x"), F.lit("").alias("y"), "n").unionByName(near.select(*scope, F.lit(0).alias("kind"), F.col("a").alias("x"), F.col("b").alias("y"), F.lit(0).cast("long").alias("n")))

    def group(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key: tuple | None = None
        held: list[tuple[str, int]] = []
        pairs: Near = set()

        def close() -> list:
            return [(*key, g, k) for (g, _), k in zip(held, people(held, pairs))] if key else []

        for b in batches:
            out = []
            for p, s, i, kind, x, y, n in zip(b["p"], b["s"], b["i"], b["kind"], b["x"], b["y"], b["n"]):
                if key != (p, s, i):
                    out += close()
                    key, held, pairs = (p, s, i), [], set()
                if kind:
                    held.append((x, n))
                else:
                    pairs |= {(x, y), (y, x)}
            if out:
                yield pd.DataFrame(out, columns=["p", "s", "i", "given", "person"])
        if out := close():
            yield pd.DataFrame(out, columns=["p", "s", "i", "given", "person"])

    sets = rows_of.repartition(*scope).sortWithinPartitions(*scope, "kind").mapInPandas(group, "p string, s string, i string, given string, person int")
    members = keyed.join(sets, [*scope, "given"])
    return members.select("p", F.lit("authors").alias("field"), F.concat_ws("\n", "s", "i", "person").alias("c"), "name").distinct()


def _parsed(names: DataFrame, key: str) -> DataFrame:
    """(key, name, tokens, text, letters): words without stop words, all words in one, and all letters in one."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            words = [journal_words(n) for n in b["name"]]
            yield b.assign(tokens=[[w for w in ws if w not in STOP] for ws in words], text=["".join(ws) for ws in words], letters=[regex.sub(r"[^\p{L}\p{N}]", "", fold(n)) for n in b["name"]])

    return names.select(F.col(key).cast("string").alias("key"), "name").mapInPandas(parse, "key string, name string, tokens array<string>, text string, letters string")


def listed_journals(names: DataFrame, usual: DataFrame) -> DataFrame:
    """(name, keys, letters): the journals of a list that each spelling may mean; none, one, or several for an acronym.

    names: (name), distinct. usual: (key, name). Word by word a spelling must have as many words as the journal, each being that
    word, a shortened form of it, or one error away by the segment index; the journal with fewest changes is meant. Otherwise an
    acronym, or all words in one with at most one error. Neither table has to be small.
    """
    spelled = checkpointed(_parsed(names.withColumn("_k", F.lit("")), "_k").drop("key"))
    known = checkpointed(_parsed(usual.where("name is not null").select(F.col(usual.columns[0]).alias("_k"), "name"), "_k").where(F.size("tokens") > 0))
    tok = spelled.select("name", F.size("tokens").alias("n"), F.posexplode("tokens").alias("i", "t"))
    word = known.select("key", F.size("tokens").alias("n"), F.posexplode("tokens").alias("i", "w"))
    ts, ws = tok.select("t").distinct(), word.select("w").distinct()
    short = ws.select("w", F.explode(F.sequence(F.lit(1), F.length("w") - 1)).alias("m")).where("m >= 1 and m < length(w)").select(F.expr("left(w, m)").alias("t"), "w").join(ts, "t")
    squeezed = known.groupBy("text").agg(F.max("key").alias("key"))
    whole = spelled.where((F.size("tokens") > 0) & (F.length(F.try_element_at("tokens", F.lit(-1))) > 1)).select("name", "text")
    looked = [(0, ts.where(F.length("t") >= MIN_TYPO - 1)), (0, ws.where(F.length("w") >= MIN_TYPO)), (1, whole.select("text").where(F.length("text") >= MIN_TYPO)), (1, squeezed.select("text").where(F.length("text") >= MIN_TYPO))]
    errors = checkpointed(segment_join(reduce(DataFrame.union, [d.select(F.lit(k).alias("whole"), F.col(d.columns[0]).alias("word")) for k, d in looked]), ["whole"]))
    errors = errors.select("whole", F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e")).select("whole", "e.*")
    near = errors.where("whole = 0").select(F.col("x").alias("t"), F.col("y").alias("w")).where(F.length("w") >= MIN_TYPO).join(ts, "t").join(ws, "w")
    match = ts.select("t", F.col("t").alias("w"), F.lit(0).alias("cost")).join(ws, "w").select("t", "w", "cost")
    match = match.union(short.select("t", "w", F.lit(1))).union(near.select("t", "w", F.lit(1))).groupBy("t", "w").agg(F.min("cost").alias("cost"))
    fits = tok.join(match, "t").join(word, ["w", "i", "n"]).groupBy("name", "key", "n", "i").agg(F.min("cost").alias("cost"))
    fits = fits.groupBy("name", "key", "n").agg(F.count("*").alias("k"), F.sum("cost").alias("cost")).where("k = n")
    least = fits.groupBy("name").agg(F.min("cost").alias("cost"))
    by_words = checkpointed(fits.join(least, ["name", "cost"]).groupBy("name").agg(F.array_sort(F.collect_set("key")).alias("by_words")))
    first = F.array_join(F.transform("tokens", lambda w: F.left(w, F.lit(1))), "")
    acronyms = known.groupBy(first.alias("t")).agg(F.array_sort(F.collect_set("key")).alias("by_letters"))
    one = spelled.where(F.size("tokens") == 1).select("name", F.col("tokens")[0].alias("t")).where(F.length("t").between(2, 6)).join(acronyms, "t").select("name", "by_letters")
    equal = whole.join(squeezed, "text").select("name", F.array("key").alias("by_text"))
    texts = errors.where("whole = 1").select(F.col("x").alias("text"), F.col("y").alias("as")).join(squeezed.withColumnRenamed("text", "as"), "as")
    almost = whole.join(texts, "text").groupBy("name").agg(F.array_sort(F.collect_set("key")).alias("by_error")).where(F.size("by_error") == 1)
    out = spelled.select("name", "letters")
    for t in (by_words, one, equal, almost):
        out = out.join(t, "name", "left")
    found = F.when(F.size("by_words") == 1, F.col("by_words")).otherwise(F.coalesce("by_letters", "by_text", "by_error", "by_words", F.array().cast("array<string>")))
    return out.select("name", found.alias("keys"), "letters")


def journal_names(rows: DataFrame, profile: str, journal: str, usual: DataFrame) -> DataFrame:
    """(p, name, keys, letters): the spellings of journals on each profile with the listed journals that they may mean; usual: (key, name)."""
    trimmed = F.regexp_replace(F.col(journal), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    names = rows.where(F.col(profile).isNotNull() & F.col(journal).isNotNull() & ~F.col(journal).isin(*MISSING_MARKERS)).select(F.col(profile).alias("p"), trimmed.alias("name")).where("name <> ''").distinct()
    names = checkpointed(names)
    return checkpointed(names.join(listed_journals(names.select("name").distinct(), usual), "name"))


def journal_classes(found: DataFrame, canon: DataFrame) -> DataFrame:
    """(p, field, c, name): the spellings of the journals on each profile, c being the journal; canon: letters (p, token, canon)."""
    sure = found.where(F.size("keys") == 1).select("p", "name", F.concat(F.lit("#"), F.col("keys")[0]).alias("c"))
    # an acronym of several journals means the one that is on the profile
    seen = sure.select("p", "c").distinct()
    maybe = found.where(F.size("keys") > 1).select("p", "name", F.explode("keys").alias("k")).select("p", "name", F.concat(F.lit("#"), "k").alias("c")).join(seen, ["p", "c"])
    maybe = maybe.groupBy("p", "name").agg(F.min("c").alias("c"), F.count("*").alias("m")).where("m = 1").select("p", "name", "c")
    other = _unlisted(found).join(canon, ["p", "token"], "left").select("p", "name", F.coalesce("canon", "token").alias("c"))
    return sure.unionByName(maybe).unionByName(other).select("p", F.lit("journal").alias("field"), "c", "name")


def _unlisted(found: DataFrame) -> DataFrame:
    return found.where(F.size("keys") == 0).where("letters <> ''").select("p", "name", F.col("letters").alias("token"))


def name_members(rows: DataFrame, usual_journals: DataFrame, profile: str, authors: str, journal: str) -> DataFrame:
    """(p, field, c, name): the members of all classes."""
    forms, found = person_forms(rows, profile, authors), journal_names(rows, profile, journal, usual_journals)
    letters = segment_join(_unlisted(found).where(F.length("token") >= MIN_TYPO), ["p"], "token")
    links = surname_links(forms).withColumn("kind", F.lit("authors")).unionByName(letters.withColumn("kind", F.lit("journal")))
    canon = checkpointed(_roots(links))
    of = lambda kind: canon.where(F.col("kind") == kind).drop("kind")
    return person_classes(forms, of("authors")).unionByName(journal_classes(found, of("journal")))


def name_variants(rows: DataFrame, usual_journals: DataFrame, profile: str = "scrap_auth_id", authors: str = "authors", journal: str = "journal") -> DataFrame:
    """(profile, field, name_a, name_b): every pair of spellings on a profile that mean the same person or journal."""
    m = checkpointed(name_members(rows, usual_journals, profile, authors, journal))
    key = ["p", "field", "c"]
    pairs = m.withColumnRenamed("name", "name_a").join(m.withColumnRenamed("name", "name_b"), key).where("name_a < name_b")
    # names that can be read in two orders may meet in two classes
    return pairs.select(F.col("p").alias(profile), "field", "name_a", "name_b").distinct()


def name_classes(rows: DataFrame, usual_journals: DataFrame, profile: str = "scrap_auth_id", authors: str = "authors", journal: str = "journal") -> DataFrame:
    """(profile, field, class, name, n_names): classes of at least two spellings, named by the least of them, with their members.

    A name that can be read in two orders may be a member of two classes; classes of the same names are one.
    """
    m = checkpointed(name_members(rows, usual_journals, profile, authors, journal))
    per = m.groupBy("p", "field", "c").agg(F.min("name").alias("class"), F.count("*").alias("n_names")).where("n_names > 1")
    return m.join(per, ["p", "field", "c"]).select(F.col("p").alias(profile), "field", "class", "name", "n_names").distinct()
