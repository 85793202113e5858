"""Text scalars as column expressions: cleaning, words, sentences, markers, repetition. No Python UDF but longest_repeat.

Functions of arrays (repeat_rate, local_repeat, leading_agreement) refer to them within lambdas: give them columns that
an earlier projection holds, not expressions, which would be computed for each element.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

# Word lists, marker patterns and front-matter patterns that results depend on.
BEHAVIOUR_STOPWORDS = """
a an the and or but if then than that this these those of in on at to for from by with
without into onto over under again is are was were be been being am do does did doing
have has had having i you he she it we they them him her his hers its their our your my
me us not no so as such very more most other some any each which who whom what when where
why how all both few many much only own same too can will just should now there here
""".split()
IMPROV_STOPWORDS = """
a an the and or but if then than so as of to in on at by for with from into onto over
is was were be been being am are it its it's this that these those there here he she
they them his her their him us we you your i me my not no nor do did does done have
has had will would can could should may might must very just
""".split()
MARKERS = [
    ("once_upon_a_time", r"once upon a time"),
    ("little_X_named", r"\b(?:little|small|young|tiny)\s+(?:girl|boy|dog|cat|bird|mouse|rabbit|bear|fish|duck|frog)\s+named\b"),
    ("moral_of_the_story", r"the moral of the story"),
    ("happily_ever_after", r"happily ever after"),
    ("from_that_day_on", r"from that day on"),
    ("learned_a_lesson", r"learned (?:a|an important) lesson|learned that it(?:'s| is) important"),
    ("the_end_terminal", r"the end\."),
    ("one_day_comma", r"\bone day,"),
    ("so_very_happy", r"(?:was|were) (?:so|very) happy"),
    ("named_proper", r"\bnamed\s+[A-Z][a-z]+"),
    ("his_her_mom", r"\b(?:his|her) (?:mom|mommy)\b"),
]
CASE_SENSITIVE_MARKERS = {"named_proper"}
FRAME_MARKERS = ["once_upon_a_time", "little_X_named", "moral_of_the_story", "happily_ever_after", "from_that_day_on", "learned_a_lesson", "the_end_terminal"]
START_MARKERS = [r"(?m)(?i)(?d)^\*\*\*\s*START OF TH(?:E|IS) PROJECT GUTENBERG EBOOK.*$", r"(?m)(?i)(?d)^\*\*\*\s*START OF TH(?:E|IS) PROJECT GUTENBERG ETEXT.*$"]
END_MARKERS = [r"(?m)(?i)(?d)^\*\*\*\s*END OF TH(?:E|IS) PROJECT GUTENBERG EBOOK.*$", r"(?m)(?i)(?d)^\*\*\*\s*END OF TH(?:E|IS) PROJECT GUTENBERG ETEXT.*$"]
PACKAGING = "|".join([
    r"(?:this\s+)?e-?(?:book|text)\s+was\s+produced\s+by\b",
    r"(?-i:Produced\s+by\s+[A-Z])",
    r"there\s+are\s+several\s+editions\s+of\s+this\s+ebook\b",
    r"various\s+characteristics\s+of\s+each\s+ebook\b",
    r"transcriber'?s?\s+note\b",
    r"updated\s+editions\s+will\s+replace\b",
    r"this\s+file\s+was\s+produced\s+from\b",
    r"transcribed\s+from\s+the\b",
    r".*?[\w.+-]+@[\w.-]+\.\w+",
])
PACKAGING_LINE = rf"(?i)^\s*(?:{PACKAGING})"
FRONT_LINES = 40
SEPARATOR = "</s>"
#: White space of Unicode, which Java's \s leaves out.
SPACES = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _strip_newlines(c: Column) -> Column:
    return F.btrim(c, F.lit("\n"))


def normalise(c: Column) -> Column:
    """CRLF and CR to LF, no blanks at line ends, at most one empty line in a row, no newlines at the ends."""
    c = F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    c = F.regexp_replace(F.regexp_replace(c, r"(?md)[ \t]+$", ""), r"\n{3,}", "\n\n")
    return _strip_newlines(c)


def _first_marker(c: Column, patterns: list[str]) -> tuple[Column, Column]:
    """Position (from 1; 0 for none) and length of the first pattern's match, or else of the next pattern's."""
    at, text = F.lit(0), F.lit("")
    for p in reversed(patterns):
        here = F.regexp_instr(c, F.lit(p))
        at, text = F.when(here > 0, here).otherwise(at), F.when(here > 0, F.regexp_substr(c, F.lit(p))).otherwise(text)
    return at, F.length(text)


def strip_boilerplate(c: Column) -> Column:
    """struct(text, status): what stands between start and end marker; the end is sought in what follows the start."""
    start, n = _first_marker(c, START_MARKERS)
    rest = F.when(start > 0, F.substring(c, start + n, F.length(c))).otherwise(c)
    end, _ = _first_marker(rest, END_MARKERS)
    kept = F.when(end > 0, F.substring(rest, F.lit(1), end - 1)).otherwise(rest)
    status = F.when((start > 0) & (end > 0), "both").when(start > 0, "start-only").when(end > 0, "end-only").otherwise("none")
    return F.struct(_strip_newlines(kept).alias("text"), status.alias("status"))


def strip_front_matter(c: Column) -> Column:
    """struct(text, removed): leading packaging and blank lines gone, if there is a packaging line among them."""
    lines = F.split(c, "\n")
    head = F.transform(F.slice(lines, 1, FRONT_LINES), lambda x: F.when(F.trim(F.regexp_replace(x, SPACES, " ")) == "", 0).when(x.rlike(PACKAGING_LINE), 1).otherwise(2))
    stop = F.array_position(head, F.lit(2))
    lead = F.when(stop > 0, F.slice(head, 1, (stop - 1).cast("int"))).otherwise(head)
    removed = F.size(F.filter(lead, lambda x: x == 1))
    rest = F.array_join(F.slice(lines, F.size(lead) + 1, F.greatest(F.size(lines), F.lit(1))), "\n")
    return F.struct(F.when(removed > 0, F.ltrim(rest, F.lit("\n"))).otherwise(c).alias("text"), removed.cast("long").alias("removed"))


def blank(c: Column) -> Column:
    """Whether a text is null or nothing but white space."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), SPACES, "") == ""


def split_words(c: Column) -> Column:
    """Words at Unicode white space, as they stand."""
    return F.filter(F.split(c, SPACES), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(split_words(c)).cast("long")


def paragraphs(c: Column) -> Column:
    return F.filter(F.split(c, "\n\n"), lambda p: F.trim(F.regexp_replace(p, SPACES, " ")) != "")


def words_of(c: Column) -> Column:
    """Lower-case runs of a-z, 0-9 and the apostrophe."""
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9']+)"), F.lit(1))


def stem(w: Column) -> Column:
    """Without a final s, of words over three letters that do not end in ss."""
    return F.when((F.length(w) > 3) & w.endswith("s") & ~w.endswith("ss"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)


def behaviour_content(c: Column) -> Column:
    """Stems of words over two letters that are no function words; both tests are of the word as it stands."""
    return F.transform(F.filter(words_of(c), lambda w: (F.length(w) > 2) & ~w.isin(*BEHAVIOUR_STOPWORDS)), stem)


def improv_content(c: Column) -> Column:
    """Lower-cased runs of letters and apostrophes that are no function words."""
    return F.filter(F.transform(F.regexp_extract_all(c, F.lit("([A-Za-z']+)"), F.lit(1)), F.lower), lambda w: ~w.isin(*IMPROV_STOPWORDS))


def sentences(c: Column) -> Column:
    """Split at white space after . ! ? or a quotation mark."""
    # F.trim as it stands would take the index, as its second argument, for the characters to trim.
    return F.filter(F.transform(F.split(F.trim(c), r"(?<=[.!?\"])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def proper_nouns(c: Column) -> Column:
    """Distinct capitalised words that do not begin a sentence, sorted."""
    words = F.flatten(F.transform(sentences(c), lambda s: F.slice(split_words(s), F.lit(2), F.size(split_words(s)))))
    return F.array_sort(F.array_distinct(F.filter(F.transform(words, lambda w: F.regexp_extract(w, r"^([A-Z][a-z]+)(?![\p{L}\p{N}_])", 1)), lambda w: w != "")))


def markers_found(c: Column) -> Column:
    """Names of the genre markers in the text, in the order of MARKERS."""
    hits = [F.when(c.rlike(p if name in CASE_SENSITIVE_MARKERS else f"(?i){p}"), F.lit(name)) for name, p in MARKERS]
    return F.array_compact(F.array(*hits))


def frame_collapsed(found: Column) -> Column:
    return F.arrays_overlap(found, F.array(*map(F.lit, FRAME_MARKERS)))


def repeat_rate(words: Column, n: int = 4) -> Column:
    """1 - distinct / all n-grams; null for fewer than n words."""
    grams = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(n)]))
    return F.when(F.size(words) >= n, 1 - F.size(F.array_distinct(grams)) / F.size(grams))


def local_repeat(words: Column, window: int = 4) -> Column:
    """Share of words that stand among the ``window`` words before; 0 for none."""
    seen = F.transform(words, lambda w, i: F.array_contains(F.slice(words, F.greatest(i - window + 1, F.lit(1)), F.least(i, F.lit(window))), w).cast("int"))
    return F.when(F.size(words) == 0, F.lit(0.0)).otherwise(F.aggregate(seen, F.lit(0), lambda a, x: a + x) / F.size(words))


@F.pandas_udf(IntegerType())
def longest_repeat(words):
    """Length of the longest n-gram that stands twice. Names are given to all runs of 1, 2, 4, ... words from those of
    half the length, equal names for equal runs; a run of any length is two that overlap. If one of n words stands
    twice, one of n - 1 words does, so n is found by bisection. Memory is the logarithm of the words times their number."""

    def named(a, b):
        return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1]

    def longest(row) -> int:
        ids = {w: k for k, w in enumerate(dict.fromkeys(row))}
        runs = [np.array([ids[w] for w in row], np.int64)]
        while len(runs[-1]) > 1 and len(np.unique(runs[-1])) < len(runs[-1]) and len(runs[-1]) > 1 << (len(runs) - 1):
            half = 1 << (len(runs) - 1)
            runs.append(named(runs[-1][: len(runs[-1]) - half], runs[-1][half:]))

        def twice(n: int) -> bool:
            k = min(n.bit_length() - 1, len(runs) - 1)
            if 2 << k < n:
                return False  # no run of 2 ** k words stands twice
            a = runs[k][: len(row) - n + 1]
            b = runs[k][n - (1 << k) :][: len(a)]
            names = named(a, b)
            return len(np.unique(names)) < len(names)

        lo, hi = 0, max(0, len(row) - 1)
        while lo < hi:
            n = (lo + hi + 1) // 2
            lo, hi = (n, hi) if twice(n) else (lo, n - 1)
        return lo

    return words.map(lambda x: None if x is None else longest(x))


def leading_agreement(a: Column, b: Column) -> Column:
    """Number of leading elements that two arrays share."""
    n = F.least(F.size(a), F.size(b))
    same = F.transform(F.sequence(F.lit(0), n), lambda i: (i < n) & F.get(a, i).eqNullSafe(F.get(b, i)))
    return (F.array_position(same, F.lit(False)) - 1).cast("long")


def truncate_at(ids: Column, eos: int = 2) -> Column:
    """The elements before the first ``eos``."""
    at = F.array_position(ids, F.lit(eos))
    return F.when(at > 0, F.slice(ids, 1, (at - 1).cast("int"))).otherwise(ids)


def engagement(prompt: Column, completion: Column) -> Column:
    """Share of the prompt's content words that the completion takes up; null for a prompt without any."""
    p, c = F.array_distinct(behaviour_content(prompt)), behaviour_content(completion)
    return F.when(F.size(p) > 0, F.size(F.array_intersect(p, c)) / F.size(p))


def intensity(c: Column, lexicon: list[str]) -> Column:
    """Lexicon hits per 100 content words; 0 without content words."""
    words, lex = improv_content(c), F.array(*map(F.lit, lexicon))
    return F.when(F.size(words) == 0, F.lit(0.0)).otherwise(100.0 * F.size(F.filter(words, lambda w: F.array_contains(lex, w))) / F.size(words))


def closed(tail: Column, lexicon: list[str]) -> Column:
    """Whether a sentence holds a marker: several words as a substring, one word as a word."""
    low = F.lower(tail)
    many, single = [m for m in lexicon if " " in m], [m for m in lexicon if " " not in m]
    hit = F.arrays_overlap(F.regexp_extract_all(low, F.lit("([a-z']+)"), F.lit(1)), F.array(*map(F.lit, single))) if single else F.lit(False)
    for m in many:
        hit = hit | low.contains(m)
    return hit


SLOTS = ["offer", "accept", "add", "stakes", "handback"]
STAKES = ["up", "level", "down"]


def render_think(**slots: Column) -> Column:
    return F.concat(F.lit("<think>\n"), F.concat_ws("\n", *[F.concat(F.lit(f"{k}: "), slots[k]) for k in SLOTS]), F.lit("\n</think>\n"))


def parse_think(c: Column) -> Column:
    """The five slots as a struct; null if a slot is missing or empty or stakes is unknown. Of lines with one name the last counts."""
    body = F.regexp_extract(c, r"(?s)<think>\s*(.*?)\s*</think>", 1)
    lines = F.filter(F.split(body, "\n"), lambda x: x.contains(":"))

    def slot(name: str) -> Column:
        own = F.filter(lines, lambda x: (F.lower(F.trim(F.split_part(x, F.lit(":"), F.lit(1)))) == name) & (F.trim(F.regexp_replace(x, "^[^:]*:", "")) != ""))
        return F.trim(F.regexp_replace(F.try_element_at(own, F.lit(-1)), "^[^:]*:", ""))

    found = {k: slot(k) for k in SLOTS}
    ok = c.rlike(r"(?s)<think>.*</think>")
    for v in found.values():
        ok = ok & v.isNotNull()
    return F.when(ok & found["stakes"].isin(STAKES), F.struct(*[v.alias(k) for k, v in found.items()]))
