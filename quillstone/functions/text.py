"""Text primitives as Column expressions: tokens, sentences, counts, rates.

Tokens are runs of Unicode letters, digits and underscores in lower case; the class is
spelled out, since `\\w` is ASCII only in this engine.  Word boundaries are spelled out
too (`bounded`), since what `\\b` means hangs on the Java version.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions import numeric

TOKEN = r"[\p{L}\p{N}_]+"
SENTENCE_END = r"(?<=[.!?])\s+"
BOUNDARY = r"(?:(?<=[\p{L}\p{N}_])(?![\p{L}\p{N}_])|(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_]))"
CAPS_RUN = r"\b[A-Z]{3,}\b"
#: Openers of a rhetorical question.
QUESTION_OPENERS = (
    r"how (is|can|could|on earth|in the world)\b",
    r"why (is|on earth|in the world|would anyone)\b",
    r"who (does|do they think|in their right mind)\b",
    r"what kind of\b",
    r"are (we|they) really\b",
    r"is this (what|really|seriously)\b",
    r"does anyone (really|honestly|seriously)\b",
    r"seriously\?",
    r"really\?",
    r"make it make sense\b",
    r"you can'?t make this (up|stuff up)\b",
)
#: Fixed value: words of exaggeration.
HYPERBOLE = (
    r"(?i)\b(literally|every (single|last) (one|time)|always|never|nobody|everybody|everyone|no one|all of them|the worst|the best|the most|"
    r"absolutely (everyone|nobody|nothing|everything)|insane|outrageous|unbelievable|insanity|madness)\b"
)
#: One of these stands in the lower-case text wherever a word of exaggeration does.
HYPERBOLE_PARTS = ("literally", "every", "always", "never", "nobody", "no one", "all of them", "the worst", "the best", "the most", "absolutely ", "insan", "outrageous", "unbelievable", "madness")
#: Capitalised words inside a sentence, pairs of them, numerals and quoted spans.
INNER_CAPITAL = r"(?=[A-Z])(?<![.!?]\s)(?<!^)\b[A-Z][a-z]+\b"
CAPITAL_PAIR = r"\b[A-Z][a-z]+\s+[A-Z][a-z]+\b"
NUMERAL = r"\b\d[\d.,]*\b"
QUOTED = "[\"“][^\"“”]{3,}[\"”]"


WORD = r"[\p{L}\p{N}_]"
#: One character of a word, not left out by what follows; the end of a pattern that is one.
_FIRST = re.compile(r"(?:[A-Za-z0-9_]|\[(?:A-Z|a-z|0-9)\]|\\d)(?![*?]|\{0)")
_LAST = re.compile(r"(?:(?<!\\)[A-Za-z0-9_]|\\d|\[(?:A-Z|a-z|0-9)\](?:\+|\{[1-9]\d*,?\d*\})?)$")


def _group(pattern: str, at: int) -> tuple[int, list[str]]:
    """Where the group that opens there closes, and its alternatives; -1 if it is no plain group."""
    depth, parts = 0, [""]
    for k in range(at, len(pattern) if pattern[at + 1 : at + 2] != "?" else at):
        depth += (pattern[k] == "(") - (pattern[k] == ")")
        if not depth:
            return k, parts
        if k > at:
            parts = [*parts, ""] if depth == 1 and pattern[k] == "|" else [*parts[:-1], parts[-1] + pattern[k]]
    return -1, []


def _firsts(rest: str) -> list[str] | None:
    """The characters with which a match of this begins, if each is one of a word."""
    if rest.startswith("("):
        end, parts = _group(rest, 0)
        told = [_firsts(x) for x in parts]
        return None if end < 0 or None in told or re.match(r"[*?]|\{0", rest[end + 1 :]) else [x for t in told for x in t]
    m = _FIRST.match(rest)
    return [m[0].strip("[]")] if m else None


def _word_ends(head: str) -> bool:
    """Whether a match of this ends with a character of a word."""
    if head.endswith(")"):
        for k in range(len(head)):
            if head[k] == "(" and (found := _group(head, k))[0] == len(head) - 1:
                return all(_word_ends(x) for x in found[1])
    return bool(_LAST.search(head))


def bounded(pattern: str) -> str:
    """The pattern with boundaries of words of any letters in the place of each `\\b`.

    Where a character of a word follows for certain, or stands before, one look at the other
    side is enough; the former is told after a look at the character itself, at which most
    places fail.
    """
    if re.search(r"\\[()|\\xucpPkQ0-9]|\[[^\]]*[()|]", pattern):  # parentheses that are no groups, letters that are no characters
        return pattern.replace(r"\b", BOUNDARY)
    parts, out = pattern.split(r"\b"), ""
    for k, part in enumerate(parts):
        head, rest = r"\b".join(parts[:k]), part
        if k and (firsts := _firsts(rest)) is not None:
            out += f"(?=[{''.join(sorted(set(firsts)))}])(?<!{WORD})"
        elif k:
            out += f"(?!{WORD})" if _word_ends(head) else BOUNDARY
        out += part
    return out


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(bounded(pattern)))


def holds(text: Column, parts) -> Column:
    """Whether the text in lower case has one of these strings.  Searching them is much cheaper than the patterns that need them."""
    return numeric.let(F.lower(text), lambda t: reduce(or_, [F.contains(t, F.lit(p)) for p in parts]))


def occurrences(text: Column, part: str) -> Column:
    """Non-overlapping occurrences of a fixed string."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def tokens(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda x: F.lower(x))


def n_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def sentences(text: Column, keep: str = "non_empty") -> Column:
    """Sentences; keep: non_empty, over_three (more than three characters) or stripped (trimmed, non-empty)."""
    parts = F.split(stripped(text), SENTENCE_END)
    if keep == "stripped":
        return F.filter(F.transform(parts, stripped), lambda s: s != "")
    return F.filter(parts, lambda s: F.length(s) > 3) if keep == "over_three" else F.filter(parts, lambda s: s != "")


def n_words(text: Column) -> Column:
    """Words between white space."""
    return F.size(F.filter(F.split(stripped(text), r"\s+"), lambda w: w != ""))


def within_words(text: Column, least: int = 8, most: int = 80) -> Column:
    """Whether a text has so many words between white space."""
    return n_words(text).between(least, most)


def n_sentences(text: Column) -> Column:
    """Runs of terminators, one more if the last character is none; at least 1."""
    open_end = (F.length(text) > 0) & ~F.substring(text, -1, 1).isin(".", "!", "?")
    return F.greatest(F.lit(1), count(text, "[.!?]+") + open_end.cast("int"))


def n_sentence_pieces(text: Column) -> Column:
    """Pieces between runs of terminators, the empty last one included; at least 1."""
    return F.greatest(F.lit(1), F.size(F.split(stripped(text), "[.!?]+")))


def truncated(text: Column, least: int = 8, most: int = 120) -> Column:
    """Whole sentences up to `most` words; a first sentence that is too long is cut; null under `least` words."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"), F.lit(False).alias("done"))

    def step(acc: Column, s: Column) -> Column:
        n = n_words(s)
        fits = ~acc["done"] & (acc["n"] + n <= most)
        first = ~acc["done"] & (acc["n"] == 0) & (n > most)
        cut = F.array_join(F.slice(F.split(stripped(s), r"\s+"), 1, most), " ")
        joined = F.when(acc["out"] == "", s).otherwise(F.concat(acc["out"], F.lit(" "), s))
        out = F.when(first, cut).when(fits, joined).otherwise(acc["out"])
        return F.struct(out.alias("out"), F.when(first, F.lit(most)).when(fits, acc["n"] + n).otherwise(acc["n"]).alias("n"), (acc["done"] | ~fits).alias("done"))

    done = F.aggregate(sentences(text), start, step)
    return F.when(done["n"] >= least, done["out"])


def punctuation_rates(text: Column) -> dict[str, Column]:
    """Ten rates: by sentence, the last two by character."""
    s, c = n_sentences(text), F.greatest(F.lit(1), F.length(text))
    smart = sum((occurrences(text, x) for x in "‘’“”"), F.lit(0))
    return {
        "em_dash": occurrences(text, "—") / s,
        "en_dash": occurrences(text, "–") / s,
        "semicolon": occurrences(text, ";") / s,
        "ellipsis": (occurrences(text, "...") + occurrences(text, "…")) / s,
        "oxford_comma": count(text, r",\s+and\b") / s,
        "multi_excl": count(text, "!{2,}") / s,
        "multi_quest": count(text, r"\?{2,}") / s,
        "all_caps_run": count(text, CAPS_RUN) / s,
        "double_space": occurrences(text, "  ") / c,
        "smart_quote": smart / c,
    }


def is_rhetorical(sentence: Column) -> Column:
    s = stripped(sentence)
    return F.endswith(s, F.lit("?")) & s.rlike(bounded("(?i)^(" + "|".join(f"(?:{p})" for p in QUESTION_OPENERS) + ")"))


def rhetoric(text: Column) -> Column:
    """Rhetorical questions, hyperboles and exclamation marks by sentence plus capital runs by token."""
    t = F.greatest(F.lit(1), n_tokens(text))
    hyperboles = F.when(holds(text, HYPERBOLE_PARTS), count(text, HYPERBOLE)).otherwise(0)

    def score(found: Column) -> Column:
        n = F.greatest(F.lit(1), F.size(found))
        questions = F.when(F.contains(text, F.lit("?")), F.size(F.filter(found, is_rhetorical))).otherwise(0)
        return questions / n + hyperboles / n + count(text, CAPS_RUN) / t + count(text, "!") / n

    return F.when(stripped(text) != "", numeric.let(sentences(text), score))


def information(text: Column) -> Column:
    """Named-entity proxies, numerals and quoted spans by token."""
    parts = F.filter(F.split(text, SENTENCE_END), lambda s: s != "")
    names = F.aggregate(parts, F.lit(0), lambda a, s: a + count(F.substr(s, F.lit(2)), INNER_CAPITAL) + count(s, CAPITAL_PAIR))
    return numeric.let(n_tokens(text), lambda t: F.when(t > 0, (names + count(text, NUMERAL) + count(text, QUOTED)) / t))


#: Fixed values, in this order: what the neutral form leaves out.
NEUTRALIZED = (
    r"\bhow (is|can|could|on earth|in the world) [^.!?]+\?",
    r"\bwhy (is|on earth|in the world|would anyone) [^.!?]+\?",
    r"\bmake it make sense\.?",
    r"\byou can'?t make this (up|stuff up)\.?",
    r"\bseriously\?+",
    r"\breally\?+",
    r"\bwake up,? (people|sheeple|everyone)\b",
    r"\bthese (clowns|idiots|morons|fools)\b",
    r"\b(omg|wtf|smh)\b",
)

#: One of these stands in the lower-case text wherever one of the patterns matches.
NEUTRALIZED_PARTS = ("how ", "why ", "make it make sense", "you can", "seriously?", "really?", "wake up", "these ", "omg", "wtf", "smh")


def neutral(text: Column, strong_words: list[str]) -> Column:
    """The text without rhetorical questions, set phrases, hyperboles and strongly affective words; capitals lowered."""

    def changed(text: Column, needed: Column, change) -> Column:
        return F.when(needed, change(text)).otherwise(text)

    def without_phrases(text: Column) -> Column:
        return reduce(lambda t, p: F.regexp_replace(t, bounded(f"(?i){p}"), ""), NEUTRALIZED, text)

    def lowered(text: Column) -> Column:
        # pieces between capital runs alternate with the runs, which are lowered
        pieces = F.split(F.regexp_replace(text, bounded(f"({CAPS_RUN})"), "\u0001$1\u0001"), "\u0001")
        return F.array_join(F.transform(pieces, lambda x, i: F.when(i % 2 == 1, F.lower(x)).otherwise(x)), "")

    text = changed(text, holds(text, NEUTRALIZED_PARTS), without_phrases)
    text = numeric.let(text, lambda t: changed(t, t.rlike("[A-Z]{3}|\u0001"), lowered))
    text = numeric.let(text, lambda t: changed(t, holds(t, HYPERBOLE_PARTS), lambda t: F.regexp_replace(t, bounded(HYPERBOLE), "")))
    if strong_words:
        without = lambda t: F.regexp_replace(t, r"(?i)(?<![\p{L}\p{N}_])(" + "|".join(sorted(strong_words)) + r")(?![\p{L}\p{N}_])", "")
        # words without characters that mean something in a pattern, and few enough to be searched one by one
        plain = len(strong_words) <= 40 and all(re.fullmatch(r"[A-Za-z0-9' -]+", w) for w in strong_words)
        text = numeric.let(text, lambda t: changed(t, holds(t, sorted({w.lower() for w in strong_words})), without)) if plain else without(text)
    return stripped(F.regexp_replace(F.regexp_replace(text, r"([!?]){2,}", "$1"), r"\s+", " "))


def length_ratio(part: Column, whole: Column) -> Column:
    return F.least(F.lit(1.0), F.length(part) / F.greatest(F.lit(1), F.length(whole)))


def certain_part(pattern: str) -> str:
    """The longest run of plain characters that every match of the pattern holds, in lower case; empty if none is told."""
    plain = re.sub(r"\\b", "\0", pattern)
    if re.search(r"[\\()|\[\]{}^$.+]", plain):
        return ""
    return max(re.split(r"\0|[a-zA-Z0-9' ,-][?*]|[^a-zA-Z0-9' ,-]", plain), key=len).lower()


def distinct_pattern_hits(text: Column, patterns) -> Column:
    """How many of the patterns match at least once.

    A text without the part that every match holds is not searched; in lower case a text has all that the pattern takes for equal.
    """
    found = lambda p: (F.contains(F.lower(text), F.lit(part)) if (part := certain_part(p)) else F.lit(True)) & text.rlike(bounded(f"(?i){p}"))
    return sum((found(p).cast("int") for p in patterns), F.lit(0))


def slug(name: Column) -> Column:
    """Lower case, other characters as underscores, a trailing number padded to two digits."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    head, number = F.regexp_extract(plain, "^(.*?)_?([0-9]+)$", 1), F.regexp_extract(plain, "^(.*?)_?([0-9]+)$", 2)
    return F.when(number != "", F.concat(head, F.lit("_"), F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number))).otherwise(plain)


def without_fence(text: Column) -> Column:
    return stripped(F.regexp_replace(F.regexp_replace(stripped(text), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))


def speaker(tag: Column) -> Column:
    t = F.lower(stripped(tag))
    return F.when(t.rlike("^person a") | t.isin("suspect", "scammer", "caller", "bot"), "S").otherwise("V")


def numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0)), lambda x: x.cast("double"))


def user_hash(name: Column, salt: str) -> Column:
    return F.when(F.length(name) > 0, F.concat(F.lit("U"), F.substring(F.sha2(F.concat(F.lit(salt), name), 256), 1, 10)))


def absolute_url(base: Column, link: Column) -> Column:
    """A link joined to its page's address."""
    origin = F.regexp_extract(base, "^([a-z]+://[^/?#]+)", 1)
    folder = F.regexp_extract(F.regexp_replace(base, "[?#].*$", ""), "^([a-z]+://[^/]+/(?:.*/)?)", 1)
    return (
        F.when(link.rlike("^[a-z]+://"), link).when(link.startswith("//"), F.concat(F.regexp_extract(base, "^([a-z]+:)", 1), link)).when(link.startswith("/"), F.concat(origin, link))
        .otherwise(F.concat(F.when(folder != "", folder).otherwise(F.concat(origin, F.lit("/"))), link))
    )
