"""Forms of words as Columns: stems, kept words of long texts, mixed alphabets, sets of words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.functions import text as T

VOWEL, OTHER = "[aeiouy]", "[^aeiouy]"
#: A stem with at least one, and with at least two, runs of vowels that a consonant follows.
ONE, TWO = f"^{OTHER}*{VOWEL}+{OTHER}", f"^{OTHER}*{VOWEL}+{OTHER}+{VOWEL}+{OTHER}"
#: Consonant, vowel, consonant at the end, the last one none of w, x and y.
SHORT = f"{OTHER}{VOWEL}[^aeiouywxY]"
#: The endings of M. F. Porter, "An algorithm for suffix stripping" (1980), steps 2 to 4.
ENDINGS_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
ENDINGS_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
ENDINGS_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _stem(cut: int) -> str:
    return f"substr(x, 1, length(x) - {cut})"


def _ending(end: str, to: str, where: str = "") -> str:
    """A branch for words with this ending; where the stem does not fit, the word stays."""
    made = f"{_stem(len(end))} || '{to}'"
    return f"WHEN x LIKE '%{end}' THEN " + (f"CASE WHEN regexp_like({_stem(len(end))}, '{where}') THEN {made} ELSE x END" if where else made)


def _step(*branches: str, rest: str = "x") -> str:
    return f"CASE WHEN length(x) < 3 THEN {rest} {' '.join(branches)} ELSE {rest} END"


_TWICE = "|".join(c * 2 for c in "bcdfghjkmnpqrtvwxY")
#: Each step is SQL text over a word x. Consonant y is written Y on the way, and ~ marks a removed ed or ing.
STEM_STEPS = [
    "CASE WHEN x LIKE 'y%' THEN 'Y' || substr(x, 2) ELSE x END",
    "regexp_replace(x, '([aeiouy])y', '$1Y')",
    _step(_ending("sses", "ss"), _ending("ies", "i"), _ending("ss", "ss"), _ending("s", "")),
    _step(_ending("eed", "ee", ONE), _ending("ed", "~", VOWEL), _ending("ing", "~", VOWEL)),
    f"CASE WHEN NOT x LIKE '%~' THEN x {_ending('at~', 'ate')} {_ending('bl~', 'ble')} {_ending('iz~', 'ize')} WHEN regexp_like(x, '({_TWICE})~$') THEN {_stem(2)} WHEN regexp_like(x, '{SHORT}~$') AND regexp_like(x, '^{OTHER}*{VOWEL}+{OTHER}+~$') THEN {_stem(1)} || 'e' ELSE {_stem(1)} END",
    f"CASE WHEN length(x) > 2 AND lower(x) LIKE '%y' AND regexp_like({_stem(1)}, '{VOWEL}') THEN {_stem(1)} || 'i' ELSE x END",
    _step(*[_ending(e, ENDINGS_2[e], ONE) for e in sorted(ENDINGS_2, key=len, reverse=True)]),
    _step(*[_ending(e, ENDINGS_3[e], ONE) for e in sorted(ENDINGS_3, key=len, reverse=True)]),
    _step(*[f"WHEN x LIKE '%ion' THEN CASE WHEN regexp_like(x, '[st]ion$') AND regexp_like({_stem(3)}, '{TWO}') THEN {_stem(3)} ELSE x END" if e == "ion" else _ending(e, "", TWO) for e in sorted(ENDINGS_4, key=len, reverse=True)]),
    f"CASE WHEN length(x) > 2 AND x LIKE '%e' AND (regexp_like({_stem(1)}, '{TWO}') OR (regexp_like({_stem(1)}, '{ONE}') AND NOT regexp_like({_stem(1)}, '{SHORT}$'))) THEN {_stem(1)} ELSE x END",
    f"lower(CASE WHEN x LIKE '%ll' AND regexp_like({_stem(1)}, '{TWO}') THEN {_stem(1)} ELSE x END)",
]


def stems(words: str) -> Column:
    """Stems of an array of lower-case English words, one pass over the array for each step."""
    made = words
    for step in STEM_STEPS:
        made = f"transform({made}, x -> {step})"
    return F.expr(made)


def stems_sql(words: str) -> str:
    """The same for DuckDB."""
    made = words
    for step in STEM_STEPS:
        made = f"list_transform({made}, lambda x: {step.replace('regexp_like', 'regexp_matches').replace(chr(39) + '$1Y' + chr(39), chr(39) + chr(92) + '1Y' + chr(39) + ', ' + chr(39) + 'g' + chr(39))})"
    return made


def decayed(words: Column, key: Column, sure: int = 600, of_ten: int = 5) -> Column:
    """The first ``sure`` words and, by a hash of key and place, ``of_ten`` in ten of the rest."""

    def kept(w: Column, i: Column) -> Column:
        return (i < sure) | (T.hash60(F.concat_ws(":", key, i.cast("string"))) % 10 < of_ten)

    return F.filter(words, kept)


#: A Latin stretch that a letter of a look-alike alphabet follows, and a digit before such a letter.
SWITCH, DIGIT_SWITCH = "[A-Za-z]+[Ͱ-ӿ]", "[0-9][Ͱ-ӿ]"


def mixed_score(word: Column, longest: int = 40, most: float = 4.0) -> Column:
    """How mixed a word's alphabets are: each switch counts one by the Latin stretch's length, after a digit a quarter."""
    switches = F.aggregate(F.regexp_extract_all(word, F.lit(SWITCH), F.lit(0)), F.lit(0.0), lambda a, s: a + F.lit(1.0) / (F.length(s) - 1))
    score = F.least(switches + F.regexp_count(word, F.lit(DIGIT_SWITCH)) * 0.25, F.lit(most))
    return F.when(F.length(word) > longest, F.lit(0.0)).otherwise(score)


def set_distance(a: Column, b: Column) -> Column:
    """How many distinct elements only one of two arrays has."""
    return F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))


def set_likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two arrays; null if both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)))


def digest(values: Column, ordered: bool = True) -> Column:
    """SHA-256 of an array's texts, in their order or in any."""
    return F.sha2(F.array_join(values if ordered else F.array_sort(values), "\x1f").cast("binary"), 256)


def encoded(url: Column) -> Column:
    """Percent encoding of all but letters, digits and ``-._~``."""
    return F.replace(F.replace(F.replace(F.url_encode(url), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
