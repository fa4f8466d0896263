"""Names and keys: normalising and similarity."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

# Words of names that stand for one another.
NAME_WORDS: dict[str, str] = {
    "mohammed": "muhammad",
    "mohammad": "muhammad",
    "muhammed": "muhammad",
    "mohamad": "muhammad",
    "mohamed": "muhammad",
    "limited": "ltd",
    "corporation": "corp",
    "company": "co",
    "incorporated": "inc",
    "mister": "mr",
    "missus": "mrs",
    "doctor": "dr",
    "junior": "jr",
    "senior": "sr",
    "saint": "st",
    "abdel": "abd",
    "abdul": "abd",
    "ibn": "bin",
}

#: White space as Unicode has it, for trimming by character.
_SPACES = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_NOT_WORD = re.compile(r"[^\w\s]")


def key(c: Column) -> Column:
    """Stripped of white space and lower-cased; the empty string for null or blank."""
    return F.coalesce(F.lower(F.btrim(c.cast("string"), F.lit(_SPACES))), F.lit(""))


def stripped(c: Column) -> Column:
    """Without outer white space; null where nothing is left."""
    return F.nullif(F.btrim(c.cast("string"), F.lit(_SPACES)), F.lit(""))


def plain_name(name: str | None) -> str:
    """Without accents and punctuation, in lower case, words replaced by their common form."""
    if not name:
        return ""
    open_ = "".join(ch for ch in unicodedata.normalize("NFKD", name) if not unicodedata.combining(ch))
    return " ".join(NAME_WORDS.get(w, w) for w in _NOT_WORD.sub(" ", open_.lower()).split())


@F.pandas_udf(StringType())
def plain_name_udf(names: pd.Series) -> pd.Series:
    """plain_name; names come distinct, so the rows are few."""
    return names.map(plain_name)


def jaro(a: str, b: str) -> float:
    """Jaro similarity; half the transposed matches, rounded down, count against it."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    reach = max(reach, 0)
    taken, hit = [False] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == ch:
                taken[j] = True
                hit.append(ch)
                break
    if not hit:
        return 0.0
    other = [ch for ch, t in zip(b, taken, strict=True) if t]
    swapped = sum(x != y for x, y in zip(hit, other, strict=True)) // 2
    m = len(hit)
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    """Jaro, raised by up to four common first characters where it is above 0.7."""
    j = jaro(a, b)
    if j <= 0.7:
        return j
    same = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        same += 1
    return j + same * 0.1 * (1 - j)


@F.pandas_udf(DoubleType())
def jaro_winkler_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro_winkler(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")


def exact_similarity(a: Column, b: Column) -> Column:
    return F.when(a == b, F.lit(1.0)).otherwise(F.lit(0.0))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """One less the edit distance over the longer length; 1 if both are empty, 0 if one is."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    near = 1 - F.levenshtein(a, b) / longest
    return F.when(longest == 0, F.lit(1.0)).when((F.char_length(a) == 0) | (F.char_length(b) == 0), F.lit(0.0)).otherwise(near)


# Metaphone as replacements in this order: small letters are still to be coded, capitals and 0 are codes.
_METAPHONE = (
    (r"[^a-z]", ""), (r"([abd-z])\1+", "$1"), (r"^[kgp](?=n)|^w(?=r)|^a(?=e)", ""), (r"^x", "s"), (r"^wh", "w"), (r"(?<=m)b$", ""),
    (r"tch", "ch"), (r"sch", "SK"), (r"c(?=ia)|ch", "X"), (r"c(?=[iey])", "S"), (r"ck?|k", "K"), (r"dg(?=[iey])", "J"), (r"d", "T"),
    (r"gn(?=$|ed$)", "N"), (r"gh(?=[^aeiou])", ""), (r"g(?=[iey])", "J"), (r"gh?|q", "K"), (r"ph|v", "F"), (r"sh|[st](?=i[oa])", "X"),
    (r"th", "0"), (r"x", "KS"), (r"z", "S"), (r"(?<=[aeiou])h(?![aeiou])|[wy](?![aeiou])", ""), (r"(?<!^)[aeiou]", ""),
)


def metaphone(word: Column) -> Column:
    """How a word in small letters sounds, by the original Metaphone; the empty string without a letter from a to z."""
    for pattern, code in _METAPHONE:
        word = F.regexp_replace(word, pattern, code)
    return F.upper(word)


def sounds(c: Column) -> Column:
    """Soundex (s) and Metaphone (m) of each word of a plain name; null where a word has none."""
    words = F.array_remove(F.split(c, " "), "")
    coded = lambda w: F.struct(F.nullif(F.soundex(w), F.lit("")).alias("s"), F.nullif(metaphone(w), F.lit("")).alias("m"))
    return F.transform(words, coded)


def heard(mine: Column, theirs: Column) -> Column:
    """The share of words in mine that a word of theirs sounds like, by Soundex or by Metaphone; both from sounds()."""
    alike = F.filter(mine, lambda x: F.exists(theirs, lambda y: F.coalesce((x["s"] == y["s"]) | (x["m"] == y["m"]), F.lit(False))))
    return F.when((F.size(mine) == 0) | (F.size(theirs) == 0), F.lit(0.0)).otherwise(F.size(alike) / F.size(mine))


def phonetic_similarity(a: Column, b: Column) -> Column:
    """heard() of two plain names."""
    return heard(sounds(a), sounds(b))


#: Similarities by name, each a function of two columns of plain names.
ALGORITHMS = {
    "exact": exact_similarity,
    "levenshtein": levenshtein_similarity,
    "jaro_winkler": jaro_winkler_udf,
    "phonetic": phonetic_similarity,
}
