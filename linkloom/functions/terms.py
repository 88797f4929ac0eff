"""Term processors: how two spellings of a term come to be one. Extend by `register_processor`."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Characters that a word may hold between two letters or digits.
_INNER = ".@_&/-"
_WORD = re.compile(rf"[^\W_](?:[^\W_]|[{re.escape(_INNER)}'](?=[^\W_]))*'?")


def clean_term(s: str) -> str:
    """Words parted by one space, in lower case, without punctuation but for `. @ _ & / -` inside a word."""
    return " ".join(m.group(0).replace("'", "") for m in _WORD.finditer(s)).lower()


def _singular(w: str) -> str:
    if len(w) <= 3 or not w.isalpha():
        return w
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith("ies"):
        return w[:-3] + "y"
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def simple_stem(s: str) -> str:
    """`clean_term`, and plurals of longer words to the singular."""
    return " ".join(map(_singular, clean_term(s).split(" ")))


class Porter:
    """Porter's stemmer (M. F. Porter, An algorithm for suffix stripping, 1980)."""

    # Suffixes and what replaces them, where the stem before has a measure over 0.
    STEP2 = {
        "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
        "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
    }
    STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
    # Suffixes that go where the stem before has a measure over 1.
    STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

    def __init__(self) -> None:
        self.known: dict[str, str] = {}

    @staticmethod
    def shape(w: str) -> str:
        """'v' and 'c' for each letter; y is a vowel after a consonant."""
        out = ""
        for i, ch in enumerate(w):
            out += "v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c"
        return out

    @classmethod
    def measure(cls, w: str) -> int:
        return len(re.findall("v+c+", cls.shape(w)))

    @classmethod
    def short_end(cls, w: str) -> bool:
        return cls.shape(w)[-3:] == "cvc" and w[-1] not in "wxy"

    @classmethod
    def swap(cls, w: str, table: dict[str, str]) -> str:
        for n in range(min(7, len(w)), 2, -1):
            if w[-n:] in table:
                return w[:-n] + table[w[-n:]] if cls.measure(w[:-n]) > 0 else w
        return w

    def word(self, w: str) -> str:
        if len(w) <= 2 or not w.isalpha():
            return w
        if w not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[w] = self._stem(w)
        return self.known[w]

    def _stem(self, w: str) -> str:
        if w.endswith(("sses", "ies")):
            w = w[:-2]
        elif w.endswith("s") and not w.endswith("ss"):
            w = w[:-1]
        if w.endswith("eed"):
            w = w[:-1] if self.measure(w[:-3]) > 0 else w
        else:
            for end in ("ed", "ing"):
                if w.endswith(end) and "v" in self.shape(w[: -len(end)]):
                    w = w[: -len(end)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif len(w) > 1 and w[-1] == w[-2] and self.shape(w)[-1] == "c" and w[-1] not in "lsz":
                        w = w[:-1]
                    elif self.measure(w) == 1 and self.short_end(w):
                        w += "e"
                    break
        if w.endswith("y") and "v" in self.shape(w[:-1]):
            w = w[:-1] + "i"
        w = self.swap(self.swap(w, self.STEP2), self.STEP3)
        for end in sorted(self.STEP4, key=len, reverse=True):
            if w.endswith(end):
                stem = w[: -len(end)]
                if self.measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                    w = stem
                break
        if w.endswith("e"):
            m = self.measure(w[:-1])
            if m > 1 or (m == 1 and not self.short_end(w[:-1])):
                w = w[:-1]
        if w.endswith("ll") and self.measure(w) > 1:
            w = w[:-1]
        return w


_porter = Porter()


def porter_stem(s: str) -> str:
    """Each word stemmed, then cleaned; the stemmer knows lower case only."""
    return clean_term(" ".join(map(_porter.word, s.split(" "))))


def case_fold(col: Column) -> Column:
    """Lower case."""
    return F.lower(col)


def remove_stopwords(col: Column, stopwords: list[str]) -> Column:
    """Without the words that are stopwords as they stand (the case counts)."""
    stop = F.array(*map(F.lit, stopwords)).cast("array<string>")
    return F.array_join(F.filter(F.split(col, r"\s+"), lambda w: ~F.array_contains(stop, w)), " ")


def _udf(f: Callable[[str], str]) -> Callable[[Column], Column]:
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else f(x))

    def column(col: Column) -> Column:
        return F.pandas_udf(run, "string")(col)  # needs a session, so not before it is used

    column.run = run
    return column


cleaner, simple_stemmer, porter_stemmer = _udf(clean_term), _udf(simple_stem), _udf(porter_stem)

#: Name -> column function.
PROCESSORS: dict[str, Callable[[Column], Column]] = {"casefold": case_fold, "clean": cleaner, "simple_stem": simple_stemmer, "porter_stem": porter_stemmer}


def register_processor(name: str, f: Callable[[Column], Column]) -> None:
    """Adds a processor under a new name."""
    if name in PROCESSORS:
        raise ValueError(f"{name} is taken")
    PROCESSORS[name] = f


def register_sql(spark: SparkSession) -> None:
    """Makes the Python processors known to SQL."""
    for name, f in (("clean_term", cleaner), ("simple_stem", simple_stemmer), ("porter_stem", porter_stemmer)):
        spark.udf.register(name, F.pandas_udf(f.run, "string"))
