"""Full-text matching: a query grammar, Porter's stemmer, and predicates over words."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Porter's stemmer, by rules: an ending, what replaces it, and what the stem before it must be.



def _shape(word: str) -> str:
    """Consonants and vowels of a word, as c and v; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or (ch == "y" and out[-1:] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    """How often a vowel run is followed by a consonant run."""
    return len(re.findall(r"v+c+", _shape(stem)))


def _vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _short(stem: str) -> bool:
    """Whether it ends in consonant, vowel, consonant, the last not w, x or y."""
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


#: Endings of the second, third and fourth step with their replacements.
SECOND = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
THIRD = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
FOURTH = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _replaced(word: str, endings: dict[str, str], least: int) -> str:
    for ending in sorted((e for e in endings if word.endswith(e)), key=len, reverse=True)[:1]:
        stem = word[: -len(ending)]
        return stem + endings[ending] if _measure(stem) > least else word
    return word


@lru_cache(200_000)
def stem(word: str) -> str:
    if len(word) <= 2 or not word.isascii():
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    elif (ending := next((e for e in ("ed", "ing") if word.endswith(e)), None)) and _vowel(word[: -len(ending)]):
        word = word[: -len(ending)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif _double(word) and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _short(word):
            word += "e"
    if word.endswith("y") and _vowel(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(word, SECOND, 0)
    word = _replaced(word, THIRD, 0)
    for ending in sorted((e for e in FOURTH if word.endswith(e)), key=len, reverse=True)[:1]:
        rest = word[: -len(ending)]
        if _measure(rest) > 1 and (ending != "ion" or rest.endswith(("s", "t"))):
            word = rest
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _short(word[:-1])):
            word = word[:-1]
    return word[:-1] if _double(word) and word[-1] == "l" and _measure(word[:-1]) > 1 else word


def words_of(text: str) -> list[str]:
    """Runs of letters and digits in small letters, without accents."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))
    return re.findall(r"[^\W_]+", plain)


class SyntaxMessage(ValueError):
    """What is wrong with a query's text."""


def parse(text: str):
    """A query as nested tuples: ('term', column or None, words, prefix?), ('and' | 'or' | 'not', left, right).

    What stands side by side binds closest, then NOT, then AND, then OR; parentheses group. NOT stands between two parts.
    """
    if text.count('"') % 2:
        raise SyntaxMessage("unfinished phrase: a quotation mark is missing")
    tokens = re.findall(r'"[^"]*"\*?|[()]|[^\s()"]+', text)
    at = 0

    def peek() -> str | None:
        return tokens[at] if at < len(tokens) else None

    def take() -> str:
        nonlocal at
        at += 1
        return tokens[at - 1]

    def primary():
        token = peek()
        if token is None or token in (")", "AND", "OR", "NOT"):
            raise SyntaxMessage(f"syntax error near {token!r}" if token else "syntax error at the end")
        take()
        if token == "(":
            inside = either()
            if peek() != ")":
                raise SyntaxMessage("a closing parenthesis is missing")
            take()
            return inside
        column = None
        if not token.startswith('"') and ":" in token:
            column, _, token = token.partition(":")
            if not token:
                token = take() if peek() else ""
        prefix = token.endswith("*")
        words = words_of(token)
        if not words:
            raise SyntaxMessage(f"no word in {token!r}")
        return ("term", column, words, prefix)

    def together():
        left = primary()
        while peek() is not None and peek() not in ("AND", "OR", "NOT", ")"):
            left = ("and", left, primary())
        return left

    def without():
        left = together()
        while peek() == "NOT":
            take()
            left = ("not", left, together())
        return left

    def both():
        left = without()
        while peek() == "AND":
            take()
            left = ("and", left, without())
        return left

    def either():
        left = both()
        while peek() == "OR":
            take()
            left = ("or", left, both())
        return left

    if not tokens:
        raise SyntaxMessage("nothing to match")
    tree = either()
    if peek() is not None:
        raise SyntaxMessage(f"syntax error near {peek()!r}")
    return tree


def _line(column: Column, stemmed: bool) -> Column:
    """A text's words between blanks. Without stems it stays a plain expression."""
    if not stemmed:
        words = F.split(F.trim(F.regexp_replace(F.lower(column), r"[^\p{L}\p{N}]+", " ")), " ")
        return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else " " + " ".join(map(stem, words_of(x))) + " ")

    return run(column)


def match_text(texts: DataFrame, text: str, column: str | list[str] = "text", stemmed: bool = False) -> DataFrame:
    """Rows whose columns match a query: words (all of them), OR, NOT, "phrases", prefix*, column:word and parentheses.

    ``stemmed``: words count as equal by their stems, as an index with Porter's stemmer has it; a prefix is compared with stems as it stands.
    """
    columns = [column] if isinstance(column, str) else list(column)
    tree = parse(text)
    lines = {c: f"_line_{i}" for i, c in enumerate(columns)}
    rows = texts.withColumns({name: _line(F.col(c), stemmed) for c, name in lines.items()})

    def test(node) -> Column:
        if node[0] != "term":
            left, right = test(node[1]), test(node[2])
            return left & right if node[0] == "and" else left | right if node[0] == "or" else left & ~right
        _, own, words, prefix = node
        if own is not None and own not in lines:
            raise SyntaxMessage(f"no such column: {own}")
        if stemmed:
            words = [stem(w) for w in words[:-1]] + [words[-1] if prefix else stem(words[-1])]
        wanted = " " + " ".join(words) + ("" if prefix else " ")
        return reduce(lambda a, b: a | b, [F.coalesce(F.col(lines[c]).contains(wanted), F.lit(False)) for c in ([own] if own else columns)])

    return rows.where(test(tree)).drop(*lines.values())


def message(text: str) -> str | None:
    """What is wrong with a query, or None."""
    try:
        parse(text)
    except SyntaxMessage as error:
        return str(error)
    return None


