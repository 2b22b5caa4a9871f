"""Many words looked for at once.

The words become one regular expression, a trie of their letters written as
alternatives, so a text is read once however many words there are and the
generated code holds one pattern. What was found is a short array, and tables
of words are looked up for that array alone.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def pattern(words) -> str:
    """A regular expression for any of the words, the longest first where several begin alike."""
    trie: dict = {}
    for word in words:
        node = trie
        for letter in word:
            node = node.setdefault(letter, {})
        node[""] = {}
    return _alternatives(trie)


def _alternatives(node: dict) -> str:
    """What may follow in a node; a word that ends here comes after all that go on."""
    made = [re.escape(letter) + _alternatives(below) for letter, below in sorted(node.items()) if letter]
    if not made:
        return ""
    body = made[0] if len(made) == 1 and "" not in node else "(?:" + "|".join(made) + ")"
    return body + "?" if "" in node else body


def whole_words(text: Column, words, letters: str) -> Column:
    """The words that stand alone in the text, between others than ``letters`` (a class of characters), each time they do."""
    return F.regexp_extract_all(text, F.lit(f"(?<![{letters}])({pattern(words)})(?![{letters}])"), F.lit(1))


def marked_words(text: Column, words, letters: str) -> Column:
    """As ``whole_words``, for words that may have digits behind them."""
    return F.regexp_extract_all(text, F.lit(f"(?<![{letters}])({pattern(words)})[0-9]*(?![{letters}])"), F.lit(1))


def anywhere(text: Column, words) -> Column:
    """The words that the text holds: at every place the longest that begins there."""
    return F.regexp_extract_all(text, F.lit(f"(?=({pattern(words)}))"), F.lit(1))


def least(found: Column, values: Mapping[str, int]) -> Column:
    """The least value of the found words, null if none has one."""
    table = F.create_map(*[F.lit(x) for item in values.items() for x in item])
    return F.array_min(F.transform(found, lambda w: F.try_element_at(table, w)))


def any_of(found: Column, words) -> Column:
    """Whether one of the words was found."""
    return F.arrays_overlap(found, F.array(*[F.lit(w) for w in words]))
