"""Words of texts that are written without spaces: the most probable way through a dictionary."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Scripts that put no spaces between words; runs of letters and digits of others are words as they are.
UNSPACED = "㐀-䶿一-鿿豈-﫿぀-ヿ฀-๿"
#: The greatest dictionary that is sent to the tasks, in characters; how much likelier a user's word is than the words it would be cut into.
MOST_CHARS, OWN_LEAD = 50_000_000, 2.0


class Dictionary:
    """A trie of words with the logarithms of their shares.  A character that no word begins with is a word, of half a count."""

    def __init__(self, counts: dict[str, float], own: Iterable[str] = ()):
        counts, own = {w: n for w, n in counts.items() if w and n > 0}, [w for w in own if w]
        if sum(map(len, counts)) + sum(map(len, own)) > MOST_CHARS:
            raise ValueError(f"a dictionary of more than {MOST_CHARS} characters isn't sent to the tasks")
        total = sum(counts.values()) or 1.0
        self.unknown = math.log(0.5 / total)
        self.trie: dict = {}
        for w, n in counts.items():
            self._put(w, math.log(n / total))
        for w, best in [(w, self.best(w)[0][0]) for w in own]:
            self._put(w, best + math.log(OWN_LEAD))

    def _put(self, word: str, share: float) -> None:
        node = self.trie
        for c in word:
            node = node.setdefault(c, {})
        node[""] = max(share, node.get("", share))

    def arcs(self, text: str, at: int) -> list[tuple[int, float]]:
        """(end, log share) of the words that begin at a place; at least the single character."""
        found, node = [], self.trie
        for end in range(at, len(text)):
            node = node.get(text[end])
            if node is None:
                break
            if "" in node:
                found.append((end + 1, node[""]))
        if not found or found[0][0] != at + 1:
            found.insert(0, (at + 1, self.unknown))
        return found

    def best(self, text: str) -> list[tuple[float, int]]:
        """From each place on: the greatest sum of log shares, and the end of the first word."""
        found: list[tuple[float, int]] = [(0.0, 0)] * (len(text) + 1)
        for at in range(len(text) - 1, -1, -1):
            found[at] = max((score + found[end][0], end) for end, score in self.arcs(text, at))
        return found

    def cut(self, text: str) -> list[str]:
        """The words of the most probable segmentation; of equally probable ones that whose first words are longer."""
        best, words, at = self.best(text), [], 0
        while at < len(text):
            words.append(text[at : best[at][1]])
            at = best[at][1]
        return words


def words(text: str, dictionary: Dictionary, unspaced: str = UNSPACED) -> list[str]:
    """The words of a text, lower-cased: runs of an unspaced script by the dictionary, other runs of letters and digits whole, marks left out."""
    out = []
    for run in re.findall(rf"[{unspaced}]+|[^\W{unspaced}]+", text.lower()):
        out += dictionary.cut(run) if re.match(f"[{unspaced}]", run) else [run]
    return out


def segmented(spark: SparkSession, text: Column | str, counts: dict[str, float], own: Iterable[str] = (), unspaced: str = UNSPACED) -> Column:
    """The words of each text as an array; ``counts``: words and how often they occur, ``own``: a user's words, which
    win over the words that they would be cut into.

    The dictionary is built once and sent to the tasks (MOST_CHARS characters at most).
    """
    shared = spark.sparkContext.broadcast(Dictionary(counts, own))

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else words(t, shared.value, unspaced))

    return cut(F.col(text) if isinstance(text, str) else text)


def grams_of(found: Column) -> Column:
    """Words and pairs of neighbours, as terms for TF-IDF."""
    after = F.slice(found, F.lit(2), F.greatest(F.size(found) - 1, F.lit(0)))
    pairs = F.zip_with(found, after, lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(found, F.filter(pairs, lambda p: p.isNotNull()))
