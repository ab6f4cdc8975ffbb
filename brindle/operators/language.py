"""A language detector: character n-grams, fitted on a bounded sample of labelled texts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_document, strip

#: Texts a language that the model is fitted on, n-grams a language that it keeps, and the lengths of n-grams.
SAMPLE_TEXTS, KEPT, LENGTHS = 200, 3000, (1, 2, 3)
#: A language must lead by this much, or it is unknown.
LEAD = 0.0
UNKNOWN = "unknown"


#: Characters of texts that are looked up together; a longer text is looked up alone.
SLICE_CHARS = 500_000
#: Numbers of n-grams up to which a length has a table of all of them, 4 bytes each.
DIRECT = 4_000_000


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@dataclass
class Model:
    """Logarithms of smoothed frequencies of n-grams in each language; an n-gram that no language keeps says nothing."""

    languages: list[str]
    grams: dict[str, np.ndarray]
    _tables: tuple | None = field(default=None, init=False, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_tables": None}

    def _lookup(self) -> tuple:
        """Small numbers of the characters of n-grams (0: of none, 1: a space), how many, the rows, and for each length the sorted n-grams as numbers, their rows' places, and these by number where the numbers are few."""
        if self._tables is None:
            names = list(self.grams)
            known = sorted({ord(c) for g in names for c in g} - {ord(" ")})
            ids, base = np.zeros(0x110000, np.int64), len(known) + 2
            ids[[ord(" "), *known]] = range(1, base)
            tables = []
            for n in LENGTHS:
                places = np.array([i for i, g in enumerate(names) if len(g) == n], np.int64)
                keys = np.zeros(len(places), np.int64)
                for k in range(n):
                    keys = keys * base + ids[[ord(names[i][k]) for i in places]]
                order = np.argsort(keys)
                keys, places = keys[order], places[order]
                direct = None
                if base**n <= DIRECT:
                    direct = np.full(base**n, -1, np.int32)
                    direct[keys] = places
                tables.append((n, keys, places, direct))
            rows = np.array([self.grams[g] for g in names], float).reshape(len(names), len(self.languages))
            self._tables = ids, base, rows, tables
        return self._tables

    def scores(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """A row of each text's scores by language, and whether it has a letter.

        The texts' n-grams, those of ``grams``, are looked up together; a text's are added in the order in which they are
        first found, so that its scores don't depend on the texts beside it.
        """
        ids, base, rows, tables = self._lookup()
        low = [t.lower() for t in texts]
        codes = np.frombuffer(f" {' '.join(low)} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        letter, owner = _letters()[codes], np.repeat(np.arange(len(low)), [len(t) + 1 for t in low])
        # between words, and so between texts, one space is left, and one at either end
        stays = letter.copy()
        stays[:-1] |= letter[1:]
        stays[-1] = True
        x, owner, letter = np.where(letter, ids[codes], 1)[stays], np.concatenate([[0], owner])[stays], letter[stays]
        found, owners = [], []
        for n, keys, places, direct in tables:
            m = len(x) - n + 1
            if m <= 0 or not len(keys):
                continue
            key = x[:m]
            for k in range(1, n):
                key = key * base + x[k : m + k]
            if direct is None:
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                place = np.where(keys[at] == key, places[at], -1)
            else:
                place = direct[key]
            # an n-gram is that text's whose letters it has; those that join two texts are none's
            first, last = (np.where(letter[i : m + i], owner[i : m + i], owner[j : m + j]) for i, j in ((0, min(1, n - 1)), (n - 1, max(0, n - 2))))
            hit = (place >= 0) & (first == last) & (letter[:m] if n == 1 else True)
            found.append(place[hit])
            owners.append(first[hit])
        total = np.zeros((len(low), len(self.languages)))
        if found:
            gram, text = np.concatenate(found), np.concatenate(owners)
            # text, n-gram and place sorted as one number: each n-gram's count goes to the place where its text has it first
            bits = len(gram).bit_length()
            key = np.sort((text * len(rows) + gram) << bits | np.arange(len(gram)))
            begin = np.flatnonzero(np.diff(key >> bits, prepend=-1))
            n = np.zeros(len(gram))
            n[key[begin] & (1 << bits) - 1] = np.diff(begin, append=len(key))
            first = np.flatnonzero(n)
            text, weighted = text[first], n[first, None] * rows[gram[first]]
            for i in range(len(self.languages)):
                total[:, i] = np.bincount(text, weighted[:, i], len(low))
        return total, np.bincount(owner[letter], minlength=len(low)) > 0

    def detect_all(self, texts: Sequence[str | None]) -> list[str]:
        """The likeliest language of each text; unknown for one without a letter, or one that no language is ahead for."""
        whole, out, first = [t if isinstance(t, str) else "" for t in texts], [], 0
        while first < len(whole) and self.languages:
            last, chars = first + 1, len(whole[first])
            while last < len(whole) and chars + len(whole[last]) <= SLICE_CHARS:
                chars += len(whole[last])
                last += 1
            scores, spoken = self.scores(whole[first:last])
            best = np.argsort(-scores, axis=1, kind="stable")
            if len(self.languages) > 1:
                top = np.take_along_axis(scores, best[:, :2], 1)
                spoken &= top[:, 0] - top[:, 1] > LEAD
            out += [self.languages[b] if s else UNKNOWN for b, s in zip(best[:, 0], spoken)]
            first = last
        return out or [UNKNOWN] * len(whole)

    def detect(self, text: str | None) -> str:
        return self.detect_all([text])[0]


def grams(text: str) -> Counter:
    """The n-grams of the lower-cased words, each between spaces, digits and marks left out."""
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    line = f" {' '.join(letters.split())} "
    found = Counter()
    for n in LENGTHS:
        found.update([line[i : i + n] for i in range(len(line) - n + 1)])
    found.pop(" ", None)
    return found


def fit(labelled: DataFrame, text: str = "text", label: str = "lang", sample: int = SAMPLE_TEXTS, kept: int = KEPT) -> Model:
    """A model from about ``sample`` whole texts of each language, chosen by a hash of the text; rows without a text or label take no part.

    Texts' n-grams are counted where they lie and added up by language; the driver gets the ``kept`` most frequent of
    each language and their totals.  Languages are as many as labels; each costs the model a column.
    """
    known = labelled.where(F.col(text).isNotNull() & F.col(label).isNotNull() & (strip(text) != "")).select(F.col(text).alias("t"), F.col(label).alias("l"))
    sizes = known.groupBy("l").agg(F.count("*").alias("n"))
    share = known.join(F.broadcast(sizes), "l").where(F.pmod(F.xxhash64("t"), F.greatest(F.lit(1), F.floor(F.col("n") / sample)).cast("long")) == 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        for b in batches:
            for language, t in zip(b.column(0).to_pylist(), b.column(1)):
                found.setdefault(language, Counter()).update(grams(t.as_py()))
        rows = [(language, g, n) for language, c in found.items() for g, n in c.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["l", "gram", "n"])

    counts = share.select("l", "t").mapInArrow(count, "l string, gram string, n long").groupBy("l", "gram").agg(F.sum("n").alias("n"))
    best = counts.groupBy("l").agg(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("n", "gram")))), 1, kept).alias("best"), F.sum("n").alias("total")).collect()
    languages = sorted(r.l for r in best)
    chosen = sorted({x.gram for r in best for x in r.best})
    place = {g: i for i, g in enumerate(chosen)}
    table, totals = np.zeros((len(chosen), len(languages))), np.zeros(len(languages))
    rows = counts.join(F.broadcast(labelled.sparkSession.createDataFrame([(g,) for g in chosen], "gram string")), "gram").collect() if chosen else []
    for r in rows:
        table[place[r.gram], languages.index(r.l)] = r.n
    for r in best:
        totals[languages.index(r.l)] = r.total
    logs = np.log(table + 0.5) - np.log(totals + 0.5 * (len(chosen) + 1)) if chosen else table
    return Model(languages, {g: logs[i] - logs[i].mean() for g, i in place.items()})


def detected(rows: DataFrame, model: Model, text: str = "text", out: str = "language") -> DataFrame:
    """rows with the language of each text, read whole."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def detect(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.detect_all(list(texts)), dtype=object)

    return rows.withColumn(out, detect(text))


def in_languages(paragraphs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The paragraphs in one of these languages or in none known; empty ones go.  zh and en take their variants."""
    from .dedupe import keep_languages

    marked = detected(paragraphs.where(strip(text) != ""), model, text, "_language")
    return keep_languages(marked, keep, "_language").drop("_language")


def clean_paragraphs(raw: DataFrame, model: Model, keep: list[str], text: str = "text", is_html: bool = True, min_chars: int = 10) -> DataFrame:
    """raw with paragraphs: the text's, cleaned as by ``clean_document``, those in the languages of ``keep`` or in none known.

    Paragraphs in other languages go before repeated and short ones do, so a paragraph is judged with all its text.
    """
    from .dedupe import keep_languages

    whole = raw.withColumn("_paragraphs", clean_document(text, is_html, 1))
    if not keep:
        return whole.withColumn("paragraphs", F.filter("_paragraphs", lambda p: F.length(p) >= min_chars)).drop("_paragraphs")
    spark = raw.sparkSession
    wanted = {r.c for r in keep_languages(spark.createDataFrame([(x,) for x in [*model.languages, UNKNOWN]], "c string"), keep, "c").collect()}
    shared = spark.sparkContext.broadcast((model, wanted))

    @F.pandas_udf("array<string>")
    def in_them(lists: pd.Series) -> pd.Series:
        model, wanted = shared.value
        found = iter(model.detect_all([p for ps in lists if ps is not None for p in ps]))
        return pd.Series([None if ps is None else [p for p in ps if next(found) in wanted] for ps in lists], dtype=object)

    return whole.withColumn("paragraphs", F.filter(in_them("_paragraphs"), lambda p: F.length(p) >= min_chars)).drop("_paragraphs")
