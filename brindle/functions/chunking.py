"""Ways of cutting a text into an array of chunks, as Column expressions; ``rows`` makes a row of each."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import WS, let, strip


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rows(docs: DataFrame, chunks: Column, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, chunk_id, text): chunks numbered from 0."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(chunks).alias("chunk_id", "text"))


def _windows(text: Column, count: Column, size: int, step: int) -> Column:
    """``count`` windows, put together from pieces of ``step`` characters: the text is cut up once, whatever their number."""
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), 0)

    def made(p: Column) -> Column:
        starts = F.sequence(F.lit(0), (count - 1).cast("int"))
        return F.transform(starts, lambda i: F.left(F.array_join(F.slice(p, i + 1, F.lit(-(-size // step))), ""), F.lit(size)))

    return F.when(count > 0, let(pieces, made)).otherwise(F.array().cast("array<string>"))


def fixed(c: Column | str, size: int = 20, overlap: int = 5) -> Column:
    """A chunk at every step of size - overlap; the last may lie inside the one before."""
    step = size - overlap
    return _windows(_c(c), F.ceil(F.length(_c(c)) / step), size, step)


def sliding(c: Column | str, size: int = 180, overlap: int = 40) -> Column:
    """Like ``fixed``, but the chunk that reaches the end is the last; size 0 keeps the text whole."""
    text = _c(c)
    if size <= 0:
        return F.array(text)
    if overlap >= size:
        overlap = size // 4
    step = size - overlap
    count = F.when(F.length(text) == 0, 0).otherwise(1 + F.ceil(F.greatest(F.length(text) - size, F.lit(0)) / step))
    return _windows(text, count, size, step)


def _filled(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def sentences(c: Column | str, ends: str = "。！？\n") -> Column:
    """Cut at sentence ends, which are dropped."""
    return _filled(F.split(_c(c), f"[{ends}]"))


def kept_sentences(c: Column | str, ends: str = "。！？?") -> Column:
    """Cut after sentence ends, which stay."""
    return _filled(F.split(_c(c), f"(?<=[{ends}])\\s*"))


def paragraphs_capped(c: Column | str, most: int = 400, empty: str = "(空文件)") -> Column:
    """A chunk for each line, long ones cut; a text without lines gives ``empty``."""
    cut = F.flatten(F.transform(_filled(F.split(_c(c), "\n")), lambda line: _windows(line, F.ceil(F.length(line) / most), most, most)))
    return let(cut, lambda chunks: F.when(F.size(chunks) > 0, chunks).otherwise(F.array(F.lit(empty))))


def _by_text(cut: Callable[[str], list[str]], c: Column | str) -> Column:
    """``cut`` over each text, in Arrow batches: a pass over its parts, where a fold over columns would copy what it has at each."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def chunks(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else cut(t))

    return chunks(_c(c))


def packed_lines(c: Column | str, most: int = 300) -> Column:
    """Lines joined to chunks of ``most`` characters, breaks included; a longer line is a chunk, and none begins with an empty line.

    The last line of a chunk is looked up among the places where lines end.
    """

    def cut(text: str) -> list[str]:
        lines = text.split("\n")
        ends = [0, *accumulate(len(line) + 1 for line in lines)]
        chunks, at = [], 0
        while at < len(lines):
            stop = at + 1
            if lines[at]:
                stop = max(stop, bisect_right(ends, ends[at] + most + 1) - 1)
                chunks.append("\n".join(lines[at:stop]))
            at = stop
        return chunks

    return _by_text(cut, c)


def packed_sentences(c: Column | str, most: int = 180, overlap: int = 40, ends: str = "。！？?") -> Column:
    """Sentences joined by spaces up to ``most`` characters; the next chunk opens with the last ``overlap`` of this one and a sentence.

    A first sentence longer than a chunk is cut, and what is past the cut, with the overlap, opens the next.  How many
    sentences follow an opening is looked up among the places where sentences end.
    """
    end = re.compile(f"(?<=[{re.escape(ends)}])\\s*")

    def cut(text: str) -> list[str]:
        sentences = [s for s in map(str.strip, end.split(text)) if s]
        places = [0, *accumulate(len(s) + 1 for s in sentences)]
        chunks, at, opening = [], 0, ""

        def fitting() -> int:
            return max(at, bisect_right(places, places[at] + most - len(opening)) - 1)

        while opening or at < len(sentences):
            if not opening:
                opening, at = sentences[at], at + 1
                if len(opening) > most:
                    chunks.append(opening[:most])
                    opening = opening[max(0, most - overlap) :] if overlap else ""
                    continue
            stop = fitting()
            if stop > at and opening[0].isspace():  # what a cut has left loses its spaces where something follows
                opening = opening.lstrip()
                stop = fitting()
            chunks.append(" ".join([opening, *sentences[at:stop]]))
            opening = f"{chunks[-1][-overlap:] if overlap else ''} {sentences[stop]}".strip() if stop < len(sentences) else ""
            at = stop + 1
        return chunks

    return _by_text(cut, c)


#: Words of sentences about attendance; lines that open a chunk.
ATTENDANCE = ("請假", "遲到", "面談", "考核", "緊急")
HEADER = r"^第.*章|^\d+\."


def by_topic(c: Column | str, keywords=ATTENDANCE, ends: str = "。！？", mark: str = "。") -> Column:
    """Neighbouring sentences with, or without, a keyword joined; each ends in ``mark``."""
    end = re.compile(f"[{re.escape(ends)}]")

    def cut(text: str) -> list[str]:
        runs: list[list[str]] = []
        label = None
        for one in filter(None, map(str.strip, end.split(text))):
            now = any(k in one for k in keywords)
            if now != label:
                runs.append([])
                label = now
            runs[-1].append(one + mark)
        return ["".join(r) for r in runs]

    return _by_text(cut, c)


def by_rules(c: Column | str, header: str = HEADER) -> Column:
    """A new chunk at each line that matches ``header``; the lines of a chunk are joined by spaces."""
    opens = re.compile(header)

    def cut(text: str) -> list[str]:
        runs: list[list[str]] = []
        for line in filter(None, map(str.strip, text.split("\n"))):
            if not runs or opens.search(line):
                runs.append([])
            runs[-1].append(line)
        return [" ".join(" ".join(r).split()) for r in runs]

    return _by_text(cut, c)


def token_windows(c: Column | str, size: int = 100, overlap: int = 20) -> Column:
    """Windows of ``size`` white-space tokens; a short text stays whole."""
    words = F.filter(F.split(_c(c), f"{WS}+"), lambda w: w != "")
    step = size - overlap

    def windows(w: Column) -> Column:
        last = F.ceil(F.greatest(F.size(w) - size, F.lit(0)) / step).cast("int")
        some = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(w, i * step + 1, F.lit(size)), " "))
        return F.when(F.size(w) > 0, some).otherwise(F.array().cast("array<string>"))

    return let(words, windows)
