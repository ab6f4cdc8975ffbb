"""Token ids of whole texts, by the tokenizers library, with worker-side caches.

A text is cut at spaces into pieces that the library would tokenise alike on their own; a piece already
met in this Python worker comes from its cache.  A new piece is cut into the vocabulary's pre-tokens, and
the library's model encodes those that are new.  Where cutting could change a result (special strings,
rare characters) the library gets the whole text or piece.
"""

from __future__ import annotations

import os
import re
from array import array
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

from .common import give_back, tokenizer_path  # noqa: E402

_SPACES = re.compile(r"\s")
#: White space as Unicode has it; characters that other tables take for white space, or once did.
_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECES = re.compile(rf"[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]?[^{_WHITE}]+|[{_WHITE}]")
_UNSURE = re.compile("[\x1c-\x1f\x85\u180e\u200b\u2060\ufeff]")
#: Characters whose classes and lower case are the same in every version of Unicode.
_PLAIN = re.compile(r"[ -~¡-¬®-ɏ]+")
_MARKS = frozenset(".,;:!?")
#: Bytes of each generation of a cache; what an entry takes beside its characters; the longest key that is kept.
CACHE_BYTES, ENTRY, LONGEST = 16 << 20, 110, 64
#: Words of batches that a worker knows at the start of a batch; words in one call of the library.
WORDS, AT_ONCE = 200_000, 50
#: A space among the vocabulary's letters; marks that a word may end with; words whose lower case every table has alike.
_SPACE, _TAIL, _SIMPLE = "Ġ", ".,;:!?#*$%&|<>()-", "^[A-Za-zª-įı-ɏ]+$"
#: How the byte-level vocabularies, and the one with word ends, split a text.
_BYTE_LEVEL = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_WORD_ENDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a vocabulary: itself if it prints, else the next above 255."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(rest)}


def joins_spaces(text: str) -> bool:
    """Whether white space is anything but single spaces and line breaks between words."""
    if not text or not text.replace("\n", "").isprintable() and _SPACES.search(text.replace(" ", "").replace("\n", "")):
        return bool(text)
    return "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n"


def spaced_pieces(text: str) -> list[str]:
    """Pieces of a text with any white space: a run is one piece, but for its last character, which goes with the word behind it."""
    out = []
    for p in _PIECES.findall(text):
        out.append(p[1:] if p[0] == " " and len(p) > 1 and p[1] not in _WHITE else p if p[0] == "\n" and len(p) > 1 and p[1] not in _WHITE else "\t" + p)
    return out


class Generations(dict):
    """A cache of ``limit`` to twice as many bytes, by estimate: when it is full, what isn't used again goes.

    Keys of more than LONGEST characters are made each time and never kept.
    """

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old, self.used = make, limit, {}, 0

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > LONGEST:
                return value
        self.used += ENTRY + 2 * len(key)
        if self.used > self.limit:
            self.old = dict(self)
            self.clear()
            self.used = 0
        self[key] = value
        return value

    def forget(self) -> None:
        self.clear()
        self.old, self.used = {}, 0


class Tiered(dict):
    """A table of values; what it hasn't comes from ``rest``."""

    def __init__(self, table: dict, rest: Generations):
        super().__init__(table)
        self.rest = rest

    def __missing__(self, key):
        return self.rest[key]


class WordTable:
    """Words and their ids, all in one array; above ``limit`` words, those that came back most often stay."""

    def __init__(self, limit: int):
        self.limit = limit
        self.forget()

    def forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.ids, self.sizes, self.hits = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def find(self, words: list[str]) -> np.ndarray:
        """The row of each word (all different), -1 for new ones.  Rows hold until the next call."""
        if len(self.sizes) > self.limit or len(self.ids) > 8 * self.limit:
            self._shrink()
        rows = np.fromiter(map(self.rows.get, words, repeat(-1)), np.int64, len(words))
        self.hits[rows[rows >= 0]] += 1
        return rows

    def add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The rows of new words, which are kept unless they have more than LONGEST characters."""
        rows = np.arange(len(self.sizes), len(self.sizes) + len(words))
        self.ids, self.sizes = np.concatenate((self.ids, ids)), np.concatenate((self.sizes, sizes))
        self.hits = np.concatenate((self.hits, np.zeros(len(words), np.int64)))
        self.rows.update(zip(words, rows.tolist()))
        for w in [w for w in words if len(w) > LONGEST]:
            del self.rows[w]
        return rows

    def _shrink(self) -> None:
        words, rows = list(self.rows), np.fromiter(self.rows.values(), np.int64, len(self.rows))
        best = np.argsort(-self.hits[rows], kind="stable")[: self.limit // 2]
        best = best[self.hits[rows[best]] > 0]
        kept, starts = rows[best], _starts(self.sizes)[:-1]
        sizes = self.sizes[kept]
        within = np.arange(int(sizes.sum())) - np.repeat(_starts(sizes)[:-1], sizes)
        self.ids, self.sizes, self.hits = self.ids[np.repeat(starts[kept], sizes) + within], sizes, self.hits[kept] // 2
        self.rows = {words[i]: n for n, i in enumerate(best.tolist())}


class PieceEncoder:
    """Pieces of texts and their values; ``value`` turns a list of ids into what is cached, ``join`` adds values up.

    A piece stands for itself with a space before it, where the vocabulary keeps spaces; the first
    piece of a line starts with "\\n" for a line that follows another, and with "\\t" for the first line.
    """

    def __init__(self, name: str, value, join, limit: int = CACHE_BYTES):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.library = Tokenizer.from_file(tokenizer_path(name))
        self.model = self.library.model
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.keeps_spaces = self.library.normalizer is None
        self.split = (_BYTE_LEVEL if self.keeps_spaces else _WORD_ENDS).findall
        self.letters = byte_letters()
        self.value, self.join = value, join
        self.tokens = self.misses = Generations(self._token, limit)
        self.cache = Generations(self._piece, limit)
        self.words = WordTable(WORDS)
        # words behind spaces, in the vocabulary's letters: their first tokens, and no others, start with that of the space
        self.speller, self.first = Tokenizer(self.model), None
        self.speller.pre_tokenizer = WhitespaceSplit()
        if self.keeps_spaces:
            self.first = np.zeros(self.library.get_vocab_size(), dtype=bool)
            self.first[[i for t, i in self.library.get_vocab().items() if t.startswith(_SPACE)]] = True

    def _token(self, pre: str):
        return self.value([t.id for t in self.model.tokenize(pre.encode().decode("latin-1").translate(self.letters))])

    def pre_tokens(self, piece: str) -> list[str] | None:
        """The pre-tokens of a piece; None: the library must split it."""
        # a word, and a word with one mark behind it, need no splitting
        head, word = (piece[0], piece[1:]) if self.keeps_spaces and piece[:1] in ("\n", "\t") else ("", piece)
        word, mark = (word[:-1], word[-1]) if word[-1:] in _MARKS else (word, "")
        if word.isalpha() and (word.isascii() or _PLAIN.fullmatch(word)):
            low = word.lower() if not self.keeps_spaces else word if head else " " + word
            if self.keeps_spaces or low.isalpha():
                return ["\n"] * (head == "\n") + [low] + [mark] * (mark != "")
        if self.keeps_spaces:
            text = piece[1:] if piece[:1] == "\t" else piece if piece[:1] == "\n" else " " + piece
            if text[:1] == "\n":
                if not text.strip("\n"):
                    return [text]
                if _PLAIN.fullmatch(text, 1):
                    return ["\n", *self.split(text[1:])]
        else:
            text = piece
        if not _PLAIN.fullmatch(text):
            return None
        return self.split(text if self.keeps_spaces else text.lower())

    def _piece(self, piece: str):
        if piece.isascii() and piece.isalpha():  # most pieces: the letters stand for themselves
            word, letters = (" " + piece, _SPACE + piece) if self.keeps_spaces else (piece.lower(),) * 2
            value = self.tokens.get(word)
            return self.value([t.id for t in self.model.tokenize(letters)]) if value is None else value
        parts = self.pre_tokens(piece)
        if parts is None:
            return self.whole(piece if not self.keeps_spaces else piece[1:] if piece[:1] == "\t" else piece if piece[:1] == "\n" else " " + piece)
        if len(parts) == 1:  # kept as a piece; no need to keep it twice
            value = self.tokens.get(parts[0])
            return self._token(parts[0]) if value is None else value
        return self.join(map(self.tokens.__getitem__, parts))

    def known(self, table: dict) -> None:
        """Pre-tokens are looked up in ``table`` first, and in the worker's cache where it hasn't them."""
        self.tokens = Tiered(table, self.misses)

    def whole(self, text: str):
        return self.value(self.library.encode(text, add_special_tokens=False).ids)

    def pieces(self, text: str) -> list[str] | None:
        """None: the text must go to the library whole."""
        for s in self.special:
            if s in text:
                return None
        if not self.keeps_spaces:
            return text.replace("\n", " ").split(" ")
        if joins_spaces(text):
            return None if _UNSURE.search(text) else spaced_pieces(text)
        return ("\t" + text).replace("\n", " \n").split(" ")

    def values(self, text: str):
        """Cached values of the text's pieces, in order."""
        pieces = self.pieces(text)
        return [self.whole(text)] if pieces is None else map(self.cache.__getitem__, pieces)

    def batch_ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a batch in one array, and where each text's begin (and the last one's end).

        Only for an encoder whose values are id_bytes.  The texts' pieces are told apart by Arrow, and words from the
        marks behind them, so that Python sees each different word of a batch once.
        """
        texts = texts.fill_null("")
        plain = [not any(s in t for s in self.special) and not (self.keeps_spaces and joins_spaces(t)) for t in texts.to_pylist()]
        some = texts.filter(pa.array(plain, pa.bool_()))
        if self.keeps_spaces:
            some = pc.replace_substring(pc.binary_join_element_wise("\t", some, ""), "\n", " \n")
        else:
            some = pc.replace_substring(some, "\n", " ")
        lists = pc.split_pattern(some, " ")
        named = lists.flatten().dictionary_encode()
        words, tails = self._parts(named.dictionary)
        rows = self._rows(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        marks, known = list(map(self.tokens.__getitem__, tails.dictionary.to_pylist())) + [b""], len(self.words.sizes)
        # each piece is a word and a tail; no tail is the last value
        of = np.empty((len(words), 2), dtype=np.int64)
        of[:, 0] = rows[words.indices.to_numpy()]
        of[:, 1] = tails.indices.fill_null(len(tails.dictionary)).to_numpy(zero_copy_only=False) + known
        sizes = np.concatenate((self.words.sizes, np.fromiter(map(len, marks), np.int64, len(marks)) // 4))
        flat = np.concatenate((self.words.ids, np.frombuffer(b"".join(marks), np.uint32)))
        lengths = sizes[of[:, 0]] + sizes[of[:, 1]]
        different = _lists(_lists(flat, sizes).take(pa.array(of.ravel())).flatten(), lengths)
        ids = different.take(named.indices).flatten().to_numpy()
        starts = _starts(lengths[named.indices.to_numpy()])[lists.offsets.to_numpy()] if len(some) else np.zeros(1, np.int64)
        if all(plain):
            return ids, starts
        parts, lengths, nth = [], [], 0
        for t, p in zip(texts, plain):
            parts.append(ids[starts[nth] : starts[nth + 1]] if p else np.frombuffer(b"".join(self.values(t.as_py())), np.uint32))
            lengths.append(len(parts[-1]))
            nth += p
        return np.concatenate(parts), _starts(np.array(lengths, np.int64))

    def _rows(self, words: list[str]) -> np.ndarray:
        """Where different pieces are in the table of words, after new ones have gone there."""
        rows = self.words.find(words)
        new = np.flatnonzero(rows < 0)
        kinds = np.fromiter((self._kind(words[i]) for i in new.tolist()), np.int8, len(new))
        for kind, encode in enumerate((self._others, self._spelled, self._spelled)):
            some = new[kinds == kind]
            these = [words[i] for i in some.tolist()]
            rows[some] = self.words.add(these, *encode(these))
        return rows

    def _kind(self, piece: str) -> int:
        """1: ASCII letters; 2: letters that are one pre-token with the space before them; 0: anything else."""
        if not piece.isalpha():
            return 0
        return 1 if piece.isascii() else 2 if self.keeps_spaces and _PLAIN.fullmatch(piece) else 0

    def _others(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        values = list(map(self._piece, pieces))
        return np.frombuffer(b"".join(values), np.uint32), np.fromiter(map(len, values), np.int64, len(values)) // 4

    def _spelled(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words of letters, one behind the other, and how many each has."""
        if self.first is not None and words:
            # all or none of the words are ASCII, whose letters stand for themselves
            spelled = words if words[0].isascii() else "\n".join(words).encode().decode("latin-1").translate(self.letters | {10: "\n"}).split("\n")
            lines = (_SPACE + f" {_SPACE}".join(spelled[at : at + AT_ONCE]) for at in range(0, len(words), AT_ONCE))
            ids = np.fromiter(chain.from_iterable(self.speller.encode_batch_fast([t], add_special_tokens=False)[0].ids for t in lines), np.uint32)
            starts = np.flatnonzero(self.first[ids])
            if len(starts) == len(words):
                return ids, np.diff(np.append(starts, len(ids)))
        if self.keeps_spaces:
            return self._others(words)
        lists = [[t.id for t in self.model.tokenize(w.lower())] for w in words]
        return np.fromiter(chain.from_iterable(lists), np.uint32), np.fromiter(map(len, lists), np.int64, len(lists))

    def _parts(self, pieces: pa.Array) -> tuple[pa.DictionaryArray, pa.DictionaryArray]:
        """The word that each piece is, and the marks behind it (else null), where that is all; else the piece itself."""
        words = pc.ascii_rtrim(pieces, characters=_TAIL)
        simple = pc.ascii_is_alpha(words).to_numpy(zero_copy_only=False)
        other = np.flatnonzero(~simple & ~pc.string_is_ascii(words).to_numpy(zero_copy_only=False))
        rest = words.take(pa.array(other))
        simple[other] = pc.and_(pc.utf8_is_alpha(rest), pc.match_substring_regex(rest, _SIMPLE)).to_numpy(zero_copy_only=False)
        simple = pa.array(simple)
        if not self.keeps_spaces:
            words = pc.utf8_lower(words)
        words = pc.if_else(simple, words, pieces)
        more = pc.subtract(pc.binary_length(pieces), pc.binary_length(words)).to_numpy()
        at = np.flatnonzero(more > 0) if len(more) else np.zeros(0, np.int64)
        found = [p[-n:] for p, n in zip(pieces.take(pa.array(at)).to_pylist(), more[at].tolist())]
        rows = np.full(len(pieces), -1, dtype=np.int64)
        rows[at] = np.arange(len(at))
        tails = pa.array(found, pa.string()).take(pa.array(rows, mask=rows < 0))
        return words.dictionary_encode(), tails.dictionary_encode()

    def forget(self) -> None:
        """Empties the caches, at the end of a task: a worker that is used again holds nothing meanwhile."""
        self.cache.forget()
        self.misses.forget()
        self.words.forget()
        self.tokens = self.misses
        give_back()


def _starts(sizes: np.ndarray) -> np.ndarray:
    """Where parts of such sizes begin, one behind the other, and the end."""
    return np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)))


def _lists(flat, sizes: np.ndarray) -> pa.LargeListArray:
    return pa.LargeListArray.from_arrays(pa.array(_starts(sizes)), flat if isinstance(flat, pa.Array) else pa.array(flat))


def id_bytes(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit ids."""
    return array("I", ids).tobytes()


_encoders: dict = {}


def id_encoder(name: str) -> PieceEncoder:
    """The encoder to ids of this Python worker."""
    if (name, "ids") not in _encoders:
        _encoders[name, "ids"] = PieceEncoder(name, id_bytes, b"".join)
    return _encoders[name, "ids"]


def length_encoder(name: str) -> PieceEncoder:
    """The encoder to numbers of ids of this Python worker."""
    if (name, "lengths") not in _encoders:
        _encoders[name, "lengths"] = PieceEncoder(name, len, sum, CACHE_BYTES)
    return _encoders[name, "lengths"]
