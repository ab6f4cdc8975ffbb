"""Operator 2: licence scans: an Aho-Corasick automaton finds tags and notices, a shunting-yard parser reads expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import pick

#: The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notice phrases beyond the base ones.
NOTICES = {
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "bsd license": "bsd",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "public domain": "public-domain",
    "boost software license": "bsl-1",
    "eclipse public license": "epl",
    "all rights reserved": "all-rights-reserved",
    "permission is hereby granted free of charge": "mit",
    "licensed under the apache license": "apache-2",
}
#: Words of a tag; the expression follows on its line.
TAG = "spdx license identifier"
#: How freely a text under a licence may be used, from 0 to 1; licences not named here: 0.2.
FREEDOM = {
    "cc0": 1.0, "public-domain": 1.0, "mit": 0.95, "bsd": 0.95, "isc": 0.95, "bsl-1": 0.95, "zlib": 0.95, "apache-2": 0.9, "cc-by": 0.9,
    "mpl": 0.7, "epl": 0.7, "lgpl": 0.6, "gpl": 0.5, "cc-by-sa": 0.5, "agpl": 0.4, "cc-by-nc": 0.3, "cc-by-nd": 0.3, "all-rights-reserved": 0.0,
}
_OTHER_FREEDOM, _EXCEPTION = 0.2, 0.1
#: A-Z to a-z, and every other ASCII character that is no digit or letter to a space.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.+\-]+")
_RANK = {"or": 1, "and": 2, "with": 3}
_SEPARATE = re.compile(rb"[^ ]+")
#: Identifiers of the public SPDX list without a version; families with theirs; families whose
#: versions may be followed by -only or -or-later; Creative Commons with theirs and their places' codes; BSD clauses.
_PLAIN = (
    "0bsd adsl afmparse aladdin antlr-pd apafml app-s2p beerware blessing clartistic curl dotseqn dsdp egenix eurosym fair fsfap fsful fsfullr ftl glide hpnd ibm-pibs icu ijg imatix imlib2 info-zip intel isc jpnic json "
    "latex2e leptonica libpng libpng-2.0 linux-openib mit mit-0 mit-cmu mit-advertising mit-feh mit-enna mitnfa motosoto mpich2 ms-pl ms-rl mtll multics naumen ncsa net-snmp netcdf newsletr ngpl nlpl noweb nrl ntp oml openssl plexus postgresql "
    "psfrag psutils qhull rdisc rsa-md rscpl ruby saxpath sendmail sleepycat smlnj snia swl tcl tcp-wrappers tmate tosl unicode-tou unlicense vim vostrom w3c wsuipa wtfpl x11 xerox xinetd xnet xpp xskat zed zlib zlib-acknowledgement"
)
_VERSIONS = {
    "afl": "1.1 1.2 2.0 2.1 3.0", "apache": "1.0 1.1 2.0", "apsl": "1.0 1.1 1.2 2.0", "artistic": "1.0 2.0", "blueoak": "1.0.0", "bsl": "1.0",
        "catosl": "1.1", "cc0": "1.0", "cddl": "1.0 1.1", "cecill": "1.0 1.1 2.0 2.1",
    "cern-ohl-p": "2.0", "cern-ohl-s": "2.0", "cern-ohl-w": "2.0", "cpal": "1.0", "cpl": "1.0", "cua-opl": "1.0", "ecl": "1.0 2.0", "efl": "1.0 2.0",
        "epl": "1.0 2.0", "erlpl": "1.1", "etalab": "2.0", "eupl": "1.0 1.1 1.2",
    "frameworx": "1.0", "jasper": "2.0", "lpl": "1.0 1.02", "lppl": "1.0 1.1 1.2 1.3a 1.3c", "mpl": "1.0 1.1 2.0", "mulanpsl": "1.0 2.0",
        "nasa": "1.3", "nbpl": "1.0", "nosl": "1.0", "npl": "1.0 1.1", "nposl": "3.0", "oclc": "2.0",
    "odbl": "1.0", "odc-by": "1.0", "ofl": "1.0 1.1", "oldap": "1.1 1.2 1.3 1.4 2.0 2.0.1 2.1 2.2 2.2.1 2.2.2 2.3 2.4 2.5 2.6 2.7 2.8",
        "osl": "1.0 1.1 2.0 2.1 3.0", "oset-pl": "2.1", "php": "3.0 3.01", "python": "2.0 2.0.1", "qpl": "1.0",
    "rpl": "1.1 1.5", "rpsl": "1.0", "sgi-b": "1.0 1.1 2.0", "simpl": "2.0", "sissl": "1.2", "spl": "1.0", "ucl": "1.0", "upl": "1.0", "vsl": "1.0",
        "watcom": "1.0", "ypl": "1.0 1.1", "zimbra": "1.3 1.4", "zpl": "1.1 2.0 2.1",
}
_OR_LATER = {"gpl": "1.0 2.0 3.0", "lgpl": "2.0 2.1 3.0", "agpl": "1.0 3.0", "gfdl": "1.1 1.2 1.3"}
_COMMONS, _COMMONS_VERSIONS = "cc-by cc-by-sa cc-by-nc cc-by-nd cc-by-nc-sa cc-by-nc-nd", "1.0 2.0 2.5 3.0 4.0"
_BSD = "1-clause 2-clause 2-clause-patent 2-clause-views 3-clause 3-clause-attribution 3-clause-clear 3-clause-lbnl 3-clause-modification 4-clause 4-clause-shortened 4-clause-uc"
#: Exceptions of the public SPDX list, which may follow with.
_EXCEPTIONS = frozenset(
    "389-exception autoconf-exception-2.0 autoconf-exception-3.0 bison-exception-2.2 bootloader-exception classpath-exception-2.0 clisp-exception-2.0 digirule-foss-exception ecos-exception-2.0 fawkes-runtime-exception fltk-exception "
    "font-exception-2.0 freertos-exception-2.0 gcc-exception-2.0 gcc-exception-3.1 gnu-javamail-exception gpl-3.0-linking-exception gpl-3.0-linking-source-exception gpl-cc-1.0 gstreamer-exception-2005 gstreamer-exception-2008 "
    "i2p-gpl-java-exception kicad-libraries-exception lgpl-3.0-linking-exception libtool-exception linux-syscall-note llvm-exception lzma-exception mif-exception ocaml-lgpl-linking-exception occt-exception-1.0 "
    "openjdk-assembly-exception-1.0 openvpn-openssl-exception ps-or-pdf-font-exception-20170817 qt-gpl-exception-1.0 qt-lgpl-exception-1.1 qwt-exception-1.0 shl-2.0 shl-2.1 swift-exception u-boot-exception-2.0 "
    "universal-foss-exception-1.0 wxwindows-exception-3.1".split()
)


def _identifiers() -> re.Pattern:
    one_of = lambda names: "(?:" + "|".join(map(re.escape, names.split())) + ")"
    kinds = [one_of(_PLAIN)] + [rf"{re.escape(f)}-{one_of(v)}" for f, v in _VERSIONS.items() if v] + [rf"{f}-{one_of(v)}(?:-only|-or-later)?" for f, v in _OR_LATER.items()]
    kinds += [rf"{one_of(_COMMONS)}-{one_of(_COMMONS_VERSIONS)}(?:-[a-z]{{2,3}})?", rf"bsd-{one_of(_BSD)}", r"licenseref-[a-z0-9.\-]+"]
    return re.compile("|".join(kinds))


_IDENTIFIER = _identifiers()


def family(identifier: str) -> str:
    """The label of a licence identifier: without version and choice suffixes."""
    name = identifier.lower().rstrip("+")
    name = re.sub(r"-(only|or-later)$", "", name)
    if name.startswith(("apache-2", "bsl-1")):
        return "apache-2" if name[0] == "a" else "bsl-1"
    if name.startswith("bsd-"):
        return "bsd"
    return re.sub(r"-\d+(\.\d+)*$", "", name)


def evaluate(text: str, start: int = 0, stop: int | None = None) -> tuple[set[str], float] | None:
    """Labels and freedom of a licence expression that begins at ``start``; None if there is none.

    Shunting-yard: with binds closer than and, and closer than or.  Or lets the user choose (the
    greater freedom counts), and binds to both (the lesser), with adds a little.  Reading ends at the
    first token that can't continue the expression, such as a word that is no identifier of a licence
    (_IDENTIFIER; LicenseRef- names too), or behind with no exception of the list; open brackets close there.
    """
    labels: set[str] = set()
    values: list = []
    marks: list[str] = []

    def apply(op: str) -> None:
        b, a = values.pop(), values.pop()
        values.append(max(a, b) if op == "or" else min(a, b) if op == "and" else min(1.0, a + _EXCEPTION))

    operand, after_with = True, False
    for m in _TOKEN.finditer(text, start, len(text) if stop is None else stop):
        token = m.group()
        low = token.lower()
        if operand:
            if token == "(" and not after_with:
                marks.append(token)
            elif token in "()" or low in _RANK:
                break
            else:
                low = low.rstrip(".-")
                if not (low in _EXCEPTIONS if after_with else _IDENTIFIER.fullmatch(low.rstrip("+"))):
                    break
                if after_with:
                    values.append(0.0)
                    labels.add(low)
                else:
                    name = family(low)
                    labels.add(name)
                    values.append(FREEDOM.get(name, _OTHER_FREEDOM))
                operand, after_with = False, False
        elif low in _RANK:
            while marks and marks[-1] != "(" and _RANK[marks[-1]] >= _RANK[low]:
                apply(marks.pop())
            marks.append(low)
            operand, after_with = True, low == "with"
        elif token == ")" and "(" in marks:
            while marks[-1] != "(":
                apply(marks.pop())
            marks.pop()
        else:
            break
    if operand:  # an operator without its right side is dropped
        while marks and marks[-1] == "(":
            marks.pop()
        if marks:
            marks.pop()
    while marks:
        op = marks.pop()
        if op != "(":
            apply(op)
    return (labels, values[-1]) if values else None


def automaton():
    """Every phrase between spaces, so that whole words match."""
    import ahocorasick

    found = ahocorasick.Automaton()
    phrases = {p: (True, v) for p, v in BASE.items()} | {p: (False, v) for p, v in NOTICES.items()} | {TAG: (False, None)}
    for phrase, (base, label) in phrases.items():
        found.add_word(f" {phrase} ", (len(phrase) + 1, base, label))
    found.make_automaton()
    return found


def scan(text: str, machine) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of one text."""
    plain = text.encode().translate(_WORDS)
    words = plain.split()
    line = f" {b' '.join(words).decode()} "
    n_base, first, last, base, labels, free = 0, None, None, set(), set(), []
    tags, seen, at = [], 0, 0  # at: the word that begins behind the space at place seen
    for end, (back, is_base, label) in machine.iter(line):
        if label is None or is_base:
            begin = end - back
            at += line.count(" ", seen, begin) if begin >= seen else -line.count(" ", begin, seen)
            seen = begin
        if label is None:
            tags.append(at + TAG.count(" "))
            continue
        labels.add(label)
        free.append(FREEDOM.get(label, _OTHER_FREEDOM))
        if is_base:
            n_base += 1
            first = at if first is None else min(first, at)
            last = at if last is None else max(last, at)
            base.add(label)
    if tags:  # the expression stands behind the tag's last word, on its line
        data, wanted, done, begin, stop = text.encode(), set(tags), 0, 0, -1
        for n, m in enumerate(_SEPARATE.finditer(plain)):
            if n in wanted:
                begin += len(data[done : m.end()].decode())
                done = m.end()
                if stop < begin:
                    stop = text.find("\n", begin)
                    stop = len(text) if stop < 0 else stop
                found = evaluate(text, begin, stop)
                if found:
                    labels |= found[0]
                    free.append(found[1])
    return len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), min(free, default=0.0)


def licences(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row of ``docs(doc_id, text)``.

    score: how freely the text may be used, the least of all that is found in it; 0 where nothing is found.
    A null text is an empty one: no words, null places, empty labels.  Repeated rows give repeated rows;
    null ids pass through; an empty table gives an empty one; other columns are ignored.
    """
    docs = pick(docs, "doc_id", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for b in batches:
            found = [scan(t.as_py() or "", machine) for t in b.column(1)]
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            columns = [pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(work, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences(spark.read.parquet(f"{sf_dir}/documents.parquet"))
