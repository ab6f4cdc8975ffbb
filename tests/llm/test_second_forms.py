"""Operators 2 and 3 written a second time, row by row: labels and scores by regular expressions, the estimation over texts."""

import math
import re

import pytest
from pyspark.sql import functions as F

from brindle.llm import licences, quality

LICENCE = r"(?:MIT(?:-0)?|Apache-(?:1\.[01]|2\.0)|BSD-[234]-Clause|(?:L|A)?GPL-[123]\.[01](?:-only|-or-later)?|CC-BY(?:-NC)?-4\.0|CC0-1\.0|ISC|MPL-2\.0)"


def expected(text):
    """Labels and score of a text whose tags are single identifiers, or two joined by OR or AND."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({i: i + 32 for i in range(65, 91)}))
    line, labels, free = f" {' '.join(words)} ", set(), []
    for phrase, label in (licences.BASE | licences.NOTICES).items():
        if f" {phrase} " in line:
            labels.add(label)
            free.append(licences.FREEDOM[label])
    for m in re.finditer(r"(?i)spdx[^\w\n]*license[^\w\n]*identifier[^\w\n]*([^\n]*)", text):
        found = re.match(rf"({LICENCE})\b(?:\s+(OR|AND)\s+({LICENCE})\b)?", m[1], re.IGNORECASE)
        if found:
            names = [licences.family(x) for x in (found[1], found[3]) if x]
            labels |= set(names)
            worth = [licences.FREEDOM.get(n, 0.2) for n in names]
            free.append(max(worth) if (found[2] or "").upper() == "OR" else min(worth))
    return ",".join(sorted(labels)), min(free, default=0.0)


def test_labels_and_scores(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    more = ["// SPDX-License-Identifier: MIT OR GPL-2.0-only\ncode", "# SPDX-License-Identifier: Apache-2.0 AND BSD-3-Clause",
        "SPDX-License-Identifier: MIT with the following changes", "All Rights Reserved. Public domain", "SPDX License Identifier: apache-77.3"]
    rows = docs.unionByName(spark.createDataFrame([(-1 - i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    texts = {r.doc_id: r.text or "" for r in rows.collect()}
    got = {r.doc_id: (r.labels, r.score) for r in licences.licences(rows).collect()}
    assert got == {i: expected(t) for i, t in texts.items()}
    assert got[-1] == ("gpl,mit", 0.95) and got[-2] == ("apache-2,bsd", 0.9) and got[-3] == ("mit", 0.95) and got[-5] == ("", 0.0)


def votes(m):
    """Each rule's vote on one text's measures: 1, -1 or 0."""
    words, lines, chars = max(m["n_words"], 1), max(m["n_lines"], 1), max(m["word_chars"], 1)

    def vote(good, bad):
        return -1 if bad else 1 if good else 0

    symbols, density, marked, size = m["n_symbols"] / words, m["n_symbols"] / chars, m["n_marked_lines"] / lines, m["word_chars"] / words
    repeated, again, ended, variety = m["n_repeat_words"] / words, m["n_dup_lines"] / lines, m["n_ended_lines"] / lines, m["n_distinct_words"] / words
    digits, layout = m["n_digits"] / chars, m["n_words"] / lines
    return [
        vote(m["n_words"] >= 50, m["n_words"] < 10), vote(symbols < 0.02 and density < 0.004, symbols > 0.1 or density > 0.025), vote(marked == 0,
            marked > 0.3), vote(2.5 <= size <= 9, size < 2 or size > 12),
        vote(repeated < 0.05, repeated > 0.2), vote(again == 0, again > 0.3), vote(ended > 0.9, ended < 0.5), vote(variety > 0.25, variety < 0.1),
            vote(digits < 0.1, digits > 0.3), vote(layout >= 5, layout < 2),
    ]


def estimated(rows):
    """Expectation-maximisation over texts, one vote after another: each text's probability of being good."""
    n, rules = len(rows), range(len(rows[0]))
    good = [0.1 if -1 in r else 0.9 for r in rows]
    clip = lambda x, low, high: min(max(x, low), high)
    for _ in range(200):
        on_good, on_bad = [], []
        for k in rules:
            spoke = [i for i in range(n) if rows[i][k]]
            g, b = sum(good[i] for i in spoke), sum(1 - good[i] for i in spoke)
            on_good.append(clip((sum(good[i] for i in spoke if rows[i][k] == 1) + 1.6) / (g + 2), 0.55, 0.99))
            on_bad.append(clip((sum(1 - good[i] for i in spoke if rows[i][k] == -1) + 1) / (b + 2), 1 - on_good[-1], 0.99))
        share = clip((sum(good) + 1.8) / (n + 2), 0.01, 0.99)
        new = []
        for r in rows:
            odds = math.log(share / (1 - share))
            for k in rules:
                odds += math.log(on_good[k] / (1 - on_bad[k])) if r[k] == 1 else math.log((1 - on_good[k]) / on_bad[k]) if r[k] == -1 else 0
            new.append(1 / (1 + math.exp(-clip(odds, -50, 50))))
        moved, good = max(abs(a - b) for a, b in zip(good, new)), new
        if moved < 1e-9:
            break
    return good


@pytest.mark.parametrize("where", ["true", "doc_id % 3 = 0"])
def test_kept_is_what_the_estimation_says(spark, data, where):
    docs = spark.read.parquet(f"{data}/documents.parquet").where(where)
    rows = [r.asDict() for r in quality.quality(docs).collect()]
    failed = [r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"] for r in rows]
    assert [r["base_failed"] for r in rows] == failed
    left = [r for r, f in zip(rows, failed) if not f]
    want = estimated([votes(r) for r in left])
    assert all(abs(r["quality"] - w) < 1e-6 for r, w in zip(left, want))
    assert [r["kept"] for r in left] == [w >= 0.5 for w in want] and not any(r["kept"] for r, f in zip(rows, failed) if f)
    assert quality.keep_good(docs).select(F.count("*")).first()[0] == sum(w >= 0.5 for w in want)
