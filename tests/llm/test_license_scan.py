import random
import re

import pytest

from tidemark.llm import license_scan as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    places, labels = [], set()
    for phrase, label in L.BASE_PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


CASES = [
    None, "", "...", "Under the MIT\n\nLicense", "under the mit licenses", "xunder the mit license", "é under, the_mit-license É",
    "cc by nc cc by nc by nc", "CC BY-NC 4.0 and Apache License, Version 2.0", "under the mit license " * 3000, "İ ſ under the mit license",
]


def test_base_matches_brute_force():
    scanner, rng = L.LicenseScanner(), random.Random(3)
    parts = "under the mit license apache version 2 cc by nc é ß . , - _ \n X".split(" ")
    for text in CASES + [" ".join(rng.choices(parts, k=200)) for _ in range(200)]:
        assert scanner.scan(text)[:5] == brute(text), text


@pytest.mark.parametrize(("text", "labels", "free"), [
    ("MIT", {"mit"}, 1.0),
    ("MIT OR GPL-3.0-only", {"mit", "gpl-3"}, 1.0),
    ("MIT AND GPL-3.0-only", {"mit", "gpl-3"}, 0.4),
    ("MIT OR GPL-2.0-only AND Apache-2.0", {"mit", "gpl-2", "apache-2"}, 1.0),
    ("(MIT OR GPL-2.0-only) AND CC-BY-NC-4.0", {"mit", "gpl-2", "cc-by-nc"}, 0.2),
    ("GPL-2.0-or-later WITH Classpath-exception-2.0", {"gpl-2"}, 0.7),
    ("BSD-3-Clause */ int main", {"bsd"}, 1.0),
    ("MIT or", {"mit"}, 1.0),
])
def test_expressions(text, labels, free):
    named, value = L.evaluate(text)
    assert named == labels and value == pytest.approx(free)


@pytest.mark.parametrize("bad", ["", "AND", "()", "(MIT", "*/", "OR MIT"])
def test_not_expressions(bad):
    with pytest.raises(L.ExpressionError):
        L.evaluate(bad)


def test_labels_and_scores():
    scan = L.LicenseScanner().scan
    assert scan("GNU General Public License, version 3.")[5:7] == ("gpl-3", 0.9)
    assert scan("// SPDX-License-Identifier: (MIT OR Apache-2.0)\nunder the MIT license")[4:] == ("mit", "apache-2,mit", 1.0, 1.0)
    assert scan("plain prose")[4:] == ("", "", 0.0, None)


def test_operator(spark):
    rows = [(1, t, "s") for t in CASES] + [(None, "cc by nc", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = L.scan_licenses(docs).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_base, str(r.first_word), str(r.last_word), r.base_labels) for r in got) == sorted((str(i), a, b, str(c), str(d), e) for i, t, _ in rows for a, b, c, d, e in [brute(t)])
    assert L.scan_licenses(docs.limit(0)).count() == 0
