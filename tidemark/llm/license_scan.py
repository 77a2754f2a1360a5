"""License scan: phrases by Aho-Corasick, expressions by a shunting yard.

A text becomes its words (see ``common.word_bytes``) joined by single
blanks. One Aho-Corasick automaton then finds every notice phrase, at word
bounds, in one pass. Where the identifier tag occurs, the rest of its line
in the raw text is parsed as a licence expression (``and`` binds tighter
than ``or``, ``with`` tighter than both, parentheses allowed), giving the
licences it names and how free the terms are: ``and`` takes the stricter
side, ``or`` the freer one, an exception moves half the way to free.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import word_bytes

# Phrases that count as the base, with their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Further notice phrases, their labels and how sure they are.
NOTICE_PHRASES = {
    "gnu general public license version 2": ("gpl-2", 0.9),
    "gnu general public license version 3": ("gpl-3", 0.9),
    "gnu lesser general public license": ("lgpl", 0.9),
    "gnu affero general public license": ("agpl", 0.9),
    "gnu general public license": ("gpl", 0.8),
    "mozilla public license": ("mpl", 0.8),
    "eclipse public license": ("epl", 0.8),
    "boost software license": ("bsl", 0.8),
    "licensed under the apache license": ("apache", 0.8),
    "permission is hereby granted free of charge": ("mit", 0.9),
    "redistribution and use in source and binary forms": ("bsd", 0.9),
    "under the bsd license": ("bsd", 0.8),
    "this is free and unencumbered software": ("unlicense", 0.9),
    "creative commons attribution": ("cc-by", 0.7),
    "creative commons zero": ("cc0", 0.8),
    "cc by sa": ("cc-by-sa", 0.7),
    "all rights reserved": ("proprietary", 0.5),
}
# How free the terms of a licence family are, from 0 to 1.
FREEDOM = {
    "mit": 1.0, "bsd": 1.0, "apache": 1.0, "isc": 1.0, "zlib": 1.0, "bsl": 1.0, "cc0": 1.0, "unlicense": 1.0, "cc-by": 0.9,
    "mpl": 0.7, "epl": 0.7, "lgpl": 0.6, "cc-by-sa": 0.5, "gpl": 0.4, "agpl": 0.3, "cc-by-nc": 0.2, "proprietary": 0.0,
}
TAG = "spdx license identifier"
#: How sure a tag is that names a known licence, or only an unknown word.
TAG_SURE, UNKNOWN_SURE = 1.0, 0.3
_TAG_LINE = re.compile(r"SPDX-License-Identifier\s*:[ \t]*([^\r\n]*)", re.IGNORECASE | re.ASCII)
_PART = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+:-]*")
_BINDS = {"or": 1, "and": 2, "with": 3}


class ExpressionError(ValueError):
    """The text isn't a licence expression."""


def to_postfix(expression: str) -> list[str]:
    """Shunting yard: operands and operators in postfix order.

    Parsing stops before the first part that cannot continue the
    expression, as a comment's end or prose may follow on the line.
    """
    out: list[str] = []
    stack: list[str] = []
    operand_next, depth, complete = True, 0, (0, 0)
    parts = _PART.findall(expression)
    for i, part in enumerate(parts):
        word = part.lower()
        if operand_next:
            if part == "(":
                stack.append(part)
                depth += 1
            elif part == ")" or word in _BINDS:
                break
            else:
                out.append(part)
                operand_next = False
        elif part == ")":
            if not depth:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
            depth -= 1
        elif word in _BINDS:
            while stack and stack[-1] != "(" and _BINDS[stack[-1]] >= _BINDS[word]:
                out.append(stack.pop())
            stack.append(word)
            operand_next = True
        else:
            break
        if not operand_next and not depth:
            complete = (i + 1, 1)
    if operand_next or depth:
        # Whole up to an earlier point, such as "MIT or" at a line's end.
        if not complete[1]:
            raise ExpressionError(expression)
        return to_postfix(" ".join(parts[: complete[0]]))
    while stack:
        out.append(stack.pop())
    return out


def family(name: str) -> str:
    """Licence id -> label: lower case, without a minor version or suffix."""
    name = re.sub(r"-(only|or-later)$|\+$", "", name.lower())
    name = re.sub(r"^bsd-.*|^0bsd$", "bsd", name)
    name = re.sub(r"-(\d+)(\.\d+)*(-.*)?$", r"-\1", name)
    return name if name.startswith(("gpl", "apache")) else re.sub(r"-\d+$", "", name)


def freedom(label: str) -> float:
    return FREEDOM.get(label, FREEDOM.get(re.sub(r"-\d+$", "", label), 0.0))


def known(label: str) -> bool:
    return label in FREEDOM or re.sub(r"-\d+$", "", label) in FREEDOM


def evaluate(expression: str) -> tuple[set[str], float]:
    """Labels that the expression names, and how free its terms are."""
    stack: list[tuple[set[str], float]] = []
    for part in to_postfix(expression):
        if part not in _BINDS:
            label = family(part)
            stack.append(({label}, freedom(label)))
            continue
        (right, r), (left, l) = stack.pop(), stack.pop()
        if part == "with":  # the right side names an exception, not a licence
            stack.append((left, (1 + l) / 2))
        else:
            stack.append((left | right, max(l, r) if part == "or" else min(l, r)))
    return stack.pop()


class LicenseScanner:
    """The automaton and its answers for one text."""

    def __init__(self, base: dict[str, str] | None = None, notices: dict[str, tuple[str, float]] | None = None):
        import ahocorasick

        self.base = BASE_PHRASES if base is None else base
        self.notices = NOTICE_PHRASES if notices is None else notices
        self.automaton = ahocorasick.Automaton()
        for phrase in {*self.base, *self.notices, TAG}:
            self.automaton.add_word(f" {phrase} ", (phrase, phrase.count(" ") + 1))
        self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple:
        words = word_bytes(text)
        joined = (b" " + b" ".join(words) + b" ").decode("latin-1") if words else ""
        places, base_labels, labels, sure, value, tagged = [], set(), set(), 0.0, None, False
        # Hits come by their end: blanks are counted on from the last one.
        blanks = upto = 0
        for end, (phrase, n) in self.automaton.iter(joined) if joined else ():
            if phrase in self.base:
                blanks, upto = blanks + joined.count(" ", upto, end), end
                places.append(blanks - n)
                base_labels.add(self.base[phrase])
                sure = max(sure, 0.9)
            elif phrase == TAG:
                tagged = True
            else:
                label, how_sure = self.notices[phrase]
                labels.add(label)
                sure = max(sure, how_sure)
        labels |= base_labels
        # A versioned label says more than the bare family found inside it.
        labels -= {x for x in labels - base_labels if any(y.startswith(f"{x}-") and y[len(x) + 1 :].isdigit() for y in labels)}
        if labels:
            value = min(map(freedom, labels))
        for m in _TAG_LINE.finditer(text) if tagged else ():
            try:
                named, free = evaluate(m[1])
            except ExpressionError:
                continue
            labels |= named
            sure = max(sure, TAG_SURE if any(map(known, named)) else UNKNOWN_SURE)
            value = free if value is None else min(value, free)
        first, last = (min(places), max(places)) if places else (None, None)
        return len(words), len(places), first, last, ",".join(sorted(base_labels)), ",".join(sorted(labels)), sure, value


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, freedom double"


def scan_licenses(docs: DataFrame, base: dict[str, str] | None = None, notices: dict[str, tuple[str, float]] | None = None) -> DataFrame:
    """One row per document: words, base phrases and all licence labels.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored, null
    ids stay, null text is the empty text (no words, no labels, score 0),
    repeated rows give repeated results. ``score`` is how sure the scan is
    that a licence is stated; ``freedom`` (null if none is) how free the
    strictest stated terms are. Works row by row without a shuffle.
    """
    kept = docs.select("doc_id", "text")
    schema = T.StructType([kept.schema["doc_id"], *T.StructType.fromDDL(SCHEMA).fields])

    def run(batches: Iterable):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        target, scanner = to_arrow_schema(schema), LicenseScanner(base, notices)
        for batch in batches:
            found = [scanner.scan(t.as_py()) for t in batch.column(1)]
            columns = list(zip(*found)) or [()] * 8
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(c, f.type) for c, f in zip(columns, list(target)[1:])], schema=target)

    return kept.mapInArrow(run, schema)
