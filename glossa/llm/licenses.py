"""Licence scans: an Aho-Corasick automaton finds notice phrases and identifier tags; a shunting-yard parser evaluates the tags' expressions.

Base phrases give the contract's places and labels. The method adds further
notice phrases and the identifiers of ``SPDX-License-Identifier:`` expressions.
An expression is evaluated to the way of satisfying it that restricts least: OR
takes its less restrictive side, AND both sides, WITH joins an exception to its
licence. That way gives the labels; a document's `named` has all identifiers
that its expressions name, `required` those of every way, and `n_ways` says how
many ways the expression with most of them offers. Each of these is one number
or set a sub-expression, so evaluation is linear in an expression's length.
Scanning is map-only and takes whole texts.

Defined cases: a null text is empty; without any label the score is 0 and the
label strings are empty; a malformed expression gives the identifiers that it
names, at a lower strength, and requires none; rows are kept one for one,
repeated ids too; very long texts are read once, hits and all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bytescan as B
from .common import batch, documents, map_arrow

BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notice phrases beyond the base ones: label and how strongly the phrase marks a licence.
NOTICES = {
    "apache license version 2 0": ("apache-2.0", 0.95),
    "apache license": ("apache", 0.8),
    "mit license": ("mit", 0.9),
    "permission is hereby granted free of charge": ("mit", 0.9),
    "mozilla public license": ("mpl", 0.9),
    "bsd license": ("bsd", 0.8),
    "redistribution and use in source and binary forms": ("bsd", 0.9),
    "lesser general public license": ("lgpl", 0.95),
    "affero general public license": ("agpl", 0.95),
    "gnu general public license": ("gpl", 0.95),
    "creative commons attribution": ("cc-by", 0.9),
    "creative commons": ("cc", 0.6),
    "cc by sa": ("cc-by-sa", 0.9),
    "cc by nc": ("cc-by-nc", 0.9),
    "cc by nd": ("cc-by-nd", 0.9),
    "cc0": ("cc0", 0.8),
    "public domain": ("public-domain", 0.5),
    "eclipse public license": ("epl", 0.9),
    "the unlicense": ("unlicense", 0.8),
    "proprietary and confidential": ("proprietary", 0.8),
}
BASE_STRENGTH = 0.7
TAG = "spdx license identifier"
_TAG = re.compile(r"SPDX-License-Identifier[ \t]*:[ \t]*([^\r\n]*)", re.IGNORECASE)
_TOKEN = re.compile(r"\s*(\(|\)|[A-Za-z0-9.+:-]+)")
_PRECEDENCE = {"OR": 1, "AND": 2, "WITH": 3}


class Malformed(ValueError):
    pass


def tokens(expression: str) -> list[str]:
    """Tokens from the expression's start up to the first that cannot belong to it."""
    out, at = [], 0
    while m := _TOKEN.match(expression, at):
        t = m[1]
        operand = bool(out) and (out[-1] == ")" or out[-1] not in ("(", *_PRECEDENCE))
        if operand and t not in (")", *_PRECEDENCE) and t.upper() not in _PRECEDENCE:
            break
        out.append(t.upper() if t.upper() in _PRECEDENCE else t)
        at = m.end()
    return out


def postfix(infix: list[str]) -> list[str]:
    """Shunting-yard: WITH binds before AND, AND before OR; all to the left."""
    out, stack, operand = [], [], False
    for t in infix:
        if t == "(":
            if operand:
                raise Malformed(t)
            stack.append(t)
        elif t == ")":
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack or not operand:
                raise Malformed(t)
            stack.pop()
        elif t in _PRECEDENCE:
            if not operand:
                raise Malformed(t)
            while stack and stack[-1] != "(" and _PRECEDENCE[stack[-1]] >= _PRECEDENCE[t]:
                out.append(stack.pop())
            stack.append(t)
        else:
            if operand:
                raise Malformed(t)
            out.append(t)
        if t != "(":
            operand = t not in _PRECEDENCE
    while stack:
        if stack[-1] == "(":
            raise Malformed("(")
        out.append(stack.pop())
    if not operand:
        raise Malformed("no operand at the end")
    return out


#: Families of identifiers by how much they restrict: permissive, weak copyleft, strong copyleft; others restrict most.
_FAMILIES = (
    ("MIT", "Apache", "BSD", "0BSD", "ISC", "Zlib", "X11", "BSL", "CC0", "CC-BY-1", "CC-BY-2", "CC-BY-3", "CC-BY-4", "Unlicense", "WTFPL", "Python", "PSF", "PostgreSQL", "NCSA"),
    ("LGPL", "MPL", "EPL", "CDDL", "CPL", "CC-BY-SA", "OFL", "EUPL"),
    ("GPL", "AGPL", "SSPL", "OSL"),
)
MOST_WAYS = 1 << 62


def restriction(identifier: str) -> int:
    """How much a licence restricts, from 0; one with an exception at most as a weak copyleft."""
    name, _, exception = identifier.upper().partition(" WITH ")
    own = next((k for k, family in enumerate(_FAMILIES) if any(name == f.upper() or name.startswith((f"{f.upper()}-", f"{f.upper()}.")) for f in family)), len(_FAMILIES))
    return min(own, 1) if exception else own


@dataclass(frozen=True)
class Terms:
    """What an expression means: the way that restricts least, all identifiers, those of every way, and how many ways there are."""

    chosen: frozenset[str]
    named: frozenset[str]
    required: frozenset[str]
    ways: int

    def weight(self) -> tuple[int, int]:
        """What OR prefers less of: the worst restriction, then the number of licences; equal sides are taken as written."""
        return max(map(restriction, self.chosen)), len(self.chosen)


def evaluate(expression: str) -> Terms:
    """An expression's meaning; ways are counted up to MOST_WAYS, repeats among them each."""
    stack: list[Terms] = []
    for t in postfix(tokens(expression)):
        if t not in _PRECEDENCE:
            one = frozenset([t])
            stack.append(Terms(one, one, one, 1))
            continue
        right, left = stack.pop(), stack.pop()
        if t == "OR":
            stack.append(Terms(min(left, right, key=Terms.weight).chosen, left.named | right.named, left.required & right.required, min(left.ways + right.ways, MOST_WAYS)))
        elif t == "AND":
            stack.append(Terms(left.chosen | right.chosen, left.named | right.named, left.required | right.required, min(left.ways * right.ways, MOST_WAYS)))
        else:
            if len(left.named) != 1 or len(right.named) != 1 or left.ways != 1 or right.ways != 1 or " WITH " in next(iter(left.named)):
                raise Malformed("WITH")
            one = frozenset([f"{next(iter(left.named))} WITH {next(iter(right.named))}"])
            stack.append(Terms(one, one, one, 1))
    return stack[0]


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for phrase in dict.fromkeys([*BASE, *NOTICES, TAG]):
        a.add_word(f" {phrase} ", phrase)
    a.make_automaton()
    return a


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("named", pa.string()), ("required", pa.string()), ("n_ways", pa.int64())])
_SQL = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, named string, required string, n_ways long"
_LENGTH = {p: len(f" {p} ") for p in [*BASE, *NOTICES, TAG]}
_TAG_STRENGTH, _MALFORMED_STRENGTH = 0.98, 0.5


def _joined(labels) -> str:
    return ",".join(sorted({x.lower() for x in labels}))


class _Found:
    """What one text's hits add up to."""

    def __init__(self) -> None:
        self.places, self.base, self.strength = [], set(), {}
        self.named, self.required, self.ways = set(), set(), 0

    def add(self, label: str, strength: float) -> None:
        self.strength[label] = max(strength, self.strength.get(label, 0))

    def tag(self, expression: str) -> None:
        try:
            terms = evaluate(expression)
        except Malformed:
            named = {t for t in tokens(expression) if t not in ("(", ")", *_PRECEDENCE)}
            terms, strength = Terms(frozenset(named), frozenset(named), frozenset(), 0), _MALFORMED_STRENGTH
        else:
            strength = _TAG_STRENGTH
        for x in terms.chosen:
            self.add(x.lower(), strength)
        self.named |= terms.named
        self.required |= terms.required
        self.ways = max(self.ways, terms.ways)

    def row(self) -> tuple:
        score = 1.0
        for _, s in sorted(self.strength.items()):
            score *= 1 - s
        return len(self.places), min(self.places, default=None), max(self.places, default=None), _joined(self.base), _joined(self.strength), 1 - score if self.strength else 0.0, _joined(self.named), _joined(self.required), self.ways


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = _automaton()
    for piece in B.chunks(batches):
        words, text = B.scan(piece.column("text")), piece.column("text")
        counts = words.counts()
        rows = []
        for d in range(piece.num_rows):
            found = _Found()
            if counts[d]:
                a, z = int(words.doc[d]), int(words.doc[d + 1])
                starts = words.start[a:z] - words.start[a]
                # One character a byte, so that places in the text are those of its bytes; phrases are ASCII.
                body = " " + words.data[words.start[a] : words.end[z - 1] + 1].tobytes().decode("latin-1")
                tagged = False
                for end, phrase in automaton.iter(body):
                    if phrase in BASE:
                        found.places.append(int(np.searchsorted(starts, end - _LENGTH[phrase] + 1)))
                        found.base.add(BASE[phrase])
                        found.add(BASE[phrase], BASE_STRENGTH)
                    if phrase in NOTICES:
                        found.add(*NOTICES[phrase])
                    tagged |= phrase == TAG
                if tagged:
                    for m in _TAG.finditer(text[d].as_py()):
                        found.tag(m[1])
            rows.append(found.row())
        yield batch(_SCHEMA, piece.column("doc_id"), counts, *map(list, zip(*rows, strict=True)))


def license_scan(docs: DataFrame) -> DataFrame:
    """Per document row: doc_id, n_words, base places (n_base, first_word, last_word), base_labels, labels of all methods, score, and the expressions' named, required and n_ways.

    The score is the chance that a licence notice is there if its signs are taken as independent.
    """
    return map_arrow(documents(docs), _scan, _SQL)
