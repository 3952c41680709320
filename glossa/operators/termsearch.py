"""All terms of a paper found in one pass over its text.

The terms that a paper's candidates are looked up by go into one automaton (a trie with failure links) of their
letters and digits. It runs over the text without everything else, with a map back to places: each hit is a term
whose letters follow each other, and what stands between and around them in the text decides whether it counts. So
the work grows with the text and its hits, not with text times terms, and the rows are those of evidence.ground().
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from .evidence import snippet

_ALNUM = re.compile("[A-Za-z0-9]")
_BETWEEN = re.compile(r"[ \t\n\x0b\f\r\-_/.()]*\Z")
_LEAD = 80
_TAIL = 220


def _lower(text: str) -> str:
    """ASCII letters in lower case, all else as it is."""
    return "".join(c.lower() if c < "\x80" else c for c in text) if not text.isascii() else text.lower()


def _bare(c: str) -> bool:
    return not (c.isascii() and c.isalnum())


class _Terms:
    """A paper's terms, by the lower-cased letters and digits that they have."""

    def __init__(self, terms: list[str]) -> None:
        import ahocorasick

        self.automaton, self.by = ahocorasick.Automaton(), {}
        for t in terms:
            letters = "".join(_ALNUM.findall(_lower(t)))
            if letters:
                self.by.setdefault(letters, []).append(t)
        for letters in self.by:
            self.automaton.add_word(letters, letters)
        if self.by:
            self.automaton.make_automaton()
        self.rest = {t: re.compile(C.COMPOUND_PREFIXES[t.upper()], re.I) for t in terms if t.upper() in C.COMPOUND_PREFIXES}

    def _stands(self, term: str, text: str, a: int, z: int) -> bool:
        """Whether what is around text[a:z] lets it be the term."""
        if (a and not _bare(text[a - 1])) or (z < len(text) and not _bare(text[z])):
            return False
        return not (term in self.rest and self.rest[term].match(text, z))

    def search(self, text: str) -> dict[str, tuple[int, int]]:
        """Each found term's first place (from 1) and size: as it is written if it stands so anywhere, else with separators between its letters."""
        place = [m.start() for m in _ALNUM.finditer(text)]
        exact: dict[str, tuple[int, int]] = {}
        spread: dict[str, tuple[int, int]] = {}
        if not self.by or not place:
            return {}
        low = _lower(text)
        for end, letters in self.automaton.iter("".join(low[p] for p in place)):
            first, last = place[end - len(letters) + 1], place[end]
            for t in self.by[letters]:
                if t not in exact:
                    at = next(m.start() for m in _ALNUM.finditer(t))
                    a, z = first - at, first - at + len(t)
                    if a >= 0 and low[a:z] == _lower(t) and self._stands(t, text, a, z):
                        exact[t] = a + 1, len(t)
                if t not in spread and len(letters) >= 3 and self._stands(t, text, first, last + 1):
                    own = place[end - len(letters) + 1 : end + 1]
                    if all(b - a == 1 or _BETWEEN.match(text[a + 1 : b]) for a, b in zip(own, own[1:], strict=False)):
                        spread[t] = first + 1, last + 1 - first
        return spread | exact


_FOUND = "pmid string, k long, term string, around string, at int, size int"


def _found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for r in b.itertuples(index=False):
            text = r.text or ""
            asked = [(int(x["k"]), [t for t in (str(t).strip() for t in (x["terms"] if x["terms"] is not None else []) if t is not None) if t]) for x in r.asked]
            hits = _Terms(sorted({t for _, ts in asked for t in ts})).search(text)
            for k, ts in asked:
                term = next((t for t in ts if t in hits), None)
                if term is not None:
                    at, size = hits[term]
                    begin = max(0, at - 1 - _LEAD)
                    out.append((r.pmid, k, term, text[begin : at - 1 + size + _TAIL], at - begin, size))
        yield pd.DataFrame(out, columns=["pmid", "k", "term", "around", "at", "size"])


def find_terms(asked: DataFrame, texts: DataFrame, id_column: str = "pmid") -> DataFrame:
    """Per row of asked (id, k, terms) whose paper's text names one of its terms: the first such term and a snippet (id, k, term, snippet).

    Each text is read once, with all that is asked of its paper; papers without text, and terms without a letter or digit, find nothing.
    """
    per = asked.select(F.col(id_column).cast("string").alias("pmid"), F.struct("k", "terms").alias("x")).groupBy("pmid").agg(F.collect_list("x").alias("asked"))
    whole = texts.select(F.col(id_column).cast("string").alias("pmid"), "text").where("text IS NOT NULL").join(per, "pmid")
    hits = whole.select("pmid", "text", "asked").mapInPandas(_found, _FOUND)
    return hits.select(F.col("pmid").alias(id_column), "k", "term", snippet(F.col("around"), F.col("at"), F.col("size")).alias("snippet"))


def ground_in_one_pass(candidates: DataFrame, texts: DataFrame, id_column: str = "pmid") -> DataFrame:
    """Candidates (with terms) that their paper's text names, with match and snippet, as evidence.ground() gives them for a text."""
    numbered = candidates.withColumn("k", F.xxhash64(*candidates.columns))
    hits = find_terms(numbered.select(id_column, "k", "terms").distinct(), texts, id_column)
    met = numbered.join(hits, [id_column, "k"]).drop("k")
    return met.withColumnsRenamed({"term": "grounding_match", "snippet": "grounding_snippet"}).withColumn("grounding_source", F.lit("paper_text"))
