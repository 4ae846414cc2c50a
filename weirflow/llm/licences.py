"""Licence scans: Aho-Corasick over words, a shunting-yard parser for licence expressions.

Texts are lower-cased (A-Z) and cut into words (digits, letters and all that is not ASCII); one automaton
then finds notice phrases and the identifier tag in the words joined by single spaces, each with a space
on both sides, so phrases are whole words.  The tag's first word gives its place in the raw text; it counts if
its words stand there with single hyphens and a colon behind them (blanks before the colon are allowed).  Behind
the colon stands a licence expression of
AND, OR, WITH and parentheses; it is turned to postfix (WITH binds tightest, then AND, then OR) and
evaluated: an expression is permitted if OR has a permitted side, AND two, WITH its licence.  A malformed
expression gives the longest well-formed beginning; a tag inside what was read counts for nothing, and a line
may hold several.  An expression ends with its line and before the next tag, and has no other limit of length.

``score``: 1 with a tag's expression, 0.9 with a base phrase, 0.6 with another phrase, else 0.  Defined
cases: null and empty texts have no words and score 0; whole texts are read however long; ids and
repeated rows pass as they are; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame

# Phrases and labels of the base, and those of this scan.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "released into the public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
TAG = "spdx license identifier"
PERMITTED = ("mit", "apache", "bsd", "isc", "cc0", "cc-by-4", "cc-by-3", "zlib", "unlicense", "bsl", "mpl")
# End of fixed values.

WORDS = bytes(32 if (c < 0x30 or 0x3A <= c <= 0x40 or 0x5B <= c <= 0x60 or 0x7B <= c <= 0x7F) else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
#: What may stand between the words of a tag, and behind the last.
JOINT, COLON = b"-", re.compile(rb"[\t ]*:")
WORD = re.compile(rb"[^ ]+")
PIECE = re.compile(rb"[\t\x0b\x0c ]*([()]|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
TAG_WORDS = [x.encode() for x in TAG.split(" ")]
RANK = {"OR": 1, "AND": 2, "WITH": 3}
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions string, permitted boolean"


def pieces(text: bytes, at: int = 0, stop: int | None = None) -> Iterator[tuple[str, int]]:
    """Operators, parentheses and identifiers with their ends, up to ``stop`` or the first other character."""
    while m := PIECE.match(text, at, len(text) if stop is None else stop):
        word, at = m[1].decode(), m.end()
        yield word.upper() if word.upper() in RANK else word, at


def postfix(tokens: list[str]) -> list[str] | None:
    """Shunting yard; None if the expression is malformed."""
    out, stack, want = [], [], True
    for t in tokens:
        if t == "(":
            if not want:
                return None
            stack.append(t)
        elif t == ")":
            if want:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        elif t in RANK:
            if want:
                return None
            while stack and stack[-1] != "(" and RANK[stack[-1]] >= RANK[t]:
                out.append(stack.pop())
            stack.append(t)
            want = True
        else:
            if not want:
                return None
            out.append(t)
            want = False
    if want or "(" in stack:
        return None
    return out + stack[::-1]


def parse_at(text: bytes, at: int, stop: int | None = None) -> tuple[list[str], int]:
    """Postfix of the longest well-formed expression at ``at`` and its end; empty if there is none."""
    tokens, whole, end_of, depth, want = [], 0, at, 0, True
    for t, end in pieces(text, at, stop):
        # Where an operand is wanted stands a licence or "(", else an operator or ")".
        if want != (t == "(" or t != ")" and t not in RANK) or t == ")" and not depth:
            break
        tokens.append(t)
        depth += (t == "(") - (t == ")")
        want = t == "(" or t in RANK
        if not want and not depth:
            whole, end_of = len(tokens), end
    return postfix(tokens[:whole]) or [], end_of


def parse(text: str) -> list[str]:
    """Postfix of the longest well-formed beginning of ``text``; empty if there is none."""
    return parse_at(text.encode("utf-8", "surrogatepass"), 0)[0]


def tags(raw: bytes, low: bytes, numbers: list[int]) -> list[tuple[int, int]]:
    """(start, end) in ``raw`` of the tags whose first words have these numbers (ascending).

    ``low`` is the text with all that is no word as blanks, byte for byte.
    """
    found, words, n, first = [], WORD.finditer(low), -1, None
    for number in numbers:
        while n < number:
            first, n = next(words), n + 1
        at = first.start()
        for part in TAG_WORDS[:-1]:
            at += len(part)
            if raw[at : at + 1] != JOINT:
                break
            at += 1
        else:
            if colon := COLON.match(raw, at + len(TAG_WORDS[-1])):
                found.append((first.start(), colon.end()))
    return found


def expressions(raw: bytes, places: list[tuple[int, int]]) -> list[list[str]]:
    """Postfix of the expression behind each tag."""
    found, done = [], 0
    starts = [start for start, _ in places]
    for (start, end), stop in zip(places, [*starts[1:], len(raw)], strict=False):
        if start >= done:
            got, done = parse_at(raw, end, stop)
            if got:
                found.append(got)
    return found


def permitted(rpn: list[str]) -> bool:
    stack: list[bool] = []
    for t in rpn:
        if t in RANK:
            b, a = stack.pop(), stack.pop()
            stack.append(a or b if t == "OR" else a and b if t == "AND" else a)
        else:
            stack.append(t.lower().startswith(PERMITTED))
    return bool(stack) and stack[0]


def identifiers(rpn: list[str]) -> list[str]:
    """Licences of an expression, without the exceptions behind WITH."""
    stack, found = [], Counter()
    for t in rpn:
        if t in RANK:
            b, a = stack.pop(), stack.pop()
            if t == "WITH" and found[b]:
                found[b] -= 1
            stack.append(a)
        else:
            found[t.lower()] += 1
            stack.append(t.lower())
    return list(found.elements())


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for phrase, label in (NOTICES | BASE).items():
        a.add_word(f" {phrase} ", (phrase, label))
    a.add_word(f" {TAG} ", (TAG, ""))
    a.make_automaton()
    return a


def scan(text: str | None, machine) -> tuple:
    """All columns but the id."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    low = raw.translate(WORDS)
    words = low.split()
    line = f" {b' '.join(words).decode('latin-1')} "
    hits, base, labels, at, n = [], set(), set(), 0, 0
    for end, (phrase, label) in machine.iter(line):
        if phrase in BASE or phrase == TAG:
            hits.append((end - len(phrase), phrase == TAG))  # of the phrase's first character
        if phrase in BASE:
            base.add(label)
        labels.add(label)
    places, tagged = [], []
    for first, tag in sorted(hits):
        n += line.count(" ", at, first)
        at = first
        (tagged if tag else places).append(n - 1)
    found = expressions(raw, tags(raw, low, tagged)) if tagged else []
    for e in found:
        labels.update(identifiers(e))
    labels.discard("")
    allowed = all(map(permitted, found)) if found else all(x.startswith(PERMITTED) for x in labels) if labels else None
    score = 1.0 if found else 0.9 if base else 0.6 if labels else 0.0
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, ";".join(" ".join(e) for e in found), allowed


def _run(batches: Iterator) -> Iterator:
    import pyarrow as pa

    machine = automaton()
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string(), pa.bool_()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for batch in batches:
        rows = [scan(x.as_py(), machine) for x in batch.column(1)]
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=names)


def scan_documents(docs: DataFrame) -> DataFrame:
    """One row per document."""
    return docs.select("doc_id", "text").mapInArrow(_run, SCHEMA)


def op3_licences(spark, sf_dir: str) -> DataFrame:
    return scan_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op3_licences": op3_licences}
SQL: dict[str, str] = {}
