"""Licence scans against plain matching."""

import re

import pytest

from weirflow.llm import licences

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def by_hand(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places = sorted(i for p in licences.BASE for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    line = f" {' '.join(words)} "
    labels = {v for p, v in licences.BASE.items() if f" {p} " in line}
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), labels | {v for p, v in licences.NOTICES.items() if f" {p} " in line}


def test_against_plain_matching(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in licences.op3_licences(spark, sf_dir).collect():
        want = by_hand(texts[r.doc_id])
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want[:5]
        assert set(filter(None, r.labels.split(","))) >= want[5] and 0 <= r.score <= 1


def test_odd_texts(spark):
    rows = [
        (1, None), (2, ""), (3, "Under the MIT-License; under  THE mit license under the mit license"), (4, "thunder the mit license"), (5, "Licensed under the Apache License, Version 2.0. CC BY-NC 4.0"),
        (6, "apache license version 20"), (None, "cc by nc"), (8, "é under\nthe\tMIT license " + "w " * 100_000 + "CC-BY-NC"), (8, "cc by nc"),
    ]
    got = licences.scan_documents(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, score string")).collect()
    for (i, t), r in zip(rows, got, strict=True):
        want = by_hand(t)
        assert (r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (i, *want[:5])
    assert (got[2].n_base, got[2].first_word, got[2].last_word) == (3, 0, 8) and got[7].last_word == 100_005
    assert licences.scan_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize(
    ("text", "rpn", "ok"),
    [
        ("MIT", "MIT", True), ("MIT OR GPL-2.0", "MIT GPL-2.0 OR", True), ("MIT and GPL-2.0", "MIT GPL-2.0 AND", False), ("GPL-2.0 OR MIT AND BSD-3-Clause", "GPL-2.0 MIT BSD-3-Clause AND OR", True),
        ("(GPL-2.0 OR MIT) AND GPL-3.0", "GPL-2.0 MIT OR GPL-3.0 AND", False), ("Apache-2.0 WITH LLVM-exception OR GPL-2.0", "Apache-2.0 LLVM-exception WITH GPL-2.0 OR", True),
        ("MIT OR", "MIT", True), ("MIT) trailing", "MIT", True), ("(MIT", "", False), ("OR MIT", "", False), ("((MIT))", "MIT", True), ("MIT Apache-2.0", "MIT", True),
    ],
)
def test_expressions(text, rpn, ok):
    assert " ".join(licences.parse(text)) == rpn and licences.permitted(licences.parse(text)) == ok


def test_tags():
    machine = licences.automaton()
    row = licences.scan("/* SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0 */\nx", machine)
    assert row[5] == "apache-2.0,gpl-2.0-only,mit" and row[6] == 1.0 and row[8] is False
    row = licences.scan("# spdx-license-identifier: ISC\n# SPDX-License-Identifier: Zlib\n", machine)
    assert row[5] == "isc,zlib" and row[7] == "ISC;Zlib" and row[8] is True
    assert licences.scan("SPDX license identifier, whatever that is", machine)[5] == ""


def test_expressions_of_any_length_and_several_in_a_line():
    machine = licences.automaton()
    names = [f"licence-with-a-long-name-{i:04d}" for i in range(5000)]
    row = licences.scan(f"SPDX-License-Identifier: {' OR '.join(names)} OR", machine)
    assert row[5].split(",") == names and row[7].split() == [names[0], *[x for n in names[1:] for x in (n, "OR")]]
    tag = "SPDX-License-Identifier:"
    for text, want in (
        (f"{tag} MIT for {tag} Apache-2.0 and so on", ["MIT", "Apache-2.0 so AND"]), (f"{tag} MIT AND {tag}Zlib", ["MIT", "Zlib"]), (f"{tag} {tag} ISC", ["ISC"]),
        (f"{tag} (MIT {tag} ISC) {tag} 0BSD", ["ISC", "0BSD"]), (f"{tag} MIT\nOR ISC", ["MIT"]), (f"{tag}\nMIT", []),
    ):
        assert licences.scan(text, machine)[7] == ";".join(want)
    assert licences.scan(f"{tag} MIT " * 20_000, machine)[7] == ";".join(["MIT"] * 20_000) and licences.scan(f"{tag} {'(' * 200_000}MIT", machine)[7] == ""
    assert licences.identifiers(licences.parse(" OR ".join(["GPL-2.0 WITH x"] * 50_000))) == ["gpl-2.0"] * 50_000


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("SPDX-License-Identifier : MIT", "MIT"), ("spdx-license-identifier\t:MIT", "MIT"), ("SPDX-License-Identifier\n: MIT", ""), ("SPDX License-Identifier: MIT", ""), ("SPDX--License-Identifier: MIT", ""),
        ("xSPDX-License-Identifier: MIT", ""), ("é SPDX-License-Identifier: MIT", "MIT"), ("SPDX-License-Identifier-Text: MIT", ""), ("SPDX license identifier; SPDX-License-Identifier: ISC", "ISC"),
        ("SPDX-License-Identifier: MIT AND\tZlib ; SPDX-License-Identifier:ISC", "MIT Zlib AND;ISC"),
    ],
)
def test_places_of_tags(text, want):
    assert licences.scan(text, licences.automaton())[7] == want
