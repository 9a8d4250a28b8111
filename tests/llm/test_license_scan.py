import re

from cohortlens.llm.license_rules import RULES, SENTENCES
from cohortlens.llm.license_scan import license_matches

HEADER = """Copyright 2020 Someone

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""


def found(frame):
    return sorted((r["doc_id"], r["rule"]) for r in license_matches(frame).collect())


def test_rules_name_known_sentences():
    assert {p for _, parts in RULES.values() for p in parts} <= set(SENTENCES)


def test_every_rule_is_found_in_its_own_sentences(docs_of):
    names = list(RULES)
    rows = [(i, "Some words before.\n" + ".\n".join(SENTENCES[p] for p in RULES[n][1]) + ".\nAnd after.") for i, n in enumerate(names)]
    matches = license_matches(docs_of(rows)).collect()
    got = {}
    for r in matches:
        got.setdefault(r["doc_id"], set()).add(r["license"])
    assert all(RULES[n][0] in got[i] for i, n in enumerate(names))


def test_ordered_sequences(docs_of):
    bsd = [SENTENCES[f"{p}-bsd"] for p in ("permission", "source", "binary", "endorse")]
    rows = [
        (1, HEADER), (2, ".\n".join(bsd)), (3, ".\n".join(bsd[:3])), (4, ".\n".join([bsd[2], bsd[1], bsd[0]])),
        (5, "released UNDER the mit licence!\nx"), (6, "I say released under the MIT License"),
        (7, bsd[0] + ".\n" + "word " * 100 + ".\n" + bsd[1] + ".\n" + bsd[2]),
        (8, "Released under the MIT License.\nReleased under the MIT License."),
    ]
    assert found(docs_of(rows)) == [
        (1, "apache-header"), (1, "apache-url"), (2, "bsd3-text"), (3, "bsd2-text"), (5, "mit-released"),
        (8, "mit-released"), (8, "mit-released"),
    ]


def test_against_plain_lines(spark, sf_dir):
    """In the given documents a licence is a line of its own."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    known = {" ".join(re.findall(r"[^\W_]+", s.lower())): n for n, s in SENTENCES.items()}
    single = {parts[0]: rule for rule, (_, parts) in RULES.items() if len(parts) == 1}
    expected = []
    for r in docs.collect():
        for line in (r["text"] or "").split("\n"):
            name = known.get(" ".join(re.findall(r"[^\W_]+", line.lower())))
            if name in single:
                expected.append((r["doc_id"], single[name]))
    assert found(docs) == sorted(expected) and expected


def test_awkward_rows(awkward, nothing, docs_of):
    assert license_matches(awkward).count() == 0
    assert license_matches(nothing).count() == 0
    assert [r["doc_id"] for r in license_matches(docs_of([(None, "MIT License"), (1, None)])).collect()] == [None]


def test_no_rules_match_nothing(docs_of):
    docs = docs_of([(1, "MIT License")])
    assert license_matches(docs, sentences={}, rules={}).count() == 0
    assert license_matches(docs, sentences={"none": " .. "}, rules={"empty": ("X", ["none"])}).count() == 0
