import re
import time

import pytest

from nearpath.llm.license_scan import BASE_PHRASES, NOTICES, Scanner, license_scan, notices

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    """The base columns, word by word."""
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places, labels = [], set()
    for phrase, label in BASE_PHRASES.items():
        parts = phrase.split()
        for i in range(len(words) - len(parts) + 1):
            if words[i:i + len(parts)] == parts:
                places.append(i)
                labels.add(label)
    return (len(words), len(places), min(places, default=None), max(places, default=None),
            ",".join(sorted(labels)))


@pytest.fixture(scope="module")
def scanner():
    return Scanner(BASE_PHRASES, notices(NOTICES, 12))


def test_base_columns(make_docs, odd_rows):
    rows = odd_rows + [
        (100, "CC BY cc-by CC.BY, ccby cc by cc by"), (101, "all rights reserved all rights reserved"),
        (102, "xGeneral Public License general public licensed GENERAL  public\nLICENSE é"),
        (103, "all rights\x7freserved all rights éreserved"),
    ]
    got = license_scan(make_docs(rows, extra="labels score n_words")).collect()
    assert sorted(repr((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"],
                        r["base_labels"])) for r in got) == sorted(
        repr((i, *plain(t))) for i, t in rows)
    for row in got:
        assert set(filter(None, row["base_labels"].split(","))) <= set(row["labels"].split(","))
        assert 0 <= row["score"] <= 1


def test_whole_table(spark, sf_dir):
    from nearpath.llm.queries import op2_license_scan

    texts = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    for r in op2_license_scan(spark, sf_dir).collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain(
            texts[r["doc_id"]])


@pytest.mark.parametrize("text,label", [
    ("Licensed under the Apache Licence, Version 2.0", "apache-2.0"),
    ("permision is herby granted free of charge to any person", "mit"),
    ("Redistribution and use in sourse and binary forms", "bsd"),
    ("released under teh MIT license", "mit"),
])
def test_notices_with_errors(scanner, text, label):
    found = scanner.scan(f"some words before {text} and after")
    assert label in found["labels"].split(",")
    assert 0.8 < found["score"] < 1


def test_too_many_errors(scanner):
    assert scanner.scan("licensed wonder they apple licking verse in 2 0")["labels"] == ""
    assert scanner.scan("mozzarella publish licenses")["labels"] == ""


def test_every_single_edit_is_found(scanner):
    notice = "redistribution and use in source and binary forms"
    for i in range(len(notice)):
        for edited in (notice[:i] + notice[i + 1:], notice[:i] + "q" + notice[i + 1:]):
            assert "bsd" in scanner.scan(edited)["labels"], edited


def test_empty_table(make_docs):
    assert license_scan(make_docs([])).count() == 0


def test_a_megabyte_of_phrases(scanner):
    started = time.time()
    found = scanner.scan("cc by " * 170_000)
    assert time.time() - started < 20
    assert found["n_words"] == 340_000 and found["n_base"] == 170_000
    assert found["first_word"] == 0 and found["last_word"] == 339_998
