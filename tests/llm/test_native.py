from collections import Counter

import brute
import pytest

from veridect.llm.licenses import scan_licenses
from veridect.llm.quality import clean_lines

QUALITY = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
LICENSE = ["n_words", "n_base", "first_word", "last_word", "base_labels"]


def same(result, source, columns, plain):
    got = Counter((r["doc_id"], *(r[c] for c in columns)) for r in result.collect())
    want = Counter((r["doc_id"], *plain(r["text"])) for r in source.select("doc_id", "text").collect())
    assert got == want


@pytest.mark.parametrize("name", ["docs", "odd", "empty"])
def test_quality_base(request, name):
    source = request.getfixturevalue(name)
    same(clean_lines(source), source, QUALITY, brute.quality)


def test_quality_lines(spark):
    prose = "The council met on Monday and agreed to repair the old bridge before the winter sets in again."
    more = "Work starts in June, when the river is low, and will take about ten weeks in total."
    rows = [
        (1, "\n".join([prose, more, "Home | About | Contact | Login"])),
        (2, "\n".join([prose, "Home | About | News | More | Login | Help | Shop | Map | Jobs | Team | Press | Blog | Terms | Media | Events | Contact | Careers | Archive"])),
        (3, "\n".join([prose, more, "We use cookies on this site. Read more.", "Menu"])),
    ]
    out = {r["doc_id"]: r for r in clean_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1]["kept"] and out[1]["n_lines_removed"] == 1 and "Home" not in out[1]["clean_text"]
    assert not out[2]["kept"] and not out[2]["base_failed"]
    assert out[3]["kept"] and out[3]["n_lines_removed"] == 2


@pytest.mark.parametrize("name", ["docs", "odd", "empty"])
def test_license_base(request, name):
    source = request.getfixturevalue(name)
    same(scan_licenses(source), source, LICENSE, brute.license_base)


def test_license_labels(odd):
    out = {r["doc_id"]: r for r in scan_licenses(odd).collect()}
    assert out[1]["labels"] == "mit,proprietary" and out[1]["score"] == 1.0
    assert out[10]["labels"] == "gpl-3" and out[10]["base_labels"] == ""
    assert out[2]["labels"] == "" and out[2]["score"] == 0.0
    assert out[None]["labels"] == "cc-by-nc,mit"
