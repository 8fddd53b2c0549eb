"""Runs over one chosen file, listings of changed files, and the result of a run."""

from __future__ import annotations

import json

import pytest

from satchel.operators import layouts as L
from satchel.plans.export import Selection, export, prepare
from satchel.plans.settings import RunSettings

FILES = {"chosen.txt": b"the body", "sibling.txt": b"unrelated", "near/nested.txt": b"neighbour", "lib/a.min.js": b"small", "image.bin": b"\x00\x01",
         ".gitignore": b"*.log\nout/\n", "x.log": b"log", "out/y.txt": b"built"}


def text_of(files, settings, **options):
    return L.materialize(L.render(prepare(files, settings, **options), settings))["root"]


def test_only_the_chosen_file_is_listed_and_packed(corpus):
    files = corpus(FILES)
    text = text_of(files, RunSettings(), selection_=Selection(item="chosen.txt"))
    assert "the body" in text and "root/chosen.txt" in text and not any(x in text for x in ("sibling", "unrelated", "near", "Skipped"))
    data = json.loads(text_of(files, RunSettings(layout="json"), selection_=Selection(item="chosen.txt")))
    assert [f["path"] for f in data["fileList"]] == ["chosen.txt"] and "sibling" not in data["directoryStructure"]


def test_a_minified_file_may_be_chosen(corpus):
    files = corpus(FILES)
    pack = prepare(files, RunSettings(), selection_=Selection(item="/lib\\a.min.js"))
    assert [r.path for r in pack.files.collect()] == ["lib/a.min.js"] and pack.skipped.count() == 0
    # Directories above it are not listed.
    assert [r.path for r in pack.entries.collect()] == ["lib/a.min.js"]


@pytest.mark.parametrize("item, listed", [("image.bin", True), ("x.log", False), ("out/y.txt", False)])
def test_a_chosen_file_that_is_left_out_is_noted(corpus, item, listed):
    files = corpus(FILES)
    s = RunSettings(extensions=(".txt", ".log"))
    text = text_of(files, s, selection_=Selection(item=item))
    head, body = text.split("===== FILE CONTENTS (LEGIBLE ONLY) =====")
    assert body.strip().split("\r\n") == [L.ILLEGIBLE_NOTE, f"root/{item}"] and (f"root/{item}" in head) == listed


def test_an_unchanged_chosen_file_has_its_own_note(spark, corpus):
    files = corpus(FILES)
    changes = spark.createDataFrame([("root", "SIBLING.txt")], "corpus string, path string")
    s = RunSettings(only_changed=True)
    assert L.UNCHANGED_NOTE in text_of(files, s, changes=changes, selection_=Selection(item="chosen.txt"))
    assert "unrelated" in text_of(files, s, changes=changes, selection_=Selection(item="sibling.txt"))
    assert L.ILLEGIBLE_NOTE in text_of(files, s, changes=changes, selection_=Selection(item="image.bin"))


def test_a_missing_item_is_an_error(corpus):
    with pytest.raises(FileNotFoundError):
        prepare(corpus(FILES), RunSettings(), selection_=Selection(item="near"))


def test_directories_of_changed_files(spark, corpus):
    """Of a plain run those with something to pack; of a choice by hand all."""
    files = corpus({"a/x.txt": b"1", "b/y.bin": b"2", "c/z.txt": b"3"})
    changes = spark.createDataFrame([("root", "a/x.txt"), ("root", "b/y.bin")], "corpus string, path string")
    listed = lambda **o: sorted(r.path for r in prepare(files, RunSettings(only_changed=True), changes=changes, **o).entries.collect())
    assert listed() == ["a", "a/x.txt", "b/y.bin"]
    assert listed(selection_=Selection(mode="Basic")) == ["a", "a/x.txt", "b", "b/y.bin"]


def test_the_result_tells_what_took_effect(corpus, tmp_path):
    clean, found = corpus({"a.txt": b"plain"}), corpus({"a.txt": b"mail someone@mail.com", "b.txt": b"# coding: nonsense\n"})
    s = RunSettings(max_tokens=1, layout="markdown")
    row = export(clean, s, str(tmp_path / "1"), decision="Redact").first()
    assert (row.scan_mode, row.over_budget, row.n_files, row.n_omitted, row.n_errors) == ("Warn", True, 1, 0, 0)
    assert export(found, s, str(tmp_path / "2"), decision="Redact").first().scan_mode == "Redact"
    assert export(found, s, str(tmp_path / "3")).first().scan_mode == "Warn"
    assert export(found, s, str(tmp_path / "4"), decision="Cancel") is None and not (tmp_path / "4").exists()
    with pytest.raises(ValueError):
        export(clean, s, str(tmp_path / "5"), decision="Perhaps")
