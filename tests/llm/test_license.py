import re

from conftest_llm import EDGES, FOLDER, frame

from grainwise.llm import license
from grainwise.llm.queries import QUERIES

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def base(text):
    words = WORD.findall(lower(text))
    found = [(i, label) for phrase, label in license.PHRASES for i in range(len(words)) if words[i: i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in found]
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found})))


def check(docs, got):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in got.collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base(texts[r["doc_id"]])
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1 and (r["score"] == 1 or not r["base_labels"])


def test_base_places_on_edges(llm):
    texts = [*EDGES, "CC-BY cc by cc by", "GNU General\nPublic  License, mit license MIT LICENSE", "ccby mitlicense", "é cc by é"]
    docs = frame(llm, texts)
    check(docs, license.scan(docs))
    assert license.scan(docs.limit(0)).count() == 0


def test_edited_notices_are_found_with_their_spans(llm):
    texts = ["under the GNU Genral Publc License v3", "Mozila Public Licence 2.0", "Redistribution and use in sorce and binary form with", "a plain sentence about public life",
             "the apache licence", "Permission is hereby granted, free of charge, to any persons obtaining copy of"]
    rows = {r["doc_id"]: r for r in license.scan(frame(llm, texts)).collect()}
    assert [rows[i]["labels"] for i in range(6)] == ["gpl", "mpl", "bsd", "", "apache", "mit"]
    assert [(s["first"], s["until"], s["edits"]) for s in rows[0]["spans"]] == [(2, 6, 2)]
    assert all(0 < rows[i]["score"] < 1 for i in (0, 1, 2, 4, 5)) and rows[3]["score"] == 0


def test_seeds_cover_the_phrase():
    for _, words, edits in license.NOTICES:
        pieces = license.seeds(words, edits)
        assert len(pieces) == edits + 1 and b"".join(p for _, p in pieces) == words.encode()


def test_query(llm):
    check(llm.read.parquet(f"{FOLDER}/documents.parquet"), QUERIES["op2_license_scan"](llm, FOLDER))
