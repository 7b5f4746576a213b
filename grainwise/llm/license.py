"""License scan: exact seeds by the pigeonhole principle, then bounded-error matching around them."""

from __future__ import annotations

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainwise.llm.common import per_text

# Phrases whose exact places are counted, with their labels (fixed values).
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
# Short notices that are also found with up to so many edits: (label, words, edits). A parameter of the call.
NOTICES = (
    ("gpl", "gnu general public license", 3), ("apache", "apache license", 1), ("mit", "mit license", 1),
    ("cc-by", "creative commons attribution", 3), ("cc-by", "creativecommons org licenses by", 2),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", 6),
    ("bsd", "redistribution and use in source and binary forms", 4), ("bsd", "bsd license", 1),
    ("mpl", "mozilla public license", 2), ("lgpl", "gnu lesser general public license", 3),
    ("agpl", "gnu affero general public license", 3), ("epl", "eclipse public license", 2),
    ("isc", "permission to use copy modify and or distribute this software", 5),
    ("unlicense", "released into the public domain", 3), ("reserved", "all rights reserved", 2),
)
_WORDS = bytes((b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32) for b in range(256))


def seeds(words: str, edits: int) -> list[tuple[int, bytes]]:
    """(offset, piece): the phrase in edits + 1 pieces, of which at most ``edits`` can be touched, so one stands unchanged."""
    raw, n = words.encode(), edits + 1
    at = [len(raw) * i // n for i in range(n + 1)]
    return [(a, raw[a:b]) for a, b in zip(at, at[1:], strict=False)]


def _scanner(phrases, notices):
    base = [(p.encode(), label) for p, label in phrases]
    fuzzy = []
    for label, words, edits in notices:
        pattern = regex.compile(rf"(?b)(?<!\S)(?:{regex.escape(words, literal_spaces=True)}){{e<={edits}}}(?!\S)")
        fuzzy.append((label, len(words.encode()), edits, pattern, seeds(words, edits)))

    def work(text: bytes) -> tuple:
        words = text.translate(_WORDS).split()
        line = b" ".join(words)
        padded = b" " + line + b" "
        starts, exact, best, spans = [], set(), 0.0, []
        for phrase, label in base:
            at = padded.find(b" " + phrase + b" ")
            while at >= 0:
                starts.append(padded.count(b" ", 0, at + 1) - 1)
                exact.add(label)
                spans.append((label, starts[-1], starts[-1] + phrase.count(b" ") + 1, 0))
                at = padded.find(b" " + phrase + b" ", at + 1)
        labels = set(exact)
        for label, size, edits, pattern, pieces in fuzzy:
            seen = []
            for offset, piece in pieces:
                at = line.find(piece)
                while at >= 0:
                    seen.append((max(0, at - offset - edits), min(len(line), at - offset + size + edits)))
                    at = line.find(piece, at + 1)
            done = -1
            for begin, end in _merged(seen):
                # Whole words around the candidate, so that the edges of the window are edges of words.
                begin = line.rfind(b" ", 0, begin + 1) + 1
                end = len(line) if (e := line.find(b" ", end)) < 0 else e
                window = line[begin:end].decode("utf-8", "replace")
                for m in pattern.finditer(window):
                    first = line.count(b" ", 0, begin + len(window[: m.start()].encode()))
                    if first <= done:
                        continue
                    done = first
                    labels.add(label)
                    errors = sum(m.fuzzy_counts)
                    best = max(best, 1 - errors / size)
                    if errors or label not in exact:
                        spans.append((label, first, first + m.group().count(" ") + 1, errors))
        return (len(words), len(starts), min(starts, default=None), max(starts, default=None), sorted(exact), sorted(labels),
                1.0 if exact else best, sorted(set(spans)))
    return work


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for begin, end in sorted(ranges):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [(a, b) for a, b in out]


def scan(docs: DataFrame, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans of every text.

    Words are runs of 0-9, a-z (A-Z lower-cased) and anything outside ASCII. ``spans`` holds (label, first word, end word,
    edits) of the exact places and of every notice within its edits; ``score`` is 1 for an exact phrase, else the share of
    the best notice that stands unchanged, else 0. A NULL or empty text has no words. One scan, no shuffle.
    """
    schema = ("n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_list array<string>, label_list array<string>, "
              "score double, spans array<struct<label:string,first:bigint,until:bigint,edits:bigint>>")
    found = per_text(docs, lambda: _scanner(phrases, notices), schema, raw=True)
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_list", ",").alias("base_labels"),
                        F.array_join("label_list", ",").alias("labels"), "score", "spans")
