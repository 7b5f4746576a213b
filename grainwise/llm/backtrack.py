"""BPE with word ends by backtracking: longest token matches, a table of compatible pairs, decoding by offsets."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import pairwise

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainwise.llm.common import per_text

# A word's last letter carries the word end. In the spelling of a token it is the same letter, this far up.
LAST = 1 << 12
KNOWN_RUNS, KNOWN_BYTES, KNOWN_PAIRS = 400_000, 32 << 20, 2_000_000
DECODED = 1 << 16
# Letters below this are precomposed and have simple lower-case forms; signs that may trail a word.
LATIN, TRAILING = "\u0250", ".,!*$%&#|?;:"
NEVER = 1 << 60


class Merges:
    """The merges of a tokenizer file as three tables.

    ``rank`` gives the rank of a pair, ``parts`` the pair that a token is made of, ``shorter`` the longest other token that
    a token's spelling begins with. Tokens that the merges never leave standing by themselves cannot occur in any text
    and are left out. The machine finds the longest token that begins at a place; every single letter is one.
    """

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        spelt, self.parts, self.born, self.rank = {}, {}, {}, {}
        self.pairs: dict[tuple[int, int], bool] = {}
        for token, i in vocab.items():
            letters = token.removesuffix(suffix) if suffix and len(token) > len(suffix) else token
            if len(letters) == 1:
                spelt[i] = letters if letters == token else chr(ord(letters) + LAST)
                self.born[i] = -1
        known = dict.fromkeys(spelt.values())
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in merges]
        for at, (a, b) in enumerate(pairs):
            a, b, whole = vocab[a], vocab[b], vocab[a + b]
            self.rank[a, b] = at, whole
        for (a, b), (at, whole) in self.rank.items():
            # Merges come in the order of their ranks: a token exists if its parts do and nothing of a lower rank joins them first.
            if a in spelt and b in spelt and spelt[a] + spelt[b] not in known and self.compatible(a, b, at):
                spelt[whole], self.parts[whole], self.born[whole] = spelt[a] + spelt[b], (a, b), at
                known[spelt[whole]] = None
        by_spelling = {s: i for i, s in spelt.items()}
        self.length = {i: len(s) for i, s in spelt.items()}
        self.reach = max(self.length.values())
        self.shorter = {i: next((by_spelling[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in by_spelling), None) for i, s in spelt.items()}
        self.machine = ahocorasick.Automaton()
        for s, i in by_spelling.items():
            self.machine.add_word(s, i)
        self.machine.make_automaton()

    def compatible(self, a: int, b: int, before: int = NEVER) -> bool:
        """Whether no merge of a rank below ``before`` joins two neighbours across the border of ``a`` and ``b``.

        Looks back through the merges that made both tokens, the latest first. At each moment one token ends at the border
        and one begins there; a pair of a lower rank than the moment's end would have been merged. Of equal pairs the
        left one is merged first, so on the right side the moment's own rank counts too.
        """
        rank, born = self.rank, self.born
        while True:
            joined = rank.get((a, b))
            if joined is not None and joined[0] < before:
                return False
            if born[a] > born[b]:
                before, a = born[a], self.parts[a][1]
            elif born[b] >= 0:
                before, b = born[b] + 1, self.parts[b][0]
            else:
                return True

    def _fits(self, a: int, b: int) -> bool:
        """The pair-compatibility table, filled as pairs are met; emptied at KNOWN_PAIRS entries."""
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= KNOWN_PAIRS:
                self.pairs.clear()
            found = self.pairs[a, b] = self.compatible(a, b)
        return found

    def longest(self, spelling: str, at: int) -> int:
        """The longest token that begins at a place."""
        return next(self.machine.iter_long(spelling[at: at + self.reach]))[1]

    def encode(self, spelling: str) -> list[int]:
        """The tokens that merging by rank leaves: the only sequence whose neighbours are all compatible.

        Tokens are laid from the left, the longest first, then the ones that its spelling begins with. A token must be
        compatible with the one before and end at a place not yet given up. A place where none fits is given up and its
        token exchanged for a shorter one; each place is given up once, so the work is linear in the text. As long as every
        longest token fits, one pass of the machine gives them all.
        """
        laid: list[int] = []
        at, n, pairs, last = 0, len(spelling), self.pairs, None
        for end, token in self.machine.iter_long(spelling):
            if last is not None and not (pairs[last, token] if (last, token) in pairs else self._fits(last, token)):
                break
            laid.append(token)
            last, at = token, end + 1
        given_up = bytearray(n + 1) if at < n else b""
        while at < n:
            while token is not None:
                end = at + self.length[token]
                if not given_up[end] and (not laid or self._fits(laid[-1], token)):
                    break
                token = self.shorter[token]
            if token is not None:
                laid.append(token)
                at = end
                token = self.longest(spelling, at) if at < n else None
            else:
                given_up[at] = 1
                last = laid.pop()
                at -= self.length[last]
                token = self.shorter[last]
        return laid


class Coder(dict):
    """Ids, as bytes, of the runs between blanks that this worker has met; emptied at KNOWN_RUNS runs or KNOWN_BYTES.

    A run of Latin letters, with or without trailing punctuation, is one or two words, whose spelling is known. In any other run
    special tokens are found first; normalising and cutting it into words is the library's own. No word crosses a blank.
    """

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        super().__init__()
        with open(tokenizer_file, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.merges = Merges(model["vocab"], model["merges"], self.suffix)
        own = Tokenizer.from_file(tokenizer_file)
        self.normal, self.words = own.normalizer, own.pre_tokenizer
        self.letters = {c: self.words.pre_tokenize_str(chr(c))[0][0] for c in range(0x61, ord(LATIN)) if chr(c).isalpha()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.marks = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        names = {i: s for s, i in model["vocab"].items()} | {i: s for s, i in self.special.items()}
        texts = [(names[i] + " ").encode() if i in names else b"" for i in range(max(names) + 1)]
        self.buffer = np.frombuffer(b"".join(texts), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        self.size = 0

    def __missing__(self, run: str) -> bytes:
        if len(self) >= KNOWN_RUNS or self.size >= KNOWN_BYTES:
            self.clear()
            self.size = 0
        word = run.rstrip(TRAILING)
        low = word.lower()
        if not low.isalpha() or max(low) >= LATIN:
            found = np.fromiter(self._ids(run), "<u4").tobytes()
        elif len(word) < len(run):
            found = self[word] + self[run[len(word):]]
        else:
            found = np.array(self._word(low.translate(self.letters)), "<u4").tobytes()
        self[run] = found
        self.size += len(run) + len(found)
        return found

    def _ids(self, run: str) -> Iterator[int]:
        edges = [0, *(e for m in self.marks.finditer(run) for e in m.span()), len(run)]
        for i, (begin, end) in enumerate(pairwise(edges)):
            if i % 2:
                yield self.special[run[begin:end]]
            elif begin < end:
                for word, _ in self.words.pre_tokenize_str(self.normal.normalize_str(run[begin:end])):
                    yield from self._word(word)

    def _word(self, word: str) -> list[int]:
        return self.merges.encode(word[:-1] + chr(ord(word[-1]) + LAST) if self.suffix else word)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, re.split("[ \n\r\t]+", text))), "<u4")

    def decode(self, ids: np.ndarray) -> Iterator[bytes]:
        """The text of the ids in pieces: spellings by the offset table, one blank between two."""
        for begin in range(0, len(ids), DECODED):
            part = ids[begin: begin + DECODED].astype(np.int64)
            starts, sizes = self.offsets[part], self.offsets[part + 1] - self.offsets[part]
            ends = np.cumsum(sizes)
            text = self.buffer[np.arange(ends[-1]) + np.repeat(starts - ends + sizes, sizes)].tobytes()
            yield text[:-1] if begin + DECODED >= len(ids) else text


_CODERS: dict[str, Coder] = {}


def coder(tokenizer_file: str) -> Coder:
    """One coder per worker process, kept from task to task."""
    if tokenizer_file not in _CODERS:
        _CODERS[tokenizer_file] = Coder(tokenizer_file)
    return _CODERS[tokenizer_file]


def encode(docs: DataFrame, tokenizer_file: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and ``ids`` (array<int>) of every whole text.

    Special tokens in a text get their own ids, none are added. A NULL or empty text has no ids. Repeated rows and NULL ids of
    documents are rows like any other; columns not in ``keep`` are not read. A text of any length is one row and one task's work;
    of a word only the places of its letters are held besides.
    """
    def make():
        mine = coder(tokenizer_file)
        return lambda text: (mine.encode(text).astype(np.int32),)
    return per_text(docs, make, "ids array<int>", keep)


def decode(coded: DataFrame, tokenizer_file: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and ``decoded``: the spellings of ``ids`` joined by one blank, word ends and special tokens included.

    No ids, or NULL, give an empty text.
    """
    def make():
        mine = coder(tokenizer_file)
        return lambda ids: (b"".join(mine.decode(np.array([int(i) for i in ids.split(",")] if ids else [], np.int64))).decode(),)
    return per_text(coded.select(*keep, F.array_join("ids", ",").alias("text")), make, "decoded string", keep)


def digests(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """doc_id, n_tokens and SHA-256 (hex) of the ids, as decimals joined by a blank, and of the decoded text."""
    def make():
        mine = coder(tokenizer_file)

        def work(text: str) -> tuple:
            ids, listed, decoded = mine.encode(text), hashlib.sha256(), hashlib.sha256()
            for begin in range(0, len(ids), DECODED):
                listed.update((" " * (begin > 0) + " ".join(map(str, ids[begin: begin + DECODED].tolist()))).encode())
            for piece in mine.decode(ids):
                decoded.update(piece)
            return len(ids), listed.hexdigest(), decoded.hexdigest()
        return work
    return per_text(docs, make, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")
