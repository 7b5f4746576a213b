import hashlib
import random

from conftest_llm import EDGES, FOLDER, frame
from tokenizers import Tokenizer

from grainwise.llm import backtrack
from grainwise.llm.queries import QUERIES, WORD_BPE


def expected(texts):
    own = Tokenizer.from_file(WORD_BPE)
    for i, t in texts:
        ids = own.encode(t or "", add_special_tokens=False).ids
        yield (i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
               hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def check(docs):
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted((str(tuple(r)) for r in backtrack.digests(docs, WORD_BPE).collect())) == sorted(str(t) for t in expected(texts))


def test_edges(llm):
    check(frame(llm, [*EDGES, "<|startoftext|>", "a<|endoftext|>b <|endoftext |>", "aaaa" * 700, "abab" * 700, "the" * 5_000, "İΑΣ ΑΣ\x85ß"]))


def test_random_texts_of_all_planes(llm):
    rng = random.Random(3)

    def sign():
        any_plane = rng.randrange(1, 0x10F800)
        return rng.choice([chr(any_plane if any_plane < 0xD800 else any_plane + 0x800), chr(rng.randrange(1, 0x800)), "a", "b", "th", " ", "'s", "'ll", "\n", "9", "<|endoftext|>", "́"])
    check(frame(llm, ["".join(sign() for _ in range(rng.randrange(60))) for _ in range(400)]))


def test_null_ids_repeated_rows_and_empty_tables(llm):
    docs = llm.createDataFrame([(None, "one two"), (None, None), (4, "one two"), (4, "one two"), (4, "other")], "doc_id bigint, text string")
    check(docs)
    assert backtrack.digests(docs.limit(0), WORD_BPE).count() == 0


def test_a_token_is_kept_only_if_the_merges_leave_it():
    vocab = {t: i for i, t in enumerate(["a", "b", "c", "a</w>", "b</w>", "c</w>", "bc", "ab", "abc", "bc</w>", "abc</w>"])}
    merges = backtrack.Merges(vocab, ["b c</w>", "b c", "a b", "ab c", "a bc</w>"], "</w>")
    assert vocab["abc"] not in merges.length and vocab["abc</w>"] in merges.length
    assert merges.encode("abca") == [vocab["a"], vocab["bc"], vocab["a"]]


def merged(word, rank):
    """Plain merging: the pair of the lowest rank, the leftmost of equal ones, again and again."""
    word = list(word)
    while len(word) > 1:
        best = min(((rank[p][0], i) for i, p in enumerate(zip(word, word[1:], strict=False)) if p in rank), default=None)
        if best is None:
            return word
        word[best[1]: best[1] + 2] = [rank[word[best[1]], word[best[1] + 1]][1]]
    return word


def test_random_merges_against_plain_merging():
    rng = random.Random(8)
    for _ in range(60):
        vocab = {c: i for i, c in enumerate("abc")}
        merges = []
        for _ in range(25):
            a, b = rng.choices(list(vocab), k=2)
            if len(a + b) < 9 and (a, b) not in merges:
                merges.append((a, b))
                vocab.setdefault(a + b, len(vocab))
        coder = backtrack.Merges(vocab, merges, "")
        for _ in range(40):
            text = "".join(rng.choices("abc", k=rng.randint(1, 25)))
            assert coder.encode(text) == merged([vocab[c] for c in text], coder.rank)


def test_ids_and_texts_as_tables(llm):
    docs = frame(llm, EDGES)
    own = Tokenizer.from_file(WORD_BPE)
    coded = backtrack.encode(docs, WORD_BPE)
    ids = {r["doc_id"]: r["ids"] for r in coded.collect()}
    assert ids == {i: own.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(EDGES)}
    assert {r["doc_id"]: r["decoded"] for r in backtrack.decode(coded, WORD_BPE).collect()} == {i: own.decode(v, skip_special_tokens=False) for i, v in ids.items()}


def test_query(llm):
    docs = llm.read.parquet(f"{FOLDER}/documents.parquet")
    got = QUERIES["op12_word_bpe"](llm, FOLDER).collect()
    assert sorted(tuple(r) for r in got) == sorted(expected([(r["doc_id"], r["text"]) for r in docs.collect()]))
