"""Repair of conversations: the lightest derivation of a legal sequence of roles from faulty rows."""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from itertools import chain, islice, pairwise

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainwise.llm.common import ready, stored

# A legal conversation is empty, or an opening by the system that may be missing and then turns of user and assistant.
# States by the last role: nothing yet, system, user, assistant.
START, OPENED, ASKED, ANSWERED = range(4)
STATES = (START, OPENED, ASKED, ANSWERED)
COMPLETE = (START, ANSWERED)
STEP = {(START, "s"): OPENED, (START, "u"): ASKED, (OPENED, "u"): ASKED, (ASKED, "a"): ANSWERED, (ANSWERED, "u"): ASKED}
FOLLOWS = ("su", "ua", "au")
# The one role of user and assistant that may come next.
WANTED = {START: "user", OPENED: "user", ASKED: "assistant", ANSWERED: "user"}
RENAME, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
# A longer conversation is derived in chunks of so many rows, or of so many characters.
CHUNK_ROWS, CHUNK_CHARS = 512, 8 << 20
BLANKS = " \t\n\x0b\x0c\r"

Row = tuple  # turn, role, text, fault
Weight = tuple[int, str]


def lightest(rows: list[Row], entry: int, last: bool) -> dict[int, Weight]:
    """Weights (cost, audit) of the lightest derivations of ``rows`` from a state, by the state that they end in.

    Items are [i]: row i is there, and [i, q]: the rows before i are edited and leave state q. Deductions are
    ``[i, q] [i] -> [i + 1, q']`` by keeping, renaming or deleting row i, and ``[i, q] -> [i, q']`` by an insertion. Each adds
    its cost and its letter at the right end, so a conclusion weighs no less than any premise, and a lighter premise gives a
    lighter conclusion: weights of one item that cost the same never differ by letters added at the end alone, since those
    could only be insertions. So the agenda pops every item with its lightest weight. With ``last`` the goal is any complete
    state after the last row and the first one popped ends the search; else all end states are wanted.
    """
    n = len(rows)
    agenda: list[tuple[int, str, int, int]] = [(0, "", 0, entry), *((0, "", i, -1) for i in range(n))]
    heapq.heapify(agenda)
    there, done, ends = set(), {}, {}
    while agenda:
        cost, audit, i, q = heapq.heappop(agenda)
        if q < 0:
            there.add(i)
            found = [d for p in STATES if (i, p) in done for d in _edits(rows[i], i, p, *done[i, p])]
        elif (i, q) in done:
            continue
        else:
            done[i, q] = cost, audit
            if i == n:
                ends[q] = cost, audit
                if last and q in COMPLETE or len(ends) == len(STATES):
                    break
            found = [(cost + INSERT, audit + "I", i, STEP[q, WANTED[q][0]])]
            if i in there:
                found += _edits(rows[i], i, q, cost, audit)
        for item in found:
            if item[2:] not in done:
                heapq.heappush(agenda, item)
    return {q: w for q, w in ends.items() if not last or q in COMPLETE}


def _edits(row: Row, i: int, q: int, cost: int, audit: str) -> Iterator[tuple[int, str, int, int]]:
    _, role, _, fault = row
    yield cost + DELETE, audit + "D", i + 1, q
    if fault not in (BLANK, DUPLICATE):
        cost += CUT_OFF * (fault == TRUNCATED)
        if (q, role[:1]) in STEP:
            yield cost, audit + "K", i + 1, STEP[q, role[:1]]
        yield cost + RENAME, audit + "R", i + 1, STEP[q, WANTED[q][0]]


def replay(rows: Iterable[Row], q: int, audit: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired conversation: the state before an edit settles which role it gives."""
    left = iter(rows)
    for edit in audit:
        role, text = (WANTED[q], "") if edit == "I" else next(left)[1:3]
        if edit == "D":
            continue
        role = WANTED[q] if edit == "R" else role
        q = STEP[q, role[:1]]
        yield role, text


class Conversation:
    """What is known of a conversation after some of its chunks: counts, and the lightest derivation and its text's hash per state."""

    def __init__(self):
        self.counts = [0, 0, 0, 0]
        self.illegal = self.turns = 0
        self.first = self.turn = self.initial = None
        self.states = {START: (0, "", hashlib.sha256(), 0)}

    def extend(self, rows: list[Row], derived: dict[int, dict[int, Weight]] | None, last: bool) -> None:
        """Joins a chunk; ``derived`` has its derivations by state before and after if they are known already."""
        for turn, role, _, fault in rows:
            self.counts[fault] += 1
            self.illegal += self.initial is not None and self.initial + role[:1] not in FOLLOWS
            self.initial = role[:1]
            if turn is not None and turn != self.turn:
                self.first, self.turn, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
        best: dict[int, tuple] = {}
        for q, (cost, audit, _, _) in self.states.items():
            for end, (more, letters) in (derived[q] if derived else lightest(rows, q, last)).items():
                weight = cost + more, audit + letters, q, letters
                if end not in best or weight[:2] < best[end][:2]:
                    best[end] = weight
        if last:
            best = dict([min(((q, w) for q, w in best.items() if q in COMPLETE), key=lambda x: x[1][:2])])
        states = {}
        for end, (cost, audit, q, letters) in best.items():
            digest, lines = self.states[q][2].copy(), self.states[q][3]
            for role, text in replay(rows, q, letters):
                digest.update(f"{chr(10) * (lines > 0)}{role}:{text}".encode())
                lines += 1
            states[end] = cost, audit, digest, lines
        self.states = states

    def result(self) -> tuple:
        (cost, audit, digest, _), = self.states.values()
        gaps = self.turn - self.first + 1 - self.turns if self.turns else 0
        return gaps, *self.counts[BLANK:], self.illegal, cost, audit, digest.hexdigest()


RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
_NAMES = [c.split()[0] for c in RESULT.split(", ")]
_KINDS = [pa.int64()] * 6 + [pa.string()] * 2
_FIELDS = ("turn", "role", "text", "fault")
_ROW = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("fault", pa.int64())])


def _chunks(batches) -> Iterator[tuple[object, list[Row], bool, bool]]:
    """(conv_id, rows, begins, ends) of the sorted rows of one task; a row's further copies follow it."""
    held, size, begins, now = [], 0, True, None

    def rows():
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies", "fault")), strict=True)
    for conv, turn, role, text, copies, fault in rows():
        if now is None or conv != now[0]:
            if now is not None:
                yield now[0], held, begins, True
            now, held, size, begins = (conv,), [], 0, True
        for copy in range(copies):
            if len(held) >= CHUNK_ROWS or size >= CHUNK_CHARS:
                yield conv, held, begins, False
                held, size, begins = [], 0, False
            held.append((turn, role, text, fault if not copy or fault == BLANK else DUPLICATE))
            size += len(text)
    if now is not None:
        yield now[0], held, begins, True


def faulted(rows: DataFrame, copies: Column) -> DataFrame:
    """Distinct rows (conv_id, turn, role, text) with ``copies`` and ``fault`` of the first copy.

    A role and text seen in an earlier turn of the conversation make a duplicate; the earliest turns are one row per
    conversation, role and text, and only those met in several turns are joined back.
    """
    given = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                        *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")], copies.cast("bigint").alias("copies"))
    folded = stored(given.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")), "folded")
    key = F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256)
    again = (folded.filter("copies > 0").select(F.col("conv_id").alias("of"), key.alias("said"), F.struct("turn").alias("at"))
             .groupBy("of", "said").agg(F.min("at").alias("first"), F.count("*").alias("n")).filter("n > 1"))
    end = F.rtrim("text", F.lit(BLANKS))
    return (folded.withColumn("own", key).join(again, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("own") == F.col("said")), "left")
            .select("conv_id", "turn", "role", "text", "copies",
                    F.when(end == "", BLANK).when(F.struct("turn") > F.col("first"), DUPLICATE)
                    .when(~F.right(end, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(FINE).cast("bigint").alias("fault")))


def repair(rows: DataFrame, copies: Column | None = None) -> DataFrame:
    """conv_id and, of its rows in the order of turns (NULL first; ties by role, then text): gaps, blank, duplicate, truncated, illegal,
    cost, audit and repaired_sha256.

    ``copies`` says how often a row is there; a row that is there no times only names its conversation, which then has zeros, no
    edits and the hash of nothing. NULL roles and texts are one blank. A NULL conv_id is a conversation. A role without a
    letter, or with another one than s, u, a, cannot be kept. A file of no rows gives none.

    Rows are sorted into ranges by (conversation, turn, role, text), so a conversation with a third of all rows lies in many
    tasks. Each task derives its rows in chunks. Conversations that lie in one task are finished there. Of the ones at its
    ends, at most two, every chunk is derived from all four states; the chunks are then joined from left to right in one
    pass per conversation that holds one chunk at a time. That pass is sequential, as the hash of a text is.
    """
    ready(rows.sparkSession)
    order = ["conv_id", "turn", "role", "text"]
    placed = stored(faulted(rows, F.lit(1) if copies is None else copies), "faulted")

    def derive(batches):
        part = TaskContext.get().partitionId()

        def found():
            steps = pairwise(chain(_chunks(batches), [None]))
            for number, ((conv, held, begins, ends), following) in enumerate(steps):
                if begins and ends and number > 0 and following is not None:
                    one = Conversation()
                    one.extend(held, None, True)
                    yield conv, *one.result(), None, None, None, None
                else:
                    ways = json.dumps({q: lightest(held, q, False) for q in STATES})
                    yield conv, *[None] * len(_NAMES), part, number, [dict(zip(_FIELDS, r, strict=True)) for r in held], ways
        return _batches(found(), [*_NAMES, "part", "chunk", "held", "ways"], [*_KINDS, pa.int64(), pa.int64(), pa.list_(_ROW), pa.string()])

    held = "part bigint, chunk bigint, held array<struct<turn: bigint, role: string, text: string, fault: bigint>>, ways string"
    derived = stored(placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(derive, f"conv_id bigint, {RESULT}, {held}"), "derived")
    chunks = derived.filter("part IS NOT NULL").select("conv_id", "part", "chunk", "held", "ways").repartition("conv_id").sortWithinPartitions("conv_id", "part", "chunk")
    return derived.filter("part IS NULL").select("conv_id", *_NAMES).union(chunks.mapInArrow(_join, f"conv_id bigint, {RESULT}"))


def _join(batches):
    """Conversations from their sorted chunks, one chunk at a time."""
    def rows():
        for batch in batches:
            for i in range(batch.num_rows):
                yield [batch.column(c)[i].as_py() for c in ("conv_id", "held", "ways")]

    def found():
        one = None
        for (conv, held, ways), following in pairwise(chain(rows(), [None])):
            one = one or Conversation()
            last = following is None or following[0] != conv
            known = {int(q): {int(end): tuple(w) for end, w in ends.items()} for q, ends in json.loads(ways).items()}
            one.extend([tuple(r[f] for f in _FIELDS) for r in held], known, last)
            if last:
                yield conv, *one.result()
                one = None
    return _batches(found(), _NAMES, _KINDS)


def _batches(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    while part := list(islice(rows, 200)):
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*part, strict=True), [pa.int64(), *kinds], strict=True)], names=["conv_id", *names])


def damaged(rows: DataFrame) -> tuple[DataFrame, Column]:
    """The rows with the faults that the hash of ``conv_id:turn`` modulo 20 gives them, and how often each is there.

    0 drops a row, 1 empties its text, 2 removes its ends of sentences, 3 repeats it, 4 makes the user say it. A NULL in any column
    is one blank in the hash, the role and the text.
    """
    conv, turn, role, text = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    fault = F.crc32(F.concat_ws(":", conv, turn)) % 20
    return rows.select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies")), F.col("copies")
