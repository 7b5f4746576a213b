import hashlib
import itertools
import random
import re

import duckdb
import pytest
from conftest_llm import FOLDER

from grainwise.llm import repair
from grainwise.llm.queries import QUERIES, SQL
from pyspark.sql import functions as F

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?")


def rows_of(roles, rng):
    """Rows as (turn, role, text, fault) with faults drawn at random."""
    return [(i, r, f"text {i}", rng.choices([repair.FINE, repair.BLANK, repair.DUPLICATE, repair.TRUNCATED], [6, 1, 1, 2])[0]) for i, r in enumerate(roles)]


def every_repair(rows):
    """(cost, audit) of all edits with at most two insertions in one place."""
    gaps = [(2 * k, "I" * k, list(p)) for k in range(3) for p in itertools.product("ua", repeat=k)]

    def choices(row):
        _, role, _, fault = row
        yield 3, "D", []
        if fault not in (repair.BLANK, repair.DUPLICATE):
            cut = int(fault == repair.TRUNCATED)
            yield cut, "K", [role[:1]]
            yield 2 + cut, "R", ["u"]
            yield 2 + cut, "R", ["a"]
    spots = [gaps]
    for row in rows:
        spots += [list(choices(row)), gaps]
    for picked in itertools.product(*spots):
        if LEGAL.fullmatch("".join(c for _, _, roles in picked for c in roles)):
            yield sum(c for c, _, _ in picked), "".join(a for _, a, _ in picked)


@pytest.mark.parametrize("seed", range(12))
def test_lightest_against_every_repair(seed):
    rng = random.Random(seed)
    rows = rows_of(rng.choices(["system", "user", "assistant", "tool"], k=rng.randrange(4)), rng)
    (_, weight), = repair.lightest(rows, repair.START, True).items()
    assert weight == min(every_repair(rows))


def plain_path(rows):
    """The cheapest edits by plain recursion over rows and states."""
    table = {0: (0, "")}
    inserts = {0: [(2, "I"), (3, "II")], 1: [(2, "I"), (3, "II")], 2: [(3, "I")], 3: [(2, "I")]}
    wanted = {0: "user", 1: "user", 2: "assistant", 3: "user"}
    after = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    def widened(t):
        out = dict(t)
        for q, (c, a) in t.items():
            for q2, i in inserts[q]:
                out[q2] = min(out.get(q2, (10**9, "")), (c + 2 * len(i), a + i))
        return out
    for _, role, _, fault in rows:
        new = {}
        for q, (c, a) in widened(table).items():
            ways = [(q, c + 3, "D")]
            if fault not in (repair.BLANK, repair.DUPLICATE):
                cut = int(fault == repair.TRUNCATED)
                ways.append((after[q, wanted[q][0]], c + 2 + cut, "R"))
                if (q, role[:1]) in after:
                    ways.append((after[q, role[:1]], c + cut, "K"))
            for q2, cost, letter in ways:
                new[q2] = min(new.get(q2, (10**9, "")), (cost, a + letter))
        table = new
    return min(w for q, w in widened(table).items() if q in (0, 3))


def test_chunks_join_to_the_whole():
    rng = random.Random(4)
    for _ in range(30):
        rows = rows_of(rng.choices(["system", "user", "assistant", ""], [1, 4, 4, 1], k=rng.randint(1, 60)), rng)
        whole, known, lazy = repair.Conversation(), repair.Conversation(), repair.Conversation()
        whole.extend(rows, None, True)
        for begin in range(0, len(rows), 7):
            part, last = rows[begin: begin + 7], begin + 7 >= len(rows)
            known.extend(part, {q: repair.lightest(part, q, False) for q in repair.STATES}, last)
            lazy.extend(part, None, last)
        assert whole.result() == known.result() == lazy.result()
        assert whole.result()[5:7] == plain_path(rows)


def expected(con, rows):
    con.execute("CREATE OR REPLACE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR, role2 VARCHAR)")
    if rows:
        con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?, 'x')", rows)
    return sorted(map(str, con.execute(SQL["op11_repair"]).fetchall()))


def damaged_and_repaired(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({"fault": F.lit("x"), "copies": F.lit(9), "held": F.lit(1)})
    return sorted(str(tuple(r)) for r in repair.repair(*repair.damaged(frame)).collect())


EDGES = [
    (None, None, None, None), (None, 1, "user", "hi."), (1, None, "user", "no turn."), (1, None, "assistant", None), (1, 0, "user", "a?"), (1, 9, "assistant", "b!\n "),
    (2, 1, "user", "tie."), (2, 1, "assistant", "tie."), (2, 1, "user", "tie."), (2, 1, "user", "tie."), (2, 2, "user", "tie."),
    (3, 4, "", "no role."), (3, 5, "tool", "x."), (4, 1, "system", ""), (5, 1, "system", "only."), (6, 3, "user", " \t\n"), (7, -3, "assistant", "日本語。"), (7, 8, "user", "x" * 70_000),
]


def test_edges_against_sql(llm):
    assert damaged_and_repaired(llm, EDGES) == expected(duckdb.connect(), EDGES)
    many = [(c, t, r, x) for c, t, r, x in EDGES for c in ([c] if c is None else range(c, 400, 10))]
    assert damaged_and_repaired(llm, many) == expected(duckdb.connect(), many)


def test_empty_table(llm):
    assert damaged_and_repaired(llm, []) == []


def test_one_conversation_holds_most_rows(llm):
    rng = random.Random(6)
    rows = [(77, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["ok.", f"text {t}.", f"cut {t}", " "])) for t in range(2_600)]
    rows += [(i, t, r, f"{r} {t}.") for i in range(60, 90) if i != 77 for t, r in enumerate(["user", "assistant"])]
    rng.shuffle(rows)
    got = {r["conv_id"]: r for r in repair.repair(llm.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == 30 and all(r["audit"] == "KK" and r["cost"] == 0 for c, r in got.items() if c != 77)
    seen, path = set(), []
    for _, t, role, text in sorted(r for r in rows if r[0] == 77):
        fault = repair.BLANK if not text.strip() else repair.DUPLICATE if (role, text) in seen else repair.FINE if text[-1] == "." else repair.TRUNCATED
        seen.add((role, text))
        path.append((t, role, text, fault))
    cost, audit = plain_path(path)
    lines = "\n".join(f"{r}:{t}" for r, t in repair.replay(path, 0, audit))
    assert (got[77]["cost"], got[77]["audit"], got[77]["repaired_sha256"]) == (cost, audit, hashlib.sha256(lines.encode()).hexdigest())
    assert LEGAL.fullmatch("".join(line[0] for line in lines.split("\n")))


def test_query(llm):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{FOLDER}/conversations.parquet'")
    assert sorted(tuple(r) for r in QUERIES["op11_repair"](llm, FOLDER).collect()) == sorted(con.execute(SQL["op11_repair"]).fetchall())
