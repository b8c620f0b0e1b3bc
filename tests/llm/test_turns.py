"""Turn structure against a search over all edits and the faults' definitions row by row."""

import hashlib
import random
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from millrace.llm import turns
from millrace.llm.queries import queries

SPACE = set(" \t\n\x0b\x0c\r")


def cheapest(rows):
    """(cost, audit) of the turns [(initial, fault)] by trying every edit."""

    @lru_cache(None)
    def best(i, state, inserted):
        ways = [(0, "")] if i == len(rows) and state in ("", "p") else []
        if i < len(rows):
            initial, fault = rows[i]
            cost, audit = best(i + 1, state, 0)
            ways.append((cost + 3, "D" + audit))
            if fault not in ("blank", "duplicate"):
                for role, before, after in (("s", ("",), "s"), ("u", ("", "p", "s"), "u"), ("a", ("u",), "p")):
                    if state in before and (initial == role or role != "s"):
                        cost, audit = best(i + 1, after, 0)
                        price = (0 if initial == role else 2) + (fault == "truncated")
                        ways.append((cost + price, ("K" if initial == role else "R") + audit))
        if inserted < 4:
            cost, audit = best(i, "p" if state == "u" else "u", inserted + 1)
            ways.append((cost + 2, "I" + audit))
        return min(ways, default=(1 << 40, ""))

    return best(0, "", 0)


def expected(rows):
    """The contract for all rows (conv_id, turn, role, text), one conversation at a time."""
    out = {}
    for conv in {r[0] for r in rows}:
        found = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if kind == 0:
                continue
            text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
            found += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        faults, seen = [], set()
        for _, role, text in found:
            seen_before, last = (role, text) in seen, [c for c in text if c not in SPACE][-1:]
            seen.add((role, text))
            faults.append("blank" if not last else "duplicate" if seen_before else "truncated" if last[0] not in ".!?" else "")
        initials = [role[:1] for _, role, _ in found]
        cost, audit = cheapest(tuple(zip(initials, faults)))
        numbers = [t for t, _, _ in found if t is not None]
        length, made, at = len(audit) - audit.count("D"), [], 0
        grammar = ["system"] * (length % 2) + ["user", "assistant"] * (length // 2)
        for edit in audit:
            if edit == "I":
                made.append(grammar[len(made)] + ":")
                continue
            if edit != "D":
                made.append((found[at][1] if edit == "K" else grammar[len(made)]) + ":" + found[at][2])
            at += 1
        out[conv] = (
            max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0,
            faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(made).encode()).hexdigest(),
        )
    return out


@pytest.mark.parametrize("letters", ["suaxbrSUAX", "ua", "uuaab", "UAuabr", "x", "s", "ub", "sua", "b"])
def test_alignment_equals_search(letters):
    r = random.Random(letters)
    for _ in range(1500):
        turn = "".join(r.choice(letters) for _ in range(r.randint(0, 13)))
        rows = tuple((c.lower(), {"b": "blank", "r": "duplicate"}.get(c, "truncated" if c.isupper() else "")) for c in turn)
        assert turns.aligned(turn) == cheapest(rows), turn
        assert turns._aligned(turn) == turns.aligned(turn)


def test_band_of_long_pieces(monkeypatch):
    """Rows of the table that are made again give the same audits, also where lengths differ much."""
    r = random.Random(3)
    for letters in ("uuaab" * 300, "u" * 1501, "".join(r.choice("uauaxsbUA") for _ in range(3000))):
        want = turns._aligned(letters)
        made = turns._Band.__init__

        def small(self, *args):
            monkeypatch.setattr(turns, "max", lambda *a: 7 if a[0] == 1024 else max(*a), raising=False)
            made(self, *args)

        monkeypatch.setattr(turns._Band, "__init__", small)
        assert turns._aligned(letters) == want
        monkeypatch.undo()


ODD = [
    (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (2, None, None, None), (2, 3, "user", None), (None, 1, "user", "a."), (None, None, "x", "b"),
    (3, 5, "system", "s."), (3, 5, "system", "s."), (3, 9, "user", "q?"), (4, 1, "", "empty role."), (5, 1, "user", "  \n\x0b "), (6, 1, "user", "a "),
    (7, 1, "assistant", "long " * 30_000 + "end.")] + [(8, k, "user", "same.") for k in range(50)] + [(9, 0, "system", "Only.")]


@pytest.mark.parametrize("rows", ["odd", "many"])
def test_report_and_repair(spark, rows):
    r = random.Random(7)
    if rows == "many":
        made = [
            (c, t, r.choice(["user", "assistant", "system", "tool", "user", "assistant"]), r.choice(["Yes.", "No", "", "Well? ", "Ok!\n", "éé."]) + str(r.randint(0, 3)) * r.randint(0, 1))
            for c in range(120) for t in range(r.randint(1, 14)) if r.random() > 0.1
        ]
    else:
        made = ODD
    table = spark.createDataFrame(made, "conv_id long, turn long, role string, text string").withColumn("copy", F.lit("clash"))
    damaged = turns.damaged(table.repartition(3))
    found = spark.createDataFrame(turns.reports(damaged).collect(), turns.REPORTS)
    sha = {x.conv_id: x.sha for x in turns.digests(turns.repaired(damaged, found)).collect()}
    got = {x.conv_id: (*tuple(x)[1:], sha.get(x.conv_id, hashlib.sha256(b"").hexdigest())) for x in found.collect()}
    want = expected(made)
    assert len(got) == found.count() and {k: v for k, v in got.items() if want[k] != v} == {} and set(got) == set(want)


def test_repaired_turns_follow_the_grammar(spark):
    table = spark.createDataFrame([(c, t, "user", f"{t}.") for c in range(30) for t in range(c)], "conv_id long, turn long, role string, text string")
    damaged = turns.damaged(table)
    made = turns.repaired(damaged, spark.createDataFrame(turns.reports(damaged).collect(), turns.REPORTS)).collect()
    for conv in range(30):
        rows = [x for x in made if x.conv_id == conv]
        assert [x.position for x in rows] == list(range(len(rows)))
        assert [x.role for x in rows] == ["user", "assistant"] * (len(rows) // 2)
        assert all((x.turn is None) == (x.edit == "I") for x in rows)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert queries()["op11_turn_structure"](spark, str(tmp_path)).count() == 0


def test_query_equals_search(spark):
    path = "/root/testdata/sf0.001"
    rows = [tuple(x) for x in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {x.conv_id: tuple(x)[1:] for x in queries()["op11_turn_structure"](spark, path).collect()}
    assert got == expected(rows)
