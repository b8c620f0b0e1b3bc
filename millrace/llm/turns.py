"""Repair of the turn structure of conversations: the cheapest edits that make the roles follow a grammar, found by alignment.

The turns of a conversation have to be read as `(s?(ua)+)?`: nothing, or an optional system turn and then pairs of user and
assistant. Edits are Keep (0), Rerole to user or assistant (2), Delete (3, the only one for blank and repeated turns) and Insert of an
empty user or assistant turn (2); a truncated turn that stays adds 1. Of the cheapest repairs the one with the least audit
(initials of the edits in order, compared as ASCII) is taken.

Wagner-Fischer: the turns are aligned with a target, the grammar's string of one length. Targets of all lengths end alike, so one table
over (turn, symbols left) serves every feasible length. Ukkonen's band: a scan over the four states of the grammar, which forgets
lengths, gives the cost of a repair that exists, and cells that cannot be part of one so cheap are left out. The audits of all
lengths that reach it are backtraced together and compared edit by edit. Before that a conversation is cut where every cheapest repair stands
after a pair; the pieces are aligned by themselves, which gives the same audit, since no way to a cut is the beginning of another.

A conversation's turns are read in order from sorted partitions, so no texts are gathered: first one letter a turn, which makes the audit,
then the texts with the audit before them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, prepare

INF = 1 << 60
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
#: Letters of a turn: b blank, r repeated, - none (a conversation left without turns), else the role's initial (x: no role of the
#: grammar), upper case if the text is truncated.
BLANK, REPEATED, NONE = "b", "r", "-"
#: The longest signature that is kept with its alignment.
KEPT_CHARS = 256
LEGAL = ("su", "ua", "au")
REPORTS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
TURNS = "conv_id long, position long, edit string, turn long, role string, text string"


# ---- alignment

# States of the grammar: 0 nothing yet, 1 an assistant turn is due, 2 after a pair, 3 after the system turn.

def _inserted(c: tuple) -> tuple:
    """Costs of states when turns may be inserted."""
    one = min(c[1], min(c[0], c[2], c[3]) + INSERT)
    return c[0], one, min(c[2], one + INSERT), c[3]


def _stays(letter: str) -> tuple[int, int, int]:
    """Costs of a turn that stays as system, user and assistant."""
    if letter in (BLANK, REPEATED):
        return INF, INF, INF
    extra = letter.isupper()
    role = letter.lower()
    return (KEEP if role == "s" else INF) + extra, (KEEP if role == "u" else REROLE) + extra, (KEEP if role == "a" else REROLE) + extra


def _forward(letters: str, start: int) -> list[tuple]:
    """Least costs of each state after each number of turns, before anything is inserted there."""
    costs = [tuple(0 if q == start else INF for q in range(4))]
    for letter in letters:
        c0, c1, c2, c3 = _inserted(costs[-1])
        s, u, a = _stays(letter)
        costs.append((
            c0 + DELETE, min(c1 + DELETE, min(c0, c2, c3) + u), min(c2 + DELETE, c1 + a), min(c3 + DELETE, c0 + s),
        ))
    return costs


def _backward(letters: str) -> list[tuple]:
    """Least costs of what is left after each number of turns, by state."""
    costs = [(0, 2, 0, 4)]
    for letter in reversed(letters):
        h0, h1, h2, h3 = costs[-1]
        s, u, a = _stays(letter)
        e0, e1 = min(h0 + DELETE, h3 + s, h1 + u), min(h1 + DELETE, h2 + a)
        e2, e3 = min(h2 + DELETE, h1 + u), min(h3 + DELETE, h1 + u)
        one = min(e1, e2 + INSERT)
        costs.append((min(e0, one + INSERT), one, min(e2, one + INSERT), min(e3, one + INSERT)))
    return costs[::-1]


def aligned(letters: str) -> tuple[int, str]:
    """Cost and audit of the repair of a conversation, given the letters of its turns."""
    return _kept(letters) if len(letters) <= KEPT_CHARS else _aligned(letters)


def _aligned(letters: str) -> tuple[int, str]:
    ahead, behind = _forward(letters, 0), _backward(letters)
    cost = behind[0][0]
    cuts = [0]
    for i in range(1, len(letters)):
        if [q for q in range(4) if ahead[i][q] + behind[i][q] == cost] == [2]:
            cuts.append(i)
    ends = [*cuts[1:], len(letters)]
    parts = (piece if end - start <= KEPT_CHARS else _piece for start, end in zip(cuts, ends))
    audits = [part(letters[start:end], start == 0, end == len(letters)) for part, start, end in zip(parts, cuts, ends)]
    return cost, "".join(audits)


def _piece(letters: str, head: bool, last: bool) -> str:
    """Least audit of a piece. Its target has pairs only, unless it is the head: that may begin with a system turn, and is
    empty only if it is the whole conversation."""
    n, ahead = len(letters), [_inserted(c) for c in _forward(letters, 0 if head else 2)]
    cost = min(ahead[n][2], ahead[n][0] if last else INF)
    # What may still be spent before turn i with an even or odd number of symbols left, if the repair is to be so cheap.
    spend = [(cost - min(c[0], c[2], c[3]), cost - c[1]) for c in ahead]
    band = _Band(letters, spend)
    audits = []
    if DELETE * n == cost and (last or not head):
        audits.append("D" * n)
    if band.row(0).even():
        audits.append(band.least_audit(0))
    for k in range(min(n - 1, cost // DELETE) if head else -1, -1, -1):
        if DELETE * k + _stays(letters[k])[0] + spend[k + 1][0] == cost and band.row(k + 1).even():
            audits.append("D" * k + "K" + band.least_audit(k + 1))
            break  # a system turn kept earlier gives a later audit
    return min(audits)


class _Cells:
    """Numbers of symbols left (from 1) as bits of an integer, from an even base on."""

    __slots__ = ("base", "bits")

    def __init__(self, base: int, bits: int):
        if bits:
            low = ((bits & -bits).bit_length() - 1) & ~1
            base, bits = base + low, bits >> low
        self.base, self.bits = (base, bits) if bits else (0, 0)

    def of(self, odd: int) -> int:
        k = self.bits.bit_length() // 2 + 1
        return self.bits & (_EVEN[k] if k < len(_EVEN) else ((1 << 2 * k) - 1) // 3) << odd

    def even(self) -> int:
        return self.of(0)


_EVEN = [((1 << 2 * k) - 1) // 3 for k in range(512)]


class _Band:
    """The cells of the alignment table inside the band. The bound is the least cost, so the cost of a cell in the band is all that
    may be spent there (it depends on the turn and on whether the symbols left are even or odd), and a row of the table
    is a set of cells. The cell without symbols left, from which all is deleted, is known without the table.

    Rows are found from the last turn backwards. Of long pieces every so many rows are kept, the others made again for the trace.
    """

    def __init__(self, letters: str, spend: list[tuple]):
        self.letters, self.spend, self.n = letters, spend, len(letters)
        self.every = max(1024, int(self.n**0.5))
        self.marks, self.blocks = {self.n: self.made(self.n, _Cells(0, 0))}, {}
        row = self.marks[self.n]
        for i in range(self.n - 1, -1, -1):
            row = self.made(i, row)
            if i % self.every == 0:
                self.marks[i] = row

    def costs(self, i: int) -> tuple[int, int]:
        """Costs of turn i as the next symbol where an even or odd number is left: user, assistant."""
        return _stays(self.letters[i])[1:]

    def made(self, i: int, after: _Cells) -> _Cells:
        may, base, bits = self.spend[i], after.base, 0
        one = DELETE * (self.n - i) + INSERT == may[1]
        if i < self.n:
            then, costs = self.spend[i + 1], self.costs(i)
            for odd in (0, 1):
                if then[odd] + DELETE == may[odd]:
                    bits |= after.of(odd)
                if then[1 - odd] + costs[odd] == may[odd]:
                    bits |= after.of(1 - odd) << 1
            one |= costs[1] + DELETE * (self.n - i - 1) == may[1]
        if one:
            base, bits = 0, bits << base | 2
        for odd in (0, 1):
            if may[1 - odd] + INSERT == may[odd]:
                bits |= _Cells.of(_plain(bits), 1 - odd) << 1
        return _Cells(base, bits)

    def row(self, i: int) -> _Cells:
        if i in self.marks:
            return self.marks[i]
        block = i // self.every
        if block not in self.blocks:
            end = min(self.n, (block + 1) * self.every)
            rows = [self.marks[end]]
            for k in range(end - 1, block * self.every, -1):
                rows.append(self.made(k, rows[-1]))
            self.blocks = {block: rows[::-1]}
        return self.blocks[block][i - block * self.every - 1]

    def least_audit(self, i: int) -> str:
        """The least of the audits from turn i on with an even number of symbols left, of all lengths at once: the cells
        that share the audit so far go on together, and the least edit of any of them is taken."""
        edits, nothing, alive = [], False, _Cells(self.row(i).base, self.row(i).even())
        while not (i == self.n and nothing):
            may = self.spend[i]
            if i < self.n:
                after, then, costs = self.row(i + 1), self.spend[i + 1], self.costs(i)
                stay = [alive.of(odd) if then[odd] + DELETE == may[odd] else 0 for odd in (0, 1)]
                bits = _common(alive.base, stay[0] | stay[1], after)
                if nothing or bits.bits:
                    edits.append("D")
                    i, alive = i + 1, bits
                    continue
            rest = DELETE * (self.n - i)
            moved = [alive.of(odd) if may[1 - odd] + INSERT == may[odd] else 0 for odd in (0, 1)]
            bits = _common(alive.base, moved[0] | moved[1], self.row(i), 1)
            zero = alive.base == 0 and bool(alive.bits & 2) and rest + INSERT == may[1]
            if bits.bits or zero:
                edits.append("I")
                nothing, alive = zero, bits
                continue
            role = self.letters[i].lower()
            kept = 0 if role == "u" else 1
            for odd in (kept, 1 - kept):
                bits = _common(alive.base, alive.of(odd) if then[1 - odd] + costs[odd] == may[odd] else 0, after, 1)
                zero = odd == 1 and alive.base == 0 and bool(alive.bits & 2) and costs[1] + rest - DELETE == may[1]
                if bits.bits or zero:
                    edits.append("K" if odd == kept and role in "ua" else "R")
                    i, nothing, alive = i + 1, zero, bits
                    break
            # A turn that is neither can only be given a role, and which depends on the symbols left alone.
        return "".join(edits)


def _plain(bits: int) -> _Cells:
    cells = _Cells(0, 0)
    cells.bits = bits
    return cells


def _common(base: int, bits: int, cells: _Cells, down: int = 0) -> _Cells:
    """The cells of a base and bits, less by `down`, that are also among `cells`."""
    low = min(base - 2 * down, cells.base) if bits else 0
    found = (bits << (base - low) >> down) & (cells.bits << (cells.base - low))
    return _Cells(low, found) if found else _Cells(0, 0)


piece = lru_cache(1 << 16)(_piece)
_kept = lru_cache(1 << 16)(_aligned)


# ---- rows

def damaged(conversations: DataFrame) -> DataFrame:
    """The turns with faults worked in by a hash of their place, as (conv_id, turn, role, text, dropped); nulls of role and text are one
    space. A repeated turn is two rows; a dropped one stays as a row that says so."""
    text = F.coalesce("text", F.lit(" "))
    key = F.concat_ws(":", *[F.coalesce(F.col(name).cast("string"), F.lit(" ")) for name in ("conv_id", "turn")])
    kind = F.crc32(key.cast("binary")) % 20
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (kind == 0).alias("dropped"), F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return rows.drop("copy")


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("digest", F.unhex(F.sha2("text", 256)))


def lettered(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, initial, letter): no texts. Order within a conversation: turn (nulls first), role, digest of the text."""
    there = _keyed(turns.where(~F.col("dropped")))
    first = F.substring("role", 1, 1)
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    narrow = there.select("conv_id", "turn", "role", "digest", F.when(first.isin("s", "u", "a"), first).otherwise(F.lit("x")).alias("initial"), blank.alias("blank"), cut.alias("cut"))
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "digest").orderBy(F.asc_nulls_first("turn"))) > 1
    letter = F.when(F.col("blank"), F.lit(BLANK)).when(seen, F.lit(REPEATED)).when(F.col("cut"), F.upper("initial")).otherwise(F.col("initial"))
    found = narrow.select("conv_id", "turn", "role", "digest", "initial", letter.alias("letter"))
    gone = turns.where("dropped").select("conv_id", F.lit(None).cast("long"), F.lit(""), F.lit(b""), F.lit(NONE), F.lit(NONE))
    return found.union(gone)


def _in_order(rows: DataFrame, *before: str) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *before, F.asc_nulls_first("turn"), "role", "digest")


def _runs(ids: pa.Array) -> Iterator[tuple[int | None, int, int]]:
    """(id, start, end) of each run of equal ids, nulls being equal."""
    found = ids.to_pylist()
    start = 0
    for at in range(1, len(found) + 1):
        if at == len(found) or found[at] != found[start]:
            yield found[start], start, at
            start = at


def reports(turns: DataFrame) -> DataFrame:
    """REPORTS: faults, cost and audit of every conversation in `turns` (as damaged() gives them; rows with the same null id are one).

    Of each turn the first fault counts: blank, duplicate (role and text seen earlier), truncated. A conversation without turns
    has zeros and an empty audit. Memory: a letter a turn of the conversation in work, as its audit has.
    """
    prepare(turns.sparkSession)

    def run(batches):
        conv, initials, letters, first, last, different = 0, [], [], None, None, 0

        def report():
            marks, roles = "".join(letters), "".join(initials)
            illegal = max(0, len(roles) - 1) - sum(roles.count(pair) for pair in LEGAL)  # none of them overlaps itself
            cost, audit = aligned(marks)
            gaps = 0 if first is None else last - first + 1 - different
            return conv, gaps, marks.count(BLANK), marks.count(REPEATED), sum(map(str.isupper, marks)), illegal, cost, audit

        begun = False
        for batch in batches:
            out = []
            marks, roles, turn = (batch.column(name).to_pylist() for name in ("letter", "initial", "turn"))
            for found, start, end in _runs(batch.column("conv_id")):
                if not begun or found != conv:
                    if begun:
                        out.append(report())
                    begun, conv, initials, letters, first, last, different = True, found, [], [], None, None, 0
                initials.append("".join(roles[start:end]).replace(NONE, ""))
                letters.append("".join(marks[start:end]).replace(NONE, ""))
                for t in turn[start:end]:  # ascending
                    if t is not None and t != last:
                        first, last, different = t if first is None else first, t, different + 1
            yield _batch(out, REPORTS)
        if begun:
            yield _batch([report()], REPORTS)

    return _in_order(lettered(turns)).select("conv_id", "turn", "initial", "letter").mapInArrow(run, REPORTS)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [field.split() for field in schema.split(", ")]
    columns = zip(*rows) if rows else [[] for _ in fields]
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields)], names=[name for name, _ in fields])


def repaired(turns: DataFrame, found: DataFrame) -> DataFrame:
    """TURNS: the turns of all conversations after the edits of their audits in `found`, in order within each partition; inserted ones have
    no turn number. A conversation whose turns are all deleted has no rows."""
    prepare(turns.sparkSession)
    audits = found.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(b"").alias("digest"), F.lit(0).alias("kind"))
    rows = _keyed(turns.where(~F.col("dropped"))).select("conv_id", "turn", "role", "text", "digest", F.lit(1).alias("kind"))

    def run(batches):
        conv = audit = None
        at = place = odd = 0

        def role():
            return "user" if (place + odd) % 2 == 0 else "assistant"

        for batch in batches:
            out = []
            for conv_id, turn, name, text, kind in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "kind"))):
                if kind == 0:
                    while audit is not None and at < len(audit):
                        out.append((conv, place, "I", None, role(), ""))
                        at, place = at + 1, place + 1
                    conv, audit, at, place = conv_id, text, 0, 0
                    odd = (len(audit) - audit.count("D")) % 2
                    continue
                while audit[at] == "I":
                    out.append((conv, place, "I", None, role(), ""))
                    at, place = at + 1, place + 1
                if audit[at] != "D":
                    out.append((conv, place, audit[at], turn, name if audit[at] == "K" else role(), text))
                    place += 1
                at += 1
            yield _batch(out, TURNS)
        if audit is not None and at < len(audit):
            out = []
            for at in range(at, len(audit)):
                out.append((conv, place, "I", None, role(), ""))
                place += 1
            yield _batch(out, TURNS)

    return _in_order(audits.unionByName(rows), "kind").drop("digest").mapInArrow(run, TURNS)


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, sha) of the lines `role:text` of each conversation, joined by line ends. Rows come in order, as repaired() gives them."""

    def run(batches):
        conv, sha = None, None
        for batch in batches:
            ids, out = [], []
            for found, start, end in _runs(batch.column("conv_id")):
                if sha is None or found != conv:
                    if sha is not None:
                        ids.append(conv)
                        out.append(sha.hexdigest())
                    conv, sha, between = found, hashlib.sha256(), b""
                for role, text in zip(*(batch.column(c).slice(start, end - start).to_pylist() for c in ("role", "text"))):
                    sha.update(between + role.encode() + b":" + text.encode())
                    between = b"\n"
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], names=["conv_id", "sha"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([sha.hexdigest()])], names=["conv_id", "sha"])

    return turns.mapInArrow(run, "conv_id long, sha string")


def op11_turn_structure(spark, sf_dir: str) -> DataFrame:
    """Every conv_id, the faults worked in, the cost and audit of its repair, and the digest of the repaired turns."""
    from millrace.llm.common import table

    turns = damaged(table(spark, sf_dir, "conversations"))
    found = Scratch(spark, "turns").stored(reports(turns), "reports")
    hashed = digests(repaired(turns, found)).withColumnRenamed("conv_id", "of")
    sha = F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256")
    return found.join(hashed, F.col("conv_id").eqNullSafe(F.col("of")), "left").select(*found.columns, sha)
