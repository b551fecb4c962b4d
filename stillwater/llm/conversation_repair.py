"""Repair of conversations: the cheapest edits that make the roles a legal sequence, by Four-Russians block tables.

Legal are `(s?(ua)+)?`, written in first letters of roles: perhaps a system message, then user and assistant in turns. A row is
kept (K, 0), given the role that is due (R, 2) or deleted (D, 3); messages without text are inserted (I, 2). Blank rows and rows
whose role and text the conversation had before must go; rows that end without a mark cost 1 unless deleted. Of the
cheapest sequences of edits the one least in ASCII is taken.

The costs to the end from the four places of the grammar (start, after s, u, a) differ by at most 4, so less their minimum they
are a few dozen vectors. For each vector and each block of `BLOCK` symbols the vector before the block and what it adds are
tabulated once; a conversation's blocks are looked up from the last to the first. Then the blocks are gone back over and
expanded row by row: the vectors inside a block are known again from the one at its end, and of the edits that stay
on a cheapest way the least letter is taken, so ties need no other pass.

Rows that must go change no vector and take `D` at once. Rows of a conversation are in order of turn (nulls first), role and
text digest; equal rows are one row with a count. These narrow rows are sorted over ranges, so a conversation of any length is
spread over many tasks: a task answers for what it holds whole and gives for the pieces at its edges their block function (for
each vector at the end the one at the beginning, for each entry place the exit). The pieces' functions, two a task, are
chained by the driver, then the pieces are expanded with the vector and place they are given. Texts travel once, at last,
to meet their edits.

Cases: a null id is a conversation of its own; a null role or text is one space, a null turn comes first and counts in no gap;
a role whose first letter is none of s, u, a is never kept; repeated rows are duplicates; without rows there is nothing
to repair. Columns other than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillwater.llm.common import written

START, S, U, A = range(4)
DUE = {START: U, S: U, U: A, A: U}  # what a new or changed message is, by place
NAMES = {U: "user", A: "assistant"}
KINDS = "suax"  # x: any other letter
SYMBOLS = [(letter, cut) for letter in KINDS for cut in (0, 1)]
END = (0, 4, 2, 0)
BLOCK = 4
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
NONE = len(SYMBOLS)  # no row: fills a conversation's last block


def kept_to(place: int, letter: str) -> int | None:
    if place == START and letter == "s":
        return S
    return DUE[place] if letter == {U: "u", A: "a"}[DUE[place]] else None


def moves(place: int, symbol: int) -> Iterator[tuple[str, int, int]]:
    """Edits of a row at a place, but for inserts: letter, cost, next place."""
    letter, cut = SYMBOLS[symbol]
    yield "D", DELETE, place
    if (to := kept_to(place, letter)) is not None:
        yield "K", KEEP + cut, to
    yield "R", REROLE + cut, DUE[place]


def before(costs: tuple, symbol: int) -> tuple:
    """Costs to the end before a row, from those behind it; inserts may come first."""
    own = [min(c + costs[to] for _, c, to in moves(p, symbol)) for p in range(4)]
    for _ in range(2):
        own = [min(own[p], INSERT + own[DUE[p]]) for p in range(4)]
    return tuple(own)


def edits(costs: tuple, symbol: int, place: int) -> tuple[str, int]:
    """The least letters of a cheapest way over one row, and the place behind it."""
    own = before(costs, symbol)
    letters = ""
    while True:
        ways = [(letter, to) for letter, c, to in moves(place, symbol) if c + costs[to] == own[place]]
        if own[place] == INSERT + own[DUE[place]]:
            ways.append(("I", DUE[place]))
        letter, to = min(ways)
        letters, place = letters + letter, to
        if letter != "I":
            return letters, place


@cache
def tables() -> dict:
    """Vectors, one-row steps, edits of a row, and the block table: the vector before a block for each vector behind it."""
    vectors, step = [END], []
    number = {END: 0}
    for v in vectors:
        row = []
        for symbol in range(NONE):
            new = before(v, symbol)
            least = min(new)
            new = tuple(x - least for x in new)
            if new not in number:
                number[new] = len(vectors)
                vectors.append(new)
            row.append(number[new])
        step.append([*row, number[v]])
    steps = np.array(step, np.uint16)
    block = np.arange(len(vectors), dtype=np.uint16)[:, None]
    for _ in range(BLOCK):  # block codes have the last symbol first, in base NONE + 1
        block = steps[block].reshape(len(vectors), -1)
    rows = {(v, symbol, p): edits(vectors[v], symbol, p) for v, symbol, p in product(range(len(vectors)), range(NONE), range(4))}
    return {"vectors": vectors, "step": step, "block": block, "edits": rows}


def codes(symbols: list[int]) -> list[int]:
    """The blocks' codes, the last block first."""
    filled = symbols + [NONE] * (-len(symbols) % BLOCK)
    out = []
    for at in range(len(filled) - BLOCK, -1, -BLOCK):
        code = 0
        for symbol in reversed(filled[at : at + BLOCK]):
            code = code * (NONE + 1) + symbol
        out.append(code)
    return out


def backward(symbols: list[int], vectors: np.ndarray) -> list[np.ndarray]:
    """The vectors behind each block and before the first one (given behind the last), the first block's first."""
    block, out = tables()["block"], [vectors]
    for code in codes(symbols):
        out.append(block[out[-1], code])
    return out[::-1]


def expand(symbols: list[int], vector: int, place: int) -> tuple[list[str], list[int], int]:
    """Letters of each row, the place before each, and the place at the end."""
    t = tables()
    step, rows = t["step"], t["edits"]
    ends = backward(symbols, np.array([vector]))
    letters, places = [], []
    for b, at in enumerate(range(0, len(symbols), BLOCK)):
        part = symbols[at : at + BLOCK]
        inside = [int(ends[b + 1][0])]
        for symbol in reversed(part[1:]):
            inside.append(step[inside[-1]][symbol])
        for symbol, v in zip(part, reversed(inside), strict=True):
            places.append(place)
            text, place = rows[v, symbol, place]
            letters.append(text)
    return letters, places, place


def closing(place: int) -> str:
    return {START: "", S: "II", U: "I", A: ""}[place]


def exits(symbols: list[int]) -> np.ndarray:
    """For each vector behind the rows and each place before them, the place behind them."""
    t = tables()
    n = len(t["vectors"])
    step, to = np.array(t["step"]), np.zeros((n, NONE, 4), np.int8)
    for (v, symbol, p), (_, place) in t["edits"].items():
        to[v, symbol, p] = place
    ends = backward(symbols, np.arange(n))
    place = np.tile(np.arange(4), (n, 1))
    for b, at in enumerate(range(0, len(symbols), BLOCK)):
        part = symbols[at : at + BLOCK]
        inside = [ends[b + 1].astype(np.int64)]
        for symbol in reversed(part[1:]):
            inside.append(step[inside[-1], symbol])
        for symbol, v in zip(part, reversed(inside), strict=True):
            place = to[v[:, None], symbol, place]
    return place


KEY = ["c", "t", "role", "d"]
EDITS = "n long, blank boolean, cut boolean, again boolean, at long, letters string, roles array<string>, own int, bad long"


def narrow(conversations: DataFrame) -> DataFrame:
    """One row for equal rows of a conversation, without text: c, t, role, d (digest of the text), n, blank, cut, again
    (the conversation had role and text at an earlier turn)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    rows = conversations.select(
        F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.unhex(F.sha2(text, 256)).alias("d"),
        (~text.rlike(r"[^\x20\x09-\x0D]")).alias("blank"), (~text.rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("cut"),
    )
    rows = written(rows.groupBy(*KEY, "blank", "cut").agg(F.count("*").alias("n")), "rows")
    turn = F.struct(F.col("t").isNotNull().alias("some"), F.col("t").alias("t"))
    first = rows.groupBy("c", "role", "d").agg(F.min(turn).alias("first"), F.count("*").alias("k")).where("k > 1").select(F.col("c").alias("c2"), F.col("role").alias("role2"), F.col("d").alias("d2"), "first")
    joined = rows.join(first, rows["c"].eqNullSafe(first["c2"]) & (rows["role"] == first["role2"]) & (rows["d"] == first["d2"]), "left")
    return joined.select(*KEY, "n", "blank", "cut", F.coalesce(turn > F.col("first"), F.lit(False)).alias("again"))


def columns_of(table: pa.Table) -> dict:
    """Rows of pieces in order: symbol (-1: must go), first letter of the role, place of the conversation's change."""
    go = np.asarray(table["blank"]) | np.asarray(table["again"])
    letters = [r[:1] for r in table["role"].to_pylist()]
    kind = np.array([KINDS.index(x) if x and x in KINDS else 3 for x in letters], np.int64)
    return {"symbol": np.where(go, -1, kind * 2 + np.asarray(table["cut"])), "letter": letters, "n": np.asarray(table["n"])}


LEGAL = {"su", "ua", "au"}


def edited(rows: dict, roles: list[str], vector: int, place: int, last: bool, prior: str | None) -> tuple[list, list, list, list]:
    """Of each row of a piece: letters, roles of the messages that stand for it, which of them is its own, illegal neighbours."""
    symbols = rows["symbol"].tolist()
    texts, places, end = expand([s for s in symbols if s >= 0], vector, place)
    ways, out = iter(zip(texts, places, strict=True)), ([], [], [], [])
    for k, (symbol, n, letter) in enumerate(zip(symbols, rows["n"].tolist(), rows["letter"], strict=True)):
        made, own = [], -1
        if symbol < 0:
            text = "D" * n
        else:
            text, at = next(ways)
            for x in text:
                if x in "KR":
                    own = len(made)
                if x == "K":
                    made.append(roles[k])
                    at = kept_to(at, letter)
                elif x != "D":
                    at = DUE[at]
                    made.append(NAMES[at])
            text += "D" * (n - 1)
        if last and k == len(symbols) - 1:
            for x in closing(end):
                end = DUE[end]
                made.append(NAMES[end])
                text += x
        bad = n - 1 + (prior is not None and prior + letter not in LEGAL)
        prior = letter
        for values, v in zip(out, (text, made, own, bad), strict=True):
            values.append(v)
    return out


def resolved(table: pa.Table, at: int, found: tuple[list, list, list, list]) -> dict:
    ends = dict(zip(("letters", "roles", "own", "bad"), found, strict=True))
    kinds = {"letters": pa.string(), "roles": pa.list_(pa.string()), "own": pa.int32(), "bad": pa.int64()}
    out = {c: table[c].combine_chunks() for c in [*KEY, "n", "blank", "cut", "again"]}
    return out | {"at": pa.array(np.arange(at, at + table.num_rows))} | {c: pa.array(ends[c], kinds[c]) for c in kinds}


def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range of the sorted rows: whole conversations edited, the pieces at its two edges as they are, with their functions."""
    table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
    if table is None or not table.num_rows:
        return
    part, total = TaskContext.get().partitionId(), table.num_rows
    rows = columns_of(table)
    code = table["c"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    cuts = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    roles = table["role"].to_pylist()
    found, edge, functions = ([], [], [], []), np.zeros(total, np.int8), []
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), total], strict=True):
        piece = {k: v[a:b] for k, v in rows.items()}
        if 0 < a and b < total:
            got = edited(piece, roles[a:b], 0, START, True, None)
        else:
            edge[a:b] = 1 if a == 0 else 2
            symbols = [s for s in piece["symbol"].tolist() if s >= 0]
            behind = np.arange(len(tables()["vectors"]))
            functions.append((int(edge[a]), a, [*backward(symbols, behind)[0].tolist(), *exits(symbols).ravel().tolist()], piece["letter"][-1]))
            got = tuple([v] * (b - a) for v in ("", [], -1, 0))
        for values, more in zip(found, got, strict=True):
            values.extend(more)
    out = resolved(table, part << 40, found)
    out |= {"part": pa.array(np.full(total, part, np.int32)), "edge": pa.array(edge.astype(np.int32)), "fn": pa.nulls(total, pa.list_(pa.int32())), "end": pa.nulls(total, pa.string())}
    yield pa.RecordBatch.from_pydict(out)
    for e, a, fn, end in functions:
        row = {c: v.slice(a, 1) for c, v in out.items()}
        yield pa.RecordBatch.from_pydict(row | {"edge": pa.array([-e], pa.int32()), "fn": pa.array([fn], pa.list_(pa.int32())), "end": pa.array([end])})


def chained(pieces: list) -> dict[tuple[int, int], tuple[int, int, bool, str | None]]:
    """Vector behind, place before, whether it is the conversation's last, and the letter before, of each piece at an edge."""
    pieces = sorted(pieces, key=lambda r: (r.part, -r.edge))
    n, out, at = len(tables()["vectors"]), {}, 0
    while at < len(pieces):
        to = at + 1
        while to < len(pieces) and pieces[to].c == pieces[at].c:
            to += 1
        group, behind = pieces[at:to], [0]
        for r in reversed(group[1:]):
            behind.append(r.fn[behind[-1]])
        place, prior = START, None
        for k, (r, v) in enumerate(zip(group, reversed(behind), strict=True)):
            out[r.part, -r.edge] = (v, place, k == len(group) - 1, prior)
            place, prior = r.fn[n + 4 * v + place], r.end
        at = to
    return out


def edit_rows(conversations: DataFrame) -> DataFrame:
    """The edits of each distinct row: its key, n, blank, cut, again, at (the order of rows), letters, roles, own, bad."""
    rows = narrow(conversations)
    key = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*KEY).schema)
    schema = f"{key}, {EDITS}"
    whole = written(rows.repartitionByRange(*KEY).sortWithinPartitions(*KEY).mapInArrow(first_pass, f"{schema}, part int, edge int, fn array<int>, end string"), "edits")
    answers = chained(whole.where("edge < 0").select("c", "part", "edge", "fn", "end").collect())  # two a task

    def second_pass(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        at = table["at"][0].as_py()
        found = edited(columns_of(table), table["role"].to_pylist(), *answers[table["part"][0].as_py(), table["edge"][0].as_py()])
        return pa.Table.from_pydict(resolved(table, at, found))

    return whole.where("edge = 0").drop("part", "edge", "fn", "end").unionByName(whole.where("edge > 0").groupBy("part", "edge").applyInArrow(second_pass, schema))


def texts(conversations: DataFrame) -> DataFrame:
    """Key and text of every row that is not blank; copies that follow each other closely go once."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    rows = conversations.select(
        F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.unhex(F.sha2(text, 256)).alias("d"), text.alias("text")
    ).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))

    def fresh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, None] = {}
        for part in batches:
            keep = []
            for key in zip(*(part.column(c).to_pylist() for c in KEY), strict=True):
                keep.append(key not in seen)
                seen[key] = None
            while len(seen) > 4096:
                seen.pop(next(iter(seen)))
            yield part.filter(pa.array(keep))

    return rows.mapInArrow(fresh, rows.schema)


def told(conversations: DataFrame, edits: DataFrame, also: DataFrame | None = None) -> DataFrame:
    """Edits and texts in one table, each row's edit before its text. side: 0 edit, 1 text, -1 a row of `also`."""
    both = edits.withColumn("side", F.lit(0)).unionByName(texts(conversations).withColumn("side", F.lit(1)), allowMissingColumns=True)
    return both if also is None else both.unionByName(also.withColumn("side", F.lit(-1)), allowMissingColumns=True)


def repair(conversations: DataFrame) -> DataFrame:
    """One row for each edit: conv_id, at and step (their order in the conversation), edit, turn (null if inserted), role and
    text (null if deleted)."""
    sides = told(conversations, edit_rows(conversations))
    kinds = {f.name: f.dataType.simpleString() for f in sides.schema}
    schema = f"conv_id {kinds['c']}, at long, step long, edit string, turn {kinds['t']}, role string, text string"

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_row: dict | None = None
        for part in batches:
            rows: list[tuple] = []
            for r in part.select(["side", *KEY, "n", "at", "letters", "roles", "own", "text"]).to_pylist():
                if r["side"] == 0:
                    made = iter(enumerate(r["roles"]))
                    for k, x in enumerate(r["letters"]):
                        j, role = (None, None) if x == "D" else next(made)
                        own = j is not None and j == r["own"]
                        row = (r["c"], r["at"], k, x, None if x == "I" else r["t"], role, None if x == "D" else "")
                        if own:
                            open_row = {"key": [r[c] for c in KEY], "row": row}
                        else:
                            rows.append(row)
                elif open_row and open_row["key"] == [r[c] for c in KEY]:
                    rows.append((*open_row["row"][:-1], r["text"]))
                    open_row = None
            columns = list(zip(*rows, strict=True)) or [()] * 7
            types = [part.schema.field("c").type, pa.int64(), pa.int64(), pa.string(), part.schema.field("t").type, pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, types, strict=True)], ["conv_id", "at", "step", "edit", "turn", "role", "text"])

    return sides.repartitionByRange(*KEY).sortWithinPartitions(*KEY, "side").mapInArrow(out, schema)


DIGEST = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class Tally:
    """One conversation, as its edits and texts come by in order."""

    def __init__(self, c):
        self.c, self.sums, self.letters, self.sha, self.any = c, Counter(), [], hashlib.sha256(), False
        self.turns, self.first, self.last, self.waiting, self.rest = 0, None, None, None, []

    def say(self, role: str, text: str) -> None:
        self.sha.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
        self.any = True

    def edit(self, r: dict) -> None:
        if r["t"] is not None and r["t"] != self.last:
            self.turns += 1
            self.first = r["t"] if self.first is None else self.first
            self.last = r["t"]
        n, letters, own = r["n"], r["letters"], r["own"]
        same = 0 if r["blank"] else n if r["again"] else n - 1
        cut = not r["blank"] and not r["again"] and r["cut"]
        cost = 3 * letters.count("D") + 2 * (letters.count("I") + letters.count("R")) + (cut and own >= 0)
        for k, v in (("blank", n * r["blank"]), ("duplicate", same), ("truncated", cut), ("illegal", r["bad"]), ("cost", cost)):
            self.sums[k] += int(v)
        self.letters.append(letters)
        for role in r["roles"][: max(own, 0)] if own >= 0 else r["roles"]:
            self.say(role, "")
        if own >= 0:
            self.waiting, self.rest = (r["t"], r["role"], r["d"], r["roles"][own]), r["roles"][own + 1 :]

    def text(self, r: dict) -> None:
        if self.waiting and self.waiting[:3] == (r["t"], r["role"], r["d"]):
            self.say(self.waiting[3], r["text"])
            for role in self.rest:
                self.say(role, "")
            self.waiting = None

    def row(self) -> tuple:
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return (self.c, gaps, *(self.sums[k] for k in ("blank", "duplicate", "truncated", "illegal", "cost")), "".join(self.letters), self.sha.hexdigest())


def digests(conversations: DataFrame, ids: DataFrame) -> DataFrame:
    """One row a conversation of `ids` (column conv_id): its faults, the letters of its edits and the digest of its repair.

    The digest is one hash over all of a conversation's texts in order, so a conversation streams through one task here, whose
    memory holds the letters alone.
    """
    sides = told(conversations, edit_rows(conversations), ids.select(F.col("conv_id").alias("c")).distinct())
    kind = sides.schema["c"].dataType.simpleString()

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, done = None, []
        for part in batches:
            for r in part.select(["side", *KEY, "n", "blank", "cut", "again", "letters", "roles", "own", "bad", "text"]).to_pylist():
                if tally is None or tally.c != r["c"]:
                    if tally:
                        done.append(tally.row())
                    tally = Tally(r["c"])
                if r["side"] == 0:
                    tally.edit(r)
                elif r["side"] == 1:
                    tally.text(r)
            yield batch(done, part.schema.field("c").type)
            done, of = [], part.schema.field("c").type
        if tally:
            yield batch([tally.row()], of)

    def batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        types = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        columns = list(zip(*rows, strict=True)) or [()] * 9
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, types, strict=True)], ["conv_id", *(x.split()[0] for x in DIGEST.split(", "))])

    return sides.repartition("c").sortWithinPartitions(*KEY, "side").mapInArrow(out, f"conv_id {kind}, {DIGEST}")
