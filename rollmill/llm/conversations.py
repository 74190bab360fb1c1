"""Repair of conversation structure: cheapest edits by Four-Russians tables over blocks of row symbols."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollmill.llm.staging import shuffle_parts, written
from rollmill.operators.keyed import attach_group_stats

#: Costs of the edits.
RENAME, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: What the roles so far allow: nothing yet, a system row, a user row, an assistant row. Nothing and assistant may be the end.
START, SYSTEM, USER, ASSISTANT = range(4)
#: By state: the state after a kept row, by the initial of its role (s, u, a, other); and the one after a row made user or assistant.
KEPT = ((SYSTEM, USER, None, None), (None, USER, None, None), (None, None, ASSISTANT, None), (None, USER, None, None))
MADE = (USER, USER, ASSISTANT, USER)
NAME = {USER: "user", ASSISTANT: "assistant"}
#: Symbols: initial of the role (0 to 3), 4 more if truncated; one for all rows that have to go.
GONE, SYMBOLS = 8, 9
BLOCK = 4
#: Row codes: initial + 4 * fault (none, blank, duplicate, truncated); and the symbol of each code.
BLANK, DUPLICATE, CUT = 1, 2, 3
_SYMBOL = np.array([(i, GONE, GONE, i + 4)[fault] for fault in range(4) for i in range(4)], np.uint8)
#: Initials that may follow each other: system user, user assistant, assistant user.
_LEGAL = np.zeros((4, 4), bool)
_LEGAL[[0, 1, 2], [1, 2, 1]] = True
_FAR = 1 << 20
#: Blocks whose expansion a worker remembers.
REMEMBERED = 1 << 16


def _options(state: int, symbol: int) -> list[tuple[str, int, int]]:
    """Edits of a row in a state: letter, cost and the state behind it."""
    out = [("D", DELETE, state)]
    if symbol != GONE:
        extra = TRUNCATED if symbol >= 4 else 0
        if KEPT[state][symbol % 4] is not None:
            out.append(("K", extra, KEPT[state][symbol % 4]))
        out.append(("R", RENAME + extra, MADE[state]))
    return out


def _with_inserts(costs: list[int]) -> tuple[int, ...]:
    for _ in range(4):
        costs = [min(c, INSERT + costs[MADE[s]]) for s, c in enumerate(costs)]
    return tuple(costs)


#: What is still to pay in each state when no row is left.
AT_END = _with_inserts([0, _FAR, _FAR, 0])


def ahead_of(symbol: int, costs: tuple[int, ...]) -> tuple[int, ...]:
    """What is still to pay in each state ahead of a row, from what is to pay behind it."""
    return _with_inserts([min(c + costs[s] for _, c, s in _options(state, symbol)) for state in range(4)])


def choose(symbol: int | None, costs: tuple[int, ...], state: int) -> tuple[str, int]:
    """The ASCII-least of the cheapest edits at a row (None: at the end), inserts ahead of it included, and the state behind it.

    A letter fixes the state behind it, so the least letter that keeps the cost is the right one, row by row.
    """
    letters = ""
    ahead = costs if symbol is None else ahead_of(symbol, costs)
    while True:
        options = [("I", INSERT + ahead[MADE[state]], MADE[state], False)]
        if symbol is not None:
            options += [(x, c + costs[s], s, True) for x, c, s in _options(state, symbol)]
        elif state in (START, ASSISTANT):
            options.append(("", 0, state, True))
        letter, _, state, done = min(o for o in options if o[1] == ahead[state])
        letters += letter
        if done:
            return letters, state


class Tables:
    """Transitions of cost vectors over blocks of symbols, worked out once.

    A vector less its least entry is one of a few; they are numbered. ``after[size][block, v]`` is the vector ahead of a block whose
    symbols are the digits of its number, if v stands behind it, and ``paid`` the entry taken off on the way.
    """

    def __init__(self) -> None:
        self.vectors, number = [AT_END], {AT_END: 0}
        step, paid = [], []
        for v in self.vectors:  # grows on the way, until no new vector comes up
            row, cost = [], []
            for symbol in range(SYMBOLS):
                ahead = ahead_of(symbol, v)
                normal = tuple(c - min(ahead) for c in ahead)
                if normal not in number:
                    number[normal] = len(self.vectors)
                    self.vectors.append(normal)
                row.append(number[normal])
                cost.append(min(ahead))
            step.append(row)
            paid.append(cost)
        n = len(self.vectors)
        one, one_paid = np.array(step).T, np.array(paid).T
        self.after, self.paid = [np.arange(n)[None]], [np.zeros((1, n), np.int64)]
        for _ in range(BLOCK):
            # A block is its first symbol, and a shorter block behind it.
            rest, rest_paid = self.after[-1], self.paid[-1]
            self.after.append(one[:, rest].reshape(-1, n))
            self.paid.append((rest_paid[None] + one_paid[:, rest]).reshape(-1, n))
        self.known: dict[tuple[bytes, int, int], tuple[str, int]] = {}

    def expand(self, block: bytes, behind: int, state: int) -> tuple[str, int]:
        """Edits of a block and the state behind it: the vectors inside it are worked out backward, the choices made forward."""
        key = block, behind, state
        if key not in self.known:
            costs = [self.vectors[behind]]
            for symbol in reversed(block):
                costs.append(ahead_of(symbol, costs[-1]))
            letters = ""
            for symbol, after in zip(block, reversed(costs[:-1])):
                some, state = choose(symbol, after, state)
                letters += some
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[key] = letters, state
        return self.known[key]

    def solve(self, symbols: np.ndarray) -> tuple[int, str]:
        """The least cost of all edits, and the ASCII-least of the cheapest."""
        short = len(symbols) % BLOCK
        digits = symbols[short:].reshape(-1, BLOCK).astype(np.int64) @ (SYMBOLS ** np.arange(BLOCK - 1, -1, -1))
        after, paid = self.after[BLOCK], self.paid[BLOCK]
        behind, v, cost = [], 0, 0
        for block in digits[::-1].tolist():
            behind.append(v)
            cost += int(paid[block, v])
            v = int(after[block, v])
        behind.append(v)
        first = int(symbols[:short].astype(np.int64) @ (SYMBOLS ** np.arange(short - 1, -1, -1))) if short else 0
        cost += int(self.paid[short][first, v]) + self.vectors[int(self.after[short][first, v])][START]
        raw, letters, state, at = symbols.tobytes(), [], START, 0
        for upto, v in zip(range(short, len(raw) + 1, BLOCK), reversed(behind)):
            some, state = self.expand(raw[at:upto], v, state)
            letters.append(some)
            at = upto
        letters.append(choose(None, AT_END, state)[0])
        return cost, "".join(letters)


@cache
def tables() -> Tables:
    return Tables()


_KEY = ["_conv", "_turn", "_role", "_digest"]


def _coded(rows: DataFrame) -> DataFrame:
    """One row for each (conversation, turn, role, text) with its number, its code, and whether it holds the first of its role and text.

    Texts stay behind: their SHA-256 stands for them. Rows that are not alive only name their conversation, with number 0.
    """
    stripped = F.regexp_replace("_text", r"[ \t\n\x0B\f\r]+\z", "")
    fault = F.when(stripped == "", BLANK).when(F.substring(stripped, -1, 1).isin(".", "!", "?"), 0).otherwise(CUT)
    first = F.substring("_role", 1, 1)
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    some = rows.select("_conv", "_turn", "_role", "_digest", "_alive", (initial + 4 * fault).cast("tinyint").alias("_code"))
    some = some.groupBy(*_KEY, "_code").agg(F.count(F.when(F.col("_alive"), 1)).alias("_n"))
    # The first turn (null before all others) of every role and text in a conversation.
    living = F.when(F.col("_n") > 0, F.struct(F.col("_turn")))
    some = attach_group_stats(some, ["_conv", "_role", "_digest"], F.min(living).alias("_least"), salt=["_turn"])
    return some.withColumn("_first", (F.col("_n") > 0) & F.col("_least._turn").eqNullSafe(F.col("_turn"))).drop("_least")


def _runs(coded: DataFrame) -> DataFrame:
    """Conversations in pieces: row codes in order of turn (nulls first), role and digest, as one string per conversation and Arrow batch,
    with its place in the order and its turns."""
    kind = coded.schema["_conv"].dataType.simpleString()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 40
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, turn, code, first, n = batch.columns
            same = np.asarray(conv.dictionary_encode("encode").indices)
            bounds = np.concatenate([[0], np.flatnonzero(np.diff(same)) + 1, [len(same)]])
            n, code = np.asarray(n), np.asarray(code).astype(np.uint8)
            # The first row of a role and text has its own fault, all others are duplicates unless blank.
            again = np.where(code // 4 == BLANK, code, code % 4 + 4 * DUPLICATE).astype(np.uint8)
            codes, ends = np.repeat(again, n), np.concatenate([[0], np.cumsum(n)])
            own = np.asarray(first)
            codes[ends[:-1][own]] = code[own]
            strings = [codes[ends[a] : ends[b]].tobytes() for a, b in zip(bounds, bounds[1:])]
            counted = pa.array(turn).filter(pa.array(n > 0))
            held = np.concatenate([[0], np.cumsum(n > 0)])
            turns = [[t for t in counted[held[a] : held[b]].to_pylist() if t is not None] for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [conv.take(pa.array(bounds[:-1])), pa.array(place + np.arange(len(strings))), pa.array(strings, pa.binary()),
                 pa.array([t[0] if t else None for t in turns], pa.int64()), pa.array([t[-1] if t else None for t in turns], pa.int64()),
                 pa.array([len(set(t)) for t in turns], pa.int64())],
                ["_conv", "place", "codes", "low", "high", "turns"],
            )
            place += len(strings)

    order = [F.col("_conv"), F.col("_turn").asc_nulls_first(), F.col("_role"), F.col("_digest")]
    ranged = coded.repartitionByRange(shuffle_parts(coded.sparkSession), *order).sortWithinPartitions(*order)
    return ranged.select("_conv", "_turn", "_code", "_first", "_n").mapInArrow(
        packed, f"_conv {kind}, place long, codes binary, low long, high long, turns long")


_FOUND = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _audits(runs: DataFrame) -> DataFrame:
    """Counts, cost and audit of every conversation, from its pieces."""
    kind = runs.schema["_conv"].dataType.simpleString()

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for pieces in batch.column(1).to_pylist():
                codes = np.frombuffer(b"".join(p["codes"] for p in pieces), np.uint8)
                known = [p for p in pieces if p["low"] is not None]
                # A turn that ends one piece and begins the next is one turn.
                turns = sum(p["turns"] for p in known) - sum(p["high"] == q["low"] for p, q in zip(known, known[1:]))
                gaps = known[-1]["high"] - known[0]["low"] + 1 - turns if known else 0
                faults = np.bincount(codes // 4, minlength=4)
                illegal = int((~_LEGAL[codes[:-1] % 4, codes[1:] % 4]).sum())
                cost, audit = tables().solve(_SYMBOL[codes])
                rows.append((gaps, *(int(faults[k]) for k in (BLANK, DUPLICATE, CUT)), illegal, cost, audit))
            columns = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:6]], pa.array(columns[6], pa.string())], ["_conv", *_FOUND, "audit"])

    pieces = runs.groupBy("_conv").agg(F.array_sort(F.collect_list(F.struct("place", "codes", "low", "high", "turns"))).alias("pieces"))
    return pieces.mapInArrow(solved, f"_conv {kind}, {', '.join(f'{c} long' for c in _FOUND)}, audit string")


class _Repair:
    """The repaired rows of one conversation, as they come in order."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state, self.sha, self.lines = audit, 0, START, hashlib.sha256(), 0

    def _put(self, role: str, text: str) -> None:
        self.sha.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
        self.lines += 1

    def _inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self.state = MADE[self.state]
            self._put(NAME[self.state], "")

    def row(self, role: str, text: str) -> None:
        self._inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = KEPT[self.state]["sua".find(role[:1])]
            self._put(role, text)
        elif letter == "R":
            self.state = MADE[self.state]
            self._put(NAME[self.state], text)

    def digest(self) -> str:
        self._inserts()
        return self.sha.hexdigest()


def repair_conversations(
    rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    alive_col: str | None = None,
) -> DataFrame:
    """One row per conversation: its faults, and the cheapest edits that make its role initials match ``(s?(ua)+)?``.

    Rows are taken by turn (nulls first), rows of one turn by role and then by the SHA-256 of their text; null roles and texts are one
    blank. A row's first fault counts: blank (nothing but white space), duplicate (role and text seen earlier), truncated (its last
    character that is no white space is none of ``.!?``). Edits: Keep for 0, Rerole to user or assistant for 1, Delete for 2 (a must for
    blank and duplicate rows), Insert an empty user or assistant row for 5; truncated rows that stay cost 5 more.

    Columns: the conversation, gaps (missing whole turns between least and greatest), blank, duplicate, truncated, illegal (neighbours
    whose initials are not su, ua or au), cost, audit (initials of the cheapest edits in order, of equal ones the ASCII-least) and
    repaired_sha256 (of the repaired ``role:text`` lines). Rows whose ``alive_col`` is false or null only name their conversation: without
    a living row it has zeros, an empty audit and the hash of nothing. A null conversation is one like any other. Repeated rows are
    duplicates. Turns are integers. Other columns are dropped, whatever their names; an empty table gives an empty result.

    Codes of rows are worked out without their texts, and put in order by a range exchange, so that a conversation of any size is
    spread over tasks; per conversation one byte a row comes together, as in the audit itself. Four-Russians tables take the cost
    vector across blocks of four rows at a time, from the last row to the first; then each block is expanded from the vector behind it.
    Texts move once, to be hashed in order: a task streams them, since a SHA-256 has to be taken from start to end.
    """
    kind = rows.schema[conv_col].dataType.simpleString()
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(" "))
    d = rows.select(
        F.col(f"`{conv_col}`").alias("_conv"), F.col(f"`{turn_col}`").cast("long").alias("_turn"),
        F.coalesce(F.col(f"`{role_col}`"), F.lit(" ")).alias("_role"), text.alias("_text"), F.unhex(F.sha2(text, 256)).alias("_digest"),
        (F.coalesce(F.col(f"`{alive_col}`"), F.lit(False)) if alive_col else F.lit(True)).alias("_alive"),
    )
    audits = written(_audits(_runs(_coded(d))), "audits")

    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, repair = None, None
        for batch in batches:
            done, shas = [], []
            head, found = batch.column(0), batch.column(3)
            for i, (role, line, audit) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), found.to_pylist())):
                if audit is None:
                    repair.row(role, line)
                    continue
                if repair is not None:
                    done.append(current)
                    shas.append(repair.digest())
                current, repair = batch.slice(i, 1), _Repair(audit["audit"])
            if done:
                yield finished(done, shas)
        if repair is not None:
            yield finished([current], [repair.digest()])

    def finished(heads: list[pa.RecordBatch], shas: list[str]) -> pa.RecordBatch:
        heads = pa.concat_batches(heads)
        found = heads.column(3)
        return pa.RecordBatch.from_arrays([heads.column(0), *[found.field(c) for c in (*_FOUND, "audit")], pa.array(shas)], ["_conv", *_FOUND, "audit", "sha"])

    head = audits.select("_conv", F.lit(None).cast("long").alias("_turn"), F.lit(None).cast("string").alias("_role"),
                         F.lit(None).cast("binary").alias("_digest"), F.lit(None).cast("string").alias("_text"), F.struct(*_FOUND, "audit").alias("_found"))
    living = d.where("_alive").select("_conv", "_turn", "_role", "_digest", "_text", F.lit(None).cast(head.schema["_found"].dataType).alias("_found"))
    together = living.unionByName(head).repartition(shuffle_parts(rows.sparkSession), "_conv")
    in_order = together.sortWithinPartitions("_conv", F.col("_found").isNull(), F.col("_turn").asc_nulls_first(), "_role", "_digest")
    schema = f"_conv {kind}, {', '.join(f'{c} long' for c in _FOUND)}, audit string, repaired_sha256 string"
    return in_order.select("_conv", "_role", "_text", "_found").mapInArrow(repaired, schema).withColumnRenamed("_conv", conv_col)


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with planted faults, by crc32(``conv_id:turn``) % 20 (nulls: one blank): 0 drops a row, 1 empties its text, 2 takes
    ``[.!?]`` out of it, 3 repeats it, 4 makes its role user. Dropped rows stay with ``alive`` false."""
    or_blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case: Column = F.crc32(F.concat_ws(":", or_blank("conv_id"), or_blank("turn")).cast("binary")) % 20
    return rows.select("conv_id", "turn", or_blank("role").alias("role"), or_blank("text").alias("text"), case.alias("case")).select(
        "conv_id", "turn", F.when(F.col("case") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("case") == 1, "").when(F.col("case") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (F.col("case") != 0).alias("alive"), F.explode(F.when(F.col("case") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")
