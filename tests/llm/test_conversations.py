"""Conversation repair against a plain search over all edits."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
from pyspark.sql import functions as F

from rollmill.llm import conversations as C
from rollmill.llm import queries as Q

SF = "/root/testdata/sf0.01"
SPACE = "\x20\t\n\x0b\x0c\r"
WHOLE = re.compile("(s?(ua)+)?")


def cheapest(rows):
    """(cost, audit, repaired rows) of rows (role, text, fault) by trying all edits, a row of two inserts at most in one place."""

    @lru_cache(None)
    def best(i, last, empty, inserted):
        options = []
        if i == len(rows):
            if last == "a" or empty:
                options.append((0, "", ()))
        else:
            role, text, fault = rows[i]
            add = lambda cost, letter, rest, row=(): options.append((cost + rest[0], letter + rest[1], row + rest[2])) if rest else None
            add(2, "D", best(i + 1, last, empty, 0))
            if fault not in ("blank", "duplicate"):
                extra = 5 * (fault == "truncated")
                for letter, cost, name in (("K", 0, role), ("R", 1, "user"), ("R", 1, "assistant")):
                    c = name[:1]
                    if (c == "s" and empty) or (c == "u" and last != "u") or (c == "a" and last == "u"):
                        add(cost + extra, letter, best(i + 1, c, False, 0), ((name, text),))
        if inserted < 3:
            for name in ("user", "assistant"):
                if (name == "user") == (last != "u"):
                    rest = best(i, name[0], False, inserted + 1)
                    if rest:
                        options.append((5 + rest[0], "I" + rest[1], ((name, ""),) + rest[2]))
        return min(options, key=lambda o: o[:2]) if options else None

    return best(0, "", True, 0)


def brute(rows):
    """rows: (conv, turn, role, text, alive)."""
    by_conv = defaultdict(list)
    for conv, turn, role, text, alive in rows:
        by_conv[conv]
        if alive:
            role, text = " " if role is None else role, " " if text is None else text
            by_conv[conv].append((turn is not None, turn or 0, role.encode(), hashlib.sha256(text.encode()).digest(), role, text))
    out = []
    for conv, held in by_conv.items():
        held.sort()
        seen, faulty = set(), []
        for *_, role, text in held:
            rest = text.strip(SPACE)
            fault = "blank" if not rest else "duplicate" if (role, text) in seen else "" if rest[-1] in ".!?" else "truncated"
            seen.add((role, text))
            faulty.append((role, text, fault))
        turns = [h[1] for h in held if h[0]]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        count = [sum(f == x for *_, f in faulty) for x in ("blank", "duplicate", "truncated")]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(faulty))
        cost, audit, fixed = cheapest(tuple(faulty))
        assert WHOLE.fullmatch("".join(r[:1] for r, _ in fixed))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
        out.append((conv, gaps, *count, illegal, cost, audit, sha))
    return sorted(out, key=str)


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def result(df):
    return sorted((tuple(r) for r in df.select("conv_id", *COLUMNS).collect()), key=str)


def test_tables_find_the_least_of_the_cheapest():
    t = C.tables()
    assert len(t.vectors) < 200
    rnd = random.Random(1)
    roles = ["system", "user", "assistant", "x"]
    faults = ["", "truncated", "blank"]
    cases = [c for n in range(4) for c in itertools.product(itertools.product(roles, faults), repeat=n)]
    cases += [tuple((rnd.choice(roles), rnd.choice(faults)) for _ in range(rnd.randint(4, 14))) for _ in range(1500)]
    for case in cases:
        codes = np.array([roles.index(r) + 4 * {"": 0, "truncated": C.CUT, "blank": C.BLANK}[f] for r, f in case], np.uint8)
        assert t.solve(C._SYMBOL[codes]) == cheapest(tuple((r, "", f) for r, f in case))[:2], case


def test_repair_by_brute_force(spark):
    source = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = []
    for conv, turn, role, text in source.select("conv_id", "turn", "role", "text").collect():
        case = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        rows += [(conv, turn, "user" if case == 4 else role, text, case != 0)] * (2 if case == 3 else 1)
    assert result(Q.op11_conversation_repair(spark, SF)) == brute(rows)


def test_repair_of_edge_rows(spark):
    rnd = random.Random(3)
    texts = ["Fine.", "Yes!", "cut", "", None, " \x0b\n", "Really? \t", "é日本", "a:b\n.", "Fine.\x85"]
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "agent", "User", "tool"]
    rows = [(rnd.choice([1, 2, 3, None, 2**60]), rnd.choice([None, 0, 1, 2, 5, -3]), rnd.choice(roles), rnd.choice(texts), rnd.random() < 0.9) for _ in range(60)]
    rows += [(50 + k // 12, rnd.randint(0, 14), rnd.choice(roles[:5]), rnd.choice(texts) if rnd.random() < 0.4 else f"t{k}.", True) for k in range(1200)]
    rows += [(7, 1, "user", "gone.", False), (8, None, None, None, None), (9, 3, "user", "One.", True), (9, 3, "user", "One.", True)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, alive boolean")
    df = df.withColumns({c: F.lit("x") for c in ("_conv", "_turn", "gaps", "audit", "place", "codes", "a b", "copy", "case")})
    got = result(C.repair_conversations(df, alive_col="alive"))
    assert got == brute(rows)
    assert next(r for r in got if r[0] == 7)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert C.repair_conversations(df.limit(0)).count() == 0
    assert C.repair_conversations(C.damaged(df)).count() == df.select("conv_id").distinct().count()


def test_one_long_conversation_in_many_pieces(spark):
    """In order user and assistant alternate; a third of the rows has to go, and turns repeat across pieces."""
    df = spark.range(60_000).select(
        F.lit("c").alias("conv_id"), F.expr("cast(id div 3 as int)").alias("turn"), F.expr("if(id div 3 % 2 = 0, 'user', 'assistant')").alias("role"),
        F.expr("case id % 3 when 0 then concat('t', id, '.') when 1 then '' else concat('t', id - 2, '.') end").alias("text"))
    r = C.repair_conversations(df).first()
    assert (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"]) == (0, 20_000, 20_000, 0, 40_000)
    assert (r["cost"], r["audit"].count("K"), r["audit"].count("D")) == (80_000, 20_000, 40_000)
    lines = (f"{'assistant' if k % 2 else 'user'}:t{3 * k}." for k in range(20_000))
    assert r["repaired_sha256"] == hashlib.sha256("\n".join(lines).encode()).hexdigest()
