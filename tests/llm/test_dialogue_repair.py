"""Repair of conversations against a plain version that searches all edits."""

import hashlib
import heapq
import zlib
from collections import defaultdict
from itertools import groupby

import pytest
from brindle.llm import dialogue_repair as repair
from brindle.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WS = " \t\n\x0b\x0c\r"


def plain(turns):
    by = defaultdict(list)
    for conv, turn, role, text in turns:
        role, text = " " if role is None else role, " " if text is None else text
        by[conv]
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else "".join(c for c in text if c not in ".!?") if k == 2 else text
        by[conv] += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    out = {}
    for conv, rows in by.items():
        rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in rows:
            bare = text.rstrip(WS)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        known = [t for t, _, _ in rows if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        initials = [r[1][:1] for r in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        # the cheapest edits, the ASCII-least audit first: a search over (cost, audit, row, initial of the last)
        heap, done = [(0, "", 0, "", ())], set()
        while True:
            cost, audit, i, last, kept = heapq.heappop(heap)
            if i == len(rows) and last in ("", "a"):
                break
            if (i, last) in done:
                continue
            done.add((i, last))
            turn = "a" if last == "u" else "u"
            heapq.heappush(heap, (cost + 5, audit + "I", i, turn, (*kept, {"u": "user:", "a": "assistant:"}[turn])))
            if i < len(rows):
                _, role, text = rows[i]
                heapq.heappush(heap, (cost + 2, audit + "D", i + 1, last, kept))
                if faults[i] not in ("blank", "duplicate"):
                    more = 5 if faults[i] == "truncated" else 0
                    heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, turn, (*kept, {"u": "user:", "a": "assistant:"}[turn] + text)))
                    if role[:1] == turn or (role[:1] == "s" and not last):
                        heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[:1], (*kept, f"{role}:{text}")))
        digest = hashlib.sha256("\n".join(kept).encode()).hexdigest()
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, digest)
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_query_against_the_search(spark):
    turns = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in QUERIES["op12_dialogue_repair"](spark, SF).collect()}
    assert got == plain(turns)


def odd_turns():
    import random

    draw = random.Random(5)
    rows = []
    for conv in [*range(120), None]:
        for turn in range(draw.randint(1, 9)):
            at = draw.choice([turn, turn, turn + 3, None, 2])
            text = draw.choice(["Yes.", "No", "Well?", "", None, " \n", "Ça va ", "One. Two", f"{turn}!", "Yes."])
            rows.append((conv, at, draw.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "umpire"]), text))
    return [*rows, *rows[:9], (500, None, "user", "Hi."), (501, 7, "system", "Only."), (502, 4, "user", "x" * 300_000)]


def test_odd_rows(spark):
    rows = odd_turns()
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, copies int")
    want = plain(rows)
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in repair.repair_conversations(turns).collect()}
    assert got == want
    mended = sorted(repair.repaired_turns(turns).collect(), key=lambda r: (r.conv_id is not None, r.conv_id or 0, r.position))
    texts = {conv: "\n".join(f"{r.role}:{r.text}" for r in g) for conv, g in groupby(mended, key=lambda r: r.conv_id)}
    assert all(hashlib.sha256(texts.get(conv, "").encode()).hexdigest() == w[-1] for conv, w in want.items())
    assert repair.repair_conversations(turns.limit(0)).count() == 0


@pytest.mark.parametrize("signatures", [["", "x", "xo", "ua"[::-1], "uaS"[::-1], "a" * 9, "uuaaOxsua"]])
def test_nodes_are_shared_and_give_what_each_signature_alone_does(signatures):
    together = list(repair.audits(iter(sorted(signatures))))
    assert together == [x for s in sorted(signatures) for x in repair.audits(iter([s]))]
