"""Repair of conversations: blank, repeated and cut-off turns and turns out of order, mended by the cheapest edits.

Each conversation has a signature, one symbol a row for its role's initial and its fault. Signatures are taken from their end and sorted, so that
equal endings lie side by side: they are the nodes of an acyclic automaton that shares suffixes. A node knows, for each state of the grammar
of roles, the cheapest cost from there to the end and the first edits of it; the rest of the audit is that of the node behind. So costs and
audits are worked out once for each node and state, for all conversations that end alike.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, dealt_join, staged

#: Costs of the edits; a row that is cut off and stays costs CUT more.
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
#: States of the grammar (s?(ua)+)?: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where user or assistant, the one that may come next, leads from each state.
TURN = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
NEVER = 1 << 60

Choice = tuple[int, str, int]  # cost to the end, edits up to and with the next row's, state behind them


def _best(plain: list[Choice]) -> tuple[Choice, ...]:
    """plain: for each state, the best choice that inserts nothing before the next row. With up to two insertions, more are never cheapest.

    Of equal costs the audit that is ASCII-least wins. Two choices of a state never have one audit begin the other, so the edits here decide.
    """
    out = []
    for state in range(4):
        once, twice = TURN[state], TURN[TURN[state]]
        options = [plain[state], (plain[once][0] + INSERT, "I" + plain[once][1], plain[once][2]), (plain[twice][0] + 2 * INSERT, "II" + plain[twice][1], plain[twice][2])]
        out.append(min(options, key=lambda o: o[:2]))
    return tuple(out)


END = _best([(0, "", s) if s in (START, ASSISTANT) else (NEVER, "", s) for s in range(4)])


def node(symbol: str, behind: tuple[Choice, ...]) -> tuple[Choice, ...]:
    """The choices at a row's node. Symbols: x, a row that must go; s, u, a, o (another role), upper case for rows that are cut off."""
    plain = []
    for state in range(4):
        options = [(behind[state][0] + DELETE, "D", state)]
        if symbol != "x":
            cut = CUT if symbol.isupper() else 0
            initial, turn = symbol.lower(), TURN[state]
            options.append((behind[turn][0] + REROLE + cut, "R", turn))
            kept = SYSTEM if initial == "s" and state == START else turn if initial == ("a" if turn == ASSISTANT else "u") else None
            if kept is not None:
                options.append((behind[kept][0] + KEEP + cut, "K", kept))
        plain.append(min(options, key=lambda o: o[:2]))
    return _best(plain)


def audits(ends: Iterator[str]) -> Iterator[tuple[str, int, str]]:
    """For sorted signatures, each from its end: the signature, its cost, its audit. Nodes that no later one can share are let go."""
    path, before = [END], ""
    for end in ends:
        k = next((i for i, (a, b) in enumerate(zip(before, end, strict=False)) if a != b), min(len(before), len(end)))
        del path[k + 1 :]
        for symbol in end[k:]:
            path.append(node(symbol, path[-1]))
        state, edits = START, []
        for choices in reversed(path):
            edits.append(choices[state][1])
            state = choices[state][2]
        yield end, path[-1][START][0], "".join(edits)
        before = end


_AUDITS = pa.schema([("signature", pa.string()), ("cost", pa.int64()), ("audit", pa.string())])
_SIGNED = pa.schema([("conv_id", pa.int64()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("signature", pa.string())])
_TURNS = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string())])
_REPAIRED = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])


def _audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from arrow_batches(audits(s for batch in batches for s in batch.column("signature").to_pylist()), _AUDITS)


def damaged(turns: DataFrame) -> DataFrame:
    """The rows of turns after the damage that crc32(conv_id:turn) % 20 deals them, equal rows as one: conv_id, turn, role, text, copies (0 if
    the row is dropped: kept here so that its conversation is known). Nulls in role and text, and in the key, are one space."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("dealt"))
    text = F.when(F.col("dealt").isin(0, 1), "").when(F.col("dealt") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("dealt") == 0, "").when(F.col("dealt") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("dealt") == 0, 0).when(F.col("dealt") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies")).groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").cast("long").alias("copies"))


def faults(rows: DataFrame) -> DataFrame:
    """rows with symbol, digest (of the text: rows of one turn go by role and digest) and fresh: whether no earlier row has their role and text, so that the first
    copy isn't a duplicate."""
    bare = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    symbol = F.when(bare == "", "x").when(F.substring(bare, -1, 1).isin(".", "!", "?"), letter).otherwise(F.upper(letter))
    rows = rows.select("*", symbol.alias("symbol"), F.sha2("text", 256).alias("digest"), F.sha2(F.to_json(F.struct("conv_id", "role", "text")), 256).alias("same"))
    rank = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    first = rows.filter("copies > 0").groupBy("same").agg(F.min(rank).alias("first"))
    dropped = rows.filter("copies = 0").withColumn("fresh", F.lit(False))
    met = dealt_join(rows.filter("copies > 0"), first, "same", "turn").withColumn("fresh", rank.eqNullSafe(F.col("first")))
    return met.drop("first").unionByName(dropped).drop("same")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    """Rows as (new conversation?, values), in order."""
    before: tuple | None = None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            now = (row[0],)
            yield now != before, row
            before = now


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns: conv_id, turn, role, symbol, copies, fresh; sorted."""

    def rows() -> Iterator[tuple]:
        held: list | None = None

        def done() -> tuple:
            conv, turns, low, high, counts, illegal, _, signs = held
            return conv, high - low + 1 - turns if turns else 0, counts["blank"], counts["duplicate"], counts["truncated"], illegal, "".join(signs)[::-1]

        for new, (conv, turn, role, symbol, copies, fresh) in _conversations(batches):
            if new:
                if held is not None:
                    yield done()
                held = [conv, 0, None, None, {"blank": 0, "duplicate": 0, "truncated": 0}, 0, None, []]
            if not copies:
                continue
            if turn is not None:
                held[1] += turn != held[3]
                held[2], held[3] = turn if held[2] is None else held[2], turn
            initial = role[:1]
            held[5] += held[6] is not None and held[6] + initial not in ("su", "ua", "au")
            held[5] += copies - 1  # a role doesn't follow itself
            held[6] = initial
            if symbol == "x":
                held[4]["blank"] += copies
                held[7].append("x" * copies)
            else:
                held[4]["duplicate"] += copies - fresh
                held[4]["truncated"] += fresh and symbol.isupper()
                held[7].append((symbol if fresh else "") + "x" * (copies - fresh))
        if held is not None:
            yield done()

    yield from arrow_batches(rows(), _SIGNED)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str | None, str]]:
    """(conv_id, None, "") where a conversation begins, then (conv_id, role, text) for each row it has after the repair; a row at a time.

    Columns: conv_id, turn, role, text, copies, audit; sorted, the row with the audit first.
    """
    conv, audit, at, state = None, "", 0, START
    for new, (now, _, role, text, copies, its) in itertools.chain(_conversations(batches), [(True, (None,) * 6)]):
        for _ in range(1 if new else copies):
            row_done = False
            while at < len(audit) and not row_done and (audit[at] == "I" or not new):
                edit = audit[at]
                at, row_done = at + 1, edit != "I"
                if edit != "D":
                    state = SYSTEM if edit == "K" and role[:1] == "s" else TURN[state]
                    yield conv, role if edit == "K" else ROLE[state], "" if edit == "I" else text
        if new and its is not None:
            conv, audit, at, state = now, its, 0, START
            yield conv, None, ""


def _mend(batches: Iterator[pa.RecordBatch], texts: bool) -> Iterator[pa.RecordBatch]:
    """The rows after the repair, or a hash of each conversation's."""

    def rows() -> Iterator[tuple]:
        at = 0
        for conv, role, text in _edited(batches):
            at = 0 if role is None else at + 1
            if role is not None:
                yield conv, at, role, text

    def digests() -> Iterator[tuple]:
        before, digest, joint = None, None, ""
        for conv, role, text in _edited(batches):
            if role is None:
                if digest is not None:
                    yield before, digest.hexdigest()
                before, digest, joint = conv, hashlib.sha256(), ""
            else:
                digest.update(f"{joint}{role}:{text}".encode("utf-8", "surrogatepass"))
                joint = "\n"
        if digest is not None:
            yield before, digest.hexdigest()

    yield from arrow_batches(rows(), _TURNS) if texts else arrow_batches(digests(), _REPAIRED)


def _plan(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts and audit of each conversation, and its rows in order behind a row with the audit."""
    turns = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = staged(faults(damaged(turns)), "turns")
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "digest"]
    narrow = rows.select("conv_id", "turn", "role", "symbol", "copies", "fresh", "digest").repartition("conv_id").sortWithinPartitions(*order)
    signed = staged(narrow.select("conv_id", "turn", "role", "symbol", "copies", "fresh").mapInArrow(_sign, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, signature string"), "signed")
    shapes = signed.select("signature").distinct().repartitionByRange("signature").sortWithinPartitions("signature")
    audited = staged(shapes.mapInArrow(_audit, "signature string, cost long, audit string"), "audits")
    judged = staged(dealt_join(signed, audited, "signature", "conv_id"), "judged")
    none = lambda kind: F.lit(None).cast(kind)
    heads = judged.select("conv_id", none("long").alias("turn"), none("string").alias("role"), none("string").alias("text"), none("long").alias("copies"), "audit", none("string").alias("digest"))
    body = rows.filter("copies > 0").select("conv_id", "turn", "role", "text", "copies", none("string").alias("audit"), "digest")
    both = heads.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), *order[1:])
    return judged, both.select("conv_id", "turn", "role", "text", "copies", "audit")


def repaired_turns(turns: DataFrame) -> DataFrame:
    """conv_id, position (from 1), role, text: the conversations after the repair. See repair_conversations for odd rows."""
    return _plan(turns)[1].mapInArrow(partial(_mend, texts=True), "conv_id long, position long, role string, text string")


def repair_conversations(turns: DataFrame) -> DataFrame:
    """Per conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit (K keep, R rerole, D delete, I insert), repaired_sha256.

    turns (conv_id, turn, role, text) are damaged first, see damaged(). Rows of a conversation go by turn, nulls first; rows of one turn by role and the
    digest of their text, copies side by side. Rows without conv_id are one conversation. Null roles and texts are one space: such a text is blank,
    such a role is neither system, user nor assistant. A conversation of which no row is left has zeros, an empty audit and the hash of the empty text. Repeated
    rows are duplicates of each other. Other columns are ignored, whatever their names; an empty table gives no rows.

    Duplicates are found by an aggregate, whatever conversation they are in. A conversation's rows pass through one task in order, a row at
    a time, as its hash has to; the task holds one symbol for each of them.
    """
    judged, both = _plan(turns)
    mended = both.mapInArrow(partial(_mend, texts=False), "conv_id long, repaired_sha256 string")
    out = judged.join(mended, judged["conv_id"].eqNullSafe(mended["conv_id"]))
    return out.select(judged["conv_id"], "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
