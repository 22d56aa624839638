"""Conversation structure repair: cheapest edits that make roles alternate, over a suffix-shared automaton of role and fault signatures."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hueweave.runtime import materialize

#: States of the role grammar ``(s?(ua)+)?``: nothing yet, and after a system, user or assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: The one role that a turn can be given, or that can be inserted, in each state.
GIVEN = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
#: Turns of a signature that are spelt in one task before a conversation's pieces meet.
PIECE = 4096


@dataclass(frozen=True)
class Costs:
    """What each edit costs; ``truncated`` comes on top for a truncated turn that stays."""

    keep: int = 0
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


class Automaton:
    """Cost-to-go and first best edit for each state of the grammar, by what is left of a signature.

    A node stands for all signature endings that cost the same up to a constant from each state: there are few, and each is worked
    out once, when a turn is first put before a node. Edits in one place begin with different letters (D, I, K, R), so the first
    letter decides ties, and the ASCII-least audit follows by taking the least first letter each time.
    """

    def __init__(self, costs: Costs):
        self.costs, self.nodes, self.steps = costs, {}, {}
        done = {START: (0, ""), ASSISTANT: (0, ""), SYSTEM: (1 << 40, ""), USER: (1 << 40, "")}
        self.end, self.end_cost, self.end_edits = self._node(done)

    def _node(self, base: dict[int, tuple[int, str]]) -> tuple[int, int, str]:
        """A node, the constant that its costs lack, and the first edit for each state (a space for none)."""
        insert, best = self.costs.insert, dict(base)
        for state in (USER, ASSISTANT, USER, ASSISTANT, START, SYSTEM):
            after = NEXT[GIVEN[state][0]][state]
            best[state] = min(base[state], (insert + best[after][0], "I"))
        low = min(c for c, _ in best.values())
        key = tuple(best[s][0] - low for s in range(4))
        return self.nodes.setdefault(key, len(self.nodes)), low, "".join(best[s][1] or " " for s in range(4))

    def before(self, node: int, symbol: str) -> tuple[int, int, str]:
        """The node of a turn followed by ``node``."""
        got = self.steps.get((node, symbol))
        if got is None:
            ahead = list(self.nodes)[node]
            stays = self.costs.truncated if symbol.isupper() else 0
            base = {}
            for state in range(4):
                options = [(self.costs.delete + ahead[state], "D")]
                if symbol != "x":
                    kept = NEXT.get(symbol.lower(), {}).get(state)
                    if kept is not None:
                        options.append((self.costs.keep + stays + ahead[kept], "K"))
                    options.append((self.costs.rerole + stays + ahead[NEXT[GIVEN[state][0]][state]], "R"))
                base[state] = min(options)
            got = self.steps[node, symbol] = self._node(base)
        return got


def walk(signature: str, audit: Iterator[str] | str) -> Iterator[tuple[str, int, str | None]]:
    """(edit, place, role) for each letter of an audit: the turn that it is about and the role that it gives, None if the turn keeps its own."""
    state, at = START, 0
    for edit in audit:
        role = None
        if edit in "IR":
            role = GIVEN[state]
            state = NEXT[role[0]][state]
        elif edit == "K":
            state = NEXT[signature[at].lower()][state]
        yield edit, at, role
        at += edit != "I"


def audits(signatures: Iterator[str], costs: Costs) -> Iterator[tuple[int, str]]:
    """(cost, audit) of each signature. Signatures come sorted by their reversed form, so what two neighbours share at the end is worked out once."""
    auto = Automaton(costs)
    before, nodes, total, edits = "", [auto.end], [auto.end_cost], [auto.end_edits]
    for signature in signatures:
        turned = signature[::-1]
        shared = 0
        if turned == before:
            shared = len(turned)
        else:
            most = min(len(turned), len(before))
            while shared < most and turned[shared : shared + 256] == before[shared : shared + 256]:
                shared = min(most, shared + 256)
            while shared < most and turned[shared] == before[shared]:
                shared += 1
        for x in (nodes, total, edits):
            del x[shared + 1 :]
        for symbol in turned[shared:]:
            node, more, first = auto.before(nodes[-1], symbol)
            nodes.append(node)
            total.append(total[-1] + more)
            edits.append(first)
        before = turned
        audit, state, left = [], START, len(signature)
        while True:
            edit = edits[left][state]
            if edit == " ":
                break
            audit.append(edit)
            if edit in "IR":
                state = NEXT[GIVEN[state][0]][state]
            elif edit == "K":
                state = NEXT[signature[len(signature) - left].lower()][state]
            left -= edit != "I"
        cost = total[-1] + list(auto.nodes)[nodes[-1]][START]
        yield cost, "".join(audit)


def cheapest_edits(signatures: DataFrame, costs: Costs | None = None) -> DataFrame:
    """(signature, cost, audit) of distinct signatures, strings of a letter a turn.

    A letter is the role's initial (``s``, ``u``, ``a``, or ``o`` for another), upper-case if the turn is truncated, or ``x`` for
    a turn that must go. Signatures are range-partitioned by their reversed form, so each ending is a path of one task's
    automaton, but for those that two ranges share.
    """
    costs = costs or Costs()
    n = int(signatures.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []

        def each() -> Iterator[str]:
            for b in batches:
                for x in b.column(0).to_pylist():
                    held.append(x)
                    yield x

        out: list[list] = [[], []]
        for cost, audit in audits(each(), costs):
            out[0].append(cost)
            out[1].append(audit)
            if len(out[0]) >= 1000 or len(audit) > 1 << 20:
                yield pack(held[: len(out[0])], out)
                del held[: len(out[0])]
                out = [[], []]
        if out[0]:
            yield pack(held, out)

    def pack(held: list[str], out: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held, pa.string()), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string())], ["signature", "cost", "audit"])

    rows = signatures.select("signature", F.reverse("signature").alias("turned")).repartitionByRange(n, "turned").sortWithinPartitions("turned")
    return rows.select("signature").mapInArrow(run, "signature string, cost long, audit string")


def find_faults(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, place, new_turn, illegal, fault, symbol) of conversation rows, as a written table.

    The order is by turn, null first, then role and text. A row's first fault counts: ``blank`` (no character but white space),
    ``duplicate`` (role and text seen earlier), ``truncated`` (the last such character is not ``.``, ``!`` or ``?``). Null roles
    and texts count as one space; a null conv_id is a conversation of its own.
    """
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    space = F.lit(" ")
    rows = turns.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text")).repartition(n, "conv_id")
    by_turn = F.col("turn").asc_nulls_first()
    rows = rows.withColumn("again", F.row_number().over(W.partitionBy("conv_id", "role", "text").orderBy(by_turn)) > 1)
    order = W.partitionBy("conv_id").orderBy(by_turn, "role", "text", "again")
    initial, before = F.substring("role", 1, 1), F.lag("role").over(order)
    pair = F.concat(F.substring(before, 1, 1), initial)
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "blank").when(F.col("again"), "duplicate").when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated")
    rows = rows.select(
        "*", (F.row_number().over(order) - 1).cast("long").alias("place"), fault.alias("fault"),
        (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(order))).alias("new_turn"),
        F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)).alias("illegal"),
        F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("letter"),
    )
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper("letter")).otherwise(F.col("letter"))
    return materialize(rows.select("conv_id", "turn", "role", "text", "place", "new_turn", "illegal", "fault", symbol.alias("symbol")), "repair-turns")


def audit_conversations(faults: DataFrame, costs: Costs | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation that has rows in ``find_faults``' table.

    Signatures are spelt in pieces of ``PIECE`` turns, so a long conversation is spread over tasks until its letters meet. Equal
    signatures are looked up once. ``gaps`` is the number of turns that are missing between the least and the greatest.
    """
    count = lambda on: F.count_if(on)
    parts = faults.groupBy("conv_id", F.floor(F.col("place") / PIECE).alias("part")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "symbol"))), lambda x: x["symbol"]), "").alias("s"),
        F.min("turn").alias("low"), F.max("turn").alias("high"), count(F.col("new_turn")).alias("turns"), count(F.col("illegal")).alias("illegal"),
        *[count(F.coalesce(F.col("fault") == f, F.lit(False))).alias(f) for f in ("blank", "duplicate", "truncated")],
    )
    whole = parts.groupBy("conv_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "s"))), lambda x: x["s"]), "").alias("of"),
        F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("turns"), F.lit(0)).cast("long").alias("gaps"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")],
    )
    whole = materialize(whole, "repair-signatures")
    edits = cheapest_edits(whole.select(F.col("of").alias("signature")).distinct(), costs)
    return materialize(whole.join(edits, F.col("of") == F.col("signature")).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "signature"), "repair-audits")


def _streamed(faults: DataFrame, audited: DataFrame) -> DataFrame:
    """Each conversation's audit, then its turns in order, by conversation within each partition."""
    n = int(faults.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    none = F.lit(None).cast("string")
    heads = audited.select("conv_id", F.lit(-1).cast("long").alias("place"), none.alias("role"), none.alias("text"), "signature", "audit")
    rows = heads.unionByName(faults.select("conv_id", "place", "role", "text", none.alias("signature"), none.alias("audit")))
    return rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "place")


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, None, None, None) where a conversation begins, then (conv_id, edit, role, text) for each edit; deleted turns come with their own role and text."""
    edits, due = iter(()), None
    conv = None

    def pending() -> Iterator[tuple]:
        """Inserts that stand before the next turn or at the end."""
        nonlocal due
        while due is not None and due[0] == "I":
            yield conv, "I", due[2], ""
            due = next(edits, None)

    for b in batches:
        for conv_id, place, role, text, signature, audit in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if place < 0:
                conv, edits = conv_id, walk(signature, audit)
                due = next(edits, None)
                yield conv, None, None, None
            else:
                edit, _, given = due
                due = next(edits, None)
                yield conv, edit, given or role, text
            yield from pending()


def repaired_turns(faults: DataFrame, audited: DataFrame) -> DataFrame:
    """(conv_id, edit, place, role, text): the repaired conversations, and with edit ``D`` the turns taken out; ``place`` counts what stays, and of a deleted turn what stays before it."""
    kind = faults.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[pa.RecordBatch] = []

        def watched() -> Iterator[pa.RecordBatch]:
            for b in batches:
                seen[:] = [b]
                yield b

        out, place, size = [], 0, 0
        for conv, edit, role, text in _repaired(watched()):
            if edit is None:
                place = 0
                continue
            out.append((conv, edit, place, role, text))
            place += edit != "D"
            size += len(text)
            if len(out) >= 5000 or size > 1 << 24:
                yield pack(out, seen[0].column(0).type)
                out, size = [], 0
        if out:
            yield pack(out, seen[0].column(0).type)

    def pack(rows: list[tuple], conv_type: pa.DataType) -> pa.RecordBatch:
        types = [conv_type, pa.string(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], ["conv_id", "edit", "place", "role", "text"])

    return _streamed(faults, audited).mapInArrow(run, f"conv_id {kind}, edit string, place long, role string, text string")


def repair_digests(faults: DataFrame, audited: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): the digest of each repaired conversation's ``role:text``, joined by newlines; turns are streamed and never held together."""
    kind = faults.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[pa.RecordBatch] = []

        def watched() -> Iterator[pa.RecordBatch]:
            for b in batches:
                seen[:] = [b]
                yield b

        def pack() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], seen[0].column(0).type), pa.array([d.hexdigest() for _, d in done], pa.string())], ["conv_id", "repaired_sha256"])

        done: list[tuple] = []
        first = True
        for conv, edit, role, text in _repaired(watched()):
            if edit is None:
                if len(done) >= 5000:
                    yield pack()
                    done.clear()
                done.append((conv, hashlib.sha256()))
                first = True
            elif edit != "D":
                done[-1][1].update(f"{'' if first else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
                first = False
        if done:
            yield pack()

    return _streamed(faults, audited).mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def repair_conversations(turns: DataFrame, costs: Costs | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of conversation rows (conv_id, turn, role, text).

    ``audit`` has the cheapest edits that leave the roles ``(s?(ua)+)?``, one initial each, in order: Keep, Rerole, Delete,
    Insert; of equal cost the ASCII-least. Blank and duplicate turns are always deleted. Null roles and texts count as one space,
    a null conv_id is a conversation of its own, repeated rows are duplicates, other columns are not looked at, and an
    empty table gives no rows. A conversation's signature, audit and digest are one value each, made in one task; its turns are streamed.
    """
    faults = find_faults(turns)
    audited = audit_conversations(faults, costs)
    digests = repair_digests(faults, audited).withColumnRenamed("conv_id", "c")
    return audited.join(digests, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c", "signature")
