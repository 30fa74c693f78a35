"""Cheapest repair of damaged conversations, by an audit DP over shared edit histories.

A row's first fault is ``blank`` (no visible character), ``duplicate`` (role
and text seen earlier in its conversation) or ``truncated`` (last visible
character not one of ``.!?``).  Edits: Keep 0, Rerole to user or assistant 1,
Delete 2 (the only edit of blank and duplicate rows), Insert an empty user or
assistant turn 5; a truncated row that stays costs 5 more.  The repaired role
initials read ``(s?(ua)+)?``.  The cheapest edits win, then the least string
of their initials (``D``, ``I``, ``K``, ``R``).

The DP walks the rows with four states (last role kept: none, system, user,
assistant).  A state's edits so far are a linked node: one step a row, each
the inserts before the row and the row's own edit.  Nodes share their
prefixes, know their ancestors 1, 2, 4, ... steps back and a rolling hash of
their whole string.  Equal costs compare by searching the longest common
prefix down the ancestors; an equal hash is believed only after the steps
themselves agree.  As every step ends with the row's own edit, no string of
the same rows is a proper prefix of another, so the comparison never changes
with what follows.

Rows are sorted by conversation and turn over range partitions, so one huge
conversation spans many tasks.  A conversation that lies inside one task and
block is finished there.  The others become blocks of at most ``BLOCK_ROWS``
rows, solved in parallel for each state they may be entered in; one task a
conversation then strings their solutions together, streaming (the digest of
the repaired text is a chain and cannot be split).

Defined cases: NULL in any column reads as one space (a NULL turn sorts first
and is no part of the gaps); a NULL ``conv_id`` is a conversation of its own;
rows of one turn sort by role, the text's first 64 characters, then its
digest; repeated rows are duplicates;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsieve.functions.joins import join_bounded
from netsieve.llm.storage import map_arrow, materialise

BLOCK_ROWS, BLOCK_CHARS = 2000, 1 << 20
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
NONE, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5

#: State after one more turn whose role has this initial; absent: not allowed.
_KEPT = {"s": {NONE: SYSTEM}, "u": {NONE: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: State after an inserted or renamed turn: an assistant answers a user, else a user speaks.
_GIVEN = {NONE: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_NAME = {USER: "user", ASSISTANT: "assistant"}
#: Inserts that end a conversation in each state.
_ENDING = {NONE: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
_LEGAL = {"su", "ua", "au"}

_PRIME, _BASE = (1 << 61) - 1, 1_000_003
_WHITE = " \t\n\v\f\r"


class Audit:
    """An edit history: this step and the history before it."""

    __slots__ = ("up", "depth", "step", "length", "hash")

    def __init__(self, before: Audit | None = None, step: str = ""):
        self.step = step
        if before is None:
            self.up, self.depth, self.length, self.hash = (), 0, 0, 0
            return
        up, k = [before], 0
        while k < len(up[k].up):
            up.append(up[k].up[k])
            k += 1
        h = before.hash
        for c in step:
            h = (h * _BASE + ord(c)) % _PRIME
        self.up, self.depth, self.length, self.hash = up, before.depth + 1, before.length + len(step), h

    def steps(self) -> Iterator[str]:
        """Last step first."""
        node = self
        while node.depth:
            yield node.step
            node = node.up[0]

    def text(self) -> str:
        return "".join(reversed(list(self.steps())))


def same(a: Audit, b: Audit) -> bool:
    """Equal histories of equally many steps: hashes first, then the steps until the nodes are shared."""
    if a.hash != b.hash or a.length != b.length:
        return False
    while a is not b:
        if a.step != b.step:
            return False
        a, b = a.up[0], b.up[0]
    return True


def earlier(a: Audit, step_a: str, b: Audit, step_b: str) -> bool:
    """Whether history ``a`` then ``step_a`` reads before ``b`` then ``step_b``; both took equally many steps."""
    if a is b or same(a, b):
        return step_a < step_b
    k = len(a.up) - 1
    while k >= 0:                      # climb while the ancestors still differ
        if k < len(a.up) and not same(a.up[k], b.up[k]):
            a, b = a.up[k], b.up[k]
        k -= 1
    return a.step < b.step


def _choose(best: dict, state: int, cost: int, before: Audit, step: str) -> None:
    old = best.get(state)
    if old is None or cost < old[0] or cost == old[0] and earlier(before, step, old[1], old[2]):
        best[state] = (cost, before, step)


def advance(layer: dict[int, tuple[int, Audit]], initial: str, fault: int) -> dict[int, tuple[int, Audit]]:
    """Best (cost, history) of each state after one more row."""
    best: dict[int, tuple[int, Audit, str]] = {}
    free = fault not in (BLANK, DUPLICATE)
    extra = CUT if fault == TRUNCATED else 0
    kept = _KEPT.get(initial, {})
    for state, (cost, node) in layer.items():
        _choose(best, state, cost + DELETE, node, "D")
        if not free:
            continue
        now, inserted = state, ""
        for _ in range(3):             # two inserts reach every state; none is better after a delete
            after = kept.get(now)
            if after is not None:
                _choose(best, after, cost + KEEP + extra, node, inserted + "K")
            _choose(best, _GIVEN[now], cost + REROLE + extra, node, inserted + "R")
            now, inserted, cost = _GIVEN[now], inserted + "I", cost + INSERT
    return {s: (c, Audit(node, step)) for s, (c, node, step) in best.items()}


def repaired(roles: list[str], texts: list[str], audit: str, state: int) -> list[str]:
    """``role:text`` of the turns that ``audit`` leaves of these rows, entered in ``state``."""
    out, i = [], 0
    for c in audit:
        if c == "D":
            i += 1
            continue
        if c == "K":
            role = roles[i]
            state = _KEPT[role[:1]][state]
        else:
            state = _GIVEN[state]
            role = _NAME[state]
        if c == "I":
            out.append(role + ":")
        else:
            out.append(f"{role}:{texts[i]}")
            i += 1
    return out


def solve(roles: list[str], faults: list[int], entries) -> dict[int, dict[int, tuple[int, str]]]:
    """Per state entered, per state left: (cost, audit) of these rows."""
    out = {}
    for entry in entries:
        layer = {entry: (0, Audit())}
        for role, fault in zip(roles, faults):
            layer = advance(layer, role[:1], fault)
        out[entry] = {s: (c, node.text()) for s, (c, node) in layer.items()}
    return out


class Block:
    """Consecutive rows of one conversation."""

    def __init__(self):
        self.turns, self.roles, self.texts, self.faults, self.chars = [], [], [], [], 0

    def add(self, turn, role, text, fault) -> None:
        self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)
        self.faults.append(fault)
        self.chars += len(text)

    def facts(self, whole: bool) -> dict:
        """What stringing blocks together needs; a block that may be a later one is solved for every state."""
        known = [t for t in self.turns if t is not None]
        initials = [r[:1] for r in self.roles]
        return {
            "roles": self.roles, "texts": self.texts,
            "solved": solve(self.roles, self.faults, (NONE,) if whole else range(4)),
            "turns": (known[0], known[-1], len(set(known))) if known else None,
            "ends": (initials[0], initials[-1]) if initials else None,
            "faults": [self.faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)],
            "illegal": sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:])),
        }


class Conversation:
    """Strings the blocks of a conversation together, in order."""

    def __init__(self):
        self.layer = {NONE: (0, Audit(), hashlib.sha256())}
        self.faults, self.illegal, self.turns, self.last = [0, 0, 0], 0, None, None

    def add(self, facts: dict) -> None:
        if facts["ends"] is None:
            return
        best: dict[int, tuple] = {}
        came: dict[int, int] = {}
        for s, (cost, node, _) in self.layer.items():
            for t, (more, audit) in facts["solved"][s].items():
                before = best.get(t)
                _choose(best, t, cost + more, node, audit)
                if best[t] is not before:
                    came[t] = s
        layer = {}
        for t, (cost, node, audit) in best.items():
            s = came[t]
            digest = self.layer[s][2].copy()
            lines = repaired(facts["roles"], facts["texts"], audit, s)
            if lines:
                digest.update((("\n" if s != NONE else "") + "\n".join(lines)).encode())
            layer[t] = (cost, Audit(node, audit), digest)
        self.layer = layer
        self.faults = [a + b for a, b in zip(self.faults, facts["faults"])]
        first, last = facts["ends"]
        self.illegal += facts["illegal"] + (self.last is not None and self.last + first not in _LEGAL)
        self.last = last
        if facts["turns"]:
            lo, hi, distinct = facts["turns"]
            if self.turns is None:
                self.turns = (lo, hi, distinct)
            else:
                self.turns = (self.turns[0], hi, self.turns[2] + distinct - (self.turns[1] == lo))

    def result(self) -> tuple:
        """(gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)."""
        best: dict[int, tuple] = {}
        for s, (cost, node, digest) in self.layer.items():
            ending = _ENDING[s]
            old = best.get(0)
            _choose(best, 0, cost + INSERT * len(ending), node, ending)
            if best[0] is not old:
                state, end = s, digest
        cost, node, ending = best[0]
        lines = repaired([], [], ending, state)
        if lines:
            end = end.copy()
            end.update(("\n" + "\n".join(lines)).encode())
        gaps = self.turns[1] - self.turns[0] + 1 - self.turns[2] if self.turns else 0
        return (gaps, *self.faults, self.illegal, cost, node.text() + ending, end.hexdigest())


_RESULT = ("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
           "audit string, repaired_sha256 string")
_BLOCKS = f"conv_id long, part int, seq long, done boolean, facts binary, {_RESULT}"
_RESULT_NAMES = [f.split()[0] for f in _RESULT.split(", ")]
_RESULT_TYPES = [pa.string() if f.endswith("string") else pa.int64() for f in _RESULT.split(", ")]
OUT_ROWS = 2000


def _blocks(batches):
    """Finished conversations, and blocks of those that may go on in another task or do not fit one block.

    The rows come sorted; only the first and the last conversation of a task may have rows elsewhere.
    """
    part = TaskContext.get().partitionId()
    types = [pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary(), *_RESULT_TYPES]
    names = ["conv_id", "part", "seq", "done", "facts", *_RESULT_NAMES]
    out: list[tuple] = []
    conv, block, seq, first = None, None, 0, True

    def close(more: bool, edge: bool) -> None:
        """``more``: the conversation goes on in this task; ``edge``: it may have rows in another one."""
        nonlocal seq
        if not more and not edge and seq == 0:
            whole = Conversation()
            whole.add(block.facts(True))
            out.append((conv, part, 0, True, None, *whole.result()))
        else:
            out.append((conv, part, seq, False, pickle.dumps(block.facts(False)), *[None] * len(_RESULT_NAMES)))
            seq += 1

    def batch():
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
        out.clear()
        return made

    for rows in batches:
        for key, gone, turn, role, text, fault in zip(*[c.to_pylist() for c in rows.columns]):
            if block is None or key != conv:
                if block is not None:
                    close(False, first)
                    first = False
                conv, block, seq = key, Block(), 0
            elif len(block.roles) >= BLOCK_ROWS or block.chars >= BLOCK_CHARS:
                close(True, first)
                block = Block()
            if not gone:
                block.add(turn, role, text, fault)
            if len(out) >= OUT_ROWS or out and out[-1][4] is not None:
                yield batch()
    if block is not None:
        close(False, True)
    if out:
        yield batch()


def _strung(batches):
    """Results of the conversations whose blocks come in order."""
    conv, whole = None, None
    types = [pa.int64(), *_RESULT_TYPES]
    names = ["conv_id", *_RESULT_NAMES]

    def batch():
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((conv, *whole.result()), types)], names=names)

    for rows in batches:
        for key, facts in zip(*[c.to_pylist() for c in rows.columns]):
            if whole is None or key != conv:
                if whole is not None:
                    yield batch()
                conv, whole = key, Conversation()
            whole.add(pickle.loads(facts))
    if whole is not None:
        yield batch()


def _shown(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone) after the stated damage, a function of crc32(``conv_id:turn``) % 20.

    0 drops the row (it stays, marked ``gone``), 1 empties its text, 2 removes
    its ``.!?``, 3 repeats it, 4 makes it the user's.
    """
    kind = F.crc32(F.concat(_shown("conv_id"), F.lit(":"), _shown("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return (rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        _shown("role").alias("role"), _shown("text").alias("text"), kind.alias("kind"))
            .withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
            .select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                    text.alias("text"), (F.col("kind") == 0).alias("gone")))


def as_given(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone) of rows to be repaired as they are."""
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                       _shown("role").alias("role"), _shown("text").alias("text"), F.lit(False).alias("gone"))


def faulted(rows: DataFrame) -> DataFrame:
    """Rows with their first ``fault`` (0: none), an order number and a digest of role and text.

    Only keys that repeat travel: the first row of each repeated (conversation,
    role, text) is found by grouping, and joined back behind a size check.
    """
    seen = F.rtrim(F.col("text"), F.lit(_WHITE))
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    rows = materialise(rows.select(
        "conv_id", "turn", "role", "text", "gone", _shown("conv_id").alias("conv"), digest.alias("same"),
        F.when(F.length(seen) == 0, BLANK).when(~F.right(seen, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(0).alias("seen"),
        F.monotonically_increasing_id().alias("number")), "conversation-rows")
    again = (rows.where(~F.col("gone") & (F.col("seen") != BLANK)).groupBy("conv", "same")
             .agg(F.count("*").alias("n"), F.min(F.struct("turn", "number")).alias("first"))
             .where("n > 1").select("conv", "same", F.col("first.number").alias("original")))
    found = join_bounded(rows, materialise(again, "repeated-turns"), ["conv", "same"], "left")
    repeated = F.col("original").isNotNull() & (F.col("number") != F.col("original")) & (F.col("seen") != BLANK)
    return found.withColumn("fault", F.when(repeated, DUPLICATE).otherwise(F.col("seen")))


def audits(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation.

    Args:
        rows: (conv_id, turn, role, text, gone), from ``as_given`` or ``damaged``;
            a row marked ``gone`` only says that its conversation exists.
    """
    rows = faulted(rows).withColumn("start", F.left("text", F.lit(64)))
    order = ["conv_id", "turn", "role", "start", "same", "number"]
    in_order = (rows.repartitionByRange(*order).sortWithinPartitions(*order)
                .select("conv_id", "gone", "turn", "role", "text", "fault"))
    blocks = materialise(map_arrow(in_order, _blocks, _BLOCKS), "conversation-blocks")
    rest = (blocks.where("not done").repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "part", "seq")
            .select("conv_id", "facts"))
    done = blocks.where("done").select("conv_id", *_RESULT_NAMES)
    return done.unionByName(map_arrow(rest, _strung, f"conv_id long, {_RESULT}"))
