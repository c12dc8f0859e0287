"""Cheapest repair of conversations, worked out on an automaton that shares suffixes.

A conversation is written as a signature: one letter a row for its role's initial
and its fault. Signatures are put in order of their reversed text, so those with a
common suffix stand together. A task walks through them from the end: the nodes
of the automaton are the distinct suffixes, and a node that the signature before
has built is used again. At each node and grammar state the cost-to-go and the
best edit are worked out once; following the best edits gives the best audit suffix.

Grammar of role initials: nothing, or an optional ``s`` and one or more ``ua``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sitelens.llm.store import settle

SPACE = " \t\n\x0b\x0c\r"
LEGAL = ("su", "ua", "au")
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Grammar states: nothing yet, after s, after u (an a is due), after a whole pair.
START, SYSTEM, ASKED, ANSWERED = range(4)
#: The state after a row with role initial u, a or s, where the grammar allows one.
STEPS = ({"s": SYSTEM, "u": ASKED}, {"u": ASKED}, {"a": ANSWERED}, {"u": ASKED})
#: The role that an inserted or re-roled row takes on in each state.
DUE = ("u", "u", "a", "u")
NAMES = {"u": "user", "a": "assistant"}
#: Letters of a signature: role initial (x: any other), capital where the text is truncated; - must be deleted.
MUST_GO = "-"

Node = tuple[tuple[int, ...], str, "Node | None"]


def _with_inserts(costs: list[int], edits: list[str]) -> tuple[tuple[int, ...], str]:
    """Costs and best first edits of the states, where a row may also be inserted before."""
    out, best = list(costs), list(edits)
    for state in (ASKED, ANSWERED, START, SYSTEM):
        cost = INSERT + min(costs[STEPS[state][DUE[state]]], INSERT + costs[state] if state in (ASKED, ANSWERED) else INSERT + costs[ANSWERED])
        if (cost, "I") < (costs[state], edits[state]):
            out[state], best[state] = cost, "I"
    return tuple(out), "".join(best)


#: The node of the empty suffix; ~ stands for the end, which comes after every edit.
END: Node = (*_with_inserts([0, 1 << 60, 1 << 60, 0], ["~"] * 4), None)


def node(letter: str, after: Node) -> Node:
    """The node of a suffix that begins with ``letter`` and goes on with ``after``: (costs, first edits, after)."""
    costs, edits = [], []
    initial, extra = letter.lower(), TRUNCATED if letter.isupper() else 0
    for state in range(4):
        options = [(DELETE + after[0][state], "D")]
        if letter != MUST_GO:
            if initial in STEPS[state]:
                options.append((extra + after[0][STEPS[state][initial]], "K"))
            options.append((REROLE + extra + after[0][STEPS[state][DUE[state]]], "R"))
        cost, edit = min(options)
        costs.append(cost)
        edits.append(edit)
    return (*_with_inserts(costs, edits), after)


def audit(signature: str, at: Node) -> str:
    """The cheapest edits in order, ASCII-least among equals, read along the best edits.

    All options at a node and state begin with different letters, so the first
    letters decide between equal costs.
    """
    out, state, i = [], START, 0
    while True:
        edit = at[1][state]
        if edit == "~":
            return "".join(out)
        out.append(edit)
        if edit == "I":
            state = STEPS[state][DUE[state]]
            continue
        if edit == "K":
            state = STEPS[state][signature[i].lower()]
        elif edit == "R":
            state = STEPS[state][DUE[state]]
        at, i = at[2], i + 1


class SuffixWalk:
    """The automaton of signatures that come in order of their reversed text; holds the path of the last one."""

    def __init__(self) -> None:
        self.last, self.path, self.made = "", [END], 0

    def __call__(self, signature: str) -> tuple[int, str]:
        """(cost, audit) of the signature."""
        back = signature[::-1]
        shared = 0
        if back.startswith(self.last):
            shared = len(self.last)
        else:
            for x, y in zip(back, self.last):
                if x != y:
                    break
                shared += 1
        del self.path[shared + 1 :]
        for letter in back[shared:]:
            self.path.append(node(letter, self.path[-1]))
            self.made += 1
        self.last = back
        return self.path[-1][0][START], audit(signature, self.path[-1])


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, copy, dropped): each row after the damage that crc32(conv:turn) % 20 brings it.

    0 drops the row (it stays, marked ``dropped``), 1 empties the text, 2 removes
    . ! ? from it, 3 repeats the row, 4 sets the role user. Nulls count as one
    space, in the hash as in role and text; conv and turn themselves stay null.
    """
    words = {n: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")) for n, c in (("conv", conv), ("turn", turn), ("role", role), ("text", text))}
    code = F.crc32(F.concat(words["conv"], F.lit(":"), words["turn"])) % 20
    rows = rows.select(
        F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").cast("bigint").alias("turn"), words["role"].alias("role"), words["text"].alias("text"), code.alias("code")
    )
    copies = F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    harmed = F.when(F.col("code").isin(0, 1), "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select(
        "conv", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), harmed.alias("text"), copies.alias("copy"), (F.col("code") == 0).alias("dropped")
    )


#: Rows of a conversation: by turn (nulls first); rows of one turn by role and SHA-256 of the text, copies side by side.
ORDER = [F.asc_nulls_first, F.asc, F.asc, F.asc]


def _order() -> list[Column]:
    return [f(c) for f, c in zip(ORDER, ("turn", "role", "digest", "copy"))]


def signatures(rows: DataFrame) -> DataFrame:
    """(conv, signature, gaps, blank, duplicate, truncated, illegal) of every conversation in the form of ``damaged``.

    ``rows`` may mark rows as ``dropped``: they count for nothing, but a
    conversation of such rows only is there, with zeros and an empty signature.
    """
    trimmed = F.rtrim(F.col("text"), F.lit(SPACE))
    thin = rows.select("conv", "turn", "role", "copy", "dropped", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), (trimmed == "").alias("blank"), (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("open"))
    earlier = Window.partitionBy("conv", "role", "digest", "dropped").orderBy(F.asc_nulls_first("turn"), "copy")
    thin = thin.repartition("conv").withColumn("again", F.row_number().over(earlier) > 1)
    ordered = thin.sortWithinPartitions(F.asc_nulls_first("conv"), *_order())
    initial = F.substring("role", 1, 1)
    ordered = ordered.select("conv", "turn", initial.alias("initial"), "dropped", "blank", "again", "open")
    kind, id_type = rows.schema["conv"].dataType.simpleString(), to_arrow_type(rows.schema["conv"].dataType)
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        conv, fresh = None, True
        letters, faults, turns, illegal, before = [], [0, 0, 0], [None, None, 0], 0, None

        def close() -> None:
            gaps = turns[1] - turns[0] + 1 - turns[2] if turns[2] else 0
            done.append((conv, "".join(letters), gaps, *faults, illegal))

        def out() -> pa.RecordBatch:
            columns = list(zip(*done))
            named = {"conv": pa.array(columns[0], id_type), "signature": pa.array(columns[1], pa.string())}
            named |= {n: pa.array(columns[i + 2], pa.int64()) for i, n in enumerate(counts)}
            return pa.RecordBatch.from_pydict(named)

        for batch in batches:
            for key, turn, first, dropped, blank, again, is_open in zip(*[c.to_pylist() for c in batch.columns]):
                if fresh or key != conv:
                    if not fresh:
                        close()
                    conv, fresh = key, False
                    letters, faults, turns, illegal, before = [], [0, 0, 0], [None, None, 0], 0, None
                if dropped:
                    continue
                if turn is not None and turn != turns[1]:
                    turns = [turn if turns[0] is None else turns[0], turn, turns[2] + 1]
                illegal += before is not None and before + first not in LEGAL
                before = first
                letter = first if first in ("u", "a", "s") else "x"
                if blank:
                    faults[0] += 1
                    letter = MUST_GO
                elif again:
                    faults[1] += 1
                    letter = MUST_GO
                elif is_open:
                    faults[2] += 1
                    letter = letter.upper()
                letters.append(letter)
            if len(done) >= 4096:
                yield out()
                done = []
        if not fresh:
            close()
        if done:
            yield out()

    return ordered.mapInArrow(read, f"conv {kind}, signature string, " + ", ".join(f"{n} bigint" for n in counts))


def audits(signed: DataFrame) -> DataFrame:
    """The rows of ``signed`` with ``cost`` and ``audit`` of their ``signature``.

    Rows go to tasks by ranges of the reversed signature, then of a hash of the
    conversation, so equal suffixes meet in one task and a signature of very
    many conversations is cut between several.
    """
    keys = [F.reverse("signature"), F.xxhash64("conv")]
    parts = int(signed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = signed.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in signed.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, last, found = SuffixWalk(), None, (0, "")
        for batch in batches:
            costs, texts = [], []
            for signature in batch.column("signature").to_pylist():
                if signature != last:
                    last, found = signature, walk(signature)
                costs.append(found[0])
                texts.append(found[1])
            yield batch.append_column("cost", pa.array(costs, pa.int64())).append_column("audit", pa.array(texts, pa.string()))

    return ranged.mapInArrow(run, f"{schema}, cost bigint, audit string")


def _apply(rows: DataFrame, plans: DataFrame, keep_rows: bool) -> DataFrame:
    """Stream every conversation's rows behind its audit and carry out the edits."""
    kind, id_type = rows.schema["conv"].dataType.simpleString(), to_arrow_type(rows.schema["conv"].dataType)
    own = rows.filter(~F.col("dropped")).select(
        "conv", F.lit(1).alias("stage"), "turn", "role", "text", "copy", F.sha2(F.col("text").cast("binary"), 256).alias("digest")
    )
    nothing = [F.lit(None).cast(own.schema[c].dataType).alias(c) for c in ("turn", "role")]
    heads = plans.select("conv", F.lit(0).alias("stage"), *nothing, F.col("audit").alias("text"), F.lit(0).alias("copy"), F.lit(None).cast("string").alias("digest"))
    both = own.union(heads).repartition("conv").sortWithinPartitions(F.asc_nulls_first("conv"), "stage", *_order())
    ordered = both.select("conv", "stage", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        conv, plan, at, state, place, digest = None, None, 0, START, 0, hashlib.sha256()

        def put(role: str, text: str) -> None:
            nonlocal place
            if keep_rows:
                out.append((conv, place, role, text))
            else:
                digest.update((("\n" if place else "") + role + ":" + text).encode())
            place += 1

        def inserts() -> None:
            nonlocal at, state
            while at < len(plan) and plan[at] == "I":
                put(NAMES[DUE[state]], "")
                state, at = STEPS[state][DUE[state]], at + 1

        def close() -> None:
            if plan is not None:
                inserts()
                if not keep_rows:
                    out.append((conv, digest.hexdigest()))

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out))
            if keep_rows:
                return pa.RecordBatch.from_pydict(
                    {"conv": pa.array(columns[0], id_type), "place": pa.array(columns[1], pa.int64()), "role": pa.array(columns[2], pa.string()), "text": pa.array(columns[3], pa.string())}
                )
            return pa.RecordBatch.from_pydict({"conv": pa.array(columns[0], id_type), "repaired_sha256": pa.array(columns[1], pa.string())})

        for batch in batches:
            for key, stage, role, text in zip(*[c.to_pylist() for c in batch.columns]):
                if stage == 0:
                    close()
                    conv, plan, at, state, place, digest = key, text, 0, START, 0, hashlib.sha256()
                    continue
                inserts()
                edit, at = plan[at], at + 1
                if edit == "K":
                    state = STEPS[state][role[0]]
                    put(role, text)
                elif edit == "R":
                    put(NAMES[DUE[state]], text)
                    state = STEPS[state][DUE[state]]
            if out:
                yield batch_of()
                out = []
        close()
        if out:
            yield batch_of()

    schema = f"conv {kind}, place bigint, role string, text string" if keep_rows else f"conv {kind}, repaired_sha256 string"
    return ordered.mapInArrow(run, schema)


def repaired_rows(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """(conv, place, role, text): the rows of all conversations after their audits' edits, numbered from 0."""
    return _apply(rows, plans, True)


def repair(rows: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) per conversation.

    ``rows`` has the columns of ``damaged``: conv, turn, role, text, copy (0 where
    rows are no copies) and dropped. Rows stand by turn, nulls first; rows that
    share a turn by role and SHA-256 of the text. The first of blank (nothing but
    white space), duplicate (role and text stood before) and truncated (does not
    end in . ! or ?) counts for a row. Blank and duplicate rows must be deleted.
    Conversations without rows, and empty tables, cost nothing. Role and
    text must not be null; a null conv is a conversation. Other columns are not read.

    Memory: one letter a row of a conversation, and one node a row of a task's
    current signature; texts are streamed. A conversation's rows are read
    by one task in order, since its SHA-256 has no other way.
    """
    plans = settle(audits(settle(signatures(rows), "signatures")), "audits")
    hashes = _apply(rows, plans, False).withColumnRenamed("conv", "same")
    met = plans.join(hashes, F.col("conv").eqNullSafe(F.col("same")))
    return met.select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
