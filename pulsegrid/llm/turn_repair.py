"""Repair of conversations: the cheapest edits that make the roles of a conversation alternate.

A conversation's turns must give role initials (s?(ua)+)?. Its rows are kept, given another role or deleted, and turns
without text are put in. The states are what has been written so far: nothing, a first s, a u last, an a last. For each
state the cheapest edits that lead to it survive (Viterbi); of equally cheap ones those whose letters are least.

Survivors are the leaves of a tree of back pointers that counts how many later nodes refer to each. A node that none
refers to goes. Once all survivors share an ancestor, the edits down to it are certain: they are given out, and their
rows with them. So what is held is the part on which survivors still differ. Ties are decided on the whole of that part:
survivors are kept in the order of their letters from where they part, and as every row adds one of K, R and D, none
is the beginning of another, so that letters added later never change that order.

A state from which nothing can still be as cheap goes too: what follows from a late "nothing yet" follows from an "a
last" for 3 more at most, and from a "u last" for 5 more. So survivors part for long only where their edits stay
equally cheap, row after row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from pulsegrid.llm.common import giving_back, quoted, tune

#: Costs of edits, white space.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"

NONE, FIRST, USER, ASSISTANT = range(4)
#: What a role may follow, and what it leads to.
BEFORE = {"s": (NONE,), "u": (NONE, FIRST, ASSISTANT), "a": (USER,)}
AFTER = {"s": FIRST, "u": USER, "a": ASSISTANT}
ROLES = {"u": "user", "a": "assistant"}
#: The most that a state can be dearer than another and still come out even, where that has a bound.
SLACK = {(NONE, ASSISTANT): DELETE, (NONE, USER): DELETE + INSERT, (FIRST, ASSISTANT): 0, (FIRST, USER): INSERT}

#: (letter, role or None for the row's own, row or None): one edit.
Edit = tuple[str, str | None, tuple | None]


def inserts(roles: str) -> tuple[Edit, ...]:
    return tuple(("I", ROLES[x], None) for x in roles)


class Node:
    """Edits that follow those of the parent: insertions, then one edit of a row."""

    __slots__ = ("parent", "edits", "children")

    def __init__(self, parent: Node | None, edits: tuple[Edit, ...]) -> None:
        self.parent, self.edits, self.children = parent, edits, set()
        if parent is not None:
            parent.children.add(self)


class Repair:
    """Takes the rows of one conversation in order, and gives out its edits as soon as they are certain."""

    def __init__(self) -> None:
        self.root = Node(None, ())
        #: state: cost, node, place among the survivors in order of their letters
        self.alive: dict[int, tuple[int, Node, int]] = {NONE: (0, self.root, 0)}

    def with_inserts(self) -> list[tuple[int, int, Node, int, str]]:
        """(state, cost, node, place, roles put in) of the survivors as they are and with one or two turns after them."""
        out = []
        for state, (cost, node, place) in self.alive.items():
            out.append((state, cost, node, place, ""))
            if state in BEFORE["u"]:
                out.append((USER, cost + INSERT, node, place, "u"))
                out.append((ASSISTANT, cost + 2 * INSERT, node, place, "ua"))
            else:
                out.append((ASSISTANT, cost + INSERT, node, place, "a"))
        return out

    def push(self, row: tuple, initial: str, must_go: bool, truncated: bool) -> Iterator[Edit]:
        """One more row; initial: of its role; must_go: it can only be deleted."""
        best: dict[int, tuple] = {}
        for state, cost, node, place, put in self.with_inserts():
            letters = "I" * len(put)
            choices = [("D", None, state, DELETE)]
            if not must_go:
                if initial in BEFORE and state in BEFORE[initial]:
                    choices.append(("K", None, AFTER[initial], KEEP + TRUNCATED * truncated))
                choices += [("R", ROLES[x], AFTER[x], REROLE + TRUNCATED * truncated) for x in "ua" if state in BEFORE[x]]
            for letter, role, to, price in choices:
                key = (cost + price, place, letters + letter)
                if to not in best or key < best[to][0]:
                    best[to] = (key, node, put, (letter, role, row))
        for a, b in SLACK:
            if a in best and b in best and best[a][0][0] > best[b][0][0] + SLACK[a, b]:
                del best[a]
        before = [node for _, node, _ in self.alive.values()]
        in_order = sorted(best, key=lambda to: best[to][0][1:])
        self.alive = {}
        for place, to in enumerate(in_order):
            (cost, *_), node, put, edit = best[to]
            self.alive[to] = (cost, Node(node, (*inserts(put), edit)), place)
        for node in before:
            self.let_go(node)
        yield from self.certain()

    def let_go(self, node: Node) -> None:
        """Takes away a node that nothing refers to any more, and so on to its parents."""
        while not node.children and node.parent is not None and node is not self.root:
            node.parent.children.discard(node)
            node = node.parent

    def certain(self) -> Iterator[Edit]:
        """The edits of all ancestors that the survivors share."""
        while len(self.root.children) == 1:
            (self.root,) = self.root.children
            self.root.parent = None
            yield from self.root.edits

    def finish(self) -> Iterator[Edit]:
        """The rest of the edits, for the cheapest of all ways to end."""
        ends = [((cost, place, "I" * len(put)), node, put) for state, cost, node, place, put in self.with_inserts() if state in (NONE, ASSISTANT)]
        _, node, put = min(ends, key=lambda e: e[0])
        path: list[Edit] = []
        while node is not self.root:
            path += reversed(node.edits)
            node = node.parent
        yield from reversed(path)
        yield from inserts(put)


def faults(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role and text of rows, nulls in the last two as one space, with fault: blank, duplicate, truncated or null; and nth, of rows alike.

    Rows are dealt by conversation, once. Duplicates are found by sorting, so that no conversation is held.
    """
    space = F.lit(" ")
    dealt = rows.select(quoted(conv).alias("conv"), quoted(turn).alias("turn"), F.coalesce(quoted(role), space).alias("role"), F.coalesce(quoted(text), space).alias("text")).repartition("conv")
    counted = dealt.withColumn("nth", F.row_number().over(Window.partitionBy("conv", "role", "text").orderBy(F.asc_nulls_first("turn"))))
    trimmed = F.trim("text", F.lit(SPACE))
    fault = F.when(trimmed == "", "blank").when(F.col("nth") > 1, "duplicate").when(~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), "truncated")
    return counted.withColumn("fault", fault)


EDITS = "conv {conv}, step long, edit string, role string, text string, turn {turn}, fault string, illegal boolean"


def repair_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The edits of each conversation in order: conv, step (from 0), edit, role, text, turn, fault, illegal.

    edit is K, R, D or I; role and text are as repaired (of a deleted row: as they were). turn and fault are those of
    the row, null for a turn put in. illegal: the row does not go with the row before it, by the initials of their
    roles before any edit; null for a turn put in.

    Rows of a conversation are taken by turn (nulls first), then role and text; a null role or text is one space; rows
    without a conversation are one of their own. turn is a whole number. Blank rows and rows whose role and text came
    before must go; a truncated row that stays costs 1 more. Other columns are not used, whatever their names.

    A conversation is walked by one task, a batch of rows at a time, in bounded memory: its edits depend on each other
    from end to end. The result is sorted by conversation and step inside each partition.
    """
    tune(rows.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    marked = faults(rows, conv_col, turn_col, role_col, text_col)
    ordered = marked.sortWithinPartitions(F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), "role", "text", "nth").drop("nth")
    schema = EDITS.format(conv=kinds[conv_col], turn=kinds[turn_col])
    arrow = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in T._parse_datatype_string(schema).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        repair, current, step, last = None, None, 0, None

        def take(edits: Iterator[Edit]) -> None:
            nonlocal step
            for letter, role, row in edits:
                turn, own, text, fault, illegal = row or (None, None, "", None, None)
                out.append((current, step, letter, role or own, text, turn, fault, illegal))
                step += 1

        for batch in batches:
            for conv, turn, role, text, fault in zip(*(c.to_pylist() for c in batch.columns)):
                if repair is None or conv != current:
                    if repair is not None:
                        take(repair.finish())
                    repair, current, step, last = Repair(), conv, 0, None
                initial = role[:1]
                illegal = last is not None and (last, initial) not in (("s", "u"), ("u", "a"), ("a", "u"))
                last = initial
                take(repair.push((turn, role, text, fault, illegal), initial, fault in ("blank", "duplicate"), fault == "truncated"))
            if out:
                yield batch_of_rows(out, arrow)
                out.clear()
        if repair is not None:
            take(repair.finish())
        if out:
            yield batch_of_rows(out, arrow)

    return ordered.mapInArrow(lambda b: giving_back(run(b)), schema)


def batch_of_rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair_report(edits: DataFrame) -> DataFrame:
    """One row for each conversation of repair_turns: conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    gaps: turns that are missing between the first and the last; audit: the edits' letters; repaired_sha256: of the
    repaired role:text, joined by line feeds. Edits are read in the order in which repair_turns gives them, so it must
    follow without a shuffle; texts go into a running hash.
    """
    conv = edits.schema["conv"].dataType.simpleString()
    schema = f"conv {conv}, {REPORT}"
    arrow = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in T._parse_datatype_string(schema).fields])
    price = {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}

        def result() -> tuple:
            turns = state["last"] - state["first"] + 1 - state["turns"] if state["turns"] else 0
            return (state["conv"], turns, *(state[k] for k in ("blank", "duplicate", "truncated", "illegal", "cost")), "".join(state["audit"]), state["hash"].hexdigest())

        for batch in batches:
            done = []
            for conv, step, edit, role, text, turn, fault, illegal in zip(*(c.to_pylist() for c in batch.columns)):
                if step == 0:
                    if state:
                        done.append(result())
                    state = {"conv": conv, "first": None, "last": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": [], "hash": hashlib.sha256(), "begun": False}
                if turn is not None and turn != state["last"]:
                    state["first"] = turn if state["first"] is None else state["first"]
                    state["last"], state["turns"] = turn, state["turns"] + 1
                if fault:
                    state[fault] += 1
                state["illegal"] += bool(illegal)
                state["cost"] += price[edit] + TRUNCATED * (fault == "truncated" and edit != "D")
                state["audit"].append(edit)
                if edit != "D":
                    state["hash"].update(("\n" * state["begun"] + f"{role}:{text}").encode())
                    state["begun"] = True
            if done:
                yield batch_of_rows(done, arrow)
        if state:
            yield batch_of_rows([result()], arrow)

    return edits.mapInArrow(lambda b: giving_back(run(b)), schema)

