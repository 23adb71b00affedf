"""Repairing conversations at least cost, so that roles read ``(s?(ua)+)?`` by their initials.

Faults are found first (blank, repeated and truncated rows), by joins on row numbers.  Then each
conversation's rows pass once, in order, through a Viterbi search over four states: nothing written
yet, after the system row, after a user row, after an assistant row.  Survivors are leaves of a
tree of back pointers with reference counts; what no survivor needs is freed, and once all survivors
share an ancestor the edits up to it are final and are emitted, so memory is that of the part still
open, and of equal costs the whole open parts are compared.  A survivor that another beats by more
than the dearest way from one state to the other is dropped at once (it can't win nor tie).

Rows stream through sorted partitions; no conversation is held.  The search sees initials and faults
only; texts join the finished edits by row number, spread evenly however long a conversation is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendframe.llm.base import cut, pick

#: What the edits cost, and the roles that rows can be given.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
ROLES = {"u": "user", "a": "assistant"}
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ENDS = (START, ASSISTANT)
#: BEHIND[i][j]: being in state i instead of j costs this much more at most, whatever rows follow.  Reached by
#: inserts; a system row that only START may keep is deleted instead; SYSTEM can't end, so it inserts a pair.
BEHIND = ((0, 0, 2, 0), (4, 0, 2, 4), (5, 2, 0, 2), (3, 0, 2, 0))
#: Open edits are looked over for final ones when there are twice as many as were left last time, and these at least.
LOOK = 64
ROWS = 4096
BLANK = r"[^\x20\x09-\x0D]"


class _Node:
    """An edit at the end of the path to its parent; ``uses`` counts children and survivors."""

    __slots__ = ("parent", "edit", "role", "row", "depth", "uses")

    def __init__(self, parent, edit: str, role: str | None, row):
        self.parent, self.edit, self.role, self.row, self.uses = parent, edit, role, row, 0
        self.depth = parent.depth + 1 if parent is not None else 0
        if parent is not None:
            parent.uses += 1


def _drop(node: _Node) -> None:
    """One use less; frees what nobody uses any more."""
    node.uses -= 1
    while node.uses == 0 and node.parent is not None:
        node, freed = node.parent, node
        freed.parent = None
        node.uses -= 1


def _less(one: tuple, other: tuple) -> bool:
    """Whether path ``one`` + edit is ASCII-less than ``other``; both are (node, edit), compared from where they part."""
    (a, x), (b, y) = one, other
    left, right = [x], [y]
    while a is not b:
        if a.depth >= b.depth:
            left.append(a.edit)
            a = a.parent
        else:
            right.append(b.edit)
            b = b.parent
    return left[::-1] < right[::-1]


def _better(new: tuple, old: tuple | None) -> bool:
    """Candidates are (cost, parent, edit, role, row)."""
    return old is None or new[0] < old[0] or (new[0] == old[0] and _less(new[1:3], old[1:3]))


class Search:
    """Feed rows with ``step``; ``final`` yields edits that no later row can change, ``end`` the rest."""

    def __init__(self):
        self.root = _Node(None, "", None, None)
        self.root.uses = 1
        self.alive: dict[int, tuple[int, _Node]] = {}
        self._settle({START: (0, self.root, None, None, None)}, [self.root])
        self.look, self.open = LOOK, 0

    def _settle(self, best: dict[int, tuple], before: list[_Node]) -> None:
        """Takes the best candidate of each state, lets inserts improve them, drops the beaten, frees the old."""
        done: dict[int, tuple[int, _Node]] = {}
        while best:  # in order of cost: an insert only leads to dearer paths, so what is taken is settled
            state = min(best, key=lambda s: best[s][0])
            cost, parent, edit, role, row = best.pop(state)
            if any(held[0] + BEHIND[other][state] < cost for other, held in done.items()):
                continue
            node = parent if edit is None else _Node(parent, edit, role, row)
            done[state] = (cost, node)
            for initial, name in ROLES.items():
                to = NEXT.get((state, initial))
                if to is not None and to not in done:
                    new = (cost + INSERT, node, "I", name, None)
                    if _better(new, best.get(to)):
                        best[to] = new
        for _, node in done.values():
            node.uses += 1
        for node in before:
            _drop(node)
        self.alive = done

    def step(self, initial: str, truncated: bool, delete: bool, row) -> None:
        """The next row: the initial of its role, and whether it must be deleted."""
        best: dict[int, tuple] = {}

        def offer(state: int, new: tuple) -> None:
            if _better(new, best.get(state)):
                best[state] = new

        for state, (cost, node) in self.alive.items():
            offer(state, (cost + DELETE, node, "D", None, row))
            if delete:
                continue
            stays = cost + TRUNCATED * truncated
            if (state, initial) in NEXT:
                offer(NEXT[state, initial], (stays + KEEP, node, "K", None, row))
            for to, name in ROLES.items():
                if (state, to) in NEXT:
                    offer(NEXT[state, to], (stays + REROLE, node, "R", name, row))
        self._settle(best, [node for _, node in self.alive.values()])
        self.open += 1

    def _path(self, node: _Node) -> list[_Node]:
        path = []
        while node is not self.root:
            path.append(node)
            node = node.parent
        return path[::-1]

    def final(self) -> Iterator[tuple[str, str | None, object]]:
        """(edit, new role, row) of the edits that all survivors share."""
        if self.open < self.look:
            return
        path = self._path(next(iter(self.alive.values()))[1])
        at = 0
        held = {id(node) for _, node in self.alive.values()}
        while at < len(path) and self.root.uses == 1 and id(self.root) not in held:
            self.root.uses = 0
            self.root, at = path[at], at + 1
            self.root.parent = None
            yield self.root.edit, self.root.role, self.root.row
        self.open = len(path) - at
        self.look = max(LOOK, 2 * self.open)

    def end(self) -> tuple[int, list[tuple[str, str | None, object]]]:
        """The least cost, and the edits still open."""
        best = None
        for state in ENDS:
            if state in self.alive:
                cost, node = self.alive[state]
                if best is None or cost < best[0] or (cost == best[0] and _less((node, ""), (best[1], ""))):
                    best = (cost, node)
        return best[0], [(n.edit, n.role, n.row) for n in self._path(best[1])]


def _batches(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield from zip(*[column.to_pylist() for column in batch.slice(at, ROWS).columns])


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, conv_id, place, edit, new_role) from sorted (conv_id, initial, fault, row)."""
    source: list[pa.DataType] = []

    def watched() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source[:] = [batch.schema.field("conv_id").type]
            yield batch

    def found() -> Iterator[tuple]:
        search, conv, place = None, None, 0
        for conv_id, initial, fault, row in _rows(watched()):
            if search is None or conv_id != conv:
                if search is not None:
                    for edit, role, of in search.end()[1]:
                        yield of, conv, place, edit, role
                        place += 1
                search, conv, place = Search(), conv_id, 0
            search.step(initial, fault == "truncated", fault in ("blank", "duplicate"), row)
            for edit, role, of in search.final():
                yield of, conv, place, edit, role
                place += 1
        if search is not None:
            for edit, role, of in search.end()[1]:
                yield of, conv, place, edit, role
                place += 1

    rows = found()
    for first in rows:  # the schema is known once a batch has come
        schema = pa.schema([("row", pa.int64()), ("conv_id", source[0]), ("place", pa.int64()), ("edit", pa.string()), ("new_role", pa.string())])

        def chained(first=first) -> Iterator[tuple]:
            yield first
            yield from rows

        yield from _batches(chained(), schema)


def repair(convs: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per edit: ``conv_id, place, edit, turn, fault, old_role, role, text``.

    ``edit`` is K (keep), R (give another role), D (delete; ``role`` is null) or I (insert an empty row);
    ``place`` orders a conversation's edits.  Rows without D, by place, are the repaired conversation.
    Of all cheapest repairs it is the one whose edits' initials are least in ASCII.
    A row's ``fault`` is blank, else duplicate (role and text came before), else truncated.

    Rows go by turn, null first; of equal turns by role and then by the text's digest.  A null role or
    text counts as one space, so a null or empty text is blank; null ids are one conversation.  Repeated
    rows are duplicates.  Other columns are ignored; an empty table gives no rows.
    """
    plain = pick(convs, conv_id=id_col, turn=turn_col, role=role_col, text=text_col)
    plain = plain.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text")}).withColumn("turn", F.col("turn").cast("long"))
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    shape = F.when(last == "", "blank").when(~last.isin(".", "!", "?"), "truncated")
    held = cut(plain.withColumns({"shape": shape, "digest": F.sha2("text", 256), "row": F.monotonically_increasing_id()}))
    first = held.where("shape IS DISTINCT FROM 'blank'").groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn", "row"))["row"].alias("_first"))
    fault = F.when(F.col("shape") == "blank", "blank").when(F.col("_first").isNull(), "duplicate").otherwise(F.col("shape"))
    keys = held.select("conv_id", "turn", "role", "digest", "shape", "row").join(first.select("_first"), F.col("row") == F.col("_first"), "left")
    keys = cut(keys.select("conv_id", "turn", "role", "digest", fault.alias("fault"), "row"))
    ordered = keys.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "digest", "row")
    kind = held.schema["conv_id"].dataType.simpleString()
    edits = cut(
        ordered.select("conv_id", F.substring("role", 1, 1).alias("initial"), "fault", "row").mapInArrow(
            _edits, f"row bigint, conv_id {kind}, place bigint, edit string, new_role string"
        )
    )
    texts = held.select(F.col("row").alias("_row"), "turn", F.col("role").alias("old_role"), "text")
    faults = keys.select(F.col("row").alias("_of"), "fault")
    given = edits.where("row IS NOT NULL").join(texts, F.col("row") == F.col("_row")).join(faults, F.col("row") == F.col("_of"))
    role = F.when(F.col("edit") != "D", F.coalesce("new_role", "old_role"))
    given = given.select("conv_id", "place", "edit", "turn", "fault", "old_role", role.alias("role"), "text")
    nothing = F.lit(None).cast("string")
    made = edits.where("row IS NULL").select(
        "conv_id", "place", "edit", F.lit(None).cast("long").alias("turn"), nothing.alias("fault"), nothing.alias("old_role"), F.col("new_role").alias("role"), F.lit("").alias("text")
    )
    return given.union(made)


COST = {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}


class _Account:
    """What is counted of one conversation, edit by edit."""

    def __init__(self):
        self.turns, self.low, self.turn, self.illegal, self.cost = 0, None, None, 0, 0
        self.faults = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.audit, self.before, self.hash, self.rows = [], None, hashlib.sha256(), 0

    def add(self, edit, turn, fault, old_role, role, text) -> None:
        self.audit.append(edit)
        self.cost += COST[edit] + (TRUNCATED if fault == "truncated" and edit != "D" else 0)
        if edit != "I":
            if fault:
                self.faults[fault] += 1
            if turn is not None and turn != self.turn:  # turns rise
                self.turns += 1
                self.low = turn if self.low is None else self.low
                self.turn = turn
            if self.before is not None and self.before + old_role[:1] not in ("su", "ua", "au"):
                self.illegal += 1
            self.before = old_role[:1]
        if edit != "D":
            self.hash.update(("\n" if self.rows else "").encode() + f"{role}:{text}".encode())
            self.rows += 1

    def row(self) -> tuple:
        gaps = self.turn - self.low + 1 - self.turns if self.turns else 0
        return (gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


def account(repaired: DataFrame) -> DataFrame:
    """One row per conversation of ``repair``'s edits: ``gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256``.  Rows stream in order; of a conversation only its audit string is held."""
    kind = repaired.schema["conv_id"].dataType.simpleString()
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (batches := iter(batches)):
            schema = pa.schema([("conv_id", batch.schema.field("conv_id").type), *((c, pa.int64()) for c in counts), ("audit", pa.string()), ("repaired_sha256", pa.string())])

            def found(first=batch) -> Iterator[tuple]:
                held, conv = None, None

                def all_batches() -> Iterator[pa.RecordBatch]:
                    yield first
                    yield from batches

                for conv_id, *edit in _rows(all_batches()):
                    if held is None or conv_id != conv:
                        if held is not None:
                            yield conv, *held.row()
                        held, conv = _Account(), conv_id
                    held.add(*edit)
                if held is not None:
                    yield conv, *held.row()

            yield from _batches(found(), schema)

    ordered = repaired.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    columns = ordered.select("conv_id", "edit", "turn", "fault", "old_role", "role", "text")
    return columns.mapInArrow(run, f"conv_id {kind}, {', '.join(f'{c} bigint' for c in counts)}, audit string, repaired_sha256 string")
