"""Repair of the turns of conversations: the cheapest edits that make their roles alternate."""

import pickle
import struct
from collections.abc import Iterator
from functools import cache
from hashlib import sha256
from tempfile import SpooledTemporaryFile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 1, 2, 5, 5
BLANK_CHARACTERS = " \t\n\x0b\x0c\r"

# What has been put out so far: nothing, a system turn, a user turn, an answer.
NOTHING, SYSTEM, USER, ANSWER = range(4)
FOLLOWS = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (ANSWER, "u"): USER, (USER, "a"): ANSWER}
ROLES = {"u": "user", "a": "assistant"}
# DEAREST[p, q]: what a path in state p pays at most above one in state q for any rest of the
# conversation. A path that costs more than another plus this can never win, nor tie.
DEAREST = {
    (NOTHING, SYSTEM): 0, (NOTHING, USER): 2, (NOTHING, ANSWER): 0,
    (ANSWER, NOTHING): 2, (ANSWER, SYSTEM): 0, (ANSWER, USER): 2,
    (USER, NOTHING): 5, (USER, SYSTEM): 2, (USER, ANSWER): 5,
}
# Rows that wait for a decision stay in memory up to so many bytes, then in a temporary file.
WAITING_BYTES = 32_000_000
BATCH_ROWS, BATCH_BYTES = 4_096, 4_000_000

REPAIRED = "conv_id bigint, turn bigint, fault string, edit string, role_before string, role string, text string, cost bigint"


def _inserts(state: int) -> list[tuple[int, str, tuple[str, ...]]]:
    """States reached by inserted turns alone: state, edits, inserted roles; a longer round trip never pays."""
    out, roles = [(state, "", ())], ()
    for _ in range(2):
        initial = "a" if state == USER else "u"
        state, roles = FOLLOWS[state, initial], (*roles, ROLES[initial])
        out.append((state, INSERT * len(roles), roles))
    return out


@cache
def _moves(initial: str, forced: bool, truncated: bool) -> list[tuple[int, int, int, str, tuple]]:
    """Ways past one row: from state, to state, cost, edits, roles put out (None: as it was)."""
    best: dict[tuple[int, int], tuple] = {}
    for start in range(4):
        for state, inserted, roles in _inserts(start):
            ways = [(state, DELETE_COST, DELETE, ())]
            if not forced:
                more = TRUNCATED_COST * truncated
                if (state, initial) in FOLLOWS:
                    ways.append((FOLLOWS[state, initial], more, KEEP, (None,)))
                other = "a" if state == USER else "u"
                ways.append((FOLLOWS[state, other], more + REROLE_COST, REROLE, (ROLES[other],)))
            for end, cost, edit, own in ways:
                way = (cost + INSERT_COST * len(inserted), inserted + edit, (*roles, *own))
                if (start, end) not in best or way[:2] < best[start, end][:2]:
                    best[start, end] = way
    return [(*k, *v) for k, v in best.items()]


class _Node:
    """One row's edits on some path; ``refs`` counts the nodes after it, and itself while a survivor."""

    __slots__ = ("parent", "move", "refs")

    def __init__(self, parent, move):
        self.parent, self.move, self.refs = parent, move, 1


class Survivors:
    """The cheapest path into each state, as leaves of one tree.

    Of paths of equal cost the one with the least edits, compared from their fork to the present
    row, is kept. Two paths over the same rows never begin one another, so their order does not
    change any more: it is carried on as a rank, which stands for comparing the whole suffixes
    anew at every tie. What all survivors share is handed out and forgotten.
    """

    def __init__(self):
        self.root = _Node(None, None)
        self.live = {NOTHING: (0, 0, self.root)}

    def step(self, initial: str, forced: bool, truncated: bool) -> list[tuple]:
        """Moves decided by the next row, oldest first."""
        best: dict[int, tuple] = {}
        for start, end, cost, edits, roles in _moves(initial, forced, truncated):
            if start in self.live:
                before, rank, node = self.live[start]
                way = (before + cost, rank, edits, node, roles)
                if end not in best or way[:3] < best[end][:3]:
                    best[end] = way
        for state in list(best):
            if any(best[p][0] + DEAREST.get((p, state), 1e9) < best[state][0] for p in best if p != state):
                del best[state]
        order = {key: i for i, key in enumerate(sorted(w[1:3] for w in best.values()))}
        old, self.live = self.live, {}
        for state, (cost, rank, edits, node, roles) in best.items():
            node.refs += 1
            self.live[state] = (cost, order[rank, edits], _Node(node, (edits, roles)))
        for _, _, node in old.values():
            self._drop(node)
        return self._decided(next(iter(self.live.values()))[2]) if self.root.refs == 1 else []

    def end(self) -> tuple[int, list[tuple]]:
        """The whole cost, and all moves not handed out yet with the turns to be added last."""
        ends = []
        for state, (cost, rank, node) in self.live.items():
            for reached, edits, roles in _inserts(state):
                if reached in (NOTHING, ANSWER):
                    ends.append((cost + INSERT_COST * len(edits), rank, edits, node, roles))
        cost, _, edits, node, roles = min(ends, key=lambda e: e[:3])
        moves = []
        while node is not self.root:
            moves.append(node.move)
            node = node.parent
        return cost, [*reversed(moves), (edits, roles)]

    def _drop(self, node) -> None:
        node.refs -= 1
        while node.refs == 0 and node.parent is not None:
            node.move, node = None, node.parent
            node.refs -= 1

    def _decided(self, leaf) -> list[tuple]:
        path = []
        while leaf is not self.root:
            path.append(leaf)
            leaf = leaf.parent
        leaves, out = {id(n) for _, _, n in self.live.values()}, []
        while path and self.root.refs == 1 and id(self.root) not in leaves:
            self.root = path.pop()
            out.append(self.root.move)
        self.root.parent = None
        return out


class _Waiting:
    """Rows in order until their edits are known; beyond WAITING_BYTES in a temporary file."""

    def __init__(self):
        self.file, self.at, self.held = SpooledTemporaryFile(WAITING_BYTES), 0, 0

    def put(self, row: tuple) -> None:
        data = pickle.dumps(row)
        self.file.seek(0, 2)
        self.file.write(struct.pack("<q", len(data)) + data)
        self.held += 1

    def get(self) -> tuple:
        self.file.seek(self.at)
        (size,) = struct.unpack("<q", self.file.read(8))
        row = pickle.loads(self.file.read(size))
        self.at, self.held = self.at + 8 + size, self.held - 1
        if not self.held:
            self.file.seek(0)
            self.file.truncate()
            self.at = 0
        return row


def _price(edit: str, fault: str | None) -> int:
    own = {KEEP: 0, REROLE: REROLE_COST, DELETE: DELETE_COST, INSERT: INSERT_COST}[edit]
    return own + TRUNCATED_COST * (fault == "truncated" and edit in (KEEP, REROLE))


def _apply(conv_id, waiting: _Waiting, moves: list[tuple]) -> Iterator[tuple]:
    """Rows of REPAIRED for decided moves."""
    for edits, roles in moves:
        put_out = iter(roles)
        for edit in edits:
            if edit == INSERT:
                yield conv_id, None, None, INSERT, None, next(put_out), "", INSERT_COST
                continue
            turn, role, text, fault = waiting.get()
            if edit == DELETE:
                yield conv_id, turn, fault, DELETE, role, None, None, DELETE_COST
            else:
                yield conv_id, turn, fault, edit, role, next(put_out) or role, text, _price(edit, fault)


def _batches(rows: Iterator[tuple], schema: pa.Schema, text: int) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
    for row in rows:
        held.append(row)
        size += len(row[text] or "")
        if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield pack()
            held, size = [], 0
    if held:
        yield pack()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        # A few rows at a time, so that long texts are not all held twice.
        for at in range(0, batch.num_rows, 256):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, 256).columns))


def _repaired(rows: Iterator[tuple]) -> Iterator[tuple]:
    """``rows (conv_id, turn, role, text, fault)`` with conversations one after the other."""
    current = survivors = waiting = None
    for conv_id, *row in rows:
        if survivors is None or conv_id != current:
            if survivors:
                yield from _apply(current, waiting, survivors.end()[1])
            current, survivors, waiting = conv_id, Survivors(), _Waiting()
        _, role, _, fault = row
        waiting.put(tuple(row))
        moves = survivors.step(role[:1], fault in ("blank", "duplicate"), fault == "truncated")
        yield from _apply(conv_id, waiting, moves)
    if survivors:
        yield from _apply(current, waiting, survivors.end()[1])


def faults(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, fault`` in the order of turns, a conversation in one partition.

    ``fault`` is the first that holds: ``blank`` (no character but white space), ``duplicate``
    (role and text seen earlier in the conversation), ``truncated`` (does not end in ``.!?``).
    Rows stand by turn, null turns first, then by role and text. One shuffle serves the search
    for duplicates and the order.
    """
    value = lambda n: F.coalesce(n, F.lit(" ")).alias(n)
    own = rows.select("conv_id", "turn", value("role"), value("text")).repartition("conv_id")
    copies = Window.partitionBy("conv_id", "role", "text").orderBy(F.asc_nulls_first("turn"))
    bare = F.rtrim("text", F.lit(BLANK_CHARACTERS))
    fault = (
        F.when(bare == "", "blank").when(F.row_number().over(copies) > 1, "duplicate")
        .when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated")
    )
    order = [F.asc_nulls_first(n) for n in ("conv_id", "turn")]
    # Of equal rows the one that is no duplicate stands first.
    later = F.coalesce(F.col("fault") == "duplicate", F.lit(False))
    return own.withColumn("fault", fault).sortWithinPartitions(*order, "role", "text", later)


def repair(rows: DataFrame) -> DataFrame:
    """The columns of REPAIRED: every row of ``rows (conv_id, turn, role, text)`` and every inserted one with its edit.

    Roles must read, by their initials, ``(s?(ua)+)?``. Rows are kept (cost 0), given the role
    user or assistant (1), deleted (2; blank and duplicate ones must be) or inserted without text
    (5); a truncated row that stays costs 5 more. The cheapest edits win, of equally cheap ones
    those whose initials come first as a string.

    Conversations are streamed turn by turn: each task holds one path per state, and what they
    all share is put out at once. Only turns that are still open wait, in memory or beyond
    WAITING_BYTES in a temporary file of the task. Turns are written in order, a conversation
    after the other, its deleted ones with null ``role`` and ``text``. One conversation is one
    task, since each decision depends on all turns before it.

    Null roles and texts count as one space, so they are blank or of an unknown role; rows
    without ``conv_id`` are one conversation; null turns come first; repeated rows are
    duplicates of each other. Without rows the result is empty. Other columns are ignored.
    """
    schema = to_arrow_schema(StructType.fromDDL(REPAIRED))
    return faults(rows).mapInArrow(lambda batches: _batches(_repaired(_rows(batches)), schema, 6), REPAIRED)


#: Columns of a digest, one row for each conversation that has turns.
DIGEST = (
    "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
    "audit string, repaired_sha256 string"
)


class _Digest:
    def __init__(self, conv_id):
        self.conv_id, self.turns, self.first, self.last, self.before = conv_id, 0, None, None, None
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.illegal = self.cost = 0
        self.audit, self.kept, self.hash = [], 0, sha256()

    def add(self, turn, fault, edit, role_before, role, text, cost) -> None:
        self.cost += cost
        self.audit.append(edit)
        if edit != INSERT:
            if turn is not None and turn != self.last:
                self.first = turn if self.first is None else self.first
                self.turns, self.last = self.turns + 1, turn
            if fault:
                self.counts[fault] += 1
            if self.before is not None:
                self.illegal += self.before + role_before[:1] not in ("su", "ua", "au")
            self.before = role_before[:1]
        if edit != DELETE:
            self.hash.update(f"{chr(10) if self.kept else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
            self.kept += 1

    def row(self) -> tuple:
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return self.conv_id, gaps, *self.counts.values(), self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


def _digests(rows: Iterator[tuple]) -> Iterator[tuple]:
    held = None
    for conv_id, *row in rows:
        if held is None or held.conv_id != conv_id:
            if held:
                yield held.row()
            held = _Digest(conv_id)
        held.add(*row)
    if held:
        yield held.row()


def digest(repaired: DataFrame) -> DataFrame:
    """The columns of DIGEST from :func:`repair`, whose partitions are read as they stand."""
    schema = to_arrow_schema(StructType.fromDDL(DIGEST))
    return repaired.mapInArrow(lambda batches: _batches(_digests(_rows(batches)), schema, 7), DIGEST)


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with faults put in by the crc32 of ``conv_id:turn``.

    By the remainder by 20: 0 drops the row, 1 empties its text, 2 removes its ``.!?``, 3 repeats
    it, 4 makes it the user's. Nulls in the key, the role and the text are one space.
    """
    text = lambda n: F.coalesce(F.col(n).cast("string"), F.lit(" "))
    case: Column = F.crc32(F.concat_ws(":", text("conv_id"), text("turn"))) % 20
    own = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), case.alias("case"))
    changed = F.when(F.col("case") == 1, "").when(F.col("case") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(True), F.when(F.col("case") == 3, 2).otherwise(1)))
    role = F.when(F.col("case") == 4, "user").otherwise(F.col("role"))
    return own.where("case != 0").select("conv_id", "turn", role.alias("role"), changed.alias("text"), copies.alias("copy")).drop("copy")


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """DIGEST of every conversation after damage and repair; one that lost all rows has zeros and an empty audit."""
    ids = conversations.select("conv_id").distinct()
    found = digest(repair(damaged(conversations))).withColumnRenamed("conv_id", "found_id")
    names = [f.name for f in StructType.fromDDL(DIGEST)][1:]
    empty = {"audit": "", "repaired_sha256": sha256().hexdigest()}
    return ids.join(found, ids.conv_id.eqNullSafe(found.found_id), "left").select(
        "conv_id", *[F.coalesce(n, F.lit(empty.get(n, 0))).alias(n) for n in names]
    )
