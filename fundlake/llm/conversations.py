"""Repair of conversation structure: cost DP, then the least cheapest path by prefix-doubling ranks.

A conversation is repaired to role initials `(s?(ua)+)?` by edits of its rows: Keep (0), Rerole to user or assistant (1),
Delete (2; required for blank and duplicate rows), Insert an empty user or assistant text anywhere (5); a truncated row
that stays costs 5 more. The form is an automaton of four states, so the edits of n rows are paths over 4 (n + 1) nodes:

1. the cost DP runs from the end: each node's cheapest way to an accepted end;
2. arcs of that cost are the optimal arcs. A letter leads from a node to one node only, and every optimal arc can be
   completed;
3. nodes are ranked by the least first letter of their optimal arcs, then by successive power-of-two audit lengths: the
   rank for 2 L letters is the rank of the pair (rank for L, rank for L of the node that the pointer for L reaches), and
   the pointer is doubled. An ended audit ranks before every letter, so ranks are the ASCII order of audits. When every
   pointer has reached an end, the doubled pointers spell the least path from the start.

Spark sorts all rows by conversation, turn, role and text into ranges of like size, so a conversation of any length is
spread over tasks. A task cuts what it reads into pieces of at most PIECE rows. A conversation that lies within one
piece, and not at a border of the task's range, is solved at once. All other pieces are stored, and few as they are go
through four steps, each of which moves rows by piece or single numbers per piece: duplicates of earlier pieces are found
by digests; a piece is condensed to the cost matrix between its entry and exit states; a pass from each conversation's
end turns matrices into the cost from each state at a piece's end; with these each piece is ranked by itself, for every
entry state; a pass from the start chains the audits and feeds the repaired text into the hash. Memory is bounded by the
piece, but for the audit itself, which the result holds as one string.

Defined results: null values are read as one space in the damage's checksum, in role and text; a null conv_id is a
conversation of its own and is returned as null; null turns come first; rows of one turn are ordered by role and text
(by their first KEY characters, then by a digest); equal rows are duplicates of each other; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundlake.llm.common import split_join, stored

PIECE, PIECE_BYTES = 4096, 1 << 23  # rows and bytes of text of a piece
TOGETHER = 1 << 14  # rows whose paths are ranked at once
KEY = 64  # characters of role and text that a sort key holds
SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
LETTERS = "DIKR"  # in ASCII order
FAR = 1 << 60
# Automaton: 0 nothing yet, 1 after s, 2 after u, 3 after a. Ends in 0 and 3.
STATES = 4
TURN = np.array([2, 2, 3, 2])  # the state after the user or assistant row that is due
DUE = ["user", "user", "assistant", "user"]
KEPT = np.array([[1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1], [-1, -1, -1, -1]])  # [initial s, u, a, other][state]
END = np.array([0, 10, 5, 0])  # with the inserts that are still due
PLAIN, BLANK, DUPLICATE, CUT = range(4)
_KEY_TYPE = "struct<dated: boolean, turn: bigint, role: string, text: string, digest: binary, row: bigint>"
_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_RESULT = ", ".join(["conv_id bigint", *(f"{c} bigint" for c in _COUNTS), "audit string", "repaired_sha256 string"])
_PIECE = ("piece bigint, start " + _KEY_TYPE + ", roles array<string>, texts array<string>, faults array<int>, turns array<bigint>")


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, key, role, text, copies): the rows after damage by crc32(conv_id:turn) % 20; a dropped row has 0 copies."""
    conv, turn = (F.col(c).cast("long") for c in ("conv_id", "turn"))
    spaced = [F.coalesce(c.cast("string"), F.lit(" ")) for c in (conv, turn)]
    part = F.crc32(F.concat_ws(":", *spaced).cast("binary")) % 20
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    # fixed values: what each remainder does
    text = F.when(part.isin(0, 1), F.lit("")).when(part == 2, F.translate(text, ".!?", "")).otherwise(text)
    role = F.when(part == 4, F.lit("user")).otherwise(role)
    rows = rows.select(conv.alias("conv_id"), turn.alias("turn"), role.alias("role"), text.alias("text"),
                       F.when(part == 0, 0).when(part == 3, 2).otherwise(1).cast("long").alias("copies"))
    digest = F.unhex(F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256))
    key = F.struct(F.col("turn").isNotNull().alias("dated"), F.col("turn").alias("turn"), F.substring("role", 1, KEY).alias("role"),
                   F.substring("text", 1, KEY).alias("text"), digest.alias("digest"), F.monotonically_increasing_id().alias("row"))
    return rows.select("conv_id", key.alias("key"), "role", "text", "copies")


def _faults(roles: list[str], texts: list[str], seen: set[tuple[str, str]]) -> list[int]:
    out = []
    for row in zip(roles, texts, strict=True):
        last = row[1].rstrip(SPACE)[-1:]
        out.append(BLANK if not last else DUPLICATE if row in seen else PLAIN if last in ".!?" else CUT)
        seen.add(row)
    return out


def _initials(roles: list[str]) -> np.ndarray:
    return np.array(["sua".find(r[:1]) if r else -1 for r in roles], np.int64) % STATES


class Paths:
    """Costs and least paths of several pieces at once: initials and faults per row, offsets of the pieces, and for each
    piece the costs at its end (rows of `ends`) and whether inserts may follow its last row."""

    def __init__(self, initials: np.ndarray, faults: np.ndarray, offsets: np.ndarray, ends: np.ndarray, last: np.ndarray) -> None:
        self.offsets, self.last = offsets, last
        sizes = np.diff(offsets)
        self.first = offsets[:-1] + np.arange(len(sizes))  # the nodes' first position of each piece
        cost = np.empty((int(offsets[-1]) + len(sizes), STATES), np.int64)
        cost[self.first + sizes] = ends
        self.initials, self.forced, self.extra = initials, (faults == BLANK) | (faults == DUPLICATE), np.where(faults == CUT, TRUNCATED, 0)
        longest = np.argsort(-sizes, kind="stable")
        for step in range(int(sizes.max(initial=0))):
            active = longest[:np.searchsorted(-sizes[longest], -step, "left")]
            row = offsets[active + 1] - 1 - step
            cost[self.first[active] + sizes[active] - 1 - step] = self._inserted(self._arcs(row, cost[self.first[active] + sizes[active] - step])[0].min(0))
        self.cost = cost

    @staticmethod
    def _inserted(cost: np.ndarray) -> np.ndarray:
        once = np.minimum(cost, np.minimum(INSERT + cost[:, TURN], FAR))
        return np.minimum(once, np.minimum(INSERT + once[:, TURN], FAR))

    def _arcs(self, row: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Costs (D, K, R) x rows x states with the costs `after` the rows, and the states that K leads to."""
        kept = KEPT[self.initials[row]]
        stays = np.where(self.forced[row], FAR, self.extra[row])[:, None]
        keep = np.where(kept < 0, FAR, np.take_along_axis(after, np.maximum(kept, 0), 1))
        return np.minimum(np.stack([DELETE + after, KEEP + stays + keep, REROLE + stays + after[:, TURN]]), FAR), kept

    def arcs(self) -> tuple[np.ndarray, np.ndarray]:
        """Per node (position x state) the place in LETTERS of the least optimal arc (-1 at an end), and where it leads."""
        sizes = np.diff(self.offsets)
        n = len(self.cost)
        letter, target = np.full((n, STATES), -1), np.arange(n * STATES).reshape(n, STATES)
        node = target.copy()
        inner = np.ones(n, bool)
        inner[self.first + sizes] = False
        at = np.flatnonzero(inner)
        costs, kept = self._arcs(np.arange(int(self.offsets[-1])), self.cost[at + 1])
        here = self.cost[at]
        insert = INSERT + here[:, TURN]
        ways = [costs[2], costs[1], insert, costs[0]]  # R, K, I, D: the least letter is written last
        places = [node[at + 1][:, TURN], np.take_along_axis(node[at + 1], np.maximum(kept, 0), 1), node[at][:, TURN], node[at + 1]]
        for number, way, place in zip((3, 2, 1, 0), ways, places, strict=True):
            best = (way == here) & (here < FAR)
            letter[at] = np.where(best, number, letter[at])
            target[at] = np.where(best, place, target[at])
        closing = (self.first + sizes)[self.last]
        due = self.cost[closing] > 0
        letter[closing] = np.where(due, LETTERS.index("I"), letter[closing])
        target[closing] = np.where(due, node[closing][:, TURN], target[closing])
        return letter.reshape(-1), target.reshape(-1)

    def least(self, starts: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The least cheapest audit from each start node, and every node's rank by its audit."""
        letter, target = self.arcs()
        rank, pointers = letter + 1, [target]
        while (rank[pointers[-1]] > 0).any():
            pair = rank * (rank.max() + 1) + rank[pointers[-1]]
            rank = np.unique(pair, return_inverse=True)[1].reshape(-1) + (0 if (pair == 0).any() else 1)
            pointers.append(pointers[-1][pointers[-1]])
        # a node at step t of a path has the one at step t + L behind its pointer of length L
        owner, step, node = np.arange(len(starts)), np.zeros(len(starts), np.int64), starts
        for level in range(len(pointers) - 1, -1, -1):
            owner, step = np.concatenate([owner, owner]), np.concatenate([step, step + (1 << level)])
            node = np.concatenate([node, pointers[level][node]])
            on = letter[node] >= 0
            owner, step, node = owner[on], step[on], node[on]
        order = np.lexsort((step, owner))
        spelled = np.frombuffer(LETTERS.encode(), np.uint8)[letter[node[order]]].tobytes().decode()
        ends = np.searchsorted(owner[order], np.arange(len(starts) + 1))
        return [spelled[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)], rank


def repaired_lines(audit: str, state: int, roles: list[str], texts: list[str]) -> tuple[list[str], int]:
    """The lines `role:text` that an audit makes of its rows, and the state after them."""
    lines, row = [], 0
    for letter in audit:
        if letter == "I":
            lines.append(f"{DUE[state]}:")
            state = int(TURN[state])
            continue
        if letter == "K":
            lines.append(f"{roles[row]}:{texts[row]}")
            state = int(KEPT[_initials(roles[row:row + 1])[0], state])
        elif letter == "R":
            lines.append(f"{DUE[state]}:{texts[row]}")
            state = int(TURN[state])
        row += 1
    return lines, state


def _illegal(initials: np.ndarray) -> int:
    """Adjacent initials that are not su, ua or au."""
    a, b = initials[:-1], initials[1:]
    return int((~(((a == 0) & (b == 1)) | ((a == 1) & (b == 2)) | ((a == 2) & (b == 1)))).sum())


class _Tally:
    """Counts over the rows of a conversation, piece after piece."""

    def __init__(self) -> None:
        self.counts = dict.fromkeys(_COUNTS, 0)
        self.initial = self.turn = self.first = None
        self.distinct = 0

    def add(self, roles: list[str], faults: list[int], turns: list[int | None]) -> None:
        if not roles:
            return
        initials = _initials(roles)
        before = [] if self.initial is None else [self.initial]
        self.counts["illegal"] += _illegal(np.concatenate([before, initials]).astype(np.int64))
        self.initial = initials[-1]
        for name, fault in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", CUT)):
            self.counts[name] += sum(f == fault for f in faults)
        for turn in turns:
            if turn is not None and turn != self.turn:
                self.distinct += 1
                self.first = turn if self.first is None else self.first
                self.turn = turn

    def result(self) -> list[int]:
        self.counts["gaps"] = 0 if self.first is None else self.turn - self.first + 1 - self.distinct
        return list(self.counts.values())


def _solved(pieces: list[dict]) -> list[list]:
    """The results of conversations of one piece each."""
    offsets = np.cumsum([0, *(len(p["roles"]) for p in pieces)])
    flat = [r for p in pieces for r in p["roles"]]
    paths = Paths(_initials(flat), np.array([f for p in pieces for f in p["faults"]], np.int64), offsets, np.tile(END, (len(pieces), 1)),
                  np.ones(len(pieces), bool))
    starts = paths.first * STATES
    audits, _ = paths.least(starts)
    out = []
    for piece, audit, cost in zip(pieces, audits, paths.cost.reshape(-1)[starts], strict=True):
        tally = _Tally()
        tally.add(piece["roles"], piece["faults"], piece["turns"])
        tally.counts["cost"] = int(cost)
        lines, _ = repaired_lines(audit, 0, piece["roles"], piece["texts"])
        out.append([piece["conv_id"], *tally.result(), audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()])
    return out


def _pieces(limit: int):
    """Sorted rows to whole conversations (with results) and pieces (with rows)."""
    names = ["conv_id", *_COUNTS, "audit", "repaired_sha256", "piece", "start", "roles", "texts", "faults", "turns"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_piece: dict | None = None
        seen: set[tuple[str, str]] = set()
        parts = 0  # pieces of the open conversation already sent
        first_conv = True
        ready: list[dict] = []
        waiting = 0

        def fresh(conv, key) -> dict:
            return {"conv_id": conv, "piece": key["row"], "start": key, "roles": [], "texts": [], "faults": [], "turns": [], "bytes": 0, "sent": 0}

        def rows_of(pieces: list[dict]) -> pa.RecordBatch:
            data = [{n: p.get(n) for n in names} for p in pieces]
            return pa.RecordBatch.from_pylist(data, schema=_ARROW)

        def results(pieces: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(names, r, strict=False)) for r in _solved(pieces)], schema=_ARROW)

        for batch in batches:
            for conv, key, role, text, copies in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "key", "role", "text", "copies")), strict=True):
                if open_piece is None or conv != open_piece["conv_id"]:
                    if open_piece is not None:
                        # a conversation at the beginning of the range may have begun in the range before
                        if first_conv or parts:
                            yield rows_of([open_piece])
                        else:
                            ready.append(open_piece)
                            waiting += len(open_piece["roles"])
                            if waiting >= TOGETHER or len(ready) >= TOGETHER:
                                yield results(ready)
                                ready, waiting = [], 0
                        first_conv = False
                    open_piece, seen, parts = fresh(conv, key), set(), 0
                elif len(open_piece["roles"]) >= limit or open_piece["bytes"] >= PIECE_BYTES:
                    yield rows_of([open_piece])
                    open_piece, seen, parts = fresh(conv, key), set(), parts + 1
                if copies:
                    open_piece["roles"] += [role] * copies
                    open_piece["texts"] += [text] * copies
                    open_piece["turns"] += [key["turn"]] * copies
                    open_piece["faults"] += _faults([role] * copies, [text] * copies, seen)
                    open_piece["bytes"] += copies * (len(role) + len(text))
        if ready:
            yield results(ready)
        if open_piece is not None:
            yield rows_of([open_piece])

    return run


_KEY_ARROW = pa.struct([("dated", pa.bool_()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()),
                        ("digest", pa.binary()), ("row", pa.int64())])
_ARROW = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in _COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string()),
                    ("piece", pa.int64()), ("start", _KEY_ARROW), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())),
                    ("faults", pa.list_(pa.int32())), ("turns", pa.list_(pa.int64()))])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each row of a piece that is neither blank nor a duplicate within it."""
    for batch in batches:
        for conv, piece, start, roles, texts, faults in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "piece", "start", "roles", "texts", "faults")), strict=True):
            at = [i for i, f in enumerate(faults) if f in (PLAIN, CUT)]
            found = [hashlib.sha256(f"{len(roles[i])}:{roles[i]}:{texts[i]}".encode()).digest() for i in at]
            yield pa.RecordBatch.from_arrays([
                pa.array([{"conv": conv, "digest": d} for d in found], pa.struct([("conv", pa.int64()), ("digest", pa.binary())])),
                pa.array([piece] * len(at), pa.int64()), pa.array([start] * len(at), _KEY_ARROW), pa.array(at, pa.int32())],
                ["line", "piece", "start", "place"])


def _with_duplicates(pieces: DataFrame) -> DataFrame:
    """The pieces with the rows marked that an earlier piece of the conversation holds."""
    lines = stored(pieces.mapInArrow(_digests, "line struct<conv: bigint, digest: binary>, piece bigint, start " + _KEY_TYPE + ", place int"))
    earliest = lines.groupBy("line").agg(F.min("start").alias("earliest"), F.count("*").alias("n")).where("n > 1")
    repeated = split_join(lines, earliest.drop("n"), "line").where("start > earliest")
    places = repeated.groupBy("piece").agg(F.collect_set("place").alias("places"))
    marked = F.transform("faults", lambda f, i: F.when(F.array_contains("places", i), F.lit(DUPLICATE)).otherwise(f))
    return split_join(pieces, places, "piece", "left").withColumn("faults", F.when(F.col("places").isNull(), F.col("faults")).otherwise(marked)).drop("places")


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per piece the cheapest cost from each entry state (row) to each state at its end (column)."""
    for batch in batches:
        for conv, piece, start, roles, faults in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "piece", "start", "roles", "faults")), strict=True):
            # four copies of the piece, each with one accepted end
            n, ends = len(roles), np.full((STATES, STATES), FAR)
            np.fill_diagonal(ends, 0)
            paths = Paths(np.tile(_initials(roles), STATES), np.tile(np.array(faults, np.int64), STATES), np.arange(STATES + 1) * n, ends, np.zeros(STATES, bool))
            yield pa.RecordBatch.from_arrays([
                pa.array([conv], pa.int64()), pa.array([piece], pa.int64()), pa.array([start], _KEY_ARROW),
                pa.array([paths.cost[paths.first].T.reshape(-1).tolist()], pa.list_(pa.int64()))], ["conv_id", "piece", "start", "matrix"])


def _costs_after(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of each conversation, last first, to the cost from each state at the piece's end."""
    conv, after, none = None, END, True
    for batch in batches:
        pieces, ends, last = [], [], []
        for name, piece, matrix in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "piece", "matrix")), strict=True):
            closing = none or name != conv
            conv, none = name, False
            after = END if closing else after
            pieces.append(piece)
            ends.append([int(v) for v in after])
            last.append(closing)
            after = np.minimum((np.array(matrix).reshape(STATES, STATES) + after[None, :]).min(1), FAR)
        yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.int64()), pa.array(ends, pa.list_(pa.int64())), pa.array(last, pa.bool_())],
                                         ["piece", "ends", "last"])


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each piece with its least audit from every entry state."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            roles, faults, ends, last = (row.column(c)[0].as_py() for c in ("roles", "faults", "ends", "last"))
            paths = Paths(_initials(roles), np.array(faults, np.int64), np.array([0, len(roles)]), np.array([ends]), np.array([last]))
            entered = np.flatnonzero(paths.cost[0] < FAR)
            audits, _ = paths.least(entered)
            spelled = dict(zip(entered.tolist(), audits, strict=True))
            costs = [int(c) for c in paths.cost[0]]
            yield pa.RecordBatch.from_arrays([
                *(row.column(c) for c in ("conv_id", "start", "roles", "texts", "faults", "turns")),
                pa.array([[spelled.get(s) for s in range(STATES)]], pa.list_(pa.string())), pa.array([costs], pa.list_(pa.int64()))],
                ["conv_id", "start", "roles", "texts", "faults", "turns", "audits", "costs"])


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of each conversation in order to its result; texts go into the hash and are not kept."""
    def line(now: dict) -> pa.RecordBatch:
        values = [now["conv"], *now["tally"].result(), "".join(now["audit"]), now["hash"].hexdigest()]
        return pa.RecordBatch.from_pylist([dict(zip(["conv_id", *_COUNTS, "audit", "repaired_sha256"], values, strict=True))], schema=pa.schema(list(_ARROW)[:9]))

    now: dict | None = None
    for batch in batches:
        for conv, roles, texts, faults, turns, audits, costs in zip(
                *(batch.column(c).to_pylist() for c in ("conv_id", "roles", "texts", "faults", "turns", "audits", "costs")), strict=True):
            if now is None or now["conv"] != conv:
                if now is not None:
                    yield line(now)
                now = {"conv": conv, "tally": _Tally(), "audit": [], "hash": hashlib.sha256(), "state": 0, "any": False}
                now["tally"].counts["cost"] = costs[0]
            audit = audits[now["state"]]
            now["tally"].add(roles, faults, turns)
            now["audit"].append(audit)
            lines, now["state"] = repaired_lines(audit, now["state"], roles, texts)
            if lines:
                now["hash"].update(("\n" * now["any"] + "\n".join(lines)).encode())
                now["any"] = True
    if now is not None:
        yield line(now)


def repair(rows: DataFrame, limit: int = PIECE) -> DataFrame:
    """Per conversation, after the contract's damage: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = damaged(rows).repartitionByRange(spread, "conv_id", "key").sortWithinPartitions("conv_id", "key")
    cut = stored(ordered.mapInArrow(_pieces(limit), _RESULT + ", " + _PIECE))
    names = ["conv_id", *_COUNTS, "audit", "repaired_sha256"]
    whole = cut.where("piece is null").select(*names)
    pieces = stored(_with_duplicates(cut.where("piece is not null").select("conv_id", "piece", "start", "roles", "texts", "faults", "turns")))
    matrices = pieces.select("conv_id", "piece", "start", "roles", "faults").mapInArrow(
        _matrices, "conv_id bigint, piece bigint, start " + _KEY_TYPE + ", matrix array<bigint>")
    after = (matrices.repartition(spread, "conv_id").sortWithinPartitions("conv_id", F.desc("start"))
             .mapInArrow(_costs_after, "piece bigint, ends array<bigint>, last boolean"))
    ranked = split_join(pieces, stored(after), "piece").mapInArrow(
        _audits, "conv_id bigint, start " + _KEY_TYPE + ", roles array<string>, texts array<string>, faults array<int>, turns array<bigint>, "
                 "audits array<string>, costs array<bigint>")
    chained = ranked.repartition(spread, "conv_id").sortWithinPartitions("conv_id", "start").mapInArrow(_chained, _RESULT)
    return whole.unionByName(chained)
