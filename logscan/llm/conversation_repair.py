"""Least-cost repair of the turns of conversations, as shortest paths over an edit lattice.

A node of a conversation's lattice is (turns done, state of the grammar); an edit leads from
one to the next: K keeps a turn, R gives it the role user or assistant (3), D deletes it (4), I
inserts an empty turn of user or assistant (3). Blank turns and repeats of an earlier turn
must be deleted, and a truncated turn that stays costs 3 more. The roles that are left must
begin with at most one system turn and then alternate, user first, to an assistant's end; nothing
at all is right too. Dijkstra's search expands the node of the least (cost, edits so far) and
stops at the first accepting end; edits are compared as text. A path's edits tell its end node and its
cost, so no two paths are equal, and none of equal cost is the beginning of another: extending never
changes their order.

Turns are dealt by range of (conversation, turn) and written with their positions, so that
a long conversation lies in many tasks. Its lattice is cut into blocks of at most BLOCK
positions. Within a block the search runs from each state that it may be entered in to all
states that it may be left in; the best paths between states are then joined by the same search over
blocks, which is exact as a best path is made of best paths. Most conversations lie within one
block, and many of those are alike, so a task remembers the last it has solved. The edits of a
block go back to its turns by position. What a conversation has in one row is its edits, as is asked of it, and before they are chosen
at most sixteen such paths.
The digest of a repaired conversation streams its turns, sorted, through a task, as one hash over a
text must; it holds no more than a batch.

Turns are in the order of turn (nulls first), then role, then text. A null role or text counts as one
space. Rows without conv_id are one conversation. A role is told by its first letter, s, u or a; a turn of another one, or of an
empty role, cannot be kept. Repeated rows are repeats of a turn. An empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logscan.llm.common import broadcast_if_small, written

#: Positions of a block, as a power of two; turns of a block whose paths a task remembers; costs of edits.
BLOCK_BITS, SHORT = 12, 64
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
#: States of the grammar: nothing yet, after a system turn, after a user's, after an assistant's; the state that each role leads to.
START, SYSTEM, USER, ASSISTANT = range(4)
STEPS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
ACCEPTING = (START, ASSISTANT)
INK = r"[^\x20\x09-\x0D]"


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text, where nulls of role and text are one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role"), text("text"))


def damage(conversations: DataFrame) -> DataFrame:
    """The turns after faults that a hash of conversation and turn chooses: one of 20 each is dropped, emptied, loses its ends of sentences, is repeated, becomes a user's."""
    rows = turns(conversations)
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.encode(F.concat(number("conv_id"), F.lit(":"), number("turn")), "UTF-8")) % 20
    rows = rows.withColumn("_fault", fault).filter("_fault <> 0")
    text = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_fault") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("_fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times)).drop("col")


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def ordered(rows: DataFrame) -> DataFrame:
    """Turns with pos, which ascends in the order of a conversation's turns, block, fault and initial; written."""
    key = ["conv_id", F.col("turn").asc_nulls_first(), "role"]
    dealt = rows.repartitionByRange(*key, F.substring("text", 1, 32)).sortWithinPartitions(*key, "text")
    dealt = dealt.withColumn("pos", F.monotonically_increasing_id())
    ink = F.regexp_extract("text", rf"({INK})[\x20\x09-\x0D]*\z", 1)
    fault = F.when(ink == "", "blank").when(~ink.isin(".", "!", "?"), "truncated")
    first = F.substring("role", 1, 1)
    digest = F.md5(F.encode(F.concat(F.octet_length(F.encode("role", "UTF-8")).cast("string"), F.lit(":"), "role", "text"), "UTF-8"))
    return written(dealt.select("*", F.shiftright("pos", BLOCK_BITS).alias("block"), fault.alias("fault"), F.when(first.isin("s", "u", "a"), first).otherwise("o").alias("initial"), digest.alias("digest")))


def with_repeats(rows: DataFrame) -> DataFrame:
    """conv_id, turn, pos, block, fault, initial: where a role and text stood before in the conversation, fault is duplicate."""
    narrow = rows.drop("role", "text")
    said = narrow.filter("fault is null or fault <> 'blank'").groupBy(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest")).agg(F.min("pos").alias("_first"), F.count(F.lit(1)).alias("_n"))
    twice = written(said.filter("_n > 1").drop("_n"))
    both = narrow.join(broadcast_if_small(twice), _same("conv_id", "_conv") & (F.col("digest") == F.col("_digest")), "left")
    again = (F.col("pos") > F.col("_first")) & ~F.coalesce(F.col("fault") == "blank", F.lit(False))
    return both.select("conv_id", "turn", "pos", "block", F.when(again, "duplicate").otherwise(F.col("fault")).alias("fault"), "initial")


def _edits(code: str, state: int) -> list[tuple[str, int, int, str]]:
    """(letter, state after, cost, what becomes of the turn) of a turn: x must go; s, u, a and o are roles, in capitals if truncated. What becomes: '' gone, K kept, U or A given that role."""
    out = [("D", state, DELETE, "")]
    if code != "x":
        more = TRUNCATED if code.isupper() else 0
        for role, after in STEPS[state].items():
            if code.lower() == role:
                out.append(("K", after, more, "K"))
            if role != "s":
                out.append(("R", after, REROLE + more, role.upper()))
    return out


class Path:
    """A way from the start to a node: its last edge and the path before that. A path further back (jump) makes finding where two paths part logarithmic."""

    __slots__ = ("audit", "before", "cost", "depth", "jump", "node", "roles")

    def __init__(self, node: tuple[int, int], cost: int = 0, audit: str = "", roles: str = "", before: Path | None = None):
        self.node, self.cost, self.audit, self.roles, self.before = node, cost, audit, roles, before
        if before is None:
            self.depth, self.jump = 0, self
        else:
            self.depth, far = before.depth + 1, before.jump
            self.jump = far.jump if before.depth - far.depth == far.depth - far.jump.depth else before

    def back_to(self, depth: int) -> Path:
        path = self
        while path.depth > depth:
            path = path.jump if path.jump.depth >= depth else path.before
        return path

    def edges(self) -> list[Path]:
        out, path = [], self
        while path.before is not None:
            out.append(path)
            path = path.before
        return out[::-1]

    def __lt__(self, other: Path) -> bool:
        """By cost, then by the edits from where the paths part."""
        if self.cost != other.cost:
            return self.cost < other.cost
        depth = min(self.depth, other.depth)
        a, b = self.back_to(depth), other.back_to(depth)
        while a is not b:
            a, b = (a.jump, b.jump) if a.jump is not b.jump else (a.before, b.before)
        at, mine, theirs = a.depth, "", ""
        while True:
            at += 1
            mine += self.back_to(at).audit if at <= self.depth else ""
            theirs += other.back_to(at).audit if at <= other.depth else ""
            both = min(len(mine), len(theirs))
            if mine[:both] != theirs[:both]:
                return mine < theirs
            if at >= self.depth and at >= other.depth:
                return len(mine) < len(theirs)
            mine, theirs = mine[both:], theirs[both:]


def search(end: int, entry: int, edges: Callable[[int, int], Iterable[tuple[int, int, int, str, str]]], first: bool) -> dict[int, Path]:
    """Best paths from (0, entry) to the states of end: to the first accepting one alone, or to all. edges gives (turn, state, cost, edits, roles) from a node."""
    heap, done, out = [Path((0, entry))], set(), {}
    while heap:
        path = heapq.heappop(heap)
        if path.node in done:
            continue
        done.add(path.node)
        i, state = path.node
        if i == end and (not first or state in ACCEPTING):
            out[state] = path
            if first or len(out) == len(STEPS):
                break
        for j, after, cost, audit, roles in edges(i, state):
            if (j, after) not in done:
                heapq.heappush(heap, Path((j, after), path.cost + cost, audit, roles, path))
    return out


def _block_paths(codes: str, entry: int, first: bool) -> dict[int, tuple[int, str, str]]:
    def edges(i: int, state: int):
        if i < len(codes):
            for letter, after, cost, role in _edits(codes[i], state):
                yield i + 1, after, cost, letter, role or "-"
        for role, after in STEPS[state].items():
            if role != "s":
                yield i, after, INSERT, "I", role

    found = {}
    for state, path in search(len(codes), entry, edges, first).items():
        steps = path.edges()
        found[state] = (path.cost, "".join(e.audit for e in steps), "".join(e.roles for e in steps))
    return found


_short_paths = lru_cache(maxsize=20_000)(_block_paths)


def paths(codes: str, entry: int, first: bool) -> dict[int, tuple[int, str, str]]:
    """(cost, edits, roles) of the best paths over a block's turns from a state: to each state, or, with first, to the accepting one that is popped first.

    roles has a letter for each edit: what becomes of the turn, or u or a for the one inserted.
    """
    return (_short_paths if len(codes) <= SHORT else _block_paths)(codes, entry, first)


def joined(blocks: list[dict[int, dict[int, tuple[int, str, str]]]]) -> tuple[int, list[tuple[str, str]]]:
    """The cost of a conversation and the (edits, roles) of each block, from the paths of its blocks by state of entry: the same search, with the paths as edges."""

    def edges(i: int, state: int):
        if i < len(blocks):
            for after, (cost, audit, roles) in blocks[i].get(state, {}).items():
                yield i + 1, after, cost, audit, roles

    (path,) = search(len(blocks), START, edges, True).values()
    return path.cost, [(e.audit, e.roles) for e in path.edges()]


def marks(audit: str, roles: str) -> list[str]:
    """For each turn what its block puts there: roles of turns inserted before (u, a), what becomes of it (K, U, A, or - if gone), and, at the last one, roles inserted after it."""
    out, open_ = [], ""
    for letter, role in zip(audit, roles, strict=True):
        open_ += role
        if letter != "I":
            out.append(open_)
            open_ = ""
    if open_ and out:
        out[-1] += open_
    return out


_PATH = "struct<entry:int,after:int,cost:bigint,audit:string,roles:string>"


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The paths of blocks (conv_id, block, from_pos, codes, first, last)."""
    kind = pa.list_(pa.struct([("entry", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()), ("audit", pa.string()), ("roles", pa.string())]))
    for batch in batches:
        get = dict(zip(batch.schema.names, batch.columns, strict=True))
        found = []
        for codes, first, last in zip(*(get[n].to_pylist() for n in ("codes", "first", "last")), strict=True):
            entries = [START] if first else range(len(STEPS))
            found.append([{"entry": e, "after": a, "cost": c, "audit": x, "roles": r} for e in entries for a, (c, x, r) in paths(codes, e, first and last).items()])
        yield pa.RecordBatch.from_arrays([*(get[n] for n in ("conv_id", "block", "from_pos", "first", "last")), pa.array(found, kind)], names=["conv_id", "block", "from_pos", "first", "last", "paths"])


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """cost, audit and, by block, from_pos and marks of conversations (conv_id, blocks)."""
    kind = pa.list_(pa.struct([("from_pos", pa.int64()), ("marks", pa.list_(pa.string()))]))
    for batch in batches:
        costs, audits, turns_ = [], [], []
        for blocks in batch.column(1).to_pylist():
            by_entry = []
            for b in blocks:
                table: dict[int, dict[int, tuple[int, str, str]]] = {}
                for p in b["paths"]:
                    table.setdefault(p["entry"], {})[p["after"]] = (p["cost"], p["audit"], p["roles"])
                by_entry.append(table)
            cost, pieces = joined(by_entry)
            costs.append(cost)
            audits.append("".join(a for a, _ in pieces))
            turns_.append([{"from_pos": b["from_pos"], "marks": marks(a, r)} for b, (a, r) in zip(blocks, pieces, strict=True)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(costs, pa.int64()), pa.array(audits, pa.string()), pa.array(turns_, kind)], names=["conv_id", "cost", "audit", "blocks"])


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of turns (conv_id, turn, role, text) the conversations (conv_id, blank, duplicate, truncated, illegal, gaps, cost, audit) and the repaired turns (conv_id, pos, nth, role, text), in the order of pos and nth."""
    at = ordered(rows)
    told = written(with_repeats(at))
    code = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial"))
    # the turns of a block, in order: at most as many as a block has positions
    lists = told.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(F.struct("pos", code.alias("code"), "initial"))).alias("t"), *[F.count(F.when(F.col("fault") == f, 1)).alias(f) for f in ("blank", "duplicate", "truncated")])
    each = F.array_join(F.transform("t", lambda x: x["initial"]), "")
    pairs = F.transform(F.sequence(F.lit(1), F.length(each)), lambda i: F.substring(each, i, F.lit(2)))
    wrong = F.size(F.filter(pairs, lambda p: (F.length(p) == 2) & ~p.isin("su", "ua", "au")))
    blocks = lists.select("conv_id", "block", F.col("t")[0]["pos"].alias("from_pos"), F.array_join(F.transform("t", lambda x: x["code"]), "").alias("codes"), "blank", "duplicate", "truncated", wrong.alias("wrong"), F.substring(each, 1, 1).alias("begin"), F.substring(each, -1, 1).alias("end"))
    blocks = written(blocks)
    # a row for each block from here on
    known = blocks.groupBy("conv_id").agg(
        *[F.sum(f).cast("long").alias(f) for f in ("blank", "duplicate", "truncated", "wrong")],
        F.min("block").alias("first"), F.max("block").alias("last"), F.array_sort(F.collect_list(F.struct("block", "begin", "end"))).alias("b"),
    )
    seams = F.size(F.filter(F.transform("b", lambda x, i: F.when(i > 0, F.concat(F.get(F.col("b"), i - 1)["end"], x["begin"]))), lambda p: p.isNotNull() & ~p.isin("su", "ua", "au")))
    known = known.select(F.col("conv_id").alias("_conv"), "blank", "duplicate", "truncated", (F.col("wrong") + seams).cast("long").alias("illegal"), "first", "last")
    asked = blocks.select("conv_id", "block", "from_pos", "codes").join(known.select("_conv", "first", "last"), _same("conv_id", "_conv"))
    asked = asked.select("conv_id", "block", "from_pos", "codes", (F.col("block") == F.col("first")).alias("first"), (F.col("block") == F.col("last")).alias("last"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    solved = asked.mapInArrow(_solved, f"conv_id {kind}, block long, from_pos long, first boolean, last boolean, paths array<{_PATH}>")
    gathered = solved.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", "from_pos", "paths"))).alias("blocks"))
    chosen = written(gathered.mapInArrow(_chosen, f"conv_id {kind}, cost long, audit string, blocks array<struct<from_pos:bigint,marks:array<string>>>"))
    span = told.select("conv_id", "turn").distinct().groupBy(F.col("conv_id").alias("_of")).agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    summary = chosen.drop("blocks").join(known.drop("first", "last"), _same("conv_id", "_conv")).join(span, _same("conv_id", "_of"))
    summary = summary.select("conv_id", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    mark = chosen.select(F.explode("blocks").alias("b")).select(F.col("b.from_pos").alias("_from"), F.posexplode("b.marks").alias("_i", "mark")).select((F.col("_from") + F.col("_i")).alias("pos"), "mark")
    name = F.when(F.col("m") == "K", F.col("role")).otherwise(F.when(F.lower("m") == "u", "user").otherwise("assistant"))
    left = at.select("conv_id", "pos", "role", "text").join(mark, "pos").select("conv_id", "pos", "role", "text", F.posexplode(F.split("mark", "")).alias("nth", "m")).filter("m <> '-' and m <> ''")
    turns_ = left.select("conv_id", "pos", "nth", name.alias("role"), F.when(F.col("m").isin("K", "U", "A"), F.col("text")).otherwise("").alias("text"))
    return summary, turns_


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of repaired turns: of their `role:text`, joined by line feeds."""
    kind = repaired.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hashed = None, None
        schema = None
        for batch in batches:
            schema = pa.schema([batch.schema.field(0), ("repaired_sha256", pa.string())])
            ids, sums = [], []
            for conv, line in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if hashed is None or conv != now:
                    if hashed is not None:
                        ids.append(now)
                        sums.append(hashed.hexdigest())
                    now, hashed = conv, hashlib.sha256()
                else:
                    hashed.update(b"\n")
                hashed.update(line.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array(ids, schema.field(0).type), pa.array(sums, pa.string())], schema=schema)
        if hashed is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], schema.field(0).type), pa.array([hashed.hexdigest()])], schema=schema)

    lines = repaired.select("conv_id", "pos", "nth", F.concat("role", F.lit(":"), "text").alias("line"))
    dealt = lines.repartition("conv_id").sortWithinPartitions("conv_id", "pos", "nth").select("conv_id", "line")
    return dealt.mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")
