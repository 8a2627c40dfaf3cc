"""Repair of a conversation's structure: the cheapest edits that make its roles
alternate, by iterative-deepening A*."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callwatch.llm.words import SPACE
from callwatch.runtime import dealt, map_arrow, written

#: Rows and bytes of text in a block of a long or divided conversation.
BLOCK_ROWS, BLOCK_BYTES = 512, 4_000_000
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
NEVER = 1 << 60

#: States of ``(s?(ua)+)?``: nothing yet, after s, after u, after a.
NEXT = (2, 2, 3, 2)
ROLES = ("user", "user", "assistant", "user")
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: Cost of the insertions that end a conversation in each state.
ENDING = (0, 2 * INSERT, INSERT, 0)
LEGAL = {"su", "ua", "au"}

#: (initial, truncated, 0) of a row that may stay; ("", False, n) of n rows that must go.
Unit = tuple[str, bool, int]


def cheapest(units: list[Unit], start: int, ending: tuple[int, ...] | list[int]) -> tuple[int, str] | None:
    """Cost and edits (D, I, K, R) of the cheapest way from state ``start`` through
    all units, ties to the ASCII-least; None where there is none. ``ending``
    gives what each last state costs: ``ENDING``, or 0 for one and ``NEVER`` for
    the others.

    Iterative-deepening A*: a depth-first search takes edits in ASCII order
    within a bound, which rises to the least cost that may still do. ``low`` is
    the table of transpositions: what a place and state are known to cost at
    least, first by the heuristic (each row's own least cost), then by searches
    that failed. So the first path that ends is the answer.
    """
    n = len(units)
    rest = [0] * (n + 1)
    starts = [False] * (n + 1)
    for i in range(n - 1, -1, -1):
        initial, truncated, gone = units[i]
        rest[i] = rest[i + 1] + (DELETE * gone if gone else min(DELETE, TRUNCATED) if truncated else 0)
        starts[i] = starts[i + 1] or (not gone and initial == "s")
    free = ending == ENDING
    most = max((q for q in range(4) if ending[q] < NEVER), default=0)

    def reachable(i: int, q: int) -> bool:
        if i == n:
            return ending[q] < NEVER
        return free or most >= 2 or q == most or (most == 1 and q == 0 and starts[i])

    low = [[rest[i] if reachable(i, q) else NEVER for q in range(4)] for i in range(n)] + [list(ending)]

    def moves(i: int, q: int) -> list[tuple[str, int, int, int]]:
        initial, truncated, gone = units[i]
        if gone:
            return [("D" * gone, DELETE * gone, i + 1, q), ("I", INSERT, i, NEXT[q])]
        extra = TRUNCATED if truncated else 0
        found = [("D", DELETE, i + 1, q), ("I", INSERT, i, NEXT[q])]
        if (kept := KEPT.get((q, initial))) is not None:
            found.append(("K", extra, i + 1, kept))
        found.append(("R", REROLE + extra, i + 1, NEXT[q]))
        return found

    while (bound := low[0][start]) < NEVER:
        # a frame: place, state, budget, its moves, the next of them
        stack = [[0, start, bound, None, 0]]
        path: list[str] = []
        while stack:
            frame = stack[-1]
            i, q, budget = frame[0], frame[1], frame[2]
            if i == n:
                return bound, "".join(path) + "I" * (ending[q] // INSERT)
            if frame[3] is None:
                frame[3] = moves(i, q)
            for k in range(frame[4], len(frame[3])):
                letter, cost, j, p = frame[3][k]
                if cost + low[j][p] <= budget:
                    frame[4] = k + 1
                    path.append(letter)
                    stack.append([j, p, budget - cost, None, 0])
                    break
            else:
                low[i][q] = max(low[i][q], min(c + low[j][p] for _, c, j, p in frame[3]))
                stack.pop()
                if path:
                    path.pop()
    return None


def apply_edits(edits: str, start: int, rows: Iterable[tuple[str, str]]) -> list[str]:
    """The lines ``role:text`` that edits make of rows, from a state on."""
    given, state, lines = iter(rows), start, []
    for letter in edits:
        if letter == "I":
            lines.append(f"{ROLES[state]}:")
            state = NEXT[state]
            continue
        role, text = next(given)
        if letter == "K":
            lines.append(f"{role}:{text}")
            state = KEPT[(state, role[:1])]
        elif letter == "R":
            lines.append(f"{ROLES[state]}:{text}")
            state = NEXT[state]
    return lines


def units_of(rows: Iterable[tuple[str, bool, bool, bool, int]]) -> tuple[list[Unit], int, int, int, int]:
    """Units of rows (role initial, blank, first of its kind, truncated, how many
    equal rows) and their counts of blank, duplicate, truncated and illegal."""
    units: list[Unit] = []
    blanks = repeats = cut = illegal = 0
    last = None
    for initial, blank, first, truncated, n in rows:
        illegal += n - 1 + (last is not None and last + initial not in LEGAL)
        last = initial
        gone = n if blank or not first else n - 1
        if blank:
            blanks += n
        else:
            repeats += gone
        if gone < n:
            cut += truncated
            units.append((initial, truncated, 0))
        if gone:
            if units and units[-1][2]:
                gone += units.pop()[2]
            units.append(("", False, gone))
    return units, blanks, repeats, cut, illegal


#: A stretch of a conversation: cost from each state to each (16 values), and the
#: rank of its edits among those from the same state.
Node = tuple[list[int], list[int]]


def node_of(units: list[Unit]) -> tuple[Node, list[str | None]]:
    """The node of a block and its edits. No insertion follows the last row (it
    belongs before the next), so no edits from a state begin others."""
    found = [cheapest(units, s, [0 if q == t else NEVER for q in range(4)]) for s in range(4) for t in range(4)]
    edits = [f[1] if f else None for f in found]
    ranks = [sum(e is not None and edits[i] is not None and e < edits[i] for e in edits[i - i % 4 : i - i % 4 + 4]) for i in range(16)]
    return ([f[0] if f else NEVER for f in found], ranks), edits


def way_through(nodes: list[Node], start: int, ending: tuple[int, ...] | list[int]) -> tuple[int, list[int]] | None:
    """Cost and the state before each node and after the last, of the cheapest
    way, ties to the ASCII-least edits."""
    after = list(ending)
    costs = [after]
    for cost, _ in reversed(nodes):
        after = [min(min(cost[4 * s + t] + after[t] for t in range(4)), NEVER) for s in range(4)]
        costs.append(after)
    costs.reverse()
    if costs[0][start] >= NEVER:
        return None
    states = [start]
    for k, (cost, rank) in enumerate(nodes):
        s = states[-1]
        states.append(min((t for t in range(4) if cost[4 * s + t] + costs[k + 1][t] == costs[k][s]), key=lambda t: rank[4 * s + t]))
    return costs[0][start], states


def joined(nodes: list[Node]) -> Node:
    """The node of several stretches in a row."""
    costs, ranks = [], []
    for s in range(4):
        ways = [way_through(nodes, s, [0 if q == t else NEVER for q in range(4)]) for t in range(4)]
        paths = [[nodes[k][1][4 * a + b] for k, (a, b) in enumerate(zip(w[1], w[1][1:], strict=False))] if w else None for w in ways]
        costs += [w[0] if w else NEVER for w in ways]
        ranks += [sum(p is not None and mine is not None and p < mine for p in paths) for mine in paths]
    return costs, ranks


RESULT = "blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
STREAMED = f"conv_id long, {RESULT}, part int, block int, pos int, role string, text string, hollow boolean, ragged boolean, n long"
_NAMES = [c.split()[0] for c in STREAMED.split(", ")]
_TYPES = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
_FIELDS = pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in STREAMED.split(", ")])


def _streamed(batches: Iterator[pa.RecordBatch], block_rows: int) -> Iterator[pa.RecordBatch]:
    """Whole conversations of a sorted partition are repaired as they pass. The
    partition's first and last, which may go on in others, and those of more
    than one block are handed on as numbered rows."""
    part = TaskContext.get().partitionId()
    out: list[dict] = []
    rows: list[tuple] = []
    key, size, block, first = (), 0, 0, True

    def hand_on() -> None:
        nonlocal block, rows, size
        out.extend({"conv_id": key[0], "part": part, "block": block, "pos": i, "role": r[0], "text": r[1], "hollow": r[2], "ragged": r[3], "n": r[4]} for i, r in enumerate(rows))
        block, rows, size = block + 1, [], 0

    def finish(whole: bool) -> None:
        nonlocal rows, size
        if not rows:
            return
        if not whole:
            hand_on()
            return
        seen: set[tuple[str, str]] = set()
        facts = []
        for role, text, hollow, ragged, n in rows:
            facts.append((role[:1], hollow, (role, text) not in seen, ragged, n))
            seen.add((role, text))
        units, blanks, repeats, cut, illegal = units_of(facts)
        cost, edits = cheapest(units, 0, ENDING)
        lines = apply_edits(edits, 0, ((r[0], r[1]) for r in rows for _ in range(r[4])))
        out.append({"conv_id": key[0], "blank": blanks, "duplicate": repeats, "truncated": cut, "illegal": illegal, "cost": cost, "audit": edits, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()})
        rows, size = [], 0

    divided = False
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "hollow", "ragged", "n")]
        for conv, *row in zip(*columns, strict=True):
            if (conv,) != key:
                finish(whole=not first and not divided)
                first, divided, key = key == (), False, (conv,)
            elif len(rows) >= block_rows or size >= BLOCK_BYTES:
                divided = True
                hand_on()
            rows.append(tuple(row))
            size += len(row[1])
        if len(out) >= 1000:
            yield pa.RecordBatch.from_pylist(out, schema=_FIELDS)
            out = []
    if key:
        finish(whole=False)
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=_FIELDS)


BLOCKS = "conv_id long, part int, block int, cost array<long>, rank array<long>, edits array<string>, blank long, duplicate long, truncated long, illegal long, first string, last string"
WAYS = "part int, block int, entry int, exit int, tail int"


def _solved_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for b in batch.to_pylist():
            facts = sorted(b["rows"], key=lambda r: r["pos"])
            firsts = set(b["firsts"])
            units, blanks, repeats, cut, illegal = units_of((r["initial"], r["hollow"], r["pos"] in firsts, r["ragged"], r["n"]) for r in facts)
            (cost, rank), edits = node_of(units)
            out.append({"conv_id": b["conv_id"], "part": b["part"], "block": b["block"], "cost": cost, "rank": rank, "edits": edits, "blank": blanks, "duplicate": repeats, "truncated": cut, "illegal": illegal, "first": facts[0]["initial"], "last": facts[-1]["initial"]})
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("block", pa.int32()), ("cost", pa.list_(pa.int64())), ("rank", pa.list_(pa.int64())), ("edits", pa.list_(pa.string())), *[(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")], ("first", pa.string()), ("last", pa.string())]))


def _gathered(nodes: list[dict]) -> dict:
    """One node of a group's nodes, in their order; counts are summed, and roles
    that clash where two meet are added."""
    cost, rank = joined([(x["cost"], x["rank"]) for x in nodes])
    clash = sum(a["last"] + b["first"] not in LEGAL for a, b in zip(nodes, nodes[1:], strict=False))
    counts = {c: sum(x[c] for x in nodes) for c in ("blank", "duplicate", "truncated", "illegal")}
    return counts | {"illegal": counts["illegal"] + clash, "cost": cost, "rank": rank, "first": nodes[0]["first"], "last": nodes[-1]["last"]}


def _long_conversations(rows: DataFrame) -> DataFrame:
    """Results of conversations handed on in blocks. A block is solved from every
    state to every state; blocks of one partition, then the partitions of one
    conversation, are joined to nodes, and the cheapest way is followed back
    down. So a task holds a block, a partition's blocks as 32 numbers each, or
    as much for each partition; only the digest, which is sequential, streams a
    whole conversation through one task."""
    firsts = rows.groupBy("conv_id", "role", "text").agg(F.min(F.struct("part", "block", "pos")).alias("f")).select("f.*", F.lit(True).alias("first"))
    narrow = rows.select("part", "block", "pos", F.lit(False).alias("first"), "conv_id", F.substring("role", 1, 1).alias("initial"), "hollow", "ragged", "n")
    both = narrow.unionByName(firsts, allowMissingColumns=True)
    facts = F.struct("pos", "initial", "hollow", "ragged", "n")
    grouped = both.groupBy("part", "block").agg(F.max("conv_id").alias("conv_id"), F.collect_list(F.when(~F.col("first"), facts)).alias("rows"), F.collect_list(F.when(F.col("first"), F.col("pos"))).alias("firsts"))
    blocks = written(map_arrow(dealt(grouped, "part", "block"), _solved_blocks, BLOCKS))

    node = "struct<cost:array<long>,rank:array<long>,blank:long,duplicate:long,truncated:long,illegal:long,first:string,last:string>"
    state = F.struct("cost", "rank", "blank", "duplicate", "truncated", "illegal", "first", "last").cast(node)
    pieces = blocks.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("block", state.alias("node")))).alias("blocks"))
    arrow_node = pa.struct([("cost", pa.list_(pa.int64())), ("rank", pa.list_(pa.int64())), *[(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")], ("first", pa.string()), ("last", pa.string())])

    def piece_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [{"conv_id": p["conv_id"], "part": p["part"], "head": p["blocks"][0]["block"], "node": _gathered([b["node"] for b in p["blocks"]])} for p in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("head", pa.int32()), ("node", arrow_node)]))

    heads = map_arrow(pieces, piece_nodes, f"conv_id long, part int, head int, node {node}")
    whole = heads.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "head", "node"))).alias("pieces"))

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for c in batch.to_pylist():
                nodes = [p["node"] for p in c["pieces"]]
                cost, states = way_through([(x["cost"], x["rank"]) for x in nodes], 0, ENDING)
                facts = _gathered(nodes)
                for k, p in enumerate(c["pieces"]):
                    final = k == len(nodes) - 1
                    out.append({"conv_id": c["conv_id"], "part": p["part"], "head": p["head"], "entry": states[k], "exit": states[k + 1], "tail": ENDING[states[-1]] // INSERT if final else 0, "total": cost if k == 0 else None, **({f: facts[f] for f in ("blank", "duplicate", "truncated", "illegal")} if k == 0 else {})})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("conv_id", pa.int64()), *[(c, pa.int32()) for c in ("part", "head", "entry", "exit", "tail")], *[(c, pa.int64()) for c in ("total", "blank", "duplicate", "truncated", "illegal")]]))

    through = written(map_arrow(whole, solved, "conv_id long, part int, head int, entry int, exit int, tail int, total long, blank long, duplicate long, truncated long, illegal long"))

    def followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for p in batch.to_pylist():
                nodes = [(b["node"]["cost"], b["node"]["rank"]) for b in p["blocks"]]
                _, states = way_through(nodes, p["entry"], [0 if q == p["exit"] else NEVER for q in range(4)])
                out += [{"part": p["part"], "block": b["block"], "entry": states[k], "exit": states[k + 1], "tail": p["tail"] if k == len(nodes) - 1 else 0} for k, b in enumerate(p["blocks"])]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([(c, pa.int32()) for c in ("part", "block", "entry", "exit", "tail")]))

    entered = pieces.select(F.col("part").alias("p"), F.col("blocks")[0]["block"].alias("h"), "blocks").join(through.select("part", "head", "entry", "exit", "tail"), (F.col("p") == F.col("part")) & (F.col("h") == F.col("head")))
    ways = map_arrow(entered.select("part", "blocks", "entry", "exit", "tail"), followed, WAYS)
    chosen = ways.join(blocks.select("part", "block", "edits"), ["part", "block"]).select("part", "block", "entry", F.concat(F.element_at("edits", 4 * F.col("entry") + F.col("exit") + 1), F.repeat(F.lit("I"), F.col("tail"))).alias("edits"))
    texts = rows.groupBy("part", "block").agg(F.max("conv_id").alias("conv_id"), F.sort_array(F.collect_list(F.struct("pos", "role", "text", "n"))).alias("rows"))

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                made = apply_edits(b["edits"], b["entry"], ((r["role"], r["text"]) for r in b["rows"] for _ in range(r["n"])))
                yield pa.RecordBatch.from_pylist([{"conv_id": b["conv_id"], "part": b["part"], "block": b["block"], "edits": b["edits"], "made": "\n".join(made) if made else None}], schema=pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("block", pa.int32()), ("edits", pa.string()), ("made", pa.string())]))

    repaired = map_arrow(texts.join(chosen, ["part", "block"]), lines, "conv_id long, part int, block int, edits string, made string")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, audit, begun = None, None, [], False
        result = lambda: pa.RecordBatch.from_pylist([{"conv_id": key[0], "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}], schema=pa.schema([("conv_id", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())]))
        for batch in batches:
            for b in batch.to_pylist():
                if (b["conv_id"],) != key:
                    if key is not None:
                        yield result()
                    key, digest, audit, begun = (b["conv_id"],), hashlib.sha256(), [], False
                audit.append(b["edits"])
                if b["made"] is not None:
                    digest.update((("\n" if begun else "") + b["made"]).encode())
                    begun = True
        if key is not None:
            yield result()

    hashed = map_arrow(dealt(repaired, "conv_id").sortWithinPartitions("conv_id", "part", "block"), digests, "conv_id long, audit string, repaired_sha256 string")
    facts = through.filter(F.col("total").isNotNull()).select(F.col("conv_id").alias("c"), F.col("total").alias("cost"), "blank", "duplicate", "truncated", "illegal")
    return hashed.join(facts, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", *[c.split()[0] for c in RESULT.split(", ")])


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) after the trial damage that crc32 of
    ``conv_id:turn`` decides: by its remainder by 20, 0 drops the row, 1 empties
    its text, 2 takes the marks ``.!?`` out of it, 3 says it twice, 4 makes it
    the user's. Null counts as one space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), said("role").alias("role"), said("text").alias("text"), lot.alias("lot"))
    text = F.when(F.col("lot") == 1, "").when(F.col("lot") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("lot") == 4, "user").otherwise(F.col("role"))
    return rows.filter("lot <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("lot") == 3, 2).otherwise(1).cast("long").alias("copies"))


def _faults() -> tuple[Column, Column]:
    """Whether ``text`` is blank, and whether it lacks a mark at its end."""
    end = F.regexp_extract("text", rf"(?s)([^\x20\x09-\x0D]){SPACE}*+\z", 1)
    return ~F.col("text").rlike(r"[^\x20\x09-\x0D]"), ~end.isin(".", "!", "?")


def repair(rows: DataFrame, ids: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """For each ``conv_id`` of ``ids`` the cheapest repair of its ``rows`` (conv_id,
    turn, role, text, copies): gaps between its turns, counts of blank, duplicate
    and truncated rows (a row's first fault counts) and of illegal neighbours,
    cost, audit (the edits' initials) and the digest of the repaired lines.

    Rows go by turn (nulls first), then role, then text; equal rows are counted
    before they are sorted, so that many copies are one row. Conversations are
    ranged over partitions by all of these, and one that spans partitions or
    more than ``block_rows`` rows is solved in blocks, so none meets in one
    task. A null conv_id is a conversation of its own; one without rows has
    zeros, no audit and the digest of nothing.
    """
    hollow, ragged = _faults()
    counted = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("n"))
    shown = counted.select("conv_id", "turn", "role", "text", hollow.alias("hollow"), ragged.alias("ragged"), "n")
    ranged = shown.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 32)).sortWithinPartitions("conv_id", "turn", "role", "text")
    passed = written(map_arrow(ranged.drop("turn"), lambda b: _streamed(b, block_rows), STREAMED))
    results = [c.split()[0] for c in RESULT.split(", ")]
    done = passed.filter(F.col("part").isNull()).select("conv_id", *results)
    long = _long_conversations(passed.filter(F.col("part").isNotNull()).select("conv_id", "part", "block", "pos", "role", "text", "hollow", "ragged", "n"))
    turns = rows.groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    given = ids.select(F.col("conv_id").cast("long").alias("conv_id"))
    parts = given.unionByName(turns, allowMissingColumns=True).unionByName(done, allowMissingColumns=True).unionByName(long, allowMissingColumns=True)
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    one = parts.groupBy("conv_id").agg(*[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in numbers], F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
    return one.select("conv_id", *numbers, "audit", "repaired_sha256")


def repaired_conversations(conversations: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``repair`` of damaged conversations, one row for each original conv_id. Other
    columns are not read; an empty table gives no rows."""
    return repair(damaged(conversations), conversations.select("conv_id"), block_rows)
