"""Conversation structure repair by a Viterbi search over four grammar states.

A conversation is sound if its roles' initials read ``(s?(ua)+)?``. Rows are
brought into order by a range sort, so that one conversation may spread over many
tasks, and cut into pieces of at most ``PIECE`` rows. For each state in which a
piece may be entered, a forward search over the states nothing yet, after system,
after user, after assistant carries the minimum (cost, audit string) and closes
every row's layer with at most two inserts. A piece thus becomes a 4 x 4 table;
the tables of a conversation are chained in order, and the path of least cost is
traced back through them. Of two audits of equal cost and place neither begins
with the other (it would hold more inserts and cost more), so the least whole
string comes of the least beginnings.

Only a digest of a whole conversation brings its rows back into one task, since a
hash reads its bytes in order; they are streamed, a batch at a time.

Null roles and texts are read as one space, and null ids and turns are written so
in the damage's key; null turns come first; rows of one turn are taken by role and
then the MD5 of their text, so order and result do not depend on files. Repeated
rows are duplicates. A null id is a conversation of its own. Roles are known by
their first character. Other columns are passed over; an empty table gives an
empty result. Texts are never cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexquarry.llm.common import WHITESPACE, discard, map_arrow, materialize

#: Rows of a piece: 2 to this power.
PIECE_BITS = 9

#: What each edit costs, and what a truncated row costs that is not deleted.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

#: States: nothing yet, after system, after user, after assistant. What the grammar goes on with in each, and the state after it.
NEXT = ((2, "user"), (2, "user"), (3, "assistant"), (2, "user"))
ACCEPTED = (0, 3)
_KEPT = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
_SOUND = {"su", "ua", "au"}

Layer = list[tuple[int, str] | None]


# The search ------------------------------------------------------------------


def offer(layer: Layer, state: int, cost: int, audit: str) -> None:
    if layer[state] is None or (cost, audit) < layer[state]:
        layer[state] = (cost, audit)


def close(layer: Layer) -> Layer:
    """A layer with up to two inserts after each of its paths; more would come back to where one was."""
    for _ in range(2):
        for state, best in enumerate(list(layer)):
            if best is not None:
                offer(layer, NEXT[state][0], best[0] + INSERT, best[1] + "I")
    return layer


def advance(layer: Layer, symbol: str) -> Layer:
    """The layer after one more row. Symbol: ``-`` for a row that has to go, else its role's initial, in capitals if truncated."""
    out: Layer = [None] * 4
    extra = TRUNCATED if symbol.isupper() else 0
    for state, best in enumerate(layer):
        if best is None:
            continue
        cost, audit = best
        offer(out, state, cost + DELETE, audit + "D")
        if symbol != "-":
            kept = _KEPT.get((symbol.lower(), state))
            if kept is not None:
                offer(out, kept, cost + extra, audit + "K")
            offer(out, NEXT[state][0], cost + REROLE + extra, audit + "R")
    return close(out)


@lru_cache(maxsize=20_000)
def piece_table(symbols: str) -> tuple[tuple[tuple[int, str] | None, ...], ...]:
    """For each state at a piece's begin: cost and audit of the best way to each state at its end."""
    rows = []
    for entry in range(4):
        layer: Layer = [None] * 4
        layer[entry] = (0, "")
        for symbol in symbols:
            layer = advance(layer, symbol)
        rows.append(tuple(layer))
    return tuple(rows)


def start() -> Layer:
    return close([(0, ""), None, None, None])


def chained(tables: Iterator) -> tuple[list[tuple[int, int]], str]:
    """Of a conversation's pieces: the states at which the best path enters and leaves each, and its inserts before the first row.

    A table holds, at 4 * entry + exit, a cost (null: no way) and an audit.
    """
    layer, back = start(), []
    leads = [x and x[1] for x in layer]
    for costs, audits in tables:
        after: Layer = [None] * 4
        came = [0] * 4
        for x in range(4):
            for y in range(4):
                if layer[x] is not None and costs[4 * x + y] is not None:
                    way = (layer[x][0] + costs[4 * x + y], layer[x][1] + audits[4 * x + y])
                    if after[y] is None or way < after[y]:
                        after[y], came[y] = way, x
        layer = after
        back.append(came)
    state = min((s for s in ACCEPTED if layer[s] is not None), key=lambda s: layer[s])
    path = []
    for came in reversed(back):
        path.append((came[state], state))
        state = came[state]
    return path[::-1], leads[state]


# Tables ----------------------------------------------------------------------


def _blank(text: Column) -> Column:
    return F.translate(text, WHITESPACE, "") == ""


def damaged(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` with the damage that each row's checksum calls for; a repeated row comes twice."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    said = F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    left = rows.select("conv_id", F.col("turn").try_cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(role).alias("role"), said.alias("text"), kind.alias("kind"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return left.where("kind <> 0").select("conv_id", "turn", "role", "text", copies.alias("copy")).drop("copy")


def ordered(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, pos)``, written; pos counts rows in order within a range of the sort."""
    keyed = rows.withColumn("h", F.md5(F.col("text").cast("binary"))).withColumn("row", F.monotonically_increasing_id())  # the last tells equal rows apart
    by = ["conv_id", "turn", "role", "h", "row"]
    return materialize(keyed.repartitionByRange(*by).sortWithinPartitions(*by).select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("pos")), "turns")


def pieces(turns: DataFrame) -> DataFrame:
    """``(conv_id, block, faults, costs, audits)`` of every piece: its rows' first faults (b, d, t or a point each) and its table."""
    last = F.substring(F.rtrim("text", F.lit(WHITESPACE)), -1, 1)
    slim = turns.select(
        "conv_id", "pos", F.substring("role", 1, 1).alias("initial"), _blank(F.col("text")).alias("blank"), (~last.isin(".", "!", "?")).alias("cut"),
        F.unhex(F.md5(F.concat("role", F.lit("\0"), "text").cast("binary"))).alias("h"),
    )
    new = slim.where("not blank").groupBy("conv_id", "h").agg(F.min("pos").alias("pos"))
    rows = slim.drop("h").withColumn("kind", F.lit(1)).unionByName(new.select("pos", F.lit(0).alias("kind")), allowMissingColumns=True)
    rows = rows.withColumn("block", F.shiftright("pos", PIECE_BITS)).repartition("block").sortWithinPartitions("block", "pos", "kind")

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, symbols, faults, first = None, [], [], None
        for batch in chain(batches, (None,)):
            out = []
            for block, conv, pos, initial, blank, cut, kind in () if batch is None else zip(*(batch[c].to_pylist() for c in ("block", "conv_id", "pos", "initial", "blank", "cut", "kind"))):
                if kind == 0:
                    first = pos
                    continue
                if key != (conv, block):
                    if key:
                        out.append((*key, "".join(symbols), "".join(faults)))
                    key, symbols, faults = (conv, block), [], []
                gone = blank or first != pos
                symbol = initial if initial in ("s", "u", "a") else "x"
                symbols.append("-" if gone else symbol.upper() if cut else symbol)
                faults.append("b" if blank else "d" if gone else "t" if cut else ".")
            if batch is None and key:
                out.append((*key, "".join(symbols), "".join(faults)))
            if out:
                tables = [[x for row in piece_table(s) for x in row] for _, _, s, _ in out]
                yield pa.RecordBatch.from_arrays([
                    pa.array([x[0] for x in out], kinds["conv_id"]), pa.array([x[1] for x in out], pa.int64()), pa.array([x[3] for x in out], pa.string()),
                    pa.array([[x and x[0] for x in t] for t in tables], pa.list_(pa.int64())), pa.array([[x and x[1] for x in t] for t in tables], pa.list_(pa.string())),
                ], ["conv_id", "block", "faults", "costs", "audits"])

    kinds = {"conv_id": _arrow_kind(turns)}
    return materialize(map_arrow(rows, table, f"conv_id {_kind(turns)}, block long, faults string, costs array<long>, audits array<string>"), "pieces")


def _kind(turns: DataFrame) -> str:
    return turns.schema["conv_id"].dataType.simpleString()


def _arrow_kind(turns: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(turns.schema["conv_id"].dataType)


def chosen(cut: DataFrame) -> DataFrame:
    """``(conv_id, block, entry, lead, audit, faults)`` of the best path; ``cut``: what ``pieces`` returns."""
    conv_kind, arrow_kind = _kind(cut), _arrow_kind(cut)
    rows = cut.select("conv_id", "block", "costs", "audits").repartition("conv_id").sortWithinPartitions("conv_id", "block")

    def tables(own: Iterator[tuple], at: list[int]) -> Iterator[tuple]:
        for _, block, costs, audits in own:
            at.append(block)
            yield costs, audits

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, own in grouped(x for b in batches for x in zip(*(b[c].to_pylist() for c in ("conv_id", "block", "costs", "audits")))):
            at: list[int] = []
            path, lead = chained(tables(own, at))
            leads = [lead] + [""] * (len(path) - 1)
            yield pa.RecordBatch.from_arrays([pa.array([conv] * len(path), arrow_kind), pa.array(at, pa.int64()), *(pa.array([p[i] for p in path], pa.int32()) for i in (0, 1)), pa.array(leads, pa.string())], ["conv_id", "block", "entry", "exit", "lead"])

    path = map_arrow(rows, link, f"conv_id {conv_kind}, block long, entry int, exit int, lead string").select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "entry", "exit", "lead")
    found = cut.join(path, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    return found.select("conv_id", "block", "entry", "lead", F.element_at("audits", 4 * F.col("entry") + F.col("exit") + 1).alias("audit"), "faults")


def grouped(rows: Iterator[tuple]) -> Iterator[tuple]:
    """``(key, rows)`` of runs of equal first members; a run's rows have to be taken before the next run."""
    rows = iter(rows)
    ahead = next(rows, None)
    while ahead is not None:
        key = ahead[0]

        def run():
            nonlocal ahead
            while ahead is not None and ahead[0] == key:
                now, ahead = ahead, next(rows, None)
                yield now

        own = run()
        yield key, own
        for _ in own:
            pass


def _stream(turns: DataFrame, best: DataFrame, *more: DataFrame) -> DataFrame:
    """Rows, and before the rows of each piece what was chosen for it."""
    heads = best.select("conv_id", F.shiftleft("block", PIECE_BITS).alias("pos"), F.lit(1).alias("kind"), "entry", "lead", "audit", "faults")
    out = turns.select("conv_id", "pos", F.lit(2).alias("kind"), "turn", "role", "text").unionByName(heads, allowMissingColumns=True)
    for df in more:
        out = out.unionByName(df, allowMissingColumns=True)
    return out.select("conv_id", "pos", "kind", "entry", "lead", "audit", "faults", "turn", "role", "text")


def replay(rows: Iterator[tuple]) -> Iterator[tuple]:
    """``(pos, edit, fault, turn, initial, role, text)`` of every edit in order, of rows as ``_stream`` has them; inserts have no turn."""
    state, edits, faults = 0, iter(""), iter("")
    ahead: str | None = None

    def inserts(pos):
        nonlocal state, ahead
        while ahead == "I":
            state, role = NEXT[state]
            ahead = next(edits, None)
            yield pos, "I", "", None, "", role, ""

    for _, pos, kind, entry, lead, audit, said, turn, role, text in rows:
        if kind == 1:
            state, faults, edits = entry, iter(said), iter(lead + audit)
            if lead:
                state = 0
            ahead = next(edits, None)
            yield from inserts(pos)
        elif kind == 2:
            edit, ahead = ahead, next(edits, None)
            initial, now = role[:1], role
            if edit == "K":
                state = _KEPT[(initial, state)]
            elif edit == "R":
                state, now = NEXT[state]
            yield pos, edit, next(faults), turn, initial, now, text
            yield from inserts(pos)


def repaired(rows: DataFrame) -> DataFrame:
    """``(conv_id, pos, nth, edit, role, text)`` of rows ``(conv_id, turn, role, text)`` once repaired: what is kept, reroled or inserted, in the order of pos and nth.

    The rows of one conversation stay spread over tasks by their pieces.
    """
    turns = ordered(rows)
    stream = _stream(turns, chosen(pieces(turns))).withColumn("block", F.shiftright("pos", PIECE_BITS))
    stream = stream.repartition("block").sortWithinPartitions("block", "conv_id", "pos", "kind").drop("block")
    kind, arrow_kind = _kind(turns), _arrow_kind(turns)

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batched(grouped(x for b in batches for x in zip(*(c.to_pylist() for c in b.columns))), lambda conv, own: ((conv, x[0], i, x[1], x[5], x[6]) for i, x in enumerate(replay(own)) if x[1] != "D")):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*batch), (arrow_kind, pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()))], ["conv_id", "pos", "nth", "edit", "role", "text"])

    return map_arrow(stream, rebuild, f"conv_id {kind}, pos long, nth int, edit string, role string, text string")


def batched(groups: Iterator[tuple], rows_of, size: int = 1000) -> Iterator[list[tuple]]:
    held: list[tuple] = []
    for key, own in groups:
        for row in rows_of(key, own):
            held.append(row)
            if len(held) == size:
                yield held
                held = []
    if held:
        yield held


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def fold(rows: Iterator[tuple]) -> tuple:
    """A conversation's counts, cost, audit and digest, from its rows in order."""
    seen = {"b": 0, "d": 0, "t": 0, ".": 0}
    turns = illegal = cost = 0
    least = most = before = None
    audit, digest, empty = [], hashlib.sha256(), True
    for _, edit, fault, turn, initial, role, text in replay(rows):
        audit.append(edit)
        if edit != "I":
            seen[fault] += 1
            illegal += before is not None and before + initial not in _SOUND
            before = initial
            if turn is not None:
                least = turn if least is None else least
                turns += turn != most
                most = turn
        cost += {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[edit] + TRUNCATED * (fault == "t" and edit != "D")
        if edit != "D":
            digest.update(("" if empty else "\n").encode() + f"{role}:{text}".encode())
            empty = False
    gaps = 0 if least is None else most - least + 1 - turns
    return gaps, seen["b"], seen["d"], seen["t"], illegal, cost, "".join(audit), digest.hexdigest()


def repair_digest(rows: DataFrame, damage: bool = True) -> DataFrame:
    """Every conversation of ``rows(conv_id, turn, role, text)``, damaged first if so asked: ``conv_id`` and REPORT."""
    turns = ordered(damaged(rows) if damage else rows.select("conv_id", F.col("turn").try_cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text"))))
    cut = pieces(turns)
    every = rows.select("conv_id").distinct().select("conv_id", F.lit(-1).cast("long").alias("pos"), F.lit(0).alias("kind"))
    stream = _stream(turns, chosen(cut), every).repartition("conv_id").sortWithinPartitions("conv_id", "pos", "kind")
    kind, arrow_kind = _kind(turns), _arrow_kind(turns)

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batched(grouped(x for b in batches for x in zip(*(c.to_pylist() for c in b.columns))), lambda conv, own: ((conv, *fold(own)),)):
            columns = list(zip(*batch))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], arrow_kind), *(pa.array(c, pa.int64()) for c in columns[1:7]), *(pa.array(c, pa.string()) for c in columns[7:])], ["conv_id", *(c.split()[0] for c in REPORT.split(", "))])

    out = materialize(map_arrow(stream, report, f"conv_id {kind}, {REPORT}"), "repairs")
    discard(turns, cut)
    return out
