"""Repair of conversations by weighted interval parsing.

A conversation is well formed if the first letters of its roles read ``(s?(ua)+)?``: nothing, or an optional system turn
and then user and assistant in turn. The repair grammar is in Chomsky normal form. Its nonterminals are pairs of states
``[p, q]`` of that pattern and stand for the edited rows that lead from p to q:

    [p, q] -> [p, r] [r, q]                              two spans side by side
    [p, q] -> a row that is kept or given another role   where its role leads from p to q
    [p, p] -> a row that is deleted
    [p, q] -> inserted turns                             where these lead from p to q (the insertion closure)

The chart holds, for an interval of rows and every nonterminal, the least (cost, audit), where the audit is the edits' initials in
order. Spans of one row are closed under insertion on both sides; longer ones are combined bottom-up, doubling the
span length. One split of an interval is enough, as every derivation of [p, q] passes each boundary in some state r. Least
cells are made of least cells: two audits of one cell with equal cost edit the same rows, so none is the beginning of the
other, and what follows does not change their order.

Conversations of up to ``block`` rows are parsed as a whole, after one shuffle. Of longer ones each block of rows becomes a
chart cell by itself, cells of a conversation are combined level by level, and its rows then stream past the audit,
so that a task holds a block or an audit but never a whole conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passages.llm.batches import small_batches
from passages.operators.scan import ordinal
from passages.session import checkpoint_dir

BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"
LEGAL = ("su", "ua", "au")
NAMES = {"u": "user", "a": "assistant"}

#: states of (s?(ua)+)?: at the start, behind s, behind u, behind a; the start and behind a may end it
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FINAL = (0, 3)
EXPECTED = ("u", "u", "a", "u")
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
BLOCK = 4096

Cell = list[dict[int, tuple[int, str]]]


def _better(row: dict[int, tuple[int, str]], q: int, found: tuple[int, str]) -> None:
    if q not in row or found < row[q]:
        row[q] = found


def combine(left: Cell, right: Cell) -> Cell:
    """The cell of two neighbouring intervals."""
    out: Cell = []
    for row in left:
        best: dict[int, tuple[int, str]] = {}
        for r, (c, a) in row.items():
            for q, (d, b) in right[r].items():
                if q not in best or c + d <= best[q][0]:
                    _better(best, q, (c + d, a + b))
        out.append(best)
    return out


def _insertions() -> Cell:
    """The cell of an empty interval: what can be inserted between two rows, at its least."""
    cell: Cell = [{p: (0, "")} | {q: (INSERT, "I") for c, q in NEXT[p].items() if c in NAMES} for p in range(4)]
    while (grown := combine(cell, cell)) != cell:
        cell = grown
    return cell


EMPTY = _insertions()


def _row_cell(symbol: str) -> Cell:
    """The cell of one row. ``x`` has to go; other rows are named by their role (``o`` if it is none of s, u, a), cut-off
    ones in capitals."""
    cell: Cell = [{p: (DELETE, "D")} for p in range(4)]
    if symbol != "x":
        extra = CUT if symbol.isupper() else 0
        for p in range(4):
            for c, q in NEXT[p].items():
                if c == symbol.lower():
                    _better(cell[p], q, (extra, "K"))
                if c in NAMES:
                    _better(cell[p], q, (extra + REROLE, "R"))
    return combine(combine(EMPTY, cell), EMPTY)


ROW_CELLS = {symbol: _row_cell(symbol) for symbol in "xsuaoSUAO"}


def parse(cells: list[Cell]) -> Cell:
    """The cell over all of neighbouring ``cells``, combined bottom-up by span length."""
    while len(cells) > 1:
        pairs = [combine(a, b) for a, b in zip(cells[::2], cells[1::2])]
        cells = pairs + cells[len(pairs) * 2 :]
    return cells[0] if cells else EMPTY


def best(cell: Cell) -> tuple[int, str]:
    return min(cell[0][q] for q in FINAL if q in cell[0])


def symbol_of(initial: str, cut: bool) -> str:
    symbol = initial if initial in ("s", "u", "a") else "o"
    return symbol.upper() if cut else symbol


class Edits:
    """Reads an audit along the rows it edits."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        """The turns put in before the next row, or at the end."""
        while self.audit.startswith("I", self.at):
            yield self._turn("I", "")

    def _turn(self, edit: str, text: str) -> tuple[str, str, str]:
        self.at += 1
        initial = EXPECTED[self.state]
        self.state = NEXT[self.state][initial]
        return edit, NAMES[initial], text

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        if edit == "R":
            yield self._turn("R", text)
            return
        self.at += 1
        if edit == "K":
            self.state = NEXT[self.state][role[:1]]
            yield edit, role, text


def judge(rows: list[tuple]) -> tuple[str, dict[str, int]]:
    """The symbols of a conversation's (turn, role, text) rows, and its counts."""
    seen, symbols = set(), []
    counts = {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
    before = None
    for _, role, text in rows:
        bare = text.rstrip(BLANKS)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ENDS else ""
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        symbols.append("x" if fault in ("blank", "duplicate") else symbol_of(role[:1], fault == "truncated"))
        if before is not None:
            counts["illegal"] += before + role[:1] not in LEGAL
        before = role[:1]
    turns = {t for t, _, _ in rows if t is not None}
    if turns:
        counts["gaps"] = max(turns) - min(turns) + 1 - len(turns)
    return "".join(symbols), counts


_TURNS = pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]))
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")
_WHOLE = pa.schema([("id", pa.string()), *[(c, pa.int64()) for c in _COUNTS], ("cost", pa.int64()), ("audit", pa.string()), ("turns", _TURNS)])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parses conversations whose rows follow each other; only the last one waits for the next batch."""

    def repaired(name: str, rows: list[tuple]) -> dict:
        symbols, counts = judge(rows)
        cost, audit = best(parse([ROW_CELLS[s] for s in symbols]))
        edits = Edits(audit)
        turns = [t for _, role, text in rows for t in edits.row(role, text)] + list(edits.inserted())
        return {"id": name, **counts, "cost": cost, "audit": audit, "turns": [dict(zip(("edit", "role", "text"), t)) for t in turns]}

    name, rows = None, []
    for batch in batches:
        out = []
        for key, *row in zip(*(batch.column(c).to_pylist() for c in ("id", "turn", "role", "text"))):
            if key != name:
                if rows:
                    out.append(repaired(name, rows))
                name, rows = key, []
            rows.append(tuple(row))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_WHOLE)
    if rows:
        yield pa.RecordBatch.from_pylist([repaired(name, rows)], schema=_WHOLE)


def _kind(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.string(): "string", pa.int32(): "int", _TURNS: "array<struct<edit:string,role:string,text:string>>"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _short(rows: DataFrame) -> DataFrame:
    return rows.repartition("id").sortWithinPartitions("id", "turn", "role", "text").mapInArrow(_whole, _kind(_WHOLE))


_CELL = "array<struct<p:int,q:int,cost:long,audit:string>>"


def _packed(cell: Cell) -> list[dict]:
    return [{"p": p, "q": q, "cost": c, "audit": a} for p, row in enumerate(cell) for q, (c, a) in row.items()]


def _unpacked(packed: list[dict]) -> Cell:
    cell: Cell = [{} for _ in range(4)]
    for x in packed:
        cell[x["p"]][x["q"]] = (x["cost"], x["audit"])
    return cell


_CELLS = pa.schema([
    ("id", pa.string()), ("at", pa.int64()),
    ("cell", pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))),
])


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One cell per row of (id, at, symbols) or of (id, at, halves)."""
    for batch in batches:
        for row in batch.to_pylist():
            parts = [ROW_CELLS[s] for s in row["symbols"]] if "symbols" in row else [_unpacked(h["cell"]) for h in row["halves"]]
            yield pa.RecordBatch.from_pylist([{"id": row["id"], "at": row["at"], "cell": _packed(parse(parts))}], schema=_CELLS)


def _initial() -> Column:
    return F.substring("role", 1, 1)


def _long(rows: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """The placed rows (id, pos, role, text) and the audits (id, counts, cost, audit) of conversations of any length."""
    rows = ordinal(rows, ["id"], ["turn", "role", "text"], "pos").checkpoint()
    word = r"[^\x20\x09-\x0D]"
    marks = rows.select("id", "pos", "turn", "role", F.sha2("text", 256).alias("digest"), (~F.col("text").rlike(word)).alias("blank"),
                        (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("cut"))
    firsts = marks.groupBy("id", "role", "digest").agg(F.min("pos").alias("first"))
    marks = marks.join(firsts, ["id", "role", "digest"])
    again, initial = F.col("first") < F.col("pos"), _initial()
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    symbol = F.when(F.col("blank") | again, "x").when(F.col("cut"), F.upper(known)).otherwise(known)
    fault = F.when(F.col("blank"), "blank").when(again, "duplicate").when(F.col("cut"), "truncated")
    marks = marks.select("id", "pos", "turn", initial.alias("initial"), symbol.alias("symbol"), fault.alias("fault")).checkpoint()
    counts = marks.groupBy("id").agg(*[F.count(F.when(F.col("fault") == c, 1)).alias(c) for c in ("blank", "duplicate", "truncated")])
    turns = marks.filter("turn IS NOT NULL").groupBy("id", "turn").agg(F.lit(1).alias("one")).groupBy("id")
    turns = turns.agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))

    at = F.floor(F.col("pos") / block).cast("long")
    blocks = marks.groupBy("id", at.alias("at")).agg(F.array_sort(F.collect_list(F.struct("pos", "initial", "symbol"))).alias("rows"))
    initials = F.transform("rows", lambda r: r["initial"])
    blocks = blocks.select("id", "at", initials.alias("initials"), F.array_join(F.transform("rows", lambda r: r["symbol"]), "").alias("symbols")).checkpoint()
    pairs = F.zip_with("initials", F.slice("initials", F.lit(2), F.size("initials")), lambda a, b: F.when(b.isNotNull(), F.concat(a, b)))
    wrong = F.size(F.filter(pairs, lambda p: p.isNotNull() & ~p.isin(*LEGAL)))
    met = F.concat(F.lag(F.element_at("initials", -1)).over(Window.partitionBy("id").orderBy("at")), F.element_at("initials", 1))
    illegal = blocks.select("id", wrong.alias("inside"), F.when(~met.isin(*LEGAL), 1).otherwise(0).alias("between"))
    illegal = illegal.groupBy("id").agg(F.sum(F.col("inside") + F.col("between")).alias("illegal"))

    cells = blocks.select("id", "at", "symbols").mapInArrow(_parsed, f"id string, at long, cell {_CELL}").checkpoint()
    while not cells.filter("at > 0").isEmpty():
        halves = cells.groupBy("id", F.shiftright("at", 1).alias("half")).agg(F.array_sort(F.collect_list(F.struct("at", "cell"))).alias("halves"))
        cells = halves.withColumnRenamed("half", "at").mapInArrow(_parsed, f"id string, at long, cell {_CELL}").checkpoint()
    ends = F.filter("cell", lambda c: (c["p"] == 0) & c["q"].isin(*FINAL))
    least = F.array_min(F.transform(ends, lambda c: F.struct(c["cost"].alias("cost"), c["audit"].alias("audit"))))
    audits = cells.select("id", least.alias("least")).select("id", "least.*")
    audits = audits.join(counts, "id").join(illegal, "id").join(turns, "id", "left").fillna(0, ["gaps"])
    return rows.select("id", "pos", "role", "text"), audits.select("id", *_COUNTS, "cost", "audit").checkpoint()


_TURN = pa.schema([("id", pa.string()), ("at", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
_DIGEST = pa.schema([("id", pa.string()), ("repaired_sha256", pa.string())])


def _streamed(rows: DataFrame, audits: DataFrame, digest: bool) -> DataFrame:
    """Rows of long conversations past their audits: the repaired turns, or their digest."""
    schema = _DIGEST if digest else _TURN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, edits, total, n = None, None, None, 0

        def told(turns) -> Iterator[dict]:
            nonlocal n
            for edit, role, text in turns:
                total.update(("\n" if n else "").encode() + f"{role}:{text}".encode())
                n += 1
                if not digest:
                    yield {"id": name, "at": n - 1, "edit": edit, "role": role, "text": text}

        def ended() -> Iterator[dict]:
            if edits is not None:
                yield from told(edits.inserted())
                if digest:
                    yield {"id": name, "repaired_sha256": total.hexdigest()}

        for batch in batches:
            out = []
            for key, pos, role, text in zip(*(batch.column(c).to_pylist() for c in ("id", "pos", "role", "text"))):
                if pos < 0:
                    out += ended()
                    name, edits, total, n = key, Edits(text), hashlib.sha256(), 0
                else:
                    out += told(edits.row(role, text))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        out = list(ended())
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    heads = audits.select("id", F.lit(-1).cast("long").alias("pos"), F.lit("").alias("role"), F.col("audit").alias("text"))
    both = rows.unionByName(heads).repartition("id").sortWithinPartitions("id", "pos")
    return both.mapInArrow(run, _kind(schema))


def _prepared(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, turn, role, text) without nulls but in turn, and (id, conv_id); the id of a null conv_id is empty."""
    name = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    texts = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text")}
    plain = rows.select(name.alias("id"), F.col("turn").cast("long").alias("turn"), *[v.alias(c) for c, v in texts.items()])
    return plain, rows.select(name.alias("id"), "conv_id").distinct()


def _divided(plain: DataFrame, block: int) -> tuple[DataFrame, DataFrame | None]:
    checkpoint_dir(plain.sparkSession)
    long = plain.groupBy("id").count().filter(F.col("count") > block).select("id").checkpoint()
    if long.isEmpty():
        return plain, None
    return plain.join(long, "id", "left_anti"), plain.join(long, "id")


def summaries(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text): conv_id, gaps, blank, duplicate, truncated, illegal, cost,
    audit and repaired_sha256, the digest of the repaired turns (``role:text``, joined by newlines).

    Rows are taken by turn, nulls first; equal turns go by role and then text in byte order. The first fault of a row counts:
    blank (nothing but white space), duplicate (role and text seen earlier), truncated (does not end in ``.!?``). Keeping a row
    costs nothing, another role 1, deleting 2, an inserted empty turn 5; blank and duplicate rows have to go, truncated ones
    that stay cost 5 more. Of the cheapest repairs the one with the least audit in ASCII order is taken. A role that is empty or
    begins with another letter cannot be kept. A null role or text counts as one space, a null conv_id as a conversation
    of its own; other columns are ignored. Tables without rows give no rows.
    """
    plain, names = _prepared(rows)
    short, long = _divided(plain, block)
    with small_batches(rows.sparkSession):
        joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
        out = _short(short).select("id", *_COUNTS, "cost", "audit", F.sha2(joined, 256).alias("repaired_sha256"))
        if long is not None:
            placed, audits = _long(long, block)
            out = out.unionByName(audits.join(_streamed(placed, audits, True), "id").select(*out.columns))
    return out.join(names, "id").select("conv_id", *out.columns[1:])


def repaired(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """The turns of the repaired conversations: conv_id, at (0, 1, ...), edit (K, R or I), role, text. Rules as in ``summaries``."""
    plain, names = _prepared(rows)
    short, long = _divided(plain, block)
    out = _short(short).select("id", F.posexplode("turns").alias("at", "turn")).select("id", F.col("at").cast("long").alias("at"), "turn.*")
    if long is not None:
        out = out.unionByName(_streamed(*_long(long, block), False).select(*out.columns))
    return out.join(names, "id").select("conv_id", *out.columns[1:])
