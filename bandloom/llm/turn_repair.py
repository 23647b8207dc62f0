"""Conversation structure repair: cheapest edits by an auction for shortest paths."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, table

#: A conversation is cut into pieces of at most so many rows, or of about so many bytes. An auction's time grows with the square of the rows.
PIECE_ROWS, PIECE_BYTES = 64, 4_000_000
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST_REROLE, COST_DELETE, COST_INSERT, COST_TRUNCATED = 2, 3, 2, 1
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn. A repaired conversation ends in the first or the last.
AFTER = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
#: What is inserted after the last row if a conversation ends in each state, and its cost.
TAIL = ["", INSERT * 2, INSERT, ""]
TAIL_COST = [COST_INSERT * len(x) for x in TAIL]
STATES, FAR = range(4), 1 << 40


def _arcs(code: str | None) -> list[list[tuple[int, int, str]]]:
    """Arcs from each state before a row of this code: (step of the node's number, cost, letter). None: after the last row."""
    out: list[list[tuple[int, int, str]]] = []
    for q in STATES:
        nxt = 3 if q == 2 else 2  # a user or assistant turn, whichever may follow
        arcs = [(nxt - q, COST_INSERT, INSERT)]
        if code is not None:
            arcs.append((4, COST_DELETE, DELETE))
            if code != "d":
                more = COST_TRUNCATED if code.isupper() else 0
                arcs.append((4 + nxt - q, COST_REROLE + more, REROLE))
                if (q, code.lower()) in AFTER:
                    arcs.append((4 + AFTER[q, code.lower()] - q, more, KEEP))
        out.append(arcs)
    return out


#: Arcs of a row by its code: the role's initial (x: none of s, u, a), in capitals if truncated; d must go.
ARCS = {c: _arcs(c) for c in "suaxSUAXd"}
LEAST = {c: min(cost for arcs in a for step, cost, _ in arcs if step > 2) for c, a in ARCS.items()}


class Lattice:
    """Edits of a piece of a conversation as paths in a lattice of (rows done, state).

    Node ``4 * i + q``. In a closed lattice turns may be inserted after the last row too and the end
    is a node of its own; in an open one paths end at the last row's states, so that every edit
    string ends with a row's letter and none begins another one.
    """

    def __init__(self, codes: str, closed: bool):
        self.n = len(codes)
        self.arcs = [ARCS[c] for c in codes]
        final = [[(4 - q, 0, "")] if closed and TAIL[q] == "" else [] for q in STATES]
        self.arcs.append([x + y if closed else [] for x, y in zip(final, _arcs(None), strict=True)])
        self.arcs.append([[]])
        self.least = [0] * (self.n + 2)
        for i in range(self.n - 1, -1, -1):
            self.least[i] = self.least[i + 1] + LEAST[codes[i]]

    def out(self, v: int) -> list[tuple[int, int, str]]:
        return self.arcs[v >> 2][v & 3]

    def prices(self, end: int) -> list[int]:
        """First prices: rows ahead cost at least this. Nodes that can't reach ``end`` are far."""
        price = [FAR] * (4 * self.n + 8)
        price[end] = 0
        for i in range(min(self.n, end >> 2), -1, -1):
            for _ in range(3):  # insertions stay at the row
                for v in range(4 * i, 4 * i + 4):
                    if v != end and price[v] == FAR and any(price[v + step] < FAR for step, _, _ in self.out(v)):
                        price[v] = self.least[i]
        return price

    def auction(self, price: list[int], start: int, end: int) -> int:
        """Raise prices until a path of tight arcs leads from ``start`` to ``end``; its cost.

        No price ever exceeds an arc's cost and the price behind it. The path's last node takes the
        least such sum as its price: if that is a raise the path is contracted by it, otherwise it is
        extended by the arc. When the path reaches the end, the prices are dual to the costs, so
        every arc of every cheapest path is tight. All cycles cost something, so none comes up.
        """
        path = [start]
        if price[start] == FAR:
            return FAR
        while path[-1] != end:
            v = path[-1]
            best, to = FAR, -1
            for step, cost, _ in self.out(v):
                if cost + price[v + step] < best:
                    best, to = cost + price[v + step], v + step
            if price[v] < best:
                price[v] = best
                if len(path) > 1:
                    path.pop()
                if best >= FAR:
                    price[v] = FAR
            else:
                path.append(to)
        return price[start]

    def trace(self, price: list[int], start: int, end: int) -> str:
        """The least string of letters along tight arcs from ``start`` to ``end``."""
        tight = lambda v: [(v + step, letter) for step, cost, letter in self.out(v) if price[v] == cost + price[v + step]]
        seen, stack = {start}, [start]
        while stack:
            for to, _ in tight(stack.pop()):
                if to not in seen:
                    seen.add(to)
                    stack.append(to)
        leads = {end}
        for v in sorted(seen, key=lambda v: (-(v >> 2), price[v])):
            if any(to in leads for to, _ in tight(v)):
                leads.add(v)
        front, letters = {start}, []
        while end not in front:
            ways = [(letter, to) for v in front for to, letter in tight(v) if to in leads]
            first = min(letter for letter, _ in ways)
            letters.append(first)
            front = {to for letter, to in ways if letter == first}
        return "".join(letters)


@lru_cache(50_000)
def solve(codes: str) -> tuple[int, str]:
    """Cost and letters of the cheapest edits of a whole conversation; of equal costs the least string."""
    lattice = Lattice(codes, closed=True)
    end = 4 * len(codes) + 4
    price = lattice.prices(end)
    cost = lattice.auction(price, 0, end)
    return cost, lattice.trace(price, 0, end)


@lru_cache(2_000)
def piece_map(codes: str) -> tuple[list[int], list[str]]:
    """For each state before and after a piece (row by row of a 4 x 4 table): least cost (``FAR``: none) and least string."""
    if not codes:
        return [0 if s == t else FAR for s in STATES for t in STATES], [""] * 16
    lattice, cost, text = Lattice(codes, closed=False), [FAR] * 16, [""] * 16
    for t in STATES:
        end = 4 * len(codes) + t
        price = lattice.prices(end)
        for s in STATES:
            cost[4 * s + t] = lattice.auction(price, s, end)
            if cost[4 * s + t] < FAR:
                text[4 * s + t] = lattice.trace(price, s, end)
    return cost, text


def chain(maps: list[tuple[list[int], list[int]]]) -> tuple[int, list[tuple[int, int]]]:
    """Compose the maps of a conversation's pieces: its cost, and the state before and after each piece.

    ``maps`` has least costs and the ranks of the strings among those of the same piece. Costs of
    what follows go from the last piece to the first; then the least strings go forward, with all
    states that share the least string so far.
    """
    ahead = [TAIL_COST]
    for cost, _ in reversed(maps):
        ahead.append([min(cost[4 * s + t] + ahead[-1][t] for t in STATES) for s in STATES])
    ahead.reverse()
    front, came = {0}, []
    for (cost, rank), here, there in zip(maps, ahead, ahead[1:], strict=False):
        ways = [(rank[4 * s + t], s, t) for s in front for t in STATES if cost[4 * s + t] + there[t] == here[s] < FAR]
        first = min(ways)[0]
        came.append({t: s for r, s, t in ways if r == first})
        front = set(came[-1])
    states, t = [], min(front)
    for back in reversed(came):
        states.append((back[t], t))
        t = back[t]
    return ahead[0][0], states[::-1]


def _code(initial: str, gone: bool, cut: bool) -> str:
    if gone:
        return "d"
    code = initial if initial in ("s", "u", "a") else "x"
    return code.upper() if cut else code


def repaired(roles: list[str], texts: list[str], letters: str, state: int) -> Iterator[str]:
    """Lines ``role:text`` of the edited rows, from the state before them."""
    i = 0
    for x in letters:
        role = "assistant" if state == 2 else "user"
        if x == INSERT:
            yield f"{role}:"
        else:
            if x == KEEP:
                yield f"{roles[i]}:{texts[i]}"
                state = AFTER[state, roles[i][:1]]
            elif x == REROLE:
                yield f"{role}:{texts[i]}"
            i += 1
        if x in (INSERT, REROLE):
            state = 3 if state == 2 else 2


def _facts(turns: list, initials: list[str], blank: list[bool], repeat: list[bool], cut: list[bool]) -> tuple[str, list]:
    """Codes of a piece's rows, and its counts with what is needed at its borders."""
    codes = "".join(_code(x, b or r, c) for x, b, r, c in zip(initials, blank, repeat, cut, strict=True))
    known = [t for t in turns if t is not None]
    distinct = sum(a != b for a, b in zip(known, known[1:], strict=False)) + bool(known)
    illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:], strict=False))
    n_repeat = sum(r and not b for b, r in zip(blank, repeat, strict=True))
    n_cut = sum(c and not b and not r for b, r, c in zip(blank, repeat, cut, strict=True))
    ends = [known[0], known[-1]] if known else [None, None]
    return codes, [sum(blank), n_repeat, n_cut, illegal, distinct, *ends]


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
ROWS = "turns array<long>, roles array<string>, texts array<string>, blanks array<boolean>, cuts array<boolean>"
NAMES = [x.strip().split()[0] for x in RESULT.split(",")]


def _batches(df: DataFrame, schema: str):
    """A function that makes Arrow batches of this schema from rows given as tuples."""
    kind = df.sparkSession.createDataFrame([], schema).schema

    def make(rows: list[tuple]) -> pa.RecordBatch:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(kind)
        cols = list(zip(*rows, strict=True)) or [()] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return make


def _flow(batches: Iterator[pa.RecordBatch], make, walk) -> Iterator[pa.RecordBatch]:
    """Rows of the input one by one through ``walk``; its rows in batches of bounded rows and bytes."""
    rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True))
    held, size = [], 0
    for got, weight in walk(rows):
        held.append(got)
        size += weight + 100
        if size > PIECE_BYTES:
            yield make(held)
            held, size = [], 0
    if held:
        yield make(held)
    give_back()


def repair(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present_col: str | None = None) -> DataFrame:
    """One row for each conversation: its faults and the cheapest edits that give roles ``(s?(ua)+)?``.

    Rows count in the order of turn (nulls first), then role, then text, so that ties have one order
    and repeated rows stand together. Nulls of role and text are one space; a null conversation is
    one of its own. A row where ``present_col`` is false only makes its conversation known; one
    without other rows has zeros, an empty audit and the digest of nothing. An empty table gives no
    rows; other columns go.

    Rows are dealt by ranges of that order, so a conversation of any length is spread over tasks. A
    conversation that lies within one task and has fewer than 64 rows is solved there. Others are
    cut into pieces; of each piece the auction gives the least cost and the least string between all
    states before and after it, and a conversation's pieces are composed from these small tables.
    Only the digest, which can't be put together from parts, goes over a conversation's rows in one
    task, as a stream.
    """
    spark = df.sparkSession
    role, text = F.coalesce(F.col(role_col), F.lit(" ")), F.coalesce(F.col(text_col), F.lit(" "))
    rows = df.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"), (F.col(present_col) if present_col else F.lit(True)).alias("present"))
    head = F.substring("text", 1, 32)
    order = ["conv_id", "turn", "role", head, "text"]
    dealt = rows.repartitionByRange(*order[:4]).sortWithinPartitions(*order)
    flags = dealt.select("*", (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"), (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("cut"))
    kind = df.schema[conv_col].dataType.simpleString()
    schema = f"conv_id {kind}, part int, piece long, closed boolean, {RESULT}, {ROWS}"
    make = _batches(df, schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        piece = 0

        def closed(conv, held: list[tuple]) -> tuple:
            turns, roles, texts, blank, cut = zip(*held, strict=True) if held else ((),) * 5
            seen, repeat = set(), []
            for x in zip(roles, texts, strict=True):
                repeat.append(x in seen)
                seen.add(x)
            codes, (n_blank, n_repeat, n_cut, illegal, distinct, first, last) = _facts(turns, [r[:1] for r in roles], blank, repeat, cut)
            cost, audit = solve(codes)
            digest = hashlib.sha256("\n".join(repaired(roles, texts, audit, 0)).encode()).hexdigest()
            gaps = last - first + 1 - distinct if first is not None else 0
            return (conv, part, None, True, gaps, n_blank, n_repeat, n_cut, illegal, cost, audit, digest, *[None] * 5)

        def walk(rows: Iterator[tuple]) -> Iterator[tuple[tuple, int]]:
            nonlocal piece
            now, held, size, whole, begun = None, [], 0, False, False

            def opened() -> tuple[tuple, int]:
                nonlocal piece, held, size
                cols = [list(c) for c in zip(*held, strict=True)] if held else [[] for _ in range(5)]
                got = (now, part, piece, False, *[None] * 8, *cols), size
                piece, held, size = piece + 1, [], 0
                return got

            for conv, turn, who, what, present, blank, cut in rows:
                if not begun or conv != now:
                    if begun:
                        if whole:
                            yield closed(now, held), len(held)
                            held, size = [], 0
                        else:
                            yield opened()
                    whole, now, begun = begun, conv, True  # a task's first conversation may have begun before
                if present:
                    held.append((turn, who, what, blank, cut))
                    size += len(what) + 100
                    if len(held) >= PIECE_ROWS or size > PIECE_BYTES:
                        yield opened()
                        whole = False
            if begun:  # a task's last conversation may go on
                yield opened()

        yield from _flow(batches, make, walk)

    seen = table(flags.mapInArrow(read, schema), "conversations")
    done, pieces = seen.filter("closed").select("conv_id", *NAMES), seen.filter("not closed").drop("closed", *NAMES)

    # Repeats across pieces: the first place of each role and text.
    each = pieces.select("conv_id", "part", "piece", F.posexplode(F.arrays_zip("roles", "texts")))
    place = F.min(F.struct("part", "piece", "pos"))
    firsts = each.groupBy("conv_id", F.col("col.roles").alias("role"), F.sha2("col.texts", 256).alias("digest")).agg(place.alias("at")).groupBy("at.part", "at.piece").agg(F.collect_list("at.pos").alias("firsts"))
    mapped = "part int, piece long, costs array<long>, audits array<string>, ranks array<int>, facts array<long>, initials array<string>"
    make_map = _batches(df, f"conv_id {kind}, {mapped}")

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def walk(rows: Iterator[tuple]) -> Iterator[tuple[tuple, int]]:
            for conv, part, piece, turns, roles, blank, cut, first in rows:
                fresh = set(first or ())
                initials = [r[:1] for r in roles]
                codes, facts = _facts(turns, initials, blank, [i not in fresh for i in range(len(roles))], cut)
                costs, audits = piece_map(codes)
                order = {x: k for k, x in enumerate(sorted(set(audits)))}
                yield (conv, part, piece, costs, audits, [order[x] for x in audits], facts, initials[:1] + initials[-1:]), 16 * len(codes)

        yield from _flow(batches, make_map, walk)

    joined = pieces.join(firsts, ["part", "piece"], "left").select("conv_id", "part", "piece", "turns", "roles", "blanks", "cuts", "firsts")
    maps = table(joined.mapInArrow(summarise, f"conv_id {kind}, {mapped}"), "conversation-maps")
    chained = "part int, piece long, entry int, leave int, final boolean, totals array<long>"
    make_chain = _batches(df, f"conv_id {kind}, {chained}")

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish(conv, held: list[tuple]) -> Iterator[tuple[tuple, int]]:
            cost, states = chain([(costs, ranks) for _, _, costs, ranks, _, _ in held])
            total, first, last, tail = [0] * 5, None, None, None
            for *_, facts, initials in held:
                total = [a + b for a, b in zip(total, facts[:5], strict=True)]
                if initials:
                    total[3] += tail is not None and tail + initials[0] not in ("su", "ua", "au")
                    tail = initials[-1]
                if facts[5] is not None:
                    total[4] -= last == facts[5]
                    first, last = facts[5] if first is None else first, facts[6]
            gaps = last - first + 1 - total[4] if first is not None else 0
            for k, ((part, piece, *_), (s, t)) in enumerate(zip(held, states, strict=True)):
                final = k == len(held) - 1
                yield (conv, part, piece, s, t, final, [gaps, *total[:4], cost] if final else None), 100

        def walk(rows: Iterator[tuple]) -> Iterator[tuple[tuple, int]]:
            now, held = None, []
            for conv, *rest in rows:
                if held and conv != now:
                    yield from finish(now, held)
                    held = []
                now = conv
                held.append(rest)
            if held:
                yield from finish(now, held)

        yield from _flow(batches, make_chain, walk)

    by = ["conv_id", "part", "piece"]
    small = maps.select(*by, "costs", "ranks", "facts", "initials").repartition("conv_id").sortWithinPartitions(*by)
    states = small.mapInArrow(compose, f"conv_id {kind}, {chained}").drop("conv_id")
    make_end = _batches(df, f"conv_id {kind}, {RESULT}")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def walk(rows: Iterator[tuple]) -> Iterator[tuple[tuple, int]]:
            sha, audit, any_line = hashlib.sha256(), [], False
            for conv, _, _, roles, texts, letters, entry, leave, final, totals in rows:
                audit.append(letters + (TAIL[leave] if final else ""))
                for line in repaired(roles, texts, audit[-1], entry):
                    sha.update(("\n" * any_line + line).encode())
                    any_line = True
                if final:
                    text = "".join(audit)
                    yield (conv, *totals, text, sha.hexdigest()), len(text)
                    sha, audit, any_line = hashlib.sha256(), [], False

        yield from _flow(batches, make_end, walk)

    letters = F.element_at("audits", F.col("entry") * 4 + F.col("leave") + 1).alias("letters")
    path = maps.select("part", "piece", "audits").join(states, ["part", "piece"]).select("part", "piece", letters, "entry", "leave", "final", "totals")
    whole = pieces.select(*by, "roles", "texts").join(path, ["part", "piece"]).select(*by, "roles", "texts", "letters", "entry", "leave", "final", "totals")
    ends = whole.repartition("conv_id").sortWithinPartitions(*by).mapInArrow(digest, f"conv_id {kind}, {RESULT}")
    return done.unionByName(ends)


def damage(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows ``(conv_id, turn, role, text, present)`` with planted faults by ``crc32("conv_id:turn") % 20``.

    0 drops a row (it stays with ``present`` false, so that its conversation is known), 1 empties the
    text, 2 removes its ``.!?``, 3 repeats the row, 4 sets the role to user. Nulls are one space, in
    the checksum too.
    """
    blank = F.lit(" ")
    name = [F.coalesce(F.col(c).cast("string"), blank) for c in (conv_col, turn_col)]
    kind = F.pmod(F.crc32(F.concat(name[0], F.lit(":"), name[1])), F.lit(20))
    role, text = F.coalesce(F.col(role_col), blank), F.coalesce(F.col(text_col), blank)
    return df.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), (kind != 0).alias("present"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")
