"""Repair of conversations' role order by Hirschberg's divide and conquer over four states.

A repaired conversation's role initials follow ``(s?(ua)+)?``. Four states say what came last: nothing, system,
user or assistant. Rows are kept, given another role or deleted, and empty ones inserted, at least cost; of equal
costs the audit (the edits' initials in order) that is least in ASCII wins. A state's cost is taken right after a
row's own edit, so insertions belong to the row that follows; then no audit up to a row begins another one, and the
order of the states' audits can be carried along as ranks, without the audits themselves. Forward and backward
vectors meet in the middle of a stretch of rows, the optimal crossing of the least rank is taken, and both halves
are solved alike: no table of all rows and states is kept.

Rows are dealt by ranges of (conversation, turn), so a long conversation is spread over many tasks. A task solves
the conversations that lie inside its range at once. Of those at its edges it says what each way through costs
(four states by four); these few figures are put together by conversation, the states at the borders are chosen by
the same rule, and each stretch is then solved between its two states.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import staged

START, S, U, A = range(4)
BIG = 1 << 60
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Where a role's initial leads from each state; the order allows nothing else.
MOVES = {"s": {START: S}, "u": {START: U, S: U, A: U}, "a": {U: A}}
NAMES = {U: "user", A: "assistant"}
#: Insertions from a state: how many, and the state after them. More than two in a row only go round.
INSERTED = {START: [(0, START), (1, U), (2, A)], S: [(0, S), (1, U), (2, A)], U: [(0, U), (1, A), (2, U)], A: [(0, A), (1, U), (2, A)]}
#: Cost of what must still be inserted at the end.
LAST = (0, 2 * INSERT, INSERT, 0)
PARTITION = 8 << 20
CHUNK = 1 << 20
#: Kinds of rows: 0 must go; then s, u, a and other initials, whole and truncated.
GONE = 0


def kind_of(initial: str, must_go: bool, truncated: bool) -> int:
    return GONE if must_go else 1 + "sua".find(initial) % 4 + 4 * truncated


def _ways(kind: int) -> list[tuple[int, int, int, str]]:
    """All (state before, state after, cost, edits) of one row with the insertions before it."""
    found = []
    for before, inserted in INSERTED.items():
        for n, at in inserted:
            paid, edits = n * INSERT, "I" * n
            found.append((before, at, paid + DELETE, edits + "D"))
            if kind == GONE:
                continue
            extra = paid + TRUNCATED * (kind > 4)
            if own := "sua_"[(kind - 1) % 4].strip("_"):
                if at in MOVES[own]:
                    found.append((before, MOVES[own][at], extra + KEEP, edits + "K"))
            for role in "ua":
                if at in MOVES[role]:
                    found.append((before, MOVES[role][at], extra + REROLE, edits + "R"))
    return found


#: For each kind, the cheapest and then least edits between two states.
BEST: list[dict[tuple[int, int], tuple[int, str]]] = []
for _kind in range(9):
    BEST.append({})
    for _b, _a, _c, _e in _ways(_kind):
        BEST[_kind][_b, _a] = min(BEST[_kind].get((_b, _a), (BIG, "")), (_c, _e))

_FORWARD: dict = {}
_BACKWARD: dict = {}


def _ahead(costs: tuple, ranks: tuple, kind: int) -> tuple[tuple, tuple, int]:
    """Costs and ranks of the states after a row; costs are given over the least one, which is returned too."""
    key = (costs, ranks, kind)
    if (known := _FORWARD.get(key)) is None:
        found = []
        for after in range(4):
            ways = [(costs[b] + c, ranks[b], e) for (b, a), (c, e) in BEST[kind].items() if a == after and costs[b] < BIG]
            found.append(min(ways, default=(BIG, 0, "")))
        order = sorted({f[1:] for f in found if f[0] < BIG})
        least = min(f[0] for f in found)
        known = tuple(f[0] - least if f[0] < BIG else BIG for f in found), tuple(order.index(f[1:]) if f[0] < BIG else 9 for f in found), least
        _FORWARD[key] = known
    return known


def _behind(costs: tuple, kind: int) -> tuple[tuple, int]:
    """Costs from the states before a row to the end, over the least one."""
    key = (costs, kind)
    if (known := _BACKWARD.get(key)) is None:
        found = [min((c + costs[a] for (b, a), (c, _) in BEST[kind].items() if b == before and costs[a] < BIG), default=BIG) for before in range(4)]
        least = min(found)
        known = _BACKWARD[key] = tuple(f - least if f < BIG else BIG for f in found), least
    return known


def _unit(state: int) -> tuple:
    return tuple(0 if x == state else BIG for x in range(4))


def forward(kinds: bytes, lo: int, hi: int, entry: int) -> tuple[tuple, tuple]:
    """Costs of the states after rows ``lo`` to ``hi`` from state ``entry``, and the order of their audits."""
    costs, ranks, paid = _unit(entry), (0, 0, 0, 0), 0
    for i in range(lo, hi):
        costs, ranks, least = _ahead(costs, ranks, kinds[i])
        paid += least
    return tuple(c + paid if c < BIG else BIG for c in costs), ranks


def edits_between(kinds: bytes, entry: int, leave: int) -> list[str]:
    """The edits of each row (with the insertions before it) on the audit-least cheapest way between two states."""
    out: list[str] = []
    stack = [(0, len(kinds), entry, leave)]
    while stack:
        lo, hi, p, q = stack.pop()
        if hi - lo == 1:
            out.append(BEST[kinds[lo]][p, q][1])
        elif hi > lo:
            mid = (lo + hi) // 2
            costs, ranks = forward(kinds, lo, mid, p)
            back = _unit(q)
            for i in range(hi - 1, mid - 1, -1):
                back, _ = _behind(back, kinds[i])
            least = min(c + b for c, b in zip(costs, back, strict=True))
            x = min((ranks[x], x) for x in range(4) if costs[x] + back[x] == least)[1]
            stack += [(mid, hi, x, q), (lo, mid, p, x)]
    return out


def last_state(costs: tuple, ranks: tuple) -> tuple[int, int]:
    """The cost of the whole and the state after the last row."""
    cost, _, state = min((c + end, r, x) for x, (c, r, end) in enumerate(zip(costs, ranks, LAST, strict=True)))
    return cost, state


def repaired(edits: list[str], rows: list[tuple[str, str]], state: int) -> Iterator[str]:
    """``role:text`` of what the edits leave of the rows, from a state on. More edits than rows end in insertions."""
    for k, each in enumerate(edits):
        for e in each:
            if e == "D":
                continue
            if e == "K":
                role, text = rows[k]
                state = MOVES[role[0]][state]
            else:
                state = MOVES["a" if state == U else "u"][state]
                role, text = NAMES[state], "" if e == "I" else rows[k][1]
            yield f"{role}:{text}"


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, turn, role, text, copy`` of seeded faults: by crc32 of ``conv:turn`` modulo 20 a row is dropped (0), emptied (1),
    loses its ``.!?`` (2), stands twice (3) or gets the role user (4). Nulls in keys, roles and texts are one space."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(plain(conv), F.lit(":"), plain(turn)).cast("binary")) % 20
    out = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), plain(role).alias("role"), plain(text).alias("text"), fate.alias("fate")).where("fate <> 0")
    new = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return out.select("conv", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), new.alias("text"), F.explode(copies).alias("copy"))


def faults(rows: DataFrame) -> DataFrame:
    """``rows`` (``conv, turn, role, text, copy``) with ``place`` (the order of rows with the same turn) and ``fault``: blank, duplicate, truncated or null.

    The first place of each role and text in a conversation is found by an aggregation that is joined back, so that a
    text repeated without end is no single group.
    """
    marked = rows.withColumn("mark", F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256))
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "mark", "copy")
    marked = staged(marked.withColumns({"place": place, "salt": F.xxhash64(F.rand(13))}), "damaged")
    firsts = marked.groupBy("conv", "mark").agg(F.min(F.struct("place", "salt")).alias("first"), F.count("*").alias("times")).where("times > 1")
    known = firsts.select(F.col("conv").alias("_conv"), F.col("mark").alias("_mark"), "first")
    joined = marked.join(known, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("mark") == F.col("_mark")), "left")
    return joined.select("conv", "turn", "role", "text", "place", "salt", _fault(F.col("text"), F.col("first").isNotNull() & (F.struct("place", "salt") != F.col("first"))).alias("fault"))


def _fault(text: Column, again: Column) -> Column:
    bare = F.rtrim(F.translate(text, "\t\n\x0b\x0c\r", "     "))
    return F.when(bare == "", "blank").when(again, "duplicate").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated")


_ROW = "conv long, part int, pos long, role string, text string, kind int, n_rows long, lo long, hi long, turns long, blank long, duplicate long, truncated long, illegal long, first string, last string, ways binary, audit string, sha string, gaps long, cost long"
_LEGAL = {"su", "ua", "au"}


def _gaps(lo: int, hi: int, turns: int) -> int:
    """Turns that are missing between the least and the largest one, as far as a long holds them."""
    return min(hi - lo + 1 - turns, (1 << 63) - 1)


class _Stretch:
    """Rows of one conversation that follow one another in one task."""

    def __init__(self, conv):
        self.conv, self.kinds, self.rows = conv, bytearray(), []
        self.lo = self.hi = None
        self.turns = self.illegal = 0
        self.count = {"blank": 0, "duplicate": 0, "truncated": 0}

    def add(self, turn, role, text, fault):
        if self.rows and self.rows[-1][0][:1] + role[:1] not in _LEGAL:
            self.illegal += 1
        if turn is not None:
            self.turns += turn != self.hi
            self.lo, self.hi = turn if self.lo is None else self.lo, turn
        if fault:
            self.count[fault] += 1
        self.rows.append((role, text))
        self.kinds.append(kind_of(role[:1], fault in ("blank", "duplicate"), fault == "truncated"))

    def facts(self, part: int) -> dict:
        ends = {"first": self.rows[0][0][:1], "last": self.rows[-1][0][:1]} if self.rows else {}
        return {"conv": self.conv, "part": part, "n_rows": len(self.rows), "lo": self.lo, "hi": self.hi, "turns": self.turns, "illegal": self.illegal, **self.count, **ends}

    def whole(self) -> dict:
        cost, end = last_state(*forward(self.kinds, 0, len(self.kinds), START))
        edits = edits_between(self.kinds, START, end) + ["I" * (LAST[end] // INSERT)]
        sha = hashlib.sha256("\n".join(repaired(edits, self.rows, START)).encode()).hexdigest()
        gaps = 0 if self.lo is None else _gaps(self.lo, self.hi, self.turns)
        return {"audit": "".join(edits), "sha": sha, "cost": cost, "gaps": gaps}

    def ways(self) -> bytes:
        """Costs and ranks of each way through, from each of the four states."""
        return np.array([forward(self.kinds, 0, len(self.kinds), p) for p in range(4)], "<i8").tobytes()


def _table(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_schema(_ROW))


def _schema(fields: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in map(str.split, fields.split(", "))])


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole results of the conversations inside this range; figures and rows of the two at its edges."""
    part, now, edge = TaskContext.get().partitionId(), None, True
    out: list[dict] = []

    def at_edge(x: _Stretch):
        yield _table([x.facts(part) | {"ways": x.ways()}])
        for at in range(0, len(x.rows), 4096):
            yield _table([{"conv": x.conv, "part": part, "pos": at + k, "role": r, "text": t, "kind": x.kinds[at + k]} for k, (r, t) in enumerate(x.rows[at : at + 4096])])

    for batch in batches:
        for conv, turn, role, text, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or conv != now.conv:
                if now is not None:
                    if edge:
                        yield from at_edge(now)
                    else:
                        out.append(now.facts(part) | now.whole())
                    edge = False
                now = _Stretch(conv)
            if role is not None:
                now.add(turn, role, text, fault)
        if len(out) > 1000:
            yield _table(out)
            out = []
    if out:
        yield _table(out)
    if now is not None:
        yield from at_edge(now)


_JOINED = "conv long, part int, entry int, leave int, end boolean, cost long, gaps long, blank long, duplicate long, truncated long, illegal long"


def _stitched(found: pa.Table) -> pa.Table:
    """The states at the borders of a conversation's stretches, one row a stretch, and the figures of the whole.

    A conversation has at most one stretch in each range of rows.
    """
    found = sorted(found.to_pylist(), key=lambda r: r["part"])
    rows = [r for r in found if r["n_rows"]]
    costs, ranks, taken = _unit(START), (0, 0, 0, 0), []
    for t in (np.frombuffer(r["ways"], "<i8").tolist() for r in rows):
        way = []
        for q in range(4):
            way.append(min(((costs[p] + t[8 * p + q], ranks[p], t[8 * p + 4 + q], p) for p in range(4) if costs[p] < BIG and t[8 * p + q] < BIG), default=(BIG, 9, 9, -1)))
        order = sorted({w[1:3] for w in way if w[0] < BIG})
        costs, ranks = tuple(w[0] for w in way), tuple(order.index(w[1:3]) if w[0] < BIG else 9 for w in way)
        taken.append([w[3] for w in way])
    cost, state = last_state(costs, ranks)
    states = [state]
    for before in reversed(taken):
        states.append(before[states[-1]])
    states.reverse()
    illegal = sum(r["illegal"] for r in found) + sum(a["last"] + b["first"] not in _LEGAL for a, b in pairwise(rows))
    known = [r for r in rows if r["lo"] is not None]
    same = sum(a["hi"] == b["lo"] for a, b in pairwise(known))
    gaps = _gaps(known[0]["lo"], known[-1]["hi"], sum(r["turns"] for r in known) - same) if known else 0
    one = {"conv": found[0]["conv"], "cost": cost, "gaps": gaps, "illegal": illegal} | {c: sum(r[c] for r in found) for c in ("blank", "duplicate", "truncated")}
    n = max(1, len(rows))
    states += [START] * (n + 1 - len(states))
    out = [one | {"part": r["part"], "entry": states[k], "leave": states[k + 1], "end": k == n - 1} for k, r in enumerate(rows or found[:1])]
    return pa.Table.from_pylist(out, schema=_schema(_JOINED))


_CHUNKS = "conv long, part int, chunk int, audit string, text string"


def _between(rows: pd.DataFrame) -> pd.DataFrame:
    """Audit and repaired text of one stretch between its two states, in chunks."""
    rows = rows.sort_values("pos", ignore_index=True)
    head = rows.iloc[0]
    conv, entry, leave = head["conv"], int(head["entry"]), int(head["leave"])
    own = rows[rows["kind"].notna()]
    edits = edits_between(bytes(own["kind"].astype(int).tolist()), entry, leave)
    if head["end"]:
        edits = [*edits, "I" * (LAST[leave] // INSERT)]
    texts = list(zip(own["role"], own["text"], strict=True))
    chunks: list[str | None] = [None]
    held, size = [], 0
    for line in repaired(edits, texts, entry):
        held.append(line)
        size += len(line)
        if size >= CHUNK:
            chunks.append("\n".join(held))
            held, size = [], 0
    if held:
        chunks.append("\n".join(held))
    n = len(chunks)
    said = ["".join(edits)] + [""] * (n - 1)
    return pd.DataFrame({"conv": pd.array([conv] * n, "Int64"), "part": [int(head["part"])] * n, "chunk": range(n), "audit": said, "text": pd.array(chunks, "string")})


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``conv, audit, sha`` of chunks in order: one after another, since a SHA-256 can't be taken in parts."""
    now, audit, state, first = None, [], None, True

    def close():
        own = [pa.array([now[0]], pa.int64()), pa.array(["".join(audit)]), pa.array([state.hexdigest()])]
        return pa.RecordBatch.from_arrays(own, names=["conv", "audit", "sha"])

    for batch in batches:
        for conv, said, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or conv != now[0]:
                if now is not None:
                    yield close()
                now, audit, state, first = (conv,), [], hashlib.sha256(), True
            audit.append(said)
            if text is not None:
                state.update((text if first else "\n" + text).encode())
                first = False
    if now is not None:
        yield close()


def repair(rows: DataFrame, convs: DataFrame, partition_bytes: int = PARTITION) -> DataFrame:
    """``conv, gaps, blank, duplicate, truncated, illegal, cost, audit, sha`` of each conversation in ``convs`` (one column ``conv``).

    ``rows`` are ``conv, turn, role, text, copy``. They are taken by turn, nulls first; rows of one turn in the order of a
    hash of role and text, copies beside each other. A null conversation is one of its own. A conversation without rows has
    zeros, an empty audit and the hash of an empty text. An empty table gives an empty result.
    """
    marked = staged(faults(rows), "faults")
    size = marked.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    ghosts = convs.distinct().select("conv", F.lit(None).cast("long").alias("turn"), *(F.lit(None).cast("string").alias(c) for c in ("role", "text", "fault")), F.lit(None).cast(marked.schema["place"].dataType).alias("place"), F.lit(None).cast("long").alias("salt"))
    every = marked.unionByName(ghosts)
    keys = [F.asc_nulls_first(k) for k in ("conv", "place.known", "place.turn", "place.mark", "place.copy", "salt")]
    parts = max(marked.sparkSession.sparkContext.defaultParallelism, -(-size // partition_bytes))
    dealt = every.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    found = staged(dealt.select("conv", "turn", "role", "text", "fault").mapInArrow(_solve, _ROW), "stretches")
    whole = found.where("audit is not null").select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "sha")
    edges = found.where("ways is not null").groupBy("conv").applyInArrow(_stitched, _JOINED)
    edges = staged(edges, "borders")
    own = found.where("audit is null and ways is null").select(F.col("conv").alias("_conv"), F.col("part").alias("_part"), "pos", "role", "text", "kind")
    met = edges.join(own, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part")), "left")
    stretches = met.select("conv", "part", "entry", "leave", "end", "pos", "role", "text", "kind").groupBy("conv", "part").applyInPandas(_between, _CHUNKS)
    hashed = stretches.repartition("conv").sortWithinPartitions("conv", "part", "chunk").select("conv", "audit", "text").mapInArrow(_hashed, "conv long, audit string, sha string")
    figures = edges.where("end").drop("part", "entry", "leave", "end").withColumnRenamed("conv", "_conv")
    rest = figures.join(hashed, F.col("conv").eqNullSafe(F.col("_conv")))
    return whole.unionByName(rest.drop("_conv"))


_OPTIONS = ", ".join(f"({k}, {b}, {a}, {c}, '{e}')" for k, best in enumerate(BEST) for (b, a), (c, e) in best.items())

SQL = f"""
WITH RECURSIVE bits(n, v, k) AS (
  SELECT n, n, 0 FROM (SELECT unnest(range(256))::UBIGINT AS n)
  UNION ALL SELECT n, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8
), crc AS (
  SELECT list(v ORDER BY n) AS t FROM bits WHERE k = 8
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ord(c)::UBIGINT) AS letters
  FROM conversations
), fated AS (
  SELECT conv_id, turn, role, text,
         xor(list_reduce(letters, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::BIGINT + 1]), 4294967295::UBIGINT), 4294967295::UBIGINT) % 20 AS fate
  FROM keyed, crc
), rows AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE WHEN fate = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM fated WHERE fate <> 0
), placed AS (
  SELECT *, left(role, 1) AS initial, row_number() OVER w AS k, lag(left(role, 1)) OVER w AS before,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || ':' || text), copy) > 1 AS again,
         regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS bare
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || ':' || text), copy)
), judged AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM placed
), kinds AS (
  SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 0 ELSE 1 + CASE initial WHEN 's' THEN 0 WHEN 'u' THEN 1 WHEN 'a' THEN 2 ELSE 3 END + CASE WHEN fault = 'truncated' THEN 4 ELSE 0 END END AS kind
  FROM judged
), options(kind, b, a, c, e) AS (
  VALUES {_OPTIONS}
), walk(conv_id, k, state, cost, edits) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, 0, 0, [] ::VARCHAR[] FROM conversations
  UNION ALL
  SELECT conv_id, k, a, best.cost, best.edits FROM (
    SELECT w.conv_id, r.k, o.a, min({{'cost': w.cost + o.c, 'audit': array_to_string(w.edits, '') || o.e, 'edits': list_append(w.edits, o.e)}}) AS best
    FROM walk w JOIN kinds r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.k = w.k + 1 JOIN options o ON o.kind = r.kind AND o.b = w.state
    GROUP BY ALL
  )
), ended AS (
  SELECT w.conv_id, min({{'cost': cost + CASE state WHEN 1 THEN 10 WHEN 2 THEN 5 ELSE 0 END,
                         'audit': array_to_string(edits, '') || CASE state WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END, 'edits': edits, 'state': state}}) AS best
  FROM walk w JOIN (SELECT conv_id, max(k) AS k FROM walk GROUP BY 1) l ON l.conv_id IS NOT DISTINCT FROM w.conv_id AND l.k = w.k GROUP BY 1
), steps AS (
  SELECT conv_id, unnest(best.edits) AS e, unnest(range(1, len(best.edits) + 1)) AS k FROM ended
  UNION ALL SELECT conv_id, CASE best.state WHEN 1 THEN 'II' ELSE 'I' END, 9223372036854775807 FROM ended WHERE best.state IN (1, 2)
), letters AS (
  SELECT conv_id, k, unnest(string_split(e, '')) AS e, unnest(range(1, length(e) + 1)) AS i FROM steps
), lines AS (
  SELECT l.conv_id, l.k, l.i, l.e, r.role, r.text, coalesce(r.initial = 's' AND l.e = 'K', false) AS opens
  FROM letters l LEFT JOIN kinds r ON r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.k = l.k WHERE l.e <> 'D'
), spoken AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY k, i) - CASE WHEN bool_or(opens) OVER (PARTITION BY conv_id) THEN 1 ELSE 0 END AS nth FROM lines
), texts AS (
  SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role ELSE CASE WHEN nth % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY k, i) AS said
  FROM spoken GROUP BY 1
), figures AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank')::BIGINT AS blank,
         count(*) FILTER (fault = 'duplicate')::BIGINT AS duplicate, count(*) FILTER (fault = 'truncated')::BIGINT AS truncated,
         count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal
  FROM kinds GROUP BY 1
)
SELECT e.conv_id, coalesce(f.gaps, 0) AS gaps, coalesce(f.blank, 0) AS blank, coalesce(f.duplicate, 0) AS duplicate, coalesce(f.truncated, 0) AS truncated,
       coalesce(f.illegal, 0) AS illegal, e.best.cost::BIGINT AS cost, e.best.audit AS audit, sha256(coalesce(t.said, '')) AS repaired_sha256
FROM ended e LEFT JOIN figures f ON f.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM e.conv_id
"""
