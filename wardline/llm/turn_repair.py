"""Conversation structure repair: the cheapest edits that give a conversation the form ``(s?(ua)+)?``.

The turns of a conversation become symbols. They are aligned to each feasible length of the alternating target (nothing,
user assistant user assistant ..., and the same behind a system turn) by the Wagner-Fischer recurrence. A length is feasible, and
a cell within Ukkonen's band, if the difference in length alone costs no more than the cheapest alignment found so far. Of
alignments that cost the same, the one with the ASCII-least audit of edits stays; the audits come from the backtrace.

A conversation of more than ``PIECE`` turns is cut into pieces. Each is aligned for every role it may begin after and end
with, and neighbours are joined by the cheapest sum. That loses nothing: audits of the same turns at the same cost differ
before either ends, so the least whole is made of least parts. Pieces are aligned where their rows are; what is joined per conversation
is its audit, so no task holds the texts of a conversation, however long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from wardline.llm.frames import ready, written

# Symbols of turns by initial of the role (system, user, assistant, other): sound, truncated, and to be deleted.
SOUND, TRUNCATED, GONE = "suao", "SUAO", "1234"
DELETE, RENAME, INSERT, CUT = 2, 1, 5, 5
# What a conversation has last: nothing, a system, a user, an assistant turn. It may end with the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
PIECE = 32
# Rows of a conversation in one segment, at most, as a power of two.
SEGMENT_BITS = 12
NEVER = 1 << 40

Way = tuple[int, str]


def _targets(entry: int, leave: int, longest: int) -> Iterator[str]:
    """The target strings of up to ``longest`` turns that lead from one state to the other."""
    turn = "a" if entry == USER else "u"
    if entry == leave:
        yield ""
    for lead in ("", "s") if entry == START else ("",):
        if lead and leave == SYSTEM:
            yield lead
        for size in range(1, longest + 1 - len(lead)):
            body = (turn + ("u" if turn == "a" else "a")) * (size // 2) + turn * (size % 2)
            if leave == (USER if body[-1] == "u" else ASSISTANT):
                yield lead + body


def _aligned(turns: str, target: str, most: int) -> Way | None:
    """The cheapest alignment to one target that costs ``most`` or less, with the least audit."""
    n, m = len(turns), len(target)
    before = [0]  # turns that may stay, among the first i
    for symbol in turns:
        before.append(before[-1] + (symbol not in GONE))
    apart = m - before[n]
    slack = most - DELETE * (n - before[n]) - (INSERT * apart if apart > 0 else -DELETE * apart)
    if slack < 0:
        return None
    wide = slack // (INSERT + DELETE)
    low, high = min(0, apart) - wide, max(0, apart) + wide
    # rest[i][j]: the cost of the turns from i on against the target from j on.
    rest = [[NEVER] * (m + 2) for _ in range(n + 2)]
    for i in range(n, -1, -1):
        after, own = rest[i + 1], rest[i]
        symbol = turns[i] if i < n else ""
        kind = SOUND.find(symbol) if i < n else -1
        extra = 0
        if i < n and kind < 0:
            kind, extra = TRUNCATED.find(symbol), CUT
        role = SOUND[kind] if kind >= 0 else ""
        for j in range(min(m, before[i] + high), max(0, before[i] + low) - 1, -1):
            cost = (0 if j == m else NEVER) if i == n else DELETE + after[j]
            if j < m:
                if target[j] != "s":
                    cost = min(cost, INSERT + own[j + 1])
                if role == target[j]:
                    cost = min(cost, extra + after[j + 1])
                elif role and target[j] != "s":
                    cost = min(cost, RENAME + extra + after[j + 1])
            own[j] = cost
    total = rest[0][0]
    if total > most:
        return None
    audit, i, j = [], 0, 0
    while i < n or j < m:
        left = rest[i][j]
        if i < n and DELETE + rest[i + 1][j] == left:
            audit.append("D")
            i += 1
        elif j < m and target[j] != "s" and INSERT + rest[i][j + 1] == left:
            audit.append("I")
            j += 1
        else:
            audit.append("K" if SOUND[(SOUND + TRUNCATED).index(turns[i]) % 4] == target[j] else "R")
            i, j = i + 1, j + 1
    return total, "".join(audit)


@lru_cache(maxsize=1 << 16)
def best(turns: str, entry: int = START, leaves: tuple[int, ...] = ENDS) -> Way | None:
    """The cheapest way through a piece, from what stands before it to one of the states behind it."""
    stay = sum(s not in GONE for s in turns)
    found: Way | None = None
    # Deleting all turns and writing up to two costs no more than this.
    most = DELETE * len(turns) + 2 * INSERT
    longest = stay + most // INSERT + 1
    every = {t for leave in leaves for t in _targets(entry, leave, longest)}

    def least(target: str) -> int:
        apart = len(target) - stay
        return INSERT * apart if apart > 0 else -DELETE * apart

    for target in sorted(every, key=lambda t: (least(t), t)):
        if least(target) + DELETE * (len(turns) - stay) > most:
            break
        way = _aligned(turns, target, most)
        if way is not None and (found is None or way < found):
            found, most = way, way[0]
    return found


Ways = dict[tuple[int, int], Way]


@lru_cache(maxsize=1 << 12)
def _piece(turns: str) -> Ways:
    made = {}
    for entry in range(4):
        for leave in range(entry and 1, 4):
            way = best(turns, entry, (leave,))
            if way is not None:
                made[entry, leave] = way
    return made


def _joined(left: Ways, right: Ways) -> Ways:
    made: Ways = {}
    for (a, b), (cost, audit) in left.items():
        for (c, d), (more, rest) in right.items():
            if b == c and ((a, d) not in made or cost + more <= made[a, d][0]):
                way = cost + more, audit + rest
                made[a, d] = min(way, made.get((a, d), way))
    return made


def _folded(parts: list[Ways]) -> Ways:
    """Neighbours are joined in rounds, so the audits are copied a few times only."""
    while len(parts) > 1:
        parts = [_joined(*parts[i:i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def ways_of(turns: str, alone: bool) -> Ways:
    """All ways through a run of turns; ``alone`` if it is the whole conversation."""
    if alone and len(turns) <= PIECE:
        way = best(turns)
        return {(START, ASSISTANT if way[1].strip("D") else START): way}
    return _folded([_piece(turns[i:i + PIECE]) for i in range(0, len(turns), PIECE)])


def _cheapest(ways: Ways) -> tuple[Way, int]:
    return min((way, leave) for (entry, leave), way in ways.items() if entry == START and leave in ENDS)


def _role(symbol: str) -> str:
    return SOUND[(SOUND + TRUNCATED + GONE).index(symbol) % 4]


def illegal_pairs(turns: str) -> int:
    roles = [_role(s) for s in turns]
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False))


def _walk(turns: str, audit: str, state: int) -> Iterator[tuple[int, str, str | None, int]]:
    """(turn's place or -1, edit, new role, state behind it) of each edit but deletions; a last row has the state only."""
    at = 0
    for edit in audit:
        if edit == "D":
            at += 1
            continue
        if edit == "K":
            state = "sua".index(_role(turns[at])) + 1
        else:
            state = ASSISTANT if state == USER else USER
        role = {USER: "user", ASSISTANT: "assistant"}.get(state) if edit != "K" else None
        yield (-1 if edit == "I" else at), edit, role, state
        at += edit != "I"


def damaged(turns: DataFrame) -> DataFrame:
    """The rows of a conversations table with planted faults: (conv_id, turn, role, text), NULL roles and texts are one space.

    By crc32 of ``conv_id:turn`` (NULLs as one space) modulo 20, 0 drops a row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it,
    4 makes it the user's.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), space))
    fault = F.crc32(key.cast("binary")) % 20
    text = F.coalesce(F.col("text").cast("string"), space)
    return (
        turns.select(
            "conv_id", "turn",
            F.when(fault == 4, "user").otherwise(F.coalesce(F.col("role").cast("string"), space)).alias("role"),
            F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
            F.explode(F.when(fault == 0, F.array().cast("array<int>")).when(fault == 3, F.array(F.lit(0), F.lit(1)))
                      .otherwise(F.array(F.lit(0)))).alias("__copy"))
        .drop("__copy")
    )


def _symbols(rows: DataFrame) -> DataFrame:
    """Rows in order, numbered, with the first fault and the symbol of each."""
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    ordered = rows.repartitionByRange("conv_id", "turn", "role", "text").sortWithinPartitions(
        "conv_id", "turn", "role", "text").withColumn("at", F.monotonically_increasing_id())
    ordered = written(ordered, "turns")
    # The first row of each role and text by its number: rows are joined by a key of their own, which no text can make hot.
    first = ordered.groupBy("conv_id", "role", F.sha2("text", 256)).agg(F.min("at").alias("at")).select(
        "at", F.lit(True).alias("__first"))
    fault = (
        F.when(blank, "blank").when(F.col("__first").isNull(), "duplicate")
        .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated")
    )

    def symbol(letters: str) -> Column:
        initial = F.substring("role", 1, 1)
        return (F.when(initial == "s", letters[0]).when(initial == "u", letters[1]).when(initial == "a", letters[2])
                .otherwise(letters[3]))

    return ordered.join(first, "at", "left").withColumn("fault", fault).withColumn(
        "symbol", F.when(F.col("fault").isNull(), symbol(SOUND)).when(F.col("fault") == "truncated", symbol(TRUNCATED))
        .otherwise(symbol(GONE)))


_WAYS = pa.list_(pa.struct([("entry", pa.int32()), ("leave", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
_PLAN = pa.list_(pa.struct([
    ("first_at", pa.int64()), ("turns", pa.string()), ("audit", pa.string()), ("entry", pa.int32()), ("before", pa.int64())]))
_WAYS_TYPE = "array<struct<entry:int,leave:int,cost:bigint,audit:string>>"
_PLAN_TYPE = "array<struct<first_at:bigint,turns:string,audit:string,entry:int,before:bigint>>"


def _made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ways through each segment."""
    for batch in batches:
        held = batch.to_pydict()
        ways = [
            [{"entry": a, "leave": b, "cost": c, "audit": audit} for (a, b), (c, audit) in ways_of(turns, alone).items()]
            for turns, alone in zip(held["turns"], held["alone"], strict=True)]
        names = ("conv_id", "first_at", "turns")
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(batch.schema.get_field_index(n)) for n in names), pa.array(ways, _WAYS)], [*names, "ways"])


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A conversation's audit from the ways through its segments, and each segment's share of it."""
    for batch in batches:
        costs, audits, illegal, plans = [], [], [], []
        for parts in batch.column(1).to_pylist():
            folded = _folded([{(w["entry"], w["leave"]): (w["cost"], w["audit"]) for w in p["ways"]} for p in parts])
            (cost, audit), _ = _cheapest(folded)
            bad, last, at, state, before, plan = 0, "", 0, START, 0, []
            for part in parts:
                turns, begin, seen = part["turns"], at, 0
                bad += illegal_pairs(last + turns)
                last = turns[-1]
                while seen < len(turns):
                    seen += audit[at] != "I"
                    at += 1
                # Turns written behind the last segment are its own; elsewhere they may as well go to the next one.
                at = len(audit) if part is parts[-1] else at
                share = audit[begin:at]
                plan.append({"first_at": part["first_at"], "turns": turns, "audit": share, "entry": state, "before": before})
                for *_, state in _walk(turns, share, state):
                    before += 1
            costs.append(cost)
            audits.append(audit)
            illegal.append(bad)
            plans.append(plan)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(costs, pa.int64()), pa.array(audits, pa.string()), pa.array(illegal, pa.int64()),
             pa.array(plans, _PLAN)], ["conv_id", "cost", "audit", "illegal", "plan"])


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each turn of the repaired conversation: its number, its row's number (NULL for new turns), edit, new role."""
    names = ["conv_id", "position", "at", "edit", "new_role"]
    kinds = [None, pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        ids, parts = batch.column(0), batch.column(1).to_pylist()
        for low in range(0, len(parts), 256):
            owner: list[int] = []
            out: list[list] = [[], [], [], []]
            for i, part in enumerate(parts[low:low + 256], low):
                walk = _walk(part["turns"], part["audit"], part["entry"])
                for place, (k, edit, role, _) in enumerate(walk, part["before"]):
                    owner.append(i)
                    for held, value in zip(out, (place, part["first_at"] + k if k >= 0 else None, edit, role), strict=True):
                        held.append(value)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(owner, pa.int64())), *(pa.array(v, k) for v, k in zip(out, kinds[1:], strict=True))], names)


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(audits, repaired turns) of rows (conv_id, turn, role, text).

    Audits: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, one row for each conversation. A turn's first fault counts:
    blank, duplicate (role and text seen earlier in the conversation), truncated (the last character that isn't ASCII white space is none of ``.!?``).
    Repaired: conv_id, position, turn, role, text, edit (K kept, R other role, I new with an empty text and no turn number).

    Turns are ordered by number, then role, then text, NULLs first; rows that agree in all of them are repeated turns, of which
    the first is no duplicate. A NULL role or text counts as one space. Rows without conv_id are a conversation of their own. A
    role's initial decides; other roles must be renamed or deleted. A conversation of which nothing can stay has audits of
    deletions and no repaired turn. An empty table gives empty ones. Other columns are not read.
    """
    ready(turns.sparkSession)
    space = F.lit(" ")
    rows = turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), space).alias("role"),
        F.coalesce(F.col("text").cast("string"), space).alias("text"))
    rows = written(_symbols(rows), "turn-symbols")
    id_field = StructField("conv_id", rows.schema["conv_id"].dataType)

    segments = rows.groupBy("conv_id", F.shiftright("at", SEGMENT_BITS).alias("segment")).agg(
        F.min("at").alias("first_at"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "symbol"))), lambda r: r["symbol"]), "")
        .alias("turns"))
    segments = segments.withColumn("alone", F.count("*").over(Window.partitionBy("conv_id")) == 1)
    made = segments.select("conv_id", "first_at", "turns", "alone").mapInArrow(_made, StructType([
        id_field, StructField("first_at", LongType()), StructField("turns", StringType()),
        *_fields(f"ways {_WAYS_TYPE}")]))
    chains = made.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("first_at", "turns", "ways"))).alias("parts"))
    plans = written(chains.mapInArrow(_chained, StructType([
        id_field, *_fields(f"cost long, audit string, illegal long, plan {_PLAN_TYPE}")])), "turn-plans")

    counts = rows.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        *(F.count(F.when(F.col("fault") == name, 1)).alias(name) for name in ("blank", "duplicate", "truncated")))
    same = F.col("a.conv_id").eqNullSafe(F.col("b.conv_id"))
    audits = counts.alias("a").join(plans.alias("b"), same).select(
        "a.conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    edits = plans.select("conv_id", F.explode("plan").alias("part")).mapInArrow(_edited, StructType([
        id_field, *_fields("position long, at long, edit string, new_role string")]))
    repaired = edits.join(rows.select("at", "turn", "role", "text"), "at", "left").select(
        "conv_id", "position", "turn", F.coalesce("new_role", "role").alias("role"),
        F.coalesce("text", F.lit("")).alias("text"), "edit")
    return audits, repaired


def _fields(kinds: str) -> list[StructField]:
    return StructType.fromDDL(kinds).fields


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256, of ``role:text`` of its turns joined by newlines. The sorted turns are hashed as a stream, so
    a task holds a batch of turns, not a conversation."""
    ready(repaired.sparkSession)
    schema = StructType([repaired.schema["conv_id"], StructField("repaired_sha256", StringType())])
    kind = repaired.select("conv_id").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, owner, any_row, arrow = None, None, False, None
        ids: list = []
        sums: list[str] = []

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(ids, arrow), pa.array(sums, pa.string())], schema.names)
            ids.clear()
            sums.clear()
            return made

        for batch in batches:
            arrow = batch.schema.field(0).type
            for name, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if any_row and name == owner:
                    state.update(b"\n")
                else:
                    if any_row:
                        ids.append(owner)
                        sums.append(state.hexdigest())
                    state, owner, any_row = hashlib.sha256(), name, True
                state.update(line.encode("utf-8", "surrogatepass"))
            if len(ids) > 4096:
                yield out()
        if any_row:
            ids.append(owner)
            sums.append(state.hexdigest())
            yield out()

    lines = repaired.select(*kind.names, "position", F.concat("role", F.lit(":"), "text").alias("line"))
    return lines.repartition("conv_id").sortWithinPartitions("conv_id", "position").select("conv_id", "line").mapInArrow(
        run, schema)


ORACLE = r"""
WITH RECURSIVE base AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k
  FROM conversations
), hashed AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(
    list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT),
    lambda crc, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
      lambda r, z: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384::BIGINT) ELSE r >> 1 END, xor(crc, b)),
    4294967295::BIGINT), 4294967295::BIGINT) % 20 AS h
  FROM base
), hurt AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT * FROM hashed WHERE h <> 0 UNION ALL SELECT * FROM hashed WHERE h = 3)
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n, role[1] AS i
  FROM hurt
), seen AS (
  SELECT *, n > min(n) OVER (PARTITION BY conv_id, role, text) AS again FROM ordered
), rows AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN again THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault,
    lag(i) OVER (PARTITION BY conv_id ORDER BY n) || i AS pair
  FROM seen
), counts AS (
  SELECT conv_id, count(*) AS size, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (n > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows GROUP BY conv_id
), walk AS (
  SELECT conv_id, 0::BIGINT AS n, {'c': 0, 'a': '', 'r': ''} AS q, {'c': 9999999, 'a': '', 'r': ''} AS s,
    {'c': 5, 'a': 'I', 'r': chr(10) || 'user:'} AS u,
    {'c': 10, 'a': 'II', 'r': chr(10) || 'user:' || chr(10) || 'assistant:'} AS a
  FROM counts
  UNION ALL
  SELECT conv_id, n, q, s, u2,
    list_min([a1, {'c': u2.c + 5, 'a': u2.a || 'I', 'r': u2.r || chr(10) || 'assistant:'}]) AS a
  FROM (
    SELECT *, list_min([u1, {'c': q.c + 5, 'a': q.a || 'I', 'r': q.r || chr(10) || 'user:'},
      {'c': s.c + 5, 'a': s.a || 'I', 'r': s.r || chr(10) || 'user:'},
      {'c': a1.c + 5, 'a': a1.a || 'I', 'r': a1.r || chr(10) || 'user:'}]) AS u2
    FROM (
      SELECT w.conv_id, r.n,
        {'c': q.c + 2, 'a': q.a || 'D', 'r': q.r} AS q,
        list_min([{'c': s.c + 2, 'a': s.a || 'D', 'r': s.r},
          {'c': q.c + CASE WHEN i = 's' THEN p ELSE 9999999 END, 'a': q.a || 'K', 'r': q.r || t}]) AS s,
        list_min([{'c': u.c + 2, 'a': u.a || 'D', 'r': u.r},
          {'c': q.c + p + (i <> 'u')::INT, 'a': q.a || eu, 'r': q.r || tu},
          {'c': s.c + p + (i <> 'u')::INT, 'a': s.a || eu, 'r': s.r || tu},
          {'c': a.c + p + (i <> 'u')::INT, 'a': a.a || eu, 'r': a.r || tu}]) AS u1,
        list_min([{'c': a.c + 2, 'a': a.a || 'D', 'r': a.r},
          {'c': u.c + p + (i <> 'a')::INT, 'a': u.a || CASE WHEN i = 'a' THEN 'K' ELSE 'R' END,
            'r': u.r || CASE WHEN i = 'a' THEN t ELSE chr(10) || 'assistant:' || text END}]) AS a1
      FROM walk w JOIN (
        SELECT conv_id, n, i, text, chr(10) || role || ':' || text AS t, CASE WHEN i = 'u' THEN 'K' ELSE 'R' END AS eu,
          CASE WHEN i = 'u' THEN chr(10) || role || ':' || text ELSE chr(10) || 'user:' || text END AS tu,
          CASE fault WHEN '' THEN 0 WHEN 'truncated' THEN 5 ELSE 9999999 END AS p FROM rows
      ) r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.n = w.n + 1
    )
  )
), ended AS (
  SELECT c.*, list_min([w.q, w.a]) AS b
  FROM counts c JOIN walk w ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.size = w.n
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.c, 0)::BIGINT AS cost,
  coalesce(b.a, '') AS audit, sha256(substr(coalesce(b.r, ''), 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN ended e ON o.conv_id IS NOT DISTINCT FROM e.conv_id"""
