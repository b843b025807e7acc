"""Repair of conversations by the cheapest edits, found by Viterbi search with survivor coalescence.

A conversation should be an optional system row and then user, assistant, user,
assistant ... Rows may be kept, given the other role, or deleted, and rows
without text may be inserted; blank and repeated rows have to go. The search
walks the rows in order. For each state of the pattern it keeps the cheapest
edits that lead there (the survivor); of two that cost the same, the one whose
edits' initials come first.

Survivors are leaves of a tree of back pointers whose nodes count their
references. What has lost its last leaf is dropped, and once all survivors share
an ancestor the edits up to it are certain: they are emitted, hashed, and their
rows forgotten. Survivors that cannot win whatever follows are dropped too, or
the path that deletes all rows would keep the tree from ever closing. So memory
holds the undecided rows only, not the conversation. A tie is settled by the
complete undecided suffixes: their order is carried from row to row, and it is
total, since two suffixes that end in an edit of the same row never extend one
another (further insertions would cost more).

Rows reach the search sorted, in batches, and a conversation is never gathered
in memory, even if it has a third of all rows. It is one stream in one task all
the same, because its answer holds one SHA-256 over all repaired rows, which
can't be worked out in parts. What is cut is what comes before: equal rows are
counted together, and the first place of a text is an aggregate.

Nulls: a null in conv_id or turn counts as one space where the damage is chosen,
a null role or text is one space; a null conv_id is a conversation of its own;
null turns come first. Empty texts are blank. Rows that repeat a turn, role and
text are duplicates of one another; rows with one turn stand in order of role
and text. Conversations without a row left have zeros. An empty table gives an
empty table. Very long texts are carried as they are; other columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from recordloom.llm.common import stored
from recordloom.session import table

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
TRUNCATED_COST = 1
ROLES = {"u": "user", "a": "assistant"}
#: States of the pattern: nothing yet, system, user, assistant. It may end in the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
OTHER = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}       # what may be inserted or given
MOST_INSERTS = 2                                                     # more come back to a state passed
SETTLE = 64                                                          # nodes between looks for a common ancestor

#: How much more than the second at most the first has to cost until the end, whatever follows.
BEHIND = {(ASSISTANT, START): 3, (USER, START): 5, (ASSISTANT, SYSTEM): 0, (USER, SYSTEM): 2, (ASSISTANT, USER): 2, (USER, ASSISTANT): 2, (START, ASSISTANT): 4, (START, USER): 2}


def _moves(initial: str, must_go: bool, truncated: bool) -> list[list[tuple[int, int, str]]]:
    """For each state, (target, cost, edits) of all ways past a row; the last edit is that of the row."""
    out = []
    for state in range(4):
        ways, at = [], state
        for k in range(MOST_INSERTS + 1):
            before, paid = INSERT * k, COST[INSERT] * k
            ways.append((at, paid + COST[DELETE], before + DELETE))
            if not must_go:
                more = TRUNCATED_COST * truncated
                if (to := STEP.get((at, initial))) is not None:
                    ways.append((to, paid + COST[KEEP] + more, before + KEEP))
                ways.append((STEP[at, OTHER[at]], paid + COST[REROLE] + more, before + REROLE))
            at = STEP[at, OTHER[at]]
        out.append(ways)
    return out


class _Node:
    __slots__ = ("edits", "parent", "refs", "row", "state")

    def __init__(self, parent, state, edits, row):
        self.parent, self.state, self.edits, self.row, self.refs = parent, state, edits, row, 0
        if parent is not None:
            parent.refs += 1


def _drop(node: _Node | None) -> None:
    while node is not None:
        node.refs -= 1
        if node.refs:
            return
        above, node.parent = node.parent, None
        node = above


class Repair:
    """The search over the rows of one conversation; ``row`` by ``row``, then ``end``."""

    _known: dict[tuple, list] = {}

    def __init__(self):
        self.root = _Node(None, START, "", None)
        self.root.refs = 1
        self.alive = [(START, 0, self.root)]       # (state, cost, node), in order of their complete suffixes
        self.count = 0
        self.most = 0
        self.audit: list[str] = []
        self.hash = hashlib.sha256()
        self.lines = 0

    def row(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        key = (role[:1] if role[:1] in ("s", "u", "a") else "", must_go, truncated)
        moves = self._known.get(key)
        if moves is None:
            moves = self._known[key] = _moves(*key)
        best: dict[int, tuple] = {}
        for rank, (state, cost, node) in enumerate(self.alive):
            for to, paid, edits in moves[state]:
                found = (cost + paid, rank, edits)
                if to not in best or found < best[to][0]:
                    best[to] = (found, node)
        order = sorted(best, key=lambda to: best[to][0][1:])
        costs = {to: best[to][0][0] for to in order}
        order = [to for to in order if not any((by, to) in BEHIND and costs[to] > costs[by] + BEHIND[by, to] for by in costs)]
        alive = []
        for to in order:
            (cost, _, edits), parent = best[to]
            node = _Node(parent, to, edits, (role, text))
            node.refs += 1
            alive.append((to, cost, node))
        for _, _, node in self.alive:
            _drop(node)
        self.alive = alive
        self.count += 1
        if self.count >= SETTLE:
            self._settle()

    def _settle(self) -> None:
        """Emits what all survivors have in common."""
        path, node = [], self.alive[0][2]
        while node is not self.root:
            path.append(node)
            node = node.parent
        self.most = max(self.most, len(path))
        leaves = {id(n) for _, _, n in self.alive}
        while path and self.root.refs == 1 and id(self.root) not in leaves:
            self._emit(self.root.state, path[-1])
            self.root = path.pop()
            self.root.parent = None
        self.count = -len(path)        # looks are spaced by what is undecided, so they cost a constant a row

    def _line(self, role: str, text: str) -> None:
        self.hash.update(("\n" * bool(self.lines) + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.lines += 1

    def _emit(self, state: int, node: _Node) -> None:
        self.audit.append(node.edits)
        for edit in node.edits:
            if edit == DELETE:
                continue
            initial = node.row[0][:1] if edit == KEEP else OTHER[state]
            self._line(node.row[0] if edit == KEEP else ROLES[initial], "" if edit == INSERT else node.row[1])
            state = STEP[state, initial]

    def end(self) -> tuple[int, str, str]:
        """(cost, audit, SHA-256 of the repaired rows)."""
        ways = []
        for rank, (state, cost, node) in enumerate(self.alive):
            edits = ""
            while state not in ENDS:
                edits, cost, state = edits + INSERT, cost + COST[INSERT], STEP[state, OTHER[state]]
            ways.append((cost, rank, edits, node))
        cost, _, edits, node = min(ways, key=lambda w: w[:2])
        self.alive = [(node.state, cost, node)]
        path, at = [], node
        while at is not self.root:
            path.append(at)
            at = at.parent
        for step in reversed(path):
            self._emit(self.root.state, step)
            self.root = step
        if edits:
            self._emit(node.state, _Node(None, node.state, edits, None))
        return cost, "".join(self.audit), self.hash.hexdigest()


class _Conversation:
    """Counts and repair of one conversation."""

    def __init__(self):
        self.repair = Repair()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.last = self.low = self.high = None

    def add(self, turn, role, text, times, blank, first, truncated):
        if turn is not None:
            self.turns += self.high is None or turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        for k in range(times):
            again = bool(k) or not first
            self.blank += blank
            self.duplicate += again and not blank
            self.truncated += truncated and not (blank or again)
            initial = role[:1]
            self.illegal += self.last is not None and self.last + initial not in ("su", "ua", "au")
            self.last = initial
            self.repair.row(role, text, blank or again, truncated)

    def result(self):
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, *self.repair.end()


def _repaired(batches):
    """Sorted rows to one row a conversation."""
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    current, state, kind, out = None, None, None, []

    def flush():
        columns = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *[pa.array(c, pa.int64()) for c in columns[1:7]], pa.array(columns[7]), pa.array(columns[8])], names=names)

    for batch in batches:
        kind = batch.schema.field(0).type
        for conv, *row in zip(*batch.columns, strict=True):
            conv = conv.as_py()
            if state is None or conv != current:
                if state is not None:
                    out.append((current, *state.result()))
                current, state = conv, _Conversation()
                if len(out) >= 1_000:
                    yield flush()
                    out = []
            turn, role, text, times, blank, first, truncated = (x.as_py() for x in row)
            if times:
                state.add(turn, role, text, times, blank, first, truncated)
    if state is not None:
        out.append((current, *state.result()))
        yield flush()


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) as they arrive: conv_id, turn, role, text, times; dropped rows have times 0."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    step = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), case.alias("_case"))
    text = F.when(F.col("_case") <= 1, "").when(F.col("_case") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_case") == 0, "").when(F.col("_case") == 4, "user").otherwise(F.col("role"))
    return step.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("_case") == 0, 0).when(F.col("_case") == 3, 2).otherwise(1).alias("times"))


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256
    for each conv_id of ``rows`` (conv_id, turn, role, text, times)."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    some = stored(rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("times").alias("times")).withColumn("_said", digest), "rows")
    null = F.col("turn").isNull()
    firsts = some.where("times > 0").groupBy("conv_id", "_said").agg(F.max(null).alias("_null"), F.min("turn").alias("_turn"))
    firsts = firsts.select(F.col("conv_id").alias("_conv"), F.col("_said").alias("_first"), "_null", "_turn")
    met = some.join(firsts.hint("merge"), F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_said") == F.col("_first")), "left")
    blank = ~F.col("text").rlike("[^ \\x09-\\x0D]")
    first = F.when(F.col("_null"), null).otherwise(F.coalesce(F.col("turn") == F.col("_turn"), F.lit(False)))
    truncated = ~blank & ~F.col("text").rlike("[.!?][ \\x09-\\x0D]*\\z")
    told = met.select("conv_id", "turn", "role", "text", "times", blank.alias("blank"), F.coalesce(first, F.lit(False)).alias("first"), truncated.alias("truncated"))
    told = told.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    return told.mapInArrow(_repaired, f"conv_id {kind}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(damaged(table(spark, sf_dir, "conversations")))


_BYTE = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, (y & 1) * 3988292384))"
_CRC = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda ch: ord(ch)::BIGINT)), lambda c, b: {_BYTE}), 4294967295)"

OP12_SQL = f"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' ')) AS key FROM conversations
), c AS (
  SELECT conv_id, turn, role, text, {_CRC} % 20 AS kind FROM k
), d AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM c WHERE kind <> 0
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, encode(role), encode(text), copy) AS i, left(role, 1) AS initial FROM d
), m AS (
  SELECT *, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
         NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS open, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM n
), told AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
         count(*) FILTER (open AND NOT blank AND NOT again) AS truncated, count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS rows
  FROM m GROUP BY conv_id
), inserts(state, k, target, lines) AS (
  -- states: 0 nothing, 1 system, 2 user, 3 assistant
  VALUES (0, 0, 0, ''), (0, 1, 2, chr(10) || 'user:'), (0, 2, 3, chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 0, 1, ''), (1, 1, 2, chr(10) || 'user:'), (1, 2, 3, chr(10) || 'user:' || chr(10) || 'assistant:'),
         (2, 0, 2, ''), (2, 1, 3, chr(10) || 'assistant:'), (2, 2, 2, chr(10) || 'assistant:' || chr(10) || 'user:'), (3, 0, 3, ''), (3, 1, 2, chr(10) || 'user:'), (3, 2, 3, chr(10) || 'user:' || chr(10) || 'assistant:')
), best(conv_id, i, state, way) AS (
  SELECT conv_id, 0::BIGINT, 0, {{'cost': 0::BIGINT, 'audit': '', 'out': ''}} FROM told
  UNION ALL
  SELECT conv_id, i, state, min(way) FROM (
    SELECT b.conv_id, m.i, e.state, {{'cost': b.way.cost + 2 * x.k + e.cost, 'audit': b.way.audit || repeat('I', x.k) || e.edit, 'out': b.way.out || x.lines || e.line}} AS way
    FROM best b JOIN inserts x ON x.state = b.state JOIN m ON m.conv_id IS NOT DISTINCT FROM b.conv_id AND m.i = b.i + 1,
    LATERAL (
      SELECT x.target AS state, 3 AS cost, 'D' AS edit, '' AS line
      UNION ALL SELECT CASE m.initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, m.open::INTEGER, 'K', chr(10) || m.role || ':' || m.text
      WHERE NOT m.blank AND NOT m.again AND (m.initial = 's' AND x.target = 0 OR m.initial = 'u' AND x.target <> 2 OR m.initial = 'a' AND x.target = 2)
      UNION ALL SELECT CASE x.target WHEN 2 THEN 3 ELSE 2 END, 2 + m.open::INTEGER, 'R', chr(10) || CASE x.target WHEN 2 THEN 'assistant' ELSE 'user' END || ':' || m.text
      WHERE NOT m.blank AND NOT m.again
    ) e
  ) GROUP BY conv_id, i, state
), ends AS (
  SELECT b.conv_id, min({{'cost': b.way.cost + 2 * x.k, 'audit': b.way.audit || repeat('I', x.k), 'out': b.way.out || x.lines}}) AS way
  FROM best b JOIN told t ON t.conv_id IS NOT DISTINCT FROM b.conv_id AND t.rows = b.i JOIN inserts x ON x.state = b.state AND x.target IN (0, 3) GROUP BY b.conv_id
)
SELECT o.conv_id, coalesce(t.gaps, 0)::BIGINT AS gaps, coalesce(t.blank, 0)::BIGINT AS blank, coalesce(t.duplicate, 0)::BIGINT AS duplicate, coalesce(t.truncated, 0)::BIGINT AS truncated,
       coalesce(t.illegal, 0)::BIGINT AS illegal, coalesce(e.way.cost, 0)::BIGINT AS cost, coalesce(e.way.audit, '') AS audit, sha256(coalesce(e.way.out[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""
