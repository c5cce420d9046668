"""Conversation structure repair by a survivor-coalescence Viterbi decoder.

A repaired conversation's roles read ``(s?(ua)+)?``.  The cheapest edits that
get there are the best path through four states (nothing said, after a system
row, after a user row, after an assistant row).  The decoder reads a
conversation's rows once, in order.  It keeps one survivor for each state, as
a tree of backpointers with reference counts: nodes that no survivor needs are
freed, and edits that all survivors share are final, so they are emitted and
their texts forgotten.  Equally cheap survivors are told apart by their whole
unresolved edits, back to where they part.  A survivor that another one can
follow for less is dropped, so survivors meet soon; memory is the edits on
which the survivors still differ.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmon.llm.common import WHITE

#: States: nothing said yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where a row of a role leads from each state; others are not allowed.
_NEXT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
_ROLES = {USER: "user", ASSISTANT: "assistant"}
_EDIT = "conv_id long, step long, edit string, fault string, turn long, role_was string, role string, text string, cost long"


@dataclass(frozen=True)
class Costs:
    """What an edit costs; ``truncated`` is added to a truncated row that is not deleted."""

    keep: int = 0
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


class Node:
    """One edit of a survivor; ``refs`` counts the edits and the states that stand on it."""

    __slots__ = ("parent", "edit", "state", "row", "price", "depth", "refs")

    def __init__(self, parent, edit, state, row, price):
        self.parent, self.edit, self.state, self.row, self.price = parent, edit, state, row, price
        self.depth = parent.depth + 1 if parent is not None else 0
        self.refs = 0
        if parent is not None:
            parent.refs += 1


def _release(node) -> None:
    """Frees ``node`` and those above it that nothing stands on any more."""
    while node is not None and not node.refs:
        parent, node.parent = node.parent, None
        if parent is not None:
            parent.refs -= 1
        node = parent


def _before(a: Node, b: Node) -> bool:
    """Whether the edits up to ``a`` come before those up to ``b`` in the order of strings."""
    longer = a.depth > b.depth
    while a.depth > b.depth:
        a = a.parent
    while b.depth > a.depth:
        b = b.parent
    if a is b:
        return not longer
    while a.parent is not b.parent:
        a, b = a.parent, b.parent
    return a.edit < b.edit


class Decoder:
    """Rows in, edits out; a row is any tuple that the caller gets back with its edit."""

    def __init__(self, costs: Costs = Costs()):
        self.costs = costs
        i, d = costs.insert, costs.delete
        #: (s, t): what following s from t costs more at most, so s is of no use at more than that above t.
        self._follow = {
            (START, ASSISTANT): d, (SYSTEM, ASSISTANT): 0, (ASSISTANT, START): 0, (SYSTEM, START): 0, (USER, START): i,
            (USER, ASSISTANT): i, (ASSISTANT, USER): i, (SYSTEM, USER): i, (START, USER): i + d, (USER, SYSTEM): i,
            (ASSISTANT, SYSTEM): 2 * i, (START, SYSTEM): 2 * i + d,
        }
        self.root = Node(None, "", START, None, 0)
        self.root.refs = 1
        self.best: dict[int, tuple[int, Node]] = {START: (0, self.root)}
        self._inserts(self.best)

    def _offer(self, into: dict, state: int, cost: int, node: Node) -> bool:
        had = into.get(state)
        if had is not None and (had[0] < cost or had[0] == cost and not _before(node, had[1])):
            _release(node)
            return False
        node.refs += 1
        into[state] = (cost, node)
        if had is not None:
            had[1].refs -= 1
            _release(had[1])
        return True

    def _inserts(self, into: dict) -> None:
        """Empty rows of the role that a state waits for; two in a row reach every state."""
        for _ in range(2):
            for state in list(into):
                cost, node = into[state]
                to = ASSISTANT if state == USER else USER
                price = self.costs.insert
                had = into.get(to)
                if had is None or had[0] >= cost + price:
                    self._offer(into, to, cost + price, Node(node, "I", to, None, price))

    def row(self, role: str, fault: str | None, row) -> Iterator[Node]:
        """Takes the next row and gives the edits that became final."""
        c, into = self.costs, {}
        more = c.truncated if fault == "truncated" else 0
        for state, (cost, node) in self.best.items():
            self._offer(into, state, cost + c.delete, Node(node, "D", state, row, c.delete))
            if fault in ("blank", "duplicate"):
                continue
            to = _NEXT.get(role[:1], {}).get(state)
            if to is not None:
                price = c.keep + more
                self._offer(into, to, cost + price, Node(node, "K", to, row, price))
            to, price = ASSISTANT if state == USER else USER, c.rerole + more
            self._offer(into, to, cost + price, Node(node, "R", to, row, price))
        self._inserts(into)
        for _, node in self.best.values():
            node.refs -= 1
            _release(node)
        for (s, t), gap in self._follow.items():
            if s in into and t in into and into[s][0] > into[t][0] + gap:
                node = into.pop(s)[1]
                node.refs -= 1
                _release(node)
        self.best = into
        return self._settled()

    def _settled(self) -> Iterator[Node]:
        """The edits below the root that all survivors share; the last of them is the new root."""
        if self.root.refs != 1 or any(node is self.root for _, node in self.best.values()):
            return
        path, node = [], next(iter(self.best.values()))[1]
        while node is not self.root:
            path.append(node)
            node = node.parent
        standing = {id(node) for _, node in self.best.values()}
        for node in reversed(path):
            yield node
            self.root, node.parent, node.row = node, None, None
            if node.refs != 1 or id(node) in standing:
                return

    @property
    def unresolved(self) -> int:
        """Edits on which the survivors still differ, along the longest."""
        return max(node.depth for _, node in self.best.values()) - self.root.depth

    def finish(self) -> Iterator[Node]:
        """The rest of the cheapest edits."""
        done = [self.best[s] for s in (START, ASSISTANT) if s in self.best]
        best = done[0]
        for other in done[1:]:
            if other[0] < best[0] or other[0] == best[0] and _before(other[1], best[1]):
                best = other
        path, node = [], best[1]
        while node is not self.root:
            path.append(node)
            node = node.parent
        yield from reversed(path)


def _mark(role: Column, text: Column) -> Column:
    return F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)


def faulty_rows(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, mark, blank, again, cut: the rows with what can be told of them before the decoder.

    ``again`` means that an earlier turn of the conversation has the same role
    and text.  Earlier turns come from a pre-aggregated table of repeated
    contents, so no window holds a conversation.
    """
    some = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                       F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    bare = F.rtrim("text", F.lit(WHITE))
    some = some.select("*", _mark(F.col("role"), F.col("text")).alias("mark"), (bare == "").alias("blank"),
                       (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    first = some.groupBy("conv_id", "mark").agg(F.min("turn").alias("first"), F.max(F.col("turn").isNull()).alias("before_all"), F.count("*").alias("k"))
    first = first.where("k > 1").select(F.col("conv_id").alias("of"), F.col("mark").alias("same"), "first", "before_all")
    joined = some.join(first, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("mark") == F.col("same")), "left")
    again = F.col("turn").isNotNull() & (F.coalesce("before_all", F.lit(False)) | F.coalesce(F.col("turn") > F.col("first"), F.lit(False)))
    return joined.select("conv_id", "turn", "role", "text", "mark", "blank", again.alias("again"), "cut")


def repair_conversations(rows: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """The cheapest edits of every conversation, in order: one row for each edit.

    Input: ``conv_id, turn, role, text``; other columns are ignored.  A
    conversation is its rows by turn, null turns first, rows of one turn by
    role and text.  A null role or text is one space; a null ``conv_id`` is one
    conversation.  A row's fault is the first of ``blank`` (white space only),
    ``duplicate`` (role and text seen earlier in the conversation) and
    ``truncated`` (does not end in ``.!?``).  Output: ``conv_id, step`` (from
    0), ``edit`` (``K`` keep, ``R`` rerole, ``D`` delete, ``I`` insert),
    ``fault, turn, role_was`` (null where inserted), ``role, text`` (null where
    deleted) and the edit's ``cost``.  An empty table gives an empty result.
    The rows of a conversation come out together and in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = 0
        own = before = decoder = None
        step = 0

        def put(nodes) -> None:
            nonlocal step, held
            for node in nodes:
                turn, role, text, fault = node.row or (None, None, "", None)
                kept = node.edit != "D"
                now = None if not kept else role if node.edit == "K" else _ROLES[node.state]
                out.append((own[0], step, node.edit, fault, turn, role, now, text if kept else None, node.price))
                step += 1
                held += len(text)

        for batch in batches:
            for conv, turn, role, text, mark, blank, again, cut in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own is None or own[0] != conv:
                    if decoder is not None:
                        put(decoder.finish())
                    own, before, decoder, step = (conv,), None, Decoder(costs), 0
                if blank:
                    fault = "blank"
                elif again or before == (turn, mark):
                    fault = "duplicate"
                else:
                    fault = "truncated" if cut else None
                before = (turn, mark)
                put(decoder.row(role, fault, (turn, role, text, fault)))
                if len(out) >= 8192 or held > 4_000_000:
                    yield _batch(out)
                    out, held = [], 0
        if decoder is not None:
            put(decoder.finish())
        if out:
            yield _batch(out)

    ready = faulty_rows(rows).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ready.mapInArrow(run, _EDIT)


_KINDS = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}


def _batch(rows: list[tuple], schema: str = _EDIT) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    return pa.record_batch([pa.array(c, _KINDS[k]) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))


_REPORT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
           "repaired_sha256 string")


def report_repairs(edits: DataFrame) -> DataFrame:
    """One row per conversation: its faults, what the repair costs, its edits and a digest of the repaired rows.

    ``edits`` is the result of :func:`repair_conversations` as it comes, whose
    conversations are together and in order: one narrow pass, a running digest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        key = None

        def close() -> None:
            gaps = turns[1] - turns[0] + 1 - turns[2] if turns[2] else 0
            done.append((key[0], gaps, *(faults[f] for f in ("blank", "duplicate", "truncated")), illegal, cost, "".join(audit), digest.hexdigest()))

        for batch in batches:
            for conv, _, edit, fault, turn, was, role, text, price in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key is None or key[0] != conv:
                    if key is not None:
                        close()
                    key, last, audit, digest, said = (conv,), None, [], hashlib.sha256(), False
                    faults = {"blank": 0, "duplicate": 0, "truncated": 0, None: 0}
                    illegal = cost = 0
                    turns = [0, 0, 0]
                faults[fault] += 1
                cost += price
                audit.append(edit)
                if was is not None:
                    illegal += last is not None and last + was[:1] not in ("su", "ua", "au")
                    last = was[:1]
                    if turn is not None and (not turns[2] or turn != turns[1]):
                        turns = [turns[0] if turns[2] else turn, turn, turns[2] + 1]
                if edit != "D":
                    digest.update(f"{chr(10) if said else ''}{role}:{text}".encode())
                    said = True
            if len(done) >= 4096:
                yield _batch(done, _REPORT)
                done.clear()
        if key is not None:
            close()
        if done:
            yield _batch(done, _REPORT)

    return edits.mapInArrow(run, _REPORT)


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of ``rows`` with known faults, chosen by ``crc32(conv_id:turn) % 20`` (null: one space).

    0 drops a row, 1 empties its text, 2 removes its full stops, exclamation
    and question marks, 3 repeats it, 4 makes it the user's.
    """
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    some = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                       F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
                       (F.crc32(F.encode(key, "UTF-8")) % 20).alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    once = some.where("kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), "kind")
    return once.drop("kind").unionByName(once.where("kind = 3").drop("kind"))


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """The report of every conversation of the table after :func:`damage`; those that lost all rows have zeros and no edits."""
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    found = report_repairs(repair_conversations(damage(conversations)))
    of = found.withColumnRenamed("conv_id", "of")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return ids.join(of, F.col("conv_id").eqNullSafe(F.col("of")), "left").select(
        "conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"))


#: The remainders of a CRC-32 by byte (polynomial EDB88320), made by its rule.
CRC_TABLE = """SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k:
  CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END, i::BIGINT)) AS tab"""


def crc_sql(octets: str) -> str:
    """The unsigned CRC-32 of a list of octets (BIGINT), with ``tab`` from :data:`CRC_TABLE` in reach."""
    return f"xor(list_reduce({octets}, lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"


def _step_sql(state: int) -> str:
    """All ways into ``state`` by one row (deleted, kept, given another role), cheapest first."""
    ways = [f"{{'c': s{state}.c + 2, 'a': s{state}.a || 'D', 'o': s{state}.o}}"]
    line = "role || ':' || text || chr(10)"
    for sign, moves in _NEXT.items():
        for a, b in moves.items():
            if b == state:
                ways.append(f"CASE WHEN sign = '{sign}' AND free THEN {{'c': s{a}.c + more, 'a': s{a}.a || 'K', 'o': s{a}.o || {line}}} END")
                if sign != "s":
                    ways.append(f"CASE WHEN free THEN {{'c': s{a}.c + 1 + more, 'a': s{a}.a || 'R', 'o': s{a}.o || '{_ROLES[b]}:' || text || chr(10)}} END")
    return "list_min(list_filter([" + ", ".join(ways) + "], lambda w: w.c IS NOT NULL))"


def _insert_sql(a: str, state: int) -> str:
    return f"{{'c': {a}.c + 5, 'a': {a}.a || 'I', 'o': {a}.o || '{_ROLES[state]}:' || chr(10)}}"


def _least_sql(*ways: str) -> str:
    return "list_min(list_filter([" + ", ".join(ways) + "], lambda w: w.c IS NOT NULL))"


OP11_SQL = f"""
WITH RECURSIVE t AS ({CRC_TABLE}),
k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key
  FROM conversations
), c AS (
  SELECT conv_id, turn, role, text, {crc_sql("list_transform(range(1, length(key) + 1), lambda i: ord(key[i])::BIGINT)")} % 20 AS kind
  FROM k, t
), d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM c, (VALUES (0), (1)) v(again) WHERE kind <> 0 AND (again = 0 OR kind = 3)
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
         regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS last, role[1] AS sign
  FROM d
), m AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM n
), r AS (
  SELECT *, CASE WHEN last = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM m
), g AS (
  SELECT *, fault NOT IN ('blank', 'duplicate') AS free, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS more,
         lag(sign) OVER (PARTITION BY conv_id ORDER BY i) || sign AS two
  FROM r
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n_rows
  FROM g GROUP BY conv_id
), p(conv_id, i, s0, s1, s2, s3) AS (
  SELECT conv_id, 0::BIGINT, {{'c': 0::BIGINT, 'a': '', 'o': ''}}, NULL::STRUCT(c BIGINT, a VARCHAR, o VARCHAR),
         {{'c': 5::BIGINT, 'a': 'I', 'o': 'user:' || chr(10)}}, {{'c': 10::BIGINT, 'a': 'II', 'o': 'user:' || chr(10) || 'assistant:' || chr(10)}}
  FROM counts
  UNION ALL
  SELECT conv_id, i, s0, s1, {_least_sql("y2", _insert_sql("n3", USER))}, y3
  FROM (
    SELECT conv_id, i, s0, s1, y2, n3, {_least_sql("n3", _insert_sql("y2", ASSISTANT))} AS y3
    FROM (
      SELECT conv_id, i, n0 AS s0, n1 AS s1, n3, {_least_sql("n2", _insert_sql("n0", USER), _insert_sql("n1", USER), _insert_sql("n3", USER))} AS y2
      FROM (
        SELECT p.conv_id, g.i, {_step_sql(0)} AS n0, {_step_sql(1)} AS n1, {_step_sql(2)} AS n2, {_step_sql(3)} AS n3
        FROM p JOIN g ON g.conv_id IS NOT DISTINCT FROM p.conv_id AND g.i = p.i + 1
      ) x
    ) y
  ) z
), best AS (
  SELECT p.conv_id, {_least_sql("s0", "s3")} AS w FROM p JOIN counts ON counts.conv_id IS NOT DISTINCT FROM p.conv_id AND counts.n_rows = p.i
)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(w.c, 0)::BIGINT AS cost,
       coalesce(w.a, '') AS audit, sha256(coalesce(w.o[:-2], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM a.conv_id
"""
