"""Conversation structure repair over a suffix-shared automaton of role and fault signatures.

A row of a conversation becomes one symbol: whether its role begins like system, user, assistant or something else, and
whether it must go, is cut off, or is sound. A conversation's signature is the text of its symbols. Signatures are
minimised from the end: two positions, of whatever conversations, that have the same symbols left are one node of the
automaton, a symbol with the node after it. What is cheapest from a position on depends on its node and on the state of
the grammar of roles alone, so the cost to go and the first edit of the best audit are worked out once for each node
and state, from the last level to the first, for all conversations together. A walk from the first node reads off the
audit. Edits that lead on from one node and state have different initials, so ties are settled by the first initial.

Rows are sorted by ranges of conversation and turn, which spreads a conversation of any size over tasks, and cut into
segments. A conversation that has several is put together from its segments: each has the cost and the edits from every
state that it can be entered in to every state that it can be left in, by the same automaton.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import buckets_for, count_and_bytes, doc_columns, store

#: Costs: a row's role is changed, a row goes, a row is put in, a cut-off row stays.
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
#: Roles whose initials the grammar knows, in the order of its letters; any other role has the letter 3.
ROLES = ("system", "user", "assistant")
#: The grammar ``(s?(ua)+)?``: where each state goes with s, u and a (-1: nowhere). State 0 is the start.
NEXT = np.array([[1, 2, -1], [-1, 2, -1], [-1, -1, 3], [-1, 2, -1]])
#: States in which a conversation may end, and the letter that can be put in, or written over another, in each state.
ENDS, GIVEN = (0, 3), (1, 1, 2, 1)
STATES = len(NEXT)
#: Edits in the order of their initials.
EDITS = "DIKR"
#: Rows of a segment at most, and bytes of text that a task sorts, about.
SEGMENT, RANGE_BYTES = 1 << 14, 32_000_000
#: Symbols of the signatures that are minimised together.
BATCH_SYMBOLS = 1 << 18

_NEVER = 1 << 40


class Automaton:
    """The minimal automaton of a batch of signatures from their ends, with the best edits of its nodes.

    A row's symbol is ``a`` if it must go, else one of the four letters from ``b`` on if it is sound, or from ``f`` on
    if it is cut off. Node 0 is the end, which is reached at the given costs. Nodes of one level have the same number of symbols left, so a level is a contiguous range.
    """

    def __init__(self, signatures: list[bytes], terminal: np.ndarray) -> None:
        lengths = np.array([len(s) for s in signatures], dtype=np.int64)
        flat = np.frombuffer(b"".join(signatures), dtype=np.uint8).astype(np.int64) - ord("a")
        ends = np.cumsum(lengths)
        self.symbols, self.after, levels = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [0, 1]
        entry = np.zeros(len(signatures), dtype=np.int64)
        active = np.argsort(-lengths, kind="stable")
        for depth in range(1, int(lengths.max(initial=0)) + 1):
            active = active[: int(np.searchsorted(-lengths[active], -depth, side="right"))]
            keys = entry[active] * 16 + flat[ends[active] - depth]
            distinct, which = np.unique(keys, return_inverse=True)
            entry[active] = levels[-1] + which
            self.symbols.append(distinct % 16)
            self.after.append(distinct // 16)
            levels.append(levels[-1] + len(distinct))
        self.entry = entry
        self.symbols, self.after = np.concatenate(self.symbols), np.concatenate(self.after)
        self.cost = np.full((levels[-1], STATES), _NEVER, dtype=np.int64)
        self.edit = np.full((levels[-1], STATES), -1, dtype=np.int64)
        self.cost[0] = terminal
        if (terminal[list(ENDS)] == 0).all():  # rows may be put in at the very end only, else before the next row
            self._put_in(slice(0, 1))
        for begin, end in zip(levels[1:-1], levels[2:], strict=True):
            self._level(slice(begin, end))

    def _level(self, level: slice) -> None:
        symbols, after = self.symbols[level], self.after[level]
        letter = np.where(symbols == 0, 3, (symbols - 1) % 4)
        stays = np.where(symbols > 4, CUT_OFF, 0)
        for state in range(STATES):
            kept = np.where(letter < 3, NEXT[state][np.minimum(letter, 2)], -1)
            may = (symbols > 0) & (kept >= 0)
            choices = np.stack(
                [
                    DELETE + self.cost[after, state],
                    np.full(len(symbols), _NEVER),
                    np.where(may, stays + self.cost[after, np.maximum(kept, 0)], _NEVER),
                    np.where(symbols > 0, REROLE + stays + self.cost[after, NEXT[state][GIVEN[state]]], _NEVER),
                ]
            )
            self.edit[level, state] = choices.argmin(axis=0)  # ties to the first initial
            self.cost[level, state] = np.minimum(choices.min(axis=0), _NEVER)
        self._put_in(level)

    def _put_in(self, level: slice) -> None:
        """Better edits that begin with putting a row in; the longest useful run of them visits every state once."""
        for _ in range(STATES):
            for state in range(STATES):
                cost = INSERT + self.cost[level, NEXT[state][GIVEN[state]]]
                now, edit = self.cost[level, state], self.edit[level, state]
                better = (cost < now) | ((cost == now) & (cost < _NEVER) & (edit > EDITS.index("I")))
                self.edit[level, state] = np.where(better, EDITS.index("I"), edit)
                self.cost[level, state] = np.where(better, cost, now)

    def audits(self, state: int) -> tuple[np.ndarray, list[list[str]]]:
        """Cost of each signature entered in a state, and the edits at each row: initials and given letters.

        A row's edits are those before it and its own, such as ``IuK`` or ``Ra``; what is put in after the last row is
        added to it.
        """
        rows: list[list[str]] = []
        cost = self.cost[self.entry, state]
        for node in np.where(cost < _NEVER, self.entry, -1).tolist():
            at, edits, now = state, [], ""
            while node >= 0:
                edit = int(self.edit[node, at])
                if node == 0 and edit < 0:
                    break
                letter = GIVEN[at]
                if edit == 0:
                    now += "D"
                elif edit == 1:
                    now += "I" + "sua"[letter]
                elif edit == 2:
                    now += "K"
                    letter = (int(self.symbols[node]) - 1) % 4
                else:
                    now += "R" + "sua"[letter]
                at = at if edit == 0 else int(NEXT[at, letter])
                if edit != 1:
                    edits.append(now)
                    now = ""
                    node = int(self.after[node])
            if now and edits:
                edits[-1] += now
            rows.append(edits)
        return cost, rows


def initials(edits: list[str]) -> str:
    """The audit of a segment's edits."""
    return "".join(x for edit in edits for x in edit if x in EDITS)


_WAYS = "signature string, first boolean, last boolean, entered int, left int, cost bigint, rank int, edits array<string>"
_WAYS_FIELDS = pa.schema(
    [("signature", pa.string()), ("first", pa.bool_()), ("last", pa.bool_()), ("entered", pa.int32())]
    + [("left", pa.int32()), ("cost", pa.int64()), ("rank", pa.int32()), ("edits", pa.list_(pa.string()))]
)


def ways(signatures: list[str], first: bool, last: bool) -> Iterator[dict]:
    """The best way through each segment from every state in which it can be entered to every one it can be left in.

    A first segment is entered in state 0. A last one is left at the end of its conversation, which is written as -1.
    Of the ways from one state, ``rank`` is the order of their audits, none of which begins another one.
    """
    exits = [-1] if last else range(STATES)
    automata = []
    for left in exits:
        terminal = np.full(STATES, _NEVER, dtype=np.int64)
        terminal[list(ENDS) if last else left] = 0
        automata.append(Automaton([s.encode() for s in signatures], terminal))
    for state in [0] if first else range(STATES):
        found = [a.audits(state) for a in automata]
        for i, signature in enumerate(signatures):
            known = [k for k in range(len(exits)) if found[k][0][i] < _NEVER]
            known.sort(key=lambda k: initials(found[k][1][i]))
            for rank, k in enumerate(known):
                yield {
                    "signature": signature,
                    "first": first,
                    "last": last,
                    "entered": state,
                    "left": exits[k],
                    "cost": int(found[k][0][i]),
                    "rank": rank,
                    "edits": found[k][1][i],
                }


def _best_ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ways through a task's distinct signatures, which come sorted from the end."""
    held: dict[tuple[bool, bool], list[str]] = {kind: [] for kind in product((False, True), repeat=2)}
    symbols = 0

    def out() -> Iterator[pa.RecordBatch]:
        for (first, last), signatures in held.items():
            rows: list[dict] = []
            size = 0
            for row in ways(signatures, first, last) if signatures else ():
                rows.append(row)
                size += len(row["edits"]) + 16
                if size > BATCH_SYMBOLS:
                    yield pa.RecordBatch.from_pylist(rows, schema=_WAYS_FIELDS)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_WAYS_FIELDS)
            signatures.clear()

    for batch in batches:
        for signature, first, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held[first, last].append(signature)
            symbols += len(signature)
            if symbols > BATCH_SYMBOLS:
                yield from out()
                symbols = 0
    yield from out()


def _through(costs: pd.DataFrame) -> pd.DataFrame:
    """The best way of one conversation through its segments; its cost stands at the first segment."""
    places = np.sort(costs["first_at"].unique())
    at = np.searchsorted(places, costs["first_at"].to_numpy())
    shape = (len(places), STATES, STATES)
    cost, rank = np.full(shape, _NEVER, dtype=np.int64), np.full(shape, STATES, dtype=np.int64)
    where = (at, costs["entered"].to_numpy(), np.maximum(costs["left"].to_numpy(), 0))
    cost[where], rank[where] = costs["cost"].to_numpy(), costs["rank"].to_numpy()
    onward = np.zeros(STATES, dtype=np.int64)
    best = np.zeros((len(places), STATES), dtype=np.int64)
    total = 0
    for k in range(len(places) - 1, -1, -1):
        whole = cost[k] + (onward[None, :] if k < len(places) - 1 else 0)
        best[k] = np.lexsort((rank[k], whole), axis=1)[:, 0]
        onward = np.minimum(np.take_along_axis(whole, best[k][:, None], axis=1)[:, 0], _NEVER)
        total = int(onward[0])
    state, rows = 0, []
    for k, place in enumerate(places.tolist()):
        left = int(best[k][state])
        rows.append((place, state, -1 if k == len(places) - 1 else left, total if k == 0 else 0))
        state = left
    return pd.DataFrame(rows, columns=["at_first", "by", "to", "total"])


def initial(role: Column) -> Column:
    return F.substring(role, 1, 1)


def damaged(
    rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """The four columns of a conversation table with faults, as CRC-32 of ``conv_id:turn`` modulo 20 says.

    0 drops the row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 sets its role to user. Nulls of role
    and text become one space, and those of conv_id and turn are one space within the checksum.
    """
    space = F.lit(" ")
    narrow = doc_columns(rows, conv_id, turn, role, text).select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), space).alias("role"),
        F.coalesce(F.col(text).cast("string"), space).alias("text"),
    )
    named = [F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")]
    kind = F.crc32(F.encode(F.concat_ws(":", *named), "UTF-8")) % 20
    hit = narrow.withColumn("kind", kind).where("kind <> 0")
    changed = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return hit.select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        changed.alias("text"),
        copies.alias("copy"),
    ).drop("copy")


def ordered(rows: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """All rows with their places, their faults apart from repetition, and their identities.

    Places rise with conversation, turn (nulls first) and, within a turn, role and text. Storing settles them.
    """
    narrow = doc_columns(rows, conv_id, turn, role, text).select(
        F.col(conv_id).alias("conv"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"),
    )
    same = F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text"))
    narrow = narrow.withColumn("identity", same)
    _, size = count_and_bytes(narrow)
    order = [F.col(c).asc_nulls_first() for c in ("conv", "turn", "role", "identity")]
    parts = buckets_for(rows.sparkSession, size, RANGE_BYTES)
    sorted_rows = narrow.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    letter = F.array_position(F.array(*[F.lit(r[0]) for r in ROLES]), initial(F.col("role")))
    tail = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*+\z", 1)
    return store(
        sorted_rows.withColumns(
            {
                "at": F.monotonically_increasing_id(),
                "initial": initial(F.col("role")),
                "letter": F.when(letter == 0, 3).otherwise(letter - 1).cast("int"),
                "blank": tail == "",
                "cut": ~tail.isin(".", "!", "?"),
            }
        ).withColumn("segment", F.expr(f"at div {SEGMENT}")),
        "ordered",
    )


class Repair:
    """The cheapest edits that bring conversations into the form ``(s?(ua)+)?`` of their roles' initials.

    A row's first fault counts: it is blank, repeats role and text of an earlier row, or is cut off (its last visible
    character is none of ``.!?``). Blank and repeated rows go. Rows are ordered by turn, nulls first, and rows of one
    turn by role and text. Null roles and texts are one space, and rows without a conv_id are one conversation. Further
    columns are left out. An empty table gives empty results.
    """

    def __init__(
        self, rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
    ) -> None:
        self.rows = ordered(rows, conv_id, turn, role, text)
        self.segments = store(self._segments(), "segments")
        self.chosen = store(self._chosen(), "chosen")

    def _faults(self) -> DataFrame:
        """Places with their fault: 0 none, 1 cut off, 2 repeated, 3 blank."""
        narrow = self.rows.select("conv", "segment", "at", "initial", "letter", "blank", "cut", "identity")
        seen = narrow.groupBy(F.col("conv").alias("of"), F.col("identity").alias("same")).agg(
            F.min("at").alias("first"), F.count(F.lit(1)).alias("n")
        )
        seen = seen.where("n > 1").drop("n")
        found = narrow.join(seen, F.col("conv").eqNullSafe(F.col("of")) & (F.col("identity") == F.col("same")), "left")
        repeated = F.coalesce(F.col("at") > F.col("first"), F.lit(False))
        fault = F.when(F.col("blank"), 3).when(repeated, 2).when(F.col("cut"), 1).otherwise(0)
        return found.select("conv", "segment", "at", "initial", "letter", fault.alias("fault"))

    def _segments(self) -> DataFrame:
        """A row for each segment: the rows of one conversation within a block of places."""
        code = F.when(F.col("fault") > 1, 0).otherwise(1 + F.col("letter") + 4 * F.col("fault"))
        one = F.struct("at", F.chr(code + ord("a")).alias("symbol"), "initial")
        kinds = ((3, "blank"), (2, "duplicate"), (1, "truncated"))
        grouped = (
            self._faults()
            .withColumn("one", one)
            .groupBy("conv", "segment")
            .agg(
                F.array_sort(F.collect_list("one")).alias("rows"),
                *[F.count(F.when(F.col("fault") == k, 1)).alias(name) for k, name in kinds],
            )
        )
        pairs = F.zip_with(
            F.slice("rows", F.lit(1), F.size("rows") - 1),
            F.slice("rows", F.lit(2), F.size("rows")),
            lambda a, b: F.concat(a["initial"], b["initial"]),
        )
        segments = grouped.select(
            "conv",
            "segment",
            F.col("rows")[0]["at"].alias("first_at"),
            F.array_join("rows.symbol", "").alias("signature"),
            F.col("rows")[0]["initial"].alias("begins"),
            F.element_at("rows", -1)["initial"].alias("ends"),
            F.size(F.filter(pairs, illegal)).cast("bigint").alias("illegal"),
            *[name for _, name in kinds],
        )
        segments = store(segments, "parts")
        heads = segments.groupBy(F.col("conv").alias("of")).agg(
            F.min("first_at").alias("head"), F.max("first_at").alias("tail")
        )
        placed = segments.join(heads, F.col("conv").eqNullSafe(F.col("of"))).drop("of")
        return placed.select(
            "*", (F.col("first_at") == F.col("head")).alias("first"), (F.col("first_at") == F.col("tail")).alias("last")
        ).drop("tail")

    def _chosen(self) -> DataFrame:
        """The segments with the cost and the edits of the best way through each of them."""
        kinds = ["signature", "first", "last"]
        # equal ends meet where signatures are sorted from the end
        order = [F.reverse("signature"), F.col("first"), F.col("last")]
        distinct = self.segments.select(*kinds).distinct().repartitionByRange(*order).sortWithinPartitions(*order)
        found = store(distinct.mapInArrow(_best_ways, _WAYS), "ways")
        alone = self.segments.where("first and last").join(found.drop("entered", "left", "rank"), kinds)
        several = self.segments.where("not (first and last)")
        costs = several.join(found.drop("edits"), kinds).select("head", "first_at", "entered", "left", "cost", "rank")
        picked = costs.groupBy("head").applyInPandas(_through, "at_first bigint, by int, to int, total bigint")
        by_way = several.join(picked, F.col("first_at") == F.col("at_first")).join(
            found.drop("cost", "rank"), kinds
        )
        by_way = by_way.where((F.col("entered") == F.col("by")) & (F.col("left") == F.col("to"))).withColumn("cost", F.col("total"))
        before = F.lag("ends").over(Window.partitionBy("head").orderBy("first_at"))
        join = F.concat(before, "begins")
        by_way = by_way.withColumn("illegal", F.col("illegal") + F.when(illegal(join), 1).otherwise(0))
        columns = [*self.segments.columns, "cost", "edits"]
        return alone.select(*columns).unionByName(by_way.select(*columns))

    def repaired(self, together: bool = False) -> DataFrame:
        """conv_id, place, step, edit (K, R or I), role and text of the rows that the repaired conversations have.

        ``place`` and ``step`` order them. With ``together`` the rows of a conversation lie in one partition, in
        order, else those of a segment do.
        """
        keys = ["conv"] if together else ["conv", "segment"]
        nothing = F.lit(None).cast("string")
        edits = self.chosen.select("conv", "segment", "first_at", F.posexplode("edits").alias("k", "edits")).select(
            "conv", "segment", (F.col("first_at") + F.col("k")).alias("at"), "edits", nothing.alias("role"), nothing.alias("text")
        )
        rows = self.rows.select("conv", "segment", "at", nothing.alias("edits"), "role", "text")
        # a row's edits come right before it, so both meet in one exchange
        order = Window.partitionBy(*keys).orderBy("at", F.col("edits").asc_nulls_last())
        met = edits.unionByName(rows).withColumn("given", F.lag("edits").over(order)).where("edits is null")
        steps = F.posexplode(F.regexp_extract_all("given", F.lit("([DIKR][sua]?)"), 1)).alias("step", "edit")
        stepped = met.select("conv", "at", "role", "text", steps).where("edit <> 'D'")
        letter = F.substring("edit", 2, 1)
        role = F.col("role")
        for name in ROLES:
            role = F.when(letter == name[0], name).otherwise(role)
        return stepped.select(
            F.col("conv").alias("conv_id"),
            F.col("at").alias("place"),
            "step",
            F.substring("edit", 1, 1).alias("edit"),
            role.alias("role"),
            F.when(F.col("edit").startswith("I"), "").otherwise(F.col("text")).alias("text"),
        )

    def audited(self) -> DataFrame:
        """conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit of every conversation that has rows."""
        audit = F.regexp_replace(F.array_join("edits", ""), "[a-z]", "")
        parts = self.chosen.select(
            "conv", "blank", "duplicate", "truncated", "illegal", "cost", F.struct("first_at", audit.alias("audit")).alias("part")
        )
        turns = self.rows.groupBy("conv", F.col("turn").cast("bigint").alias("turn")).agg(F.lit(0).alias("none")).drop("none")
        counts = ("blank", "duplicate", "truncated", "illegal", "cost")
        both = parts.unionByName(turns, allowMissingColumns=True)
        summed = both.groupBy("conv").agg(
            F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("bigint").alias("gaps"),
            *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in counts],
            F.array_join(F.array_sort(F.collect_list("part")).getField("audit"), "").alias("audit"),
        )
        return summed.withColumnRenamed("conv", "conv_id")


def illegal(pair: Column) -> Column:
    """Whether roles of these two initials may not follow each other."""
    return ~pair.isin("su", "ua", "au")


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of the lines ``role:text`` of each conversation, in order.

    The rows are those of :meth:`Repair.repaired` with ``together``, hashed as they pass by.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, digest = None, None
        for batch in batches:
            done: list[tuple] = []
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                line = f"{role}:{text}".encode()
                if digest is not None and conv == held:
                    digest.update(b"\n" + line)
                    continue
                if digest is not None:
                    done.append((held, digest.hexdigest()))
                held, digest = conv, hashlib.sha256(line)
            if done:
                yield _pairs(done, batch.schema)
        if digest is not None:
            yield _pairs([(held, digest.hexdigest())], batch.schema)

    def _pairs(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        conv, digest = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(conv, schema.field(0).type), pa.array(digest)], ["conv_id", "digest"])

    kind = repaired.schema["conv_id"].dataType.simpleString()
    return repaired.select("conv_id", "role", "text").mapInArrow(run, f"conv_id {kind}, digest string")


def repair(rows: DataFrame, original: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """Every conv_id of the original table once, with what :meth:`Repair.audited` says and ``repaired_sha256``.

    A conversation without rows left has zeros, an empty audit and the digest of an empty text.
    """
    found = Repair(rows)
    parts = [
        doc_columns(original, conv_id).select(F.col(conv_id).alias("conv_id")).distinct(),
        found.audited(),
        digests(found.repaired(together=True)),
    ]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return both.groupBy("conv_id").agg(
        *[F.coalesce(F.max(c), F.lit(0)).cast("bigint").alias(c) for c in counts],
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("digest"), F.sha2(F.encode(F.lit(""), "UTF-8"), 256)).alias("repaired_sha256"),
    )
