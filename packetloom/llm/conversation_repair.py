"""Cheapest repair of damaged conversations by rank-convergence parallel Viterbi.

A conversation is legal when its role initials read ``(s?(ua)+)?``. Edits keep a row, give it
another role, delete it or insert an empty message; four states (nothing yet, after the system
message, after a user, after an assistant) follow the pattern. The vector before a row, the least cost to the end from
each state, follows from the vector after it, so a conversation is one long chain of steps, cut into chunks:

* Each chunk starts from speculative vectors at its end, one per state (zero there, ``SPREAD``
  elsewhere). Vectors of different states never differ by more than ``SPREAD``, so every real vector is
  a minimum of these four plus constants.
* Where the four results differ only by constants the chunk has forgotten its end, and its
  vector is known up to a constant, which no choice depends on. Fix-up passes rerun the other
  chunks behind what follows them, twice as far each time, until all are settled.
* The stitched vectors are each chunk's end vector. With it, a chunk traces its
  least audit from each state it may begin in; the same passes settle those beginnings, left to right.

Rows are put in order by a range exchange on (conversation, turn, digest), so a conversation may span many
tasks. Only the digest of the repaired text, which is sequential by nature, streams one conversation
through one task; what it holds in memory is the audit, a letter per row.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Callable

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.llm.common import arrow_schema, map_rows, saved, to_batch
from packetloom.session import task_slots

START, SYSTEM, USER, ASSISTANT = range(4)
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3  # costs
SPREAD = 10  # at most two inserts (6) and one deletion of a system message (4) part two states
DELETE_ONLY = 8  # row code of a blank or repeated row; others are 2 * initial + truncated
CHUNK = 4096
ROLES = {USER: "user", ASSISTANT: "assistant"}
AFTER_INSERT = (USER, USER, ASSISTANT, USER)
FINAL = (0, 2 * INSERT, INSERT, 0)
BLANKS = " \t\n\x0b\x0c\r"
KEY = ["c0", "c1"]
ORDER = [*KEY, "t0", "t1", "mark"]

Vector = tuple[int, ...]


def edits(state: int, code: int) -> list[tuple[str, int, int]]:
    """(letter, next state, cost) of the edits that use up a row, in the order of their letters."""
    found = [("D", state, DELETE)]
    if code < DELETE_ONLY:
        initial, extra = code >> 1, TRUNCATED * (code & 1)
        if state == START and initial == 0:
            found.append(("K", SYSTEM, extra))
        if initial == (2 if state == USER else 1):
            found.append(("K", AFTER_INSERT[state], extra))
        found.append(("R", AFTER_INSERT[state], REROLE + extra))
    return found


def relative(vector: Vector) -> Vector:
    least = min(vector)
    return tuple(v - least for v in vector)


class Chain:
    """Vector steps and choices, remembered: relative vectors are few."""

    def __init__(self) -> None:
        self.steps: dict[tuple[Vector, int], tuple[Vector, int]] = {}
        self.choices: dict[tuple[int, int, Vector], tuple[str, int]] = {}

    def step(self, after: Vector, code: int) -> tuple[Vector, int]:
        """The vector before a row of this code, as a relative vector and a constant."""
        known = self.steps.get((after, code))
        if known is None:
            before = self.exact(after, code)
            known = self.steps[after, code] = relative(before), min(before)
        return known

    @staticmethod
    def exact(after: Vector, code: int) -> Vector:
        least = [min(cost + after[to] for _, to, cost in edits(state, code)) for state in range(4)]
        least[USER] = min(least[USER], INSERT + least[ASSISTANT])
        return tuple(min(v, INSERT + least[USER]) if state != USER else v for state, v in enumerate(least))

    def choose(self, state: int, code: int, after: Vector) -> tuple[str, int]:
        """The least letters that use up the row at least cost, and the next state."""
        known = self.choices.get((state, code, after))
        if known is None:
            here, letters, at = self.exact(after, code), "", state
            while True:
                options = [(letter, to) for letter, to, cost in edits(at, code) if cost + after[to] == here[at]]
                if INSERT + here[AFTER_INSERT[at]] == here[at]:
                    options.append(("I", AFTER_INSERT[at]))
                letter, at = min(options)
                letters += letter
                if letter != "I":
                    break
            known = self.choices[state, code, after] = letters, at
        return known

    def vectors(self, codes: bytes, end: Vector) -> list[Vector]:
        """Relative vector before every row, and the end vector."""
        found = [end]
        for code in reversed(codes):
            found.append(self.step(found[-1], code)[0])
        return found[::-1]

    def back(self, codes: bytes, end: Vector) -> Vector:
        """The vector before the first row."""
        total = 0
        for code in reversed(codes):
            end, constant = self.step(end, code)
            total += constant
        return tuple(v + total for v in end)

    def trace(self, codes: bytes, begin: int, end: Vector) -> tuple[list[str], int]:
        """Letters of every row (inserts first), and the state at the end."""
        vectors, letters = self.vectors(codes, end), []
        for code, after in zip(codes, vectors[1:]):
            taken, begin = self.choose(begin, code, after)
            letters.append(taken)
        return letters, begin


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after damage, with their keys: ``copies`` is 0 for a dropped and 2 for a repeated row."""
    named = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    hit = F.crc32(named.cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), hit.alias("hit"))
    rows = rows.select(
        F.col("conv_id").isNotNull().alias("c0"), F.coalesce("conv_id", F.lit(0)).cast("long").alias("c1"),
        F.col("turn").isNotNull().alias("t0"), F.coalesce("turn", F.lit(0)).cast("long").alias("t1"),
        F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("hit") == 0, 0).when(F.col("hit") == 3, 2).otherwise(1).alias("copies"))
    return rows.withColumn("mark", F.unhex(F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))))


def row_code() -> Column:
    """2 * (0 system, 1 user, 2 assistant, 3 other) + truncated; ``DELETE_ONLY`` for a blank text."""
    solid, initial = F.rtrim(F.col("text"), F.lit(BLANKS)), F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return F.when(solid == "", DELETE_ONLY).otherwise(2 * kind + (~F.right(solid, F.lit(1)).isin(".", "!", "?")).cast("int"))


def chunks(rows: DataFrame, size: int) -> DataFrame:
    """``c0, c1, t0, t1, mark`` of a chunk's first row, ``idx`` in its conversation, ``last``, ``codes`` (a byte per distinct row).

    Equal rows of a turn are one row here; whatever comes after the first of equal role and text is deleted.
    """
    keys = rows.groupBy(*ORDER).agg(F.max("code").alias("code"))
    # the first turn of a text, nulls before all others, by numbers that a map-side combine can hold
    firsts = keys.groupBy(*KEY, "mark").agg(F.min("t0").alias("t0"), F.min(F.when(F.col("t0"), F.col("t1"))).alias("t1"))
    firsts = firsts.select(*KEY, "t0", F.when(F.col("t0"), F.col("t1")).otherwise(0).alias("t1"), "mark", F.lit(None).cast("int").alias("code"))
    both = keys.select(*ORDER, "code").unionByName(firsts)
    sorted_rows = both.repartitionByRange(task_slots(rows.sparkSession), *ORDER).sortWithinPartitions(*ORDER, "code")
    schema = "c0 boolean, c1 long, t0 boolean, t1 long, mark binary, part int, k long, more boolean, edge boolean, codes binary"
    arrow = arrow_schema(schema)

    def run(batches):
        part = TaskContext.get().partitionId()
        key, first, codes, k, at_start = None, None, bytearray(), 0, True  # the open chunk
        before, is_first = None, False
        out = []

        def piece(more, at_end):
            out.append((*key, *first, part, k, more, not more and (at_start or at_end), bytes(codes)))

        for batch in batches:
            for c0, c1, t0, t1, mark, code in zip(*(c.to_pylist() for c in batch.columns)):
                here = (c0, c1, t0, t1, mark)
                if code is None:  # sorts before the row itself and says that it is the first of its text
                    before, is_first = here, True
                    continue
                if key != (c0, c1):
                    if key is not None:
                        piece(False, False)
                        at_start = False
                    key, first, k = (c0, c1), here[2:], 0
                    codes.clear()
                elif len(codes) == size:
                    piece(True, False)
                    first, k = here[2:], k + 1
                    codes.clear()
                codes.append(code if is_first and before == here else DELETE_ONLY)
            if len(out) >= 5000:
                yield to_batch(out, arrow)
                out.clear()
        if key is not None:
            piece(False, True)
        if out:
            yield to_batch(out, arrow)

    found = saved(sorted_rows.mapInArrow(run, schema), "chunks")
    # a conversation at the edge of a task may go on in the next: at most two such pieces a task
    pieces = found.filter("edge").select(*KEY, "part", (F.col("k") + 1).alias("n"))
    whole = Window.partitionBy(*KEY)
    pieces = pieces.select(*KEY, "part", F.sum("n").over(whole.orderBy("part")).alias("upto"), "n", F.sum("n").over(whole).alias("total"))
    numbered = found.join(F.broadcast(pieces), [*KEY, "part"], "left")
    idx = F.col("k") + F.coalesce(F.col("upto") - F.col("n"), F.lit(0))
    return numbered.select(*ORDER, idx.alias("idx"), F.coalesce(idx == F.col("total") - 1, ~F.col("more")).alias("last"), "codes")


def fix_up(state: DataFrame, step: int, compose: Callable[[list, list], list], settled: Callable[[list], bool], kind: str) -> DataFrame:
    """``c0, c1, idx, value`` with every ``value`` settled.

    ``value`` stands for chunk ``idx`` alone at first and is rerun behind the value of the chunk it reaches, which
    doubles what it stands for, until it no longer depends on what lies beyond. Chunks join on
    (conversation, index), so a long conversation is spread like many short ones.
    """
    columns = f"c0 boolean, c1 long, idx long, reach long, value array<{kind}>, done boolean"

    def mark():
        return lambda c0, c1, idx, value: [(c0, c1, idx, idx + step, value, settled(value))]

    def rerun():
        def one(c0, c1, idx, reach, value, beyond, done):
            joined = compose(value, beyond)
            return [(c0, c1, idx, reach, joined, done or settled(joined))]

        return one

    now = saved(map_rows(state, [*KEY, "idx", "value"], mark, columns), "state")
    while not (waiting := now.filter("not done")).isEmpty():
        beyond = now.select(*KEY, F.col("idx").alias("reach"), F.col("reach").alias("further"), F.col("value").alias("beyond"), F.col("done").alias("known"))
        pairs = waiting.drop("done").join(beyond, [*KEY, "reach"]).select(*KEY, "idx", F.col("further").alias("reach"), "value", "beyond", "known")
        now = saved(now.filter("done").unionByName(map_rows(pairs, pairs.columns, rerun, columns)), "state")
    return now.select(*KEY, "idx", "value")


def behind(value: list[int], beyond: list[int]) -> list[int]:
    """Vectors of a chunk, from each speculative vector at the end of what lies beyond it."""
    return [min(beyond[4 * i + j] + value[4 * j + s] for j in range(4)) for i in range(4) for s in range(4)]


def parallel(value: list[int]) -> bool:
    """Whether the four vectors differ only by constants."""
    return all(len({value[4 * i + s] - value[s] for s in range(4)}) == 1 for i in range(1, 4))


def solved(pieces: DataFrame) -> DataFrame:
    """The chunks with ``begin`` (state before their first row) and ``ends`` (relative vector after their last one)."""
    pieces = saved(pieces, "pieces")
    whole = pieces.filter("idx = 0 and last").select("*", F.lit(START).alias("begin"), F.array(*map(F.lit, FINAL)).alias("ends"))
    parts = pieces.filter("idx > 0 or not last")
    if parts.isEmpty():
        return whole
    speculative = [tuple(0 if s == i else SPREAD for s in range(4)) for i in range(4)]

    def speculate():
        chain = Chain()

        def one(c0, c1, idx, last, codes):
            if last:
                vector = chain.back(codes, FINAL)
                return [(c0, c1, idx, list(vector) * 4)]
            return [(c0, c1, idx, [v for vector in speculative for v in chain.back(codes, vector)])]

        return one

    vectors = map_rows(parts, [*KEY, "idx", "last", "codes"], speculate, "c0 boolean, c1 long, idx long, value array<long>")
    vectors = fix_up(vectors, 1, behind, parallel, "long")
    ends = vectors.select(*KEY, (F.col("idx") - 1).alias("idx"), F.slice("value", 1, 4).alias("ends"))
    ends = ends.withColumn("ends", F.expr("transform(ends, v -> v - array_min(ends))"))
    ended = saved(parts.join(ends, [*KEY, "idx"], "left").withColumn("ends", F.coalesce("ends", F.array(*[F.lit(v).cast("long") for v in FINAL]))), "ended")

    def ways():
        chain = Chain()

        def one(c0, c1, idx, codes, end):
            if idx == 0:
                return [(c0, c1, idx, [chain.trace(codes, START, tuple(end))[1]] * 4)]
            return [(c0, c1, idx, [chain.trace(codes, state, tuple(end))[1] for state in range(4)])]

        return one

    states = map_rows(ended, [*KEY, "idx", "codes", "ends"], ways, "c0 boolean, c1 long, idx long, value array<int>")
    states = fix_up(states, -1, lambda value, before: [value[s] for s in before], lambda value: len(set(value)) == 1, "int")
    begins = states.select(*KEY, (F.col("idx") + 1).alias("idx"), F.col("value")[0].alias("begin"))
    stitched = ended.join(begins, [*KEY, "idx"], "left").withColumn("begin", F.coalesce("begin", F.lit(START)))
    return whole.unionByName(stitched.select(*whole.columns))


class Report:
    """Counts, audit and digest of one conversation, fed row by row."""

    def __init__(self, chain: Chain):
        self.chain, self.audit, self.digest = chain, io.StringIO(), hashlib.sha256()
        self.blank = self.duplicate = self.truncated = self.illegal = self.cost = self.turns = 0
        self.state, self.letters, self.codes, self.at, self.any_text = START, [], b"", 0, False
        self.low = self.high = self.turn = self.key = self.initial = None

    def chunk(self, codes: bytes, begin: int, ends: list[int]) -> None:
        (self.letters, _), self.codes, self.at, self.state = self.chain.trace(codes, begin, tuple(ends)), codes, 0, begin

    def say(self, line: str) -> None:
        self.digest.update((("\n" if self.any_text else "") + line).encode())
        self.any_text = True

    def insert(self) -> None:
        self.state = AFTER_INSERT[self.state]
        self.cost += INSERT
        self.say(ROLES[self.state] + ":")

    def row(self, t0: bool, t1: int, mark: bytes, role: str, text: str) -> None:
        key = (t0, t1, mark)
        if key == self.key:
            letters, spare = "D", True
        else:
            letters, spare = self.letters[self.at], self.codes[self.at] == DELETE_ONLY
            self.key, self.at = key, self.at + 1
        if t0 and t1 != self.turn:
            self.turns, self.turn, self.high = self.turns + 1, t1, t1
            self.low = t1 if self.low is None else self.low
        initial, solid = role[:1], text.rstrip(BLANKS)
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        self.audit.write(letters)
        for _ in letters[:-1]:
            self.insert()
        short = bool(solid) and solid[-1] not in ".!?"
        if not solid:
            self.blank += 1
        elif spare:
            self.duplicate += 1
        else:
            self.truncated += short
        if letters[-1] == "D":
            self.cost += DELETE
            return
        self.cost += TRUNCATED * short + REROLE * (letters[-1] == "R")
        self.state = SYSTEM if letters[-1] == "K" and initial == "s" else AFTER_INSERT[self.state]
        self.say((ROLES[self.state] if letters[-1] == "R" else role) + ":" + text)

    def finish(self, conv_id: int | None) -> tuple:
        while FINAL[self.state]:
            self.audit.write("I")
            self.insert()
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, self.audit.getvalue(), self.digest.hexdigest())


def repair(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per ``conv_id``: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows of a turn are taken by the MD5 of their role and text (equal rows side by side), null turns
    first; a null conv_id is a conversation of its own, null roles and texts are one space. A
    conversation that loses all rows has zeros, an empty audit and the digest of an empty text.
    """
    rows = damaged(conversations)
    codes = rows.filter("copies > 0").select(*ORDER, row_code().alias("code"))
    ways = solved(chunks(codes, chunk))
    lines = rows.select(*KEY, "t0", "t1", F.when(F.col("copies") > 0, F.col("mark")).alias("mark"), F.lit(1).alias("kind"), "copies",
                        F.when(F.col("copies") > 0, F.col("role")).alias("role"), F.when(F.col("copies") > 0, F.col("text")).alias("text"),
                        F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("int").alias("begin"), F.lit(None).cast("array<long>").alias("ends"))
    told = ways.select(*ORDER, F.lit(0).alias("kind"), F.lit(0).alias("copies"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"),
                       "codes", "begin", F.col("ends").cast("array<long>").alias("ends"))
    stream = told.unionByName(lines).repartition(*KEY).sortWithinPartitions(*ORDER, "kind")
    schema = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
    arrow = arrow_schema(schema)

    def run(batches):
        chain, key, report, out = Chain(), None, None, []
        for batch in batches:
            for c0, c1, t0, t1, mark, kind, copies, role, text, codes, begin, ends in zip(*(c.to_pylist() for c in batch.columns)):
                if key != (c0, c1):
                    if report:
                        out.append(report.finish(key[1] if key[0] else None))
                    key, report = (c0, c1), Report(chain)
                if kind == 0:
                    report.chunk(codes, begin, ends)
                for _ in range(copies):
                    report.row(t0, t1, mark, role, text)
            if out:
                yield to_batch(out, arrow)
                out = []
        if report:
            yield to_batch([report.finish(key[1] if key[0] else None)], arrow)

    return stream.select(*ORDER, "kind", "copies", "role", "text", "codes", "begin", "ends").mapInArrow(run, schema)
