"""Repair of damaged conversations by a retained-subsequence dynamic program.

A repair keeps some turns as they are, gives others the role user or assistant, deletes the rest and inserts empty turns, so
that the roles read `(s?(ua)+)?` by their initials. The program runs over retained turns only: between two of them the
deletions cost a difference of prefix sums, their two roles tell what must be inserted, and of all turns that may come next
only one for each role is remembered, the one with the least cost-to-go (of equal ones the farthest, for a longer run of
deletions comes first in the audit). Ties end there: a retained turn's successors differ in how far they are, in an insertion
or in keeping against reroling, which is the order of the letters D, I, K, R.

Turns are light rows (a digest of role and text instead of the text) until the edits are known. They are dealt by ranges of
(conversation, turn), so a conversation of any length is spread over partitions; the few that cross a border are solved
segment by segment: each has a table of costs from state to state, these are chained (a row a partition reaches the driver),
and every segment then starts from its own state. Texts meet the retained turns again by digest.

Defined results: null roles and texts are one space; turns go by number, nulls first, then by digest of role and text; equal
rows are copies, of which all but the first are duplicates; a null conversation is one of its own; a role with another
initial can't be kept; a very long text is read whole, but never by the program; a conversation without turns has zeros, an
empty audit and the digest of nothing; an empty table stays empty; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
#: States: nothing retained yet, or the role of the last retained turn.
START, S, U, A = range(4)
NEVER = 1 << 60
#: What must be inserted between two retained turns, and after the last one.
BETWEEN = {START: {S: 0, U: 0, A: INSERT}, S: {U: 0, A: INSERT}, U: {U: INSERT, A: 0}, A: {U: 0, A: INSERT}}
AT_END = [0, 2 * INSERT, INSERT, 0]
NAME = {U: "user", A: "assistant"}
STATE = {"s": S, "u": U, "a": A}
LEGAL = {"su", "ua", "au"}


class Program:
    """The turns of a segment and the best next retained turn after each of them. role: initials; n: copies; free: may be retained; cut: ends without a mark; togo: cost after the segment by state."""

    def __init__(self, role: list[str], n: list[int], free: list[bool], cut: list[bool], togo: list[int]):
        self.role, self.n = role, n
        self.deleted = [0]  # prefix sums of what deleting costs
        for k in n:
            self.deleted.append(self.deleted[-1] + DELETE * k)
        self.end = [self.deleted[-1] + t for t in togo]
        self.best = [(NEVER, -1)] * 4  # per role: the least cost from the beginning if that turn comes next, and the turn
        self.after: list[dict[int, tuple[int, int] | None]] = [{} for _ in n]
        for j in range(len(n) - 1, -1, -1):
            if not free[j]:
                continue
            own = STATE.get(role[j], START)
            found = []
            for r in (own, U, A) if own == S else (U, A):
                cost, self.after[j][r] = self.next(r)
                edit = (KEEP if r == own else REROLE) + CUT * cut[j] + DELETE * (n[j] - 1)
                found.append((r, self.deleted[j] + edit + cost - self.deleted[j + 1]))
            for r, cost in found:
                if cost < self.best[r][0]:
                    self.best[r] = (cost, j)

    def next(self, r: int) -> tuple[int, tuple[int, int] | None]:
        """The least cost after a turn of role r, and the next retained turn and its role (None: none in this segment)."""
        low, pick, rank = self.end[r], None, None
        for r2, insert in BETWEEN[r].items():
            cost, j = self.best[r2]
            cost += insert
            if cost > low or (cost == low and pick is None):
                continue
            mine = (-j, 0 if insert else 1 if STATE.get(self.role[j]) == r2 else 2)
            if cost < low or mine < rank:
                low, pick, rank = cost, (j, r2), mine
        return low, pick

    def path(self, entry: int) -> tuple[list[tuple[int, int, int]], int]:
        """The retained turns from a state on as (turn, its role, the role before), and the last state."""
        out, r, pick = [], entry, self.next(entry)[1]
        while pick is not None:
            j, r2 = pick
            out.append((j, r2, r))
            r, pick = r2, self.after[j][r2]
        return out, r


def costs(role, n, free, cut) -> list[int]:
    """What a segment costs from each state to each state, row by row."""
    table = []
    for last in range(4):
        p = Program(role, n, free, cut, [0 if r == last else NEVER for r in range(4)])
        table.append([p.next(r)[0] for r in range(4)])
    return [table[last][first] for first in range(4) for last in range(4)]


def _key(role: Column, text: Column) -> Column:
    """A 128-bit digest that tells pairs of role and text apart."""
    return F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))


def prepared(turns: DataFrame) -> DataFrame:
    """turns: conv_id, turn, role, text and n (copies). c: the conversation as text, null apart; nulls are one space."""
    c = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    x = turns.select(c.alias("c"), F.col("turn").isNotNull().alias("told"), F.coalesce(F.col("turn").cast("bigint"), F.lit(0).cast("bigint")).alias("turn"), role.alias("role"), text.alias("text"), F.col("n").cast("bigint").alias("n"))
    return x.withColumn("key", _key(F.col("role"), F.col("text")))


def light(rows: DataFrame) -> DataFrame:
    """One row for the copies of a turn, without its text: whether it is blank, ends without a mark, or was said before."""
    ends = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    said = rows.select("c", "told", "turn", "key", "n", F.substring("role", 1, 1).alias("initial"), (ends == "").alias("blank"), (~F.substring(ends, -1, 1).isin(".", "!", "?")).alias("cut"))
    once = written(said.groupBy("c", "told", "turn", "key", "initial", "blank", "cut").agg(F.sum("n").alias("n")), "turns")
    order = F.struct("told", "turn")
    again = written(once.groupBy("c", "key").agg(F.min(order).alias("first"), F.count("*").alias("times")).where("times > 1"), "said-again")
    # What is said more than 10,000 times and in one of a thousand turns, there are a thousand of at most: those rows needn't meet in one task.
    bound = max(10_000, once.count() // 1000)
    often, other = again.where(F.col("times") > bound).drop("times"), again.where(F.col("times") <= bound).drop("times")
    hot = once.join(F.broadcast(often), ["c", "key"])
    rest = once.join(F.broadcast(often), ["c", "key"], "left_anti").join(other, ["c", "key"], "left")
    cols = [*once.columns, "first"]
    return hot.select(*cols).unionByName(rest.select(*cols)).withColumn("again", F.coalesce(F.col("first") < order, F.lit(False))).drop("first")


_SEGMENT = "c string, part bigint, audit string, cost bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, opens string, closes string, turns bigint, from bigint, to bigint"
_LINE = "at bigint, sub int, told boolean, turn bigint, key binary, role string"
_IN = ["c", "part", "at", "told", "turn", "key", "initial", "blank", "cut", "again", "n"]


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """The rows of each (c, part) as columns; rows come sorted, and a segment is no longer than a partition."""
    held: dict[str, list] = {}
    for batch in batches:
        cols = {name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)}
        keys = list(zip(cols["c"], cols["part"], strict=True))
        a = 0
        for b in [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]] + [len(keys)]:
            if a == b:
                continue
            if held and (held["c"][0], held["part"][0]) != keys[a]:
                yield held
                held = {}
            for name, x in cols.items():
                held.setdefault(name, []).extend(x[a:b])
            a = b
    if held:
        yield held


def _program(seg: dict[str, list]) -> tuple:
    free = [not b and not d for b, d in zip(seg["blank"], seg["again"], strict=True)]
    return seg["initial"], seg["n"], free, seg["cut"]


def _solved(seg: dict[str, list], entry: int, togo: list[int], final: bool) -> tuple[tuple, list[tuple]]:
    """The summary of a segment and the lines that it leaves."""
    role, n, free, cut = _program(seg)
    p = Program(role, n, free, cut, togo)
    retained, last = p.path(entry)
    audit, cost, lines, at = [], 0, [], 0
    for j, r, before in retained:
        gone = p.deleted[j] - p.deleted[at]
        audit.append("D" * (gone // DELETE))
        cost += gone + DELETE * (n[j] - 1) + CUT * cut[j]
        if BETWEEN[before][r]:
            audit.append("I")
            cost += INSERT
            lines.append((seg["at"][j], 0, None, None, None, NAME[A if r == U else U]))
        kept = STATE.get(role[j]) == r
        audit.append(("K" if kept else "R") + "D" * (n[j] - 1))
        cost += KEEP if kept else REROLE
        lines.append((seg["at"][j], 1, seg["told"][j], seg["turn"][j], seg["key"][j], None if kept else NAME[r]))
        at = j + 1
    gone = p.deleted[-1] - p.deleted[at]
    audit.append("D" * (gone // DELETE))
    cost += gone
    if final and AT_END[last]:
        added = [U, A] if last == S else [A]
        audit.append("I" * len(added))
        cost += INSERT * len(added)
        lines += [(seg["at"][-1], 2 + i, None, None, None, NAME[r]) for i, r in enumerate(added)]
    blank = sum(k for k, b in zip(n, seg["blank"], strict=True) if b)
    duplicate = sum(k - f for k, b, f in zip(n, seg["blank"], free, strict=True) if not b)
    truncated = sum(f and t for f, t in zip(free, cut, strict=True))
    illegal = sum(k - 1 for k in n) + sum(a + b not in LEGAL for a, b in zip(role, role[1:], strict=False))
    turns = [t for t, told in zip(seg["turn"], seg["told"], strict=True) if told]
    distinct = sum(i == 0 or t != turns[i - 1] for i, t in enumerate(turns))
    span = (turns[0], turns[-1]) if turns else (None, None)
    return (seg["c"][0], seg["part"][0], "".join(audit), cost, blank, duplicate, truncated, illegal, role[0], role[-1], distinct, *span), lines


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("c", "part").sortWithinPartitions("c", "part", "at")


def _chained(turns: DataFrame) -> DataFrame | None:
    """c, part, entry, togo and final for the segments of conversations that cross a border of partitions: at most two for each border."""
    spans = turns.groupBy("c").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("c")
    wide = written(turns.join(F.broadcast(spans), "c", "left_semi"), "wide")  # spans: at most one conversation a border

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seg in _segments(batches):
            yield pa.RecordBatch.from_pylist([{"c": seg["c"][0], "part": seg["part"][0], "costs": costs(*_program(seg))}], pa.schema([("c", pa.string()), ("part", pa.int64()), ("costs", pa.list_(pa.int64()))]))

    segments = sorted(tuple(r) for r in _dealt(wide.select(*_IN)).mapInArrow(measure, "c string, part bigint, costs array<bigint>").collect())
    if not segments:
        return None
    spark = turns.sparkSession
    togo: dict[tuple, list[int]] = {}
    for k in range(len(segments) - 1, -1, -1):
        c, part, _ = segments[k]
        if k + 1 == len(segments) or segments[k + 1][0] != c:
            togo[c, part] = AT_END
        else:
            _, after, m = segments[k + 1]
            togo[c, part] = [min(NEVER, min(m[4 * r + x] + togo[c, after][x] for x in range(4))) for r in range(4)]
    told = spark.createDataFrame([(c, part, t) for (c, part), t in togo.items()], "c string, part bigint, togo array<bigint>")

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seg in _segments(batches):
            p = Program(*_program(seg), seg["togo"][0])
            yield pa.RecordBatch.from_pylist([{"c": seg["c"][0], "part": seg["part"][0], "to": [p.path(r)[1] for r in range(4)]}], pa.schema([("c", pa.string()), ("part", pa.int64()), ("to", pa.list_(pa.int64()))]))

    left = _dealt(wide.select(*_IN).join(F.broadcast(told), ["c", "part"])).mapInArrow(leave, "c string, part bigint, to array<bigint>")
    out, state, at = [], START, None
    for c, part, to in sorted(tuple(r) for r in left.collect()):
        state = state if c == at else START
        out.append((c, part, state, togo[c, part], togo[c, part] is AT_END))
        state, at = to[state], c
    return spark.createDataFrame(out, "c string, part bigint, entry int, togo array<bigint>, final boolean")


def edits(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """rows: of prepared(). Written: a row for each segment (audit not null) and for each line that is left (audit null). parts: ranges of turns."""
    order = ["c", "told", "turn", "key"]
    facts = written(light(rows), "marked")
    ranged = facts.repartitionByRange(parts, *order) if parts else facts.repartitionByRange(*order)
    turns = written(ranged.sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "ranged").withColumn("part", F.shiftright("at", 33))
    chained = _chained(turns)
    x = turns.select(*_IN)
    x = x.withColumns({"entry": F.lit(None).cast("int"), "togo": F.lit(None).cast("array<bigint>"), "final": F.lit(None).cast("boolean")}) if chained is None else x.join(F.broadcast(chained), ["c", "part"], "left")
    schema = _SEGMENT + ", " + _LINE
    names = [f.split()[0] for f in schema.split(", ")]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
        types = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")])
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*held, strict=True))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types.types, strict=True)], schema=types)

        for seg in _segments(batches):
            whole = seg["entry"][0] is None
            summary, lines = _solved(seg, *((START, AT_END, True) if whole else (seg["entry"][0], seg["togo"][0], seg["final"][0])))
            held.append((*summary, *[None] * 6))
            held.extend((*summary[:2], *[None] * 11, *line) for line in lines)
            if len(held) >= 10_000:
                yield flush()
        if held:
            yield flush()

    return written(_dealt(x.select(*_IN, "entry", "togo", "final")).mapInArrow(part, schema).select(*names), "edits")


def repaired(rows: DataFrame, edited: DataFrame) -> DataFrame:
    """The repaired conversations' lines: c, at, sub (their order), role, text."""
    lines = edited.where("audit is null").select("c", "at", "sub", "told", "turn", "key", F.col("role").alias("given"))
    texts = rows.select("c", "told", "turn", "key", "role", "text").dropDuplicates(["c", "told", "turn", "key"])
    said = lines.where("key is not null").join(texts, ["c", "told", "turn", "key"]).select("c", "at", "sub", F.coalesce("given", "role").alias("role"), "text")
    return said.unionByName(lines.where("key is null").select("c", "at", "sub", F.col("given").alias("role"), F.lit("").alias("text")))


def digests(lines: DataFrame) -> DataFrame:
    """c and the sha256 of its newline-joined `role:text` lines. A digest is sequential, so a conversation's lines stream through one task, a batch at a time."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sha = None, None
        schema = pa.schema([("c", pa.string()), ("repaired_sha256", pa.string())])
        for batch in batches:
            done = []
            for c, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if sha is None or c != at:
                    if sha is not None:
                        done.append({"c": at, "repaired_sha256": sha.hexdigest()})
                    at, sha = c, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_pylist(done, schema)
        if sha is not None:
            yield pa.RecordBatch.from_pylist([{"c": at, "repaired_sha256": sha.hexdigest()}], schema)

    return lines.repartition("c").sortWithinPartitions("c", "at", "sub").select("c", "role", "text").mapInArrow(part, "c string, repaired_sha256 string")


def summaries(edited: DataFrame) -> DataFrame:
    """c with gaps, faults, cost and audit, put together from its segments (more than one only where it crosses a border)."""
    cols = ["part", "audit", "cost", "blank", "duplicate", "truncated", "illegal", "opens", "closes", "turns", "from", "to"]
    seg = edited.where("audit is not null").groupBy("c").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("s"))
    add = lambda k: F.aggregate(F.transform("s", lambda x: x[k]), F.lit(0).cast("bigint"), lambda a, x: a + x)
    joints = F.transform("s", lambda x, i: F.struct(F.get(F.col("s"), i - 1)["closes"].alias("a"), x["opens"].alias("b"), F.get(F.col("s"), i - 1)["to"].alias("t"), x["from"].alias("f")))
    count = lambda cond: F.size(F.filter(joints, lambda j: F.coalesce(cond(j), F.lit(False)))).cast("bigint")
    legal = F.array(*[F.lit(x) for x in sorted(LEGAL)])
    broken = count(lambda j: j["a"].isNotNull() & ~F.array_contains(legal, F.concat(j["a"], j["b"])))
    low, high = F.array_min(F.transform("s", lambda x: x["from"])), F.array_max(F.transform("s", lambda x: x["to"]))
    gaps = F.coalesce(high - low + 1 - (add("turns") - count(lambda j: j["t"] == j["f"])), F.lit(0))
    return seg.select("c", gaps.alias("gaps"), *[add(k).alias(k) for k in ("blank", "duplicate", "truncated")], (add("illegal") + broken).alias("illegal"), add("cost").alias("cost"), F.array_join(F.transform("s", lambda x: x["audit"]), "").alias("audit"))


def repair(turns: DataFrame, conversations: DataFrame, parts: int | None = None) -> DataFrame:
    """turns: conv_id, turn, role, text, n; conversations: distinct conv_id to return."""
    rows = prepared(turns)
    edited = edits(rows, parts)
    c = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    out = conversations.withColumn("c", c).join(summaries(edited), "c", "left").join(digests(repaired(rows, edited)), "c", "left")
    counts = [F.coalesce(k, F.lit(0).cast("bigint")).alias(k) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The damage that the query's contract asks for, by crc32 of `conv_id:turn`; a row that is repeated has two copies."""
    blank = F.lit(" ")
    d = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank)).cast("binary")) % 20
    x = conversations.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), d.alias("d")).where("d <> 0")
    text = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return x.select("conv_id", "turn", F.when(F.col("d") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("d") == 3, 2).otherwise(1).alias("n"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: every conversation, damaged and repaired."""
    conversations = table(spark, sf_dir, "conversations")
    return repair(damaged(conversations), conversations.select("conv_id").distinct())
