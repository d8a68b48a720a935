"""Repair of conversations by depth-first branch and bound over edits of their turns.

A conversation is right if the first letters of its roles read ``(s?(ua)+)?``: perhaps a system
turn, then user and assistant in turn. Spark puts all turns in order, finds blank, repeated and cut
off ones and sends a byte per turn to the search; texts do not go along. The search returns what
becomes of each turn, and a join makes the repaired turns out of that, so neither a long
conversation nor one that holds a third of all rows lies in one task with its texts.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendline.llm.common import WORD_PATTERN
from trendline.workspace import written_once

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
SEGMENT_BITS = 8
# How a turn is told to the search: its role's letter, in capitals if it is cut off,
# as a number if it has to go. Letters other than s, u and a are told as x.
LETTERS, CUT_OFF, TO_GO = "suax", "SUAX", "1234"
# What has been put out so far: nothing, a system turn, a user or an assistant turn last.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
LONGS = "gaps blank duplicate truncated illegal cost".split()
SOLVED = (
    "group_key long, illegal long, cost long, audit string, "
    "parts array<struct<first:bigint,fates:array<string>>>"
)


def _edits(code: str, state: int) -> list[tuple[str, str, int, int]]:
    """What may become of a turn, in the order of the edits' letters: letter, fate, cost, state."""
    user_next = state != USER
    due, after = ("u", USER) if user_next else ("a", ASSISTANT)
    found = [(DELETE, "", DELETE_COST, state)]
    if code in TO_GO:
        return found
    flaw = TRUNCATED_COST if code in CUT_OFF else 0
    letter = code.lower()
    if letter == due:
        found.append((KEEP, "k", flaw, after))
    elif letter == "s" and state == NOTHING:
        found.append((KEEP, "k", flaw, SYSTEM))
    if letter != due:
        found.append((REROLE, due, REROLE_COST + flaw, after))
    return found


def _inserted(state: int) -> tuple[str, int]:
    """The fate that tells an insertion, and the state after it."""
    return ("A", ASSISTANT) if state == USER else ("U", USER)


def suffix_bounds(codes: str) -> list[tuple[int, int, int, int]]:
    """For every place and state, a cost that no repair of the turns from there can stay below.

    The bounds leave out that a system turn needs a pair after it.
    """
    bounds = [(0, 0, INSERT_COST, 0)]
    for code in reversed(codes):
        rest = bounds[-1]
        row = [min(cost + rest[after] for _, _, cost, after in _edits(code, s)) for s in range(4)]
        for state in (ASSISTANT, USER, SYSTEM, NOTHING, ASSISTANT):
            row[state] = min(row[state], INSERT_COST + row[_inserted(state)[1]])
        bounds.append(tuple(row))
    return bounds[::-1]


class _Path:
    """An edit and the ones before it."""

    __slots__ = ("before", "letter", "fate")

    def __init__(self, before: _Path | None, letter: str, fate: str):
        self.before, self.letter, self.fate = before, letter, fate

    def edits(self) -> list[tuple[str, str]]:
        found, path = [], self
        while path.before is not None:
            found.append((path.letter, path.fate))
            path = path.before
        return found[::-1]


def _moves(codes: str, place: int, state: int) -> list[tuple[str, str, int, int, int]]:
    """All edits at a node in the order of their letters: letter, fate, cost, place and state."""
    fate, after = _inserted(state)
    moves = [(INSERT, fate, INSERT_COST, place, after)]
    if place < len(codes):
        moves += [(*edit[:3], place + 1, edit[3]) for edit in _edits(codes[place], state)]
    return sorted(moves)


def _is_right(codes: str, place: int, state: int) -> bool:
    return place == len(codes) and state in (NOTHING, ASSISTANT)


def _dive(codes: str, bounds: list[tuple]) -> tuple[int, list[tuple[str, str]]]:
    """A first incumbent: always the edit of the smallest cost and bound, the first of equal ones."""
    place, state, total, path = 0, NOTHING, 0, _Path(None, "", "")
    while not _is_right(codes, place, state):
        letter, fate, cost, place, state = min(
            _moves(codes, place, state), key=lambda move: move[2] + bounds[move[3]][move[4]]
        )
        total, path = total + cost, _Path(path, letter, fate)
    return total, path.edits()


def search(codes: str) -> tuple[int, str, list[str]]:
    """The least cost, the audit and the fate of every turn of a conversation told as ``codes``.

    A fate holds a letter for each turn put out: k the turn itself, u and a the turn as user or
    assistant, U and A an inserted one; inserted turns belong to the turn they stand before, at
    the end to the last one. The conversation without turns is right as it is.

    Edits are tried depth first in the order of their letters. So of two ways to a node at the
    same cost the one found first has the smaller audit, and each node needs to be left again only
    at a lower cost, which its entry in the dominance table tells. A way whose cost and bound
    together exceed the incumbent's cost is cut off. When the stack is empty, the incumbent is best.
    """
    bounds = suffix_bounds(codes)
    incumbent, edits = _dive(codes, bounds)
    audit = "".join(letter for letter, _ in edits)
    table: dict[tuple[int, int], int] = {}
    stack = [(0, 0, NOTHING, _Path(None, "", ""))]
    while stack:
        total, place, state, path = stack.pop()
        if total + bounds[place][state] > incumbent or table.get((place, state), total + 1) <= total:
            continue
        table[place, state] = total
        if _is_right(codes, place, state):
            found = path.edits()
            letters = "".join(letter for letter, _ in found)
            if (total, letters) < (incumbent, audit):
                incumbent, audit, edits = total, letters, found
        for letter, fate, cost, place_after, after in reversed(_moves(codes, place, state)):
            stack.append((total + cost, place_after, after, _Path(path, letter, fate)))
    return incumbent, audit, _fates(edits, len(codes))


def _fates(edits: list[tuple[str, str]], turns: int) -> list[str]:
    """The edits turn by turn."""
    fates, waiting = [], ""
    for letter, fate in edits:
        waiting += fate
        if letter != INSERT:
            fates.append(waiting)
            waiting = ""
    if turns:
        fates[-1] += waiting
    return fates


def illegal_pairs(codes: str) -> int:
    """Neighbours whose roles do not follow one another."""
    letters = codes.lower().translate(str.maketrans(TO_GO, LETTERS))
    return sum(pair not in ("su", "ua", "au") for pair in map("".join, zip(letters, letters[1:], strict=False)))


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = {name: [] for name in ("group_key", "illegal", "cost", "audit", "parts")}
        for key, parts in zip(batch["group_key"].to_pylist(), batch["parts"], strict=True):
            parts = sorted(parts.as_py(), key=lambda part: part["first"])
            codes = "".join("".join(part["codes"]) for part in parts)
            cost, audit, fates = search(codes)
            taken, told = 0, []
            for part in parts:
                own = []
                for code in part["codes"]:
                    own.append("".join(fates[taken : taken + len(code)]))
                    taken += len(code)
                told.append({"first": part["first"], "fates": own})
            values = (key, illegal_pairs(codes), cost, audit, told)
            for name, value in zip(rows, values, strict=True):
                rows[name].append(value)
        parts = pa.list_(pa.struct([("first", pa.int64()), ("fates", pa.list_(pa.string()))]))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), parts)
        columns = [pa.array(rows[name], kind) for name, kind in zip(rows, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, list(rows))


def _ordered(turns: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """Distinct turns with their number of ``copies`` and a ``place`` that grows along the order.

    Places are dealt by ranges of conversation, turn, role and text, so a long conversation is
    spread over tasks; rows alike in all four were added up before, so no range is larger for them.
    """
    rows = turns.select(
        turns[key].alias("conv"),
        turns[turn].alias("turn"),
        F.coalesce(turns[role], F.lit(" ")).alias("role"),
        F.coalesce(turns[text], F.lit(" ")).alias("text"),
    )
    order = ["conv", "turn", "role", "text"]
    distinct = rows.groupBy(*order).agg(F.count("*").alias("copies"))
    tasks = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = distinct.repartitionByRange(max(tasks, 1), *order).sortWithinPartitions(*order)
    placed = dealt.withColumn("place", F.monotonically_increasing_id())
    said = F.sha2(F.concat(F.lower(F.hex("role")), F.lit(":"), "text"), 256)
    return written_once(placed.withColumn("said", said), "turns")


def _letter(role: Column) -> Column:
    """1 to 4 for a role that begins with s, u, a or anything else."""
    first = F.substring(role, 1, 1)
    place = F.instr(F.lit("sua"), first)
    return F.when((place == 0) | (first == F.lit("")), F.lit(4)).otherwise(place)


def _faulty(rows: DataFrame) -> DataFrame:
    """The turns without their texts, with counts of faults and a ``code`` of a letter per copy."""
    alike = rows.groupBy("conv", "said").agg(F.min("place").alias("_first"), F.count("*").alias("_n"))
    alike = written_once(alike.filter("_n > 1").select("conv", "said", "_first"), "said-again")
    again = alike.toDF("_conv", "_said", "_first")
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    narrow = rows.select(
        "conv",
        "turn",
        "place",
        "copies",
        "said",
        _letter(F.col("role")).alias("letter"),
        (~F.col("text").rlike(WORD_PATTERN)).alias("is_blank"),
        (~last.isin(".", "!", "?")).alias("is_open"),
    )
    same = narrow["conv"].eqNullSafe(again["_conv"]) & (narrow["said"] == again["_said"])
    marked = narrow.join(again, same, "left")
    later = F.coalesce(F.col("place") > F.col("_first"), F.lit(False))
    blank = F.when(F.col("is_blank"), F.col("copies")).otherwise(0)
    repeats = F.when(later, F.col("copies")).otherwise(F.col("copies") - 1)
    copies = F.when(F.col("is_blank"), 0).otherwise(repeats)
    is_cut = ~F.col("is_blank") & ~later & F.col("is_open")

    def letter(kind: str) -> Column:
        return F.substring(F.lit(kind), F.col("letter"), F.lit(1))

    goes = F.col("is_blank") | later
    head = F.when(goes, letter(TO_GO)).when(is_cut, letter(CUT_OFF)).otherwise(letter(LETTERS))
    rest = F.repeat(letter(TO_GO), (F.col("copies") - 1).cast("int"))
    return marked.select(
        "conv",
        "turn",
        "place",
        blank.alias("blank"),
        copies.alias("duplicate"),
        is_cut.cast("bigint").alias("truncated"),
        F.concat(head, rest).alias("code"),
    )


def repair(
    turns: DataFrame,
    key: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """The repaired turns, and a row per conversation that says what was wrong and done.

    Repaired turns: key, ``place`` and ``step`` (their order), ``turn`` (that of the turn they come
    from), ``role``, ``text`` and ``edit`` (K, R or I). Conversations: key, ``gaps``, ``blank``,
    ``duplicate``, ``truncated``, ``illegal``, ``cost`` and ``audit``.

    Turns go by their number, NULL first, then by role and text. A NULL role or text is one space,
    the NULL key is a conversation of its own. Equal rows are copies, all but the first of them
    duplicates. A turn's first fault counts: blank, then duplicate (role and text were
    there before), then truncated (the last character that is no white space ends no sentence).
    Roles that begin with another letter than s, u or a, and empty ones, never fit. Empty tables
    give no rows. Gaps beyond 64 bits are given as the largest long.
    """
    rows = _ordered(turns, key, turn, role, text)
    told = written_once(_faulty(rows), "faults")
    span = F.max("turn").cast("decimal(38,0)") - F.min("turn").cast("decimal(38,0)") + 1
    missing = F.coalesce(span - F.count_distinct("turn"), F.lit(0).cast("decimal(38,0)"))
    gaps = F.least(missing, F.lit(2**63 - 1).cast("decimal(38,0)"))
    counts = told.groupBy("conv").agg(
        gaps.cast("bigint").alias("gaps"),
        *[F.sum(name).cast("bigint").alias(name) for name in ("blank", "duplicate", "truncated")],
        F.min("place").alias("group_key"),
    )
    counts = written_once(counts, "conversations")
    # Consecutive places of a conversation, at most 256 in a segment.
    segment = F.shiftright("place", SEGMENT_BITS).alias("segment")
    listed = F.array_sort(F.collect_list(F.struct("place", "code")))
    segments = told.groupBy("conv", segment).agg(listed.alias("listed"))
    part = F.struct(
        F.col("listed")[0]["place"].alias("first"), F.col("listed")["code"].alias("codes")
    )
    of_one = segments.select("conv", part.alias("part"))
    whole = of_one.groupBy("conv").agg(
        F.min("part.first").alias("group_key"), F.collect_list("part").alias("parts")
    )
    solved = written_once(whole.select("group_key", "parts").mapInArrow(_solve, SOLVED), "solved")
    report = counts.join(solved.drop("parts"), "group_key").select(
        F.col("conv").alias(key), *LONGS[:4], "illegal", "cost", "audit"
    )
    parts = solved.select(F.explode("parts").alias("part")).select(
        F.col("part.first").alias("first"), F.posexplode("part.fates").alias("nth", "fates")
    )
    fates = parts.select((F.col("first") + F.col("nth")).alias("place"), "fates")
    steps = F.posexplode(F.split("fates", "")).alias("step", "fate")
    lines = rows.join(fates.filter("fates <> ''"), "place").select("*", steps)
    added = F.col("fate").isin("U", "A")
    new_role = F.when(F.lower("fate") == F.lit("u"), F.lit("user")).otherwise(F.lit("assistant"))
    edit = F.when(added, F.lit(INSERT)).when(F.col("fate") == F.lit("k"), F.lit(KEEP))
    repaired = lines.filter("fate <> ''").select(
        F.col("conv").alias(key),
        "place",
        "step",
        F.when(~added, F.col("turn")).alias("turn"),
        F.when(F.col("fate") == F.lit("k"), F.col("role")).otherwise(new_role).alias("role"),
        F.when(added, F.lit("")).otherwise(F.col("text")).alias("text"),
        F.coalesce(edit, F.lit(REROLE)).alias("edit"),
    )
    return repaired, report


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from hashlib import sha256

    def told(keys, hashes):
        columns = [pa.array(keys, pa.int64()), pa.array(hashes, pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["conv", "repaired_sha256"])

    open_key, digest = None, None
    for batch in batches:
        keys, hashes = [], []
        for key, role, text in zip(batch["conv"].to_pylist(), batch["role"], batch["text"], strict=True):
            line = f"{role.as_py()}:{text.as_py()}".encode("utf-8", "surrogatepass")
            if digest is None or key != open_key:
                if digest is not None:
                    keys.append(open_key)
                    hashes.append(digest.hexdigest())
                open_key, digest = key, sha256(line)
            else:
                digest.update(b"\n" + line)
        yield told(keys, hashes)
    if digest is not None:
        yield told([open_key], [digest.hexdigest()])


def digests(repaired: DataFrame, key: str = "conv_id") -> DataFrame:
    """Key and ``repaired_sha256`` of conversations that have turns left.

    It hashes ``role:text`` of all turns in order, joined by newlines. A conversation streams through its task.
    """
    rows = repaired.select(F.col(key).cast("bigint").alias("conv"), "place", "step", "role", "text")
    tasks = int(repaired.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(max(tasks, 1), "conv").sortWithinPartitions("conv", "place", "step")
    found = rows.select("conv", "role", "text").mapInArrow(
        _digests, "conv long, repaired_sha256 string"
    )
    return found.withColumnRenamed("conv", key)


def damaged(turns: DataFrame) -> DataFrame:
    """The turns of ``conversations`` with known faults, drawn from a check sum of key and turn."""
    number = [F.coalesce(F.col(name).cast("string"), F.lit(" ")) for name in ("conv_id", "turn")]
    draw = F.crc32(F.concat(number[0], F.lit(":"), number[1])) % F.lit(20)
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    bare = F.regexp_replace(text, "[.!?]", "")
    said = F.when(draw == 1, F.lit("")).when(draw == 2, bare).otherwise(text)
    copies = F.when(draw == 3, F.lit(2)).otherwise(F.lit(1))
    rows = turns.select("conv_id", "turn", "role", "text").filter(draw != 0)
    return rows.select(
        "conv_id",
        "turn",
        F.when(draw == 4, F.lit("user")).otherwise(role).alias("role"),
        said.alias("text"),
        F.explode(F.sequence(F.lit(1), copies)).alias("_copy"),
    ).drop("_copy")


def repair_report(original: DataFrame, turns: DataFrame) -> DataFrame:
    """A row for every ``conv_id`` of ``original`` with the faults, cost, audit and digest of its ``turns``."""
    repaired, report = repair(turns)
    repaired_digests = digests(repaired).toDF("_digested", "repaired_sha256")
    found = report.withColumnRenamed("conv_id", "_conv")
    keys = original.select("conv_id").distinct()
    result = keys.join(found, keys["conv_id"].eqNullSafe(found["_conv"]), "left")
    same = result["conv_id"].eqNullSafe(repaired_digests["_digested"])
    result = result.join(repaired_digests, same, "left")
    nothing = F.sha2(F.lit(""), 256)
    return result.select(
        "conv_id",
        *[F.coalesce(name, F.lit(0)).alias(name) for name in LONGS],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"),
    )
