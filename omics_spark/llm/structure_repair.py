"""Repair of conversation structure by iterative-deepening A*.

A sound conversation is an optional system turn and then user and assistant
turns in pairs: role initials ``(s?(ua)+)?``. A conversation is repaired row
by row with the edits Delete, Insert, Keep and Rerole; the cheapest sequence
of edits is wanted, of equally cheap ones the first in ASCII order.

The search goes depth first through the edits in ASCII order under a cost
bound, and raises the bound to the least cost that went over it until a path
is accepted. The estimate of what is left is the cost of the rows that no
edit saves; a table keeps, for each state that failed, how much it was given,
which cuts the state off at no greater allowance and raises its estimate.

Long conversations are cut into blocks of BLOCK rows. Within a block the
search runs from each state of the grammar to each other one; the blocks of a
conversation are then chained by those costs. An edit sequence ends with the
row it takes up, so no block's sequence is the beginning of another's, and
the first sequence of the whole is made of the first ones of its blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc32_of_id, grouped_streams, map_batches, positions, slices, written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Rows searched at once.
BLOCK = 64
#: States: nothing yet, after the system turn, after a user, after an
#: assistant. In a state, a user or an assistant turn may come next, and a
#: system turn at the start.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
WANTED = {0: "u", 1: "u", 2: "a", 3: "u"}
ROLES = {"u": "user", "a": "assistant"}
ENDS = {0, 3}
NEVER = 1 << 40
BLANK = " \t\n\x0b\x0c\r"
# The code of a row: its role's initial s, u, a or another (o), a small letter
# if the row is sound, a capital if truncated; x must go.


def _least(code: str) -> int:
    return DELETE if code == "x" or code.isupper() else KEEP


class Search:
    """The rows of one block, by their codes."""

    def __init__(self, codes: str, last: bool):
        self.codes, self.last = codes, last
        self.rest = [0] * (len(codes) + 1)
        for i in range(len(codes) - 1, -1, -1):
            self.rest[i] = self.rest[i + 1] + _least(codes[i])

    def edits(self, at: int, state: int) -> Iterator[tuple[str, int, int, int]]:
        """(letter, cost, row after it, state after it), in ASCII order."""
        after = NEXT[state, WANTED[state]]
        if at < len(self.codes):
            code = self.codes[at]
            yield "D", DELETE, at + 1, state
            yield "I", INSERT, at, after
            if code != "x":
                more = TRUNCATED if code.isupper() else 0
                kept = NEXT.get((state, code.lower()))
                if kept is not None:
                    yield "K", KEEP + more, at + 1, kept
                yield "R", REROLE + more, at + 1, after
        elif self.last:
            yield "I", INSERT, at, after

    def accepts(self, at: int, state: int, goal: int | None) -> bool:
        return at == len(self.codes) and (state in ENDS if goal is None else state == goal)

    def cheapest(self, state: int, goal: int | None = None, limit: int = NEVER) -> tuple[int, str] | None:
        """(cost, letters) of the first cheapest path from ``state`` to the
        end of the rows and the state ``goal``, or to any accepting state.
        None if there is none of a cost under ``limit``."""
        failed: dict[tuple[int, int], int] = {}
        bound = self.rest[0]
        while bound < limit:
            path: list[str] = []
            over = self._deepen(0, state, goal, bound, failed, path)
            if over is None:
                return bound, "".join(reversed(path))
            bound = over
        return None

    def _deepen(self, at: int, state: int, goal: int | None, allowed: int, failed: dict, path: list[str]) -> int | None:
        """None if a path costs at most ``allowed`` (its letters, last first,
        go to ``path``), else the least allowance that might do."""
        if self.accepts(at, state, goal):
            return None
        least = NEVER
        for letter, cost, then, after in self.edits(at, state):
            need = max(self.rest[then], failed.get((then, after), 0))
            if cost + need <= allowed:
                over = self._deepen(then, after, goal, allowed - cost, failed, path)
                if over is None:
                    path.append(letter)
                    return None
                need = over
            least = min(least, cost + need)
        failed[at, state] = max(least, failed.get((at, state), 0))
        return least


def ways(codes: str, first: bool, last: bool) -> list[dict]:
    """Each way through a block: its states before and after (-1: the end of
    the conversation), cost, rank among those of its first state, letters."""
    search, found = Search(codes, last), []
    for start in (0,) if first else range(4):
        mine = []
        if last:
            mine.append((*search.cheapest(start), -1))
        else:
            # All rows deleted, two inserts lead to any state that can be reached.
            limit = DELETE * len(codes) + 2 * INSERT + TRUNCATED + 1
            for goal in range(4):
                reached = goal >= 2 or goal == start or ((start, goal) == (0, 1) and "s" in codes.lower())
                if reached and (way := search.cheapest(start, goal, limit)) is not None:
                    mine.append((*way, goal))
        order = sorted(letters for _, letters, _ in mine)
        found += [{"start": start, "goal": goal, "cost": cost, "rank": order.index(letters), "letters": letters} for cost, letters, goal in mine]
    return found


def chain(blocks: list[list[tuple[int, int, int, int]]]) -> list[tuple[int, int]]:
    """(state before, state after) of each block on the first cheapest path;
    a block is its ways as (start, goal, cost, rank)."""
    rest = {-1: 0}
    left = []
    for block in reversed(blocks):
        left.append(rest)
        best: dict[int, int] = {}
        for start, goal, cost, _ in block:
            if goal in rest:
                best[start] = min(best.get(start, NEVER), cost + rest[goal])
        rest = best
    state, chosen = 0, []
    for block, rest in zip(blocks, reversed(left), strict=True):
        options = [(cost + rest[goal], rank, goal) for start, goal, cost, rank in block if start == state and goal in rest]
        _, _, goal = min(options)
        chosen.append((state, goal))
        state = goal
    return chosen


def damaged(messages: DataFrame) -> DataFrame:
    """``messages`` (conv_id, turn, role, text) after planted damage, with
    ``copy``: crc32("conv_id:turn") % 20 of 0 drops a row, 1 empties its
    text, 2 takes ``.!?`` out of it, 3 repeats the row, 4 makes it a user's.
    Null is one space, in role, text and that string; turn stays null."""
    turn, conv = F.col("turn").cast("long"), F.col("conv_id").cast("long")
    named = F.concat(F.coalesce(conv.cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(turn.cast("string"), F.lit(" ")))
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    harm = (crc32_of_id(named) % 20).alias("harm")
    rows = messages.select(conv.alias("conv_id"), turn.alias("turn"), role.alias("role"), text.alias("text"), harm).where("harm <> 0")
    return rows.select("conv_id", "turn",
                       F.when(F.col("harm") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
                       F.when(F.col("harm") == 1, F.lit("")).when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
                       F.explode(F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))


def facts(messages: DataFrame) -> DataFrame:
    """(conv, conv_id, turn, pos, initial, blank, duplicate, truncated) of
    each row of ``messages`` (conv_id, turn, role, text, all but turn and
    conv_id without nulls); ``conv`` names the conversation without nulls.

    Rows come by turn, nulls first, ties by the hash of role and text. Each
    row has its first fault alone. Texts are read once and left behind; a
    repeated text is found by its hash, counted before rows are shuffled.
    """
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv")
    said = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary")
    last = F.substring(F.rtrim("text", F.lit(BLANK)), -1, 1)
    rows = messages.select(conv, "conv_id", "turn", F.unhex(F.md5(said)).alias("said"), F.substring("role", 1, 1).alias("initial"),
                           (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("open"))
    rows = written(positions(rows, "conv", [F.col("turn"), F.col("said")], "pos"))
    first = (rows.groupBy(F.col("conv").alias("c"), F.col("said").alias("s")).agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("times"))
             .where("times > 1"))
    seen = F.coalesce(F.col("first") < F.col("pos"), F.lit(False))
    return (rows.join(first, (F.col("conv") == F.col("c")) & (F.col("said") == F.col("s")), "left")
            .select("conv", "conv_id", "turn", "pos", "initial", "blank", (~F.col("blank") & seen).alias("duplicate"),
                    (~F.col("blank") & ~seen & F.col("open")).alias("truncated")))


def code_of() -> Column:
    known = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise(F.lit("o"))
    return F.when(F.col("blank") | F.col("duplicate"), F.lit("x")).when(F.col("truncated"), F.upper(known)).otherwise(known)


def blocks_of(rows: DataFrame) -> DataFrame:
    """(conv, block, last, ways) from ``facts``."""
    sizes = rows.groupBy("conv").agg(F.floor(F.max("pos") / BLOCK).cast("long").alias("end"))
    codes = (rows.withColumn("block", F.floor(F.col("pos") / BLOCK).cast("long"))
             .groupBy("conv", "block").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", code_of().alias("code")))), lambda x: x["code"]), "").alias("codes")))
    cut = codes.join(sizes, "conv").select("conv", "block", (F.col("block") == F.col("end")).alias("last"), "codes")
    # Few bytes and much work: the number of tasks is given, not left to size.
    cut = cut.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "conv", "block")

    def run(columns: dict) -> dict:
        found = [ways(c, b == 0, last) for c, b, last in zip(columns["codes"], columns["block"], columns["last"], strict=True)]
        return {"conv": columns["conv"], "block": columns["block"], "last": columns["last"], "ways": found}

    return map_batches(cut, "conv string, block long, last boolean, ways array<struct<start: int, goal: int, cost: bigint, rank: int, letters: string>>", run)


def edits_of(rows: DataFrame) -> DataFrame:
    """(conv, block, state, cost, letters): the edits of each block."""
    found = written(blocks_of(rows))
    whole = found.where("block = 0 and last")
    long = found.where("not (block = 0 and last)")

    def chained(batches):
        from itertools import groupby

        import pyarrow as pa

        names = ["conv", "block", "start", "goal"]
        each = (r for b in slices(batches) for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for conv, mine in groupby(each, key=lambda r: r[0]):
            steps = chain([[(w["start"], w["goal"], w["cost"], w["rank"]) for w in r[2]] for r in mine])
            for at in range(0, len(steps), 10_000):
                part = steps[at:at + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([conv] * len(part)), pa.array(range(at, at + len(part)), pa.int64()),
                                                  pa.array([s for s, _ in part], pa.int32()), pa.array([g for _, g in part], pa.int32())], names=names)

    # Of a conversation of n rows, n / BLOCK rows of sixteen costs come to one task.
    slim = long.select("conv", "block", F.transform("ways", lambda w: F.struct(w["start"].alias("start"), w["goal"].alias("goal"), w["cost"].alias("cost"), w["rank"].alias("rank"))).alias("ways"))
    steps = slim.repartition("conv").sortWithinPartitions("conv", "block").mapInArrow(chained, "conv string, block long, start int, goal int")
    picked = (long.join(steps, ["conv", "block"])
              .select("conv", "block", F.filter("ways", lambda w: (w["start"] == F.col("start")) & (w["goal"] == F.col("goal")))[0].alias("w")))
    return whole.select("conv", "block", F.col("ways")[0].alias("w")).unionByName(picked).select("conv", "block", F.col("w.start").alias("state"), F.col("w.cost").alias("cost"), F.col("w.letters").alias("letters"))


def apply_edits(letters: Iterator[str], rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The repaired (role, text) of ``rows``."""
    state = 0
    for letter in letters:
        role = ROLES[WANTED[state]]
        if letter == "I":
            state = NEXT[state, WANTED[state]]
            yield role, ""
            continue
        kept, text = next(rows)
        if letter == "K":
            state = NEXT[state, kept[0]]
            yield kept, text
        elif letter == "R":
            state = NEXT[state, WANTED[state]]
            yield role, text


def repair(messages: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256), one row for each conversation of ``messages`` (conv_id,
    turn, role, text) and each further conv_id of ``conversations``.

    Null role and text are one space; a null conv_id is a conversation. Rows
    come by turn, nulls first, ties by the hash of role and text. A
    conversation without rows has zeros, an empty audit and the hash of
    nothing. Only the edits, a letter for each row, are gathered for a
    conversation; texts stream through their hash.
    """
    space = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text")}
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(e.alias(c) for c, e in space.items()))
    known = written(facts(rows))
    edits = written(edits_of(known))

    pair = F.concat("initial", "following")
    follow = known.select("conv", (F.col("pos") - 1).alias("pos"), F.col("initial").alias("following"))
    illegal = (known.select("conv", "pos", "initial").join(follow, ["conv", "pos"]).where(~pair.isin("su", "ua", "au"))
               .groupBy("conv").agg(F.count(F.lit(1)).alias("illegal")))
    turns = known.groupBy("conv", "turn").agg(F.first("conv_id").alias("conv_id"), *(F.sum(F.col(c).cast("long")).alias(c) for c in ("blank", "duplicate", "truncated")))
    counts = turns.groupBy("conv").agg(
        F.first("conv_id").alias("conv_id"), F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"),
        *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")))
    costs = edits.groupBy("conv").agg(F.sum("cost").alias("cost"))
    hashes = repaired_hashes(rows, edits)
    done = counts.join(costs, "conv").join(hashes, "conv").join(illegal, "conv", "left")
    if conversations is not None:
        ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
        ids = ids.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), F.col("conv_id").alias("original"))
        done = done.join(ids, "conv", "full").withColumn("conv_id", F.coalesce("conv_id", "original"))
    return done.select("conv_id", *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                       F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"))


def repaired_hashes(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv, audit, repaired_sha256): the edits of a conversation come
    first, its rows after them, one by one."""
    said = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary")
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    texts = rows.select(conv.alias("conv"), F.lit(1).alias("kind"), F.col("turn").alias("place"), F.unhex(F.md5(said)).alias("tie"), "role", "text", F.lit(None).cast("string").alias("letters"))
    pieces = edits.select("conv", F.lit(0).alias("kind"), F.col("block").alias("place"), F.lit(None).cast("binary").alias("tie"),
                          F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "letters")

    def fold(conv, stream):
        import hashlib
        from itertools import chain as link

        audit, first = [], None
        for row in stream:
            if row[1]:
                first = row
                break
            audit.append(row[6])
        audit = "".join(audit)
        texts = ((r[4], r[5]) for r in link([first] if first else [], stream))
        h, line = hashlib.sha256(), ""
        for role, text in apply_edits(iter(audit), texts):
            h.update(f"{line}{role}:{text}".encode())
            line = "\n"
        return conv, audit, h.hexdigest()

    return grouped_streams(pieces.unionByName(texts), "conv", ["kind", "place", "tie"], "conv string, audit string, repaired_sha256 string", fold)
