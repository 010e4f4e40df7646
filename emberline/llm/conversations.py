r"""Conversation structure repair by a scalar big-integer shortest path.

Faults (``damage`` plants some): a row is blank, a repeat of an earlier role and text, or
truncated. The cheapest edits that turn the role initials into ``(s?(ua)+)?`` are the
shortest path through a directed acyclic graph of nodes (rows read, grammar state). A
path's weight is one integer: its high digits are the cost, below them stand as many
base-256 digits as the longest edit word has letters, the first letter highest, zeros at
the end. The ordinary minimum of such integers is the cheapest path and, among equals,
the one whose letters are least in ASCII (D < I < K < R); nothing else is compared.

Rows are range-partitioned by (conversation, turn, role, text hash), so a conversation of
any size is spread over tasks. Inside a task chunks of ``CHUNK_ROWS`` rows become tables
of best paths from state to state. A conversation that begins and ends inside one task is
finished there; the chunks of one that touches a task's border are put together in order
by ``_folded``, which streams them and keeps, for each state, the best path so far and a
running SHA-256. (Hashing a text is sequential by nature; it and the edit word, a cell of
the result, are all that one task must see of a conversation.) Whether a role and text
was seen earlier is known from narrow marker rows, one for each (conversation, role, text
hash), which are sorted right before the first row that has them.

Rows of a conversation are taken by turn, nulls first, then role and hash of the text.
Null roles and texts count as one space, so such a text is blank and such a role is no
letter of the grammar; a null conv_id is a conversation of its own. Repeated rows are
duplicates. A conversation whose rows are all dropped has zeros, an empty audit and the
hash of the empty string. Texts of any length are whole. Extra columns are not read.
Empty table: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import drop_scratch, materialize

BLANK = r"[^\x20\x09-\x0D]"
#: Rows to a table of best paths; only time depends on it.
CHUNK_ROWS = 64

#: Grammar states: 0 nothing yet, 1 after s, 2 after u, 3 after a. A new or changed row takes the role that fits.
STATES = 4
NEXT = (2, 2, 3, 2)
FITS = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
FINAL = (0, 3)
KEEP, REROLE, DELETE, INSERT = b"KRDI"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
ROLE_OF = {2: "user", 3: "assistant"}


def damage(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows as the check sum of `conv_id:turn` damages them; copies 0 means dropped."""
    def text_of(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20
    rows = messages.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), kind.alias("kind"))
    text = (F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                       F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))


class Row:
    """A row as the graph sees it."""

    __slots__ = ("role", "text", "turn", "fault")

    def __init__(self, role: str, text: str, turn: int | None, fault: str):
        self.role, self.text, self.turn, self.fault = role, text, turn, fault


def best_paths(rows: list[Row], starts: Iterable[int] = range(STATES)) -> dict[tuple[int, int], tuple[int, bytes]]:
    """(start, end) -> (cost, letters) of the least path over these rows.

    Suffixes are extended to the left: a letter in front moves the others one digit down,
    and the zeros at the end make room for it.
    """
    digits = 3 * len(rows) + 2  # at most two insertions before, between and after rows
    low_bits = 8 * digits
    mask, unit, top = (1 << low_bits) - 1, 1 << low_bits, low_bits - 8
    best = {}

    def put(letter: int, cost: int, rest: int | None) -> int | None:
        if rest is None:
            return None
        low = rest & mask
        return rest - low + cost * unit + (letter << top) + (low >> 8)

    def least(*weights: int | None) -> int | None:
        return min((w for w in weights if w is not None), default=None)

    def inserted(plain: list[int | None]) -> list[int | None]:
        once = [least(plain[s], put(INSERT, INSERT_COST, plain[NEXT[s]])) for s in range(STATES)]
        return [least(plain[s], put(INSERT, INSERT_COST, once[NEXT[s]])) for s in range(STATES)]

    for end in range(STATES):
        weights = inserted([0 if s == end else None for s in range(STATES)])
        for row in reversed(rows):
            after = weights
            plain = [put(DELETE, DELETE_COST, after[s]) for s in range(STATES)]
            if row.fault not in ("blank", "duplicate"):
                extra = TRUNCATED_COST if row.fault == "truncated" else 0
                fits = FITS.get(row.role[:1], (None,) * STATES)
                for s in range(STATES):
                    kept = None if fits[s] is None else put(KEEP, extra, after[fits[s]])
                    plain[s] = least(plain[s], kept, put(REROLE, REROLE_COST + extra, after[NEXT[s]]))
            weights = inserted(plain)
        for s in starts:
            if weights[s] is not None:
                best[s, end] = (weights[s] >> low_bits, (weights[s] & mask).to_bytes(digits, "big").rstrip(b"\0"))
    return best


def repaired_lines(rows: Iterable[Row], letters: bytes, state: int) -> Iterator[str]:
    """The `role:text` lines that the edit word makes of the rows."""
    rows = iter(rows)
    for letter in letters:
        if letter == INSERT:
            state = NEXT[state]
            yield f"{ROLE_OF[state]}:"
            continue
        row = next(rows)
        if letter == KEEP:
            state = FITS[row.role[:1]][state]
            yield f"{row.role}:{row.text}"
        elif letter == REROLE:
            state = NEXT[state]
            yield f"{ROLE_OF[state]}:{row.text}"


class Tally:
    """Counts over consecutive rows; two neighbours add up."""

    FIELDS = ("blank", "duplicate", "truncated", "illegal", "turns", "least", "most", "opens", "closes")

    def __init__(self, rows: Iterable[Row] = ()):
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.least = self.most = self.opens = self.closes = None
        for row in rows:
            one = Tally()
            if row.fault:
                setattr(one, row.fault, 1)
            if row.turn is not None:
                one.turns, one.least, one.most = 1, row.turn, row.turn
            one.opens = one.closes = row.role[:1]
            self.add(one)

    def add(self, other: Tally) -> None:
        self.blank += other.blank
        self.duplicate += other.duplicate
        self.truncated += other.truncated
        self.illegal += other.illegal
        if other.opens is not None:
            if self.closes is not None:
                self.illegal += self.closes + other.opens not in ("su", "ua", "au")
            else:
                self.opens = other.opens
            self.closes = other.closes
        if other.turns:
            # rows come by turn, so only the border turn can be in both
            self.turns += other.turns - (self.most == other.least and self.turns > 0)
            self.least = other.least if self.least is None else self.least
            self.most = other.most

    def gaps(self) -> int:
        return self.most - self.least + 1 - self.turns if self.turns else 0


class Fold:
    """Chunks of one conversation in order: best path, counts and running hash for each state."""

    def __init__(self):
        self.tally = Tally()
        #: state -> (cost, letters after the part that all states share, hash)
        self.paths = {0: (0, b"", hashlib.sha256())}
        self.shared: list[bytes] = []
        self.empty = {0: True}

    def add(self, rows: list[Row], tally: Tally) -> None:
        self.tally.add(tally)
        if not rows:
            return
        table = best_paths(rows, self.paths)
        chosen = {}
        for end in range(STATES):
            options = [(self.paths[s][0] + table[s, end][0], self.paths[s][1] + table[s, end][1], s) for s in self.paths if (s, end) in table]
            if options:
                chosen[end] = min(options)
        paths, empty = {}, {}
        for end, (cost, letters, start) in chosen.items():
            digest, none = self.paths[start][2].copy(), self.empty[start]
            for line in repaired_lines(rows, table[start, end][1], start):
                digest.update((line if none else "\n" + line).encode())
                none = False
            paths[end], empty[end] = (cost, letters, digest), none
        words = [p[1] for p in paths.values()]
        low, high = min(words), max(words)
        same = next((k for k, (a, b) in enumerate(zip(low, high, strict=False)) if a != b), min(len(low), len(high)))
        self.shared.append(low[:same])
        self.paths = {s: (c, w[same:], d) for s, (c, w, d) in paths.items()}
        self.empty = empty

    def result(self) -> dict:
        cost, letters, digest = min((self.paths[s] for s in FINAL if s in self.paths), key=lambda p: p[:2])
        t = self.tally
        return {"gaps": t.gaps(), "blank": t.blank, "duplicate": t.duplicate, "truncated": t.truncated, "illegal": t.illegal, "cost": cost,
                "audit": (b"".join(self.shared) + letters).decode(), "repaired_sha256": digest.hexdigest()}


RESULT = {"gaps": "long", "blank": "long", "duplicate": "long", "truncated": "long", "illegal": "long", "cost": "long", "audit": "string", "repaired_sha256": "string"}
CHUNK = {"chunk": "long", "roles": "array<string>", "texts": "array<string>", "turns": "array<long>", "faults": "array<string>"}


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows and the markers of first occurrences, by range; a marker comes right before its row."""
    hashed = rows.withColumn("h", F.unhex(F.sha2("text", 256)).substr(1, 16))
    live = hashed.filter("copies > 0")
    first = (live.groupBy("conv_id", "role", "h").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("t"))
             .select("conv_id", F.col("t.turn").alias("turn"), "role", "h", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("text"), F.lit(1).alias("copies")))
    # a dropped row only says that its conversation exists
    told = hashed.select("conv_id", "turn", "role", "h", F.lit(1).alias("kind"), F.when(F.col("copies") > 0, F.col("text")).alias("text"), "copies")
    key = ["conv_id", "turn", "role", "h"]
    return told.unionByName(first).repartitionByRange(*key).sortWithinPartitions(*key, "kind")


def _stream(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple]:
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            yield from zip(*(batch.slice(start, 512).column(name).to_pylist() for name in names), strict=True)


def _row_stream(part: Iterable[tuple]) -> Iterator[Row]:
    """The rows of one conversation, each with its fault; ``part`` holds its markers too."""
    marked = None
    for _, turn, role, h, kind, text, copies in part:
        if kind == 0:
            marked = (turn, role, h)
            continue
        for _ in range(copies):
            first, marked = marked == (turn, role, h), None
            body = text.strip(" \t\n\v\f\r")
            yield Row(role, text, turn, "blank" if not body else "duplicate" if not first else "truncated" if body[-1] not in ".!?" else "")


def _chunks(rows: Iterable[Row]) -> Iterator[list[Row]]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == CHUNK_ROWS:
            yield held
            held = []
    if held:
        yield held


def _analysed(rows: DataFrame) -> DataFrame:
    """Finished conversations (place null), and the chunks of those at a task's borders."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, place int, " + ", ".join(f"{k} {v}" for k, v in (CHUNK | RESULT).items())
    names = [*CHUNK, *RESULT]
    arrow = {"long": pa.int64(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64())}

    def analysed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        place, key_type, out = TaskContext.get().partitionId(), None, []

        def typed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal key_type
            for batch in batches:
                key_type = batch.schema.field("conv_id").type
                yield batch

        def flush() -> pa.RecordBatch:
            columns = [pa.array([r[0] for r in out], key_type), pa.array([r[1] for r in out], pa.int32())]
            columns += [pa.array([r[2].get(n) for r in out], arrow[(CHUNK | RESULT)[n]]) for n in names]
            out.clear()
            return pa.record_batch(columns, names=["conv_id", "place", *names])

        groups = groupby(_stream(typed(batches), ("conv_id", "turn", "role", "h", "kind", "text", "copies")), key=lambda r: r[0])
        opening, waiting = True, None
        for conv, part in groups:
            if waiting is not None:  # not the last one of this task after all
                fold = Fold()
                for chunk in waiting[1]:
                    fold.add(chunk, Tally(chunk))
                out.append((waiting[0], None, fold.result()))
                waiting = None
            held, sent = [], 0
            for chunk in _chunks(_row_stream(part)):
                if not opening and not sent and len(held) < 64:
                    held.append(chunk)  # may turn out to be whole
                    continue
                for piece in [*held, chunk]:
                    out.append((conv, place, _packed(sent, piece)))
                    sent += 1
                    if len(out) >= 64:
                        yield flush()
                held = []
            if opening and not sent:
                out.append((conv, place, _packed(0, [])))
            elif not sent:
                waiting = (conv, held)
            opening = False
            if len(out) >= 256:
                yield flush()
        if waiting is not None:
            for k, piece in enumerate(waiting[1] or [[]]):
                out.append((waiting[0], place, _packed(k, piece)))
        if out:
            yield flush()

    return rows.mapInArrow(analysed, schema)


def _packed(number: int, rows: list[Row]) -> dict:
    return {"chunk": number, "roles": [r.role for r in rows], "texts": [r.text for r in rows], "turns": [r.turn for r in rows], "faults": [r.fault for r in rows]}


def _folded(chunks: DataFrame) -> DataFrame:
    """Chunks to finished conversations, as a stream: a task holds one chunk at a time."""
    kind = chunks.schema["conv_id"].dataType.simpleString()
    arrow = {"long": pa.int64(), "string": pa.string()}

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_type = None

        def typed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            nonlocal key_type
            for batch in batches:
                key_type = batch.schema.field("conv_id").type
                for k in range(batch.num_rows):
                    yield tuple(batch.column(n)[k].as_py() for n in ("conv_id", "roles", "texts", "turns", "faults"))

        for conv, part in groupby(typed(batches), key=lambda r: r[0]):
            fold = Fold()
            for _, *columns in part:
                rows = [Row(*values) for values in zip(*columns, strict=True)]
                fold.add(rows, Tally(rows))
            done = fold.result()
            yield pa.record_batch([pa.array([conv], key_type), *(pa.array([done[n]], arrow[t]) for n, t in RESULT.items())], names=["conv_id", *RESULT])

    ordered = chunks.repartition("conv_id").sortWithinPartitions("conv_id", "place", "chunk")
    return ordered.mapInArrow(folded, f"conv_id {kind}, " + ", ".join(f"{k} {v}" for k, v in RESULT.items()))


def repair(rows: DataFrame) -> DataFrame:
    """One row for each conv_id of (conv_id, turn, role, text, copies): faults, cost, edit word and hash of the repaired text."""
    analysed = materialize(_analysed(_ordered(rows)), "conversation-chunks")
    whole = analysed.filter("place IS NULL").select("conv_id", *RESULT)
    result = materialize(whole.unionByName(_folded(analysed.filter("place IS NOT NULL").select("conv_id", "place", *CHUNK))), "conversation-repairs")
    drop_scratch(rows.sparkSession, analysed)
    return result
