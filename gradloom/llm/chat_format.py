"""Conversations as training text: a machine over roles, segments with loss flags, and the way back.

A :class:`Template` declares for each role what stands before and after its text and whether its text is
under the loss mask, and a finite-state machine: which roles may follow in which state, and in which states a conversation may
end. Control strings inside of texts are escaped by a backslash after their first character, backslashes by a second
one, so no text can end its own turn and :func:`read_back` gives what was formatted.

A conversation may hold a third of all turns, so turns, and not conversations, are what is dealt out: by ranges
of conversation and turn, in order. A partition does not know in which state its first turn is met; it walks its first conversation
from every state at once and leaves the map from state before to state after. These maps, one for each partition, are chained on the
driver, and every turn gets its state by looking up the one that holds for its partition. The formatted text stays in pieces,
one for each turn, ordered by ``part, pos``. Only the digests of :func:`digests` are of whole
conversations: SHA-256 has no way to join parts, so the turns of a conversation stream in order through one task, which holds
one batch of them.

Defined results: a null text or role is empty; null turns come first, turns of equal number are ordered by role and the MD5 of
their text, repeated rows are turns of their own; a null conversation id is a conversation; a role that the template
doesn't name is written with its name and is never valid; a turn out of order is formatted like any other, and its
conversation's ``valid`` is false and ``first_error`` the number of its first bad turn (from 0; the number of turns where it
ends too early); an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradloom.llm.common import cut
from gradloom.workers import batches_of, ship

BATCH = 500
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean, first_error long"


@dataclass(frozen=True)
class Template:
    """``roles``: role to (before, after, loss). ``moves``: state to {role: next state}; the first state is where conversations
    begin. ``ends``: states in which they may end. ``other``: before the name of a role that isn't listed, between it and its text, after."""

    roles: dict[str, tuple[str, str, bool]]
    moves: dict[str, dict[str, str]]
    ends: frozenset[str]
    other: tuple[str, str, str]
    control: tuple[str, ...]
    states: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "states", (*self.moves, "error"))
        for c in self.control:
            if len(c) < 2 or "\\" in c:
                raise ValueError(f"control string {c!r} is too short or holds a backslash")
            for d in self.control:
                if c != d and c in d or any(c.endswith(d[:i]) for i in range(1, min(len(c), len(d)))):
                    raise ValueError(f"control strings {c!r} and {d!r} overlap")
        inside = set("".join(self.control))
        firsts = [before for before, _, _ in self.roles.values()]
        for before, after in [*((b, a) for b, a, _ in self.roles.values()), self.other[:2], self.other[1:]]:
            if not before or not after or before[-1] in inside or after[0] in inside or not any(c in after for c in self.control):
                raise ValueError(f"a text between {before!r} and {after!r} can't be told from them")
        if len({*firsts, self.other[0]}) != len(firsts) + 1 or any(a != b and a.startswith(b) for a in [*firsts, self.other[0]] for b in [*firsts, self.other[0]]):
            raise ValueError("the beginnings of turns can't be told from each other")

    def next(self, state: int, role: str) -> int:
        """The number of the state after ``role`` in the state of number ``state``; the last one is an error's."""
        after = self.moves.get(self.states[state], {}).get(role)
        return len(self.states) - 1 if after is None else self.states.index(after)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """The turn's segments: what is written, and whether it is under the loss mask."""
        special = re.compile("|".join(re.escape(c) for c in ("\\", *self.control)))

        def safe(t: str) -> str:
            return special.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", t)  # a backslash becomes two

        if role in self.roles:
            before, after, loss = self.roles[role]
            return [(before, False), (safe(text), loss), (after, False)]
        return [(self.other[0] + safe(role) + self.other[1], False), (safe(text), False), (self.other[2], False)]

    def turns(self, written: str) -> list[tuple[str, str]]:
        """Roles and texts of turns that were written one after the other: marks end them, as none is left inside of a text."""
        out, at = [], 0
        while at < len(written):
            role = next((r for r, (before, _, _) in self.roles.items() if written.startswith(before, at)), None)
            if role is None:
                if not written.startswith(self.other[0], at):
                    raise ValueError(f"no turn begins at {at}")
                at += len(self.other[0])
                end = written.index(self.other[1], at)
                role, at, after = unescaped(written[at:end]), end + len(self.other[1]), self.other[2]
            else:
                before, after, _ = self.roles[role]
                at += len(before)
            end = written.index(after, at)
            out.append((role, unescaped(written[at:end])))
            at = end + len(after)
        return out


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


#: User and assistant in turn, after a system's turn or none; only what assistants say is learnt.
INSTRUCT = Template(
    roles={"system": ("<<SYS>> ", " <</SYS>>\n", False), "user": ("[INST] ", " [/INST]", False), "assistant": (" <s> ", " </s>\n", True)},
    moves={"start": {"system": "told", "user": "asked"}, "told": {"user": "asked"}, "asked": {"assistant": "answered"}, "answered": {"user": "asked"}},
    ends=frozenset({"answered"}),
    other=("<<ROLE>> ", " <</ROLE>> ", " <</OTHER>>\n"),
    control=("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "<<ROLE>>", "<</ROLE>>", "<</OTHER>>"),
)


def formatted(rows: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """``conv_id, part, pos, segments (array of text, loss), state``: the turns of ``rows`` (conv_id, turn, role, text), in the
    order of ``part, pos``; ``state`` is the machine's after the turn, ``error`` from the first one on that isn't allowed.

    Writes them when it is called.
    """
    spark = rows.sparkSession
    ship(spark)
    states = range(len(template.states))
    turns = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = ["conv_id", "turn", "role", "tie"]
    ranged = turns.withColumn("tie", F.md5("text")).repartitionByRange(*order).sortWithinPartitions(*order)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, pos, last, now = TaskContext.get().partitionId(), 0, object(), list(states)
        for b in batches:
            segments, after = [], []
            for conv, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if conv != last:
                    now = list(states) if not pos and not after else [0] * len(states)
                    last = conv
                now = [template.next(s, role) for s in now]
                after.append(now)
                segments.append([{"text": t, "loss": loss} for t, loss in template.segments(role, text)])
            places = pa.array(range(pos, pos + b.num_rows), pa.int64())
            pos += b.num_rows
            yield pa.RecordBatch.from_arrays(
                [b.column("conv_id"), pa.array([part] * b.num_rows, pa.int32()), places, pa.array(segments, pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))), pa.array(after, pa.list_(pa.int32()))], names=["conv_id", "part", "pos", "segments", "after"]
            )

    with batches_of(spark, BATCH):
        walked = cut(ranged.drop("turn", "tie").mapInArrow(walk, "conv_id long, part int, pos long, segments array<struct<text: string, loss: boolean>>, after array<int>"), "turns")
    ends = walked.groupBy("part").agg(F.min(F.struct("pos", "conv_id"))["conv_id"].alias("first"), F.max(F.struct("pos", "conv_id", "after")).alias("last")).orderBy("part").collect()  # a row for each partition
    entry, state, before = [], 0, object()
    for e in ends:
        enters = state if e["first"] == before else 0
        entry += [F.lit(e["part"]), F.lit(enters)]
        state, before = e["last"]["after"][enters], e["last"]["conv_id"]
    own = F.get("after", F.create_map(*entry)[F.col("part")]) if entry else F.lit(0)
    return walked.select("conv_id", "part", "pos", "segments", F.get(F.array(*map(F.lit, template.states)), own).alias("state"))


def written(segments: str) -> Column:
    """A turn's text as it is written."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def _mask(segments: str) -> Column:
    return F.transform(segments, lambda s: F.struct(F.length(s["text"]).alias("chars"), s["loss"].alias("loss")))


def _learnt(text: str, mask: list[dict]) -> str | None:
    """What lies under the loss mask, unescaped; None where nothing does."""
    at, out = 0, None
    for m in mask:
        if m["loss"]:
            out = (out or "") + unescaped(text[at : at + m["chars"]])
        at += m["chars"]
    return out


def read_back(pieces: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """``conv_id, part, pos, role, text, learnt`` of formatted turns: role and text from what is written alone, and what is under the
    loss mask (null where nothing is)."""
    ship(pieces.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column("written").to_pylist()
            turns = [template.turns(t)[0] for t in text]
            learnt = [_learnt(t, m) for t, m in zip(text, b.column("mask").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("conv_id", "part", "pos")), pa.array([r for r, _ in turns], pa.string()), pa.array([t for _, t in turns], pa.string()), pa.array(learnt, pa.string())], names=["conv_id", "part", "pos", "role", "text", "learnt"])

    return pieces.select("conv_id", "part", "pos", written("segments").alias("written"), _mask("segments").alias("mask")).mapInArrow(read, "conv_id long, part int, pos long, role string, text string, learnt string")


def digests(pieces: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """``DIGESTS``: a row for each conversation of formatted turns, which stream in order and are read back one by one when this is called."""
    names = [x.split()[0] for x in DIGESTS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.int64()]

    @dataclass
    class Held:
        conv: int | None
        n: int = 0
        chars: int = 0
        learnt_chars: int = 0
        first_error: int | None = None
        state: str = ""

        def __post_init__(self) -> None:
            self.all, self.learnt = hashlib.sha256(), hashlib.sha256()

        def row(self) -> tuple:
            error = self.first_error if self.first_error is not None or self.state in template.ends else self.n
            return self.conv, self.n, self.all.hexdigest(), self.learnt_chars, self.learnt.hexdigest(), self.chars, error is None, error

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Held | None = None
        for b in batches:
            done = []
            for conv, text, mask, state in zip(*(b.column(c).to_pylist() for c in ("conv_id", "written", "mask", "state")), strict=True):
                if held is None or conv != held.conv:
                    done += [held.row()] if held else []
                    held = Held(conv)
                (role, said), learnt = template.turns(text)[0], _learnt(text, mask)
                held.all.update(f"{role}\n{said}\n".encode())
                if learnt is not None:
                    held.learnt.update(learnt.encode())
                    held.learnt_chars += len(learnt)
                if state == "error" and held.first_error is None:
                    held.first_error = held.n
                held.state = state
                held.n += 1
                held.chars += len(text)
            yield batch(done)
        if held:
            yield batch([held.row()])

    spark = pieces.sparkSession
    ship(spark)
    flat = pieces.select("conv_id", "part", "pos", written("segments").alias("written"), _mask("segments").alias("mask"), "state")
    with batches_of(spark, BATCH):  # written at once, a row for each conversation: the bound holds for jobs that run in here
        return cut(flat.repartition("conv_id").sortWithinPartitions("conv_id", "part", "pos").mapInArrow(run, DIGESTS), "digests")


def op12(rows: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """The contract of ``op12_chat_format``: all conversations and conversation -1, written as Parquet and read back."""
    said = "</s>[INST] ok [/INST]"
    more = rows.sparkSession.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    mine = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return digests(formatted(mine.unionByName(more), template), template)
