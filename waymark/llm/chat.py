"""Chat formatting: a hidden Markov model recovers roles from transcripts; turns are rendered anew.

A transcript is lines of text, some of which begin with a speaker's marker. States are roles, each
at the first line of a turn or inside one. What a line looks like (its marker, its length, how it
ends, how it begins) is emitted by the state; Viterbi finds the best sequence. Probabilities are
counted on a bounded sample of conversations whose roles are known, with a prior by rule.

Turns are read in the order of ``turn``, then of their texts. Exact repeats of a row are one turn.
Null texts are empty turns; null or unknown roles count as ``user`` where a model is fitted; rows
without ``conv_id`` make one conversation of their own; rows without ``turn`` come first. A conversation
is one row. One beyond ``LONG_TURNS`` or ``LONG_CHARS`` is shared by many tasks: each of its chunks becomes
the best score from any state before it to any state at its end, those are combined in order, and each
chunk is then decoded from what came before it and towards what comes after it. Scores are whole numbers,
so the roles are those that one pass over all lines would find, ties too. Such a conversation gives its
canonical text in several rows, ``part`` by ``part``, which joined are the whole. Empty tables give no
rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import partial

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import batches, dropped, small_batches, written

ROLES = ("system", "user", "assistant")
#: What speakers are called in transcripts.
MARKERS = {
    "system": ("system", "instructions", "context"),
    "user": ("user", "human", "customer", "question", "q", "you", "prompter", "instruction"),
    "assistant": ("assistant", "ai", "bot", "gpt", "agent", "answer", "a", "response", "model"),
}
MARKER = re.compile(r"^\s*(?:#{1,4}\s*|\*\*|\[|<\|?|>\s*)?(" + "|".join(sorted({m for v in MARKERS.values() for m in v}, key=len, reverse=True)) + r")\s*(?:\*\*)?\s*(?::\*\*|:|\]|\|?>|\s-\s)\s*(?:\*\*\s*)?", re.I)
OF_MARKER = {m: r for r, v in MARKERS.items() for m in v}
#: Conversations that are shared by many tasks, by turns or characters; turns and characters of a chunk of them.
LONG_TURNS, LONG_CHARS, CHUNK_TURNS, CHUNK_CHARS = 1 << 16, 32 << 20, 4096, 4 << 20
#: The sample that a model is fitted on: conversations, turns of each, and characters in all.
FIT, FIT_TURNS, FIT_CHARS = 2000, 64, 16 << 20
#: Log probabilities are whole numbers of that part of one.
FINE = 1 << 20
START, END = "<|{role}|>\n", "\n<|end|>\n"
#: Values of each feature of a line.
SIZES = (4, 7, 3, 3, 2)


def features(line: str, first: bool) -> tuple[int, ...]:
    """Marker, length, ending, beginning, and whether the transcript begins here."""
    m = MARKER.match(line)
    mark = 0 if not m else 1 + ROLES.index(OF_MARKER[m[1].lower()])
    bare = line[m.end() :] if m else line
    n = min(len(bare).bit_length() // 2, 6)
    last = bare.rstrip()[-1:]
    end = 0 if last == "?" else 1 if last in ".!:;" and last else 2
    begin = bare.lstrip()[:1]
    start = 0 if begin.isupper() else 1 if begin.isalpha() else 2
    return mark, n, end, start, int(first)


@dataclass
class Model:
    """Log probabilities in whole numbers: of the first state, of moves, and of each feature's value by state. States are roles' first lines, then their others."""

    first: np.ndarray
    moves: np.ndarray
    shows: list[np.ndarray]

    def emitted(self, lines: list[tuple[int, ...]]) -> np.ndarray:
        f = np.array(lines)
        return sum(s[:, f[:, i]].T for i, s in enumerate(self.shows))

    def forward(self, emit: np.ndarray, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Best scores at the last line, and each line's best state before it; ``before``: scores of the line before these."""
        best = self.first + emit[0] if before is None else None
        back = np.zeros((len(emit), len(self.first)), np.int8)
        for t in range(0 if best is None else 1, len(emit)):
            ways = (before if best is None else best)[:, None] + self.moves
            back[t] = ways.argmax(0)
            best = ways.max(0) + emit[t]
        return best, back

    def through(self, emit: np.ndarray) -> np.ndarray:
        """Best scores from each state before the lines (rows) to each state of the last one."""
        out = self.moves + emit[0]
        for e in emit[1:]:
            out = (out[:, :, None] + self.moves).max(1) + e
        return out

    @staticmethod
    def trace(back: np.ndarray, last: int) -> list[int]:
        """States of the lines, that of the line before them first (of no meaning for a first line)."""
        path = [last]
        for b in back[::-1]:
            path.append(int(b[path[-1]]))
        return path[::-1]

    def viterbi(self, lines: list[tuple[int, ...]]) -> list[int]:
        """The best states of the lines. Ties go to the lower state."""
        best, back = self.forward(self.emitted(lines))
        return self.trace(back, int(best.argmax()))[1:]


def prior_counts() -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """What is thought without data: conversations open with system or user and alternate; markers name roles; only first lines have them."""
    n = len(ROLES)
    first = np.array([2.0, 6, 0.5] + [0.01] * n)
    moves = np.full((2 * n, 2 * n), 0.02)
    for r in range(n):
        for s in (r, n + r):
            moves[s, n + r] += 4  # the turn goes on
            for to, w in zip(range(n), ((0.05, 2, 0.5), (0.05, 0.3, 3), (0.05, 3, 0.3))[r], strict=True):
                moves[s, to] += w
    shows = [np.full((2 * n, k), 0.5) for k in SIZES]
    shows[0] = np.full((2 * n, 4), 0.05)
    for r in range(n):
        shows[0][r, 0] += 1
        shows[0][r, 1 + r] += 4
        shows[0][n + r, 0] += 20
    return first, moves, shows


def fit(transcripts: list[list[tuple[str, int]]]) -> Model:
    """From transcripts of ``(line, state)``: counts on top of the prior ones."""
    first, moves, shows = prior_counts()
    for lines in transcripts:
        before = None
        for i, (line, state) in enumerate(lines):
            for s, v in zip(shows, features(line, i == 0), strict=True):
                s[state, v] += 1
            if before is None:
                first[state] += 1
            else:
                moves[before, state] += 1
            before = state
    log = lambda x: np.rint(np.log(x / x.sum(-1, keepdims=True)) * FINE).astype(np.int64)
    return Model(log(first), log(moves), [log(s) for s in shows])


def turns_of(lines: list[str], states: list[int]) -> list[tuple[str | None, str]]:
    """``role, text`` of each turn: markers are taken off, lines of a turn joined again. Lines before a first turn have no role."""
    n, turns = len(ROLES), []
    for line, s in zip(lines, states, strict=True):
        if s < n:
            m = MARKER.match(line)
            turns.append((ROLES[s], [line[m.end() :] if m else line]))
        else:
            if not turns:
                turns.append((None, []))
            turns[-1][1].append(line)
    return [(r, "\n".join(t)) for r, t in turns]


def parse(lines: list[str], model: Model) -> list[tuple[str, str]]:
    """Turns of a transcript. Its first line begins a turn, of the role that its state has, whatever that is."""
    if not lines:
        return []
    states = model.viterbi([features(x, i == 0) for i, x in enumerate(lines)])
    return turns_of(lines, [states[0] % len(ROLES), *states[1:]])


def _safe(text: str) -> str:
    return text.replace("<|", "< |")


def render(turns: list[tuple[str | None, str]], goes_on: bool = False) -> str:
    """Turns in the canonical form; what would read as its marks is broken up. A turn without a role goes on from a part before; ``goes_on``: the last one does after."""
    out = []
    for i, (role, t) in enumerate(turns):
        t = _safe(t)
        ends = i < len(turns) - 1 or not goes_on
        t = t.rstrip() if ends else t
        out.append(("\n" + t if role is None else START.format(role=role) + t.lstrip()) + END * ends)
    return "".join(out)


# -- conversations as transcripts -----------------------------------------------------------------


def spoken(conv, turn, role: str | None, text: str | None) -> list[str]:
    """A turn as a transcript has it: its marker's name and form by a hash, at times with none."""
    import zlib

    h = zlib.crc32(f"{conv}:{turn}:{role}".encode())
    role = role if role in ROLES else "user"
    name = MARKERS[role][h % len(MARKERS[role])]
    form = ("{0}: ", "### {0}:\n", "**{0}:** ", "[{0}] ", "<|{0}|>", "")[(h >> 8) % 6].format(name.capitalize() if h >> 16 & 1 else name)
    return (form + (text or "")).split("\n")


def _conversations(rows):
    """``conv, turns`` of sorted rows, repeats once; a conversation may cross batches."""
    now, turns, any_ = None, [], False
    for b in batches(rows):
        for c, t, r, x in zip(*(col.to_pylist() for col in b.columns), strict=True):
            if not any_ or c != now:
                if turns:
                    yield now, turns
                now, turns, any_ = c, [], True
            if not turns or turns[-1] != (t, r, x):
                turns.append((t, r, x))
    if turns:
        yield now, turns


def _transcript(conv, turns) -> tuple[list[str], list[int]]:
    lines, truth = [], []
    for t, r, x in turns:
        one = spoken(conv, t, r, x)
        lines += one
        truth += [ROLES.index(r) if r in ROLES else 1] * len(one)
    return lines, truth


_KINDS = "conv_id bigint, part bigint, n_turns bigint, n_found bigint, roles array<string>, rendered string, n_right bigint"


def _told(made):
    """Rows of the result, in batches of bounded text."""
    import pyarrow as pa

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.int64()]
    held, size = [], 0

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=[k.split()[0] for k in _KINDS.split(", ")])

    for row in made:
        held.append(row)
        size += len(row[5])
        if len(held) >= 500 or size > 8 << 20:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def _row(conv, part, n_turns, lines, truth, states, goes_on=False):
    right = sum(s % len(ROLES) == t for s, t in zip(states, truth, strict=True))
    if part == 0:
        states = [states[0] % len(ROLES), *states[1:]]
    found = turns_of(lines, states)
    roles = [r for r, _ in found if r]
    return conv, part, n_turns, len(roles), roles, render(found, goes_on), (1000 * right) // len(lines)


def _parse_batches(rows, shared):
    model = shared.value

    def made():
        for conv, turns in _conversations(rows):
            lines, truth = _transcript(conv, turns)
            yield _row(conv, 0, len(turns), lines, truth, model.viterbi([features(x, i == 0) for i, x in enumerate(lines)]))

    yield from _told(made())


# -- long conversations, chunk by chunk -----------------------------------------------------------

_CHUNK = "conv_id bigint, at bigint, n_turns bigint, lines array<string>, truth array<tinyint>"


def _chunk_batches(rows, turns_most: int, chars_most: int):
    """Chunks of range-sorted turns; ``at`` puts a conversation's chunks in order over all tasks."""
    import pyarrow as pa
    from pyspark import TaskContext

    base, n = TaskContext.get().partitionId() << 32, 0

    def out(conv, turns):
        nonlocal n
        n += 1
        lines, truth = _transcript(conv, turns)
        return pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([base + n], pa.int64()), pa.array([len(turns)], pa.int64()), pa.array([lines], pa.list_(pa.string())), pa.array([truth], pa.list_(pa.int8()))], names=["conv_id", "at", "n_turns", "lines", "truth"])

    now, turns, size = None, [], 0
    for b in batches(rows):
        for c, t, r, x in zip(*(col.to_pylist() for col in b.columns), strict=True):
            if turns and (c != now or len(turns) >= turns_most or size >= chars_most):
                yield out(now, turns)
                turns, size = [], 0
            now = c
            turns.append((t, r, x))
            size += len(x or "")
    if turns:
        yield out(now, turns)


def _bytes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x, np.int64).tobytes()


def _from(x) -> np.ndarray | None:
    return None if x is None else np.frombuffer(x, np.int64)


def _emitted(model: Model, lines: list[str], first: bool) -> np.ndarray:
    return model.emitted([features(x, first and i == 0) for i, x in enumerate(lines)])


def _through_batches(rows, shared):
    """``conv_id, at, opens, through``: a chunk's scores if it opens the conversation, and from any state before it."""
    import pyarrow as pa

    for b in batches(rows):
        for i in range(b.num_rows):
            lines = b.column(3)[i].as_py()
            opens = shared.value.forward(_emitted(shared.value, lines, True))[0]
            through = shared.value.through(_emitted(shared.value, lines, False))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(1).slice(i, 1), pa.array([_bytes(opens)], pa.binary()), pa.array([_bytes(through)], pa.binary())], names=["conv_id", "at", "opens", "through"])


def _forward_batches(rows):
    """``conv_id, at, part, before`` of chunks in order: scores of the line before each, null before the first."""
    import pyarrow as pa

    now, best, part, any_ = None, None, 0, False
    for b in batches(rows):
        before, parts = [], []
        for conv, opens, through in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            if not any_ or conv != now:
                now, part, any_ = conv, 0, True
                before.append(None)
                best = _from(opens)
            else:
                part += 1
                before.append(_bytes(best))
                best = (best[:, None] + _from(through).reshape(len(best), -1)).max(0)
            parts.append(part)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(parts, pa.int64()), pa.array(before, pa.binary())], names=["conv_id", "at", "part", "before"])


def _ways_batches(rows, shared):
    """``conv_id, at, part, best, ways``: scores at a chunk's end, and by its last state the state before it and that of its first line."""
    import pyarrow as pa

    for b in batches(rows):
        for i in range(b.num_rows):
            before = _from(b.column(6)[i].as_py())
            best, back = shared.value.forward(_emitted(shared.value, b.column(3)[i].as_py(), before is None), before)
            paths = [shared.value.trace(back, s) for s in range(len(best))]
            ways = np.array([[p[0], p[1]] for p in paths])
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(1).slice(i, 1), b.column(5).slice(i, 1), pa.array([_bytes(best)], pa.binary()), pa.array([_bytes(ways)], pa.binary())], names=["conv_id", "at", "part", "best", "ways"])


def _backward_batches(rows):
    """``conv_id, at, last, goes_on`` of chunks from the last to the first: a chunk's last state, and whether the next one goes on with its turn."""
    import pyarrow as pa

    now, state, inside, any_ = None, 0, False, False
    for b in batches(rows):
        last, goes_on = [], []
        for conv, best, ways in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
            if not any_ or conv != now:
                now, any_, state, inside = conv, True, int(_from(best).argmax()), False
            last.append(state), goes_on.append(inside)
            before, first = _from(ways).reshape(-1, 2)[state]
            state, inside = int(before), int(first) >= len(ROLES)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(last, pa.int64()), pa.array(goes_on, pa.bool_())], names=["conv_id", "at", "last", "goes_on"])


def _decode_batches(rows, shared):
    model = shared.value

    def made():
        for b in batches(rows):
            for conv, _, n_turns, lines, truth, part, before, last, goes_on in zip(*(c.to_pylist() for c in b.columns), strict=True):
                before = _from(before)
                states = model.trace(model.forward(_emitted(model, lines, before is None), before)[1], last)[1:]
                yield _row(conv, part, n_turns, lines, truth, states, goes_on)

    yield from _told(made())


def _long(turns: DataFrame, shared, chunk_turns: int, chunk_chars: int) -> DataFrame:
    """Rows of long conversations, part by part."""
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "turn", "text", "role"]
    dealt = turns.distinct().repartitionByRange(n, *order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text")
    chunks = written(dealt.mapInArrow(partial(_chunk_batches, turns_most=chunk_turns, chars_most=chunk_chars), _CHUNK), "chunks")
    through = chunks.mapInArrow(partial(_through_batches, shared=shared), "conv_id bigint, at bigint, opens binary, through binary")
    # a few hundred bytes for each chunk from here on, so a conversation's chunks may meet in one task
    before = through.repartition(n, "conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(_forward_batches, "conv_id bigint, at bigint, part bigint, before binary")
    before = written(before, "chunks-before")
    own = written(chunks.join(before.drop("conv_id"), "at").select("conv_id", "at", "n_turns", "lines", "truth", "part", "before"), "chunks-own")
    ways = own.mapInArrow(partial(_ways_batches, shared=shared), "conv_id bigint, at bigint, part bigint, best binary, ways binary")
    after = ways.repartition(n, "conv_id").sortWithinPartitions("conv_id", F.desc("part")).mapInArrow(_backward_batches, "conv_id bigint, at bigint, last bigint, goes_on boolean")
    after = written(after, "chunks-after")
    dropped(chunks, before)
    every = own.join(after.drop("conv_id"), "at").select("conv_id", "at", "n_turns", "lines", "truth", "part", "before", "last", "goes_on")
    return every.mapInArrow(partial(_decode_batches, shared=shared), _KINDS)


def train(turns: DataFrame, conversations: int = FIT) -> Model:
    """Fit on at most ``conversations``, picked by a hash of their identifiers; the first ``FIT_TURNS`` turns of each, ``FIT_CHARS`` in all."""
    by = [F.xxhash64("conv_id", F.lit("fit")), F.col("conv_id")]
    ids = turns.select("conv_id").where("conv_id is not null").distinct().orderBy(*by).limit(conversations)
    w = Window.partitionBy("conv_id").orderBy("turn", "text", "role")
    some = turns.join(F.broadcast(ids), "conv_id").select("conv_id", "turn", "role", "text").where(F.coalesce(F.length("text"), F.lit(0)) <= FIT_CHARS // 16)
    some = some.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= FIT_TURNS).orderBy(*by, "__n")
    got: dict = {}
    size = 0
    for r in some.toLocalIterator():
        size += len(r["text"] or "")
        if size > FIT_CHARS:
            break
        state = ROLES.index(r["role"]) if r["role"] in ROLES else 1
        for i, line in enumerate(spoken(r["conv_id"], r["turn"], r["role"], r["text"])):
            got.setdefault(r["conv_id"], []).append((line, state if i == 0 else len(ROLES) + state))
    return fit(list(got.values()))


def formatted(turns: DataFrame, model: Model | None = None, long_turns: int = LONG_TURNS, long_chars: int = LONG_CHARS, chunk_turns: int = CHUNK_TURNS, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """``conv_id, part, n_turns, n_found, roles, rendered, n_right`` (of 1000 lines, those whose role was recovered); ``part`` is 0 but for long conversations."""
    spark = turns.sparkSession
    t = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model or train(t))
    sizes = t.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    long = written(sizes.where((F.col("n") > long_turns) | (F.col("chars") > long_chars)).select(F.col("conv_id").alias("__id")), "long")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    some = not long.isEmpty()
    cold = t.join(long, t["conv_id"].eqNullSafe(long["__id"]), "left_anti") if some else t
    dealt = cold.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "text", "role").select("conv_id", "turn", "role", "text")
    out = dealt.mapInArrow(partial(_parse_batches, shared=shared), _KINDS)
    if not some:
        dropped(long)
        return out
    return out.union(_long(t.join(long, t["conv_id"].eqNullSafe(long["__id"]), "left_semi"), shared, chunk_turns, chunk_chars))
