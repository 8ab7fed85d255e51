"""Chat formatting from a declarative template, with a finite-state machine over roles.

A template says for each role what surrounds a turn's text, which of these pieces carry
loss, and which role may follow in which state. Each turn becomes a row of segments
(text, loss); the machine says whether the turn may stand where it stands. Turns that
may not are formatted all the same, and marked.

Control strings inside texts, and the escape character itself, are written as the escape
character and a letter, so that no control string remains and reading back restores the text.

Conversations are not dealt by their id: rows are sorted over the whole table by
conversation and turn, so that one conversation may lie in many tasks. A task that begins
inside a conversation doesn't know the machine's state, and so follows all of them at once: its rows
have a small table from the state on entry to the state after the row. These tables are composed over the
tasks' borders, one row a border, which gives each task's true entry state.

Reading back digests one conversation after the other as a stream of its turns; as a digest
of a whole conversation is sequential by nature, a task holds one digest, never a conversation.

Rows of a conversation stand by turn (null first), then role, then text. Null texts are
empty, null roles are empty roles; a role that the template doesn't know is written out by name, and is never in
order. Rows with a null conv_id are one conversation. Repeated rows are turns of their own. An empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field
from enum import Enum

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops
from .common import plain, written



class Slot(Enum):
    TEXT = "t"
    ROLE = "r"


#: The slots of a template's pieces.
TEXT, ROLE = Slot.TEXT, Slot.ROLE
ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """turns: role -> pieces (literal or slot, loss); other: the pieces of roles that turns doesn't name; steps: (state, role) -> state.

    Where no step is given the turn is out of order, and the machine goes on from resume[role], or stays where there is none.
    """

    turns: dict[str, list]
    other: list
    controls: tuple[str, ...]
    steps: dict[tuple[str, str], str]
    resume: dict[str, str]
    start: str
    accept: frozenset[str]
    _find: re.Pattern = field(init=False, repr=False)
    _turn: re.Pattern = field(init=False, repr=False)

    def __post_init__(self):
        odd = [c for c in self.controls if not c or ESCAPE in c or re.search(r"\s", c) or any(c[:i] == c[-i:] for i in range(1, len(c)))]
        if odd or len(self.controls) > 26:
            raise ValueError(f"control strings must be free of the escape, of blanks and of borders: {odd}")
        object.__setattr__(self, "_find", re.compile("|".join(map(re.escape, (ESCAPE, *sorted(self.controls, key=len, reverse=True))))))
        forms = []
        for k, pieces in enumerate([*self.turns.values(), self.other]):
            slots = [p for p, _ in pieces if not isinstance(p, str)]
            ends = [q for (p, _), (q, _) in zip(pieces, [*pieces[1:], ("", False)]) if not isinstance(p, str)]
            if slots.count(TEXT) != 1 or not isinstance(pieces[0][0], str) or any(not isinstance(q, str) or not q.lstrip().startswith(self.controls) for q in ends):
                raise ValueError("a turn begins with a literal, has one text, and a control string after each slot")
            forms.append("".join(re.escape(p) if isinstance(p, str) else f"(?P<{p.value}{k}>.*?)" for p, _ in pieces))
        object.__setattr__(self, "_turn", re.compile("|".join(forms), re.S))

    @property
    def states(self) -> list[str]:
        return list(dict.fromkeys([self.start, *(s for s, _ in self.steps), *self.steps.values(), *self.resume.values(), *sorted(self.accept)]))

    def escape(self, text: str) -> str:
        letter = lambda m: ESCAPE + (ESCAPE if m[0] == ESCAPE else chr(97 + self.controls.index(m[0])))
        return self._find.sub(letter, text)

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(.)", lambda m: m[1] if m[1] == ESCAPE else self.controls[ord(m[1]) - 97], text, flags=re.S)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        fill = {TEXT: text, ROLE: role}
        return [(p if isinstance(p, str) else self.escape(fill[p]), loss) for p, loss in self.turns.get(role, self.other)]

    def read(self, formatted: str) -> list[tuple[str, str]]:
        """(role, text) of the turns of a formatted text."""
        roles, out, at = list(self.turns), [], 0
        while at < len(formatted):
            m = self._turn.match(formatted, at)
            if not m:
                raise ValueError(f"no turn at {at}")
            k = next(int(n[1:]) for n, v in m.groupdict().items() if n[0] == "t" and v is not None)
            role = roles[k] if k < len(roles) else self.unescape(m[f"r{k}"])
            out.append((role, self.unescape(m[f"t{k}"])))
            at = m.end()
        return out


#: Only what an assistant says carries loss; a conversation may begin with a system's turn and ends with an assistant's.
CHAT = Template(
    turns={
        "system": [("<<SYS>>\n", False), (TEXT, False), ("\n<</SYS>>\n\n", False)],
        "user": [("[INST] ", False), (TEXT, False), (" [/INST]", False)],
        "assistant": [("<s> ", False), (TEXT, True), (" </s>", False)],
    },
    other=[("[ROLE] ", False), (ROLE, False), (" [SAYS] ", False), (TEXT, False), (" [/ROLE]", False)],
    controls=("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[SAYS]", "[/ROLE]"),
    steps={("start", "system"): "told", ("start", "user"): "asked", ("told", "user"): "asked", ("asked", "assistant"): "answered", ("answered", "user"): "asked"},
    resume={"system": "told", "user": "asked", "assistant": "answered"},
    start="start",
    accept=frozenset({"answered"}),
)

_SEGMENTS = "array<struct<text:string,loss:boolean>>"


def _formatted(template: Template):
    """mapInArrow over sorted rows: segments of each turn, and the machine from every state that the task may begin in."""
    states = template.states
    after = {(k, r): states.index(template.steps.get((s, r), template.resume.get(r, s))) for k, s in enumerate(states) for r in template.turns}
    fine = {(states.index(s), r) for s, r in template.steps}

    def run(batches):
        task, n, conv, now = TaskContext.get().partitionId(), 0, None, list(range(len(states)))
        for b in textops.slices(batches):
            out = []
            for c, role, text in zip(b.column("conv_id").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist()):
                if n and c != conv:
                    now = [0]  # a conversation that begins here; states has the start first
                conv, role = c, role or ""
                ok = [(s, role) in fine for s in now]
                now = [after.get((s, role), s) for s in now]
                out.append(([{"text": t, "loss": x} for t, x in template.segments(role, text or "")], now, ok, n))
                n += 1
            cols = [pa.array([task] * len(out), pa.int32()), pa.array([x[3] for x in out], pa.int64()), b.column("conv_id"), b.column("turn"), b.column("role"), pa.array([x[0] for x in out], pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))), pa.array([x[1] for x in out], pa.list_(pa.int32())), pa.array([x[2] for x in out], pa.list_(pa.bool_()))]
            yield pa.RecordBatch.from_arrays(cols, ["task", "n", "conv_id", "turn", "role", "segments", "after", "ok"])

    return run


def _step(entry, table):
    """What a row's table says for the state on entry; a table of one holds for all."""
    return F.get(table, F.when(F.size(table) == 1, 0).otherwise(entry))


def format_turns(conversations: DataFrame, template: Template = CHAT, partitions: int | None = None) -> DataFrame:
    """(conv_id, seq, turn, role, segments, in_order, state): one row a turn; seq gives the order of all turns."""
    rows = plain(conversations, "conv_id", "turn", "role", "text")
    kind = dict(rows.dtypes)
    # The range looks at the beginning of texts only: its sample reaches the driver.
    by = ["conv_id", "turn", "role", F.substring("text", 1, 64)]
    dealt = rows.repartitionByRange(*([partitions] if partitions else []), *by).sortWithinPartitions("conv_id", "turn", "role", "text")
    turns = written(dealt.mapInArrow(_formatted(template), f"task int, n long, conv_id {kind['conv_id']}, turn {kind['turn']}, role string, segments {_SEGMENTS}, after array<int>, ok array<boolean>"))
    # Conversations that a task begins with may have begun in another: at most one a task.
    first = F.broadcast(turns.filter("n = 0").select(F.col("conv_id").alias("_c")).distinct())
    parts = turns.join(first, F.col("conv_id").eqNullSafe(F.col("_c")), "left_semi").groupBy("conv_id", "task").agg(F.max_by("after", "n").alias("f"))
    # A conversation's parts are at most as many as tasks.
    lists = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("task", "f"))).alias("p"))
    entry = lambda k: F.aggregate(F.slice("p", 1, k), F.lit(0), lambda s, x: _step(s, x["f"]))
    entries = lists.select(F.col("conv_id").alias("_c"), F.explode(F.transform("p", lambda x, k: F.struct(x["task"].alias("_t"), entry(k).alias("_e")))).alias("_x")).select("_c", "_x.*")
    at = (F.col("task") == F.col("_t")) & F.col("conv_id").eqNullSafe(F.col("_c"))
    known = turns.join(F.broadcast(entries), at, "left").withColumn("_e", F.coalesce("_e", F.lit(0)))
    names = F.array(*map(F.lit, template.states))
    seq = (F.shiftleft(F.col("task").cast("long"), 40) + F.col("n")).alias("seq")
    return known.select("conv_id", seq, "turn", "role", "segments", _step(F.col("_e"), F.col("ok")).alias("in_order"), F.get(names, _step(F.col("_e"), F.col("after"))).alias("state"))


READ = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, out_of_order long, complete boolean"


def _read(template: Template):
    """mapInArrow over turns in order: a row a conversation, digested turn by turn."""
    names = ["conv_id", *[c.split()[0] for c in READ.split(", ")]]

    def run(batches):
        conv, held = None, None

        def row():
            n, turns, chars, loss, size, odd, state = held
            return conv, n, turns.hexdigest(), chars, loss.hexdigest(), size, odd, odd == 0 and state in template.accept

        for b in batches:
            out = []
            for c, segments, ok, state in zip(*[b.column(k).to_pylist() for k in ("conv_id", "segments", "in_order", "state")]):
                if held is None or c != conv:
                    if held:
                        out.append(row())
                    conv, held = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, ""]
                whole = "".join(s["text"] for s in segments)
                for role, text in template.read(whole):
                    held[0] += 1
                    held[1].update(f"{role}\n{text}\n".encode())
                lost = template.unescape("".join(s["text"] for s in segments if s["loss"]))
                held[2] += len(lost)
                held[3].update(lost.encode())
                held[4] += len(whole)
                held[5] += not ok
                held[6] = state
            yield batch(out, b)
        if held:
            yield batch([row()], b)

    def batch(out, like):
        kinds = [like.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names)

    return run


def read_back(formatted: DataFrame, template: Template = CHAT) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, out_of_order, complete) of the turns of format_turns, from their segments."""
    rows = formatted.select("conv_id", "seq", "segments", "in_order", "state").repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    return rows.mapInArrow(_read(template), f"conv_id {dict(rows.dtypes)['conv_id']}, {READ}")
