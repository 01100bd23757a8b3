"""Chat formatting at token level.

Every turn is encoded by itself, with the control strings in its text escaped; reserved ids are spliced in front of and
behind it, and the loss mask is the prefix sum of +1 where a learnt segment begins and -1 where it ends. The formatted text
says the same with the marks written out, and either form reads back to the turns.

The template: `begin` opens a conversation; a turn is its role's opening mark, the text and the closing mark. A role without
marks of its own (null counts as '') is written between `named` marks in front of its text, which then closes like a learnt
turn. Reserved ids follow the tokenizer's vocabulary in the order of `Template.marks`.

Escaping: an occurrence of a control string gets one more escape character behind its first character, one that already has
some there too; unescaping takes one away. No control string is then left in a text, and since none of them overlaps another or
itself (checked), neither does one arise where texts and marks meet.

Turns are encoded where they are read and then dealt by conversation and sorted by turn; a task streams through its
conversations and gives out parts of at most `PART` ids, so a conversation of any length takes bounded memory. Its turns
stay in one task because a digest of all of them is a running one; encoding, the heavy work, comes before the shuffle.

Defined cases: a null text is empty and a turn all the same; equal rows are turns of their own; turns of the same number are
ordered by role and escaped text, a null number comes first; rows with a null conversation id make one conversation; other columns
are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.arrays import pieces
from barloom.llm.packing import Encoder, encoder

#: ids of a part of a conversation
PART = 1 << 20


@dataclass(frozen=True)
class Template:
    """Marks of a chat format. `turns`: (role, opening mark, closing mark); an empty opening mark is allowed for one role, whose
    turns begin where no mark stands. `learnt`: roles under the loss mask. `more`: further strings to escape."""

    begin: str = "<s>"
    turns: tuple[tuple[str, str, str], ...] = (("system", "<<SYS>>", "<</SYS>>"), ("user", "[INST]", "[/INST]"), ("assistant", "", "</s>"))
    named: tuple[str, str, str] = ("[ROLE]", "[/ROLE]", "[/TURN]")
    learnt: tuple[str, ...] = ("assistant",)
    more: tuple[str, ...] = ("<|endoftext|>",)
    escape: str = "\\"
    marks: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        marks = tuple(m for m in (self.begin, *(m for t in self.turns for m in t[1:]), *self.named) if m)
        object.__setattr__(self, "marks", marks)
        control = self.control
        if len(set(marks)) < len(marks) or len(self.escape) != 1 or any(len(c) < 2 or self.escape in c for c in control):
            raise ValueError("marks must differ, have two characters or more, and not hold the escape character")
        if sum(not t[1] for t in self.turns) > 1 or not all(t[2] for t in self.turns):
            raise ValueError("every role needs a closing mark, and all but one an opening mark")
        for x, y in itertools.product(control, control):
            if x != y and x in y or any(y.startswith(x[k:]) for k in range(1, len(x))):
                raise ValueError(f"{x} and {y} overlap")

    @property
    def control(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys((*self.marks, *self.more)))

    def _pattern(self, least: str) -> re.Pattern:
        """Runs of the escape character (`least`: * or +) behind the first character of a control string."""
        e = re.escape(self.escape)
        return re.compile("|".join(f"(?<={re.escape(c[0])}){e}{least}(?={re.escape(c[1:])})" for c in sorted(self.control, key=len, reverse=True)))

    def hide(self, text: str) -> str:
        """The text with its control strings escaped."""
        if self.escape not in text and not any(c in text for c in self.control):
            return text
        return self._pattern("*").sub(lambda m: m[0] + self.escape, text)

    def show(self, text: str) -> str:
        return self._pattern("+").sub(lambda m: m[0][:-1], text) if self.escape in text else text


class Formatter:
    """A template with a tokenizer of byte-level ids: the form of single turns, and how they are put together and read back."""

    def __init__(self, template: Template, tokenizer: str):
        self.template, self.encode = template, encoder(tokenizer)
        self.size = max(self.encode.tokenizer.get_vocab().values()) + 1
        self.id = {m: self.size + k for k, m in enumerate(template.marks)}
        self.mark = {i: m for m, i in self.id.items()}
        self.open = {t[0]: t[1] for t in template.turns}
        self.close = {t[0]: t[2] for t in template.turns}
        self.closes = {t[2]: t[0] for t in template.turns}
        self.opens = {t[1]: t[0] for t in template.turns if t[1]}

    def bodies(self, texts: list[str]) -> tuple[list[str], list[np.ndarray]]:
        hidden = [self.template.hide(t) for t in texts]
        return hidden, self.encode(pa.array(hidden, pa.large_string()))

    def decode(self, ids: np.ndarray) -> str:
        return self.encode.tokenizer.decode(ids.tolist(), skip_special_tokens=False) if len(ids) else ""

    def segments(self, role: str, body: tuple[str, np.ndarray], name: tuple[str, np.ndarray] | None) -> Iterator[tuple[str, np.ndarray, bool]]:
        """(text, ids, learnt) of a turn: marks and content in order."""
        def spliced(mark: str):
            return mark, np.array([self.id[mark]], dtype="<u4"), False

        learnt = role in self.template.learnt
        if name is None:
            if self.open[role]:
                yield spliced(self.open[role])
            yield *body, learnt
            yield spliced(self.close[role])
        else:
            yield spliced(self.template.named[0])
            yield *name, False
            yield spliced(self.template.named[1])
            yield *body, learnt
            yield spliced(self.template.named[2])


def mask_of(lengths: np.ndarray, learnt: np.ndarray) -> np.ndarray:
    """One byte an id: the running sum of +1 at the begin and -1 behind the end of every learnt segment."""
    ends = np.cumsum(lengths)
    step = np.zeros((ends[-1] if len(ends) else 0) + 1, dtype=np.int8)
    np.add.at(step, (ends - lengths)[learnt], 1)
    np.add.at(step, ends[learnt], -1)
    return np.cumsum(step[:-1], dtype=np.int8).astype(np.uint8)


_formatters: dict[tuple[Template, str], Formatter] = {}


def formatter(template: Template, tokenizer: str) -> Formatter:
    if (template, tokenizer) not in _formatters:
        _formatters[template, tokenizer] = Formatter(template, tokenizer)
    return _formatters[template, tokenizer]


def _encoded(turns: DataFrame, template: Template, tokenizer: str) -> DataFrame:
    """conv_id, turn, role, hidden (the escaped text) and ids of every turn."""
    names = ["conv_id", "turn", "role", "hidden", "ids"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = formatter(template, tokenizer)
        for batch in pieces(batches, "text"):
            hidden, ids = form.bodies(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names[:3]), pa.array(hidden, pa.string()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())], names=names)

    kind, order = (turns.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    return turns.mapInArrow(rows, f"conv_id {kind}, turn {order}, role string, hidden string, ids binary")


def formatted(turns: DataFrame, tokenizer: str, template: Template = Template(), conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
              part: int = PART) -> DataFrame:
    """conv_id, part (from 0), last (whether it is the conversation's last), ids (binary, little-endian unsigned 32-bit), mask (binary, a
    byte an id, 1 where the loss counts) and text. Parts of a conversation follow each other in order; one is the rule."""
    read = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = read.schema["conv_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = formatter(template, tokenizer)
        known: dict[str, tuple[str, np.ndarray]] = {}
        out: list[tuple] = []
        held: list[tuple[str, np.ndarray, bool]] = []
        now, number, size, ready, kind_ = None, 0, 0, 0, None

        def cut(last: bool) -> None:
            nonlocal number, size, ready
            mask = mask_of(np.array([len(x[1]) for x in held], dtype=np.int64), np.array([x[2] for x in held], dtype=bool))
            out.append((now[0], number, last, b"".join([x[1].tobytes() for x in held]), mask.tobytes(), "".join([x[0] for x in held])))
            held.clear()
            number, ready, size = number + 1, ready + size, 0

        def batch_of() -> pa.RecordBatch:
            nonlocal ready
            made = pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*out), (kind_, pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.string()))],
                names=["conv_id", "part", "last", "ids", "mask", "text"])
            out.clear()
            ready = 0
            return made

        for batch in pieces(batches, "hidden"):
            kind_ = batch.schema.field("conv_id").type
            columns = [batch.column(n).to_pylist() for n in ("conv_id", "role", "hidden", "ids")]
            for conv, who, hidden, ids in zip(*columns):
                if now is None or now[0] != conv:
                    if now is not None:
                        cut(True)
                    now, number = (conv,), 0
                    held.append((template.begin, np.array([form.id[template.begin]], dtype="<u4"), False))
                    size = 1
                elif size >= part:
                    cut(False)
                name = None
                if who not in form.open:
                    if len(known) > 10_000:
                        known.clear()
                    if who not in known:
                        hidden_name, ids_name = form.bodies([who])
                        known[who] = hidden_name[0], ids_name[0]
                    name = known[who]
                for segment in form.segments(who, (hidden, np.frombuffer(ids, dtype="<u4")), name):
                    held.append(segment)
                    size += len(segment[1])
                if ready > PART:
                    yield batch_of()
        if now is not None:
            cut(True)
            yield batch_of()

    dealt = _encoded(read, template, tokenizer).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "hidden")
    return dealt.select("conv_id", "role", "hidden", "ids").mapInArrow(rows, f"conv_id {kind}, part int, last boolean, ids binary, mask binary, text string")


def turns_of_ids(form: Formatter, ids: np.ndarray) -> Iterator[tuple[str, str]]:
    """(role, text) of every turn, from the ids alone."""
    at = np.flatnonzero(ids >= form.size)
    name, begin = None, 0
    for k in at.tolist():
        mark = form.mark[int(ids[k])]
        if mark == form.template.named[1]:
            name = form.template.show(form.decode(ids[begin:k]))
        elif mark == form.template.named[2] or mark in form.closes:
            yield form.closes.get(mark, name), form.template.show(form.decode(ids[begin:k]))
        begin = k + 1


def turns_of_text(form: Formatter, text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of every turn, from the formatted text alone."""
    name, begin = None, 0
    for m in re.finditer("|".join(map(re.escape, form.template.marks)), text):
        if m[0] == form.template.named[1]:
            name = form.template.show(text[begin : m.start()])
        elif m[0] == form.template.named[2] or m[0] in form.closes:
            yield form.closes.get(m[0], name), form.template.show(text[begin : m.start()])
        begin = m.end()


def learnt_texts(form: Formatter, ids: np.ndarray, mask: np.ndarray) -> Iterator[str]:
    """The text of every run under the mask."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask, [0]])))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        yield form.template.show(form.decode(ids[a:b]))


def digests(made: DataFrame, tokenizer: str, template: Template = Template()) -> DataFrame:
    """What formatted() gave, read back from ids and mask, a row a conversation: conv_id, n_turns, turns_sha256 (of role, line feed, text,
    line feed for every turn), loss_chars and loss_sha256 (of all text under the mask), formatted_chars, and consistent: the
    formatted text reads back to the same turns. The parts of a conversation must still be in order in one partition."""
    kind = made.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "consistent"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = formatter(template, tokenizer)
        turns, loss, n, chars, width, same = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, True
        for batch in batches:
            out = []
            for conv, last, ids, mask, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "last", "ids", "mask", "text"))):
                ids = np.frombuffer(ids, dtype="<u4")
                found = list(turns_of_ids(form, ids))
                for who, said in found:
                    turns.update(f"{who}\n{said}\n".encode())
                n, width, same = n + len(found), width + len(text), same and found == list(turns_of_text(form, text))
                for said in learnt_texts(form, ids, np.frombuffer(mask, dtype=np.uint8)):
                    loss.update(said.encode())
                    chars += len(said)
                if last:
                    out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), width, same))
                    turns, loss, n, chars, width, same = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, True
            types = [batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=names)

    return made.mapInArrow(rows, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, consistent boolean")
