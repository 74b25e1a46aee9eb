"""Chat formatting: a finite-state machine over roles and a declarative template.

``format_turns`` turns rows ``(conv_id, turn, role, text)`` into formatted turns
with segments and loss flags; ``read_back`` recovers the turns from that output.

Order: turns of a conversation go by turn, then role, then text, NULL first, so
rows that share a turn have a defined order. A NULL text is empty, a NULL role
is the empty role, rows without conversation id form one conversation. Any role
is formatted; ``valid`` says whether the turn order was allowed so far. Extra
columns are ignored. An empty table gives an empty result.

A conversation is streamed through its task turn by turn: memory holds one Arrow
batch, whatever the number of turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: An escape never occurs in a marker; see ``Template.escape``.
ESCAPE, JOINT = "\\", "\\:"


@dataclass(frozen=True)
class Template:
    """What opens and closes a turn of each role, which texts carry loss, and
    which role may follow which (``None``: the start)."""

    turns: dict = field(default_factory=lambda: {
        "system": ("<<SYS>>\n", "\n<</SYS>>\n\n", False),
        "user": ("[INST] ", " [/INST]", False),
        "assistant": ("<s> ", " </s>", True),
    })
    #: Any other role: its escaped name stands between the two openings.
    other: tuple = ("[ROLE]", "[/ROLE] ", " [/TURN]", False)
    follows: dict = field(default_factory=lambda: {
        None: ("system", "user"), "system": ("user",), "user": ("assistant",),
        "assistant": ("user",),
    })
    controls: tuple = ("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>",
                       "[ROLE]", "[/ROLE]", "[/TURN]")

    def __post_init__(self):
        marks = [m for t in self.turns.values() for m in t[:2]] + list(self.other[:3])
        for mark in marks:
            if ESCAPE in mark or not any(c in mark for c in self.controls):
                raise ValueError(f"a marker needs a control string and no backslash: {mark!r}")
            for c in self.controls:
                if any(mark.endswith(c[:k]) for k in range(1, len(c))):
                    raise ValueError(f"{mark!r} ends with the beginning of {c!r}")

    def pattern(self) -> re.Pattern:
        """Every place where a control string begins."""
        return re.compile("(?=" + "|".join(map(re.escape, self.controls)) + ")")

    def escape(self, text: str, after: str, pattern: re.Pattern) -> str:
        """Double every backslash and put a joint behind the first character of
        each control string, also of one that ``after`` would complete."""
        out, last = [], 0
        for m in pattern.finditer(text + after):
            if m.start() >= len(text):
                break
            out.append(text[last:m.start() + 1].replace(ESCAPE, ESCAPE * 2))
            out.append(JOINT)
            last = m.start() + 1
        out.append(text[last:].replace(ESCAPE, ESCAPE * 2))
        return "".join(out)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", lambda m: "" if m[1] == ":" else m[1], text) \
            if ESCAPE in text else text


FORMATTED = ("conv_id long, turn long, formatted string, text_start int, text_end int, "
             "loss boolean, valid boolean")
READ = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
        "formatted_chars long, valid boolean")


def format_turns(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per turn: its formatted text, where the turn's own (escaped) text
    lies in it, whether that part carries loss, and whether the conversation has
    kept to the turn order up to here. Markers never carry loss.

    Rows come sorted by conversation and turn within each partition.
    """
    ordered = (
        conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"),
                             F.coalesce("role", F.lit("")).alias("role"),
                             F.coalesce("text", F.lit("")).alias("text"))
        .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = template.pattern()
        current, state, valid, started = None, None, True, False
        for batch in batches:
            out = {k: [] for k in ("formatted", "text_start", "text_end", "loss", "valid")}
            for conv, role, text in zip(batch["conv_id"].to_pylist(), batch["role"].to_pylist(),
                                        batch["text"].to_pylist()):
                if not started or conv != current:
                    current, state, valid, started = conv, None, True, True
                valid = valid and role in template.follows.get(state, ())
                state = role
                if role in template.turns:
                    opening, closing, loss = template.turns[role]
                else:
                    before, behind, closing, loss = template.other
                    opening = before + template.escape(role, behind, pattern) + behind
                body = template.escape(text, closing, pattern)
                out["formatted"].append(opening + body + closing)
                out["text_start"].append(len(opening))
                out["text_end"].append(len(opening) + len(body))
                out["loss"].append(loss)
                out["valid"].append(valid)
            yield pa.RecordBatch.from_arrays([
                batch["conv_id"], batch["turn"], pa.array(out["formatted"], pa.string()),
                pa.array(out["text_start"], pa.int32()), pa.array(out["text_end"], pa.int32()),
                pa.array(out["loss"], pa.bool_()), pa.array(out["valid"], pa.bool_())],
                names=["conv_id", "turn", "formatted", "text_start", "text_end", "loss", "valid"])

    return ordered.mapInArrow(run, FORMATTED)


def segments(formatted: DataFrame) -> DataFrame:
    """The parts of each formatted turn with their loss flags, markers apart."""
    part = lambda name, start, end, loss: F.struct(
        F.lit(name).alias("kind"), F.substring("formatted", start + 1, end - start).alias("text"),
        loss.alias("loss"))
    size = F.char_length("formatted")
    return formatted.select("conv_id", "turn", F.posexplode(F.array(
        part("open", F.lit(0), F.col("text_start"), F.lit(False)),
        part("text", F.col("text_start"), F.col("text_end"), F.col("loss")),
        part("close", F.col("text_end"), size, F.lit(False)))).alias("place", "part")) \
        .select("conv_id", "turn", "place", "part.*")


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """What ``format_turns`` wrote, read again: one row per conversation with the
    digest of its roles and texts, and of all text under the loss mask.

    Takes the sorted partitions that ``format_turns`` gives. Roles come from the
    markers in the formatted text, texts from between them.
    """

    def parse(line: str) -> tuple[str, str]:
        for role, (opening, closing, _) in template.turns.items():
            if line.startswith(opening):
                return role, template.unescape(line[len(opening):len(line) - len(closing)])
        before, behind, closing, _ = template.other
        cut = line.index(behind)
        return (template.unescape(line[len(before):cut]),
                template.unescape(line[cut + len(behind):len(line) - len(closing)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()),
                            ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                            ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
                            ("valid", pa.bool_())])
        current = None  # conversation, counts and digests so far

        def done():
            conv, n, turns, chars, lost, size, valid = current
            return conv, n, turns.hexdigest(), chars, lost.hexdigest(), size, valid

        for batch in batches:
            rows = []
            for conv, line, start, end, loss, valid in zip(
                    *(batch[c].to_pylist() for c in
                      ("conv_id", "formatted", "text_start", "text_end", "loss", "valid"))):
                if current is None or conv != current[0]:
                    if current is not None:
                        rows.append(done())
                    current = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, True]
                role, text = parse(line)
                current[1] += 1
                current[2].update(f"{role}\n{text}\n".encode())
                if loss:
                    under = template.unescape(line[start:end])
                    current[3] += len(under)
                    current[4].update(under.encode())
                current[5] += len(line)
                current[6] = valid
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        if current is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], f.type) for v, f in zip(done(), schema)], schema=schema)

    return formatted.mapInArrow(run, READ)
