"""Chat formatting by schema fingerprints.

A record's layout is the set of its nested field paths with their kinds; its hash selects a declarative mapping, which
says where turns, roles and texts lie.  Mapped turns are written with control strings that cannot occur in escaped text,
together with the spans of the output that count for the loss, and can be read back exactly.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions

# ---- layouts ---------------------------------------------------------------------------------------------------------


def paths(value: Any, at: str = "") -> Iterator[str]:
    """Nested field paths with kinds, e.g. messages[].role:str.  Null and strings are one kind."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from paths(v, f"{at}.{k}" if at else str(k))
    elif isinstance(value, list):
        if not value:
            yield f"{at}[]"
        for v in value:
            yield from paths(v, f"{at}[]")
    else:
        yield f"{at}:{'str' if value is None or isinstance(value, str) else type(value).__name__}"


def schema_fingerprint(record: dict) -> str:
    return _fingerprint(sorted(set(paths(record))))


def _fingerprint(found: Iterable[str]) -> str:
    return xxhash.xxh64_hexdigest("\n".join(found).encode(), 0)


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns.

    turns: field of the list of messages, with role and text the fields within; or, without turns, fixed (role, fields)
    pairs: the fields that are not empty are joined by a blank line, and a pair without any gives no turn, but for roles
    in ``always``.  rename says what roles are called here.
    """

    turns: str | None = None
    role: str | None = None
    text: str | None = None
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = ()
    rename: tuple[tuple[str, str], ...] = ()
    always: tuple[str, ...] = ("user", "assistant")

    def layout(self, optional: tuple[str, ...] = ()) -> tuple[str, ...]:
        """Paths of a record of this mapping without the optional fields."""
        if self.turns:
            return tuple(sorted((f"{self.turns}[].{self.role}:str", f"{self.turns}[].{self.text}:str")))
        if self.role:
            return tuple(sorted((f"{self.role}:str", f"{self.text}:str")))
        return tuple(sorted(f"{f}:str" for _, fields in self.fixed for f in fields if f not in optional))

    def apply(self, record: dict) -> list[tuple[str, str]]:
        names = dict(self.rename)
        if self.turns or self.role:
            rows = record.get(self.turns) or [] if self.turns else [record]
            pairs = [(r.get(self.role) or "", r.get(self.text) or "") for r in rows]
            return [(names.get(role, role), text) for role, text in pairs]
        out = []
        for role, fields in self.fixed:
            found = [record[f] for f in fields if record.get(f)]
            if found or role in self.always:
                out.append((role, "\n\n".join(found)))
        return out


SHARED = (("human", "user"), ("gpt", "assistant"), ("chatgpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))
INSTRUCTION = Mapping(fixed=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))))
PROMPT = Mapping(fixed=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",))))
RESPONSE = Mapping(fixed=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))))
QUESTION = Mapping(fixed=(("system", ("context",)), ("user", ("question",)), ("assistant", ("answer",))))
TURN_ROW = Mapping(role="role", text="text")


def _registry() -> dict[str, Mapping]:
    out = {}
    for mapping in (
        Mapping(turns="messages", role="role", text="content"),
        Mapping(turns="conversations", role="from", text="value", rename=SHARED),
        Mapping(turns="turns", role="role", text="text"),
        TURN_ROW,
    ):
        out[_fingerprint(mapping.layout())] = mapping
    for name in ("messages", "conversations", "turns"):
        # no turns at all: an empty list under the field
        out[_fingerprint([f"{name}[]"])] = Mapping(turns=name, role="role", text="text")
    for mapping, optional in ((INSTRUCTION, ("system", "input")), (PROMPT, ("system",)), (RESPONSE, ("system",)), (QUESTION, ("context",))):
        for k in range(1 << len(optional)):
            out[_fingerprint(mapping.layout(tuple(o for i, o in enumerate(optional) if k >> i & 1)))] = mapping
    return out


MAPPINGS = _registry()


class UnknownLayout(ValueError):
    """No mapping has this fingerprint; the message names it and the paths."""


def canonical_turns(record: dict, mappings: dict[str, Mapping] = MAPPINGS) -> list[tuple[str, str]]:
    """(role, text) pairs of a record in any known layout; null roles and texts are empty."""
    mapping = mappings.get(fingerprint := schema_fingerprint(record))
    if mapping is None:
        raise UnknownLayout(f"{fingerprint}: {sorted(set(paths(record)))}")
    return mapping.apply(record)


# ---- template --------------------------------------------------------------------------------------------------------

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that this or a common model takes for control; a backslash after the first character breaks them.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_ESCAPE = re.compile(r"\\|" + "|".join(map(re.escape, CONTROL)))
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """No control string is left, and unescape gives the text back: every backslash of the result starts an escape."""
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, list[tuple[int, int]]]:
    """The turn's output, and the spans of it that count for the loss: the text, if the assistant says it."""
    head = f"{TURN}{escape(role)}{TEXT}"
    body = escape(text)
    return f"{head}{body}{END}\n", [(len(head), len(head) + len(body))] if role == "assistant" else []


_READ = re.compile(f"{re.escape(TURN)}(.*?){re.escape(TEXT)}(.*?){re.escape(END)}\n", re.DOTALL)


def read_turns(output: str) -> list[tuple[str, str]]:
    """The (role, text) pairs that the output was made from."""
    out, at = [], 0
    while at < len(output):
        if (m := _READ.match(output, at)) is None:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def format_record(record: dict) -> tuple[str, list[tuple[int, int]]]:
    """A whole record's output with the loss spans in it."""
    output, spans = "", []
    for role, text in canonical_turns(record):
        piece, own = format_turn(role, text)
        spans += [(a + len(output), b + len(output)) for a, b in own]
        output += piece
    return output, spans


# ---- tables ----------------------------------------------------------------------------------------------------------

FORMATTED = "conv_id long, k long, formatted string, loss_from long, loss_to long"


def turn_records(rows: DataFrame) -> DataFrame:
    """rows: conv_id, turn, role, text, a row per turn.  Returns them as records (see format_records) of one turn each."""
    record = F.to_json(F.struct("role", "text"), {"ignoreNullFields": "false"}).alias("record")
    by = F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), by.alias("by"), record)


def format_records(records: DataFrame) -> DataFrame:
    """records: conv_id, turn, by (a struct of two strings, which orders records of one turn), record (JSON in any layout of
    MAPPINGS; an unknown one is an error).  Returns conv_id, k, formatted, loss_from, loss_to; a row per turn.

    Records are in order of turn (null last), then by, and repeated rows all count; k numbers a conversation's turns from 0.
    Null roles and texts are empty; a record without turns, as of an empty list, gives no row.  A conversation's output is its
    rows' formatted, one after the other, and the loss spans are given within each.  Null conv_ids are one conversation.
    Empty tables give an empty result.  Records are sorted within partitions by conversation and stream through, so that no
    conversation, however long, is held in memory.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, k = object(), 0
        for batch in batches:
            out = []
            for conv_id, record in zip(batch["conv_id"], batch["record"]):
                conv_id = None if pd.isna(conv_id) else int(conv_id)
                if conv_id != last:
                    last, k = conv_id, 0
                for role, text in canonical_turns(json.loads(record)):
                    piece, spans = format_turn(role, text)
                    out.append((conv_id, k, piece, *(spans[0] if spans else (None, None))))
                    k += 1
            frame = pd.DataFrame(out, columns=["conv_id", "k", "formatted", "loss_from", "loss_to"])
            yield frame.astype({"conv_id": "Int64", "loss_from": "Int64", "loss_to": "Int64"})

    ordered = (
        records.select("conv_id", "turn", "by", "record")
        .repartition(partitions(records.sparkSession), "conv_id")
        .sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "by")
        .select("conv_id", "record")
    )
    return ordered.mapInPandas(work, FORMATTED)


def format_rows(rows: DataFrame) -> DataFrame:
    """rows: conv_id, turn, role, text, a row per turn; other columns are ignored.  As format_records, ties by role and text."""
    return format_records(turn_records(rows))


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digest(formatted: DataFrame, ordered: bool = False) -> DataFrame:
    """What the output of format_rows says when it is read back: one row per conversation.

    formatted: conv_id, k, formatted, loss_from, loss_to, in any order; a conversation's rows are dealt to one task and sorted
    there, and digests are carried from row to row, since SHA-256 has no other way.  ordered: it comes straight from
    format_records, which has dealt and sorted it.  Null conv_ids are one conversation, rows of one k come as they are.  Empty
    tables give an empty result.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: list | None = None
        last = object()

        def row() -> tuple:
            return (state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5])

        for batch in batches:
            out = []
            for conv_id, piece, lo, hi in zip(*(batch[c] for c in ("conv_id", "formatted", "loss_from", "loss_to"))):
                conv_id = None if pd.isna(conv_id) else int(conv_id)
                if conv_id != last:
                    if state:
                        out.append(row())
                    last, state = conv_id, [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in read_turns(piece):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                if not pd.isna(lo):
                    text = unescape(piece[int(lo) : int(hi)])
                    state[3] += len(text)
                    state[4].update(text.encode())
                state[5] += len(piece)
            yield _digests(out)
        if state:
            yield _digests([row()])

    if not ordered:
        formatted = formatted.repartition(partitions(formatted.sparkSession), "conv_id").sortWithinPartitions("conv_id", "k")
    return formatted.mapInPandas(work, DIGEST)


def _digests(rows: list[tuple]) -> pd.DataFrame:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pd.DataFrame(rows, columns=names).astype({"conv_id": "Int64"})
