"""Chat formatting: records of unlike layouts become canonical turns, then one marked text.

A layout is known by its fingerprint, a hash of the nested field paths of a record. Fingerprints
select a declarative mapping: where the turns are, and which field or constant is role and text.
The template marks each turn; control strings inside a text are escaped so that they can be told
from the template's and put back.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longitab.llm.common import bounded_batches, partitions_of, pieces

BEGIN, END = "<|im_start|>", "<|im_end|>"
_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
#: Speakers of the layout with ``from`` and ``value``, and their canonical roles (fixed values).
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "prompter": "user"}


@dataclass(frozen=True)
class Mapping:
    """``turns``: path of the list of turns, None for one record; ``parts``: (role, text path) in
    order. A role that begins with ``.`` is a path in the turn."""

    paths: tuple[str, ...]
    parts: tuple[tuple[str, str], ...]
    turns: str | None = None
    optional: frozenset[str] = field(default_factory=frozenset)

    @property
    def fingerprint(self) -> str:
        return fingerprint_of(self.paths)


def fingerprint_of(paths) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


def paths_of(value, at: str = "") -> set[str]:
    """Nested field paths; elements of a list share one path."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in paths_of(v, f"{at}.{k}" if at else k)}
    if isinstance(value, list):
        return {p for v in value for p in paths_of(v, at + "[]")} or {at + "[]"}
    return {at}


#: Known layouts.
MAPPINGS = (
    Mapping(("role", "text"), ((".role", "text"),)),
    Mapping(("role", "content"), ((".role", "content"),)),
    Mapping(("prompt", "completion"), (("user", "prompt"), ("assistant", "completion"))),
    Mapping(("prompt", "response"), (("user", "prompt"), ("assistant", "response"))),
    Mapping(("instruction", "output"), (("user", "instruction"), ("assistant", "output"))),
    Mapping(("instruction", "input", "output"), (("user", "instruction\ninput"), ("assistant", "output"))),
    Mapping(("messages[].role", "messages[].content"), ((".role", "content"),), "messages"),
    Mapping(("conversations[].from", "conversations[].value"), ((".from", "value"),), "conversations"),
    Mapping(("system", "messages[].role", "messages[].content"), ((".role", "content"),), "messages", frozenset(["system"])),
)
BY_FINGERPRINT = {m.fingerprint: m for m in MAPPINGS}


def _text(record: dict, path: str) -> str:
    """Fields named one per line, joined by a blank line; null and empty ones are left out."""
    found = [record.get(p) for p in path.split("\n")]
    return "\n\n".join(str(v) for v in found if v not in (None, "")) if len(found) > 1 else str(found[0] if found[0] is not None else "")


def turns_of(record, mappings=None) -> list[tuple[str, str]] | None:
    """Canonical (role, text) turns of a record, None when no mapping has its fingerprint."""
    if not isinstance(record, dict):
        return None
    mapping = (mappings or BY_FINGERPRINT).get(fingerprint_of(paths_of(record)))
    if mapping is None:
        return None
    out = [("system", str(record[k] or "")) for k in sorted(mapping.optional)]
    for item in (record[mapping.turns] if mapping.turns else [record]):
        for role, path in mapping.parts:
            name = str(item.get(role[1:]) or "") if role.startswith(".") else role
            out.append((ROLES.get(name, name) if role == ".from" else name, _text(item, path)))
    return out


def escape(text: str) -> str:
    """One more backslash in every ``<`` ... ``|``, so that no ``<|`` is left."""
    return _CONTROL.sub(lambda m: "<" + m[1] + "\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "<" + m[1] + "|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The marked turn, and the code points [begin, end) under the loss mask: an assistant's text."""
    head, body = f"{BEGIN}{escape_role(role)}\n", escape(text)
    return f"{head}{body}{END}\n", *((len(head), len(head) + len(body)) if role == "assistant" else (0, 0))


def parse_turn(marked: str) -> tuple[str, str]:
    """Role and text of a marked turn."""
    if not marked.startswith(BEGIN) or not marked.endswith(END + "\n") or "<|" in marked[len(BEGIN):-len(END) - 1]:
        raise ValueError("not a marked turn")
    role, _, body = marked[len(BEGIN):-len(END) - 1].partition("\n")
    return unescape_role(role), unescape(body)


def format_records(df: DataFrame, id_col: str, record_col: str) -> DataFrame:
    """One row per turn of each JSON record: id, ``turn``, ``role``, ``text``, ``fingerprint``.

    A record that is null, not JSON, or of an unknown layout gives one row with null turn, role and
    text, so that nothing is lost silently. Repeated rows each give their turns.
    """
    bounded_batches(df.sparkSession)
    schema = pa.schema([("id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("fingerprint", pa.string())])

    def run(batches):
        for batch in batches:
            rows = []
            for key, raw in zip(*(batch.column(c).to_pylist() for c in range(2))):
                try:
                    record = json.loads(raw) if raw is not None else None
                except ValueError:
                    record = None
                mark = fingerprint_of(paths_of(record)) if isinstance(record, dict) else None
                turns = turns_of(record)
                rows += [(key, i, r, t, mark) for i, (r, t) in enumerate(turns)] if turns else [(key, None, None, None, mark)]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, schema)], schema=schema)

    return (df.select(F.col(id_col).cast("long").alias("id"), F.col(record_col).cast("string").alias("raw"))
            .mapInArrow(run, "id long, turn long, role string, text string, fingerprint string").withColumnRenamed("id", id_col))


def format_turns(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """Marked turns: id, ``turn``, ``role``, ``marked`` and the loss mask ``loss_begin``,
    ``loss_end`` in code points. A conversation's text is its marked turns in order.

    Rows are read as records with the fields role and text, through the mapping that their
    fingerprint selects. Null text and role are empty. A turn is formatted by itself, so no
    conversation has to fit anywhere.
    """
    bounded_batches(rows.sparkSession)
    schema = pa.schema([("id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("marked", pa.string()),
                        ("loss_begin", pa.int64()), ("loss_end", pa.int64())])

    def run(batches):
        for batch in pieces(batches, 3):
            out = []
            for key, turn, role, text in zip(*(batch.column(c).to_pylist() for c in range(4))):
                for r, t in turns_of({"role": role, "text": text}):
                    out.append((key, turn, r, *format_turn(r, t)))
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return (rows.select(F.col(id_col).cast("long").alias("id"), F.col(turn_col).cast("long").alias("turn"),
                        F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(run, "id long, turn long, role string, marked string, loss_begin long, loss_end long")
            .withColumnRenamed("id", id_col))


def digest(marked: DataFrame, id_col: str = "conv_id", partitions: int | None = None) -> DataFrame:
    """One row per conversation, parsed from its marked turns: id, ``n_turns``, ``turns_sha256``,
    ``loss_chars``, ``loss_sha256``, ``formatted_chars``.

    Turns are hashed one after another in the order turn, role, text, null first, so a
    conversation of any length takes the memory of one turn. Null ids are one conversation.
    """
    bounded_batches(marked.sparkSession)
    n = partitions or partitions_of(marked.sparkSession)
    schema = pa.schema([("id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                        ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches):
        key, state = None, None

        def row():
            n, turns, chars, loss, formatted = state
            return key, n, turns.hexdigest(), chars, loss.hexdigest(), formatted

        for batch in pieces(batches, 1):
            rows = []
            for k, marked_turn, begin, end in zip(*(batch.column(c).to_pylist() for c in range(4))):
                if state is None or k != key:
                    if state is not None:
                        rows.append(row())
                    key, state = k, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parse_turn(marked_turn)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                loss = unescape(marked_turn[begin:end])
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += len(marked_turn)
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        if state is not None:
            yield pa.record_batch([pa.array([v], f.type) for v, f in zip(row(), schema)], schema=schema)

    ordered = (marked.select(F.col(id_col).alias("id"), "turn", "role", "marked", "loss_begin", "loss_end")
               .repartition(n, "id").sortWithinPartitions("id", "turn", "role", "marked")
               .select("id", "marked", "loss_begin", "loss_end"))
    return ordered.mapInArrow(run, "id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                                   "formatted_chars long").withColumnRenamed("id", id_col)
