"""Chat formatting by columnar byte assembly.

A conversation becomes ``<s>`` + turns + ``</s>`` and each turn ``[INST]role\\ntext[/INST]\\n``.  Control strings inside
roles and texts are escaped by one more backslash after their first character, so they can be told from the template's and
restored exactly.  The bytes of all turns of a batch are laid out at once: segment lengths, cumulative offsets and scatter
indices are computed with numpy, and headers and contents copied into one preallocated buffer.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, END, OPEN, CLOSE = b"<s>", b"</s>", b"[INST]", b"[/INST]\n"
CONTROL = r"([<\[])(\\*)(/?(?:s>|INST\]))"
ESCAPED = re.compile(r"([<\[])\\(\\*)(/?(?:s>|INST\]))")
TURN = re.compile(r"\[INST\](.*?)\n(.*?)\[/INST\]\n", re.S)
LOSS_ROLE = "assistant"
#: Bytes after which a conversation goes on in a further part, so that no task holds more than about so much of one.
PART_BYTES = 1 << 26


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def escaped_role(role: Column) -> Column:
    """Roles have their backslashes doubled and line ends spelled out too: a header is one line."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescaped(text: str) -> str:
    return ESCAPED.sub(r"\1\2\3", text)


def unescaped_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role))


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, and first place and length of each value, of a string column without nulls."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    return data, offsets[:-1], np.diff(offsets)


def _scatter(out: np.ndarray, to: np.ndarray, data: np.ndarray, first: np.ndarray, length: np.ndarray) -> None:
    """Copy the values (first, length) of data to the places ``to``, all at once."""
    total = int(length.sum())
    if total:
        run = np.arange(total) - np.repeat(np.cumsum(length) - length, length)
        out[np.repeat(to, length) + run] = data[np.repeat(first, length) + run]


def assemble(roles: pa.Array, texts: pa.Array, loss: np.ndarray, group: np.ndarray, opens: np.ndarray, closes: np.ndarray) -> tuple[pa.Array, list[list[dict]]]:
    """Formatted strings of the groups of consecutive turns, and the byte spans of each under the loss mask.

    ``group`` numbers the turns' strings from 0; ``opens`` and ``closes`` tell which strings begin and end a conversation."""
    role, text = _bytes(roles), _bytes(texts)
    head = len(OPEN) + role[2] + 1
    size = head + text[2] + len(CLOSE)
    per = np.bincount(group, weights=size, minlength=len(opens)).astype(np.int64) + len(BEGIN) * opens + len(END) * closes
    start = np.concatenate([[0], np.cumsum(per)])
    before = np.cumsum(size) - size
    first_turn = np.searchsorted(group, np.arange(len(opens)))
    at = start[group] + len(BEGIN) * opens[group] + before - before[first_turn][group]
    out = np.empty(int(start[-1]), dtype=np.uint8)
    for marker, places in ((BEGIN, start[:-1][opens]), (END, (start[1:] - len(END))[closes]), (OPEN, at), (b"\n", at + head - 1), (CLOSE, at + head + text[2])):
        value = np.frombuffer(marker, dtype=np.uint8)
        out[places[:, None] + np.arange(len(value))] = value
    _scatter(out, at + len(OPEN), *role)
    _scatter(out, at + head, *text)
    spans: list[list[dict]] = [[] for _ in range(len(opens))]
    for g, a, n in zip(group[loss].tolist(), (at + head - start[group])[loss].tolist(), text[2][loss].tolist(), strict=True):
        spans[g].append({"start": a, "length": n})
    return pa.Array.from_buffers(pa.large_string(), len(opens), [None, pa.py_buffer(start.astype(np.int64)), pa.py_buffer(out)]), spans


def format_chats(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows of id, part, formatted and loss (array of structs start, length in bytes of formatted), one per conversation.

    Rows stand by turn (null first), then by role and text as escaped; a null role or text counts as empty; repeated rows are turns of
    their own; rows whose id is null are one conversation; other columns are ignored; an empty table gives no rows.  A
    conversation of more than PART_BYTES goes on in further parts, whose concatenation is its whole.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = turns.select(F.col(id_col).cast("long").alias("id"), escaped_role(role).alias("role"), escaped(text).alias("text"), (role == LOSS_ROLE).alias("loss"), F.col(turn_col).alias("turn"))
    rows = rows.repartition("id").sortWithinPartitions("id", "turn", "role", "text").drop("turn")
    loss_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))

    def run(batches):
        held: list[pa.RecordBatch] = []
        part, going = 0, False

        def known_ids(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            ids = table.column("id").combine_chunks()
            return ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False)

        def emit(table: pa.Table, last: bool):
            """The conversations of these turns; unless ``last``, the final one goes on."""
            nonlocal part, going
            ids = table.column("id").combine_chunks()
            values, known = known_ids(table)
            new = np.concatenate([[True], (values[1:] != values[:-1]) | (known[1:] != known[:-1])])
            first = np.flatnonzero(new)
            opens, closes = np.ones(len(first), dtype=bool), np.ones(len(first), dtype=bool)
            opens[0], closes[-1] = not going, last
            text, spans = assemble(table.column("role").combine_chunks(), table.column("text").combine_chunks(), table.column("loss").combine_chunks().to_numpy(zero_copy_only=False), np.cumsum(new) - 1, opens, closes)
            parts = np.zeros(len(first), dtype=np.int32)
            parts[0] = part
            part, going = (0, False) if last else (int(parts[-1]) + 1, True)
            yield from pa.table([ids.take(pa.array(first)), pa.array(parts), text.cast(pa.string()), pa.array(spans, loss_type)], names=[id_col, "part", "formatted", "loss"]).to_batches()

        for batch in batches:
            if not len(batch):
                continue
            table = pa.Table.from_batches([*held, batch])
            values, known = known_ids(table)
            other = np.flatnonzero((values != values[-1]) | (known != known[-1]))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield from emit(table.slice(0, cut), True)
            rest = table.slice(cut).combine_chunks()
            if rest.nbytes > PART_BYTES and len(rest) > 1:
                yield from emit(rest.slice(0, len(rest) - 1), False)
                rest = rest.slice(len(rest) - 1)
            held = rest.to_batches()
        if held:
            yield from emit(pa.Table.from_batches(held), True)

    return rows.mapInArrow(run, f"`{id_col}` long, part int, formatted string, loss array<struct<start:long,length:long>>")


def read_chats(formatted: DataFrame, id_col: str = "conv_id", in_order: bool = False) -> DataFrame:
    """What the formatted strings hold: id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars.

    Parts of a conversation are brought together and into order; ``in_order`` says that they follow each other in their
    partitions already, as they do straight from ``format_chats``, and saves that shuffle."""
    if not in_order:
        formatted = formatted.select(id_col, "part", "formatted", "loss").repartition(id_col).sortWithinPartitions(id_col, "part")

    def run(batches):
        open_: dict = {}
        names = [id_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        for batch in batches:
            out = []
            for conv, part, text, loss in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not part:
                    open_ = {"turns": hashlib.sha256(), "loss": hashlib.sha256(), "n": 0, "loss_n": 0, "chars": 0}
                body = text[len(BEGIN) if not part else 0 :]
                for m in TURN.finditer(body):
                    open_["turns"].update(f"{unescaped_role(m[1])}\n{unescaped(m[2])}\n".encode())
                    open_["n"] += 1
                raw = text.encode()
                for span in loss:
                    own = unescaped(raw[span["start"] : span["start"] + span["length"]].decode())
                    open_["loss"].update(own.encode())
                    open_["loss_n"] += len(own)
                open_["chars"] += len(text)
                if text.endswith(END.decode()):
                    out.append((conv, open_["n"], open_["turns"].hexdigest(), open_["loss_n"], open_["loss"].hexdigest(), open_["chars"]))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=names)

    return formatted.select(id_col, "part", "formatted", "loss").mapInArrow(run, f"`{id_col}` long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
