"""Chat formatting with a loss mask whose spans are aligned to token offsets."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shapelog.llm.common import ship

#: Role whose texts are learned from; characters after which a part ends with its turn.
LEARNED, PART = "assistant", 1 << 20

_TURN = re.compile(r"### ((?:[^\\:]|\\.)*+): ((?:[^\\<]|\\.|<(?!/turn>))*+)</turn>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)
# A backslash goes before each backslash and each place where a control string begins.
_CONTROL = re.compile(r"\\|#(?=##)|<(?=/turn>)")
_CONTROL_OF_ROLE = re.compile(r"[\\:]|#(?=##)|<(?=/turn>)")


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """One turn of the template, and where its text lies in it."""
    head = "### " + _CONTROL_OF_ROLE.sub(lambda m: "\\" + m[0], role) + ": "
    body = escape(text)
    return head + body + "</turn>\n", len(head), len(head) + len(body)


def parse(text: str) -> list[tuple[str, str]]:
    """The (role, text) pairs that a rendered conversation or part was made of."""
    turns, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def intersect(offsets: np.ndarray, spans: np.ndarray):
    """For sorted token offsets and sorted disjoint spans: which tokens meet a span, and the common parts.

    Both ends are found by binary search. The parts are joined where they touch:
    tokens of one character's bytes share its offsets, and count it once.
    """
    starts, ends = spans[:, 0], spans[:, 1]
    first = np.searchsorted(ends, offsets[:, 0], "right")
    last = np.searchsorted(starts, offsets[:, 1], "left")
    mask = (last > first) & (offsets[:, 1] > offsets[:, 0])
    which = first[mask]
    low = np.maximum(offsets[mask, 0], starts[which])
    high = np.minimum(offsets[mask, 1], ends[which])
    parts = []
    for a, b in zip(low.tolist(), high.tolist()):
        if parts and a <= parts[-1][1]:
            parts[-1][1] = max(parts[-1][1], b)
        elif b > a:
            parts.append([a, b])
    return mask, parts


class Formatter:
    """Renders and encodes turns; a part ends with a turn.

    The tokenizer's words end before the ``###`` that begins a turn, so the parts of
    a long conversation have the tokens of the whole, one after the other.
    """

    def __init__(self, model: str):
        self.tokenizer = Tokenizer.from_str(model)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def __call__(self, turns):
        texts, spans, at = [], [], 0
        for role, text in turns:
            made, low, high = render_turn(role, text)
            texts.append(made)
            if role == LEARNED and high > low:
                spans.append((at + low, at + high))
            at += len(made)
        whole = "".join(texts)
        encoded = self.tokenizer.encode(whole, add_special_tokens=False)
        offsets = np.array(encoded.offsets, np.int64).reshape(-1, 2)
        mask, parts = intersect(offsets, np.array(spans, np.int64).reshape(-1, 2))
        return whole, encoded.ids, mask.tolist(), parts


_PARTS = pa.schema(
    [
        ("conv_id", pa.int64()), ("part", pa.int64()), ("turns", pa.int64()), ("text", pa.string()),
        ("ids", pa.list_(pa.int32())), ("loss_mask", pa.list_(pa.bool_())),
        ("loss_spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
    ]
)


def format_conversations(rows: DataFrame, tokenizer: str) -> DataFrame:
    """Rendered conversations of ``rows(conv_id, turn, role, text)``: text, token ids, loss mask and spans.

    One row per conversation; one of over ``PART`` characters has several parts,
    numbered, in order, cut between turns. ``loss_mask`` marks the tokens that meet an
    assistant's text, ``loss_spans`` their characters in it. Rows are shuffled by
    conversation and sorted by turn, then role and text; a task streams them and
    holds one part, however long the conversation. The tokenizer file is read on the
    driver and broadcast. Null texts and roles are empty, null turns come first, rows
    without conv_id form one conversation; repeated rows are turns of their own. An
    empty table gives none; other columns are not read.
    """
    with open(tokenizer, encoding="utf-8") as file:
        model = rows.sparkSession.sparkContext.broadcast(file.read())

    def run(batches_in):
        form, conv, part, held, size = Formatter(model.value), None, 0, [], 0
        started = False

        def flush():
            text, ids, mask, spans = form(held)
            made = [{"start": a, "end": b} for a, b in spans]
            columns = [[conv], [part], [len(held)], [text], [ids], [mask], [made]]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, _PARTS)], schema=_PARTS
            )

        for batch in batches_in:
            for now, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if started and now != conv:
                    if held:
                        yield flush()
                    part, held, size = 0, [], 0
                started, conv = True, now
                held.append((role, text))
                size += len(text) + len(role)
                if size >= PART:
                    yield flush()
                    part, held, size = part + 1, [], 0
        if held:
            yield flush()

    ship(rows.sparkSession)
    narrow = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    placed = narrow.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return placed.mapInArrow(
        run,
        "conv_id long, part long, turns long, text string, ids array<int>, loss_mask array<boolean>,"
        " loss_spans array<struct<start:int,end:int>>",
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, read from its rendered text and loss spans alone.

    ``formatted`` comes straight from ``format_conversations``: the parts of a
    conversation follow each other in one task, which keeps running digests only.
    """

    def run(batches_in):
        conv, state = None, None
        for batch in batches_in:
            for now, text, spans in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if state is not None and now != conv:
                    yield close(conv, state)
                    state = None
                if state is None:
                    conv, state = now, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parse(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for s in spans:
                    state[3].update(unescape(text[s["start"] : s["end"]]).encode())
                    state[2] += len(unescape(text[s["start"] : s["end"]]))
                state[4] += len(text)
        if state is not None:
            yield close(conv, state)

    def close(conv, state):
        values = [conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)

    ship(formatted.sparkSession)
    return formatted.select("conv_id", "text", "loss_spans").mapInArrow(
        run,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )
