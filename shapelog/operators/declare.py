"""Declared catalogs: TypeScript-like text to catalog rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapelog.functions.typetext import (
    TYPE_WORDS,
    TokenReader,
    TypeTextError,
    type_json,
    type_text,
)
from shapelog.functions.vocabulary import IDENTIFIER, MESSAGE_NAME
from shapelog.operators.extract import fail_on_error
from shapelog.operators.python_stage import flat_map_rows

_DECLARED = (
    "file_rank bigint, file string, actor string, actor_at int, actor_line int, "
    "message string, message_at int, line int, arity int, slot0 string, slot1 string, "
    "slot0_json string, slot1_json string, error string"
)
_BLOCK_END = (",", ";", "}")


def _word(reader):
    if reader.group != "word" or reader.value in TYPE_WORDS:
        reader.fail()
    taken = reader.value, reader.at
    reader.advance()
    return taken


def _name(reader):
    if reader.group == "text":
        taken = reader.value, reader.at
        reader.advance()
        return taken
    return _word(reader)


def _up_to_brace(reader):
    """Yields before each entry of a block; entries are separated by , or ;"""
    while True:
        yield
        if not reader.accept(",", ";"):
            reader.expect("}")
            return
        if reader.accept("}"):
            return


def _slots(reader):
    line = reader.at
    if reader.sees("("):
        ahead = reader.offset, reader.line
        reader.advance()
        if reader.group == "word" and reader.value not in TYPE_WORDS:
            reader.advance()
            reader.expect(":")
            sent = reader.type()
            reader.expect(")")
            reader.expect("=>")
            slots = [None if t == "never" else t for t in (sent, reader.type())]
            if slots == [None, None]:
                raise TypeTextError(
                    line,
                    'Message type must have a non-"never" type to either the left or right '
                    "of the arrow",
                )
            return slots
        (reader.offset, reader.line), reader.group, reader.value = ahead, "mark", "("
        reader.at = line
    return [reader.type()]


def _message(reader):
    name, line = _name(reader)
    reader.expect(":")
    slots = _slots(reader)
    if not any(reader.sees(mark) for mark in _BLOCK_END):
        reader.fail()
    if not re.fullmatch(MESSAGE_NAME, name):
        raise TypeTextError(
            line,
            f'Message name "{name}" should be a valid identifier (it can also contain '
            '"-" or ":" after the first character)',
        )
    return name, line, slots


def _actor(reader):
    """Name, line, and either the one type of the actor or its messages."""
    name, line = _name(reader)
    reader.expect(":")
    if not reader.accept("{"):
        if reader.group != "word" or reader.value not in ("any", "testOnly"):
            reader.fail()
        whole = reader.value
        reader.advance()
        if not re.fullmatch(IDENTIFIER, name):
            raise TypeTextError(line, f'Actor name "{name}" should be a valid identifier')
        return [(name, line, None, None, [whole])]
    found = [(name, line, *_message(reader)) for _ in _up_to_brace(reader)]
    if not re.fullmatch(IDENTIFIER, name):
        raise TypeTextError(line, f'Actor name "{name}" should be a valid identifier')
    return found


def _document(text):
    reader = TokenReader(text)
    opening = [_word(reader), _word(reader)]
    reader.expect("=")
    reader.expect("{")
    actors = [_actor(reader) for _ in _up_to_brace(reader)]
    reader.expect(";")
    reader.accept(";")
    if reader.group != "end":
        reader.fail()
    expected = ("type", "Expected actor declarations to start with"), (
        "MessageTypes",
        "Expected top level type name to be",
    )
    for (word, line), (wanted, complaint) in zip(opening, expected):
        if word != wanted:
            raise TypeTextError(line, f'{complaint} "{wanted}", not "{word}"')
    return actors


def _declared(rank, file, text):
    try:
        actors = _document(text)
    except TypeTextError as e:
        yield (rank, file, *[None] * 11, e.located(file))
        return
    except RecursionError:
        yield (rank, file, *[None] * 11, f"{file}:0: Type is nested too deeply")
        return
    for actor_at, messages in enumerate(actors):
        for message_at, (actor, actor_line, message, line, slots) in enumerate(messages):
            texts = [t and type_text(t) for t in slots] + [None] * (2 - len(slots))
            jsons = [t and type_json(t) for t in slots] + [None] * (2 - len(slots))
            yield (
                rank, file, actor, actor_at, actor_line, message, message_at, line,
                len(slots), *texts, *jsons, None,
            )


def parse_declarations(files: DataFrame, mode="PERMISSIVE") -> DataFrame:
    """Catalog rows of declaration files (``file, text`` and perhaps
    ``file_rank``), with where each actor and message stands.

    A file that is no declaration gives one row with only ``error``.
    """
    if "file_rank" not in files.columns:
        files = files.withColumn("file_rank", F.lit(0).cast("bigint"))
    parsed = flat_map_rows(files, ["file_rank", "file", "text"], _declared, _DECLARED)
    return fail_on_error(parsed, mode)
