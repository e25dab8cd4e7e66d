"""Prompts and conversations as columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from string import Formatter
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.text import WS

# The prompt texts of the data set, with the places for what is filled in.
INSTRUCTION = "Extraia todas as ocorrências da entidade {etype} do texto."
FORMAT = (
    "Reproduza o texto inteiro, token a token (separados por espaço), na mesma ordem e sem omitir nenhum token. "
    "Logo após cada token, anexe entre parênteses, sem espaço, o seu rótulo BIO:\n"
    "- B-{etype} no primeiro token de cada ocorrência da entidade {etype};\n"
    "- I-{etype} nos demais tokens da mesma ocorrência;\n"
    "- O em todo token que não pertence à entidade.\n"
    "Formato esperado (esquema sintático, não exemplo de conteúdo): token1(O) token2(B-{etype}) token3(I-{etype}) token4(O)"
)
TEACHER = (
    "{query}\n\nEste é um exemplo de resposta correta para a tarefa acima:\n{output}\n\n"
    "Agora produza a sua própria resposta, no mesmo formato."
)
TURN = "<|im_start|>{role}\n{content}<|im_end|>"
OPEN_TURN = "<|im_start|>assistant\n"


class Encoder(Protocol):
    def encode(self, text: str) -> list[int]: ...

    def decode(self, tokens: list[int]) -> str: ...


def pieces(template: str) -> list[tuple[str, str | None]]:
    """The fixed pieces of a template, each with the name of the place behind it."""
    return [(text, name) for text, name, _, _ in Formatter().parse(template)]


def fill(template: str, **values: Column) -> Column:
    """A template with columns in its places."""
    return F.concat(*[c for text, name in pieces(template) for c in ([F.lit(text)] if text else []) + ([values[name]] if name else [])])


def instruction(entity_type: Column) -> Column:
    return fill(INSTRUCTION, etype=entity_type)


def instruction_with_format(entity_type: Column) -> Column:
    return F.concat(instruction(entity_type), F.lit("\n\n"), fill(FORMAT, etype=entity_type))


def content(instruction_text: Column, text: Column) -> Column:
    """Instruction, blank line, input."""
    return F.concat(instruction_text, F.lit("\n\n"), text)


def message(role: str, text: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), text.alias("content"))


def turn(role: Column | str, text: Column) -> Column:
    """One closed turn of the plain chat template."""
    role = F.lit(role) if isinstance(role, str) else role
    return fill(TURN, role=role, content=text)


def chat(messages: Column, open_answer: bool = True) -> Column:
    """All messages as turns, one a line; with ``open_answer`` the assistant's turn is left open at the end."""
    closed = F.array_join(F.transform(messages, lambda m: turn(m["role"], m["content"])), "\n")
    return F.concat(closed, F.lit("\n" + OPEN_TURN)) if open_answer else closed


def training_text(instruction_text: Column, text: Column, output: Column) -> Column:
    """The closed conversation a model is tuned on."""
    return F.concat(turn("user", content(instruction_text, text)), F.lit("\n"), turn("assistant", output))


def teacher(student: Column, output: Column) -> Column:
    """The student's prompt with a right answer shown."""
    return fill(TEACHER, query=student, output=output)


def few_shot(demos: Column, query: Column) -> Column:
    """Messages of demonstrations (instruction, input, output), each a user and an assistant turn, then the query."""
    kind = "array<struct<role:string,content:string>>"
    shown = F.flatten(F.transform(demos, lambda d: F.array(
        message("user", content(d["instruction"], d["input"])), message("assistant", d["output"]))))
    return F.concat(F.coalesce(shown, F.array().cast(kind)), F.array(message("user", query)))


def budget(shots: int) -> int:
    """Tokens allowed for a prompt with so many demonstrations."""
    return 1024 * (1 + shots) + 160 if shots else 1536


def keep_end(text: Column, most: int) -> Column:
    """The last ``most`` white-space tokens, so that the query at the end survives."""
    tokens = F.filter(F.split(text, rf"(?U){WS}+"), lambda t: t != "")
    n = F.least(F.size(tokens), F.lit(most))
    return F.when(F.size(tokens) > most, F.array_join(F.slice(tokens, F.size(tokens) - n + 1, n), " ")).otherwise(text)


def keep_last_tokens(df: DataFrame, text: str, most: int, encoder: Callable[[], Encoder]) -> DataFrame:
    """``df`` with ``text`` cut to its last ``most`` tokens of a tokenizer; null stays null.

    ``encoder`` is called once in every worker and returns an object with ``encode`` and ``decode``, so any tokenizer
    can be passed in. A cut inside a character leaves a replacement character.
    """
    schema = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder()

        def cut(t: str | None) -> str | None:
            ids = codec.encode(t) if t else []
            return codec.decode(ids[-most:]) if len(ids) > most else t

        for batch in batches:
            at = batch.schema.get_field_index(text)
            yield batch.set_column(at, batch.schema.field(at), pa.array([cut(t) for t in batch.column(at).to_pylist()], pa.string()))

    return df.mapInArrow(run, schema)
