"""Chat formatting by token-level assembly.

Roles and texts are encoded apart from each other with a byte-level BPE, and
reserved ids, which no text can give, are spliced between them:

    START role SEP text END

The loss mask covers the tokens of assistant texts; it is the prefix sum of +1
at each such segment's first token and -1 after its last.  Control strings
inside roles and texts are escaped: a backslash goes after their first
character and before every backslash, so no control string is left and taking
the backslashes away gives the content back.

Turns of a conversation are ordered by (turn, role, text), nulls first; a
conversation's turns are streamed in that order, so that one of any length
needs the memory of one batch.

Edge cases: null roles and texts are empty; rows with a null conv_id form one
conversation; repeated rows are turns of their own; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dagloom.llm.common import load, stored

#: Strings that must not occur in formatted content.
CONTROL = ("<|im_start|>", "<|im_sep|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)) + r"|\\")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
#: Names of the reserved ids, which follow the vocabulary.
RESERVED = ("<|im_start|>", "<|im_sep|>", "<|im_end|>")


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class Assembler:
    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.start, self.sep, self.end = (self.library.get_vocab_size() + k for k in range(3))

    def assemble(self, roles: list[str], texts: list[str], learn: list[bool]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, mask, first): the turns' tokens one after another, the loss
        mask, and where each turn begins (one entry more than turns)."""
        parts = [escape(x) for pair in zip(roles, texts) for x in pair]
        coded = [x.ids for x in self.library.encode_batch(parts, add_special_tokens=False)]
        n = len(roles)
        size = np.ones((n, 5), np.int64)
        size[:, 1] = [len(x) for x in coded[::2]]
        size[:, 3] = [len(x) for x in coded[1::2]]
        at = np.concatenate([[0], np.cumsum(size)])
        ids = np.empty(at[-1], np.int32)
        grid = at[:-1].reshape(n, 5)
        ids[grid[:, 0]], ids[grid[:, 2]], ids[grid[:, 4]] = self.start, self.sep, self.end
        inside = np.ones(len(ids), bool)
        inside[grid[:, [0, 2, 4]].ravel()] = False
        ids[inside] = np.fromiter((t for x in coded for t in x), np.int32)
        step = np.zeros(len(ids) + 1, np.int32)
        chosen = np.array(learn, bool)
        np.add.at(step, grid[chosen, 3], 1)
        np.add.at(step, grid[chosen, 4], -1)
        return ids, np.cumsum(step[:-1]).astype(np.uint8), np.append(grid[:, 0], at[-1])

    def read(self, ids: np.ndarray, mask: np.ndarray) -> tuple[str, str, str, int]:
        """(role, text, text under the mask, characters as formatted) of a turn."""
        marks = np.flatnonzero(ids >= self.start)
        if len(marks) != 3 or ids[marks].tolist() != [self.start, self.sep, self.end]:
            raise ValueError("a turn is not framed by the reserved ids")
        text = lambda x: self.library.decode(x.tolist(), skip_special_tokens=False)
        role, body = text(ids[1 : marks[1]]), text(ids[marks[1] + 1 : marks[2]])
        loss = text(ids[mask.astype(bool)])
        return unescape(role), unescape(body), unescape(loss), len(role) + len(body) + sum(map(len, RESERVED))


@cache
def assembler(name: str) -> Assembler:
    return Assembler(public_tokenizers.path(name))


def format_turns(turns: DataFrame, name: str = "byte_bpe_50k.json", learn: str = "assistant") -> DataFrame:
    """(conv_id, turn, ids, mask): ids as little-endian int32, mask a byte each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = assembler(name)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                roles, texts = ([x or "" for x in part.column(k).to_pylist()] for k in (2, 3))
                ids, mask, first = make.assemble(roles, texts, [x == learn for x in roles])
                edges = list(zip(first[:-1].tolist(), first[1:].tolist()))
                yield pa.record_batch(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array([ids[x:y].astype("<i4").tobytes() for x, y in edges], pa.binary()),
                        pa.array([mask[x:y].tobytes() for x, y in edges], pa.binary()),
                    ],
                    ["conv_id", "turn", "ids", "mask"],
                )

    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "conv_id long, turn long, ids binary, mask binary")


def read_turns(formatted: DataFrame, name: str = "byte_bpe_50k.json") -> DataFrame:
    """(conv_id, turn, role, text, loss, chars) as decoded from the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = assembler(name)
        for b in batches:
            got = [
                make.read(np.frombuffer(i, "<i4"), np.frombuffer(m, np.uint8))
                for i, m in zip(b.column(2).to_pylist(), b.column(3).to_pylist())
            ]
            columns = list(zip(*got)) or [()] * 4
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
            yield pa.record_batch(
                [b.column(0), b.column(1), *(pa.array(x, k) for x, k in zip(columns, kinds))],
                ["conv_id", "turn", "role", "text", "loss", "chars"],
            )

    return formatted.select("conv_id", "turn", "ids", "mask").mapInArrow(
        run, "conv_id long, turn long, role string, text string, loss string, chars long"
    )


def conversation_digests(read: DataFrame) -> DataFrame:
    """One row for each conversation, from its turns in order."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, done = None, None, []

        def finish() -> None:
            if state is not None:
                n, turns, chars, loss, formatted = state
                done.append((key, n, turns.hexdigest(), chars, loss.hexdigest(), formatted))

        def out() -> pa.RecordBatch:
            columns = list(zip(*done)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.record_batch([pa.array(x, k) for x, k in zip(columns, kinds)], names)

        for b in batches:
            for conv, role, text, loss, chars in zip(*(b.column(k).to_pylist() for k in range(5))):
                if state is None or conv != key:
                    finish()
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += chars
            if done:
                yield out()
                done.clear()
        finish()
        yield out()

    ordered = read.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text", "loss", "chars").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string"
    )
    return conversation_digests(read_turns(stored(format_turns(rows.unionByName(extra)), "op9-chat")))
