"""Chat conversations as token ids with a loss mask.

Each turn is [OPEN] role [SEP] text [CLOSE]. Roles and texts are encoded alone and the three marks are
reserved ids past the vocabulary, so no content can make a mark. In the text form the marks read
"### ", ": " and "</turn>", and a backslash in front of the same strings in content keeps it readable back.

Turns are encoded where they are read. Then rows are dealt by conversation, sorted, and assembled as a
stream, so that a conversation of any length takes no more memory than one part of it.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import TEXT_ROWS, shuffle_partitions

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
OPEN, SEP, CLOSE = "### ", ": ", "</turn>"
#: Roles whose text is trained on.
LOSS_ROLES = ("assistant",)
#: Tokens after which a part of a conversation is written out at the end of a turn.
PART_TOKENS = 1 << 16
#: Tokens that a task holds as arrays at a time, one part or turn at least.
OUT_TOKENS = 1 << 18
#: Bytes of a tokenizer's file that may be broadcast.
TOKENIZER_BYTES = 64 << 20

_ESCAPED = re.compile(r"\\|###|</turn>")
_ESCAPED_ROLE = re.compile(r"\\|###|</turn>|:")
_UNESCAPED = re.compile(r"\\(\\|###|</turn>|:)")


def escape(text: str, role: bool = False) -> str:
    return (_ESCAPED_ROLE if role else _ESCAPED).sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPED.sub(lambda m: m[1], text)


def read_tokenizer(spark: SparkSession, path: str = TOKENIZER):
    """Broadcast a tokenizer's file, which any file system of Spark's may hold."""
    rows = spark.read.text(path if "://" in path else f"file://{path}", wholetext=True).limit(2).collect()
    if len(rows) != 1 or len(rows[0].value.encode()) > TOKENIZER_BYTES:
        raise ValueError("a tokenizer is one file of bounded size")
    return spark.sparkContext.broadcast(rows[0].value)


class Codec:
    """A tokenizer with the three marks as ids past its vocabulary."""

    def __init__(self, source: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(source)
        self.model.encode_special_tokens = True  # special strings in a text are text
        self.open, self.sep, self.close = (self.model.get_vocab_size(with_added_tokens=True) + i for i in range(3))

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.model.decode_batch(ids, skip_special_tokens=False)


def loss_mask(lengths, on) -> np.ndarray:
    """1 for the tokens of the segments that are on: a prefix sum over the segments' edges."""
    lengths, on = np.asarray(lengths, np.int64), np.asarray(on, np.int64)
    ends = np.cumsum(lengths)
    edge = np.zeros(int(ends[-1]) + 1 if ends.size else 1, np.int64)
    np.add.at(edge, ends - lengths, on)
    np.add.at(edge, ends, -on)
    return np.cumsum(edge[:-1]).astype(np.int8)


def _columns(ids: np.ndarray, mask: np.ndarray, lengths: list[int]) -> list[pa.Array]:
    """Rows of ids and of mask bytes, from all of them in turn and the number of each row."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    binary = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(mask, np.int8))])
    return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.asarray(ids, np.int32))), binary]


def _slices(batches: Iterator[pa.RecordBatch], tokens: int) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """Batches (conv_id, ids, mask) as (conv_ids, offsets, ids, mask), of about so many tokens and one row at least."""
    for batch in batches:
        conv, lists, masks = (batch.column(batch.schema.get_field_index(n)) for n in ("conv_id", "ids", "mask"))
        ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            n = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + tokens, "right")) - at)
            ids = lists.slice(at, n).flatten().to_numpy(zero_copy_only=False)
            offsets = np.concatenate([[0], ends[at : at + n] - (ends[at - 1] if at else 0)])
            mask = np.frombuffer(b"".join(masks.slice(at, n).to_pylist()), np.int8)
            yield conv.slice(at, n).to_pylist(), offsets, ids, mask
            at += n


def _encode(shared, loss_roles: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for batch in (b.slice(at, TEXT_ROWS) for b in batches for at in range(0, b.num_rows, TEXT_ROWS)):
            roles, texts = ([x or "" for x in batch.column(i).to_pylist()] for i in (2, 3))
            names = sorted(set(roles))
            known = dict(zip(names, codec.encode([escape(r, True) for r in names]), strict=True))
            flat, lengths = [], np.ones((len(roles), 5), np.int64)  # open, role, separator, text, close
            for i, (role, text_ids) in enumerate(zip(roles, codec.encode([escape(t) for t in texts]), strict=True)):
                flat.append(codec.open)
                flat += known[role]
                flat.append(codec.sep)
                flat += text_ids
                flat.append(codec.close)
                lengths[i, 1], lengths[i, 3] = len(known[role]), len(text_ids)
            on = np.zeros(lengths.shape, np.int64)
            on[:, 3] = [r in loss_roles for r in roles]
            tie = [hashlib.md5(t.encode("utf-8", "replace")).digest() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(roles, pa.string()), pa.array(tie, pa.binary()), *_columns(np.array(flat, np.int32), loss_mask(lengths.ravel(), on.ravel()), lengths.sum(axis=1).tolist())],
                names=["conv_id", "turn", "role", "tie", "ids", "mask"],
            )

    return run


def _assemble(part_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part, size = None, 0, 0
        keys, lengths, ids, masks = [], [], [], []  # finished parts, then the pieces of the one that is open behind theirs

        def out():
            # the parts that are finished; the pieces of the open one stay
            done = sum(lengths)
            flat, mask = np.concatenate(ids), np.concatenate(masks)
            batch = pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.int64()), pa.array([p for _, p in keys], pa.int64()), *_columns(flat[:done], mask[:done], lengths)], names=["conv_id", "part", "ids", "mask"])
            ids[:], masks[:], keys[:], lengths[:] = [flat[done:].copy()], [mask[done:].copy()], [], []
            return batch

        for conv, offsets, own, mask in _slices(batches, OUT_TOKENS):
            at = 0  # tokens of this slice before it are among the pieces
            for i, c in enumerate(conv):
                if size and (c != now or size >= part_tokens):
                    ids.append(own[at : offsets[i]])
                    masks.append(mask[at : offsets[i]])
                    at = offsets[i]
                    keys.append((now, part))
                    lengths.append(size)
                    part, size = part + 1, 0
                if c != now:
                    now, part = c, 0
                size += int(offsets[i + 1] - offsets[i])
            ids.append(own[at:])
            masks.append(mask[at:])
            if keys:
                yield out()
        if size:
            keys.append((now, part))
            lengths.append(size)
            yield out()

    return run


def format_chats(turns: DataFrame, tokenizer, loss_roles: tuple[str, ...] = LOSS_ROLES, part_tokens: int = PART_TOKENS) -> DataFrame:
    """Rows (conv_id, part, ids, mask): the conversations' tokens in parts that end with a turn.

    turns: conv_id, turn (integers), role, text; other columns are not read. tokenizer: see read_tokenizer.
    mask has a byte for each id, 1 where the text of a loss role is. Turns go by `turn`, nulls first, and equal
    ones by role and then by a digest of the text; repeated rows are turns of their own. A null text or role is
    empty. Rows without a conv_id are one conversation. An empty table gives an empty table.
    """
    slim = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    encoded = slim.mapInArrow(_encode(tokenizer, loss_roles), "conv_id long, turn long, role string, tie binary, ids array<int>, mask binary")
    dealt = encoded.repartition(shuffle_partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "tie")
    return dealt.select("conv_id", "ids", "mask").mapInArrow(_assemble(part_tokens), "conv_id long, part long, ids array<int>, mask binary")


def _read_back(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        now, state, done = None, None, []

        def out():
            conv, states = zip(*done, strict=True)
            n, turns, loss_chars, loss, chars = zip(*states, strict=True)
            values = [pa.array(conv, pa.int64()), pa.array(n, pa.int64()), pa.array([h.hexdigest() for h in turns]), pa.array(loss_chars, pa.int64()), pa.array([h.hexdigest() for h in loss]), pa.array(chars, pa.int64())]
            done.clear()
            return pa.RecordBatch.from_arrays(values, names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for conv, offsets, ids, mask in _slices(batches, OUT_TOKENS):
            flat = ids.tolist()
            opens, seps, closes = (np.flatnonzero(ids == x).tolist() for x in (codec.open, codec.sep, codec.close))
            roles = [flat[a + 1 : b] for a, b in zip(opens, seps, strict=True)]
            names = sorted({tuple(r) for r in roles})
            known = dict(zip(names, codec.decode([list(r) for r in names]), strict=True))
            spans = [(a + 1, b) for a, b in zip(seps, closes, strict=True)]
            texts = codec.decode([flat[a:b] for a, b in spans])
            at = dict(zip(spans, texts, strict=True))
            # runs of the mask; marks part the texts of two turns. A run that is a whole text has been decoded already
            edges = np.flatnonzero(np.diff(mask, prepend=0, append=0)).reshape(-1, 2)
            runs = list(map(tuple, edges.tolist()))
            other = [r for r in runs if r not in at]
            at.update(zip(other, codec.decode([flat[a:b] for a, b in other]), strict=True))
            turn_of, run_of = (np.searchsorted(x, offsets).tolist() for x in (np.array(opens), edges[:, 0]))
            for i, c in enumerate(conv):
                if state and c != now:
                    done.append((now, state))
                    state = None
                if not state:
                    now, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for j in range(turn_of[i], turn_of[i + 1]):
                    role, text = known[tuple(roles[j])], texts[j]
                    state[0] += 1
                    state[1].update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                    state[4] += len(OPEN) + len(role) + len(SEP) + len(text) + len(CLOSE)
                for r in runs[run_of[i] : run_of[i + 1]]:
                    text = unescape(at[r])
                    state[2] += len(text)
                    state[3].update(text.encode())
            if done:
                yield out()
        if state:
            done.append((now, state))
            yield out()

    return run


def read_back(formatted: DataFrame, tokenizer) -> DataFrame:
    """A row for each conversation, decoded from format_chats' output: counts and digests of turns and of the text under the mask."""
    dealt = formatted.repartition(shuffle_partitions(formatted.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part")
    return dealt.mapInArrow(_read_back(tokenizer), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: The contract of op8 in DuckDB.
CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e AS (
  SELECT *, length(replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>')) AS text_chars,
         length(replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\:')) AS role_chars FROM t)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(4 + role_chars + 2 + text_chars + 7) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
