"""Vector bin packing of tokenized examples into training sequences.

Each task tokenizes its rows as a stream and keeps a bounded buffer of pieces. A sequence takes the
piece whose demand has the largest dot product with what is left of three limits at once: tokens,
segments and loss-bearing tokens. When no whole piece fits, one is cut to fill the rest. A sequence
that ends short is cut back to a power of two and the remainder returns to the buffer, so nothing is
padded. Rows never leave their task, so no shuffle, no unbounded group and no driver state exists;
a lost task packs the same split again with the same sequence ids.

Null and empty texts are one closing token. Repeated rows are examples of their own. Very long texts
are cut into full sequences. Extra columns are ignored, an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from panelspark.llm import common  # noqa: F401

PIECE_SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "loss_tokens long, sequence_tokens long, sequence_segments long"
)
VOCABULARY = "byte_bpe_50k"


@dataclass(frozen=True)
class Limits:
    """What a sequence may hold. ``buffer`` bounds the open pieces of a task."""

    tokens: int = 2048
    segments: int = 64
    loss_tokens: int = 2048
    buffer: int = 192


#: Beyond this many characters without a space the rank encoder would merge one huge piece; see ``encoder``.
LONG_RUN = 512


def tokenizer_files(folder: str | None = None) -> tuple[str, str]:
    """Vocabulary files as tokenizer JSON and as merge ranks (default: the installed public ones)."""
    import public_tokenizers

    of = (lambda n: f"{folder.rstrip('/')}/{n}") if folder else public_tokenizers.path
    return of(f"{VOCABULARY}.json"), of(f"{VOCABULARY}.tiktoken")


def encoder(json_path: str, ranks_path: str) -> Callable[[str], list[int]]:
    """Ids as the tokenizer file gives them, without added special tokens.

    The rank encoder has the same vocabulary and gives the same ids several times faster; texts with
    a special token's string or a very long run without spaces go to the tokenizer itself.
    """
    import base64
    import re

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    exact: list[Tokenizer] = []
    odd = re.compile(rf"<\|endoftext\|>|\S{{{LONG_RUN}}}|\s{{{LONG_RUN}}}")

    def encode(text: str) -> list[int]:
        if odd.search(text):
            if not exact:
                exact.append(Tokenizer.from_file(json_path))
            return exact[0].encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


@dataclass
class Piece:
    doc_id: int | None
    ids: np.ndarray
    start: int
    doc_tokens: int
    prompt: int

    def __len__(self) -> int:
        return len(self.ids)

    def loss(self, n: int | None = None) -> int:
        """Loss-bearing ids among the first n (default: all): those behind the document's prompt."""
        n = len(self.ids) if n is None else n
        return max(0, self.start + n - max(self.start, self.prompt))

    def split(self, n: int) -> tuple[Piece, Piece]:
        head = Piece(self.doc_id, self.ids[:n], self.start, self.doc_tokens, self.prompt)
        return head, Piece(self.doc_id, self.ids[n:], self.start + n, self.doc_tokens, self.prompt)

    def most(self, tokens: int, loss: int) -> int:
        """Ids of the longest head within so many tokens and so many loss-bearing tokens."""
        free = max(0, min(self.prompt - self.start, len(self.ids)))
        return min(len(self.ids), tokens, free + loss)


class Packer:
    """Packs a stream of pieces; ``emit`` gets each closed sequence as a list of pieces."""

    def __init__(self, limits: Limits, emit: Callable[[list[Piece]], None]):
        self.limits, self.emit, self.open = limits, emit, []

    def add(self, piece: Piece) -> None:
        t = self.limits.tokens
        if self.limits.loss_tokens >= t:
            while len(piece) >= t:
                head, piece = piece.split(t)
                self.emit([head])
        if len(piece):
            self.open.append(piece)
        while len(self.open) >= self.limits.buffer:
            self.fill()

    def finish(self) -> None:
        while self.open:
            self.fill()

    def fill(self) -> None:
        lim, pieces = self.limits, self.open
        size = np.array([(len(p), p.loss()) for p in pieces], np.float64)
        free, chosen, tokens, loss = np.ones(len(pieces), bool), [], lim.tokens, lim.loss_tokens
        while tokens and len(chosen) < lim.segments:
            fits = free & (size[:, 0] <= tokens) & (size[:, 1] <= loss)
            if not fits.any():
                break
            left = np.array([tokens / lim.tokens, loss / lim.loss_tokens])
            segment = (lim.segments - len(chosen)) / lim.segments / lim.segments
            value = size @ (left / (lim.tokens, lim.loss_tokens)) + segment
            i = int(np.argmax(np.where(fits, value, -1.0)))
            free[i] = False
            chosen.append(pieces[i])
            tokens, loss = tokens - len(pieces[i]), loss - pieces[i].loss()
        rest = [p for p, f in zip(pieces, free) if f]
        if tokens and len(chosen) < lim.segments and rest:
            i = max(range(len(rest)), key=lambda j: (rest[j].most(tokens, loss), len(rest[j])))
            n = rest[i].most(tokens, loss)
            if n:
                head, tail = rest[i].split(n)
                chosen.append(head)
                rest[i] = tail
                if not len(tail):
                    rest.pop(i)
        self.open = rest
        self.close(chosen)

    def close(self, chosen: list[Piece]) -> None:
        total = sum(map(len, chosen))
        if total < self.limits.tokens:
            over = total - (1 << total.bit_length() - 1)
            while over:
                last = chosen.pop()
                if len(last) <= over:
                    self.open.append(last)
                    over -= len(last)
                else:
                    head, tail = last.split(len(last) - over)
                    chosen.append(head)
                    self.open.append(tail)
                    over = 0
        self.emit(chosen)


def pack(
    docs: DataFrame, limits: Limits | None = None, *, id_col: str = "doc_id", text_col: str = "text", prompt_col: str | None = None,
    closing_id: int = 1, tokenizers_folder: str | None = None,
) -> DataFrame:
    """One row per piece. ``prompt_col`` names text that precedes each text without bearing loss."""
    limits = limits or Limits()
    if min(limits.tokens, limits.segments, limits.loss_tokens, limits.buffer) < 1:
        raise ValueError("every limit must be at least 1")
    files = tokenizer_files(tokenizers_folder)
    some = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), *([docs[prompt_col].cast("string").alias("prompt")] if prompt_col else []))
    names = [f.split()[0] for f in PIECE_SCHEMA.split(", ")]
    schema = pa.schema([(n, pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*files)
        rows: list[tuple] = []
        sequence = TaskContext.get().partitionId() << 36

        def emit(pieces: list[Piece]) -> None:
            nonlocal sequence
            offset, total = 0, sum(map(len, pieces))
            for p in pieces:
                rows.append((p.doc_id, p.start, len(p), zlib.crc32(p.ids), p.doc_tokens, sequence, offset, p.loss(), total, len(pieces)))
                offset += len(p)
            sequence += 1

        def out() -> pa.RecordBatch:
            batch = pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * len(names), schema=schema)
            rows.clear()
            return batch

        packer = Packer(limits, emit)
        for batch in batches:
            for part in common.text_slices(batch, "text"):
                texts = part.column("text").to_pylist()
                prompts = part.column("prompt").to_pylist() if prompt_col else [None] * len(texts)
                for doc_id, text, prompt in zip(part.column("doc_id").to_pylist(), texts, prompts):
                    before = encode(prompt) if prompt else []
                    ids = np.array([*before, *encode(text or ""), closing_id] if before else [*encode(text or ""), closing_id], "<u4")
                    packer.add(Piece(doc_id, ids, 0, len(ids), len(before)))
                yield out()
        packer.finish()
        yield out()

    return some.mapInArrow(run, PIECE_SCHEMA)
