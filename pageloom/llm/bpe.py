"""Byte-level BPE with tiktoken and a local rank file: encoding, decoding and token attribution."""

from __future__ import annotations

import base64
import re
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

RANKS = "byte_bpe_50k.tiktoken"
#: Texts longer than this are cut where no match of the pre-split pattern can span.
LONG = 1 << 16
#: Bytes of ids and texts that a worker holds before it hands a batch on.
HELD = 1 << 24
#: A lone space between two other characters: every alternative of the pattern ends before it or begins with it.
_SAFE = re.compile(r"(?<=\S) (?=\S)")
RULES = ("first", "most", "share")


@cache
def encoding(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def safe_parts(text: str, long: int = LONG) -> list[str]:
    """Pieces of about ``long`` characters that encode apart as they do together."""
    out, at = [], 0
    while len(text) - at > long and (m := _SAFE.search(text, at + long)):
        out.append(text[at : m.start()])
        at = m.start()
    out.append(text[at:])
    return out


def encode(enc: tiktoken.Encoding, text: str, long: int = LONG) -> np.ndarray:
    parts = [enc.encode_to_numpy(p, disallowed_special=()) for p in safe_parts(text, long)]
    return (parts[0] if len(parts) == 1 else np.concatenate(parts)).astype(np.int32)


def _ranks(df: DataFrame, ranks: str | None):
    ship(df.sparkSession)
    with open(ranks or public_tokenizers.path(RANKS), "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())  # a fixed vocabulary file


def encode_decode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``(id_col, ids, decoded)``: the token ids of each whole text and the raw bytes they stand for.

    No special tokens. A null text counts as empty and gives no ids; repeated
    rows are encoded each; other columns are not read; an empty table gives an
    empty result. Decoding joins the bytes of the ids, which need not be whole
    characters one by one.
    """
    shared = _ranks(df, ranks)
    narrow = df.select(F.col(id_col), F.col(text_col).alias("__text"))

    def run(batches):
        enc = encoding(shared.value, pattern)
        for batch in batches:
            at, held, ids, texts = 0, 0, [], []

            def out(upto, at, ids, texts, batch=batch):
                ends = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                return pa.RecordBatch.from_arrays([batch.column(0).slice(at, upto - at), lists, pa.array(texts, pa.binary())], names=[id_col, "ids", "decoded"])

            for i, text in enumerate(batch.column(1)):
                ids.append(encode(enc, text.as_py() or ""))
                texts.append(enc.decode_bytes(ids[-1].tolist()))
                held += ids[-1].nbytes + len(texts[-1])
                if held > HELD:
                    yield out(i + 1, at, ids, texts)
                    at, held, ids, texts = i + 1, 0, [], []
            if ids:
                yield out(batch.num_rows, at, ids, texts)

    kind = narrow.schema[id_col].dataType.simpleString()
    return narrow.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded binary")


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str) -> np.ndarray:
    """Tokens with byte spans [start, end) allotted to sections [bounds[i], bounds[i + 1]).

    ``first``: to the section of the token's first byte. ``most``: to the section
    with most of its bytes, the earlier of equals. ``share``: to each section by
    its share of the bytes. Empty sections get nothing.
    """
    n = len(bounds) - 1
    first = np.searchsorted(bounds, starts, side="right") - 1
    if rule == "first":
        return np.bincount(first, minlength=n).astype(float)
    last = np.searchsorted(bounds, ends - 1, side="right") - 1
    out = np.bincount(first[first == last], minlength=n).astype(float)
    for t in np.nonzero(first != last)[0]:
        parts = np.arange(first[t], last[t] + 1)
        held = np.minimum(bounds[parts + 1], ends[t]) - np.maximum(bounds[parts], starts[t])
        if rule == "most":
            out[parts[np.argmax(held)]] += 1
        else:
            out[parts] += held / (ends[t] - starts[t])
    return out


def token_counts(df: DataFrame, id_col: str = "doc_id", fields: tuple[str, ...] = ("text",), rule: str = "first", ranks: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Tokens of every section of every document.

    The fields of a row, joined by line feeds, are its document, which is encoded
    once and whole. A section is a line of it with its line feed. Returns
    ``(id_col, section, field, start, end, n_tokens, n_crossing, doc_tokens)``:
    sections from 0, character offsets (end exclusive), tokens allotted by
    ``rule`` (see ``attribute``), tokens that also lie in another section, and
    the document's tokens, which the sections' add up to. A null field counts as
    empty; an empty document is one empty section; repeated rows are counted
    each; other columns are not read; an empty table gives an empty result.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    shared = _ranks(df, ranks)
    narrow = df.select(F.col(id_col), *(F.col(c).alias(f"__f{i}") for i, c in enumerate(fields)))
    names = [id_col, "section", "field", "start", "end", "n_tokens", "n_crossing", "doc_tokens"]

    def one(enc, width, values):
        texts = [v or "" for v in values]
        text = "\n".join(texts)
        ids = encode(enc, text)
        lines = text.split("\n")
        chars = np.concatenate([[0], np.cumsum([len(x) + 1 for x in lines])])
        bounds = np.concatenate([[0], np.cumsum([len(x.encode()) + 1 for x in lines])])
        chars[-1] -= 1
        bounds[-1] -= 1
        ends = np.cumsum(width[ids]) if len(ids) else np.zeros(0, np.int64)
        starts = ends - width[ids] if len(ids) else ends
        counts = attribute(starts, ends, bounds, rule)
        crossing = np.zeros(len(lines) + 1, np.int64)
        a, b = np.searchsorted(bounds, starts, side="right") - 1, np.searchsorted(bounds, ends - 1, side="right") - 1
        over = a != b
        np.add.at(crossing, a[over], 1)
        np.add.at(crossing, b[over] + 1, -1)
        field = np.repeat(np.arange(len(texts)), [t.count("\n") + 1 for t in texts])
        return np.arange(len(lines)), field, chars[:-1], chars[1:], counts, np.cumsum(crossing)[:-1], np.full(len(lines), len(ids))

    def run(batches):
        enc = encoding(shared.value, pattern)
        width = np.array([len(enc.decode_single_token_bytes(i)) for i in range(enc.n_vocab)], np.int64)
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]

        def out(batch, who, rows):
            columns = [np.concatenate(c) for c in zip(*rows, strict=True)]
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(who))), *(pa.array(c.astype(k.to_pandas_dtype()), k) for c, k in zip(columns, kinds, strict=True))], names=names)

        for batch in batches:
            who, rows, held = [], [], 0
            for i in range(batch.num_rows):
                rows.append(one(enc, width, [c[i].as_py() for c in batch.columns[1:]]))
                who.append(np.full(len(rows[-1][0]), i))
                held += len(who[-1])
                if held > 1 << 18:
                    yield out(batch, who, rows)
                    who, rows, held = [], [], 0
            if rows:
                yield out(batch, who, rows)

    kind = narrow.schema[id_col].dataType.simpleString()
    return narrow.mapInArrow(run, f"`{id_col}` {kind}, section int, field int, start bigint, end bigint, n_tokens double, n_crossing bigint, doc_tokens bigint")
