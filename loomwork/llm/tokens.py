"""Token counts of fields and sections by offset mapping.

A record is rendered once (its fields, each ended by a newline, then its text) and encoded as a whole, so that the counts of
its sections add up to the tokens a model would see. The sections are the fields and the lines of the text; a newline
belongs to the section that it ends. Each token has a span of characters (a token of part of a character's bytes has that
character's). The spans are joined to the sections' spans: both are sorted, so a binary search for a token's first and last
character gives the sections it touches.

Rule for tokens that touch several sections: RULE "most" gives the token to the section that holds most of its characters,
the earlier of equals; "first" and "last" give it to the section of its first or last character.

Defined cases: a null field counts as empty and keeps its newline; null text counts as empty; an empty text is one line
without characters, while a text that ends with a newline has no line after it; repeated rows are counted each by itself;
rows that share a doc_id are told apart by record, the hash of the rendered record, unless they are equal; a table without rows gives none; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from xxhash import xxh64_intdigest

from loomwork.llm.bpe import ForcedBoundaryBPE
from loomwork.llm.common import only, slices, unknown

FIELDS = ("source", "lang")
RULE = "most"


def characters(data: np.ndarray) -> np.ndarray:
    """For each byte the number of its character."""
    return np.cumsum((data & 0xC0) != 0x80) - 1


def token_spans(lengths: np.ndarray, char: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last character of each token, from the tokens' lengths in bytes."""
    ends = np.cumsum(lengths)
    return char[ends - lengths], char[ends - 1]


def sections(fields: Sequence[bytes], text: bytes) -> tuple[bytes, list[int]]:
    """The rendered record and the byte at which each section begins."""
    head = b"".join(f + b"\n" for f in fields)
    starts = [0]
    for f in fields:
        starts.append(starts[-1] + len(f) + 1)
    lines = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    starts += [len(head) + x for x in lines.tolist() if x < len(text)]
    return head + text, starts


def allocate(first: np.ndarray, last: np.ndarray, bounds: np.ndarray, rule: str = RULE) -> tuple[np.ndarray, np.ndarray]:
    """The section of each token, and whether it touches several. bounds: first character of each section, ascending."""
    a = np.searchsorted(bounds, first, side="right") - 1
    b = np.searchsorted(bounds, last, side="right") - 1
    crosses = a != b
    if rule == "last":
        return b, crosses
    out = a.copy()
    if rule == "most":
        stops = np.append(bounds[1:], np.iinfo(np.int64).max)
        for t in np.flatnonzero(crosses):
            over = [min(last[t] + 1, stops[s]) - max(first[t], bounds[s]) for s in range(a[t], b[t] + 1)]
            out[t] = a[t] + int(np.argmax(over))
    elif rule != "first":
        raise ValueError(f"unknown rule: {rule}")
    return out, crosses


def count(df: DataFrame, path: str, fields: Sequence[str] = FIELDS, rule: str = RULE) -> DataFrame:
    """doc_id, record (XXH64 of the rendered record), section, kind (a field's name or line), start, end (characters of the
    rendered record), n_tokens, n_crossing."""
    unknown(df, ["doc_id", "text", *fields])
    names = list(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ForcedBoundaryBPE(path)
        size = np.array([len(x) for x in bpe.bytes_of], np.int64)
        for whole in batches:
            for b in slices(whole, "text", 1_000_000):
                values = [[(x or b"") for x in b.column(c).cast(pa.string()).cast(pa.binary()).to_pylist()] for c in [*names, "text"]]
                rows, out, records = [], [[], [], [], [], []], []
                for i, record in enumerate(zip(*values, strict=True)):
                    data, starts = sections(record[:-1], record[-1])
                    records.append(xxh64_intdigest(data) - (1 << 63))
                    raw = np.frombuffer(data, np.uint8)
                    char = np.append(characters(raw), len(data) and int(((raw & 0xC0) != 0x80).sum()))
                    bounds = char[starts]
                    ids = np.array(bpe.encode(data), np.int64)
                    first, last = token_spans(size[ids], char)
                    section, crosses = allocate(first, last, bounds, rule)
                    n = len(starts)
                    rows.append(np.full(n, i))
                    for c, x in zip(out, (np.arange(n), bounds, np.append(bounds[1:], char[-1]), np.bincount(section, minlength=n), np.bincount(section, crosses, minlength=n).astype(np.int64)), strict=True):
                        c.append(x)
                cols = [np.concatenate(c).astype(np.int64) for c in out]
                kinds = pa.array([*names, "line"]).take(pa.array(np.minimum(cols[0], len(names))))
                of = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(of), pa.array(records, pa.int64()).take(of), pa.array(cols[0]), kinds, *(pa.array(c) for c in cols[1:])], ["doc_id", "record", "section", "kind", "start", "end", "n_tokens", "n_crossing"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return only(df, *dict.fromkeys(["doc_id", *fields, "text"])).mapInArrow(run, f"doc_id {kind}, record bigint, section bigint, kind string, start bigint, end bigint, n_tokens bigint, n_crossing bigint")
