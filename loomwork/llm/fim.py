"""Fill-in-the-middle rows: a text cut at two of its token boundaries and written in another order between three marks.

A token is white space with the other characters that follow it, or white space at the end. Boundaries are found without
a loop over characters. bytes.translate() turns the UTF-8 bytes into a string of zeros and ones, read as one big integer
with a bit for each byte (bytes of longer characters are no white space, so bytes do for characters). With N the bits of
other characters, a token ends at the bits of N & ~(N >> 1), and at the last byte. int.bit_count() gives their number n,
and the place of the k-th is found by halving: the lower half's count says which half has it. Each halving looks at half
of the bits before, so one place costs twice the length of the text at most, in machine words of bits.

The cuts, whether a text is rewritten, and the order come from SHA-256 of seed and doc_id, so a task can be redone.

Defined cases: null text counts as empty; an empty text, and one that has a mark in it, stays as it is (form "plain"); a
null doc_id hashes as the empty string; rows of one doc_id get the same numbers, each for its own text; a text of white
space is one token; a table without rows gives none; transform() carries other columns through, but for those with the names
of its own, and restore() does so too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import SPACE, only, slices, unknown, without_columns

SEED = 42
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Texts in a hundred that are rewritten, and rewritten ones in a hundred whose suffix comes first.
RATE, SPM_RATE = 50, 80
#: "1" for a byte of white space, "0" for others, and the other way around.
SPACES = bytes(ord("1") if chr(i) in SPACE else ord("0") for i in range(256))
OTHERS = bytes(ord("0") if chr(i) in SPACE else ord("1") for i in range(256))
#: Below so many bits they are looked at one by one.
FEW = 64


def class_bits(data: bytes, table: bytes) -> int:
    """Bit i is set if byte i is of the table's class."""
    return int(data[::-1].translate(table), 2) if data else 0


def token_ends(data: bytes) -> int:
    """Bit i is set if a token ends with byte i."""
    other = class_bits(data, OTHERS)
    ends = other & ~(other >> 1)
    return ends | 1 << len(data) - 1 if data else 0


def select(bits: int, k: int, width: int) -> int:
    """The place of the k-th set bit (from 1 on) of an integer of `width` bits."""
    at = 0
    while width > FEW:
        half = width >> 1
        low = bits & (1 << half) - 1
        n = low.bit_count()
        if k <= n:
            bits, width = low, half
        else:
            bits, width, k, at = bits >> half, width - half, k - n, at + half
    for _ in range(k - 1):
        bits &= bits - 1
    return at + (bits & -bits).bit_length() - 1


def numbers(doc_id, seed: int = SEED) -> tuple[int, int, int, int]:
    """The first four groups of 8 hex digits of SHA-256 of "seed:doc_id"."""
    raw = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(raw[i : i + 4]) for i in (0, 4, 8, 12))


def rearranged(data: bytes, h: tuple[int, int, int, int], rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple[int, str, bytes, bytes, bytes]:
    """n, form, and the three parts of a text (all of it in the first if the form is plain)."""
    ends = token_ends(data)
    n = ends.bit_count()
    if not data or h[2] % 100 >= rate or any(m.encode() in data for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", data, b"", b""
    first, last = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = (select(ends, k, len(data)) + 1 if k else 0 for k in (first, last))
    return n, "spm" if h[3] % 100 < spm_rate else "psm", data[:a], data[a:b], data[b:]


def written(form: str, prefix: bytes, middle: bytes, suffix: bytes) -> bytes:
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if form == "plain":
        return prefix
    return b"".join((p, prefix, s, suffix, m, middle) if form == "psm" else (s, suffix, p, prefix, m, middle))


def chars(data: bytes) -> int:
    return len(data.decode())


NEW = ("fim_text", "fim_form", "fim_tokens", "fim_prefix_chars", "fim_middle_chars")


def transform(df: DataFrame, text: str = "text", key: str = "doc_id", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """The columns of df less text, with fim_text (the output), fim_form (plain, psm or spm), fim_tokens, and the code points of
    prefix and middle (null if plain)."""
    unknown(df, [key, text])
    df = without_columns(df, *NEW)
    keep = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, text):
                out = []
                for i, x in zip(b.column(key).to_pylist(), b.column(text).cast(pa.binary()).to_pylist(), strict=True):
                    n, form, *parts = rearranged(x or b"", numbers(i, seed), rate, spm_rate)
                    plain = form == "plain"
                    out.append((written(form, *parts), form, n, None if plain else chars(parts[0]), None if plain else chars(parts[1])))
                cols = list(zip(*out, strict=True)) or [()] * 5
                made = [pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
                made[0] = made[0].cast(pa.string())
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *made], [*keep, *NEW])

    kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)
    return only(df, *keep, text).mapInArrow(run, f"{kinds}fim_text string, fim_form string, fim_tokens bigint, fim_prefix_chars bigint, fim_middle_chars bigint")


def original(output: Column, form: Column) -> Column:
    """The text of an output. A rewritten text has each mark once: marks begin with < and end with >, so none can arise where a
    part meets one."""
    after = lambda c, mark: F.substring_index(c, mark, -1)
    between = lambda a, b: F.substring_index(after(output, a), b, 1)
    middle = after(output, MIDDLE)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def restore(df: DataFrame, text: str = "text") -> DataFrame:
    """What transform() gave, with the text again, rebuilt from fim_text and fim_form alone."""
    unknown(df, ["fim_text", "fim_form"])
    return df.withColumn(text, original(F.col("fim_text"), F.col("fim_form")))


def report(df: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    out = restore(transform(only(df, "doc_id", "text")))
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return out.select(
        "doc_id", F.col("fim_tokens").alias("n"), F.col("fim_form").alias("form"), F.col("fim_prefix_chars").alias("prefix_chars"), F.col("fim_middle_chars").alias("middle_chars"),
        sha("fim_text").alias("output_sha256"), sha("text").alias("restored_sha256"),
    )
