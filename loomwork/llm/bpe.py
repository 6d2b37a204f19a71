"""BPE encoding and decoding by forced-boundary splitting.

A pair of bytes that stands inside no vocabulary token can never be merged over, so the place between the two bytes is
a certain cut for the merges. The tokenizer also cuts its input with a pattern before merging, and a fragment must be cut
there as the whole text is. A pair is therefore used only between two characters where that holds too:

* letter or number followed by a letter or number: the pattern treats the rest of a run as a run;
* letter, number or other sign followed by white space, and letter or number against a sign, either way: the pattern cuts there
  anyway, and from a cut on it looks only forward;
* never after white space (its last character goes with what follows), never between two signs, never after an apostrophe or
  between the letters of a contraction.

What a character is follows from Unicode's categories, for those of the first plane that were the same in Unicode 3.2 and are now, so
that no version of the pattern's own tables disagrees; others are never cut next to. Texts of any script are cut so.

Each text is cut at all such places at once (a 65,536-entry table over neighbouring bytes), each distinct fragment is
encoded once and the ids are concatenated. Fragments are remembered in a table of a bounded number of bytes; long ones are not
remembered. Where the vocabulary's ids follow the order of its merges, fragments of Latin letters are merged by rank with a
second library, which gives the same ids in less time; other fragments, and other vocabularies, go to the tokenizer itself.

Defined cases: null text counts as empty; an empty text has no tokens; the strings of special tokens become their ids, as
the library does by default; repeated rows and ids are each encoded; a table without rows gives none.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomwork.llm.common import only, slices, unknown

#: Bytes that the fragment table takes up, about; it is emptied when full.
REMEMBERED = 96_000_000
#: Bytes of a fragment that is remembered.
SHORT = 64
#: What an entry takes up besides its fragment, and what an id does.
ENTRY, ID = 240, 40
#: Characters that are looked at together, so that the numbers of a long text aren't all held at once.
BLOCK = 1_000_000
#: The published pattern that byte-level tokenizers of this kind cut with before merging. Fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, by the published rule."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


OTHER, LETTER, NUMBER, SPACE, SIGN, APOSTROPHE = range(6)


def classes() -> np.ndarray:
    """The class of each character of the first plane; OTHER for those whose category has changed, and one more entry for what lies
    beyond."""
    of = {"L": LETTER, "N": NUMBER, "Z": SPACE, "P": SIGN, "S": SIGN, "M": SIGN}
    out = np.zeros(65_537, np.uint8)
    for i in range(65_536):
        now, then = unicodedata.category(chr(i))[0], unicodedata.ucd_3_2_0.category(chr(i))[0]
        out[i] = of.get(now, OTHER) if now == then else OTHER
    # white space by its property, not its category
    out[[i for i in range(65_536) if out[i] == SPACE and not chr(i).isspace()]] = OTHER
    out[[9, 10, 11, 12, 13]] = SPACE
    out[ord("'")] = APOSTROPHE
    return out


def allowed() -> np.ndarray:
    """Which classes may stand before and after a cut."""
    out = np.zeros((6, 6), bool)
    for a in (LETTER, NUMBER, SIGN):
        out[a, SPACE] = True
    for a in (LETTER, NUMBER):
        out[a, [LETTER, NUMBER, SIGN, APOSTROPHE]] = True
        out[SIGN, a] = True
    out[APOSTROPHE, SPACE] = True
    return out


class Fragments(dict):
    """The ids of each fragment, made when first asked for. Short ones are kept; the table is emptied when it has taken up `most` bytes."""

    def __init__(self, encode, most: int):
        super().__init__()
        self.encode, self.most, self.held = encode, most, 0

    def __missing__(self, fragment: bytes) -> tuple[int, ...]:
        ids = tuple(self.encode(fragment.decode()))
        if len(fragment) <= SHORT:
            size = ENTRY + len(fragment) + ID * len(ids)
            if self.held + size > self.most:
                self.clear()
                self.held = 0
            self.held += size
            self[fragment] = ids
        return ids


class ForcedBoundaryBPE:
    """Encoder and decoder of one byte-level vocabulary file."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        spec = json.loads(open(path, encoding="utf-8").read())
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        alphabet = byte_alphabet()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special_raw = [t.encode() for t in self.special]
        self.bytes_of: list[bytes] = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        never = np.ones(65536, bool)
        for token, i in vocab.items():
            if token in self.special:
                continue
            raw = bytes(alphabet[c] for c in token)
            self.bytes_of[i] = raw
            for a, b in zip(raw, raw[1:], strict=False):
                never[a << 8 | b] = False
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        for a, b in ("re", "ve", "ll"):
            never[ord(a) << 8 | ord(b)] = False
        self.never, self.classes, self.allowed = never, classes(), allowed()
        own = self.classes[:128]
        ascii_pairs = np.zeros((256, 256), bool)
        ascii_pairs[:128, :128] = self.allowed[own[:, None], own[None, :]]
        self.cut = never & ascii_pairs.ravel()
        self.known = Fragments(self.encoder(spec), remembered)

    def cuts(self, data: bytes) -> Iterator[int]:
        """Places inside data (as the index of the byte after it) where a cut is certain, in order."""
        if data.isascii():
            for at in range(0, len(data), BLOCK):
                raw = np.frombuffer(data, np.uint8, min(BLOCK + 1, len(data) - at), at)
                yield from (np.flatnonzero(self.cut[raw[:-1].astype(np.uint16) << 8 | raw[1:]]) + (at + 1)).tolist()
            return
        text, start = data.decode(), 0
        for at in range(0, len(text), BLOCK):
            point = np.frombuffer(text[at : at + BLOCK + 1].encode("utf-32-le"), np.uint32)
            width = 1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF)
            begin = start + np.cumsum(width) - width
            raw = np.frombuffer(data, np.uint8)
            first, last = raw[begin[1:]], raw[begin[1:] - 1]
            kind = self.classes[np.minimum(point, 65_536)]
            fits = self.allowed[kind[:-1], kind[1:]] & self.never[last.astype(np.uint16) << 8 | first]
            yield from begin[1:][fits].tolist()
            start = int(begin[BLOCK]) if len(point) > BLOCK else start

    def cut_places(self, data: bytes) -> list[int]:
        """cuts() of bytes that may be no text, which have none."""
        try:
            return list(self.cuts(data))
        except UnicodeDecodeError:
            return []

    def fragments(self, data: bytes) -> list[bytes]:
        at = [0, *self.cuts(data), len(data)]
        return [data[a:b] for a, b in zip(at, at[1:], strict=False)] if data else []

    def encoder(self, spec: dict):
        """A function from a fragment to its ids."""
        library = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        model, vocab = spec["model"], spec["model"]["vocab"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        merged = [vocab["".join(m)] for m in pairs]
        whole = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        plain = all((spec.get("pre_tokenizer") or {}).get(k) == v for k, v in whole.items()) and not spec.get("normalizer") and not model.get("ignore_merges") and not model.get("dropout")
        if not plain or merged != sorted(set(merged)):
            return library
        import tiktoken

        rank = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(self.bytes_of) if t and i not in self.special.values()}, special_tokens={}).encode_ordinary
        return lambda text: rank(text) if text.isascii() or max(text) < "\u0250" else library(text)

    def parts(self, text: bytes) -> list[bytes | int]:
        """Text between the strings of special tokens, and the ids of those."""
        out: list[bytes | int] = [text]
        for token, i in self.special.items():
            raw = token.encode()
            if raw in text:
                split = [x.split(raw) if isinstance(x, bytes) else [x] for x in out]
                out = [y for xs in split for j, x in enumerate(xs) for y in ([i, x] if j else [x])]
        return out

    def encode(self, text: bytes) -> list[int]:
        known = self.known.__getitem__
        if not any(raw in text for raw in self.special_raw):
            return list(chain.from_iterable(map(known, self.fragments(text))))
        return [i for part in self.parts(text) for i in ((part,) if isinstance(part, int) else chain.from_iterable(map(known, self.fragments(part))))]

    def encode_batch(self, batch: list[bytes]) -> list[list[int]]:
        return list(map(self.encode, batch))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def raw_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def encode(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, ids array<int>: the tokens of each whole text."""
    unknown(df, [*keep, text])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ForcedBoundaryBPE(path)
        for whole in batches:
            for b in slices(whole, text):
                ids = bpe.encode_batch(raw_texts(b, text))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(ids, pa.list_(pa.int32()))], [*keep, "ids"])

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return only(df, *keep, text).mapInArrow(run, f"{fields}, ids array<int>")


def decode(df: DataFrame, path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, text string: the text of each list of ids (null: empty)."""
    unknown(df, [*keep, ids])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ForcedBoundaryBPE(path)
        for b in batches:
            out = [bpe.decode(x or []) for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(out, pa.string())], [*keep, "text"])

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return only(df, *keep, ids).mapInArrow(run, f"{fields}, text string")


def round_trip(df: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of what encode gives and of what decode makes of it.

    Both run on the same Arrow batch, so that the ids do not pass through the JVM between them.
    """
    unknown(df, ["doc_id", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ForcedBoundaryBPE(path)
        number = [str(i) for i in range(len(bpe.bytes_of))].__getitem__
        for whole in batches:
            for b in slices(whole):
                rows = []
                for text in raw_texts(b):
                    ids = bpe.encode(text)
                    rows.append((len(ids), hashlib.sha256(",".join(map(number, ids)).encode()).hexdigest(), hashlib.sha256(bpe.decode(ids).encode()).hexdigest()))
                cols = list(zip(*rows, strict=True)) or [[]] * 3
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return only(df, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
