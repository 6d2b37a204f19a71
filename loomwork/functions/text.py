"""Text functions, Column to Column: normalising, redacting, guarding, tokenising. All but NFKC run inside the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that carry no content in questions to the graph and in ranked search.
QUESTION_STOP_WORDS = (
    "who what where when how which why is are was were the a an in on at to for of and or with by from about does do can has have tell me list show find give all any their our"
).split()
SEARCH_STOP_WORDS = (
    "a an the and or but in on at to for of with by from is are was were be been have has had do does did will would could should may might this that it not no as if"
).split()

# Personal data, in the order of replacement.
PII_PATTERNS = {
    "email": r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "card": r"\b(?:\d{4}[\- ]?){3}\d{4}\b",
    "phone": r"(?:^|\s)(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)?\d{3}[-.\s]?\d{4}\b",
    "ipv4": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
}
REDACTED = "[REDACTED]"

# Phrases that try to steer a model.
INJECTION_PATTERNS = (
    r"(?i)ignore\s+(?:all\s+)?(?:previous|prior|above|all)\s+instructions?",
    r"(?i)ignore\s+your\s+(system\s+)?prompt",
    r"(?i)forget\s+(your|all|previous)\s+(instructions?|context|training)",
    r"(?i)disregard\s+(all|previous|your)\s+instructions?",
    r"(?i)override\s+(the\s+)?(system|previous|all)\s+(prompt|instructions?)",
    r"(?i)you\s+are\s+now\s+(?:DAN|an?\s+AI\s+without)",
    r"(?i)act\s+as\s+if\s+you\s+(have\s+no|are\s+without)\s+(restrictions?|rules?)",
    r"(?i)pretend\s+(you\s+are|to\s+be)\s+",
    r"(?i)roleplay\s+as\s+",
    r"(?i)simulate\s+(a|an|the)\s+.{0,30}(AI|model|assistant|bot)",
    r"(?i)(print|reveal|show|output|repeat|display)\s+(your\s+)?(system\s+)?prompt",
    r"(?i)(print|repeat|show)\s+(all\s+)?(your\s+)?instructions?",
    r"(?i)what\s+(are|were)\s+your\s+instructions?",
    r"(?i)\[\s*SYSTEM\s*\]",
    r"(?i)<\s*system\s*>",
    r"(?i)###\s*(instruction|system|prompt)",
    r"(?i)```\s*(system|instructions?)",
    r"(?i)jailbreak",
    r"(?i)developer\s+mode",
    r"(?i)DAN\s+mode",
)
#: The shorter list that guards questions to the graph.
GRAPH_INJECTION_PATTERNS = tuple(INJECTION_PATTERNS[i] for i in (0, 1, 2, 3, 4, 5, 6, 10, 13, 14, 17, 18, 19))


def strip(c: Column) -> Column:
    """Without white space at either end (trim() only knows the space)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    return c.isNull() | ~c.rlike(r"\S")


def redact(c: Column, enabled: bool = True) -> Column:
    """Personal data replaced kind by kind; null stays null."""
    return reduce(lambda x, p: F.regexp_replace(x, p, REDACTED), PII_PATTERNS.values(), c) if enabled else c


def normalize(c: Column, pii: bool = False) -> Column:
    """Line ends, control characters, exotic spaces and runs of blanks made plain; blank text becomes empty.

    Compatibility forms (NFKC) have no built-in function; see normalize_nfkc.
    """
    steps = (
        (r"\r\n?", "\n"),
        (r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""),
        (r"[   -   　]", " "),
        (r"[ \t]{2,}", " "),
        (r"[ \t]+\n", "\n"),
        (r"\n{3,}", "\n\n"),
    )
    plain = reduce(lambda x, s: F.regexp_replace(x, *s), steps, c)
    return F.when(is_blank(c), F.lit("")).otherwise(strip(redact(plain, pii)))


def normalize_nfkc(df: DataFrame, column: str, pii: bool = False) -> DataFrame:
    """df with the column in NFKC and then normalised. Only texts beyond ASCII become Python objects; Arrow's own normaliser isn't
    used, as in some of its builds it leaves letters and their marks apart."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            plain = b.column(column).cast(pa.string())
            odd = pc.fill_null(pc.invert(pc.string_is_ascii(plain)), False)
            composed = pa.array([unicodedata.normalize("NFKC", t) for t in plain.filter(odd).to_pylist()], pa.string())
            plain = pc.replace_with_mask(plain, odd, composed)
            yield pa.RecordBatch.from_arrays([plain if n == column else b.column(n) for n in names], names)

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)
    return df.mapInArrow(run, kinds).withColumn(column, normalize(F.col(column), pii))


def injected(c: Column, patterns: tuple[str, ...] = INJECTION_PATTERNS) -> Column:
    """True where a steering phrase is found; null and blank texts are safe."""
    return F.coalesce(c.rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(False))


def has_word(c: Column, words: list[str]) -> Column:
    """True where one of the words is contained, whatever the case."""
    found = [F.contains(F.lower(c), F.lit(w.lower())) for w in words]
    return F.coalesce(reduce(lambda a, b: a | b, found, F.lit(False)), F.lit(False))


def escape_fences(c: Column) -> Column:
    return F.replace(c, F.lit("```"), F.lit("` ` `"))


def latin1(c: Column) -> Column:
    """What plain PDF text can't show becomes a question mark."""
    return F.regexp_replace(c, r"[^\x20-\x7E\n\r\t]", "?")


def wrap(c: Column, width: int = 90) -> Column:
    """Lines of at most width characters, broken at blanks; longer words are cut."""
    return F.regexp_replace(F.regexp_replace(c, rf"([^\n]{{1,{width}}})(?: +|$|(?=\n))", "$1\n"), r"\n(?=\n|$)", "")


def tokens(c: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, in order (for reranking and similarity)."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda t: t != "")


def search_tokens(c: Column) -> Column:
    """Lower-case tokens of three characters or more without stop words (for ranked search)."""
    plain = F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9\s]", " "), r"\s+")
    return F.filter(plain, lambda t: (F.length(t) > 2) & ~t.isin(*SEARCH_STOP_WORDS))


def keywords(c: Column, most: int = 8) -> Column:
    """A question's distinct content words in order of appearance, at most `most`."""
    plain = F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9 ]", " "), r"\s+")
    return F.slice(F.array_distinct(F.filter(plain, lambda t: (F.length(t) > 2) & ~t.isin(*QUESTION_STOP_WORDS))), 1, most)


def identity(source: Column, name: Column) -> Column:
    """PDF#name, WIKI#name or DB#name; empty for another source."""
    return F.when(source.isin("PDF", "WIKI", "DB"), F.concat(source, F.lit("#"), F.coalesce(name, F.lit("")))).otherwise("")


def chunk_id(identity_: Column, source: Column, index: Column) -> Column:
    """SHA-256 of identity|source|index, nulls as empty."""
    return F.sha2(F.concat_ws("|", F.coalesce(identity_, F.lit("")), F.coalesce(source, F.lit("")), index.cast("string")), 256)


def html_to_text(c: Column) -> Column:
    """Text of a page: scripts, styles, comments and tags gone, block ends as line ends, common entities decoded."""
    steps = (
        (r"(?is)<(script|style|noscript)\b.*?</\1\s*>", " "),
        (r"(?s)<!--.*?-->", " "),
        (r"(?i)<br\s*/?>|</(p|div|li|tr|h[1-6]|title|section|article|ul|ol|table)\s*>", "\n"),
        (r"<[^>]+>", " "),
        ("&nbsp;", " "),
        ("&lt;", "<"),
        ("&gt;", ">"),
        ("&quot;", '"'),
        ("&#39;", "'"),
        ("&amp;", "&"),
        (r"[ \t]+", " "),
        (r" ?\n[ \n]*", "\n"),
    )
    return strip(reduce(lambda x, s: F.regexp_replace(x, *s), steps, c))
