"""Chunking: a document row becomes chunk rows. Strategies are functions from documents to (…, chunk_index, content).

Windows and pattern splits are expressions. The greedy ones (recursive, semantic, boundary) carry a running length from
piece to piece, which no expression does; they run on Arrow batches and need no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.text import chunk_id, is_blank, strip, tokens

FIXED = (1000, 150)
RECURSIVE = (1000, 150)
TOKENS = 800
SEMANTIC = (0.8, 1500)
BOUNDARY = (500, 100)
DELIMITER = "---CHUNK---"
HEADING = r"\n(?=#+\s)"


def finish(df: DataFrame, segments: Column, strategy: str) -> DataFrame:
    """One row for each segment that is not blank, stripped, numbered from 0."""
    kept = F.filter(F.transform(segments, strip), lambda s: s != "")
    return df.select("*", F.posexplode(kept).alias("chunk_index", "_content")).drop("content").withColumnRenamed("_content", "content").withColumn("chunk_strategy", F.lit(strategy))


def windows(text: Column, size: int, overlap: int) -> Column:
    """Windows of size characters, each overlapping the one before; the window that reaches the end is the last."""
    step = size - overlap
    last = F.greatest(F.length(text) - overlap - 1, F.lit(0))
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), last, F.lit(step)), lambda i: F.substring(text, i + 1, F.lit(size))))


def fixed(df: DataFrame, size: int = FIXED[0], overlap: int = FIXED[1]) -> DataFrame:
    return finish(df, windows(F.coalesce("content", F.lit("")), size, max(0, min(overlap, size - 1))), "fixed")


def fixed_raw(df: DataFrame, size: int, overlap: int, label: str = "FIXED_SIZE") -> DataFrame:
    """Windows as they are: blanks kept, nothing stripped, an overlap as large as the window refused."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    segments = windows(F.coalesce("content", F.lit("")), size, overlap)
    return df.select("*", F.posexplode(segments).alias("chunk_index", "_content")).drop("content").withColumnRenamed("_content", "content").withColumn("chunk_strategy", F.lit(label))


def pdf_pages(df: DataFrame) -> DataFrame:
    return fixed_raw(df, 500, 100, "PDF_PRAGMATIC_FIXED_SIZE")


def token_windows(df: DataFrame, size: int = TOKENS) -> DataFrame:
    """Windows of so many tokens, joined by blanks."""
    return finish(df, token_segments(F.col("content"), size), "token")


def token_segments(text: Column, size: int = TOKENS) -> Column:
    t = tokens(text)
    n = F.size(t)
    starts = F.when(n > 0, F.sequence(F.lit(1), n, F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(t, i, F.lit(size)), " "))


def markdown(df: DataFrame, label: str = "markdown") -> DataFrame:
    """Sections: split before each heading."""
    return finish(df, F.split("content", HEADING), label)


def wiki_sections(df: DataFrame) -> DataFrame:
    return markdown(df, "WIKI_SECTION")


def delimited(df: DataFrame, marked: str = "marked") -> DataFrame:
    """Split a model's marked-up copy of the text at its delimiter lines; without one, the whole text is a chunk."""
    text = F.when(is_blank(F.col(marked)), F.col("content")).otherwise(F.col(marked))
    return finish(df.withColumn("_text", text), F.split("_text", rf"(?m)^\s*{DELIMITER}\s*$"), "llm").drop("_text", marked)


def whole_row(df: DataFrame) -> DataFrame:
    """A database row is one chunk."""
    return df.withColumn("chunk_index", F.lit(0)).withColumn("chunk_strategy", F.lit("db"))


# --- greedy strategies


def in_batches(df: DataFrame, cut: Callable[[str], list[str]], strategy: str) -> DataFrame:
    """finish() for a Python splitter: segments are made in Arrow batches."""
    names = [c for c in df.columns if c != "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            segments = pa.array([cut(t or "") for t in b.column("content").to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), segments], [*names, "_segments"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)
    made = df.select(*names, "content").mapInArrow(run, f"{kinds}, _segments array<string>")
    return finish(made.withColumn("content", F.lit(None).cast("string")), F.col("_segments"), strategy).drop("_segments")


def split_recursively(text: str, most: int = RECURSIVE[0], overlap: int = RECURSIVE[1], separators: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Pieces by the first separator (each keeps it), packed up to `most` characters with a tail of the chunk before.

    A piece that is too long is cut by the next separator; what was packed before it is closed first. Without a separator
    left, text is cut hard.
    """
    if len(text) <= most:
        return [text]
    first, *finer = separators
    pieces = [p + first for p in text.split(first)] if first else [text[i : i + most] for i in range(0, len(text), most)]
    out: list[str] = []
    current = ""
    for p in pieces:
        if len(p) > most and finer:
            if current:
                out.append(current)
            current = ""
            out += split_recursively(p, most, overlap, tuple(finer))
            continue
        if current and len(current) + len(p) > most:
            out.append(current)
            current = current[-overlap:] if overlap else ""
        current += p
    return [*out, current] if current else out


def recursive(df: DataFrame, most: int = RECURSIVE[0], overlap: int = RECURSIVE[1]) -> DataFrame:
    return in_batches(df, lambda t: split_recursively(t, most, overlap), "recursive")


def sentences(text: str) -> list[str]:
    return [s.strip() for s in re.split(r"(?<=[.!?])\s+|\n{2,}", text) if s.strip()]


def term_vector(text: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for t in re.findall("[a-z0-9]+", text.lower()):
        out[t] = out.get(t, 0) + 1
    return out


def bag_similarity(a: dict[str, int], b: dict[str, int]) -> float:
    norms = (sum(x * x for x in a.values()) * sum(x * x for x in b.values())) ** 0.5
    return sum(n * b.get(t, 0) for t, n in a.items()) / norms if norms else 0.0


def split_semantically(text: str, least: float = SEMANTIC[0], most: int = SEMANTIC[1], embed=term_vector, similarity=bag_similarity) -> list[str]:
    """Neighbouring sentences while they stay similar and short enough together."""
    parts = sentences(text)
    out, vectors = parts[:1], [embed(s) for s in parts]
    for i in range(1, len(parts)):
        if similarity(vectors[i - 1], vectors[i]) < least or len(out[-1]) + len(parts[i]) > most:
            out.append(parts[i])
        else:
            out[-1] += " " + parts[i]
    return out


def semantic(df: DataFrame, least: float = SEMANTIC[0], most: int = SEMANTIC[1], embed=term_vector, similarity=bag_similarity) -> DataFrame:
    return in_batches(df, lambda t: split_semantically(t, least, most, embed, similarity), "semantic")


def split_at_boundaries(text: str, size: int = BOUNDARY[0], overlap: int = BOUNDARY[1]) -> list[str]:
    """Windows that end after the last period or line end in their second half. The last one is followed by its own tail."""
    out: list[str] = []
    start = 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            cut = max(text.rfind(".", 0, end + 1), text.rfind("\n", 0, end + 1))
            if cut > start + size // 2:
                end = cut + 1
        out.append(text[start:end])
        if end - overlap <= start:
            break
        start = end - overlap
    return [s.strip() for s in out if s.strip()]


def boundary(df: DataFrame, size: int = BOUNDARY[0], overlap: int = BOUNDARY[1]) -> DataFrame:
    return in_batches(df, lambda t: split_at_boundaries(t, size, overlap), "boundary")


#: Strategies by name.
STRATEGIES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "fixed": fixed,
    "recursive": recursive,
    "token": token_windows,
    "semantic": semantic,
    "markdown": markdown,
    "db": whole_row,
    "boundary": boundary,
    "wiki_section": wiki_sections,
    "pdf_fixed": pdf_pages,
}


def strategy(name: str) -> Callable[[DataFrame], DataFrame]:
    if name.lower() not in STRATEGIES:
        raise ValueError(f"unknown chunking strategy: {name}")
    return STRATEGIES[name.lower()]


def route(source: Column, configured: Column | None = None, classified: Column | None = None) -> Column:
    """The strategy's name: configured, else db for database rows, else classified, else by source."""
    default = F.when(source == "WIKI", "markdown").when(source == "PDF", "recursive").otherwise("token")
    by_source = F.when(source == "DB", "db").otherwise(F.coalesce(F.lower(classified), default) if classified is not None else default)
    return F.coalesce(F.lower(configured), by_source) if configured is not None else by_source


#: Strategies that cut with Python, by name.
GREEDY: dict[str, Callable[[str], list[str]]] = {"recursive": split_recursively, "semantic": split_semantically, "boundary": split_at_boundaries}


def chunk(df: DataFrame, configured: Column | None = None, classified: Column | None = None) -> DataFrame:
    """Every document by its strategy, in one pass over df.

    Documents of a greedy strategy are cut in Arrow batches, which the others pass through; theirs are expressions of which
    a row evaluates its own alone. A document with an unknown strategy gives no chunks.
    """
    names = [c for c in df.columns if c != "content"]
    routed = df.select(*names, "content", route(F.col("source"), configured, classified).alias("_route"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cut = [GREEDY[r](t or "") if r in GREEDY else None for r, t in zip(b.column("_route").to_pylist(), b.column("content").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cut, pa.list_(pa.string()))], [*b.schema.names, "_segments"])

    kinds = ", ".join(f"`{c}` {routed.schema[c].dataType.simpleString()}" for c in routed.columns)
    made = routed.mapInArrow(run, f"{kinds}, _segments array<string>")
    text, way = F.col("content"), F.col("_route")
    plain = F.coalesce(text, F.lit(""))
    segments = (
        F.when(way.isin(*GREEDY), F.col("_segments"))
        .when(way == "fixed", windows(plain, *FIXED))
        .when(way == "token", token_segments(text))
        .when(way == "markdown", F.split(text, HEADING))
    )
    kept = F.when(way == "db", F.array(text)).otherwise(F.filter(F.transform(segments, strip), lambda x: x != ""))
    out = made.select(*names, F.posexplode(kept).alias("chunk_index", "content"), way.alias("chunk_strategy"))
    return out.select(*names, "chunk_index", "content", "chunk_strategy")


def classified_strategy(text: Column) -> Column:
    """A deterministic classifier of strategies: headings ask for sections, long prose for recursive cuts, many short lines
    for windows of a fixed size, the rest for tokens. Blank texts have none, like a model that fails."""
    lines, chars = F.size(F.split(text, "\n")), F.length(text)
    chosen = F.when(text.rlike(r"(?m)^#{1,6}\s"), "markdown").when(chars / lines < 40, "fixed").when(chars > 2000, "recursive").otherwise("token")
    return F.when(~is_blank(text), chosen)


def summary(text: Column, most: int = 160) -> Column:
    """A deterministic section summary: the first sentence, cut to `most` characters."""
    return F.substring(strip(F.regexp_extract(text, r"(?s)\A\s*(.*?(?:[.!?](?=\s|\z)|\z))", 1)), 1, most)


def with_ids(chunks: DataFrame) -> DataFrame:
    """chunk_index renumbered densely over all segments of an identity, and chunk_id from it."""
    order = [c for c in ("page", "segment", "chunk_index") if c in chunks.columns]
    w = Window.partitionBy("identity", "source").orderBy(*order)
    return chunks.withColumn("chunk_index", F.row_number().over(w) - 1).withColumn("chunk_id", chunk_id(F.col("identity"), F.col("source"), F.col("chunk_index")))


def top_terms(chunks: DataFrame, key: str = "chunk_id", text: str = "content", k: int = 5) -> DataFrame:
    """key, keywords: the k terms with the largest tf * idf, ties by term. A deterministic enricher."""
    t = chunks.select(key, F.explode(tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    n = chunks.agg(F.count(F.lit(1)).alias("n"))
    df = t.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(F.col("tf") * F.log((F.col("n") + 1) / (F.col("df") + 0.5)) * 1e6 + 0.5) / 1e6
    w = Window.partitionBy(key).orderBy(F.col("weight").desc(), "term")
    ranked = t.join(df, "term").crossJoin(F.broadcast(n)).withColumn("weight", weight).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k)
    return ranked.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "term"))), lambda x: x["term"]), ",").alias("keywords"))


def enrich(chunks: DataFrame, enabled: bool = True, k: int = 5, summarize: Callable[[Column], Column] = summary) -> DataFrame:
    """chunks with keywords and section_summary; unchanged when disabled. Keywords are null for a chunk without terms."""
    return chunks.join(top_terms(chunks, k=k), "chunk_id", "left").withColumn("section_summary", summarize(F.col("content"))) if enabled else chunks
