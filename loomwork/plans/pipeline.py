"""Whole plans: ingest, retrieve, generate, answer from the graph, chat over BM25. One job answers a batch of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork import models
from loomwork.config import Generation, Ingestion, Retrieval
from loomwork.functions import text as T
from loomwork.functions.vectors import score as rounded
from loomwork.operators import evaluate as E
from loomwork.operators import chunking, graph, lexical, lifecycle, postprocess, prompt, query_transforms, rerank, search
from loomwork.sources.tables import join_small, kept

#: Hits (ids and scores) of a batch of queries that are sent to the chunks; beyond that both sides are shuffled.
MOST_HITS = 500_000

Embed = Callable[[DataFrame, str, str], DataFrame]

ATTRIBUTES = ("source", "identity", "file_name", "page", "chunk_index", "table", "visibility", "effective_from", "effective_to", "date")


def ingest(documents: DataFrame, store: DataFrame | None = None, cfg: Ingestion = Ingestion(), strategy: Column | None = None) -> DataFrame:
    """The store's chunks after ingesting documents: normalise, chunk, number, keep identities with new content, enrich.

    Stages that are switched off add no node to the plan.
    """
    named = T.normalize_nfkc(documents, "content", cfg.pii).filter(F.col("content") != "")
    configured = strategy if strategy is not None else (F.lit(cfg.strategy) if cfg.strategy else None)
    classified = chunking.classified_strategy(F.col("content")) if cfg.classify else None
    chunks = chunking.with_ids(chunking.chunk(named, configured, classified))
    if store is not None:
        base = [c for c in chunks.columns if c in store.columns]
        chunks = lifecycle.incremental(store.select(*base), chunks.select(*base))
    return chunking.enrich(chunks, cfg.enrich, cfg.keywords)


def first_stage(queries: DataFrame, chunks: DataFrame, cfg: Retrieval, embed: Embed | None, index: lexical.Index | None = None) -> DataFrame:
    """query_id, chunk_id, score, rank by the configured mode. Without an embedder, vector search isn't there and the other
    side stands alone. index is a stored one of the chunks, by chunk_id."""
    k = search.over_fetch(cfg.top_k, cfg.over_fetch)
    lexical_side = dense_side = None
    if cfg.mode != "VECTOR" or embed is None:
        lexical_side = search.keyword_top_k(queries, index or chunks, k, key="chunk_id", text="content")
    if cfg.mode != "KEYWORD" and embed is not None:
        vectors = chunks.select("chunk_id", "embedding") if "embedding" in chunks.columns else embed(chunks, "chunk_id", "content")
        dense_side = search.vector_top_k(embed(queries, "query_id", "query"), vectors, k, key="chunk_id", threshold=cfg.threshold)
    if lexical_side is not None and dense_side is not None:
        return search.fuse(dense_side, lexical_side, k, key="chunk_id")
    return lexical_side if dense_side is None else dense_side


def retrieve(queries: DataFrame, chunks: DataFrame, cfg: Retrieval = Retrieval(), embed: Embed | None = None, made: Column | None = None, today: Column | None = None, index: lexical.Index | None = None) -> DataFrame:
    """query_id, query, ord (1 is best), score and the chunk's columns, at most top_k for each query.

    queries (query_id, query); made is a model's text for the query transform; today switches on date rules.
    """
    variants = query_transforms.transform(queries, cfg.transform, made)
    if cfg.transform == "NONE":
        found = first_stage(queries, chunks, cfg, embed, index).withColumnRenamed("rank", "ord")
    else:
        # every variant is a query of its own to the first stage
        numbered = variants.select(F.struct("query_id", "variant_no").alias("_v"), "query").withColumn("query_id", F.to_json("_v"))
        hits = first_stage(numbered.select("query_id", "query"), chunks, cfg, embed, index)
        back = F.from_json("query_id", f"query_id {queries.schema['query_id'].dataType.simpleString()}, variant_no int")
        split = hits.withColumn("_v", back).withColumn("query_id", F.col("_v.query_id")).withColumn("variant_no", F.col("_v.variant_no"))
        found = search.merge_variants(split, key="chunk_id").select("query_id", "chunk_id", "score", "ord")
    columns = [c for c in chunks.columns if c in ATTRIBUTES or c in ("chunk_id", "content")]
    hits = variants.count() * search.over_fetch(cfg.top_k, cfg.over_fetch)
    out = join_small(join_small(chunks.select(*columns), found, "chunk_id", rows=hits, most=MOST_HITS), queries.select("query_id", "query"), "query_id")
    out = kept(out, "candidates")  # few rows, which every later step reads, some of them several times
    if today is not None and {"table", "visibility", "effective_from", "effective_to"} <= set(out.columns):
        out = postprocess.business_rules(out, today)
    if cfg.min_chars or cfg.max_chars:
        out = postprocess.length_band(out, cfg.min_chars, cfg.max_chars)
    if cfg.dedup:
        out = postprocess.near_duplicates(out, cfg.dedup_threshold)
    if cfg.rerank:
        method = rerank.RERANKERS[cfg.rerank]
        out = postprocess.rerank_head(out, lambda c: method(c, key="chunk_id"), cfg.rerank_top_n, cfg.rerank_least)
    if {"source", "table", "date"} <= set(out.columns):
        out = postprocess.rank(out)
    else:
        out = out.withColumn("ord", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "ord", "chunk_id")))
    if cfg.mmr:
        out = postprocess.diversify(out, cfg.mmr_lambda)
    return search.trim(out, cfg.top_k, "ord")


def cite(found: DataFrame) -> DataFrame:
    keys = tuple(c for c in ("identity", "page", "chunk_index") if c in found.columns)
    return postprocess.citations(found, keys=keys)


def generate(
    queries: DataFrame,
    chunks: DataFrame,
    cfg: Generation = Generation(),
    embed: Embed | None = None,
    answer=models.answer,
    judge=models.judge,
    enough=models.enough,
    cache: DataFrame | None = None,
    turns: DataFrame | None = None,
    now: Column | None = None,
    index: lexical.Index | None = None,
) -> DataFrame:
    """query_id, answer, context, faithful, blocked, from_cache, insufficient, citations, history.

    queries (query_id, query and, for a memory, conv_id). The steps, each only for the queries that are left:

    1. unsafe queries get the policy's message, those with a sensitive word another;
    2. queries close enough to one in cache (entry_id, embedding, answer, expires_at) get its answer;
    3. passages are retrieved, unsafe ones left out, and numbered into a context;
    4. where the context doesn't suffice by the judge, a canned answer says so;
    5. the others are answered from the context and judged for faithfulness; history has the last messages of the
       conversation from turns (conv_id, turn, role, text), for a model that reads them.

    citations are "identity" or "identity, p.N" in order, for answered queries. In ADVISOR mode passages come from vector
    search above a threshold and there are no judges.
    """
    q = queries.withColumn("blocked", T.injected(F.col("query")) if cfg.guard else F.lit(False))
    q = q.withColumn("_sensitive", T.has_word(F.col("query"), list(cfg.sensitive_words)) if cfg.sensitive_words else F.lit(False))
    known = None
    if cache is not None and embed is not None:
        vectors = embed(q.filter(~F.col("blocked")), "query_id", "query")
        known = search.similar_queries(vectors, cache, now, cfg.cache_similarity).select("query_id", F.col("answer").alias("_cached"))
    q = q.join(known, "query_id", "left") if known is not None else q.withColumn("_cached", F.lit(None).cast("string"))
    todo = q.filter(~F.col("blocked") & ~F.col("_sensitive") & F.col("_cached").isNull()).select("query_id", "query")
    r = Retrieval(**{**cfg.retrieval.__dict__, "top_k": cfg.top_k})
    if cfg.mode == "ADVISOR":
        r = Retrieval(top_k=cfg.top_k, mode="VECTOR", threshold=cfg.advisor_threshold, dedup=False)
    found = retrieve(todo, chunks, r, embed, index=index)
    if cfg.guard:
        found = found.filter(~T.injected(F.col("content")))
    for c in ("file_name", "page", "source", "identity"):
        if c not in found.columns:
            found = found.withColumn(c, F.lit(None).cast("string"))
    ctx = prompt.contexts(todo, found, order="ord").join(todo, "query_id").withColumn("_found", F.col("context") != prompt.NO_CONTEXT)
    judged = cfg.mode != "ADVISOR"
    few = ~E.sufficient(F.when(F.col("_found"), F.col("context")), enough(F.col("query"), F.col("context"))) if judged and cfg.sufficiency else F.lit(False)
    said = ctx.withColumn("insufficient", few).withColumn("_said", F.when(~F.col("insufficient"), answer(F.col("context"))))
    said = said.withColumn("faithful", F.when(~F.col("insufficient"), judge(F.col("_said"), F.col("context"))) if judged and cfg.judge else F.lit(None).cast("boolean"))
    if cfg.citations:
        page = F.when(F.col("page").try_cast("int").isNotNull(), F.concat(F.lit(", p."), F.col("page").try_cast("int").cast("string"))).otherwise(F.lit(""))
        named = cite(found).select("query_id", F.struct("citation_no", F.concat(F.coalesce("identity", F.lit("")), page).alias("name")).alias("_c"))
        lists = named.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list("_c")), lambda x: x["name"]).alias("_cited"))
        said = said.join(lists, "query_id", "left")
    else:
        said = said.withColumn("_cited", F.lit(None).cast("array<string>"))
    out = q.join(said.drop("query"), "query_id", "left")
    if turns is not None and "conv_id" in queries.columns:
        last = prompt.chat_window(turns.join(queries.select("conv_id").distinct(), "conv_id", "left_semi"), cfg.memory)
        line = F.struct("turn", F.concat_ws(": ", "role", "text").alias("line"))
        memory = last.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("history"))
        out = out.join(memory, "conv_id", "left")
    else:
        out = out.withColumn("history", F.lit(None).cast("string"))
    no = lambda c: F.coalesce(c, F.lit(False))
    text = (
        F.when(F.col("blocked"), F.lit(cfg.block_message))
        .when(F.col("_sensitive"), F.lit(cfg.sensitive_answer))
        .when(F.col("_cached").isNotNull(), F.col("_cached"))
        .when(no(F.col("insufficient")), F.lit(cfg.insufficient_answer))
        .otherwise(F.col("_said"))
    )
    cited = F.when(F.col("_said").isNotNull() & F.col("_cited").isNotNull(), F.col("_cited")).otherwise(F.array().cast("array<string>"))
    hit = ~F.col("blocked") & ~F.col("_sensitive") & F.col("_cached").isNotNull()
    return out.select("query_id", text.alias("answer"), "context", "faithful", "blocked", hit.alias("from_cache"), no(F.col("insufficient")).alias("insufficient"), cited.alias("citations"), "history")


def token_stream(answers: DataFrame, qid: str = "query_id", text: str = "answer") -> DataFrame:
    """qid, token_no, token: an answer piece by piece, each word with the white space before it; together they are the answer."""
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\s*\S+|\s+)"), 1)
    return answers.select(qid, F.posexplode(pieces).alias("token_no", "token"))


def graph_answer(questions: DataFrame, nodes: DataFrame, edges: DataFrame, answer=models.answer) -> DataFrame:
    """qid, blocked, context, answer: questions past the guard are answered from the graph's context."""
    asked = questions.withColumn("blocked", T.injected(F.col("question"), T.GRAPH_INJECTION_PATTERNS))
    ctx = graph.context(nodes, edges, asked.filter(~F.col("blocked")).select("qid", "question"))
    return asked.select("qid", "blocked").join(ctx, "qid", "left").withColumn("answer", F.when(~F.col("blocked"), answer(F.col("context"))))


def bm25_chat(queries: DataFrame, chunks: DataFrame, k: int = 5, answer=models.answer, index: lexical.Index | None = None) -> DataFrame:
    """query_id, context, answer: passages by BM25 alone. index is a stored one of the chunks' search_tokens(), by chunk_id."""
    known = index or lexical.Index.of(chunks, "chunk_id", "content", T.search_tokens)
    found = lexical.search_top(known, queries, k, tokenize=T.search_tokens)
    scored = join_small(chunks.select("chunk_id", "content"), found.withColumn("score", rounded(F.col("score"), 3)), "chunk_id", rows=queries.count() * k, most=MOST_HITS)
    return prompt.passages(queries.select("query_id"), scored).withColumn("answer", answer(F.col("context")))
