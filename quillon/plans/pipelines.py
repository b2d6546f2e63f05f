"""Whole flows composed of the operators: indexing documents, replacing them, answering questions.

Model services are passed in as factories of :mod:`quillon.plans.clients`; nothing here
runs an action.
"""

from __future__ import annotations

from collections.abc import Callable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import ids, legal
from quillon.functions import metadata as M
from quillon.functions import text as T
from quillon.operators import search, store
from quillon.plans import clients

CHUNK_COLUMNS = "seq int, node_id string, kind string, parent_id string, parent_context string, title string, content string, full_text string"
#: Words beyond which a chunk's content is embedded in parts.
MOST_WORDS = 2000
#: Code points of context that an answer is drawn from.
CONTEXT = 8000
#: Intents and the branch that serves them; anything else goes to the fallback.
BRANCHES = {"LEGAL_QUERY": "legal_query", "GENERAL": "general", "DOC_RELATION": "doc_relation", "CHITCHAT": "fallback"}


def document_metadata(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Number, type, title, agency, dates and article count read off each text: one select over the cleaned text."""
    clean = docs.where(F.col(text).isNotNull()).select(key, T.apply(F.col(text), T.CLEAN).alias("clean"))
    c = F.col("clean")
    articles = F.regexp_count("clean", F.lit(rf"(?d)(?m)^{T.WHITE}*Điều{T.WHITE}+\d+[a-zA-Z]?\."))
    return clean.select(
        key, T.document_number(c).alias("so_hieu"), M.title(c).alias("ten_van_ban"), T.document_type(c).alias("loai"), M.agency(c).alias("co_quan_ban_hanh"),
        M.issue_date(c).alias("ngay_ban_hanh"), M.effective_date(c).alias("ngay_co_hieu_luc"), articles.alias("so_dieu"),
    )


def chunk_documents(docs: DataFrame, document: str, text: str) -> DataFrame:
    """Sections of each document as chunks with text to embed; long contents become overlapping parts that keep their context."""
    named = docs.where(F.col(document).isNotNull() & F.col(text).isNotNull())
    tree = legal.rows_per_text(named, document, text, lambda key, value: legal.flat_chunks(str(key), value), CHUNK_COLUMNS)
    kept = tree.where("coalesce(title, '') <> '' or coalesce(content, '') <> ''")
    short = kept.where(T.word_count(F.coalesce("content", F.lit(""))) <= MOST_WORDS).withColumn("part", F.lit(None).cast("int"))
    long = kept.where(T.word_count(F.coalesce("content", F.lit(""))) > MOST_WORDS)
    parts = legal.rows_per_text(long, "node_id", "content", lambda _, value: list(enumerate(legal.oversize_split(value))), "part int, piece string").withColumnRenamed("node_id", "_n")
    cut = long.join(parts, F.col("node_id") == F.col("_n")).drop("_n").withColumn("content", F.col("piece")).drop("piece")
    every = short.unionByName(cut)
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    chunk_id = F.when(F.col("part").isNull(), F.col("node_id")).otherwise(F.concat("node_id", F.lit("_part_"), F.col("part").cast("string")))
    return every.select(F.col(document).alias("so_hieu"), chunk_id.alias("chunk_id"), "seq", "kind", "parent_id", "full_text", F.concat_ws("\n", blank("parent_context"), blank("title"), blank("content")).alias("text"))


def index_documents(docs: DataFrame, document: str, text: str, embedder: Callable[[], clients.Embedder] = clients.HashEmbedder) -> DataFrame:
    """Chunks with vectors and the columns that are filtered on; rows whose embedding failed have an error."""
    chunks = chunk_documents(docs, document, text)
    embedded = clients.embed(chunks, "chunk_id", "text", embedder).withColumnRenamed("chunk_id", "_c")
    return chunks.join(embedded, F.col("chunk_id") == F.col("_c")).drop("_c").withColumn("trang_thai", F.lit(1))


def replace_documents(metadata: DataFrame, chunks: DataFrame, relations: DataFrame, new_metadata: DataFrame, new_chunks: DataFrame, replacements: DataFrame, once: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Next state of the three stores after new documents; ``replacements(entity_start, entity_end, relation_type)``.

    Only what is replaced (``thay_the``) loses its validity, in both stores alike; a
    relation that is there already is not added again, unless ``once`` is switched off.
    """
    gone = replacements.where("relation_type = 'thay_the'")
    meta = store.deactivate(store.upsert(metadata, new_metadata, "so_hieu", keep=("trang_thai",)), "so_hieu", gone, "entity_end", "trang_thai")
    held = store.deactivate(store.upsert(chunks, new_chunks, "chunk_id"), "so_hieu", gone, "entity_end", "trang_thai")
    related = store.add_missing(relations, replacements, ["entity_start", "entity_end", "relation_type"]) if once else store.append(relations, replacements)
    return meta, held, related


def refuse_long(items: DataFrame, request: str, place: str, text: str, most: int = 256, preview: int = 200) -> tuple[DataFrame, DataFrame]:
    """Requests of texts for a model that takes at most ``most`` words: the items of requests that fit as a whole, and, of the others, ``(request, place, words, preview)`` of every text that is too long."""
    long = items.withColumn("_words", T.word_count(F.coalesce(text, F.lit("")))).where(F.col("_words") > most)
    refused = long.select(request, place, F.col("_words").alias("words"), F.left(text, F.lit(preview)).alias("preview"))
    gone = long.select(F.col(request).alias("_gone")).distinct()
    return items.join(gone, F.col(request) == F.col("_gone"), "left_anti"), refused


def sub_questions(answers: DataFrame, question: str, answer: str) -> DataFrame:
    """``(question, pos, query, intent, branch)`` out of a model's JSON; what cannot be read is one request for the fallback."""
    schema = "struct<sub_questions: array<struct<query: string, intent: string>>>"
    parsed = legal.per_text(answers, question, answer, legal.safe_json, "_json", "string").select(question, F.from_json("_json", schema)["sub_questions"].alias("_all"))
    usable = F.when(F.size("_all") > 0, F.col("_all")).otherwise(F.array(F.struct(F.lit("").alias("query"), F.lit("CHITCHAT").alias("intent"))))
    rows = parsed.select(question, F.posexplode(usable).alias("pos", "_sub")).select(question, "pos", "_sub.query", F.upper("_sub.intent").alias("intent"))
    table = F.create_map(*(F.lit(x) for pair in BRANCHES.items() for x in pair))
    return rows.withColumn("branch", F.coalesce(table[F.col("intent")], F.lit("fallback")))


def merge_results(asked: DataFrame, gathered: DataFrame, request: str, item: str, order: str) -> DataFrame:
    """``asked`` with ``context``: every sub-question of a request has all that was gathered for the request, first seen first, each item once."""
    first = gathered.where(F.col(item).isNotNull()).groupBy(F.col(request).alias("_r"), F.col(item).alias("_i")).agg(F.min(order).alias("_o"))
    lists = first.groupBy("_r").agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_i"))), lambda x: x["_i"]).alias("context"))  # what one request gathered
    joined = asked.join(lists, F.col(request) == F.col("_r"), "left").drop("_r")
    return joined.withColumn("context", F.coalesce("context", F.array().cast(joined.schema["context"].dataType)))


def retrieve(questions: DataFrame, question: str, text: str, chunks: DataFrame, embedder: Callable[[], clients.Embedder] = clients.HashEmbedder, reranker: Callable[[], clients.Reranker] = clients.OverlapReranker, k: int = 50, best: int = 5) -> DataFrame:
    """Active leaf chunks for each question: nearest ones, without those below another one, reranked; ``(query, chunk_id, score, rank)``."""
    asked = clients.embed(questions, question, text, embedder).where("vector is not null")
    leaf = chunks.where(F.col("kind").isin(*search.LEAF_TYPES) & (F.col("trang_thai") == 1)).select("chunk_id", "text", "vector")
    nearest = search.top_k_of_queries(leaf, "chunk_id", "vector", asked, question, "vector", k).withColumnRenamed("key", "_c")
    near = search.drop_descendants(nearest.join(leaf.select("chunk_id", "text"), F.col("_c") == F.col("chunk_id")).drop("_c"), "query", "chunk_id")
    worded = near.join(questions.select(F.col(question).alias("_k"), F.col(text).alias("_text")), F.col("query") == F.col("_k"))
    pairs = worded.select(F.concat_ws("\u0001", F.col("query").cast("string"), "chunk_id").alias("pair"), "_text", "text")
    scored = clients.score(pairs, "pair", "_text", "text", reranker).select("pair", "score")
    named = near.withColumn("pair", F.concat_ws("\u0001", F.col("query").cast("string"), "chunk_id")).join(scored, "pair")
    return search.rerank(named, ["query"], F.col("score"), best, "chunk_id").select("query", "chunk_id", "text", F.col("score_rerank").alias("score"), "rank")


def build_prompts(found: DataFrame, template: str = "Ngữ cảnh:\n{context}\n\nTrả lời dựa vào ngữ cảnh.") -> DataFrame:
    """``(query, prompt, citations)``: numbered sources in rank order, cut to :data:`CONTEXT` code points, and what they cite."""
    if "{context}" not in template:
        raise ValueError("the template has no {context}")
    head, tail = template.split("{context}", 1)
    part = ids.decode(F.col("chunk_id"))
    shown = F.struct("rank", F.concat(F.lit("[Nguồn "), F.col("rank").cast("string"), F.lit("] "), "text").alias("t"), F.concat_ws(" - ", part["so_hieu"], part["dieu"], part["khoan"]).alias("c"))
    lists = found.groupBy("query").agg(F.array_sort(F.collect_list(shown)).alias("x"))  # at most the reranked few of a question
    context = F.left(F.array_join(F.transform("x", lambda s: s["t"]), "\n\n"), F.lit(CONTEXT))
    return lists.select("query", F.concat(F.lit(head), context, F.lit(tail)).alias("prompt"), F.array_join(F.transform("x", lambda s: s["c"]), "; ").alias("citations"))


def answer(questions: DataFrame, question: str, text: str, chunks: DataFrame, generator: Callable[[], clients.Generator], **how) -> DataFrame:
    """``(query, answer, citations, error)`` of each question; a question without any source has a null answer."""
    prompts = build_prompts(retrieve(questions, question, text, chunks, **how))
    said = clients.generate(prompts, "query", "prompt", generator).withColumnRenamed("query", "_q")
    with_answer = prompts.join(said, F.col("query") == F.col("_q")).select("query", "answer", "citations", "error")
    return questions.select(F.col(question).alias("query")).join(with_answer, "query", "left")


#: Fixed value: what is said where nothing was found to answer from.
APOLOGY = "Xin lỗi, tôi không thể sinh câu trả lời từ thông tin được cung cấp."


def answer_all(questions: DataFrame, question: str, text: str, chunks: DataFrame, generator: Callable[[], clients.Generator], **how) -> DataFrame:
    """As :func:`answer`, with an apology for questions without any source or answer."""
    return answer(questions, question, text, chunks, generator, **how).withColumn("answer", F.coalesce(F.nullif("answer", F.lit("")), F.lit(APOLOGY)))


def chunk_lines(docs: DataFrame, document: str, text: str) -> DataFrame:
    """``(document, seq, line)``: the chunks of each document as JSON lines, its root first; written as text this is the side output of indexing."""
    root = docs.where(F.col(document).isNotNull()).select(F.col(document).alias("so_hieu"), F.lit(-1).alias("seq"), F.col(document).alias("chunk_id"), F.lit("van_ban").alias("kind"), F.lit(None).cast("string").alias("parent_id"), F.lit(None).cast("string").alias("text"))
    below = chunk_documents(docs, document, text).select("so_hieu", "seq", "chunk_id", "kind", "parent_id", "text")
    every = root.unionByName(below)
    return every.select("so_hieu", "seq", F.to_json(F.struct("chunk_id", "kind", "parent_id", "text")).alias("line"))
