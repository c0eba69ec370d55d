"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Float outputs are rounded to 6 decimals; ranks are INT. Column names equal the oracle SQL
in :mod:`shoprank.plans.oracle`. Every query reads whole tables (no id subsets, no caps
other than the top-k limits that are the feature itself).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import (ALPHA_GRID, DEFAULT_MODE, EMBEDDING_DIM, HASH_DIM, MODE_SPACES, PARITY_ALPHA, PARITY_K, PARITY_MULTIPLIER, SPACE_SLICES, TEXT_ENCODERS,
                      TEXT_SPACES)
from ..functions.encoders import hashing_encoder
from ..functions.hashing import dense_counts, sparse_weights, token_buckets
from ..functions.vector import l2_norm, l2_normalize
from ..operators.cells import build_cells, calibrated_probes, search_cells
from ..operators.constraint_grammar import grammar_constraints
from ..operators.constraints import post_filter, recommend
from ..operators.knn import SideStats, TileConfig, hybrid_candidates, pack_corpus
from ..operators.product_codes import build_codes, search_codes, survivor_counts
from ..operators.prompts import (agent_answer_request, agent_slicing_request, answer_messages, assemble_context, blocks_of, result_card,
                                 slicing_messages, with_blocks)
from ..operators.rank import fuse, pools, ranked, top_k
from ..operators.sparse_index import build_index, search_index
from ..operators.slicing import clean_keywords, extract_constraints, parse_slices
from ..session import scratch_path, scratch_table
from ..sources.catalog import catalog_from_tables, read_catalog_csv
from ..sources.sinks import KeyedSink
from ..sources.store import space_vectors, store_stats, stored_catalog, stored_corpus, write_store
from ..sources.tables import read_table
from ..sources.vectors import corpus_stats, product_vectors, rejects_of, valid_vectors
from ..sources.vectors import vector_rejects as rejected_vectors
from .certified import certified_topk
from .fixtures import (DISPATCH_MODES, faulty_questions, faulty_vectors, mixed_mode_questions, mixed_parameter_questions, parity_questions, question_texts,
                       prose_constraints, slicing_responses)
from .retrieval import (candidate_pools, question_rejects, question_stats, resolved_mode, retrieve, route_questions, route_table,
                        with_defaults)
from .text_retrieval import search_texts, text_corpus

R = 6  # decimals of published scores


def _r(c: str, name: str | None = None):
    return F.round(F.col(c), R).alias(name or c)


# --------------------------------------------------------------------------- sources


def catalog_typed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 adapter: typed catalog (FLOAT price/rating) from part + lineitem."""
    return catalog_from_tables(spark, sf_dir)


def _catalog_csv(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The catalog written by Spark as CSV (extra column; empty, missing-word and bad prices) and ingested again."""
    cat = catalog_from_tables(spark, sf_dir)
    part = read_table(spark, sf_dir, "part", ["p_partkey", "p_size"])
    size = F.col("p_size")
    price_text = (F.when(size % 13 == 0, F.lit("")).when(size % 17 == 0, F.lit("n/a")).when(size % 19 == 0, F.lit("NaN"))
                  .when(size % 11 == 0, F.lit("NULL")).when(size % 23 == 0, F.lit("12d")).when(size % 7 == 0, F.lit("about 9"))
                  .otherwise(F.col("price").cast("double").cast("string")))
    out = (cat.join(part, cat.product_id == part.p_partkey)
           .select(size.cast("string").alias("junk"), "title", "store",
                   price_text.alias("price"), F.col("average_rating").cast("string").alias("average_rating"),
                   "image", F.col("product_id").cast("string").alias("product_key")))
    path = scratch_path(spark, "catalog-csv")
    out.write.option("header", True).option("escape", '"').mode("overwrite").csv(path)
    return read_catalog_csv(spark, path, id_col="product_key")


def catalog_csv_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV ingest by column name; missing-value words become NULL prices and the rows stay."""
    typed, _ = _catalog_csv(spark, sf_dir)
    return typed.select("product_id", "title", "store", "price", "average_rating", "image")


def catalog_csv_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the ingest leaves out, with the number as written and the reason."""
    _, rejects = _catalog_csv(spark, sf_dir)
    return rejects.select("product_id", "price", "reason")


def catalog_csv_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog CSV whose titles hold line ends, quotes and commas, one file read by blocks; ids are places in the file."""
    cat = catalog_from_tables(spark, sf_dir)
    title = F.concat("title", F.lit(", \n\""), "store", F.lit("\"\n"), "description")
    out = cat.select("product_id", F.lit("x").alias("junk"), title.alias("title"), "store", F.col("price").cast("double").cast("string").alias("price"),
                     F.col("average_rating").cast("string").alias("average_rating"), "image")
    path = scratch_path(spark, "catalog-split")
    out.coalesce(1).sortWithinPartitions("product_id").drop("product_id").write.option("header", True).option("escape", '"').csv(path)
    typed, _ = read_catalog_csv(spark, path, split=True)
    return typed.select("product_id", "title", "store", "price", "average_rating", "image")


def vector_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings that can't be searched and why."""
    return rejected_vectors(spark, sf_dir)


def faulty_vector_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings with faults put in, what of them can't be searched and why."""
    products = read_table(spark, sf_dir, "part", ["p_partkey"]).select(F.col("p_partkey").alias("vec_id"))
    return rejects_of(faulty_vectors(spark, sf_dir), products, EMBEDDING_DIM)


def vector_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mode routes with the number and dimension of the vectors in the sets that they search."""
    sets = F.array(*[F.struct(F.lit(name).alias("space"), F.size(F.slice("embedding", *at)).alias("dim")) for name, at in SPACE_SLICES.items()])
    long = valid_vectors(spark, sf_dir).select(F.explode(sets).alias("s")).select("s.*")
    stats = long.groupBy("space").agg(F.count(F.lit(1)).alias("n_vectors"), F.max("dim").alias("dim"))
    routes = route_table(spark).withColumnRenamed("route_mode", "model_choice")
    t = stats.select(F.col("space").alias("text_space"), F.col("n_vectors").alias("n_text_vectors"), F.col("dim").alias("text_dim"))
    i = stats.select(F.col("space").alias("image_space"), F.col("n_vectors").alias("n_image_vectors"), F.col("dim").alias("image_dim"))
    # A row per vector set on either side: five at most, so broadcast is safe.
    return routes.join(F.broadcast(t), "text_space").join(F.broadcast(i), "image_space", "left")


def l2_normalize_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4/V5: L2 normalisation of every vector in each space (and the full vector)."""
    emb = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    parts = {"text": F.slice("embedding", 1, 32), "image": F.slice("embedding", 33, 32), "full": F.col("embedding")}
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("space"), v.alias("v")) for n, v in parts.items()])).alias("s")
    sp = emb.select(F.col("vec_id").alias("product_id"), each).select("product_id", "s.space", "s.v")
    n = sp.withColumn("nb", l2_norm("v"))
    u = n.withColumn("u", l2_normalize("v", "nb"))
    return u.select("product_id", "space", _r("nb", "norm_before"),
                    F.round(l2_norm("u"), R).alias("norm_after"),
                    F.round(F.element_at("u", 1), R).alias("first_value"))


def text_encode_hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1-V3 stand-in: hashed bag-of-words of every whole document (sparse form)."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    w = sparse_weights(token_buckets(docs, "doc_id", "text"), "doc_id")
    return w.select("doc_id", "bucket", "tf", _r("weight"))


# --------------------------------------------------------------------------- retrieval


def _inputs(spark: SparkSession, sf_dir: str, modes: list[str] | None = None):
    return product_vectors(spark, sf_dir, modes), corpus_stats(spark, sf_dir, modes)


def _pool(spark: SparkSession, sf_dir: str, questions: DataFrame) -> DataFrame:
    corpus, stats = _inputs(spark, sf_dir, ["Clip-STrans"])
    routed = route_questions(questions)
    return candidate_pools(routed, corpus, qstats=question_stats(routed)[0], cstats=stats)


def topn_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text-space pool (top k*multiplier by text cosine) of every question."""
    p = _pool(spark, sf_dir, parity_questions(spark, sf_dir)).filter(F.col("text_rank").isNotNull())
    return p.select("query_id", "product_id", F.col("text_rank").cast("int").alias("rank"), _r("text_sim", "sim"))


def topn_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2: image-space pool of every question."""
    p = _pool(spark, sf_dir, parity_questions(spark, sf_dir)).filter(F.col("image_rank").isNotNull())
    return p.select("query_id", "product_id", F.col("image_rank").cast("int").alias("rank"), _r("image_sim", "sim"))


def candidate_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of both pools with membership flags."""
    p = _pool(spark, sf_dir, parity_questions(spark, sf_dir))
    return p.select("query_id", "product_id", F.col("text_rank").isNotNull().alias("in_text"),
                    F.col("image_rank").isNotNull().alias("in_image"))


def rescore_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both exact cosines of every candidate and the fused score."""
    p = fuse(_pool(spark, sf_dir, parity_questions(spark, sf_dir)))
    return p.select("query_id", "product_id", _r("text_sim"), _r("image_sim"), _r("score"))


def _ranked(spark: SparkSession, sf_dir: str, questions: DataFrame | None = None,
            catalog: DataFrame | None = None, modes: list[str] | None = None) -> DataFrame:
    questions = questions if questions is not None else parity_questions(spark, sf_dir)
    corpus, stats = _inputs(spark, sf_dir, modes or ["Clip-STrans"])
    return retrieve(questions, corpus, catalog, cstats=stats)


def hybrid_topk_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R8/R9/S4 (flagship): hybrid top-k of every product question, fetched from the catalog."""
    out = _ranked(spark, sf_dir, catalog=catalog_from_tables(spark, sf_dir))
    return out.select("query_id", "rank", "product_id", "title", "store", "price", "average_rating", "image", _r("score"))


def _store(spark: SparkSession, sf_dir: str):
    return write_store(space_vectors(spark, sf_dir), catalog_from_tables(spark, sf_dir))


def stored_topk_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship over stored tables; catalog and vectors are joined bucket by bucket."""
    store = _store(spark, sf_dir)
    q = parity_questions(spark, sf_dir)
    out = retrieve(q, stored_corpus(spark, store, modes=["Clip-STrans"]), stored_catalog(spark, store), cstats=store_stats(store, ["Clip-STrans"]))
    return out.select("query_id", "rank", "product_id", "title", "store", "price", "average_rating", "image", _r("score"))


def stored_mode_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``mode_dispatch`` over the stored vector sets, of which only those are read that the questions' modes name."""
    store = _store(spark, sf_dir)
    q = mixed_mode_questions(spark, sf_dir)
    modes = q.select("query_id", "model_choice", resolved_mode().alias("route_mode"))
    out = retrieve(q, stored_corpus(spark, store, modes), cstats=store_stats(store))
    return out.join(modes, "query_id").select("query_id", "model_choice", "route_mode", "rank", "product_id", _r("score"))


def stored_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored vector sets: rows, dimension and norms of every space."""
    rows = spark.table(_store(spark, sf_dir).vectors)
    return rows.groupBy("space").agg(F.count(F.lit(1)).alias("n_vectors"), F.max(F.size("embedding")).alias("dim"),
                                     F.round(F.min("norm"), R).alias("least_norm"), F.round(F.max("norm"), R).alias("greatest_norm"))


def text_only_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text-only mode: top k by text cosine, no over-fetch, no fusion."""
    q = parity_questions(spark, sf_dir, model_choice="Blip-Text")
    out = _ranked(spark, sf_dir, q, catalog_from_tables(spark, sf_dir, with_rating=False), ["Blip-Text"])
    return out.select("query_id", "rank", "product_id", "title", _r("text_sim"))


def mode_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One batch mixing all modes and an unknown one (falls back)."""
    q = mixed_mode_questions(spark, sf_dir)
    out = _ranked(spark, sf_dir, q, modes=list(MODE_SPACES))
    modes = q.select("query_id", "model_choice", resolved_mode().alias("route_mode"))
    return out.join(modes, "query_id").select("query_id", "model_choice", "route_mode", "rank", "product_id", _r("score"))


def mixed_parameter_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question with its own k, multiplier, alpha and mode, NULL settings taking the defaults."""
    q = mixed_parameter_questions(spark, sf_dir)
    out = _ranked(spark, sf_dir, q, modes=list(MODE_SPACES))
    k = with_defaults(q).select("query_id", "k")
    return out.join(k, "query_id").select("query_id", "k", "rank", "product_id", _r("score"))


def rejected_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions whose settings can't be run and why."""
    return question_rejects(faulty_questions(spark, sf_dir))


def alpha_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pools fused with every alpha of a grid; top k per (question, alpha)."""
    p = _pool(spark, sf_dir, parity_questions(spark, sf_dir))
    grid = F.explode(F.array(*[F.lit(float(a)) for a in ALPHA_GRID])).alias("alpha_g")
    swept = p.select("*", grid).drop("alpha").withColumnRenamed("alpha_g", "alpha")
    out = top_k(fuse(swept), PARITY_K, partition=("query_id", "alpha"))
    return out.select("query_id", "alpha", F.col("rank").cast("int").alias("rank"), "product_id", _r("score"))


def _cell_setup(spark: SparkSession, sf_dir: str):
    """The text-space corpus of the default mode as an index of cells, its questions (n = k), and the number of cells to probe,
    measured on 256 questions."""
    corpus = product_vectors(spark, sf_dir, ["Clip-STrans"]).select("product_id", F.col("tv").alias("vec"))
    index = build_cells(corpus)
    questions = parity_questions(spark, sf_dir).select("query_id", F.col("sbert").alias("vec"), "k")
    questions = scratch_table(spark, questions.withColumn("n", F.lit(PARITY_K)).drop("k"), "cell-questions")
    sample = scratch_table(spark, questions.orderBy(F.xxhash64("query_id"), "query_id").limit(256), "cell-sample")
    exact = search_cells(sample, index, len(index.centroids))  # all cells: the exact answer
    return index, questions, calibrated_probes(sample, index, scratch_table(spark, exact, "cell-exact"))


def cell_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1 approximated: every question's top k by text cosine among its nearest cells."""
    index, questions, nprobe = _cell_setup(spark, sf_dir)
    out = search_cells(questions, index, nprobe)
    return out.select("query_id", "product_id", F.col("rank").cast("int").alias("rank"), _r("sim"))


def cell_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of the exact top k (the first k rows of ``topn_text``) that ``cell_topk`` finds, over all questions, and the
    share of all vectors that a question is compared with."""
    index, questions, nprobe = _cell_setup(spark, sf_dir)
    exact = topn_text(spark, sf_dir).where(F.col("rank") <= PARITY_K).select("query_id", "product_id")
    found = search_cells(questions, index, nprobe).select("query_id", "product_id", F.lit(1).alias("hit"))
    hits = exact.join(found, ["query_id", "product_id"], "left").agg(F.count(F.lit(1)).alias("n_exact"), F.count("hit").alias("n_found"))
    return hits.select(F.lit(len(index.centroids)).alias("cells"), F.lit(nprobe).alias("probed"), "n_exact", "n_found", (F.col("n_found") / F.col("n_exact")).alias("recall"))


def _code_setup(spark: SparkSession, sf_dir: str):
    corpus = product_vectors(spark, sf_dir, ["Clip-STrans"]).select("product_id", F.col("tv").alias("vec"))
    questions = parity_questions(spark, sf_dir).select("query_id", F.col("sbert").alias("vec"), (F.col("k") * F.col("multiplier")).alias("n"))
    return build_codes(corpus), questions


def coded_topn_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text pool of every question by two phases, product-quantised codes and floats of the survivors; equal to ``topn_text``."""
    coded, questions = _code_setup(spark, sf_dir)
    return search_codes(questions, coded).select("query_id", "product_id", F.col("rank").cast("int").alias("rank"), _r("sim"))


def coded_search_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the first phase reads and leaves: bytes of all codes and of all floats, pairs of a question and a vector, and those whose
    floats are fetched."""
    coded, questions = _code_setup(spark, sf_dir)
    few = survivor_counts(questions, coded).where("n_rescored > 0").agg(F.coalesce(F.sum("n_rescored"), F.lit(0)).alias("n_rescored"), F.count(F.lit(1)).alias("n_questions"))
    return few.select("n_questions", F.lit(coded.rows).cast("bigint").alias("n_vectors"), F.lit(coded.code_bytes).cast("bigint").alias("code_bytes"),
                      F.lit(coded.rows * 4 * coded.dim).cast("bigint").alias("float_bytes"),
                      (F.col("n_questions") * F.lit(coded.rows)).cast("bigint").alias("n_pairs"), "n_rescored")


def certified_fused_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R7/R8 with R3: the true fused top k of every question, whatever the pools hold, and whether the pools of the application
    (their own k, multiplier, alpha and mode) give the same rows."""
    corpus, stats = _inputs(spark, sf_dir)
    tiles = scratch_table(spark, pack_corpus(corpus, dims=stats.dim_t + stats.dim_i), "certified-tiles")
    out = certified_topk(mixed_parameter_questions(spark, sf_dir), tiles, cstats=stats)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "product_id", _r("score"), "pool_is_exact")


# --------------------------------------------------------------------------- slicing and constraints


def _sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_slices(slicing_responses(spark, sf_dir))


def slice_response_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1: (constraints, keywords) from every response; failed calls stay NULL."""
    return _sliced(spark, sf_dir).select("query_id", "ok", "constraints", "keywords")


def keyword_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q2: keyword clean-up of every parsed response."""
    return clean_keywords(_sliced(spark, sf_dir)).select("query_id", "keywords", "keywords_norm")


def constraint_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q3: typed constraints (field, op, value) from the constraint text."""
    return extract_constraints(_sliced(spark, sf_dir))


def constraint_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q3: ranges, suffixes, negations and units in constraint texts, by the transducer."""
    return grammar_constraints(prose_constraints(spark, sf_dir)).select("query_id", "pos", "field", "op", "value")


def _survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _ranked(spark, sf_dir, catalog=catalog_from_tables(spark, sf_dir))
    return post_filter(out, extract_constraints(_sliced(spark, sf_dir)))


def constraint_filter_post(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q4: ranked products that satisfy all constraints of their question."""
    return _survivors(spark, sf_dir).select("query_id", "rank", "product_id", "price", "average_rating")


def recommend_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most three recommendations per question after the post-filter."""
    rec = recommend(_survivors(spark, sf_dir))
    return rec.select("query_id", F.col("rec_rank").cast("int").alias("rec_rank"), "product_id", "title",
                      "price", "average_rating", "image")


def recommendation_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q6: proposals (top 3 by image similarity alone) checked against the retrieved list."""
    # the proposals are rows of the pool, so their place in the ranking tells whether they were retrieved
    pool = ranked(fuse(_pool(spark, sf_dir, parity_questions(spark, sf_dir))))
    return pool.filter(F.col("image_rank") <= 3).select("query_id", "product_id", (F.col("rank") <= F.col("k")).alias("allowed"))


# --------------------------------------------------------------------------- prompts and reports


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_blocks(_ranked(spark, sf_dir, catalog=catalog_from_tables(spark, sf_dir)))


def product_block_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight-line product block of every retrieved product."""
    return _blocks(spark, sf_dir).select("query_id", "rank", "product_id", "block")


def context_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks joined in rank order per question."""
    return assemble_context(_blocks(spark, sf_dir))


Retriever = Callable[[DataFrame], DataFrame]


def rag_requests(sliced: DataFrame, retriever: Retriever, catalog: DataFrame) -> DataFrame:
    """What a language model is asked about every question that was sliced.

    sliced: ``query_id, query, constraints, keywords``. ``retriever`` takes ``query_id, text`` and returns
    ``query_id, rank, product_id``; the keywords are what it searches. Adds ``n_products`` and ``context``.
    """
    found = scratch_table(sliced.sparkSession, retriever(sliced.select("query_id", F.col("keywords").alias("text"))), "rag-found")
    # texts made from a small, well packed file look small to the planner: never broadcast, both sides grow with the questions
    return sliced.hint("merge").join(assemble_context(blocks_of(found, catalog)), "query_id")


def hashed_retriever(spark: SparkSession, sf_dir: str) -> Retriever:
    """Text questions against the catalog text through the hashing encoder."""
    return lambda questions: _hashed_search(spark, sf_dir, questions)


def _answerable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions whose slicing call succeeded and gave something to search (an empty question is never run)."""
    return _sliced(spark, sf_dir).filter(F.col("ok") & (F.length("keywords") > 0))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rag_requests(_answerable(spark, sf_dir), hashed_retriever(spark, sf_dir), catalog_from_tables(spark, sf_dir))


def prompt_messages_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slicing messages of every question as JSON, and answer messages of those that can be answered
    (chat variant)."""
    asked = _sliced(spark, sf_dir).select("query_id", "query")
    answers = _requests(spark, sf_dir).select("query_id", "constraints", "context")
    both = asked.hint("merge").join(answers, "query_id", "left")
    answer = answer_messages(F.col("query"), F.col("constraints"), F.col("context"))
    return both.select("query_id", slicing_messages(F.col("query")).alias("slicing_json"),
                       F.when(F.col("context").isNotNull(), answer).alias("answer_json"))


def agent_messages_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: the agent's slicing request of every question, as ``json.dumps`` text."""
    texts = question_texts(spark, sf_dir)
    return texts.select("query_id", agent_slicing_request(F.col("query")).alias("slicing_request"))


def result_card_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result card text of every retrieved product."""
    out = _ranked(spark, sf_dir, catalog=catalog_from_tables(spark, sf_dir))
    return out.select("query_id", "rank", result_card(out).alias("card"))


def response_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response envelopes parsed from JSON; counts by call status (failed rows unparsed)."""
    resp = slicing_responses(spark, sf_dir)
    env = F.to_json(F.named_struct(F.lit("output"), F.named_struct(F.lit("message"), F.named_struct(
        F.lit("content"), F.array(F.named_struct(F.lit("text"), F.col("body")))))))
    raw = resp.select("query_id", "ok", F.when(F.col("ok"), env).otherwise(F.col("body")).alias("raw"))
    parsed = raw.select("query_id", "ok", F.when(F.col("ok"), F.get_json_object(
        "raw", "$.output.message.content[0].text")).alias("body"))
    sliced = parse_slices(parsed)
    return sliced.groupBy("ok").agg(
        F.count(F.lit(1)).alias("n_responses"),
        F.count("body").alias("n_parsed"),
        F.sum(F.when(F.length("keywords") > 0, 1).otherwise(0)).cast("bigint").alias("n_with_keywords"),
        F.sum(F.when(F.length("constraints") > 0, 1).otherwise(0)).cast("bigint").alias("n_with_constraints"),
    )


def _hashed_search(spark: SparkSession, sf_dir: str, questions: DataFrame) -> DataFrame:
    """Text questions ``(query_id, text)`` against the catalog text (title, description,
    store), both through the hashing encoder; exact cosine top-k on the tiled kNN join.
    Every distinct text is searched once, for the least id that asks it."""
    asked = scratch_table(spark, questions.select("query_id", F.coalesce("text", F.lit("")).alias("text")), "hashed-questions")
    distinct = scratch_table(spark, asked.groupBy("text").agg(F.min("query_id").alias("rep")), "hashed-distinct")
    part = read_table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_type", "p_brand"])
    ctext = part.select(F.col("p_partkey").alias("product_id"),
                        F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("text"))
    qv = dense_counts(token_buckets(distinct, "rep", "text"), "rep", HASH_DIM, distinct)
    cv = dense_counts(token_buckets(ctext, "product_id", "text"), "product_id", HASH_DIM, ctext)
    q = qv.select(F.lit("hash").alias("group_key"), F.col("rep").alias("query_id"), F.lit(PARITY_K).alias("n_text"),
                  F.lit(0).alias("n_image"), F.lit(PARITY_K).alias("k"), F.lit(1.0).alias("alpha"),
                  F.col("vec").alias("qt"), F.lit(None).cast("array<float>").alias("qi"))
    c = cv.select(F.lit("hash").alias("group_key"), "product_id", F.col("vec").alias("tv"),
                  F.lit(None).cast("array<float>").alias("iv"))
    cands = hybrid_candidates(q, c, TileConfig(pool_hint=PARITY_K), qstats=SideStats(distinct.count(), HASH_DIM, 0),
                              cstats=SideStats(part.count(), HASH_DIM, 0))
    found = top_k(fuse(pools(cands)), PARITY_K).select(F.col("query_id").alias("rep"), F.col("rank").cast("int").alias("rank"), "product_id", "score")
    return asked.join(distinct, "text").select("query_id", "rep").join(found, "rep").drop("rep")


def hashed_text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1 over the hashing encoder: free-text questions against catalog text, exact cosine."""
    bench = read_table(spark, sf_dir, "benchmark", ["item_id", "text"])
    out = _hashed_search(spark, sf_dir, bench.select(F.col("item_id").alias("query_id"), "text"))
    return out.select("query_id", "rank", "product_id", _r("score"))


def sparse_text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1 on sparse vectors: the keywords of every answerable question and every benchmark text (ids below 0) against the catalog
    text by token counts, exact cosine top k over an inverted index with upper bounds."""
    part = read_table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_type", "p_brand"])
    products = part.select(F.col("p_partkey").alias("product_id"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("text"))
    bench = read_table(spark, sf_dir, "benchmark", ["item_id", "text"]).select((-F.col("item_id") - 1).alias("query_id"), "text")
    asked = _answerable(spark, sf_dir).select("query_id", F.col("keywords").alias("text")).unionByName(bench)
    out = search_index(asked.withColumn("n", F.lit(PARITY_K)), build_index(products))
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "product_id", _r("score"))


def keyword_rag_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliced keywords -> retriever -> catalog fetch -> blocks -> context -> answer messages (chat variant)."""
    return _requests(spark, sf_dir).select(
        "query_id", "keywords", "n_products",
        answer_messages(F.col("query"), F.col("constraints"), F.col("context")).alias("answer_json"))


def _text_setup(spark: SparkSession, sf_dir: str, modes: list[str]) -> tuple[DataFrame, dict]:
    """Corpus of the modes' vector sets encoded from the catalog's texts, and the encoders."""
    encoders = {name: hashing_encoder(name, dim) for name, dim in TEXT_ENCODERS.items()}
    return text_corpus(catalog_from_tables(spark, sf_dir, with_rating=False), TEXT_SPACES, encoders, modes), encoders


def hybrid_retriever(spark: SparkSession, sf_dir: str, mode: str = DEFAULT_MODE, **settings) -> Retriever:
    """Text questions against the catalog through a mode's pair of vector sets (k, alpha, multiplier: the defaults, or ``settings``)."""
    corpus, encoders = _text_setup(spark, sf_dir, [mode])

    def search(questions: DataFrame) -> DataFrame:
        for name, value in {"model_choice": mode, **settings}.items():
            questions = questions.withColumn(name, F.lit(value))
        return search_texts(questions, corpus, encoders).select("query_id", "rank", "product_id", "score")

    return search


def text_mode_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sliced keywords of every question as a text question, with a mode by ``query_id % 5`` (one of them unknown);
    every distinct question is encoded and searched once."""
    modes = F.array(*[F.lit(m) for m in DISPATCH_MODES])
    asked = _answerable(spark, sf_dir).select(
        "query_id", F.col("keywords").alias("text"), F.element_at(modes, F.pmod(F.col("query_id"), F.lit(len(DISPATCH_MODES))).cast("int") + 1).alias("model_choice"),
        F.lit(PARITY_K).alias("k"), F.lit(PARITY_ALPHA).alias("alpha"), F.lit(PARITY_MULTIPLIER).alias("multiplier"))
    asked = scratch_table(spark, asked, "mode-questions")
    corpus, encoders = _text_setup(spark, sf_dir, list(MODE_SPACES))
    out = search_texts(asked, corpus, encoders).join(asked.select("query_id", "model_choice"), "query_id")
    return out.select("query_id", "model_choice", resolved_mode().alias("route_mode"), "rank", "product_id", _r("text_sim"), _r("image_sim"), _r("score"))


def rag_prompt_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question -> slice (Q1) -> hybrid retrieval of the keywords by the application's defaults (R9) -> products that meet
    the question's constraints (Q4) -> blocks and context (P1, P2) -> request body of the agent's call (P3-P5): its
    messages as ``json.dumps`` text, wrapped as one user turn. A question none of whose products meets its constraints
    has an empty context."""
    sliced = scratch_table(spark, _answerable(spark, sf_dir), "sliced")
    catalog = scratch_table(spark, catalog_from_tables(spark, sf_dir), "rag-catalog")
    found = hybrid_retriever(spark, sf_dir)(sliced.select("query_id", F.col("keywords").alias("text")))
    met = post_filter(found.join(catalog.select("product_id", "price", "average_rating"), "product_id"), extract_constraints(sliced))
    kept = scratch_table(spark, met.select("query_id", "rank", "product_id"), "rag-kept")
    both = sliced.hint("merge").join(assemble_context(blocks_of(kept, catalog)), "query_id", "left")
    request = agent_answer_request(F.col("query"), F.col("constraints"), F.col("context"))
    body = F.to_json(F.array(F.named_struct(F.lit("role"), F.lit("user"), F.lit("content"),
                                            F.array(F.named_struct(F.lit("text"), request)))))
    return both.select("query_id", "constraints", "keywords", F.coalesce("n_products", F.lit(0)).cast("bigint").alias("n_products"), body.alias("request_json"))


def stream_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions arrive as a file stream (several micro-batches); each batch
    is answered by the batch plan. Questions mix k, multiplier, alpha and modes."""
    from ..streaming.retrieval_stream import answer_stream, read_answers

    base = scratch_path(spark, "stream")
    questions = mixed_parameter_questions(spark, sf_dir)
    # Spark writes the question files (4 files -> 4 micro-batches).
    questions.repartition(4, "query_id").write.parquet(f"{base}/source")
    corpus, stats = _inputs(spark, sf_dir)
    # packed tiles and the catalog are made once, micro-batches read them
    tiles = scratch_table(spark, pack_corpus(corpus, dims=stats.dim_t + stats.dim_i), "stream-tiles")
    catalog = scratch_table(spark, catalog_from_tables(spark, sf_dir), "stream-catalog")
    answer_stream(spark, f"{base}/source", questions.schema, f"{base}/sink", f"{base}/checkpoint",
                  tiles, catalog, retrieve_kwargs={"cstats": stats})
    out = read_answers(spark, f"{base}/sink")
    return out.select("query_id", "rank", "product_id", "title", "store", "price",
                      "average_rating", "image", _r("score"))


def stream_answer_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 with state: every question comes three times, in the same and in later micro-batches, and is answered once."""
    from ..streaming.retrieval_stream import answer_stream, read_answers

    base = scratch_path(spark, "stream-once")
    questions = mixed_parameter_questions(spark, sf_dir)
    questions.repartition(2, "query_id").write.parquet(f"{base}/source")
    questions.unionByName(questions).coalesce(1).write.mode("append").parquet(f"{base}/source")
    corpus, stats = _inputs(spark, sf_dir)
    tiles = scratch_table(spark, pack_corpus(corpus, dims=stats.dim_t + stats.dim_i), "once-tiles")
    catalog = scratch_table(spark, catalog_from_tables(spark, sf_dir), "once-catalog")
    answer_stream(spark, f"{base}/source", questions.schema, f"{base}/sink", f"{base}/checkpoint", tiles, catalog,
                  retrieve_kwargs={"cstats": stats}, once_within="1 day")
    return read_answers(spark, f"{base}/sink").select("query_id", "rank", "product_id", "title", "store", "price", "average_rating", "image", _r("score"))


def answers_written_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship's answers in a keyed sink, half of the questions written again, as they are read back."""
    sink = KeyedSink(scratch_path(spark, "answers"))
    answers = scratch_table(spark, hybrid_topk_fetch(spark, sf_dir), "answers")
    sink.write(answers)
    sink.write(answers.where("query_id % 2 = 0"))
    return sink.read(spark)


def prompts_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The finished prompts as JSON lines in a keyed sink, written twice, as they are read back."""
    sink = KeyedSink(scratch_path(spark, "prompts"), unique=(), format="json")
    prompts = scratch_table(spark, rag_prompt_end_to_end(spark, sf_dir), "prompts")
    sink.write(prompts)
    sink.write(prompts)
    return sink.read(spark)


QUERIES = {
    "catalog_typed_scan": catalog_typed_scan,
    "catalog_csv_ingest": catalog_csv_ingest,
    "catalog_csv_rejects": catalog_csv_rejects,
    "catalog_csv_split": catalog_csv_split,
    "vector_rejects": vector_rejects,
    "faulty_vector_rejects": faulty_vector_rejects,
    "vector_route": vector_route,
    "l2_normalize": l2_normalize_query,
    "text_encode_hashed": text_encode_hashed,
    "topn_text": topn_text,
    "topn_image": topn_image,
    "certified_fused_topk": certified_fused_topk,
    "coded_topn_text": coded_topn_text,
    "coded_search_report": coded_search_report,
    "cell_topk": cell_topk,
    "cell_recall": cell_recall,
    "candidate_union": candidate_union,
    "rescore_fusion": rescore_fusion,
    "hybrid_topk_fetch": hybrid_topk_fetch,
    "stored_topk_fetch": stored_topk_fetch,
    "stored_mode_dispatch": stored_mode_dispatch,
    "stored_vectors": stored_vectors,
    "text_only_topk": text_only_topk,
    "mode_dispatch": mode_dispatch,
    "mixed_parameter_topk": mixed_parameter_topk,
    "question_rejects": rejected_questions,
    "alpha_sweep": alpha_sweep,
    "slice_response_parse": slice_response_parse,
    "keyword_normalize": keyword_normalize,
    "constraint_extract": constraint_extract,
    "constraint_grammar": constraint_grammar,
    "constraint_filter_post": constraint_filter_post,
    "recommend_top3": recommend_top3,
    "recommendation_guard": recommendation_guard,
    "product_block_format": product_block_format,
    "context_assemble": context_assemble,
    "prompt_messages_json": prompt_messages_json,
    "agent_messages_json": agent_messages_json,
    "result_card_format": result_card_format,
    "response_status": response_status,
    "hashed_text_search": hashed_text_search,
    "text_mode_topk": text_mode_topk,
    "sparse_text_search": sparse_text_search,
    "rag_prompt_end_to_end": rag_prompt_end_to_end,
    "keyword_rag_prompt": keyword_rag_prompt,
    "stream_retrieval": stream_retrieval,
    "stream_answer_once": stream_answer_once,
    "answers_written_twice": answers_written_twice,
    "prompts_written": prompts_written,
}
