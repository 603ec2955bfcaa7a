"""Named queries over the test tables, and the SQL that each is checked against."""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragtide.functions import text as X
from ragtide.operators import batch, inspection, reporting
from ragtide.operators import defenses as D
from ragtide.operators import diagnostics as G
from ragtide.operators import metrics as M
from ragtide.operators import mlfilter, providers, retrieval, shred, sweeps, transforms
from ragtide.operators import pairs as P
from ragtide.operators import passages as S
from ragtide.plans import oracles as O
from ragtide.sources.discovery import rounded_join
from ragtide.sources.tables import durable, table
from ragtide.streaming import summaries

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
BETAS = [0.0, 0.25, 0.5, 0.75, 1.0]
ALPHAS = [1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3]
EPSILONS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8, 1.0]
TEMPLATE = "Answer from the contexts.\n\nContexts: [context] \n\nQuery: [question] \n\nAnswer:"
RULES = {
    "pp_weakened": "top_pair_pp < base_top_pair_pp", "pc_appeared": "top_pair_pc > base_top_pair_pc", "fewer_poison": "removed_poison < base_removed_poison", "first_residual": "removed_poison < n_poison",
    "label_changed": "label <> base_label", "clean_increased": "removed_clean > base_removed_clean",
}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name; integers come out as bigint and doubles at six decimals, as in its SQL."""

    def add(f: Query) -> Query:
        def run(spark: SparkSession, d: str) -> DataFrame:
            df = f(spark, d)
            return df.select(*[(F.round(c, 6) + 0.0).alias(c) if t in ("double", "float") else F.col(c).cast("bigint").alias(c) if t in ("int", "smallint") else F.col(c) for c, t in df.dtypes])

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql.replace(", 6) AS ", ", 6) + 0.0 AS ")  # no negative zero on either side
        return f

    return add


# -- nested result files


def _files(spark: SparkSession, d: str, fields: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    return shred.result_tables(table(spark, d, "result_files"), "file_id", "body", list(fields))


@query(O.NESTED)
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d)["texts"].select("file_id", "iter_name", "rec_pos", "id", "adv_pos")


@query(O.NESTED_ITERATIONS)
def p1_iterations(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d)["iterations"].drop("tree", "iter_pos")


@query(O.NESTED_RECORDS)
def p1_records(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d, O.RECORD_FIELDS)["records"].drop("tree", "iter_pos")


@query(O.NESTED_TEXTS)
def p1_texts(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d)["texts"].drop("tree", "iter_pos")


@query(O.REJECTS)
def p1_rejects(spark: SparkSession, d: str) -> DataFrame:
    """Bodies that yield nothing, with the reason."""
    return _files(spark, d)["rejects"].drop("tree")


# -- retrieval


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "embedding")


def _top(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    """Retrieved passages, written once: k rows a query, which everything behind reads several times."""
    return durable(retrieval.merged_top_k(_vectors(spark, d), k))


def _search(spark: SparkSession, d: str, metric: str) -> DataFrame:
    v = _vectors(spark, d)
    queries = v.where(F.col("vec_id") % 50 == 0).withColumnRenamed("vec_id", "query_id")
    return retrieval.top_k(queries, v.withColumnRenamed("vec_id", "doc_id"), 10, metric, skip_self=True)


@query(O.search("list_cosine_similarity"))
def topk_cosine(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, "cosine")


@query(O.search("list_dot_product"))
def topk_dot(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, "dot")


@query(O.MERGED)
def merge_injected_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.merged_top_k(_vectors(spark, d), 10).select("query_id", "doc_id", "source", "is_poison", "own", "score", "rank")


@query(O.PREFIX_GRID)
def prefix_k_grid(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.prefix_grid(retrieval.merged_top_k(_vectors(spark, d), 20), [5, 10, 20])


@query(O.RETRIEVAL_PRF)
def retrieval_prf1(spark: SparkSession, d: str) -> DataFrame:
    return M.retrieval_prf(retrieval.prefix_grid(retrieval.merged_top_k(_vectors(spark, d), 10), [10]), 10, 5)


# -- pairs and removals

Q = ["query_id"]


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return durable(P.pair_table(_top(spark, d), Q))


def _defended(spark: SparkSession, d: str) -> DataFrame:
    """Flags of every filter that needs vectors and labels only, stacked."""
    return D.flag_all(_top(spark, d), Q).select(*Q, "doc_id", "is_poison", "rank", "removed", "defense")


@query(O.NEAREST)
def nearest_neighbor(spark: SparkSession, d: str) -> DataFrame:
    return P.neighbours(_pairs(spark, d), Q).select("query_id", "i", "pi", "neighbour", "neighbour_poison", "sim")


@query(O.NN_ENTROPY)
def nn_entropy(spark: SparkSession, d: str) -> DataFrame:
    return P.neighbour_entropy(_pairs(spark, d), Q)


@query(O.PAIR_CLASS)
def pair_class_stats(spark: SparkSession, d: str) -> DataFrame:
    return P.class_stats(_pairs(spark, d), Q)


@query(O.CONCENTRATION)
def concentration_stage1(spark: SparkSession, d: str) -> DataFrame:
    return P.concentration(_pairs(spark, d), Q)


@query(O.PAIR_FREQUENCY)
def pairfreq_removal(spark: SparkSession, d: str) -> DataFrame:
    return D.concentration_defense(_top(spark, d), Q).select("query_id", "doc_id", "rank", "is_poison", "pair_score", "removed")


@query(O.PAIR_MIX)
def top_pair_mix(spark: SparkSession, d: str) -> DataFrame:
    pairs = _pairs(spark, d)
    return P.pair_mix(P.top_pairs(pairs, Q, P.concentration(pairs, Q)), Q)


@query(O.RECORD)
def diag_record(spark: SparkSession, d: str) -> DataFrame:
    got = G.record(_defended(spark, d), [*Q, "defense"])
    lists = {c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("retrieved_doc_ids", "retrieved_is_poison", "removed_doc_ids", "removed_is_poison")}
    return got.withColumns(lists).withColumn("label", G.decision(F.col("removed_poison"), F.col("removed_clean"), F.col("n_retrieved_poison")))


@query(O.POOLED)
def pooled_metrics(spark: SparkSession, d: str) -> DataFrame:
    return G.pooled(G.record(_defended(spark, d), [*Q, "defense"]), ["defense"])


@query(O.KEPT)
def kept_and_removed(spark: SparkSession, d: str) -> DataFrame:
    """Passages kept (semi join) and removed (anti join) by the concentration defense, as one list."""
    passages = _top(spark, d)
    top, kept = passages.select("query_id", "doc_id"), durable(D.concentration_defense(passages, Q).where("not removed").select("query_id", "doc_id"))
    return top.join(kept, ["query_id", "doc_id"], "left_semi").withColumn("side", F.lit("kept")).unionByName(top.join(kept, ["query_id", "doc_id"], "left_anti").withColumn("side", F.lit("removed")))


@query(O.CORAL)
def coral_distance(spark: SparkSession, d: str) -> DataFrame:
    return P.coral_distance(_pairs(spark, d), Q)


@query(O.MMD)
def mmd_rbf(spark: SparkSession, d: str) -> DataFrame:
    return P.mmd_rbf(_pairs(spark, d), Q)


@query(O.PRESERVATION)
def preservation_metrics(spark: SparkSession, d: str) -> DataFrame:
    return P.preservation(P.centroid_sweep(_top(spark, d), Q, [1.0, 0.7, 0.3]), [*Q, "alpha"])


# -- sweeps

QA = ["query_id", "alpha"]


def _sweep(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    """For each query and alpha of the centroid sweep: the pair mix, removals, label and distances."""
    return _sweep_rows(P.centroid_sweep(_top(spark, d, k), Q, ALPHAS), QA)


def _sweep_rows(moved: DataFrame, keys: list[str]) -> DataFrame:
    """What the concentration defense does to every set of moved vectors, and how far apart its sides are."""
    moved = durable(moved)
    pairs = durable(P.pair_table(moved, keys))
    estimates = durable(P.concentration(pairs, keys))
    flagged = P.pair_frequency_removal(moved, pairs, estimates, keys)
    rec = G.record(flagged, keys).select(*keys, F.col("n_retrieved_poison").alias("n_poison"), "removed_poison", "removed_clean", "residual_poison_fraction")
    rec = rec.withColumn("label", G.decision(F.col("removed_poison"), F.col("removed_clean"), F.col("n_poison")))
    mix = P.pair_mix(P.top_pairs(pairs, keys, estimates), keys)
    apart = P.mmd_rbf(pairs, keys).join(P.coral_distance(pairs, keys), keys)
    return durable(rec.join(mix, keys, "left").join(apart, keys, "left").join(P.class_stats(pairs, keys).select(*keys, "mean_pp"), keys, "left"))


@query(O.SWEEP_ROWS)
def e0_centroid_sweep(spark: SparkSession, d: str) -> DataFrame:
    return _sweep(spark, d)


def _triggers(spark: SparkSession, d: str) -> DataFrame:
    plain = _sweep(spark, d).select(*QA, "n_poison", "removed_poison", "removed_clean", "label", "top_pair_pp", "top_pair_pc")
    return sweeps.triggers_down(plain, Q, "alpha", RULES)


@query(O.TRIGGERS)
def trigger_alpha(spark: SparkSession, d: str) -> DataFrame:
    return _triggers(spark, d)


def _long_triggers(df: DataFrame) -> DataFrame:
    return df.select("query_id", F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("alpha")) for n in RULES])).alias("x")).select("query_id", "x.rule", "x.alpha")


@query(O.ANY_ALL)
def any_all_counts(spark: SparkSession, d: str) -> DataFrame:
    return sweeps.any_all(_long_triggers(_triggers(spark, d)), "query_id", "alpha", [0.9, 0.7, 0.5, 0.3], len(RULES))


@query(O.WINNERS)
def winner_ties(spark: SparkSession, d: str) -> DataFrame:
    return sweeps.winners(_long_triggers(_triggers(spark, d)), "query_id", "rule", "alpha")


@query(O.LEADING)
def leading_indicator(spark: SparkSession, d: str) -> DataFrame:
    return sweeps.leading_summary(_triggers(spark, d), "pp_weakened", "first_residual")


@query(O.PEARSON)
def pearson_by_group(spark: SparkSession, d: str) -> DataFrame:
    return M.pearson(_sweep(spark, d), Q, "alpha", "mmd")


@query(O.COMPARE)
def method_compare(spark: SparkSession, d: str) -> DataFrame:
    """Retrieved sets of 5 and of 10 as two methods over the same sweep."""
    rows = [_sweep(spark, d, k).select(F.lit(f"top_{k}").alias("method"), "query_id", (1 - F.col("alpha")).alias("strength"), (F.col("removed_poison") < F.col("n_poison")).alias("failed"), F.col("mmd").alias("value")) for k in (5, 10)]
    return sweeps.compare_methods(rows[0].unionByName(rows[1]))


@query(O.FIRST_UP)
def first_residual_strength(spark: SparkSession, d: str) -> DataFrame:
    """The least strength of the centroid sweep at which poison stays, going up; null if never."""
    rows = _sweep(spark, d).withColumn("strength", F.round(1 - F.col("alpha"), 9))
    return sweeps.first_up(rows, Q, "strength", "removed_poison < n_poison", "first_residual")


@query(O.PRESERVED)
def preserved_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Preservation joined with the sweep's labels on an alpha that was computed in another way, so on its rounded value."""
    kept = P.preservation(P.centroid_sweep(_top(spark, d), Q, [1 - x for x in (0.0, 0.3, 0.7)]), QA)
    return rounded_join(kept.withColumn("alpha", F.col("alpha") * 1.0), _sweep(spark, d).select(*QA, "label", "removed_poison"), Q, "alpha").withColumn("alpha", F.round("alpha", 6))


def _summary_e0(spark: SparkSession, d: str) -> DataFrame:
    return batch.extended_summary(_sweep(spark, d), Q)


@query(O.EXTENDED)
def extended_summary(spark: SparkSession, d: str) -> DataFrame:
    return _summary_e0(spark, d)


@query(O.DECREASE)
def batch_decrease(spark: SparkSession, d: str) -> DataFrame:
    return batch.decrease(_summary_e0(spark, d))


@query(O.INDICATORS)
def batch_indicators(spark: SparkSession, d: str) -> DataFrame:
    return batch.indicators(_summary_e0(spark, d))


@query(O.VERDICT)
def batch_verdict(spark: SparkSession, d: str) -> DataFrame:
    rows = durable(_summary_e0(spark, d))
    return batch.verdict(batch.decrease(rows), batch.indicators(rows))


def _summary_e1(spark: SparkSession, d: str) -> DataFrame:
    """The extended summary of each query and anchor strategy."""
    keys = [*Q, "strategy", "alpha"]
    moved = transforms.by_group(_top(spark, d), Q, list(product(transforms.STRATEGIES, ALPHAS)), lambda p, c, strategy, alpha: transforms.anchor_interpolate(p, c, alpha, strategy), ("strategy", "alpha"))
    return batch.extended_summary(_sweep_rows(moved, keys), [*Q, "strategy"])


@query()
def e1_summary(spark: SparkSession, d: str) -> DataFrame:
    return _summary_e1(spark, d)


@query()
def e1_movers(spark: SparkSession, d: str) -> DataFrame:
    return batch.movers(_summary_e1(spark, d), "query_id", "strategy")


@query()
def e1_any_all(spark: SparkSession, d: str) -> DataFrame:
    """How many queries keep poison under some, and under all four, of the anchor strategies."""
    return sweeps.any_all(_summary_e1(spark, d), "query_id", "first_residual", [0.7, 0.5, 0.3], len(transforms.STRATEGIES))


# -- passages and stages


def _judged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Flagged passages, their pairs and estimates."""
    top = _top(spark, d)
    pairs = durable(P.pair_table(top, Q))
    estimates = durable(P.concentration(pairs, Q))
    return durable(P.pair_frequency_removal(top, pairs, estimates, Q)), pairs, estimates


@query(O.PASSAGE_ROWS)
def passage_rows(spark: SparkSession, d: str) -> DataFrame:
    return inspection.passage_rows(*_judged(spark, d), Q).drop("text_preview")


@query()
def passage_rows_pca(spark: SparkSession, d: str) -> DataFrame:
    flagged, pairs, estimates = _judged(spark, d)
    return inspection.passage_rows(flagged, pairs, estimates, Q, transforms.pca_coordinates(flagged, Q))


@query(O.STAGE1)
def stage1_rows(spark: SparkSession, d: str) -> DataFrame:
    """Against the number of own injected passages as what was recorded."""
    flagged, pairs, estimates = _judged(spark, d)
    return inspection.stage1_rows(pairs, estimates, Q, flagged.groupBy(*Q).agg(F.count_if("own").alias("n_adv_recorded")))


@query(O.STAGE2)
def stage2_rows(spark: SparkSession, d: str) -> DataFrame:
    """Against the random removal of as many as what was recorded."""
    flagged, pairs, estimates = _judged(spark, d)
    return inspection.stage2_rows(flagged, pairs, estimates, Q, D.random_same_count(flagged, estimates, Q).select(*Q, "rank", "removed"))


@query(O.MATRIX)
def matrix_rows(spark: SparkSession, d: str) -> DataFrame:
    flagged, pairs, _ = _judged(spark, d)
    return inspection.matrix_rows(flagged, pairs, Q)


# -- text and matching


@query(O.CLEAN)
def clean_str(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "records").select("record_id", X.clean(F.col("answer")).alias("answer"), X.clean(F.col("incorrect_answer")).alias("incorrect_answer"))


@query(O.ASR)
def asr_match(spark: SparkSession, d: str) -> DataFrame:
    """Legacy and strict matches of the wrong answer in both outputs."""
    r = table(spark, d, "records").select("record_id", "incorrect_answer", "output_poison", "output_poison_no_defense")
    t = F.col("incorrect_answer")
    return r.select("record_id", *[f(t, F.col(c)).alias(f"{n}_{c}") for c in ("output_poison", "output_poison_no_defense") for n, f in (("legacy", X.legacy_match), ("strict", X.strict_match))])


@query(O.ASR_RUN)
def asr_by_run(spark: SparkSession, d: str) -> DataFrame:
    """Attack success of each run over the records with an output, and mean and population deviation over the runs of a dataset."""
    r = table(spark, d, "records").where("output_poison is not null").select("run_id", X.legacy_match(F.col("incorrect_answer"), F.col("output_poison")).alias("hit"))
    per = r.groupBy("run_id").agg(F.count("*").alias("n"), F.avg(F.coalesce(F.col("hit"), F.lit(False)).cast("int")).alias("asr"))
    runs = table(spark, d, "runs").select("run_id", "dataset", "defense")
    return runs.join(per, "run_id").groupBy("dataset", "defense").agg(F.sum("n").alias("n"), F.avg("asr").alias("mean_asr"), F.stddev_pop("asr").alias("sd_asr"))


@query(O.EM_F1)
def squad_em_f1(spark: SparkSession, d: str) -> DataFrame:
    return M.exact_and_f1(table(spark, d, "records"), "record_id", "output_poison", "answer")


@query(O.BEST_F1)
def squad_best_f1(spark: SparkSession, d: str) -> DataFrame:
    """The best of two golds: the right and the planted answer."""
    return M.exact_and_f1(table(spark, d, "records").withColumn("golds", F.array("answer", "incorrect_answer")), "record_id", "output_poison", "golds")


SCORE_FIELDS = ["record_id", "dataset", "k", "query_id", "rank", "doc_id", "is_poison", "retrieval_score", "filterrag_score", "query_only_score", "slm_answer", "answer_token_overlap_score"]


@query(O.ASR_ITERATION)
def asr_by_iteration(spark: SparkSession, d: str) -> DataFrame:
    return M.success_by_iteration(table(spark, d, "records"), "run_id", "iter_name", "incorrect_answer", "output_poison")


@query(O.ASR_BOTH)
def asr_both_sides(spark: SparkSession, d: str) -> DataFrame:
    return M.success_by_run(table(spark, d, "records"), "run_id", "incorrect_answer", "output_poison", "output_poison_no_defense")


@query(O.TEMPLATED)
def templated_injection(spark: SparkSession, d: str) -> DataFrame:
    """The first three planted texts of each target as they are injected."""
    return table(spark, d, "targets").select("id", F.posexplode(X.injected_texts(F.col("question"), F.col("adv_texts"), 3)).alias("place", "text")).select("id", "place", F.md5("text").alias("text_md5"))


def _passages(spark: SparkSession, d: str, *fields: str) -> DataFrame:
    """Distinct score rows: their natural key (record_id, rank) and ``fields``, all by default. Repeats are exact, so fewer fields give the same rows."""
    names = dict.fromkeys(("record_id", "rank", *fields)) if fields else SCORE_FIELDS
    return table(spark, d, "score_rows").select(*names).distinct()


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """Distinct score rows with the whole text of their passage.

    The rows go to as many tasks as the session shuffles to: texts are dear to read for their bytes, so small shuffles are not to be put together.
    """
    rows = table(spark, d, "score_rows").select(*SCORE_FIELDS).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "record_id", "rank").distinct()
    return S.passage_text(rows, table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "records").select("record_id", "injected_adv"))


def _answered(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "targets").select(F.col("id").alias("query_id"), "correct_answer", "incorrect_answer", "question")
    return _texts(spark, d).join(targets, "query_id")


@query(O.PASSAGE_TEXT)
def passage_text(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("record_id", "rank", F.length("text").alias("chars"), F.md5("text").alias("text_md5"))


@query(O.SCORED_PASSAGES)
def score_passages(spark: SparkSession, d: str) -> DataFrame:
    """Scores of every retrieved passage by the question and the answer, by the question alone, and by the answer alone, from the whole texts."""
    full = S.score_passages(_answered(spark, d), ["record_id", "rank"])
    both = S.score_passages(full.select("record_id", "rank", "k", "is_poison", "question", "slm_answer", "text", F.col("freq_density_score").alias("full_score"), "matched_freq_sum", F.col("matched_keyword_count").alias("matched"), F.array_join("matched_keywords_sample", " ").alias("sample")), ["record_id", "rank"], answer=None)
    return both.select("record_id", "rank", "k", "is_poison", "full_score", "matched", "sample", F.col("freq_density_score").alias("question_score"), "unique_word_count", S.answer_only_score(F.col("text"), F.col("slm_answer")).alias("answer_score"))


@query(O.SEMANTIC)
def semantic_density(spark: SparkSession, d: str) -> DataFrame:
    """The density with near words counted; words that differ by a plural ending stand for a model's similar ones."""
    a = _answered(spark, d)
    near = providers.plural_similarity(a.select(F.explode(X.tokens(F.col("text"))).alias("word")))
    got = S.score_passages(a, ["record_id", "rank"], matching_mode="semantic", similar=near)
    return got.select("record_id", "rank", "freq_density_score", F.col("matched_freq_sum").cast("bigint").alias("matched_freq_sum"), "matched_keyword_count")


@query(O.HAS_ANSWER)
def has_answer(spark: SparkSession, d: str) -> DataFrame:
    got = M.has_answer(_answered(spark, d), "text", "correct_answer")
    return got.groupBy("dataset", "k").agg(F.count("*").alias("n"), F.count_if("has_answer").alias("hits"))


@query(O.HAS_ANY_ANSWER)
def has_any_answer(spark: SparkSession, d: str) -> DataFrame:
    """Passages that hold the right or the planted answer."""
    got = M.has_answer(_answered(spark, d).withColumn("answers", F.array("correct_answer", "incorrect_answer")), "text", "answers")
    return got.select("record_id", "rank", "has_answer")


@query(O.HITS)
def topk_hits_curve(spark: SparkSession, d: str) -> DataFrame:
    hits = _passages(spark, d, "is_poison").select(F.col("record_id").alias("query_id"), "rank", F.coalesce("is_poison", F.lit(False)).alias("hit"))
    return M.hits_curve(hits, 20)


@query(O.PARSE)
def prompt_parse(spark: SparkSession, d: str) -> DataFrame:
    c = X.parse_contexts(F.col("input_prompt"))
    missing = F.lit(-1)
    return table(spark, d, "records").select("record_id", F.coalesce(F.size(c), missing).alias("n"), F.coalesce(F.length(F.array_join(c, "\n")), missing).alias("chars"), F.get(c, F.lit(0)).alias("first"))


@query(O.RENDER)
def prompt_render(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "records").where("injected_adv is not null and question is not null")
    return r.select("record_id", F.md5(X.render_prompt(TEMPLATE, F.col("question"), F.col("injected_adv"))).alias("prompt_md5"))


@query(O.MARKS)
def unicode_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(X.plain_marks(F.col("text"))).alias("text_md5"))


@query()
def nfd_normalize(spark: SparkSession, d: str) -> DataFrame:
    t = X.decomposed(F.col("text"))
    return table(spark, d, "documents").select("doc_id", t.alias("text_nfd"))


@query(O.JACCARD)
def jaccard_overlap(spark: SparkSession, d: str) -> DataFrame:
    a = _answered(spark, d)
    return a.select("record_id", "rank", X.jaccard(F.array_distinct(X.tokens(F.col("question"))), F.array_distinct(X.tokens(F.col("text")))).alias("overlap"))


@query(O.DENSITY)
def freq_density_exact(spark: SparkSession, d: str) -> DataFrame:
    a = _answered(spark, d).withColumn("_n", X.distinct_tokens(F.col("text")))
    full, only = (X.frequency_density(F.col("text"), keys, F.col("_n")) for keys in (S.keywords(F.col("question"), F.col("slm_answer")), S.keywords(F.col("question"))))
    return a.select("record_id", "rank", full.alias("density"), only.alias("query_only"))


@query(O.FILTER)
def freq_density_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = _passages(spark, d, "k", "doc_id", "is_poison", "filterrag_score", "query_only_score").withColumn("query_id", F.col("record_id"))
    got = [D.apply(kind, rows, ["query_id"]).select("record_id", "k", "is_poison", "removed", "defense") for kind in ("density", "density_query_only")]
    both = got[0].unionByName(got[1])
    return both.groupBy("defense", "k").agg(F.count("*").alias("n"), F.count_if(F.col("removed") & F.col("is_poison")).alias("removed_poison"), F.count_if(F.col("removed") & ~F.col("is_poison")).alias("removed_clean"))


@query(O.EPSILON)
def epsilon_sweep(spark: SparkSession, d: str) -> DataFrame:
    return sweeps.epsilon_sweep(_passages(spark, d, "k", "is_poison", "filterrag_score", "query_only_score"), EPSILONS)


@query(O.RECOMMEND)
def epsilon_recommend(spark: SparkSession, d: str) -> DataFrame:
    return sweeps.recommend(sweeps.epsilon_sweep(_passages(spark, d, "k", "is_poison", "filterrag_score", "query_only_score"), EPSILONS), 0.3)


@query(O.SCORE_SUMMARY)
def score_agg_all_k(spark: SparkSession, d: str) -> DataFrame:
    return sweeps.score_summary(_passages(spark, d, "k", "is_poison", "filterrag_score", "query_only_score")).withColumn("k", F.coalesce(F.col("k").cast("string"), F.lit("all")))


@query(O.TFIDF)
def tfidf_top_terms(spark: SparkSession, d: str) -> DataFrame:
    return D.tfidf_terms(_texts(spark, d), ["record_id"])


@query(O.TFIDF_COUNT)
def tfidf_count_estimate(spark: SparkSession, d: str) -> DataFrame:
    return D.tfidf_count(_texts(spark, d), ["record_id"])


@query(O.CONFUSION)
def confusion(spark: SparkSession, d: str) -> DataFrame:
    rows = _passages(spark, d, "dataset", "k", "is_poison", "filterrag_score").where("filterrag_score is not null and not isnan(filterrag_score)").withColumn("predicted", F.col("filterrag_score") >= 0.5)
    return M.confusion(rows, ["dataset", "k"], "is_poison", "predicted")


@query(O.AUC)
def roc_auc(spark: SparkSession, d: str) -> DataFrame:
    rows = _passages(spark, d, "dataset", "k", "is_poison", "filterrag_score").where("filterrag_score is not null and not isnan(filterrag_score)")
    return M.roc_auc(rows, ["dataset", "k"], "is_poison", "filterrag_score")


@query(O.INVERSIONS)
def rank_inversions(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a record's passages that retrieval and the lexical score put in different order."""
    rows = _passages(spark, d, "dataset", "k", "is_poison", "filterrag_score").where("filterrag_score is not null and not isnan(filterrag_score)").select("record_id", "rank", (-F.col("filterrag_score")).alias("s"))
    return M.rank_inversions(rows, ["record_id"], "rank", "s")


@query(O.RANKING)
def ndcg_map_mrr(spark: SparkSession, d: str) -> DataFrame:
    rows = _passages(spark, d, "is_poison").select(F.col("record_id").alias("query_id"), "rank", F.coalesce(F.col("is_poison"), F.lit(False)).cast("int").alias("rel"))
    relevant = rows.groupBy("query_id").agg(F.sum("rel").alias("n_rel"))
    return M.ranking_metrics(rows, relevant, 10)


@query(O.AGREEMENT)
def topk_agreement(spark: SparkSession, d: str) -> DataFrame:
    """How far the first five by the lexical score are the first five retrieved."""
    return M.topk_agreement(_passages(spark, d, "filterrag_score").withColumn("s", F.nanvl("filterrag_score", F.lit(None).cast("double"))), ["record_id"], "rank", "s", 5)


def _capped(spark: SparkSession, d: str) -> DataFrame:
    rows = _passages(spark, d, "is_poison", "filterrag_score").select(F.col("record_id").alias("query_id"), "rank", F.coalesce(F.col("is_poison"), F.lit(False)).cast("int").alias("rel"), "filterrag_score")
    return M.capped_recall(rows, rows.groupBy("query_id").agg(F.sum("rel").alias("n_rel")), rows.where("filterrag_score is not null"), 5)


@query(O.CAPPED)
def recall_cap_hole(spark: SparkSession, d: str) -> DataFrame:
    """Capped recall of poison in the first five, and the share of them without a lexical score as not judged."""
    return _capped(spark, d)


@query(O.MACRO)
def macro_average(spark: SparkSession, d: str) -> DataFrame:
    """The means over datasets of the means over records."""
    of = table(spark, d, "records").select(F.col("record_id").alias("query_id"), "run_id").join(table(spark, d, "runs").select("run_id", "dataset"), "run_id")
    return M.macro_average(_capped(spark, d).join(of, "query_id"), "dataset", ["recall_cap", "hole"])


@query(O.EXAMPLES)
def score_examples(spark: SparkSession, d: str) -> DataFrame:
    return reporting.examples(_passages(spark, d, "k", "is_poison", "filterrag_score", "query_only_score"), 0.5)


@query(O.SCORE_GRID)
def score_row_grid(spark: SparkSession, d: str) -> DataFrame:
    """Score rows made anew from whole texts for the first 5 and 10 passages of every record: both scores, the answer's own, and a preview."""
    a = _answered(spark, d).withColumn("grid_k", F.explode(F.filter(F.array(F.lit(5), F.lit(10)), lambda k: (k > F.col("rank")) & (k <= F.col("k")))))
    return S.score_rows(a.withColumn("k", F.col("grid_k")).drop("grid_k"), ["record_id", "k", "rank"]).select("record_id", "k", "rank", "doc_id", "is_poison", "filterrag_score", "query_only_score", "answer_token_overlap_score", F.md5("text_preview").alias("preview_md5"))


@query()
def text_concentration(spark: SparkSession, d: str) -> DataFrame:
    """The estimate of injected passages over texts, by the stand-in encoder."""
    rows = providers.embedding_hashed(_texts(spark, d), "text").select("record_id", "rank", "is_poison", "embedding")
    return P.concentration(durable(P.pair_table(rows, ["record_id"])), ["record_id"])


@query(O.SPLIT)
def group_split(spark: SparkSession, d: str) -> DataFrame:
    return M.group_split(table(spark, d, "score_rows"), "query_id", by=["dataset"])


@query(O.LEAKAGE)
def split_leakage(spark: SparkSession, d: str) -> DataFrame:
    split = M.group_split(table(spark, d, "score_rows"), "query_id", by=["dataset"])
    return M.leakage(split, "query_id").agg(F.count("*").alias("leaked"))


@query(O.SEED)
def stable_seed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "targets").select("id", F.substring(F.sha2(F.concat(F.lit("12:"), "id"), 256), 1, 16).alias("seed_hex"))


# -- stored diagnostics


def _diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """One row for each diag_id; repeats are exact, so any one stands for all, and only the fields that a query reads are moved."""
    return table(spark, d, "diagnostics").dropDuplicates(["diag_id"])


@query(O.SUMMARY)
def diag_summary(spark: SparkSession, d: str) -> DataFrame:
    return G.summary(_diagnostics(spark, d))


@query(O.STRICT)
def strict_flags(spark: SparkSession, d: str) -> DataFrame:
    return G.strict_flags(_diagnostics(spark, d)).select("diag_id", "asr_no_defense_strict", "asr_with_defense_strict")


@query(O.WORST)
def worst_n(spark: SparkSession, d: str) -> DataFrame:
    return G.worst(_diagnostics(spark, d)).select("diag_id", "query_id", "residual_poison_fraction")


@query(O.FINDINGS)
def decision_findings(spark: SparkSession, d: str) -> DataFrame:
    return G.findings(G.summary(_diagnostics(spark, d)))


@query(O.DECISION)
def decision_label(spark: SparkSession, d: str) -> DataFrame:
    return _diagnostics(spark, d).select("diag_id", G.decision(F.col("removed_poison"), F.col("removed_clean"), F.col("n_retrieved_poison")).alias("label"))


@query(O.SUCCESS)
def success_cases(spark: SparkSession, d: str) -> DataFrame:
    """Records whose poison all went, nothing being left, without the queries of records that failed before."""
    g = _diagnostics(spark, d)
    failed = g.where("residual_poison_fraction > 0.5").select("query_id").distinct()
    good = g.where("n_retrieved_poison > 0 and removed_poison = n_retrieved_poison and residual_poison_fraction = 0")
    return good.join(failed, "query_id", "left_anti").select("diag_id", "query_id")


@query(O.LATEST)
def latest_record(spark: SparkSession, d: str) -> DataFrame:
    """The last written record of each run and id, ties by record_id."""
    return G.latest(table(spark, d, "records").select("record_id", "run_id", "id", "written_at"), ["run_id", "id"], ["written_at", "record_id"]).select("run_id", "id", "record_id")


@query(O.MORE_CLEAN)
def clean_over_poison(spark: SparkSession, d: str) -> DataFrame:
    return _diagnostics(spark, d).where("removed_clean > removed_poison").select("diag_id", "query_id", "removed_clean", "removed_poison")


@query(O.COUNTS)
def count_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Mean, population variance and histogram of the removed poison of each defense."""
    g = _diagnostics(spark, d).where("removed_poison is not null").groupBy("defense", "removed_poison").agg(F.count("*").alias("n"))
    w = Window.partitionBy("defense")
    mean = F.sum(F.col("removed_poison") * F.col("n")).over(w) / F.sum("n").over(w)
    return g.withColumn("mean", mean).withColumn("variance", F.sum(F.col("n") * F.pow(F.col("removed_poison") - F.col("mean"), F.lit(2))).over(w) / F.sum("n").over(w))


@query(O.NAMES)
def run_names(spark: SparkSession, d: str) -> DataFrame:
    """The dataset that a run's name begins with, and the name built again from its parts."""
    top = F.concat(F.lit("Top"), F.col("k").cast("string"))
    tail = F.concat_ws("-", F.lit("adv"), "attack", F.lit("dot"), F.col("n_injected").cast("string"), F.col("k").cast("string"), F.lit("defense"), "defense")
    built = F.concat_ws("-", "dataset", F.lit("contriever"), "model", F.concat(top, F.lit("--M10x1")), tail)
    return table(spark, d, "runs").select("run_id", F.substring_index("run_name", "-", 1).alias("dataset"), (built == F.col("run_name")).alias("rebuilt"))


@query(O.CATEGORY)
def failure_category(spark: SparkSession, d: str) -> DataFrame:
    return _diagnostics(spark, d).select("diag_id", reporting.failure_category(F.col("removed_poison"), F.col("removed_clean"), F.col("n_retrieved_poison")).alias("category"))


@query(O.DETECTION)
def detection_table(spark: SparkSession, d: str) -> DataFrame:
    return reporting.detection_table(G.summary(_diagnostics(spark, d)))


@query(O.COMPARISON)
def comparison_table(spark: SparkSession, d: str) -> DataFrame:
    return reporting.comparison_table(G.summary(_diagnostics(spark, d)))


@query(O.WEIGHTED)
def weighted_means(spark: SparkSession, d: str) -> DataFrame:
    """Poison recall of each defense, weighted by what was retrieved."""
    return reporting.weighted_means(_diagnostics(spark, d), ["defense"], "poison_recall", "n_retrieved_poison")


@query(O.FULL_RECORD)
def diag_full_record(spark: SparkSession, d: str) -> DataFrame:
    """Whole diagnostic records of the density filter over the score rows, lists as text."""
    keys = ["record_id"]
    rows = _passages(spark, d, "doc_id", "is_poison", "filterrag_score").withColumn("query_id", F.col("record_id"))
    flagged = D.by_threshold(rows, "filterrag_score", 0.2)
    records = table(spark, d, "records").select("record_id", "run_id", F.col("id").alias("query_id"), "answer", "incorrect_answer", "output_poison", "output_poison_no_defense")
    runs = table(spark, d, "runs").select("run_id", "dataset", "model", "attack", "k", "n_injected")
    estimated = flagged.groupBy(*keys).agg(F.count_if("removed").alias("n_adv_estimated_by_ragdefender"))
    context = records.select(*keys, "run_id", "query_id").join(runs, "run_id").withColumn("defense", F.lit("density")).drop("run_id").join(estimated, keys)
    answers = records.select(*keys, F.col("output_poison_no_defense").alias("answer_no_defense"), F.col("output_poison").alias("answer_with_defense"), F.col("incorrect_answer").alias("target_wrong_answer"), F.col("answer").alias("gold_answer"))
    got = G.full_record(flagged.drop("query_id"), keys, context, answers)
    return got.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c, t in got.dtypes if t.startswith("array")})


@query(O.STREAM)
def stream_summary(spark: SparkSession, d: str) -> DataFrame:
    """The running summary of a stream over the diagnostics that are there, in complete mode."""
    return _stream(spark, d, summaries.running_summary, "complete")


@query(O.WINDOWS)
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Records and removals of each day and defense by a stream over the diagnostics that are there."""
    return _stream(spark, d, lambda r: summaries.windowed_counts(r, late="36500 days"), "complete")


def _stream(spark: SparkSession, d: str, aggregate: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    source = summaries.read_stream(spark, f"{d}/diagnostics*.parquet", table(spark, d, "diagnostics").schema)
    return summaries.run_to_table(aggregate(source), mode)


# -- learned and dense operators, checked by rows and invariants


@query()
def ward_estimate(spark: SparkSession, d: str) -> DataFrame:
    return D.ward_sizes(_top(spark, d), Q)


@query()
def singlehop_defense(spark: SparkSession, d: str) -> DataFrame:
    """The single-hop filter over retrieved vectors whose texts are those of documents of the same number."""
    texts = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    top = _top(spark, d).join(texts, "doc_id", "left")
    return D.apply("singlehop", top, Q).select("query_id", "doc_id", "rank", "is_poison", "removed")


def _features(spark: SparkSession, d: str) -> DataFrame:
    """Feature rows without their texts. Questions and splits are joined first, as rows are light before they have a text; the distinct passages are looked up by themselves."""
    score_rows = table(spark, d, "score_rows").select(*SCORE_FIELDS)
    targets = table(spark, d, "targets").select(F.col("id").alias("query_id"), "question")
    rows = durable(score_rows.distinct().join(targets.join(M.group_split(score_rows, "query_id", by=["dataset"]), "query_id"), ["dataset", "query_id"]))
    found = lambda r: S.passage_text(r, table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "records").select("record_id", "injected_adv"))
    passages = found(rows.select(F.when(F.col("doc_id").startswith("adv::"), F.col("record_id")).alias("record_id"), "doc_id").distinct())
    return mlfilter.features(found(rows), passages=passages).select("record_id", "dataset", "k", "query_id", "doc_id", "rank", "is_poison", "split", *mlfilter.FEATURES)


@query()
def ml_filter(spark: SparkSession, d: str) -> DataFrame:
    """For each dataset its kind of ensemble, fitted on the training queries and applied to the passages of the others."""
    scored = mlfilter.fit_and_score(_features(spark, d))
    flagged = D.apply("classifier", scored.withColumn("query_id", F.col("record_id")), ["query_id"])
    return M.confusion(flagged, ["dataset", "k"], "is_poison", "removed")


@query()
def ml_filter_boosted(spark: SparkSession, d: str) -> DataFrame:
    """The same with boosted trees for every dataset."""
    return M.roc_auc(mlfilter.fit_and_score(_features(spark, d), "boosted"), ["dataset"], "is_poison", "probability")


@query()
def pca_coords(spark: SparkSession, d: str) -> DataFrame:
    return transforms.pca_coordinates(_top(spark, d), Q)


def _moved(top: DataFrame, move: Callable, names: tuple[str, ...], *grid: list, least: int = 1) -> DataFrame:
    """Preservation and discrepancy of every set at every point of a grid, a list of values for each of ``names``; moved is false where a set is too small for the transform."""
    moved = durable(transforms.by_group(top, Q, list(product(*grid)), move, names, least))
    keys = [*Q, *names]
    return P.preservation(moved, keys).join(P.mmd_rbf(P.pair_table(moved, keys), keys), keys).join(moved.select(*Q, "moved").distinct(), Q)


@query()
def coral_pca(spark: SparkSession, d: str) -> DataFrame:
    return _moved(_top(spark, d), transforms.coral_pca, ("beta",), BETAS, least=2)


@query()
def coral_ridge(spark: SparkSession, d: str) -> DataFrame:
    return _moved(_top(spark, d), transforms.coral_ridge, ("beta", "ridge"), BETAS, [0.1, 0.01, 0.001], least=2)


@query()
def mmd_descent(spark: SparkSession, d: str) -> DataFrame:
    return _moved(_top(spark, d), lambda p, c, steps, keep: transforms.mmd_descent(p, c, int(steps), keep=keep), ("steps", "keep"), [0.0, 50.0, 100.0], [0.01, 0.1, 1.0])


@query()
def e1_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Poisoned vectors moved to their nearest clean anchors; one_to_one is false where there are fewer clean than poisoned rows, so anchors repeat."""
    top = _top(spark, d)
    moved = _moved(top, lambda p, c, a: transforms.anchor_interpolate(p, c, a, "nearest"), ("alpha",), ALPHAS)
    return moved.join(top.groupBy(*Q).agg((F.count_if("is_poison") <= F.count_if(~F.col("is_poison"))).alias("one_to_one")), Q)


@query(O.RANK_ALIGNED)
def e1_rank_aligned(spark: SparkSession, d: str) -> DataFrame:
    """Poisoned vectors moved to the clean one of the same place in their set, as often repeated as is needed: a plain join on the place."""
    moved = P.rank_aligned_sweep(_top(spark, d), Q, ALPHAS)
    return P.preservation(moved, [*Q, "alpha"])


@query()
def lsh_topk(spark: SparkSession, d: str) -> DataFrame:
    """Approximate neighbours of the query set by random hyperplanes over unit vectors: all rows are indexed; recall against topk_cosine is tested."""
    v = _vectors(spark, d)
    queries = v.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    return retrieval.hashed_top_k(queries, v.withColumnRenamed("vec_id", "doc_id"), 10)


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Detection quality of each defense over retrieved and injected passages."""
    return QUERIES["pooled_metrics"](spark, folder)
