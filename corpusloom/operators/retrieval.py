"""Hybrid retrieval: routing, five arms, fusion, diversity, budgets, one-hop expansion and abstention."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.text import ARM_WEIGHTS, identifiers, intent, needs_rewrite, stitched, token_set
from corpusloom.operators.lexical import bm25_topk, lexical_topk, term_matches
from corpusloom.operators.tables import written
from corpusloom.operators.vectors import dense_topk

__all__ = ["bm25_topk", "dense_topk", "lexical_topk", "term_matches"]

RRF_K, FUSED = 60, 100
LAMBDA, MODULE_CAP, GENERATED_PENALTY = 0.7, 3, 0.25
TOTAL_TOKENS, PRIMARY_SHARE, EXPANSION_SHARE = 24_000, 0.55, 0.25
SEED_NEIGHBOURS, CENTRALITY_CEILING = 4, 50
# Relations from most to least wanted.
RELATIONS = ["type", "parent", "callee", "implementation", "caller"]


def ranked(df: DataFrame, query: str, score: Column, item: str, k: int) -> DataFrame:
    """The k best items of each query, ties by id: query, item, rank, score. The window is limited before its shuffle."""
    order = Window.partitionBy(query).orderBy(F.desc("score"), item)
    return df.select(query, item, score.alias("score")).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def document_frequency(chunks: DataFrame, scope: str, item: str, text: str) -> DataFrame:
    """scope, term, ndoc, docs, idf of terms that more than one chunk of a scope holds."""
    terms = chunks.select(scope, item, F.explode(token_set(F.col(text))).alias("term"))
    total = chunks.groupBy(scope).agg(F.count("*").alias("docs"))
    df = terms.groupBy(scope, "term").agg(F.count("*").alias("ndoc")).where("ndoc > 1").join(total, scope)
    return df.withColumn("idf", F.round(F.log((F.col("docs") - F.col("ndoc") + 0.5) / (F.col("ndoc") + 0.5) + 1.0), 6))


def symbol_topk(symbols: DataFrame, queries: DataFrame, k: int = 10, item: str = "symbol_id", name: str = "name", query: str = "query_id", wanted: str = "identifier") -> DataFrame:
    """Symbols whose name is an identifier of the query (1.0) or ends with it (0.5); shorter names first.

    Names that are alike but for case are a class, of which only the first k symbols can be
    among a query's best; identifiers are searched once each, however many queries ask. So
    what meets is distinct names and identifiers, and k rows of each go on to the queries.
    """
    asked = queries.select(query, F.lower(wanted).alias("_id")).where("_id <> ''").distinct()
    # A name is met by its endings of the lengths that are asked for, so this is an equi-join.
    sizes = sorted(r[0] for r in asked.select(F.length("_id")).distinct().collect())
    low = F.lower(F.col(name))
    alike = Window.partitionBy("_low", "_size").orderBy(item)
    known = symbols.select(item, name).distinct().select(item, name, low.alias("_low"), F.length(name).alias("_size"))
    first = known.withColumn("_n", F.row_number().over(alike)).where(F.col("_n") <= k).drop("_n")
    ends = F.array_distinct(F.filter(F.array(*[F.when(F.length("_low") >= n, F.right(F.col("_low"), F.lit(n))) for n in sizes]), lambda x: x.isNotNull())) if sizes else F.array().cast("array<string>")
    met = first.withColumn("_id", F.explode(ends)).join(asked.select("_id").distinct(), "_id").withColumn("score", F.when(F.col("_low") == F.col("_id"), 1.0).otherwise(0.5))
    each = Window.partitionBy("_id").orderBy(F.desc("score"), "_size", item)
    few = met.withColumn("_n", F.row_number().over(each)).where(F.col("_n") <= k).select("_id", item, name, "_size", "score")
    # A symbol among the k best of a query is among the k best of the identifier that gives it its score.
    best = few.join(asked, "_id").groupBy(query, item, name, "_size").agg(F.max("score").alias("score"))
    order = Window.partitionBy(query).orderBy(F.desc("score"), "_size", item)
    return best.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select(query, item, "score", "rank")


def fuse(arms: DataFrame, item: str = "doc_id", query: str = "query_id", k: int = RRF_K, limit: int = FUSED) -> DataFrame:
    """Reciprocal rank fusion of arms (query, item, rank, weight)."""
    total = arms.groupBy(query, item).agg(F.sum(F.col("weight") / (F.lit(k) + F.col("rank"))).alias("s"))
    return ranked(total, query, F.round("s", 9), item, limit)


def diversify(scored: DataFrame, limit: int, item: str = "doc_id", query: str = "query_id", text: str = "text", module: str = "module", cap: int = MODULE_CAP, weight: float = LAMBDA, penalty: float = GENERATED_PENALTY) -> DataFrame:
    """Greedy maximal marginal relevance with a cap for each module: query, item, position.

    Each step takes the item with the best mix of score and unlikeness to those taken; a
    module that has its share is passed over, and when all are, the first item left is taken
    without counting. A query's candidates are bounded by the arms' limits, so one group is
    one small frame.
    """
    cols = scored.select(query, item, "score", F.coalesce(F.col(module).cast("string"), F.lit("docs")).alias("module"), F.col("generated").cast("boolean").alias("generated"), token_set(F.col(text)).alias("tokens"))
    kinds = dict(cols.dtypes)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", item], ascending=[False, True])
        left = [(r[1], r[2] * (1 - penalty if r[4] else 1), r[3], set(r[5])) for r in pdf[[query, item, "score", "module", "generated", "tokens"]].itertuples(index=False, name=None)]
        like = [0.0] * len(left)
        used: dict[str, int] = {}
        out = []
        while left and len(out) < limit:
            best, at = -math.inf, -1
            for i, (_, rel, mod, _t) in enumerate(left):
                if used.get(mod, 0) < cap and (s := weight * rel - (1 - weight) * like[i]) > best:
                    best, at = s, i
            counted = at >= 0
            name, _, mod, toks = left.pop(max(at, 0))
            like.pop(max(at, 0))
            if counted:
                used[mod] = used.get(mod, 0) + 1
            out.append(name)
            for i, x in enumerate(left):
                both = len(toks & x[3])
                if toks and x[3]:
                    like[i] = max(like[i], both / (len(toks) + len(x[3]) - both))
        return pd.DataFrame({query: pdf[query].iloc[0], item: out, "position": range(1, len(out) + 1)})

    return cols.groupBy(query).applyInPandas(pick, f"{query} {kinds[query]}, {item} {kinds[item]}, position int")


def fit_budget(items: DataFrame, budget: int = int(TOTAL_TOKENS * PRIMARY_SHARE), item: str = "doc_id", query: str = "query_id", order: str = "position", tokens: str = "tokens") -> DataFrame:
    """Items in order while they fit: one that does not is passed over, the first is always kept. Adds kept and used.

    What fits hangs on all that was kept before, so a query's items are folded in their
    order: sorted by query, they stream through a task, which carries one number from row to
    row. A query of any length needs no memory of its own.
    """
    kinds = dict(items.dtypes)
    schema = f"`{query}` {kinds[query]}, `{item}` {kinds[item]}, `{order}` {kinds[order]}, `{tokens}` long, kept boolean, used long"

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, used, n = None, 0, 0
        for batch in batches:
            kept, sums = [], []
            for name, t in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                if n == 0 or name != now:
                    now, used, n = name, 0, 0
                n += 1
                fits = n == 1 or used + t <= budget
                used += t if fits else 0
                kept.append(fits)
                sums.append(used)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(4)], pa.array(kept, pa.bool_()), pa.array(sums, pa.int64())], names=[query, item, order, tokens, "kept", "used"])

    dealt = items.select(query, item, order, F.col(tokens).cast("long").alias(tokens)).repartition(query).sortWithinPartitions(query, order, item)
    return dealt.mapInArrow(fold, schema)


def neighbour_shortlist(neighbours: DataFrame, seed: str = "seed_id", item: str = "symbol_id", most: int = SEED_NEIGHBOURS, ceiling: int = CENTRALITY_CEILING) -> DataFrame:
    """Each seed's neighbours under the centrality ceiling, by relation then centrality, at most ``most``; adds place."""
    wanted = F.array_position(F.array(*[F.lit(r) for r in RELATIONS]), F.col("relation"))
    order = Window.partitionBy(seed).orderBy(wanted, "centrality", item)
    return neighbours.where(F.col("centrality") <= ceiling).withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= most)


def expand(neighbours: DataFrame, budget: int = int(TOTAL_TOKENS * EXPANSION_SHARE), query: str = "query_id", seed_rank: str = "seed_rank", item: str = "symbol_id", tokens: str = "tokens") -> DataFrame:
    """Round robin over the seeds' shortlists (query, seed_rank, place, item, tokens) under one budget.

    An item counts once, at its first turn that fits; one that does not fit is passed over.
    Adds taken_at and used. A query's rows stream through a task in the order of their turns,
    which carries the items taken so far; the budget bounds these.
    """
    kinds = dict(neighbours.dtypes)

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen, used, n = None, set(), 0, 0
        for batch in batches:
            at, taken, sums = [], [], []
            for i, (who, name, t) in enumerate(zip(*[batch.column(c).to_pylist() for c in (0, 3, 4)])):
                if n == 0 or who != now:
                    now, seen, used = who, set(), 0
                n += 1
                if name in seen or used + t > budget:
                    continue
                seen.add(name)
                used += t
                at.append(i)
                taken.append(len(seen))
                sums.append(used)
            of = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(3).take(of), pa.array(taken, pa.int32()), pa.array(sums, pa.int64())], names=[query, item, "taken_at", "used"])

    rows = neighbours.select(query, seed_rank, "place", item, F.col(tokens).cast("long").alias(tokens))
    dealt = rows.repartition(query).sortWithinPartitions(query, "place", seed_rank, item, tokens)
    return dealt.mapInArrow(turn, f"`{query}` {kinds[query]}, `{item}` {kinds[item]}, taken_at int, used long")


def abstention(evidence: DataFrame, query: str = "query_id", threshold: float = 0.35, least: int = 1, least_unranked: int = 3) -> DataFrame:
    """Verdict of each query from rows (n_chunks, top_score, reranked, n_shallow, n_generated, n_stale_repos).

    Abstains without evidence; with a reranker, if the best score is missing or under the
    threshold; without one, under least_unranked chunks. Otherwise may ask for hedging.
    """
    n, top = F.col("n_chunks"), F.col("top_score")
    weak = F.when(F.col("reranked"), top.isNull() | (top < threshold)).otherwise(n < least_unranked)
    abstain = (n < least) | weak
    reason = F.when(n < least, "no-evidence").when(~weak, None).when(F.col("reranked"), "weak-score").otherwise("few-unranked")
    hedges = F.filter(F.array(F.when(F.col("n_shallow") == n, "all-shallow"), F.when(F.col("n_stale_repos") > 0, "stale-repos"), F.when(F.col("n_generated") == n, "all-generated"), F.when(~F.col("reranked"), "fusion-order")), lambda x: x.isNotNull())
    return evidence.select(query, abstain.alias("abstain"), reason.alias("reason"), F.when(abstain, F.lit("")).otherwise(F.array_join(hedges, ";")).alias("hedges"))


SESSION_BOOST = 1.15
#: Ranks of an arm, of the fused list, and of exact names.
ARM_DEPTH, CHOSEN, NAMED = 50, 50, 10
# Corpora of documentation; all others are code.
DOCUMENTATION = ["docs", "adr"]


def routed(questions: DataFrame, query: str = "query_id", text: str = "query", turn: str = "last_turn") -> DataFrame:
    """questions with what is searched for, the intent, the arms' weights, the corpora and the names in the question.

    A question that needs the turn before it is searched for together with it.
    """
    said = F.when(needs_rewrite(F.col(text)), stitched(F.col(text), F.col(turn))).otherwise(F.col(text)) if turn in questions.columns else F.col(text)
    table = {i: F.struct(*[F.lit(float(w)).alias(n) for n, w in zip(("dense", "lexical", "symbol"), (d, l, y))], F.array(*[F.lit(c) for c in corpora]).alias("corpora")) for i, (d, l, y, corpora) in ARM_WEIGHTS.items()}
    out = questions.withColumn("asked", said).withColumn("intent", intent(F.col("asked")))
    arms = None
    for name, value in table.items():
        arms = F.when(F.col("intent") == name, value) if arms is None else arms.when(F.col("intent") == name, value)
    return out.withColumn("arms", arms).withColumn("names", identifiers(F.col("asked")))


def hybrid_search(chunks: DataFrame, vectors: DataFrame, questions: DataFrame, links: DataFrame, stale: DataFrame, session: list | None = None, rescored: DataFrame | None = None, item: str = "doc_id", query: str = "query_id", most: int = 8) -> tuple[DataFrame, DataFrame]:
    """The served chunks of every question, and the verdict on its evidence.

    chunks (item, text, module, name, tokens, corpus, depth, generated) are those that the
    caller may see; vectors (item, embedding) are theirs. questions: (query, query text as
    ``query``, query_vector, which may be null, and last_turn if there is a conversation).

    A question's intent gives its weights and corpora. Code and documentation are ranked
    apart, so that the larger does not crowd out the other: five arms in all, vectors and
    words of both and exact names in code. Their ranks are fused, chunks of the session's
    symbols weigh SESSION_BOOST times as much, and a diverse choice is made. A reranker's
    scores (query, item, rerank_score), if given, put that in order. What fits the budget is
    ``primary``; links (src, dst, relation) of it fill the rest as ``expansion``. A question
    whose evidence does not carry an answer is served nothing. stale: items of repositories
    behind their heads.

    The arms, the choice and the primary chunks are written once each; arms rank by
    question and corpus, in parts, and only ranks are shuffled.
    """
    asked = written(routed(questions, query), "questions")
    corpus = F.coalesce("corpus", F.lit("code"))
    of = chunks.withColumn("corpus", corpus)
    each = asked.select(query, "asked", "query_vector", "arms", F.explode("arms.corpora").alias("corpus"))
    # One name for a question and a corpus, so that each is ranked by itself; the best of a side are among them.
    pair = F.struct(query, "corpus")
    dense = dense_topk(vectors.join(of.select(item, "corpus"), item), each.select(pair.alias("_q"), "query_vector", "corpus"), ARM_DEPTH, item, query="_q", within="corpus")
    words = bm25_topk(of.select(item, "text", "corpus"), each.select(pair.alias("_q"), F.col("asked").alias("query"), "corpus"), ARM_DEPTH, item, query="_q", within="corpus")
    side = F.when(F.col("_q.corpus").isin(DOCUMENTATION), "docs").otherwise("code")
    named = lambda df, arm: df.select(F.col(f"_q.{query}").alias(query), item, "score", F.concat(F.lit(arm), side).alias("arm"))
    order = Window.partitionBy(query, "arm").orderBy(F.desc("score"), item)
    both = named(dense, "dense-").unionByName(named(words, "lexical-")).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= ARM_DEPTH)
    code = of.where(~F.col("corpus").isin(DOCUMENTATION))
    exact = symbol_topk(code, asked.select(query, F.explode("names").alias("identifier")), NAMED, item, query=query)
    allowed = exact.join(code.select(item, "corpus"), item).join(asked.select(query, "arms.corpora"), query).where(F.array_contains("corpora", F.col("corpus")))
    ranks = both.select(query, item, "arm", "rank").unionByName(allowed.select(query, item, F.lit("symbol").alias("arm"), "rank"))
    weight = F.when(F.col("arm").startswith("dense"), F.col("arms.dense")).when(F.col("arm").startswith("lexical"), F.col("arms.lexical")).otherwise(F.col("arms.symbol"))
    arms = written(ranks.join(asked.select(query, "arms"), query).select(query, item, "rank", weight.alias("weight")), "arms")
    fused = fuse(arms, item, query, limit=CHOSEN)
    boost = F.when(F.col(item).isin(session), SESSION_BOOST).otherwise(1.0) if session else F.lit(1.0)
    full = fused.join(chunks.select(item, "text", "module", "generated"), item).select(query, item, (F.col("score") * boost).alias("score"), "text", "module", "generated")
    chosen = written(diversify(full, CHOSEN, item, query), "chosen")
    if rescored is None:
        ordered = chosen.where(F.col("position") <= most).withColumn("rerank_score", F.lit(None).cast("double"))
    else:
        w = Window.partitionBy(query).orderBy(F.desc("rerank_score"), item)
        ordered = chosen.join(rescored, [query, item]).withColumn("position", F.row_number().over(w)).where(F.col("position") <= most)
    known = chunks.select(item, "tokens", "depth", "generated")
    fitted = fit_budget(ordered.join(known.select(item, "tokens"), item), item=item, query=query).where("kept")
    primary = written(fitted.join(ordered.select(query, item, "rerank_score"), [query, item]).join(known.drop("tokens"), item), "primary")
    central = links.groupBy(F.col("dst").alias(item)).agg(F.count("*").alias("centrality"))
    near = primary.select(query, F.col(item).alias("src"), F.col("position").alias("seed_rank")).join(links, "src").withColumnRenamed("dst", item).join(central, item).join(chunks.select(item, "tokens"), item)
    near = near.join(primary.select(query, item), [query, item], "left_anti").withColumn("seed_id", F.struct(query, "src"))
    grown = expand(neighbour_shortlist(near, item=item), query=query, item=item)
    found = primary.join(stale.select(F.col(item), F.lit(1).alias("old")), item, "left")
    evidence = questions.select(query).distinct().join(found, query, "left").groupBy(query).agg(F.count(item).alias("n_chunks"), F.max("rerank_score").alias("top_score"), F.count_if(F.col("depth") == "shallow").alias("n_shallow"), F.count_if(F.col("generated")).alias("n_generated"), F.count("old").alias("n_stale_repos"))
    verdicts = abstention(evidence.withColumn("reranked", F.lit(rescored is not None)), query)
    served = primary.select(query, item, F.lit("primary").alias("part"), F.col("position").cast("int").alias("place"), "used").unionByName(grown.select(query, item, F.lit("expansion").alias("part"), F.col("taken_at").alias("place"), "used"))
    return served.join(verdicts.where("not abstain").select(query), query, "left_semi"), verdicts
