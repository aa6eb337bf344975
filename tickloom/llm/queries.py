"""Registered queries of the problems on training data, with SQL where it can give the same rows."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.cooccurrence import associations, baskets
from tickloom.llm.mixing import marginals, measured, mix, shares
from tickloom.llm.neighbours import exact_neighbours, nearest_neighbours
from tickloom.llm.packing import pack
from tickloom.llm.splitting import bisection, split_sequences
from tickloom.llm.tokens import counted
from tickloom.llm.truncation import truncated, truncation_rates
from tickloom.plans.storage import materialise
from tickloom.sources.tables import table

CONTEXT, OVERLAP = 254, 24
NEIGHBOURS, SIMILAR = 10, 0.9
CAPACITY = 2_048


def _packages(spark: SparkSession, root: str) -> DataFrame:
    return baskets(table(spark, root, "sentences"), F.col("package_id"), F.date_format("trade_date", "yyyy-MM"), F.col("token_ids"))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """Token pairs in at least 6 of a month's packages, at least 10 times as often as expected."""
    together = associations(_packages(spark, root), min_together=6).where(F.col("n_ab") * F.col("n") >= 10 * F.col("n_a") * F.col("n_b"))
    return together.select(F.col("grp").alias("trade_month"), F.col("item_a").alias("token_a"), F.col("item_b").alias("token_b"))


def p2_pairs(spark: SparkSession, root: str) -> DataFrame:
    """Every token pair of every month, with its counts and log-likelihood ratio."""
    out = associations(_packages(spark, root))
    return out.select(F.col("grp").alias("trade_month"), F.col("item_a").alias("token_a"), F.col("item_b").alias("token_b"), "n_ab", "n_a", "n_b", (F.round("llr", 4) + 0.0).alias("llr"))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """Pieces of the sequences that exceed the context."""
    out = split_sequences(table(spark, root, "packed_corpus"), "seq_id", "tokens", CONTEXT, OVERLAP)
    return out.select("seq_id", "piece_start", "piece_end").distinct()


def p3_bisected(spark: SparkSession, root: str) -> DataFrame:
    """The same sequences cut by recursive bisection into pieces of even size."""
    return split_sequences(table(spark, root, "packed_corpus"), "seq_id", "tokens", CONTEXT, OVERLAP, bisection)


def p3_report(spark: SparkSession, root: str) -> DataFrame:
    """Of the bisected pieces: the longest, and per kind of end how many, their tokens and what they share with the piece before."""
    size = F.col("piece_end") - F.col("piece_start")
    kinds = p3_bisected(spark, root).groupBy("end_kind").agg(F.count(F.lit(1)).alias("n_pieces"), F.max(size).alias("longest"), F.sum(size).alias("n_tokens"), F.sum("overlap").alias("n_shared"), F.max("overlap").alias("most_shared"))
    return kinds


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of vectors at a cosine of 0.9 or more, one among the 10 nearest of the other."""
    near = nearest_neighbours(table(spark, root, "oracle_token_vectors"), "vec_id", "v", NEIGHBOURS, at_least=SIMILAR)
    pairs = near.select("vec_id", F.explode("neighbours").alias("x"))
    return pairs.select(F.least("vec_id", "x.id").alias("vec_a"), F.greatest("vec_id", "x.id").alias("vec_b")).distinct()


_ASKED = "vec_id % 50 = 0"


def p6_neighbours(spark: SparkSession, root: str) -> DataFrame:
    """The 10 nearest, among all vectors, of every vector whose id is divisible by 50."""
    near = nearest_neighbours(table(spark, root, "oracle_token_vectors"), "vec_id", "v", NEIGHBOURS, queries=F.expr(_ASKED))
    near = near.select("vec_id", F.posexplode("neighbours").alias("pos", "x"))
    return near.select("vec_id", (F.col("pos") + 1).alias("rank"), F.col("x.id").alias("neighbour"), F.round("x.cosine", 6).alias("cosine"))


def p6_recall(spark: SparkSession, root: str) -> DataFrame:
    """Of the true 10 nearest of every vector whose id is divisible by 50, how many ``p6_neighbours`` finds."""
    vectors = table(spark, root, "oracle_token_vectors")
    true = exact_neighbours(vectors, "vec_id", "v", NEIGHBOURS, F.expr(_ASKED)).select("vec_id", F.col("neighbours.id").alias("true_ids"))
    found = nearest_neighbours(vectors, "vec_id", "v", NEIGHBOURS, queries=F.expr(_ASKED)).select("vec_id", F.col("neighbours.id").alias("ids"))
    hits = true.join(found, "vec_id", "left").select(F.size("true_ids").alias("n"), F.coalesce(F.size(F.array_intersect("true_ids", "ids")), F.lit(0)).alias("hits"))
    whole = hits.agg(F.count(F.lit(1)).alias("n_queries"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_true"), F.coalesce(F.sum("hits"), F.lit(0)).alias("n_found"))
    return whole.select("*", F.expr("CASE WHEN n_true > 0 THEN n_found / n_true END").alias("recall"))


def _packed(spark: SparkSession, root: str) -> DataFrame:
    sizes = table(spark, root, "documents").select("doc_id", "text").mapInArrow(counted(), "doc_id long, n_tokens long")
    return pack(materialise(sizes, "sizes"), "doc_id", "n_tokens", CAPACITY).withColumnRenamed("item", "doc_id")


def p7_packed(spark: SparkSession, root: str) -> DataFrame:
    """Every document's place in a context of 2,048 tokens."""
    return _packed(spark, root)


def p7_report(spark: SparkSession, root: str) -> DataFrame:
    """Contexts, tokens, and the share of padding."""
    out = _packed(spark, root).where("pack_id IS NOT NULL").agg(F.max("pack_id").alias("last"), F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_parts"))
    packs = F.coalesce(F.col("last") + 1, F.lit(0))
    return out.select(packs.alias("n_packs"), "n_parts", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), (1 - F.col("n_tokens") / (packs * CAPACITY)).alias("padding_share"))


def _mixture(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = measured(table(spark, root, "documents"), "doc_id", "source", "lang", "text")
    targets = table(spark, root, "source_targets")
    return mix(docs, targets), docs, targets


def p8_mixture(spark: SparkSession, root: str) -> DataFrame:
    """Documents of the mixture and how often each is used."""
    return _mixture(spark, root)[0]


def p8_shares(spark: SparkSession, root: str) -> DataFrame:
    """Target and reached share of each source."""
    return shares(*_mixture(spark, root))


def p8_marginals(spark: SparkSession, root: str) -> DataFrame:
    """Wanted and reached share of each source, language and topic."""
    return marginals(*_mixture(spark, root))


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents whose text was cut off."""
    return truncated(table(spark, root, "documents"), "doc_id", "source", "text").select("doc_id").distinct()


def p9_rates(spark: SparkSession, root: str) -> DataFrame:
    """How often each source cuts its texts."""
    docs = table(spark, root, "documents")
    return truncation_rates(docs, truncated(docs, "doc_id", "source", "text"), "source")


_PAIRS = """
WITH held AS (SELECT DISTINCT package_id, strftime(trade_date, '%Y-%m') AS trade_month, unnest(token_ids) AS token FROM sentences WHERE trade_date IS NOT NULL AND package_id IS NOT NULL),
items AS (SELECT * FROM held WHERE token IS NOT NULL),
whole AS (SELECT trade_month, count(DISTINCT package_id) AS n FROM items GROUP BY 1),
single AS (SELECT trade_month, token, count(*) AS n FROM items GROUP BY 1, 2),
pairs AS (
    SELECT a.trade_month, a.token AS token_a, b.token AS token_b, count(*) AS n_ab
    FROM items a JOIN items b ON a.package_id = b.package_id AND a.trade_month = b.trade_month AND a.token < b.token GROUP BY 1, 2, 3
),
rated AS (
    SELECT p.*, a.n AS n_a, b.n AS n_b, w.n FROM pairs p JOIN whole w USING (trade_month)
    JOIN single a ON a.trade_month = p.trade_month AND a.token = p.token_a JOIN single b ON b.trade_month = p.trade_month AND b.token = p.token_b
)"""
_XLOGX = "(CASE WHEN {0} > 0 THEN {0} * ln({0}) ELSE 0 END)"
_LLR = "greatest(0.0, 2 * (" + " + ".join(_XLOGX.format(x) for x in ("n_ab", "(n_a - n_ab)", "(n_b - n_ab)", "(n - n_a - n_b + n_ab)")) + " - (" + " + ".join(_XLOGX.format(x) for x in ("n_a", "(n - n_a)", "n_b", "(n - n_b)")) + ") + " + _XLOGX.format("n") + "))"
_NEAR = """
WITH good AS (
    SELECT vec_id, CAST(v AS DOUBLE[]) AS v FROM oracle_token_vectors
    WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
),
near AS (SELECT a.vec_id, b.vec_id AS neighbour, round(list_cosine_similarity(a.v, b.v), 12) AS cosine FROM good a JOIN good b ON a.vec_id <> b.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, neighbour) AS rank FROM near)"""

_END = "CASE WHEN stop - st <= 254 THEN stop ELSE coalesce(list_max(list_filter(packages, lambda i: i > reached AND i <= st + 254)), list_max(list_filter(line_starts, lambda i: i > reached AND i <= st + 254)), st + 254) END"
_LONG = """
WITH RECURSIVE arrays AS (SELECT DISTINCT seq_id, tokens FROM packed_corpus WHERE tokens IS NOT NULL AND seq_id IS NOT NULL),
content AS (SELECT seq_id, tokens, list_filter(range(len(tokens)), lambda i: coalesce(tokens[i + 1], 0) > 2) AS pos FROM arrays),
long AS (
    SELECT row_number() OVER () AS k, seq_id, tokens, pos[1] AS begin, pos[len(pos)] + 1 AS stop, list_filter(pos, lambda i: tokens[i + 1] = 3) AS packages, list_filter(pos, lambda i: tokens[i + 1] IN (3, 4)) AS line_starts
    FROM content WHERE len(pos) > 254
)"""
_PIECES = f"""{_LONG},
pieces AS (
    SELECT k, begin AS st, begin AS reached FROM long
    UNION ALL
    SELECT k, coalesce(list_min(list_filter(line_starts, lambda i: i > st AND i >= piece_end - 24 AND i <= piece_end)), piece_end), piece_end
    FROM (SELECT p.k, st, stop, line_starts, {_END} AS piece_end FROM pieces p JOIN long l ON l.k = p.k) WHERE stop - st > 254
)
SELECT DISTINCT seq_id, st AS piece_start, {_END} AS piece_end FROM pieces p JOIN long l ON l.k = p.k"""
_NEAREST = "list_min(list_transform(list_filter({}, lambda i: i >= {} AND i <= {}), lambda i: abs(i - (b + s) // 2) * 4294967296 + i)) % 4294967296"
_CUT = f"coalesce({_NEAREST.format('packages', 'greatest((b + s) // 2 - (s - b) // 4, b + 1)', 'least((b + s) // 2 + (s - b) // 4, s - 1)')}, {_NEAREST.format('line_starts', 'b + 1', 's - 1')}, (b + s) // 2)"
_BISECTED = f"""{_LONG},
parts AS (
    SELECT k, begin AS b, stop AS s FROM long
    UNION ALL
    SELECT k, unnest([b, cut]), unnest([cut, s]) FROM (SELECT p.k, b, s, CAST({_CUT} AS BIGINT) AS cut FROM parts p JOIN long l ON l.k = p.k WHERE s - b > 230)
),
cores AS (SELECT l.*, b, s, row_number() OVER (PARTITION BY p.k ORDER BY b) - 1 AS piece_no FROM parts p JOIN long l ON l.k = p.k WHERE s - b <= 230),
begun AS (SELECT *, CASE WHEN b = begin THEN b ELSE coalesce(list_min(list_filter(line_starts, lambda i: i > begin AND i >= b - 24 AND i <= b)), b) END AS st FROM cores),
bisected AS (SELECT DISTINCT seq_id, piece_no, st AS piece_start, s AS piece_end, b - st AS overlap, CASE WHEN s = stop THEN 'end' WHEN tokens[s + 1] = 3 THEN 'package' WHEN tokens[s + 1] = 4 THEN 'line' ELSE 'inside' END AS end_kind FROM begun)"""

SQL = {
    "p3_bisected": f"{_BISECTED} SELECT * FROM bisected",
    "p3_report": f"{_BISECTED} SELECT end_kind, count(*) AS n_pieces, max(piece_end - piece_start) AS longest, CAST(sum(piece_end - piece_start) AS BIGINT) AS n_tokens, CAST(sum(overlap) AS BIGINT) AS n_shared, max(overlap) AS most_shared FROM bisected GROUP BY 1",
    "p3_found": _PIECES,
    "p2_found": f"{_PAIRS} SELECT trade_month, token_a, token_b FROM rated WHERE n_ab >= 6 AND n_ab * n >= 10 * n_a * n_b",
    "p2_pairs": f"{_PAIRS} SELECT trade_month, token_a, token_b, n_ab, n_a, n_b, round(CASE WHEN n_ab * n >= n_a * n_b THEN {_LLR} ELSE -{_LLR} END, 4) + 0.0 AS llr FROM rated",
    "p6_neighbours": f"{_NEAR} SELECT vec_id, rank, neighbour, round(cosine, 6) AS cosine FROM ranked WHERE rank <= 10 AND vec_id % 50 = 0",
    "p6_found": f"{_NEAR} SELECT DISTINCT least(vec_id, neighbour) AS vec_a, greatest(vec_id, neighbour) AS vec_b FROM ranked WHERE rank <= 10 AND cosine >= 0.9",
}
QUERIES = {f.__name__: f for f in (p2_found, p2_pairs, p3_found, p3_bisected, p3_report, p6_found, p6_neighbours, p6_recall, p7_packed, p7_report, p8_mixture, p8_shares, p8_marginals, p9_found, p9_rates)}
