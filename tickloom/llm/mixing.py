"""Mixing sources to target shares of tokens.

Token weights are raked over the cells source x language x topic: the source
marginal to the target shares, the others to the corpus's own shares, each
cell's weight limited by its source's cap on repeats. A cell's weight is then
the expected number of copies of each of its documents. Whole copies are given
to all; the rest is one draw. For it a cell is cut into bins of nearly equal
length, and every bin gets a whole number of documents, from the longest bin to
the shortest, so that what one bin has too many or too few tokens the next ones
make up for. Within a bin the documents are drawn evenly by rank.

Topics are the nearest of a few centroids of hashed token histograms, by
spherical k-means over all documents: every round assigns all and sums them up
per centroid in Spark. Only the seeds come from a bounded sample (about
``SAMPLE`` documents).
"""

import math
import warnings
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.llm.tokens import TOKENIZERS, encoder
from tickloom.plans.ranking import rank_in_group
from tickloom.plans.storage import materialise

SAMPLE = 2_000
TOPICS = 6
ROUNDS, MOVED = 10, 1e-3  # k-means ends after so many rounds, or when no centroid moves more
BUCKETS = 512
BINS = 16  # of length, in an octave
SMALL = 100_000  # rows of a plan that is broadcast; a larger one is joined by shuffle
PART_ROWS = 200_000  # documents that one task ranks, about


def _seeds(x: np.ndarray, k: int) -> np.ndarray:
    """Deterministic, mutually distant rows."""
    if len(x) <= k:
        return np.vstack([x, np.zeros((k - len(x), BUCKETS))])
    c = x[:1]
    while len(c) < k:
        c = np.vstack([c, x[np.argmin((x @ c.T).max(axis=1))]])
    return c


def _roots(column: pa.BinaryArray) -> np.ndarray:
    """Square roots of a column of histograms, each ``BUCKETS`` 4-byte counts; a row's length is the root of its tokens."""
    if not len(column):
        return np.zeros((0, BUCKETS), np.float32)
    start, end = (np.frombuffer(column.buffers()[1], np.int32)[column.offset + i] for i in (0, len(column)))
    counts = np.frombuffer(column.buffers()[2], np.int32, (end - start) // 4, start)
    return np.sqrt(counts.astype(np.float32)).reshape(-1, BUCKETS)


def _count(folder: str):
    """(doc_id, source, lang, text) to (doc_id, source, lang, n_tokens, histogram)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(folder)
        for batch in batches:
            tokens = [np.asarray(encode(t) if t else [], np.int64) for t in batch.column(3).to_pylist()]
            histograms = pa.array([np.bincount(t % BUCKETS, minlength=BUCKETS).astype(np.int32).tobytes() for t in tokens], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([len(t) for t in tokens], pa.int64()), histograms], ["doc_id", "source", "lang", "n_tokens", "histogram"])

    return run


def _sums(centroids: np.ndarray):
    """A partition's sum of unit histograms for each centroid that is their nearest."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(centroids.shape)
        for batch in batches:
            if batch.num_rows:
                x = _roots(batch.column(0))
                near = np.argmax(x @ centroids.T.astype(np.float32), axis=1)
                share = (near == np.arange(len(centroids))[:, None]) / np.sqrt(batch.column(1).to_numpy())
                total += share.astype(np.float32) @ x
        k, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(total[k, at])], ["k", "at", "s"])

    return run


def _topic(centroids: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.argmax(_roots(batch.column(4)) @ centroids.T.astype(np.float32), axis=1) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(near.astype(np.int32))], ["doc_id", "source", "lang", "n_tokens", "topic"])

    return run


def centroids(counted: DataFrame, topics: int) -> np.ndarray:
    """Unit centroids of the documents' histograms; ``topics`` x ``BUCKETS`` numbers a round come to the driver."""
    known = counted.where("n_tokens > 0").select("histogram", "n_tokens", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(max(1, counted.count()))).alias("h"))
    sample = known.where(F.col("h") < SAMPLE).select("histogram").toArrow()
    x = _roots(sample["histogram"].combine_chunks())
    c = _seeds(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12), topics)
    for _ in range(ROUNDS):
        new = np.zeros_like(c)
        for r in known.select("histogram", "n_tokens").mapInArrow(_sums(c), "k int, at int, s double").groupBy("k", "at").agg(F.sum("s").alias("s")).collect():
            new[r["k"], r["at"]] = r["s"]
        size = np.linalg.norm(new, axis=1, keepdims=True)
        new = np.where(size > 0, new / np.maximum(size, 1e-12), c)
        moved, c = np.abs(new - c).max(), new
        if moved <= MOVED:
            break
    return c


def measured(docs: DataFrame, doc_id: str, source: str, lang: str, text: str, folder: str = TOKENIZERS, topics: int = TOPICS) -> DataFrame:
    """``doc_id, source, lang, n_tokens, topic`` of every document, written once to the shared folder.

    A language is the lower-cased first part of its tag; null is its own
    language ``und``. An empty or null text has no tokens and topic 0.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.lower(F.split(F.col(lang), "[-_]")[0]), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    counted = materialise(rows.mapInArrow(_count(folder), "doc_id long, source string, lang string, n_tokens long, histogram binary"), "counted")
    return materialise(counted.mapInArrow(_topic(centroids(counted, topics)), "doc_id long, source string, lang string, n_tokens long, topic int"), "measured")


Cell = tuple[str, str, int]


def raked(cells: dict[Cell, float], targets: dict[str, tuple[float, float | None]], rounds: int = 10_000) -> dict[Cell, float]:
    """Copies per document in each cell ``(source, language, topic)``, given the cells' tokens.

    ``targets`` has each source's share and cap on copies (None: no cap). The
    total is the largest at which every source that has documents reaches its
    share under its cap; without any cap it is that of the documents. Shares
    of sources without documents go to the others in proportion. Raking ends
    when a round changes no cell by more than 10^-9 of the total; a warning
    says if it does not. Where caps leave the marginals out of reach together,
    that of the sources holds.
    """
    names = sorted(c for c, t in cells.items() if t > 0 and c[0] in targets and targets[c[0]][0] > 0 and targets[c[0]][1] != 0)
    if not names:
        return {}
    have = np.array([cells[c] for c in names], float)
    cap = np.array([np.inf if targets[c[0]][1] is None else targets[c[0]][1] for c in names], float)
    axes = [np.unique([str(c[i]) for c in names], return_inverse=True) for i in range(3)]
    sources, of = axes[0]
    share = np.array([targets[s][0] for s in sources])
    share /= share.sum()
    capped = np.bincount(of, np.isinf(cap)) == 0
    reach = np.bincount(of, have * np.where(np.isinf(cap), 0, cap))
    total = (reach[capped] / share[capped]).min() if capped.any() else have.sum()
    marginals = [share * total, *(np.bincount(a, have) / have.sum() * total for _, a in axes[1:])]
    x = have * (share * total / np.bincount(of, have))[of]
    for _ in range(rounds):
        last = x
        for (_, a), m in [*zip(axes[1:], marginals[1:]), (axes[0], marginals[0])]:
            now = np.bincount(a, x)
            x = np.minimum(x * (m / np.maximum(now, 1e-300))[a], cap * have)
        if np.abs(x - last).max() <= 1e-9 * total:
            break
    else:
        warnings.warn(f"raking still moves by {np.abs(x - last).max() / total:.1e} of the total after {rounds} rounds", stacklevel=2)
    for _ in names:  # what caps took from a source goes to its other cells
        free = x < cap * have * (1 - 1e-12)
        lack, room = marginals[0] - np.bincount(of, x), np.bincount(of, np.where(free, x, 0))
        if not ((lack > 1e-9 * total) & (room > 0)).any():
            break
        x = np.minimum(np.where(free, x * (1 + np.maximum(lack, 0) / np.maximum(room, 1e-300))[of], x), cap * have)
    return dict(zip(names, (x / have).tolist()))


def _draw(weights: dict[Cell, float], bins: dict[tuple[str, str, int, int], tuple[int, int]], targets: dict[str, tuple[float, float | None]]) -> list[tuple]:
    """(source, language, topic, bin, whole, drawn, documents, salts): copies for all of a bin's documents, and how many get one more.

    ``bins`` has documents and tokens. What rounding leaves of a source's tokens
    goes on from bin to bin, the longest first, and from cell to cell.
    """
    out, carry, last = [], 0.0, None
    for (s, lang, topic, at), (n, tokens) in sorted(bins.items(), key=lambda x: (*x[0][:3], -x[0][3])):
        if (s, lang, topic) not in weights:
            continue
        carry, last = carry if s == last else 0.0, s
        cap = targets[s][1]
        whole = math.floor(weights[s, lang, topic] + 1e-9)
        due = carry + max(0.0, weights[s, lang, topic] - whole) * tokens
        drawn = min(max(round(due * n / tokens), 0), n if cap is None or whole + 1 <= cap else 0)
        carry = due - drawn * tokens / n
        out.append((s, lang, topic, at, whole, drawn, n, -(-n // PART_ROWS)))
    return out


def _targets(targets: DataFrame, source: str, share: str, max_repeats: str) -> dict[str, tuple[float, float | None]]:
    """The table of targets is a parameter of the mixture, one row per source."""
    out: dict[str, tuple[float, float | None]] = {}
    for r in targets.select(F.col(source).alias("s"), F.col(share).alias("w"), F.col(max_repeats).alias("c")).where("s IS NOT NULL AND w > 0").collect():
        if r["s"] in out:
            raise ValueError(f"several targets for source {r['s']!r}")
        out[r["s"]] = (float(r["w"]), None if r["c"] is None else float(r["c"]))
    return out


def mix(docs: DataFrame, targets: DataFrame, source: str = "source", share: str = "target_share", max_repeats: str = "max_repeats") -> DataFrame:
    """``doc_id, source, n_tokens, copies, lang, topic`` of the documents in the mixture; ``docs`` as from ``measured``.

    Documents without tokens, or of a source that is null, has no target or
    target 0, are in no mixture. A cap of 0 excludes its source. Repeated rows
    are documents of their own. No documents give no rows.
    """
    spark, wanted = docs.sparkSession, _targets(targets, source, share, max_repeats)
    usable = docs.select("doc_id", "source", "lang", "n_tokens", "topic", F.floor(F.log2(F.col("n_tokens").cast("double")) * BINS).cast("int").alias("bin")).where("n_tokens > 0 AND source IS NOT NULL")
    usable = usable.where(F.col("source").isin(list(wanted)))
    # A row per source of the targets, language, topic and bin of length.
    bins = {tuple(r)[:4]: (r["n"], r["t"]) for r in usable.groupBy("source", "lang", "topic", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t")).collect()}
    tokens: dict[Cell, float] = {}
    for (s, lang, topic, _), (_, t) in bins.items():
        tokens[s, lang, topic] = tokens.get((s, lang, topic), 0) + t
    rows = _draw(raked(tokens, wanted), bins, wanted)
    plan = spark.createDataFrame(rows, "source string, lang string, topic int, bin int, whole int, drawn long, n long, salts int")
    drawn = usable.join(F.broadcast(plan) if len(rows) <= SMALL else plan, ["source", "lang", "topic", "bin"])
    ranked = rank_in_group(drawn, ["source", "lang", "topic", "bin"], ["doc_id", "n_tokens"], salts=F.col("salts"))
    # Rank r of n is drawn where the multiples of drawn / n pass a whole number.
    extra = F.floor((F.col("rank") + 1) * F.col("drawn") / F.col("n")) - F.floor(F.col("rank") * F.col("drawn") / F.col("n"))
    return ranked.select("doc_id", "source", "n_tokens", (F.col("whole") + extra).cast("int").alias("copies"), "lang", "topic").where("copies > 0")


def shares(mixture: DataFrame, docs: DataFrame, targets: DataFrame, source: str = "source", share: str = "target_share", max_repeats: str = "max_repeats") -> DataFrame:
    """Per source of the targets or the documents: target and reached share of tokens, tokens held and drawn, most copies of a document."""
    drawn = mixture.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("drawn_tokens"), F.max("copies").alias("most_copies"))
    held = docs.groupBy("source").agg(F.sum("n_tokens").alias("held_tokens"))
    wanted = targets.select(F.col(source).alias("source"), F.col(share).alias("target_share"), F.col(max_repeats).alias("max_repeats"))
    whole = F.sum("drawn_tokens").over(W.partitionBy())  # over one row per source
    return (
        held.withColumnRenamed("source", "s").join(wanted, F.col("s").eqNullSafe(F.col("source")), "full").withColumn("source", F.coalesce("s", "source")).drop("s")
        .join(drawn, "source", "left")
        .select("source", "target_share", (F.coalesce("drawn_tokens", F.lit(0)) / whole).alias("reached_share"), F.coalesce("held_tokens", F.lit(0)).alias("held_tokens"), F.coalesce("drawn_tokens", F.lit(0)).alias("drawn_tokens"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), "max_repeats")
    )


def marginals(mixture: DataFrame, docs: DataFrame, targets: DataFrame, source: str = "source", share: str = "target_share", max_repeats: str = "max_repeats") -> DataFrame:
    """``axis, value, wanted_share, reached_share`` of tokens for every source, language and topic that the mixture may hold.

    A source is wanted at its target, a language or topic at its share of the
    tokens of those sources; sources without documents give their share to the others.
    """
    known = targets.where(f"`{share}` > 0 AND (`{max_repeats}` IS NULL OR `{max_repeats}` > 0)").select(F.col(source).alias("source"), F.col(share).alias("target"))
    usable = docs.where("n_tokens > 0").join(known, "source")
    axes = lambda: F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), F.col(c).cast("string").alias("value")) for a, c in (("source", "source"), ("language", "lang"), ("topic", "topic"))))).alias("x")
    held = usable.select("n_tokens", "target", axes()).groupBy("x.axis", "x.value").agg(F.sum("n_tokens").alias("held"), F.max("target").alias("target"))
    drawn = mixture.select((F.col("n_tokens") * F.col("copies")).alias("t"), axes()).groupBy("x.axis", "x.value").agg(F.sum("t").alias("drawn"))
    weight = F.when(F.col("axis") == "source", F.col("target")).otherwise(F.col("held").cast("double"))
    whole = W.partitionBy("axis")  # a row per source, language or topic
    return held.join(drawn, ["axis", "value"], "left").select(
        "axis", "value", (weight / F.sum(weight).over(whole)).alias("wanted_share"), (F.coalesce("drawn", F.lit(0)) / F.sum("drawn").over(whole)).alias("reached_share")
    )
