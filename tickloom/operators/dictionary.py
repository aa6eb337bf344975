"""Dictionary encoding: disjoint id ranges for the families of a token block, and dictionaries with validity."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.plans.ranking import rank_in_group

# Special ids and the sizes of the closed families.
PAD, BOS, EOS, SEP, LEG, UNK = range(6)
SENSES = (0, 1, 2)
CLOSED = {"TDLT": 25, "SZ": 8, "NDLR": 8, "OUT": 24}


@dataclass(frozen=True)
class Ranges:
    """First id of each family; the order is specials, TDLT, CLI, TOK, SZ, NDLR, OUT."""

    n_clients: int
    n_tokens: int

    def first(self, family: str) -> int:
        at = UNK + 1
        for name, size in (("TDLT", CLOSED["TDLT"]), ("CLI", self.n_clients), ("TOK", self.n_tokens), ("SZ", CLOSED["SZ"]), ("NDLR", CLOSED["NDLR"]), ("OUT", CLOSED["OUT"])):
            if name == family:
                return at
            at += size
        raise ValueError(f"unknown family {family!r}")

    def size(self, family: str) -> int:
        return {"CLI": self.n_clients, "TOK": self.n_tokens}.get(family) or CLOSED.get(family, 0)

    def encode(self, family: str, local: Column) -> Column:
        """Global id of a local code, held within the family."""
        return F.least(F.greatest(local.cast("long"), F.lit(0)), F.lit(self.size(family) - 1)) + self.first(family)

    def belongs(self, gid: Column, family: str) -> Column:
        return gid.between(self.first(family), self.first(family) + self.size(family) - 1)


def sorted_codes(ids: DataFrame, column: str, first: int, width: int = 4096) -> DataFrame:
    """``raw_id, gid``: the distinct non-null ids in ascending order, numbered from ``first``."""
    distinct = ids.select(F.col(column).cast("long").alias("raw_id")).where("raw_id IS NOT NULL").distinct()
    ranked = rank_in_group(distinct, [], ["raw_id"], F.floor(F.col("raw_id") / width), salts=1)
    return ranked.select("raw_id", (F.col("rank") + first).alias("gid"))


def ranges(clients: DataFrame, tokens: DataFrame) -> Ranges:
    return Ranges(clients.select("client_id").distinct().count(), tokens.select("token_id").distinct().count())


def vocabulary(spark: SparkSession, clients: DataFrame, tokens: DataFrame) -> DataFrame:
    """``family, raw_id, gid`` of every id; raw_id is the code within a closed family."""
    r = ranges(clients, tokens)
    closed = [("SPECIAL", i, i) for i in range(UNK + 1)] + [(f, i, r.first(f) + i) for f in CLOSED for i in range(CLOSED[f])]
    out = spark.createDataFrame(closed, "family string, raw_id long, gid long")
    for family, ids, column in (("CLI", clients, "client_id"), ("TOK", tokens, "token_id")):
        out = out.unionByName(sorted_codes(ids, column, r.first(family)).select(F.lit(family).alias("family"), "raw_id", "gid"))
    return out


def encode(df: DataFrame, column: str, codes: DataFrame, out: str) -> DataFrame:
    """``df`` with the global id of ``column``; unknown and null values become ``UNK``."""
    own = codes.select(F.col("raw_id").alias("_raw"), F.col("gid").alias("_gid"))
    return df.join(own, F.col(column) == F.col("_raw"), "left").withColumn(out, F.coalesce("_gid", F.lit(UNK))).drop("_raw", "_gid")


def observable_tokens(lines: DataFrame, token_map: DataFrame) -> DataFrame:
    """``lines`` with ``observed_token``: that of the instrument and disclosed side; null if the dictionary has none."""
    known = token_map.select(F.col("instrument_id").alias("_i"), F.col("sense").alias("_s"), F.col("token_id").alias("observed_token"))
    return lines.join(known, (F.col("instrument_id") == F.col("_i")) & (F.col("client_side_disclosed") == F.col("_s")), "left").drop("_i", "_s")


def tokens_for(lines: DataFrame, token_map: DataFrame) -> DataFrame:
    """``lines`` with ``observed_token``; a side that is no sense, or an instrument the dictionary lacks, fails the query."""
    out = observable_tokens(lines, token_map)
    side, instrument = F.col("client_side_disclosed"), F.col("instrument_id")
    wrong = F.when(side.isNull() | ~side.isin(*SENSES), F.concat(F.lit("no such sense: "), F.coalesce(side.cast("string"), F.lit("null")))).when(
        F.col("observed_token").isNull(), F.concat(F.lit("no token for instrument "), F.coalesce(instrument.cast("string"), F.lit("null")))
    )
    return out.withColumn("observed_token", F.when(wrong.isNull(), F.col("observed_token")).otherwise(F.raise_error(wrong).cast("long")))


def decode(df: DataFrame, column: str, known: DataFrame) -> DataFrame:
    """``df`` with ``family, raw_id`` of the global ids in ``column``, null for ids that ``known`` (``vocabulary``) lacks."""
    own = known.select("family", "raw_id", F.col("gid").alias("_gid"))
    return df.drop("family", "raw_id").join(own, F.col(column) == F.col("_gid"), "left").drop("_gid")


def token_rows(token_map: DataFrame) -> DataFrame:
    """``token_id, instrument_row, sense``: each token's instrument as a row number of the sorted instruments."""
    rows = sorted_codes(token_map, "instrument_id", 0).select(F.col("raw_id").alias("_i"), F.col("gid").alias("instrument_row"))
    return token_map.join(rows, F.col("instrument_id") == F.col("_i")).select("token_id", "instrument_row", F.col("sense").cast("long").alias("sense"))


def register(token_map: DataFrame, newcomers: DataFrame) -> DataFrame:
    """``token_map`` with three more tokens for each of ``newcomers`` (``instrument_id, born_ts``), a sense each.

    New ids go on from the greatest known, in the order of (birth, instrument).
    An instrument that is known or comes twice fails the query, one without id
    or birth takes no part.
    """
    rows = newcomers.select(F.col("instrument_id").cast("long").alias("instrument_id"), "born_ts").where("instrument_id IS NOT NULL AND born_ts IS NOT NULL")
    once = rows.groupBy("instrument_id").agg(F.min("born_ts").alias("born_ts"), F.count(F.lit(1)).alias("_n"))
    known = token_map.select(F.col("instrument_id").alias("_i")).distinct()
    checked = once.join(known, F.col("instrument_id") == F.col("_i"), "left")
    fresh = F.when((F.col("_n") == 1) & F.col("_i").isNull(), F.col("instrument_id")).otherwise(F.raise_error(F.concat(F.lit("already registered: instrument "), F.col("instrument_id").cast("string"))).cast("long"))
    ranked = rank_in_group(checked.select(fresh.alias("instrument_id"), "born_ts"), [], ["born_ts", "instrument_id"], F.floor(F.unix_micros(F.col("born_ts").cast("timestamp")) / 86_400_000_000), salts=1)
    after = F.coalesce(token_map.agg(F.max("token_id")).scalar() + 1, F.lit(0))
    senses = ranked.select("*", F.explode(F.array(*map(F.lit, SENSES))).alias("sense"))
    types = dict(token_map.dtypes)
    added = senses.select((after + F.col("rank") * len(SENSES) + F.col("sense")).alias("token_id"), "instrument_id", "sense", "born_ts", F.lit(None).alias("retired_ts"))
    return token_map.unionByName(added.select(*(F.col(c).cast(types[c]).alias(c) for c in token_map.columns)))


def retire(token_map: DataFrame, retired: DataFrame) -> DataFrame:
    """``token_map`` in which the instruments of ``retired`` (``instrument_id, retired_ts``) end then, at the earliest time if there are several."""
    ends = retired.groupBy(F.col("instrument_id").alias("_i")).agg(F.min("retired_ts").alias("_end"))
    joined = token_map.join(ends, F.col("instrument_id") == F.col("_i"), "left")
    return joined.select(*(F.coalesce("_end", "retired_ts").alias(c) if c == "retired_ts" else c for c in token_map.columns))


def valid_at(entries: DataFrame, born: str, retired: str, at: Column) -> DataFrame:
    """Entries in force at a time: born at or before it and not yet retired; a null birth is never in force."""
    return entries.where((F.col(born) <= at) & (F.col(retired).isNull() | (F.col(retired) > at)))


def layout_breaks(token_map: DataFrame) -> DataFrame:
    """Instruments whose tokens are not three consecutive ids in the order of their senses."""
    by = token_map.groupBy("instrument_id").agg(F.count(F.lit(1)).alias("n"), F.min("token_id").alias("first"), F.min(F.col("token_id") - F.col("sense")).alias("low"), F.max(F.col("token_id") - F.col("sense")).alias("high"))
    return by.where("n <> 3 OR low <> high OR low <> first").select("instrument_id", "n")
