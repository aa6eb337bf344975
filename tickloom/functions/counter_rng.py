"""Random numbers addressed by a counter: the same row gets the same draw however the data is partitioned."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the published Philox4x32-10 generator: multipliers, key increments, rounds.
_M0, _M1 = 0xD2511F53, 0xCD9E8D57
_W0, _W1 = 0x9E3779B9, 0xBB67AE85
_MASK = 0xFFFFFFFF


def _lit(x: int) -> Column:
    return F.lit(x).cast("long")


def _high_low(x: Column, m: int) -> tuple[Column, Column]:
    """High and low 32 bits of x * m, by halves, so that no product exceeds 63 bits."""
    low = x * _lit(m & 0xFFFF)
    middle = x * _lit(m >> 16) + F.shiftright(low, 16)
    return F.shiftright(middle, 16), F.shiftleft(middle.bitwiseAND(_lit(0xFFFF)), 16).bitwiseOR(low.bitwiseAND(_lit(0xFFFF)))


def philox(counter: Column, stream: Column | int = 0, key: tuple[int, int] = (0, 0)) -> Column:
    """Four 32-bit words (array of long) for the counter words (counter low, counter high, stream, 0)."""

    def round_(state: Column, number: Column) -> Column:
        k0 = (_lit(key[0]) + number * _lit(_W0)).bitwiseAND(_lit(_MASK))
        k1 = (_lit(key[1]) + number * _lit(_W1)).bitwiseAND(_lit(_MASK))
        h0, l0 = _high_low(state[0], _M0)
        h1, l1 = _high_low(state[2], _M1)
        return F.array(h1.bitwiseXOR(state[1]).bitwiseXOR(k0), l1, h0.bitwiseXOR(state[3]).bitwiseXOR(k1), l0)

    words = F.array(counter.bitwiseAND(_lit(_MASK)), F.shiftrightunsigned(counter, 32), _lit(stream) if isinstance(stream, int) else stream, _lit(0))
    return F.aggregate(F.sequence(_lit(0), _lit(9)), words, round_)


def uniform(word: Column) -> Column:
    """A 32-bit word as a number strictly between 0 and 1."""
    return (word.cast("double") + 0.5) / 4294967296.0


def normal_pair(words: Column) -> tuple[Column, Column]:
    """Two independent standard normal numbers from the first two words (Box-Muller)."""
    radius = F.sqrt(-2.0 * F.ln(uniform(words[0])))
    angle = 2 * math.pi * uniform(words[1])
    return radius * F.cos(angle), radius * F.sin(angle)


def inverse_cdf(u: Column, cumulative: Column) -> Column:
    """How many entries of a rising array of cumulative probabilities ``u`` exceeds."""
    return F.size(F.filter(cumulative, lambda c: u > c))


def categorical(u: Column, weights: Column) -> Column:
    """Index drawn from an array of non-negative weights; -1 if they sum to 0, null if there are none to read."""
    running = F.aggregate(weights, F.struct(F.lit(0.0).alias("t"), F.array().cast("array<double>").alias("c")), lambda a, w: F.struct((a["t"] + w).alias("t"), F.concat(a["c"], F.array(a["t"] + w)).alias("c")))
    return F.when(running["t"] > 0, F.size(F.filter(running["c"], lambda c: c < u * running["t"]))).when(weights.isNotNull(), -1)


def poisson(u: Column, mean: Column) -> Column:
    """A Poisson count by inverse distribution from one uniform number; 0 for a mean of 0, null for a null, negative or infinite mean.

    Terms are taken relative to the first one and divided by their sum, so that
    none underflows. They span 12 standard deviations and 64 about the mean;
    what lies beyond has less than e^-70 of the distribution, while a number
    made of a 32-bit word is at least 2^-33 from 0 and 1.
    """
    m = mean.cast("double")
    spread = 12 * F.sqrt(m) + 64
    low = F.greatest(F.floor(m - spread).cast("long"), _lit(0))
    rest = F.sequence(low + 1, F.ceil(m + spread).cast("long"))

    def total(state: Column, k: Column) -> Column:
        term = state["term"] * m / k
        return F.struct(term.alias("term"), (state["sum"] + term).alias("sum"))

    def add(state: Column, k: Column) -> Column:
        term = state["term"] * m / k
        return F.struct(term.alias("term"), (state["sum"] + term).alias("sum"), state["at"].alias("at"), (state["n"] + (state["at"] > state["sum"]).cast("long")).alias("n"))

    one = F.lit(1.0)
    at = u * F.aggregate(rest, F.struct(one.alias("term"), one.alias("sum")), total)["sum"]
    return F.when(u.isNotNull() & (m >= 0) & (m < float("inf")), F.aggregate(rest, F.struct(one.alias("term"), one.alias("sum"), at.alias("at"), low.alias("n")), add)["n"])
