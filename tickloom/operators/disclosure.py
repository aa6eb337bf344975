"""The observable view of a canonical tape under a disclosure policy, and an independent audit of such views."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.classes import ADDED, TAPE, TYPES, check_columns, check_contract, contract

# Codes of the tape.
TWO_WAY = 2
TRADED, NOT_TRADED, CANCELLED, EXPIRED = 0, 1, 2, 3
WON, COVER, LOST, NO_QUOTE = 0, 1, 2, 3


@dataclass(frozen=True)
class Policy:
    """Which ends of an enquiry reveal a two-way side, how late, and which prices are shown.

    ``sides_of_trades`` holds results of traded enquiries and ``sides_of_others``
    outcomes without a trade after which the side is known; ``cover_shown_to``
    holds the results that see the cover price; ``prints`` shows executions of
    enquiries that others won.
    """

    sides_of_trades: frozenset[int] = frozenset({WON, COVER})
    sides_of_others: frozenset[int] = frozenset()
    lag_us: int = 0
    cover_shown_to: frozenset[int] = frozenset({WON})
    prints: bool = False


DEFAULT = Policy()
STRICT = Policy(sides_of_trades=frozenset({WON}), cover_shown_to=frozenset())


def _among(column: str, codes: frozenset[int]) -> Column:
    return F.col(column).isin(*codes) if codes else F.lit(False)


def _traded() -> Column:
    return F.col("enquiry_outcome") == TRADED


def _gates(policy: Policy) -> tuple[Column, Column, Column]:
    """(a two-way side is revealed, the execution shows, the cover shows)"""
    side = (_traded() & _among("our_result", policy.sides_of_trades)) | _among("enquiry_outcome", policy.sides_of_others)
    execution = _traded() if policy.prints else _traded() & (F.col("our_result") == WON)
    return side, execution, _traded() & _among("our_result", policy.cover_shown_to)


def _later(ts: str, us: int) -> Column:
    return F.col(ts) + F.expr(f"INTERVAL '{us / 1e6:.6f}' SECOND") if us else F.col(ts)


def observable(tape: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """Received lines without latent columns; sides and prices as far as ``policy`` shows them.

    Raises if the columns are not exactly those of the tape; types become those of the contract. A null code opens
    no gate; a null disclosed side stays null. Repeated lines stay repeated.
    """
    check_columns(tape.columns, TAPE)
    side, execution, cover = _gates(policy)
    two_way = F.col("client_side_disclosed") == TWO_WAY
    seen = tape.where("received").select(
        *(c for c in tape.columns if not c.startswith(("exec_", "cover_"))),
        F.when(~two_way, F.col("client_side_disclosed")).when(side, F.col("client_side_true")).alias("side_revealed"),
        F.when(~two_way, F.col("ts")).when(side, _later("outcome_ts", policy.lag_us)).alias("side_reveal_ts"),
        *(F.when(execution, F.col(c)).alias(c) for c in ("exec_sprd_bp", "exec_px")),
        *(F.when(cover, F.col(c)).alias(c) for c in ("cover_sprd_bp", "cover_px")),
    )
    kinds = TYPES | ADDED
    return seen.select(*(F.col(c).cast(kinds[c]).alias(c) for c in contract()))


def _counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``rule, n_rows``: one pass, one row per rule; a null condition is no breach."""
    sums = df.agg(*(F.count(F.when(bad, 1)).alias(name) for name, bad in rules.items()))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("n_rows")) for n in rules))).alias("x")).select("x.*")


def invariants(tape: DataFrame) -> DataFrame:
    """``rule, n_rows``: lines that break what every tape must hold."""
    return _counts(
        tape,
        {
            "received_off_panel": F.col("received") & ~F.col("our_in_panel"),
            "disclosed_side_differs": (F.col("client_side_disclosed") != TWO_WAY) & (F.col("client_side_disclosed") != F.col("client_side_true")),
        },
    )


def audit(view: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """``rule, n_rows``: rows of an observable view that show more than ``policy`` allows; raises on other columns, another order or other types."""
    check_contract(view.schema)
    side, execution, cover = _gates(policy)
    two_way = F.col("client_side_disclosed") == TWO_WAY
    revealed = F.col("side_revealed").isNotNull()
    return _counts(
        view,
        {
            "disclosed_side_changed": ~two_way & ~F.col("side_revealed").eqNullSafe(F.col("client_side_disclosed")),
            "disclosed_time_changed": ~two_way & ~F.col("side_reveal_ts").eqNullSafe(F.col("ts")),
            "two_way_side_shown": two_way & revealed & ~F.coalesce(side, F.lit(False)),
            "reveal_before_request": F.col("side_reveal_ts") < F.col("ts"),
            "reveal_without_time": revealed != F.col("side_reveal_ts").isNotNull(),
            "execution_shown": (F.col("exec_px").isNotNull() | F.col("exec_sprd_bp").isNotNull()) & ~F.coalesce(execution, F.lit(False)),
            "cover_shown": (F.col("cover_px").isNotNull() | F.col("cover_sprd_bp").isNotNull()) & ~F.coalesce(cover, F.lit(False)),
        },
    )
