"""Access classes of the canonical tape's columns, and the checks that hold them together."""

from pyspark.sql import types as T

OBSERVABLE, LATENT, SELECTOR, GATED = "observable", "latent", "selector", "policy_gated"

# The columns of the canonical tape in order with their types, those that the observable tape adds, and the
# class of those that are not plainly observable.
TYPES = {
    "event_id": "bigint", "package_id": "bigint", "line_no": "int", "n_lines": "int", "package_type": "tinyint", "ts": "timestamp", "trade_date": "date", "grid_idx": "bigint", "response_deadline": "timestamp",
    "client_id": "bigint", "instrument_id": "bigint", "client_side_disclosed": "tinyint", "qty_par": "bigint", "qty_bucket": "tinyint", "n_dealers": "smallint", "anonymous": "boolean", "platform": "smallint",
    "token_id": "bigint", "client_side_true": "tinyint", "our_in_panel": "boolean", "received": "boolean", "action": "tinyint", "quote_sprd_bp": "float", "quote_px": "double", "response_ts": "timestamp",
    "enquiry_outcome": "tinyint", "our_result": "tinyint", "outcome_ts": "timestamp", "exec_sprd_bp": "float", "exec_px": "double", "cover_sprd_bp": "float", "cover_px": "double", "rec_token_id": "bigint",
    "rec_delta": "float", "rec_propensity": "float", "policy_id": "int",
}
ADDED = {"side_revealed": "tinyint", "side_reveal_ts": "timestamp"}
TAPE = tuple(TYPES)
RESTRICTED = {
    "grid_idx": LATENT, "token_id": LATENT, "client_side_true": LATENT, "our_in_panel": SELECTOR, "received": SELECTOR,
    "exec_sprd_bp": GATED, "exec_px": GATED, "cover_sprd_bp": GATED, "cover_px": GATED,
}


class ContractError(ValueError):
    """A frame does not keep to the contract of its columns."""


def class_of(column: str) -> str:
    if column not in TAPE:
        raise ContractError(f"{column} is no column of the tape")
    return RESTRICTED.get(column, OBSERVABLE)


def contract() -> list[str]:
    """Columns of the observable tape; the added ones stand before the recommendation's."""
    kept = [c for c in TAPE if class_of(c) in (OBSERVABLE, GATED)]
    at = kept.index("rec_token_id")
    return [*kept[:at], *ADDED, *kept[at:]]


def check_columns(found: list[str], wanted: list[str]) -> None:
    if len(set(found)) != len(found) or set(found) != set(wanted):
        raise ContractError(f"unknown columns {sorted(set(found) - set(wanted))}, missing columns {sorted(set(wanted) - set(found))}")


def check_contract(schema: T.StructType) -> None:
    """The observable tape's columns, their order and their types."""
    check_columns(schema.names, contract())
    kinds = TYPES | ADDED
    wrong = [f"{f.name} {f.dataType.simpleString()} for {name} {kinds[name]}" for f, name in zip(schema, contract()) if (f.name, f.dataType.simpleString()) != (name, kinds[name])]
    if wrong:
        raise ContractError(f"columns out of place or of another type: {wrong}")


def with_classes(schema: T.StructType) -> T.StructType:
    """The schema with every field's class in its metadata."""
    check_columns(schema.names, TAPE)
    return T.StructType([T.StructField(f.name, f.dataType, f.nullable, {**f.metadata, "class": class_of(f.name)}) for f in schema])
