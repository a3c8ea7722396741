"""Defaults, reserved column names and the encoder model registry."""

from __future__ import annotations

from dataclasses import dataclass

# Defaults and reserved names users of the operators rely on.
DEFAULT_MODEL = "mini"
DEFAULT_METRIC = "cosine"
DEFAULT_TOP_K = 10
DEFAULT_DECIMALS = 2
DEFAULT_MATCH_THRESHOLD = 0.90
VECTOR_PREFIX = "_emb_"
COMPOSITE_KEY = "_composite_key"
ROW_ID = "_row_id"


@dataclass(frozen=True)
class Model:
    shortcut: str
    id: str
    dim: int


# Shortcut, public model id, vector size.
MODELS: dict[str, Model] = {
    m.shortcut: m
    for m in (
        Model("mini", "all-MiniLM-L6-v2", 384),
        Model("bge-large", "BAAI/bge-large-en-v1.5", 1024),
        Model("nomic", "nomic-ai/nomic-embed-text-v1.5", 768),
        Model("gte", "Alibaba-NLP/gte-large-en-v1.5", 1024),
        Model("e5", "intfloat/e5-large-v2", 1024),
        Model("address", "pawan2411/address-emnet", 768),
        Model("entity", "themelder/arctic-embed-xs-entity-resolution", 384),
    )
}

# Words in a column name that route it to a domain model, in order of
# precedence. The test is a lower-cased substring test.
ROUTING_WORDS: dict[str, tuple[str, ...]] = {
    "address": (
        "address", "addr", "street", "city", "state", "zip", "postal", "location", "country",
        "region",
    ),
    "entity": (
        "company", "vendor", "supplier", "customer", "client", "organization", "org",
        "employer", "counterparty", "partner", "institution", "firm",
    ),
}


def find_model(name: str) -> Model:
    """Model record for a shortcut or a full model id."""
    by_id = {m.id: m for m in MODELS.values()}
    found = MODELS.get(name) or by_id.get(name)
    if found is None:
        raise ValueError(f"Unknown model '{name}'. Known shortcuts: {', '.join(sorted(MODELS))}")
    return found


def same_dimension(models: list[str]) -> int:
    """Common vector size of the models; vectors of unequal size cannot be averaged."""
    dims = {m: find_model(m).dim for m in models}
    if len(set(dims.values())) != 1:
        raise ValueError(f"Models differ in dimension and cannot be combined: {dims}")
    return next(iter(dims.values()))
