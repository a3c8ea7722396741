"""Named parameter sets for common record-matching tasks."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Preset:
    id: str
    columns: tuple[str, ...]
    key: str
    embed: tuple[str, ...]
    model: str
    threshold: float


# Preset id, columns, key, embedded columns, model, and the similarity from which
# rows are likely duplicates.
PRESETS: dict[str, Preset] = {
    p.id: p
    for p in (
        Preset(
            "vendor-dedup",
            ("Vendor ID", "Company Name", "Address", "Category", "Annual Spend"),
            "Vendor ID",
            ("Company Name",),
            "entity",
            0.85,
        ),
        Preset(
            "address-cleansing",
            ("Customer ID", "Full Name", "Address", "City", "State", "ZIP"),
            "Customer ID",
            ("Address",),
            "address",
            0.90,
        ),
        Preset(
            "product-catalog",
            ("SKU", "Product Name", "Description", "Category", "Price"),
            "SKU",
            ("Product Name", "Description"),
            "mini",
            0.90,
        ),
        Preset(
            "lead-dedup",
            ("Lead ID", "Company", "Contact Name", "Title", "Notes"),
            "Lead ID",
            ("Company", "Notes"),
            "entity",
            0.85,
        ),
        Preset(
            "counterparty-screening",
            ("Entity ID", "Legal Name", "DBA Name", "Country", "Risk Score"),
            "Entity ID",
            ("Legal Name", "DBA Name"),
            "entity",
            0.85,
        ),
    )
}


def find_preset(id: str) -> Preset:
    if id not in PRESETS:
        raise ValueError(f"Unknown preset: {id}. Available: {', '.join(PRESETS)}")
    return PRESETS[id]
