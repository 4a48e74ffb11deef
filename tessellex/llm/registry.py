"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from importlib import import_module

MODULES = ("quota_sample", "split_pieces", "byte_bpe", "mix_sources", "one_form", "bad_pairs", "split_overlap", "abuse_score")


def _collect(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(import_module(f"{__package__}.{name}"), what)
    return out


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict:
    return _collect("SQL")
