"""All registered queries with their oracle SQL."""

from __future__ import annotations


def load():
    from isohypsa.registry import base
    from isohypsa.registry import datasets, detection, mapdata, requests  # noqa: F401

    return base.QUERIES, base.ORACLES
