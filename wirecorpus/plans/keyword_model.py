"""A stand-in for a language model in queries and tests."""

from __future__ import annotations

from collections.abc import Sequence


class KeywordModel:
    """Deterministic: the first keyword found in a prompt decides the answer."""

    def __init__(self, rules: Sequence[tuple[str, str]], default: str) -> None:
        self.rules, self.default = list(rules), default

    def __call__(self, prompts: list[str], settings: dict) -> list[str]:
        find = lambda p: next((a for k, a in self.rules if k in p), self.default)
        return [find(p) for p in prompts]
