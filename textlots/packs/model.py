"""Shape of a rule pack."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Rule:
    type: str
    keywords: tuple[str, ...]
    attrs: dict[str, str]


@dataclass(frozen=True)
class Pack:
    """Rules in order of precedence: on equal scores the earlier rule wins."""

    domain: str
    label: str
    description: str
    type_key: str
    result_keys: tuple[str, ...]
    fallback: dict[str, str]
    rules: tuple[Rule, ...] = field(default=())
