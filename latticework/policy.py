"""Who may do what: allow rules over actor, action and branch; nothing is allowed without one."""

from __future__ import annotations

from dataclasses import dataclass
from fnmatch import fnmatchcase

ACTIONS = frozenset("read export change schema_apply branch_create branch_delete branch_merge admin graph_list".split())


@dataclass(frozen=True)
class Rule:
    actors: tuple[str, ...]
    actions: tuple[str, ...]
    branches: tuple[str, ...] = ("*",)


class Denied(PermissionError):
    pass


@dataclass(frozen=True)
class Policy:
    rules: tuple[Rule, ...] = ()

    def allows(self, actor: str, action: str, branch: str = "main") -> bool:
        if action not in ACTIONS:
            raise ValueError(f"unknown action {action!r}")
        return any(any(fnmatchcase(actor, a) for a in r.actors) and (action in r.actions or "*" in r.actions) and any(fnmatchcase(branch, b) for b in r.branches) for r in self.rules)

    def require(self, actor: str, action: str, branch: str = "main") -> None:
        if not self.allows(actor, action, branch):
            raise Denied(f"{actor} may not {action} on {branch}")

    def test(self, cases: list[tuple[str, str, str, bool]]) -> list[tuple[str, str, str, bool]]:
        """The cases (actor, action, branch, expected) that come out otherwise."""
        return [c for c in cases if self.allows(*c[:3]) != c[3]]
