"""The rule set: an immutable, plan-time value."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import types as T


@dataclass(frozen=True)
class Rule:
    """Mask ``column`` with ``strategy``; no table means every table."""

    table: str | None
    column: str
    strategy: str

    @classmethod
    def from_dict(cls, raw: dict) -> Rule:
        if not isinstance(raw, dict):
            raise ValueError(f"a rule is a mapping, not {raw!r}")
        for name in ("column", "strategy"):
            if not isinstance(raw.get(name), str):
                raise ValueError(f"a rule needs a text {name!r}: {raw!r}")
        table = raw.get("table")
        if table is not None and not isinstance(table, str):
            raise ValueError(f"a rule's table is text or absent: {raw!r}")
        return cls(table, raw["column"], raw["strategy"])

    def to_dict(self) -> dict:
        return {"table": self.table, "column": self.column, "strategy": self.strategy}


@dataclass(frozen=True)
class AuditConfig:
    """Which audit events are kept; an empty tuple means all."""

    enabled: bool = True
    events: tuple[str, ...] = ()


@dataclass(frozen=True)
class HealthConfig:
    """Streak lengths that change a health state."""

    unhealthy_threshold: int = 3
    healthy_threshold: int = 1


@dataclass(frozen=True)
class LimitsConfig:
    """Rate limit (none by default) and idle time-out."""

    connections_per_second: int | None = None
    idle_timeout_secs: int = 300


@dataclass(frozen=True)
class MaskPolicy:
    """Rules in order of precedence, the global switch and the settings."""

    rules: tuple[Rule, ...] = ()
    masking_enabled: bool = True
    audit: AuditConfig = field(default_factory=AuditConfig)
    health: HealthConfig = field(default_factory=HealthConfig)
    limits: LimitsConfig = field(default_factory=LimitsConfig)

    def __post_init__(self) -> None:
        object.__setattr__(self, "rules", tuple(self.rules))

    def add(self, rule: Rule) -> MaskPolicy:
        """A new rule goes last: it has the lowest precedence."""
        return replace(self, rules=(*self.rules, rule))

    def extend(self, rules: Iterable[Rule]) -> MaskPolicy:
        """Append rules as they are, duplicates included."""
        return replace(self, rules=(*self.rules, *rules))

    def delete(
        self,
        index: int | None = None,
        column: str | None = None,
        table: str | None = None,
    ) -> MaskPolicy:
        """Delete one rule by position, or all rules of a column [and table]."""
        if index is not None:
            if not 0 <= index < len(self.rules):
                raise IndexError(f"rule {index} of {len(self.rules)}")
            return replace(self, rules=self.rules[:index] + self.rules[index + 1 :])
        if column is None:
            raise ValueError("give an index or a column")
        kept = tuple(
            r
            for r in self.rules
            if r.column != column or (table is not None and r.table != table)
        )
        return replace(self, rules=kept)

    def set_enabled(self, enabled: bool) -> tuple[MaskPolicy, dict]:
        """The changed policy and the change record for the audit log."""
        change = {"masking_enabled": {"old": self.masking_enabled, "new": enabled}}
        return replace(self, masking_enabled=enabled), change

    @classmethod
    def from_dict(cls, raw: dict) -> MaskPolicy:
        if not isinstance(raw, dict) or not isinstance(raw.get("rules"), list):
            raise ValueError("a policy is a mapping with a list of 'rules'")
        enabled = raw.get("masking_enabled", True)
        if not isinstance(enabled, bool):
            raise ValueError("'masking_enabled' is true or false")
        audit = raw.get("audit") or {}
        health = raw.get("health_check") or {}
        limits = raw.get("limits") or {}
        return cls(
            rules=tuple(Rule.from_dict(r) for r in raw["rules"]),
            masking_enabled=enabled,
            audit=AuditConfig(audit.get("enabled", True), tuple(audit.get("events") or ())),
            health=HealthConfig(
                health.get("unhealthy_threshold", 3), health.get("healthy_threshold", 1)
            ),
            limits=LimitsConfig(
                limits.get("connections_per_second"), limits.get("idle_timeout_secs", 300)
            ),
        )

    def to_dict(self) -> dict:
        return {
            "masking_enabled": self.masking_enabled,
            "rules": [r.to_dict() for r in self.rules],
            "audit": {"enabled": self.audit.enabled, "events": list(self.audit.events)},
            "health_check": {
                "unhealthy_threshold": self.health.unhealthy_threshold,
                "healthy_threshold": self.health.healthy_threshold,
            },
            "limits": {
                "connections_per_second": self.limits.connections_per_second,
                "idle_timeout_secs": self.limits.idle_timeout_secs,
            },
        }


def resolve_rules(
    schema: T.StructType,
    policy: MaskPolicy,
    table: str | None = None,
    ignore_table: bool = False,
) -> dict[str, str]:
    """Strategy per column: the first rule with that column name and table.

    Names are compared exactly.  ``ignore_table`` applies every rule to every
    table.
    """
    first: dict[str, str] = {}
    for rule in policy.rules:
        if ignore_table or rule.table is None or rule.table == table:
            first.setdefault(rule.column, rule.strategy)
    return {f.name: first[f.name] for f in schema.fields if f.name in first}
