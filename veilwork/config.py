"""What a masking run does."""

from __future__ import annotations

from dataclasses import dataclass

from veilwork.functions.rules import FULL, LEAN, LEGACY, PROFILES, Rule, rules_of
from veilwork.functions.vocabulary import ENTITIES, NUMBERED, Entity


#: Place of the first of a configuration's own rules, in the order of spans.
OWN_PLACE = 500


@dataclass(frozen=True)
class MaskConfig:
    """profile: "lean" scans the text as it is and has one token for each type; "full" normalises, applies the bank's rules
    and numbers tokens; "legacy" is the first generation: looser patterns, a score threshold, its own ranking.

    rules: more rules, that are scanned after those of the profile. types: more entity types, or others in place of those of
    the same name; a rule's type that is neither here nor known is refused.

    numbered: the types whose tokens are numbered. branches: whether branch codes are masked. entities: only these types are
    scanned for (all if None). threshold: least score in legacy.
    """

    profile: str = FULL
    threshold: float = 0.60
    branches: bool = True
    entities: frozenset[str] | None = None
    least_asr: float = 0.70
    least_labelled: float = 0.8
    most_density: float = 3.0
    numbered: frozenset[str] = NUMBERED
    nfc: bool = True
    rules: tuple[Rule, ...] = ()
    types: tuple[Entity, ...] = ()

    def __post_init__(self) -> None:
        if self.profile not in PROFILES:
            raise ValueError(f"profile must be one of {', '.join(PROFILES)}")
        known = self.all_types
        if unknown := ((self.entities or set()) | {r.entity for r in self.rules}) - set(known):
            raise ValueError(f"unknown entity types: {', '.join(sorted(unknown))}")

    @property
    def all_types(self) -> dict[str, Entity]:
        return ENTITIES | {t.name: t for t in self.types}

    @property
    def all_rules(self) -> tuple[tuple[int, Rule], ...]:
        """(place, rule) of the profile's rules and of one's own."""
        own = tuple((OWN_PLACE + i, r) for i, r in enumerate(self.rules) if self.entities is None or r.entity in self.entities)
        return rules_of(self.profile, self.branches, self.entities) + own

    @property
    def all_numbered(self) -> frozenset[str]:
        """The types whose tokens are numbered: `numbered`, and those of `types` that say so."""
        return self.numbered | {t.name for t in self.types if t.numbered}

    @property
    def lean(self) -> bool:
        return self.profile == LEAN

    @property
    def legacy(self) -> bool:
        return self.profile == LEGACY
