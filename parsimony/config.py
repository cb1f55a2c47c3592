"""Settings of a reduction."""

from __future__ import annotations

from dataclasses import dataclass

LEVELS = ("lite", "full", "ultra", "wenyan")
FALSE, TRUE = frozenset(("0", "false", "no", "off")), frozenset(("1", "true", "yes", "on"))


def default_on(value: str | None) -> bool:
    """A switch that is on unless its text says no."""
    return (value or "").strip().lower() not in FALSE


def is_true(value: str | None) -> bool:
    """A switch that is off unless its text says yes."""
    return (value or "").strip().lower() in TRUE


@dataclass(frozen=True)
class ReduceConfig:
    """Level, number of passes (0: to the fixpoint) and which stages run. ``all_roles`` also reduces system and assistant messages.

    ``longest_line`` ends a text with headings at a line of so many bytes, as a line reader with such a buffer does; by default no line is too long.
    """

    level: str = "ultra"
    passes: int = 0
    filler: bool = True
    synonyms: bool = True
    gloss: bool = True
    arrows: bool = True
    all_roles: bool = False
    longest_line: int | None = None

    def __post_init__(self):
        if self.level not in LEVELS:
            raise ValueError(f"level must be one of {', '.join(LEVELS)}")

    @property
    def base_level(self) -> str:
        """The level of the reduction proper; wenyan is ultra with a change of script."""
        return "ultra" if self.level == "wenyan" else self.level

    @classmethod
    def from_settings(cls, settings: dict[str, str]) -> ReduceConfig:
        """From texts such as session settings: level, passes, and switches that are on by default."""
        level = (settings.get("level") or "").strip().lower() or "ultra"
        switches = {k: default_on(settings.get(k)) for k in ("filler", "synonyms", "gloss", "arrows")}
        return cls(level, int(settings.get("passes") or 0), **switches, all_roles=is_true(settings.get("all_roles")))
