"""A search profile: which skills count, how much, and the thresholds of scoring. Neutral example data; callers bring their own."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Skill:
    name: str
    aliases: tuple[str, ...]
    weight: int = 0
    supporting: bool = False


@dataclass(frozen=True)
class Profile:
    profile_id: str
    rules_version: str
    skills: tuple[Skill, ...]
    negative_skills: tuple[Skill, ...]
    countries: tuple[str, ...] = ()
    regions: tuple[str, ...] = ()
    cities: tuple[str, ...] = ()
    threshold: int = 55
    salary: dict[str, int] = field(default_factory=lambda: {"preferred": 1000, "suspicious": 2000, "full_time_minimum": 400})
    penalties: dict[str, int] = field(default_factory=lambda: {"suspicious": 20, "low": 15, "toxic": 5, "negative": 15})
    freelance: dict[str, int] = field(default_factory=lambda: {"hourly": 8, "hourly_preferred": 12, "fixed": 75, "fixed_preferred": 150})


EXAMPLE = Profile(
    "example", "example-v1",
    skills=(
        Skill("Python", ("python",), 10), Skill("Django", ("django",), 12), Skill("FastAPI", ("fastapi", "fast api"), 10), Skill("PostgreSQL", ("postgresql", "postgres"), 6),
        Skill("React", ("react", "react.js", "reactjs"), 10), Skill("TypeScript", ("typescript",), 5), Skill("REST APIs", ("rest api", "restful api", "rest apis"), 5),
        Skill("Git", ("git", "github"), 3, True), Skill("Docker", ("docker",), 4, True), Skill("Linux", ("linux",), 3, True),
    ),
    negative_skills=(Skill("Java", ("java",)), Skill("Go", ("go", "golang")), Skill("PHP", ("php", "laravel")), Skill("Angular", ("angular",))),
    countries=("CZ", "Czechia", "Czech Republic"), regions=("Europe", "EU", "EMEA", "Worldwide", "Anywhere"), cities=("Prague", "Praha"),
)
