"""The rules of a robots text that hold for an agent."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote


#: Lines that say something about the agents above them, so that the next agent begins a group.
RULES = ("allow", "disallow")
SETTINGS = ("crawl-delay", "request-rate")


def _fields(text: str) -> Iterator[tuple[str, str]]:
    """(name, value) of each line that has both; an empty line is told as empty names."""
    for line in text.splitlines():
        name, colon, value = line.partition("#")[0].partition(":")
        if (colon and name.strip()) or not line:
            yield name.strip().lower(), unquote(value.strip())


def groups(text: str) -> list[tuple[list[str], list[tuple[bool, str]]]]:
    """(agents, rules) of the text's groups, in order; a rule is whether it allows, and how paths begin that it is for.

    A group are agents that follow each other and what is said below them; agents of whom nothing is said are none.  A rule that
    disallows nothing allows everything.
    """
    out: list[tuple[list[str], list[tuple[bool, str]]]] = []
    agents: list[str] = []
    said: list[tuple[bool, str] | None] = []
    for name, value in [*_fields(text), ("", "")]:
        if not name or (name == "user-agent" and said):
            if said:
                out.append((agents, [rule for rule in said if rule]))
            agents, said = [], []
        if name == "user-agent":
            agents.append(value)
        elif name in RULES + SETTINGS and agents:
            said.append((name == "allow" or not value, value) if name in RULES else None)
    return out


def rules_for(text: str, agent: str) -> list[tuple[bool, str]]:
    """The rules of the first group for ``agent`` by name, else of the first for all agents, else none."""
    name = agent.split("/")[0].lower()
    found = groups(text)
    named = [rules for agents, rules in found if "*" not in agents and any(a.lower() in name for a in agents)]
    return next(iter(named + [rules for agents, rules in found if "*" in agents]), [])
