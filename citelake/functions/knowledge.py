"""Entities, relations, topics and a summary out of a model's reply."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from citelake.functions.jsonx import loads_lenient

# Entity types and lengths that stores rely on.
ENTITY_TYPES = ("ORGANIZATION", "PERSON", "PRODUCT", "TECHNOLOGY", "LOCATION", "EVENT", "CONCEPT", "ENTITY")
MOST_ENTITIES, MOST_TRIPLES, MOST_TOPICS = 40, 60, 20
NAME_CHARS, PREDICATE_CHARS, TOPIC_CHARS, SUMMARY_CHARS = 200, 120, 80, 1000


def _listed(value: Any) -> list:
    return value if isinstance(value, list) else [] if value is None else [value]


def _text(value: Any) -> str:
    return str(value or "").strip()


def _first_of(rows: Iterable[dict], key: Callable[[dict], Any], most: int) -> list[dict]:
    held: dict[Any, dict] = {}
    for row in rows:
        if len(held) >= most:
            break
        held.setdefault(key(row), row)
    return list(held.values())


def parse_knowledge(raw: str | None, most_entities: int = MOST_ENTITIES, most_triples: int = MOST_TRIPLES) -> dict:
    """``entities, triples, topics, summary``: malformed items go, repeated ones count once whatever their case."""
    found = loads_lenient(raw)
    if not isinstance(found, dict):
        return {"entities": [], "triples": [], "topics": [], "summary": ""}
    named = ({"name": _text(e.get("name")), "type": _text(e.get("type") or "ENTITY").upper()} for e in _listed(found.get("entities")) if isinstance(e, dict))
    entities = _first_of((e for e in named if e["name"]), lambda e: e["name"].lower(), most_entities)
    parts = ("subject", "predicate", "object")
    stated = ({p: _text(t.get(p)) for p in parts} for t in _listed(found.get("triples")) if isinstance(t, dict))
    triples = _first_of((t for t in stated if all(t.values())), lambda t: tuple(v.lower() for v in t.values()), most_triples)
    topics = [str(t).strip()[:TOPIC_CHARS] for t in _listed(found.get("topics")) if str(t).strip()]
    return {
        "entities": [{"name": e["name"][:NAME_CHARS], "type": e["type"] if e["type"] in ENTITY_TYPES else "ENTITY"} for e in entities],
        "triples": [
            {"subject": t["subject"][:NAME_CHARS], "predicate": t["predicate"][:PREDICATE_CHARS], "object": t["object"][:NAME_CHARS]} for t in triples
        ],
        "topics": topics[:MOST_TOPICS],
        "summary": _text(found.get("summary"))[:SUMMARY_CHARS],
    }
