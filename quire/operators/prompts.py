"""What a model is told: the prompt file with the run's settings, and the shape of its answer."""

from __future__ import annotations

import json
import os

from quire.functions.constants import CATEGORIES, GROUNDINGS, ROW_FIELDS, TOP_FIELDS
from quire.operators.estimate import Settings

#: Bounds of a note in words and what it should hold, by quality.
QUALITY_TEXT = {
    "low": ("15 to 40", "say what the quoted passage means; leave minor sentences alone"),
    "medium": ("25 to 60", "say what the passage means and why it matters here, with its reason, method or result where it has one; explain a term that the note needs"),
    "high": ("40 to 90", "cover concept, evidence, method, assumptions and what the passage leaves open, as far as they are there; add nothing that the text does not have"),
}
DENSITY_TEXT = {
    "selective": "only main claims, methods and results",
    "balanced": "main points, and the terms, assumptions and evidence behind them",
    "dense": "a close reading, without repeats and boilerplate",
}


def tier(quotes_per_page: int) -> str:
    return "selective" if quotes_per_page <= 2 else "balanced" if quotes_per_page <= 5 else "dense"


def settings_overlay(settings: Settings) -> str:
    """The run's density and quality, in words."""
    n = settings.quotes_per_page
    words, aim = QUALITY_TEXT[settings.quality]
    return "\n".join([
        "## Density", f"A page gets {n} notes at most, and a range of pages {n} times its pages. This is a limit, no quota: fewer, or none, is right where little is worth a note.",
        f"Scope: {DENSITY_TEXT[tier(n)]}. Quotes of one page differ; notes follow the order of their quotes.",
        f"## Quality: {settings.label()}", f"Length: {words} words. In each note {aim}. What goes beyond the text is marked interpretation or uncertain.",
    ])


def load_system_prompt(path: str, settings: Settings | None = None) -> str:
    """The prompt file's text and, if there are settings, their overlay."""
    if not os.path.isfile(path):
        raise FileNotFoundError(f"no prompt file: {path}")
    with open(path, encoding="utf-8") as f:
        base = f.read()
    return base if settings is None else f"{base}\n\n{settings_overlay(settings)}"


def response_schema() -> dict:
    """JSON schema of an answer; no further fields."""
    kinds = {"page": {"type": "integer"}, "category": {"type": "string", "enum": CATEGORIES}, "grounding": {"type": "string", "enum": GROUNDINGS}}
    row = {"type": "object", "properties": {f: kinds.get(f, {"type": "string"}) for f in ROW_FIELDS}, "required": ROW_FIELDS, "additionalProperties": False}
    top = {"chapter_title": {"type": "string"}, "annotations": {"type": "array", "items": row}}
    return {"type": "object", "properties": {f: top.get(f, {"type": "integer"}) for f in TOP_FIELDS}, "required": TOP_FIELDS, "additionalProperties": False}


def chat_request(model: str, system: str, message: str, most_tokens: int) -> dict:
    """The body of one call to a chat service that answers by schema."""
    shape = {"type": "json_schema", "json_schema": {"name": "notes", "strict": True, "schema": response_schema()}}
    return {"model": model, "max_completion_tokens": most_tokens, "messages": [{"role": "system", "content": system}, {"role": "user", "content": message}], "response_format": shape}


def chat_provider(send, model: str, system: str, most_tokens: int):
    """A provider of answers by ``send``, a callable from a request body to the answer's text; it runs in the tasks."""

    def provider(message: str, errors: list[str]) -> str:
        return send(json.loads(json.dumps(chat_request(model, system, message, most_tokens))))

    return provider
