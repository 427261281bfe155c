"""Requests to prompting services: a system text that is the same for a whole run, and a user text for each batch."""

from __future__ import annotations

import json
from collections.abc import Sequence

from quirelight.operators.settings import Settings

_RULES = (
    "You translate a book into {language}, passage by passage.",
    "Each request holds a JSON list of strings; answer every string, in the same order.",
    'Reply with one JSON object: {{"translations": [...]}}, and optionally "notes": [...] for remarks to the editor.',
    "Keep every tag and every attribute as it is; move tags only with the words they mark.",
    "Keep references such as &amp; and &nbsp; intact.",
    "Leave numbers, addresses and code unchanged.",
    "Keep the author's register, tense and paragraph breaks; add nothing and leave nothing out.",
    "Use one rendering for a name or a term throughout.",
    "A string that needs no translation comes back as it is.",
)
#: Schema of a reply, for services that take one.
REPLY = {"type": "object", "properties": {"translations": {"type": "array", "items": {"type": "string"}}, "notes": {"type": "array", "items": {"type": "string"}}}, "required": ["translations"], "additionalProperties": False}


def system_text(settings: Settings, *, second: bool = False) -> str:
    parts = ["\n".join(_RULES).format(language=settings.target_language)]
    if settings.source_language.strip():
        parts[0] += f"\nThe book is written in {settings.source_language.strip()}."
    for title, text in (("About the book", settings.about), ("Glossary", settings.glossary), ("Style", settings.style_notes)):
        if text.strip():
            parts.append(f"{title}:\n{text.strip()}")
    if second:
        parts.append("An earlier answer to these strings could not be used. Take special care of their number and their tags.")
    return "\n\n".join(parts)


def payload(sources: Sequence[str]) -> str:
    return json.dumps(list(sources), ensure_ascii=False)


def user_text(sources: Sequence[str], *, book: str = "", passage: str = "", k: int = 1, n: int = 1, part: int = 1, parts: int = 1, tail: str = "") -> str:
    lines = [f"Book: {book}"] if book else []
    lines.append(f"Passage {k} of {n}" + (f": {passage}" if passage else ""))
    if parts > 1:
        lines.append(f"Part {part} of {parts}")
    if tail:
        lines.append(f"The translation so far ends:\n{tail}")
    return "\n".join([*lines, f"{len(sources)} strings:", payload(sources)])


def continuity(configured: int) -> int:
    """Characters of the translation so far that a batch is shown: a run takes a negative number for none, settings 0."""
    return configured if configured > 0 else -1


def last_runes(text: str, n: int) -> str:
    """The end of ``text``, at most n characters, with an ellipsis where it was cut."""
    return "" if n <= 0 else text if len(text) <= n else "…" + text[-n:]


def byte_excerpt(text: str, most: int = 200) -> str:
    """Collapsed text cut after ``most`` bytes, never inside a character."""
    raw = " ".join(text.split()).encode()
    return raw.decode() if len(raw) <= most else raw[:most].decode("utf-8", "ignore") + "…"
