"""Settings of a run: services, lenient loading, ordered validation, output names."""

from __future__ import annotations

import dataclasses
import json
import os
import re
import tempfile
from dataclasses import dataclass, field
from pathlib import Path
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelight.functions.text import FOLD_FROM, FOLD_MANY, FOLD_TO, LANGUAGE_TAG
from quirelight.operators import ordered as O

# Known services (id, name, protocol, endpoint, variables that may hold the key, free tier, no key needed).
SERVICES = [
    ("anthropic", "Anthropic (Claude)", "anthropic", "", ["ANTHROPIC_API_KEY"], False, False),
    ("gemini", "Google AI Studio (Gemini)", "openai", "https://generativelanguage.googleapis.com/v1beta/openai/", ["GEMINI_API_KEY", "GOOGLE_API_KEY"], True, False),
    ("mistral", "Mistral", "openai", "https://api.mistral.ai/v1", ["MISTRAL_API_KEY"], True, False),
    ("groq", "Groq", "openai", "https://api.groq.com/openai/v1", ["GROQ_API_KEY"], True, False),
    ("cerebras", "Cerebras", "openai", "https://api.cerebras.ai/v1", ["CEREBRAS_API_KEY"], True, False),
    ("nvidia", "NVIDIA NIM", "openai", "https://integrate.api.nvidia.com/v1", ["NVIDIA_API_KEY"], True, False),
    ("cohere", "Cohere", "openai", "https://api.cohere.ai/compatibility/v1", ["COHERE_API_KEY"], True, False),
    ("cloudflare", "Cloudflare Workers AI", "openai", "https://api.cloudflare.com/client/v4/accounts/{account_id}/ai/v1", ["CLOUDFLARE_API_TOKEN", "CLOUDFLARE_API_KEY"], True, False),
    ("deepl", "DeepL", "deepl", "https://api-free.deepl.com/v2", ["DEEPL_API_KEY", "DEEPL_AUTH_KEY"], False, False),
    ("openai", "OpenAI", "openai", "https://api.openai.com/v1", ["OPENAI_API_KEY"], False, False),
    ("openrouter", "OpenRouter", "openai", "https://openrouter.ai/api/v1", ["OPENROUTER_API_KEY"], False, False),
    ("ollama", "Ollama (local)", "openai", "http://localhost:11434/v1", [], False, True),
    ("lmstudio", "LM Studio (local)", "openai", "http://localhost:1234/v1", [], False, True),
    ("openai-compatible", "Custom endpoint", "openai", "", ["OPENAI_API_KEY"], False, False),
    ("offline", "Offline (capitals)", "offline", "", [], False, True),
]
FORMATS = ("epub", "txt")
EFFORTS = ("low", "medium", "high", "xhigh", "max")


def services(spark: SparkSession) -> DataFrame:
    """The catalogue, best first: the first service, free tiers, services without a key, the rest."""
    rows = [(k, *s) for k, s in enumerate(SERVICES)]
    known = spark.createDataFrame(rows, "ordinal int, id string, name string, protocol string, endpoint string, key_env array<string>, free_tier boolean, no_key boolean")
    return ranked(known, SERVICES[0][0]).orderBy("place")


def ranked(known: DataFrame, first: str) -> DataFrame:
    """``known`` (ordinal, id, free_tier, no_key) with ``place``: the service ``first``, free tiers, those without a key, the rest, each in their order.

    Numbers are dense over four tiers of ordinals, in blocks, so the list may have any length.
    """
    tier = F.when(F.col("id") == first, 0).when(F.col("free_tier"), 1).when(F.col("no_key"), 2).otherwise(3)
    rows = known.withColumns({"_list": F.lit(0), "_tier": tier})
    block = F.col("_tier") * F.lit(1 << 40) + F.floor(F.col("ordinal") / O.SPAN)
    return O.numbered(rows, ("_list",), ("ordinal",), block).drop("_list", "_tier", "places")


def key_of(service: str, environment: dict[str, str] | None = None) -> str:
    """The first key the environment holds for the service."""
    environment = os.environ if environment is None else environment
    names = next((s[4] for s in SERVICES if s[0] == service), [])
    return next((environment[n].strip() for n in names if environment.get(n, "").strip()), "")


@dataclass
class Settings:
    provider: str = "offline"
    model: str = ""
    base_url: str = ""
    target_language: str = "French"
    target_code: str = "fr"
    source_language: str = ""
    source_code: str = ""
    glossary: str = ""
    style_notes: str = ""
    about: str = ""
    translate_titles: bool = True
    chunk_chars: int = 4000
    max_segments: int = 40
    max_tokens: int = 16000
    attempts: int = 4
    context_chars: int = 400
    timeout_seconds: int = 300
    requests_per_minute: int = 0
    effort: str = ""
    salvage_pass: bool = True
    output_dir: str = ""
    format: str = "epub"
    resume: bool = True
    unknown: dict = field(default_factory=dict, compare=False, repr=False)

    @property
    def endpoint(self) -> str:
        return self.base_url.strip() or next((s[3] for s in SERVICES if s[0] == self.provider), "")

    def problem(self) -> str | None:
        """The first thing that is wrong, in a fixed order; None if nothing is."""
        known = {s[0]: s[2] for s in SERVICES}
        protocol, at = known.get(self.provider), self.endpoint
        url = urlsplit(at)
        low = [("chunk_chars", 1), ("max_segments", 1), ("max_tokens", 1), ("attempts", 1), ("context_chars", 0), ("requests_per_minute", 0), ("timeout_seconds", 1)]
        long = [("target_language", 100), ("source_language", 100), ("about", 2000), ("style_notes", 10000), ("glossary", 200000)]
        checks = [
            ("provider", protocol is None),
            ("model", protocol in ("anthropic", "openai") and not self.model.strip()),
            ("target_language", not self.target_language.strip()),
            ("base_url", protocol == "openai" and not at),
            ("base_url", "{" in at),
            ("target_code", protocol == "deepl" and not self.target_code.strip()),
            ("base_url", bool(at) and not (url.scheme in ("http", "https") and url.netloc)),
            ("effort", protocol == "anthropic" and bool(self.effort.strip()) and self.effort.strip().lower() not in EFFORTS),
            *[(name, getattr(self, name) < least) for name, least in low],
            *[(name, len(getattr(self, name)) > most) for name, most in long],
            *[(name, bool(getattr(self, name)) and not re.fullmatch(LANGUAGE_TAG, getattr(self, name))) for name in ("target_code", "source_code")],
            ("format", self.format not in FORMATS),
            ("output_dir", bool(self.output_dir) and not Path(self.output_dir).is_dir()),
        ]
        return next((name for name, wrong in checks if wrong), None)


def problems(rows: DataFrame) -> DataFrame:
    """``rows`` of settings (columns named as they are, the others at their defaults) with ``problem``, the first in order or null."""
    names = [f.name for f in dataclasses.fields(Settings) if f.name in rows.columns]

    @F.pandas_udf("string")
    def first(given: pd.DataFrame) -> pd.Series:
        return pd.Series([Settings(**{n: v.item() if hasattr(v, "item") else v for n, v in zip(names, r, strict=True)}).problem() for r in given[names].itertuples(index=False)], dtype=object)

    return rows.withColumn("problem", first(F.struct(*names)))


def load(path: str) -> tuple[Settings, str | None]:
    """(settings, error): unknown names are kept apart, missing or ill-typed ones take their default; an unreadable file gives defaults and its error."""
    try:
        raw = json.loads(Path(path).read_text())
        if not isinstance(raw, dict):
            raise ValueError("not an object")
    except (OSError, ValueError) as e:
        return Settings(), str(e)
    kinds = {f.name: type(f.default) for f in dataclasses.fields(Settings) if f.name != "unknown"}
    good = {k: v for k, v in raw.items() if k in kinds and type(v) is kinds[k]}
    return Settings(**good, unknown={k: v for k, v in raw.items() if k not in kinds}), None


def save(settings: Settings, path: str) -> None:
    """Written beside and renamed, for the owner only."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True, mode=0o700)
    values = dataclasses.asdict(settings)
    values |= values.pop("unknown")
    handle, part = tempfile.mkstemp(dir=target.parent)
    with os.fdopen(handle, "w") as f:
        json.dump(values, f, indent=2, ensure_ascii=False)
    os.chmod(part, 0o600)
    os.replace(part, target)


def plain_slug(text: str, fallback: str = "translated") -> str:
    text = text.lower()
    for letter, plain in FOLD_MANY.items():
        text = text.replace(letter, plain)
    return re.sub("[^a-z0-9]+", "-", text.translate(str.maketrans(FOLD_FROM, FOLD_TO))).strip("-") or fallback


def output_path(source: str, settings: Settings) -> Path:
    """``<folder>/<stem>.<code or language>.<format>``, numbered so that nothing is overwritten."""
    name = Path(source)
    wanted = Path(settings.output_dir or name.parent) / f"{name.stem}.{settings.target_code or plain_slug(settings.target_language)}.{settings.format}"
    free = [wanted, *(wanted.with_suffix(f".{k}{wanted.suffix}") for k in range(2, 1000))]
    return next((p for p in free if not p.exists()), wanted)


def check_writable(path: str | Path) -> None:
    """Fail before anything is spent: the folder takes a file and the target is no folder."""
    if Path(path).is_dir():
        raise IsADirectoryError(path)
    with tempfile.TemporaryFile(dir=Path(path).parent):
        pass
