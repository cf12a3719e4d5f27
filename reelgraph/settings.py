"""Settings of a run: defaults, then the environment, then what the caller says."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace
from functools import lru_cache

PREFIX = "REELGRAPH_"


def truth(value: str | None, default: bool) -> bool:
    """Usual words for yes and no; the default for anything else."""
    word = (value or "").strip().lower()
    return True if word in ("1", "true", "yes", "y", "on") else False if word in ("0", "false", "no", "n", "off") else default


@dataclass(frozen=True)
class Endpoint:
    """Where a model is reached, and how."""

    model: str = ""
    api_key: str = field(default="", repr=False)
    base_url: str = ""
    max_tokens: int = 4096
    temperature: float = 0.0
    timeout: float = 300.0
    pictures_per_call: int = 64
    attempts: int = 5
    first_delay: float = 1.0
    longest_delay: float = 20.0


@dataclass(frozen=True)
class Settings:
    """What a search does; see solve(). Numbers out of range are moved into it."""

    vision: Endpoint = Endpoint()
    text: Endpoint = Endpoint(max_tokens=2048)
    encoder: str = ""
    encoder_folder: str = ""
    fps: float = 1.0
    threshold: float = 0.82
    least_frames: int = 10
    several_routes: bool = True
    visual_share: float = 0.5
    timeline_frames: int = 32
    model_relevance: bool = False
    show_evidence: bool = True
    transcripts: bool = True
    base_steps: int = 10
    base_options: int = 4
    steps_per_option: int = 1
    least_uniform: int = 4
    least_gap: float = 0.15

    def __post_init__(self):
        object.__setattr__(self, "visual_share", min(1.0, max(0.0, self.visual_share)))
        object.__setattr__(self, "timeline_frames", max(0, self.timeline_frames))
        object.__setattr__(self, "vision", replace(self.vision, pictures_per_call=max(1, self.vision.pictures_per_call)))
        # The text model is reached like the other one unless it has an address of its own.
        object.__setattr__(self, "text", replace(self.text, api_key=self.text.api_key or self.vision.api_key, base_url=self.text.base_url or self.vision.base_url))


def _read(cls, names: Mapping[str, str], prefix: str, base):
    """base with the fields that the environment has; a number that can't be read changes nothing."""
    found = {}
    for f in fields(cls):
        now, raw = getattr(base, f.name), names.get((prefix + f.name).upper())
        if isinstance(now, Endpoint):
            found[f.name] = _read(Endpoint, names, f"{prefix}{f.name}_", now)
        elif raw is not None:
            try:
                found[f.name] = truth(raw, now) if isinstance(now, bool) else type(now)(raw)
            except ValueError:
                continue
    return replace(base, **found)


def from_environment(names: Mapping[str, str] | None = None) -> Settings:
    return _read(Settings, os.environ if names is None else names, PREFIX, Settings())


@lru_cache(1)
def settings() -> Settings:
    """Those of this process, read once."""
    return from_environment()
