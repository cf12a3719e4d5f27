"""Models behind plain interfaces, and deterministic stand-ins for work without any."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Sequence
from typing import Any, Protocol

import numpy as np


class Models(Protocol):
    """What a search asks of models. One object lives in a Python worker for a video's questions; it must be picklable
    or made by a factory that is."""

    def encode(self, texts: Sequence[str]) -> np.ndarray:
        """Vectors of unit length in the space of the frames' vectors."""

    def encode_images(self, images: Sequence[bytes]) -> np.ndarray:
        """A vector for each picture, in the same space, of any length."""

    def plan(self, question: str) -> str:
        """JSON: option_keywords, query_keywords, semantic_queries, general_semantic_query, vlm_query."""

    def timeline(self, video_id: int, frames: Sequence[int]) -> str:
        """Lines [MM:SS-MM:SS] what happens."""

    def observe(self, video_id: int, frames: Sequence[int], question: str, with_relevance: bool) -> str:
        """JSON: relevance, caption, refinement_plan, and ocr, the strings read in the frames."""

    def answer(self, video_id: int, frames: Sequence[int], prompt: str, system: str) -> str:
        """Free text with a line Final Answer: LETTER."""


def words(text: str) -> list[str]:
    """Lower-case runs of a-z0-9, longer than one or a digit; "text:" dropped."""
    return [t for t in re.split(r"[^a-z0-9]+", (text or "").lower().replace("text:", " ")) if len(t) > 1 or t.isdigit()]


def hashed(text: str, size: int = 64) -> np.ndarray:
    """The same vector as functions.text.embedding() makes."""
    out = np.zeros(size)
    for t in words(text):
        h = hashlib.md5(t.encode()).hexdigest()  # noqa: S324
        out[int(h[:6], 16) % size] += 1.0 if h[6] < "8" else -1.0
    return out / max(float(np.sqrt((out * out).sum())), 1e-8)


class StandIn:
    """Answers from the texts that it is given, the same in every run.

    told: what can be seen in a frame, by (video_id, frame); read: strings in its picture.
    """

    def __init__(self, told: dict[tuple[int, int], str] | None = None, read: dict[tuple[int, int], str] | None = None, size: int = 64):
        self.told, self.read, self.size = told or {}, read or {}, size

    def encode(self, texts: Sequence[str]) -> np.ndarray:
        return np.stack([hashed(t, self.size) for t in texts]) if len(texts) else np.empty((0, self.size))

    def encode_images(self, images: Sequence[bytes]) -> np.ndarray:
        """How often each byte occurs, modulo the size."""
        return np.stack([np.bincount(np.frombuffer(x, np.uint8) % self.size, minlength=self.size) for x in images]).astype(float) if len(images) else np.empty((0, self.size))

    def plan(self, question: str) -> str:
        lines = dict(re.findall(r"(?m)^\s*\(?([A-Z])\)?[.):]\s*(.+)$", question))
        head = question.split("\n", 1)[0]
        return json.dumps({"option_keywords": {k: words(v)[:5] for k, v in lines.items()}, "query_keywords": re.findall(r"\b[A-Z0-9]\w+", head)[1:], "semantic_queries": lines, "general_semantic_query": head, "vlm_query": head})

    def timeline(self, video_id: int, frames: Sequence[int]) -> str:
        ends = [*frames[1:], (frames[-1] if len(frames) else 0) + 1]
        return "\n".join(f"[{a // 60:02d}:{a % 60:02d}-{z // 60:02d}:{z % 60:02d}] {self.told[video_id, a]}" for a, z in zip(frames, ends, strict=False) if (video_id, a) in self.told)

    def observe(self, video_id: int, frames: Sequence[int], question: str, with_relevance: bool) -> str:
        seen = [self.told[video_id, f] for f in frames if (video_id, f) in self.told]
        common = set(words(" ".join(seen))) & set(words(question))
        return json.dumps({"relevance": len(common) / 10 if with_relevance else 0, "caption": " ".join(dict.fromkeys(seen)), "refinement_plan": {"needs_more_info": not seen, "missing_visual_keyword": None}, "ocr": [self.read[video_id, f] for f in frames if (video_id, f) in self.read]})

    def answer(self, video_id: int, frames: Sequence[int], prompt: str, system: str) -> str:
        """The option whose words the prompt's evidence has most of."""
        evidence = set(words(" ".join(re.findall(r"\(During (.*)\)", prompt))))
        options = re.findall(r"(?m)^\s*\(?([A-Z])\)?[.):]\s*(.+)$", prompt.rsplit("Question:", 1)[-1])
        best = max(options, key=lambda o: (len(evidence & set(words(o[1]))), -ord(o[0])), default=None)
        return f"Analysis: {len(evidence)} words of evidence.\nFinal Answer: {best[0]}" if best else "unclear"


def read_json(reply: str) -> Any:
    """The JSON in a reply: all of it, a fenced part, or the first object without inner ones. ValueError if there is none."""
    fences = [re.search(rf"(?s)```{mark}\s*(.*?)\s*```", reply) for mark in ("json", "")]
    inner = re.search(r"\{[^{}]*\}", reply)
    for part in [reply.strip(), *(m[1] for m in fences if m), *([inner[0]] if inner else [])]:
        try:
            return json.loads(part)
        except ValueError:
            continue
    raise ValueError("no JSON in the reply")
