"""Calls of a chat model: attempts, other spellings of its name, pictures, JSON, and what it all used."""

from __future__ import annotations

import base64
import random
import time
from collections import Counter
from collections.abc import Callable, Sequence
from typing import Any

from reelgraph.functions.text import COUNTERS, TRANSIENT
from reelgraph.models import read_json
from reelgraph.settings import Endpoint

#: Replies that stand for one that can't be had, by parts of the error.
FILTERED, UNREACHABLE = "[SAFETY_FILTERED]", "[PROVIDER_UNREACHABLE]"
_REFUSED = ("data_inspection_failed", "inappropriate content")
_AWAY = ("Unable to reach the model provider", "ERROR_OPENAI")
_UNKNOWN = ("model_not_found", "does not exist")


def transient(error: Exception) -> bool:
    return any(m in str(error).lower() for m in TRANSIENT)


def spellings(name: str) -> list[str]:
    now = (name or "").strip()
    fixed = now.replace("instrcut", "instruct")
    more = [fixed] if fixed != now else []
    for a, b in (("qwen3vl-", "qwen3-vl-"), ("qwen3-vl-", "qwen3vl-")):
        more += [fixed.replace(a, b)] if a in fixed else []
    return list(dict.fromkeys(x for x in more if x))


def content(reply: Any) -> str:
    """What a reply says: text as it is, else the first choice's message or text, else its content, else all of it."""
    if reply is None or isinstance(reply, str):
        return reply or ""
    if not isinstance(reply, dict):
        return content(reply.model_dump()) if hasattr(reply, "model_dump") else str(reply)
    first = next(iter(reply.get("choices") or []), None) or {}
    for holder, name in ((first.get("message") or {}, "content"), (first, "text"), (reply, "content")):
        if name in holder:
            return str(holder[name] or "")
    return str(reply)


def usage(reply: Any) -> dict[str, int]:
    """Counters of a reply; those of images may be nested."""
    if hasattr(reply, "model_dump"):
        reply = reply.model_dump()
    told = reply.get("usage") if isinstance(reply, dict) else None
    if not isinstance(told, dict):
        return {}
    nested = told.get("prompt_tokens_details")
    flat = told | ({"image_tokens": nested["image_tokens"]} if isinstance(nested, dict) and "image_tokens" in nested else {})
    return {k: int(flat[k]) for k in COUNTERS if isinstance(flat.get(k), (int, float))}


class Client:
    """send(model, messages, options) makes one call and returns a reply, or raises. Counts are this object's own: one in
    each Python worker, written out as rows where a total is wanted (the query usage_summary adds up such a log)."""

    def __init__(self, endpoint: Endpoint, send: Callable[[str, list, dict], Any], sleep: Callable[[float], None] = time.sleep, chance: Callable[[], float] = random.random):
        self.endpoint, self.model, self.send, self.sleep, self.chance = endpoint, endpoint.model, send, sleep, chance
        self.reset_usage()

    def reset_usage(self) -> None:
        self._used: Counter = Counter()

    def usage(self) -> dict[str, int]:
        return {k: self._used[k] for k in ("calls", "text_calls", "multimodal_calls", "images_sent", *COUNTERS)}

    def delay(self, attempt: int) -> float:
        """Doubled with every attempt up to the longest, a fifth more or less."""
        e = self.endpoint
        return min(e.longest_delay, e.first_delay * 2 ** (attempt - 1)) * (0.8 + 0.4 * self.chance())

    def _attempts(self, model: str, messages: list, options: dict, pictures: int) -> str:
        for attempt in range(1, max(1, self.endpoint.attempts) + 1):
            try:
                reply = self.send(model, messages, options)
            except Exception as error:
                if not transient(error) or attempt >= self.endpoint.attempts:
                    raise
                self.sleep(self.delay(attempt))
                continue
            self._used.update({"calls": 1, ("multimodal_calls" if pictures else "text_calls"): 1, "images_sent": pictures})
            self._used.update(usage(reply))
            return content(reply)
        raise AssertionError

    def chat(self, messages: list, as_json: bool = False, pictures: int = 0) -> str:
        options = {"max_tokens": self.endpoint.max_tokens, "temperature": self.endpoint.temperature, "timeout": self.endpoint.timeout} | ({"response_format": {"type": "json_object"}} if as_json else {})
        try:
            return self._attempts(self.model, messages, options, pictures)
        except Exception as error:
            said = str(error)
            if any(x in said for x in _REFUSED):
                return FILTERED
            if any(x in said for x in _AWAY):
                return UNREACHABLE
            for other in spellings(self.model) if any(x in said for x in _UNKNOWN) else ():
                try:
                    out = self._attempts(other, messages, options, pictures)
                except Exception:  # noqa: S112
                    continue
                self.model = other
                return out
            raise

    def chat_with_pictures(self, prompt: str, pictures: Sequence[bytes], system: str | None = None) -> str:
        """Evenly spread ones of the pictures (encoded images) first, then the text."""
        most = self.endpoint.pictures_per_call
        sent = pictures if len(pictures) <= most else [pictures[int(i * len(pictures) / most)] for i in range(most)]
        parts: list = [{"type": "image_url", "image_url": {"url": f"data:image/jpeg;base64,{base64.b64encode(p).decode()}"}} for p in sent]
        return self.chat(([{"role": "system", "content": system}] if system else []) + [{"role": "user", "content": [*parts, {"type": "text", "text": prompt}]}], pictures=len(sent))

    def chat_json(self, prompt: str, system: str | None = None, pictures: Sequence[bytes] = (), again: int = 2) -> Any:
        """What a reply says as JSON; asked again where it can't be read. ValueError after the last time."""
        for left in range(again, -1, -1):
            said = self.chat_with_pictures(prompt, pictures, system) if pictures else self.chat(([{"role": "system", "content": system}] if system else []) + [{"role": "user", "content": prompt}], as_json=True)
            if said in (FILTERED, UNREACHABLE):
                return {"error": said, "relevance": 0.0}
            try:
                return read_json(said)
            except ValueError:
                if not left:
                    raise
        raise AssertionError
