"""Language-model providers for escalation and generation, with pacing. None is called unless it is passed in."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field

from tidewater import constants as K


def checked(content: object) -> dict:
    """The contract of a reply; anything else is a violation without options (fail closed)."""

    def fallback(why: str) -> dict:
        return {"contains_violation": True, "options": [], "valid": False, "fallback_reason": why}

    try:
        v = json.loads(content)
    except (TypeError, ValueError):
        return fallback("not valid JSON")
    if not isinstance(v, dict) or "contains_violation" not in v or "options" not in v:
        return fallback("missing key")
    if not v["contains_violation"]:
        return {"contains_violation": False, "options": [], "valid": True, "fallback_reason": None}
    o = v["options"]
    if not isinstance(o, list) or len(o) != K.OPTION_COUNT:
        return fallback("wrong number of options")
    if any(not isinstance(x, str) or len(x.split()) < K.OPTION_MIN_WORDS for x in o):
        return fallback("option too short")
    return {"contains_violation": True, "options": o, "valid": True, "fallback_reason": None}


@dataclass
class HttpProvider:
    """A chat-completions endpoint: temperature 0.3, 200 tokens, JSON replies, 3 seconds. Errors fall back."""

    url: str
    model: str
    system: str = "Decide whether the last message shares contact details. Reply as JSON with contains_violation and options."
    timeout: float = 3.0

    def __call__(self, turns: list[dict]) -> dict:
        chat = "\n".join(f"{t['speaker']}: {t['text']}" for t in turns)
        body = {
            "model": self.model, "temperature": 0.3, "max_tokens": 200, "response_format": {"type": "json_object"},
            "messages": [{"role": "system", "content": self.system}, {"role": "user", "content": chat}],
        }
        request = urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as r:
                return checked(json.load(r)["choices"][0]["message"]["content"])
        except Exception as e:  # any failure of the call must block, not pass
            return {"contains_violation": True, "options": [], "valid": False, "fallback_reason": f"call failed: {type(e).__name__}"}


@dataclass
class Pace:
    """Calls per minute and per day of one model; failed calls count."""

    per_minute: int = 15
    per_day: int = 500
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    used: int = 0
    last: float = field(default=float("-inf"))

    @property
    def spent(self) -> bool:
        return self.used >= self.per_day

    def wait(self) -> None:
        due = self.last + 60 / self.per_minute - self.clock()
        if due > 0:
            self.sleep(due)
        self.last = self.clock()
        self.used += 1


@dataclass
class Rotator:
    """Round robin over models that still have calls left today."""

    paces: dict[str, Pace]
    at: int = 0

    def next(self) -> str:
        names = list(self.paces)
        for _ in names:
            name = names[self.at % len(names)]
            self.at += 1
            if not self.paces[name].spent:
                return name
        raise RuntimeError("every model has used its calls of the day")


def generate_until(missing: int, batch: int, call: Callable[[int], int]) -> int:
    """Asks for batches until nothing is missing or a batch adds nothing; returns what was added."""
    added = 0
    while added < missing:
        got = call(min(batch, missing - added))
        if got <= 0:
            break
        added += got
    return added
