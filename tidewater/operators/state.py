"""The conversation state machine: one transition, shared by the batch fold and the stream.

State of a sender: a suspicion counter over rooms, and per room the last digits and the last turns. Digits live 120 s
after the last message with digits, turns 180 s after the last message, the counter 600 s after it began; an age equal
to the lifetime has expired. Times are event times in microseconds.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from tidewater import constants as K

SECOND = 1_000_000


@dataclass
class Room:
    digits: str = ""
    digits_at: int = 0
    turns: list[dict] = field(default_factory=list)
    turns_at: int = 0


@dataclass
class Sender:
    suspicion: int = 0
    suspicion_at: int = 0
    rooms: dict[str, Room] = field(default_factory=dict)

    def dumps(self) -> str:
        return json.dumps([self.suspicion, self.suspicion_at, {k: [r.digits, r.digits_at, r.turns, r.turns_at] for k, r in self.rooms.items()}])

    @staticmethod
    def loads(s: str | None) -> Sender:
        if not s:
            return Sender()
        a, b, rooms = json.loads(s)
        return Sender(a, b, {k: Room(*v) for k, v in rooms.items()})

    def expire(self, now: int) -> None:
        """Forget rooms whose digits and turns have both expired."""
        self.rooms = {k: r for k, r in self.rooms.items() if now - r.digits_at < K.DIGIT_TTL * SECOND or now - r.turns_at < K.TURN_TTL * SECOND}


@dataclass
class Message:
    """What the transition needs of a message; the stateless features are computed before."""

    room: str
    msg_id: str
    speaker: str | None
    text: str
    at: int
    run: int
    digits: str
    contact: float
    pattern: float
    link: float
    platform: bool
    handle: bool


#: provider(turns) -> validated reply {contains_violation, options, valid, fallback_reason}
Provider = Callable[[list[dict]], dict]


def stub_provider(turns: list[dict]) -> dict:
    """A deterministic stand-in for the language model: three rewrites that name the number of turns it saw."""
    n = len(turns)
    return {
        "contains_violation": True,
        "options": [f"please keep the {n} turns here", "let us talk in the app", "happy to answer right here"],
        "valid": True,
        "fallback_reason": None,
    }


def score(run: int, contact: float, pattern: float, history: float, link: float, platform: float) -> int:
    parts = {"run": min(run / 10, 1.0), "contact": contact, "pattern": pattern, "history": history, "link": link, "platform": platform}
    raw = 0.0
    for name, weight in K.WEIGHTS:
        raw = raw + weight * parts[name]
    out = round(raw * 100)
    if history >= K.HISTORY_FLOOR_AT:
        out = max(out, K.FLOOR)
    if platform >= K.PLATFORM_FLOOR_AT:
        out = max(out, K.FLOOR)
    return min(out, 100)


def tier(s: int) -> str:
    return "low" if s < K.LOW_BELOW else "moderate" if s < K.HIGH_FROM else "high"


def kept_options(options: list[str]) -> list[str]:
    out = []
    for o in options:
        run = longest = 0
        for ch in o:
            run = run + 1 if ch.isdecimal() else 0
            longest = max(longest, run)
        if longest < K.GATE_DIGITS:
            out.append(o)
    return out


def step(state: Sender, m: Message, provider: Provider) -> dict:
    """One message: features from the state, decision, then the state after it. Returns the decision."""
    room = state.rooms.setdefault(m.room, Room())
    digits = room.digits if m.at - room.digits_at < K.DIGIT_TTL * SECOND else ""
    turns = room.turns if m.at - room.turns_at < K.TURN_TTL * SECOND else []
    history = min((len(digits) + len(m.digits)) / K.HISTORY_DIGITS, 1.0)
    kw = m.platform or any(t["platform"] for t in turns)
    handle = m.handle or any(t["handle"] for t in turns)
    platform = 0.0 if not turns else 1.0 if kw and handle else 0.2 if kw or handle else 0.0
    points = score(m.run, m.contact, m.pattern, history, m.link, platform)
    scored = logged = tier(points)
    action, reason, options, escalated, cleared = "pass", None, None, None, False
    log_action = "pass"
    ask = scored == "high"
    if scored == "moderate":
        alive = state.suspicion > 0 and m.at - state.suspicion_at < K.SUSPICION_TTL * SECOND
        state.suspicion, state.suspicion_at = (state.suspicion + 1, state.suspicion_at) if alive else (1, m.at)
        ask = state.suspicion >= K.SUSPICION_ESCALATES
        action = log_action = "soft_mask"
        if ask:
            logged, reason, escalated = "high", "escalated_by_suspicion", True
    if ask:
        escalated = bool(escalated)
        reply = provider([{"speaker": t["speaker"], "text": t["text"]} for t in turns] + [{"speaker": "user", "text": m.text}])
        if not reply["valid"]:
            action, log_action, reason, cleared, escalated = "block", "llm_fallback_block", reply.get("fallback_reason"), True, None
            logged = "high"
        elif not reply["contains_violation"]:
            action, log_action, reason, escalated = "pass", "llm_override_pass", "model says no violation", None
            logged = "high"
        else:
            action = log_action = "llm_escalation"
            options, cleared = kept_options(reply["options"]), True
    if cleared:
        digits, turns = "", []
        room.digits = ""
    if m.digits:
        room.digits, room.digits_at = (digits + m.digits)[-K.DIGITS_KEPT :], m.at
    turn = {"speaker": m.speaker, "text": m.text, "msg_id": m.msg_id, "platform": m.platform, "handle": m.handle}
    room.turns, room.turns_at = (turns + [turn])[-K.TURNS_KEPT :], m.at
    return {
        "history_score": history,
        "cross_turn_platform_score": platform,
        "score": points,
        "tier": scored,
        "logged_tier": logged,
        "action": action,
        "log_action": log_action,
        "reason": reason,
        "options": options,
        "escalated_from_suspicion": escalated,
    }
