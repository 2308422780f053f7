"""A bounded tool loop on the driver; each tool is a DataFrame query or a gated action."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

MAX_ROUNDS, MAX_NUDGES = 12, 3


@dataclass
class Agent:
    """``model(messages)`` returns ``{"content": str, "tool_calls": [{"id", "name", "arguments": json}]}``."""

    model: Callable[[list[dict]], dict]
    tools: dict[str, Callable[..., object]]
    required: tuple[str, ...] = ()
    must_mention: str = ""
    messages: list[dict] = field(default_factory=list)
    called: list[str] = field(default_factory=list)

    def use(self, call: dict) -> str:
        """Result of a tool as JSON; bad arguments, unknown tools and failures become messages."""
        tool = self.tools.get(call.get("name", ""))
        if tool is None:
            return json.dumps({"error": f"no tool {call.get('name')}"})
        try:
            args = json.loads(call.get("arguments") or "{}")
            args = args if isinstance(args, dict) else {}
        except ValueError:
            args = {}
        try:
            result = tool(**args)
        except Exception as e:  # the model may try again
            return json.dumps({"error": str(e)[:300]})
        self.called.append(call["name"])
        return json.dumps(result, ensure_ascii=False, default=str)

    def rounds(self) -> str:
        for _ in range(MAX_ROUNDS):
            reply = self.model(self.messages)
            self.messages.append({"role": "assistant", **reply})
            calls = reply.get("tool_calls") or []
            if not calls:
                return reply.get("content") or ""
            self.messages += [{"role": "tool", "tool_call_id": c.get("id"), "content": self.use(c)} for c in calls]
        return ""

    def run(self, task: str) -> str:
        """Answer to a task; at most three reminders of required tools, then one of the answer's form."""
        self.messages.append({"role": "user", "content": task})
        answer = self.rounds()
        for _ in range(MAX_NUDGES):
            missing = [t for t in self.required if t not in self.called]
            if not missing:
                break
            self.messages.append({"role": "user", "content": f"Before you answer, call: {', '.join(missing)}."})
            answer = self.rounds()
        if self.must_mention and self.must_mention not in answer.lower():
            self.messages.append({"role": "user", "content": f"Write the answer so that it is given by {self.must_mention}."})
            answer = self.rounds()
        return answer


def given(value: object) -> bool:
    """Whether an argument was really given: models write "null" or "string" for none."""
    return value is not None and str(value).strip().lower() not in ("", "null", "string")


def gated(action: Callable[..., dict], approve: Callable[[dict], bool], done: dict[str, dict]) -> Callable[..., dict]:
    """An irreversible action behind a person's yes; the same request is carried out once."""

    def tool(**args) -> dict:
        key = json.dumps(args, sort_keys=True, default=str)
        if key not in done:
            if not approve(args):
                return {"status": "cancelled"}
            done[key] = action(**args)
        return done[key]

    return tool


def permit_tool(availability: dict[str, dict], response: dict, approve: Callable[[dict], bool], done: dict[str, dict]) -> Callable[..., dict]:
    """The permit request: read-only checks first, then a person's yes, then the service's (canned) answer for this request.

    A missing argument and a park or date without a free permit are errors and ask nobody; a request that was carried out is answered as before.
    """

    def submit(**args) -> dict:
        return {**response, "request": args}

    ask = gated(submit, approve, done)

    def tool(park="", date="", party_size=1, **_):
        if not given(park) or not given(date):
            return {"error": "a park and a date are needed"}
        left = next((v for k, v in availability.items() if str(park).lower() in k.lower()), {}).get(str(date), 0)
        if left < int(party_size):
            return {"error": f"{left} permits left in {park} on {date}"}
        return ask(park=park, date=str(date), party_size=int(party_size))

    return tool


def trail_tools(trails, reports, weather, campsites) -> dict[str, Callable[..., object]]:
    """The read-only tools over DataFrames; results are a few rows each."""
    from pyspark.sql import functions as F

    from switchback.operators.catalog import latest, park_match, resolve, search_trails

    def rows(df):
        return [r.asDict(recursive=True) for r in df.collect()]

    def search(park=None, max_difficulty=None, features=None, **_):
        return rows(search_trails(trails, park if given(park) else None, max_difficulty if given(max_difficulty) else None, features))

    def by_park(table):
        def tool(park="", **_):
            found = rows(park_match(table.withColumnRenamed("key", "park"), park)) if given(park) else []
            return found[0] if found else {"error": f"nothing on file for {park}"}

        return tool

    def conditions(trail="", **_):
        if not given(trail):
            return {"error": "which trail?"}
        ids = [trail] if trail.startswith("trail-") else [r.id for r in resolve(trails, trail).select("id").collect()]
        return rows(latest(reports.where(F.col("trail_id").isin(ids)), "trail_id", "date")) if ids else {"error": f"no trail {trail}"}

    return {"search_trails": search, "get_weather": by_park(weather), "check_campsites": by_park(campsites), "get_trail_conditions": conditions}
