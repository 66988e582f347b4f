"""Model providers behind a small interface; calls happen in batches within mapInPandas, with retry."""

from __future__ import annotations

import json
import os
import time
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What an ecosystem's dependencies are called in the system prompt.
SUBJECTS = {"java": "Maven coordinates", "c": "C and C++ libraries", "go": "Go modules", "javascript": "npm packages", "python": "PyPI packages", "php": "Composer packages", "ruby": "Ruby gems", "rust": "Rust crates", "erlang": "Erlang applications"}


def system_prompt(ecosystem: str) -> str:
    return f"You are given {SUBJECTS[ecosystem]}, one a line. Reply with a JSON array only: an object with the keys name and description for each of them, in the same order. name is the given line; description says in one or two sentences what it does."


def retry(call: Callable[[], str], attempts: int = 3, first_wait: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> str:
    """Calls again after 2 s and 4 s; the last failure is raised."""
    for n in range(attempts):
        try:
            return call()
        except Exception:
            if n == attempts - 1:
                raise
            sleep(first_wait * 2**n)
    raise ValueError("no attempts")


@dataclass
class ChatProvider:
    """A chat endpoint of the usual form. The key is read from the named variable where the call happens, not on import."""

    url: str
    model: str
    key_variable: str
    timeout: float = 60.0

    def think(self, messages: list[dict]) -> str:
        body = json.dumps({"model": self.model, "messages": messages}).encode()
        head = {"Content-Type": "application/json", "Authorization": f"Bearer {os.environ[self.key_variable]}"}

        def call() -> str:
            with urllib.request.urlopen(urllib.request.Request(self.url, body, head), timeout=self.timeout) as reply:
                return json.load(reply)["choices"][0]["message"]["content"]

        return retry(call)


@dataclass
class StubProvider:
    """Answers from the prompt alone, always alike."""

    notes: dict[str, str] = field(default_factory=dict)

    def think(self, messages: list[dict]) -> str:
        names = [x for x in messages[-1]["content"].splitlines() if x]
        return json.dumps([{"name": n, "description": self.notes.get(n, f"library {n}")} for n in names])


def describe(dependencies: DataFrame, provider, *, batch: int = 10, pause: float = 0.0, keep_undescribed: bool = True) -> DataFrame:
    """(ecosystem, coord) -> with description: one call for each `batch` coordinates of an ecosystem.

    Distinct coordinates are asked for once. A batch whose reply isn't a JSON array gives nulls; keep_undescribed False drops these.
    """
    asked = dependencies.select("ecosystem", "coord").distinct()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for ecosystem, own in frame.groupby("ecosystem", sort=True):
                coords = own["coord"].tolist()
                for at in range(0, len(coords), batch):
                    part = coords[at : at + batch]
                    try:
                        reply = json.loads(provider.think([{"role": "system", "content": system_prompt(ecosystem)}, {"role": "user", "content": "\n".join(part)}]))
                        told = {x["name"]: x["description"] for x in reply}
                    except (ValueError, TypeError, KeyError):
                        told = {}
                    time.sleep(pause)
                    yield pd.DataFrame({"ecosystem": ecosystem, "coord": part, "description": [told.get(c) for c in part]})

    told = asked.mapInPandas(run, "ecosystem string, coord string, description string")
    out = dependencies.join(told, ["ecosystem", "coord"], "left")
    return out if keep_undescribed else out.where(F.col("description").isNotNull())


def answer(prompts: DataFrame, provider, column: str = "input") -> DataFrame:
    """prompts with an `answer` column, a call for each row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(answer=[provider.think([{"role": "user", "content": p}]) for p in frame[column]])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema)
    return prompts.mapInPandas(run, f"{fields}, answer string")
