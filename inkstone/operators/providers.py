"""Model providers: settings of a chat endpoint, and calls from Arrow batches with retries.

The client itself is a function that the caller brings, from a request to the
text of the reply; nothing here reaches a network.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from inkstone.operators.answer import NO_ANSWER


@dataclass(frozen=True)
class ChatSettings:
    """What a request needs besides its messages."""

    model: str
    base_url: str | None = None
    api_key_env: str = "OPENAI_API_KEY"
    temperature: float = 0.3
    max_tokens: int = 2000
    timeout: int = 60
    attempts: int = 3
    waits: tuple[float, float] = (2.0, 10.0)
    retry_on: tuple[type[Exception], ...] = field(default=(TimeoutError, ConnectionError))

    @property
    def routed(self) -> bool:
        """Whether requests go through a router of several vendors."""
        return "openrouter" in (self.base_url or "").lower()

    @property
    def reasons_natively(self) -> bool:
        """Whether the model's own interface has a setting for the effort of reasoning."""
        return self.model.lower().startswith(("gpt-", "o1", "o3", "o4", "openai/"))


def request(settings: ChatSettings, system: str, prompt: str) -> dict:
    """The request for one prompt, with reasoning kept to the least the route allows."""
    out = {
        "model": settings.model, "messages": [{"role": "system", "content": system}, {"role": "user", "content": prompt}],
        "temperature": settings.temperature, "max_completion_tokens": settings.max_tokens, "timeout": settings.timeout,
    }
    if settings.routed:
        least = {"effort": "minimal"} if settings.reasons_natively else {"enabled": False, "max_tokens": 1, "exclude": True}
        out["extra_body"] = {"reasoning": least}
    elif settings.reasons_natively:
        out["reasoning_effort"] = "minimal"
    return out


def call(settings: ChatSettings, client: Callable[[dict], str | None], system: str, prompt: str, sleep: Callable[[float], None] = time.sleep) -> str:
    """One reply; passing failures are tried again after doubling waits, a blank reply becomes a fixed text."""
    low, high = settings.waits
    for attempt in range(settings.attempts):
        try:
            reply = client(request(settings, system, prompt))
            return reply if reply and reply.strip() else NO_ANSWER
        except settings.retry_on:
            if attempt + 1 == settings.attempts:
                raise
            sleep(min(high, max(low, 2.0**attempt)))
    raise ValueError("attempts must be positive")


def provider(settings: ChatSettings, make_client: Callable[[], Callable[[dict], str | None]], system: str = "") -> Callable[[Column], Column]:
    """A provider that calls a chat model for every prompt; null where all attempts failed.

    The client is made once per batch stream of a worker; the number of tasks at
    a time is the limit of concurrent calls.
    """

    @F.pandas_udf("string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        client = make_client()

        def one(prompt: str | None) -> str | None:
            if prompt is None:
                return None
            try:
                return call(settings, client, system, prompt)
            except Exception:  # noqa: BLE001 - a failed call is this row's
                return None

        for prompts in batches:
            yield prompts.map(one, na_action=None)

    return ask


def system_prompt(base: Column, warning: Column, image_based: Column) -> Column:
    """The system's text, with a warning behind it for documents read from images."""
    return F.concat(base, F.when(image_based, F.concat(F.lit("\n\n"), warning)).otherwise(""))
