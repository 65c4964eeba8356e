"""Requests, retries and the Arrow provider."""

import pytest
from pyspark.sql import functions as F

from inkstone.operators import answer, providers
from inkstone.operators.providers import ChatSettings, call, request


def test_requests_by_model_and_route():
    assert request(ChatSettings("gpt-5"), "s", "p")["reasoning_effort"] == "minimal"
    routed = request(ChatSettings("openai/gpt-5", "https://openrouter.ai/api"), "s", "p")
    assert routed["extra_body"] == {"reasoning": {"effort": "minimal"}} and "reasoning_effort" not in routed
    assert request(ChatSettings("other/model", "https://openrouter.ai/api"), "s", "p")["extra_body"]["reasoning"]["enabled"] is False
    assert "extra_body" not in request(ChatSettings("other"), "s", "p")


def test_retries():
    waits, replies = [], [TimeoutError(), ConnectionError(), "ok"]

    def client(_):
        r = replies.pop(0)
        if isinstance(r, Exception):
            raise r
        return r

    assert call(ChatSettings("m"), client, "s", "p", waits.append) == "ok" and waits == [2.0, 2.0]
    assert call(ChatSettings("m"), lambda _: " ", "s", "p") == answer.NO_ANSWER
    with pytest.raises(TimeoutError):
        call(ChatSettings("m", attempts=1), lambda _: (_ for _ in ()).throw(TimeoutError()), "s", "p")


def test_provider(spark):
    def make():
        def client(r):
            text = r["messages"][1]["content"]
            if text == "bad":
                raise ValueError
            return text.upper()

        return client

    ask = providers.provider(ChatSettings("m"), make)
    rows = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None)], "i int, p string").select("i", ask(F.col("p")).alias("r")).orderBy("i").collect()
    assert [r.r for r in rows] == ["A", None, None]
    r = spark.range(1).select(providers.system_prompt(F.lit("a"), F.lit("w"), F.lit(True)).alias("x"), providers.system_prompt(F.lit("a"), F.lit("w"), F.lit(False)).alias("y")).first()
    assert (r.x, r.y) == ("a\n\nw", "a")
