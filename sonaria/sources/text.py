"""Text from a remote model, for features.describe. Nothing is asked unless a caller makes an asker."""

from __future__ import annotations

import json
import urllib.request

import pandas as pd


def asker(url: str, model: str, key: str = "", timeout: float = 30.0, most: int = 300):
    """A function of prompts, a pandas Series, that asks a chat endpoint for each and gives its answers; null where it
    fails or takes longer than `timeout` seconds, so that the rules answer. `most` bounds the tokens of an answer."""

    def one(prompt: str) -> str | None:
        body = json.dumps({"model": model, "messages": [{"role": "user", "content": prompt}], "max_tokens": most}).encode()
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
        try:
            with urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=timeout) as answer:
                return json.load(answer)["choices"][0]["message"]["content"].strip() or None
        except (OSError, ValueError, LookupError, TypeError, AttributeError):
            return None

    return lambda prompts: pd.Series([one(p) for p in prompts], index=prompts.index, dtype=object)
