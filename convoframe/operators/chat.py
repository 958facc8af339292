"""A chat completion over HTTP, as a function from prompt to reply."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

#: What requests for scores and for analyses carry beside model and prompt.
SCORING = {"max_tokens": 10000, "temperature": 0.1, "chat_template_kwargs": {"enable_thinking": False}, "top_k": 20}
ANALYSIS = {"max_tokens": 10000, "temperature": 0.7, "top_p": 0.95}


def chat(url: str, key: str, model: str, timeout: float = 30, extra: Mapping[str, Any] | None = None) -> Callable[[str], str]:
    """A function that posts one user message and returns the reply's text, stripped.

    It raises on a bad status, after ``timeout`` seconds without an answer, and on
    an answer without a reply; the caller repeats.  It is a closure, so executors
    need no module of this package to run it.
    """
    body = {"model": model, **(extra or {})}

    def call(prompt: str) -> str:
        import json
        from urllib.request import Request, urlopen

        data = json.dumps(body | {"messages": [{"role": "user", "content": prompt}]}).encode()
        request = Request(url, data, {"Authorization": f"Bearer {key}", "Content-Type": "application/json"}, method="POST")
        with urlopen(request, timeout=timeout) as answer:
            return json.loads(answer.read())["choices"][0]["message"]["content"].strip()

    return call
