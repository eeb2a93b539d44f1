"""Embedding and chat providers behind HTTP. They are plain values that travel to the executors and open no connection
before a call; `vectors.embed_column` takes the embedders, `helpers.summary` the chat."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from dataclasses import dataclass


def _post(url: str, body: dict, key: str, timeout: float) -> dict:
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    request = urllib.request.Request(url, json.dumps(body).encode(), headers)
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return json.load(answer)


@dataclass(frozen=True)
class HttpEmbeddings:
    """Vectors of texts, in their order. kind 'openai': {url}/embeddings; 'local': {url}/api/embed of a model server.

    A batch that the server refuses as too large (400 or 413) is halved; a single text is cut by a quarter until it is
    taken or no more than `least` characters are left, and then the error is raised. An empty text is sent as one blank.
    """

    url: str
    model: str
    kind: str = "openai"
    key: str = ""
    timeout: float = 120.0
    least: int = 256

    def __call__(self, texts: list[str]) -> list[list[float]]:
        if not texts:
            return []
        try:
            return self._ask([t or " " for t in texts])
        except urllib.error.HTTPError as e:
            if e.code not in (400, 413):
                raise
            if len(texts) > 1:
                half = len(texts) // 2
                return self(texts[:half]) + self(texts[half:])
            if len(texts[0]) <= self.least:
                raise
            return self([texts[0][: max(self.least, len(texts[0]) * 3 // 4)]])

    def _ask(self, texts: list[str]) -> list[list[float]]:
        body = {"model": self.model, "input": texts}
        if self.kind == "openai":
            rows = sorted(_post(f"{self.url}/embeddings", body, self.key, self.timeout)["data"], key=lambda r: r["index"])
            found = [r["embedding"] for r in rows]
        else:
            found = _post(f"{self.url}/api/embed", body, self.key, self.timeout)["embeddings"]
        if len(found) != len(texts):
            raise ValueError(f"{len(found)} vectors for {len(texts)} texts")
        return found


@dataclass(frozen=True)
class HttpChat:
    """One answer of a chat model to a system and a user message."""

    url: str
    model: str
    key: str = ""
    timeout: float = 120.0

    def __call__(self, system: str, user: str) -> str:
        messages = [{"role": "system", "content": system}, {"role": "user", "content": user}]
        answer = _post(f"{self.url}/chat/completions", {"model": self.model, "messages": messages, "temperature": 0}, self.key, self.timeout)
        return answer["choices"][0]["message"]["content"]
