"""Models behind an HTTP interface of the usual form (``/embeddings``, ``/chat/completions``), called from Arrow batches."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from urllib.request import Request, urlopen

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..options import Options
from .embedders import Custom

#: Seconds that one call may take.
TIMEOUT = 120
ROLE = "You answer questions from the context that you are given."


def post(url: str, key: str, body: dict) -> dict:
    request = Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {key or 'not-needed'}"})
    with urlopen(request, timeout=TIMEOUT) as reply:  # noqa: S310
        return json.load(reply)


def embedder(options: Options) -> Custom:
    """An embedder that asks the model for ten texts at a time."""
    url, key, model = f"{options.embedding_api_base.rstrip('/')}/embeddings", options.embedding_api_key, options.embedding_model

    def encode(texts: list[str]) -> list[list[float]]:
        rows = post(url, key, {"model": model, "input": texts})["data"]
        return [r["embedding"] for r in sorted(rows, key=lambda r: r.get("index", 0))]

    return Custom(encode, options.embedding_dim)


def generator(options: Options) -> Callable[[Column], Column]:
    """A generator for ``operators.answer``: struct<answer, error> of a prompt; a failed call is a row's error."""
    url, key = f"{options.llm_api_base.rstrip('/')}/chat/completions", options.llm_api_key
    fixed = {"model": options.llm_model, "temperature": options.temperature, "max_tokens": options.max_tokens}

    @F.pandas_udf("answer string, error string")
    def generate(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for prompts in batches:
            rows = []
            for prompt in prompts:
                if prompt is None:
                    rows.append((None, None))
                    continue
                try:
                    messages = [{"role": "system", "content": ROLE}, {"role": "user", "content": prompt}]
                    rows.append((post(url, key, {**fixed, "messages": messages})["choices"][0]["message"]["content"], None))
                except Exception as e:  # told in the row, as results have to
                    rows.append((None, str(e)))
            yield pd.DataFrame(rows, columns=["answer", "error"])

    return generate
