"""Parameters of the engine, with the environment and a file of settings as sources."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

#: Words that count as true.
TRUE_WORDS = ("1", "true", "yes")


def settings_file(path: str) -> dict[str, str]:
    """NAME=value lines of a file; empty if there is none. Lines of ``#`` and a leading ``export`` are skipped, quotes taken off."""
    found: dict[str, str] = {}
    if os.path.isfile(path):
        with open(path, encoding="utf-8") as f:
            for line in f:
                name, mark, value = line.strip().removeprefix("export ").partition("=")
                if mark and not name.startswith("#"):
                    value = value.strip()
                    found[name.strip()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value
    return found


@dataclass(frozen=True)
class Options:
    #: Defaults that results depend on.
    chunk_size: int = 512
    chunk_overlap: int = 100
    top_k: int = 5
    score_threshold: float = 0.7
    auto_ingest: bool = True
    supported_exts: tuple[str, ...] = (".pdf", ".docx", ".doc", ".txt")
    embedding_model: str = "text-embedding-v3"
    embedding_dim: int = 1024
    warehouse: str = "spark-warehouse/folioscan"
    #: Remote models; one is used where its address is given.
    embedding_api_base: str = ""
    embedding_api_key: str = ""
    llm_api_base: str = ""
    llm_api_key: str = ""
    llm_model: str = ""
    temperature: float = 0.7
    max_tokens: int = 1024

    @classmethod
    def from_environment(cls, values: Mapping[str, str] | None = None, file: str | None = None) -> Options:
        """Options named in upper case in ``values`` (the environment, if None) or else in ``file``, cast to their types.

        SIMILARITY_THRESHOLD names score_threshold; the key for embeddings is that of the language model unless it has its own.
        """
        values = {**(settings_file(file) if file else {}), **(os.environ if values is None else values)}
        if not values.get("EMBEDDING_API_KEY") and values.get("LLM_API_KEY"):
            values["EMBEDDING_API_KEY"] = values["LLM_API_KEY"]
        found = {}
        for f in fields(cls):
            text = values.get("SIMILARITY_THRESHOLD" if f.name == "score_threshold" else f.name.upper())
            if text is None:
                continue
            default = f.default
            if isinstance(default, bool):
                found[f.name] = text.strip().lower() in TRUE_WORDS
            elif isinstance(default, tuple):
                found[f.name] = tuple(x.strip().lower() for x in text.split(",") if x.strip())
            else:
                found[f.name] = type(default)(text)
        return cls(**found)
