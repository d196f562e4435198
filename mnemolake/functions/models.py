"""What is known of embedding models: vector sizes, request forms, tasks."""

from __future__ import annotations

import os
import re
from collections.abc import Callable

from .embedding import Embedder

#: The vector size of each model.
DIMENSIONS = {
    "text-embedding-3-small": 1536,
    "text-embedding-3-large": 3072,
    "text-embedding-004": 768,
    "gemini-embedding-001": 3072,
    "nomic-embed-text": 768,
    "mxbai-embed-large": 1024,
    "BAAI/bge-m3": 1024,
    "all-MiniLM-L6-v2": 384,
    "all-mpnet-base-v2": 512,
    "jina-embeddings-v5-text-small": 1024,
    "jina-embeddings-v5-text-nano": 768,
}


def dimensions(model: str, wanted: int | None = None) -> int:
    if wanted and wanted > 0:
        return wanted
    if model not in DIMENSIONS:
        raise ValueError(f"the vector size of {model} is not known; name it")
    return DIMENSIONS[model]


def with_env(value: str, env: dict[str, str] | None = None) -> str:
    """value with ${NAME} replaced by what the environment says; a name that is unset or empty is an error."""
    known = os.environ if env is None else env

    def of(m: re.Match) -> str:
        if not known.get(m[1]):
            raise KeyError(f"environment variable {m[1]} is not set")
        return known[m[1]]

    return re.sub(r"\$\{([^}]+)\}", of, value)


def env_file(content: str, env: dict[str, str] | None = None) -> dict[str, str]:
    """env (or the environment) with the NAME=value lines of a text; what is set already and not empty stays, of repeated names the first value that is not empty."""
    out = dict(os.environ if env is None else env)
    for line in map(str.strip, content.split("\n")):
        name, sign, value = line.partition("=")
        if sign and name and not line.startswith("#"):
            out[name.strip()] = out.get(name.strip()) or value.strip()
    return out


def config_file(exists: Callable[[str], bool], name: str, variable: str, folders: list[str], env: dict[str, str] | None = None) -> str:
    """The file that the variable names, or else the first that exists of `name` in the folders, in their order; an error if there is none."""
    known = os.environ if env is None else env
    if known.get(variable):
        return os.path.abspath(known[variable])
    found = next((p for p in (os.path.join(os.path.expanduser(f), name) for f in folders) if exists(p)), None)
    if found is None:
        raise FileNotFoundError(f"no {name} in {', '.join(folders)}; set {variable}")
    return found


class TaskEmbedder:
    """Embeds queries and passages, each with its own task, by a call that takes a request body and gives vectors."""

    def __init__(self, call: Callable[[dict], list[list[float]]], model: str, task_query: str | None = None, task_passage: str | None = None, size: int | None = None, normalized: bool | None = None):
        self.call, self.model, self.size, self.normalized = call, model, size, normalized
        self.tasks = {"query": task_query, "passage": task_passage}
        self.dim = dimensions(model, size)

    def body(self, texts: list[str], task: str | None) -> dict:
        known = {"task": task, "normalized": self.normalized, "dimensions": self.size if self.size and self.size > 0 else None}
        return {"model": self.model, "input": texts, "encoding_format": "float"} | {k: v for k, v in known.items() if v is not None}

    def embedder(self, kind: str = "passage") -> Embedder:
        def embed(texts: list[str]) -> list[list[float]]:
            found = self.call(self.body(texts, self.tasks[kind]))
            for v in found:
                if len(v) != self.dim:
                    raise ValueError(f"a vector has {len(v)} components, not {self.dim}")
            return found

        return embed

    def test(self) -> tuple[bool, str]:
        """Whether a text can be embedded, and if not why."""
        try:
            return True, str(len(self.embedder("query")(["test"])[0]))
        except Exception as e:
            return False, str(e)
