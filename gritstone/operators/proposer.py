"""Proposers: an optional model that offers rewrites as text. The default has no network and offers nothing."""

from __future__ import annotations

import json
import re
import urllib.request
from dataclasses import dataclass, field
from hashlib import sha256
from typing import Protocol

from gritstone.plans import sqltext
from gritstone.sources.catalog import SchemaContext

PROMPT_VERSION = "1"
#: What is worth trying, and when it is safe.
HINTS = (
    "A COUNT(*) > 0 test of a subquery needs only EXISTS.",
    "IN over a subquery can be an EXISTS or a semi join.",
    "DISTINCT that only undoes a join's repeats can be EXISTS.",
    "A common table expression used once can be inlined.",
    "OR over different columns can be UNION of disjoint branches; mind NULLs in the guard.",
    "Several aggregates over one table can share a scan with FILTER.",
    "A scalar aggregate in WHERE can be a one-row derived table.",
    "A correlated lookup in SELECT can be a LEFT JOIN if its key is unique.",
)


class ProposerUnavailable(RuntimeError):
    """The model could not be asked."""


class Proposer(Protocol):
    """Anything that turns a prompt into text."""

    provider: str

    def propose(self, system: str, user: str, model: str) -> str: ...

    def metadata(self, model: str) -> dict[str, str]: ...

    def models(self) -> list[str]: ...


@dataclass
class OfflineProposer:
    """Answers from a dictionary of original texts; for tests and for running without a model."""

    answers: dict[str, str] = field(default_factory=dict)
    provider: str = "offline"

    def propose(self, system: str, user: str, model: str) -> str:
        return next((a for q, a in self.answers.items() if q.strip() in user), "NO_OPTIMIZATION")

    def metadata(self, model: str) -> dict[str, str]:
        return {"provider": self.provider, "digest": sha256(json.dumps(self.answers, sort_keys=True).encode()).hexdigest()}

    def models(self) -> list[str]:
        return ["offline"]


@dataclass
class HttpProposer:
    """A local model server with generate, tags and version endpoints that speak JSON."""

    base_url: str
    timeout_s: float = 120.0
    provider: str = "ollama"

    def _call(self, path: str, body: dict | None, timeout: float) -> dict:
        request = urllib.request.Request(self.base_url.rstrip("/") + path, json.dumps(body).encode() if body is not None else None, {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                return json.load(answer)
        except (OSError, ValueError) as e:
            raise ProposerUnavailable(type(e).__name__) from e

    def propose(self, system: str, user: str, model: str) -> str:
        name = model.split(":", 1)[1] if model.startswith(f"{self.provider}:") else model
        return str(self._call("/api/generate", {"model": name, "system": system, "prompt": user, "stream": False, "options": {"temperature": 0}}, self.timeout_s).get("response", ""))

    def _short(self) -> float:
        return min(max(self.timeout_s, 15.0), 60.0)

    def metadata(self, model: str) -> dict[str, str]:
        try:
            name = model.split(":", 1)[1] if model.startswith(f"{self.provider}:") else model
            tags = self._call("/api/tags", None, self._short()).get("models", [])
            found = next((m for m in tags if m.get("name") == name), {})
            return {"provider": self.provider, "digest": str(found.get("digest", "")), "runtime": str(self._call("/api/version", None, self._short()).get("version", ""))}
        except ProposerUnavailable:
            return {"provider": self.provider}

    def models(self) -> list[str]:
        return [str(m.get("name")) for m in self._call("/api/tags", None, self._short()).get("models", [])]


@dataclass(frozen=True)
class Prompt:
    system: str
    user: str
    version: str

    @property
    def hash(self) -> str:
        return sha256(f"{self.version}\n{self.system}\n{self.user}".encode()).hexdigest()


class PromptBuilder:
    """Prompts with a version and a hash, so that a result can be traced to what was asked."""

    def build(self, sql: str, context: SchemaContext, most: int = 3) -> Prompt:
        system = "\n".join(
            [
                "You rewrite one analytical SELECT into faster, equivalent ones for Spark SQL.",
                "Keep output columns, their names and order, row multiplicity, NULL behaviour, outer ordering and all $n parameters.",
                "Answer with SQL only, several answers divided by a line of ---, or with NO_OPTIMIZATION.",
                "Ideas:",
                *[f"- {h}" for h in HINTS],
            ]
        )
        facts = [f"{t.name}({', '.join(c + (' NOT NULL' if not nullable else '') for c, nullable in t.columns.items())})" + (f" keys {list(t.keys)}" if t.keys else "") + "".join(f"; {c} refers to {other}.{its}" for c, other, its in t.references) + (f"; about {t.rows} rows" if t.rows is not None else "") for t in context.tables.values()]
        return Prompt(system, "\n".join([f"At most {most} rewrites.", "Tables:", *facts, "Query:", sql.strip()]), PROMPT_VERSION)


def parse_response(answer: str) -> tuple[list[str], list[tuple[str, str]]]:
    """(texts, refused texts with reasons) of a model's answer."""
    kept, refused = [], []
    for part in re.split(r"^\s*-{3,}\s*$", answer or "", flags=re.M):
        fenced = re.search(r"```(?:\w+)?\s*\n(.*?)```", part, re.S)
        text = (fenced[1] if fenced else part).strip()
        if not text or re.fullmatch(r"\W*NO_OPTIMIZATION\W*", text, re.I):
            continue
        if re.match(r"(insert|update|delete|drop|create|alter|truncate|merge|grant|copy|call|set)\b", text, re.I):
            refused.append((text, "unsafe_non_select_output"))
            continue
        m = re.search(r"^\s*(select|with)\b", text, re.I | re.M)
        if not m:
            refused.append((text, "non_sql_output"))
            continue
        text = text[m.start() :].strip()
        try:
            parts = [p for p in _statements(text) if p]
        except ValueError:
            refused.append((text, "non_sql_output"))
            continue
        if len(parts) != 1:
            refused.append((text, "multiple_statements"))
        else:
            kept.append(parts[0])
    return kept, refused


def _statements(text: str) -> list[str]:
    out, begin = [], 0
    for t in sqltext.tokens(text):
        if t.text == ";":
            out.append(text[begin : t.start].strip())
            begin = t.end
    return [*out, text[begin:].strip()]
