"""Settings: nested JSON with dotted lookup, and the engine's typed options."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path
from typing import Any


class Settings:
    """Nested values by dotted names; a missing file is an empty one."""

    def __init__(self, path: str | Path | None = None, values: dict | None = None):
        self.path = Path(path) if path else None
        self.values = values if values is not None else self._read()

    def _read(self) -> dict:
        if self.path is None or not self.path.exists():
            return {}
        try:
            return json.loads(self.path.read_text(encoding="utf-8"))
        except ValueError:
            return {}

    def get(self, name: str, default: Any = None) -> Any:
        at: Any = self.values
        for part in name.split("."):
            if not isinstance(at, dict) or part not in at:
                return default
            at = at[part]
        return at

    def set(self, name: str, value: Any) -> None:
        *parents, last = name.split(".")
        at = self.values
        for part in parents:
            if not isinstance(at.get(part), dict):
                at[part] = {}
            at = at[part]
        at[last] = value

    def save(self) -> None:
        if self.path is None:
            raise ValueError("these settings have no file")
        self.path.write_text(json.dumps(self.values, ensure_ascii=False, indent=2), encoding="utf-8")

    def exists(self) -> bool:
        return self.path is not None and self.path.exists()


@dataclass(frozen=True)
class Api:
    """Where completions are asked for."""

    url: str
    key: str
    model: str
    timeout: float

    @classmethod
    def of(cls, s: Settings, part: str, timeout: float) -> Api | None:
        """The endpoint of a part of the settings; None unless enabled, with an address and a real key."""
        key, url = s.get(f"{part}.api_key"), s.get(f"{part}.api_url")
        if not (s.exists() and s.get(f"{part}.enabled") and url and key and key != "your_api_key_here"):
            return None
        return cls(url, key, s.get(f"{part}.model") or "", s.get(f"{part}.timeout", timeout))


#: What is asked where the settings have no prompts.
SCORE = """{instruction}
{input}
{output}

The lines above are a situation in a chat, what was said, and the reply that was given.
How good is the reply as an example of its writer's own way of talking? Consider whether it
answers what was said, whether it sounds like one person talking to another, and whether it
says anything at all. Give one number from 0 (useless) to 10 (very good), alone on the last line.
"""
FIRST = """{contact_name} ({relationship}), {conversation_count} messages:
{conversations}

This is part of a chat; messages of the user are under the user's own name. Describe how the
user talks to this person: tone and distance, usual words and phrases, length and rhythm of
messages, use of emoji and punctuation, how questions, jokes and disagreement are handled.
Quote short examples. Say only what the messages show.
"""
SECOND = """{contact_name} ({relationship}), {total_messages} messages in {analysis_count} parts:
{analyses}

These are descriptions of parts of one chat, in order. Join them into one: keep what comes up
again, say what changed over time, and drop what only one part shows by chance.
"""
FINAL = """{contact_count} contacts, {total_messages} messages:
{contact_analyses}

These describe how one user talks to different people. Write one description of the user:
what is the same with everyone, what depends on the relationship, and which words, habits
and reactions would be missed if they were not there.
"""


@dataclass(frozen=True)
class Options:
    """What the stages need to know."""

    data_dir: str = "data"
    output_dir: str = "output"
    my_id: str = ""
    my_name: str = "我"
    max_gap: int = 90
    max_delay: int = 300
    epoch_unit: str | None = None
    scoring: bool = False
    min_score: float = 6.0
    attempts: int = 3
    threads: int = 3
    per_minute: float | None = None
    chunk: int = 1000
    fan: int = 8
    prompt_limit: int = 60_000
    analysis_threads: int = 3
    analysis_attempts: int = 3
    score_api: Api | None = None
    analysis_api: Api | None = None
    prompt: str = SCORE
    first_prompt: str = FIRST
    second_prompt: str = SECOND
    final_prompt: str = FINAL

    @classmethod
    def of(cls, s: Settings) -> Options:
        score_api = Api.of(s, "llm_evaluation", 30)
        d = cls()
        return cls(
            data_dir=s.get("data_processing.data_dir", d.data_dir),
            output_dir=s.get("data_processing.output_dir", d.output_dir),
            my_id=s.get("data_processing.my_wxid", d.my_id),
            max_gap=s.get("data_processing.max_inter_message_gap", d.max_gap),
            max_delay=s.get("data_processing.max_reply_delay", d.max_delay),
            scoring=score_api is not None,
            min_score=s.get("llm_evaluation.min_score", d.min_score),
            attempts=s.get("llm_evaluation.retry_attempts", d.attempts),
            threads=s.get("llm_evaluation.max_workers", d.threads),
            per_minute=s.get("calls_per_minute", d.per_minute),
            chunk=s.get("pattern_analysis.chunk_size", d.chunk),
            fan=s.get("pattern_analysis.merge_fan", d.fan),
            prompt_limit=s.get("pattern_analysis.prompt_limit", d.prompt_limit),
            analysis_threads=s.get("pattern_analysis.max_workers", d.analysis_threads),
            analysis_attempts=s.get("pattern_analysis.retry_attempts", d.analysis_attempts),
            score_api=score_api,
            analysis_api=Api.of(s, "pattern_analysis", 60),
            prompt=s.get("llm_evaluation.evaluation_prompt", d.prompt),
            first_prompt=s.get("pattern_analysis.first_level_prompt", d.first_prompt),
            second_prompt=s.get("pattern_analysis.second_level_prompt", d.second_prompt),
            final_prompt=s.get("pattern_analysis.final_level_prompt", d.final_prompt),
        )
