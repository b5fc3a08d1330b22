"""A chat-completion service as a source of answers: checked settings, credentials from the environment only, one request at a time.

    done = chat_completions(records, ChatService("model-name"), parser, reminder, concurrent=8)

The protocol is the common one of `POST <base>/chat/completions` with a bearer token. Tasks read the token and the address from the environment
variables that the settings name, so neither is in a plan, in a closure or in an error; executors need those variables.
"""

from __future__ import annotations

import base64
import json
import math
import os
import re
import urllib.error
import urllib.request
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators.runner import MissingSetting, completions

#: The public address of the protocol where no variable gives another, and keys that would hold a credential in a file.
DEFAULT_URL = "https://api.openai.com/v1"
CREDENTIALS = ("api_key", "apikey", "base_url", "token", "access_token", "secret")


class ServiceError(Exception):
    """An answer with a status other than success; without the service's text, which may repeat a credential."""

    def __init__(self, status_code: int):
        super().__init__(f"HTTP {status_code}")
        self.status_code = status_code


class NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args):  # noqa: ANN002  the token goes to the address that was named, and to no other
        return None


OPENER = urllib.request.build_opener(NoRedirect)


@dataclass(frozen=True)
class ChatService:
    """Settings of a service, checked when made; called with the texts of a request, it gives the text of the answer.

    timeout bounds each wait on the connection, in seconds. Retries and their waits are for `completions`.
    """

    model: str
    api_key_env: str = "LLM_API_KEY"
    base_url_env: str | None = "LLM_BASE_URL"
    temperature: float = 0.3
    max_tokens: int = 4096
    timeout: float = 120.0
    retries: int = 4
    first_wait: float = 1.0
    longest_wait: float = 30.0
    seed: int | None = None

    def __post_init__(self):
        if not isinstance(self.model, str) or not self.model.strip() or self.model.startswith("YOUR_") or re.fullmatch(r"\s*<.*>\s*", self.model):
            raise ValueError("model must be named, and not by a placeholder")
        for name in (self.api_key_env, *([self.base_url_env] if self.base_url_env else [])):
            if not isinstance(name, str) or not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
                raise ValueError("api_key_env and base_url_env must be names of environment variables")
        if not all(math.isfinite(v) for v in (self.temperature, self.timeout, self.first_wait, self.longest_wait)):
            raise ValueError("temperature, timeout and waits must be finite")
        if self.temperature < 0 or self.max_tokens <= 0 or self.timeout <= 0 or self.retries < 0 or not 0 <= self.first_wait <= self.longest_wait:
            raise ValueError("settings of the service out of range")

    @classmethod
    def of(cls, section: Mapping[str, object]) -> ChatService:
        """From the `llm` section of a settings file, which must not hold a credential or an address."""
        if held := sorted(k for k in section if k.casefold() in CREDENTIALS):
            raise ValueError(f"credentials and addresses come from the environment only; remove {', '.join(held)}")
        names = {"timeout_seconds": "timeout", "max_api_retries": "retries", "initial_backoff_seconds": "first_wait", "max_backoff_seconds": "longest_wait"}
        mine = {names.get(k, k): v for k, v in section.items()}
        return cls(**{k: v for k, v in mine.items() if k in cls.__dataclass_fields__})

    def __call__(self, user_prompt: str, system_prompt: str | None = None, image: bytes | None = None) -> str:
        """The answer's text. image: bytes of a PNG. A status other than success is a ServiceError, an answer of another form a ValueError."""
        key = os.environ.get(self.api_key_env, "").strip()
        if not key:
            raise MissingSetting(f"the environment variable {self.api_key_env} holds no credential")
        base = (os.environ.get(self.base_url_env, "").strip() if self.base_url_env else "") or DEFAULT_URL
        if not base.startswith(("http://", "https://")):
            raise MissingSetting(f"the environment variable {self.base_url_env} holds no address of HTTP")
        content: object = user_prompt
        if image is not None:
            shown = f"data:image/png;base64,{base64.b64encode(image).decode('ascii')}"
            content = [{"type": "text", "text": user_prompt}, {"type": "image_url", "image_url": {"url": shown}}]
        system = [{"role": "system", "content": system_prompt}] if system_prompt and system_prompt.strip() else []
        body = {"model": self.model, "messages": [*system, {"role": "user", "content": content}], "temperature": self.temperature, "max_tokens": self.max_tokens}
        body |= {} if self.seed is None else {"seed": self.seed}
        ask = urllib.request.Request(f"{base.rstrip('/')}/chat/completions", json.dumps(body).encode("utf-8"), {"Content-Type": "application/json"})
        ask.add_unredirected_header("Authorization", f"Bearer {key}")
        try:
            with OPENER.open(ask, timeout=self.timeout) as answer:
                found = json.load(answer)
        except urllib.error.HTTPError as e:
            e.close()
            raise ServiceError(e.code) from None
        try:
            return found["choices"][0]["message"]["content"]
        except (KeyError, IndexError, TypeError):
            raise ValueError("an answer without a text") from None


def chat_completions(records: DataFrame, service: ChatService, parser: Callable[[str], object], reminder: str, format_retries: int = 2, concurrent: int = 4) -> DataFrame:
    """completions() of records (sample_id, user_prompt, and if they have them system_prompt and image), at most `concurrent` requests at once in a task.

    A null or blank system prompt is left out, and a null image too. A null user prompt is an api_error without a request. Where an executor lacks the
    credential the job fails with the name of its variable, as no record could succeed.
    """
    others = tuple(c for c in ("system_prompt", "image") if c in records.columns)
    return completions(
        records, service, parser, reminder, format_retries, service.retries, service.first_wait, service.longest_wait, prompt="user_prompt", others=others, concurrent=concurrent
    )
