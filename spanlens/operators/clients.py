"""Clients of chat services. What sends a request is injected, so that nothing here needs a network or a vendor's package."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from .answer import Client, MockClient


@dataclass(frozen=True)
class Adaptation:
    """What a service's refusal of a parameter looks like, and the name under which it is sent from then on (none: not
    at all)."""

    parameter: str
    marks: tuple[str, ...]
    instead: str | None = None

    def fits(self, message: str) -> bool:
        return self.parameter in message and any(m in message for m in self.marks)


# Parts of refusals, in lower case.
ADAPTATIONS = {
    "openai": (Adaptation("max_tokens", ("max_completion_tokens",), "max_completion_tokens"), Adaptation("temperature", ("does not support", "only the default", "unsupported value"))),
    "anthropic": (Adaptation("temperature", ("deprecated", "not support", "unsupported")),),
}
KEYS = {"openai": "OPENAI_API_KEY", "anthropic": "ANTHROPIC_API_KEY"}


@dataclass
class ServiceClient:
    """Sends one user message; a parameter that the service refuses is renamed or left out, then and in later calls.

    send takes the request's fields and returns the answer's text. Any other error is the caller's, at once.
    """

    provider: str
    model: str
    send: Callable[[dict], str | None]
    base_url: str | None = None
    temperature: float = 0.0
    max_tokens: int = 64
    key_variable: str | None = None
    names: dict[str, str | None] = field(default_factory=lambda: {"max_tokens": "max_tokens", "temperature": "temperature"})

    def complete(self, prompt: str) -> str:
        while True:
            values = {"max_tokens": self.max_tokens, "temperature": self.temperature}
            sent = {self.names[p]: v for p, v in values.items() if self.names[p]}
            try:
                return self.send({"model": self.model, "messages": [{"role": "user", "content": prompt}], **sent}) or ""
            except Exception as e:
                message = str(e).lower()
                refused = [a for a in ADAPTATIONS[self.provider] if self.names[a.parameter] == a.parameter and a.fits(message)]
                if not refused:  # each parameter is changed once, so this ends
                    raise
                self.names |= {a.parameter: a.instead for a in refused}

    def describe(self) -> dict:
        """What a run's sidecar tells: the parameters as they are sent, not only as they were asked for."""
        return {
            "provider": self.provider, "model": self.model, "base_url": self.base_url, "api_key_env": self.key_variable or KEYS[self.provider], "temperature": self.temperature if self.names["temperature"] else None,
            "requested_temperature": self.temperature, "token_param": self.names["max_tokens"], "max_tokens": self.max_tokens,
        }


def make_client(provider: str, model: str, send: Callable[[dict], str | None] | None = None, output: str = "A", **how: object) -> Client:
    """A client of a provider: openai or anthropic, which need send, or mock, which always answers output."""
    if provider == "mock":
        return MockClient(default=output)
    if provider not in ADAPTATIONS:
        raise ValueError(f"unknown provider: {provider!r}")
    if send is None:
        raise ValueError(f"provider {provider!r} needs something to send requests with")
    return ServiceClient(provider, model, send, **how)
