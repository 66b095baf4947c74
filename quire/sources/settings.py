"""Options of readers and of translation from a mapping of names, such as an environment: tables of options, and one reader for both."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from quire.operators.merge import SEPARATOR
from quire.operators.reports import OUTPUT_TOKENS


@dataclass(frozen=True)
class Option:
    """An option under the first of its names that has a value: white space and quotes around it go, then read makes a value of it. A required one has no default."""

    names: tuple[str, ...]
    default: Any
    read: Callable[[str], Any] = str
    required: bool = False

    def of(self, options: Mapping[str, str]) -> Any:
        for name in self.names:
            text = (options.get(name) or "").strip().strip("'\"").strip()
            if text:
                try:
                    return self.read(text)
                except (ValueError, KeyError) as error:
                    raise ValueError(f"{name}: {error}") from error
        if self.required:
            raise ValueError(f"{' or '.join(self.names)} must be given")
        return self.default


def at_least(least: float, kind: type = int) -> Callable[[str], Any]:
    """A number, no less than least."""
    return lambda text: max(kind(least), kind(text))


def limit(text: str) -> int | None:
    """A number over 0; 0 and less switch a limit off."""
    return n if (n := int(text)) > 0 else None


def one_of(*allowed: str) -> Callable[[str], str]:
    def read(text: str) -> str:
        if text.lower() not in allowed:
            raise ValueError(f"must be one of {', '.join(map(repr, allowed))}")
        return text.lower()

    return read


def listed(text: str) -> tuple[str, ...]:
    """The entries of a list with commas; blank ones go."""
    return tuple(x for x in map(str.strip, text.split(",")) if x)


# Names, defaults, bounds and allowed values of all options.
READING = {
    "responses": Option(("RESPONSES",), "", lambda text: text.rstrip("/")),
    "pages_per_chunk": Option(("PAGES_PER_CHUNK",), 8, at_least(1)),
    "max_pages": Option(("MAX_PAGES",), 200, limit),
    "max_page_chars": Option(("MAX_PAGE_OUTPUT_CHARS",), 16_384, limit),
    "max_page_tokens": Option(("MAX_PAGE_OUTPUT_TOKENS",), 6_144, limit),
    "max_response_mb": Option(("MAX_RESPONSE_MB",), 20, at_least(1)),
    "page_separator": Option(("PAGE_SEPARATOR",), SEPARATOR, lambda text: text.encode().decode("unicode_escape")),
    "allowed_hosts": Option(("ALLOWED_HOSTS",), (), listed),
}
TRANSLATION = {
    "model": Option(("TRANSLATE_MODEL", "OPENAI_MODEL"), None, required=True),
    "base_url": Option(("OPENAI_BASE_URL",), None, required=True),
    "api_mode": Option(("TRANSLATE_API_MODE",), "auto", one_of("auto", "chat", "responses")),
    "max_tokens_param": Option(("TRANSLATE_MAX_TOKENS_PARAM",), "max_tokens", one_of("max_tokens", "max_completion_tokens", "none")),
    "reasoning": Option(("TRANSLATE_REASONING",), "", one_of(*OUTPUT_TOKENS)),
    "concurrency": Option(("TRANSLATE_CONCURRENCY",), 4, at_least(1)),
    "max_retries": Option(("TRANSLATE_MAX_RETRIES",), 3, at_least(0)),
    "timeout_s": Option(("TRANSLATE_TIMEOUT_S",), 180.0, at_least(5, float)),
    "context": Option(("TRANSLATE_CONTEXT",), True, lambda text: text not in ("0", "false", "no")),
}


def settings(table: Mapping[str, Option], options: Mapping[str, str]) -> dict[str, Any]:
    """The values of a table's options; what is missing and required, or is not of its kind, raises ValueError under the option's name."""
    return {field: option.of(options) for field, option in table.items()}


def output_tokens(translation: Mapping[str, Any]) -> int:
    """What a reply may have, by the effort of reasoning."""
    return OUTPUT_TOKENS[translation["reasoning"]]
