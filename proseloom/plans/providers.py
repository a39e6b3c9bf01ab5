"""What surrounds a model: whether a provider can be used, what is said about it, and what its reply holds."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds after which a call counts as failed.
CALL_TIMEOUT = 180


@dataclass(frozen=True)
class Remote:
    """A remote provider; the key comes from the settings, or else from the environment variable ``key_name``."""

    url: str = ""
    model: str = ""
    api_key: str = ""
    key_name: str = ""

    @property
    def key(self) -> str | None:
        return self.api_key or (os.environ.get(self.key_name) if self.key_name else None) or None

    @property
    def usable(self) -> bool:
        return bool(self.url and self.model and self.key)


def setup_note(provider: str, remote: Remote, install: str | None, has_backend: bool) -> str | None:
    """The one line about the set-up: text that leaves the machine comes first, a model that is missing second."""
    if provider == "remote":
        return f"sending text to {remote.url}" if remote.usable else "remote provider needs a model and an API key, rules only"
    if provider == "off":
        return None
    return install or (None if has_backend else "no GPU backend found, rules only")


def parse_reply(body: Column) -> Column:
    """struct(answer, error) of the JSON replies of a chat service: an error's message goes first and as it is. Stays in the JVM."""
    kind = "error struct<message: string>, choices array<struct<message: struct<content: string>>>"
    said = F.from_json(body, kind, {"mode": "PERMISSIVE"})
    readable = F.get_json_object(body, "$").isNotNull()
    message, content = said["error"]["message"], F.get(said["choices"], F.lit(0))["message"]["content"]
    error = F.when(~F.coalesce(readable, F.lit(False)), "unreadable reply").when(message.isNotNull(), message).when(content.isNull(), "the reply contained no content")
    return F.struct(F.when(error.isNull(), content).alias("answer"), error.alias("error"))
