"""JSON objects in a proposer's reply, which may surround them with prose."""

from __future__ import annotations

import json

from ..errors import ProposerError

_DECODER = json.JSONDecoder()


def find_object(reply: str, key: str) -> dict:
    """The longest object that has ``key``. A cut-off reply is an error, never an empty answer."""
    found, at = [], reply.find("{")
    while at >= 0:
        try:
            value, end = _DECODER.raw_decode(reply, at)
        except json.JSONDecodeError:
            end = at + 1
        else:
            if isinstance(value, dict) and key in value:
                found.append((end - at, value))
        at = reply.find("{", end)
    if found:
        return max(found, key=lambda x: x[0])[1]
    if "{" not in reply:
        raise ProposerError("the reply has no JSON object")
    raise ProposerError(f"the reply has no whole object with {key!r}; it may have been cut off")
