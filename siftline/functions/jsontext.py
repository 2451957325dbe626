"""JSON of any depth and with numbers of any length: parsed and written without recursion."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|("[^"\\\x00-\x1f]*(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*)*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|(true|false|null))')
_SPACE = re.compile(r"[ \t\n\r]*")
_LITERAL = {"true": True, "false": False, "null": None}


class Number(str):
    """A whole number as it was written; it may have more digits than Python converts."""


class _Mark(str):
    """Punctuation on its way out."""


def _number(text: str):
    if re.search("[.eE]", text):
        return float(text)
    return Number("0" if text == "-0" else text)


def _slow(text: str, hide: Callable[[str], bool] | None, mark: str):
    top: list = []
    open_: list = [top]
    keys: list = [None]
    state, at = "value", 0

    def put(value) -> None:
        box = open_[-1]
        if isinstance(box, list):
            box.append(value)
        else:
            box[keys[-1]] = mark if hide and hide(keys[-1]) else value

    while True:
        if state == "after" and len(open_) == 1:
            if _SPACE.fullmatch(text, at):
                return top[0]
            raise ValueError("more behind the value")
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"no JSON at {at}")
        at = m.end()
        sign, string, number, word = m.groups()
        if state in ("value", "first value"):
            if sign in ("{", "["):
                new: list | dict = {} if sign == "{" else []
                put(new)
                open_.append(new)
                keys.append(None)
                state = "first name" if sign == "{" else "first value"
            elif sign == "]" and state == "first value":
                open_.pop()
                keys.pop()
                state = "after"
            elif sign:
                raise ValueError(f"{sign} in place of a value")
            else:
                put(json.loads(string) if string is not None else _number(number) if number is not None else _LITERAL[word])
                state = "after"
        elif state in ("name", "first name"):
            if string is not None:
                keys[-1] = json.loads(string)
                state = "colon"
            elif sign == "}" and state == "first name":
                open_.pop()
                keys.pop()
                state = "after"
            else:
                raise ValueError("a name is missing")
        elif state == "colon":
            if sign != ":":
                raise ValueError("a colon is missing")
            state = "value"
        else:
            inside = open_[-1]
            if sign == ",":
                state = "value" if isinstance(inside, list) else "name"
            elif sign == ("]" if isinstance(inside, list) else "}"):
                open_.pop()
                keys.pop()
            else:
                raise ValueError(f"no end of a value at {at}")


def _no_constant(name: str):
    raise json.JSONDecodeError(f"{name} is not JSON", name, 0)


def parse(text: str, hide: Callable[[str], bool] | None = None, mark: str = ""):
    """The value of a JSON text; members whose name ``hide`` accepts are replaced by ``mark``, at any depth.  ValueError where
    the text is not JSON."""
    pairs = None if hide is None else lambda found: {k: mark if hide(k) else v for k, v in found}
    try:
        return json.loads(text, object_pairs_hook=pairs, parse_constant=_no_constant)
    except json.JSONDecodeError:
        raise
    except (ValueError, RecursionError):  # too many digits, too deep
        return _slow(text, hide, mark)


def write(value) -> str:
    """Compact JSON with members in order of name."""
    try:
        return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False) if not _has_number(value) else _write(value)
    except (ValueError, RecursionError):
        return _write(value)


def _has_number(value) -> bool:
    stack = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, Number):
            return True
        stack.extend(v.values() if isinstance(v, dict) else v if isinstance(v, list) else ())
    return False


def _write(value) -> str:
    out, stack = [], [value]
    while stack:
        v = stack.pop()
        if isinstance(v, (_Mark, Number)):
            out.append(v)
        elif isinstance(v, dict):
            stack.append(_Mark("}"))
            names = sorted(v, reverse=True)
            for i, k in enumerate(names):
                stack.append(v[k])
                stack.append(_Mark(("," if i < len(names) - 1 else "") + json.dumps(k, ensure_ascii=False) + ":"))
            out.append("{")
        elif isinstance(v, list):
            stack.append(_Mark("]"))
            for i in range(len(v) - 1, -1, -1):
                stack.append(v[i])
                if i:
                    stack.append(_Mark(","))
            out.append("[")
        elif isinstance(v, int) and not isinstance(v, bool):
            out.append(str(v))
        else:
            out.append(json.dumps(v, ensure_ascii=False))
    return "".join(out)
