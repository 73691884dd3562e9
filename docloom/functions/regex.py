"""Regular expressions and replacements of the JavaScript dialect, in Java's."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.errors import OperationError


def java_pattern(pattern: str, flags: str = "") -> str:
    """The pattern with its flags inlined. `\\d`, `\\w` and the like agree in both dialects."""
    if bad := set(flags) - set("gimsuy"):
        raise OperationError(f"Unsupported regular expression flags: {''.join(sorted(bad))}")
    pattern = pattern.replace("[^]", r"[\s\S]").replace("[]", r"(?!)")
    pattern = re.sub(r"\\u\{([0-9A-Fa-f]+)\}", r"\\x{\1}", pattern)
    inline = "".join(f for f in "ims" if f in flags)
    return f"(?{inline}){pattern}" if inline else pattern


def java_replacement(replacement: str, shift: int = 0) -> str:
    """`$&`, `$1`, `$<name>` and `$$` as Java has them; group numbers move by `shift`."""

    def one(m: re.Match) -> str:
        text = m[0]
        if text == "$$":
            return r"\$"
        if text == "$&":
            return "${whole}" if shift else "$0"
        if text.startswith("$<"):
            return "${" + text[2:-1] + "}"
        if len(text) > 1 and text[0] == "$":
            return f"${int(text[1:]) + shift}"
        return "\\" + text

    return re.sub(r"\$\$|\$&|\$<\w+>|\$\d{1,2}|\$|\\", one, replacement)


def replace_regex(pattern: str, replacement: str, flags: str = "g") -> Callable[[Column], Column]:
    try:
        re.compile(re.sub(r"\(\?<(?![=!])", "(?P<", pattern))
    except re.error as e:
        raise OperationError(f"Invalid regular expression: {e}") from e
    if "g" in flags:
        find, put = java_pattern(pattern, flags), java_replacement(replacement)
        return lambda col: F.regexp_replace(col, F.lit(find), F.lit(put))
    # The first match only: anchored, with what comes before it put back.
    inner = re.sub(r"(?<!\\)\\([1-9])", lambda m: f"\\{int(m[1]) + 2}", pattern)
    find, put = java_pattern(rf"\A(?<before>(?s:.*?))(?<whole>{inner})", flags), java_replacement(replacement, 2)
    return lambda col: F.regexp_replace(col, F.lit(find), F.lit("${before}" + put))
