"""An HTML tree of one JSON value, for previews."""

from __future__ import annotations

from typing import Any

from docloom.operators.nodes import Number, dump_json
from docloom.paths import pointer


def escape(text: str) -> str:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = text.replace(char, name)
    return text


def tree_html(value: Any, highlight: dict[str, str] | None = None, path: tuple = (), key: str | None = None) -> str:
    """Containers fold, the first two levels stand open; `highlight` maps pointers to the
    kind of their change, which becomes a class."""
    mark = (highlight or {}).get(pointer(list(path)))
    css = f' class="diff-{escape(mark)}"' if mark else ""
    label = "" if key is None else f'<span class="key">{escape(key)}</span>: '
    if isinstance(value, (dict, list)):
        items = list(value.items()) if isinstance(value, dict) else list(enumerate(value))
        noun = "item" if isinstance(value, list) else "field"
        inner = "".join(f"<li>{tree_html(v, highlight, (*path, k), str(k))}</li>" for k, v in items)
        opened = " open" if len(path) < 2 else ""
        return f"<details{opened}{css}><summary>{label}{len(items)} {noun}{'' if len(items) == 1 else 's'}</summary><ul>{inner}</ul></details>"
    kind = "number" if isinstance(value, Number) else "null" if value is None else type(value).__name__
    return f'<span{css}>{label}<span class="{kind}">{escape(dump_json(value))}</span></span>'
