"""JSON that pages show: a body served as JSON, or a page that holds nothing but a `<pre>`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.paths import ref

#: A page whose body has one element, a `<pre>` without elements of its own.
SOLE_PRE = r"(?is)<body[^>]*>\s*<pre[^>]*>([^<]*)</pre>\s*</body>\s*(?:</html>)?\s*$"
#: Character references of HTML, `&` last. Fixed values.
REFERENCES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def page_json(pages: DataFrame, html: str = "html", media_type: str | None = None, name: str = "doc") -> DataFrame:
    """`pages` that show JSON, with its text under `name`. Where the column `media_type` says
    application/json or ends in +json, the whole body is the text. Pages with null, with text
    besides the `<pre>` and with anything that isn't JSON are left out."""
    text = F.regexp_extract(ref(html), SOLE_PRE, 1)
    for reference, char in REFERENCES.items():
        text = F.replace(text, F.lit(reference), F.lit(char))
    if media_type is not None:
        served = F.coalesce(ref(media_type).rlike(r"(?i)^\s*(application/json|[^;]*\+json)\s*(;.*)?$"), F.lit(False))
        text = F.when(served, ref(html)).otherwise(text)
    found = pages.withColumn(name, text)
    return found.where((F.trim(ref(name)) != "") & F.try_parse_json(ref(name)).isNotNull())
