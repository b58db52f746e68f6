"""T1 in full: text nodes of HTML with entities decoded, as an Arrow UDF on the standard parser."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")

    def handle_endtag(self, tag):
        if tag in ("script", "style") and self.skip:
            self.skip -= 1

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)


def text_of(html: str | None) -> str:
    """Text nodes joined by a space; scripts, styles and comments are left out."""
    p = _Text()
    p.feed(html or "")
    p.close()
    return " ".join(p.parts)


@F.pandas_udf(StringType())
def html_text(c: pd.Series) -> pd.Series:
    return c.map(text_of)
