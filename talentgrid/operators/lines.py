"""Tables of text lines and what stands around each line."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def document_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, line_no, line``: the lines of each text from 0, trimmed; blank ones are no lines and take no number.

    A null text has none.  ``key`` is unique.
    """
    lines = F.filter(F.transform(F.split(F.col(text), "\n"), lambda l: F.trim(l)), lambda l: l != "")
    return docs.select(key, F.posexplode(lines).alias("line_no", "line"))


def with_neighbours(lines: DataFrame, n: int = 2, key: str = "doc_id", order: str = "line_no", line: str = "line") -> DataFrame:
    """``lines`` with ``prev1`` to ``prev<n>`` and ``next1`` to ``next<n>``: the lines 1 to ``n`` before and after in the same
    document, by ``order``; NULL beyond its ends.

    One shuffle by document and a sort, which spill; no document is gathered in memory.  ``order`` is unique in a document.
    """
    around = Window.partitionBy(key).orderBy(order)
    return lines.withColumns({**{f"prev{k}": F.lag(line, k).over(around) for k in range(1, n + 1)},
                              **{f"next{k}": F.lead(line, k).over(around) for k in range(1, n + 1)}})
