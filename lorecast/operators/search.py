"""The retrieval API: a request over a story's passages, answered by a named retriever under an inclusive cutoff."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import cjk_tokens, japanese_tokens, latin_tokens, word_tokens
from . import retrieval as rt

#: Device names that some file systems reserve, as a pattern.
RESERVED = r"con|prn|aux|nul|com\d|lpt\d"
#: One path component: word characters and hyphens with single dots between them, not led by a hyphen, dot or device name.
STORY = re.compile(rf"(?!(?:{RESERVED})(?:\.|$))(?![.-])(?:\.?[\w-]+)+", re.I | re.A)
TOKENIZERS: dict[str, Callable] = {"words": word_tokens, "japanese": japanese_tokens, "cjk": cjk_tokens, "latin": latin_tokens}


@dataclass(frozen=True)
class Request:
    story: str
    query: str
    cutoff: int
    k: int = 10
    start: int = 1
    end: int | None = None

    def problems(self) -> list[str]:
        end = self.cutoff if self.end is None else self.end
        faults = {
            "the story is not one plain path component": STORY.fullmatch(self.story) is None,
            "the query is empty": not self.query or self.query.isspace(),
            "k is below 1": self.k < 1,
            "the window is not within 1 and the cutoff": not (0 < self.start <= end <= self.cutoff),
        }
        return [what for what, wrong in faults.items() if wrong]

    def checked(self) -> Request:
        if found := self.problems():
            raise ValueError("; ".join(found))
        return self


def retrieve(passages: DataFrame, request: Request, tokenizer: str = "words", index_all: bool = False) -> DataFrame:
    """(query, id, chapter, rank, score) by BM25. passages: story, chapter, id, text; only those up to the cutoff are read.

    index_all: statistics over the whole story instead of its part up to the cutoff. A hit beyond the window is an error.
    """
    r = request.checked()
    tokenize = TOKENIZERS[tokenizer]
    scope = passages.where(F.col("story") == r.story)
    if not index_all:
        scope = scope.where(F.col("chapter") <= r.cutoff)
    scope = scope.select("id", "chapter", tokenize(F.col("text")).alias("tokens"))
    query = scope.sparkSession.createDataFrame([(r.query,)], "query string").withColumn("tokens", tokenize(F.col("query")))
    window = F.col("chapter").between(r.start, r.end or r.cutoff)
    hits = rt.ranked(rt.bm25_scores(scope, query, allowed=window), "id", k=r.k).join(scope.select("id", "chapter"), "id")
    leak = F.when(~F.col("chapter").between(r.start, r.end or r.cutoff), F.raise_error(F.lit("a hit lies beyond the window")).cast("int")).otherwise(F.col("chapter"))
    return hits.select("query", "id", leak.alias("chapter"), "rank", "score")
