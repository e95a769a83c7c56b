"""python -m lorecast STORY QUERY --passages PATH --cutoff N: print hits as JSON lines."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .functions.shipping import ship
from .operators.search import TOKENIZERS, Request, retrieve


def main() -> int:
    p = argparse.ArgumentParser(prog="lorecast")
    p.add_argument("story")
    p.add_argument("query")
    p.add_argument("--passages", required=True, help="Parquet with story, chapter, id, text")
    p.add_argument("--cutoff", type=int, required=True)
    p.add_argument("--start", type=int, default=1)
    p.add_argument("--end", type=int)
    p.add_argument("-k", type=int, default=10)
    p.add_argument("--tokenizer", choices=sorted(TOKENIZERS), default="words")
    a = p.parse_args()
    spark = SparkSession.builder.appName("lorecast").getOrCreate()
    ship(spark)
    try:
        hits = retrieve(spark.read.parquet(a.passages), Request(a.story, a.query, a.cutoff, a.k, a.start, a.end), a.tokenizer)
    except ValueError as error:
        print(error, file=sys.stderr)
        return 2
    for line in hits.orderBy("rank").toJSON().collect():
        print(line)
    return 0


if __name__ == "__main__":
    sys.exit(main())
