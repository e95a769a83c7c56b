"""Ingestion: documents to lines, paragraphs, chunks and segments with exact code point and byte offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Code points that make a line blank when it holds nothing else.
BLANK = r"[\x{0009}\x{000B}\x{000C}\x{0020}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
CHUNK_CHARACTERS = 1200


def scan_lines(docs: DataFrame) -> DataFrame:
    """(doc, line, content, terminator, blank, char_start, char_end, byte_start, byte_end) of each line of (doc, text).

    Only CRLF, LF and CR end a line. Offsets are half open and leave the terminator out. A null or empty text has no
    lines. The running sums are per document.
    """
    pieces = F.regexp_extract_all("text", F.lit(r"[^\r\n]*(?:\r\n|\n|\r)|[^\r\n]+"), 0)
    lines = docs.select("doc", F.posexplode(pieces).alias("line", "raw"))
    content = F.regexp_replace("raw", r"(\r\n|\n|\r)$", "")
    before = Window.partitionBy("doc").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    out = lines.withColumn("content", content).withColumn("char_start", F.coalesce(F.sum(F.length("raw")).over(before), zero)).withColumn("byte_start", F.coalesce(F.sum(F.octet_length("raw")).over(before), zero))
    return out.select(
        "doc", "line", "content", F.expr("substring(raw, length(content) + 1)").alias("terminator"), F.col("content").rlike(f"^{BLANK}*$").alias("blank"),
        "char_start", (F.col("char_start") + F.length("content")).alias("char_end"), "byte_start", (F.col("byte_start") + F.octet_length("content")).alias("byte_end"),
    )


def paragraphs(lines: DataFrame) -> DataFrame:
    """(doc, ordinal, char_start, char_end, byte_start, byte_end): maximal runs of lines that are not blank, ordinals from 1."""
    in_order = Window.partitionBy("doc").orderBy("line")
    runs = lines.withColumn("island", F.sum(F.col("blank").cast("int")).over(in_order)).where(~F.col("blank"))
    spans = runs.groupBy("doc", "island").agg(F.min("char_start").alias("char_start"), F.max("char_end").alias("char_end"), F.min("byte_start").alias("byte_start"), F.max("byte_end").alias("byte_end"))
    return spans.withColumn("ordinal", F.row_number().over(Window.partitionBy("doc").orderBy("char_start"))).drop("island")


def document_version(content: Column) -> Column:
    return F.sha2(content, 256)


def segment_id(story: Column, document: Column, version: Column, start: Column, end: Column, text: Column) -> Column:
    """An opaque id that changes with the document's bytes."""
    parts = F.to_json(F.array(story, document, version, start.cast("string"), end.cast("string"), F.sha2(text, 256)))
    return F.concat(F.lit("seg-"), F.substring(F.sha2(parts, 256), 1, 40))


def corpus_fingerprint(docs: DataFrame) -> DataFrame:
    """(story, fingerprint): digest of the ordered `NNN:sha` lines of (story, order, text); orders have three digits or more."""
    number = F.col("order").cast("string")
    padded = F.lpad(number, F.greatest(F.length(number), F.lit(3)), F.lit("0"))
    entry = F.struct("order", F.concat(padded, F.lit(":"), F.sha2("text", 256)).alias("v"))
    return docs.groupBy("story").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["v"]), "\n"), 256).alias("fingerprint"))


def pack_paragraphs(spans: DataFrame, most: int = CHUNK_CHARACTERS) -> DataFrame:
    """(doc, chunk, char_start, char_end, first_paragraph, last_paragraph, reason) from (doc, ordinal, char_start, char_end).

    Paragraphs are packed in order while a chunk, gaps between its paragraphs included, has at most `most` characters;
    a longer paragraph is cut every `most` characters. One fold over each document's array of paragraphs.
    """
    one = "struct<char_start:bigint,char_end:bigint,first_paragraph:int,last_paragraph:int,reason:string>"
    state = f"struct<done:array<{one}>,open:{one}>"

    def chunk(start: Column, end: Column, first: Column, last: Column, reason: str) -> Column:
        return F.struct(start.alias("char_start"), end.alias("char_end"), first.alias("first_paragraph"), last.alias("last_paragraph"), F.lit(reason).alias("reason")).cast(one)

    def closed(s: Column) -> Column:
        return F.when(s["open"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["open"])))

    def step(s: Column, p: Column) -> Column:
        start, end, n, open_ = p["char_start"], p["char_end"], p["ordinal"], s["open"]
        pieces = F.transform(F.sequence(start, F.greatest(end - 1, start), F.lit(most).cast("long")), lambda x: chunk(x, F.least(x + most, end), n, n, "HARD_SPLIT"))
        cut = F.struct(F.concat(closed(s), pieces).alias("done"), F.lit(None).cast(one).alias("open")).cast(state)
        wider = F.struct(s["done"].alias("done"), chunk(open_["char_start"], end, open_["first_paragraph"], n, "PACK").alias("open")).cast(state)
        fresh = F.struct(closed(s).alias("done"), chunk(start, end, n, n, "PACK").alias("open")).cast(state)
        return F.when(end - start > most, cut).when(open_.isNotNull() & (end - open_["char_start"] <= most), wider).otherwise(fresh)

    begin = F.struct(F.array().cast(f"array<{one}>").alias("done"), F.lit(None).cast(one).alias("open")).cast(state)
    row = F.struct(F.col("ordinal").cast("int").alias("ordinal"), F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"))
    folded = spans.groupBy("doc").agg(F.aggregate(F.array_sort(F.collect_list(row)), begin, step, closed).alias("chunks"))
    return folded.select("doc", F.posexplode("chunks").alias("at", "c")).select("doc", (F.col("at") + 1).alias("chunk"), "c.*")


def gap_violations(spans: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc, char_start, kind) where spans overlap or text outside them is not blank. spans: doc, char_start, char_end; texts: doc, text."""
    order = Window.partitionBy("doc").orderBy("char_start")
    rows = spans.withColumn("last_end", F.coalesce(F.lag("char_end").over(order), F.lit(0).cast("long")))
    tail = spans.groupBy("doc").agg(F.max("char_end").alias("last_end")).withColumn("char_start", F.lit(None).cast("long"))
    whole = rows.select("doc", "last_end", "char_start").unionByName(tail.select("doc", "last_end", "char_start")).join(texts, "doc")
    gap = F.expr("substring(text, cast(last_end + 1 as int), cast(coalesce(char_start, length(text)) - last_end as int))")
    kind = F.when(F.col("char_start") < F.col("last_end"), "OVERLAP").when(~gap.rlike(rf"^(?:{BLANK}|[\r\n])*$"), "TEXT_OUTSIDE")
    return whole.select("doc", F.coalesce("char_start", "last_end").alias("char_start"), kind.alias("kind")).where(F.col("kind").isNotNull())


def token_windows(docs: DataFrame, size: int = 448, stride: int = 384) -> DataFrame:
    """(doc, window, start, end) over (doc, n_tokens): windows every `stride`, the last the first that reaches the end."""
    last = F.greatest(F.ceil((F.col("n_tokens") - size) / F.lit(stride)), F.lit(0)).cast("int")
    rows = docs.where(F.col("n_tokens") > 0).select("doc", "n_tokens", F.explode(F.sequence(F.lit(0), last)).alias("window"))
    start = F.col("window") * stride
    return rows.select("doc", "window", start.cast("long").alias("start"), F.least(start + size, F.col("n_tokens")).cast("long").alias("end"))


def layout(docs: DataFrame) -> DataFrame:
    """(doc, lines_per_paragraph, sentence_end_share, decision) of (doc, text): dense text whose lines end sentences is split by line."""
    shape = docs.select(
        "doc",
        F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "").alias("rows"),
        F.filter(F.split("text", r"\n\s*\n"), lambda x: F.trim(x) != "").alias("paras"),
    )
    per = F.size("rows") / F.greatest(F.size("paras"), F.lit(1))
    ends = F.size(F.filter("rows", lambda x: x.rlike("[.!?。！？」』…]\"?$"))) / F.greatest(F.size("rows"), F.lit(1))
    return shape.select("doc", F.round(per, 9).alias("lines_per_paragraph"), F.round(ends, 9).alias("sentence_end_share"), F.when((per >= 4) & (ends >= 0.7), "SPLIT_LINES").otherwise("KEEP").alias("decision"))
