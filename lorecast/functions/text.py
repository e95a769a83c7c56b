"""Text functions: tokenizers, similarity and checks, as built-in expressions; only Unicode forms are Arrow UDFs."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Character ranges of Han with its extensions, of Hangul, and of kana with unified ideographs.
HAN = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{20000}-\x{2FA1F}"
HANGUL = r"\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{AC00}-\x{D7AF}"
KANA_KANJI = r"\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}"
WORDS = r"[\p{L}\p{N}]+"


def _form(name: str, fold: bool = True):
    """A Unicode form, case-folded or not, which no built-in function gives; null counts as empty."""

    @F.pandas_udf(StringType())
    def form(text: pd.Series) -> pd.Series:
        found = text.fillna("").map(lambda x: unicodedata.normalize(name, x))
        return found.str.casefold() if fold else found

    return form


nfkc, nfkc_folded, nfc_folded = _form("NFKC", False), _form("NFKC"), _form("NFC")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), the value being computed once; what a lambda of body refers to is then no Python UDF."""
    return F.transform(F.array(value), body)[0]


def word_tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), 0)


def _pairs(items: Column, joined) -> Column:
    """joined(x, y) of each item x and the next, y."""
    return F.zip_with(F.slice(items, 1, F.greatest(F.size(items) - 1, F.lit(0))), F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))), joined)


def _characters(run: Column) -> Column:
    return F.regexp_extract_all(run, F.lit("(?s)."), 0)


def japanese_tokens(text: Column) -> Column:
    """Runs of letters and digits as they are; of a run of kana and kanji each character, followed from the second on by its pair with the one before."""
    native = f"[{KANA_KANJI}]"
    runs = F.regexp_extract_all(nfkc_folded(text), F.lit(rf"{native}+|[\p{{L}}\p{{N}}&&[^{KANA_KANJI}]]+"), 0)

    def spread(run: Column) -> Column:
        chars = _characters(run)
        return F.concat(F.slice(chars, 1, 1), F.flatten(_pairs(chars, lambda x, y: F.array(y, F.concat(x, y)))))

    return F.flatten(F.transform(runs, lambda r: F.when(r.rlike(f"^{native}"), spread(r)).otherwise(F.array(r))))


def cjk_tokens(text: Column) -> Column:
    """Words, then the character pairs of each Han or Hangul run (a run of one counts itself unless it is a word)."""
    def spread(folded: Column) -> Column:
        words, runs = (F.regexp_extract_all(folded, F.lit(p), 0) for p in (WORDS, f"[{HAN}]+|[{HANGUL}]+"))
        alone = lambda r: F.when(F.array_contains(words, r), F.array().cast("array<string>")).otherwise(F.array(r))
        return F.concat(words, F.flatten(F.transform(runs, lambda r: F.when(F.length(r) == 1, alone(r)).otherwise(_pairs(_characters(r), lambda x, y: F.concat(x, y))))))

    return let(nfkc_folded(text), spread)


def latin_tokens(text: Column) -> Column:
    """Words, then each pair of neighbours."""
    words = F.regexp_extract_all(nfc_folded(text), F.lit(WORDS), 0)
    return let(words, lambda w: F.concat(w, _pairs(w, lambda x, y: F.concat_ws("_", x, y))))


def tokens_by_language(text: Column, lang: Column) -> Column:
    """The tokenizer of a text's language: Japanese, Korean and Chinese have their own, all others are Latin."""
    return F.when(lang == "ja", japanese_tokens(text)).when(lang.isin("ko", "zh"), cjk_tokens(text)).otherwise(latin_tokens(text))


def bigram_set(text: Column) -> Column:
    """Distinct pairs of adjacent characters, whitespace taken out, lower-cased."""
    squashed = F.regexp_replace(F.lower(text), r"\s+", "")
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(squashed) - 1, F.lit(1))), lambda i: F.substring(squashed, i, F.lit(2)))
    return F.when(F.length(squashed) < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(pairs))


def dice(a: Column, b: Column) -> Column:
    """Dice similarity of two sets; 0 where either is empty."""
    total = F.size(a) + F.size(b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / total)


def squash(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", "")


def natural_key(identifier: Column) -> Column:
    """A key that orders digit runs by value: each is preceded by its length."""
    parts = F.regexp_extract_all(identifier, F.lit(r"[0-9]+|[^0-9]+"), 0)
    def padded(p: Column) -> Column:
        stripped = F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.when(p.rlike("^[0-9]"), F.concat(F.lpad(F.length(stripped).cast("string"), 4, "0"), stripped)).otherwise(p)
    return F.transform(parts, padded)


#: Patterns of leftovers that a finished text must not hold.
ARTIFACTS = {
    "code_fence": "```",
    "heading": r"(?m)^#{1,6} ",
    "placeholder": r"(?i)\[(todo|tbd|insert[^\]]*|placeholder)\]",
    "html_tag": r"</?[a-z]+[^>]*>",
}


def artifacts(text: Column, patterns: dict[str, str] | None = None) -> Column:
    """Names of the pattern families that a text shows, in order of name."""
    found = [F.when(text.rlike(p), F.lit(k)) for k, p in sorted((patterns or ARTIFACTS).items())]
    return F.filter(F.array(*found), lambda x: x.isNotNull())
