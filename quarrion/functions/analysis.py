"""Text analysis as column functions: char filters, then a tokenizer, then token filters.

Tokens are an array of strings whose index is the position; a filter that removes a token leaves a null, so positions keep
their gaps for phrases and spans.  All but stemming and Unicode normalisation runs in the JVM.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stemming import english_minimal, porter, spanish_plural

#: Words by the rules of UAX 29, near enough: letters, marks and digits, joined by single apostrophes, dots or underscores.
STANDARD = r"[\p{L}\p{M}\p{N}]+(?:['’._][\p{L}\p{M}\p{N}]+)*"
URL_EMAIL = r"[A-Za-z][A-Za-z0-9+.-]*://[^\s<>\"]+|[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+|" + STANDARD
# The default stop words of the English analyzer.
ENGLISH_STOP = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()


def _udf(f: Callable[[str], str]):
    """An Arrow function over arrays of tokens."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(tokens):
        known: dict[str, str] = {}

        def one(row):
            if row is None:
                return None
            out = []
            for t in row:
                if t is not None and t not in known:
                    known[t] = f(t)
                out.append(None if t is None else known[t])
            return out

        return tokens.map(one)

    return run


def _text_udf(f: Callable[[str], str]):
    @F.pandas_udf(T.StringType())
    def run(texts):
        return texts.map(lambda t: None if t is None else f(t))

    return run


def _keep(condition):
    """Tokens that fail the condition become gaps."""
    return lambda tokens: F.transform(tokens, lambda t: F.when(condition(t), t))


def _each(f):
    return lambda tokens: F.transform(tokens, f)


def _fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def fold_table() -> tuple[str, str]:
    """Latin letters with marks and their bare forms, by decomposition."""
    pairs = {}
    for code in range(0xC0, 0x250):
        bare = _fold(chr(code))
        if len(bare) == 1 and bare != chr(code) and ord(bare) < 128:
            pairs[chr(code)] = bare
    return "".join(pairs), "".join(pairs.values())


def ascii_fold(column: Column) -> Column:
    return F.translate(column, *fold_table())


def grams(token: Column, low: int, high: int, edge: bool) -> Column:
    """All substrings of low to high characters, or those at the start."""
    sizes = F.sequence(F.lit(low), F.least(F.lit(high), F.length(token)))
    if edge:
        found = F.transform(sizes, lambda n: F.substring(token, F.lit(1), n))
    else:
        starts = lambda n: F.sequence(F.lit(1), F.length(token) - n + 1)
        found = F.flatten(F.transform(sizes, lambda n: F.transform(starts(n), lambda s: F.substring(token, s, n))))
    return F.when(F.length(token) >= low, found).otherwise(F.array().cast("array<string>"))


def char_filter(spec: dict) -> Callable[[Column], Column]:
    kind = spec["type"]
    if kind == "htmlStrip":
        kept = "|".join(map(re.escape, spec.get("ignoredTags", [])))
        tag = rf"(?is)<(?:script|style)\b.*?</(?:script|style)\s*>|<!--.*?-->|</?(?!(?:{kept})\b)[a-zA-Z!][^>]*>" if kept else r"(?is)<(?:script|style)\b.*?</(?:script|style)\s*>|<!--.*?-->|</?[a-zA-Z!][^>]*>"

        def strip(c):
            bare = F.regexp_replace(c, tag, " ")
            for name, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
                bare = F.replace(bare, F.lit(name), F.lit(mark))
            return bare

        return strip
    if kind == "mapping":
        pairs = sorted(spec["mappings"].items(), key=lambda p: -len(p[0]))

        def replaced(c):
            for k, (old, _) in enumerate(pairs):  # through marks of the private use area, so that no output is mapped again
                c = F.replace(c, F.lit(old), F.lit(chr(0xE000 + k)))
            for k, (_, new) in enumerate(pairs):
                c = F.replace(c, F.lit(chr(0xE000 + k)), F.lit(new))
            return c

        return replaced
    if kind == "persian":
        return lambda c: F.translate(c, "‌", " ")
    if kind == "icuNormalize":
        return _text_udf(lambda t: unicodedata.normalize("NFKC", t).casefold())
    raise ValueError(f"unknown char filter {kind}")


def tokenizer(spec: dict) -> Callable[[Column], Column]:
    kind, longest = spec["type"], spec.get("maxTokenLength")

    def cut(found):
        """Tokens over the longest length are cut to several."""
        if longest is None:
            return found
        starts = lambda t: F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1)), F.lit(longest))
        return F.flatten(F.transform(found, lambda t: F.transform(starts(t), lambda s: F.substring(t, s, F.lit(longest)))))

    nonempty = lambda a: F.filter(a, lambda t: t != "")
    if kind == "standard":
        return lambda c: cut(F.regexp_extract_all(c, F.lit(STANDARD), F.lit(0)))
    if kind == "uaxUrlEmail":
        return lambda c: cut(F.regexp_extract_all(c, F.lit(URL_EMAIL), F.lit(0)))
    if kind == "whitespace":
        return lambda c: cut(nonempty(F.split(c, r"\s+")))
    if kind == "letter":
        return lambda c: F.regexp_extract_all(c, F.lit(r"\p{L}+"), F.lit(0))
    if kind == "keyword":
        return lambda c: F.array(c)
    if kind == "regexSplit":
        return lambda c: nonempty(F.split(c, spec["pattern"]))
    if kind == "regexCaptureGroup":
        return lambda c: nonempty(F.regexp_extract_all(c, F.lit(spec["pattern"]), F.lit(spec["group"])))
    if kind in ("nGram", "edgeGram"):
        return lambda c: grams(c, spec["minGram"], spec["maxGram"], kind == "edgeGram")
    raise ValueError(f"unknown tokenizer {kind}")


def token_filter(spec: dict) -> Callable[[Column], Column]:
    kind = spec["type"]
    if kind == "lowercase":
        return _each(F.lower)
    if kind == "uppercase":
        return _each(F.upper)
    if kind == "trim":
        return _each(lambda t: F.trim(t))
    if kind == "reverse":
        return _each(F.reverse)
    if kind == "stopword":
        words = spec["tokens"]
        if spec.get("ignoreCase", True):
            low = [w.lower() for w in words]
            return _keep(lambda t: ~F.lower(t).isin(low))
        return _keep(lambda t: ~t.isin(list(words)))
    if kind == "length":
        return _keep(lambda t: F.length(t).between(spec.get("min", 0), spec.get("max", 255)))
    if kind == "limitTokenCount":
        return lambda a: F.slice(a, 1, spec.get("maxTokenCount", 1))
    if kind == "regex":
        if spec.get("matches", "all") == "first":
            return _each(lambda t: F.regexp_replace(t, f"^(.*?)(?:{spec['pattern']})", "$1" + spec["replacement"]))
        return _each(lambda t: F.regexp_replace(t, spec["pattern"], spec["replacement"]))
    if kind == "englishPossessive":
        return _each(lambda t: F.regexp_replace(t, "['’][sS]$", ""))
    if kind == "asciiFolding":
        if spec.get("originalTokens", "omit") == "include":
            return lambda a: F.flatten(F.transform(a, lambda t: F.array_distinct(F.array(ascii_fold(t), t))))
        return _each(ascii_fold)
    if kind == "icuFolding":
        return _udf(lambda t: _fold(unicodedata.normalize("NFKC", t).casefold()))
    if kind == "icuNormalizer":
        form = spec.get("normalizationForm", "nfc").upper()
        return _udf(lambda t: unicodedata.normalize(form, t))
    if kind == "shingle":
        low, high = spec["minShingleSize"], spec["maxShingleSize"]

        def shingled(a):
            words = F.filter(a, lambda t: t.isNotNull())
            starts = F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1)))
            at = lambda s: F.transform(
                F.filter(F.array(*[F.lit(n) for n in range(low, high + 1)]), lambda n: s + n - 1 <= F.size(words)), lambda n: F.array_join(F.slice(words, s, n), " ")
            )
            return F.flatten(F.transform(starts, lambda s: F.concat(F.filter(F.slice(words, s, 1), lambda t: t.isNotNull()), at(s))))

        return shingled
    if kind in ("nGram", "edgeGram"):
        low, high, edge = spec["minGram"], spec["maxGram"], kind == "edgeGram"
        keep = spec.get("termNotInBounds", "omit") == "include"

        def gram(t):
            found = grams(t, low, high, edge)
            whole = ((F.length(t) < low) | (F.length(t) > high)) if keep else F.lit(False)
            return F.when(t.isNull(), F.array().cast("array<string>")).when(whole, F.concat(found, F.array(t))).otherwise(found)

        return lambda a: F.flatten(F.transform(a, gram))
    if kind == "keywordRepeat":
        return lambda a: F.flatten(F.transform(a, lambda t: F.array(t, t)))
    if kind == "removeDuplicates":
        return lambda a: F.filter(a, lambda t, i: (i == 0) | ~t.eqNullSafe(F.get(a, i - 1)))
    if kind == "flattenGraph":
        return lambda a: a
    if kind == "wordDelimiterGraph":
        options = spec.get("delimiterOptions", {})
        parts = r"\p{Lu}?\p{Ll}+|\p{Lu}+(?!\p{Ll})|\p{Lo}+" if options.get("splitOnCaseChange", True) else r"\p{L}+"
        parts = f"{parts}|\\p{{N}}+" if options.get("splitOnNumerics", True) else f"(?:{parts}|\\p{{N}})+"

        def split(t):
            bare = F.regexp_replace(t, "['’][sS]$", "") if options.get("stemEnglishPossessive", True) else t
            found = F.regexp_extract_all(bare, F.lit(parts), F.lit(0))
            if options.get("preserveOriginal", False):
                found = F.array_distinct(F.concat(F.array(t), found))
            if options.get("concatenateAll", False):
                found = F.array_distinct(F.concat(found, F.array(F.array_join(F.regexp_extract_all(bare, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), ""))))
            return found

        return lambda a: F.flatten(F.transform(F.filter(a, lambda t: t.isNotNull()), split))
    if kind in ("porterStemming", "snowballStemming"):
        if kind == "snowballStemming" and spec.get("stemmerName") != "porter":
            raise NotImplementedError(f"no {spec.get('stemmerName')} stemmer")
        return _udf(porter)
    if kind == "englishMinimalStemming":
        return _udf(english_minimal)
    if kind == "spanishPluralStemming":
        return _udf(spanish_plural)
    raise NotImplementedError(f"no token filter {kind}")


_analysed: dict[tuple, list] = {}


class Analyzer:
    def __init__(self, char_filters=(), tokenizer_spec=None, filters=()):
        self.spec = (tuple(map(repr, char_filters)), repr(tokenizer_spec), tuple(map(repr, filters)))
        self.char_filters = [char_filter(s) for s in char_filters]
        self.tokenizer = tokenizer(tokenizer_spec or {"type": "standard"})
        self.filters = [token_filter(s) for s in filters]

    def __call__(self, column: Column) -> Column:
        for f in self.char_filters:
            column = f(column)
        tokens = self.tokenizer(column)
        for f in self.filters:
            tokens = f(tokens)
        return tokens

    def tokens(self, spark, text: str) -> list[str | None]:
        """The tokens of one text, such as a query's, by the same plan.  The last ones are kept: a query is compiled more than once."""
        key = (*self.spec, text)
        if key not in _analysed:
            if len(_analysed) >= 1000:
                _analysed.clear()
            _analysed[key] = spark.range(1).select(self(F.lit(text)).alias("t")).first().t
        return _analysed[key]


LOWER = {"type": "lowercase"}
#: Names of analyzers that need stop words, stemmers or segmentation that are not built: fixed values.
NOT_BUILT = ("arabic armenian basque bengali brazilian bulgarian catalan chinese cjk czech danish dutch finnish french galician german greek hindi hungarian indonesian irish italian japanese korean kuromoji latvian lithuanian morfologik nori norwegian persian polish portuguese romanian russian smartcn sorani spanish swedish thai turkish ukrainian").split()


def stock(name: str) -> Analyzer:
    """A stock analyzer by its name, with or without the prefix lucene."""
    plain = name.removeprefix("lucene.").lower()
    if plain in NOT_BUILT:
        raise NotImplementedError(f"the analyzer {name} is not built")
    if plain == "standard":
        return Analyzer(filters=[LOWER])
    if plain == "simple":
        return Analyzer(tokenizer_spec={"type": "letter"}, filters=[LOWER])
    if plain == "whitespace":
        return Analyzer(tokenizer_spec={"type": "whitespace"})
    if plain == "keyword":
        return Analyzer(tokenizer_spec={"type": "keyword"})
    if plain == "stop":
        return Analyzer(tokenizer_spec={"type": "letter"}, filters=[LOWER, {"type": "stopword", "tokens": ENGLISH_STOP}])
    if plain == "english":
        return Analyzer(filters=[{"type": "englishPossessive"}, LOWER, {"type": "stopword", "tokens": ENGLISH_STOP}, {"type": "porterStemming"}])
    raise ValueError(f"unknown analyzer {name}")


def custom(definition: dict) -> Analyzer:
    return Analyzer(definition.get("charFilters", ()), definition["tokenizer"], definition.get("tokenFilters", ()))
