"""Full-text operators over token arrays: terms, phrases, patterns, edit distances, prefixes and spans."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from quarrion.functions import scoring
from quarrion.plans.scope import Hit, Scope


def paths_of(spec, scope: Scope | None = None) -> list[str]:
    """A path or several.  {wildcard} names all text paths that fit it, {value, multi} a path with another of its analyzers."""
    out = []
    for p in spec if isinstance(spec, list) else [spec]:
        if isinstance(p, str):
            out.append(p)
        elif "wildcard" in p:
            if scope is None:
                raise ValueError("a wildcard path is for text operators only")
            fits = re.compile(wildcard_pattern(p["wildcard"]))
            out += [name for name in scope.text_paths() if fits.match(name)]
        else:
            out.append(scope.with_multi(p["value"], p["multi"]) if p.get("multi") and scope is not None else p["value"])
    return list(dict.fromkeys(out))


def queries_of(spec) -> list[str]:
    return spec if isinstance(spec, list) else [spec]


def bind(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it in lambdas."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def analysed(scope: Scope, path: str, text: str) -> list[str]:
    return [t for t in scope.analyzer(path).tokens(SparkSession.builder.getOrCreate(), text) if t is not None]


def any_of(hits: list[Hit]) -> Hit:
    """Matches where one does; the scores of those that do add up."""
    if not hits:
        return Hit(F.lit(False), F.lit(0.0))
    match, score = hits[0].match, F.lit(0.0)
    for h in hits[1:]:
        match = match | h.match
    for h in hits:
        score = score + F.when(h.match, h.score).otherwise(0.0)
    return Hit(match, score)


def weighed(scope: Scope, path: str, tokens: Column, tf: Column, rarity: list[tuple], similarity: str, df: float | None = None) -> Column:
    """Relevance of a frequency; rarity: (name, condition) of the terms whose inverse document frequencies add up."""
    if similarity == "boolean" or scope.element is not None:
        return F.when(tf > 0, 1.0).otherwise(0.0)
    length = scope.once((path, "length"), F.size(F.filter(tokens, lambda t: t.isNotNull())), 1)
    if similarity == "stableTfl":
        return scoring.stable_tfl(tf, length, str(rarity[0][0]))
    n = scope.stats.get((path, "n"), F.sum(F.when(length > 0, 1).otherwise(0)))
    total = scope.stats.get((path, "length"), F.sum(F.when(length > 0, length).otherwise(0)))
    idf = sum(scoring.idf(n, scope.stats.get((path, "df", name), F.sum(F.when(there, 1).otherwise(0))) if df is None else df) for name, there in rarity)
    return scoring.bm25(tf, length, idf, total / n if n else 0.0)


def counted(scope: Scope, path: str, name, test, similarity: str | None = None, df: float | None = None) -> Hit:
    """Tokens that pass a test, as one term of its own; df: its document frequency where it is not its own."""
    tokens = scope.tokens(path)
    tf = scope.once((path, "tf", name), F.coalesce(F.size(F.filter(tokens, lambda t: t.isNotNull() & test(t))), F.lit(0)), 1)
    spec = scope.definition.of(path, "string", scope.type_of(path)) or {}
    kind = similarity or spec.get("similarity", {}).get("type", scope.definition.similarity)
    return Hit(tf > 0, weighed(scope, path, tokens, tf, [(name, tf > 0)], kind, df))


def swaps(word: str) -> list[tuple[str, str, str]]:
    """(before, pair, after) for every pair of unlike neighbours, the pair in the other order."""
    return [(word[:i], word[i + 1] + word[i], word[i + 2 :]) for i in range(len(word) - 1) if word[i] != word[i + 1]]


def within(token: Column, word: str, edits: int) -> Column:
    """The number of edits from a token to a word, null beyond `edits`.  To swap two neighbours is one edit, and no further
    edit falls between the two (optimal string alignment)."""
    plain = F.levenshtein(token, F.lit(word), edits)
    out = F.when(plain >= 0, plain)
    if edits == 0 or len(word) < 2:
        return out
    once = [a + pair + b for a, pair, b in swaps(word)]
    found = F.when(token.isin(once), 1) if once else F.lit(None).cast("int")
    if edits > 1 and once:
        two = {a + p + b[: len(x)] + q + y for a, p, b in swaps(word) for x, q, y in swaps(b)}
        hit = token.isin(sorted(two)) if two else F.lit(False)
        for a, pair, b in swaps(word):
            rest = F.length(token) - len(pair) - len(b)
            hit = hit | (token.startswith(a + pair) & (F.levenshtein(F.substring(token, F.lit(len(a) + 3), F.length(token)), F.lit(b), 1) >= 0))
            hit = hit | (token.endswith(pair + b) & (rest >= 0) & (F.levenshtein(F.substring(token, F.lit(1), F.greatest(rest, F.lit(0))), F.lit(a), 1) >= 0))
        # four plain edits make up for any two of these
        found = F.coalesce(found, F.when((F.levenshtein(token, F.lit(word), 4) >= 0) & hit, 2))
    return F.least(out, found)


def fuzzy_options(fuzzy: dict, most: int = 50, least_edits: int = 1) -> tuple[int, int, int]:
    edits, prefix, expansions = fuzzy.get("maxEdits", 2), fuzzy.get("prefixLength", 0), fuzzy.get("maxExpansions", most)
    if not least_edits <= edits <= 2:
        raise ValueError(f"maxEdits must be from {least_edits} to 2")
    if not 1 <= expansions <= 1000 or prefix < 0:
        raise ValueError("maxExpansions must be from 1 to 1000, and prefixLength not negative")
    return edits, prefix, expansions


def near_word(word: str, fuzzy: dict):
    """Tokens within some edits of a word that share its first characters."""
    edits, prefix, _ = fuzzy_options(fuzzy, least_edits=0)
    return lambda t: (t.startswith(word[:prefix]) if prefix else F.lit(True)) & within(F.substring(t, F.lit(prefix + 1), F.length(t)), word[prefix:], edits).isNotNull()


def fuzzy_hit(scope: Scope, path: str, word: str, fuzzy: dict, most: int = 50, least_edits: int = 1) -> Hit:
    """The terms of the index within some edits: the maxExpansions nearest, each by its frequency and the largest document
    frequency among them, weighed by 1 - edits / the shorter length.  Within nested documents all such tokens are one term."""
    edits, prefix, expansions = fuzzy_options(fuzzy, most, least_edits)
    test = near_word(word, {"maxEdits": edits, "prefixLength": prefix})
    if scope.element is not None:
        return counted(scope, path, ("fuzzy", word, str(fuzzy)), test)

    def rank(t):
        far = within(F.substring(t, F.lit(prefix + 1), F.length(t)), word[prefix:], edits)
        return 1 - far / F.least(F.length(t), F.lit(len(word)))

    terms = scope.stats.terms((path, "fuzzy", word, edits, prefix), scope.tokens(path), test, rank, expansions)
    if terms is None:
        return counted(scope, path, ("fuzzy", word, str(fuzzy)), test)
    df = max((n for _, _, n in terms), default=0)
    return any_of([boosted(counted(scope, path, t, lambda x, w=t: x == w, df=df), weight) for t, weight, _ in terms])


def boosted(hit: Hit, by: float) -> Hit:
    return Hit(hit.match, hit.score * by)


def best_of(hits: list[Hit], tie: float) -> Hit:
    """The best score, and `tie` of the others."""
    if len(hits) == 1:
        return hits[0]
    each = [F.when(h.match, h.score).otherwise(0.0) for h in hits]
    best = F.greatest(*each)
    return Hit(any_of(hits).match, best + tie * (sum(each[1:], each[0]) - best))


def term_hit(scope: Scope, path: str, word: str) -> Hit:
    return counted(scope, path, word, lambda t: t == word)


def joined_hits(hits: list[Hit], criteria: str) -> Hit:
    hit = any_of(hits)
    if criteria == "all" and hits:
        return Hit(_all([h.match for h in hits]), hit.score)
    return hit


def text(spec: dict, scope: Scope) -> Hit:
    """Any or all terms of the analysed query, exact, fuzzy, or with synonyms."""
    if spec.get("fuzzy") is not None and not isinstance(spec["fuzzy"], dict):
        raise ValueError("fuzzy must be a document")
    if spec.get("fuzzy") is not None and spec.get("synonyms"):
        raise ValueError("fuzzy and synonyms exclude each other")
    criteria, hits = spec.get("matchCriteria", "any"), []
    for path in paths_of(spec["path"], scope):
        for query in queries_of(spec["query"]):
            words = analysed(scope, path, query)
            terms = list(dict.fromkeys(words))
            if spec.get("synonyms"):
                hits.append(with_synonyms(scope, path, words, scope.definition.synonyms[spec["synonyms"]], criteria))
            elif spec.get("fuzzy") is not None:
                hits.append(joined_hits([fuzzy_hit(scope, path, w, spec["fuzzy"]) for w in terms], criteria))
            else:
                hits.append(joined_hits([term_hit(scope, path, w) for w in terms], criteria))
    return any_of(hits)


#: What synonyms weigh: the others of a group beside the best one, and what is written as it is asked.  Fixed values.
SYNONYM_TIE, EXACT_BOOST = 0.1, 2.0


def with_synonyms(scope: Scope, path: str, words: list[str], mapping: dict, criteria: str) -> Hit:
    """Each term or longest run of terms that has synonyms is a group, of which the best counts; alternatives of several
    words are phrases.  What matches without synonyms scores twice its relevance more.

    mapping: from the words of an input, joined by spaces, to its alternatives, each so joined; a term that stands for itself
    too is among its alternatives.
    """
    groups, at, used = [], 0, False
    longest = max((len(k.split(" ")) for k in mapping), default=1)
    while at < len(words):
        for n in range(min(longest, len(words) - at), 0, -1):
            name = " ".join(words[at : at + n])
            if name in mapping:
                groups.append((name, list(dict.fromkeys(mapping[name]))))
                used, at = True, at + n
                break
        else:
            groups.append((words[at], [words[at]]))
            at += 1
    one = lambda alternative: term_hit(scope, path, alternative) if " " not in alternative else phrase_hit(scope, path, alternative.split(" "), 0)
    groups = list(dict((g[0], g) for g in groups).values())
    found = joined_hits([best_of([boosted(one(x), EXACT_BOOST) if x == name and len(same) > 1 else one(x) for x in same], SYNONYM_TIE) for name, same in groups], criteria)
    if not used:
        return found
    exact = joined_hits([term_hit(scope, path, w) for w in dict.fromkeys(words)], criteria)
    return any_of([found, boosted(exact, EXACT_BOOST)])


def phrase_frequency(tokens: Column, terms: list[str], slop: int) -> Column:
    """The sum of 1 / (1 + moves) over the places of the first term from which the others are reached within `slop` moves.

    A term's shift is how far it stands from its place after the first term, the nearest one counting; moves are the
    difference of the largest and the least shift, so terms may stand in another order at the cost of their shifts.
    """

    def frequency(words):
        starts = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i) == terms[0])

        def shift(i, k):
            # no further than the slop allows, so that a rare term does not cost the whole text from every start
            low = F.greatest(i + k - slop, F.lit(0))
            window = F.slice(words, low + 1, F.greatest(i + k + slop - low + 1, F.lit(0)))
            away = F.filter(F.transform(window, lambda t, j: F.when(t == terms[k], low + j - i - k)), lambda x: x.isNotNull())
            return F.array_min(F.transform(away, lambda x: F.struct(F.abs(x).alias("d"), x.alias("x"))))["x"]

        def moves(i):
            shifts = [shift(i, k) for k in range(1, len(terms))]
            known = _all([x.isNotNull() for x in shifts])
            spread = F.greatest(F.lit(0), *shifts) - F.least(F.lit(0), *shifts)
            return F.when(known & (spread <= slop), 1 / (1 + spread)).otherwise(0.0)

        if len(terms) == 1:
            return F.size(starts).cast("double")
        return F.aggregate(F.transform(starts, moves), F.lit(0.0), lambda a, x: a + x)

    return F.coalesce(F.when(F.size(tokens) > 0, bind(tokens, frequency)), F.lit(0.0))


def phrase_hit(scope: Scope, path: str, terms: list[str], slop: int) -> Hit:
    tokens = scope.tokens(path)
    tf = scope.once((path, "phrase", tuple(terms), slop), phrase_frequency(tokens, terms, slop), 1)
    rarity = [(t, F.coalesce(F.array_contains(tokens, t), F.lit(False))) for t in dict.fromkeys(terms)]
    return Hit(tf > 0, weighed(scope, path, tokens, tf, rarity, scope.definition.similarity))


def phrase(spec: dict, scope: Scope) -> Hit:
    """Terms in order, within some moves of their places; with synonyms, every wording of the phrase is one."""
    hits = []
    for path in paths_of(spec["path"], scope):
        for query in queries_of(spec["query"]):
            terms = analysed(scope, path, query)
            if not terms:
                continue
            if spec.get("synonyms"):
                mapping = scope.definition.synonyms[spec["synonyms"]]
                wordings = [[]]
                for t in terms:
                    wordings = [w + x.split(" ") for w in wordings for x in dict.fromkeys(mapping.get(t, [t]))][:1024]
                each = [phrase_hit(scope, path, w, spec.get("slop", 0)) for w in wordings]
                hits.append(any_of([best_of(each, SYNONYM_TIE), boosted(phrase_hit(scope, path, terms, spec.get("slop", 0)), EXACT_BOOST)]))
                continue
            hits.append(phrase_hit(scope, path, terms, spec.get("slop", 0)))
    return any_of(hits)


def phrase_prefix(spec: dict, scope: Scope) -> Hit:
    """A phrase whose last term is a prefix of one of the first maxExpansions terms of the index in term order."""
    hits, most = [], spec.get("maxExpansions", 50)
    for path in paths_of(spec["path"], scope):
        for query in queries_of(spec["query"]):
            terms = analysed(scope, path, query)
            if not terms:
                continue
            head, last = terms[:-1], terms[-1]
            found = scope.stats.terms((path, "prefix", last), scope.tokens(path), lambda t: t.startswith(last), lambda t: F.lit(0.0), most)
            hits.append(phrase_hit(scope, path, terms, 0) if found is None else any_of([phrase_hit(scope, path, [*head, t], spec.get("slop", 0)) for t, _, _ in found]))
    return any_of(hits)


def wildcard_pattern(query: str) -> str:
    """* any run, ? one character, a backslash takes the next as it is."""
    out = ""
    for escaped, char in re.findall(r"\\(.)|(.)", query, re.S):
        out += re.escape(escaped) if escaped else {"*": ".*", "?": "."}.get(char, re.escape(char))
    return f"(?s)^(?:{out})$"


def fitting(pattern: str):
    return lambda v: F.coalesce(v.cast("string").rlike(pattern), F.lit(False))


def patterned(spec: dict, scope: Scope, to_pattern) -> Hit:
    """A pattern over whole values; over tokens where the field is analysed and that is allowed.  Scores are constant."""
    hits = []
    for path in paths_of(spec["path"], scope):
        for query in queries_of(spec["query"]):
            pattern = to_pattern(query)
            if spec.get("allowAnalyzedField"):
                match = F.coalesce(F.exists(scope.tokens(path), fitting(pattern)), F.lit(False))
            else:
                match = scope.any_value(path, fitting(pattern))
            hits.append(Hit(match, F.lit(1.0)))
    return any_of(hits)


def wildcard(spec: dict, scope: Scope) -> Hit:
    return patterned(spec, scope, wildcard_pattern)


def anchored(query: str) -> str:
    if re.search(r"\(\?[=!<]", query) or re.search(r"(?<!\\)[~&@#<>\"]", query):
        raise ValueError(f"unsupported pattern {query}")
    try:
        re.compile(query)
    except re.error:
        return r"(?!)"
    return f"(?s)^(?:{query})$"


def regex(spec: dict, scope: Scope) -> Hit:
    """Anchored; a pattern that does not compile matches nothing.  Operators of other dialects are refused."""
    return patterned(spec, scope, anchored)


def term(spec: dict, scope: Scope) -> Hit:
    """One term that is not analysed; variants by prefix, wildcard, regex and edits."""
    out = []
    for path in paths_of(spec["path"], scope):
        word = spec["query"]
        if spec.get("prefix"):
            out.append(Hit(F.coalesce(F.exists(scope.tokens(path), lambda t: t.startswith(word)), F.lit(False)), F.lit(1.0)))
        elif spec.get("wildcard") or spec.get("regex"):
            out.append((wildcard if spec.get("wildcard") else regex)({"path": path, "query": word, "allowAnalyzedField": True}, scope))
        elif spec.get("fuzzy") is not None:
            out.append(fuzzy_hit(scope, path, word, spec["fuzzy"], 256, 0))
        else:
            out.append(counted(scope, path, word, lambda t: t == word))
    return any_of(out)


def autocomplete(spec: dict, scope: Scope) -> Hit:
    """Beginnings of words.  any: one of the query's words, or the whole query, begins a word of the text; sequential: the
    whole query does.  Each that matches scores 1; what matches as a text (sequential: as a phrase) adds its relevance.

    A beginning has minGrams to maxGrams characters: a longer query is cut, and a shorter one matches nothing.
    """
    hits = []
    for path in paths_of(spec["path"], scope):
        grams = scope.definition.of(path, "autocomplete", scope.type_of(path)) or {}
        low, high = grams.get("minGrams", 2), grams.get("maxGrams", 15)
        if (spec.get("fuzzy") or {}).get("prefixLength", 0) > high:
            raise ValueError("prefixLength exceeds maxGrams")
        for query in queries_of(spec["query"]):
            words = analysed(scope, path, query)
            if not words:
                raise ValueError("no terms are left of the query")
            tokens, one = scope.tokens(path), spec.get("tokenOrder", "any") == "sequential"
            whole = " ".join(words)[:high].split(" ")
            parts = [] if one else [x[:high] for x in words if len(x) >= low]
            each = [F.coalesce(F.exists(tokens, _prefix(x, spec.get("fuzzy"))), F.lit(False)) for x in dict.fromkeys(parts)]
            if len(" ".join(whole)) >= low and (one or len(whole) > 1):
                each.append(F.coalesce(bind(tokens, starting(whole, spec.get("fuzzy"))), F.lit(False)))
            hits.append(any_of([Hit(m, F.lit(1.0)) for m in each]))
            exact = phrase_hit(scope, path, words, 0) if one else joined_hits([term_hit(scope, path, w) for w in dict.fromkeys(words)], "any")
            hits.append(Hit(F.lit(False), F.when(exact.match, exact.score).otherwise(0.0)))
    match = any_of(hits).match
    return Hit(match, sum((F.when(h.match, h.score).otherwise(0.0) if k % 2 == 0 else h.score for k, h in enumerate(hits)), F.lit(0.0)))


def starting(words: list[str], fuzzy: dict | None = None):
    """Whether words follow one another, the last of them as a beginning; fuzzy: the last within its edits."""
    begins = _prefix(words[-1], fuzzy)
    here = lambda ts, i: _all([*[F.coalesce(F.get(ts, i + k) == x, F.lit(False)) for k, x in enumerate(words[:-1])], F.coalesce(begins(F.get(ts, i + len(words) - 1)), F.lit(False))])
    return lambda ts: F.exists(F.sequence(F.lit(0), F.size(ts)), lambda i: here(ts, i))


def _prefix(word: str, fuzzy: dict | None):
    """Whether a token begins with a word, or with what is within some edits of it."""
    if fuzzy is None or len(word) <= fuzzy.get("prefixLength", 0):
        return lambda t: F.coalesce(t.startswith(word), F.lit(False))
    edits, near = fuzzy.get("maxEdits", 2), near_word(word, fuzzy)

    def test(t):
        out = F.lit(False)
        for n in range(max(1, len(word) - edits), len(word) + edits + 1):
            out = out | F.coalesce((F.length(t) >= n) & near(F.substring(t, 1, n)), F.lit(False))
        return out

    return test


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


# --- spans: arrays of (s, e, w): start, end (exclusive), positions covered by terms ---


def _span(s, e, w) -> Column:
    return F.struct(s.cast("int").alias("s"), e.cast("int").alias("e"), w.cast("int").alias("w"))


def _joined(left: Column, in_order: bool, slop: int):
    """Spans of two clauses that do not overlap; those too far apart are left out before they are formed."""

    def close(a, b):
        apart = b["s"] >= a["e"]
        if not in_order:
            apart = apart | (a["s"] >= b["e"])
        return apart & (F.greatest(a["e"], b["e"]) - F.least(a["s"], b["s"]) - a["w"] - b["w"] <= slop)

    both = lambda a, b: _span(F.least(a["s"], b["s"]), F.greatest(a["e"], b["e"]), a["w"] + b["w"])
    return lambda right: F.flatten(F.transform(left, lambda a: F.transform(F.filter(right, lambda b: close(a, b)), lambda b: both(a, b))))


def spans(spec: dict, scope: Scope) -> tuple[str, Column]:
    """The path and the spans of a span clause."""
    (kind, arg), = spec.items()
    if kind == "term":
        path = paths_of(arg["path"], scope)[0]
        tokens, word = scope.tokens(path), arg["query"]
        test = span_test(arg)
        marked = F.transform(tokens, lambda t, i: F.when(F.coalesce(test(t), F.lit(False)), _span(i, i + 1, F.lit(1))))
        return path, F.filter(marked, lambda x: x.isNotNull())
    if kind == "near":
        parts = [spans(c, scope) for c in arg["clauses"]]
        path, found = parts[0]
        for _, other in parts[1:]:
            found = bind(other, _joined(found, bool(arg.get("inOrder")), arg.get("slop", 0)))
        return path, found
    if kind == "first":
        path, found = spans(arg["operator"], scope)
        return path, F.filter(found, lambda x: x["e"] <= arg.get("endPositionLte", 3))
    if kind == "or":
        parts = [spans(c, scope) for c in arg["clauses"]]
        return parts[0][0], F.array_distinct(F.concat(*[p[1] for p in parts]))
    if kind in ("subtract", "contains"):
        one, two = ("include", "exclude") if kind == "subtract" else ("big", "little")
        (path, a), (_, b) = spans(arg[one], scope), spans(arg[two], scope)
        if kind == "subtract":
            return path, bind(b, lambda ys: F.filter(a, lambda x: ~F.exists(ys, lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"]))))
        holds = lambda x, y: (x["s"] <= y["s"]) & (y["e"] <= x["e"])
        if arg.get("spanToReturn", "outer") == "inner":
            return path, bind(a, lambda xs: F.filter(b, lambda y: F.exists(xs, lambda x: holds(x, y))))
        return path, bind(b, lambda ys: F.filter(a, lambda x: F.exists(ys, lambda y: holds(x, y))))
    raise ValueError(f"unknown span {kind}")


def span_test(arg: dict):
    word = arg["query"]
    if arg.get("prefix"):
        return lambda t: t.startswith(word)
    if arg.get("wildcard") or arg.get("regex"):
        return fitting(wildcard_pattern(word) if arg.get("wildcard") else anchored(word))
    return near_word(word, arg["fuzzy"]) if arg.get("fuzzy") is not None else (lambda t: t == word)


def span_terms(spec: dict) -> list[dict]:
    """The term clauses that a span's relevance counts; what is subtracted adds none."""
    (kind, arg), = spec.items()
    if kind == "term":
        return [arg]
    inner = arg.get("clauses") or [arg[k] for k in ("operator", "include", "big", "little") if k in arg]
    return [t for c in inner for t in span_terms(c)]


def span(spec: dict, scope: Scope) -> Hit:
    """Documents with a span left.  The frequency is the sum of 1 / (1 + positions within a span that no term covers)."""
    clause = {k: v for k, v in spec.items() if k != "score"}
    path, found = spans(clause, scope)
    total = F.aggregate(found, F.lit(0.0), lambda a, x: a + 1 / (1 + x["e"] - x["s"] - x["w"]))
    tf = scope.once((path, "span", repr(clause)), F.coalesce(total, F.lit(0.0)), 1)
    tokens = scope.tokens(path)
    named = {repr({k: v for k, v in a.items() if k != "path"}): a for a in span_terms(clause)}
    rarity = [(name if len(a) > 2 else a["query"], F.coalesce(F.exists(tokens, span_test(a)), F.lit(False))) for name, a in named.items()]
    return Hit(tf > 0, weighed(scope, path, tokens, tf, rarity, scope.definition.similarity))
