"""Personal data by weak supervision, in DataFrame functions alone.

Base spans come from fixed patterns with a check each and always stay.  Further candidates (numbers and addresses in looser
forms, keys and secrets) are voted on by labelers: a strict form, a gazetteer of telling parts, words in the context before,
and signs against.  Expectation-maximisation over the counts of vote patterns estimates each labeler's reliability without
any labels, and a logistic classifier of spans is fitted to the resulting probabilities.  Both are fitted to counts whose
number is bounded by the number of patterns (VOTES and FEATURES), over all candidates of all documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_or_empty

KINDS = ("email", "ip", "card", "phone", "secret")
#: Equal to the plain patterns match for match, in linear time: runs are possessive, and a run that can't start a match is
#: not tried again from its middle unless the match before it ended there.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to match.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
#: Looser forms; matches that are base spans are left out.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\[at\]|\(at\)|\x20at\x20)\x20?[A-Za-z0-9-]{2,}+(?:\x20?(?:\[dot\]|\(dot\)|\x20dot\x20|\.)\x20?[A-Za-z]{2,10}+){1,3}+",
    "phone": r"(?<![0-9+.-])(?<!\+[0-9]{1,3}[\x20(])\(?[0-9]{2,4}+\)?(?:[\x20.-][0-9]{2,4}+){2,4}+(?![0-9]|[.-][A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9+/_-])(?:(?=[A-Za-z0-9_.-]{20})eyJ[A-Za-z0-9_-]*+(?:\.[A-Za-z0-9_-]++){1,4}+|(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{20,}+)(?!@|\.[A-Za-z0-9])",
}
STRICT = {
    "email": r"(?i)^[a-z0-9._%+-]+ ?[\[(]at[\])] ?[a-z0-9-]+ ?[\[(]dot[\])]",
    "phone": r"^\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$",
    "secret": r"^(?:AKIA[0-9A-Z]{16}|[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$",
}
GAZETTEER = {
    "email": r"(?i)(gmail|mail|example|yahoo|outlook|proton|\.com|\.org|\.net|dot com|dot org)",
    "phone": r"^\(?(?:0[1-9]|800|888|877|212|310|415|555|617|646|718)",
    "secret": r"^(?:AKIA|ASIA|ghp_|gho_|sk-|sk_|pk_|xox|AIza|eyJ)",
}
CONTEXT = {
    "email": r"(?i)(mail|contact|write|reach)[^a-z]{0,8}$",
    "phone": r"(?i)(phone|tel|call|fax|mobile|cell|number|dial)[a-z]{0,2}[^a-z0-9]{0,8}$",
    "secret": r"(?i)(key|token|secret|passw(?:or)?d|api|credential|auth)[^a-z0-9]{0,8}$",
}
AGAINST = {
    "email": r"(?i) (?:at|dot) (?:the|a|an|once|least|all) ",
    "phone": r"^(?:(?:19|20)[0-9]{2}[ .-][0-9]{2}[ .-][0-9]{2}|[0-9]{2}[ .-][0-9]{2}[ .-](?:19|20)[0-9]{2})$",
    "secret": r"^(?:[A-Za-z]+[-_/]){2,}|^[0-9_/-]+$",
}
N_VOTES = 4
MAX_ROUNDS = 60
#: What the code points before a candidate are searched for CONTEXT.
BEFORE = 24




def located(text: Column, pattern: str, needs: str) -> Column:
    """array<struct<s, e, m, b>>: start, end (code points, exclusive), match and text before, of all matches in order.

    The pieces between the matches and the matches add up to the text, so their lengths give the places.  A text without
    the needed character is not searched.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    pairs = F.zip_with(found, F.slice(pieces, 1, F.size(found)), lambda m, p: F.struct(m.alias("m"), F.length(m).alias("n"), F.length(p).alias("g"), F.substring(F.right(p, F.lit(BEFORE)), 1, BEFORE).alias("b")))
    empty = F.array().cast("array<struct<m:string,n:int,g:int,b:string>>")
    need = F.contains(text, F.lit(needs)) if needs else F.lit(True)
    return F.when(need, F.when(F.size(found) > 0, pairs).otherwise(empty)).otherwise(empty)


def with_places(pairs: Column, sums: Column) -> Column:
    """located()'s pairs with s and e; sums: totals of n + g by blocks of 256."""
    block = 256
    before = F.transform(sums, lambda _, b: F.aggregate(F.slice(sums, 1, b), F.lit(0), lambda a, x: a + x))

    def place(x, i):
        base = F.element_at(before, (i / block).cast("int") + 1)
        inner = F.aggregate(F.slice(pairs, ((i / block).cast("int") * block + 1), i % block), F.lit(0), lambda a, y: a + y["n"] + y["g"])
        start = base + inner + x["g"]
        return F.struct(start.alias("s"), (start + x["n"]).alias("e"), x["m"].alias("m"), x["b"].alias("b"))

    return F.when(F.size(pairs) > 0, F.transform(pairs, place)).otherwise(F.array().cast("array<struct<s:int,e:int,m:string,b:string>>"))


def block_sums(pairs: Column) -> Column:
    block = 256
    last = ((F.size(pairs) - 1) / block).cast("int")
    return F.when(
        F.size(pairs) > 0,
        F.transform(F.sequence(F.lit(0), last), lambda k: F.aggregate(F.slice(pairs, k * block + 1, block), F.lit(0), lambda a, y: a + y["n"] + y["g"])),
    )


def luhn(digits: Column) -> Column:
    """Whether the digits pass the check of card numbers; from the right, every second digit is doubled."""
    marks = F.split(F.reverse(digits), "")
    total = F.aggregate(
        F.transform(marks, lambda d, i: F.when(d == "", 0).otherwise(F.when(i % 2 == 1, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int")))),
        F.lit(0),
        lambda a, x: a + x,
    )
    return total % 10 == 0


def passes(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        small = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 4).try_cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(match, r"\."), small)
    if kind == "card":
        return F.length(digits).between(16, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _located_all(rows: DataFrame, text: Column, patterns: dict[str, str], tag: str, needs: dict[str, str]) -> DataFrame:
    """Columns p_<tag><kind> with the matches and their places."""
    rows = rows.withColumns({f"p_{tag}{k}": located(text, p, needs.get(k, "")) for k, p in patterns.items()})
    rows = rows.withColumns({f"p_sum_{tag}{k}": block_sums(F.col(f"p_{tag}{k}")) for k in patterns})
    rows = rows.withColumns({f"p_{tag}{k}": with_places(F.col(f"p_{tag}{k}"), F.col(f"p_sum_{tag}{k}")) for k in patterns})
    return rows.drop(*[f"p_sum_{tag}{k}" for k in patterns])


def _checked(kind: str) -> Column:
    """Places of the matches that pass their check."""
    good = F.filter(F.col(f"p_base_{kind}"), lambda x: passes(kind, x["m"]))
    return F.transform(good, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))


def _as_kind(kind: str, spans: Column) -> Column:
    number = F.lit(KINDS.index(kind))
    return F.transform(spans, lambda x: F.struct(number.alias("k"), x["s"].alias("s"), x["e"].alias("e")))


def _base_spans() -> list[Column]:
    return [_as_kind(k, F.col(f"p_base_{k}")) for k in BASE]


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with p_base_<kind> (array<struct<s, e>>) and p_loose (array of candidates with votes and features)."""
    text = F.col("p_text")
    rows = docs.withColumn("p_text", text_or_empty(text_col))
    rows = _located_all(rows, text, BASE, "base_", NEEDS)
    rows = rows.withColumns({f"p_base_{k}": _checked(k) for k in BASE})
    rows = _located_all(rows, text, LOOSE, "loose_", {})

    def voted(kind: str):
        base = F.col(f"p_base_{kind}") if kind in BASE else None

        def one(x):
            m, b = x["m"], x["b"]
            votes = [
                F.when(m.rlike(STRICT[kind]), 1).otherwise(0),
                F.when(m.rlike(GAZETTEER[kind]), 1).otherwise(0),
                F.when(b.rlike(CONTEXT[kind]), 1).otherwise(0),
                F.when(m.rlike(AGAINST[kind]), 2).otherwise(0),
            ]
            size, digits = F.length(m), F.length(F.regexp_replace(m, "[^0-9]", ""))
            features = F.concat_ws(
                ":",
                F.when(size < 12, "s").when(size < 24, "m").otherwise("l"),
                F.when(digits * 2 > size, "d").when(digits * 6 > size, "h").otherwise("f"),
                F.when(b.rlike(r"[=:\"'(]\x20?[\"']?$"), "q").when(b.rlike(r"[A-Za-z]\x20$"), "w").otherwise("o"),
                F.when(m.rlike("[A-Z]"), F.when(m.rlike("[a-z]"), "x").otherwise("u")).otherwise("n"),
                F.when(b.rlike(CONTEXT[kind]), "c").otherwise("-"),
                F.when(m.rlike(STRICT[kind]), "t").otherwise("-"),
            )
            return F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(kind).alias("kind"), F.concat(*[v.cast("string") for v in votes]).alias("votes"), features.alias("features"))

        found = F.col(f"p_loose_{kind}")
        if base is not None:
            others = [F.col(f"p_base_{k}") for k in BASE]
            found = F.filter(found, lambda x: ~F.exists(F.concat(*others), lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"])))
        else:
            found = F.filter(found, lambda x: ~F.exists(F.concat(F.col("p_base_card"), F.col("p_base_email")), lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"])))
        return F.transform(found, one)

    return rows.withColumn("p_loose", F.concat(*[voted(k) for k in LOOSE])).drop(*[f"p_loose_{k}" for k in LOOSE])


def estimate(counts: dict[str, float]) -> dict[str, float]:
    """P(true) of each vote pattern, by expectation-maximisation with labelers independent given the truth.

    Votes are 0 (none), 1 (for) and 2 (against).  The start says that votes for come mostly from true spans, which settles
    which class is which; counts are smoothed, so no rate is 0.
    """
    prior = 0.5
    rate = [{True: (0.4, 0.59, 0.01), False: (0.85, 0.1, 0.05)} for _ in range(N_VOTES)]
    out: dict[str, float] = {}
    for _ in range(MAX_ROUNDS):
        new = {}
        for votes in counts:
            yes, no = math.log(prior), math.log1p(-prior)
            for k, v in enumerate(votes):
                yes += math.log(rate[k][True][int(v)])
                no += math.log(rate[k][False][int(v)])
            new[votes] = 1 / (1 + math.exp(min(700.0, no - yes)))
        done = out and max(abs(new[v] - out[v]) for v in new) < 1e-6
        out = new
        if done:
            break
        whole = sum(counts.values())
        mass = sum(counts[v] * out[v] for v in counts)
        prior = min(0.95, max(0.05, (mass + 1) / (whole + 2)))
        for k in range(N_VOTES):
            for truth, total in ((True, mass), (False, whole - mass)):
                seen = [sum(c * (out[v] if truth else 1 - out[v]) for v, c in counts.items() if v[k] == str(x)) for x in range(3)]
                rate[k][truth] = tuple((n + 1) / (total + 3) for n in seen)
    return out


def fit(rows: list[tuple[str, float, float]], steps: int = 400) -> dict[str, float]:
    """P(true) of each feature string, by logistic regression on its parts: rows are (features, weight, P(true))."""
    parts = sorted({f"{k}{p}" for f, _, _ in rows for k, p in enumerate(f.split(":"))} | {""})
    weight = dict.fromkeys(parts, 0.0)
    total = sum(n for _, n, _ in rows) or 1.0
    inputs = [(f, ["", *(f"{k}{p}" for k, p in enumerate(f.split(":")))], n / total, y) for f, n, y in rows]
    score = lambda used: 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weight[p] for p in used)))))
    for _ in range(steps):
        slope = {p: 0.001 * w for p, w in weight.items()}
        for _, used, share, y in inputs:
            gap = share * (score(used) - y)
            for p in used:
                slope[p] += gap
        for p in weight:
            weight[p] -= 2.0 * slope[p]
    return {f: score(used) for f, used, _, _ in inputs}


def train(found: DataFrame) -> dict[str, list[str]]:
    """Per kind, the feature strings whose spans are taken.  found has p_loose; only counts by pattern reach the driver."""
    counts = found.select(F.explode("p_loose").alias("x")).groupBy("x.kind", "x.votes", "x.features").count().collect()
    taken = {}
    for kind in LOOSE:
        own = [r for r in counts if r.kind == kind]
        votes: dict[str, float] = {}
        for r in own:
            votes[r.votes] = votes.get(r.votes, 0.0) + r["count"]
        true = estimate(votes) if own else {}
        soft: dict[str, list[float]] = {}
        for r in own:
            one = soft.setdefault(r.features, [0.0, 0.0])
            one[0] += r["count"]
            one[1] += r["count"] * true[r.votes]
        chance = fit([(f, n, y / n) for f, (n, y) in sorted(soft.items())])
        taken[kind] = sorted(f for f, p in chance.items() if p >= 0.5)
    return taken


def _all_spans(taken: dict[str, list[str]]) -> Column:
    """array<struct<k, s, e>> by kind as listed, then start."""

    def added(kind):
        return _as_kind(kind, F.filter(F.col("p_loose"), lambda x: (x["kind"] == kind) & x["features"].isin(taken[kind])))

    return F.sort_array(F.concat(*_base_spans(), *[added(k) for k in LOOSE if taken[k]]))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans.

    spans holds base and added ones as kind:start:end.  A null or empty text has none; a null id stays null; repeated rows
    get a row each; other columns are left out, whatever their names; an empty table gives an empty one.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = materialize(candidates(rows).drop("p_text", "text"), "pii")
    spans = found.withColumn("p_spans", _all_spans(train(found)))
    base = F.concat(*_base_spans())
    return spans.select("doc_id", *[F.size(f"p_base_{k}").cast("long").alias(f"n_{k}") for k in BASE], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("p_spans")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span of the text, base or added, put as [KIND]; overlapping spans become one, named by the first.

    Columns, whatever their names, and rows stay as they are otherwise; a null text stays null, an empty one empty; repeated
    rows are treated alike; an empty table gives an empty one.  Texts are searched once, and what was found is written.
    """
    own, text_col = docs.columns, f"c{docs.columns.index(text_col)}"
    docs = docs.toDF(*[f"c{k}" for k in range(len(own))])
    found = materialize(candidates(docs, text_col).drop("p_text"), "pii")
    taken = train(found.select("p_loose"))
    rows = found.withColumns({"p_text": text_or_empty(text_col), "p_order": F.sort_array(F.transform(_all_spans(taken), lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("e"), x["k"].alias("k"))))})
    order = F.col("p_order")
    none = F.array().cast("array<struct<s:int,e:int,k:int>>")

    def merge(acc, x):
        last = F.element_at(acc, -1)
        joins = (F.size(acc) > 0) & (x["s"] < F.get(acc, F.size(acc) - 1)["e"])
        longer = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], -x["e"]).alias("e"), last["k"].alias("k"))))
        return F.when(joins, longer).otherwise(F.concat(acc, F.array(F.struct(x["s"].alias("s"), (-x["e"]).alias("e"), x["k"].alias("k")))))

    rows = rows.withColumn("p_merged", F.aggregate(order, none, merge))
    merged, text = F.col("p_merged"), F.col("p_text")
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    pieces = F.transform(
        merged,
        lambda x, i: F.concat(
            F.substring(text, F.when(i > 0, F.get(merged, i - 1)["e"]).otherwise(0) + 1, x["s"] - F.when(i > 0, F.get(merged, i - 1)["e"]).otherwise(0)),
            F.element_at(names, x["k"] + 1),
        ),
    )
    clean = F.concat(F.array_join(pieces, ""), F.substring(text, F.element_at(merged, -1)["e"] + 1, F.length(text)))
    rows = rows.withColumn(text_col, F.when(F.size(merged) > 0, clean).otherwise(F.col(text_col)))
    return rows.select(*docs.columns).toDF(*own)
