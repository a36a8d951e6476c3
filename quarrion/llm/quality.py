"""Quality rules with risk-controlled thresholds.

Every document is measured once, over its whole text.  Labelled documents that pass the base rules are dealt into two halves
by a hash of their id.  In each stratum the first half proposes a cutoff for each measure: of all cutoffs that lose at most
an equal part of the risk among its good documents, the one that catches the most bad ones for the good ones it loses.  How
far a document is beyond the proposed cutoffs, as a share of the way to the measure's end, is its excess.  Cutoffs on the
excess are then tested on the good documents of the other half, from the most lenient on: a cutoff is certified if, were the
true rate of false rejection `risk` or more, so few rejections would be this unlikely (the exact binomial tail).  The first
that fails ends the sequence, which needs no correction within a stratum (fixed-sequence testing); between strata the error
rate is divided by their number.  So with probability 1 - error, no stratum loses more than `risk` of its good documents to
the rules.  Only DataFrame functions are used, and nothing but the fitted cutoffs, one row for each stratum, is joined back.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import GAP, WORD, materialize, text_or_empty

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bang")
#: Rates in thousandths: what is counted, and of what.
RATES = (("n_symbols", "word_chars"), ("n_upper", "word_chars"), ("n_bang", "word_chars"), ("n_dup_lines", "n_lines"), ("n_repeat_words", "n_words"))
#: Steps of the excess, and the cutoffs that reject nothing.
STEPS, NONE = 10_000, 1001
#: Up to so many strata (a few MB) their cutoffs are broadcast; beyond it the join shuffles and AQE splits a large stratum.
BROADCAST_STRATA = 20_000


def repeat_words(windows: Column, places: Column) -> Column:
    """How many words stand in windows of three that occur twice or more, from the hashes of all windows.

    Windows are sorted with their places, so equal ones are neighbours; places of those are spread over three words.
    """
    n = F.size(windows)
    both = F.zip_with(
        F.slice(places, 1, n - 1), F.slice(places, 2, n - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["p"], b["p"]))
    )
    hit = F.array_distinct(F.flatten(F.filter(both, lambda x: x.isNotNull())))
    return F.size(F.array_distinct(F.flatten(F.transform(hit, lambda p: F.array(p, p + 1, p + 2)))))


def measures(docs: DataFrame, text_col: str = "text", prefix: str = "q_") -> DataFrame:
    """docs with the MEASURES as long columns under prefix (columns of these names are replaced).

    A null text counts as empty and has no words, symbols or lines.
    """
    text = text_or_empty(text_col)
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.drop(*[prefix + m for m in (*MEASURES, "hash", "win", "place", "lines")])
    rows = rows.withColumns({f"{prefix}hash": F.transform(words, lambda w: F.xxhash64(w)), f"{prefix}lines": lines})
    h = F.col(f"{prefix}hash")
    n = F.greatest(F.size(h) - 2, F.lit(0))
    pairs = F.zip_with(F.slice(h, 1, n), F.slice(h, 2, n), lambda a, b: F.xxhash64(a, b))
    rows = rows.withColumn(f"{prefix}win", F.zip_with(pairs, F.slice(h, 3, n), lambda ab, c: F.xxhash64(ab, c)))
    win = F.col(f"{prefix}win")
    repeats = F.size(F.array_distinct(win)) < F.size(win)
    place = F.when(repeats, F.sort_array(F.transform(win, lambda x, i: F.struct(x.alias("h"), i.alias("p")))))
    rows = rows.withColumn(f"{prefix}place", place)
    long = {
        "n_words": F.size(h),
        "word_chars": F.length(F.regexp_replace(text, GAP + "+", "")),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")),
        "n_dup_lines": F.size(f"{prefix}lines") - F.size(F.array_distinct(F.col(f"{prefix}lines"))),
        "n_repeat_words": F.when(F.col(f"{prefix}place").isNull(), 0).otherwise(repeat_words(win, F.col(f"{prefix}place"))),
        "n_lines": F.size(f"{prefix}lines"),
        "n_upper": F.regexp_count(text, F.lit(r"\p{Lu}")),
        "n_bang": F.regexp_count(text, F.lit("!")),
    }
    rows = rows.withColumns({prefix + k: v.cast("long") for k, v in long.items()})
    return rows.drop(*[prefix + m for m in ("hash", "win", "place", "lines")])


def base_failed(prefix: str = "q_") -> Column:
    words, repeats = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (words < 50) | (100 * repeats > 50 * words)


def rates(prefix: str = "q_") -> Column:
    """array of the RATES in whole thousandths, at most 1000; 0 where there is nothing to count in."""
    one = lambda a, b: F.when(F.col(prefix + b) > 0, F.least(F.floor(1000 * F.col(prefix + a) / F.col(prefix + b)), F.lit(1000))).otherwise(0).cast("long")
    return F.array(*[one(a, b) for a, b in RATES])


def excess(rate: Column, cuts: Column) -> Column:
    """0 if no rate is above its cutoff, else how far the worst is beyond it on the way to 1000: 1 to STEPS."""
    beyond = F.zip_with(rate, cuts, lambda r, c: F.when(r > c, F.ceil(STEPS * (r - c) / (1000 - c))).otherwise(0))
    return F.coalesce(F.array_max(beyond), F.lit(0)).cast("long")


def log_gamma(x: Column) -> Column:
    """The logarithm of the gamma function for x >= 1: Stirling's series, from x + 8 on."""
    low = F.log(x * (x + 1) * (x + 2) * (x + 3)) + F.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    y = x + 8
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5.0))) - low


def allowed(n: Column, level: float, risk: float) -> Column:
    """The largest k with P(X <= k) <= level for X binomial with n draws at rate risk; -1 if there is none.

    level is below a half, so k is below n * risk.  Terms that are over twelve deviations below the mean are left out: they
    are less than 1e-30 together.
    """
    n = n.cast("double")
    least = F.greatest(F.floor(n * risk - 12 * F.sqrt(n * risk * (1 - risk))) - 30, F.lit(0)).cast("double")
    term = log_gamma(n + 1) - log_gamma(least + 1) - log_gamma(n - least + 1) + least * math.log(risk) + (n - least) * math.log1p(-risk)
    start = F.struct((least - 1).alias("k"), F.lit(0.0).alias("sum"), term.alias("term"), least.alias("j"))

    def step(acc, _):
        total = acc["sum"] + F.exp(acc["term"])
        following = acc["term"] + F.log((n - acc["j"]) / (acc["j"] + 1)) + math.log(risk / (1 - risk))
        return F.struct(F.when(total <= level, acc["j"]).otherwise(acc["k"]).alias("k"), total.alias("sum"), following.alias("term"), (acc["j"] + 1).alias("j"))

    places = F.sequence(F.lit(0), F.greatest(F.ceil(n * risk) - least, F.lit(0)).cast("int"))
    found = F.aggregate(places, start, step)["k"].cast("long")
    # with no draw at all, nothing is certain
    return F.when((n > 0) & (found >= least), found).otherwise(F.lit(-1).cast("long"))


def second_half(doc_id: Column) -> Column:
    """Whether a labelled document certifies; else it proposes."""
    return F.substring(F.md5(F.concat(F.lit("half:"), doc_id.cast("string"))), 1, 1) >= "8"


def propose(rows: DataFrame, risk: float) -> DataFrame:
    """stratum, cuts from rows (stratum, good, rate): a cutoff for each rate, NONE where none catches more than it loses."""
    every = rows.select("stratum", "good", F.posexplode("rate").alias("m", "r"))
    table = every.groupBy("stratum", "m", "r").agg(F.count(F.when(F.col("good"), 1)).alias("good"), F.count(F.when(~F.col("good"), 1)).alias("bad"))
    # a window holds the values of one rate, 1001 at most
    all_of = Window.partitionBy("stratum", "m")
    above = all_of.orderBy(F.desc("r")).rowsBetween(Window.unboundedPreceding, -1)
    nothing = F.lit(0).cast("long")
    scored = table.select(
        "stratum", "m", "r",
        F.sum("good").over(all_of).alias("all_good"), F.sum("bad").over(all_of).alias("all_bad"),
        F.coalesce(F.sum("good").over(above), nothing).alias("lost"), F.coalesce(F.sum("bad").over(above), nothing).alias("caught"),
    )
    gain = F.col("caught") * F.col("all_good") - F.col("lost") * F.col("all_bad")
    fair = scored.where((F.col("lost") * len(RATES) <= risk * F.col("all_good")) & (gain > 0) & (F.col("r") < 1000))
    best = fair.groupBy("stratum", "m").agg(F.max_by("r", F.struct(gain, "r")).alias("r"))
    return best.groupBy("stratum").agg(F.array(*[F.coalesce(F.max(F.when(F.col("m") == k, F.col("r"))), F.lit(NONE).cast("long")) for k in range(len(RATES))]).alias("cuts"))


def certify(rows: DataFrame, risk: float, error: float) -> DataFrame:
    """stratum, most: the least certified cutoff on the excess, from the excess of good documents (stratum, excess).

    Strata too small for any certificate have no row and don't count in the correction.
    """
    sizes = materialize(rows.groupBy("stratum").agg(F.count("*").alias("n")).where(F.pow(F.lit(1 - risk), F.col("n")) <= error), "strata")
    tested = sizes.select("stratum", allowed(F.col("n"), error / max(1, sizes.count()), risk).alias("k")).where("k >= 0")
    # a window holds the steps of one stratum, STEPS + 1 at most
    above = Window.partitionBy("stratum").orderBy(F.desc("excess")).rowsBetween(Window.unboundedPreceding, -1)
    table = rows.unionByName(rows.select("stratum").distinct().withColumn("excess", F.lit(0).cast("long")).withColumn("none", F.lit(0)), allowMissingColumns=True)
    table = table.groupBy("stratum", "excess").agg(F.count(F.when(F.col("none").isNull(), 1)).alias("n"))
    lost = table.select("stratum", "excess", F.coalesce(F.sum("n").over(above), F.lit(0).cast("long")).alias("lost"))
    fine = lost.join(tested, lost["stratum"].eqNullSafe(tested["stratum"])).where("lost <= k").select(lost["stratum"], "excess")
    return fine.groupBy("stratum").agg(F.min("excess").alias("most"))


def _join(rows: DataFrame, keyed: DataFrame, stratum: Column) -> DataFrame:
    """Left join on the stratum, null as a stratum of its own."""
    keyed = keyed.withColumnRenamed("stratum", "q_of")
    return rows.join(keyed, stratum.eqNullSafe(F.col("q_of")), "left").drop("q_of")


def thresholds(rows: DataFrame, labels: DataFrame, risk: float, error: float) -> DataFrame:
    """stratum, cuts, most from rows (q_id, stratum, rate, failed) of all documents.  Ids with labels of both kinds are left out."""
    one = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("q_id"))
    known = one.agg(F.min("quality").alias("lo"), F.max("quality").alias("hi")).where("lo = hi").select("q_id", (F.col("lo") == 1).alias("good"))
    held = materialize(rows.where(~F.col("failed")).join(known, "q_id").select("q_id", "stratum", "rate", "good"), "labelled")
    cuts = materialize(propose(held.where(~second_half(F.col("q_id"))), risk), "proposed")
    last = held.where(second_half(F.col("q_id")) & F.col("good"))
    beyond = _join(last, cuts, F.col("stratum")).select("stratum", excess(F.col("rate"), F.col("cuts")).alias("excess"))
    most = certify(beyond, risk, error)
    return cuts.join(most.withColumnRenamed("stratum", "q_most"), F.col("stratum").eqNullSafe(F.col("q_most"))).select("stratum", "cuts", "most")


def judged(rows: DataFrame, labels: DataFrame, risk: float, error: float, prefix: str) -> DataFrame:
    """rows (a written table with q_id, stratum and the measures) with failed and kept, all under prefix."""
    rows = rows.withColumns({f"{prefix}rate": rates(prefix), f"{prefix}failed": base_failed(prefix)})
    narrow = rows.select(*[F.col(prefix + c).alias(n) for c, n in (("id", "q_id"), ("stratum", "stratum"), ("rate", "rate"), ("failed", "failed"))])
    fitted = materialize(thresholds(narrow, labels, risk, error), "cutoffs").select("stratum", F.col("cuts").alias(f"{prefix}cuts"), F.col("most").alias(f"{prefix}most"))
    if fitted.count() <= BROADCAST_STRATA:
        fitted = F.broadcast(fitted)
    out = _join(rows, fitted, F.col(f"{prefix}stratum"))
    beyond = F.coalesce(excess(F.col(f"{prefix}rate"), F.col(f"{prefix}cuts")) > F.col(f"{prefix}most"), F.lit(False))
    return out.withColumn(f"{prefix}kept", ~F.col(f"{prefix}failed") & ~beyond)


def judge(docs: DataFrame, labels: DataFrame, stratum_col="lang", id_col="doc_id", text_col="text", risk: float = 0.03, error: float = 0.05, prefix: str = "q_", whole: bool = True) -> DataFrame:
    """docs with the measures, failed (by the base rules) and kept, and what led to them, all under prefix.

    A document is kept if it passes the base rules and its excess is not above its stratum's certified cutoff.  Strata
    without a certificate, a null stratum among them unless it has its own, keep all that passes the base rules.  A null or
    empty text has no words and fails; a long one is measured whole.  Repeated rows are judged alike, and each labelled row
    counts; a row with a null id counts for nothing and is judged like others.  Columns of docs that begin with prefix are
    replaced.  An empty table or empty labels give no certificate and no error.  whole: docs are written to the shared
    folder with their measures, so no text is read or measured twice; else the other columns are left out.
    """
    rows = docs.drop(*[c for c in docs.columns if c.startswith(prefix)])
    rows = rows.withColumns({f"{prefix}id": F.col(id_col).cast("long"), f"{prefix}stratum": F.col(stratum_col).cast("string")})
    rows = measures(rows, text_col, prefix)
    names = [f"{prefix}id", f"{prefix}stratum", *[prefix + m for m in MEASURES]]
    return judged(materialize(rows if whole else rows.select(*names), "measured"), labels, risk, error, prefix)


def keep(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that are kept, with the columns of docs, whatever their names."""
    prefix = "q_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix = f"q{prefix}"
    return judge(docs, labels, prefix=prefix, **options).where(F.col(f"{prefix}kept")).select(*docs.columns)


def report(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept; other columns are left out."""
    rows = judge(docs, labels, whole=False, **options)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return rows.select(F.col("q_id").alias("doc_id"), *[F.col(f"q_{m}").alias(m) for m in names], F.col("q_failed").alias("base_failed"), F.col("q_kept").alias("kept"))
