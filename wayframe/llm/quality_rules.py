"""Weak supervision of document quality: rules vote good, bad or abstain; expectation maximisation rates the rules.

All of it is DataFrame functions. Each document gives one pattern of votes; there are at most 2 ** rules patterns whatever
the corpus, so the counts of all documents by pattern fit in one row, and the rounds of EM are a fold over that row.
Each junk rule votes bad or abstains, since the absence of one kind of junk says little about the others; one rule votes good
where every measure is in its good range. A rule's accuracy is the chance that its vote, when it votes, agrees with the hidden
quality; rules that agree with each other raise each other's. A document is kept if its posterior of good quality is at least
0.5 and the base rules do not fail it. Null texts have no words and fail.
Texts of any length are measured whole, in time in proportion to it. Repeated rows are separate rows; patterns of equal posterior are treated alike; an empty table gives an empty result; clashing column names are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
ROUNDS, PRIOR, START, LOW, HIGH = 20, 0.8, 0.85, 0.6, 0.99
#: Words that end in symbols, and in the mark of a sentence's end.
TAILS, ENDS = r"[#*$%&|<>](?=[\x20\x09-\x0D]|$)", r"[.!?](?=[\x20\x09-\x0D]|$)"
#: (measure, upper bound of good, lower bound of bad); between them the rule abstains.
CEILINGS = (
    ("n_symbols / n_words", 0.05, 0.2),
    ("n_dup_lines / n_lines", 0.05, 0.3),
    ("n_repeat_words / n_words", 0.05, 0.2),
    ("n_upper / n_letters", 0.2, 0.5),
    ("n_marks / n_words", 0.1, 0.4),
    ("n_digits / word_chars", 0.05, 0.25),
    ("n_tails / n_words", 0.05, 0.15),
)


def count_of(text: Column, chars: str) -> Column:
    """How many characters of the text are among chars."""
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def repeated_words(w: Column, window: int = 5) -> Column:
    """Words of the array w in windows that are found twice or more, each word once.

    Hashes of the windows tell whether any repeats; only then are they sorted, with their places, so that equal ones meet.
    Places of repeated windows, in order, each cover the words up to the next such place, at most `window`.
    """

    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - window), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)]))

    def places(h: Column) -> Column:
        by_hash = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        equal = lambda s, k, x: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        return common.let(by_hash, lambda s: F.sort_array(F.transform(F.filter(s, lambda x, k: equal(s, k - 1, x) | equal(s, k + 1, x)), lambda x: x["i"])))

    def covered(p: Column) -> Column:
        parts = F.transform(p, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - x, F.lit(window))))
        return F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x)

    some = common.let(hashes(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(common.let(places(h), covered)))
    return F.when(F.size(w) < window, F.lit(0).cast("long")).otherwise(some)


def measures(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, the base measures and those of the rules, one row per document."""
    d = docs.select(*keep, F.coalesce("text", F.lit("")).alias("__text"))
    lines = F.filter(F.split("__text", "\n", -1), lambda x: x.rlike(common.WORD))
    # what is left without the letters a to z, then without white space, is short, and the rest is counted in it
    # a letter stays for each run of them, so that a mark before it is not taken for the end of a word
    d = d.withColumn("__short", F.regexp_replace("__text", "[a-z]+", "a")).withColumn("__rest", F.replace("__short", F.lit("a"), F.lit(""))).withColumn("__marks", F.regexp_replace("__rest", common.SPACE, ""))
    lower, q = F.length("__text") - F.length("__rest"), F.col("__marks")
    d = d.select(
        *keep,
        (lower + F.length(q)).cast("long").alias("word_chars"),
        count_of(q, SYMBOLS).alias("n_symbols"),
        common.let(common.words(F.col("__text")), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r"))).alias("_w"),
        common.let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("r"))).alias("_l"),
        F.regexp_count(q, F.lit("[A-Z]")).cast("long").alias("n_upper"),
        lower.cast("long").alias("n_lower"),
        F.regexp_count(q, F.lit("[!?]")).cast("long").alias("n_marks"),
        F.regexp_count(q, F.lit("[0-9]")).cast("long").alias("n_digits"),
        F.regexp_count("__short", F.lit(TAILS)).cast("long").alias("n_tails"),
        F.regexp_count("__short", F.lit(ENDS)).cast("long").alias("n_ends"),
    )
    d = d.withColumn("n_letters", F.col("n_upper") + F.col("n_lower"))
    more = {"n_words": F.col("_w.n"), "n_repeat_words": F.col("_w.r"), "n_lines": F.col("_l.n"), "n_dup_lines": F.col("_l.r")}
    return d.withColumns(more).drop("_w", "_l")


def votes() -> Column:
    """Array of the rules' votes: 1 good, -1 bad, 0 abstain, also where a share has no whole."""
    n, mean = F.col("n_words"), F.expr("try_divide(word_chars, n_words)")
    share = {m: F.expr("try_divide({0}, {1})".format(*m.split(" / "))) for m, _, _ in CEILINGS}
    bad = [n < 15, (mean < 2) | (mean > 14), 200 * F.col("n_ends") < n, *[share[m] >= high for m, _, high in CEILINGS]]
    good = (n >= 20) & (mean >= 3) & (mean <= 9) & (100 * F.col("n_ends") >= 2 * n)
    for m, low, _ in CEILINGS:
        good &= share[m] <= low
    return F.array(*[F.when(b, -1).otherwise(0) for b in bad], F.when(good, 1).otherwise(0))


RULES = len(CEILINGS) + 4


def posteriors(patterns: DataFrame) -> DataFrame:
    """(votes, posterior, accuracies, prior) of each pattern of (votes, n), by EM over all of them."""
    # proven bound: at most 2 ** RULES rows, as each rule votes in one way or abstains
    row = patterns.groupBy().agg(F.sort_array(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n")))).alias("p")).where(F.size("p") > 0)
    clip = lambda x, low, high: F.least(F.greatest(x, F.lit(low)), F.lit(high))
    odds = lambda x: F.log(x / (F.lit(1.0) - x))

    def good(state: Column, v: Column) -> Column:
        logit = F.aggregate(F.zip_with(v, state["accuracies"], lambda v, a: v * odds(a)), odds(state["prior"]), lambda s, x: s + x)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))

    def again(state: Column, _: Column) -> Column:
        rated = F.transform(F.col("p"), lambda x: F.struct(x["votes"].alias("v"), (x["n"] * good(state, x["votes"])).alias("g"), x["n"].alias("n")))

        def update(r: Column) -> Column:
            total = lambda f: F.aggregate(r, F.lit(0.0), lambda s, x: s + f(x))

            def accuracy(j: Column) -> Column:
                vote = lambda x: F.get(x["v"], j)
                right = total(lambda x: F.when(vote(x) == 1, x["g"]).when(vote(x) == -1, x["n"] - x["g"]).otherwise(0.0))
                return clip((right + F.lit(START)) / (total(lambda x: F.when(vote(x) != 0, x["n"]).otherwise(0.0)) + F.lit(1.0)), LOW, HIGH)

            prior = clip(total(lambda x: x["g"]) / total(lambda x: x["n"]), 0.05, 0.95)
            return F.struct(prior.alias("prior"), F.transform(F.sequence(F.lit(0), F.lit(RULES - 1)), accuracy).alias("accuracies"))

        return common.let(rated, update)

    first = F.struct(F.lit(PRIOR).alias("prior"), F.array(*[F.lit(START)] * RULES).alias("accuracies"))
    fitted = row.withColumn("state", F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), first, again))
    each = fitted.select("state", F.explode("p").alias("x")).select(F.col("x.votes").alias("votes"), "state")
    return each.select("votes", good(F.col("state"), F.col("votes")).alias("posterior"), "state.accuracies", "state.prior")


def judge(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, the base measures, base_failed, posterior (rounded to 6 places) and kept of each document of (text, *keep)."""
    m = common.checkpointed(measures(docs, keep).withColumn("votes", votes()))
    p = posteriors(m.groupBy("votes").agg(F.count("*").alias("n")))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    j = m.join(F.broadcast(p.select("votes", "posterior")), "votes").withColumn("base_failed", failed)
    return j.select(*keep, *BASE, "base_failed", F.round("posterior", 6).alias("posterior"), (~F.col("base_failed") & (F.col("posterior") >= 0.5)).alias("kept"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "documents"))


def sql() -> str:
    """The same rows as SQL, with EM as a recursive query."""
    n, mean = RULES, "(word_chars::DOUBLE / nullif(n_words, 0))"
    shares = [("({}::DOUBLE / nullif({}, 0))".format(*m.split(" / ")), low, high) for m, low, high in CEILINGS]
    bad = ["n_words < 15", f"{mean} < 2 OR {mean} > 14", "200 * n_ends < n_words", *[f"{x} >= {high}" for x, _, high in shares]]
    good = " AND ".join(["n_words >= 20", f"{mean} BETWEEN 3 AND 9", "100 * n_ends >= 2 * n_words", *[f"{x} <= {low}" for x, low, _ in shares]])
    cases = [*[f"CASE WHEN {b} THEN -1 ELSE 0 END" for b in bad], f"CASE WHEN {good} THEN 1 ELSE 0 END"]
    vs = [f"v{j}" for j in range(n)]
    logit = lambda s: f"ln({s}.prior / (1 - {s}.prior)) + " + " + ".join(f"{v} * ln({s}.a{j} / (1 - {s}.a{j}))" for j, v in enumerate(vs))
    steps = ", ".join(f"least(greatest((sum(CASE v{j} WHEN 1 THEN n * g WHEN -1 THEN n - n * g ELSE 0 END) + {START}::DOUBLE) / (sum(CASE WHEN v{j} <> 0 THEN n ELSE 0 END) + 1), {LOW}::DOUBLE), {HIGH}::DOUBLE)" for j in range(n))
    count = lambda chars: f"length(t) - length(translate(t, '{chars}', ''))"
    # without look-ahead: the white space after a mark never is the next mark
    tails, ends = (x.replace("(?=", "(?:") for x in (TAILS, ENDS))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, i, [w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
p AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM g) WHERE c > 1),
r AS (SELECT doc_id, sum(least(5, coalesce(nxt - i, 5)))::BIGINT AS r FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM p) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         ({count(SYMBOLS)})::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines,
         coalesce(r.r, 0)::BIGINT AS n_repeat_words, {count(upper)} AS n_upper, {count(upper + upper.lower())} AS n_letters,
         len(regexp_extract_all(t, '{tails}')) AS n_tails, len(regexp_extract_all(t, '{ends}')) AS n_ends, {count('!?')} AS n_marks, {count('0123456789')} AS n_digits
  FROM d LEFT JOIN r ON d.doc_id = r.doc_id),
v AS (SELECT *, {', '.join(f'{c} AS v{j}' for j, c in enumerate(cases))} FROM m),
q AS (SELECT {', '.join(vs)}, count(*)::DOUBLE AS n FROM v GROUP BY ALL),
em AS (
  SELECT 0 AS round, {PRIOR}::DOUBLE AS prior, {', '.join(f'{START}::DOUBLE AS a{j}' for j in range(n))}
  UNION ALL
  SELECT round + 1, least(greatest(sum(n * g) / sum(n), 0.05::DOUBLE), 0.95::DOUBLE), {steps}
  FROM (SELECT em.round, q.*, 1 / (1 + exp(-({logit('em')}))) AS g FROM em, q WHERE em.round < {ROUNDS}) GROUP BY round)
SELECT v.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       round(1 / (1 + exp(-({logit('em')}))), 6) AS posterior,
       (NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 1 / (1 + exp(-({logit('em')}))) >= 0.5) AS kept
FROM v, em WHERE em.round = {ROUNDS}
"""


SQL = sql()
