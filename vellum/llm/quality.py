"""Quality by weak supervision: rules vote or abstain, EM learns what the votes are worth.

Each rule votes "good", "bad" or abstains. A vote of either kind is right with
an accuracy of its own; expectation maximisation estimates these from the
counts of vote patterns (at most 3 to the number of rules, whatever the
corpus). A document's posterior probability of being good is then a logistic
sum of one weight per vote, a plain column expression. Only DataFrame
functions touch the corpus.

Defined cases: null and empty texts have no words and fail the base rule; a
very long text is measured in its row, in memory that follows its length; a
posterior of exactly ``least`` keeps; repeated rows and ids are judged each for
itself; other columns, whatever their names, are ignored and kept as they are;
an empty table leaves the accuracies as they start and returns no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, written

WINDOW = 5
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MARKS = "!?"


@dataclass(frozen=True)
class Rule:
    """Votes bad where ``bad`` holds, else good where ``good`` holds; both are SQL over the measures."""

    name: str
    bad: str
    good: str


#: Written so that Spark and DuckDB read them alike.
RULES = (
    Rule("length", "n_words < 10", "FALSE"),
    Rule("word_length", "word_chars > 14 * n_words OR word_chars < 2 * n_words", "FALSE"),
    Rule("symbols", "10 * n_symbols > n_words", "FALSE"),
    Rule("lines", "2 * n_dup_lines > n_lines", "FALSE"),
    Rule("repeats", "100 * n_repeat_words > 15 * n_words", "FALSE"),
    Rule("stutter", "5 * n_stutter > n_words", "FALSE"),
    Rule("capitals", "3 * n_capitals > word_chars", "FALSE"),
    Rule("marks", "5 * n_marks > n_words", "FALSE"),
    Rule("prose", "FALSE", "n_words >= 50 AND n_symbols = 0 AND n_repeat_words = 0 AND word_chars BETWEEN 3 * n_words AND 9 * n_words"),
)

#: Accuracy of a bad and of a good vote before any evidence, the votes that this belief is worth, its bounds, and the EM rounds.
START = {-1: 0.9, 1: 0.7}
WORTH, LEAST, MOST, ROUNDS = 10.0, 0.55, 0.99, 12


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def measures(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stutter, n_lines, n_capitals, n_marks."""
    text = F.coalesce(docs["text"], F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: _without(x, SPACES) > 0)
    long = lambda c: c.cast("long")
    out = docs.withColumns({
        "_words": F.transform(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), lambda x: F.xxhash64(x)),
        "_lines": lines,
        "word_chars": long(_without(text, SPACES)),
        "n_symbols": long(F.length(text) - _without(text, SYMBOLS)),
        "n_capitals": long(F.length(text) - _without(text, CAPITALS)),
        "n_marks": long(F.length(text) - _without(text, MARKS)),
    })
    n = F.size("_words")
    word = F.col("_words")
    window = lambda i: F.xxhash64(*(F.get(word, i + j) for j in range(WINDOW)))
    out = out.withColumns({
        "n_words": long(n),
        "n_stutter": long(F.size(F.filter(word, lambda x, i: x == F.get(word, i - 1)))),
        "n_lines": long(F.size("_lines")),
        "n_dup_lines": long(F.size("_lines") - F.size(F.array_distinct("_lines"))),
        "_windows": F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), window)),
    }).drop("_words", "_lines")
    repeated = F.size(F.array_distinct("_windows")) < F.size("_windows")
    out = out.withColumn("_sorted", F.when(repeated, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_windows")
    s = F.col("_sorted")
    again = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))
    out = out.withColumn("_at", F.sort_array(F.transform(again, lambda x: x["i"]))).drop("_sorted")
    at = F.col("_at")
    covered = F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW))))
    return out.withColumn("n_repeat_words", long(F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)))).drop("_at")


def votes(measured: DataFrame, rules=RULES) -> DataFrame:
    return measured.withColumns({f"v_{r.name}": F.expr(f"CASE WHEN {r.bad} THEN -1 WHEN {r.good} THEN 1 ELSE 0 END") for r in rules})


def fit(patterns: dict[tuple[int, ...], int], rounds: int = ROUNDS) -> list[dict[int, float]]:
    """Each rule's log odds of its bad and its good vote being right, from counts of vote patterns.

    Good and bad are equally likely beforehand, so a vote that no other rule
    confirms or contradicts keeps the accuracy that it started with.
    """
    n_rules = len(next(iter(patterns), RULES))
    right = [dict(START) for _ in range(n_rules)]
    for _ in range(rounds):
        seen = [{v: [WORTH * START[v], WORTH] for v in START} for _ in range(n_rules)]
        for p in sorted(patterns):
            odds = sum(v * math.log(right[j][v] / (1 - right[j][v])) for j, v in enumerate(p) if v)
            good = 1 / (1 + math.exp(-odds))
            for j, v in enumerate(p):
                if v:
                    seen[j][v][0] += patterns[p] * (good if v == 1 else 1 - good)
                    seen[j][v][1] += patterns[p]
        right = [{v: min(MOST, max(LEAST, x[v][0] / x[v][1])) for v in x} for x in seen]
    return [{v: math.log(a / (1 - a)) for v, a in x.items()} for x in right]


def fitted(voted: DataFrame, rules=RULES) -> Column:
    """The posterior probability of good, as an expression over ``voted``'s columns."""
    names = [f"v_{r.name}" for r in rules]
    counted = voted.groupBy(*names).agg(F.count("*").alias("n")).collect()
    odds = F.lit(0.0)
    for c, w in zip(names, fit({tuple(r[c] for c in names): r["n"] for r in counted})):
        odds = odds + F.when(F.col(c) == -1, -w[-1]).when(F.col(c) == 1, w[1]).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"


def judged(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, the measures, base_failed, kept and the posterior, one row for each document."""
    voted = written(votes(measures(docs.select("doc_id", "text"))).drop("text"), "votes")
    out = voted.withColumn("posterior", fitted(voted)).withColumn("base_failed", F.expr(BASE_FAILED))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= least))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that pass the base rule and whose posterior is ``least`` or more."""
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text")
    posterior = fitted(written(votes(measures(docs.select("text"))).select(*(f"v_{r.name}" for r in RULES)), "votes"))
    # Measured once more rather than stored with the texts, which would be a copy of the corpus. The generator keeps
    # the optimizer from copying the measures into the filter, once for each use.
    voted = votes(measures(whole)).select("row", F.struct("n_words", "n_repeat_words", *(f"v_{r.name}" for r in RULES)).alias("m"))
    voted = voted.select("row", F.inline(F.array("m")))
    return voted.filter(~F.expr(BASE_FAILED) & (posterior >= least)).select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def oracle(rules=RULES, rounds: int = ROUNDS) -> str:
    """The query's result in DuckDB's SQL: the EM rounds are common table expressions of one row each."""
    word = WORD.replace("\\x20", " ").replace("\\x09-\\x0D", "\\t-\\r")
    names = [f"v_{r.name}" for r in rules]

    def chars(column: str, kept: str) -> str:
        return f"length({column}) - length(translate({column}, '{kept}', ''))"

    ctes = [f"""docs AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT k, doc_id, text, regexp_extract_all(text, '{word}') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{word}')) AS l FROM docs),
spread AS (SELECT k, unnest(w) AS w, unnest(range(len(w))) AS i FROM words),
windows AS (SELECT k, i, {" || ' ' || ".join(f"lead(w, {j}) OVER o" if j else "w" for j in range(WINDOW))} AS g FROM spread WINDOW o AS (PARTITION BY k ORDER BY i)),
stuttered AS (SELECT k, count(*) AS n_stutter FROM (SELECT k, w = lag(w) OVER (PARTITION BY k ORDER BY i) AS same FROM spread) WHERE same GROUP BY k),
twice AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM windows WHERE g IS NOT NULL) WHERE c > 1),
covered AS (SELECT k, count(DISTINCT i + j) AS n FROM twice, range({WINDOW}) t(j) GROUP BY k),
measured AS MATERIALIZED (SELECT k, doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, {chars("text", SYMBOLS)} AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines, {chars("text", CAPITALS)} AS n_capitals, {chars("text", MARKS)} AS n_marks, coalesce(n_stutter, 0)::BIGINT AS n_stutter FROM words LEFT JOIN covered USING (k) LEFT JOIN stuttered USING (k)),
voted AS MATERIALIZED (SELECT *, {", ".join(f"CASE WHEN {r.bad} THEN -1 WHEN {r.good} THEN 1 ELSE 0 END AS v_{r.name}" for r in rules)} FROM measured),
patterns AS MATERIALIZED (SELECT {", ".join(names)}, count(*)::DOUBLE AS n FROM voted GROUP BY ALL),
right0 AS (SELECT {", ".join(f"{START[-1]}::DOUBLE AS {c}_m, {START[1]}::DOUBLE AS {c}_p" for c in names)})"""]
    for t in range(rounds + 1):
        odds = " + ".join(f"CASE {c} WHEN -1 THEN -ln({c}_m / (1 - {c}_m)) WHEN 1 THEN ln({c}_p / (1 - {c}_p)) ELSE 0 END" for c in names)
        ctes.append(f"good{t} AS MATERIALIZED (SELECT {', '.join(names)}, n, 1 / (1 + exp(-({odds}))) AS p FROM patterns, right{t})")
        seen = [f"least({MOST}, greatest({LEAST}, ({WORTH * START[v]} + coalesce(sum(n * {p}) FILTER ({c} = {v}), 0)) / ({WORTH} + coalesce(sum(n) FILTER ({c} = {v}), 0)))) AS {c}_{tag}" for c in names for v, tag, p in ((-1, "m", "(1 - p)"), (1, "p", "p"))]
        ctes.append(f"right{t + 1} AS MATERIALIZED (SELECT {', '.join(seen)} FROM good{t})")
    return "WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({BASE_FAILED}) AS base_failed, NOT ({BASE_FAILED}) AND p >= 0.5 AS kept FROM voted JOIN good{rounds} USING ({', '.join(names)})"
