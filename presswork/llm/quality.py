"""Quality rules as weak supervision.

Rules (labelling functions) look at counts of a text and vote "bad" or "good", each for its own class only, or
abstain. Expectation-maximisation finds, without labels, the accuracy of every rule and the share of good texts:
the E-step gives each pattern of votes its posterior probability of a good text, the M-step sets a rule's accuracy
to the mean posterior of its class over the texts it voted on. A text is kept if it passes the base limits and its
posterior is at least one half, so that one wrong vote does not reject a text, as all-must-pass filters do.

The statistics are the counts of vote patterns over all texts (at most 2^rules rows, whatever the input), found
with one aggregate; the texts themselves meet only column expressions and are read once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.functions._util import let
from presswork.llm.common import GAP, WORD, split_words, written

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Frequent words of English, French, German and Spanish, as they stand inside and at the start of a sentence.
STOP_WORDS = ["the", "of", "and", "to", "is", "in", "a", "for", "that", "de", "la", "le", "les", "des", "et", "est", "que",
              "und", "der", "die", "das", "ist", "el", "en", "los"]
STOP_FORMS = STOP_WORDS + [w.capitalize() for w in STOP_WORDS]

#: Votes: name -> (class voted for, condition on the counts). The conditions are plain arithmetic that Spark SQL and
#: other SQL engines read alike.
RULES: dict[str, tuple[str, str]] = {
    "symbols_by_word": ("bad", "10 * n_symbols > n_words"),
    "symbols_by_char": ("bad", "20 * n_symbols > word_chars"),
    "repeated_windows": ("bad", "5 * n_repeat_words > n_words"),
    "repeated_lines": ("bad", "10 * n_dup_lines > 3 * n_lines"),
    "word_after_itself": ("bad", "5 * n_adjacent > n_words"),
    # two in five words, and from 1,000 words on as many as grow with the root of the text's length
    "few_distinct": ("bad", "10 * n_distinct < 4 * n_words AND n_distinct * n_distinct < 160 * n_words AND n_words >= 20"),
    "capitals": ("bad", "10 * n_upper > 3 * word_chars"),
    "word_length": ("bad", "word_chars < 3 * n_words OR word_chars > 10 * n_words"),
    "no_stop_words": ("bad", "50 * n_stop < n_words AND n_words >= 50"),
    "no_sentences": ("bad", "100 * n_stops < n_words AND n_words >= 50"),
    "prose": ("good", "100 * n_stop >= 5 * n_words AND 100 * n_stops >= 3 * n_words AND 100 * n_stops <= 25 * n_words"),
}
BASE_FAILED = f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"
ROUNDS = 25
#: Start values; pseudo-counts hold a rule that votes on few texts near its start; limits keep rules better than
#: chance and the classes apart.
START_GOOD, START_BAD_RULE, START_GOOD_RULE, PSEUDO = 0.8, 0.9, 0.7, 10.0
GOOD_LIMITS, RULE_LIMITS = (0.5, 0.9), (0.6, 0.95)
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_adjacent", "n_distinct",
          "n_upper", "n_stop", "n_stops"]


def _covered(h: Column) -> Column:
    """Words in windows whose hash occurs twice or more; ``h`` has a hash per window start."""

    def inner(s):
        twin = lambda x, i: (F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))
                             | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
        starts = F.sort_array(F.transform(F.filter(s, twin), lambda x: x["i"]))
        return F.aggregate(starts, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
                           lambda a, p: F.struct((p + WINDOW).alias("end"), (a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n")),
                           lambda a: a["n"])

    ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(inner, s=ranked))


def counts(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with the counts the rules look at (all long). Null and empty texts count 0 everywhere.

    Windows of eight words are compared by 64-bit hashes within one text.
    """
    d = df.withColumn("_t", F.coalesce(text, F.lit("")))
    d = d.withColumn("_w", split_words(F.col("_t")))
    d = d.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: x.rlike(WORD)))
    d = d.withColumn("n_words", F.size("_w"))
    hashes = let(lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW))),
                 w=F.col("_w"))
    d = d.withColumn("_h", F.when(F.col("n_words") > WINDOW, hashes).otherwise(F.array().cast("array<bigint>")))
    w = F.col("_w")
    new = {
        "n_words": F.col("n_words"),
        "word_chars": F.length("_t") - F.regexp_count("_t", F.lit(GAP[:-1])),
        "n_symbols": F.regexp_count("_t", F.lit(SYMBOLS)),
        "n_dup_lines": F.size("_l") - F.size(F.array_distinct("_l")),
        "n_repeat_words": let(lambda h: _covered(h), h=F.col("_h")),
        "n_lines": F.size("_l"),
        "n_adjacent": let(lambda x: F.size(F.filter(x, lambda a, i: F.coalesce(a == F.get(x, i + 1), F.lit(False)))), x=w),
        "n_distinct": F.size(F.array_distinct(w)),
        "n_upper": F.regexp_count("_t", F.lit("[A-Z]")),
        "n_stop": F.size(F.filter(w, lambda x: x.isin(*STOP_FORMS))),
        "n_stops": F.regexp_count("_t", F.lit("[.!?]")),
    }
    return d.select(*df.columns, *[new[c].cast("long").alias(c) for c in COUNTS])


def fit(counted: DataFrame) -> dict:
    """Accuracies and class share by expectation-maximisation over the vote patterns of all rows."""
    bits = [F.when(F.expr(cond), 1 << j).otherwise(0) for j, (_, cond) in enumerate(RULES.values())]
    pattern = bits[0]
    for b in bits[1:]:
        pattern = pattern + b
    rows = [(r["p"], r["n"]) for r in counted.groupBy(pattern.alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect()]
    good = [side == "good" for side, _ in RULES.values()]
    start = [START_GOOD_RULE if g else START_BAD_RULE for g in good]
    acc, share = list(start), START_GOOD
    total = sum(n for _, n in rows)
    for _ in range(ROUNDS if total else 0):
        post = [(p, n, 1 / (1 + math.exp(-_logit(p, acc, share, good)))) for p, n in rows]
        share = _between(sum(n * q for _, n, q in post) / total, GOOD_LIMITS)
        for j, g in enumerate(good):
            on = [(n, q if g else 1 - q) for p, n, q in post if p >> j & 1]
            acc[j] = _between((sum(n * q for n, q in on) + PSEUDO * start[j]) / (sum(n for n, _ in on) + PSEUDO), RULE_LIMITS)
    return {"share": share, "accuracy": dict(zip(RULES, acc))}


def _between(x: float, limits: tuple[float, float]) -> float:
    return min(limits[1], max(limits[0], x))


def _logit(pattern: int, acc: list[float], share: float, good: list[bool]) -> float:
    out = math.log(share / (1 - share))
    for j, g in enumerate(good):
        if pattern >> j & 1:
            out += (1 if g else -1) * math.log(acc[j] / (1 - acc[j]))
    return out


def judge(counted: DataFrame, model: dict) -> DataFrame:
    """``counted`` with base_failed, p_good (posterior) and kept."""
    logit = F.lit(math.log(model["share"] / (1 - model["share"])))
    for name, (side, cond) in RULES.items():
        a = model["accuracy"][name]
        logit = logit + F.when(F.expr(cond), (1 if side == "good" else -1) * math.log(a / (1 - a))).otherwise(0.0)
    p = 1 / (1 + F.exp(-logit))
    return (counted.withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("p_good", p)
            .withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5)))


def digest(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts and verdict of every row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept and p_good.

    The counts are written once and read again for the verdicts, so the text is read once. Null texts have no words
    and fail the base limits; repeated rows are judged alike; an empty table gives an empty result; extra columns
    are not returned.
    """
    counted = written(counts(df.select(F.col(key).alias("doc_id"), F.col(text).alias("_text")), F.col("_text")).drop("_text"), "quality")
    out = judge(counted, fit(counted))
    return out.select("doc_id", *COUNTS[:5], "base_failed", "kept", F.round("p_good", 6).alias("p_good"))


def keep_good(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``df`` that pass, with its columns. The counts are made once for the model and again for the
    verdicts, so that no copy of the texts is written.

    Null, empty and blank texts have no words and go; very long texts are judged whole; repeated rows are counted and
    judged one by one and go or stay together, as rows with equal texts do; an empty table gives an empty result; other
    columns, whatever their names, come back as they are, and only the text is read for the verdict."""
    packed = df.select(F.struct(*df.columns).alias("_row"))
    model = fit(counts(packed, F.col("_row")[text]))
    return judge(counts(packed, F.col("_row")[text]), model).filter("kept").select("_row.*")


def digest_sql() -> str:
    """DuckDB SQL for :func:`digest` on ``documents``."""
    words = ", ".join(f"'{w}'" for w in STOP_FORMS)
    votes = ", ".join(f"({cond}) AS v{j}" for j, (_, cond) in enumerate(RULES.values()))
    names = [f"v{j}" for j in range(len(RULES))]
    good = [side == "good" for side, _ in RULES.values()]
    start = [START_GOOD_RULE if g else START_BAD_RULE for g in good]

    def logit(state: str) -> str:
        terms = [f"ln({state}.share / (1 - {state}.share))"]
        terms += [f"CASE WHEN {v} THEN {'' if g else '-'}ln({state}.a{j} / (1 - {state}.a{j})) ELSE 0 END"
                  for j, (v, g) in enumerate(zip(names, good))]
        return " + ".join(terms)

    def mean(v: str, g: bool, j: int) -> str:
        q = "q" if g else "(1 - q)"
        return (f"least({RULE_LIMITS[1]}, greatest({RULE_LIMITS[0]}, (coalesce(sum(CASE WHEN {v} THEN n * {q} END), 0) + {PSEUDO * start[j]!r})"
                f" / (coalesce(sum(CASE WHEN {v} THEN n END), 0) + {PSEUDO})))::DOUBLE AS a{j}")

    rounds = []
    for k in range(ROUNDS):
        rounds.append(f"""
s{k + 1} AS MATERIALIZED (
  SELECT least({GOOD_LIMITS[1]}, greatest({GOOD_LIMITS[0]}, sum(n * q) / sum(n)))::DOUBLE AS share,
    {', '.join(mean(v, g, j) for j, (v, g) in enumerate(zip(names, good)))}
  FROM (SELECT patterns.*, 1 / (1 + exp(-({logit(f's{k}')}))) AS q FROM patterns, s{k}))""")
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '{WORD}')) AS lines
  FROM documents),
win AS (
  SELECT r, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS x
  FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})),
rep AS (
  SELECT r, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT r, unnest(range(i, i + {WINDOW})) AS p
        FROM (SELECT *, count(*) OVER (PARTITION BY r, x) AS c FROM win) WHERE c > 1) GROUP BY r),
counted AS MATERIALIZED (
  SELECT doc_id, len(w)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '{SYMBOLS}'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    len(lines)::BIGINT AS n_lines,
    len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1]))::BIGINT AS n_adjacent,
    len(list_distinct(w))::BIGINT AS n_distinct,
    len(regexp_extract_all(t, '[A-Z]'))::BIGINT AS n_upper,
    len(list_filter(w, lambda x: x IN ({words})))::BIGINT AS n_stop,
    len(regexp_extract_all(t, '[.!?]'))::BIGINT AS n_stops
  FROM d LEFT JOIN rep USING (r)),
voted AS MATERIALIZED (SELECT *, {votes} FROM counted),
patterns AS MATERIALIZED (SELECT {', '.join(names)}, count(*) AS n FROM voted GROUP BY ALL),
s0 AS MATERIALIZED (SELECT {START_GOOD}::DOUBLE AS share, {', '.join(f'{a}::DOUBLE AS a{j}' for j, a in enumerate(start))}),
{','.join(rounds)},
judged AS (SELECT voted.*, ({BASE_FAILED}) AS base_failed, 1 / (1 + exp(-({logit(f's{ROUNDS}')}))) AS p_good FROM voted, s{ROUNDS})
SELECT doc_id, {', '.join(COUNTS[:5])}, base_failed, NOT base_failed AND p_good >= 0.5 AS kept, round(p_good, 6) AS p_good
FROM judged"""
