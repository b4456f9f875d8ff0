"""Rule bitmask ledger: every rule is evaluated once, policies are applied later.

``measure`` takes each text's measurements, ``ledger`` turns them into one failure bit per
rule, ``apply_policy`` keeps the rows none of whose failures a policy counts, and
``ablation`` tells from the ledger alone, by bitwise aggregation, what each rule of a policy
changes. Everything is built-in DataFrame code: there is one scan and no shuffle but the small
one of ``ablation``.

Defined results: a null text counts as empty; an empty text has zero measurements and fails
``few_words``; repeated rows are judged one by one; an empty table gives an empty ledger;
other columns pass through ``ledger``, except that columns of its own names are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words

MEASURES = ("n_words", "word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    name: str
    bit: int
    fails: str


#: Thresholds are whole-number comparisons, so each engine decides alike.
RULES = (
    Rule("few_words", 0, "n_words < 50"),
    Rule("repeated_words", 1, "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", 2, "100 * n_symbols > 25 * n_words"),
    Rule("shouting", 3, "100 * n_upper > 50 * word_chars"),
    Rule("duplicate_lines", 4, "n_lines >= 8 AND 100 * n_dup_lines > 70 * n_lines"),
    Rule("short_words", 5, "2 * word_chars < 3 * n_words"),
    Rule("long_words", 6, "word_chars > 30 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        bits = {r.name: r.bit for r in RULES}
        return sum(1 << bits[name] for name in self.rules)


BASE_POLICY = Policy("base", 1, ("few_words", "repeated_words"))
WEB_POLICY = Policy("web", 1, tuple(r.name for r in RULES))


def _pick(values: Column, index: Column) -> Column:
    return F.get(values, index)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the measurements of ``MEASURES`` (long).

    Repeated words: windows of three words are hashed to 64 bits and sorted with their
    positions, equal neighbours mark the repeated windows, and a fold over the marked positions
    counts each covered word once. That is n log n in the text's length, so very long texts stay
    cheap.
    """
    own = docs.drop(*[c for c in docs.columns if c.startswith("__q_")])
    keep = [F.col(f"`{c}`") for c in own.columns if c not in MEASURES]
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    step = own.select(*keep, body.alias("__q_text"), words(body).alias("__q_words"))
    windows = F.transform(
        F.when(F.size("__q_words") > 2, F.slice("__q_words", 1, F.greatest(F.size("__q_words") - 2, F.lit(1)))).otherwise(F.array().cast("array<string>")),
        lambda w, i: F.struct(F.xxhash64(w, _pick(F.col("__q_words"), i + 1), _pick(F.col("__q_words"), i + 2)).alias("h"), i.alias("p")),
    )
    lines = F.filter(F.split("__q_text", "\n"), lambda x: F.regexp_replace(x, r"^[\x20\x09-\x0D]+", "") != "")
    step = step.select(
        *keep,
        F.size("__q_words").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "__q_words")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("__q_text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("__q_text", r"[^A-Z]+", "")).cast("long").alias("n_upper"),
        lines.alias("__q_lines"),
        F.array_sort(windows).alias("__q_sorted"),
    )
    at = F.transform(
        "__q_sorted",
        lambda x, i: F.when(
            (i > 0) & (_pick(F.col("__q_sorted"), i - 1)["h"] == x["h"]) | F.coalesce(_pick(F.col("__q_sorted"), i + 1)["h"] == x["h"], F.lit(False)), x["p"]
        ),
    )
    covered = F.aggregate(
        F.array_sort(F.filter(at, lambda p: p.isNotNull())),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.alias("last")),
        lambda acc: acc["n"],
    )
    found = {
        **{c: F.col(c) for c in ("n_words", "word_chars", "n_symbols", "n_upper")},
        "n_lines": F.size("__q_lines").cast("long"),
        "n_dup_lines": (F.size("__q_lines") - F.size(F.array_distinct("__q_lines"))).cast("long"),
        "n_repeat_words": covered,
    }
    # Behind a generator of one row: the optimizer moves no later filter below it, which would
    # put these expressions into the filter and evaluate the sort once for each of its elements.
    return step.select(*keep, F.inline(F.array(F.struct(*[c.alias(name) for name, c in found.items()]))))


def ledger(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with its measurements and ``fail_mask``, in which bit k is set if rule k failed."""
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long") for r in rules]
    mask = bits[0]
    for bit in bits[1:]:
        mask = mask.bitwiseOR(bit)
    return measure(docs, text).withColumn("fail_mask", mask)


def passes(policy: Policy) -> Column:
    return F.col("fail_mask").bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def apply_policy(rows: DataFrame, policy: Policy) -> DataFrame:
    """The ledger's rows that ``policy`` keeps."""
    return rows.where(passes(policy))


def ablation(rows: DataFrame, policies: tuple[Policy, ...] = (BASE_POLICY, WEB_POLICY)) -> DataFrame:
    """For each policy and each of its rules: rows kept, failed by the rule, failed by it alone.

    Rows are first counted by ``fail_mask``, of which there are at most 2^rules, so the rest
    works on that small table whatever the ledger's size.
    """
    terms = F.array(*[
        F.struct(F.lit(p.name).alias("policy"), F.lit(p.version).alias("version"), F.lit(p.mask).cast("long").alias("policy_mask"), F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("rule_mask"))
        for p in policies for r in RULES if r.name in p.rules
    ])
    masks = rows.groupBy("fail_mask").agg(F.count("*").alias("rows"))
    hit = F.col("fail_mask").bitwiseAND(F.col("policy_mask"))
    tally = lambda test: F.sum(F.when(test, F.col("rows")).otherwise(F.lit(0)))
    met = masks.select("fail_mask", "rows", F.inline(terms))
    return met.groupBy("policy", "version", "rule").agg(
        tally(hit == 0).alias("kept"),
        tally(F.col("fail_mask").bitwiseAND(F.col("rule_mask")) != 0).alias("failed"),
        tally(hit == F.col("rule_mask")).alias("failed_alone"),
    )
