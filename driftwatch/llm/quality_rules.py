"""Quality rules as a bitmask ledger (native Spark SQL functions only).

``ledger`` evaluates every rule once per document and stores the measurements and
one bit per failed rule.  ``apply_policy`` reads a verdict from those bits under a
versioned policy (a mask of enforced rules); changing the policy never touches the
texts again.  ``ablations`` tells, from the distinct masks alone, how many documents
each rule rejects, and how many it rejects that no other rule of the policy does.

Defined results: null or empty text has no words, fails ``too_few_words`` and is
rejected by every policy; repeated rows get equal rows; ties do not arise; an empty
table gives an empty ledger; extra columns are ignored.  A text of any length is
handled whole: all passes over its words are linear, but for one sort.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules by bit.  Conditions are over the measurements, in integers.
RULES: dict[str, str] = {
    "too_few_words": "n_words < 50",
    "repeated_trigrams": "100 * n_repeat_words > 50 * n_words",
    "word_length": "word_chars < 2 * n_words or word_chars > 20 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "duplicate_lines": "2 * n_dup_lines > n_lines",
    "shouting": "2 * n_upper > word_chars",
}

#: Versioned policies: the rules each enforces.
POLICIES: dict[str, list[str]] = {
    "base": ["too_few_words", "repeated_trigrams"],
    "v1": list(RULES),
}

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]

_SPACE = "[ \\\\x09-\\\\x0D]+"

# Lambda variables bind each intermediate array once; a plain column used inside a
# lambda could be inlined by the optimizer and evaluated again for every element.
_WORDS = f"array_remove(split(coalesce(text, ''), '{_SPACE}'), '')"
_TRIGRAMS = ("case when size(w) < 3 then cast(array() as array<struct<h:bigint,i:int>>) else "
             "transform(sequence(0, size(w) - 3), i -> named_struct('h', xxhash64(w[i], w[i+1], w[i+2]), 'i', i)) end")
_REPEATED = ("filter(s, (x, j) -> (j > 0 and s[j-1].h = x.h) or (j < size(s) - 1 and s[j+1].h = x.h))")
_COVERED = ("aggregate(p, named_struct('n', 0L, 'e', 0), (a, i) -> named_struct("
            "'n', a.n + cast(i + 3 - greatest(i, a.e) as bigint), 'e', i + 3), a -> a.n)")


def _let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def measurements() -> Column:
    """One struct of all measurements of ``text``."""
    repeats = _let(_TRIGRAMS, "g", "if(size(array_distinct(transform(g, x -> x.h))) = size(g), 0L, "
                   + _let("sort_array(g)", "s",
                          _let(f"sort_array(transform({_REPEATED}, x -> x.i))", "p", _COVERED)) + ")")
    of_words = (f"named_struct('n_words', cast(size(w) as bigint), 'word_chars', cast(length(array_join(w, '')) as bigint), "
                f"'n_repeat_words', {repeats})")
    lines = f"filter(split(coalesce(text, ''), '\\n'), l -> l rlike '[^ \\\\x09-\\\\x0D]')"
    of_lines = ("named_struct('n_lines', cast(size(l) as bigint), "
                "'n_dup_lines', cast(size(l) - size(array_distinct(l)) as bigint))")
    return F.struct(
        F.expr(_let(_WORDS, "w", of_words)).alias("w"),
        F.expr(_let(lines, "l", of_lines)).alias("l"),
        F.expr("cast(size(split(coalesce(text, ''), '[#*$%&|<>]')) - 1 as bigint)").alias("n_symbols"),
        F.expr("cast(size(split(coalesce(text, ''), '[A-Z]')) - 1 as bigint)").alias("n_upper"),
    )


def _measured(docs: DataFrame, cols: list[str]) -> DataFrame:
    """``cols`` of ``docs`` and a struct ``__q`` of the measurements."""
    names = {"n_words": "__m.w.n_words", "word_chars": "__m.w.word_chars", "n_symbols": "__m.n_symbols",
             "n_dup_lines": "__m.l.n_dup_lines", "n_repeat_words": "__m.w.n_repeat_words",
             "n_lines": "__m.l.n_lines", "n_upper": "__m.n_upper"}
    cols = [F.col(f"`{c}`") for c in cols]
    return (docs.select(*cols, measurements().alias("__m"))
            .select(*cols, F.struct(*[F.col(p).alias(n) for n, p in names.items()]).alias("__q")))


def _bits() -> Column:
    conds = [re.sub(r"\b(n_\w+|word_chars)\b", r"__q.\1", c) for c in RULES.values()]
    return F.expr(" | ".join(f"if({c}, {1 << k}L, 0L)" for k, c in enumerate(conds)))


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and ``failed_bits`` (bit k: rule k of RULES failed)."""
    return _measured(docs, ["doc_id"]).select("doc_id", "__q.*", _bits().alias("failed_bits"))


def mask(policy: str) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in POLICIES[policy])


def apply_policy(led: DataFrame, policy: str = "v1") -> DataFrame:
    """Adds ``base_failed`` and ``kept``: no enforced rule failed."""
    failed = lambda p: F.col("failed_bits").bitwiseAND(F.lit(mask(p)).cast("bigint")) != 0
    return led.withColumn("base_failed", failed("base")).withColumn("kept", ~failed("base") & ~failed(policy))


def ablations(led: DataFrame, policy: str = "v1") -> DataFrame:
    """Per enforced rule: documents it rejects, and those it alone rejects.

    Documents are first counted by mask (at most 2 ** rules rows); rules are then
    read off the masks with bit operations.
    """
    m = mask(policy)
    masks = (led.select(F.col("failed_bits").bitwiseAND(F.lit(m).cast("bigint")).alias("bits"))
             .groupBy("bits").agg(F.count("*").alias("docs")))
    names = [(k, r) for k, r in enumerate(RULES) if r in POLICIES[policy]]
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << k).cast("bigint").alias("bit")) for k, r in names])
    each = masks.select("bits", "docs", F.explode(rules).alias("r")).select("bits", "docs", "r.rule", "r.bit")
    return each.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("docs")).otherwise(0)).alias("rejects"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("docs")).otherwise(0)).alias("rejects_alone"))


def keep_documents(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The rows of ``docs`` (all its columns) that the policy keeps."""
    cols = docs.columns
    enforced = F.lit(mask(policy) | mask("base")).cast("bigint")
    return (_measured(docs, cols).where(_bits().bitwiseAND(enforced) == 0)
            .select(*[F.col(f"`{c}`") for c in cols]))


def query(docs: DataFrame) -> DataFrame:
    return apply_policy(ledger(docs)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                                             "n_repeat_words", "base_failed", "kept", "failed_bits")


def oracle_sql() -> str:
    """DuckDB statement for ``query`` over ``documents``."""
    bits = " | ".join(f"(case when {cond} then {1 << k} else 0 end)" for k, cond in enumerate(RULES.values()))
    m, b = mask("v1"), mask("base")
    return f"""
with d as (
  select row_number() over () as r, doc_id, coalesce(text, '') as t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l
  from documents),
g as (select r, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] as g
      from (select r, w, unnest(range(1, greatest(len(w) - 1, 1))) as i from d)),
p as (select distinct r, unnest([i, i+1, i+2]) as i
      from (select r, i, count(*) over (partition by r, g) as n from g) where n > 1),
c as (select r, count(*) as n from p group by r),
m as (select d.r, doc_id, len(w)::bigint as n_words, len(array_to_string(w, ''))::bigint as word_chars,
             len(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
             (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words,
             len(l)::bigint as n_lines, len(regexp_replace(t, '[^A-Z]', '', 'g'))::bigint as n_upper
      from d left join c on d.r = c.r),
f as (select *, ({bits})::bigint as failed_bits from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed_bits & {b}) <> 0 as base_failed, (failed_bits & {m | b}) = 0 as kept, failed_bits
from f"""
