"""Line de-duplication: repeated runs of lines, found by distributed prefix doubling
(native Spark SQL functions only).

A document is the sequence of its lines that hold a word.  Suffixes of all these
sequences are ranked by prefix doubling: rank 0 names a line by the earliest place of
an equal line, and rank k+1 names a block of 2 ** (k+1) lines by the earliest place
where the same pair of rank-k names stands.  Suffixes whose block occurs once are
dropped after each pass, as they can share no longer prefix with another suffix.

A window is the shortest run of lines from a line on (or up to a line) with at least
``min_words`` words.  Two windows are equal if they have the same length and the same
names of their first and last block; groups of equal windows are the intervals of the
suffix array whose longest common prefix reaches the window.  The union of all windows
that also start earlier is exactly the union of the maximal runs of ``min_words`` words
or more that also start earlier, and those lines are deleted.  "Earlier" is a smaller
doc_id, or the same document and an earlier start; runs are judged on the input.

A line has a word, so a window has at most ``min_words`` lines, and the number of
doubling passes is log2(min_words), whatever the input.  Groups are counted by partial
aggregation before any shuffle; joins back are equi-joins that AQE can split.

Defined results: null text counts as empty and stays null; blank lines are kept and do not
break a run; equal rows (doc_id and text) are one document and both get its result; a
text of any length is handled whole; an empty table gives no rows; extra columns are
ignored by ``query`` and kept by ``remove_repeated_lines``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_key, land

MIN_WORDS = 50


def _doc_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def line_rows(docs: DataFrame) -> DataFrame:
    """d, u (document), i (index among lines with a word), pos (index in the text), line (digest), words."""
    lines = docs.select(id_key().alias("d"), _doc_hash().alias("u"),
                        F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "text"))
    lines = (lines.where(F.col("text").rlike(r"[^ \x09-\x0D]"))
             .select("d", "u", "pos", F.md5("text").alias("line"),
                     F.size(F.array_remove(F.split("text", r"[ \x09-\x0D]+"), "")).alias("words")))
    once = lines.groupBy("d", "u", "pos").agg(F.first("line").alias("line"), F.first("words").alias("words"))
    return once.withColumn("i", F.row_number().over(Window.partitionBy("d", "u").orderBy("pos")) - 1)


def _shortest_runs(rows: DataFrame, min_words: int) -> DataFrame:
    """Adds fl and bl: lines in the shortest run with min_words from (up to) a line, or null."""
    w = Window.partitionBy("d", "u").orderBy("i")
    # A run has min_words lines at most, so each window frame is bounded.
    ahead = F.collect_list("words").over(w.rowsBetween(0, min_words - 1))
    behind = F.reverse(F.collect_list("words").over(w.rowsBetween(-(min_words - 1), 0)))
    size = f"""aggregate(x, named_struct('s', 0, 'n', 0), (a, v) ->
               if(a.s >= {min_words}, a, named_struct('s', a.s + v, 'n', a.n + 1)),
               a -> if(a.s >= {min_words}, a.n, null))"""
    return (rows.withColumn("x", ahead).withColumn("fl", F.expr(size))
            .withColumn("x", behind).withColumn("bl", F.expr(size)).drop("x", "words"))


def _place() -> Column:
    return F.struct("d", "u", "i")


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """d, u, pos of every line inside a run of min_words words or more that also starts earlier."""
    rows = land(_shortest_runs(line_rows(docs), min_words), "lines")
    first = rows.groupBy("line").agg(F.min(_place()).alias("name"), F.count("*").alias("n")).where("n > 1").drop("n")
    active = land(rows.join(first, "line").select("d", "u", "i", "name"), "rank-0")
    wins = land(rows.select("d", "u", "i", F.explode(F.array_distinct(F.array(
        F.struct(F.col("i").alias("s"), F.col("fl").alias("len")),
        F.struct((F.col("i") - F.col("bl") + 1).alias("s"), F.col("bl").alias("len"))))).alias("x"))
        .where("x.len is not null").select("d", "u", "x.s", "x.len").distinct()
        .withColumn("k", F.floor(F.log2("len")).cast("int")), "windows")
    levels, k = [], 0
    while (1 << k) <= min_words:
        of_k = wins.where(F.col("k") == k)
        heads = active.select("d", "u", F.col("i").alias("s"), F.col("name").alias("a"))
        tails = active.select("d", "u", F.col("i").alias("t"), F.col("name").alias("b"))
        named = (of_k.join(heads, ["d", "u", "s"]).withColumn("t", F.col("s") + F.col("len") - (1 << k))
                 .join(tails, ["d", "u", "t"]))
        levels.append(named.select("d", "u", "s", "len", "a", "b"))
        k += 1
        if (1 << k) > min_words:
            break
        step = 1 << (k - 1)
        w = Window.partitionBy("d", "u").orderBy("i").rangeBetween(step, step)
        pairs = active.withColumn("next", F.first("name").over(w)).where("next is not null")
        groups = (pairs.groupBy("name", "next").agg(F.min(_place()).alias("rank"), F.count("*").alias("n"))
                  .where("n > 1").drop("n"))
        active = land(pairs.join(groups, ["name", "next"]).select("d", "u", "i", F.col("rank").alias("name")), f"rank-{k}")
    named = land(reduce(DataFrame.unionByName, levels), "named-windows")
    earliest = (named.groupBy("len", "a", "b").agg(F.min(F.struct("d", "u", F.col("s").alias("i"))).alias("at"),
                                                   F.count("*").alias("n")).where("n > 1").drop("n"))
    later = named.join(earliest, ["len", "a", "b"]).where(F.struct("d", "u", F.col("s").alias("i")) != F.col("at"))
    marked = (later.select("d", "u", F.explode(F.expr("sequence(s, s + len - 1)")).alias("i")).distinct())
    return rows.select("d", "u", "i", "pos").join(marked, ["d", "u", "i"]).select("d", "u", "pos")


def _with_removed(docs: DataFrame, cols: list[str], min_words: int) -> DataFrame:
    """``cols`` and ``__kept`` (text without the deleted lines), ``__n``, ``__removed``."""
    gone = (repeated_lines(docs, min_words).groupBy(F.col("d").alias("__d"), F.col("u").alias("__u"))
            .agg(F.sort_array(F.collect_list("pos")).alias("__gone")))
    keyed = docs.select(*[F.col(f"`{c}`") for c in cols], id_key().alias("__d"), _doc_hash().alias("__u"))
    joined = keyed.join(gone, ["__d", "__u"], "left")
    # Kept lines are the stretches between deleted ones: linear in the lines of the text.
    between = """transform(array(split(text, '\n')), l -> transform(array(concat(array(-1), __gone, array(size(l)))), g ->
        array_join(flatten(transform(sequence(0, size(g) - 2), j -> slice(l, g[j] + 2, g[j+1] - g[j] - 1))), '\n'))[0])[0]"""
    return joined.select(
        *[F.col(f"`{c}`") for c in cols],
        F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.expr(between)).alias("__kept"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("bigint").alias("__removed"))


def remove_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``docs`` with the later copies of repeated runs cut from ``text``."""
    out = _with_removed(docs, docs.columns, min_words)
    return out.select(*[F.col("__kept").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def query(docs: DataFrame) -> DataFrame:
    out = _with_removed(docs, ["doc_id", "text"], MIN_WORDS)
    return out.select(
        "doc_id", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("bigint").alias("n_lines"),
        F.col("__removed").alias("n_removed"), F.md5(F.coalesce("__kept", F.lit(""))).alias("kept_md5"))


def oracle_sql(min_words: int = MIN_WORDS) -> str:
    """DuckDB statement for ``query`` over ``documents`` (plain strings instead of ranks)."""
    return f"""
with t as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
l as (select r, doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from t),
x as (select r, doc_id, pos, line, row_number() over (partition by r order by pos) as i,
             len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) as n
      from l where regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
c as (select *, sum(n) over (partition by r order by i)::bigint as e, sum(n) over (partition by r order by i)::bigint - n as b from x),
fw as (select a.r, a.i as s, min(z.i) as t from c a join c z on a.r = z.r and z.i >= a.i and z.e - a.b >= {min_words} group by all),
bw as (select z.r, max(a.i) as s, z.i as t from c a join c z on a.r = z.r and z.i >= a.i and z.e - a.b >= {min_words} group by all),
w as (select * from fw union select * from bw),
v as (select w.r, w.s, w.t, any_value(c.doc_id) as doc_id, string_agg(c.line, chr(10) order by c.i) as run
      from w join c on c.r = w.r and c.i between w.s and w.t group by all),
o as (select *, row_number() over (partition by run order by doc_id, s) as k from v),
g as (select distinct c.r, c.pos from o join c on c.r = o.r and c.i between o.s and o.t where o.k > 1)
select l.doc_id, count(*) as n_lines, count(g.pos) as n_removed,
       md5(coalesce(string_agg(case when g.pos is null then l.line end, chr(10) order by l.pos), '')) as kept_md5
from l left join g on g.r = l.r and g.pos = l.pos group by l.r, l.doc_id"""
