"""Near-duplicate lines by an exact set-similarity join, in DataFrame functions only.

A line is the set of its words. Its words are put in one fixed order, and two
lines of Jaccard similarity t or more share a word among the first
n - ceil(t n) + 1 of each: its prefix. Lines meet on prefix words, subject to
length, positional and bit-signature bounds that never lose a pair, and the
pairs left are verified by their words. A line goes if an earlier line, by
(doc_id, line number), is that similar; equal lines are settled beforehand by
their hashes, so copies never meet. Only prefix words that let some other
line through are looked at further. One earlier match is enough to remove a
line, so lines first meet only the earliest line of each prefix word and
length; just those left over meet all others. Groups of alike lines are thus
never expanded into all pairs.

Any fixed order of words gives exact results; a good one puts rare words
first. Long words come first, as they are rare, and need no count; words that
fill a prefix too often all the same are put last in a second pass. Lines
given as hashes have no lengths: their order comes from a table of fixed size,
in which all hashes are counted by slots.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, keep, settings, small_batches, spent_shuffles_go

SIMILARITY = (4, 5)
#: Lines with fewer words are kept, and remove nothing.
LEAST_WORDS = 5
#: Slots of the rarity table, which is part of the plan.
SLOTS = 1 << 16
#: Prefixes that a word fills before it is put last, and the most such words.
HOT, HOT_WORDS = 50_000, 1000
#: Lines of hashes whose prefix words meet in one partition, on average.
MET_LINES = 5_000
#: Places of a prefix that have a signature of their own.
BLOCKS = 8
BLANKS = " \t\n\v\f\r"


def _hashed(lines: DataFrame) -> bool:
    """Whether the lines are arrays of distinct 64-bit hashes, one for each word, and no text."""
    return isinstance(lines.schema["line"].dataType, T.ArrayType)


def _split(lines: DataFrame) -> Column:
    """All words; splitting at one blank takes no regular expression."""
    blank = F.when(F.col("line").rlike(r"[\x09-\x0D]"), F.translate("line", BLANKS, " " * len(BLANKS))).otherwise(F.col("line"))
    return F.array_remove(F.split(blank, " "), "")


def _words(lines: DataFrame) -> Column:
    """Distinct words of a line that has any."""
    return F.col("line") if _hashed(lines) else F.array_distinct(_split(lines))


#: Longs of a line's signature.
SIGNATURE = 4


def split_lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0), line of docs(doc_id, text); null texts have no lines."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def at_least(words: int) -> Column:
    """Whether the line has that many words."""
    return F.col("line").rlike(rf"^(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){{{words}}}")


def rarity_table(lines: DataFrame) -> str:
    """Level of each slot of hashes, comma-separated: about twice the log2 of its hashes over all lines(line)."""
    slots = lines.select(F.explode("line").alias("w"))
    rows = slots.groupBy(F.pmod("w", F.lit(SLOTS)).alias("id")).agg(F.least(F.floor(2 * F.log2(F.count(F.lit(1)).cast("double"))), F.lit(63)).cast("int").alias("level"))
    every = lines.sparkSession.range(SLOTS).join(rows, "id", "left").select("id", F.coalesce("level", F.lit(0)).alias("level"))
    # One short text for SLOTS slots: that many rows would take the driver a hundred megabytes.
    return every.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "level"))), lambda x: x["level"].cast("string")), ",")).first()[0]


#: Bits of a key below its level.
LOW = (1 << 57) - 1


def _keys(lines: DataFrame, levels: str | None, last: list[int]) -> Column:
    """Distinct words in their order, each as a number: a level in the six bits below the sign, its hash's lower bits after it."""
    low = lambda w: w.bitwiseAND(F.lit(LOW))
    if _hashed(lines):
        table = F.split(F.lit(levels), ",").cast("array<tinyint>")
        return F.sort_array(F.transform("line", lambda w: F.shiftleft(F.coalesce(F.get(table, F.pmod(w, F.lit(SLOTS)).cast("int")), F.lit(0).cast("tinyint")).cast("long"), 57).bitwiseOR(low(w))))
    level = lambda w: 62 - F.least(F.octet_length(w), F.lit(62))
    if last:
        hot = F.array(*[F.lit(x).cast("long") for x in last])
        key = lambda w: F.shiftleft(F.when(F.array_contains(hot, F.xxhash64(w).bitwiseAND(F.lit(LOW & ~SIZES))), 63).otherwise(level(w)).cast("long"), 57).bitwiseOR(low(F.xxhash64(w)))
    else:
        key = lambda w: F.shiftleft(level(w).cast("long"), 57).bitwiseOR(low(F.xxhash64(w)))
    return F.sort_array(F.array_distinct(F.transform(_split(lines), key)))


#: Bits of a word's number that hold the size of the line.
SIZES = 31


def _prefix(t: tuple[int, int]) -> str:
    """Words of the prefix of n words."""
    return f"(n - (({t[0]} * n + {t[1] - 1}) div {t[1]}) + 1)"


def _step(t: tuple[int, int]) -> str:
    """Places of a prefix that share a signature."""
    return f"(({_prefix(t)} + {BLOCKS - 1}) div {BLOCKS})"


def prefix_rows(lines: DataFrame, t: tuple[int, int], levels: str | None = None, last: list[int] | None = None) -> DataFrame:
    """(word, doc_id, line_no, n, pos, sig): the prefix words of lines(doc_id, line_no, line).

    word is the number that stands for it, with the number of binary digits
    of n in place of its last bits; a row that may meet lines of one digit
    more as the shorter one is there twice. sig has a bit for each place of 64
    that an odd number of the line's words from place with_off() on has.
    """
    a, b = t
    parity = "(s, k) -> s ^ shiftleft(1L, cast(k & 63 as int))"
    rows = lines.select("doc_id", "line_no", _keys(lines, levels, last or []).alias("keys")).withColumn("n", F.size("keys"))
    rows = rows.withColumn("p", F.expr(f"cast({_prefix(t)} as int)")).withColumn("step", F.expr(f"cast({_step(t)} as int)")).withColumn("all", F.expr(f"aggregate(keys, 0L, {parity})"))
    rows = rows.withColumn("sigs", F.expr(f"transform(sequence(0, cast((p - 1) div step as int)), q -> aggregate(slice(keys, 1, q * step), all, {parity}))"))
    rows = rows.select("doc_id", "line_no", "n", F.length(F.bin("n")).alias("digits"), "step", "sigs", F.posexplode(F.expr("slice(keys, 1, p)")).alias("pos", "word"))
    rows = rows.select("word", "doc_id", "line_no", "n", "digits", "pos", F.expr("get(sigs, cast(pos div step as int))").alias("sig"))
    both = f"{a} * next <= {b} * n and n - pos >= ({a} * (n + next) + {a + b - 1}) div {a + b}".replace("next", "shiftleft(1, digits)")
    rows = rows.select("word", F.expr(f"explode(if({both}, array(digits, digits + 1), array(digits)))").alias("size"), "doc_id", "line_no", "n", "pos", "sig")
    return rows.withColumn("word", F.expr(f"(word & {~SIZES}L) | size")).drop("size")


def with_off(rows: DataFrame, t: tuple[int, int]) -> DataFrame:
    """rows with off, the place in the line from which on sig counts: pos or a little less."""
    return rows.withColumn("off", F.expr(f"cast(pos - pos % ({_step(t)}) as int)"))


def _may_be_near(t: tuple[int, int]) -> str:
    """Whether prefix rows x and y of one word may be the first that two similar lines share.

    No word before it is shared, so enough words must follow in both lines,
    and the words from off on differ by no more than those before leave.
    """
    a, b = t
    need = f"(({a} * (x.n + y.n) + {a + b - 1}) div {a + b})"  # least number of shared words
    return f"""
        x.word = y.word
        and {a} * x.n <= {b} * y.n and {a} * y.n <= {b} * x.n
        and least(x.n - x.pos, y.n - y.pos) >= {need}
        and bit_count(x.sig ^ y.sig) <= x.n + y.n - 2 * {need} - x.off - y.off
    """


def met_rows(prefixes: DataFrame, t: tuple[int, int]) -> DataFrame:
    """The prefix rows whose bounds let another line's row through."""
    prefixes = with_off(prefixes, t)
    x, y = prefixes.alias("x"), prefixes.alias("y")
    return x.join(y, F.expr(_may_be_near(t) + " and (x.doc_id <> y.doc_id or x.line_no <> y.line_no)"), "left_semi")


def met_at_once(prefixes: DataFrame, t: tuple[int, int], parts: int) -> DataFrame:
    """met_rows of prefixes that no table holds: both sides read one shuffle, which is all that lies on disk."""
    return met_rows(prefixes.repartition(parts, "word"), t)


def signed_rows(rows: DataFrame, told: DataFrame) -> DataFrame:
    """rows with the signatures of their lines, s0, s1, ..."""
    signs = told.select("k.doc_id", "k.line_no", *[f"s{k}" for k in range(SIGNATURE)])
    return rows.join(signs, ["doc_id", "line_no"])


#: Unlike bits of the signatures of x and y.
APART = "(" + " + ".join(f"bit_count(x.s{k} ^ y.s{k})" for k in range(SIGNATURE)) + ")"


def _signs_near(t: tuple[int, int]) -> str:
    """Whether the unlike bits of x and y, x earlier, are no more than their unlike words may be."""
    a, b = t
    return f"struct(x.doc_id, x.line_no) < struct(y.doc_id, y.line_no) and {APART} <= x.n + y.n - 2 * (({a} * (x.n + y.n) + {a + b - 1}) div {a + b})"


def _pairs(both: DataFrame) -> DataFrame:
    return both.select(F.struct("x.doc_id", "x.line_no").alias("a"), F.struct("y.doc_id", "y.line_no").alias("b"), F.expr(APART).alias("apart"))


def hub_pairs(rows: DataFrame, t: tuple[int, int]) -> DataFrame:
    """Pairs (a, b, apart) of each line b of signed rows with the earliest line a that has the prefix word and the length."""
    row = F.struct([c for c in rows.columns if c != "word"])
    first = F.first(row).over(Window.partitionBy("word", "n").orderBy("doc_id", "line_no"))
    return _pairs(rows.select(first.alias("x"), row.alias("y")).where(_signs_near(t)))


def candidate_pairs(later: DataFrame, earlier: DataFrame, t: tuple[int, int]) -> DataFrame:
    """Pairs (a, b, apart) of lines of signed rows as structs (doc_id, line_no), a earlier, that the bounds let through; apart counts unlike bits."""
    return _pairs(earlier.alias("x").join(later.alias("y"), F.expr(f"{_may_be_near(t)} and {_signs_near(t)}")))


def nearest_only(pairs: DataFrame) -> DataFrame:
    """Each later line with its most alike candidate: one pair that passes is enough."""
    return pairs.groupBy("b").agg(F.min(F.struct("apart", "a")).alias("m")).select(F.col("m.a").alias("a"), "b")


def words_of(ends: DataFrame, table: DataFrame) -> DataFrame:
    """(k, words, s0, s1, ..., of hashes sketch too) of the lines ends(doc_id, line_no), from table(h1, h2, doc_id, line_no, line), which lies by its hashes and is not moved.

    s0, s1, ... have a bit for each place that an odd number of the words has.
    """
    ends = ends.distinct().join(table.where("line is not null").select("doc_id", "line_no", "h1", "h2"), ["doc_id", "line_no"])
    texts = table.where("line is not null").select("h1", "h2", "line")
    found = texts.join(ends.hint("shuffle_hash"), ["h1", "h2"])
    found = found.select(F.struct("doc_id", "line_no").alias("k"), _words(found).alias("words"))
    found = found.withColumn("hs", F.col("words") if _hashed(table) else F.transform("words", lambda w: F.xxhash64(w)))
    lane = "aggregate(hs, 0L, (s, w) -> if((w & 192) = {}, s ^ shiftleft(1L, cast(w & 63 as int)), s))"
    found = found.select("k", "words", *[F.expr(lane.format(k << 6)).alias(f"s{k}") for k in range(SIGNATURE)])
    return keep(sketched(found) if _hashed(table) else found, "line-words")


def sketched(rows: DataFrame) -> DataFrame:
    """rows(words: hashes) with sketch, a bit for each place that an odd number of the words has: one to two places a word, by powers of two from 64 on."""

    def run(batches):
        for batch in batches:
            words, out = batch.column(batch.schema.get_field_index("words")), []
            ends, flat = words.offsets.to_numpy(), words.values.to_numpy()
            for i, j in itertools.pairwise(ends.tolist()):
                places = 64 << max(0, (j - i - 1).bit_length() - 6)
                odd = np.bincount(flat[i:j] & (places - 1), minlength=places) & 1
                out.append(np.packbits(odd.astype("u1"), bitorder="little").view("<i8"))
            bits = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, out)]).astype("i4")), pa.array(np.concatenate(out or [np.zeros(0, "<i8")])))
            yield pa.RecordBatch.from_arrays([*batch.columns, bits], names=[*batch.schema.names, "sketch"])

    small_batches(rows.sparkSession)
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("sketch", T.ArrayType(T.LongType()))]))


def sketches_near(pairs: DataFrame, told: DataFrame, t: tuple[int, int]) -> DataFrame:
    """Those of the pairs (a, b) whose sketches differ in no more bits than their words may; sketches are short, and no similar pair is lost.

    The larger sketch is folded to the places of the other, which differ from its own by one doubling at most.
    """
    a, b = t
    of = lambda k: told.select(F.col("k").alias(k), F.size("words").alias(f"n{k}"), F.col("sketch").alias(f"s{k}"))
    both = pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b").where(f"{a} * na <= {b} * nb and {a} * nb <= {b} * na")
    fold = "if(size({0}) > size({1}), zip_with(slice({0}, 1, size({1})), slice({0}, size({1}) + 1, size({1})), (p, q) -> p ^ q), {0})"
    unlike = f"aggregate(zip_with({fold.format('sa', 'sb')}, {fold.format('sb', 'sa')}, (p, q) -> bit_count(p ^ q)), 0, (c, k) -> c + k)"
    return both.where(f"{unlike} <= na + nb - 2 * (({a} * (na + nb) + {a + b - 1}) div {a + b})").select("a", "b")


def verified(pairs: DataFrame, told: DataFrame, t: tuple[int, int]) -> DataFrame:
    """The later lines (doc_id, line_no) of those pairs (a, b) whose words are similar enough; told comes from words_of."""
    a, b = t
    if "sketch" in told.columns:  # long lines of hashes: their words are moved for few pairs only
        pairs = keep(sketches_near(pairs, told, t), "line-sifted")
    both = pairs.join(told.select(F.col("k").alias("a"), F.col("words").alias("wa")), "a").join(told.select(F.col("k").alias("b"), F.col("words").alias("wb")), "b")
    near = f"{a + b} * size(array_intersect(wa, wb)) >= {a} * (size(wa) + size(wb))"
    return keep(both.where(near).select("b.doc_id", "b.line_no").distinct(), "line-near")


def later_matches(docs: DataFrame, t: tuple[int, int] = SIMILARITY, least_words: int = LEAST_WORDS) -> DataFrame:
    """The lines to remove: (doc_id, line_no), each once.

    Lines of fewer than least_words words neither go nor remove anything.
    Rows with a null id or text have none. Rows that share an id are one
    document here: their lines go where the id's do.
    """
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    return later_lines(split_lines(docs).where(at_least(least_words)), t)


def later_lines(rows: DataFrame, t: tuple[int, int] = SIMILARITY, met: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The rows of (doc_id, line_no, line) that an earlier one resembles: (doc_id, line_no), each once.

    line is a text with words or an array of distinct hashes with at least
    one. met() may name pairs (a, b) of structs (doc_id, line_no), a earlier,
    of the distinct lines it gets, without line but with the rows' other
    columns. They are verified first; the join then looks for copies of the
    lines that are left.
    """
    spark = rows.sparkSession
    more = [c for c in rows.columns if c not in ("doc_id", "line_no", "line")]
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place, key = F.struct("doc_id", "line_no"), ["doc_id", "line_no"]
    name = f"arcwise_lines_{uuid.uuid4().hex}"
    every = rows.select("doc_id", "line_no", F.xxhash64("line").alias("h1"), F.xxhash64("line", F.lit(1)).alias("h2"), "line", *more)
    same = Window.partitionBy("h1", "h2").orderBy("doc_id", "line_no")
    every = every.withColumn("first", F.first(place).over(same)).withColumn("no", F.row_number().over(same))
    # First lines with their texts, laid out by hash so that looking them up again moves no text; of copies the places only.
    every = every.select("h1", "h2", "doc_id", "line_no", F.when(F.col("no") == 1, F.col("line")).alias("line"), (place > F.col("first")).alias("copy"), *more)
    try:
        with spent_shuffles_go(spark):
            every.write.bucketBy(buckets, "h1", "h2").option("compression", "zstd").format("parquet").saveAsTable(name)
        table = spark.table(name)
        lines = table.where("line is not null")
        last, hashed = [], _hashed(lines)
        if hashed:
            parts = max(buckets, -(-table.where("not copy").count() // MET_LINES))
            meeting = keep(met_at_once(prefix_rows(lines, t, rarity_table(lines)), t, parts), "line-meeting")
        for again in range(0 if hashed else 2):
            # Prefix words laid out by word, in order, so that meeting moves and sorts nothing.
            with spent_shuffles_go(spark):
                rows_ = prefix_rows(lines, t, None, last).repartition("word")
                plain = {f"parquet.enable.dictionary#{c}": "false" for c in ("word", "sig")}
                rows_.write.bucketBy(buckets, "word").sortBy("word").options(compression="zstd", **plain).format("parquet").saveAsTable(f"{name}_prefixes")
            if again:
                break
            often = spark.table(f"{name}_prefixes").groupBy("word").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > HOT)
            last = sorted({r.word & LOW & ~SIZES for r in often.orderBy(F.desc("c"), "word").limit(HOT_WORDS).collect()})
            if not last:
                break
            spark.sql(f"drop table {name}_prefixes")
        if not hashed:
            with settings(spark, spark__sql__legacy__bucketedTableScan__outputOrdering="true"):
                meeting = keep(met_rows(spark.table(f"{name}_prefixes"), t), "line-meeting")
            spark.sql(f"drop table {name}_prefixes")
        named = keep(met(lines.select(*key, *more)), "line-pairs") if met else None
        ends = meeting.select(*key)
        if met:
            ends = ends.unionByName(named.select(F.explode(F.array("a", "b")).alias("k")).select("k.doc_id", "k.line_no"))
        told = words_of(ends, table)
        meeting, met_first = keep(signed_rows(meeting, told), "line-meeting"), meeting
        discard(met_first)
        copies = keep(table.where("copy").select(*key), "line-copies")
    finally:
        spark.sql(f"drop table if exists {name}")
        spark.sql(f"drop table if exists {name}_prefixes")
    hubs, near = hub_pairs(meeting, t), verified(named, told, t) if met else None
    if met:
        hubs = hubs.join(near.select(F.struct(*key).alias("b")), "b", "left_anti")
    found = verified(nearest_only(hubs), told, t)
    near = near.unionByName(found) if met else found
    for last_round in (False, True):
        rest = keep((rest if last_round else meeting).join(near, key, "left_anti"), "line-rest")
        pairs = candidate_pairs(rest, meeting, t)
        near = near.unionByName(verified(pairs.select("a", "b").distinct() if last_round else nearest_only(pairs), told, t))
    discard(meeting, told)
    return copies.unionByName(near).distinct()


def drop_lines(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """docs with the lines removed(doc_id, line_no) taken out of text; other columns stay.

    Documents without removed lines pass unchanged, null texts too.
    """
    of_doc = removed.groupBy("doc_id").agg(F.collect_set("line_no").alias("_gone"))
    joined = docs.join(of_doc, "doc_id", "left")
    kept = F.expr("array_join(filter(split(text, '\\n'), (l, i) -> not array_contains(_gone, i)), '\n')")
    return joined.withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(kept)).select(docs.columns)


def dedup_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """docs without their near-duplicate later lines; a text may become empty, its row stays."""
    return drop_lines(docs, later_matches(docs, least_words=least_words))


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, removed (sorted line numbers) of docs with distinct ids."""
    removed = later_matches(docs).groupBy("doc_id").agg(F.sort_array(F.collect_set("line_no")).alias("removed"))
    sizes = docs.select("doc_id", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).alias("n_lines"))
    return sizes.join(removed, "doc_id", "left")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which lines go from every document: doc_id, n_lines, n_removed, removed_lines (joined by commas)."""
    report = line_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return report.select("doc_id", F.col("n_lines").cast("long"), F.size(removed).cast("long").alias("n_removed"), F.array_join(removed.cast("array<string>"), ",").alias("removed_lines"))


#: The same rows by brute force: all pairs of lines that share a word.
ORACLE_SQL = r"""
with lines as (
  select doc_id, cast(i - 1 as bigint) as line_no, string_split(text, chr(10))[i] as line
  from (select doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents where text is not null)
),
rows_ as (select *, list_distinct([w for w in string_split_regex(line, '[\x20\x09-\x0D]+') if w <> '']) as words from lines
          where len([w for w in string_split_regex(line, '[\x20\x09-\x0D]+') if w <> '']) >= 5),
firsts as (select line, min((doc_id, line_no)) as k, any_value(words) as words from rows_ group by line),
numbered as (select *, row_number() over (order by k) as id, len(words) as n from firsts),
tokens as (select id, n, unnest(words) as w from numbered),
shared as (select a.id as a, b.id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as o
           from tokens a join tokens b on a.w = b.w and a.id < b.id and 4 * a.n <= 5 * b.n and 4 * b.n <= 5 * a.n group by a.id, b.id),
near as (select distinct b from shared where 9 * o >= 4 * (na + nb)),
gone as (select r.doc_id, r.line_no from rows_ r join numbered f on r.line = f.line
         where (r.doc_id, r.line_no) > f.k or f.id in (select b from near)),
per_doc as (select doc_id, count(*) as n, string_agg(cast(line_no as varchar), ',' order by line_no) as l from gone group by doc_id)
select d.doc_id, cast(coalesce(len(string_split(d.text, chr(10))), 0) as bigint) as n_lines,
       cast(coalesce(p.n, 0) as bigint) as n_removed, coalesce(p.l, '') as removed_lines
from documents d left join per_doc p on d.doc_id = p.doc_id
"""
