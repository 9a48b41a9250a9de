"""Removal of globally repeated runs of lines, cut where the content says.

A rolling hash over the hashes of the last three lines ends a chunk where it is a
multiple of DIVISOR; a line inserted or taken away moves only the bounds beside it.
Chunks of several lines that occur more than once are found by hash and length, then
compared byte by byte with their first occurrence, and all but that are removed.
Bounds depend on the text around a passage, so chunks alone miss most short ones;
cleaned_runs also removes every repeated run of lines with LEAST_WORDS words or more,
line by line. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, shared_dir, stored

#: Rolling hash: polynomial of the last three lines' hashes, modulo a prime.
BASE, PRIME, DIVISOR = 257, 2147483647, 4
#: Lines that a chunk needs to be removed.
LEAST_LINES = 2
#: The most repeated chunks that are broadcast to the scan; beyond, a shuffled join.
BROADCAST_CHUNKS = 100_000
#: Occurrences of a chunk that are compared in one task.
SLICE_ROWS = 10_000
#: Words of the shortest run that is removed wherever it repeats.
LEAST_WORDS = 50
#: A window's line and its number of lines in one long.
_SHIFT = 1 << 32


def _bind(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def chunks(text: Column) -> Column:
    """array<struct<pos, at, n, body>>: consecutive chunks; joined by newlines they give the text. Null for null."""

    def of_lines(lines: Column) -> Column:
        def of_hashes(h: Column) -> Column:
            def ends(i: Column) -> Column:
                rolled = (F.get(h, i) + BASE * F.coalesce(F.get(h, i - 1), F.lit(0)) + BASE * BASE * F.coalesce(F.get(h, i - 2), F.lit(0))) % PRIME
                return (rolled % DIVISOR == 0) | (i == F.size(h) - 1)

            def of_ends(e: Column) -> Column:
                def chunk(end: Column, k: Column) -> Column:
                    start = F.coalesce(F.get(e, k - 1) + 1, F.lit(0))
                    n = end - start + 1
                    return F.struct(k.alias("pos"), start.alias("at"), n.alias("n"), F.array_join(F.slice(lines, start + 1, n), "\n").alias("body"))

                return F.transform(e, chunk)

            return _bind(F.filter(F.sequence(F.lit(0), F.size(h) - 1), ends), of_ends)

        return _bind(F.transform(lines, lambda x: F.conv(F.left(F.md5(x.cast("binary")), F.lit(7)), 16, 10).cast("long")), of_hashes)

    return F.when(text.isNotNull(), _bind(F.split(text, "\n", -1), of_lines))


def _sided(table: DataFrame, array: str) -> DataFrame:
    """A table with an array in each row, broadcast if rows and elements together are few (they are counted)."""
    n = table.agg(F.count(F.lit(1)) + F.coalesce(F.sum(F.size(array)), F.lit(0))).first()[0]
    return F.broadcast(table) if n <= 4 * BROADCAST_CHUNKS else table


def repeats(rows: DataFrame, top: str) -> DataFrame:
    """rows (rid, doc_id, text) -> (rid, gone): positions of the chunks to remove from a row.

    The first occurrence by (doc_id, rid, position) stays; null ids come first.
    """
    each = rows.select("rid", "doc_id", F.explode(chunks(F.col("text"))).alias("c")).where(F.col("c.n") >= LEAST_LINES)
    each = each.select("rid", "doc_id", F.col("c.pos").alias("pos"), F.col("c.body").alias("body")).withColumn("hash", F.xxhash64("body")).withColumn("size", F.octet_length("body"))
    known = each.groupBy("hash", "size").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("doc_id", "rid", "pos")).alias("first")).where("times > 1")
    known = known.select(F.col("hash").alias("h"), F.col("size").alias("s"), F.col("first.rid").alias("first_rid"), F.col("first.pos").alias("first_pos"), F.ceil(F.col("times") / SLICE_ROWS).alias("slices"))
    known = stored(known, f"{top}/known")
    same = (F.col("hash") == F.col("h")) & (F.col("size") == F.col("s"))
    found = each.drop("doc_id").join(F.broadcast(known) if known.count() <= BROADCAST_CHUNKS else known, same).drop("h", "s")
    found = stored(found, f"{top}/found")
    is_first = (F.col("rid") == F.col("first_rid")) & (F.col("pos") == F.col("first_pos"))
    # a common chunk is compared in slices, each with a copy of the first occurrence
    firsts = found.where(is_first).select(F.col("hash").alias("h"), F.col("size").alias("s"), F.col("body").alias("first_body"), F.explode(F.sequence(F.lit(0), F.col("slices").cast("int") - 1)).alias("t"))
    rest = found.where(~is_first).withColumn("slice", F.pmod(F.xxhash64("rid", "pos"), "slices"))
    gone = rest.join(firsts, same & (F.col("slice") == F.col("t"))).where(F.col("body") == F.col("first_body"))
    return gone.groupBy("rid").agg(F.collect_set("pos").alias("gone"))


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", into: str = "text") -> DataFrame:
    """(doc_id, text, n_lines, n_chunks, n_removed), one row for each row of docs.

    A null text stays null with no lines; an empty one is one empty line. Repeated rows
    and rows with equal or null ids are told apart by a row number given when they are
    stored. Two chunks whose hash and length agree but whose bytes differ both stay.
    """
    top = shared_dir(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), docs[f"`{id_col}`"].alias("doc_id"), docs[f"`{text_col}`"].alias("text"))
    rows = stored(rows, f"{top}/rows")
    gone = stored(repeats(rows, top), f"{top}/gone").withColumnRenamed("rid", "gone_rid")
    out = rows.join(_sided(gone, "gone"), F.col("rid") == F.col("gone_rid"), "left")
    gone_at = F.coalesce("gone", F.array().cast("array<int>"))

    def kept(c: Column) -> Column:
        left = F.filter(c, lambda x: ~F.array_contains(gone_at, x["pos"]))
        return F.struct(
            F.array_join(F.transform(left, lambda x: x["body"]), "\n").alias("text"),
            F.aggregate(c, F.lit(0), lambda a, x: a + x["n"]).alias("n_lines"),
            F.size(c).alias("n_chunks"),
            (F.size(c) - F.size(left)).alias("n_removed"),
        )

    out = out.select(F.col("doc_id").alias(id_col), _bind(chunks(F.col("text")), kept).alias("k"), F.col("text").isNull().alias("none"))
    whole = F.when(~F.col("none"), F.col("k")["text"]).alias(into)
    return out.select(id_col, whole, *[F.when(F.col("none"), 0).otherwise(F.col("k")[x]).alias(x) for x in ("n_lines", "n_chunks", "n_removed")])


def windows(text: Column, least: int = LEAST_WORDS) -> Column:
    """array<struct<at, n, hash>>: the shortest runs of lines with `least` words from, and up to, each line with words.

    And those of two lines that are windows alone with lines without words between them.
    A run of that many words that begins and ends in lines with words is the union of
    the windows inside it.
    """

    def of_lines(lines: Column) -> Column:
        def of_words(line: Column) -> Column:
            last = F.size(line) - 1

            def span(a: Column, z: Column) -> Column:
                return F.get(line, a) * F.lit(_SHIFT) + F.get(line, z) - F.get(line, a) + 1

            opens = F.filter(F.sequence(F.lit(0), last), lambda w: (w + (least - 1) <= last) & ((w == 0) | (F.get(line, w - 1) != F.get(line, w))))
            closes = F.filter(F.sequence(F.lit(0), last), lambda w: (w >= least - 1) & ((w == last) | (F.get(line, w + 1) != F.get(line, w))))
            # lines that are windows alone, with empty ones between them
            apart = F.filter(opens, lambda w: (w >= least) & (F.get(line, w) - F.get(line, w - 1) > 1) & (F.get(line, w - least) == F.get(line, w - 1)) & (F.get(line, w + (least - 1)) == F.get(line, w)))
            spans = F.array_distinct(F.concat(F.transform(opens, lambda w: span(w, w + (least - 1))), F.transform(closes, lambda w: span(w - (least - 1), w)), F.transform(apart, lambda w: span(w - 1, w))))

            def of_hashes(h: Column) -> Column:
                def window(x: Column) -> Column:
                    at, n = F.floor(x / _SHIFT).cast("int"), (x % _SHIFT).cast("int")
                    return F.struct(at.alias("at"), n.alias("n"), F.xxhash64(F.slice(h, at + 1, n)).alias("hash"))

                return F.transform(spans, window)

            return F.when(last >= least - 1, _bind(F.transform(lines, lambda x: F.xxhash64(x)), of_hashes))

        return _bind(F.flatten(F.transform(lines, lambda x, k: F.array_repeat(k.cast("long"), F.regexp_count(x, F.lit(WORD))))), of_words)

    return _bind(F.split(text, "\n", -1), of_lines)


def runs(rows: DataFrame, top: str, least: int = LEAST_WORDS) -> DataFrame:
    """rows (rid, doc_id, text) -> (rid, runs): array<struct<at, n>>, the runs of lines to remove from a row.

    A window goes where it occurred before by (doc_id, rid, line), but not where it
    overlaps its first occurrence. Neighbouring windows with neighbouring first
    occurrences are joined before their bytes are compared.
    """
    each = rows.select("rid", "doc_id", F.explode(windows(F.col("text"), least)).alias("w")).select("rid", "doc_id", "w.*")
    each = stored(each, f"{top}/windows")
    known = each.groupBy("hash", "n").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("doc_id", "rid", "at")).alias("first")).where("times > 1")
    known = stored(known.select(F.col("hash").alias("h"), F.col("n").alias("s"), F.col("first.rid").alias("first_rid"), F.col("first.at").alias("first_at")), f"{top}/known_windows")
    same = (F.col("hash") == F.col("h")) & (F.col("n") == F.col("s"))
    found = each.join(F.broadcast(known) if known.count() <= BROADCAST_CHUNKS else known, same)
    found = found.where((F.col("rid") != F.col("first_rid")) | (F.col("at") >= F.col("first_at") + F.col("n")))
    found = found.select("rid", "at", "n", "first_rid", (F.col("at") - F.col("first_at")).alias("shift"))

    along = Window.partitionBy("rid", "first_rid", "shift").orderBy("at", "n")
    before = F.max(F.col("at") + F.col("n")).over(along.rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("part", F.when(F.col("at") <= before, 0).otherwise(1)).withColumn("part", F.sum("part").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    found = found.groupBy("rid", "first_rid", "shift", "part").agg(F.min("at").alias("at"), F.max(F.col("at") + F.col("n")).alias("end"))
    found = stored(found.select("rid", "at", (F.col("end") - F.col("at")).alias("n"), "first_rid", (F.col("at") - F.col("shift")).alias("first_at")), f"{top}/runs")

    # one pass over the texts cuts out runs and first occurrences; always shuffled, so that cost grows evenly
    firsts = found.select(F.col("first_rid").alias("rid"), F.col("first_at").alias("at"), "n").distinct()
    spans = found.unionByName(firsts, allowMissingColumns=True).groupBy("rid").agg(F.collect_list(F.struct("at", "n", "first_rid", "first_at")).alias("r"))
    spans = spans.withColumnRenamed("rid", "of_rid").hint("merge")

    def cut(lines: Column) -> Column:
        return F.transform("r", lambda x: F.struct(x.alias("x"), F.array_join(F.slice(lines, x["at"] + 1, x["n"]), "\n").alias("body")))

    bodies = rows.select("rid", "text").join(spans, F.col("rid") == F.col("of_rid")).select("rid", F.explode(_bind(F.split("text", "\n", -1), cut)).alias("b"))
    bodies = stored(bodies.select("rid", "b.x.*", "b.body"), f"{top}/bodies")
    firsts = bodies.where(F.col("first_rid").isNull()).select(F.col("rid").alias("r"), F.col("at").alias("a"), F.col("n").alias("s"), F.col("body").alias("first_body"))
    gone = bodies.where(F.col("first_rid").isNotNull()).join(firsts.hint("merge"), (F.col("first_rid") == F.col("r")) & (F.col("first_at") == F.col("a")) & (F.col("n") == F.col("s")))
    return gone.where(F.col("body") == F.col("first_body")).groupBy("rid").agg(F.collect_list(F.struct("at", "n")).alias("runs"))


def cleaned_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", into: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, text, n_lines, n_gone), one row for each row of docs: without the lines of repeated chunks and runs.

    Every line that goes stands somewhere before, by (doc_id, row, line). Null and empty
    texts, repeated rows and equal or null ids are as in cleaned.
    """
    top = shared_dir(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), docs[f"`{id_col}`"].alias("doc_id"), docs[f"`{text_col}`"].alias("text"))
    rows = stored(rows, f"{top}/rows")
    by_chunk = stored(repeats(rows, top), f"{top}/gone").withColumnRenamed("rid", "chunk_rid")
    by_run = stored(runs(rows, top, least), f"{top}/gone_runs").withColumnRenamed("rid", "run_rid")
    out = rows.join(_sided(by_chunk, "gone"), F.col("rid") == F.col("chunk_rid"), "left")
    out = out.join(_sided(by_run, "runs"), F.col("rid") == F.col("run_rid"), "left")

    def lines_of(spans: Column) -> Column:
        return F.flatten(F.transform(spans, lambda x: F.sequence(x["at"], x["at"] + x["n"] - 1)))

    gone_chunks = F.filter(chunks(F.col("text")), lambda x: F.array_contains("gone", x["pos"]))
    none = F.array().cast("array<int>")
    gone_lines = F.concat(F.coalesce(F.when(F.col("gone").isNotNull(), lines_of(gone_chunks)), none), F.coalesce(lines_of(F.col("runs")), none))

    def kept(lines: Column) -> Column:
        def of_left(left: Column) -> Column:
            return F.struct(F.array_join(F.transform(left, lambda k: F.get(lines, k)), "\n").alias("text"), F.size(lines).alias("n_lines"), (F.size(lines) - F.size(left)).alias("n_gone"))

        return _bind(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone_lines), of_left)

    out = out.select(F.col("doc_id").alias(id_col), F.when(F.col("text").isNotNull(), _bind(F.split("text", "\n", -1), kept)).alias("k"))
    return out.select(id_col, F.col("k")["text"].alias(into), *[F.coalesce(F.col("k")[x], F.lit(0)).alias(x) for x in ("n_lines", "n_gone")])
