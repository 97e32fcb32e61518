"""Removal of repeated passages of lines, by content-defined chunks and runs of lines.  DataFrame functions only.

A text is a list of lines, each with a 64-bit hash.  A rolling hash over the
hashes of ``window`` lines marks lines that are 0 modulo ``average_lines``; a
chunk ends with such a line if the one before it isn't marked as well.  A border
so depends on the lines beside it alone, and a passage is cut the same way
wherever it stands.  A line of more than ``long_line`` words is a chunk of its
own.  Chunks of at least two lines that aren't blank, and long lines, are
compared over all documents, byte by byte, and only what occurs more than once
is removed, everywhere but at its first place (by doc_id, then place in the
document).  A single line that is left between others is compared, and removed,
together with the chunk before it (at the beginning of a text: after it), so
that a copied document leaves no crumbs.

The borders of a chunk may lie outside of a passage.  So for each line that is
neither blank nor long, the shortest runs of lines that begin and that end with
it and have more than ``long_line`` words are compared as well: any repeated
passage of so many words in lines that aren't long is a union of such runs,
wherever it is cut.  A long line ends a run, blank lines don't count, and the
lines of a run are removed everywhere but at its first place.  Where a run
overlaps its own first place, only the lines behind that go.

Each line is hashed once; chunks and runs are named by the hashes of their lines.
Names and places are written, and counted; only texts that hold a name seen twice
are cut into bodies, which are named by a second hash of their text as well, and
a name counts only if all its bodies are equal.

Shuffles: names, to count them and to find the places of repeated ones; the
texts once, to meet those places; bodies of repeated names, and the texts that
hold any.  Counts are summed within tasks before they are shuffled, so a passage
that a third of all documents share costs one row a task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labtrail.llm.common import free_name, materialize

#: One line in so many is marked; chunks have about twice as many lines less one.
AVERAGE_LINES = 3
WINDOW = 2
LONG_LINE = 50


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row, however often it is used."""
    return F.transform(F.array(value), use)[0]


def lines_of(text: Column, long_line: int = LONG_LINE) -> Column:
    """The lines of a text: array of (hash, words, long); a blank line has no words."""

    def line(x: Column) -> Column:
        words = F.when(F.trim(x) == "", 0).otherwise(F.size(F.split(F.trim(x), r"\s+")))
        return let(words, lambda n: F.struct(
            F.xxhash64(x).alias("hash"), n.alias("words"), ((F.length(x) > 2 * long_line) & (n > long_line)).alias("long")
        ))

    return F.transform(F.split(text, "\n", -1), line)


def _between(lines: Column, first: Column, last: Column) -> Column:
    return F.slice(lines, first + 1, last - first + 1)


def chunk_spans(lines: Column, average_lines: int = AVERAGE_LINES, window: int = WINDOW) -> Column:
    """The chunks of ``lines_of`` a text, in order: array of (begin, end, from, to).

    ``begin`` and ``end`` are a chunk's first and last line; the lines ``from``
    to ``to`` are compared for it, null if it is never removed.
    """

    def spans(hashes: Column, long: Column) -> Column:
        def marked(i: Column) -> Column:
            rolled = F.xxhash64(F.slice(hashes, F.greatest(i - window + 2, F.lit(1)), F.least(i + 1, F.lit(window))))
            return F.pmod(rolled, F.lit(average_lines)) == 0

        def ends(marks: Column) -> Callable[[Column], Column]:
            # neither the first line nor the last is cut off alone
            return lambda i: (
                (F.get(marks, i) & ~F.coalesce(F.get(marks, i - 1), F.lit(True)) & (i < F.size(lines) - 2))
                | F.get(long, i) | F.coalesce(F.get(long, i + 1), F.lit(True))
            )

        numbers = lambda: F.sequence(F.lit(0), F.size(lines) - 1)
        last = let(F.transform(numbers(), marked), lambda marks: F.filter(numbers(), ends(marks)))
        return let(last, lambda last: let(F.transform(last, lambda e, k: chunk(last, e, k)), lambda own: F.transform(own, lambda c, k: with_unit(own, c, k))))

    def chunk(last: Column, e: Column, k: Column) -> Column:
        begin = F.coalesce(F.get(last, k - 1), F.lit(-1)) + 1
        written = F.size(F.filter(_between(lines, begin, e), lambda x: x.words > 0))
        return F.struct(begin.alias("begin"), e.alias("end"), F.get(lines, e).long.alias("long"), written.alias("written"))

    def with_unit(own: Column, c: Column, k: Column) -> Column:
        before, after, alone = F.get(own, k - 1), F.get(own, k + 1), ~c.long & (c.written == 1)
        whole = c.long | (c.written > 1)
        joined_before, joined_after = alone & (k > 0) & (before.written > 0), alone & (k == 0) & (after.written > 0)
        first = F.when(whole | joined_after, c.begin).when(joined_before, before.begin)
        to = F.when(whole | joined_before, c.end).when(joined_after, after.end)
        return F.struct(c.begin.alias("begin"), c.end.alias("end"), first.alias("from"), to.alias("to"))

    hashes, long = F.transform(lines, lambda x: x.hash), F.transform(lines, lambda x: x.long)
    return let(hashes, lambda hashes: let(long, lambda long: spans(hashes, long)))


def chunks_of(text: Column, average_lines: int = AVERAGE_LINES, window: int = WINDOW, long_line: int = LONG_LINE) -> Column:
    """The chunks of a text in order, joined by line breaks the text again: array of (text, unit, begin, end).

    ``unit`` is what is compared for the chunk, null if it is never removed; ``begin`` and ``end`` are its first and last line.
    """

    def shown(plain: Column, c: Column) -> Column:
        body = lambda first, last: F.array_join(_between(plain, first, last), "\n")
        return F.struct(body(c.begin, c.end).alias("text"), F.when(c["from"].isNotNull(), body(c["from"], c.to)).alias("unit"), c.begin.alias("begin"), c.end.alias("end"))

    cut = let(lines_of(text, long_line), lambda lines: chunk_spans(lines, average_lines, window))
    return let(F.split(text, "\n", -1), lambda plain: F.transform(cut, lambda c: shown(plain, c)))


def run_spans(lines: Column, long_line: int = LONG_LINE) -> Column:
    """The shortest runs of more than ``long_line`` words from and up to each line: array of (first, last) of the written ``lines``."""
    most = long_line + 1
    # a line's words, its number, or more words than a run can have if it is long
    stop = 4 * most
    count = lambda x: F.when(x.long, F.lit(stop)).otherwise(F.least(x.words, F.lit(most)))

    def needed(counts: Column) -> Column:
        # lines * 2**20 + words, until the words are enough
        step = lambda acc, n: F.when(acc % (1 << 20) > long_line, acc).otherwise(acc + (1 << 20) + n)
        return F.aggregate(counts, F.lit(0).cast("long"), step, lambda acc: F.when((acc % (1 << 20) > long_line) & (acc % (1 << 20) < stop), F.shiftright(acc, 20)))

    def spans(counts: Column) -> Column:
        # first line * 2**20 + lines after it: there are at most long_line
        numbers = F.sequence(F.lit(0).cast("long"), F.size(counts).cast("long") - 1)
        code = lambda k, n: k * (1 << 20) + n - 1
        before = lambda k: F.greatest(k - long_line, F.lit(0).cast("long"))
        down = F.transform(numbers, lambda k: code(k, needed(F.slice(counts, (k + 1).cast("int"), F.lit(most)))))
        up = F.transform(numbers, lambda k: let(needed(F.reverse(F.slice(counts, (before(k) + 1).cast("int"), (k - before(k) + 1).cast("int")))), lambda n: code(k - n + 1, n)))
        return F.filter(F.array_union(down, up), lambda c: c.isNotNull())

    ends = lambda c: F.struct(F.shiftright(c, 20).cast("int").alias("first"), (F.shiftright(c, 20) + c % (1 << 20)).cast("int").alias("last"))
    none = F.array().cast("array<struct<first:int,last:int>>")
    return F.when(F.size(lines) == 0, none).otherwise(let(F.transform(lines, count), lambda counts: F.transform(spans(counts), ends)))


#: A passage by name and place: its lines ``begin`` to ``end`` go if it is repeated; ``from`` to ``to`` are compared, in a run without blank lines.
PASSAGES = "array<struct<h:bigint,begin:int,end:int,from:int,to:int,run:boolean>>"


def passages_of(text: Column, average_lines: int = AVERAGE_LINES, window: int = WINDOW, long_line: int = LONG_LINE) -> Column:
    """The chunks and runs of a text that may be removed: ``PASSAGES``."""

    def named(lines: Column, first: Column, last: Column, run: bool, *place: Column) -> Column:
        own = _between(lines, first, last)
        kind = F.lit("run" if run else "chunk")
        return F.struct(
            F.xxhash64(kind, F.transform(own, lambda x: x.hash)).alias("h"),
            *[p.alias(n) for p, n in zip(place, ("begin", "end", "from", "to"))], F.lit(run).alias("run"),
        )

    def chunks(lines: Column) -> Column:
        kept = F.filter(chunk_spans(lines, average_lines, window), lambda c: c["from"].isNotNull())
        return F.transform(kept, lambda c: named(lines, c["from"], c.to, False, c.begin, c.end, c["from"], c.to))

    def runs(lines: Column) -> Column:
        placed = F.transform(lines, lambda x, i: F.struct(x.hash.alias("hash"), x.words.alias("words"), x.long.alias("long"), i.alias("at")))

        def run(written: Column, c: Column) -> Column:
            begin, end = F.get(written, c.first).at, F.get(written, c.last).at
            return named(written, c.first, c.last, True, begin, end, begin, end)

        return let(F.filter(placed, lambda x: x.words > 0), lambda written: F.transform(run_spans(written, long_line), lambda c: run(written, c)))

    return let(lines_of(text, long_line), lambda lines: F.concat(chunks(lines), runs(lines))).cast(PASSAGES)


def bodies_of(text: Column, spans: Column) -> Column:
    """The bodies of passages of a text: array of (h, g, begin, end, body); ``g`` is a hash of the body's text."""

    def body(lines: Column, s: Column) -> Column:
        own = _between(lines, s["from"], s.to)
        return F.array_join(F.when(s.run, F.filter(own, lambda x: F.trim(x) != "")).otherwise(own), "\n")

    def named(s: Column, body: Column) -> Column:
        return F.struct(s.h.alias("h"), F.xxhash64(F.lit("body"), body).alias("g"), s.begin.alias("begin"), s.end.alias("end"), body.alias("body"))

    cut = lambda lines: F.transform(spans, lambda s: let(body(lines, s), lambda b: named(s, b)))
    return let(F.split(text, "\n", -1), cut)


def dedup_lines(
    docs: DataFrame,
    average_lines: int = AVERAGE_LINES,
    window: int = WINDOW,
    long_line: int = LONG_LINE,
) -> DataFrame:
    """``docs`` with repeated chunks and runs taken out of ``text``, and ``removed_chunks`` and ``removed_chars``.

    ``removed_chunks`` counts the chunks of which lines are taken out.

    ``docs`` needs ``doc_id`` and ``text``; all other columns stay (one named
    like a new column is replaced).  A null text stays null, an empty one
    empty; a document of which all is repeated elsewhere has an empty text.
    Rows with the same doc_id (null is one value) *and* the same text are one
    document: they keep or lose the same chunks, and don't repeat each other.
    An empty table stays empty.  Places in ``docs`` order don't matter.
    """
    docs = docs.drop("removed_chunks", "removed_chars")
    key, content, cut, places = (free_name(docs, x) for x in ("doc_key", "text_hash", "spans", "lines"))
    own = passages_of(F.col("text"), average_lines, window, long_line)
    seen = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").alias(key), F.xxhash64("text").alias(content), own.alias(cut))
    passages = materialize(seen.select(key, content, F.inline(cut)), "passages")
    twice = materialize(passages.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "names-seen-twice")
    hits = passages.join(twice, "h").groupBy(key, content).agg(F.collect_set(F.struct("h", "begin", "end", "from", "to", "run")).alias(cut))
    hits = hits.select(F.col(key).alias("hit_key"), F.col(content).alias("hit_content"), cut)
    same = lambda k, c: F.col("doc_id").eqNullSafe(F.col(k)) & (F.col(content) == F.col(c))
    met = docs.withColumn(content, F.xxhash64("text")).join(hits, same("hit_key", "hit_content"), "left").drop("hit_key", "hit_content")
    met = materialize(met, "texts-and-passages")
    held = met.where(F.col(cut).isNotNull())

    at = F.struct(key, content, "begin", "end")
    bodies = held.select(F.col("doc_id").alias(key), content, F.inline(bodies_of(F.col("text"), F.col(cut))))
    texts = bodies.groupBy("h", "g", "body").agg(F.min(at).alias("first"), F.max(at).alias("last"))
    named = texts.groupBy("h", "g").agg(F.count("*").alias("texts"), F.min("first").alias("first"), F.max("last").alias("last"))
    # names that several texts share are no proof, so nothing is removed by them
    repeated = materialize(named.where("texts = 1 and first != last").select("h", "g", "first"), "repeated-passages")
    gone = bodies.drop("body").join(repeated, ["h", "g"]).where(~at.eqNullSafe(F.col("first")))
    inside = F.col(f"first.{key}").eqNullSafe(F.col(key)) & (F.col(f"first.{content}") == F.col(content))
    gone = gone.withColumn("begin", F.when(inside, F.greatest("begin", F.col("first.end") + 1)).otherwise(F.col("begin"))).where("begin <= end")
    gone = gone.groupBy(key, content).agg(F.collect_set(F.struct("begin", "end")).alias(places))
    gone = gone.select(F.col(key).alias("gone_key"), F.col(content).alias("gone_content"), places)

    def between(all_: Column, gone: Column, j: Column) -> Column:
        begin = F.coalesce(F.get(gone, j - 1), F.lit(-1)) + 1
        return F.slice(all_, begin + 1, F.coalesce(F.get(gone, j), F.size(all_)) - begin)

    # the lines between the removed ones
    kept = lambda lines, gone: F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), lambda j: between(lines, gone, j))), "\n")
    spans = let(lines_of(F.col("text"), long_line), lambda lines: chunk_spans(lines, average_lines, window))
    chunk_of = F.flatten(F.transform(spans, lambda c, k: F.array_repeat(k, c.end - c.begin + 1)))
    touched = lambda gone: let(chunk_of, lambda of: F.size(F.array_distinct(F.transform(gone, lambda i: F.get(of, i)))))
    lost = F.array_sort(F.array_distinct(F.flatten(F.transform(F.col(places), lambda x: F.sequence(x.begin, x.end)))))
    new = let(lost, lambda gone: F.struct(let(F.split("text", "\n", -1), lambda lines: kept(lines, gone)).alias("text"), touched(gone).alias("chunks")))
    out = held.join(gone, same("gone_key", "gone_content"), "left").withColumn("_new", F.when(F.col(places).isNotNull(), new))
    changed = out.select(
        *[(F.when(F.col(places).isNull(), F.col("text")).otherwise(F.col("_new.text")).alias("text") if c == "text" else F.col(c)) for c in docs.columns],
        F.coalesce("_new.chunks", F.lit(0)).cast("long").alias("removed_chunks"),
        F.coalesce(F.length("text") - F.length("_new.text"), F.lit(0)).cast("long").alias("removed_chars"),
    )
    zero = F.lit(0).cast("long")
    rest = met.where(F.col(cut).isNull()).select(*docs.columns, zero.alias("removed_chunks"), zero.alias("removed_chars"))
    return changed.unionByName(rest)
