"""Line dedup by winnowing, in DataFrame operations only.

A run is consecutive lines of `least` words (51) or more in all. Each line begins one window: it and as many next
lines as it takes to have that many words, so every run holds a window. The minimum of a window's line hashes (the last
of equal minima) is its fingerprint, and texts that share a window share the fingerprint there. Windows that
follow each other mostly have the same one: the places of these minima, with their windows, are the only rows that go
on, and those whose fingerprint stands at one place of the corpus only go no further.
Positions of equal fingerprints are joined with the first place (smallest id, then line) that has the same lines around
it: a match is extended both ways over the windows whose minimum it is, each verified by two independent 64-bit hashes of all
its lines, and windows that adjoin or overlap make up the whole run. All lines of a run that stands at an
earlier place too are deleted, and the earliest copy stays.

Every step groups by a hash with map-side aggregation; no step pairs the copies of a run with one
another, so a passage that a third of all texts share costs a row a copy.

Results for odd input: lines are compared without white space at their ends; lines without any other character don't count,
and go with the run that they lie within; a copy that overlaps its own first place in one text stays; a null text has no
lines and stays null; an empty text stays empty; a text whose lines all go becomes empty; rows with equal ids and
different texts are texts of their own, in the order of a hash; rows with equal ids and texts all keep what the first keeps; a null
id comes before all others; very long texts are cut like all others, with windows of 51 lines at most; other columns aren't
returned; an empty table gives an empty result.

Lines see a passage only where it is cut into the same lines. `passages_removed` works on words instead, however they are
wrapped or embedded: every stretch of `least` words (51) that stands at an earlier place too is deleted, and so is every
longer one, as the sum of such stretches. Its fingerprints are hashes of `gram` words, winnowed so that each stretch
of `least` words has one. White space isn't compared; a deleted word goes with the white space after it. Copies
that overlap their own first place in one text stay, so a word that is repeated a thousand times keeps its first fifty or more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.shared import written

#: Words that a repeated run or passage has at least, and words of a fingerprint of a passage.
LEAST, GRAM = 51, 8
SPACE = r"\x20\x09-\x0D"


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def stripped(line: Column) -> Column:
    return F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")


def windows(df: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, version, fingerprint, place, windows: a row for each window minimum, with the windows that have it.

    A window has at and n (its first line and number of lines, of those with words), line and last (their numbers in the text, 0 is the
    first), one and two (hashes of its lines). version tells texts of one id apart.
    """
    word = F.lit(f"[^{SPACE}]+")
    own = df.where("text is not null").select("doc_id", F.xxhash64("text").alias("version"), F.transform(lines(F.col("text")), stripped).alias("l"))
    of_line = lambda x, i: F.struct(i.alias("line"), F.xxhash64(x).alias("one"), F.xxhash64(F.lit(41), x).alias("two"), F.regexp_count(x, word).alias("words"))
    own = own.select("doc_id", "version", F.filter(F.transform("l", of_line), lambda x: x["words"] > 0).alias("l")).where(F.size("l") > 0)
    # a line with words has one at least, so no window is longer than `least` lines
    grown = lambda i: F.aggregate(F.slice("l.words", i, least), F.struct(F.lit(0).alias("words"), F.lit(0).alias("n")), lambda a, x: F.when(a["words"] >= least, a).otherwise(F.struct((a["words"] + x).alias("words"), (a["n"] + 1).alias("n"))))
    own = own.select("doc_id", "version", "l", F.transform(F.sequence(F.lit(1), F.size("l")), grown).alias("w"))
    # the last windows of a text run out of words
    own = own.select("doc_id", "version", "l", F.col("l.one").alias("one"), F.col("l.two").alias("two"), F.transform(F.filter("w", lambda x: x["words"] >= least), lambda x: x["n"]).alias("n"))
    of_start = lambda n, i: F.struct(
        i.alias("at"), n.alias("n"), F.get("l", i)["line"].alias("line"), F.get("l", i + n - 1)["line"].alias("last"),
        F.xxhash64(F.slice("one", i + 1, n)).alias("one"), F.xxhash64(F.slice("two", i + 1, n)).alias("two"), F.array_min(F.slice("one", i + 1, n)).alias("least"),
    )
    own = own.select("doc_id", "version", "one", F.transform("n", of_start).alias("w"))
    place = lambda x: x["at"] + x["n"] - F.array_position(F.reverse(F.slice("one", x["at"] + 1, x["n"])), x["least"]).cast("int")
    own = own.select("doc_id", "version", "w", F.transform("w", place).alias("places"))
    # places never go back from one window to the next
    cut = F.filter(F.transform("places", lambda x, i: F.when((i == 0) | (x != F.get("places", i - 1)), i)), lambda i: i.isNotNull())
    own = own.select("doc_id", "version", "w", "places", cut.alias("cut"))
    part = lambda i, k: F.struct(F.get("w", i)["least"].alias("fingerprint"), F.get("places", i).alias("place"), F.transform(F.slice("w", i + 1, F.coalesce(F.get("cut", k + 1), F.size("w")) - i), lambda x: x.dropFields("least")).alias("windows"))
    return own.select("doc_id", "version", F.inline(F.transform("cut", part)))


def repeated_lines(df: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, version, gone: the stretches (line and last) that are deleted, apart and ascending; only texts that have any."""
    rows = written(windows(df, least), "fingerprints")
    position = F.struct("doc_id", "version", "place")
    shared = rows.groupBy("fingerprint").agg(F.min(position).alias("a"), F.max(position).alias("b")).where("a <> b").select("fingerprint")
    candidates = rows.join(shared, "fingerprint", "left_semi").select("fingerprint", "doc_id", "version", F.inline("windows"))
    candidates = written(candidates, "positions")
    start = F.struct("doc_id", "version", "at")
    first = candidates.groupBy("fingerprint", "one", "two").agg(F.min(start).alias("first"), F.max(start).alias("end")).where("first <> end").drop("end")
    elsewhere = ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("version") == F.col("first.version")))
    later = candidates.join(first, ["fingerprint", "one", "two"]).where(elsewhere | (F.col("at") >= F.col("first.at") + F.col("n")))
    found = later.groupBy("doc_id", "version").agg(F.array_sort(F.collect_set(F.struct("line", "last"))).alias("w"))
    # windows end in the order in which they start, so only neighbours can touch
    starts = F.filter("w", lambda x, k: (k == 0) | (x["line"] > F.get("w", k - 1)["last"] + 1))
    ends = F.filter("w", lambda x, k: (k == F.size("w") - 1) | (x["last"] + 1 < F.get("w", k + 1)["line"]))
    return found.select("doc_id", "version", F.zip_with(starts, ends, lambda a, b: F.struct(a["line"].alias("line"), b["last"].alias("last"))).alias("gone"))


def deduplicated(df: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: doc_id, n_lines, n_gone, text without the deleted lines."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    gone = repeated_lines(docs, least).select(F.col("doc_id").alias("of"), F.col("version").alias("own"), "gone")
    both = docs.withColumn("version", F.xxhash64("text")).join(gone, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("version") == F.col("own")), "left")
    both = both.select("doc_id", "text", "gone", lines(F.col("text")).alias("l"))
    # what lies between one deleted stretch and the next
    froms = F.concat(F.array(F.lit(0)), F.transform("gone", lambda x: x["last"] + 1))
    untils = F.concat(F.transform("gone", lambda x: x["line"]), F.array(F.size("l")))
    left = F.flatten(F.zip_with(froms, untils, lambda a, b: F.slice("l", a + 1, F.greatest(b - a, F.lit(0)))))
    n_gone = F.aggregate("gone", F.lit(0), lambda n, x: n + x["last"] - x["line"] + 1)
    return both.select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.size("l")).cast("long").alias("n_lines"),
        F.coalesce(n_gone, F.lit(0)).cast("long").alias("n_gone"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")).alias("text"),
    )


def _hashes(text: Column) -> Column:
    """Hashes of the words of a text."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"[^{SPACE}]+"), F.lit(0)), lambda x: F.xxhash64(x))


def _slices(a: Column, size: int, start: Column | int, end: Column) -> Column:
    """A hash of `size` elements from each place (0 is the first) from start to end."""
    return F.transform(F.sequence(start, end), lambda i: F.xxhash64(F.slice(a, i + 1, size)))


def word_windows(df: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """doc_id, fingerprint, start, end: the stretches of `least` words from the words start to end (0 is the first) have this least hash of `gram` words at one place."""
    own = df.select("doc_id", _hashes(F.col("text")).alias("h")).where(F.size("h") >= least)
    own = own.select("doc_id", _slices(F.col("h"), gram, F.lit(0), F.size("h") - gram).alias("g"))
    # the least of 2, 4, 8 and so on hashes, up to as many as a stretch has
    wide, width = 1, least - gram + 1
    while wide < width:
        step = min(wide, width - wide)
        own = own.select("doc_id", F.zip_with(F.slice("g", 1, F.size("g") - step), F.slice("g", step + 1, F.size("g")), lambda a, b: F.least(a, b)).alias("g"))
        wide += step
    cut = F.filter(F.transform("g", lambda x, i: F.when((i == 0) | (x != F.get("g", i - 1)), i)), lambda i: i.isNotNull())
    own = own.select("doc_id", "g", cut.alias("cut"))
    rows = F.transform("cut", lambda i, k: F.struct(F.get("g", i).alias("fingerprint"), i.alias("start"), (F.coalesce(F.get("cut", k + 1), F.size("g")) - 1).alias("end")))
    return own.select("doc_id", F.inline(rows))


def repeated_words(df: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """doc_id, gone: the stretches (start and end, 0 is the first word) that are deleted, apart and ascending; only texts that have any."""
    rows = written(word_windows(df, least, gram).distinct(), "wordwindows")
    position = F.struct("doc_id", "start")
    shared = rows.groupBy("fingerprint").agg(F.min(position).alias("a"), F.max(position).alias("b"))
    # stretches of a text that share their least hash without a break may repeat each other too
    shared = shared.where("a <> b").select("fingerprint").unionByName(rows.where(F.col("end") - F.col("start") >= least).select("fingerprint")).distinct()
    places = rows.join(shared, "fingerprint", "left_semi").groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("places"))
    # a text's hashes are one array that all its places are cut from, and aren't copied to a row a place
    own = df.join(places, "doc_id").select("doc_id", _hashes(F.col("text")).alias("h"), "places")
    run = lambda p: F.transform(F.sequence(p["start"], p["end"]), lambda i: F.struct(i.alias("word"), F.xxhash64(F.slice("h", i + 1, least)).alias("run")))
    runs = written(own.select("doc_id", F.inline(F.flatten(F.transform("places", run)))).distinct(), "wordruns")
    place = F.struct("doc_id", "word")
    first = runs.groupBy("run").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").drop("last")
    later = runs.join(first, "run").where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("word") >= F.col("first.word") + least))
    found = later.groupBy("doc_id").agg(F.array_sort(F.collect_set("word")).alias("w"))
    # stretches that overlap or adjoin are one: it starts at a word that is more than `least` after the one before, and ends before such a gap
    starts = F.filter("w", lambda x, k: (k == 0) | (x > F.get("w", k - 1) + least))
    ends = F.filter("w", lambda x, k: (k == F.size("w") - 1) | (x + least < F.get("w", k + 1)))
    return found.select("doc_id", F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), (b + least - 1).alias("end"))).alias("gone"))


def passages_removed(df: DataFrame, least: int = LEAST, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: doc_id, n_words, n_gone, text without the words of passages that stand at an earlier place."""
    # texts that share an id are told apart by a hash
    docs = df.select(F.struct(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("version")).alias("doc_id"), F.col(text_col).alias("text"))
    both = docs.join(repeated_words(docs, least, gram), "doc_id", "left")
    pieces = F.regexp_extract_all("text", F.lit(f"[^{SPACE}]+[{SPACE}]*"), F.lit(0))
    # what lies between one deleted stretch and the next
    froms = F.concat(F.array(F.lit(0)), F.transform("gone", lambda x: x["end"] + 1))
    untils = F.concat(F.transform("gone", lambda x: x["start"]), F.array(F.size("pieces")))
    left = F.flatten(F.zip_with(froms, untils, lambda a, b: F.slice("pieces", a + 1, F.greatest(b - a, F.lit(0)))))
    both = both.select("doc_id", "text", "gone", F.when(F.col("gone").isNotNull(), pieces).alias("pieces"))
    number = F.coalesce(F.regexp_count("text", F.lit(f"[^{SPACE}]+")), F.lit(0))
    gone = F.aggregate("gone", F.lit(0), lambda n, x: n + x["end"] - x["start"] + 1)
    kept = F.concat(F.regexp_extract("text", f"^[{SPACE}]*", 0), F.array_join(left, ""))
    return both.select(F.col("doc_id.id").alias("doc_id"), number.cast("long").alias("n_words"), F.coalesce(gone, F.lit(0)).cast("long").alias("n_gone"), F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"))
